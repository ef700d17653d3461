"""Command: `python -m lexispark build words.txt folder` makes chunks and a Parquet store, `complete store` asks it, `serve store folder out` answers a stream."""

from __future__ import annotations

import argparse
import signal
import sys
import threading
from pathlib import Path

from . import cli, config


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lexispark")
    kinds = out.add_subparsers(dest="what", required=True)
    build = kinds.add_parser("build", help="word list to chunk files and a Parquet store")
    build.add_argument("words")
    build.add_argument("folder")
    build.add_argument("--chunk-size", type=int, default=config.Dict.chunk_size)
    build.add_argument("--max-chunks", type=int, default=0)
    build.add_argument("-v", "--verbose", action="store_true")
    ask = kinds.add_parser("complete", help="completes the prefixes of standard input, one a line")
    ask.add_argument("store")
    ask.add_argument("--config")
    ask.add_argument("--limit", type=int)
    ask.add_argument("--prmin", type=int)
    ask.add_argument("--prmax", type=int)
    ask.add_argument("--no-filter", action="store_true")
    ask.add_argument("--words", type=int, help="words to load in whole chunks; 0 takes all")
    serve = kinds.add_parser("serve", help="answers the JSON lines that come into a folder, until it is told to end")
    serve.add_argument("store")
    serve.add_argument("requests")
    serve.add_argument("out")
    serve.add_argument("--checkpoint", help="by default a folder of out")
    serve.add_argument("--config")
    serve.add_argument("--words", type=int, help="words that new sessions have, in whole chunks")
    serve.add_argument("--once", action="store_true", help="ends when all that there is has been answered")
    return out


def serve(spark, args: argparse.Namespace, held: config.Config, path: Path | None) -> None:
    """Runs sessions.serve; SIGINT and SIGTERM end it after the micro-batch at work."""
    from .operators import dictionary as d
    from .operators import prefix_tree, requests
    from .sources.shared import cut
    from .streaming import sessions

    words = spark.read.parquet(args.store)
    tree, sizes = cut(prefix_tree.build(words, ("chunk_id",))), requests.chunk_sizes(words)
    budget = held.dict.max_words if args.words is None else args.words
    loaded = max(1, d.chunks_for_budget(d.chunk_info(words), budget).count())
    trigger = {"availableNow": True} if args.once else {"processingTime": "1 second"}
    query = sessions.serve(sessions.read_messages(spark, args.requests), tree, sizes, loaded, args.out, args.checkpoint or f"{args.out}/checkpoint", trigger, path, **requests.rules_of(held.server))
    ended = threading.Event()
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: ended.set())
    while not query.awaitTermination(1):
        if ended.is_set():
            query.stop()
    if query.exception():
        raise query.exception()


def rules(args: argparse.Namespace, held: config.Config) -> config.Cli:
    own = held.cli
    pick = lambda given, other: other if given is None else given
    return config.Cli(pick(args.limit, own.default_limit), pick(args.prmin, own.default_min_len), pick(args.prmax, own.default_max_len), args.no_filter or own.default_no_filter)


def main(argv: list[str] | None = None, lines=sys.stdin, out=sys.stdout) -> int:
    from pyspark.sql import SparkSession

    from .operators import dictionary as d
    from .sources import binary_chunks, chunk_source, word_lists

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lexispark").getOrCreate()
    if args.what == "build":
        words = d.positioned(word_lists.read(spark, args.words), args.chunk_size, args.max_chunks)
        chunk_source.write(words, f"{args.folder}/chunks")
        binary_chunks.store(words, f"{args.folder}/store")
        if args.verbose:
            for r in d.chunk_info(words).orderBy("id").collect():
                print(r["filename"], r["word_count"], file=out)
        return 0
    held, path = config.load(Path(args.config) if args.config else None)
    if args.what == "serve":
        serve(spark, args, held, path)
        return 0
    words = spark.read.parquet(args.store)
    if args.words:
        words = d.active(words, d.chunks_for_budget(d.chunk_info(words), args.words))
    cli.loop(words, lines, out, rules(args, held))
    return 0


if __name__ == "__main__":
    sys.exit(main())
