"""The request loop as a stream: JSON lines of requests in, answers out; control messages change the active chunks between batches."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.exprs import trim_unicode
from ..operators import requests as q

REQUEST = "id string, p string, l long, action string, chunk_count string, dictionary_size string, get_chunk_count string"


def parsed(lines: DataFrame, *more: str) -> DataFrame:
    """The columns of REQUEST, after those of `more` (session: text, n: a number), from JSON lines (value).

    A field of a wrong type is null, and so are all of a line that is no JSON. Numbers lose their fractions; counts of chunks may be texts.
    """
    v = F.try_parse_json("value")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    text = lambda name: F.when(kind(name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
    whole = lambda name: F.when(kind(name) == "BIGINT", F.try_variant_get(v, f"$.{name}", "long"))
    number = lambda name: F.coalesce(whole(name), F.when(kind(name).rlike("^(DOUBLE|DECIMAL)"), F.try_variant_get(v, f"$.{name}", "double").try_cast("long")))
    either = lambda name: F.when(kind(name).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN)"), F.try_variant_get(v, f"$.{name}", "string"))
    read = {"session": text, "n": number, "id": text, "p": text, "l": number, "action": text, "chunk_count": either, "dictionary_size": either, "get_chunk_count": either}
    return lines.select(*[read[c](c).alias(c) for c in (*more, *[x.split()[0] for x in REQUEST.split(", ")])])


def read_requests(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of requests from JSON lines in files of a folder."""
    return parsed(spark.readStream.options(**options).text(folder))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of prefixes from text lines: trimmed, blank ones left out."""
    return spark.readStream.text(folder).select(trim_unicode(F.col("value")).alias("p")).filter("p <> ''")


def completions(requests: DataFrame, lists: DataFrame, **rules) -> DataFrame:
    """Answers to a stream of completion requests: a stream-static join, without state."""
    return q.answer(requests.select("id", "p", "l"), lists, **rules)


REPLY = "id string, status string, error string, current_chunks long, available_chunks long, options string, config_path string"
#: Messages between two readings of the settings.
RELOAD = 100


def _state_file(spark: SparkSession, checkpoint: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint, "active-chunks")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def recall(spark: SparkSession, checkpoint: str, loaded: int) -> int:
    """The number of active chunks that an earlier run of the stream left beside its checkpoint, else `loaded`."""
    files, path = _state_file(spark, checkpoint)
    if not files.exists(path):
        return loaded
    stream = files.open(path)
    n = stream.readInt()
    stream.close()
    return n


def remember(spark: SparkSession, checkpoint: str, loaded: int) -> None:
    files, path = _state_file(spark, checkpoint)
    stream = files.create(path, True)
    stream.writeInt(loaded)
    stream.close()


def serve(
    requests: DataFrame, dictionary: DataFrame, lists_of: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], loaded: int, checkpoint: str,
    replies: Callable[[DataFrame], None] | None = None, settings: Callable[[], tuple[Config, Path | None]] | None = None,
):
    """Runs a stream of all messages. Within a micro-batch completions see the chunks that were active before it; control messages,
    few by nature, are answered in order on the driver, and what they set holds from the next batch on and over restarts.

    sink gets the answers to completions; replies (sink, if not given) a table of the control messages' answers. settings is read at
    the start and again after every `RELOAD` messages.
    """
    spark = dictionary.sparkSession
    state = {"loaded": recall(spark, checkpoint, loaded), "lists": None, "for": None, "seen": 0, "read_at": None, "rules": {}, "path": None}

    def batch(df: DataFrame, _: int) -> None:
        routed = q.route(df).persist()
        if settings and (state["read_at"] is None or state["seen"] - state["read_at"] >= RELOAD):
            config, state["path"] = settings()
            state["rules"], state["read_at"] = q.rules_of(config.server), state["seen"]
        state["seen"] += routed.count()
        if state["for"] != state["loaded"]:
            if state["lists"] is not None:
                state["lists"].unpersist()
            state["lists"], state["for"] = lists_of(dictionary.filter(F.col("chunk_id") <= state["loaded"])).persist(), state["loaded"]
        sink(q.answer(routed.filter("route = 'completion'").select("id", "p", "l"), state["lists"], **state["rules"]))
        said = []
        for r in routed.filter("route <> 'completion'").toLocalIterator():
            reply, state["loaded"] = q.manage({k: v for k, v in r.asDict().items() if v is not None}, dictionary, state["loaded"], state["path"])
            state["last"] = reply
            said.append(reply)
        if said:
            rows = [tuple(json.dumps(x[f]) if f == "options" and f in x else x.get(f) for f in ("id", "status", "error", "current_chunks", "available_chunks", "options", "config_path")) for x in said]
            (replies or sink)(spark.createDataFrame(rows, REPLY))
            remember(spark, checkpoint, state["loaded"])
        routed.unpersist()

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), state
