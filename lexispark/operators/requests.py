"""Requests: validation, routing and answers of the server, the command line and the browser entry."""

from __future__ import annotations

from itertools import accumulate
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_PATH, rebuild
from ..functions.exprs import SERVER_MAX_LIMIT, is_valid_input, server_limit
from . import dictionary as d
from .complete import complete_batch

MIN_PREFIX, MAX_PREFIX = 1, 60


def validate(requests: DataFrame, least: int = MIN_PREFIX, most: int = MAX_PREFIX, filtered: bool = True, max_limit: int = SERVER_MAX_LIMIT) -> DataFrame:
    """Adds status (ok, empty: answered without words, error), error and code, in the order of the checks; and the clamped limit l."""
    n, p = F.octet_length("p"), F.coalesce("p", F.lit(""))
    error = (
        F.when(p == "", "empty prefix").when(n < least, f"prefix too short (min: {least})").when(n > most, f"prefix too long (max: {most})")
    )
    bad = F.lit(filtered) & ~is_valid_input(p)
    out = requests.withColumn("error", error).withColumn("code", F.when(F.col("error").isNotNull(), 400).cast("long"))
    out = out.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(bad, "empty").otherwise("ok"))
    return out.withColumn("l", server_limit(F.coalesce(F.col("l"), F.lit(0)), max_limit).cast("long"))


def answer(requests: DataFrame, lists: DataFrame, **rules) -> DataFrame:
    """id, status, error, code, s (array of w, r), c: the server's answers to a table or a stream of completion requests."""
    checked = validate(requests, **rules)
    done = complete_batch(checked, lists)
    s = F.when(F.col("status") == "ok", F.transform("s", lambda x: F.struct(x["w"].alias("w"), x["r"].alias("r"))))
    none = F.array().cast("array<struct<w:string,r:bigint>>")
    return done.withColumn("s", F.when(F.col("status") != "error", F.coalesce(s, none))).withColumn("c", F.when(F.col("status") != "error", F.size("s").cast("long"))).select("id", "status", "error", "code", "s", "c")


def route(messages: DataFrame) -> DataFrame:
    """Adds route: by action first, then dictionary_size, get_chunk_count, p; other messages are tried as completions."""
    known = F.col("action").isin("get_info", "get_options", "set_size", "get_chunk_count", "rebuild_config", "get_config_path")
    return messages.withColumn(
        "route",
        F.when(F.col("action").isNotNull(), F.when(known, F.col("action")).otherwise("unknown_action"))
        .when(F.col("dictionary_size").isNotNull(), "set_size").when(F.col("get_chunk_count").isNotNull(), "get_chunk_count").otherwise("completion"),
    )


def rules_of(server) -> dict:
    """The settings of config.Server as rules of validate and answer."""
    return {"least": server.min_prefix, "most": server.max_prefix, "filtered": server.enable_filter, "max_limit": server.max_limit}


def chunk_number(x) -> int | None:
    """A number of chunks as messages give it (whole, with a fraction that is cut off, or digits), or None."""
    try:
        return None if isinstance(x, bool) else int(float(x)) if not isinstance(x, str) or "." in x else int(x)
    except (TypeError, ValueError, OverflowError):
        return None


def reply(message: dict, sizes: list[int], loaded: int, settings: Path | None = None) -> tuple[dict, int]:
    """Answer to one control message, and the number of chunks that are active after it. sizes: words of each chunk, in the chunks' order."""
    answer_, action = {"id": message.get("id", ""), "status": "ok"}, message.get("action")
    if action is None and "dictionary_size" in message:
        action = "set_size"
    if action == "get_info":
        return answer_ | {"current_chunks": loaded, "available_chunks": len(sizes)}, loaded
    if action == "get_options":
        words = accumulate(sizes)
        return answer_ | {"options": [{"chunk_count": i, "word_count": n, "size_label": f"{n // 1000}K words"} for i, n in enumerate(words, 1)]}, loaded
    if action == "get_chunk_count" or (action is None and "get_chunk_count" in message):
        return answer_ | {"available_chunks": len(sizes)}, loaded
    if action == "set_size":
        asked = chunk_number(message.get("chunk_count"))
        if asked is None or asked < 1:
            return answer_ | {"status": "error", "error": "invalid chunk_count"}, loaded
        return answer_ | {"current_chunks": (n := min(asked, len(sizes)))}, n
    if action == "rebuild_config":
        try:
            rebuild(settings or DEFAULT_PATH)
        except OSError as e:
            return answer_ | {"status": "error", "error": f"Failed to rebuild config file: {e}"}, loaded
        return answer_, loaded
    if action == "get_config_path":
        return answer_ | {"config_path": str(settings or DEFAULT_PATH)}, loaded
    return answer_ | {"status": "error", "error": f"unknown action: {action}"}, loaded


def chunk_sizes(dictionary: DataFrame) -> list[int]:
    """Words of each chunk, in the chunks' order: one number a chunk."""
    return [r["word_count"] for r in d.chunk_info(dictionary).orderBy("id").collect()]


def manage(message: dict, dictionary: DataFrame, loaded: int, settings: Path | None = None) -> tuple[dict, int]:
    """reply, for the chunks of a dictionary."""
    return reply(message, chunk_sizes(dictionary), loaded, settings)
