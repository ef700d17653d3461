"""Serving many sessions from one stream: each session's active chunks and its number of requests lie in the stream's state store.

`annotated` is a stateful step keyed by session: of each message it says which chunks its session has active, and control messages that
concern chunks are answered there. Within a micro-batch completions see what was active before it; control messages take effect in the
order of their numbers (`n`) from the next micro-batch on, as for `service.serve`, so no result hangs on the order in which rows arrive.
State is part of the stream's checkpoint: a restart goes on from it, and a micro-batch that is run again starts from the state before it
and gives the same rows.

`serve` answers each micro-batch's completions from one prefix tree by chunk, where a request merges what its session's active chunks
answer; no lists are built anew when a session changes its size. Results go to a folder per micro-batch, written again if it is.

Messages: session, n, and the columns of service.REQUEST. A null session is a session of its own. Messages without a number come first,
in the order of their ids. Sessions are independent, so one's messages within a micro-batch are handled by one task: completions pass
through as they come, only control messages, few by nature, are held.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import prefix_tree
from ..operators import requests as q
from .measures import BATCH, observed
from .service import REQUEST, parsed

OUT = "session string, n long, id string, route string, p string, l long, active long, seen long, status string, error string, current_chunks long, available_chunks long, options string"
REPLY = "session string, n long, id string, route string, status string, error string, current_chunks long, available_chunks long, options string, config_path string"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
_NUMBERS = {c.split()[0] for c in OUT.split(", ") if c.endswith(" long")}
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Actions that concern files of the host: the driver answers them.
HOST = ("rebuild_config", "get_config_path")


class Sessions(StatefulProcessor):
    """State of a session: active chunks, messages seen. sizes: words of each chunk; loaded: chunks that a new session has active."""

    def __init__(self, sizes: list[int], loaded: int):
        self.sizes, self.loaded = sizes, loaded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "active long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        active, seen = (int(x) for x in state) if state else (self.loaded, 0)
        control, before = [], active
        for some in rows:
            seen += len(some)
            names, asked = list(some.columns), []
            for row in some.itertuples(index=False, name=None):
                r = dict(zip(names, row, strict=True))
                if r["route"] == "completion":
                    asked.append(r | {"active": before})
                else:
                    control.append(r)
            if asked:
                yield self._rows(asked)
        control.sort(key=lambda r: (pd.notna(r["n"]), r["n"] if pd.notna(r["n"]) else 0, r["id"] or ""))
        said = []
        for r in control:
            message = {c: r[c] for c in ("id", "action", "chunk_count", "dictionary_size", "get_chunk_count") if isinstance(r[c], str)}
            answer = {}
            if r["route"] not in HOST:
                answer, active = q.reply(message, self.sizes, active)
                if "options" in answer:
                    answer["options"] = json.dumps(answer["options"])
            said.append(r | answer | {"id": r["id"], "active": before, "seen": seen})
        if said:
            yield self._rows(said)
        self.state.update((active, seen))

    @staticmethod
    def _rows(rows: list[dict]) -> pd.DataFrame:
        """OUT from messages as they are: most sessions have few in a micro-batch, so that work by column costs more than by value."""
        value = lambda x, c: None if x is None or x != x else int(x) if c in _NUMBERS else x
        out = np.empty((len(rows), len(_COLUMNS)), object)
        for i, r in enumerate(rows):
            out[i] = [value(r.get(c), c) for c in _COLUMNS]
        return pd.DataFrame(out, columns=_COLUMNS, copy=False)


def read_messages(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of sessions' messages from JSON lines in files of a folder."""
    return parsed(spark.readStream.options(**options).text(folder), "session", "n")


def annotated(messages: DataFrame, sizes: list[int], loaded: int) -> DataFrame:
    """A stream of OUT: completions with what their session has active; control messages with their answers."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    routed = q.route(messages)
    return routed.groupBy("session").transformWithStateInPandas(Sessions(sizes, loaded), OUT, "Append", "None")


def answers(rows: DataFrame, tree: DataFrame, **rules) -> DataFrame:
    """session, n, id, status, error, code, s (array of w, r), c, read (entries looked at): answers to the completions among annotated rows. tree: by chunk_id."""
    checked = q.validate(rows.filter("route = 'completion'").select("session", "n", "id", "p", "l", "active"), **rules)
    done = prefix_tree.complete_tree(checked, tree, by=("chunk_id",), active="active")
    s = F.transform("s", lambda x: F.struct(x["w"].alias("w"), x["r"].alias("r")))
    none = F.array().cast("array<struct<w:string,r:bigint>>")
    s = F.when(F.col("status") == "ok", s).when(F.col("status") == "empty", none)
    return done.withColumn("s", s).select("session", "n", "id", "status", "error", "code", "s", F.when(F.col("s").isNotNull(), F.size("s").cast("long")).alias("c"), "read")


def replies(rows: DataFrame, settings: Path | None = None) -> DataFrame:
    """REPLY: answers to the control messages among annotated rows. Those that concern the settings' file are answered here, on the driver."""
    columns = [c.split()[0] for c in REPLY.split(", ")]
    host, said = F.col("route").isin(*HOST), []
    for r in rows.filter(host).orderBy("session", "n", "id").toLocalIterator():
        answer, _ = q.reply({"id": r["id"], "action": r["route"]}, [], 0, settings)
        said.append(tuple(({"session": r["session"], "n": r["n"], "route": r["route"]} | answer).get(c) for c in columns))
    own = rows.filter(~host & (F.col("route") != "completion")).withColumn("config_path", F.lit(None).cast("string"))
    return own.select(*columns).unionByName(rows.sparkSession.createDataFrame(said, REPLY)) if said else own.select(*columns)


def serve(messages: DataFrame, tree: DataFrame, sizes: list[int], loaded: int, folder: str, checkpoint: str, trigger: dict | None = None, settings: Path | None = None, **rules):
    """Starts the stream; answers, replies and measures of micro-batch b are in folder/answers/batch=b, folder/replies/batch=b and
    folder/measures/batch=b. Answers have t, the microseconds that the micro-batch took for each of them. trigger: Spark's triggers, by
    default all that there is, then the end. settings: the file of the settings in use."""

    def batch(df: DataFrame, number: int) -> None:
        began, rows = time.monotonic(), df.persist()
        done, seen = observed(answers(rows, tree, **rules), words=F.col("c"), entries=F.col("read"))
        done = done.persist()
        n, all_ = done.count(), rows.count()
        took = int((time.monotonic() - began) * 1e6)
        done.withColumn("t", F.lit(took // max(n, 1)).cast("long")).write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")
        replies(rows, settings).write.mode("overwrite").parquet(f"{folder}/replies/batch={number}")
        said = df.sparkSession.createDataFrame([(number, all_, n, all_ - n, seen.get["words"], seen.get["entries"], took)], BATCH)
        said.drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{folder}/measures/batch={number}")
        done.unpersist()
        rows.unpersist()

    stream = annotated(messages, sizes, loaded).writeStream.foreachBatch(batch).outputMode("append")
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
