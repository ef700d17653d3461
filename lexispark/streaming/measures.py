"""Measures of a stream: a row for each micro-batch as it is written, and the progress that Spark reports."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

BATCH = "batch long, messages long, completions long, replies long, words long, entries long, elapsed_us long"
PROGRESS = "query string, batch long, rows long, rows_per_second double, waiting_files long, waiting_bytes long, sessions long, duration_ms long"
#: Micro-batches whose progress is held.
HELD = 10_000


def observed(df: DataFrame, **sums: Column) -> tuple[DataFrame, Observation]:
    """df, and what is counted while it is computed: its rows, and the sums of some columns."""
    seen = Observation()
    named = [F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(k) for k, x in sums.items()]
    return df.observe(seen, F.count("*").alias("rows"), *named), seen


class Progress(StreamingQueryListener):
    """Gathers the progress of the session's streams: what came in, how fast, what still waits at the source, and the sessions in the state store."""

    def __init__(self, spark: SparkSession):
        self.spark, self._rows, self._lock = spark, [], threading.Lock()

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        """Nothing is measured at the start."""

    def onQueryProgress(self, event) -> None:
        p = event.progress
        waiting = [s.metrics or {} for s in p.sources]
        total = lambda k: sum(int(w.get(k, 0)) for w in waiting)
        row = (str(p.id), p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0), total("numFilesOutstanding"), total("numBytesOutstanding"), sum(s.numRowsTotal for s in p.stateOperators), int(p.batchDuration))
        with self._lock:
            self._rows = [*self._rows[-HELD + 1 :], row]

    def onQueryIdle(self, event) -> None:
        """Nothing came in."""

    def onQueryTerminated(self, event) -> None:
        """The rows stay."""

    def table(self) -> DataFrame:
        """PROGRESS: a row for each micro-batch that ended while this listened, the newest HELD."""
        with self._lock:
            return self.spark.createDataFrame(self._rows, PROGRESS)
