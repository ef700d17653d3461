"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of what a Python worker handles at once, unless one row has more.
BATCH_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lexispark", None):
        return
    top = Path(__file__).resolve().parents[1]
    sc._lexispark = str(Path(tempfile.mkdtemp(prefix="lexispark-")) / "lexispark.zip")
    with zipfile.ZipFile(sc._lexispark, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(sc._lexispark)


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order in batches of at most `most` bytes, or of one row."""
    for b in batches:
        left = [b]
        while left:
            x = left.pop()
            if x.num_rows < 2 or x.nbytes <= most:
                yield x
            else:
                half = x.num_rows // 2
                left += [x.slice(half), x.slice(0, half)]


def _give_back() -> None:
    """Returns freed memory to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in this C library
        return


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow with batches of at most `most` bytes; Spark's own batches, as the session sets them, are cut up in the worker."""
    ship(df.sparkSession)

    def run(batches):
        yield from fn(slices(batches, most))
        _give_back()

    return df.mapInArrow(run, schema)


def batch(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode, where they are one process, may it be unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return named or held.get()
    if not named and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = named or tempfile.mkdtemp(prefix="lexispark-")
    sc.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate files, wherever Spark can reach it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that nothing upstream runs twice and a lost executor costs no more than its task."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a row, together with its doc_id: rows that agree in doc_id and text are one document. Tells null from empty."""
    return F.xxhash64(F.col(doc_id), F.col(text).isNull(), F.col(text))


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id, key: no column of the table can clash with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), key_of().alias("key"))


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs from `row`, those named in new (if docs has them) by a new value, in the type that they had."""
    return rows.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """left joined to right on keys (null equals null), also where one key holds a third of all rows.

    right has one row per key and in column n (dropped) how many rows of left have it. Keys with over 1/share of left's rows are at
    most `share`, whatever the table's size, so their rows of right are broadcast and their rows of left stay where they are; all
    other keys are shuffled. how: inner, left_semi or left. left is read twice, so it should come from a checkpoint or a cheap scan.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(how)
    total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    least = max(1, total // share)
    named = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(named)
    hot, cold = right.filter(F.col(n) > least).drop(n), right.filter(F.col(n) <= least).drop(n)
    same = F.lit(True)
    for k, other in named.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    by_hot = F.broadcast(hot)
    if how == "left_semi":
        return left.join(by_hot, same, how).unionByName(left.join(F.broadcast(hot.select(*named.values())), same, "left_anti").join(cold, same, how))
    found = left.join(by_hot, same, "inner").drop(*named.values())
    rest = left.join(F.broadcast(hot.select(*named.values())), same, "left_anti")
    return found.unionByName(rest.join(cold, same, how).drop(*named.values()))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text falls in fold 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def parts_for(rows: int, per_part: int) -> int:
    return max(1, -(-rows // per_part))


def range_of(hashed: Column, parts: int) -> Column:
    """Which of so many equal ranges a hash (taken as unsigned) falls in; ranges and hashes have the same order."""
    return F.shiftright(F.shiftrightunsigned(hashed, 33) * F.lit(parts).cast("long"), 31).cast("int")


def running_total(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows before this one in (bucket, order) within its groups, whatever the size of a group.

    Buckets are summed first; only the few bucket totals are accumulated in one window, rows only within their bucket.
    """
    from pyspark.sql import Window as W

    totals = df.groupBy(*groups, bucket).agg(F.sum(value).alias("__bucket_sum"))
    before = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__bucket_sum").over(before), F.lit(0)))
    totals = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(bucket).alias("__b"), "__before")
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inner = W.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(totals, same & (F.col(bucket) == F.col("__b")), "left")
    return joined.withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("__before", "__b", *[f"__g{i}" for i in range(len(groups))])
