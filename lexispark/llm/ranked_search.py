"""Ranked lexical search by Fagin's threshold algorithm.

`index` writes the forward index, a Parquet table in the shared folder: each document's number of terms and its different terms with
their occurrences. Document frequencies, the number of documents and that of terms are aggregates of it. A search reads it once for
each block of queries, whose terms and weights are all that goes to the tasks (a block has `BLOCK_TERMS` terms at most, or one query).
A task deals its documents into shards of bounded size. In a shard each of the block's terms has a list of documents by falling impact,
and the forward index is an array of impacts by term and document. Per query the lists are read in turn, some entries of each a round;
a document that is new is looked up in the forward index for all of the query's terms; the threshold is the sum of the last impacts
read, and once it is strictly below the k-th best score that the task has, in this or earlier shards, no further document can count.
The tasks' best are merged in two steps, so that no step has more than `FAN` tasks' rows of a query together.

Terms are runs of ASCII letters, digits and all other signs beyond ASCII, only A-Z lower-cased. A query's repeats of a term count each.
Scores are 64-bit integers. Equal scores go by doc_id, nulls last. Null and empty texts have no terms: such a document is not among the
documents that are counted, such a query has no rows. Rows that repeat are documents, or queries, each. Texts of any length are handled
whole; columns besides the id and text are not looked at; an empty table of either kind gives no rows.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, map_arrow, shared_folder

TOP, ROUND, FAN = 20, 16, 1000
#: Terms of a block of queries; impacts (terms times documents) and postings of a shard of more than one document.
BLOCK_TERMS, CELLS, POSTINGS = 20_000, 4_000_000, 1_000_000
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split()


def weight(n_docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


def forward(docs: DataFrame) -> DataFrame:
    """doc_id, n, terms (each once, joined by spaces), times (how often each stands there, unsigned 32-bit) of each document that has any."""

    def run(batches):
        for b in batches:
            found = [Counter(terms(t)) for t in b.column("text").to_pylist()]
            kept = [k for k, c in enumerate(found) if c]
            own = [found[k] for k in kept]
            columns = [pa.array([c.total() for c in own], pa.int64()), pa.array([b" ".join(c) for c in own], pa.binary()).cast(pa.string()), pa.array([array("I", c.values()).tobytes() for c in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(kept, pa.int64())), *columns], names=["doc_id", "n", "terms", "times"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, terms string, times binary")


def index(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The forward index, written to the folder (a new one in the shared folder, if not given) and read from there."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/forward-{uuid.uuid4().hex}"
    forward(docs).write.parquet(folder)
    return spark.read.parquet(folder)


class Shard:
    """Impact-sorted lists and the forward index of some documents, for the terms of a block."""

    def __init__(self, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.doc_ids = doc_ids
        self.forward = np.zeros((n_terms, doc_ids.shape[1]), "i8")
        self.forward[term, doc] = impact
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))

    def search(self, wanted: np.ndarray, times: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, step: int = ROUND) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of those given and this shard's. wanted, times: the query's terms and their repeats."""
        begin, end = self.begin[wanted], self.begin[wanted + 1]
        some = end > begin
        if not some.any():
            return best
        wanted, times, begin, end = wanted[some], times[some], begin[some], end[some]
        seen, depth = np.zeros(self.doc_ids.shape[1], bool), 0
        while True:
            left = np.minimum(begin + depth, end)
            right = np.minimum(left + step, end)
            size = right - left
            at = np.arange(size.sum()) + np.repeat(left - np.cumsum(size) + size, size)
            new = np.zeros(len(seen), bool)
            new[self.doc[at]] = True
            new = np.flatnonzero(new & ~seen)
            seen[new] = True
            scores = times @ self.forward[wanted[:, None], new]
            best = top(np.concatenate([best[0], scores]), np.concatenate([best[1], self.doc_ids[:, new]], 1), k)
            threshold = int((times * np.where(right < end, self.impact[right - 1], 0)).sum())
            if threshold == 0 or len(best[0]) == k and threshold < best[0][-1]:
                return best
            depth, step = depth + step, 2 * step


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of the scores above 0, equal ones by id. ids: whether null, and the id."""
    if len(scores) > 4 * k:
        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[some], ids[:, some]
    order = np.lexsort((ids[1], ids[0], -scores))[:k]
    order = order[scores[order] > 0]
    return scores[order], ids[:, order]


def _shards(batches, asked: pa.Array, weights: np.ndarray, n_docs: int, n_all: int, cells: int):
    """Shards of a task's documents."""
    most = max(1, cells // max(len(asked), 1))
    ids, docs, found, impacts, held, postings = [], [], [], [], 0, 0

    def shard():
        return Shard(np.concatenate(ids, 1), np.concatenate(docs), np.concatenate(found), np.concatenate(impacts), len(asked))

    for whole in batches:
        for b in (whole.slice(i, most) for i in range(0, whole.num_rows, most)):
            if held and (held + b.num_rows > most or postings > POSTINGS):
                yield shard()
                ids, docs, found, impacts, held, postings = [], [], [], [], 0, 0
            lists = pc.split_pattern(b.column("terms"), " ")
            term = pc.index_in(lists.flatten(), value_set=asked)
            some = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
            doc = pc.list_parent_indices(lists).to_numpy()[some].astype("i8")
            term = term.take(pa.array(some)).to_numpy().astype("i8")
            times = np.frombuffer(b"".join(b.column("times").to_pylist()), "<u4")[some].astype("i8")
            m = 75 + 25 * b.column("n").to_numpy() * n_docs // n_all
            ids.append(np.stack([b.column("doc_id").is_null().to_numpy(zero_copy_only=False), pc.fill_null(b.column("doc_id"), 0).to_numpy()]))
            docs.append(doc + held)
            found.append(term)
            impacts.append(weights[term] * (1_000_000_000 * times // (1000 * times + 12 * m[doc])))
            held, postings = held + b.num_rows, postings + len(doc)
    if held:
        yield shard()


def _blocks(queries: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Queries (number, id, terms with repeats) in lists of at most `most` terms, or of one query."""
    held, size = [], 0
    for q in queries:
        if held and size + len(q[2]) > most:
            yield held
            held, size = [], 0
        held.append(q)
        size += len(q[2])
    if held:
        yield held


def search(forward_index: DataFrame, queries: DataFrame, id_column: str = "item_id", k: int = TOP, block_terms: int = BLOCK_TERMS, cells: int = CELLS) -> DataFrame:
    """id_column, rank, doc_id, score: the k best documents of each query. queries: id_column, text; they are read in blocks, one at a time."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = queries.sparkSession
    whole = forward_index.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    read = ((i, r[0], Counter(terms(r[1]))) for i, r in enumerate(queries.select(id_column, "text").toLocalIterator()))
    asked = (q for q in read if q[2] and whole["docs"])
    kind = queries.schema[id_column].dataType.simpleString()
    out = None
    for block in _blocks(asked, block_terms):
        found = _searched(forward_index, block, whole["docs"], whole["all"], k, cells)
        named = spark.createDataFrame([(i, q) for i, q, _ in block], f"query long, id {kind}")
        found = cut(found.join(F.broadcast(named), "query").select(F.col("id").alias(id_column), "rank", "doc_id", "score"))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"`{id_column}` {kind}, rank int, doc_id long, score long") if out is None else out


def _searched(forward_index: DataFrame, block: list[tuple], n_docs: int, n_all: int, k: int, cells: int) -> DataFrame:
    """query, rank, doc_id, score of the queries of one block."""
    spark = forward_index.sparkSession
    names = sorted({t.decode() for _, _, x in block for t in x})
    wanted = spark.createDataFrame([(t,) for t in names], "term string")
    each = forward_index.select(F.explode(F.split("terms", " ")).alias("term")).join(F.broadcast(wanted), "term")
    frequency = {r["term"]: r["n"] for r in each.groupBy("term").agg(F.count("*").alias("n")).collect()}  # the block's terms
    names = [t for t in names if t in frequency]
    place, weights = {t: i for i, t in enumerate(names)}, np.array([weight(n_docs, frequency[t]) for t in names], "i8")
    lists = []
    for i, _, x in block:
        own = [(place[t.decode()], n) for t, n in x.items() if t.decode() in place]
        lists.append((i, np.array([p for p, _ in own], "i8"), np.array([n for _, n in own], "i8")))
    held = spark.sparkContext.broadcast((names, weights, lists))

    def run(batches):
        names, weights, lists = held.value
        best = {i: (np.zeros(0, "i8"), np.zeros((2, 0), "i8")) for i, _, _ in lists}
        for shard in _shards(batches, pa.array(names, pa.string()), weights, n_docs, n_all, cells):
            for i, terms_, times in lists:
                best[i] = shard.search(terms_, times, best[i], k)
        part = TaskContext.get().partitionId()
        for i, (scores, ids) in best.items():
            if len(scores):
                columns = [np.full(len(scores), i), np.full(len(scores), part)], pa.array(ids[1], mask=ids[0].astype(bool)), pa.array(scores)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns[0]), *columns[1:]], names=["query", "part", "doc_id", "score"])

    found = map_arrow(forward_index, run, "query long, part long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = F.row_number().over(W.partitionBy("query", F.floor(F.col("part") / FAN)).orderBy(*order))
    found = found.withColumn("r", first).filter(F.col("r") <= k)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("query", "rank", "doc_id", "score")
