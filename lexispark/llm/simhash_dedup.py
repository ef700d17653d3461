"""Near-duplicate documents by SimHash and pivot distance tables.

Fingerprints are taken over word shingles; equal ones are one node. Each distinct fingerprint gets the table of its Hamming distances
to fixed reference fingerprints (pivots). By the triangle inequality a pair that differs by more than the radius in any coordinate of
the tables is no link; survivors are verified by their exact distance. So that not all pairs meet, candidates share a key: the 64 bits
fall into `blocks` blocks, and two fingerprints within radius r agree in at least `blocks` - r of them, so every choice of that many
blocks is a key. No link is lost.

Within a key pairs are not emitted: a task grows trees through the links that it finds and returns their edges, at most one per
fingerprint, which give the same components. Keys with more than `tile` fingerprints are split by hash into slots; each pair of
slots is a tile of its own, so a task holds two slots of one key, whatever the size of the key.

Null and empty texts have the fingerprint zero and link to each other. Rows that repeat have the same fingerprint. The component of
documents is their smallest doc_id that is not null, or null if all are. Texts of any length are handled whole; the table may have any
other columns; an empty table has no rows. A fingerprint or a component that a third of all rows has is spread (`common.join_spread`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread, key_of, map_arrow, packed, unpacked
from .graph import components

RADIUS, BLOCKS, PIVOTS, TILE, SHINGLE = 4, 6, 16, 2048, 4
_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], "i8")


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64-bit SimHash over shingles of `size` words (A-Z lower-cased), repeats included."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], "<u8")
    lanes = h.view("u1").reshape(-1, 8)
    ones = np.stack([np.bincount(lanes[:, i], minlength=256) for i in range(8)]) @ _BITS
    return int(np.packbits(2 * ones.reshape(64) > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """key (see key_of), doc_id, fp (as signed long) of every row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t or "", size) for t in b.column("text").to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(fp)], names=["key", "doc_id", "fp"])

    return map_arrow(docs.select(key_of().alias("key"), "doc_id", "text"), run, "key long, doc_id long, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the 64-bit mixes of 1, 2, 3, ... by the SplitMix64 finaliser."""
    out = []
    for i in range(1, n + 1):
        z = i * 0x9E3779B97F4A7C15 % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        out.append(z ^ z >> 31)
    return out


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def tables(nodes: DataFrame, n: int = PIVOTS) -> DataFrame:
    """Adds the distance table of fp: its Hamming distances to n pivots (a multiple of 8), eight to a long."""
    p = pivots(n)
    for k in range(0, n, 8):
        lanes = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(x)))).cast("long"), 8 * i) for i, x in enumerate(p[k : k + 8])]
        packed = lanes[0]
        for x in lanes[1:]:
            packed = packed.bitwiseOR(x)
        nodes = nodes.withColumn(f"d{k // 8}", packed)
    return nodes


def block_keys(fp: Column, blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """Array of keys, one for each choice of blocks - radius blocks: its number and the fingerprint's bits in it."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        m = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen)
        out.append(F.struct(F.lit(k).alias("t"), fp.bitwiseAND(F.lit(signed(m))).alias("bits")))
    return F.array(*out)


def links_of(fp: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges of trees that span the components of the links among these fingerprints."""
    left = np.arange(len(fp))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = np.abs(table[left].astype("i2") - table[i]).max(1) <= radius
            some = left[near]
            some = some[np.bitwise_count(fp[some] ^ fp[i]) <= radius]
            if len(some):
                for j in some.tolist():
                    yield int(i), j
                front.extend(some.tolist())
                left = np.setdiff1d(left, some, assume_unique=True)


def _small_links(fp: np.ndarray, table: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within small groups; rows of a group follow each other. All groups at once, by the distance between rows."""
    a_all, b_all = [], []
    at = np.arange(len(fp))
    for s in range(1, len(fp)):
        at = at[at + s < len(fp)]
        at = at[group[at] == group[at + s]]
        if not len(at):
            break
        near = at[np.abs(table[at].astype("i2") - table[at + s]).max(1) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[near + s]) <= radius]
        a_all.append(near)
        b_all.append(near + s)
    none = np.zeros(0, "i8")
    return np.concatenate([none, *a_all]).astype("i8"), np.concatenate([none, *b_all]).astype("i8")


def edges(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, n_pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """a, b: edges between distinct fingerprints whose components are those of all links. nodes: fp, distinct."""
    lanes = [f"d{k}" for k in range(n_pivots // 8)]
    keyed = tables(nodes.select("fp"), n_pivots).withColumn("k", F.explode(block_keys(F.col("fp"), blocks, radius))).select("fp", *lanes, "k.t", "k.bits")
    sizes = keyed.groupBy("t", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    slots = F.ceil(F.col("n") / tile).cast("int")
    met = keyed.join(sizes, ["t", "bits"]).withColumn("slots", slots)
    met = met.withColumn("slot", F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    met = met.withColumn("lo", F.least("slot", "other")).withColumn("hi", F.greatest("slot", "other"))
    # The bits are part of the fingerprint; a row needs only the number of its tile.
    met = met.withColumn("tile", F.xxhash64("t", "bits", "lo", "hi")).select("tile", "t", "bits", "lo", "hi", "fp", *lanes)

    def run(batches):
        held = None
        for b in batches:
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "t", "bits", "lo", "hi", "fp", *lanes)}
            held = cols if held is None else {c: np.concatenate([held[c], cols[c]]) for c in cols}
            if len(held["fp"]) < 20_000:
                continue
            new = _begins(held)
            last = np.flatnonzero(new)[-1]
            if last:
                yield found({c: v[:last] for c, v in held.items()})
                held = {c: v[last:] for c, v in held.items()}
        if held is not None and len(held["fp"]):
            yield found(held)

    def _begins(c):
        new = np.ones(len(c["fp"]), bool)
        new[1:] = np.any([c[k][1:] != c[k][:-1] for k in ("tile", "t", "bits", "lo", "hi")], axis=0)
        return new

    def found(c):
        fp = c["fp"].view("u8")
        table = np.stack([c[k] for k in lanes], 1).astype("<i8").view("u1").reshape(len(fp), -1).astype("i2")
        new = _begins(c)
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        size = np.diff([*starts, len(fp)])
        small = size[group] <= 8
        at = np.flatnonzero(small)
        a, b = _small_links(fp[at], table[at], group[at], radius)
        pairs = [np.stack([at[a], at[b]], 1)]
        for s, n in zip(starts[size > 8].tolist(), size[size > 8].tolist(), strict=True):
            pairs.append(np.array([(s + i, s + j) for i, j in links_of(fp[s : s + n], table[s : s + n], radius)], "i8").reshape(-1, 2))
        ij = np.concatenate(pairs)
        x, y = c["fp"][ij[:, 0]], c["fp"][ij[:, 1]]
        # A slot pair repeats its two slots' own links in every tile; repeats go here and in distinct().
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return map_arrow(met.repartition("t", "bits", "lo", "hi").sortWithinPartitions("tile", "t", "bits", "lo", "hi"), run, "a long, b long").distinct()


def groups(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, n_pivots: int = PIVOTS, tile: int = TILE, size: int = SHINGLE) -> DataFrame:
    """key, doc_id, fp, component (its smallest fingerprint), component_id of every row."""
    rows = cut(fingerprints(docs, size))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = components(edges(nodes, radius, blocks, n_pivots, tile))
    # Only fingerprints with links are looked up; the others are components of their own.
    linked = cut(nodes.join(linked, F.col("fp") == F.col("node")).select("fp", "component", "least"))
    ids = cut(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    named = join_spread(linked.select("fp", "component"), ids, ["component"], "members")
    named = nodes.select("fp", "least", "n").join(named.withColumnRenamed("fp", "node"), F.col("fp") == F.col("node"), "left")
    named = named.select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), "n")
    return join_spread(rows, cut(named), ["fp"], "n")


def keep_one(docs: DataFrame, found: DataFrame | None = None, **how) -> DataFrame:
    """One row of docs of each group, with the columns of docs: the one of the smallest doc_id, then key. found: groups by another method."""
    best = (groups(docs, **how) if found is None else found).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("m"))
    kept = best.select(F.col("m.doc_id").alias("kept_id"), F.col("m.key").alias("kept_key"))
    # No other row has this doc_id and key but its repeats, of which one stays.
    rows = packed(docs).join(kept, (F.col("key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return unpacked(rows.dropDuplicates(["key", "doc_id"]), docs)
