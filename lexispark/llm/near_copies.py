"""Near copies by exact Jaccard similarity of word shingles.

Texts with equal sets of shingles are one node. Each node gets `BANDS` keys, each of `ROWS` minima of its shingles' hashes under
functions of their own; nodes that share a key are candidates, and candidates make groups. Two sets of similarity s share no key with
chance (1 - s^ROWS)^BANDS, 0.000012 at 0.8 and less above; nothing else is left out. Components that another method found (SimHash) may
be given; their nodes are candidates of each other, too. Every link inside a group of candidates is
verified by the exact similarity of the two sets, and the components of the links are the result.

Sets go to their group only, which is dealt out in slots, so no task holds a group, whatever its size. In a group of several slots every
set is first compared to the group's smallest node, its centre, which is linear in the group. Those linked to it are connected and are
not compared to each other; only the rest meets itself and them, in tiles of two slots, where a task grows trees through the links. So a
large group of copies costs little, and a group whose sets are not linked to its centre costs comparisons by the square of its size.

Null and empty texts are one node. A text shorter than a shingle has itself as its only shingle. Texts of any length are handled whole;
rows that repeat are one node; columns besides doc_id and text are not looked at; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread, key_of, map_arrow
from .graph import components

SHINGLE, LEAST, ROWS, BANDS, TILE, TILE_SHINGLES = 5, 0.8, 7, 48, 512, 1 << 18
_RNG = np.random.default_rng(42)
_ADD, _TIMES = (_RNG.integers(0, 2**64, ROWS * BANDS, "u8") for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words (A-Z lower-cased)."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(size, len(words))
    starts = [0, *ends[:-size].tolist()]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], "u8"))


def node_of(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view("i8"))


def bands(hashes: np.ndarray) -> list[int]:
    """Keys of a set; none for the empty one."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(len(_ADD), 2**64 - 1, "u8")
    for a in range(0, len(hashes), 256):
        least = np.minimum(least, ((hashes[a : a + 256, None] ^ _ADD) * _TIMES).min(0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), t) for t, r in enumerate(rows)], "u8").view("i8").tolist()


def links_of(sets: list[np.ndarray], least: float = LEAST) -> Iterator[tuple[int, int]]:
    """Edges of trees that span the components of the links among these sets, none of which is empty."""
    size = np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    own = [at[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    mark = np.zeros(int(at.max()) + 1, bool)
    held = left = np.arange(len(sets))
    flat, begins = at, ends - size
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            if 2 * len(left) < len(held):
                held = left
                flat = np.concatenate([own[j] for j in held.tolist()])
                begins = np.cumsum(size[held]) - size[held]
            mark[own[i]] = True
            both = np.add.reduceat(mark[flat], begins, dtype="i8")[np.searchsorted(held, left)]
            mark[own[i]] = False
            some = left[both >= least * (size[left] + size[i] - both) - 1e-9]
            for j in some.tolist():
                yield i, j
            front.extend(some.tolist())
            left = np.setdiff1d(left, some, assume_unique=True)


def attached(stars: list[np.ndarray], rest: list[np.ndarray], least: float = LEAST) -> Iterator[tuple[int, int]]:
    """Of each of rest one link to one of stars, if there is any: its number, and the star's. No set is empty."""
    size = np.array([len(s) for s in stars])
    values, at = np.unique(np.concatenate(stars), return_inverse=True)
    begins, mark = np.cumsum(size) - size, np.zeros(len(values), bool)
    for i, s in enumerate(rest):
        found = np.minimum(np.searchsorted(values, s), len(values) - 1)
        found = found[values[found] == s]
        mark[found] = True
        both = np.add.reduceat(mark[at], begins, dtype="i8")
        mark[found] = False
        linked = np.flatnonzero(both >= least * (size + len(s) - both) - 1e-9)
        if len(linked):
            yield i, int(linked[0])


def slots(of: Column, tile: int, tile_shingles: int) -> Column:
    """Into how many slots a group's sets are dealt, of those rows only where `of` holds."""
    return F.greatest(F.ceil(F.count_if(of) / tile), F.ceil(F.sum(F.when(of, F.col("n")).otherwise(0)) / tile_shingles)).cast("int")


def stars(big: DataFrame, least: float = LEAST) -> DataFrame:
    """grp, node, n, hashes, centre, star: whether the node is its group's centre or linked to it. big: sets with slots and centre.

    The centre goes to each of its group's slots, all other sets to one, and a task holds the centre and one batch.
    """
    own = F.pmod(F.xxhash64("node"), F.col("slots")).cast("int")
    to = F.when(F.col("node") == F.col("centre"), F.sequence(F.lit(0), F.col("slots") - 1)).otherwise(F.array(own))
    dealt = big.withColumn("own", own).withColumn("slot", F.explode(to))
    dealt = dealt.select("grp", "slot", "centre", "node", "n", "hashes", (F.col("slot") == F.col("own")).alias("own"), (F.col("node") != F.col("centre")).alias("later"))

    def run(batches):
        middle = None
        for b in batches:
            flags, keep = [], []
            for hashes, own, later in zip(*(b.column(c).to_pylist() for c in ("hashes", "own", "later")), strict=True):
                x = np.frombuffer(hashes, "u8")
                if not later:
                    middle = x
                both = len(np.intersect1d(x, middle, assume_unique=True))
                flags.append(both >= least * (len(x) + len(middle) - both) - 1e-9)
                keep.append(own)
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grp", "node", "n", "hashes", "centre")), pa.array(flags, pa.bool_())], names=["grp", "node", "n", "hashes", "centre", "star"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return map_arrow(dealt.repartition("grp", "slot").sortWithinPartitions("grp", "slot", "later"), run, "grp long, node long, n long, hashes binary, centre long, star boolean")


def edges(sets: DataFrame, least: float = LEAST, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """a, b: edges between nodes whose components are those of all links. sets: grp, node (distinct), n, hashes."""
    # A group that a third of all sets belong to is spread.
    sizes = sets.groupBy("grp").agg(slots(F.lit(True), tile, tile_shingles).alias("slots"), F.min("node").alias("centre"), F.count("*").alias("members"))
    dealt = join_spread(sets, cut(sizes), ["grp"], "members")
    columns, zero = ["grp", "cross", "lo", "hi", "star", "node", "hashes"], F.lit(0)
    # Groups of one slot are one tile.
    tiles = dealt.filter("slots = 1").select("grp", F.lit(False).alias("cross"), zero.alias("lo"), zero.alias("hi"), F.lit(False).alias("star"), "node", "hashes")
    # Of larger groups, what is linked to the centre needs no comparison with its like; only what is left meets all others.
    shown = cut(stars(dealt.filter("slots > 1"), least))
    sizes = shown.groupBy("grp").agg(slots(~F.col("star"), tile, tile_shingles).alias("rest_slots"), slots(F.col("star"), tile, tile_shingles).alias("star_slots"), F.count("*").alias("members"))
    met = join_spread(shown, cut(sizes.filter("rest_slots > 0")), ["grp"], "members")
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    rest, linked = met.filter("not star").withColumn("slot", slot("rest_slots")), met.filter("star")
    own = rest.withColumn("other", every("rest_slots")).withColumn("lo", F.least("slot", "other")).withColumn("hi", F.greatest("slot", "other"))
    tiles = tiles.unionByName(own.withColumn("cross", F.lit(False)).select(*columns))
    for cross in (rest.withColumn("lo", F.col("slot")).withColumn("hi", every("star_slots")), linked.withColumn("hi", slot("star_slots")).withColumn("lo", every("rest_slots"))):
        tiles = tiles.unionByName(cross.withColumn("cross", F.lit(True)).select(*columns))

    def run(batches):
        held, nodes, sets = None, ([], []), ([], [])

        def found():
            if held[1]:
                ab = [(nodes[0][i], nodes[1][j]) for i, j in attached(sets[1], sets[0], least)] if sets[0] and sets[1] else []
            else:
                ab = [(nodes[0][i], nodes[0][j]) for i, j in links_of(sets[0], least)] if len(sets[0]) > 1 else []
            ab = [sorted(x) for x in ab]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in ab], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for grp, cross, lo, hi, star, node, hashes in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if held != (grp, cross, lo, hi):
                    if held is not None:
                        yield found()
                    held, nodes, sets = (grp, cross, lo, hi), ([], []), ([], [])
                nodes[star].append(node)
                sets[star].append(np.frombuffer(hashes, "u8"))
        if held is not None:
            yield found()

    near = map_arrow(tiles.repartition("grp", "cross", "lo", "hi").sortWithinPartitions("grp", "cross", "lo", "hi"), run, "a long, b long")
    to_centre = shown.filter("star and node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return near.unionByName(to_centre).distinct()


def stars_of(rows: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: the nodes of each component in found (key, component), each with the smallest one. rows: key, node."""
    met = rows.select("key", "node").distinct().join(found.select("key", F.col("component").alias("near")).distinct(), "key")
    met = cut(met.select("node", "near").distinct())
    centres = met.groupBy("near").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return join_spread(met, cut(centres), ["near"], "n").select(F.col("node").alias("a"), "b")


def groups(docs: DataFrame, found: DataFrame | None = None, size: int = SHINGLE, least: float = LEAST, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """key (see key_of), doc_id, component (its smallest node) of every row. found: key and component of every row by another method, as candidates."""

    def sign(batches):
        for b in batches:
            all_ = [shingles(t or "", size) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array([node_of(x) for x in all_], pa.int64()), pa.array([bands(x) for x in all_], pa.list_(pa.int64()))], names=["key", "doc_id", "node", "bands"])

    def again(batches):
        for b in batches:
            all_ = [shingles(t, size) for t in b.column("text").to_pylist()]
            # A row whose key is the same by chance has other shingles.
            same = [node_of(x) == node for x, node in zip(all_, b.column("node").to_pylist(), strict=True)]
            b, all_ = b.filter(pa.array(same, pa.bool_())), [x for x, y in zip(all_, same, strict=True) if y]
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("node"), pa.array([len(x) for x in all_], pa.int64()), pa.array([x.tobytes() for x in all_], pa.binary())], names=["grp", "node", "n", "hashes"])

    keyed = docs.select(key_of().alias("key"), "doc_id", "text")
    rows = cut(map_arrow(keyed, sign, "key long, doc_id long, node long, bands array<long>"))
    # One row of each node stands for it; rows with its key hold the same text.
    nodes = rows.groupBy("node").agg(F.min("key").alias("one"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    shared = nodes.select("node", F.explode("bands").alias("band"))
    centres = shared.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").select("band", "b")
    pairs = shared.join(centres, "band").select(F.col("node").alias("a"), "b")
    candidates = components(pairs if found is None else pairs.unionByName(stars_of(rows, found)))
    asked = rows.groupBy("node").agg(F.min("key").alias("one")).join(candidates.withColumnRenamed("component", "grp"), "node")
    texts = keyed.select("key", "text").join(asked, F.col("key") == F.col("one")).select("key", "grp", "node", "text").dropDuplicates(["key"])
    linked = components(edges(cut(map_arrow(texts, again, "grp long, node long, n long, hashes binary")), least, tile, tile_shingles))
    # A node that many rows have (copies of one text) is spread.
    named = cut(nodes.select("node", "n").join(linked, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component")))
    return join_spread(rows.select("key", "doc_id", "node"), named, ["node"], "n").select("key", "doc_id", "component")
