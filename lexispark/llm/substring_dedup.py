"""Passages that repeat, word by word, anywhere in a corpus: compressed FM-indexes per shard, searched backward over wavelet trees.

A window is `window` consecutive words of one document. So that no document need be streamed through every shard, windows are dealt by
content: a window's anchor is its leftmost `gram` of words with the least hash. Equal windows have equal anchors at the same offset.
Consecutive windows with one anchor are a segment, known by h (the anchor's hash) and g (the hash of all its words). Segments whose
anchor occurs once in the corpus cannot repeat and stay where they are. Of the others the distinct ones, with the number of their
occurrences, are dealt to shards by h. A shard builds the FM-index of its segments (suffix order by prefix tripling, the
Burrows-Wheeler transform as a wavelet matrix of packed bits with counts) and streams the segments through it: backward search from
a word gives the matching statistic of that place, the longest match that ends there and stands at two places or more. Statistics that
reach `window` are reported as a bit mask of the segment's windows, and each document that has the segment takes them from there.

What a shard holds is bounded: an anchor with more than `MOST` distinct segments is taken apart into its windows, which are counted by
their hashes. Which anchors occur twice, which segments are sent and which anchors are taken apart travels as filters of at most
`FILTER_BITS` bits; an overfull one sends more than needed, and what is not asked for is dropped where it arrives.

Words are runs without white space ([^\\x20\\x09-\\x0D]+). Null texts have none. Rows that repeat are occurrences each. Texts of any length
are handled whole; columns besides doc_id and text are not looked at; null ids stay null; an empty table has no rows. Distinct segments of
one anchor are told apart by a 64-bit hash.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread, key_of, map_arrow, parts_for, range_of

WINDOW, GRAM = 35, 5
#: Distinct segments of an anchor that a shard takes, words of a shard, bits of a filter and of one of its blocks.
MOST, SHARD_WORDS, FILTER_BITS, BLOCK_BITS = 2000, 250_000, 1 << 27, 15
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


_BYTE = _mix((np.arange(256, dtype="u8") + np.uint64(1)) * _M1)


_Q = np.uint64(0xD6E8FEB86659FD93)
_Q_INVERSE = np.uint64(pow(int(_Q), -1, 2**64))


@lru_cache(4)
def _power_table(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.cumprod(out, dtype="u8")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    return _power_table(base, 1 << max(20, (n - 1).bit_length()))[:n]


def _range_hashes(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[begin:end]."""
    sums = np.zeros(len(values) + 1, "u8")
    np.cumsum(values * _powers(_Q, len(values)), out=sums[1:])
    return (sums[ends] - sums[begins]) * _powers(_Q_INVERSE, len(values) + 1)[begins]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes; begin, end and text number of each word."""
    held = pc.fill_null(texts, "").cast(pa.large_binary())
    at = np.frombuffer(held.buffers()[1], "<i8")[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", "u1")[at[0] : at[-1]]
    at, inside = at - at[0], np.zeros(at[-1] - at[0] + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[at] = True
    begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:])) + 1
    return data, begins, ends, np.searchsorted(at, begins, "right") - 1


class Segments:
    """Segments of some texts: doc (text number), start (first word, counted over all the texts), windows, h, g."""

    def __init__(self, texts: pa.Array, window: int):
        self.data, self.begins, self.ends, self.doc_of = words_of(texts)
        n, gram = len(self.begins), gram_of(window)
        w = _mix(_range_hashes(_BYTE[self.data], self.begins, self.ends))
        none = np.zeros(0, "i8")
        self.doc = self.start = self.windows = none
        self.h = self.g = np.zeros(0, "u8")
        if n < window:
            return
        grams = np.zeros(n - gram + 1, "u8")
        for k in range(gram):
            grams = grams * _M1 + w[k : n - gram + 1 + k]
        grams = _mix(grams)
        least, place, span, need = grams, np.arange(len(grams)), 1, window - gram + 1
        while span < need:
            step = min(span, need - span)
            left = least[:-step] <= least[step:]
            place = np.where(left, place[:-step], place[step:])
            least, span = np.where(left, least[:-step], least[step:]), span + step
        whole = self.doc_of[: n - window + 1] == self.doc_of[window - 1 :]
        new = whole.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
        self.start = np.flatnonzero(new)
        last = whole.copy()
        last[:-1] &= new[1:] | ~whole[1:]
        self.windows = np.flatnonzero(last) + 1 - self.start
        # The least of many hashes is no even one: it is mixed once more.
        self.doc, self.h, self._w, self.window = self.doc_of[self.start], _mix(grams[place[self.start]] * _M1), w, window
        self.g = self.hash_of(self.start, self.start + self.windows + window - 1)

    def hash_of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from begin to end."""
        return _mix(_range_hashes(self._w, begin, end) + (end - begin).astype("u8") * _M1)

    def own(self) -> np.ndarray:
        """A hash of doc, h and g."""
        return _mix(self.h ^ (self.g * _M1) ^ (self.doc.astype("u8") * _M2))

    def words(self, k: int) -> bytes:
        """A segment's words, joined by one space."""
        a = self.start[k]
        b = a + self.windows[k] + self.window - 1
        return b" ".join(self.data[self.begins[a] : self.ends[b - 1]].tobytes().split())


def gram_of(window: int) -> int:
    """Words of an anchor: `GRAM`, but no more than a window has, and so many that a segment's windows fit a mask."""
    return max(min(GRAM, window), window - 61)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype("u8").view("i8"))


class Filter:
    """A blocked Bloom filter over 64-bit hashes, of 10 bits a hash or `FILTER_BITS` in all, whichever is less."""

    def __init__(self, hashes: DataFrame, column: str, n: int):
        bits = max(BLOCK_BITS + 1, min(FILTER_BITS.bit_length() - 1, (10 * max(n, 1)).bit_length()))
        self.shift, self.bits = np.uint64(64 - (bits - BLOCK_BITS)), np.zeros(1 << (bits - 3), "u1")
        shift, block_bytes = self.shift, 1 << (BLOCK_BITS - 3)

        def run(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                x = b.column(0).to_numpy().view("u8")
                order = np.argsort(x)
                x = x[order]
                block = (x >> shift).astype("i8")
                edges = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(x)]
                for i, j in zip(edges, edges[1:]):
                    own = held.setdefault(int(block[i]), np.zeros(block_bytes * 8, bool))
                    for at in _places(x[i:j]):
                        own[at] = True
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary())], names=["block", "bits"])

        spread = hashes.select(F.col(column).alias("x")).repartition(parts_for(n, 500_000), F.shiftrightunsigned("x", int(self.shift)))
        for r in map_arrow(spread, run, "block long, bits binary").collect():  # FILTER_BITS at most
            self.bits[r["block"] * block_bytes : (r["block"] + 1) * block_bytes] = np.frombuffer(r["bits"], "u1")

    def has(self, x: np.ndarray) -> np.ndarray:
        out, block = np.ones(len(x), bool), (x >> self.shift).astype("i8") << BLOCK_BITS
        for at in _places(x):
            at = at + block
            out &= (self.bits[at >> 3] >> (7 - (at & 7)).astype("u1") & 1).astype(bool)
        return out


def _places(x: np.ndarray):
    z = _mix(x * _M1)
    for k in range(4):
        yield (z >> np.uint64(k * BLOCK_BITS)).astype("i8") & ((1 << BLOCK_BITS) - 1)


class FMIndex:
    """FM-index of sequences of numbers from 1 on, each ended by a 0, for patterns of up to `most` symbols.

    weights: a weight of each place. Ranks come from a wavelet matrix: for each bit of a symbol a packed bit vector with running counts.
    """

    def __init__(self, symbols: np.ndarray, weights: np.ndarray, most: int):
        n, rank, span = len(symbols), symbols.astype("i8"), 1
        while span <= most:
            a, b = np.zeros(n, "i8"), np.zeros(n, "i8")
            a[: max(0, n - span)], b[: max(0, n - 2 * span)] = rank[span:] + 1, rank[2 * span :] + 1
            joint = (rank * (n + 2) + a) * (n + 2) + b
            order = np.argsort(joint)
            rank[order], span = np.cumsum(np.diff(joint[order], prepend=joint[order[0]]) != 0), span * 3
        self.levels = max(1, int(symbols.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.levels))])
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])
        text, self.bits, self.zeros = symbols[order - 1], [], []
        for level in reversed(range(self.levels)):
            one = (text >> level & 1).astype(bool)
            packed = np.zeros(n // 32 + 1, "u4")
            packed.view("u1")[: (n + 7) // 8] = np.packbits(one, bitorder="little")
            counts = np.cumsum(np.bitwise_count(packed), dtype="u8") - np.bitwise_count(packed)
            self.bits.append(counts << np.uint64(32) | packed)
            self.zeros.append(n - int(one.sum()))
            text = np.concatenate([text[~one], text[one]])
        every = np.arange(1 << self.levels)
        self.base = self.before[:-1] - self._walk(every, np.zeros(len(every), "i8"))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            held = self.bits[k].take(at >> 5, mode="clip")
            ones = (held >> np.uint64(32)).view("i8") + np.bitwise_count(held & _BELOW.take(at & 31))
            at = np.where(symbol & 1 << (self.levels - 1 - k), ones + self.zeros[k], at - ones)
        return at

    def statistics(self, symbols: np.ndarray, ends: np.ndarray, most: np.ndarray, least: int = 2) -> np.ndarray:
        """For each end (the place of a last symbol) the length of the longest match that ends there and weighs `least`, up to its `most`."""
        out, live, ends = np.zeros(len(ends), "i8"), np.arange(len(ends)), ends.copy()
        c = symbols[ends]
        low, high, length = self.before[c], self.before[c + 1], 0
        while len(live):
            kept = np.flatnonzero(self.weight[high] - self.weight[low] >= least)
            live, length = live[kept], length + 1
            out[live] = length
            kept = kept[more := most[live] > length]
            live, low, high, ends = live[more], low[kept], high[kept], ends[kept] - 1
            c = symbols[ends]
            both = self._walk(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = both[: len(c)] + self.base[c], both[len(c) :] + self.base[c]
        return out


#: The lowest k of 32 bits.
_BELOW = (np.uint64(1) << np.arange(32, dtype="u8")) - np.uint64(1)


def masks_of(texts: list[bytes], counts: np.ndarray, window: int) -> np.ndarray:
    """For each segment (words joined by one space) and its number of occurrences: a mask of its windows that stand at two places or more."""
    lengths = np.array([t.count(b" ") + 1 for t in texts], "i8")
    symbols = pa.array(b" ".join(texts).split(b" "), pa.binary()).dictionary_encode().indices.to_numpy().astype("i8") + 1
    symbols = np.insert(symbols, np.cumsum(lengths), 0)
    index = FMIndex(symbols, np.repeat(np.minimum(counts, 2), lengths + 1), int(lengths.max()))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    # The longest match at a segment's end has all windows within it. Those before it are looked at from the left, by longer and longer runs.
    match = index.statistics(symbols, begins + lengths - 1, lengths)
    left = np.where(match >= window, lengths - match, lengths - window + 1)
    out = (np.int64(1) << (lengths - window + 1)) - (np.int64(1) << left)
    live, place, run = np.flatnonzero(left), np.zeros(len(texts), "i8"), np.ones(len(texts), "i8")
    while len(live):
        n = np.minimum(run[live], left[live] - place[live])
        match = index.statistics(symbols, begins[live] + place[live] + window + n - 2, window + n - 1)
        whole = match == window + n - 1
        k = live[whole]
        out[k] |= ((np.int64(1) << n[whole]) - 1) << place[k]
        place[k], run[k] = place[k] + n[whole], 2 * run[k]
        # What stopped a single window's match is in the windows up to there, too.
        one = ~whole & (n == 1)
        place[live[one]] += window - match[one]
        run[live[~whole]] = np.maximum(n[~whole] // 2, 1)
        live = live[place[live] < left[live]]
    return out


def _rows(docs: DataFrame, window: int, twice: Filter) -> DataFrame:
    """key, h, g, windows, n: the segments of each row whose anchors may occur twice, and how often it has each."""

    def run(batches):
        for b in batches:
            s = Segments(b.column("text"), window)
            k = np.flatnonzero(twice.has(s.h))
            _, first, n = np.unique(s.own()[k], return_index=True, return_counts=True)
            k = k[first]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(s.doc[k])), longs(s.h[k]), longs(s.g[k]), pa.array(s.windows[k]), pa.array(n)], names=["key", "h", "g", "windows", "n"])

    return map_arrow(docs, run, "key long, h long, g long, windows long, n long")


def _searched(docs: DataFrame, segments: DataFrame, sent: Filter, apart: Filter, window: int, words: int, shard_words: int) -> DataFrame:
    """h, g, mask by the shards' indexes, of the segments (h, g, n) whose anchors are not taken apart."""

    def send(batches):
        for b in batches:
            s, key = Segments(b.column("text"), window), b.column("key").to_numpy().view("u8")
            k = np.flatnonzero(sent.has(s.h ^ s.g ^ key[s.doc]) & ~apart.has(s.h))
            k = k[np.unique(s.own()[k], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([longs(s.h[k]), longs(s.g[k]), pa.array([s.words(i) for i in k.tolist()], pa.binary()), pa.nulls(len(k), pa.int64())], names=["h", "g", "words", "n"])

    def search(batches):
        held = []
        for b in batches:
            while b.num_rows:
                shard = b.column("shard").to_numpy()
                more = int(np.searchsorted(shard, shard[0], "right"))
                if held and held[0].column("shard")[0].as_py() != shard[0]:
                    yield from found(held)
                    held = []
                held.append(b.slice(0, more))
                b = b.slice(more)
        if held:
            yield from found(held)

    def found(parts):
        t = pa.Table.from_batches(parts)
        h, g, n = (t.column(c).to_numpy() for c in ("h", "g", "n"))
        # Rows of a segment stand together, its count first: texts without one were not asked for, further texts are repeats.
        after = np.r_[False, (h[1:] == h[:-1]) & (g[1:] == g[:-1])]
        counted = ~np.isnan(n.astype("f8"))
        k = np.flatnonzero(after & np.r_[False, counted[:-1]] & ~counted)
        if not len(k):
            return
        texts = t.column("words").take(pa.array(k)).to_pylist()
        mask = masks_of(texts, n[k - 1].astype("i8"), window)
        k, mask = k[mask != 0], mask[mask != 0]
        yield pa.RecordBatch.from_arrays([pa.array(h[k]), pa.array(g[k]), pa.array(mask)], names=["h", "g", "mask"])

    texts = map_arrow(docs, send, "h long, g long, words binary, n long")
    rows = texts.unionByName(segments.select("h", "g", F.lit(None).cast("binary").alias("words"), "n"))
    parts = parts_for(words, shard_words)
    rows = rows.withColumn("shard", range_of(F.xxhash64("h"), parts))
    rows = rows.repartition(parts, "shard").sortWithinPartitions("shard", "h", "g", F.col("n").asc_nulls_last())
    return map_arrow(rows, search, "h long, g long, mask long")


def _counted(docs: DataFrame, segments: DataFrame, sent: Filter, apart: Filter, window: int) -> DataFrame:
    """h, g, mask of the segments whose anchors are taken apart: their windows' hashes are counted."""

    def run(batches):
        for b in batches:
            s, key = Segments(b.column("text"), window), b.column("key").to_numpy().view("u8")
            k = np.flatnonzero(apart.has(s.h))
            k = k[sent.has(s.h[k] ^ s.g[k] ^ key[s.doc[k]])]
            n = s.windows[k]
            own, place = np.repeat(k, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = s.start[own] + place
            x = s.hash_of(begin, begin + window) if len(own) else np.zeros(0, "u8")
            yield pa.RecordBatch.from_arrays([longs(s.h[own]), longs(s.g[own]), pa.array(place), longs(x)], names=["h", "g", "place", "x"])

    each = cut(map_arrow(docs, run, "h long, g long, place long, x long").distinct())
    often = cut(each.groupBy("h", "x").agg(F.count("*").alias("many")).filter("many > 1"))
    found = join_spread(each, often, ["h", "x"], "many")
    found = found.groupBy("h", "g").agg(F.bit_or(F.expr("shiftleft(1L, cast(place as int))")).alias("mask"))

    def chosen(batches):
        for b in batches:
            yield b.filter(pa.array(apart.has(b.column("h").to_numpy().view("u8"))))

    full = map_arrow(segments.filter("n > 1").select("h", "g", F.expr("shiftleft(1L, cast(windows as int)) - 1").alias("mask")), chosen, "h long, g long, mask long")
    return found.unionByName(full).groupBy("h", "g").agg(F.bit_or("mask").alias("mask"))


def repeats(docs: DataFrame, window: int = WINDOW, most: int = MOST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words outside of repeated windows, joined by one space), spans (removed words: begin, end)."""
    if window < 1:
        raise ValueError("a window has one word or more")
    texts = docs.select(key_of().alias("key"), "doc_id", "text")

    def anchors(batches):
        for b in batches:
            h, n = np.unique(Segments(b.column("text"), window).h, return_counts=True)
            yield pa.RecordBatch.from_arrays([longs(h), pa.array(n)], names=["h", "n"])

    twice = cut(map_arrow(docs.select("text"), anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"))
    rows = cut(_rows(texts, window, Filter(twice, "h", twice.count())))
    segments = cut(rows.groupBy("h", "g").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("key").alias("key"), F.first("windows").alias("windows")))
    distinct = cut(segments.groupBy("h").agg(F.count("*").alias("m"), F.max("n").alias("n")).filter("m > 1 or n > 1"))
    asked = cut(join_spread(segments, distinct.select("h", "m"), ["h"], "m"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("windows") + window), F.lit(0)).alias("words")).first()
    crowded = distinct.filter(F.col("m") > most)
    sent = Filter(asked.select(F.col("h").bitwiseXOR(F.col("g")).bitwiseXOR(F.col("key")).alias("x")), "x", size["n"])
    apart = Filter(crowded, "h", n_crowded := crowded.count())
    # Whether an anchor is taken apart is asked of the filter alone, so that all its segments go the same way.
    masks = _searched(texts, asked.select("h", "g", "n"), sent, apart, window, size["words"], shard_words)
    if n_crowded:
        masks = masks.unionByName(_counted(texts, asked, sent, apart, window))
    masks = cut(masks.groupBy("h", "g").agg(F.bit_or("mask").alias("mask")).join(asked.select("h", "g", "rows"), ["h", "g"]))
    each = join_spread(rows.select("key", "h", "g"), masks, ["h", "g"], "rows")
    marks = each.groupBy("key").agg(F.collect_set(F.struct("h", "g", "mask")).alias("marks"))

    def finish(batches):
        for b in batches:
            yield _kept(b, window)

    return map_arrow(texts.join(marks, "key", "left").select("doc_id", "text", "marks"), finish, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<begin:long,end:long>>")


def _kept(b: pa.RecordBatch, window: int) -> pa.RecordBatch:
    s, marks = Segments(b.column("text"), window), b.column("marks")
    n = len(s.begins)
    change = np.zeros(n + 1, "i8")
    flat, owner = marks.flatten(), pc.list_parent_indices(marks).to_numpy().astype("u8")
    if len(flat) and len(s.h):
        h, g, mask = (flat.field(i).to_numpy() for i in range(3))
        names = _mix(h.view("u8") ^ (g.view("u8") * _M1) ^ (owner * _M2))
        order = np.argsort(names)
        at = np.minimum(np.searchsorted(names[order], s.own()), len(order) - 1)
        k = order[at]
        own = np.flatnonzero((h[k].view("u8") == s.h) & (g[k].view("u8") == s.g) & (owner[k] == s.doc.astype("u8")))
        bit = np.arange(int(s.windows.max()))
        segment, place = np.nonzero(mask[k[own]][:, None] >> bit & 1)
        begin = s.start[own[segment]] + place
        change += np.bincount(begin, minlength=n + 1) - np.bincount(begin + window, minlength=n + 1)
    covered = np.cumsum(change)[:n] > 0
    words, removed = np.bincount(s.doc_of, minlength=b.num_rows), np.bincount(s.doc_of, covered, minlength=b.num_rows).astype("i8")
    first = np.concatenate([[0], np.cumsum(words)])
    kept, keep = [], (~covered).tolist()
    for i, text in enumerate(b.column("text").to_pylist()):
        split = (text or "").encode().split()
        kept.append(b" ".join(compress(split, keep[first[i] : first[i + 1]]) if removed[i] else split))
    # Runs of covered words, broken where another text begins.
    fresh = np.zeros(n + 1, bool)
    fresh[first] = True
    left = np.flatnonzero(covered & (fresh[:n] | ~np.r_[False, covered][:n]))
    right = np.flatnonzero(covered & (fresh[1:] | ~np.r_[covered[1:], False])) + 1
    doc = s.doc_of[left]
    spans = pa.StructArray.from_arrays([pa.array(left - first[doc]), pa.array(right - first[doc])], names=["begin", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype("i4")), spans)
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), spans], names=["doc_id", "n_words", "n_removed", "kept", "spans"])
