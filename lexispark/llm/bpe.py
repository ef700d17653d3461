"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is dealt out as overlapping chunks of `chunk` code points (a text up to that length is one chunk). Chunks are pre-tokenised in
parallel; each chunk's right overlap reaches past the next place where the pattern must break, so that the boundaries of neighbours meet
there. Stitching, on boundaries alone, gives each chunk the pre-tokens from the first boundary that it has in common with its
predecessor to the first that it has in common with its successor. Only then are the pieces encoded, each chunk's own in parallel, each
different piece of a worker once, and a text's ids are put together in order. Decoding concatenates the raw bytes of the ids.

Null texts count as empty: no ids. Rows that repeat are encoded each; a null doc_id stays null. Texts of any length are handled whole;
columns besides doc_id and text are not looked at; an empty table has no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, map_arrow, parts_for

CHUNK, OVERLAP = 32_768, 256
#: Pieces that a worker holds before it starts anew, and the longest that it holds (code points).
HELD, LONGEST = 300_000, 48
#: Chunks of long texts that a task pre-tokenises or encodes.
CHUNKS_PER_TASK = 64
_BREAK = re.compile(r"\S[ \n]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(2)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def windows(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Begin and end of the overlapping chunks. Each reaches past the first sure break after the next chunk's begin."""
    n = len(text)
    for begin in range(0, n, chunk):
        end, m = n, _BREAK.search(text, min(n, begin + chunk))
        if m:
            end = min(n, max(begin + chunk + overlap, m.end() + 2))
        yield begin, end


def pretokenise(text: str, begin: int, whole: bool) -> np.ndarray:
    """Boundaries of the pieces (in the document), first and last included; pieces that more text could change are left out."""
    ends = [m.end() for m in _pattern().finditer(text)]
    if not whole:
        while ends and ends[-1] >= len(text) - 1:
            ends.pop()
    return np.array([0, *ends], "<i8") + begin


def stitch(bounds: list[np.ndarray], begins: list[int], wholes: list[bool]) -> Iterator[tuple[int, np.ndarray]]:
    """Number and own boundaries of each chunk that has pieces of its own, in order; wholes: whether a chunk ends with the text."""
    now, at = 0, 0
    while now is not None:
        until, then = None, None
        for j in range(now + 1, len(bounds)):
            common = np.intersect1d(bounds[now][bounds[now] >= max(at, begins[j])], bounds[j], assume_unique=True)
            if len(common):
                until, then = int(common[0]), j
                break
        if until is None and not wholes[now]:
            raise ValueError("chunks do not meet")
        own = bounds[now][bounds[now] >= at]
        yield now, own if until is None else own[own <= until]
        now, at = then, until


@lru_cache(2)
def _held(path: str) -> dict[str, bytes]:
    return {}


def encode_pieces(texts: list[list[str]], path: str) -> list[bytes]:
    """Packed ids of each list of pieces. Long pieces are not held for the next call."""
    held, coded = _held(path), encoding(path).encode_ordinary
    if len(held) > HELD:
        held.clear()
    long = {}
    for p in {p for t in texts for p in t}.difference(held):
        (held if len(p) <= LONGEST else long)[p] = array("I", coded(p)).tobytes()
    if long:
        return [b"".join([held[p] if p in held else long[p] for p in t]) for t in texts]
    return [b"".join(map(held.__getitem__, t)) for t in texts]


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit little-endian) of every row. decoded: with the SHA-256 of the bytes that the ids decode to."""
    return _encoded(docs, path or default_path(), chunk, overlap, ("decoded_sha256",) if decoded else (), True)


def _encoded(docs: DataFrame, path: str, chunk: int, overlap: int, digests: tuple[str, ...], ids_too: bool) -> DataFrame:
    names, types = ["doc_id", "n_tokens"], [pa.int64(), pa.int64()]
    if ids_too:
        names, types = [*names, "ids"], [*types, pa.binary()]
    names, types = [*names, *digests], [*types, *[pa.string()] * len(digests)]

    # Digests are taken in the workers that hold the ids: another mapInArrow after them would double the workers of an executor.
    def coded_rows(doc_ids, ids):
        columns = [doc_ids, [len(x) // 4 for x in ids]]
        if ids_too:
            columns.append(ids)
        if digests:
            raw, said = _tables(path)
            numbers = [np.frombuffer(x, "<u4") for x in ids]
            of = {"ids_sha256": (said, b" "), "decoded_sha256": (raw, b"")}
            columns += [[hashlib.sha256(of[d][1].join(of[d][0][x].tolist())).hexdigest() for x in numbers] for d in digests]
        return batch(names, types, columns)

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'string' if n in digests else 'long'}" for n in names)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def one_chunk(batches):
        split = _pattern().findall
        for b in batches:
            yield coded_rows(b.column("doc_id").to_pylist(), encode_pieces([split(t) for t in b.column("text").to_pylist()], path))

    def deal(batches):
        for b in batches:
            for key, doc_id, text in zip(b.column("key").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k, (begin, end) in enumerate(windows(text, chunk, overlap)):
                    yield batch(["key", "doc_id", "k", "begin", "whole", "piece"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string()], [[key], [doc_id], [k], [begin], [end == len(text)], [text[begin:end]]])

    def boundaries(batches):
        for b in batches:
            done = [np.diff(pretokenise(t, 0, w)).astype("<u4").tobytes() for t, w in zip(b.column("piece").to_pylist(), b.column("whole").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "k", "begin", "whole")), pa.array(done, pa.binary())], names=["key", "k", "begin", "whole", "lengths"])

    def meet(batches):
        key, held = None, ([], [], [], [])

        def out():
            own = [(held[0][i], int(x[0]) - held[1][i], np.diff(x).astype("<u4").tobytes()) for i, x in stitch(held[3], held[1], held[2])]
            return batch(["key", "k", "skip", "lengths"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()], [[key] * len(own), *map(list, zip(*own, strict=True))])

        for b in batches:
            for r in b.to_pylist():
                if held[0] and r["key"] != key:
                    yield out()
                    held = ([], [], [], [])
                key = r["key"]
                bounds = np.concatenate([[0], np.cumsum(np.frombuffer(r["lengths"], "<u4").astype("i8"))]) + r["begin"]
                for x, v in zip(held, (r["k"], r["begin"], r["whole"], bounds), strict=True):
                    x.append(v)
        if held[0]:
            yield out()

    def encode_own(batches):
        for b in batches:
            pieces = []
            for text, skip, lengths in zip(*(b.column(c).to_pylist() for c in ("piece", "skip", "lengths")), strict=True):
                ends = list(accumulate(np.frombuffer(lengths, "<u4").tolist(), initial=skip))
                pieces.append([text[x:y] for x, y in zip(ends, ends[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "doc_id", "k")), pa.array(encode_pieces(pieces, path), pa.binary())], names=["key", "doc_id", "k", "ids"])

    def join_up(batches):
        key, doc_id, parts = None, None, []
        for b in batches:
            for r in b.to_pylist():
                if parts and r["key"] != key:
                    yield coded_rows([doc_id], [b"".join(parts)])
                    parts = []
                key, doc_id = r["key"], r["doc_id"]
                parts.append(r["ids"])
        if parts:
            yield coded_rows([doc_id], [b"".join(parts)])

    size = F.char_length("text")
    brief = map_arrow(rows.filter(size <= chunk), one_chunk, schema)
    long = rows.filter(size > chunk)
    n = long.agg(F.coalesce(F.sum(F.ceil(size / chunk)), F.lit(0))).first()[0]
    if not n:
        return brief
    # Numbers of partitions by the number of chunks: their bytes say little of the work. The checkpoint fixes the keys.
    tasks = parts_for(n, CHUNKS_PER_TASK)
    dealt = map_arrow(long.withColumn("key", F.monotonically_increasing_id()), deal, "key long, doc_id long, k int, begin long, whole boolean, piece string")
    dealt = cut(dealt.repartition(tasks, "key", "k"))
    met = map_arrow(dealt, boundaries, "key long, k int, begin long, whole boolean, lengths binary").repartition(tasks, "key").sortWithinPartitions("key", "k")
    own = map_arrow(met, meet, "key long, k int, skip long, lengths binary")
    coded = map_arrow(dealt.repartition(tasks, "key", "k").join(own.repartition(tasks, "key", "k"), ["key", "k"]), encode_own, "key long, doc_id long, k int, ids binary")
    return brief.unionByName(map_arrow(coded.repartition(tasks, "key").sortWithinPartitions("key", "k"), join_up, schema))


def decode(ids: np.ndarray, path: str | None = None) -> bytes:
    return b"".join(_tables(path or default_path())[0][ids].tolist())


@lru_cache(4)
def _tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Raw bytes and decimal digits of each id, as arrays of objects."""
    of = ranks(path)
    raw, said = (np.empty(max(of.values()) + 1, object) for _ in range(2))
    for b, i in of.items():
        raw[i], said[i] = b, b"%d" % i
    return raw, said


def coded_digests(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """As digests(encode(docs)), made where the ids are, which then need not leave the workers."""
    return _encoded(docs, path or default_path(), chunk, overlap, ("ids_sha256", "decoded_sha256"), False)


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the decimal ids and of the bytes that the ids decode to."""
    path = path or default_path()

    def run(batches):
        raw, said = _tables(path)
        for b in batches:
            ids = [np.frombuffer(x, "<u4") for x in b.column("ids").to_pylist()]
            a = [hashlib.sha256(b" ".join(said[x].tolist())).hexdigest() for x in ids]
            d = [hashlib.sha256(b"".join(raw[x].tolist())).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(encoded, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
