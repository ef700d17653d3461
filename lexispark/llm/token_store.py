"""Token ids in seekable files: independent zstandard frames, a document index and a trailing seek table with a checksum per frame.

A file holds frames of whole documents' ids (little-endian unsigned integers), then a skippable frame with the document index
(magic 0x184D2A50), then the seek table of the public seekable format (skippable frame 0x184D2A5E: for each frame its compressed size,
decompressed size and the low 32 bits of XXH64 of its content; footer: number of frames, descriptor 0x80, 0x8F92EAB1).
Any zstandard reader that skips skippable frames decompresses the whole; `Reader` decompresses the requested documents' frames only.

Documents lie in ascending doc_id order (nulls first, rows that repeat next to each other) in files numbered in that order, whose
names, sizes and smallest and largest ids are in a manifest, so that a reader opens only the files of the documents asked for.

Null texts count as empty; texts of any length are handled whole; columns besides doc_id and text are not looked at; an empty table
makes no file. The quick way to encode, by words, is taken only for files with the normaliser, pre-tokeniser and model kind that it
knows (see `_by_words`); any other tokenizer file encodes whole texts.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, cut, map_arrow, parts_for, shared_folder


INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, FILE_BYTES = 1 << 18, 256 << 20
#: Bytes of text that a task encodes and writes, and what it handles at once.
TASK_BYTES, AT_ONCE_BYTES = 128 << 20, 8 << 20
END_ID = 1


class Writer:
    """Writes one file; `out` is a binary stream."""

    def __init__(self, out, dtype: str = "<u2", frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.dtype, self.frame_bytes = out, dtype, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=3, write_checksum=False)
        self.held, self.size, self.frames, self.docs, self.written = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((-(1 << 63) if doc_id is None else doc_id, len(ids) // np.dtype(self.dtype).itemsize, len(self.frames), doc_id is None))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._frame()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _frame(self) -> None:
        import xxhash

        raw = b"".join(self.held)
        packed = self.zip.compress(raw)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._put(packed)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held or (self.docs and self.docs[-1][2] == len(self.frames)):
            self._frame()
        docs = np.array(self.docs, "<i8").reshape(-1, 4)
        index = self.zip.compress(docs.T.tobytes())
        head = self.dtype.encode().ljust(4) + struct.pack("<Q", len(docs))
        self._put(struct.pack("<II", INDEX_MAGIC, len(head) + len(index)) + head + index)
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self._put(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class Reader:
    """Reads one file by `read(offset, length)` of its `size` bytes; decompresses frames only as documents of them are asked for."""

    def __init__(self, read, size: int):
        import zstandard

        self.read, self.unzip, self._last = read, zstandard.ZstdDecompressor(), (-1, b"")
        n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end")
        self.frames = np.frombuffer(read(size - 9 - 12 * n, 12 * n), "<u4").reshape(-1, 3)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0].astype("i8"))])
        begin = int(self.at[-1])
        magic, length = struct.unpack("<II", read(begin, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index")
        body = read(begin + 8, length)
        self.dtype, (count,) = body[:4].decode().strip(), struct.unpack("<Q", body[4:12])
        self.doc_ids, self.lengths, self.frame_of, self.nulls = np.frombuffer(self.unzip.decompress(body[12:]), "<i8").reshape(4, count) if count else np.zeros((4, 0), "i8")
        self.without_id = int(self.nulls.sum())
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.frame_start = np.concatenate([[0], np.cumsum(self.frames[:, 1].astype("i8"))]) // np.dtype(self.dtype).itemsize

    def frame(self, k: int) -> bytes:
        import xxhash

        if self._last[0] != k:
            raw = self.unzip.decompress(self.read(int(self.at[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} fails its checksum")
            self._last = (k, raw)
        return self._last[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        k = int(self.frame_of[i])
        begin = int(self.starts[i] - self.frame_start[k])
        return np.frombuffer(self.frame(k), self.dtype)[begin : begin + int(self.lengths[i])]

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of each row with this doc_id."""
        return [self.ids(i) for i in self.places(doc_id)]

    def places(self, doc_id: int) -> range:
        """Numbers of the rows with this doc_id; those without one come first in a file."""
        held = self.doc_ids[self.without_id :]
        return range(self.without_id + int(np.searchsorted(held, doc_id, "left")), self.without_id + int(np.searchsorted(held, doc_id, "right")))


def _filesystem(uri: str):
    """The file system of a shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def open_reader(uri: str):
    files, path = _filesystem(uri)
    source = files.open_input_file(path)

    def read(offset: int, length: int) -> bytes:
        source.seek(offset)
        return source.read(length)

    return Reader(read, source.size())


#: Signs that may follow a word; a run of them is a piece of its own, whatever letter or digit stands before it.
_TAIL = ".,;:!?)]}\""
#: Letters that stay one letter in any form, and those and digits.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
_LATIN, _BEFORE_TAIL = re.compile(f"[{_LETTERS}]+"), re.compile(f"[{_LETTERS}0-9]")
#: Words that a worker holds before it starts anew, and the longest that it holds (code points).
HELD, LONGEST = 800_000, 48
#: Words of one call, so that its offsets and pieces stay small.
_AT_ONCE = 8192
#: The pre-tokeniser's pattern that the rules for words here are made for.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(path: str) -> bool:
    """Whether the tokenizer file drops white space, parts words by the pattern known here and marks the ends of words."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    steps = said.get("normalizer") or {}
    kinds = [x.get("type") for x in steps.get("normalizers", [])]
    splits = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
    patterns = [(x.get("pattern") or {}).get("Regex") for x in splits if x.get("type") == "Split"]
    others = [x for x in splits if x.get("type") != "Split"]
    level = len(others) == 1 and others[0].get("type") == "ByteLevel" and not others[0].get("add_prefix_space") and not others[0].get("use_regex")
    return kinds == ["NFC", "Replace", "Lowercase"] and patterns == [_KNOWN_SPLIT] and level and said["model"].get("end_of_word_suffix") == "</w>"


class _Words:
    """Packed ids of words, by way of their forms without trailing signs and in lower case.

    Plain words (Latin letters only) are one piece each, so many are encoded as one text, whose ids are parted after each token that
    ends a word. Words longer than the memo holds are encoded anew in each batch. Only plain words in ASCII are lower-cased here:
    other words could turn into special strings, or their marks compose otherwise than in the tokenizer's own order.
    """

    def __init__(self, tokenizer, dtype: str, usable: bool = True):
        self.tokenizer, self.dtype, self.usable, self.held = tokenizer, dtype, usable, {}
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def pack(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forms(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word as it is looked up, and the signs after it."""
        stems = pc.utf8_rtrim(words, characters=_TAIL)
        shorter = pc.less(pc.binary_length(stems), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        some = pa.array(shorter)
        tails, parted = np.full(len(words), "", object), np.zeros(len(words), bool)
        at = np.flatnonzero(shorter)
        for i, w, n in zip(at.tolist(), _strings(words.filter(some)), pc.utf8_length(stems.filter(some)).to_pylist(), strict=True):
            if n and _BEFORE_TAIL.match(w[n - 1]):
                tails[i], parted[i] = w[n:], True
        stems = pc.if_else(pa.array(parted), stems, pc.if_else(some, words, stems))
        low = pc.and_(pc.string_is_ascii(stems), pc.utf8_is_alpha(stems))
        return pc.if_else(low, pc.ascii_lower(stems), stems), pa.array(tails, pa.string())

    def plain(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        if len(cuts) != len(words):
            return self.pack(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def encode(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if _LATIN.fullmatch(w)]
        for k in range(0, len(plain), _AT_ONCE):
            some = plain[k : k + _AT_ONCE]
            for i, v in zip(some, self.plain([words[i] for i in some]), strict=True):
                out[i] = v
        other = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(other, self.pack([words[i] for i in other]), strict=True):
            out[i] = v
        return out

    def values(self, words: list[str]) -> list[bytes]:
        """Packed ids of each of these different words; long ones are not held."""
        held = self.held
        if len(held) > HELD:
            held.clear()
        out = list(map(held.get, words))
        missing = [i for i, v in enumerate(out) if v is None]
        new = [words[i] for i in missing]
        coded = self.encode(new)
        held.update((w, v) for w, v in zip(new, coded, strict=True) if len(w) <= LONGEST)
        for i, v in zip(missing, coded, strict=True):
            out[i] = v
        return out


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def _words(texts: pa.Array) -> pa.ListArray:
    """The texts parted at spaces, tabs and line ends, all of which the tokenizer drops."""
    for space in "\n\r\t":
        texts = pc.replace_substring(texts, space, " ")
    return pc.split_pattern(texts, " ")


def _looked_up(parts: pa.ListArray, words: _Words) -> list[bytes]:
    """Packed ids of each list of words: each distinct form is looked up once, its ids are dealt to its places as arrays."""
    size = np.dtype(words.dtype).itemsize
    coded = parts.flatten().dictionary_encode()
    if not len(coded.dictionary):
        return [b""] * len(parts)
    stems, tails = (x.dictionary_encode() for x in words.forms(coded.dictionary))
    values = words.values(_strings(stems.dictionary)) + words.values(_strings(tails.dictionary))
    lengths = np.fromiter(map(len, values), "i8", len(values)) // size
    ids, starts = np.frombuffer(b"".join(values), words.dtype), np.cumsum(lengths) - lengths
    # Two places a word: its stem and its tail.
    both = np.stack([stems.indices.to_numpy(), tails.indices.to_numpy() + len(stems.dictionary)], 1)
    at = both[coded.indices.to_numpy()].reshape(-1)
    n = lengths[at]
    ends = np.cumsum(n)
    raw = ids[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1])].tobytes()
    last = 2 * np.cumsum(pc.list_value_length(parts).to_numpy())
    cuts = [0, *(np.concatenate([[0], ends])[last] * size).tolist()]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(2)
def _encoder(path: str, dtype: str):
    """Words of a tokenizer file, and its special strings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return _Words(tokenizer, dtype, _by_words(path)), special


def encode_texts(texts: pa.Array, path: str, dtype: str) -> list[bytes]:
    """Packed ids of each text."""
    words, special = _encoder(path, dtype)
    if not words.usable:
        return words.pack(_strings(texts))
    # Strings and bytes make no cycles; the collector would only walk the long lists of them.
    gc.disable()
    try:
        ids = _looked_up(_words(texts), words)
    finally:
        gc.enable()
    for i in {i for s in special for i in pc.indices_nonzero(pc.match_substring(texts, s)).to_pylist()}:
        ids[i] = words.pack([texts[i].as_py()])[0]
    return ids


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """doc_id, ids (packed as dtype, with the end id) of every row. dtype must hold the vocabulary's largest id."""
    path = path or default_path()

    def run(batches):
        end = np.array([end_id], dtype).tobytes()
        for b in batches:
            ids = [x + end for x in encode_texts(b.column("text"), path, dtype)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, ids binary", AT_ONCE_BYTES)


def in_ranges(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """doc_id, text in ranges of (doc_id, hash of the text), sorted; as many ranges as the texts' bytes ask for, so no range grows with the table."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    # Small tables are dealt out finer, so that all cores have work.
    busy = min(parts_for(total, task_bytes // 8), 4 * docs.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = rows.withColumn("h", F.xxhash64("text"))
    return rows.repartitionByRange(max(busy, parts_for(total, task_bytes)), *order).sortWithinPartitions(*order, "text").drop("h")


_MANIFEST = {"part": pa.int32(), "roll": pa.int32(), "name": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64(), "least": pa.int64(), "most": pa.int64()}


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, dtype: str = "<u2", frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES, per_file: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Encodes every row, writes the files below `folder` and returns their manifest: part, roll, name, n_docs, n_ids, least and most doc_id.

    A task sorts a range of documents, encodes and writes it; it begins a new file after `file_bytes` (or `per_file` documents). It
    writes under a name of its own and renames when the file is whole, so a task that runs again leaves the same files.
    """
    path = path or default_path()

    def run(batches):
        from pyspark import TaskContext

        files, top = _filesystem(folder)
        state, part = {}, TaskContext.get().partitionId()
        end_of_doc = np.array([end_id], dtype).tobytes()

        def begin(roll):
            temp = f"{top}/.part-{uuid.uuid4().hex}"
            out = files.open_output_stream(temp)
            state.update(roll=roll, temp=temp, out=out, writer=Writer(out, dtype, frame_bytes))

        def end():
            w = state["writer"]
            w.close()
            state["out"].close()
            name = f"ids-{part:06d}-{state['roll']:05d}.zst"
            files.move(state["temp"], f"{top}/{name}")
            named = [x[0] for x in w.docs if not x[3]]
            row = (part, state["roll"], name, len(w.docs), int(sum(x[1] for x in w.docs)), min(named, default=None), max(named, default=None))
            state.clear()
            return batch(list(_MANIFEST), list(_MANIFEST.values()), [[x] for x in row])

        files.create_dir(top, recursive=True)
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode_texts(b.column("text"), path, dtype), strict=True):
                if state and (state["writer"].written >= file_bytes or (per_file and len(state["writer"].docs) >= per_file)):
                    roll = state["roll"] + 1
                    yield end()
                    begin(roll)
                elif not state:
                    begin(0)
                state["writer"].add(doc_id, ids + end_of_doc)
        if state:
            yield end()

    return cut(map_arrow(in_ranges(docs, task_bytes), run, "part int, roll int, name string, n_docs long, n_ids long, least long, most long", AT_ONCE_BYTES))


def read(manifest: DataFrame, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids_crc32, from the files; of some doc_ids only if they are given.

    Files are dealt to tasks by a hash, so a task reads one or a few; of given doc_ids only the files whose range holds one are opened.
    """
    spark = manifest.sparkSession
    base = W.partitionBy("part").orderBy("roll").rowsBetween(W.unboundedPreceding, -1)
    # One row a part meets in one window, and a part's few files in theirs.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    files_ = manifest.withColumn("inside", F.coalesce(F.sum("n_ids").over(base), F.lit(0))).join(parts, "part")
    files_ = files_.select("name", (F.col("before") + F.col("inside")).alias("base"), "least", "most")
    if doc_ids is None:
        files_ = files_.select("name", "base", F.lit(None).cast("array<bigint>").alias("wanted"))
    else:
        asked = spark.createDataFrame([(int(d),) for d in sorted(set(doc_ids))], "d long")
        files_ = files_.join(F.broadcast(asked), F.col("d").between(F.col("least"), F.col("most"))).groupBy("name", "base").agg(F.sort_array(F.collect_list("d")).alias("wanted"))

    def run(batches):
        for b in batches:
            for name, begin, wanted in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                r = open_reader(f"{folder.rstrip('/')}/{name}")
                which = range(len(r.doc_ids)) if wanted is None else [i for d in wanted for i in r.places(d)]
                yield batch(
                    ["doc_id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4,
                    [[None if r.nulls[i] else int(r.doc_ids[i]) for i in which], [begin + int(r.starts[i]) for i in which], [int(r.lengths[i]) for i in which], [zlib.crc32(r.ids(i).astype("<u4").tobytes()) for i in which]],
                )

    # A number of its own, which AQE does not merge: a row here stands for a whole file.
    return map_arrow(files_.repartition(parts_for(manifest.count(), 1), "name"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
