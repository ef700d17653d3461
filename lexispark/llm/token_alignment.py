"""Alignment of two tokenizers' tokens over the same bytes, by a dangling-suffix transducer.

The transducer reads the tokens of both sides. Its state is the side that leads and the bytes that the other has yet to match; it reads
the next token of the side behind, and where nothing is left unmatched both end at one byte: a group closes. Transitions are memoised by
state and next token. As both tokenizers break before a space or a newline that follows a word, texts are dealt with in such pieces;
each different piece of a worker is encoded and aligned once, and a text's groups are its pieces' in order.

Two tokens are linked where they share a group. A pair of ids counts once for each document that has it linked. A first pass writes each
row's groups digest, counts, and its different pairs with their numbers of links, as a table in the shared folder; pairs are counted over
that table; the `KNOWN` most frequent pairs, a table of bounded size, then go to every task, and what rows have of other pairs, each of
which few rows have, is joined to the counts by a shuffle. A group's pairs come from its different ids on either side, with products of
their frequencies; they are never written out by occurrence.

Null and empty texts, and those whose tokens' bytes differ from a space and the text, have no tokens: zeros, and no groups. Rows that
repeat are documents each. Texts of any length are handled whole, in bounded pieces wherever they have spaces; columns besides doc_id and
text are not looked at; null ids stay null; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, shared_folder
from .token_counts import _rules

#: Pairs that go to every task; pairs, pieces and their code points that a task holds.
KNOWN, PAIRS_HELD, HELD, HELD_CHARS = 1_000_000, 1_000_000, 350_000, 8_000_000
_EDGE = re.compile(r"(?<=\S)(?=[ \n])")
#: Signs that some tokenizers take for white space and others don't: a piece that ends with one of them does not end for sure.
_UNSURE = frozenset(map(chr, (0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
END = (0, b"")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others for what follows 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Groups of two token sequences with equal bytes. bytes_a, bytes_b: the bytes of each id. States are numbered; the end of a group is 0."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.bytes = bytes_a, bytes_b
        self.clear()

    def clear(self) -> None:
        self.states, self.number, self.next, self.leads, self.known = [END], {END: 0}, [{}], [False], 0

    def after(self, state: tuple[int, bytes], token: int) -> tuple[int, bytes] | None:
        """The state after the next token of the side behind, or None where the bytes differ. side: 1 if A leads, -1 if B does, 0 at the end of a group."""
        side, residual = state
        raw = self.bytes[side == 1][token]
        if not side:
            return (1, raw) if raw else END
        if residual.startswith(raw):
            return (side, residual[len(raw) :]) if len(raw) < len(residual) else END
        return (-side, raw[len(residual) :]) if raw.startswith(residual) else None

    def step(self, state: int, token: int) -> int:
        """`after` by the states' numbers, kept; -1 where the bytes differ."""
        found = self.after(self.states[state], token)
        if found is None:
            return -1
        if found not in self.number:
            self.number[found] = len(self.states)
            self.states.append(found)
            self.next.append({})
            self.leads.append(found[0] == 1)
        self.next[state][token] = self.number[found]
        self.known += 1
        return self.number[found]

    def cuts(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of either side are read where each group ends, or None where the bytes differ."""
        if self.known > HELD:
            self.clear()
        if not a and not b:
            return [], []
        # A token that no side has ends each side: no transition leads on from there.
        n, m, a, b = len(a), len(b), [*a, -1], [*b, -1]
        cut_a, cut_b, state, i, j, following, leads = [], [], 0, 0, 0, self.next, self.leads
        while True:
            if leads[state]:
                token = b[j]
                j += 1
            else:
                token = a[i]
                i += 1
            known = following[state].get(token)
            if known is None:
                if token < 0 or (known := self.step(state, token)) < 0:
                    return None
            state = known
            if not state and j > (cut_b[-1] if cut_b else 0):
                cut_a.append(i)
                cut_b.append(j)
                if i == n and j == m:
                    return cut_a, cut_b


class Aligner:
    """Pieces of texts, encoded and aligned once each. A piece's number is its place in the lists."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocabulary = byte_letters(), {i: p for p, i in self.a.get_vocab(with_added_tokens=True).items()}
        raw_a = [bytes(letters[c] for c in vocabulary.get(i, "") if c in letters) for i in range(max(vocabulary) + 1)]
        self.n_b = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.transducer, self.size_a = Transducer(raw_a, raw_b), np.array([len(x) for x in raw_a])
        # A vocabulary with a space inside a piece, or one that knows newlines, could join what stands on both sides of an edge.
        self.pieces_join = any("▁" in p.lstrip("▁") or "\n" in p for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.quick = quick_encoder(path_a, raw_a)
        # How ids are written: the first of a piece, of a group, and further ones; then the first and further ones of the other side.
        n = len(raw_a), self.n_b
        self.written = [x + str(i).encode() for x, k in ((b"\n", 0), (b";", 0), (b",", 0), (b"|", 1), (b",", 1)) for i in range(n[k])]
        self.begin = [0, n[0], 2 * n[0], 3 * n[0], 3 * n[0] + n[1]]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.unsure: set[int] = set()
        self.chars, self.said, self._new = 0, [], []
        self._flat = np.zeros((0, 5), "i8"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece tokens of either side, groups, links, and 1 where the bytes differ; how many pairs it has; all pieces' pairs and their links."""
        if self._new:
            self._flat, self._new = tuple(np.concatenate(x) for x in zip(self._flat, *self._new, strict=True)), []
        return self._flat

    def split(self, text: str, plain: bool = True) -> list[str]:
        """The pieces of a space and the text; a piece that a space begins is given without it. plain: its words' ends are sure."""
        if self.pieces_join:
            return ["\x00 " + text]
        if plain and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ("  ", " \n", "\n ", "\n\n")):
            return text.replace("\n", " \n").split(" ")
        parts = []
        for p in _EDGE.split(" " + text):
            if parts and parts[-1][-1] in _UNSURE:
                parts[-1] += p
            else:
                parts.append(p)
        return [p[1:] if p[0] == " " and p[1:2] not in ("", " ", "\n") else p if p[0] == "\n" else "\x00" + p for p in parts]

    def numbers(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's pieces; those that are not known yet are encoded and aligned."""
        split = [self.split(t) if t else [] for t in texts]
        known = self.number
        self._add(list(dict.fromkeys([p for x in split for p in x if p not in known])))
        out = [list(map(known.__getitem__, x)) for x in split]
        for k, x in enumerate(out):
            if self.unsure and not self.unsure.isdisjoint(x):
                split = self.split(texts[k], False)
                self._add([p for p in dict.fromkeys(split) if p not in known])
                out[k] = list(map(known.__getitem__, split))
        return out

    def _add(self, new: list[str]) -> None:
        whole = [p[1:] if p[0] == "\x00" and p[1:2] in (" ", "\n") else p if p[0] == "\n" else " " + p for p in new]
        # Plain pieces are encoded in one go: white space begins them, their end is sure, and all engines agree on their letters.
        plain = [self.quick is not None and x[-1] not in _UNSURE and x[-1] not in " \n" and max(x) < "\u0530" and not self.pieces_join for x in whole]
        some = [p for p, y in zip(new, plain, strict=True) if y]
        texts = [x for x, y in zip(whole, plain, strict=True) if y]
        first = next((k for k, x in enumerate(texts) if x[0] == " "), 0)
        if texts:
            some.insert(0, some.pop(first))
            texts.insert(0, texts.pop(first))
        if not texts or texts[0][0] != " " or not self._block(some, texts, self.quick("".join(texts)), self.b.encode("".join(texts)[1:])):
            plain = [False] * len(new)
        for p, x in ((p, x) for p, x, y in zip(new, whole, plain, strict=True) if not y):
            # The second tokenizer puts a space before what it gets; behind a newline, which no piece holds, it encodes what stands there.
            own = self.pieces_join or x[0] == " " and x[1:2] not in ("", " ", "\n")
            b = self.b.encode(x[1:]) if own else self.b.encode("\n" + x)[len(self.b.encode("\n")) :]
            self._block([p], [x], self.a.encode(x, add_special_tokens=False).ids, b)

    def _block(self, names: list[str], texts: list[str], a: list[int], b: list[int]) -> bool:
        """Adds pieces whose ids stand one after the other in a and b; False, and none added, where the ids do not fall to the pieces."""
        cuts = self.transducer.cuts(a, b)
        if cuts is None and len(names) > 1:
            return False
        n, ids_a, ids_b = len(names), np.array(a, "i8"), np.array(b, "i8")
        end_a, end_b = (np.array(x, "i8") for x in cuts or ([], []))
        at = np.concatenate([[0], np.cumsum(self.size_a[ids_a])])[end_a]
        ends = np.cumsum([len(t.encode()) for t in texts])
        piece = np.searchsorted(ends, at)
        if cuts is not None and not np.array_equal(ends, at[np.flatnonzero(np.append(piece[1:] != piece[:-1], True))]):
            return False
        n_a, n_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        groups = np.bincount(piece, minlength=n)
        sizes = [np.bincount(piece, x, n).astype("i8") for x in (n_a, n_b)] + [groups, np.bincount(piece, n_a * n_b, n).astype("i8"), np.full(n, cuts is None)]
        for k, p in enumerate(names):
            self.number[p] = len(self.said) + k
            if p[-1] in _UNSURE:
                self.unsure.add(len(self.said) + k)
        self.chars += sum(map(len, names))
        self.said += self._said(ids_a, ids_b, n_a, n_b, piece) if cuts is not None else [b""] * n
        own, code, links = self._pairs(ids_a, ids_b, n_a, n_b, piece)
        self._new.append((np.stack(sizes, 1).astype("i8"), np.bincount(own, minlength=n), code, links))
        return True

    def _said(self, a, b, n_a, n_b, piece) -> list[bytes]:
        """The groups of each piece as text."""
        first = np.append(True, piece[1:] != piece[:-1])
        group = np.concatenate([np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)])
        of_a, of_b = np.full(len(a), self.begin[2]), np.full(len(b), self.begin[4])
        at = np.cumsum(n_a) - n_a
        of_a[at] = np.where(first, self.begin[0], self.begin[1])
        of_b[np.cumsum(n_b) - n_b] = self.begin[3]
        order = np.argsort(2 * group + np.repeat([0, 1], [len(a), len(b)]), kind="stable")
        written = np.concatenate([a + of_a, b + of_b])[order]
        return b"".join(map(self.written.__getitem__, written.tolist()))[1:].split(b"\n")

    def _pairs(self, a, b, n_a, n_b, piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, code and links of the different pairs of each piece, in the pieces' order."""
        begin_a, begin_b, n = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
        small = np.flatnonzero(n <= 4096)
        size = n[small]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        g = np.repeat(small, size)
        keys, times = [(a[begin_a[g] + place // n_b[g]] * self.n_b + b[begin_b[g] + place % n_b[g]])], [np.ones(len(g), "i8")]
        pieces = [piece[g]]
        for k in np.flatnonzero(n > 4096).tolist():  # a long group: its different ids, and products of how often they stand there
            (i, x), (j, y) = (np.unique(z[s : s + m], return_counts=True) for z, s, m in ((a, begin_a[k], n_a[k]), (b, begin_b[k], n_b[k])))
            keys.append((i[:, None] * self.n_b + j).ravel())
            times.append((x[:, None] * y).ravel())
            pieces.append(np.full(len(keys[-1]), piece[k]))
        code, pieces = np.concatenate(keys), np.concatenate(pieces)
        span = len(self.size_a) * self.n_b
        key, links = _summed(pieces * span + code, np.concatenate(times))
        return *np.divmod(key, span), links


def quick_encoder(path: str, raw: list[bytes]):
    """An encoder of whole texts at once with the ids of a byte-level BPE file, or None where the file's merges do not go by its ids."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocabulary = said["model"]["vocab"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in said["model"].get("merges", [])]
    if not _rules(path)[0] or [vocabulary.get(m) for m in merged] != list(range(256, 256 + len(merged))) or len(vocabulary) < 256 + len(merged):
        return None
    ranks = {raw[i]: i for i in range(256 + len(merged))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(values, first)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row (its number), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes (of its different pairs: A id * B's vocabulary + B id), links (of each), the last two as little-endian longs and unsigned 32-bit numbers."""
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "links"]

    def run(batches):
        own, row = _aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for b in batches:
            if len(own.said) > HELD or own.chars > HELD_CHARS:
                own.clear()
            numbers = own.numbers(b.column("text").to_pylist())
            n = np.array([len(x) for x in numbers])
            flat, doc = np.concatenate([*numbers, np.zeros(0, "i8")]).astype("i8"), np.repeat(np.arange(len(n)), n)
            (sizes, n_held, held_codes, held_links), wrong = own.held(), np.zeros(len(n), bool)
            wrong[doc[sizes[flat, 4] == 1]] = True
            sums = np.stack([np.bincount(doc, sizes[flat, k], len(n)).astype("i8") for k in range(4)])
            sums[:, wrong] = 0
            said = ["" if w or not x else hashlib.sha256(b";".join([own.said[k] for k in x])).hexdigest() for x, w in zip(numbers, wrong.tolist(), strict=True)]
            # Different pieces of each row, then the sums of their pairs.
            each, times = np.unique((doc * len(own.said) + flat)[~wrong[doc]], return_counts=True)
            doc, piece = np.divmod(each, max(len(own.said), 1))
            begin, n_pairs = (np.cumsum(n_held) - n_held)[piece], n_held[piece]
            place = np.arange(n_pairs.sum()) - np.repeat(np.cumsum(n_pairs) - n_pairs, n_pairs) + np.repeat(begin, n_pairs)
            codes, links = held_codes[place], held_links[place]
            pair, names_of = np.unique(codes, return_inverse=True) if len(place) else (codes, place)
            key, total = _summed(np.repeat(doc, n_pairs) * max(len(pair), 1) + names_of, links * np.repeat(times, n_pairs))
            doc, code = np.divmod(key, max(len(pair), 1))
            edge = np.searchsorted(doc, np.arange(len(n) + 1)).tolist()
            codes, links = pair[code].astype("<i8"), total.astype("<u4")
            columns = [
                pa.array(np.arange(row, row + len(n))), b.column("doc_id"), *map(pa.array, sums), pa.array(said, pa.string()),
                pa.array([codes[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary()), pa.array([links[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary()),
            ]
            row += len(n)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs.select("doc_id", "text"), run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, links binary")


def counts(rows: DataFrame) -> DataFrame:
    """code, n: the number of rows that have each pair."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(np.frombuffer(b"".join(b.column("codes").to_pylist()), "<i8"))
            size += len(held[-1])
            if size > 4 * PAIRS_HELD:
                yield most(held)
                held, size = [], 0
        yield most(held)

    def most(held):
        code, n = np.unique(np.concatenate([*held, np.zeros(0, "i8")]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    return map_arrow(rows.select("codes"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def compare(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, known: int = KNOWN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    default = default_paths()
    path_a, path_b = path_a or default[0], path_b or default[1]
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/aligned-{uuid.uuid4().hex}"
    # The written table fixes the numbers of the rows.
    aligned(docs, path_a, path_b).write.parquet(folder)
    rows = spark.read.parquet(folder)
    pairs = cut(counts(rows))
    # One row for each id of the first vocabulary, at most.
    pairs = pairs.withColumn("a", F.expr(f"code div {_b_size(path_b)}"))
    best = pairs.groupBy("a").agg(F.max("n").alias("most"))
    pairs = cut(pairs.join(F.broadcast(best), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")))
    often = pairs.orderBy(F.desc("n"), "code").limit(known)
    table = often.orderBy("code").toArrow()
    held = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "n", "best")))

    def parts(b):
        """Row number, code, links, place in the known table and whether it is there, of each pair of a batch."""
        code = np.frombuffer(b"".join(b.column("codes").to_pylist()), "<i8")
        links = np.frombuffer(b"".join(b.column("links").to_pylist()), "<u4").astype("i8")
        size = np.array([len(x) // 8 for x in b.column("codes").to_pylist()], "i8")
        names = held.value[0]
        at = np.minimum(np.searchsorted(names, code), max(len(names) - 1, 0))
        return np.repeat(np.arange(len(size)), size), code, links, at, names[at] == code if len(names) else np.zeros(len(code), bool)

    def sums(batches):
        for b in batches:
            row, _, links, at, there = parts(b)
            _, n, best = held.value
            row, links, at = row[there], links[there], at[there]
            total = [np.zeros(b.num_rows, "i8"), np.zeros(b.num_rows, "i8")]
            np.add.at(total[0], row, links * best[at])
            np.add.at(total[1], row, links * n[at])
            kept = [b.column(c) for c in named]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, total)], names=[*named, "n_best", "count_sum"])

    def rest(batches):
        for b in batches:
            row, code, links, _, there = parts(b)
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(row[~there])), pa.array(code[~there]), pa.array(links[~there])], names=["row", "code", "links"])

    named = [c for c in rows.columns if c not in ("codes", "links")]
    out = map_arrow(rows, sums, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if table.num_rows == known:
        rare = map_arrow(rows.select("row", "codes", "links"), rest, "row long, code long, links long").join(pairs, "code")
        rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("b"), F.sum(F.col("links") * F.col("n")).alias("c"))
        out = out.join(rare, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("b", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("c", F.lit(0))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@lru_cache(2)
def _b_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
