"""Operator 13 against whole texts encoded by the libraries, cut where both sides' tokens end."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexispark.llm import queries
from lexispark.llm import token_alignment as t


@lru_cache(1)
def libraries():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@lru_cache(1)
def letters():
    """Bytes of the byte-level letters, as they stand in the order of their code points."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


def groups(text):
    """Lists of A and B ids, or None."""
    if not text:
        return None
    a, b = libraries()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(letters()[c] for c in a.id_to_token(i)) for i in x]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    whole = (" " + text).encode()
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return None
    ends = []
    for raw in (raw_a, raw_b):
        at, own = 0, []
        for r in raw:
            at += len(r)
            own.append(at)
        ends.append(own)
    out, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
        out.append((x[i:k], y[j:m]))
        i, j = k, m
    return out


def brute(rows):
    each = [groups(text) for _, text in rows]
    count, best, out = Counter(), defaultdict(int), Counter()
    for g in each:
        count.update({(i, j) for x, y in g or () for i in x for j in y})
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    for (doc_id, _), g in zip(rows, each, strict=True):
        links = [(i, count[i, j]) for x, y in g or () for i in x for j in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or ())
        digest = hashlib.sha256(said.encode()).hexdigest() if g else ""
        out[doc_id, sum(len(x) for x, _ in g or ()), sum(len(y) for _, y in g or ()), len(g or ()), len(links), sum(n == best[i] for i, n in links), sum(n for _, n in links), digest] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_query(spark, sf_dir, texts):
    got = queries.op13_token_alignment(spark, sf_dir)
    assert dict(got.dtypes) == {c: "bigint" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")} | {"groups_sha256": "string"}
    assert found(got) == brute(list(texts.items()))


@pytest.mark.parametrize("known", [t.KNOWN, 30])
def test_edges(edges, nothing, known):
    rows, df = edges
    assert found(t.compare(df, known=known)) == brute([r[:2] for r in rows])
    assert t.compare(nothing, known=known).count() == 0


def test_random_texts(spark, monkeypatch):
    """White space that the tokenizers take in different ways, signs that one side alone writes by bytes, special strings, the sign for a space."""
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "ß", "!?", "　", "漢字", "\U0001f600", "\x1c", "\x00", "▁", "<s>", "<0x41>", "<|endoftext|>", "᠎", "​", "\xa0", "\x85", "foo", "ing", "́", "x" * 9, "\r\n", "   ", "====", "﻿"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(700)]
    rows += [(800, " "), (801, "\n"), (802, "a" * 300 + " " * 70 + "b"), (803, "no such word\n" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(t.compare(df, known=100)) == brute(rows)


def test_transducer():
    a, b = [b"ab", b"c", b"def", b"", b"x"], [b"a", b"bcd", b"ef", b"x"]
    own = t.Transducer(a, b)
    assert own.cuts([0, 1, 2, 4], [0, 1, 2, 3]) == ([3, 4], [3, 4])
    assert own.after((1, b"ab"), 0) == (1, b"b") and own.after((1, b"b"), 1) == (-1, b"cd") and own.after((-1, b"cd"), 1) == (-1, b"d")
    assert own.cuts([0], [0]) is own.cuts([0], [1]) is own.cuts([4], [0]) is own.cuts([], [0]) is None and own.cuts([], []) == ([], [])
    before = own.known
    own.cuts([0, 1, 2, 4], [0, 1, 2, 3])
    assert own.known == before


def test_long_groups_and_files_of_other_kinds(spark, monkeypatch):
    """A group of thousands of tokens, and the way that takes no pieces together."""
    rows = [(1, "漢" * 90 + "x" * 400 + " ab ab"), (2, "ab cd"), (3, "x y" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(t.compare(df)) == brute(rows)
    own = t.Aligner(*t.default_paths())
    a, b = np.arange(300) % 7, np.arange(200) % 5
    piece, code, links = own._pairs(a, b, np.array([300]), np.array([200]), np.array([0]))
    assert links.sum() == 60_000 and len(code) == 35 and set(piece.tolist()) == {0}
    own.quick = None
    other = t.Aligner(*t.default_paths())
    for x in (own, other):
        x.numbers([r[1] for r in rows])
    assert own.said and {p: own.said[k] for p, k in own.number.items()} == {p: other.said[k] for p, k in other.number.items()}
