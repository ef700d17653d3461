"""Operator 12 against plain search for repeated windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import substring_dedup as s


def brute(rows, window):
    """Of (doc_id, text): doc_id, words, removed words, the kept text, the removed spans."""
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen, out = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1)), Counter()
    for (i, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        edges = [k for k in range(len(w) + 1) if (k > 0 and gone[k - 1]) != (k < len(w) and gone[k])]
        out[i, len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y), tuple(zip(edges[::2], edges[1::2], strict=True))] += 1
    return out


def found(df, window, **how):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], tuple((x["begin"], x["end"]) for x in r["spans"])) for r in s.repeats(df, window, **how).collect())


@pytest.mark.parametrize(("window", "how"), [(35, {}), (35, {"most": 2, "shard_words": 1500}), (4, {"most": 20, "shard_words": 4000}), (70, {})])
def test_whole_table(docs, window, how):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, window, **how) == brute(rows, window)


@pytest.mark.parametrize("window", [1, 2, 3, 35])
def test_edges(edges, nothing, window):
    rows, df = edges
    assert found(df, window) == brute([r[:2] for r in rows], window)
    assert s.repeats(nothing, window).count() == 0


def test_hot_passage_periodic_texts_and_near_misses(spark):
    """A passage in every text, texts of one or two words over and over, windows that differ in one word, odd white space, other signs."""
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "ab", "é", "漢", "x　y", "\x1c", "."])
    passage = [word() for _ in range(9)]
    rows = []
    for i in range(120):
        parts = [word() for _ in range(rng.randrange(6))] + passage + [word() for _ in range(rng.randrange(6))]
        if i % 5 == 0:
            parts[len(parts) // 2] = "other"
        rows.append((i, "".join(w + rng.choice([" ", "\n", " \t", "\x0b"]) for w in parts)))
    rows += [(500, "a " * 60), (501, "a b " * 30), (502, "b a " * 40), (503, ""), (None, None), (501, "a b " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window in (5, 9, 12):
        for how in ({}, {"most": 4, "shard_words": 60}):
            assert found(df, window, **how) == brute(rows, window)


def test_overfull_filters_lose_nothing(docs, monkeypatch):
    monkeypatch.setattr(s, "FILTER_BITS", 1 << 16)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, 12, most=3) == brute(rows, 12)


def test_index_counts_patterns():
    """Matching statistics against counting in the plain text, of patterns that no sequence's end interrupts."""
    rng = np.random.default_rng(1)
    sequences = [rng.integers(1, 6, rng.integers(1, 30)) for _ in range(40)]
    weights = rng.integers(1, 3, len(sequences))
    symbols = np.concatenate([np.append(x, 0) for x in sequences])
    index = s.FMIndex(symbols, np.concatenate([np.full(len(x) + 1, w) for x, w in zip(sequences, weights, strict=True)]), 8)
    ends = np.flatnonzero(symbols)
    got = index.statistics(symbols, ends, np.full(len(ends), 8))
    texts = ["".join(map(str, x)) for x in sequences]
    for e, n in zip(ends.tolist(), got.tolist(), strict=True):
        begin = max(np.flatnonzero(symbols[:e] == 0), default=-1) + 1
        for length in range(1, min(8, e + 1 - begin) + 1):
            pattern = "".join(map(str, symbols[e + 1 - length : e + 1]))
            count = sum(int(w) * sum(t.startswith(pattern, k) for k in range(len(t))) for t, w in zip(texts, weights, strict=True))
            assert (count >= 2) == (n >= length)
