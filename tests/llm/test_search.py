"""Operator 11 against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import queries
from lexispark.llm import ranked_search as r


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=20):
    """Multiset of (item_id, rank, doc_id, score)."""
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n, every, frequency = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n) // every
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * frequency[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out.update((item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1))
    return out


def found(df):
    return Counter(tuple(x) for x in df.select(df.columns[0], "rank", "doc_id", "score").collect())


def test_query(spark, sf_dir, texts):
    items = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op11_ranked_search(spark, sf_dir)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert found(got) == brute(list(texts.items()), items)


@pytest.mark.parametrize("how", [{}, {"block_terms": 5, "cells": 40}, {"k": 2, "cells": 1}])
def test_edges(spark, edges, nothing, how, tmp_path):
    """Nulls, ties, repeated rows and items, odd signs; blocks of one item, shards of few documents."""
    rows, df = edges
    items = [(1, "The no quick QUICK fox"), (2, None), (None, "straße 12 i̇"), (3, ""), (1, "The no quick QUICK fox"), (4, "unheard-of"), (5, "x" * 5000 + " ab CD end the"), (6, "ab")]
    asked = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    index = r.index(df.unionByName(df.filter("doc_id in (9, 4)")), str(tmp_path / "index"))
    more = [x[:2] for x in rows] + [x[:2] for x in rows if x[0] in (9, 4)]
    assert found(r.search(index, asked, **how)) == brute(more, items, how.get("k", 20))
    assert r.search(index, asked.limit(0)).count() == r.search(r.index(nothing), asked).count() == 0
    with pytest.raises(ValueError):
        r.search(index, asked, k=0)


def test_random_ties(spark):
    rng = random.Random(4)
    docs = [(rng.randrange(400), " ".join(rng.choices("abcdefgh", [9, 7, 5, 4, 3, 2, 1, 1], k=rng.randrange(1, 12)))) for _ in range(900)]
    items = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(1, 7)))) for i in range(40)]
    index = r.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    for how in ({}, {"cells": 200}):
        assert found(r.search(index, spark.createDataFrame(items, "name long, text string"), "name", **how)) == brute(docs, items)


def test_stops_early():
    """A list is not read further once no new document can count; a threshold equal to the k-th score does not stop it."""
    n = 1000
    read = []

    class Lists(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at))
            return super().__getitem__(at)

    ids = np.stack([np.zeros(n, "i8"), np.arange(n)[::-1]])
    for impact, most in ((np.arange(n, 0, -1), 100), (np.full(n, 7), n)):
        shard = r.Shard(ids, np.arange(n), np.zeros(n, "i8"), impact, 1)
        shard.doc, before = shard.doc.view(Lists), read.clear()
        scores, best = shard.search(np.array([0]), np.array([1]), (np.zeros(0, "i8"), np.zeros((2, 0), "i8")), 5)
        assert before is None and sum(read) <= most and (most < n or sum(read) == n)
        assert scores.tolist() == sorted(impact.tolist(), reverse=True)[:5] and best[1].tolist() == (list(range(5)) if most == n else list(range(n - 1, n - 6, -1)))
