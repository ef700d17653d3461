"""Prefix trees on odd and skewed vocabularies, against lists of whole buckets; requests for more than a summary holds; trees by chunk."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexispark.operators import complete as c
from lexispark.operators import dictionary as d
from lexispark.operators import prefix_tree as t

SCHEMA = "word string, score long, chunk_id long"


def vocabulary():
    """Two thirds of the words share long leading strings; some are prefixes of others, some repeat one letter, some have odd signs."""
    rng = random.Random(2)
    words = {"a" * n for n in range(1, 30)} | {"prefix" + "".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(700)}
    words |= {"".join(rng.choice("abé漢\U0001f600Σ ") for _ in range(rng.randrange(1, 5))) for _ in range(300)} | {"prefi", "ẞ", "İx", ""}
    return [(w, rng.randrange(10, 60), 1 + i % 4) for i, w in enumerate(sorted(words))]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(vocabulary(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    held = sorted({w[:n] for w, _, _ in vocabulary() for n in (1, 2, 3, 6, 7, 9)} - {""})
    rows = [(str(i), p.upper() if i % 3 == 0 and p.isascii() else p, i % 12) for i, p in enumerate(held)]
    rows += [("none", "zz", 4), ("null", None, 4), ("no limit", "a", None), ("below", "a", -3), ("empty", "", 5), ("twice", "pre", 5), ("twice", "pre", 5)]
    return spark.createDataFrame(rows, "id string, p string, l long")


def rows(df):
    return Counter(str((r["id"], r["p"], r["l"], [tuple(x) for x in r["s"]])) for r in df.collect())


@pytest.mark.parametrize("mode", ["reference", "callback", "exact"])
def test_same_answers_from_short_rows(spark, words, asked, mode):
    tree = t.build(words, bucket=20, k=24).persist()
    longest = tree.select(F.max(F.greatest(F.size("words"), F.coalesce(F.size("best"), F.lit(0)))).alias("x")).first()["x"]
    assert longest <= 25 and tree.filter("leaf and n > 20").count() == 0
    some = asked.filter("p is not null and p <> '' and l is not null")
    want = rows(c.complete_batch(some, c.postings(words.filter("word <> ''"), cap=None), mode))
    got = t.complete_tree(asked, tree, mode, k=24)
    assert rows(got.filter("p is not null and p <> '' and l is not null").drop("read")) == want
    assert got.select(F.max("read").alias("x")).first()["x"] <= 25
    assert {r["id"]: list(r["s"]) for r in got.filter("id in ('none', 'null', 'no limit', 'below', 'empty')").collect()} == {k: [] for k in ("none", "null", "no limit", "below", "empty")}
    assert got.count() == asked.count()


@pytest.mark.parametrize("mode", ["reference", "exact"])
def test_walks(spark, words, asked, mode):
    tree = t.build(words, bucket=8, k=6).persist()
    more = asked.filter("p is not null and p <> '' and l > 0").withColumn("l", F.col("l") * F.col("l") * 3)
    want = rows(c.complete_batch(more, c.postings(words.filter("word <> ''"), cap=None), mode))
    assert rows(t.complete_tree(more, tree, mode, k=6, walk=True).drop("read")) == want
    with pytest.raises(Exception, match="too short"):
        t.complete_tree(more, tree, mode, k=6).collect()


def test_loads_and_evictions_equal_a_rebuild(spark, words, asked):
    """Any set of chunks answers as a tree that is built of its words, and no row of another chunk is looked at."""
    rng, by = random.Random(1), ("chunk_id",)
    parts = {n: t.build(words.filter(F.col("chunk_id") == n), by, bucket=20, k=24).persist() for n in range(1, 5)}
    some = asked.filter("p is not null and p <> '' and l is not null")
    active = {1, 2}
    for _ in range(3):
        active ^= {rng.randrange(1, 5)}
        tree = None
        for n in sorted(active):
            tree = parts[n] if tree is None else tree.unionByName(parts[n])
        tree = parts[1].limit(0) if tree is None else tree
        own = words.filter(F.col("chunk_id").isin(*active)) if active else words.limit(0)
        assert rows(t.complete_tree(some, tree, by=by, k=24).drop("read")) == rows(t.complete_tree(some, t.build(own, bucket=20, k=24), k=24).drop("read"))
    both = t.build(words, by, bucket=20, k=24)
    assert rows(t.complete_tree(some, d.evict(both, 1, 3), by=by, k=24).drop("read")) == rows(t.complete_tree(some, parts[2].unionByName(parts[4]), by=by, k=24).drop("read"))


def test_empty_and_wrong(spark, words, asked):
    assert t.build(words.limit(0)).count() == 0 and t.complete_tree(asked, t.build(words.limit(0))).filter("size(s) > 0").count() == 0
    assert t.complete_tree(asked.limit(0), t.build(words, bucket=50)).count() == 0
    with pytest.raises(ValueError):
        t.build(words, bucket=0)


def test_positions_have_no_window(spark):
    plan = d.ranked(spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, frequency long"))
    assert "Window" not in plan._jdf.queryExecution().toString()
    assert [(r["word"], r["pos"]) for r in plan.orderBy("pos").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    assert d.ranked(spark.createDataFrame([], "word string, frequency long")).count() == 0
