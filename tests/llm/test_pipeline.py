"""The pipeline as a whole, and odd columns and rows through every operator and stage."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lexispark.llm import bpe, chat, fingerprints, line_dedup, mixing, near_copies, quality, simhash_dedup, token_counts, token_store, toxicity

#: Names that operators use, or might.
NAMES = ["key", "copy", "pass_no", "__key", "__at", "__k", "__begin", "__end", "row", "at", "slot", "size", "taken", "fp", "component", "n", "left", "place", "word", "score", "ids", "node"]


def odd(spark):
    """Rows that repeat, rows that differ in one further column only, nulls everywhere, one id with several texts."""
    line = "a line that many documents share between them word for word"
    rows = [(i, f"{line}\nown text {chr(97 + i)} of ship{i} and the sea number {i} goes on", "en", f"s{i % 3}", i) for i in range(9)]
    rows += [(20, "twin text of two rows that differ elsewhere", "en", "s1", 1), (20, "twin text of two rows that differ elsewhere", "en", "s1", 2), (21, "same row twice over", "de", None, 3), (21, "same row twice over", "de", None, 3)]
    rows += [(None, None, None, None, None), (None, "", None, None, None), (30, "", "fr", "s2", 0), (31, None, "fr", "s2", 0), (20, "another text under a used number", "en", "s0", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` {'int' if i % 2 else 'string'}" for i, n in enumerate(NAMES))
    more = lambda r, k: tuple(None if r[0] is None else k if i % 2 else f"v{k}" for i in range(len(NAMES)))
    return rows, spark.createDataFrame([r + more(r, r[4] or 0) for r in rows], schema).repartition(4)


def test_clashing_columns_and_odd_rows(spark, nothing):
    rows, df = odd(spark)
    n = len(rows)
    lexicon = toxicity.Lexicon({"idiot": 1.0})
    assert toxicity.score(df, lexicon).count() == bpe.encode(df).count() == token_counts.count(df).count() == token_store.encode(df).count() == n
    assert simhash_dedup.groups(df).count() == near_copies.groups(df).count() == fingerprints.compare(df).count() == quality.judge(df, quality.learn(df)).count() == mixing.mix(df)[0].count() == n
    whole = Counter(map(str, df.collect()))
    assert Counter(map(str, toxicity.keep_clean(df, lexicon).collect())) == whole
    lost = line_dedup.apply(df)
    assert lost.columns == df.columns and lost.count() == n
    assert Counter(str(r[2:4] + r[5:]) for r in lost.collect()) == Counter(str(r[2:4] + r[5:]) for r in df.collect())
    kept = simhash_dedup.keep_one(df, near_copies.groups(df))
    assert kept.columns == df.columns and not Counter(map(str, kept.collect())) - whole and kept.count() == len({t or "" for _, t, *_ in rows})
    for f in (lambda x: line_dedup.apply(x), lambda x: simhash_dedup.keep_one(x, near_copies.groups(x)), lambda x: mixing.apply(x), lambda x: toxicity.keep_clean(x, lexicon)):
        assert f(nothing).count() == 0 and f(df.limit(0)).columns == df.columns


def test_mix_keeps_rows_apart_and_in_the_schedule_s_order(spark):
    rows, df = odd(spark)
    got = mixing.apply(df).collect()
    whole = [tuple(r) for r in df.collect()]
    taken = Counter(tuple(r)[2:4] + tuple(r)[5:] for r in got)
    # Both twins may be taken, each by itself, and no row of the result is made of two.
    assert set(taken) <= {r[2:4] + r[5:] for r in whole} and {r["n"] for r in got if r["doc_id"] == 20 and r["text"].startswith("twin")} <= {1, 2}
    text = " ".join(["w"] * 40)
    even = spark.createDataFrame([(i, text, f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string").repartition(3)
    order = [r["source"] for r in mixing.apply(even, weights=(1, 1), block=40).collect()]
    # Equal targets: any stretch of the mix holds as many of either source, within the schedule's discrepancy.
    assert len(order) == 400 and all(abs(order[a : a + 50].count("s0") - 25) <= 3 for a in range(0, 350, 7))


def brute_mix(rows, weights, block):
    """The schedule by plain loops: words that each document gives."""
    import math

    size = {r[0]: len(r[1].split()) for r in rows}
    source = {r[0]: r[2] for r in rows}
    per = Counter()
    for i, s in source.items():
        per[s] += size[i]
    target = mixing.targets(dict(per), weights)
    order, total = sorted(per), sum(per.values())
    slots, edges = Counter(), []
    for s in order:
        edges.append((edges[-1] if edges else 0) + target[s] / total)
    for i in range(-(-total // block)):
        point = math.modf((i + 1) * mixing.GOLDEN)[0]
        slots[order[next(k for k, e in enumerate(edges) if point < e or k == len(edges) - 1)]] += 1
    return {s: round(target[s]) for s in order}, slots


def test_taken_words_against_plain_loops(spark):
    """Each source takes its target; passes are whole before a next one begins, so no two documents differ by more than a pass."""
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), "abc"[i % 7 % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, blocks = mixing.mix(df, block=100)
    got, want = got.collect(), brute_mix(rows, mixing.WEIGHTS, 100)
    took = Counter()
    for r in got:
        took[r["source"]] += r["taken"]
    assert dict(took) == want[0] and {r["source"]: r["n"] for r in blocks.join(df, "doc_id").groupBy("source").agg({"slot": "count"}).withColumnRenamed("count(slot)", "n").collect()}.keys() == want[1].keys()
    for s, quota in want[0].items():
        own = [r for r in got if r["source"] == s]
        passes = quota // own[0]["source_size"]
        partly = [r for r in own if r["taken"] not in (passes * r["size"], (passes + 1) * r["size"])]
        assert len(partly) <= 1 and all(passes * r["size"] <= r["taken"] <= (passes + 1) * r["size"] for r in own)


def test_pipeline(spark, sf_dir, texts):
    """Stage by stage over whole documents, each against what it promises; run() gives the same documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs, seen[name] = out.cache(), out.count()
    assert len(texts) >= seen["toxicity"] == seen["line_dedup"] >= seen["simhash_dedup"]
    encoded = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "decoded_sha256").collect()
    import hashlib

    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in encoded) == Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())


def test_stages_take_column_names_with_dots(spark, sf_dir, edges):
    """Names with dots, spaces, back quotes' neighbours and those of the stages' own columns go through all stages that return documents."""
    _, df = edges
    odd = df.withColumnsRenamed({"score": "a.b", "key": "row"}).withColumn("x y.z", F.struct(F.lit(1).alias("k.l")))
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd.columns, name
        docs.count()
    assert corpus_pipeline.STAGES[0][1](spark, odd, sf_dir).filter("doc_id = 6").first()["x y.z"]["k.l"] == 1
