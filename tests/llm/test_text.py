"""Operators 1, 4, 5, 7 and 8."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lexispark.llm import chat, line_dedup, mixing, quality, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_toxicity_query(spark, sf_dir, texts):
    rows = queries.op1_toxicity(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_toxicity_query_against_plain_search(spark, sf_dir, docs, texts):
    """The same lexicon, every term and phrase looked for by itself at each place of the folded text."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def places(low, folded, phrase):
        found = (m.start() for m in re.finditer(f"(?={re.escape(phrase)})", folded))
        spans = [(a, a + len(phrase)) for a in found]
        return [(a, b) for a, b in spans if not low[a - 1 : a].isalpha() and not low[b : b + 1].isalpha()]

    def brute(text):
        low, folded = toxicity.fold(text)
        free = [x for p in lexicon.exceptions if p not in lexicon.weights for x in places(low, folded, p)]
        held = [w for t, w in lexicon.weights.items() for a, b in places(low, folded, t) if not any(x <= a and b <= y for x, y in free)]
        return lexicon.score(np.log1p(100 * sum(held) / max(20, len(low.split()))) if held else 0.0), len(held)

    rows = queries.op1_toxicity(spark, sf_dir).collect()
    got = {r["doc_id"]: (r["score"], r["n_matches"]) for r in rows}
    assert set(got) == set(texts) and any(n for _, n in got.values())
    for i, t in texts.items():
        score, n = brute(t)
        assert got[i][1] == n and abs(got[i][0] - score) < 1e-9


def test_toxicity_folds_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 1.0, "trash": 0.5}, ("trash can",), 8.0, 0.5)
    auto = lexicon.automaton()
    n = lambda t: len(toxicity.matches(t, auto)[1])
    assert n("IDIOT") == n("1d10t") == n("іdiоt") == n("\U0001d4f2\U0001d4ed\U0001d4f2ot") == n("id​iot") == n("idi0t!") == 1
    assert n("idiotic") == n("xidiot") == n("the trash can") == n("") == 0
    assert n("the trash can is trash") == 1
    assert n("trash can trash " * 50_000) == 50_000 and n("trash can " * 50_000) == 0
    assert lexicon.score(toxicity.matches("you idiot", auto)[0]) > 0.5 > lexicon.score(0.0)


def test_toxicity_learns(spark, edges, nothing):
    rows = [(i, ("good day to you " * 5) + (f"w{i} idiot x{i}" if i % 3 == 0 else "friend"), None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert "idiot" in lexicon.weights and "good" not in lexicon.weights
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, lexicon).collect()}
    assert got == {i: i % 3 == 0 for i in range(200)}
    assert toxicity.score(edges[1], lexicon).count() == len(edges[0])
    kept = toxicity.keep_clean(edges[1], lexicon)
    assert kept.columns == edges[1].columns and kept.count() == len(edges[0]) - 1
    assert toxicity.learn(nothing, labels).weights == {} and toxicity.score(nothing, lexicon).count() == 0


def base_brute(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_query(spark, sf_dir, texts):
    rows = queries.op4_quality_rules(spark, sf_dir).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows}
    assert got == {i: base_brute(t) for i, t in texts.items()}
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)


def test_quality_edges(docs, edges, nothing):
    refs = quality.learn(docs)
    rows, df = edges
    got = quality.judge(df, refs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((r[0], *base_brute(r[1])) for r in rows)
    none = quality.learn(nothing)
    assert quality.judge(nothing, refs).count() == 0 and quality.judge(df, none).count() == len(rows)
    assert quality.learn(df).classes


def test_quality_references_are_exact(spark, nothing):
    """Counts sent on in parts add up to those of all texts, for every language; nulls are a language of their own."""
    rows = [(i, f"the {'of' if i % 2 else 'and'} Word{i % 7}, w{i}!", f"l{i % 90}" if i % 3 else None, "x") for i in range(900)] + [(None, None, "empty", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n string").repartition(3)
    for held in (1, 10, 1_000_000):
        refs = quality.learn(df, common=5, held=held)
        want = []
        for lang in {r[2] for r in rows} - {"empty"}:
            c = Counter(w for r in rows if r[2] == lang for w in quality.plain_words(r[1].encode()))
            want.append({w: n / c.total() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5]})
        key = lambda d: sorted(d.items())
        assert sorted(map(key, refs.words)) == sorted(map(key, want)) and len(refs.classes) == 61
        assert all(abs(c.sum() - 1) < 1e-9 for c in refs.classes)


def test_divergence():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert quality.divergence(p, q) == 1 and quality.divergence(p, p) == 0


def lines_df(spark, rows):
    return spark.createDataFrame([(i, t, None, len(t or ""), 1) for i, t in rows], "doc_id long, text string, at string, n_chars long, key int")


def test_lines(spark, edges, nothing):
    same = "this work is licensed under terms that everyone should read carefully"
    rows = [(i, f"own line {chr(97 + i)} of the document with id word{chr(97 + i)}\n{same}\nshort one\nrequest {i * 37} served by host{i} in the usual way\n") for i in range(6)]
    rows += [(50, "line with a body of words that is here in two documents only\nx"), (51, "line with a body of words that is here in two documents only\nx"), (60, None), (61, "")]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.apply(lines_df(spark, rows)).collect()}
    want = dict(rows) | {i: f"own line {chr(97 + i)} of the document with id word{chr(97 + i)}\n" for i in range(1, 6)}
    assert got == {i: (t, len(t or "")) for i, t in want.items()}
    kept = line_dedup.apply(edges[1])
    assert kept.columns == edges[1].columns and kept.count() == len(edges[0])
    assert line_dedup.apply(nothing).count() == 0


def test_short_lines_are_templates_as_they_stand(spark):
    """Lines of one to four words go where three documents have them; numbers in them are no variable fields."""
    rows = [(i, f"Les.\npage {i} of 9\nnumber 7 here\n\n{i}\nown{chr(97 + i)}") for i in range(4)] + [(9, "Les.\n\t\n")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.apply(lines_df(spark, rows)).collect()}
    assert got == {0: rows[0][1]} | {i: f"page {i} of 9\n\n{i}\nown{chr(97 + i)}" for i in range(1, 4)} | {9: "\t\n"}


def test_lines_variable_words(spark):
    """Fields without digits vary too: the template is what the leaf's lines share."""
    names = ["anna", "berta", "carla", "dora", "emma"]
    rows = [(i, f"please send all of your mail to {n} at the main office before noon today") for i, n in enumerate(names)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.apply(lines_df(spark, rows)).collect()}
    assert got == {0: rows[0][1]} | {i: "" for i in range(1, 5)}


def test_lines_of_five_words_need_more_than_their_leaf(spark):
    """Equal leading words alone make no template; equal lines of any length still do."""
    rows = [(i, f"was erlytion that {a} {b}\nwas erlytion that same end") for i, (a, b) in enumerate([("ing", "eresnt."), ("oues", "ereaha."), ("are", "for."), ("of.", "restwh."), ("a,", "reha.")])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.apply(lines_df(spark, rows)).collect()}
    assert got == {i: t if i == 0 else t.split("\n")[0] for i, t in rows}
    long = [line_dedup.parse(b" ".join(b"w%c" % (97 + i) for i in range(n))) for n in (5, 16, 24, 64)]
    assert [len(x[2]) for x in long] == [2, 13, 14, 16]


def test_lines_query_exact_copies_are_found(spark, sf_dir, texts):
    """Every line with a word that equals one in three documents stays in the first only; other documents lose only templates."""
    got = {r["doc_id"]: r["n_dropped"] for r in queries.op5_line_dedup(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    where = defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            if WORD.findall(line):
                where[line].add(i)
    least = Counter()
    for i, t in texts.items():
        least[i] = sum(len(where[x]) >= 3 and min(where[x]) != i for x in t.split("\n") if x in where)
    assert all(got[i] >= n for i, n in least.items())
    assert sum(got[i] for i in got) <= 1.1 * sum(least.values()) + 2


def chat_brute(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    turns = defaultdict(list)
    for r in rows:
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [("user", said), ("assistant", said)]
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op7_chat_format(spark, sf_dir).collect()}
    assert got == {c: chat_brute(t) for c, t in turns.items()}


def test_chat_edges(spark):
    hard = ["", None, "<|im_end|>\n", "<\\|im_start|>", "\n\nx  ", "<", "|>", "\\", "<\\\\|", " é\U0001f600 ", "a<|im_end|>", "\n"]
    rows = [(1, k, role, t, 3, "f") for k, (t, role) in enumerate((t, r) for t in hard for r in ("assistant", "user"))]
    rows += [(2, 0, "a\nb\\n<|im_end|>", "x", 3, "f"), (2, 1, None, None, 3, "f"), (2, 1, "assistant", "twice", 3, "f"), (2, 1, "assistant", "twice", 3, "f"), (None, None, "assistant", "no id", 3, "f")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int, ids string")
    turns = defaultdict(list)
    for c, k, r, t, *_ in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        turns[c].append((r or "", t or ""))
    for segment in (1, 40, 1 << 18):
        got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.format_turns(df, segment=segment)).collect()}
        assert got == {c: chat_brute(t) for c, t in turns.items()}
    whole, parts = ({}, defaultdict(bytes))
    for r in chat.format_turns(df).collect():
        whole[r["conv_id"]] = bytes(r["ids"])
    for r in chat.format_turns(df, segment=1).orderBy("conv_id", "segment").collect():
        parts[r["conv_id"]] += bytes(r["ids"])
    assert whole == parts
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_escape_is_reversible():
    for t in ["", "<|", "<\\|", "<\\\\|x<|", "\\", "<<||>", "a\\nb\n"]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_mixing_query(spark, sf_dir, docs, texts):
    rows = queries.op8_mixing(spark, sf_dir).collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    per = Counter()
    for i, n in size.items():
        per[source[i]] += n
    target = mixing.targets(dict(per))
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    took = Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[source[r["doc_id"]]] and abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[source[r["doc_id"]]] += r["taken"]
    assert all(abs(took[s] - target[s]) <= 0.03 * target[s] + 50 for s in target)
    again = {r["doc_id"]: r["taken"] for r in queries.op8_mixing(spark, sf_dir).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_targets():
    assert mixing.targets({"a": 10, "b": 10, "c": 10}) == {"a": 5, "b": 10, "c": 15}
    assert mixing.targets({"a": 100, "b": 1, None: 1}) == {"a": 96, "b": 3, None: 3}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_mixing_edges(edges, nothing):
    rows, df = edges
    got, _ = mixing.mix(df, block=5)
    got = got.collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    per, took, target = Counter(), Counter(), {}
    for r in got:
        took[r["source"]] += r["taken"]
        per[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(took[s] - target[s]) < 40 for s in per)
    assert mixing.mix(nothing)[0].count() == 0 and mixing.apply(nothing).count() == 0
    assert mixing.mix(df.filter("text is null"))[0].collect()[0]["taken"] == 0
    mixed = mixing.apply(df)
    assert mixed.columns == df.columns
    parts, _ = mixing.mix(df)
    assert mixed.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == parts.agg(F.sum("taken")).first()[0]


def test_mixing_meets_the_targets_of_rare_sources(spark):
    """Sources far below a block beside a hot one, anywhere in the order, take their targets to the word."""
    sizes = {"a": 3, "b": 700, "c": 60_000, "d": 40, "e": 60_000, "f": 5, "g": 1000, None: 2}
    rows = [(s, " ".join(["w"] * min(37, n - a))) for s, n in sizes.items() for a in range(0, n, 37)]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    got, blocks = mixing.mix(df)
    target = mixing.targets(sizes)
    took = {r["source"]: r["t"] for r in got.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert took == {s: round(x) for s, x in target.items()}
    assert blocks.filter("end <= begin").count() == 0 and got.filter("taken > 3 * size").count() == 0
    mixed = {r["source"]: r["t"] for r in mixing.apply(df).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("t")).collect()}
    assert mixed == took


def test_schedule_ranks(spark):
    rows = mixing.schedule(spark, [0.5, 0.3, 0.2], 1000).orderBy("slot").collect()
    n = Counter()
    for r in rows:
        assert r["rank"] == n[r["source_no"]]
        n[r["source_no"]] += 1
    assert abs(n[0] - 500) < 5 and abs(n[1] - 300) < 5
