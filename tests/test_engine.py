"""Fixed cases of the engine, binary chunks, streams, settings."""

import io
import json
import struct

import pytest
from pyspark.sql import functions as F

from lexispark import __main__ as command
from lexispark import cli, config
from lexispark.functions import exprs as e
from lexispark.operators import complete as c
from lexispark.operators import dictionary as d
from lexispark.operators import requests as q
from lexispark.operators.completer import TableCompleter
from lexispark.sources import binary_chunks as b
from lexispark.sources import word_lists
from lexispark.streaming import service


def table(spark, words):
    return spark.createDataFrame([(w, s, 1) for w, s in words], "word string, score long, chunk_id long")


def best(df):
    return [r["w"] for r in df.orderBy("r").collect()]


def test_small_dictionaries(spark):
    assert best(c.complete(table(spark, [("hello", 1000), ("help", 800)]), "hel", 10)) == ["hello", "help"]
    dict_ = table(spark, [("prefix", 500), ("preface", 400), ("pref", 900)])
    assert best(c.complete(dict_, "PREF", 5)) == ["PREFix", "PREFace"]
    assert best(c.complete(dict_, "Pref", 5)) == ["Prefix", "Preface"]
    four = table(spark, [("ta", 30), ("tb", 40), ("tc", 50), ("td", 60)])
    assert best(c.complete(four, "t", 2)) == ["tc", "tb"]
    assert best(c.complete(four, "t", 2, "callback")) == best(c.complete(four, "t", 2, "exact")) == ["td", "tc"]
    seen = []
    assert c.complete_each(four, "t", 4, lambda w, s: seen.append(w) or len(seen) < 2) == 2 and seen == ["td", "tc"]
    assert best(c.complete(four, "t", 0)) == []
    edge = table(spark, [("abc", 19), ("abd", 20), ("abe", 23), ("abf", 24)])
    assert sorted(best(c.complete(edge, "ab", 9))) == ["abf"]
    edge = table(spark, [("abcx", 19), ("abcy", 20)])
    assert best(c.complete(edge, "abc", 9)) == ["abcy"]


def test_scalars(spark):
    def one(col):
        return spark.range(1).select(col.alias("x")).first()["x"]

    assert [one(e.score_of_rank(F.lit(r))) for r in (0, 1, 2, 65535)] == [0, 65535, 65534, 1]
    assert [one(e.format_commas(F.lit(n))) for n in (999, 1000, 1234567, -1234567)] == ["999", "1,000", "1,234,567", "-1234567"]
    assert one(e.capitalize(F.lit("éab"), F.lit("éA"))) == "éaA"
    assert [one(e.server_limit(F.lit(n))) for n in (0, -1, 65, 64, 1)] == [32, 32, 64, 64, 1]
    assert [one(e.is_valid_input(F.lit(s))) for s in ("12", "aaa", "don't", "ok", "ééé")] == [False, False, False, True, True]
    assert one(e.rank_list(F.lit(0).cast("long"))) == [] and one(e.rank_list(F.lit(3).cast("long"))) == [1, 2, 3]
    assert [one(e.parse_chunk_count(F.lit(s))) for s in ("3", "4.7", "x")] == [3, 4, None]
    assert one(e.trim_unicode(F.lit("　 a b \n"))) == "a b"


def test_word_lists(spark, tmp_path):
    lines = spark.createDataFrame([("a\t5",), ("a\tb\t6",), ("\t7",), ("a\t5x",), ("a b",), ("a\tx",)], "value string")
    assert [(r["word"], r["frequency"]) for r in word_lists.parse_builder(lines).collect()] == [("a", 5), ("a\tb", 6), ("", 7), ("a", 5)]
    assert [(r["word"], r["frequency"]) for r in word_lists.parse_browser(lines).collect()] == [("a", 5), ("a", 0), ("a", 5), ("a", 0)]
    (tmp_path / "words.txt").write_text("the\t9\nbad line\nof\t7\n")
    assert [tuple(r) for r in word_lists.read(spark, str(tmp_path / "words.txt")).orderBy("pos").collect()] == [("the", 9, 1), ("of", 7, 2)]


def test_word_list_in_splits_and_positions_in_hot_groups(spark, tmp_path):
    """Positions over many splits of a file and over several files; words of one frequency that share their leading characters."""
    want = []
    for name in ("a.txt", "b.txt"):
        lines = [f"{name[0]}{i}\t{9000 - i}" if i % 7 else "no number" for i in range(5000)]
        (tmp_path / name).write_bytes("\r\n".join(lines).encode())
        want += [(x.split("\t")[0], int(x.split("\t")[1])) for x in lines if "\t" in x]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [tuple(r) for r in word_lists.read(spark, str(tmp_path)).orderBy("pos").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [(w, f, i + 1) for i, (w, f) in enumerate(want)]
    words = [(p + str(i) * (i % 3), f) for p in ("", "a", "ab", "abc", "abcdefgh", "é", "\U0001f600x") for i in range(40) for f in (1, 2)]
    words = sorted({w for w in words if w[0]}, key=lambda w: (-w[1], w[0].encode()))
    df = spark.createDataFrame(words, "word string, frequency long").repartition(3)
    assert [(r["word"], r["frequency"]) for r in d.ranked(df).orderBy("pos").collect()] == words
    assert [r["pos"] for r in d.ranked(df).orderBy("pos").collect()] == list(range(1, len(words) + 1))


def test_binary_chunks(spark, tmp_path):
    data = b.encode([("b", 2), ("é", 65535), ("a", 1)])
    assert list(b.decode(data)) == [("a", 1), ("b", 2), ("é", 65535)]
    assert list(b.decode(data[:-1])) == [("a", 1), ("b", 2)] and list(b.decode(struct.pack("<i", 5))) == []
    for broken in (data[:-1], data[:3]):
        with pytest.raises(ValueError):
            list(b.decode(broken, "FAILFAST"))
    words = d.positioned(spark.createDataFrame([(f"w{i:02d}", 100 - i, i) for i in range(1, 26)], "word string, frequency long, pos long"), 10)
    b.write(words, str(tmp_path / "bin"))
    (tmp_path / "bin" / "dict_x.bin").write_bytes(b"12345")
    assert sorted((r["id"], r["word_count"]) for r in b.files(spark, str(tmp_path / "bin")).collect()) == [(1, 10), (2, 10), (3, 5)]
    got = b.read(spark, str(tmp_path / "bin")).filter("chunk_id is not null")
    assert sorted(map(tuple, got.select("word", "rank", "score", "chunk_id").collect())) == sorted(map(tuple, words.select("word", "rank", "score", "chunk_id").collect()))
    b.store(words, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 25


def test_catalog(spark):
    chunks = spark.createDataFrame([(i, f"dict_{i:04d}.bin", 10_000) for i in (1, 2, 3)], "id long, filename string, word_count long")
    assert [r["size_label"] for r in d.size_options(chunks).orderBy("chunk_count").collect()] == ["10K words", "20K words", "30K words"]
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert [ids(d.chunks_for_budget(chunks, n)) for n in (0, -1, 1, 10_000, 10_001)] == [[1, 2, 3], [], [1], [1], [1, 2]]
    assert ids(d.resize(chunks, 2)) == [1, 2] and ids(d.request_more(chunks, chunks.filter("id = 1").select("id"), 5)) == [2]
    with pytest.raises(ValueError):
        d.resize(chunks, 0)
    assert [d.chunks_needed(*x) for x in ((50_000, 10_000), (1, 10), (0, 10), (25, 10))] == [5, 1, 1, 3]


def test_stream_equals_batch(spark, tmp_path):
    dict_ = table(spark, [(f"{a}{b_}{c_}x", 30 + ord(c_)) for a in "abc" for b_ in "abc" for c_ in "abc"])
    asked = [("1", "a", 3), ("2", "Ab", 2), ("3", "", 5), ("4", "zz", 5), ("5", "12", 1), ("6", "abc", 0)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text("".join(json.dumps({"id": i, "p": p, "l": n}) + "\n" for i, p, n in asked))
    lists = c.postings(dict_)
    stream = service.completions(service.read_requests(spark, str(tmp_path / "in")), lists)
    query = stream.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = q.answer(spark.createDataFrame(asked, "id string, p string, l long"), lists)
    assert sorted(map(str, spark.table("answers").collect())) == sorted(map(str, batch.collect()))


def test_control_messages(spark):
    dict_ = spark.createDataFrame([(f"w{i}", 50, 1 + i // 10) for i in range(30)], "word string, score long, chunk_id long")
    assert q.manage({"id": "1", "action": "get_info"}, dict_, 2) == ({"id": "1", "status": "ok", "current_chunks": 2, "available_chunks": 3}, 2)
    assert q.manage({"id": "2", "action": "set_size", "chunk_count": 1}, dict_, 2)[1] == 1
    assert q.manage({"id": "3", "dictionary_size": 3}, dict_, 2)[0]["status"] == q.manage({"action": "x"}, dict_, 2)[0]["status"] == "error"


def test_settings_and_command_line(spark, tmp_path):
    assert config.parse(config.dump(config.Config())) == config.Config()
    assert config.parse("[server]\nmax_limit = 9\nmin_prefix = 'x'\n").server == config.Server(max_limit=9)
    assert config.parse("no toml [") == config.Config()
    assert config.load(default=tmp_path / "a" / "config.toml")[1].exists()
    dict_ = table(spark, [("hello", 1000), ("help", 800)])
    assert cli.answer(dict_, " hel\n") == [" 1. hello (1,000)", " 2. help (800)"]
    assert cli.answer(dict_, "12") == ["no suggestions"] and "too long" in cli.answer(dict_, "x" * 25)[0]


def test_lists_that_are_too_short_for_a_request_fail(spark):
    dict_ = table(spark, [(f"t{i:03d}", 100 + i) for i in range(400)])
    ask = lambda l, **how: c.complete_batch(spark.createDataFrame([("1", "t", l)], "id string, p string, l long"), c.postings(dict_, **how.pop("lists", {})), **how)  # noqa: E731, E741
    assert len(ask(64).first()["s"]) == 64
    for l, mode in ((300, "reference"), (64, "exact")):  # noqa: E741
        with pytest.raises(Exception, match="too short"):
            ask(l, mode=mode).collect()
        assert len(ask(l, mode=mode, lists={"cap": None}).first()["s"]) == l


def test_bulk_loads(spark):
    good, broken = b.encode([("a", 1), ("b", 2)]), b.encode([("c", 3)])[:-1]
    files = spark.createDataFrame([("dict_0001.bin", good), ("dict_0002.bin", b""), ("dict_0003.bin", broken), ("dict_0004.bin", good), ("dict_0005.bin", None)], "filename string, content binary")
    assert sorted(map(tuple, b.bulk(files).collect())) == [(1, "a", 1), (1, "b", 2)]
    twice = struct.pack("<i", 2) + (struct.pack("<H", 1) + b"x" + struct.pack("<H", 5)) + (struct.pack("<H", 1) + b"x" + struct.pack("<H", 7))
    assert [tuple(r) for r in b.bulk(spark.createDataFrame([("dict_0001.bin", twice)], "filename string, content binary")).collect()] == [(1, "x", 7)]
    lines = spark.createDataFrame([("a\t5", 1), ("a\t9", 2), ("b\tx", 3), ("no", 4)], "value string, n int")
    assert {r["word"]: r["score"] for r in word_lists.bulk(lines, "n").collect()} == {"a": 5, "b": 0} and word_lists.bulk_count(lines).first()["words"] == 3


def test_formats(spark, tmp_path):
    data = b.encode([("a", 1)])
    for name, content in (("ok.bin", data), ("short.bin", b"12"), ("big.bin", struct.pack("<i", 2_000_000)), ("minus.bin", struct.pack("<i", -1)), ("list.TXT", b"a\t1"), ("x.csv", b"1")):
        (tmp_path / name).write_bytes(content)
    got = {r["filename"]: (r["format"], r["valid"], r["reason"]) for r in b.validated(spark, str(tmp_path)).collect()}
    assert got == {
        "ok.bin": ("binary", True, None), "short.bin": ("binary", False, "file too small"), "big.bin": ("binary", False, "word count too large"), "minus.bin": ("binary", False, "negative word count"),
        "list.TXT": ("text", True, None), "x.csv": ("unknown", False, "unknown format"),
    }
    assert {r["format"]: (r["description"], r["min_size"]) for r in b.formats(spark).collect()} == {"binary": ("Binary Dictionary", 4), "text": ("Plain Text Dictionary", 1)}


def test_small_functions(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first()["x"]
    assert [one(e.is_separator(F.lit(x))) for x in " _-./a"] == [True] * 5 + [False] and one(e.equal_fold(F.lit("A"), F.lit("a")))
    assert [one(e.number_or_one(F.lit(x))) for x in ("7", "x")] == [7, 1]
    assert one(e.capitalize_words(F.array(F.lit("hello"), F.lit("help")), F.lit("HE"))) == ["HEllo", "HElp"]
    dict_ = spark.createDataFrame([("a", 5, 30, 2), ("a", 9, 20, 1), ("b", 1, 40, 1)], "word string, rank long, score long, chunk_id long")
    assert sorted(map(tuple, d.one_per_word(dict_).select("word", "score").collect())) == [("a", 20), ("b", 40)] and d.word_scores(dict_.filter("chunk_id = 1")) == {"a": 20, "b": 40}
    assert list(c.search(dict_.filter("chunk_id = 1"), "", 5, 30)) == [("b", 40)] and d.enough_chunks(dict_, 3) and not d.enough_chunks(dict_, 4)
    chunks = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    assert sorted(r["id"] for r in d.resize(chunks, 5, loaded=2, mode="reference").collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="chunk 7"):
        d.evict(dict_, 1, 7, strict=True)


def test_completer(spark, tmp_path):
    words = d.positioned(spark.createDataFrame([(f"wo{i:02d}", 100 - i, i) for i in range(1, 26)], "word string, frequency long, pos long"), 10)
    b.write(words, str(tmp_path / "bin"))
    own = TableCompleter(spark)
    own.load_chunk(str(tmp_path / "bin" / "dict_0002.bin"))
    own.initialize()
    assert best(own.complete("wo", 3)) == ["wo11", "wo12", "wo13"]
    own.load_all(str(tmp_path / "bin"))
    own.add_word("wonder", 99_999)
    own.add_word("wo01", 1)
    assert best(own.complete("WOn", 3)) == ["WOnder"] and {r["name"]: r["value"] for r in own.stats().collect()}["totalWords"] == 26
    # Added words leave the others' chunks as they are.
    said = {r["name"]: r["value"] for r in own.stats().collect()}
    assert (said["loadedChunks"], said["availableChunks"], said["maxFrequency"]) == (3, 3, 99_999)
    assert {r["word"]: r["chunk_id"] for r in own.words.collect()} == {r["word"]: r["chunk_id"] for r in words.collect()} | {"wonder": None}
    own.load_chunk(str(tmp_path / "bin" / "dict_0001.bin"))
    own.add_word("wonder", 5)
    assert {r["word"]: (r["score"], r["chunk_id"]) for r in own.words.filter("word in ('wonder', 'wo01')").collect()} == {"wonder": (99_999, None), "wo01": (65_535, 1)}


def test_completer_folds_many_additions(spark, monkeypatch):
    from lexispark.operators import completer

    monkeypatch.setattr(completer, "HELD", 3)
    own = TableCompleter(spark, table(spark, [("aa", 50)]))
    for i in range(7):
        own.add_word(f"ab{i}", 40 + i)
    assert own.words.count() == 8 and len(own._added) == 1 and best(own.complete("ab", 2)) == ["ab2", "ab1"]


def test_stream_of_all_messages(spark, tmp_path):
    """Control replies reach their sink, what they set outlives a restart, settings act, their file can be made anew."""
    dict_ = spark.createDataFrame([(f"w{i:02d}", 50 + i, 1 + i // 10) for i in range(30)], "word string, score long, chunk_id long")
    (tmp_path / "in").mkdir()
    path, answers, replies = tmp_path / "config.toml", [], []

    def send(name, *messages):
        (tmp_path / "in" / name).write_text("".join(json.dumps(m) + "\n" for m in messages))
        query, state = service.serve(
            service.read_requests(spark, str(tmp_path / "in")), dict_, c.postings, lambda df: answers.extend(df.collect()), 3, str(tmp_path / "cp"),
            lambda df: replies.extend(df.collect()), lambda: (config.parse("[server]\nmax_limit = 2\nmin_prefix = 2\n"), path),
        )
        query.awaitTermination(120)
        return state

    send("a.json", {"id": "1", "p": "w2", "l": 5}, {"id": "2", "action": "set_size", "chunk_count": 1}, {"id": "3", "action": "rebuild_config"}, {"id": "4", "action": "get_config_path"}, {"id": "5", "action": "no"}, {"id": "6", "p": "w", "l": 5})
    assert {r["id"]: (r["status"], r["c"], r["error"]) for r in answers} == {"1": ("ok", 2, None), "6": ("error", None, "prefix too short (min: 2)")}
    assert {r["id"]: (r["status"], r["current_chunks"], r["config_path"]) for r in replies} == {"2": ("ok", 1, None), "3": ("ok", None, None), "4": ("ok", None, str(path)), "5": ("error", None, None)}
    assert config.parse(path.read_text()) == config.Config()
    assert send("b.json", {"id": "7", "p": "w2", "l": 5}, {"id": "8", "action": "get_options"})["loaded"] == 1
    assert [(r["id"], r["c"]) for r in answers][2:] == [("7", 0)] and len(json.loads(replies[-1]["options"])) == 3
    assert config.update(config.Config(), path, max_limit=5).server.max_limit == config.parse(path.read_text()).server.max_limit == 5


def test_line_stream(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.txt").write_text("  hel \n\n　th\n")
    service.read_lines(spark, str(tmp_path / "l")).writeStream.format("memory").queryName("typed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r["p"] for r in spark.table("typed").collect()) == ["hel", "th"]


def test_command(spark, tmp_path):
    (tmp_path / "words.txt").write_text("".join(f"word{i:02d}\t{100 - i}\n" for i in range(25)))
    assert command.main(["build", str(tmp_path / "words.txt"), str(tmp_path / "d"), "--chunk-size", "10", "-v"], out=(out := io.StringIO())) == 0
    assert out.getvalue().split() == ["dict_0001.bin", "10", "dict_0002.bin", "10", "dict_0003.bin", "5"]
    out = io.StringIO()
    assert command.main(["complete", str(tmp_path / "d" / "store"), "--limit", "2", "--words", "10", "--config", str(tmp_path / "words.txt")], ["wo\n", "\n", "word1\n"], out) == 0
    said = out.getvalue().split("\n")
    assert said[:2] == [" 1. word00 (65,535)", " 2. word01 (65,534)"] and said[3] == "no suggestions"
    with pytest.raises(ValueError):
        command.main(["build", str(tmp_path / "words.txt"), str(tmp_path / "e"), "--chunk-size", "0"])


def test_command_serves(spark, tmp_path):
    (tmp_path / "words.txt").write_text("".join(f"word{i:02d}\t{100 - i}\n" for i in range(25)))
    command.main(["build", str(tmp_path / "words.txt"), str(tmp_path / "d"), "--chunk-size", "10"])
    (tmp_path / "in").mkdir()
    for name, messages in (("a.json", [{"session": "s", "id": "1", "p": "WO", "l": 40.9}, {"session": "s", "id": "2", "action": "get_info"}]), ("b.json", [{"session": "s", "id": "3", "p": "word1", "l": 2}])):
        (tmp_path / "in" / name).write_text("".join(json.dumps(m) + "\n" for m in messages))
        assert command.main(["serve", str(tmp_path / "d" / "store"), str(tmp_path / "in"), str(tmp_path / "out"), "--once", "--words", "15", "--config", str(tmp_path / "words.txt")]) == 0
    got = {r["id"]: [x["w"] for x in r["s"]] for r in spark.read.parquet(str(tmp_path / "out" / "answers")).collect()}
    assert got == {"1": [f"WOrd{i:02d}" for i in range(20)], "3": ["word10", "word11"]}
    assert spark.read.parquet(str(tmp_path / "out" / "replies")).first()["available_chunks"] == 3
