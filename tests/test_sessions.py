"""Sessions whose state lies in the state store: restarts, repeated micro-batches, the order of rows."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexispark.operators import complete as c
from lexispark.operators import prefix_tree as t
from lexispark.operators import requests as q
from lexispark.streaming import measures, service, sessions

WORDS = [(f"w{i:02d}", 100 - i, 1 + i // 10) for i in range(30)]
FILES = {
    "a.json": [
        {"session": "x", "n": 1, "id": "1", "p": "w", "l": 64}, {"session": "y", "n": 1, "id": "2", "action": "set_size", "chunk_count": "2"},
        {"session": "x", "n": 3, "id": "3", "action": "set_size", "chunk_count": "9"}, {"session": "x", "n": 2, "id": "4", "action": "set_size", "chunk_count": "1"},
        {"n": 1, "id": "5", "p": "W1", "l": 5}, {"session": "y", "n": 2, "id": "6", "p": "w", "l": 64},
    ],
    "b.json": [
        {"session": "x", "n": 4, "id": "7", "p": "w", "l": 64}, {"session": "y", "n": 3, "id": "8", "p": "w", "l": 64}, {"session": "y", "n": 4, "id": "9", "action": "get_info"},
        {"session": "x", "n": 5, "id": "10", "action": "set_size", "chunk_count": "none"}, {"session": "z", "n": 1, "id": "11", "p": "", "l": 1}, {"session": "z", "n": 2, "id": "12", "action": "get_options"},
    ],
    "c.json": [{"session": "x", "n": 6, "id": "13", "p": "w2", "l": 3}, {"session": "y", "n": 5, "id": "14", "action": "get_config_path"}, {"session": "y", "n": 6, "id": "15", "p": "12", "l": 3}],
}


@pytest.fixture(scope="module")
def held(spark):
    dict_ = spark.createDataFrame(WORDS, "word string, score long, chunk_id long")
    return t.build(dict_, ("chunk_id",), bucket=6, k=256).persist(), q.chunk_sizes(dict_)


def run(spark, held, top, loaded=1):
    tree, sizes = held
    messages = sessions.read_messages(spark, str(top / "in"), maxFilesPerTrigger="1")
    sessions.serve(messages, tree, sizes, loaded, str(top / "out"), str(top / "cp"), settings=top.parent / "config.toml").awaitTermination(300)
    read = lambda kind: sorted(map(str, spark.read.parquet(str(top / "out" / kind)).drop("t").collect()))
    return read("answers"), read("replies")


def put(top, *names):
    (top / "in").mkdir(exist_ok=True)
    for k, name in enumerate(sorted(FILES)):
        if name in names:
            (top / "in" / name).write_text("".join(json.dumps(m) + "\n" for m in FILES[name]))
            stamp = 1_700_000_000 + 10 * k
            __import__("os").utime(top / "in" / name, (stamp, stamp))


def test_sessions_restart_and_replay(spark, held, tmp_path):
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    whole.mkdir(), parts.mkdir()
    put(whole, *FILES)
    with measures.Progress(spark) as progress:
        answers, replies = run(spark, held, whole)
        for _ in range(100):
            if progress.table().agg(F.sum("rows").alias("n")).first()["n"] == 15:
                break
            time.sleep(0.1)
    seen = progress.table().orderBy("batch").collect()
    assert sum(r["rows"] for r in seen) == 15 and max(r["sessions"] for r in seen) >= 3 and all(r["duration_ms"] >= 0 for r in seen)
    rows = {r["id"]: r for r in spark.read.parquet(str(whole / "out" / "answers")).collect()}
    assert {i: r["c"] for i, r in rows.items()} == {"1": 10, "5": 0, "6": 10, "7": 30, "8": 20, "11": None, "13": 3, "15": 0}
    assert [x["w"] for x in rows["13"]["s"]] == ["w20", "w21", "w22"] and rows["11"]["error"] == "empty prefix"
    said = {r["id"]: r for r in spark.read.parquet(str(whole / "out" / "replies")).collect()}
    assert {i: (r["status"], r["current_chunks"]) for i, r in said.items()} == {"2": ("ok", 2), "3": ("ok", 3), "4": ("ok", 1), "9": ("ok", 2), "10": ("error", None), "12": ("ok", None), "14": ("ok", None)}
    assert said["14"]["config_path"] == str(tmp_path / "config.toml")
    assert [x["word_count"] for x in json.loads(said["12"]["options"])] == [10, 20, 30]
    # What each micro-batch had, and how long it took.
    taken = {r["batch"]: r for r in spark.read.parquet(str(whole / "out" / "measures")).collect()}
    assert [(taken[b]["messages"], taken[b]["completions"], taken[b]["replies"], taken[b]["words"]) for b in sorted(taken)] == [(6, 3, 3, 20), (6, 3, 3, 50), (3, 2, 1, 3)]
    assert all(r["elapsed_us"] > 0 and r["entries"] >= r["words"] for r in taken.values()) and all(r["t"] > 0 for r in rows.values())
    # Stopped and started again after each file: the same.
    for name in FILES:
        put(parts, name)
        got = run(spark, held, parts)
    assert got == (answers, replies)
    # The last micro-batch, not known to have ended, runs again from the state before it: the same.
    last = max((int(p.name) for p in (parts / "cp" / "commits").iterdir() if p.name.isdigit()))
    for p in (parts / "cp" / "commits").glob(f"*{last}*"):
        p.unlink()
    assert run(spark, held, parts) == (answers, replies)


def test_answers_are_those_of_the_active_chunks(spark, held):
    asked = [("s", i, str(i), "completion", p, 7, active) for i, (p, active) in enumerate((p, a) for p in ("w", "w1", "W2", "w25", "x", "") for a in (1, 2, 3))]
    rows = spark.createDataFrame(asked, "session string, n long, id string, route string, p string, l long, active long")
    got = {r["id"]: (r["status"], r["s"], r["c"]) for r in sessions.answers(rows, held[0]).collect()}
    for active in (1, 2, 3):
        lists = c.postings(spark.createDataFrame([w for w in WORDS if w[2] <= active], "word string, score long, chunk_id long"))
        for r in q.answer(rows.filter(f"active = {active}").select("id", "p", "l"), lists).collect():
            assert got[r["id"]] == (r["status"], r["s"], r["c"])


def test_a_session_costs_by_its_messages():
    """Few messages each, as most sessions have: values as the columns' types have them, and no columns cast for each session."""

    class Held:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

    names = ["session", "n", "id", "p", "l", "action", "chunk_count", "dictionary_size", "get_chunk_count", "route"]
    rows = [(None, 3.0, None, None, float("nan"), "get_info", None, None, None, "get_info"), (None, float("nan"), "4", None, None, "set_size", "2", None, None, "set_size"), (None, 2.0, "5", "w", 7.0, None, None, None, None, "completion")]
    some, one = pd.DataFrame(rows, columns=names), sessions.Sessions([10, 10, 10], 1)
    one.state = Held()
    asked, said = one.handleInputRows((None,), iter([some]), None)
    assert asked.to_dict("records") == [dict.fromkeys(asked.columns) | {"n": 2, "id": "5", "route": "completion", "p": "w", "l": 7, "active": 1}]
    assert [(r["n"], r["id"], r["active"], r["seen"], r["current_chunks"]) for r in said.to_dict("records")] == [(None, "4", 1, 3, 2), (3, None, 1, 3, 2)] and one.state.held == (2, 3)
    assert all(type(x) in (int, str, type(None)) for df in (asked, said) for x in df.to_numpy().ravel())
    began = time.process_time()
    for _ in range(300):
        one.state = Held()
        list(one.handleInputRows((None,), iter([some]), None))
    took = time.process_time() - began
    began = time.process_time()
    for _ in range(300):
        some.astype({c: object for c in names})
    # Casting the columns once takes as long as about two sessions; it was done for each column of each of a session's results.
    assert took < 6 * (time.process_time() - began)


def test_messages_of_odd_types(spark):
    lines = ['{"id": "1", "p": "a", "l": 2.7}', '{"id": 2, "p": 3, "l": "5"}', '{"id": "3", "l": -1.5, "chunk_count": 2, "dictionary_size": "x", "get_chunk_count": true}', "no json", "{}", '{"id": null, "p": "b", "l": 1e300}']
    got = [tuple(r) for r in service.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).select("id", "p", "l", "chunk_count", "dictionary_size", "get_chunk_count").collect()]
    none = (None,) * 6
    assert got == [("1", "a", 2, None, None, None), none, ("3", None, -1, "2", "x", "true"), none, none, (None, "b", None, None, None, None)]
