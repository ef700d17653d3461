"""The chunk files' data source and its commit protocol; versions, upserts and pruned reads of the store."""

import struct
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lexispark.operators import complete as c
from lexispark.operators import dictionary as d
from lexispark.sources import binary_chunks as b
from lexispark.sources import chunk_source as s
from lexispark.sources import versioned_store as v


@pytest.fixture(scope="module")
def words(spark):
    return d.positioned(spark.createDataFrame([(f"w{i % 7}é{i:03d}", 1000 - i, i) for i in range(1, 96)], "word string, frequency long, pos long"), 10).persist()


def entries(df):
    return Counter((r["word"], r["rank"], r["chunk_id"]) for r in df.collect())


def test_chunks_round_trip(spark, words, tmp_path):
    folder = str(tmp_path / "c")
    s.write(words, folder)
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == [f"dict_{i:04d}.bin" for i in range(1, 11)]
    assert entries(s.read(spark, folder)) == entries(words) == entries(b.read(spark, folder))
    assert [tuple(r) for r in s.headers(spark, folder).orderBy("id").collect()] == [(i, f"dict_{i:04d}.bin", 10 if i < 10 else 5, 4) for i in range(1, 11)]
    (tmp_path / "c" / "dict_x.bin").write_bytes(b"12345")
    (tmp_path / "c" / "dict_0011.bin").write_bytes(b"12")
    assert {r["id"]: (r["word_count"], r["bytes_read"]) for r in s.headers(spark, folder).filter("id > 9").collect()} == {10: (5, 4), 11: (0, 2)}
    assert s.read(spark, str(tmp_path / "none")).count() == 0


def test_conditions_on_the_number_open_no_other_file(spark, words, tmp_path):
    folder = str(tmp_path / "c")
    s.write(words, folder)
    for name in ("dict_0003.bin", "dict_0005.bin"):
        (tmp_path / "c" / name).write_bytes(struct.pack("<i", 9))
    strict = s.read(spark, folder, "FAILFAST")
    with pytest.raises(Exception, match="inside a record"):
        strict.collect()
    for condition in ("chunk_id = 4", "chunk_id in (1, 7)", "chunk_id > 5 and chunk_id <= 8", "chunk_id < 3 and word > 'w3'", "chunk_id >= 9"):
        found = strict.filter(condition)
        assert entries(found) == entries(words.filter(condition))
    assert strict.filter("chunk_id in (1, 7)").rdd.getNumPartitions() == 2 and s.headers(spark, folder).filter("id = 5").first()["word_count"] == 9


def rows(*found):
    return iter([SimpleNamespace(word=w, rank=r, chunk_id=n) for w, r, n in found])


def test_failed_and_repeated_tasks_leave_one_set(spark, words, tmp_path):
    folder = str(tmp_path / "c")
    own = s.ChunkWriter(folder, True)
    first = own.write(rows(("a", 1, 1), ("b", 2, 1), ("c", 3, 2)))
    again = own.write(rows(("a", 1, 1), ("b", 2, 1), ("c", 3, 2)))
    lost = rows(("d", 4, 3), (None, 5, 3))
    with pytest.raises(ValueError, match="null"):
        own.write(lost)
    assert first != again and s.listed(folder) == []
    own.commit([again, own.write(rows(("e", 5, 4))), None])
    assert [n for n, _ in s.listed(folder)] == [1, 2, 4] and [p.name for p in (tmp_path / "c").iterdir() if p.is_dir()] == []
    assert entries(s.read(spark, folder)) == Counter([("a", 1, 1), ("b", 2, 1), ("c", 3, 2), ("e", 5, 4)])
    # An abort takes all that was staged; what was there stays.
    own = s.ChunkWriter(folder, True)
    own.abort([own.write(rows(("z", 9, 1)))])
    assert entries(s.read(spark, folder))["a", 1, 1] == 1 and [p.name for p in (tmp_path / "c").iterdir() if p.is_dir()] == []
    # A job that fails in one of its tasks.
    broken = words.withColumn("rank", F.when(F.col("chunk_id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("rank")))
    with pytest.raises(Exception, match="lost"):
        s.write(broken, folder)
    assert [n for n, _ in s.listed(folder)] == [1, 2, 4] and [p.name for p in (tmp_path / "c").iterdir() if p.is_dir()] == []
    # Overwriting and appending.
    s.write(words.filter("chunk_id in (2, 3)"), folder)
    assert [n for n, _ in s.listed(folder)] == [2, 3]
    s.write(words.filter("chunk_id = 9"), folder, "append")
    with pytest.raises(Exception, match="chunk 9 is there already"):
        s.write(words.filter("chunk_id in (8, 9)"), folder, "append")
    assert [n for n, _ in s.listed(folder)] == [2, 3, 9] and entries(s.read(spark, folder)) == entries(words.filter("chunk_id in (2, 3, 9)"))
    for bad in ([own.write(rows(("a", 1, 1))), own.write(rows(("b", 2, 1)))],):
        with pytest.raises(ValueError, match="several partitions"):
            own.commit(bad)
    with pytest.raises(ValueError, match="stand together"):
        own.write(rows(("a", 1, 1), ("b", 2, 2), ("c", 3, 1)))


def test_versions(spark, words, tmp_path):
    folder = str(tmp_path / "v")
    with pytest.raises(ValueError):
        v.read(spark, folder)
    assert v.create(words, folder, 4) == 1
    base = v.read(spark, folder)
    more = spark.createDataFrame([("w1é001", 7, 1, 99), ("new", 8, 2, 3)], v.SCHEMA)
    assert v.upsert(more, folder) == 2 and v.upsert(more.withColumn("score", F.col("score") + 5), folder, "last") == 3
    pick = lambda df: {r["word"]: (r["score"], r["chunk_id"]) for r in df.filter("word in ('w1é001', 'new')").collect()}
    assert pick(base) == {"w1é001": (65535, 1)} and base.count() == 95
    assert pick(v.read(spark, folder, version=1)) == {"w1é001": (65535, 1)}
    assert pick(v.read(spark, folder, version=2)) == {"w1é001": (65535, 1), "new": (2, 3)}
    assert pick(v.read(spark, folder)) == {"w1é001": (6, 1), "new": (7, 3)}
    # Additions never move a word between chunks.
    chunks = {r["word"]: r["chunk_id"] for r in words.collect()}
    assert {r["word"]: r["chunk_id"] for r in v.read(spark, folder).filter("word <> 'new'").collect()} == chunks
    want = sorted(map(tuple, v.read(spark, folder).collect()))
    assert v.compact(spark, folder, 2) == 4 and sorted(map(tuple, v.read(spark, folder).collect())) == want
    assert {e["priority"] for e in v.manifest(folder)[1]} == {0} and pick(v.read(spark, folder, version=2))["new"] == (2, 3)
    assert v.vacuum(folder, 2) == 2 and v.versions(folder) == [3, 4] and sorted(map(tuple, v.read(spark, folder, version=3).collect())) == want
    assert v.vacuum(folder) == 1 and sorted(map(tuple, v.read(spark, folder).collect())) == want


def test_two_writers(spark, words, tmp_path, monkeypatch):
    folder = str(tmp_path / "v")
    v.create(words, folder, 2)
    publish = v._publish

    def late(*given):
        monkeypatch.setattr(v, "_publish", publish)
        v.upsert(words.limit(1), folder)
        return publish(*given)

    monkeypatch.setattr(v, "_publish", late)
    with pytest.raises(RuntimeError, match="another writer"):
        v.upsert(words.limit(1), folder)
    assert v.versions(folder) == [1, 2]


def test_a_prefix_opens_its_files(spark, words, tmp_path):
    folder = str(tmp_path / "v")
    v.create(words, folder, 8)
    assert len(v.files_of(folder)) == 8
    for prefix in ("w3é", "w", "w1é0", "", "a", "z", "w3é010"):
        found = v.read(spark, folder, prefix)
        assert sorted(r["word"] for r in found.collect()) == sorted(r["word"] for r in words.collect() if r["word"].startswith(prefix))
    held = v.read(spark, folder, "w3é")
    assert len(held.inputFiles()) == len(v.files_of(folder, "w3é")) <= 3
    answer = lambda df: [tuple(r) for r in c.complete(df, "w3é", 5).orderBy("r").collect()]
    assert answer(held) == answer(words) and len(answer(held)) == 5
    assert v.files_of(folder, "zz") == [] and v.read(spark, folder, "zz").count() == 0
