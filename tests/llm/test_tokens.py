"""Operators 2, 6 and 10 against the libraries on whole texts."""

import hashlib
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexispark.llm import bpe, queries, token_counts, token_store


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def expected_bpe(text):
    ids = bpe.encoding(bpe.default_path()).encode_ordinary(text or "")
    return len(ids), sha(" ".join(map(str, ids))), sha((text or "").encode())


def test_bpe_query(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op2_byte_bpe(spark, sf_dir).collect()}
    assert got == {i: expected_bpe(t) for i, t in texts.items()}


@pytest.mark.parametrize("chunk", [1, 7, 100, 32768])
def test_bpe_chunks(edges, chunk):
    rows, df = edges
    got = bpe.digests(bpe.encode(df, chunk=chunk, overlap=3)).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == Counter((r[0], *expected_bpe(r[1])) for r in rows)


def test_pipeline_stage_decodes(spark, edges):
    import corpus_pipeline

    rows, df = edges
    got = corpus_pipeline.encode(spark, df, "").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == Counter((r[0], len(bpe.encoding(bpe.default_path()).encode_ordinary(r[1] or "")), sha(r[1] or "")) for r in rows)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)


def test_bpe_random_texts(spark):
    rng, made = random.Random(5), []
    for _ in range(300):
        made.append("".join(rng.choice(["a", "the", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "ß", "!?", " ", "　", "漢字", "\U0001f600", "\x1c"]) for _ in range(rng.randrange(60))))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for chunk in (5, 50):
        got = {r["doc_id"]: r["ids_sha256"] for r in bpe.digests(bpe.encode(df, chunk=chunk, overlap=1)).collect()}
        assert got == {i: expected_bpe(t)[1] for i, t in enumerate(made)}
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count(df).collect()} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(made)}


def test_counts(spark, sf_dir, texts, edges, nothing):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op6_token_counts(spark, sf_dir).collect()}
    assert got == {i: (len(t.encode()), n(t), n(t) > 1024) for i, t in texts.items()}
    rows, df = edges
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count(df).collect()) == Counter((r[0], n(r[1])) for r in rows)
    assert token_counts.count(nothing).count() == bpe.encode(nothing).count() == 0


@lru_cache(1)
def word_tokenizer():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def word_ids(text):
    return [*word_tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def test_store_random_texts(spark):
    """Case, signs, accents, contractions and letters that change in lower case: the ids are the library's."""
    rng, made = random.Random(7), []
    parts = ["Foo", "foo", "'s", "'", "'T", "bar's,", "É", "é", "ÿ", "ß", "ẞ", "×", "÷", "µ", "ª", "K", "Å", "İ", "\u0301", "e\u0301", "Σ", "ς", "...", ",", "_", "-", "\n", "\r\n", " ", "  ", "\t", "12", "\xa0", "\x85", "\x1c", "\u2028", "漢", "x" * 60, "J\u030c", "İ.", "<|ENDOFTEXT|>", "*", ")", "!?", "</w>", "\x1f", "²"]
    for _ in range(1200):
        made.append("".join(rng.choice(parts) for _ in range(rng.randrange(25))))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in token_store.encode(df).collect()}
    assert got == {i: word_ids(t) for i, t in enumerate(made)}


def test_store_words_that_are_not_held(monkeypatch):
    """Long words at any place of a text, in one batch after another, and more words than are held."""
    monkeypatch.setattr(token_store, "HELD", 5)
    words, _ = token_store._encoder(token_store.default_path(), "<u2")
    long = "y" * 70
    for texts in ([f"a {long}"], [f"{long} b", long], ["", "c d. E, f g H i"], [f"{long}\n{long}z, a"], []):
        got = token_store._looked_up(token_store._words(pa.array(texts, pa.string())), words)
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [word_ids(t)[:-1] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_query(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op10_token_store(spark, sf_dir).collect()}
    at, want = 0, {}
    for i in sorted(texts):
        ids = word_ids(texts[i])
        want[i] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def test_store_edges(spark, edges, nothing, tmp_path):
    rows, df = edges
    folder = f"file://{tmp_path}/a"
    manifest = token_store.write(df, folder, frame_bytes=64, file_bytes=4000, per_file=4)
    got = token_store.read(manifest, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(x := word_ids(r[1])), crc(x)) for r in rows)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [sum(x["n_tokens"] for x in order[:k]) for k in range(len(order))]
    assert [r["doc_id"] is not None and r["doc_id"] for r in order] == sorted(r["doc_id"] is not None and r["doc_id"] for r in order)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_store.read(manifest, folder, [4, 9, 77]).collect()) == Counter((i, len(word_ids(t))) for i, t, *_ in rows if i in (4, 9))
    assert token_store.read(token_store.write(nothing, f"file://{tmp_path}/b"), f"file://{tmp_path}/b").count() == 0


def test_reader_takes_only_the_frames_it_needs_and_checks_them(tmp_path):
    import zstandard

    path = tmp_path / "x.zst"
    with open(path, "wb") as f:
        w = token_store.Writer(f, "<u2", frame_bytes=100)
        for i in range(50):
            w.add(i * 2, np.arange(i, i + 30, dtype="<u2").tobytes())
        w.close()
    data, asked = path.read_bytes(), []

    def read(a, n):
        asked.append((a, n))
        return data[a : a + n]

    r = token_store.Reader(read, len(data))
    head = len(asked)
    assert r.find(40)[0].tolist() == list(range(20, 50)) and len(asked) == head + 1
    assert r.find(41) == []
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(whole) == 50 * 60
    broken = bytearray(data)
    k = int(r.frame_of[20])
    broken[int(r.at[k]) + 8] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        token_store.Reader(lambda a, n: bytes(broken[a : a + n]), len(data)).find(40)


def test_counts_by_the_shuffled_join(spark, edges):
    """Few pre-tokens go to every task, the others are joined; pre-tokens with NUL among them."""
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    rows, df = edges
    rng = random.Random(11)
    made = [" ".join(rng.choice(["the", "cat", f"w{rng.randrange(900)}", "a\x00b", "\x00\x00", "<|endoftext|>x", "Ünï"]) for _ in range(rng.randrange(80))) for _ in range(400)]
    more = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    for hot in (1, 20):
        assert Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count(df, hot=hot).collect()) == Counter((r[0], n(r[1])) for r in rows)
        assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count(more, hot=hot).collect()} == {i: n(t) for i, t in enumerate(made)}


def test_counts_of_another_kind_of_tokenizer(spark):
    """A file whose rules are not known is asked about whole texts."""
    texts = ["Hello  World's <|endoftext|> x", "", "It's 12,345!"]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("word_bpe_49k.json")).collect()}
    assert got == {i: len(word_tokenizer().encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_store_of_another_kind_of_tokenizer(spark):
    texts = ["Hello  World's x", "", " It's 12,345!\n\n"]
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.encode(df, P.path("byte_bpe_50k.json"), 50256, "<u4").collect()}
    assert got == {i: [*other.encode(t, add_special_tokens=False).ids, 50256] for i, t in enumerate(texts)}


def test_store_extreme_ids_and_files_opened(spark, tmp_path, monkeypatch):
    """The least id is an id, a null none; of given documents only their files are opened; files are read by several tasks."""
    ids = [None, -(2**63), 2**63 - 1, *range(0, 4000, 2)]
    df = spark.createDataFrame([(i, f"text of {i}", 1) for i in ids], "doc_id long, text string, start int")
    folder = f"file://{tmp_path}/c"
    manifest = token_store.write(df, folder, per_file=100)
    assert Counter(r["doc_id"] for r in token_store.read(manifest, folder).collect()) == Counter(ids)
    files = manifest.count()
    assert files >= 20 and token_store.read(manifest, folder).rdd.getNumPartitions() == files
    kept = {r["name"] for r in manifest.collect() if r["least"] <= -(2**63) or (r["least"] or 0) <= 1000 <= (r["most"] or 0)}
    for p in (tmp_path / "c").iterdir():
        if p.name not in kept:
            p.unlink()
    assert sorted(r["doc_id"] for r in token_store.read(manifest, folder, [1000, 1001, -(2**63)]).collect()) == [-(2**63), 1000]
