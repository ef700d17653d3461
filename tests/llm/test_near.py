"""Operators 3 and 9 against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexispark.llm import fingerprints, graph, near_copies, queries, simhash_dedup


def brute_fp(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in low.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    fps = [brute_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    least = {k: min((rows[i][0] for i in v if rows[i][0] is not None), default=None) for k, v in members.items()}
    return Counter((rows[i][0], f"{fps[i]:016x}", least[find(i)]) for i in range(len(rows)))


def test_query(spark, sf_dir, texts):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op3_simhash_dedup(spark, sf_dir).collect())
    assert got == brute_groups(list(texts.items()))


def test_edges(edges, nothing):
    rows, df = edges
    got = Counter((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in simhash_dedup.groups(df, tile=2).collect())
    assert got == brute_groups([r[:2] for r in rows])
    assert simhash_dedup.groups(nothing).count() == 0
    kept = simhash_dedup.keep_one(df).collect()
    assert len(kept) == len({c for _, _, c in brute_groups([r[:2] for r in rows])})


def test_texts_without_or_with_equal_ids_stay_apart(spark):
    texts = ["a first text about ships and the sea", "some other words on trains and rails", "third one that names birds of the north"]
    rows = [(i, t) for i in (None, 7) for t in texts] + [(None, texts[0]), (8, texts[1])]
    # The ids of the rows differ, so the texts of both lots are the same three groups.
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted((7, t) for t in texts)
    kept = simhash_dedup.keep_one(spark.createDataFrame([r for r in rows if r[0] is None], "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in kept) == sorted(texts)


def test_dense_groups_and_tiles(spark):
    """Chains and clouds of fingerprints, with tiles of few rows: the components of all links."""
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(20):
        x = int(rng.integers(0, 2**63))
        for _ in range(40):
            for b in rng.integers(0, 64, 2):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash_dedup.signed(x),) for x in fps], "fp long")
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    want = {frozenset(simhash_dedup.signed(y) for y in fps if find(y) == find(x)) for x in fps}
    for tile in (3, 2048):
        found = defaultdict(set)
        for r in graph.components(simhash_dedup.edges(nodes, tile=tile)).collect():
            found[r["component"]].add(r["node"])
        assert {frozenset(v) for v in found.values()} == {w for w in want if len(w) > 1}
        assert all(k == min(v) for k, v in found.items())


def brute_copies(rows, least=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b) - 1e-9:
                parent[find(i)] = find(j)
    return {frozenset(rows[i][0] for i in range(len(rows)) if find(i) == find(k)) for k in range(len(rows))}


def test_near_copies(spark):
    """The stage keeps one of each component of Jaccard similarity 0.8 over five words, also where SimHash is far."""
    rng = np.random.default_rng(5)
    rows = [(0, None), (1, ""), (2, "Two words"), (3, "two  words\n")]
    for _ in range(25):
        text = [f"w{x}" for x in rng.integers(0, 10_000, rng.integers(40, 400))]
        for _ in range(8):
            rows.append((len(rows), " ".join(text)))
            if rng.random() < 0.3:
                text = text[: int(len(text) * rng.uniform(0.75, 1))]
            for at in rng.integers(0, len(text), rng.integers(0, 2 + len(text) // 40)):
                text[at] = f"x{rng.integers(0, 10_000)}"
    want = brute_copies(rows)
    far = [g for g in want if len(g) > 1 and max((brute_fp(rows[a][1]) ^ brute_fp(rows[b][1])).bit_count() for a in g for b in g) > 4]
    assert len(far) > 10 and len(want) > 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (2, 2048):
        found = defaultdict(set)
        for r in near_copies.groups(df, tile=tile).collect():
            found[r["component"]].add(r["doc_id"])
        assert set(map(frozenset, found.values())) == want
    kept = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(map(min, want))


def test_stage_takes_the_components_of_simhash(spark, monkeypatch):
    """What op3's method links and the sets confirm is linked where no band is shared; what they don't confirm is not."""
    rng = np.random.default_rng(9)
    own = lambda n: [f"w{x}" for x in rng.integers(0, 10_000, n)]
    long, body = own(400), ["red", "green", "blue"] * 200
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-1], "end"])), (3, " ".join(body + own(12))), (4, " ".join(body + own(12))), (5, " ".join(own(40))), (6, None), (7, "")]
    near = lambda a, b: (brute_fp(rows[a][1]) ^ brute_fp(rows[b][1])).bit_count() <= 4
    assert near(0, 1) and near(2, 3) and not near(0, 4) and len(brute_copies(rows)) == 5
    df = spark.createDataFrame([*rows, rows[0], (None, rows[1][1])], "doc_id long, text string")
    monkeypatch.setattr(near_copies, "bands", lambda hashes: [])
    for tile in (1, 2048):
        found = near_copies.groups(df, simhash_dedup.groups(df), tile=tile)
        assert found.count() == 9 and found.select("component").distinct().count() == 5
    kept = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4, 5, 6]


def test_links_to_a_centre(spark):
    """Links between two slots as by plain sets; a group whose sets are all linked to its centre leaves nothing to compare."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.choice(40, rng.integers(1, 30))).astype("u8") for _ in range(120)]
    like = lambda a, b: len({*a.tolist()} & {*b.tolist()}) / len({*a.tolist()} | {*b.tolist()})
    got = dict(near_copies.attached(sets[:70], sets[70:], 0.5))
    for i, x in enumerate(sets[70:]):
        assert like(x, sets[got[i]]) >= 0.5 if i in got else all(like(x, y) < 0.5 for y in sets[:70])
    base = np.arange(1000, dtype="u8")
    rows = [(1, i, 1000, np.sort(np.append(base[base != i], np.uint64(5000 + i))).tobytes(), 10, 0) for i in range(50)]
    big = spark.createDataFrame(rows, "grp long, node long, n long, hashes binary, slots int, centre long")
    shown = near_copies.stars(big).collect()
    assert sorted(r["node"] for r in shown) == list(range(50)) and all(r["star"] for r in shown)


def test_near_copies_edges(spark, edges, nothing):
    rows, df = edges
    assert corpus_pipeline.drop_near_copies(spark, df, "").columns == df.columns
    assert corpus_pipeline.drop_near_copies(spark, df, "").count() == len({t or "" for _, t, *_ in rows})
    assert corpus_pipeline.drop_near_copies(spark, nothing, "").count() == 0


def test_components_of_a_path(spark):
    e = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in graph.components(e).collect()} == {0}
    assert graph.components(e.limit(0)).count() == 0


def brute_vote(text):
    import re

    words = re.split(r"[\x20\x09-\x0D]+", (text or "").lower())
    votes = [0] * 64
    for i, w in enumerate(words):
        rest = words[i + 1 : i + 2]
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        for y in rest:
            h = xxhash.xxh64_intdigest(y.encode(), h)
        weight = 1 + min(3, (len(w) + sum(map(len, rest))) // 8)
        for b in range(64):
            votes[b] += weight if h >> b & 1 else -weight
    return sum(1 << b for b in range(64) if votes[b] > 0)


def brute_compare(rows):
    rows = [(i, t or "", k) for i, t, k in rows]
    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
    out = {}
    for n, (i, t, k) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = brute_vote(t), brute_vote(edited), brute_vote(after)
        out[i, t, k] = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64)
    return Counter(out[r] for r in rows)


def digest(df):
    like = fingerprints.likeness
    cols = ["doc_id", "n_chars", "edited_sha256", fingerprints.as_hex(F.col("fp")), fingerprints.as_hex(F.col("edited_fp")), like(F.col("fp"), F.col("edited_fp")), like(F.col("fp"), F.col("next_fp"))]
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_fingerprint_query(spark, sf_dir, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", fingerprints.key_of()).collect()]
    got = queries.op9_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert Counter(map(tuple, got)) == brute_compare(rows)


def test_fingerprint_edges(edges, nothing, monkeypatch):
    _, df = edges
    df = df.filter("doc_id is null or doc_id <> 6")  # Java and Python lower-case a dotted I apart
    rows = [tuple(r) for r in df.select("doc_id", "text", fingerprints.key_of()).collect()]
    assert digest(fingerprints.compare(df)) == brute_compare(rows)
    whole = fingerprints.following
    monkeypatch.setattr(fingerprints, "following", lambda ids: whole(ids, per_bucket=2))
    monkeypatch.setattr(fingerprints, "POSITIONS", 3)
    assert digest(fingerprints.compare(df)) == brute_compare(rows)
    assert fingerprints.compare(nothing).count() == 0


def test_long_texts_of_one_heavy_word(spark):
    """Each of 20,000 pairs votes 4 for the same bits, also for the highest lane's."""
    texts = [" ".join(w * 26 for _ in range(20_000)) for w in "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] % 2**64 for r in fingerprints.vote(df, ["doc_id"]).collect()}
    want = {i: xxhash.xxh64_intdigest((t[:26]).encode(), xxhash.xxh64_intdigest(t[:26].encode(), 42)) for i, t in enumerate(texts)}
    assert got == want and any(x >> 63 for x in want.values())


def test_search(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 50)]
    fps = sorted({x ^ sum(1 << int(b) for b in set(rng.integers(0, 64, k))) for x in base for k in range(6)})
    df = spark.createDataFrame([(x if x < 2**63 else x - 2**64,) for x in fps], "fp long")
    for radius, blocks in ((3, 5), (2, 4), (0, 1)):
        want = {(a, b, (a ^ b).bit_count()) for a in fps[::7] for b in fps if (a ^ b).bit_count() <= radius}
        got = fingerprints.within(df, df.filter(F.col("fp").isin([x if x < 2**63 else x - 2**64 for x in fps[::7]])), radius, blocks).collect()
        assert {(r["query"] % 2**64, r["fp"] % 2**64, r["distance"]) for r in got} == want


def test_components_with_hubs(spark):
    """A node that most others hang on, directly or by chains, with its edges spread."""
    edges = [(0 if i % 3 else i - 1, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(0, 20, 2)] + [(5, 5), (2000, 399)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = {x: find(x) for x in parent}
    for hub in (10, graph.HUB):
        assert {r["node"]: r["component"] for r in graph.components(df, hub=hub).collect()} == want


def test_components_take_tasks_by_their_edges(spark, monkeypatch):
    """Rounds over few edges write few files, however many shuffle partitions are set; edges that are stars already take no round."""
    parts, whole = [], graph.cut

    def cut(df):
        out = whole(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(graph, "cut", cut)
    stars = spark.createDataFrame([(i % 5, i) for i in range(5, 200)], "a long, b long")
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert {r["node"]: r["component"] for r in graph.components(stars).collect()} == {i: i % 5 for i in range(200)}
        assert len(parts) == 1
        for edges, most in ((graph.EDGES, 4), (7, 9)):
            monkeypatch.setattr(graph, "EDGES", edges)
            parts.clear()
            assert {r["node"]: r["component"] for r in graph.components(path).collect()} == dict.fromkeys(range(61), 0)
            assert len(parts) > 2 and parts[0] == 20 and max(parts[1:]) <= most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
