"""Queries over the driver's tables and their SQL twins. Whole tables throughout; limits only where they are the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as e
from ..operators import complete as c
from ..operators import dictionary as d
from ..operators import prefix_tree as t
from ..operators import requests as q
from ..sources import binary_chunks, chunk_source, versioned_store, word_lists
from ..sources.shared import cut, new_folder
from ..streaming import sessions

BAD_PREFIXES = ("", "12", "aaa", "don't", "١٢", "ééé", "AAa", "a b", "x" * 61, "é", "_", "1a", "aa")


_LOW = "abcdefghijklmnopqrstuvwxyz"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.word_frequencies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.ranked(words(spark, sf_dir))


def request_table(dict_: DataFrame) -> DataFrame:
    """id, p, l: leading strings of up to four characters of every word, as they are and in capitals."""
    some = dict_.select("pos", "word").withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(4), F.char_length("word")))))
    some = some.withColumn("p", F.substring(F.col("word"), F.lit(1), F.col("n")))
    first = some.groupBy("p").agg(F.min("pos").alias("pos"))
    both = first.select("p", "pos").unionByName(first.select(F.translate("p", _LOW, _LOW.upper()).alias("p"), "pos"))
    return both.select(F.concat_ws(":", "p", F.col("pos").cast("string")).alias("id"), "p", (F.col("pos") % 20 + 1).alias("l")).distinct()


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p: values of text columns and fixed bad prefixes."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("p"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("p"))
    phone = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("p"))
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("p"))
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("p"))
    fixed = spark.createDataFrame([(x,) for x in BAD_PREFIXES], "p string")
    return part.union(nation).union(phone).union(kinds).union(keys).union(fixed).distinct()


_DICT = r"""
WITH t AS (SELECT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents),
f AS (SELECT word, count(*) AS frequency FROM t WHERE word <> '' GROUP BY word),
o AS (SELECT word, frequency, row_number() OVER (ORDER BY frequency DESC, word) AS pos FROM f),
d AS (SELECT word, frequency, pos, least(pos, 65535) AS rank, (65536 - least(pos, 65535)) % 65536 AS score, CAST(ceil(pos / 10000.0) AS BIGINT) AS chunk_id FROM o),
c AS (SELECT chunk_id AS id, printf('dict_%04d.bin', chunk_id) AS filename, count(DISTINCT word) AS word_count FROM d GROUP BY chunk_id)
"""
_FIXED = ", ".join("('" + x.replace("'", "''") + "')" for x in BAD_PREFIXES)
_PROBES = f"""
WITH p AS (SELECT p_name AS p FROM part UNION SELECT n_name FROM nation UNION SELECT c_name FROM customer UNION SELECT event_type FROM events
  UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders UNION SELECT * FROM (VALUES {_FIXED}) AS v(p))
"""
_REP = "(strlen({0}) > 2 AND hex({0}) = repeat(hex({0})[1:2], CAST(strlen({0}) AS INT)))"
_VALID = r"({0} <> '' AND NOT regexp_full_match({0}, '\p{{Nd}}+') AND NOT regexp_matches({0}, '[^\p{{L}}\p{{Nd}} _./-]') AND NOT " + _REP + ")"
_THR = "CASE WHEN strlen({0}) <= 2 OR " + _REP + " THEN 24 ELSE 20 END"
_REQUESTS = """,
s AS (SELECT pos, substr(word, 1, CAST(n AS BIGINT)) AS p FROM d, unnest([1, 2, 3, 4]) AS u(n) WHERE n <= length(word)),
g AS (SELECT p, min(pos) AS pos FROM s GROUP BY p),
r AS (SELECT DISTINCT p || ':' || CAST(pos AS VARCHAR) AS id, p, pos % 20 + 1 AS l, lower(p) AS low FROM (SELECT p, pos FROM g UNION ALL SELECT translate(p, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), pos FROM g)),
m AS (SELECT id, p, l, word, score, row_number() OVER (PARTITION BY id ORDER BY word) AS n FROM r JOIN (SELECT word, score, substr(word, 1, CAST(n AS BIGINT)) AS lead FROM d, unnest([1, 2, 3, 4]) AS v(n) WHERE n <= length(word)) ON lead = low AND word <> low AND score >= """ + _THR.format("low") + ")"
_CAPS = "CASE WHEN regexp_matches({p}, '[A-Z]') THEN list_aggregate(list_transform(range(1, length({w}) + 1), lambda i: coalesce(list_filter(list_transform(range(1, length({p}) + 1), lambda j: CASE WHEN strlen(substr({p}, 1, j - 1)) = i - 1 AND regexp_full_match(substr({p}, j, 1), '[A-Z]') THEN substr({p}, j, 1) END), lambda x: x IS NOT NULL)[1], substr({w}, i, 1))), 'string_agg', '') ELSE {w} END"


def _top(prefix: str, limit: int, first: int | None) -> str:
    low = prefix.lower()
    thr = 24 if len(low.encode()) <= 2 else 20
    head = f"(SELECT * FROM d WHERE starts_with(word, '{low}') AND word <> '{low}' AND score >= {thr}" + (f" ORDER BY word LIMIT {first}" if first else "") + ")"
    return _DICT + f"SELECT {_CAPS.format(w='word', p=repr(prefix))} AS w, CAST(score AS BIGINT) AS score, row_number() OVER (ORDER BY score DESC, word) AS r FROM {head} ORDER BY score DESC, word LIMIT {limit}"


def dict_rank_score(spark, sf_dir):
    return dictionary(spark, sf_dir).select("word", "frequency", "pos", "rank", "score")


def dict_chunks(spark, sf_dir):
    return dictionary(spark, sf_dir).select("word", "rank", "chunk_id")


def chunk_info(spark, sf_dir):
    return d.chunk_info(dictionary(spark, sf_dir))


def size_options(spark, sf_dir):
    return d.size_options(chunk_info(spark, sf_dir))


def load_budget(spark, sf_dir):
    return d.chunks_for_budget(chunk_info(spark, sf_dir), d.MAX_WORDS)


def request_more(spark, sf_dir):
    chunks = cut(chunk_info(spark, sf_dir))
    return d.request_more(chunks, chunks.filter("id <= 2").select("id"), 15_000)


def resize(spark, sf_dir):
    dict_ = dictionary(spark, sf_dir)
    return d.active(dict_, d.resize(d.chunk_info(dict_), 2)).select("word", "chunk_id")


def evict(spark, sf_dir):
    return d.evict(dictionary(spark, sf_dir), 1, 3).select("word", "chunk_id")


def loader_stats(spark, sf_dir):
    dict_ = dictionary(spark, sf_dir)
    return d.stats(dict_, d.chunk_info(dict_))


def max_words(spark, sf_dir):
    return chunk_info(spark, sf_dir).agg(F.sum("word_count").cast("long").alias("max_words"), F.count("*").alias("available_chunks"))


def add_word_merge(spark, sf_dir):
    said = d.ranked(d.word_frequencies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return d.add_words(dictionary(spark, sf_dir), said.select("word", "score", F.col("pos").alias("seq")))


def dup_rank_sum(spark, sf_dir):
    said = d.ranked(d.word_frequencies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    both = dictionary(spark, sf_dir).unionByName(said)
    return d.merge_ranks(both, "sum")


def complete_reference(spark, sf_dir):
    return c.complete(dictionary(spark, sf_dir), "th", 10)


def complete_exact(spark, sf_dir):
    return c.complete(dictionary(spark, sf_dir), "Co", 10, "exact")


def complete_callback(spark, sf_dir):
    return c.complete(dictionary(spark, sf_dir), "QUE", 7, "callback")


def complete_batch(spark, sf_dir):
    dict_ = dictionary(spark, sf_dir)
    return c.flat(c.complete_batch(request_table(dict_).repartition("p"), c.postings(dict_)))


def complete_batch_exact(spark, sf_dir):
    dict_ = dictionary(spark, sf_dir)
    return c.flat(c.complete_batch(request_table(dict_).repartition("p"), c.postings(dict_, cap=None), "exact"))


def complete_counts(spark, sf_dir):
    dict_ = dictionary(spark, sf_dir)
    return c.complete_batch(request_table(dict_).repartition("p"), c.postings(dict_)).select("id", F.size("s").cast("long").alias("c"))


def server_validate(spark, sf_dir):
    asked = probes(spark, sf_dir).select("p", (F.octet_length("p").cast("long") * 3 - 10).alias("l"))
    return q.validate(asked).select("p", "status", "error", "code", "l")


def limit_normalize(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 300 - 20).alias("l")).distinct()
    return rows.select("l", e.server_limit(F.col("l")).cast("long").alias("server"), e.browser_limit(F.col("l")).cast("long").alias("browser"))


def threshold(spark, sf_dir):
    return probes(spark, sf_dir).select("p", e.threshold(F.lower("p")).cast("long").alias("least"))


def valid_input(spark, sf_dir):
    p = F.col("p")
    return probes(spark, sf_dir).select("p", e.is_only_numbers(p).alias("numbers"), e.contains_special(p).alias("special"), e.is_repetitive(p).alias("repetitive"), e.is_valid_input(p).alias("valid"))


def capitalize(spark, sf_dir):
    rows = request_table(dictionary(spark, sf_dir)).select("p").distinct()
    return rows.select("p", e.capitalize(F.concat(F.lower("p"), F.lit("xyz")), F.col("p")).alias("w"))


def format_commas(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.floor(F.col("o_totalprice")).cast("long") * 37 - 1_000_000).alias("n")).distinct()
    return rows.select("n", e.format_commas(F.col("n")).alias("s"))


def _lines(spark, sf_dir, *more):
    dict_ = dictionary(spark, sf_dir)
    made = F.when(F.col("pos") % 7 == 0, F.concat("word", F.lit("\t"))).when(F.col("pos") % 7 == 1, F.concat("word", F.lit(" x"))).when(F.col("pos") % 7 == 2, F.concat(F.lit("\t"), F.col("frequency").cast("string"))).when(F.col("pos") % 7 == 3, F.concat("word", F.lit("\tb\t"), F.col("frequency").cast("string"))).when(F.col("pos") % 7 == 4, F.concat("word", F.lit("\t"), F.col("frequency").cast("string"), F.lit("x"))).otherwise(F.concat("word", F.lit("\t"), F.col("frequency").cast("string")))
    return dict_.select(made.alias("value"), *more)


_LINES = _DICT + r""", v AS (SELECT CASE pos % 7 WHEN 0 THEN word || chr(9) WHEN 1 THEN word || ' x' WHEN 2 THEN chr(9) || frequency WHEN 3 THEN word || chr(9) || 'b' || chr(9) || frequency
 WHEN 4 THEN word || chr(9) || frequency || 'x' ELSE word || chr(9) || frequency END AS value FROM d)"""


def wordlist_builder(spark, sf_dir):
    return word_lists.parse_builder(_lines(spark, sf_dir))


def wordlist_browser(spark, sf_dir):
    return word_lists.parse_browser(_lines(spark, sf_dir))


def route_requests(spark, sf_dir):
    x = F.col("event_id") % 9
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"), F.when(x == 0, "get_info").when(x == 1, "set_size").when(x == 2, "explode").when(x == 3, "get_options").alias("action"),
        F.when(x.isin(1, 4), "3").alias("dictionary_size"), F.when(x.isin(4, 5), "1").alias("get_chunk_count"), F.when(x >= 5, F.col("event_type")).alias("p"),
    )
    return q.route(rows).select("id", "route")


def rank_list(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey").cast("long") * 3000 - 9000).alias("n"))
    return n.select("n", F.explode(e.rank_list(F.col("n"))).alias("rank"))


def contains_ci(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", e.contains_ignore_case(F.col("p_name"), F.lit("RE")).alias("has"))


def prefix_ci(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", e.has_prefix_ignore_case(F.col("p_name"), F.lit("PA")).alias("has"))


def contains_digit(spark, sf_dir):
    return probes(spark, sf_dir).select("p", e.contains_numbers(F.col("p")).alias("has"))


def server_answers(spark, sf_dir):
    dict_ = dictionary(spark, sf_dir)
    asked = probes(spark, sf_dir).select(F.col("p").alias("id"), "p", F.lit(5).cast("long").alias("l"))
    words_ = F.array_join(F.transform("s", lambda x: x["w"]), " ").alias("words")
    return q.answer(asked, c.postings(dict_)).select("id", "status", "code", "c", words_)


def binary_roundtrip(spark, sf_dir):
    """Chunks as files' bytes, decoded again, all in the plan."""
    import pandas as pd

    files_ = binary_chunks.contents(dictionary(spark, sf_dir))

    def run(batches):
        for b in batches:
            for name, data in zip(b["filename"], b["content"], strict=True):
                found = list(binary_chunks.decode(data, "FAILFAST"))
                yield pd.DataFrame({"chunk_id": int(name[5:-4]), "word": [w for w, _ in found], "rank": [r for _, r in found]})

    return files_.mapInPandas(run, "chunk_id long, word string, rank long")


def loaded_ids(spark, sf_dir):
    return d.loaded_ids(d.evict(dictionary(spark, sf_dir), 2))


def completer_stats(spark, sf_dir):
    dict_ = dictionary(spark, sf_dir)
    return d.completer_stats(dict_, d.chunk_info(dict_))


def simple_lower(spark, sf_dir):
    odd = F.concat(F.col("p"), F.lit("İ ΣΑΣ"))
    return probes(spark, sf_dir).select("p", e.simple_lower(odd).alias("low"))


def capitalize_words(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.split("p_name", " ").alias("words"), F.substring(F.initcap("p_name"), 1, 2).alias("p"))
    return part.select("p_partkey", F.array_join(e.capitalize_words(F.col("words"), F.col("p")), " ").alias("s"))


def bulk_text(spark, sf_dir):
    lines = _lines(spark, sf_dir, "pos")
    return word_lists.bulk(lines.unionByName(lines.select("value", (F.col("pos") + 10_000_000).alias("pos"))), "pos")


def bulk_text_count(spark, sf_dir):
    return word_lists.bulk_count(_lines(spark, sf_dir))


def bulk_chunks(spark, sf_dir):
    """The second chunk is empty and the fourth broken: the first and third are loaded."""
    files_ = binary_chunks.contents(dictionary(spark, sf_dir))
    name, content = F.col("filename"), F.col("content")
    given = F.when(name == "dict_0004.bin", F.substring(content, F.lit(1), F.length(content) - 1)).when(name != "dict_0002.bin", content)
    return binary_chunks.bulk(files_.select("filename", given.alias("content")))


def complete_browser(spark, sf_dir):
    dict_ = dictionary(spark, sf_dir)
    asked = request_table(dict_).withColumn("l", F.col("l") * 9 - 20)
    return c.complete_browser(asked.repartition("p"), c.postings(dict_)).select("id", F.explode("s").alias("x"), "c").select("id", "x.w", "x.r", "c")


def complete_raw(spark, sf_dir):
    dict_ = dictionary(spark, sf_dir)
    asked = request_table(dict_).withColumn("l", F.col("l") * 11)
    return c.complete_raw(asked.repartition("p"), c.postings(dict_, cap=None)).select("id", F.explode("s").alias("x")).select("id", "x.word", "x.frequency", "x.rank")


def word_frequencies(spark, sf_dir):
    return words(spark, sf_dir)


def tree_nodes(spark, sf_dir):
    """The buckets of the prefix tree with their sizes and best words."""
    found = t.build(dictionary(spark, sf_dir)).filter("not own")
    return found.select("node", "parent", "leaf", "n", F.greatest(F.size("words"), F.size("best")).cast("long").alias("entries"), F.try_element_at("best", F.lit(1))["word"].alias("best"))


def _tree_answers(spark, sf_dir, mode="reference", limit=None, walk=False):
    dict_ = dictionary(spark, sf_dir)
    asked = request_table(dict_)
    if limit:
        asked = asked.withColumn("l", limit(F.col("l")))
    return t.complete_tree(asked, cut(t.build(dict_)), mode, walk=walk)


def complete_tree(spark, sf_dir):
    return c.flat(_tree_answers(spark, sf_dir))


def complete_tree_exact(spark, sf_dir):
    return c.flat(_tree_answers(spark, sf_dir, "exact"))


def complete_tree_raw(spark, sf_dir):
    """Limits of up to 2,200 words, beyond what any summary holds: the tree is walked."""
    found = _tree_answers(spark, sf_dir, "exact", lambda l: l * 110, walk=True)  # noqa: E741
    return found.select("id", F.size("s").cast("long").alias("c"), F.try_element_at(F.col("s"), F.lit(-1))["w"].alias("last"))


def tree_reads(spark, sf_dir):
    """How many entries each request of complete_tree_exact looks at."""
    return _tree_answers(spark, sf_dir, "exact").select("id", "read")


def complete_tree_chunks(spark, sf_dir):
    """Lists by chunk; of the chunks the second and fourth are evicted before requests merge what the others answer."""
    dict_ = dictionary(spark, sf_dir)
    tree = d.evict(cut(t.build(dict_, ("chunk_id",))), 2, 4)
    return c.flat(t.complete_tree(request_table(dict_), tree, by=("chunk_id",)))


def chunk_headers(spark, sf_dir):
    """Chunk files written by the data source, discovered by four bytes each."""
    chunk_source.write(dictionary(spark, sf_dir), folder := new_folder(spark, "chunks"))
    return chunk_source.headers(spark, folder)


def chunk_files(spark, sf_dir):
    """Chunk files written and read by the data source; only those of the chunks asked for are opened."""
    chunk_source.write(dictionary(spark, sf_dir), folder := new_folder(spark, "chunks"))
    return chunk_source.read(spark, folder, "FAILFAST").filter("chunk_id in (1, 3, 4)")


def store_upsert(spark, sf_dir):
    """The documents' dictionary as a store, the conversations' words over it."""
    said = d.ranked(d.word_frequencies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    versioned_store.create(dictionary(spark, sf_dir), folder := new_folder(spark, "store"))
    versioned_store.upsert(said, folder)
    return versioned_store.read(spark, folder)


def store_prefix(spark, sf_dir):
    """Completion over a store of which only the files of the prefix are opened."""
    versioned_store.create(dictionary(spark, sf_dir), folder := new_folder(spark, "store"))
    return c.complete(versioned_store.read(spark, folder, "th"), "th", 10)


def session_answers(spark, sf_dir):
    """Conversations as sessions of a stream: each first sets its own number of chunks, then, after a restart, asks for what its turns begin with."""
    dict_, folder = dictionary(spark, sf_dir), new_folder(spark, "sessions")
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    session, p = F.col("conv_id").cast("string").alias("session"), F.regexp_extract(F.lower("text"), "[a-z]{3}", 0)
    control = said.select("conv_id").distinct().select(session, F.lit(0).alias("n"), F.lit("set").alias("id"), F.lit("set_size").alias("action"), (F.col("conv_id") % 3 + 1).cast("string").alias("chunk_count"))
    asked = said.select(session, F.col("turn").alias("n"), F.lit("ask").alias("id"), p.alias("p"), F.lit(5).alias("l")).filter("p <> ''")
    tree, sizes = cut(t.build(dict_, ("chunk_id",))), q.chunk_sizes(dict_)
    for some in (control, asked):
        some.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(f"{folder}/in")
        messages = sessions.read_messages(spark, f"{folder}/in")
        sessions.serve(messages, tree, sizes, 1, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out/answers").select("session", "n", F.explode("s").alias("x")).select("session", "n", "x.w", "x.r")


_ALL = (
    word_frequencies, dict_rank_score, dict_chunks, chunk_info, size_options, load_budget, request_more, resize, evict, loader_stats, max_words, add_word_merge, dup_rank_sum,
    complete_reference, complete_exact, complete_callback, complete_batch, complete_batch_exact, complete_counts, server_validate, limit_normalize, threshold, valid_input, capitalize,
    format_commas, wordlist_builder, wordlist_browser, route_requests, rank_list, contains_ci, prefix_ci, contains_digit, server_answers, binary_roundtrip,
    loaded_ids, completer_stats, simple_lower, capitalize_words, bulk_text, bulk_text_count, bulk_chunks, complete_browser, complete_raw,
    tree_nodes, complete_tree, complete_tree_exact, complete_tree_raw, tree_reads, complete_tree_chunks, chunk_headers, chunk_files, store_upsert, store_prefix, session_answers,
)
QUERIES = {f.__name__: f for f in _ALL}

_SAID = r""", t2 AS (SELECT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM conversations),
f2 AS (SELECT word, count(*) AS frequency FROM t2 WHERE word <> '' GROUP BY word),
o2 AS (SELECT word, row_number() OVER (ORDER BY frequency DESC, word) AS pos FROM f2),
d2 AS (SELECT word, pos, least(pos, 65535) AS rank, (65536 - least(pos, 65535)) % 65536 AS score, CAST(ceil(pos / 10000.0) AS BIGINT) AS chunk_id FROM o2)"""
_BATCH = _DICT + _REQUESTS + ", k AS (SELECT id, p, l, word, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, word) AS r FROM m {where}) "
_FIRST = "WHERE n <= l + l // 2"
_BROWSER = _DICT + _REQUESTS.replace("pos % 20 + 1 AS l", "CAST({limit} AS BIGINT) AS l")+ ", k AS (SELECT id, p, l, word, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, word) AS r FROM m WHERE n <= l + l // 2) "

#: Buckets: leading strings of more than 256 words, and those below them. Of a bucket's words only those that reach its threshold are summarised.
_TREE = _DICT + """,
  x AS (SELECT word, score, n AS depth, substr(word, 1, CAST(n AS BIGINT)) AS node FROM (SELECT word, score, unnest(range(1, length(word) + 1)) AS n FROM d)),
  s AS (SELECT node, max(depth) AS depth, count(*) AS n FROM x GROUP BY node),
  b AS MATERIALIZED (
    SELECT s.node, CASE WHEN depth > 1 THEN left(s.node, CAST(depth - 1 AS BIGINT)) END AS parent, n, n <= 256 AS leaf FROM s
    WHERE depth = 1 OR left(s.node, CAST(depth - 1 AS BIGINT)) IN (SELECT node FROM s WHERE n > 256)),
  fit AS (
    SELECT node, count(*) AS n_ok, arg_min(word, (-score, word)) AS best FROM x SEMI JOIN (SELECT node FROM b WHERE NOT leaf) USING (node)
    WHERE score >= """ + _THR.format("node") + """ GROUP BY node),
  buckets AS (SELECT node, parent, leaf, n, CASE WHEN leaf THEN n ELSE least(257, coalesce(n_ok, 0)) END AS entries, best FROM b LEFT JOIN fit USING (node))
"""

ORACLE_SQL = {
    "chunk_headers": _DICT + "SELECT CAST(id AS INTEGER) AS id, filename, word_count, CAST(4 AS BIGINT) AS bytes_read FROM c",
    "chunk_files": _DICT + "SELECT word, CAST(rank AS INTEGER) AS rank, CAST(chunk_id AS INTEGER) AS chunk_id FROM d WHERE chunk_id IN (1, 3, 4)",
    "store_upsert": _DICT + _SAID + """ SELECT word, rank, score, chunk_id FROM d
UNION ALL SELECT word, least(pos, 65535), score, chunk_id FROM d2 WHERE word NOT IN (SELECT word FROM d)""",
    "store_prefix": _top("th", 10, 15),
    "session_answers": _DICT
    + """, q AS (
  SELECT row_number() OVER () AS i, CAST(conv_id AS VARCHAR) AS session, turn AS n, regexp_extract(lower(text), '[a-z]{3}') AS p, least(conv_id % 3 + 1, (SELECT count(*) FROM c)) AS active
  FROM conversations),
m AS (
  SELECT i, session, n, word, score, row_number() OVER (PARTITION BY i ORDER BY word) AS k
  FROM q JOIN d ON left(word, 3) = p AND word <> p AND chunk_id <= active AND score >= 20
  WHERE p <> '' AND NOT """ + _REP.format("p") + """)
SELECT session, n, word AS w, row_number() OVER (PARTITION BY i ORDER BY score DESC, word) AS r FROM m WHERE k <= 7
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, word) <= 5""",
    "tree_nodes": _TREE + "SELECT * FROM buckets",
    "complete_tree": _BATCH.replace("{where}", _FIRST) + f"SELECT id, {_CAPS.format(w='word', p='p')} AS w, r, CAST(score AS BIGINT) AS score FROM k WHERE r <= l",
    "complete_tree_exact": _BATCH.replace("{where}", "") + f"SELECT id, {_CAPS.format(w='word', p='p')} AS w, r, CAST(score AS BIGINT) AS score FROM k WHERE r <= l",
    "complete_tree_raw": _BATCH.replace("{where}", "").replace("pos % 20 + 1 AS l", "(pos % 20 + 1) * 110 AS l")
    + f""", a AS (SELECT id, count(*) AS c, arg_max({_CAPS.format(w='word', p='p')}, r) AS last FROM k WHERE r <= l GROUP BY id)
SELECT r.id, coalesce(c, 0) AS c, last FROM r LEFT JOIN a ON a.id = r.id""",
    "tree_reads": _TREE + _REQUESTS[: _REQUESTS.index("m AS (")].rstrip().rstrip(",").replace("s AS (SELECT pos", "y AS (SELECT pos").replace("FROM s GROUP", "FROM y GROUP")
    + """, found AS (SELECT id, max(entries) AS read FROM r JOIN buckets ON left(low, CAST(length(node) AS BIGINT)) = node AND (leaf OR node = low) GROUP BY id)
SELECT r.id, coalesce(read, 0) AS read FROM r LEFT JOIN found ON found.id = r.id""",
    "complete_tree_chunks": _BATCH.replace("{where}", _FIRST).replace("AS lead FROM d,", "AS lead FROM (SELECT * FROM d WHERE chunk_id NOT IN (2, 4)) AS e,")
    + f"SELECT id, {_CAPS.format(w='word', p='p')} AS w, r, CAST(score AS BIGINT) AS score FROM k WHERE r <= l",
    "word_frequencies": _DICT + "SELECT word, frequency FROM f",
    "dict_rank_score": _DICT + "SELECT word, frequency, pos, rank, score FROM d",
    "dict_chunks": _DICT + "SELECT word, rank, chunk_id FROM d",
    "chunk_info": _DICT + "SELECT * FROM c",
    "size_options": _DICT + "SELECT count(*) OVER w AS chunk_count, CAST(sum(word_count) OVER w AS BIGINT) AS word_count, CAST(CAST(sum(word_count) OVER w AS BIGINT) // 1000 AS VARCHAR) || 'K words' AS size_label FROM c WINDOW w AS (ORDER BY id)",
    "load_budget": _DICT + "SELECT id FROM (SELECT id, coalesce(sum(word_count) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c) WHERE b < 50000",
    "request_more": _DICT + "SELECT id FROM (SELECT id, coalesce(sum(word_count) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c WHERE id > 2) WHERE b < 15000",
    "resize": _DICT + "SELECT word, chunk_id FROM d WHERE chunk_id <= 2",
    "evict": _DICT + "SELECT word, chunk_id FROM d WHERE chunk_id NOT IN (1, 3)",
    "loader_stats": _DICT + "SELECT count(*) AS total_words, count(DISTINCT chunk_id) AS loaded_chunks, CAST(max(score) AS BIGINT) AS max_frequency, count(DISTINCT chunk_id) AS available_chunks FROM d",
    "max_words": _DICT + "SELECT CAST(sum(word_count) AS BIGINT) AS max_words, count(*) AS available_chunks FROM c",
    "add_word_merge": _DICT + _SAID + " SELECT word, score FROM d UNION ALL SELECT word, score FROM d2 WHERE word NOT IN (SELECT word FROM d)",
    "dup_rank_sum": _DICT + _SAID + " SELECT chunk_id, word, CAST(sum(rank) % 65536 AS BIGINT) AS rank FROM (SELECT chunk_id, word, rank FROM d UNION ALL SELECT chunk_id, word, rank FROM d2) GROUP BY chunk_id, word",
    "complete_reference": _top("th", 10, 15),
    "complete_exact": _top("Co", 10, None),
    "complete_callback": _top("QUE", 7, 14),
    "complete_batch": _BATCH.replace("{where}", _FIRST) + f"SELECT id, {_CAPS.format(w='word', p='p')} AS w, r, CAST(score AS BIGINT) AS score FROM k WHERE r <= l",
    "complete_batch_exact": _BATCH.replace("{where}", "") + f"SELECT id, {_CAPS.format(w='word', p='p')} AS w, r, CAST(score AS BIGINT) AS score FROM k WHERE r <= l",
    "complete_counts": _BATCH.replace("{where}", _FIRST) + "SELECT r.id, count(k.word) AS c FROM r LEFT JOIN k ON r.id = k.id AND k.r <= k.l GROUP BY r.id",
    "server_validate": _PROBES + f"SELECT p, CASE WHEN p = '' OR strlen(p) > 60 THEN 'error' WHEN NOT {_VALID.format('p')} THEN 'empty' ELSE 'ok' END AS status, CASE WHEN p = '' THEN 'empty prefix' WHEN strlen(p) > 60 THEN 'prefix too long (max: 60)' END AS error, CASE WHEN p = '' OR strlen(p) > 60 THEN CAST(400 AS BIGINT) END AS code, CAST(least(CASE WHEN strlen(p) * 3 - 10 <= 0 THEN 32 ELSE strlen(p) * 3 - 10 END, 64) AS BIGINT) AS l FROM p",
    "limit_normalize": "SELECT l, CAST(least(CASE WHEN l <= 0 THEN 32 ELSE l END, 64) AS BIGINT) AS server, CAST(least(CASE WHEN l <= 0 THEN 20 ELSE l END, 128) AS BIGINT) AS browser FROM (SELECT DISTINCT event_id % 300 - 20 AS l FROM events)",
    "threshold": _PROBES + f"SELECT p, CAST({_THR.format('lower(p)')} AS BIGINT) AS least FROM p",
    "valid_input": _PROBES + r"SELECT p, regexp_full_match(p, '\p{Nd}+') AS numbers, regexp_matches(p, '[^\p{L}\p{Nd} _./-]') AS special, " + _REP.format("p") + " AS repetitive, " + _VALID.format("p") + " AS valid FROM p",
    "capitalize": _DICT + _REQUESTS + ", x AS (SELECT DISTINCT p, lower(p) || 'xyz' AS w FROM r) SELECT p, " + _CAPS.format(w="w", p="p") + " AS w FROM x",
    "format_commas": "SELECT n, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE format('{:,}', n) END AS s FROM (SELECT DISTINCT CAST(floor(o_totalprice) AS BIGINT) * 37 - 1000000 AS n FROM orders)",
    "wordlist_builder": _LINES + r" SELECT value, regexp_extract(value, '^(.*?)\t([0-9]+)', 1) AS word, CAST(regexp_extract(value, '^(.*?)\t([0-9]+)', 2) AS BIGINT) AS frequency FROM v WHERE regexp_matches(value, '^(.*?)\t([0-9]+)')",
    "wordlist_browser": _LINES + r" SELECT value, substr(value, 1, instr(value, chr(9)) - 1) AS word, coalesce(TRY_CAST(regexp_extract(substr(value, instr(value, chr(9)) + 1), '^[0-9]*') AS BIGINT), 0) AS frequency FROM v WHERE instr(value, chr(9)) > 1 AND instr(value, chr(9)) < length(value)",
    "route_requests": "SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'get_info' WHEN 1 THEN 'set_size' WHEN 2 THEN 'unknown_action' WHEN 3 THEN 'get_options' WHEN 4 THEN 'set_size' WHEN 5 THEN 'get_chunk_count' ELSE 'completion' END AS route FROM events",
    "rank_list": "SELECT n, unnest(range(1, n + 1)) % 65536 AS rank FROM (SELECT CAST(n_nationkey AS BIGINT) * 3000 - 9000 AS n FROM nation) WHERE n > 0",
    "contains_ci": "SELECT p_partkey, contains(lower(p_name), 're') AS has FROM part",
    "prefix_ci": "SELECT p_partkey, starts_with(lower(p_name), 'pa') AS has FROM part",
    "contains_digit": _PROBES + r"SELECT p, regexp_matches(p, '\p{Nd}') AS has FROM p",
    "loaded_ids": _DICT + "SELECT DISTINCT chunk_id AS id FROM d WHERE chunk_id <> 2",
    "completer_stats": _DICT + ", x AS (SELECT count(*) AS n, CAST(max(score) AS BIGINT) AS m, count(DISTINCT chunk_id) AS k FROM d) SELECT 'totalWords' AS name, n AS value FROM x UNION ALL SELECT 'maxFrequency', m FROM x UNION ALL SELECT 'loadedChunks', k FROM x UNION ALL SELECT 'availableChunks', k FROM x UNION ALL SELECT 'chunkLoader', CAST(1 AS BIGINT) FROM x",
    "simple_lower": _PROBES + "SELECT p, lower(p || 'İ ΣΑΣ') AS low FROM p",
    "capitalize_words": "WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2, 1)) AS p FROM part) SELECT p_partkey, string_agg(" + _CAPS.format(w="w", p="p") + ", ' ' ORDER BY i) AS s FROM t GROUP BY p_partkey",
    "bulk_text": _LINES.replace(" AS value FROM d)", " AS value, pos FROM d)") + r", y AS (SELECT pos, substr(value, 1, instr(value, chr(9)) - 1) AS word, coalesce(TRY_CAST(regexp_extract(substr(value, instr(value, chr(9)) + 1), '^[0-9]*') AS BIGINT), 0) AS frequency FROM v WHERE instr(value, chr(9)) > 1 AND instr(value, chr(9)) < length(value)) SELECT word, arg_min(frequency, pos) AS score FROM y GROUP BY word",
    "bulk_text_count": _LINES + " SELECT count(*) AS words FROM v WHERE instr(value, chr(9)) > 1 AND instr(value, chr(9)) < length(value)",
    "bulk_chunks": _DICT + "SELECT chunk_id, word, rank FROM d WHERE chunk_id < CASE WHEN EXISTS (SELECT 1 FROM d WHERE chunk_id = 4) THEN 4 ELSE 1000000 END AND chunk_id <> 2",
    "complete_browser": _BROWSER.replace("{limit}", "least(CASE WHEN (pos % 20 + 1) * 9 - 20 <= 0 THEN 20 ELSE (pos % 20 + 1) * 9 - 20 END, 128)") + f"SELECT id, {_CAPS.format(w='word', p='p')} AS w, r, count(*) OVER (PARTITION BY id) AS c FROM k WHERE r <= l",
    "complete_raw": _BROWSER.replace("{limit}", "(pos % 20 + 1) * 11") + f"SELECT id, {_CAPS.format(w='word', p='p')} AS word, CAST(score AS BIGINT) AS frequency, r AS rank FROM k WHERE r <= l",
    "server_answers": _DICT + _PROBES.replace("WITH p AS", ", p AS")
    + f""", a AS (
  SELECT p, lower(p) AS low, CASE WHEN p = '' OR strlen(p) > 60 THEN 'error' WHEN NOT {_VALID.format('p')} THEN 'empty' ELSE 'ok' END AS status FROM p),
n AS (
  SELECT p, low, word, score, row_number() OVER (PARTITION BY p ORDER BY word) AS k
  FROM a JOIN d ON left(word, 1) = left(low, 1) AND starts_with(word, low) AND word <> low AND score >= {_THR.format('low')} WHERE status = 'ok'),
b AS (SELECT p, word, row_number() OVER (PARTITION BY p ORDER BY score DESC, word) AS r FROM n WHERE k <= 7),
w AS (SELECT p, count(*) AS c, string_agg({_CAPS.format(w='word', p='p')}, ' ' ORDER BY r) AS words FROM b WHERE r <= 5 GROUP BY p)
SELECT a.p AS id, status, CASE WHEN status = 'error' THEN CAST(400 AS BIGINT) END AS code, CASE WHEN status <> 'error' THEN coalesce(c, 0) END AS c,
  CASE WHEN status <> 'error' THEN coalesce(words, '') END AS words
FROM a LEFT JOIN w ON w.p = a.p""",
    "binary_roundtrip": _DICT + "SELECT chunk_id, word, rank FROM d",
}
