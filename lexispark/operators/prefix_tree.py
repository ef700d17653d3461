"""A dictionary as a table of prefix buckets of variable depth, with the best words of each.

A bucket is a leading string. One with more than `bucket` words is split by its next character; what is split is an inner node, what is
not is a leaf, and every node's parent is an inner node. A leaf has all its words, at most `bucket`. An inner node has two summaries of
bounded length instead of a list: the first and the best of the words that a request for exactly that prefix may return. They come from
limits by rank that Spark also applies before it shuffles, so a node never gathers more than the summaries' length from any task.

A request is routed to the longest matching bucket: the inner node that equals its prefix, or the leaf above it. It reads that one row,
so at most max(bucket, k + 1) entries, however many words there are. Requests that ask more than a summary holds walk the tree: as long as
an unread word of a summarised node could come before the last word of the answer, that node is replaced by its children.

Tables may be built by chunk (`by`): a chunk's rows then stand alone, so that loading or evicting a chunk touches its rows only, and a
request merges what its active chunks answer.

tree: by..., node, own, parent (null for single characters), leaf, n (words below it), words (leaf: all in word order; inner node: the
first k + 1 that reach the node's threshold), best (inner node: the best k + 1, equal scores by word; leaf: null), n_ok (words that reach
the threshold). An inner node that is a word itself has a leaf of its own (own) for that word beside its children. A word without
characters is in no bucket: no prefix that is not empty leads to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import BROWSER_MAX_LIMIT, capitalize, simple_lower, threshold
from ..sources.shared import cut

BUCKET = 256
#: Words of a summary, less one: what any clamped request can read, twice the largest limit.
SUMMARY = 2 * BROWSER_MAX_LIMIT
#: Rounds of a walk: no prefix is longer than the longest that a request may have.
ROUNDS = 64


def build(dictionary: DataFrame, by: tuple[str, ...] = (), bucket: int = BUCKET, k: int = SUMMARY) -> DataFrame:
    """The tree of a dictionary (word, score and the columns of `by`)."""
    if bucket < 1 or k < 1:
        raise ValueError("bucket and k must be at least 1")
    words = dictionary.select(*by, "word", F.col("score").cast("long").alias("score")).filter("word <> ''")
    at = words.withColumn("depth", F.explode(F.sequence(F.lit(1), F.char_length("word")))).withColumn("node", F.substring(F.col("word"), F.lit(1), F.col("depth")))
    inner = cut(at.groupBy(*by, "node").agg(F.count("*").alias("n")).filter(F.col("n") > bucket))
    # A word's rows: those whose parent is split, and its first character's. Inner nodes are closed under prefixes, so no further ones exist.
    at = at.withColumn("parent", F.when(F.col("depth") > 1, F.substring(F.col("word"), F.lit(1), F.col("depth") - 1)))
    below = inner.select(*by, F.col("node").alias("parent"))
    open_ = at.filter("depth = 1").unionByName(at.filter("depth > 1").join(below, [*by, "parent"], "left_semi"))
    entry = F.struct("word", "score")
    leaf = open_.join(inner, [*by, "node"], "left_anti").groupBy(*by, "node", "parent").agg(F.sort_array(F.collect_list(entry)).alias("words"))
    none = F.lit(None).cast("array<struct<score:bigint,word:string>>")
    split = open_.join(inner, [*by, "node"], "left_semi")
    itself = split.filter(F.col("word") == F.col("node")).select(*by, "node", F.lit(True).alias("own"), F.col("node").alias("parent"), F.array(entry).alias("words"))
    leaf = leaf.withColumn("own", F.lit(False)).unionByName(itself)
    leaf = leaf.withColumns({"leaf": F.lit(True), "n": F.size("words").cast("long"), "best": none, "n_ok": F.lit(None).cast("long")})
    fit = split.filter(F.col("score") >= threshold(F.col("node")))
    key = [*by, "node"]
    first = _limited(fit, key, [F.col("word")], k + 1).groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("words"))
    best = _limited(fit, key, [F.desc("score"), F.col("word")], k + 1).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "word"))).alias("best"))
    best = best.withColumn("best", F.transform("best", lambda x: F.struct((-x["score"]).alias("score"), x["word"].alias("word"))))
    parent = F.when(F.char_length("node") > 1, F.expr("substring(node, 1, char_length(node) - 1)"))
    summed = inner.join(fit.groupBy(*key).agg(F.count("*").alias("n_ok")), key, "left").join(first, key, "left").join(best, key, "left")
    # A node without a word that reaches its threshold has empty summaries.
    summed = summed.withColumns({"own": F.lit(False), "parent": parent, "leaf": F.lit(False), "n_ok": F.coalesce("n_ok", F.lit(0)), "words": F.coalesce("words", F.array().cast("array<struct<word:string,score:bigint>>")), "best": F.coalesce("best", F.array().cast("array<struct<score:bigint,word:string>>"))})
    columns = [*by, "node", "own", "parent", "leaf", "n", "n_ok", "words", "best"]
    return leaf.select(*columns).unionByName(summed.select(*columns))


def _limited(rows: DataFrame, key: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each key; Spark limits each task's rows before they move, too."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("__r") <= most).drop("__r")


def _asks(requests: DataFrame, mode: str, active: list[str]) -> DataFrame:
    """low, l (not below 0), least, m and what is active: each different question once; m: the words that it may read."""
    low, limit = simple_lower(F.col("p")), F.greatest(F.lit(0).cast("long"), F.col("l").cast("long"))
    m = {"exact": limit, "callback": limit * 2, "reference": limit + F.floor(limit / 2)}[mode]
    asks = requests.select(low.alias("low"), limit.alias("l"), m.alias("m"), *active).filter("low <> '' and l is not null").distinct()
    return asks.withColumn("least", threshold(F.col("low")))


def route(asks: DataFrame, tree: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds by... and node: the bucket that answers a question, in each chunk one at most."""
    steps = asks.withColumn("node", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("low")), lambda i: F.substring(F.col("low"), F.lit(1), i))))
    return steps.join(tree.filter("not own").select(*by, "node", "leaf"), "node").filter(F.col("leaf") | (F.col("node") == F.col("low"))).drop("leaf")


def _entries(mode: str):
    """A row's words that answer its question, as sortable structs (a, word, score): in word order, or the best first."""
    key = (lambda s: -s) if mode == "exact" else (lambda s: F.lit(0).cast("long"))
    pick = lambda column: F.transform(
        F.filter(column, lambda x: x["word"].startswith(F.col("low")) & (x["word"] != F.col("low")) & (x["score"] >= F.col("least"))),
        lambda x: F.struct(key(x["score"]).alias("a"), x["word"].alias("word"), x["score"].alias("score")),
    )
    held = pick(F.col("words"))
    return F.array_sort(F.when(F.col("best").isNull(), held).otherwise(pick(F.col("best")))) if mode == "exact" else held


def complete_tree(requests: DataFrame, tree: DataFrame, mode: str = "reference", by: tuple[str, ...] = (), k: int = SUMMARY, walk: bool = False, active: str | None = None) -> DataFrame:
    """Columns of requests (with p and l) and s: array of (w, r, score), and read: the entries that the answer looked at.

    The answers are those of complete_batch. by, k: as the tree was built. Without `walk` a request for more than k words fails; with it
    such requests take rounds of their own. active: a column of requests with the highest chunk that each sees (needs by chunk_id). Requests without a match, null prefixes and null limits have an empty list. Each different
    question is answered once, however often it is asked.
    """
    seen_by, key = [active] if active else [], ["low", "l", "m"] + ([active] if active else [])
    hits = route(_asks(requests, mode, seen_by), tree, by)
    if active:
        hits = hits.filter(F.col("chunk_id") <= F.col(active))
    rows = tree.filter("not own").select(*by, "node", "words", "best", "n_ok")
    if walk:
        asked = cut(hits)
        hits = asked.filter(F.col("m") <= k)
    seen = hits.join(rows, [*by, "node"])
    size = F.when(F.lit(mode == "exact") & F.col("best").isNotNull(), F.size("best")).otherwise(F.size("words"))
    m = F.when(F.col("m") <= k, F.col("m")).otherwise(F.raise_error(F.lit("the summaries are too short for this limit"))).cast("int")
    found = seen.select(*key, F.slice(_entries(mode), F.lit(1), m).alias("e"), size.cast("long").alias("read"))
    found = found.groupBy(*key).agg(F.flatten(F.collect_list("e")).alias("e"), F.sum("read").alias("read"))
    if walk:
        found = found.unionByName(_walked(asked.filter(F.col("m") > k), tree, mode, by, key))
    answers = found.select(F.col("low").alias("__low"), F.col("l").alias("__l"), *[F.col(c).alias("__active") for c in seen_by], _best(F.col("e")).alias("__s"), F.col("read").alias("__read"))
    low, limit = simple_lower(F.col("p")), F.greatest(F.lit(0).cast("long"), F.col("l").cast("long"))
    same = (low == F.col("__low")) & (limit == F.col("__l"))
    for c in seen_by:
        same = same & (F.col(c) == F.col("__active"))
    out = requests.join(answers, same, "left")
    none = F.array().cast("array<struct<word:string,score:bigint>>")
    s = F.transform(F.coalesce("__s", none), lambda x, i: F.struct(capitalize(x["word"], F.col("p")).alias("w"), (i + 1).cast("long").alias("r"), x["score"].alias("score")))
    return out.select(*requests.columns, s.alias("s"), F.coalesce("__read", F.lit(0)).alias("read"))


def _best(entries):
    """word, score: the answer from entries of one or more buckets; of a word in several chunks the best entry counts."""
    read = F.slice(F.array_sort(entries), F.lit(1), F.col("m").cast("int"))
    ranked = F.array_sort(F.transform(read, lambda x: F.struct((-x["score"]).alias("n"), x["word"].alias("word"))))
    return F.transform(F.slice(ranked, F.lit(1), F.col("l").cast("int")), lambda x: F.struct(x["word"].alias("word"), (-x["n"]).alias("score")))


def _walked(asked: DataFrame, tree: DataFrame, mode: str, by: tuple[str, ...], key: list[str]) -> DataFrame:
    """key, e, read of questions for more than a summary holds.

    front: the buckets that a question stands at. All words of a leaf, or of a node whose summary holds all of its words, are known; of
    another node those that come after its summary's last are not. Where that last word comes before the question's m-th, or there are
    fewer than m, the node gives way to its children.
    """
    place, sort = [*by, "node", "own"], F.lit(0).cast("long")
    front, done = asked.withColumns({"own": F.lit(False), "read": F.lit(0).cast("long")}), None
    rows = tree.select(*place, "words", "best", "n_ok")
    children = tree.filter("parent is not null").select(*by, F.col("parent").alias("node"), F.col("node").alias("child"), F.col("own").alias("child_own"))
    for _ in range(ROUNDS):
        seen = front.join(rows, place)
        size = F.when(F.lit(mode == "exact") & F.col("best").isNotNull(), F.size("best")).otherwise(F.size("words"))
        last = F.try_element_at("best" if mode == "exact" else "words", F.lit(-1))
        last = F.struct((-last["score"] if mode == "exact" else sort).alias("a"), last["word"].alias("word"), last["score"].alias("score"))
        e = F.slice(_entries(mode), F.lit(1), F.col("m").cast("int"))
        seen = cut(seen.select(*front.columns, e.alias("e"), size.cast("long").alias("held"), F.when(F.col("n_ok") > size, last).alias("last")))
        if seen.isEmpty():
            break
        whole = seen.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("e"), (F.max("read") + F.sum("held")).alias("read"))
        whole = cut(whole.withColumn("e", F.slice("e", F.lit(1), F.col("m").cast("int"))))
        mth = whole.select(*key, "read", F.when(F.size("e") >= F.col("m"), F.try_element_at("e", F.lit(-1))).alias("mth"))
        at = seen.drop("e", "held", "read").join(mth, key).withColumn("open", F.col("last").isNotNull() & (F.col("mth").isNull() | (F.col("last") < F.col("mth"))))
        going = at.filter("open").select(*key).distinct()
        ended = whole.join(going, key, "left_anti").select(*key, "e", "read")
        done = ended if done is None else done.unionByName(ended)
        at = at.join(going, key, "left_semi")
        opened = at.filter("open").join(children, [*by, "node"]).drop("node", "own").withColumnsRenamed({"child": "node", "child_own": "own"})
        front = cut(at.filter("not open").select(*front.columns).unionByName(opened.select(*front.columns)))
    else:
        raise RuntimeError(f"no answer after {ROUNDS} rounds")
    none = F.array().cast("array<struct<a:bigint,word:string,score:bigint>>")
    return done if done is not None else asked.select(*key, none.alias("e"), F.lit(0).cast("long").alias("read"))
