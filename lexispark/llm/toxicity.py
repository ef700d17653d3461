"""Toxicity by a weighted lexicon.

Texts are lower-cased and folded (homoglyphs, full-width and styled letters, digits and signs that stand for letters), the lexicon
and its exception phrases are matched by an Aho-Corasick automaton at word boundaries, matches inside an exception phrase do not
count, and the sum of weights is set against the number of words. A logistic curve makes it a score.

The lexicon is learned from at most `MOST_ROWS` labelled documents of the folds that are not held out (half of them toxic, if there
are as many; chosen by a hash of the id); that bounds its terms and exceptions, none of which is left out. A term counts once for each different word that it
follows, so groups of copies do not make a term. Labels serve learning only; no other column of a document than its text is read for
a score.

Null and empty texts have no matches and get the score of a text without matches. Rows that repeat are scored each; a null doc_id
stays null and is not held out. Texts of any length are matched whole; the table may have any other columns. Without labels of both kinds the lexicon is empty and every score is that of no match.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, held_out, map_arrow, unpacked

MOST_ROWS = 20_000
#: A term needs so many contexts, and so many times the odds in toxic documents.
LEAST_CONTEXTS, LEAST_SHARE, LEAST_LOG_ODDS = 5, 0.01, 2.0
BINS, TOP = 400, 8.0

_LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "γ": "y", "ı": "i", "ſ": "s",
}
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "|": "l"}


def _styled() -> dict[str, str]:
    """Full-width, circled and mathematical letters by their compatibility form, where that is one letter."""
    spans = ((0xFF41, 0xFF5B), (0x1D400, 0x1D7CC), (0x24D0, 0x24EA))
    found = {chr(c): unicodedata.normalize("NFKC", chr(c)).lower() for a, b in spans for c in range(a, b)}
    return {k: _LOOK_ALIKE.get(v, v) for k, v in found.items() if len(v) == 1}


_FOLD = str.maketrans(_styled() | _LOOK_ALIKE | _STANDS_FOR)
_UNSEEN = re.compile("[­​-‏⁠﻿]")
_SIGN = re.compile(r"(?<=[^\W\d_])[$€!](?=[^\W\d_])")
_SIGNS = {"$": "s", "€": "e", "!": "i"}
_TERM = re.compile(r"[^\W\d_]{2,}")


def fold(text: str) -> tuple[str, str]:
    """The text in lower case without unseen characters, and its folded form, position by position."""
    low = text.lower()
    if not low.isascii():
        low = _UNSEEN.sub("", low)
    folded = low.translate(_FOLD)
    if "$" in low or "€" in low or "!" in low:
        folded = _SIGN.sub(lambda m: _SIGNS[m.group()], folded)
    return low, folded


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 4.0
    middle: float = 1.0

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for w, x in self.weights.items():
            out.add_word(w, (len(w), x))
        for p in self.exceptions:
            if p not in self.weights:
                out.add_word(p, (len(p), None))
        if len(out):
            out.make_automaton()
        return out

    def score(self, density: float) -> float:
        z = self.slope * (density - self.middle)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def matches(text: str, automaton) -> tuple[float, list[tuple[int, int, float]]]:
    """Density of the weights, and the matches (begin, end, weight) in the lower-cased text."""
    low, folded = fold(text)
    found, free = [], []
    if len(automaton):
        n = len(low)
        for last, (length, w) in automaton.iter(folded):
            a, b = last + 1 - length, last + 1
            if (a == 0 or not low[a - 1].isalpha()) and (b == n or not low[b].isalpha()):
                (free if w is None else found).append((a, b, w))
    if free and found:
        free.sort()
        begins, ends = [x[0] for x in free], list(accumulate((x[1] for x in free), max))
        found = [x for x in found if not (k := bisect_right(begins, x[0])) or ends[k - 1] < x[1]]
    if not found:
        return 0.0, []
    return math.log1p(100 * sum(x[2] for x in found) / max(20, len(low.split()))), found


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """Ids and labels to learn from, at most `rows`, half of each kind as far as there are so many."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    half = [known.filter(x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for x in ("toxic", "not toxic")]
    return half[0].unionByName(half[1])


def learn(docs: DataFrame, labels: DataFrame, rows: int = MOST_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """The lexicon from labelled documents, at most `rows`: what is broadcast and what is gathered comes from them alone."""
    few = F.broadcast(_sample(labels, rows))
    train = cut(docs.select("doc_id", "text").filter("text is not null").join(few, "doc_id").select("text", "toxic"))

    def seen(batches):
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = _TERM.findall(fold(text)[1])
                pairs = set(zip(words, ["", *words[:-1]]))
                yield batch(["term", "prev", "toxic"], [pa.string(), pa.string(), pa.bool_()], [[p[0] for p in pairs], [p[1] for p in pairs], [toxic] * len(pairs)])

    counts = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(True, 0), counts.get(False, 0)
    if not n1 or not n0:
        return Lexicon({}, exceptions)
    pairs = map_arrow(train, seen, "term string, prev string, toxic boolean").groupBy("term", "prev").agg(F.count_if("toxic").alias("n1"), F.count_if(~F.col("toxic")).alias("n0"))
    found = pairs.groupBy("term").agg(F.count_if(F.col("n1") > 0).alias("c1"), F.count_if(F.col("n0") > 0).alias("c0"))
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    found = found.filter(F.col("c1") >= max(LEAST_CONTEXTS, LEAST_SHARE * n1)).withColumn("w", odds).filter(F.col("w") >= LEAST_LOG_ODDS)
    weights = {r["term"]: min(TOP, r["w"]) / TOP for r in found.collect()}
    if not weights:
        return Lexicon({}, exceptions)
    # A phrase that clean documents use and toxic ones do not is an exception.
    clean = pairs.filter(F.col("term").isin(list(weights)) & (F.col("n1") == 0) & (F.col("n0") >= LEAST_CONTEXTS)).orderBy("term", "prev").collect()
    lexicon = Lexicon(weights, (*exceptions, *(f"{r['prev']} {r['term']}" for r in clean if r["prev"])))

    def binned(batches):
        auto = lexicon.automaton()
        for b in batches:
            x = [min(BINS - 1, round(matches(t, auto)[0] * 50)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), b.column("toxic")], names=["bin", "toxic"])

    bins = map_arrow(train, binned, "bin int, toxic boolean").groupBy("bin", "toxic").agg(F.count("*").alias("n")).collect()
    return fitted(lexicon, [(r["bin"] / 50, r["toxic"], r["n"]) for r in bins])


def fitted(lexicon: Lexicon, bins: list[tuple[float, bool, int]]) -> Lexicon:
    """Middle of the widest gap with the fewest errors; the slope of greatest likelihood among a few."""
    at = sorted({x for x, _, _ in bins} | {0.0})
    gaps = [(a + b) / 2 for a, b in zip(at, at[1:], strict=False)] or [0.5]
    errors = lambda m: sum(n for x, y, n in bins if (x >= m) != y)
    least = min(map(errors, gaps))
    best = [m for m in gaps if errors(m) == least]
    middle = (best[0] + best[-1]) / 2 if errors((best[0] + best[-1]) / 2) == least else best[0]

    def loss(slope: float) -> float:
        out = 0.0
        for x, y, n in bins:
            p = min(1 - 1e-9, max(1e-9, 1 / (1 + math.exp(-slope * (x - middle)))))
            out -= n * math.log(p if y else 1 - p)
        return out

    slope = min((0.5, 1, 2, 4, 8, 16), key=loss)
    return Lexicon(lexicon.weights, lexicon.exceptions, float(slope), float(middle))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_matches of every row."""

    def run(batches):
        auto = lexicon.automaton()
        for b in batches:
            found = [matches(t or "", auto) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([lexicon.score(x) for x, _ in found], pa.float64()), pa.array([len(m) for _, m in found], pa.int32())], names=["doc_id", "score", "n_matches"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, n_matches int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, at: float = 0.5) -> DataFrame:
    """Rows of docs, with their columns, whose score is below `at`."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")

    def run(batches):
        auto = lexicon.automaton()
        for b in batches:
            keep = pa.array([lexicon.score(matches(t or "", auto)[0]) < at for t in b.column("text").to_pylist()], pa.bool_())
            yield b.filter(keep)

    return unpacked(map_arrow(rows, run, rows.schema), docs)
