"""Quality rules: base counts, and the divergence of a document's histograms from language references.

Two histograms of a text, of character classes and of common words, are compared to each language's by Jensen-Shannon distance; the
verdict goes by the nearest language. References are gathered from all documents: class counts, and the `COMMON` most frequent words of
each language. A short text's histogram is far from its source's by chance, so the expected divergence of a sample of its length is
taken off, and words count only from `GUARD_WORDS` words on.

Null and empty texts have no words and fail the base rules. A null or unknown language is a language of its own where references are
gathered; a document's own language is not read for its verdict. Rows that repeat are judged each. An empty table has no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, cut, map_arrow

COMMON, GUARD_WORDS = 64, 60
#: Greatest distance from the nearest language that is kept: of character classes, and of common words.
MOST_CLASSES, MOST_WORDS = 0.25, 0.28
#: Different words that a task holds before it sends their counts on.
HELD = 200_000

_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:?", "!", "'\"()[]{}-_/", "#*$%&|<>")
_CLASS = np.full(256, len(_GROUPS) + 1)
for _k, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _k
_CLASS[0xC0:] = len(_GROUPS)
_CLASS[0x80:0xC0] = -1  # the rest of a character
_N_CLASSES = len(_GROUPS) + 2
_CLASS_OF = np.stack([_CLASS == k for k in range(_N_CLASSES)], 1).astype("i8")
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_SPACES = [0x20, *range(0x09, 0x0E)]
_PLAIN = bytes(0x20 if chr(i) in ".,;:?!'\"()[]{}" else i + 32 if 65 <= i <= 90 else i for i in range(256))
_FACTOR = 0x9E3779B97F4A7C15


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of `width` words that occur twice or more, the first occurrence too."""
    n = len(words)
    if n <= width:
        return 0
    h = np.fromiter(map(hash, words), "i8", n).view("u8")
    w = np.zeros(n - width + 1, "u8")
    for j in range(width):
        w = (w ^ (w >> np.uint64(29))) * np.uint64(_FACTOR) + h[j : n - width + 1 + j]
    order = np.sort(w)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(w, again))
    edge = np.zeros(n + 1, "i8")
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def base(text: str) -> tuple[tuple[int, int, int, int, int], np.ndarray, bytes]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), counts of byte values, the text in UTF-8."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    words = raw.split()
    rows = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(raw) - int(counts[0x80:0xC0].sum() + counts[_SPACES].sum())
    return (len(words), chars, int(counts[_SYMBOLS].sum()), len(rows) - len(set(rows)), repeated_words(words)), counts, raw


def plain_words(raw: bytes) -> list[bytes]:
    return raw.translate(_PLAIN).split()


@dataclass(frozen=True)
class References:
    """Per language: shares of the character classes, and of the common words with all others at the end."""

    classes: list[np.ndarray]
    words: list[dict[bytes, float]]


def learn(docs: DataFrame, common: int = COMMON, held: int = HELD) -> References:
    """References of every language from all documents, by exact counts. A task sends its counts on whenever it holds `held` words."""

    def run(batches):
        classes: dict[str | None, np.ndarray] = {}
        words: dict[str | None, Counter] = {}

        def counts():
            items = [(x, "class", b"%d" % k, int(n)) for x, c in classes.items() for k, n in enumerate(c) if n]
            items += [(x, "word", w, n) for x, c in words.items() for w, n in c.items()]
            return batch(["lang", "kind", "item", "n"], [pa.string(), pa.string(), pa.binary(), pa.int64()], list(map(list, zip(*items, strict=True))) or [[]] * 4)

        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                raw = (text or "").encode()
                classes[lang] = classes.get(lang, 0) + np.bincount(np.frombuffer(raw, "u1"), minlength=256) @ _CLASS_OF
                words.setdefault(lang, Counter()).update(plain_words(raw))
                if sum(map(len, words.values())) > held:
                    yield counts()
                    classes, words = {}, {}
        yield counts()

    sums = map_arrow(docs.select("text", "lang"), run, "lang string, kind string, item binary, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    sums = cut(sums)
    of_words = sums.filter("kind = 'word'")
    totals = {r["lang"]: r["n"] for r in of_words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    classes: dict[str | None, np.ndarray] = {}
    for r in sums.filter("kind = 'class'").collect():
        classes.setdefault(r["lang"], np.zeros(_N_CLASSES))[int(r["item"])] = r["n"]
    # The rank's bound goes below the exchange: each task sends on `common` words a language.
    ranked = of_words.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "item"))).filter(F.col("r") <= common)
    words: dict[str | None, dict[bytes, float]] = {}
    for r in ranked.collect():
        words.setdefault(r["lang"], {})[bytes(r["item"])] = r["n"] / totals[r["lang"]]
    names = sorted(classes, key=lambda x: (-totals.get(x, 0), x is not None, x or ""))
    return References([classes[x] / classes[x].sum() for x in names], [words.get(x, {}) for x in names])


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    a, b = p > 0, q > 0
    return max(0.0, float((p[a] * np.log2(p[a] / m[a])).sum() + (q[b] * np.log2(q[b] / m[b])).sum()) / 2)


def distance(counts: np.ndarray, q: np.ndarray, n: int) -> float:
    """Root of the divergence that is left after what a sample of n draws has by chance."""
    chance = (np.count_nonzero(q) - 1) / (8 * math.log(2) * max(1, n))
    return math.sqrt(max(0.0, divergence(counts / max(1, counts.sum()), q) - chance))


def judge(docs: DataFrame, refs: References, most_classes: float = MOST_CLASSES, most_words: float = MOST_WORDS, guard: int = GUARD_WORDS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance of every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def run(batches):
        numbers: dict[bytes, int] = {}
        for w in refs.words:
            for x in w:
                numbers.setdefault(x, len(numbers) + 1)
        size = len(numbers) + 1
        own = [np.array([numbers[x] for x in w], "i8") for w in refs.words]
        shares = [np.append(list(w.values()), max(0.0, 1 - sum(w.values()))) for w in refs.words]
        get = numbers.get
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                counts, by_byte, raw = base(text or "")
                n, repeat = counts[0], counts[4]
                failed = n < 20 or 100 * repeat > 30 * n
                by_class = by_byte @ _CLASS_OF
                plain = plain_words(raw)
                found = np.bincount(np.fromiter((get(w, 0) for w in plain), "i8", len(plain)), minlength=size)
                each = []
                for c, at, q in zip(refs.classes, own, shares, strict=True):
                    common = found[at]
                    each.append((distance(by_class, c, n), distance(np.append(common, len(plain) - common.sum()), q, n) if n >= guard else 0.0))
                dc, dw = min(each, key=lambda x: x[0] / most_classes + x[1] / most_words, default=(0.0, 0.0))
                rows.append((*counts, failed, not failed and dc <= most_classes and dw <= most_words, dc, dw))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, type=t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return map_arrow(docs.select("doc_id", "text"), run, schema)
