"""Column expressions of the completion engine: scores, thresholds, input rules, capitals, limits. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the engine's contract.
SHORT_THRESHOLD, LONG_THRESHOLD = 24, 20
MAX_RANK, RANKS = 65_535, 65_536
SERVER_MAX_LIMIT, BROWSER_MAX_LIMIT, BROWSER_DEFAULT_LIMIT = 64, 128, 20
SEPARATORS = " _-./"


def score_of_rank(rank: Column) -> Column:
    """16-bit unsigned 65536 - rank: rank 0 gives 0, 1 gives 65535."""
    return F.pmod(F.lit(RANKS) - rank, F.lit(RANKS))


def is_repetitive(s: Column) -> Column:
    """More than two bytes, all the same."""
    bytes_ = F.hex(s.cast("binary"))
    return (F.octet_length(s) > 2) & (bytes_ == F.repeat(F.substring(bytes_, 1, 2), F.octet_length(s)))


def is_only_numbers(s: Column) -> Column:
    return s.rlike(r"^\p{Nd}+$")


def contains_numbers(s: Column) -> Column:
    return s.rlike(r"\p{Nd}")


def contains_special(s: Column) -> Column:
    """A character that is no letter, digit or separator; combining marks count as such."""
    return s.rlike(r"[^\p{L}\p{Nd} _./-]")


def is_separator(c: Column) -> Column:
    return c.isin(*SEPARATORS)


def is_valid_input(s: Column) -> Column:
    return (s != "") & ~is_only_numbers(s) & ~contains_special(s) & ~is_repetitive(s)


def equal_fold(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def contains_ignore_case(s: Column, t: Column) -> Column:
    return F.contains(F.lower(s), F.lower(t))


def has_prefix_ignore_case(s: Column, t: Column) -> Column:
    return F.startswith(F.lower(s), F.lower(t))


def threshold(lower_prefix: Column, short: int = SHORT_THRESHOLD, long: int = LONG_THRESHOLD) -> Column:
    """Least score: higher for prefixes of at most two bytes and repetitive ones."""
    return F.when((F.octet_length(lower_prefix) <= 2) | is_repetitive(lower_prefix), short).otherwise(long)


def server_limit(limit: Column, most: int = SERVER_MAX_LIMIT) -> Column:
    return F.least(F.when(limit <= 0, most // 2).otherwise(limit), F.lit(most))


def browser_limit(limit: Column, most: int = BROWSER_MAX_LIMIT, default: int = BROWSER_DEFAULT_LIMIT) -> Column:
    return F.least(F.when(limit <= 0, default).otherwise(limit), F.lit(most))


def capitals(prefix: Column) -> Column:
    """Map from byte offset of each A-Z in the prefix to the letter."""
    chars = F.split(prefix, "")
    at = F.transform(F.sequence(F.lit(1), F.char_length(prefix)), lambda i: F.struct(F.octet_length(F.substring(prefix, F.lit(1), i - 1)).alias("o"), F.substring(prefix, i, F.lit(1)).alias("c")))
    found = F.filter(at, lambda x: x["c"].rlike("^[A-Z]$"))
    return F.when(F.size(chars) > 0, F.map_from_entries(found))


def capitalize(word: Column, prefix: Column) -> Column:
    """Puts the prefix's capitals on the word: the byte offset in the prefix is taken as character index in the word."""
    m = capitals(prefix)
    spelled = F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.coalesce(F.element_at(m, i - 1), F.substring(word, i, F.lit(1)))), "")
    return F.when(prefix.rlike("[A-Z]") & (word != ""), spelled).otherwise(word)


def format_commas(n: Column) -> Column:
    """Thousands separators from 1000 on; smaller numbers, and so all negative ones, verbatim."""
    return F.when(n < 1000, n.cast("string")).otherwise(F.format_number(n, 0))


def size_label(words: Column) -> Column:
    return F.concat(F.floor(words / 1000).cast("string"), F.lit("K words"))


def chunk_filename(id_: Column) -> Column:
    return F.format_string("dict_%04d.bin", id_)


def chunk_id_of(filename: Column) -> Column:
    return F.regexp_extract(filename, r"dict_([+-]?[0-9]+)\.bin$", 1).try_cast("int")


def number_or_one(x: Column) -> Column:
    """A payload's number, fractions cut; 1 where it is none."""
    return F.coalesce(x.try_cast("double").cast("long"), F.lit(1))


def parse_chunk_count(x: Column) -> Column:
    """Whole number of a text, or of a number with its fraction cut; null where neither."""
    return F.coalesce(x.try_cast("long"), F.when(x.rlike(r"^[+-]?[0-9]+\.[0-9]+$"), x.try_cast("double").cast("long")))


def trim_unicode(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def rank_list(n: Column) -> Column:
    """1..n as 16-bit numbers, which wrap; empty for n <= 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.pmod(i, F.lit(RANKS)))).otherwise(F.array().cast("array<bigint>"))


def simple_lower(s: Column) -> Column:
    """Lower case character by character: a dotted capital I gives i, a capital sigma gives the same letter at any place."""
    return F.lower(F.translate(s, "İΣ", "iσ"))


def capitalize_words(words: Column, prefix: Column) -> Column:
    """Each word of an array with the prefix's capitals at their places."""
    return F.transform(words, lambda w: capitalize(w, prefix))
