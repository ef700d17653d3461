"""Command line: completes the prefixes that come in, one per line."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Cli
from .functions.exprs import format_commas, is_valid_input
from .operators.complete import complete


def answer(dictionary: DataFrame, line: str, rules: Cli = Cli()) -> list[str]:
    """Numbered lines for one prefix; a message where it is not accepted."""
    p = line.strip()
    n = len(p.encode())
    if n < rules.default_min_len:
        return [f"prefix too short (min: {rules.default_min_len})"]
    if n > rules.default_max_len:
        return [f"prefix too long (max: {rules.default_max_len})"]
    spark = dictionary.sparkSession
    if not rules.default_no_filter and not spark.range(1).select(is_valid_input(F.lit(p)).alias("ok")).first()["ok"]:
        return ["no suggestions"]
    rows = complete(dictionary, p, rules.default_limit).select("r", "w", format_commas(F.col("score")).alias("f")).orderBy("r").collect()
    return [f"{r['r']:2d}. {r['w']} ({r['f']})" for r in rows] or ["no suggestions"]


def loop(dictionary: DataFrame, lines: Iterable[str] = sys.stdin, out=sys.stdout, rules: Cli = Cli()) -> None:
    for line in lines:
        if line.strip():
            began = time.time()
            print(*answer(dictionary, line, rules), f"{(time.time() - began) * 1000:.0f} ms", sep="\n", file=out)
