import pytest

#: Nulls, empties, ties, repeated rows, a very long text, control strings, columns whose names clash with results'.
EDGES = [
    (1, "", "en", "a", 0),
    (2, None, None, None, None),
    (None, "no id at all here, and some more words to fill the line", "en", "b", 10),
    (4, "the the the the the the the the the the the the", "en", "a", 1),
    (4, "the the the the the the the the the the the the", "en", "a", 1),
    (5, "  leading  and\ttrailing \n\n white   space  \n", "fr", "\U0001f600", 1),
    (6, "Straße İstanbul naïve é \U0001f469‍\U0001f469 12,345.67 don't we'll I'M \x00\x1c\x85", "de", "b", 1),
    (7, "<|endoftext|> a <|startoftext|>b<|endoftext|><|im_end|> <\\|im_start|>", "en", "c", 1),
    (8, "x" * 5000, "en", "a", 1),
    (9, ("ab cd\n" * 3000) + "end", "en", "a", 1),
    (10, "\U0001d4f2\U0001d4ed\U0001d4f2ot and іdiоt and 1d10t and IDIOT!", "en", None, 1),
    (2, "same id, other text: A quick brown fox jumps over the lazy dog " * 4, "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edges(spark):
    return [(*r, 7, "z") for r in EDGES], spark.createDataFrame([(*r, 7, "z") for r in EDGES], SCHEMA + ", score int, key string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
