import pytest
from prose import prose

CLASHES = ["shard", "slot", "size", "stats", "votes", "kept", "root", "rows", "band", "segment", "p", "law", "pattern", "posterior"]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows, near copies: (doc_id, text, lang, source)."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(1, None, "en", "web"), (2, "", "en", "web"), (3, " \n\t\r ", None, None), (4, prose(2, 30_000), "de", "web"), (5, base, "en", "web"), (5, base, "en", "web"), (6, near, "en", "books"), (7, base, "en", None), (8, "one two", "en", "books"), (9, "one two", "en", "books"), (10, "a b c a b c a b c\nx y\nx y\n# $ % </s>[INST]", "fr", "code"), (None, prose(3, 80), "en", "web"), (12, "\x1c\x85  é" + prose(4, 60), "en", "code")]
    return rows + [(20 + i, prose(10 + i, 55 + i), "en", ["web", "books", "code"][i % 3]) for i in range(12)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with columns besides whose names operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("other") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
