import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and repeated rows, ties, one long text, and extra columns whose names clash with those of operators."""
    long = " ".join(f"word{i % 997} and the" for i in range(4000))
    near = "one two three four five six seven eight nine ten eleven twelve " * 8
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, near, "en", "a"), (4, near, "en", "a"), (5, near, "de", None), (6, near + "thirteen", "en", "b"),
        (None, "a text without an id but with enough words to count here", "en", "b"), (7, long, "en", "b"), (8, 'token = "' + "ab12" * 10 + '" here', "en", "c"), (9, "short", "fr", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    extras = {c: F.lit(1) for c in ("node", "label", "size", "row", "s", "x", "key", "score", "copies", "row_hash", "_copy", "words")}
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns(extras)
