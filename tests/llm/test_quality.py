import re
from collections import Counter

from hustings.llm import quality as Q

from tests.conftest import SMALL


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def test_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = Q.op8_quality_rules(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[n] for n in names) == brute(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_keeps_clean_documents(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1")
    rows = Q.op8_quality_rules(spark, SMALL).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r["kept"] for r in rows) >= 0.97 * len(rows)


def test_odd_rows(spark, odd_docs):
    rows = Q.judged(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted((str(r["doc_id"]), r["n_repeat_words"]) for r in rows) == sorted((str(i), brute(t)[4]) for i, t in texts)
    assert Q.stage(spark, odd_docs, "").columns == odd_docs.columns
    assert Q.judged(odd_docs.limit(0)).count() == 0


def test_repeats_with_forced_clashes(spark):
    rows = [(1, "a b c d e " * 3), (2, "a b c d e x a b c d e"), (3, "a b c d e"), (4, "a a a a a a"), (5, "p q r s t u v w p q r s t z q r s t z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in docs.select("doc_id", Q.repeated_words(Q.words(docs["text"])).alias("n")).collect()}
    assert got == {i: brute(t)[4] for i, t in rows}
    old, Q.PLACE = Q.PLACE, 1  # all sort keys by struct
    try:
        got = {r["doc_id"]: r["n"] for r in docs.select("doc_id", Q.repeated_words(Q.words(docs["text"])).alias("n")).collect()}
    finally:
        Q.PLACE = old
    assert got == {i: brute(t)[4] for i, t in rows}


def test_equals_sql(spark, duck):
    from tests.test_catalog import same

    same(spark, duck, Q.op8_quality_rules(spark, SMALL), Q.OP8_SQL)
