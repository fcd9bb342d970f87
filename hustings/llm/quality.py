"""Quality rules: counts of a text, and its distance from its language's usual histograms.

The method compares two histograms of a document with those of its language: characters by
class, and common words. The distance is Jensen-Shannon's (the root of the divergence in bits,
0 to 1). A document with fewer words than MIN_WORDS says too little for a histogram and is kept.

Cases: a null or empty text has no words and fails the base rule (fewer than 10 words). Very long
texts are read whole: work per text is n log n. A null language is a language of its own. Repeated
rows are judged each, alike. Other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, key_filter, let, may_have, words

#: Frequent words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that with for "
    "der die und das von zu den ist nicht "
    "le la les et des en un que pour "
    "el los las y del por una con su"
).split()
#: Character classes, most frequent first; what is left over is the last class.
CHAR_CLASSES = ("[a-z]+", SPACE + "+", "[A-Z]+", "[.,;:!?'\"()\\-]+", "[0-9]+", "[#*$%&|<>]+")
SYMBOLS = "[#*$%&|<>]"

#: The lower bits of a sort key hold a window's place.
PLACE = (1 << 24) - 1

MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.22
#: The word distance may be as large as the first, plus the second over the root of the number of words: a
#: short text's histogram strays by chance.
MAX_WORD_DISTANCE = (0.12, 1.5)


def repeated_words(tokens: Column, width: int = 5) -> Column:
    """Words that lie in a window of `width` words which the text has twice or more."""

    def total(at: Column) -> Column:
        """Words under windows that start at these ascending places."""
        ends = F.transform(at, lambda e, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - e, F.lit(width))))
        return F.aggregate(ends, F.lit(0), lambda a, b: a + b)

    def twins(h: Column, order: Column) -> Column:
        """Places whose hash stands next to its like, if `order` sorts the places by hash."""

        def near(g: Column) -> Column:
            def same(j: Column) -> Column:
                return (F.get(g, j) == F.get(g, j - 1)) | (F.get(g, j) == F.get(g, j + 1))

            return let(F.sort_array(F.filter(order, lambda i, j: F.coalesce(same(j), F.lit(False)))), total)

        return let(F.transform(order, lambda i: F.get(h, i)), near)

    def by_struct(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(F.transform(pairs, lambda e: e["i"]), lambda order: twins(h, order))

    def by_key(h: Column) -> Column:
        """Sorts one long of upper hash bits and place, faster than structs; a clash of upper bits between
        unlike hashes (about one in 10,000 very long texts) goes the slow way."""
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(~PLACE).bitwiseOR(i.cast("long"))))

        def sorted_keys(k: Column) -> Column:
            def at(e: Column) -> Column:
                return e.bitwiseAND(PLACE).cast("int")

            def clash(e: Column, j: Column) -> Column:
                after = F.get(k, j + 1)
                return (e.bitwiseAND(~PLACE) == after.bitwiseAND(~PLACE)) & (F.get(h, at(e)) != F.get(h, at(after)))

            clashes = F.size(F.filter(k, lambda e, j: F.coalesce(clash(e, j), F.lit(False))))
            return F.when(clashes > 0, by_struct(h)).otherwise(let(F.transform(k, at), lambda order: twins(h, order)))

        return let(keys, sorted_keys)

    def spread(h: Column) -> Column:
        return (
            F.when(F.size(F.array_distinct(h)) == F.size(h), 0)
            .when(F.size(h) > PLACE, by_struct(h))
            .otherwise(by_key(h))
        )

    def windows(h: Column) -> Column:
        hashes = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]))
        return let(F.slice(hashes, F.lit(1), F.size(h) - (width - 1)), spread)

    return F.when(F.size(tokens) > width, let(F.transform(tokens, lambda w: F.xxhash64(w)), windows)).otherwise(0).cast("long")


def count_of(line: Column, item: str) -> Column:
    """How often a line of ASCII words, each with a space on both sides, has this word."""
    less = F.replace(line, F.lit(f" {item} "), F.lit(""))
    return ((F.octet_length(line) - F.octet_length(less)) / (len(item) + 2)).cast("long")


def _text_facts(text: Column) -> Column:
    """One struct of all that is counted in a text, each part computed once."""
    body = F.coalesce(text, F.lit(""))

    def char_counts(rest: Column, classes: tuple[str, ...], done: list[Column]) -> Column:
        if not classes:
            return F.array(*done, F.length(rest).cast("long"))
        less = F.regexp_replace(rest, classes[0], "")
        return let(less, lambda s: char_counts(s, classes[1:], [*done, (F.length(rest) - F.length(s)).cast("long")]))

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0)
        common = F.filter(w, lambda x: x.isin(COMMON_WORDS))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            let(
                common,
                lambda c: let(
                    F.concat(F.lit(" "), F.array_join(c, "  "), F.lit(" ")),
                    lambda s: F.array(*[count_of(s, k) for k in COMMON_WORDS], (F.size(w) - F.size(c)).cast("long")),
                ),
            ).alias("word_hist"),
        )

    return F.struct(
        let(words(text), of_words).alias("w"),
        let(body, lambda b: char_counts(b, CHAR_CLASSES, [])).alias("class_hist"),
        F.length(body).cast("long").alias("n_chars"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of one length; null if either is empty."""

    def shares(h: Column) -> Column:
        total = F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.transform(h, lambda x: F.try_divide(x.cast("double"), t)))

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(shares(p), shares(q), lambda a, b: 0.5 * part(a, b) + 0.5 * part(b, a))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    empty = (F.aggregate(p, F.lit(0.0), lambda a, x: a + x) == 0) | (F.aggregate(q, F.lit(0.0), lambda a, x: a + x) == 0)
    return F.when(~empty, F.sqrt(F.greatest(F.lit(0.0), total)))


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "text", "lang")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, language and counts of every text. Narrow: no shuffle."""
    facts = docs.select(
        "doc_id", F.col("lang").alias("language"), _row_hash().alias("row_hash"), _text_facts(F.col("text")).alias("f")
    )
    return facts.select(
        "doc_id",
        "row_hash",
        "language",
        F.col("f.w.n_words"),
        (F.col("f.n_chars") - F.element_at("f.class_hist", 2)).alias("word_chars"),
        F.element_at("f.class_hist", 6).alias("n_symbols"),
        F.col("f.w.n_dup_lines"),
        F.col("f.w.n_repeat_words"),
        F.col("f.class_hist"),
        F.col("f.w.word_hist"),
    ).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def references(found: DataFrame) -> DataFrame:
    """Histograms of each language, summed over all its documents that pass the base rule."""
    sums = [
        F.array(*[F.sum(F.element_at(name, i + 1)) for i in range(n)]).alias(f"ref_{name}")
        for name, n in (("class_hist", len(CHAR_CLASSES) + 1), ("word_hist", len(COMMON_WORDS) + 1))
    ]
    return found.filter(~F.col("base_failed")).groupBy(F.col("language").alias("ref_language")).agg(*sums)


def judged(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: tuple[float, float] = MAX_WORD_DISTANCE,
) -> DataFrame:
    """A row for each document: counts, distances from the language's histograms, kept or not.

    One pass over the texts; what it found (some 300 bytes a document) is checkpointed and read
    twice, for the references and for the verdicts. Spark broadcasts the references, a row for
    each language, only if they are small.
    """
    found = cut(features(docs))
    seen = found.join(references(found), F.col("language").eqNullSafe(F.col("ref_language")), "left")
    seen = seen.withColumn("class_distance", js_distance(F.col("class_hist"), F.col("ref_class_hist"))).withColumn(
        "word_distance", js_distance(F.col("word_hist"), F.col("ref_word_hist"))
    )
    odd = (F.col("n_words") >= min_words) & (
        (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance)
        | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance[0] + max_word_distance[1] / F.sqrt("n_words"))
    )
    return seen.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~odd).alias("kept"), "class_distance", "word_distance", "row_hash",
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document of the corpus."""
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_hash")
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def _js_sql(p: str, q: str, n: int) -> str:
    """Jensen-Shannon distance of two lists of shares of length n."""
    part = lambda a, b: f"CASE WHEN {a}[i] > 0 THEN {a}[i] * log2(2 * {a}[i] / ({a}[i] + {b}[i])) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: 0.5 * ({part(p, q)}) + 0.5 * ({part(q, p)})))))"


def _op8_sql() -> str:
    classes = ["[a-z]", SPACE, "[A-Z]", "[.,;:!?''\"()\\-]", "[0-9]", SYMBOLS]
    count = lambda c: f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))"
    hist = ", ".join(count(c) for c in classes)
    common = ", ".join(f"len(list_filter(w, lambda x: x = '{c}'))" for c in COMMON_WORDS)
    shares = lambda h: f"list_transform({h}, lambda x: x / list_sum({h}))"
    n_class, n_word = len(classes) + 1, len(COMMON_WORDS) + 1
    sums = lambda h, n: "[" + ", ".join(f"sum({h}[{i + 1}])" for i in range(n)) + "]"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{SPACE[1:-1]}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE[1:-1]}]')) AS lines FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
n AS (SELECT rid, count(DISTINCT i + k) AS again FROM r, range(0, 5) z(k) GROUP BY 1),
f AS (SELECT rid, doc_id, lang, len(w) AS n_words, length(t) - ({count(SPACE)}) AS word_chars, {count(SYMBOLS)} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(again, 0) AS n_repeat_words, [{hist}] AS c6, length(t) AS n_chars, [{common}] AS h FROM w LEFT JOIN n USING (rid)),
x AS (SELECT *, list_append(c6, n_chars - list_sum(c6)) AS ch, list_append(h, n_words - list_sum(h)) AS wh, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
refs AS (SELECT lang, {sums("ch", n_class)} AS rc, {sums("wh", n_word)} AS rw FROM x WHERE NOT base_failed GROUP BY 1),
y AS (SELECT x.*, CASE WHEN list_sum(ch) > 0 AND list_sum(rc) > 0 THEN {shares("ch")} END AS pc, {shares("rc")} AS qc, CASE WHEN list_sum(wh) > 0 AND list_sum(rw) > 0 THEN {shares("wh")} END AS pw, {shares("rw")} AS qw
  FROM x LEFT JOIN refs ON x.lang IS NOT DISTINCT FROM refs.lang),
z AS (SELECT *, CASE WHEN pc IS NOT NULL THEN {_js_sql("pc", "qc", n_class)} END AS cd, CASE WHEN pw IS NOT NULL THEN {_js_sql("pw", "qw", n_word)} END AS wd FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND (coalesce(cd, 0) > {MAX_CLASS_DISTANCE} OR coalesce(wd, 0) > {MAX_WORD_DISTANCE[0]} + {MAX_WORD_DISTANCE[1]} / sqrt(n_words))) AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM z"""


OP8_SQL = _op8_sql()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep. The verdict follows a row by id, text and language, so rows that
    share an id are judged each; a null id is an id like others."""
    bad = cut(judged(docs).filter("not kept").select(F.col("row_hash").alias("_key")).distinct())
    seen = may_have(docs, _row_hash(), key_filter(bad, "_key"))
    # Texts stay where they are, but for those that a bitmap takes for rejected ones.
    looked_up = seen.filter("_hit").join(bad, "_key", "left_anti")
    return seen.filter("not _hit").select("_row").unionByName(looked_up.select("_row")).select("_row.*")
