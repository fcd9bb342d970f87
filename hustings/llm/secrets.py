"""Secret scans: candidates by shape, then a random forest that drops what only looks like a secret.

A candidate is a run of 16 or more of [A-Za-z0-9_+/-] and up to two = behind it; and, with or without digits and however short
(4 characters), what is assigned to a name with a secret word in it, and what follows a known prefix. The forest sees its length and
character classes, its character transitions (how surprising each is to a model of pairs of characters, learned from the words of a
public vocabulary), the share that dictionary words cover (a trie of that vocabulary's DICTIONARY most frequent ones), path
marks and the words beside it. It is grown on the driver from `labelled_findings`: FINDINGS findings labelled by the rule that made
them, set into CONTEXTS pieces of the corpus's own texts, drawn by hash; and compiled to one SQL expression: on the texts, all is SQL.

Cases: a null or empty text has no candidates. Texts are read whole. A candidate that stands in a text
several times is judged at each place, by its neighbours there. Repeated rows are scanned each. Other
columns pass through; none is looked up but doc_id and text.
"""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the text before and behind a candidate that the forest sees.
BEFORE, BEHIND = 48, 16
MASK = "[SECRET]"
#: Words beside a secret, and words beside what isn't one.
SECRET_WORDS = "token|secret|passwo?r?d|passwd|api[_ -]?key|apikey|auth|bearer|credential|private[_ -]?key|access[_ -]?key|signing"
PLAIN_WORDS = "commit|sha-?1|sha-?256|sha|md5|checksum|digest|uuid|guid|hash|revision|build|etag|version|integrity|iban|card|order|invoice|blob|request[_ -]?id|trace"
KNOWN = "AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abprs]-|sk_live_|sk-|rk_live_|eyJ|AIza|SG[.]|ya29[.]"

_EDGE = "(?<![A-Za-z0-9_+/-])"
#: A value that is assigned to a name with a secret word in it, a known prefix with what follows, or a run of 16 or more.
#: One character tells at most places that no value is assigned there; longer look-behinds follow.
CANDIDATE = (
    "(?<=[:=\\s\"'])(?<=[:=]\\s{0,2}[\"']?)(?<=(?i:" + SECRET_WORDS + ")[A-Za-z0-9_-]{0,12}[\"']?\\s{0,2}[:=]\\s{0,2}[\"']?)"
    "[A-Za-z0-9_+/@!#$%^&*~.-]{3,}[A-Za-z0-9_+/@!#$%^&*~-]={0,2}+"
    "|" + _EDGE + "(?:[A-Za-z0-9_+/-]{16,}+={0,2}+|(?=[AgxsreyS])(?:" + KNOWN + ")[A-Za-z0-9_+/-]{8,}+={0,2}+)"
)

#: How many labelled findings the forest is grown from, pieces of texts they are set into, and its size.
FINDINGS, CONTEXTS, TREES, DEPTH, SEED = 3000, 400, 24, 6, 5
#: The public vocabulary (a file of public_tokenizers), and how many of its words, the most frequent, are the dictionary.
VOCABULARY, DICTIONARY = "word_bpe_49k.json", 6000
#: Characters whose pairs are counted; all digits are one, all others another.
PAIRED = "abcdefghijklmnopqrstuvwxyz0"


@cache
def vocabulary(name: str = VOCABULARY) -> tuple[str, ...]:
    """The whole words of a vocabulary, of four ASCII letters or more, the most frequent first."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        known = json.load(file)["model"]["vocab"]
    whole = [w.removesuffix("</w>") for w in sorted(known, key=known.get) if w.endswith("</w>")]
    return tuple(w for w in whole if len(w) >= 4 and w.isascii() and w.isalpha())


def trie_pattern(words: Sequence[str]) -> str:
    """A pattern that matches the longest of some words, letter by letter."""
    root: dict = {}
    for word in words:
        at = root
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        ways = [letter + pattern(below) for letter, below in sorted(node.items()) if letter]
        if not ways:
            return ""
        one = ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"
        return (f"(?:{one})?" if len(ways) == 1 else one + "?") if "" in node else one

    return pattern(root)


def pair_costs(words: Sequence[str]) -> str:
    """The bits by which each pair of PAIRED (and others) surprises who knows these words, a character each from "0" on, in thirds."""
    n = len(PAIRED) + 1
    counts = np.full((n, n), 0.5)
    for word in words:
        places = [0, *(PAIRED.find(x) + 1 for x in word.lower()), 0]
        for x, y in zip(places, places[1:], strict=False):
            counts[x, y] += 1
    bits = -np.log2(counts / counts.sum(axis=1, keepdims=True))
    return "".join(chr(48 + min(70, round(3 * b))) for b in bits.ravel())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@cache
def _transitions() -> str:
    """SQL of the mean cost of {c}'s pairs."""
    normal = "translate(lower({c}), '123456789', '000000000')"
    place = lambda k: f"instr('{PAIRED}', substr(w, {k}, 1))"
    cost = f"ascii(substr({_quoted(pair_costs(vocabulary()))}, {len(PAIRED) + 1} * {place('k')} + {place('k + 1')} + 1, 1)) - 48"
    return f"transform(array({normal}), w -> aggregate(sequence(1, greatest(1, length(w) - 1)), 0, (s, k) -> s + {cost}) / greatest(1, length(w) - 1))[0]"


#: Name and SQL of each feature, of candidate {c}, text before {b} and text behind {a}.
FEATURES = {
    "transitions": "{transitions}",
    "covered": "(length({c}) - length(regexp_replace(lower({c}), {dictionary}, ''))) / length({c})",
    "length": "length({c})",
    "class_runs": "regexp_count({c}, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+') / length({c})",
    "digits": "(length({c}) - length(regexp_replace({c}, '[0-9]+', ''))) / length({c})",
    "uppers": "(length({c}) - length(regexp_replace({c}, '[A-Z]+', ''))) / length({c})",
    "symbols": "(length({c}) - length(regexp_replace({c}, '[^A-Za-z0-9]+', ''))) / length({c})",
    "distinct": "size(array_distinct(split({c}, ''))) / length({c})",
    "hex": "cast({c} rlike '^[0-9a-fA-F]+$' as int)",
    "uuid": "cast({c} rlike '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$' as int)",
    "path_marks": "regexp_count({c}, '/') + cast({b} rlike '[/.\\\\\\\\@]$' as int) + cast({a} rlike '^[.@][A-Za-z]' as int)",
    "known_form": f"cast({{c}} rlike '^({KNOWN})' as int)",
    "secret_words": f"cast({{b}} rlike '(?i)({SECRET_WORDS})[^.!?]{{0,16}}$' as int)",
    "plain_words": f"cast({{b}} rlike '(?i)({PLAIN_WORDS})[^.!?]{{0,16}}$' as int)",
    "assigned": "cast({b} rlike '[:=]\\\\s*[\"\\']?$' as int)",
    "quoted": "cast({b} rlike '[\"\\']$' and {a} rlike '^[\"\\']' as int)",
}


def labelled_findings(n: int = FINDINGS, seed: int = SEED, contexts: Sequence[str] = (), rare: bool = False) -> list[tuple[str, str, str, int]]:
    """(before, candidate, behind, label): findings made by rule, half of them secrets, set into pieces of texts.

    Ordinary identifiers are made of a vocabulary's words: of its upper half, which holds the dictionary, or of the lower, `rare` one."""
    rng = random.Random(seed)
    hexes, lower, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    known = vocabulary()
    half = known[len(known) // 2 :] if rare else known[: len(known) // 2]
    word = lambda k: "".join(rng.choice(lower) + rng.choice("aeiou") for _ in range(k))
    some = lambda letters, k: "".join(rng.choices(letters, k=k))
    piece = lambda: rng.choice(half)

    def filler() -> str:
        if contexts and rng.random() < 0.8:
            words = rng.choice(contexts).split()
            at = rng.randrange(len(words)) if words else 0
            return " ".join(words[at : at + rng.randint(0, 6)])
        return " ".join(piece() for _ in range(rng.randint(0, 5)))

    def secret() -> tuple[str, str, str]:
        body = rng.choice([
            lambda: some(hexes, rng.choice((32, 40, 40, 48, 64))), lambda: some(alnum, rng.randint(20, 64)),
            lambda: some(alnum + "+/", rng.randint(28, 84)) + rng.choice(("", "=", "==")), lambda: some(alnum + "-_", rng.randint(22, 60)),
        ])()
        if rng.random() < 0.25:
            known = rng.choice(["AKIA", "ghp_", "glpat-", "xoxb-", "sk_live_", "sk-", "eyJ", "AIza"])
            body = some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16) if known == "AKIA" or rng.random() < 0.2 else some(alnum, rng.randint(16, 40))
            if rng.random() < 0.3:
                body = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isdigit() else c for c in body)
            return filler() + rng.choice([" ", " = ", ": ", ' "']), known + body, rng.choice(['"', " ", "\n"])
        if rng.random() < 0.35:
            body = rng.choice([
                lambda: some(alnum, rng.randint(8, 15)), lambda: some(alnum + "!@#$%&*", rng.randint(8, 15)), lambda: some(alnum, rng.randint(20, 64)).translate(str.maketrans("", "", "0123456789")),
                lambda: word(rng.randint(2, 3)) + str(rng.randint(0, 9999)) + rng.choice(["", "!", some(lower, 1)]),
                lambda: piece() + str(rng.randint(0, 999)) + rng.choice(["", "!", some(lower, 1)]),
            ])()
        name = rng.choice(["token", "secret", "password", "api_key", "apikey", "auth_token", "Bearer", "client_secret", "access_key", "private_key", "signing key", "TOKEN", "API_KEY"])
        sign, quote = rng.choice([" = ", "=", ": ", " ", " is ", ":"]), rng.choice(['"', "'", ""])
        return f"{filler()} {name}{sign}{quote}", body, quote + rng.choice([" ", "\n", ";", ","]) + filler()[:10]

    def plain() -> tuple[str, str, str]:
        kind = rng.randrange(11)
        if kind >= 9:
            name = rng.choice(["token", "secret", "password", "auth", "credential", "passwd", "auth_type", "token_name", "private key", "Bearer"])
            value = rng.choice([lambda: rng.choice(["null", "none", "None", "true", "false", "string", "required", "optional", "undefined", "env"]), piece, lambda: word(rng.randint(2, 5)), lambda: piece() + rng.choice("_.-") + piece()])()
            return f"{filler()} {name}{rng.choice([' = ', '=', ': ', ':'])}", value, rng.choice([" ", "\n", ";", ",", "."]) + filler()[:10]
        if kind == 0:
            name = rng.choice(["commit", "sha1:", "checksum", "md5 =", "etag:", "revision", "digest:", "sha256:", "build", "blob", "hash"])
            return f"{filler()} {name} {rng.choice(['', chr(34)])}", some(hexes, rng.choice((32, 40, 64))), " " + filler()[:10]
        if kind == 1:
            u = some(hexes, 32)
            return filler() + rng.choice([" id ", " uuid: ", " = ", ' "', " token "]), "-".join((u[:8], u[8:12], u[12:16], u[16:20], u[20:])), " "
        if kind == 2:
            return filler() + " ", some("0123456789", rng.randint(16, 24)), " " + filler()[:10]
        if kind == 3:
            return filler() + rng.choice([" ", "/", " /", " https://"]), "/".join(piece() + rng.choice(["", str(rng.randint(1, 99))]) for _ in range(rng.randint(3, 6))), rng.choice([".py", ".html", "/", " "])
        if kind == 4:
            return filler() + rng.choice([" ", ' "', "="]), rng.choice("_-").join(piece() for _ in range(rng.randint(3, 6))) + rng.choice(["", str(rng.randint(1, 2030))]), rng.choice([".png", " ", '"'])
        if kind == 5:
            return filler() + " ", word(rng.randint(8, 14)) + rng.choice(["", str(rng.randint(1, 99))]), " "
        if kind == 6:
            return filler() + " ", f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}_{rng.randint(10, 23)}-{rng.randint(10, 59)}-{rng.randint(10, 59)}", " "
        if kind == 7:
            return filler() + rng.choice([" ", " iban ", ", "]), some("ABCDEFGHILMNOPRSTUV", 2) + some("0123456789", rng.randint(14, 25)), " "
        return filler() + rng.choice([" token ", " password: ", " secret = ", " the password "]), "-".join(piece() for _ in range(rng.randint(3, 5))), rng.choice([" ", "."])

    return [((secret if i % 2 else plain)() + (i % 2,)) for i in range(n)]


def corpus_contexts(docs: DataFrame, most: int = CONTEXTS, seed: int = SEED) -> list[str]:
    """Pieces of 200 characters of texts, in the order of a hash. Of a large table only a part of the hash range is looked at, in which many
    times `most` texts lie, so that tasks don't send so many each."""
    drawn = F.xxhash64("doc_id", "text", F.lit(seed))
    part = min(1.0, 20 * most / max(1, docs.count()))
    docs = docs.filter(F.pmod(drawn, F.lit(1 << 30)) < int(part * (1 << 30)))
    start = F.pmod(F.col("draw"), F.greatest(F.lit(1), F.length("text") - 200)).cast("int") + 1
    pieces = docs.filter("text is not null").select("text", drawn.alias("draw")).select("draw", F.substring("text", start, F.lit(200)).alias("piece"))
    return [r["piece"] for r in pieces.orderBy("draw", "piece").limit(most).collect()]


def _features(c: str, b: str, a: str) -> list[str]:
    dictionary = _quoted(trie_pattern(vocabulary()[:DICTIONARY]))

    def filled(sql: str) -> str:
        return sql.replace("{transitions}", _transitions()).replace("{dictionary}", dictionary).replace("{c}", c).replace("{b}", b).replace("{a}", a)

    return [f"cast({filled(sql)} as double) as {name}" for name, sql in FEATURES.items()]


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, least: int = 5):
    """A tree as a number (the share of secrets) or (feature, bound, left, right)."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best, features = None, rng.choice(x.shape[1], size=max(1, round(np.sqrt(x.shape[1]))) + 1, replace=False)
    for f in sorted(features):
        values = np.unique(x[:, f])
        for bound in np.unique(np.quantile(values, np.linspace(0.04, 0.96, 24))) if len(values) > 24 else (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= bound
            n = int(left.sum())
            if least <= n <= len(y) - least:
                p, q = y[left].mean(), y[~left].mean()
                loss = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or loss < best[0] - 1e-12:
                    best = (loss, int(f), float(bound), left)
    if best is None:
        return share
    _, f, bound, left = best
    return (f, bound, _grow(x[left], y[left], depth - 1, rng, least), _grow(x[~left], y[~left], depth - 1, rng, least))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """Trees on bootstrap samples, each split among a random few of the features."""
    rng = np.random.default_rng(seed)
    return [_grow(x[rows], y[rows], depth, rng) for rows in (rng.integers(0, len(y), len(y)) for _ in range(trees))]


def forest_sql(forest: list, row: str) -> str:
    names = list(FEATURES)

    def tree(node) -> str:
        if isinstance(node, float):
            return f"{node:.6f}D"
        f, bound, left, right = node
        return f"CASE WHEN {row}.{names[f]} <= {bound!r}D THEN {tree(left)} ELSE {tree(right)} END"

    return "((" + ") + (".join(tree(t) for t in forest) + f")) / {len(forest)}D"


_FORESTS: dict[tuple, list] = {}


def trained(spark: SparkSession, contexts: Sequence[str] = (), findings: int = FINDINGS, seed: int = SEED) -> list:
    """The forest for these findings; their features come from the SQL that texts are scanned with."""
    key = (findings, seed, tuple(contexts))
    if key not in _FORESTS:
        made = labelled_findings(findings, seed, contexts)
        table = spark.createDataFrame(made, "b string, c string, a string, label int")
        cut = table.select("label", "c", F.right("b", F.lit(BEFORE)).alias("b"), F.left("a", F.lit(BEHIND)).alias("a"))
        rows = np.array([tuple(r) for r in cut.selectExpr("label", *_features("c", "b", "a")).collect()], float)
        _FORESTS[key] = grow_forest(rows[:, 1:], rows[:, 0])
    return _FORESTS[key]


def scored(forest: list) -> Column:
    """array<struct<i, c, score>> of a text's candidates; p and c are its pieces and candidates."""
    pattern = _quoted(CANDIDATE)
    places = "CASE WHEN size(z.c) > 0 THEN sequence(0, size(z.c) - 1) ELSE array() END"
    near = f"named_struct('i', i, 'c', z.c[i], 'b', right(z.p[i], {BEFORE}), 'a', left(z.p[i + 1], {BEHIND}))"
    facts = "struct(y.i as i, y.c as c, " + ", ".join(_features("y.c", "y.b", "y.a")) + ")"
    return F.expr(f"""
        transform(array(named_struct('p', split(coalesce(text, ''), {pattern}, -1), 'c', regexp_extract_all(coalesce(text, ''), {pattern}, 0))),
          z -> named_struct('p', z.p, 'found', transform(transform(transform({places}, i -> {near}), y -> {facts}),
            x -> named_struct('i', x.i, 'c', x.c, 'score', {forest_sql(forest, "x")}))))[0]
    """)


#: Characters from each candidate's start to the next one's, summed by blocks, so that a place costs a block's steps and the blocks before it.
_BLOCK = 256
_STEPS = "transform(s.found, (y, i) -> cast(length(y.c) + length(s.p[i + 1]) as bigint))"
_BLOCKS = f"transform(sequence(0, size(steps) div {_BLOCK}), k -> aggregate(slice(steps, k * {_BLOCK} + 1, {_BLOCK}), 0L, (n, y) -> n + y))"
_PLACE = (
    f"first_piece + aggregate(slice(blocks, 1, x.i div {_BLOCK}), 0L, (n, y) -> n + y)"
    f" + aggregate(slice(steps, x.i div {_BLOCK} * {_BLOCK} + 1, x.i % {_BLOCK}), 0L, (n, y) -> n + y)"
)


def findings(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """A row for each secret: doc_id, place (characters before it), length, score, SHA-256 of it. Narrow: no shuffle."""
    forest = trained(docs.sparkSession, corpus_contexts(docs))
    # explode_outer: for explode, the optimizer would put a filter below it that scans the texts once more.
    found = docs.select("doc_id", scored(forest).alias("s")).withColumn("steps", F.expr(_STEPS)).withColumn("blocks", F.expr(_BLOCKS))
    found = found.withColumn("first_piece", F.expr("cast(length(s.p[0]) as bigint)"))
    return (
        found.select("doc_id", "steps", "blocks", "first_piece", F.explode_outer("s.found").alias("x"))
        .filter(F.col("x.score") >= least)
        .select(
            "doc_id", F.expr(_PLACE).alias("place"), F.length("x.c").alias("length"),
            F.round("x.score", 6).alias("score"), F.sha2("x.c", 256).alias("secret_sha256"),
        )
    )


def redacted(docs: DataFrame, least: float = 0.5, mask: str = MASK) -> DataFrame:
    """The same rows with each secret replaced by `mask` in text. Narrow: no shuffle."""
    forest = trained(docs.sparkSession, corpus_contexts(docs))
    clean = F.expr(
        f"CASE WHEN NOT exists(s.found, x -> x.score >= {least}D) THEN text ELSE array_join(transform(s.p, (p, i) -> CASE WHEN i < size(s.found) "
        f"THEN concat(p, CASE WHEN s.found[i].score >= {least}D THEN {_quoted(mask)} ELSE s.found[i].c END) ELSE p END), '') END"
    )
    held = docs.select(F.struct("*").alias("row"), F.col("text"), scored(forest).alias("s"))
    return held.select(*[clean.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return redacted(docs)
