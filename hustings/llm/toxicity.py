"""Toxicity: a weighted finite-state grammar over clauses.

Five transducers, each a table of states and arcs, read a clause as a row of kinds (insult, threat, target, negation, report, or
none) and pass it on, each with a factor on what it marks: `targets` tells insults and threats with a target within REACH tokens
before or behind from others, `threats` drops threats without one, `insults` weighs insults, `negations` damps what stands within REACH tokens behind a
negation, `reports` damps all of a clause in which somebody is said to speak, wherever that stands. `compose` makes one
transducer of them. What lies ahead is guessed and must come true: a guess that fails ends its path, so one path is left at the
end of a clause, and its value is the sum of factor * lexicon weight. What the clauses of a text sum to is turned into a
score by a logistic model.

Lexicon and model are learned from at most MAX_LABELLED labelled documents, drawn by the hash of their id among the
rows that the caller lets it learn from; all documents are scored, each whole. Only clauses in which an automaton finds an insult or
a threat are read by the grammar: others sum to 0.

Cases: a null or empty text has no clauses, and scores as the model has it for none (below 0.5 as long
as toxic documents are the lesser part). Several labels of one id count as the highest, of several texts the least is learned
from; labels without a document, or null, are left aside. Without labelled documents every score is 0. Repeated rows score alike.
"""

from __future__ import annotations

import re
from collections.abc import Hashable, Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED, SEED = 20_000, 13
#: A lexicon entry stands in at least LEAST toxic documents, and in RATIO times the share of toxic ones as of others.
LEAST, RATIO, STEMS = 5, 12.0, (3, 8)
#: Words that threaten, name a target, negate, or report, in English, German, French and Spanish.
THREATS = (
    "kill kills killed killing hurt hurts hurting destroy destroys destroyed destroying beat beats beaten beating burn burns burned burnt "
    "burning shoot shoots shot shooting stab stabs stabbed stabbing "
    "töten töte tötest tötet tötete töteten getötet umbringen umbringe umbringst umbringt umgebracht umzubringen schlagen schlage schlägst schlägt "
    "schlug schlugen geschlagen verletzen verletze verletzt verletzte verletzten "
    "tuer tue tues tuez tuons tuent tuera tuerai tueras tuerons tuerez tueront tué tués tuée tuées tuant frapper frappe frappes frappez frappons frappent frappera "
    "frapperai frapperas frapperons frapperez frapperont frappé frappés frappée frappées détruire détruis détruit détruisez détruisent détruira détruirai "
    "détruiras détruirons détruiront détruite "
    "matar mato matas mata matamos matan mataré matarás matará mataremos matarán maté mató mataron matado matando golpear golpeo golpeas golpea "
    "golpean golpearé golpeará golpearán golpeado golpeando herir hiero hieres hiere hieren heriré herirás herirá herirán herido hiriendo"
).split()
TARGETS = "you your yours he she they him her them his their du dich dir dein ihr euch sie tu te toi ton vous votre il elle ils usted tú él ella ellos vosotros".split()
NEGATIONS = "not no never neither nor nicht kein keine nie ne pas jamais non nunca jamás ni".split()
REPORTS = "said says say told called claimed according quoted wrote sagte sagt laut dit disait selon dijo dice según".split()

TOKEN, ENDS = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?;:\n]")
NONE, INSULT, THREAT, TARGET, NEGATION, REPORT = KINDS = range(6)
#: What `targets` makes of an insult or a threat that is aimed at somebody.
AIMED_INSULT, AIMED_THREAT = 6, 7
#: A negation or a target reaches this many tokens; factors of a match.
REACH = 3
FACTOR = {"target": 1.5, "negated": 0.25, "reported": 0.3, "threat": 1.5}
FEATURES = 6


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol]: (symbol out, factor, next state) of each way to go on; a path counts if it ends in a final state."""

    start: Hashable
    arcs: dict[Hashable, dict[int, list[tuple[int, float, Hashable]]]]
    final: frozenset


def _built(start: Hashable, follow, symbols: Sequence[int], is_final=lambda state: True) -> Transducer:
    """The transducer of the states that can be reached; follow(state, symbol) gives the ways to go on."""
    arcs: dict = {}
    left = [start]
    while left:
        state = left.pop()
        if state in arcs:
            continue
        arcs[state] = {s: ways for s in symbols if (ways := follow(state, s))}
        left += [after for ways in arcs[state].values() for _, _, after in ways]
    return Transducer(start, arcs, frozenset(filter(is_final, arcs)))


def targets() -> Transducer:
    """A state is (tokens that the last target still reaches, tokens within which one must come, tokens within which none may)."""
    aimed = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}

    def follow(state, s):
        reached, must, ban = state
        if s == TARGET:
            return [] if ban else [(s, 1.0, (REACH, 0, 0))]
        if must == 1:
            return []
        reached, must, ban = max(0, reached - 1), max(0, must - 1), max(0, ban - 1)
        if s not in aimed:
            return [(s, 1.0, (reached, must, ban))]
        if state[0]:
            return [(aimed[s], FACTOR["target"], (reached, must, ban))]
        # One that must come comes as soon as the first that waits for it asks; none may come until the last has been passed.
        return [(aimed[s], FACTOR["target"], (reached, must or REACH, ban)), (s, 1.0, (reached, must, REACH))]

    return _built((0, 0, 0), follow, KINDS, lambda state: not state[1])


def threats() -> Transducer:
    """A threat counts if it is aimed."""
    factor = {THREAT: 0.0, AIMED_THREAT: FACTOR["threat"]}
    return _built(0, lambda _, s: [(THREAT if s in factor else s, factor.get(s, 1.0), 0)], (*KINDS, AIMED_INSULT, AIMED_THREAT))


def insults() -> Transducer:
    """An insult counts by itself, aimed or not."""
    return _built(0, lambda _, s: [(INSULT if s == AIMED_INSULT else s, 1.0, 0)], (*KINDS, AIMED_INSULT))


def negations() -> Transducer:
    """A state is the number of tokens that the last negation still reaches."""

    def follow(left, s):
        factor = FACTOR["negated"] if left and s in (INSULT, THREAT) else 1.0
        return [(s, factor, REACH if s == NEGATION else max(0, left - 1))]

    return _built(0, follow, KINDS)


def reports() -> Transducer:
    """Whether somebody reports is guessed before the first token: `said` follows from `will be said` at a report."""

    def follow(state, s):
        if state == "start":
            return follow("plain", s) + follow("will be said", s)
        if state == "plain":
            return [] if s == REPORT else [(s, 1.0, "plain")]
        return [(s, FACTOR["reported"] if s in (INSULT, THREAT) else 1.0, "said" if s == REPORT else state)]

    return _built("start", follow, KINDS, lambda state: state != "will be said")


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What `second` makes of what `first` makes of a row: factors multiply, and states that lead to no end are left out."""

    def follow(state, s):
        p, q = state
        return [
            (out, f * g, (p2, q2))
            for middle, f, p2 in first.arcs[p].get(s, ())
            for out, g, q2 in second.arcs[q].get(middle, ())
        ]

    symbols = sorted({s for row in first.arcs.values() for s in row})
    both = _built((first.start, second.start), follow, symbols, lambda state: state[0] in first.final and state[1] in second.final)
    alive = set(both.final)
    while True:
        more = {p for p, row in both.arcs.items() if p not in alive and any(after in alive for ways in row.values() for _, _, after in ways)}
        if not more:
            break
        alive |= more
    arcs = {p: {s: kept for s, ways in row.items() if (kept := [w for w in ways if w[2] in alive])} for p, row in both.arcs.items() if p in alive or p == both.start}
    return Transducer(both.start, arcs, both.final)


def grammar_of_clauses() -> Transducer:
    whole = targets()
    for part in (threats(), insults(), negations(), reports()):
        whole = compose(whole, part)
    return whole


def value(machine: Transducer, kinds: Sequence[int], weights: Sequence[float]) -> float:
    """The sum of factor * weight along the path of a clause."""
    now: dict[Hashable, float] = {machine.start: 0.0}
    for kind, weight in zip(kinds, weights, strict=True):
        after: dict[Hashable, float] = {}
        for state, total in now.items():
            for _, factor, to in machine.arcs[state].get(kind, ()):
                after[to] = max(after.get(to, -np.inf), total + factor * weight)
        now = after
    return max((total for state, total in now.items() if state in machine.final), default=0.0)


class Grammar:
    """Kinds and weights of tokens, and features of texts."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.sizes = sorted({len(s) for s in stems}, reverse=True)
        fixed = ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT))
        self.fixed = {w: (kind, float(kind == THREAT)) for ws, kind in fixed for w in ws}
        self.machine = grammar_of_clauses()
        self.finder = ahocorasick.Automaton()
        for entry in {*words, *stems, *THREATS}:
            self.finder.add_word(entry, entry)
        self.finder.make_automaton()

    def kind(self, low: str) -> tuple[int, float]:
        if low in self.words:
            return INSULT, self.words[low]
        for n in self.sizes:
            if low[:n] in self.stems and len(low) >= n:
                return INSULT, self.stems[low[:n]]
        return self.fixed.get(low, (NONE, 0.0))

    def features(self, text: str) -> tuple[float, ...]:
        """Sum and largest of the clauses' scores, matched clauses, their share, score by length, and whether any."""
        low = text.lower()
        # Places at which a word begins that may be an insult or a threat.
        found = [end - len(entry) + 1 for end, entry in self.finder.iter(low)] if len(low) else []
        found = sorted({at for at in found if not at or not TOKEN.match(low[at - 1])})
        if not found:
            return (0.0,) * FEATURES
        ends = [m.start() for m in ENDS.finditer(low)]
        total, most, matched, at, begin = 0.0, 0.0, 0, 0, 0
        for end in (*ends, len(low)):
            if at < len(found) and found[at] < end:
                while at < len(found) and found[at] < end:
                    at += 1
                kinds = [self.kind(token) for token in TOKEN.findall(low[begin:end])]
                score = value(self.machine, *zip(*kinds, strict=True)) if kinds else 0.0
                total, most, matched = total + score, max(most, score), matched + (score > 0)
            begin = end + 1
        words = max(1.0, len(low) / 6)
        return (np.log1p(total), np.log1p(most), np.log1p(matched), matched / (len(ends) + 1), min(3.0, 100.0 * total / words), float(total > 0))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the intercept last: Newton's method with a ridge on all but the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lexicon(texts: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark toxic documents, weighted by the log of the ratio of shares."""
    n = texts.groupBy().agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    p, q = n["p"] or 0, n["n"] - (n["p"] or 0)
    if not p or not q:
        return {}, {}
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    words = texts.select("toxic", F.explode(found).alias("w")).groupBy("w").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    ends = F.sequence(F.lit(STEMS[0]), F.least(F.lit(STEMS[1]), F.length("w")))
    stems = F.transform(ends, lambda k: F.struct(F.left("w", k).alias("entry"), F.lit(True).alias("stem")))
    entries = words.select("p", "n", F.inline(F.array_append(stems, F.struct(F.col("w").alias("entry"), F.lit(False).alias("stem")))))
    share = F.col("p") / p
    ratio = share / ((F.col("n") - F.col("p") + 0.5) / q)
    rows = (
        entries.filter("length(entry) >= 3")
        .groupBy("entry", "stem")
        .agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.count("*").alias("kinds"))
        .withColumn("ratio", ratio)
        .filter((F.col("p") >= LEAST) & (F.col("ratio") >= RATIO))
        .collect()
    )
    words_found = {r["entry"]: float(np.log(r["ratio"])) for r in rows if not r["stem"]}
    # A stem stands for many words; one that only one word has adds nothing to that word.
    stems_found = {r["entry"]: float(np.log(r["ratio"])) for r in rows if r["stem"] and r["kinds"] >= 3}
    return words_found, stems_found


class Model:
    """A grammar and the logistic weights of its features."""

    def __init__(self, grammar: Grammar, weights: np.ndarray):
        self.words, self.stems, self.weights = grammar.words, grammar.stems, weights

    def scorer(self):
        grammar, weights = Grammar(self.words, self.stems), self.weights

        def score(text: str | None) -> float:
            z = float(np.dot(weights[:-1], grammar.features(text or "")) + weights[-1])
            return 1 / (1 + np.exp(-z)) if z > -30 else 0.0

        return score


def learned(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, seed: int = SEED) -> Model | None:
    """docs (doc_id, text); labels (doc_id, toxic) that may be learned from."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    texts = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("toxic", "text")
    grammar = Grammar(*_lexicon(texts))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Grammar(grammar.words, grammar.stems)
        for batch in batches:
            x = [mine.features(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    facts = texts.mapInArrow(rows, "toxic int, x array<double>").collect()
    if not facts:
        return None
    y = np.array([f["toxic"] for f in facts], float)
    order = np.lexsort(np.column_stack([[f["x"] for f in facts], y]).T)
    return Model(grammar, fit_logistic(np.array([f["x"] for f in facts])[order], y[order]))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score. Narrow: no shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer() if model else lambda text: 0.0
        for batch in batches:
            found = [float(score(t.as_py())) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; learn from labels of rows that aren't held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out)
    model = learned(docs, labels)
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
