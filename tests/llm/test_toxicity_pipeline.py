import itertools
import random
import zlib

from hustings.llm import toxicity as T


def plainly(kinds, weights):
    """The value of a clause by its definition, match by match."""
    total = 0.0
    for i, kind in enumerate(kinds):
        if kind not in (T.INSULT, T.THREAT):
            continue
        near = kinds[max(0, i - T.REACH) : i] + kinds[i + 1 : i + T.REACH + 1]
        aimed = T.TARGET in near
        factor = (T.FACTOR["target"] if aimed else 1.0) * ((T.FACTOR["threat"] if aimed else 0.0) if kind == T.THREAT else 1.0)
        factor *= T.FACTOR["negated"] if T.NEGATION in kinds[max(0, i - T.REACH) : i] else 1.0
        factor *= T.FACTOR["reported"] if T.REPORT in kinds else 1.0
        total += factor * weights[i]
    return total


def test_composed_grammar_against_brute_force():
    """Every clause of up to five kinds, and long ones by chance: one path is left, and its value is the definition's."""
    machine, rng = T.grammar_of_clauses(), random.Random(2)
    every = [k for n in range(6) for k in itertools.product(T.KINDS, repeat=n)]
    for kinds in [*every, *(tuple(rng.choices(T.KINDS, weights=(6, 2, 2, 2, 1, 1), k=rng.randint(6, 40))) for _ in range(2000))]:
        weights = [rng.uniform(0.5, 3) if k in (T.INSULT, T.THREAT) else 0.0 for k in kinds]
        assert abs(T.value(machine, kinds, weights) - plainly(list(kinds), weights)) < 1e-9


def paths(machine, kinds):
    now = [((), (), machine.start)]
    for k in kinds:
        now = [(out + (o,), factors + (f,), to) for out, factors, state in now for o, f, to in machine.arcs[state].get(k, ())]
    return [(out, factors) for out, factors, state in now if state in machine.final]


def test_composition_is_application_in_turn():
    rng = random.Random(4)
    first, second = T.targets(), T.threats()
    both = T.compose(first, second)
    for _ in range(500):
        kinds = rng.choices(T.KINDS, k=rng.randint(0, 9))
        in_turn = sorted((o2, tuple(f * g for f, g in zip(f1, f2, strict=True))) for o1, f1 in paths(first, kinds) for o2, f2 in paths(second, o1))
        assert sorted(paths(both, kinds)) == in_turn and len(in_turn) == 1


def test_grammar():
    g = T.Grammar({"idiot": 2.0}, {"scumm": 1.0})
    total = lambda text: g.features(text)[0]
    assert total("a quiet text") == total("") == total("you and he") == 0
    assert total("you idiot") > total("the idiot") > total("not an idiot") > 0
    assert total("they said he is an idiot") < total("he is an idiot")
    assert total("I will kill time") == 0 < total("you will kill")
    assert total("scummiest") > 0 and total("scum") == 0
    assert total("not. idiot") == total("idiot")
    assert total("he is an idiot, she said") < total("he is an idiot") and total("pidiot idiots") == 0


def test_targets_behind():
    g = T.Grammar({"idiot": 2.0}, {"scumm": 1.0})
    total = lambda text: g.features(text)[0]
    assert total("I will kill you") == total("you will kill") > 0
    assert total("idiot, you") == total("you idiot") > total("idiot, here are three or four words and you")
    assert total("kill in a week you") == total("kill. you") == total("I will kill time") == 0
    assert 0 < total("I will not kill you") < total("I will kill you") and 0 < total("they said we would kill you") < total("would kill you")
    assert total("not an idiot, you") < total("an idiot, you")
    assert all(total(text) > 0 for text in ("he kills them", "killing you", "er tötet dich", "je vais te frapper", "te mataré"))
    assert total("idiot kill you") > total("idiot kill") == total("idiot")
    assert total("idiot you you") == total("idiot you")


def test_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows = T.op3_toxicity(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(good) / len(bad)
    assert auc > 0.93 and sum(g >= 0.5 for g in good) < 0.01 * len(good)


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (9, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    model = T.learned(odd_docs, labels)
    assert T.scored(odd_docs, model).count() == odd_docs.count()
    assert T.scored(odd_docs.limit(0), T.learned(odd_docs.limit(0), labels)).count() == 0
    assert T.scored(odd_docs, T.learned(odd_docs, labels.limit(0))).agg({"score": "max"}).first()[0] == 0


def test_pipeline(spark, odd_docs, tmp_path):
    """run() and its stages, with nulls, ties, repeated rows and clashing names: columns stay until the last stage."""
    import corpus_pipeline

    (tmp_path / "sf").mkdir()
    odd_docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    assert pieces and {r["offset"] + r["length"] <= 1024 for r in pieces} == {True}
    docs = odd_docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == odd_docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs.limit(0), "").count() == 0
