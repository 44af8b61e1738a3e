"""Mixing has no limit on the number of sources."""

from collections import Counter

from chainrollup.llm import mixing


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = [(k, "w " * (k % 7), f"s{k % 40}" if k % 3 else "big") for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = lambda: sorted(map(tuple, mixing.mixing_plan(d, block_rows=16, flatten=0.5).collect()))
    few = plan()
    for name in ("MAX_SOURCES", "FEW_SOURCES"):
        monkeypatch.setattr(mixing, name, 5, raising=False)
    many = plan()
    assert many == few
    size, got = Counter(), Counter()
    for _, t, s in rows:
        size[s] += len(t.split()) + 1
    budget = sum(size.values())
    power, weights = mixing.temperature_weights(size, budget, flatten=0.5, max_epochs=2.0)
    for _, s, n, _, w, p, _ in many:
        got[s] += n
        assert abs(w - weights[s]) < 1e-8 and abs(p - power) < 1e-12
    assert len(weights) > 5 and all(int(w * budget) - 7 < got[s] <= int(w * budget) for s, w in weights.items())


def test_permutation_is_realised(spark):
    d = spark.createDataFrame([(k, "w " * (k % 5), f"s{k % 3}", k) for k in range(300)], "doc_id long, text string, source string, position long").repartition(4)
    plan = {}
    for r in mixing.mixing_plan(d, flatten=0.5).collect():
        plan.setdefault(r.doc_id, []).append(r.position)
    parts = [[r.doc_id for r in part] for part in mixing.mix(d, flatten=0.5).rdd.glom().collect()]
    assert sorted(x for p in parts for x in p) == sorted(x for x, v in plan.items() for _ in v)
    for p in parts:  # each partition in the order of some assignment of the positions
        last = -1
        for x in p:
            last = min(v for v in plan[x] if v > last)


def test_ties_and_long_texts(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "w " * 300_000, "y"), (None, None, None), (None, "", "")], "doc_id long, text string, source string")
    got = mixing.mixing_plan(d, flatten=0.5).collect()
    assert {r.source for r in got} <= {"x", "y", ""} and max(r.n_tokens for r in got if r.source == "x") == 3
