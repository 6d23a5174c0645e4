"""Scores, margins, merges, subsets and small rules around them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import scorers, vectors


def test_scores_and_margins(spark):
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [4.0, 3.0]), ("c", [0.0, 2.0])], "k string, x array<double>")
    got = scorers.margins(spark.createDataFrame([("a", "b", "c")], "anchor string, positive string, negative string"), vectors, "k", "x").first()
    assert got.margin == pytest.approx(0.96 - 0.8)
    assert scorers.rms(vectors, "x").first().rms == pytest.approx(((9 + 16 + 16 + 9 + 0 + 4) / 6) ** 0.5)
    cold = {r.k: r.x for r in scorers.cold_start(vectors, spark.createDataFrame([("b",)], "k string"), "k", "x").collect()}
    assert cold == {"a": [3.0, 4.0], "b": [0.0, 0.0], "c": [0.0, 2.0]}
    scores = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([5, 1, 3, 9])] + [(2, 0, 4.0), (2, 1, float("inf")), (2, 2, float("nan"))], "q int, i int, score double")
    assert {r.q: r["mean"] for r in scorers.highest_mean(scores.where("q = 1"), ["q"], "score", 2).collect()} == {1: 7.0}
    allowed = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)], "q int, i int")
    assert [(r.q, r.i) for r in scorers.masked_top(scores, allowed, "q", "i", 2).orderBy("q", "rank").collect()] == [(1, 0), (1, 2), (2, 0)]
    with pytest.raises(ValueError, match="mode"):
        scorers.prepared(vectors, "other")
    hidden = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "h array<array<double>>, m array<int>")
    assert [hidden.select(scorers.pooled(F.col("h"), F.col("m"), how)).first()[0] for how in ("mean", "first")] == [[2.0, 3.0], [1.0, 2.0]]
    ranked = spark.createDataFrame([("q", "x", 2), ("q", "y", 4)], "q string, i string, rank int")
    mrr = scorers.pair_average_mrr(ranked, spark.createDataFrame([("q", "x"), ("q", "y"), ("q", "z")], "q string, i string"), "q", "i").first()
    assert mrr.mrr == pytest.approx(0.25) and mrr.pairs == 3


def test_merges_and_subsets(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string"), spark.createDataFrame([(1, "x")], "k int, r string")
    assert sorted(map(tuple, scorers.merged_many_to_one(left, right, ["k"]).collect())) == [(1, "a", "x"), (2, "b", None)]
    with pytest.raises(ValueError, match="one row"):
        scorers.merged_many_to_one(left, right.union(right), ["k"])
    rows = spark.createDataFrame([(1, "s", [1, 2]), (2, "s", [2, 3]), (3, "s", [4]), (4, "t", [9])], "k int, sig string, u array<int>")
    assert sorted(map(tuple, scorers.disjoint_peers(rows, ["sig"], "k", "u").collect())) == [(1, 3), (2, 3)]
    sets = spark.createDataFrame([(["W", "U", "B"],), ([],)], "c array<string>")
    assert [r[0] for r in sets.select(scorers.combinations(F.col("c"), 2)).collect()] == [[["W", "U"], ["W", "B"], ["U", "B"]], []]
    assert [r[0] for r in sets.select(F.size(scorers.combinations(F.col("c"), 1))).collect()] == [3, 0]
    members = spark.createDataFrame([("g", i) for i in range(8)] + [("h", 1)], "g string, m int")
    picked = scorers.picked_subsets(members, "g", "m", 3, 5, 1).collect()
    assert [r.g for r in picked] == ["g", "g"] and len({m for r in picked for m in r.members}) == 6
    assert [scorers.mixed_in(100, s) for s in (0, 0.2, 0.5)] == [0, 25, 100]
    with pytest.raises(ValueError):
        scorers.mixed_in(10, 1)
    now = datetime.datetime(2024, 1, 2, 12)
    seen = spark.createDataFrame([("a", now - datetime.timedelta(hours=30)), ("a", now - datetime.timedelta(hours=5)), ("b", now - datetime.timedelta(hours=7))], "s string, t timestamp")
    assert {r.s: r.stale for r in scorers.stale(seen, "s", "t", F.lit(now), 6).collect()} == {"a": False, "b": True}


def test_best_products(spark):
    """Against all pairs; ties by key, fewer rows than k, odd vectors; no join of queries with plain rows."""
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows + [(500, None), (501, [1.0, None, 0.0])], "key long, v array<double>").repartition(3)
    asked = df.where("key % 20 = 0").selectExpr("key as qid", "v as q")
    got = {(r.qid, r["rank"]): (r.key, r.score) for r in vectors.best_products(asked, df, 4).collect() if r.qid < 500}
    want = {}
    for a, q in rows[::20]:
        best = sorted((-sum(x * y for x, y in zip(q, v)), b) for b, v in rows if b != a)[:4]
        want |= {(a, n): (b, -s) for n, (s, b) in enumerate(best, 1)}
    assert got == want
    few = vectors.best_products(asked.where("qid = 0"), df.where("key < 3"), 4)
    assert sorted((r.key, r["rank"]) for r in few.collect())[0][0] == 1 and few.count() == 2
    assert "MapInArrow" in few._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mode", ["cross_dot", "symmetric_cross_cosine", "compatibility"])
def test_best_of_a_mode(spark, mode):
    """The same as ranking all scores, without a join that makes them."""
    rnd = random.Random(4)
    df = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(3)], [rnd.gauss(0, 1) for _ in range(3)]) for i in range(60)], "k long, u array<double>, v array<double>")
    weights = F.array(*map(F.lit, (0.2, 0.5, 1.0)))
    got = {(r.query, r["rank"]): (r.k, r.score_r) for r in scorers.best(df.where("k % 20 = 0"), df, "k", mode, 3, weights).collect()}
    every = {}
    for r in scorers.scored(df.where("k % 20 = 0"), df, "k", mode, weights).collect():
        every.setdefault(r["query"], []).append((-round(r.score, 6), r.k))
    assert got == {(q, n): (k, pytest.approx(-s, abs=1e-9)) for q, x in every.items() for n, (s, k) in enumerate(sorted(x)[:3], 1)}
