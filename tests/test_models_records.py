"""Models, nested records, stages and summaries."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import models, rank, records
from sparkloom.sources import stages


def test_probes(spark):
    rng = np.random.default_rng(0)
    rows = [(list(map(float, x)), int(x[0] + 0.3 * rng.standard_normal() > 0.5), float(2 * x[1] + 1)) for x in rng.standard_normal((400, 4))]
    df = spark.createDataFrame(rows, "v array<double>, y int, z double")
    train, test = df.limit(300), df.limit(300)
    judged = models.logistic_probe(train, test, "v", "y", 1.0)
    assert judged.where("y = guess").count() > 0.85 * 300 and "chance" in judged.columns
    err = models.regression_errors(models.ridge_probe(train, test, "v", "z", 0.01), "z", "guess").first()
    assert err.mae < 0.01 and err.r2 > 0.99
    both = spark.createDataFrame([(list(map(float, a)), list(map(float, b)), int(a[0] * b[0] > 0)) for a, b in zip(rng.standard_normal((300, 3)), rng.standard_normal((300, 3)))], "a array<double>, b array<double>, y int")
    assert models.compatibility(both, both, "a", "b", "y").where("(chance > 0.5) = (y = 1)").count() > 270


def test_losses(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [0, 2], [0.5, -0.5], [0.1, -0.2], [7, 8])], "l array<double>, t array<int>, m array<double>, v array<double>, ids array<int>")
    got = row.select(models.cross_entropy(F.col("l"), F.col("t")).alias("ce"), models.normal_divergence(F.col("m"), F.col("v")).alias("kl"), models.padded(F.col("ids"), 4).alias("p")).first()
    z = math.log(sum(map(math.exp, (1, 2, 3))))
    assert got.ce == pytest.approx(z - 2) and got.kl == pytest.approx(-0.5 * sum(1 + v - m * m - math.exp(v) for m, v in ((0.5, 0.1), (-0.5, -0.2))))
    assert got.p["values"] == [7, 8, 0, 0] and got.p["mask"] == [True, True, False, False]


def test_sets_and_vectors(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "item string, vector array<double>")
    got = models.scores_of_sets(spark.createDataFrame([(1, "a")], "query int, item string"), items, 2).orderBy("rank").collect()
    assert [r.item for r in got] == ["b", "c"]
    rnd = random.Random(1)
    ctx = spark.createDataFrame([(i, rnd.choice("abcdef" if i % 2 else "uvwxyz")) for i in range(200) for _ in range(4)], "ctx int, item string").distinct()
    assert models.skip_gram(ctx, 8).count() == 12


def test_records(spark):
    old = [
        {"deck_id": "7", "source": "Site", "url": "https://www.site.org/7", "name": "one", "format": "EDH", "date": "2024-01-02", "mainboard": [{"n": "Bolt", "q": 2}, {"n": "bolt ", "q": 1}, {"n": "", "q": 3}], "commanders": [{"n": "Boss", "q": 1}]},
        {"deck_url": "u", "date": "05/06/24", "main": [{"name": "Bolt", "qty": 4}], "cmds": []},
    ]
    raw = spark.createDataFrame([(json.dumps(r),) for r in old], "t string")
    a, b = sorted(records.normalized(raw, "t").collect(), key=lambda r: r.source)
    assert a.source == "mtgtop8" and a.source_id is None and a.deck_id.startswith("mtgtop8:content-") and a.date == "2024-06-05" and a.mainboard[0].quantity == 4 and a.format == "commander"
    assert b.deck_id == "site:7" and [(e.name, e.quantity) for e in b.mainboard] == [("Bolt", 3)] and b.commanders[0].name == "Boss"
    flat = records.flattened(records.normalized(raw, "t"), "deck_id")
    assert {(r.zone, r.name, r.quantity) for r in flat.collect()} == {("mainboard", "Bolt", 3), ("commanders", "Boss", 1), ("mainboard", "Bolt", 4)}
    sets = spark.createDataFrame([(["B", "a ", "b"],), (["x", " "],), (None,)], "c array<string>")
    assert [r[0] for r in sets.select(records.sane_context(F.col("c"))).collect()] == [["a", "b"], None, None]
    edges = records.hyperedges(spark.createDataFrame([("e1", ["A", "b"]), ("e2", ["a", "zz"]), ("e3", ["a"])], "id string, members array<string>"), spark.createDataFrame([("a",), ("b",)], "key string"))
    assert {r.id: (r.eligible, r.reasons) for r in edges.collect()} == {"e1": (True, []), "e2": (False, ["unknown_member", "too_small"]), "e3": (False, ["too_small"])}
    sig = spark.createDataFrame([(["R", "B"], "Legendary Creature — Elf Druid", 3.0), ([], "Land", 30.0)], "c array<string>, t string, n double").select(records.structural_signature(F.col("c"), F.col("t"), F.col("n")).alias("s")).collect()
    assert sig[0].s.colors == ["B", "R"] and sig[0].s.types == ["creature"] and sig[1].s is None


def test_stages(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "s")
    stages.stage(df, path, {"seed": 1})
    assert stages.validated(spark, path).count() == 5
    with pytest.raises(Exception, match="exist"):
        stages.stage(df, path, {"seed": 1})
    with pytest.raises(ValueError):
        stages.disjoint(f"{path}/in", [path])


def test_summaries(spark):
    rows = [("m", s, v, float(s + (3 if v == "b" else 0))) for s in range(4) for v in "ab"]
    df = spark.createDataFrame(rows, "metric string, seed int, variant string, value double")
    got = rank.paired_difference(df, ["metric"], "seed", "variant", "value", "a", "b").first()
    assert got.n == 4 and got.difference == 3 and got.low == 3
    assert rank.seed_summary(df.where("variant = 'a'"), ["metric"], "value").first().shown == "1.5000 ± 1.2910"
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "y", 9)], "q string, i string, rank int")
    goal, freq = ranked.select("q", "i"), spark.createDataFrame([("x", 0), ("y", 2)], "i string, freq int")
    assert rank.rarity_recall(ranked, goal, freq, "q", "i", 5).first().recall == pytest.approx(1 / (1 + 0.5))
