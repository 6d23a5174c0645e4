"""Operators without SQL, against plain Python, and their edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import dedup, graph, lookup, neardup, rank, rules, split, vectors
from sparkloom.sources import files
from sparkloom.streaming import ingest


def test_two_key_first_wins(spark):
    rnd = random.Random(1)
    rows = [(i, f"a{rnd.randint(0, 30)}", f"b{rnd.randint(0, 30)}") for i in range(200)]
    seen, want = set(), {}
    for i, a, b in rows:
        want[i] = a not in seen and b not in seen
        if want[i]:
            seen |= {a, b}
    df = spark.createDataFrame(rows, "pos int, a string, b string")
    got = {r.pos: r.kept for r in dedup.two_key_first_wins(df, "a", "b", "pos").collect()}
    assert got == want
    assert dedup.two_key_first_wins(df.limit(0), "a", "b", "pos").count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


WORDS = [f"v{i}" for i in range(3000)]


def test_similar_pairs(spark):
    rnd = random.Random(4)
    base = [[f"w{rnd.randint(0, 60)}" for _ in range(20)] for _ in range(12)]
    rows = []
    for i in range(80):
        words = list(base[i % 12])
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(20)] = f"x{rnd.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    sets = {i: set(t.split()) for i, t in rows}
    lead = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    want = {(a, b) for a in sets for b in sets if a < b and lead[a] == a and lead[b] in (a, b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    df = neardup.token_sets(spark.createDataFrame(rows + [(99, ""), (98, None)], "doc_id long, text string"), "doc_id", "text")
    assert {(r.a, r.b) for r in neardup.similar_pairs(df, 0.8).collect()} == want
    found = {(r.a, r.b): r.jaccard for r in neardup.verified(neardup.candidates(df), df, 0.8).collect()}
    assert all(j == pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for (a, b), j in found.items())
    # every set that has a near one is met
    assert len({x for p in want for x in p} - {x for p in found for x in p}) <= 2


def test_similar_pairs_ship_no_whole_sets_but_those_of_near_ones(spark):
    """Long texts without near ones: only their prefixes are dealt out, so what is shuffled stays far under the size of the texts."""
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.sample(WORDS, 600))) for i in range(60)]
    rows += [(100, rows[0][1] + " more"), (101, rows[0][1]), (102, " ".join(rows[1][1].split()[:580]))]
    df = neardup.token_sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    kept, shared = [], neardup.shared_table
    try:
        neardup.shared_table = lambda d, name: (kept.append((name, shared(d, name))), kept[-1][1])[1]
        got = {(r.a, r.b): r.jaccard for r in neardup.similar_pairs(df, 0.9).collect()}
    finally:
        neardup.shared_table = shared
    assert got == {(0, 100): pytest.approx(600 / 601), (0, 101): 1.0, (1, 102): pytest.approx(580 / 600)}
    tables = [(n, d) for n, d in kept]
    assert dict(tables)["token-pairs"].count() == 2 and tables[-1][0] == "token-words" and tables[-1][1].count() == 4
    assert dict(tables)["token-heads"].agg({"n": "max"}).first()[0] == 601 and max(len(r.t) for r in dict(tables)["token-heads"].collect()) <= 62


def test_all_similar_pairs(spark, monkeypatch):
    """Pairs of copies, and of copies of one set with copies of another, in parts of a few: each once."""
    monkeypatch.setattr(neardup, "COPIES", 3)
    rnd = random.Random(6)
    base = rnd.sample(WORDS, 20)
    texts = [base] * 14 + [base[::-1] * 2] * 3 + [base + ["other"]] * 9 + [base[:19]] + [base[1:]] * 2 + [base[:18]] + [rnd.sample(WORDS, 20) for _ in range(5)] + [[]] * 2
    rnd.shuffle(texts)
    rows = [(7 * i % 101, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: set(t.split()) for i, t in rows if t}
    want = sorted((a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]))
    df = neardup.token_sets(spark.createDataFrame(rows + [(200, None)], "doc_id long, text string"), "doc_id", "text")
    assert sorted((r.a, r.b, round(r.jaccard, 9)) for r in neardup.all_similar_pairs(df, 0.9).collect()) == want


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", i, r) for r, i in enumerate("abcdef", 1)], "q string, i string, rank int")
    got = rank.metrics(ranked, spark.createDataFrame([("q", "b"), ("q", "d"), ("z", "a")], "q string, i string"), "q", "i", 3).collect()
    by = {r.q: r for r in got}
    assert by["q"].recall == 0.5 and by["q"].mrr == 0.5 and by["q"].ap == pytest.approx(0.25) and by["z"].hits == 0 and by["z"].ndcg == 0


def test_names_dates_lines(spark):
    names = ["Ætherling É", "a-Fire // Ice", "  Two   Words ", "ﬁre", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(tx.name_key(F.col("n"))).collect()] == ["ætherling e", "fire", "two words", "fire", None]
    written = [("  Fire/Ice ", "fire // ice"), ("Fire // Ice", "fire // ice"), ("It’s…", "it's..."), ("______ Goblin", "_____ goblin"), ("With Great Power . . .", "with great power..."), ("With Great Power...", "with great power..."), ("“É” – ß", "“e” - ss")]
    for key in (tx.lookup_key, tx.native_lookup_key):
        assert [r[0] for r in spark.createDataFrame(written, "n string, w string").select(key(F.col("n"))).collect()] == [w for _, w in written]
    latin = [(chr(c) + "x",) for c in range(0xC0, 0x250)]
    assert all(r.a == r.b for r in spark.createDataFrame(latin, "n string").select(tx.name_key(F.col("n")).alias("a"), tx.native_key(F.col("n")).alias("b")).collect() if len(r.a) == 2)
    days = ["2024-01-02T03:04", "03/04/99", "03/04/2024", "12/31/2024", "2024/05/06", "January 5, 2024", "soon", "", None, "2024-01-02 x", "2024-01-02x", "2024-1-5", "5-Mar-2024", "05-MAR-2024 23:59", "05-Mar-2024 24:00", "31/02/2024", "01/02/68", "01/02/69"]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in days], "d string").select(tx.normal_date(F.col("d"))).collect()]
    assert got == ["2024-01-02", "1999-04-03", "2024-04-03", "2024-12-31", "2024/05/06", "January 5, 2024", "soon", None, None, "2024-01-02", "2024-01-02x", "2024-01-05", "2024-03-05", "2024-03-05", "05-Mar-2024 24:00", "31/02/2024", "2068-02-01", "1969-02-01"]
    lines = [("4Name", 4, "Name"), ("4x Name", 4, "Name"), ("4X  Name ", 4, "Name"), ("0 Name", 1, "Name"), ("Name", 1, "Name"), ("sb: 2 Name", 2, "Name"), ("12", 1, "2")]
    assert [(r.e.quantity, r.e.name) for r in spark.createDataFrame([(x,) for x, _, _ in lines], "l string").select(tx.parsed_line(F.col("l")).alias("e")).collect()] == [(q, n) for _, q, n in lines]
    suffixed = [("Bolt (ABC) 123", "Bolt"), ("Bolt (ABCDEFGH) 12a-b ", "Bolt"), ("Bolt (ABC)", "Bolt (ABC)"), ("Bolt (A) 1", "Bolt (A) 1"), ("Bolt(ABC) 1", "Bolt(ABC) 1")]
    assert [r[0] for r in spark.createDataFrame(suffixed, "n string, w string").select(tx.without_set_suffix(F.col("n"))).collect()] == [w for _, w in suffixed]
    text = "# note\n2x Bolt\nSB: 1 Shock\nSideboard\n3 Bolt\nMaybeboard\n1 No\nDeck:\nBolt\n"
    zones = {(r.zone, r.name): r.quantity for r in tx.zones(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()}
    assert zones == {("mainboard", "Bolt"): 3, ("sideboard", "Shock"): 1, ("sideboard", "Bolt"): 3}
    self_named = spark.createDataFrame([("Bob hits bobby and BOB", ["Bob"])], "t string, n array<string>").select(tx.without_names(F.col("t"), F.col("n"))).first()[0]
    assert self_named == "[SELF] hits bobby and [SELF]"


def test_rules(spark):
    texts = [("A deck can have up to seven cards named Dwarves.", False, 7), ("A deck can have any number of cards named Rats.", False, None), ("up to seven", False, 4), ("any number", False, 4), ("plain", True, None), ("A deck can have up to one card named X.", False, 1), ("A deck can have up to 9 cards named Y.", False, 9), ("A deck can have up to many cards named Z.", False, 4), (None, None, 4)]
    df = spark.createDataFrame(texts, "t string, b boolean, w int")
    assert [r[0] for r in df.select(rules.copy_limit(F.col("t"), F.col("b"), 4)).collect()] == [w for _, _, w in texts]
    titles = [("Pauper Cube Archetypes", 209, "explicit_cube"), ("My collection", 150, "collection_or_pool"), ("Merged lists", 160, "aggregate_or_reference"), ("Cube-loving commander", 100, None), (None, 200, None), ("Normal Commander", 200, None), ("Pool of every list", 500, None), ("Card Pool", 120, "collection_or_pool")]
    assert [r[0] for r in spark.createDataFrame(titles, "t string, n int, w string").select(dedup.quality_reason(F.col("t"), F.col("n"))).collect()] == [w for _, _, w in titles]
    tries = [(1, 0, False, 60), (1, 1, False, 300), (1, 2, False, 900), (1, 3, False, None), (0, 0, False, None), (2, 0, False, None), (130, 0, False, None), (1, 0, True, None)]
    assert [r[0] for r in spark.createDataFrame(tries, "c int, a int, b boolean, w int").select(tx.retry_delay(F.col("c"), F.col("a"), F.col("b"))).collect()] == [w for *_, w in tries]


def test_sink_survives_restarts_and_replays(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, at int, v string")
    later = spark.createDataFrame([("b", 4, "w"), ("c", 5, "v")], rows.schema)
    path = str(tmp_path / "sink")
    shown = lambda sink: sorted(map(tuple, sink.read(rows.schema).collect()))
    first = ingest.Sink(spark, ["k"], "at", path)
    first.add(rows, "batch0")
    first.add(later, "batch1")
    want = [("a", 1, "x"), ("b", 2, "y"), ("c", 5, "v")]
    assert shown(first) == want
    again = ingest.Sink(spark, ["k"], "at", path)  # after a restart
    assert shown(again) == want
    again.add(rows, "batch2")
    again.add(later, "batch1")  # the same batch once more
    again.add(rows, "batch0")
    assert shown(again) == want and shown(ingest.Sink(spark, ["k"], "at", path)) == want
    (tmp_path / "sink" / "batch1" / "_SUCCESS").unlink()  # a batch that was cut short
    assert shown(again) == want[:2]
    again.add(later, "batch1")
    assert shown(again) == want


def test_numbers_by_range(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(97)))
    got = split.prefix_sums(df, ["v", "id"], F.col("v"), "s").orderBy("v", "id").collect()
    total = 0
    for r in got:
        assert r.s == total
        total += r.v
    assert [r.n for r in split.numbered(df, ["v", "id"], "n").orderBy("v", "id").collect()] == list(range(1, 1001))


def test_untested_before(spark):
    votes = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "a"), ("y", "a"), ("y", "a"), ("y", "a")], "i string, s string")
    assert [tuple(r) for r in ingest.discovered(votes, "i", "s", 3, 2).collect()] == [("x", 3, 2)]
    shared = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q"), (3, "r"), (4, "s"), (4, "r")], "g int, m string")
    kept = {r.g: (r.root, r.reserved) for r in dedup.reserved_families(shared, "g", "m", spark.createDataFrame([("p",)], "m string")).collect()}
    assert kept == {1: (1, True), 2: (1, True), 3: (3, False), 4: (3, False)}
    firsts = dedup.first_wins(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "p int, k string"), ["k"], ["p"]).orderBy("p").collect()
    assert [(r.kept, r.group_size) for r in firsts] == [(True, 2), (False, 2), (True, 1)]
    out = lookup.aligned(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", [1.0, 2.0])], "k string, v array<double>"), "k", "v", 2).orderBy("k").collect()
    assert [(r.v, r.present) for r in out] == [([1.0, 2.0], True), ([0.0, 0.0], False)]
    marks = spark.createDataFrame([(0.2, 0.4), (-0.4, -0.2), (-0.05, 0.05), (-0.2, 0.3)], "l double, h double")
    assert [r[0] for r in marks.select(rank.assessment(F.col("l"), F.col("h"), 0.1)).collect()] == ["better", "worse", "equivalent", "unclear"]
    bands = spark.createDataFrame([(1, 0.1), (2, 0.6), (3, 0.5), (4, 0.9)], "b int, v double")
    assert rank.reliable_from(bands, "b", "v", 0.5).first().b == 2
    near = vectors.near_pairs(spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [2.0, 1e-9, -1e-9]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 3.0, 0.0]), (5, [0.0, 0.0, 0.0]), (6, [0.0, 1.0, 0.02])], "i int, v array<double>"), "i", "v", 0.9998)
    assert {(r.a, r.b) for r in near.collect()} == {(1, 2), (3, 4)} | {(3, 6)}


def test_splits(spark):
    groups = spark.createDataFrame([(i, 1 + i % 7) for i in range(300)], "k int, n int")
    out = split.balanced_groups(groups, "k", "n", {"train": 0.8, "test": 0.2}).groupBy("split").agg(F.sum("n").alias("s")).collect()
    sizes = {r["split"]: r.s for r in out}
    assert abs(sizes["train"] / sum(sizes.values()) - 0.8) < 0.02
    masked = split.mask(spark.createDataFrame([(1, i) for i in range(10)], "g int, m int"), "g", "m", 0.25, 1)
    assert masked.where("hidden").count() == 2  # 2.5 rounds to even


def test_svd_keeps_rows_and_columns_off_the_driver(spark, monkeypatch):
    """What comes to the driver or goes from it is bounded by the rank, whatever the rows and columns."""
    most = []
    frame, session = type(spark.range(0)), type(spark)
    collect, create = frame.collect, session.createDataFrame
    cells = spark.range(900).selectExpr("concat('r', id % 450) AS i", "concat('c', id % 400) AS j", "1.0D + id % 7 AS v")
    monkeypatch.setattr(frame, "collect", lambda self: (rows := collect(self), most.append(len(rows)))[0])
    monkeypatch.setattr(session, "createDataFrame", lambda self, data, *a, **b: (most.append(len(data)), create(self, data, *a, **b))[1])
    u, s = vectors.randomized_svd(cells, "i", "j", "v", 4, rounds=1)
    assert max(most, default=0) <= 24 and len(s) == 4
    monkeypatch.undo()
    assert u.count() == 450


@pytest.mark.parametrize("mirrored", [False, True])
def test_svd_by_blocks(spark, mirrored):
    """Blocks of seven places, against the plain decomposition."""
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.standard_normal((31, 5)) @ rng.standard_normal((5, 18))
    if mirrored:
        x = rng.standard_normal((24, 3))
        a = x @ x.T
        np.fill_diagonal(a, 0)  # of full rank, so all columns are asked for
    cells = [(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if not mirrored or i < j]
    u, s = vectors.placed_svd(spark.createDataFrame(cells, "i int, j int, v double"), a.shape, 4, rounds=2, over=20, mirrored=mirrored, block=7)
    left, want, _ = np.linalg.svd(a)
    rows = sorted(u.collect())
    got = np.array([r.u for r in rows])
    assert np.allclose(s, want[:4], rtol=1e-6) and [r["at"] for r in rows] == list(range(a.shape[0]))
    assert np.allclose(got @ got.T, left[:, :4] * want[:4] @ left[:, :4].T, atol=1e-5)


def test_svd_and_procrustes(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 4)) @ rng.standard_normal((4, 12))
    cells = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(12)], "i int, j int, v double")
    u, s = vectors.randomized_svd(cells, "i", "j", "v", 4)
    assert np.allclose(s, np.linalg.svd(a)[1][:4], rtol=1e-6) and u.count() == 30
    q = np.linalg.qr(rng.standard_normal((3, 3)))[0]
    x = rng.standard_normal((20, 3))
    rows = spark.createDataFrame([(list(map(float, r)), list(map(float, r @ q))) for r in x], "a array<double>, b array<double>")
    assert np.allclose(vectors.procrustes(rows, "a", "b"), q, atol=1e-6)


def test_work_queue(spark):
    log = [("b", "x", "add", 1), ("b", "y", "add", 2), ("b", "z", "add", 3), ("b", "x", "finish", 4), ("b", "y", "complete", 5), ("b", "z", "remove", 6)]
    df = spark.createDataFrame(log, "bucket string, job string, action string, at int")
    state = {r.job: (r.state, r.place) for r in ingest.work_queue(df, "bucket", "job", "action", "at").collect()}
    assert state == {"x": ("queued", 1), "y": ("complete", None), "z": ("removed", None)}
    more = df.unionByName(spark.createDataFrame([("b", None, "refresh", 7)], df.schema))
    assert {r.job: r.state for r in ingest.work_queue(more, "bucket", "job", "action", "at").collect()}["y"] == "queued"


def test_files(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1, "b": "é"}\n\n{"a": 2}\n')
    df = files.read_jsonl(spark, str(path), "a int, b string")
    assert df.count() == 2
    assert files.write_jsonl(df, str(tmp_path / "out")) == 2
    path.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(ValueError, match="rows.jsonl"):
        files.read_jsonl(spark, str(path), "a int, b string")
    (tmp_path / "all.json").write_text(json.dumps({"data": [{"a": 1}, {"a": 2}]}))
    assert files.read_catalog(spark, str(tmp_path / "all.json"), "a int").count() == 2
    shown = files.manifest(spark, str(tmp_path / "out"))
    assert shown.count() >= 1 and set(shown.columns) == {"path", "size", "sha256"}
