"""Every query with SQL gives the same rows as DuckDB; the plans have the shape that scales."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest

from sparkloom.plans import catalog
from tests.oracle import difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, SMALL), catalog.SQL[name], SMALL) is None


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"two_key_dedup", "balanced_groups", "probe_logistic", "ppmi_space", "minhash_candidates"}


def test_two_key_dedup(spark):
    events = pd.read_parquet(f"{SMALL}/events.parquet")
    seen, want = set(), {}
    for pos, ts, user, kind in sorted(zip(events.event_id, events.ts, events.user_id, events.event_type)):
        keys = (1, user, ts.date()), (2, kind, ts.day, ts.hour)
        want[pos] = int(not seen & set(keys))
        if want[pos]:
            seen |= set(keys)
    assert {r.pos: r.kept for r in catalog.QUERIES["two_key_dedup"](spark, SMALL).collect()} == want


def test_balanced_groups(spark):
    orders = pd.read_parquet(f"{SMALL}/orders.parquet")
    sizes = orders.groupby("o_custkey").size()
    rows = catalog.QUERIES["balanced_groups"](spark, SMALL).collect()
    assert {r.o_custkey: r.n for r in rows} == sizes.to_dict() and len(rows) == len(sizes)
    share = {s: sum(r.n for r in rows if r.split == s) / sizes.sum() for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["validation"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02


def test_probe_logistic(spark):
    """Against a plain fit of the same loss by gradient steps."""
    rows = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    part = np.array([int(hashlib.sha256(str(i).encode()).hexdigest()[:12], 16) / 16**12 for i in rows.vec_id])
    x, y = np.array(rows.embedding.tolist(), float), (rows.label == 0).to_numpy().astype(float)
    own = part < 0.8
    x = (x - x[own].mean(0)) / x[own].std(0, ddof=1)
    a, b = x[own], y[own]
    weight = np.where(b == 1, len(b) / (2 * b.sum()), len(b) / (2 * (len(b) - b.sum())))
    w, c = np.zeros(x.shape[1]), 0.0
    for _ in range(20_000):
        e = weight * (1 / (1 + np.exp(-(a @ w + c))) - b) / weight.sum()
        w -= 0.2 * (a.T @ e + w / (0.1 * len(b)))
        c -= 0.2 * e.sum()
    guess = (x[~own] @ w + c > 0).astype(float)
    f1 = {k: 2 * ((guess == k) & (y[~own] == k)).sum() / max(1, (guess == k).sum() + (y[~own] == k).sum()) for k in (0, 1)}
    got = {r.label: r.f1 for r in catalog.QUERIES["probe_logistic"](spark, SMALL).collect()}
    assert all(abs(got.get(k, 0) - f1[k]) < 0.03 for k in f1)


def test_ppmi_space(spark):
    lines = pd.read_parquet(f"{SMALL}/lineitem.parquet")[["l_orderkey", "l_partkey"]].drop_duplicates()
    items = {p: i for i, p in enumerate(sorted(set(lines.l_partkey)))}
    inc = np.zeros((lines.l_orderkey.nunique(), len(items)))
    for o, p in zip(lines.l_orderkey.rank(method="dense").astype(int) - 1, lines.l_partkey):
        inc[o, items[p]] = 1
    joint, n = inc.T @ inc, len(inc)
    np.fill_diagonal(joint, 0)
    with np.errstate(divide="ignore"):
        ppmi = np.maximum(np.log2(joint * n / np.outer(inc.sum(0), inc.sum(0))), 0)
    best = np.linalg.svd(ppmi, compute_uv=False)[:8]
    rows = catalog.QUERIES["ppmi_space"](spark, SMALL).collect()
    # rows are scaled by the root of the singular values, so their squared lengths sum to these
    total = sum(r.norm_r**2 for r in rows)
    assert {r.item for r in rows} <= set(items) and {r.dims for r in rows} == {8} and 0.9 * best.sum() < total <= best.sum() * 1.001


def test_minhash_candidates(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    sets = {i: w for i, t in zip(docs.doc_id, docs.text) if (w := set(re.findall("[a-z0-9À-ɏ]+", t.lower())))}
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])}
    got = {(r.a, r.b): r.jaccard_r for r in catalog.QUERIES["minhash_candidates"](spark, SMALL).collect()}
    assert set(got) <= set(near) and all(abs(near[k] - v) < 1e-6 for k, v in got.items()) and {x for p in near for x in p} == {x for p in got for x in p}


def test_near_duplicate_pairs_are_all(spark):
    """Every pair that meets the bound, copies among themselves too, against brute force."""
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    sets = {i: w for i, t in zip(docs.doc_id, docs.text) if (w := set(re.findall("[a-z0-9À-ɏ]+", t.lower())))}
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])}
    rows = catalog.QUERIES["near_duplicate_pairs"](spark, SMALL).collect()
    assert len(rows) == len(near) and {(r.a, r.b): r.jaccard_r for r in rows} == pytest.approx(near, abs=1e-6)


def test_candidate_counts_of_every_order(spark):
    """Orders with one commander against a plain count; no order is passed over for its key."""
    lines, part = pd.read_parquet(f"{SMALL}/lineitem.parquet"), pd.read_parquet(f"{SMALL}/part.parquet")
    bits = dict(zip(part.p_partkey, part.p_size % 32))
    legal = {k for k, t in zip(part.p_partkey, part.p_type) if t not in ("PROMO", "LARGE", "MEDIUM")}
    heads = lines[(lines.l_linenumber == 1) | ((lines.l_linenumber == 2) & (lines.l_orderkey % 3 == 0))]
    single = heads[~heads.l_orderkey.duplicated(keep=False) & (heads.l_linenumber == 1)]
    want = {}
    for order, k in zip(single.l_orderkey, single.l_partkey):
        card = 1 if k % 103 == 0 else k
        if k % 101 and order % 17 and (card % 6 < 2 or card % 7 == 6):
            want[order] = sum(bits[c] & ~bits[card] == 0 for c in legal - {card})
    want = {o: n for o, n in want.items() if n}
    got = {r.record: r.cards for r in catalog.QUERIES["candidate_counts"](spark, SMALL).collect()}
    assert {o: n for o, n in got.items() if o in set(single.l_orderkey)} == want
    assert len({o % 20 for o in want}) == 20


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned(spark):
    shown = plan(catalog.QUERIES["ppmi_top_partners"](spark, SMALL))
    assert "l_extendedprice" not in shown and "CartesianProduct" not in shown


def test_top_k_is_limited_before_the_exchange(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["popularity_by_key"](spark, SMALL))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.SQL) <= set(__spark_entry__.oracle_sql())
