"""Queries on contexts: an order is a context, its parts are the items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import cooc, rank, split
from sparkloom.sources.tables import read

CTX = """ctx AS (SELECT DISTINCT l_orderkey AS ctx, l_partkey AS item FROM lineitem),
f AS (SELECT item, count(*) AS freq FROM ctx GROUP BY item), n AS (SELECT count(DISTINCT ctx) AS n FROM ctx),
p AS (SELECT a.item AS a, b.item AS b, count(*) AS joint FROM ctx a JOIN ctx b ON a.ctx = b.ctx AND a.item <> b.item GROUP BY a.item, b.item)"""
FRACTION = "(('0x' || substr(sha256(CAST(ctx AS VARCHAR)), 1, 12))::UBIGINT / 281474976710656.0)"
SPLIT = f"""ctx AS (SELECT DISTINCT l_orderkey AS ctx, l_partkey AS item FROM lineitem),
train AS (SELECT * FROM ctx WHERE {FRACTION} < 0.9), test AS (SELECT * FROM ctx WHERE {FRACTION} >= 0.9),
m AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY sha256('42:' || ctx || ':' || item), item) <= greatest(1, round_even(count(*) OVER (PARTITION BY ctx) * 0.5, 0)) AS hidden FROM test),
visible AS (SELECT ctx, item FROM m WHERE NOT hidden), target AS (SELECT ctx, item FROM m WHERE hidden),
p AS (SELECT a.item AS a, b.item AS b, count(*) AS joint FROM train a JOIN train b ON a.ctx = b.ctx AND a.item <> b.item GROUP BY a.item, b.item)"""
SCORED = """s AS (SELECT v.ctx, p.b AS item, CAST(sum(p.joint) AS BIGINT) AS score FROM visible v JOIN p ON p.a = v.item GROUP BY v.ctx, p.b),
r AS (SELECT s.ctx, s.item, s.score, row_number() OVER (PARTITION BY s.ctx ORDER BY s.score DESC, s.item) AS rank FROM s ANTI JOIN visible v ON v.ctx = s.ctx AND v.item = s.item)"""


def _ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooc.contexts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def _heldout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training contexts; of the others, what is visible and what is hidden."""
    ctx, f = _ctx(spark, sf_dir), split.fraction(F.col("ctx"))
    masked = split.mask(ctx.where(f >= 0.9), "ctx", "item", 0.5, 42)
    return ctx.where(f < 0.9), masked.where("not hidden").drop("hidden"), masked.where("hidden").drop("hidden")


def ppmi_top_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooc.top_partners(_ctx(spark, sf_dir), cooc.ppmi(), "ppmi_r", 10)


def incidence_cosine_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooc.top_partners(_ctx(spark, sf_dir), cooc.incidence_cosine(), "cosine_r", 10)


def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooc.associations(_ctx(spark, sf_dir)).where("joint >= 2")
    return pairs.select("a", "b", "joint", F.round(cooc.smoothed_pmi(), 9).alias("pmi_r"), F.round(F.col("joint") / F.col("fa"), 9).alias("b_given_a"), F.round(F.col("joint") / F.col("fb"), 9).alias("a_given_b"))


def doc_frequency_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooc.vocabulary(_ctx(spark, sf_dir), 5)


def global_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooc.popularity(_ctx(spark, sf_dir), k=50)


def popularity_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ctx"), F.col("c_mktsegment").alias("key"))
    return cooc.popularity(_ctx(spark, sf_dir), keys, 20).select("key", "item", "cnt", "rank")


def cooccurrence_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, visible, _ = _heldout(spark, sf_dir)
    return cooc.recommend(train, visible, 10)


def holdout_recall_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, visible, target = _heldout(spark, sf_dir)
    measured = rank.metrics(cooc.recommend(train, visible, 20), target, "ctx", "item", 20)
    return measured.agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(f"{c}20_r") for c in ("recall", "ndcg", "ap", "mrr")))


def popularity_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The popularity baseline: the most frequent items that a context doesn't show."""
    train, visible, target = _heldout(spark, sf_dir)
    measured = rank.metrics(cooc.popular_unseen(train, visible, target.select("ctx").distinct(), 20), target, "ctx", "item", 20)
    return measured.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall20_r"), F.round(F.avg("ndcg"), 6).alias("ndcg20_r"))


def usage_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ctx"), F.col("o_orderpriority").alias("label"))
    return cooc.usage_lift(_ctx(spark, sf_dir), labels)


def source_neighbour_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ctx"), F.col("o_orderstatus").alias("source"))
    near = cooc.source_neighbours(_ctx(spark, sf_dir), sources, 10, 20)
    a, b = near.select(F.col("source").alias("src_a"), "anchor", F.col("partners").alias("pa")), near.select(F.col("source").alias("src_b"), "anchor", F.col("partners").alias("pb"))
    return a.join(b, "anchor").where("src_a < src_b").select("anchor", "src_a", "src_b", F.round(cooc.jaccard(F.col("pa"), F.col("pb")), 9).alias("jaccard_r"))


def incidence_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, visible, _ = _heldout(spark, sf_dir)
    scored = cooc.incidence_baselines(train, visible.withColumnRenamed("ctx", "query"))
    return rank.top_k(scored, ["query"], [F.desc("cosine"), "item"], 10)


def pessimistic_vs_name_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooc.mirrored(cooc.cooccurrence(_ctx(spark, sf_dir)))
    both = rank.pessimistic(rank.by_name(pairs, ["a"], "joint", "b", "rank_det"), ["a"], "joint", "rank_pess")
    n = F.count("*")
    return both.groupBy("a").agg(n.alias("n"), F.max("joint").alias("best"), F.sum("rank_det").alias("sum_det"), F.sum("rank_pess").alias("sum_pess"), F.min("rank_pess").alias("first_pess"))


def metric_ap_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well joint counts rank the partners of a part's own brand."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    pairs = cooc.mirrored(cooc.cooccurrence(_ctx(spark, sf_dir)))
    ranked = rank.by_name(pairs, ["a"], "joint", "b")
    same = pairs.join(part.select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("x")), "a").join(part.select(F.col("p_partkey").alias("b"), F.col("p_brand").alias("y")), "b").where("x = y").select("a", "b")
    out = rank.metrics(ranked, same, "a", "b", 10)
    return out.select(F.col("a").alias("query"), "hits", *(F.round(c, 9).alias(f"{c}_r") for c in ("prec", "ap", "mrr", "ndcg")))


def boundary_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.boundary_ties(cooc.mirrored(cooc.cooccurrence(_ctx(spark, sf_dir))), ["a"], "joint", "b", 10)


def seed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean agreement of top partners between three thirds of the contexts, by frequency bucket."""
    from sparkloom.functions.text import frequency_bucket

    ctx = _ctx(spark, sf_dir)
    near = cooc.source_neighbours(ctx, ctx.select("ctx").distinct().withColumn("source", F.col("ctx") % 3), 1, 20)
    a, b = near.select(F.col("source").alias("s"), "anchor", F.col("partners").alias("pa")), near.select(F.col("source").alias("t"), "anchor", F.col("partners").alias("pb"))
    both = a.join(b, "anchor").where("s < t").join(cooc.frequencies(ctx).withColumnRenamed("item", "anchor"), "anchor")
    return both.groupBy(frequency_bucket(F.col("freq")).alias("bucket")).agg(F.count("*").alias("pairs"), F.round(F.avg(cooc.jaccard(F.col("pa"), F.col("pb"))), 6).alias("jaccard_r"))


def split_overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of different splits that share items: equal, within one another, or similar."""
    ctx = _ctx(spark, sf_dir)
    side = ctx.withColumn("split", split.partition(F.col("ctx")))
    n = ctx.groupBy("ctx").agg(F.count("*").alias("n"))
    a, b = side.select("item", F.col("ctx").alias("a"), F.col("split").alias("sa")), side.select("item", F.col("ctx").alias("b"), F.col("split").alias("sb"))
    shared = a.join(b, "item").where("a < b and sa <> sb").groupBy("a", "b").agg(F.count("*").alias("both"))
    sized = shared.join(n.select(F.col("ctx").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("ctx").alias("b"), F.col("n").alias("nb")), "b")
    kind = F.when((F.col("both") == F.col("na")) & (F.col("na") == F.col("nb")), "equal").when(F.col("both") == F.least("na", "nb"), "contained").when(F.col("both") >= 0.5 * (F.col("na") + F.col("nb") - F.col("both")), "similar").otherwise("touching")
    return sized.groupBy(kind.alias("category")).agg(F.count("*").alias("cnt"))


def _top(score: str, name: str) -> str:
    return f"""WITH {CTX}, s AS (SELECT p.a AS item, p.b AS partner, p.joint, round({score}, 9) AS {name} FROM p JOIN f fa ON fa.item = p.a JOIN f fb ON fb.item = p.b CROSS JOIN n),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY {name} DESC, partner) AS rank FROM s) SELECT item, partner, joint, {name}, rank FROM r WHERE rank <= 10"""


NEAR = """rows AS (SELECT c.ctx, c.item, {source} AS source FROM ctx c{join}),
anchors AS (SELECT source, item FROM rows GROUP BY source, item HAVING count(*) >= {least}),
c AS (SELECT a.source, a.item AS anchor, b.item AS partner, count(*) AS c FROM rows a JOIN anchors x ON x.source = a.source AND x.item = a.item JOIN rows b ON a.source = b.source AND a.ctx = b.ctx AND a.item <> b.item GROUP BY 1, 2, 3),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, anchor ORDER BY c DESC, partner) AS r FROM c) WHERE r <= 20),
size AS (SELECT source, anchor, count(*) AS n FROM near GROUP BY source, anchor),
common AS (SELECT a.source AS sa, b.source AS sb, a.anchor, count(*) AS c FROM near a JOIN near b ON a.anchor = b.anchor AND a.partner = b.partner AND a.source < b.source GROUP BY 1, 2, 3),
j AS (SELECT x.anchor, x.source AS src_a, y.source AS src_b, coalesce(b.c, 0)::DOUBLE / (x.n + y.n - coalesce(b.c, 0)) AS jaccard FROM size x JOIN size y ON x.anchor = y.anchor AND x.source < y.source LEFT JOIN common b ON b.anchor = x.anchor AND b.sa = x.source AND b.sb = y.source)"""
MEASURED = """hit AS (SELECT r.ctx, r.rank, sum(1) OVER (PARTITION BY r.ctx ORDER BY r.rank) AS running FROM r JOIN target t ON t.ctx = r.ctx AND t.item = r.item WHERE r.rank <= 20),
nr AS (SELECT ctx, count(*) AS n_rel FROM target GROUP BY ctx), per AS (SELECT ctx, count(*) AS hits, sum(running / rank) AS ap, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM hit GROUP BY ctx),
q AS (SELECT nr.ctx, coalesce(hits, 0) / n_rel AS recall, coalesce(ap, 0) / least(20, n_rel) AS ap, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(20, n_rel) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, coalesce(1.0 / first, 0) AS mrr FROM nr LEFT JOIN per USING (ctx))"""

SQL = {
    "ppmi_top_partners": _top("greatest(log2(p.joint * n.n / (fa.freq * fb.freq)), 0)", "ppmi_r"),
    "incidence_cosine_top": _top("p.joint / sqrt(fa.freq * fb.freq)", "cosine_r"),
    "pair_evidence": f"WITH {CTX} SELECT p.a, p.b, joint, round(log2((joint + 0.5) * n / ((fa.freq + 0.5) * (fb.freq + 0.5))), 9) AS pmi_r, round(joint / fa.freq, 9) AS b_given_a, round(joint / fb.freq, 9) AS a_given_b FROM p JOIN f fa ON fa.item = p.a JOIN f fb ON fb.item = p.b CROSS JOIN n WHERE p.a < p.b AND joint >= 2",
    "doc_frequency_vocab": f"WITH {CTX} SELECT item, freq, row_number() OVER (ORDER BY item) + 1 AS idx FROM f WHERE freq >= 5",
    "global_popularity": f"WITH {CTX} SELECT item, freq AS cnt, row_number() OVER (ORDER BY freq DESC, item) AS rank FROM f QUALIFY rank <= 50",
    "popularity_by_key": f"WITH {CTX} SELECT c_mktsegment AS key, item, count(*) AS cnt, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, item) AS rank FROM ctx JOIN orders ON o_orderkey = ctx JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment, item QUALIFY rank <= 20",
    "cooccurrence_recommend": f"WITH {SPLIT}, {SCORED} SELECT ctx, item, score, rank FROM r WHERE rank <= 10",
    "holdout_recall_ndcg": f"WITH {SPLIT}, {SCORED}, {MEASURED} SELECT count(*) AS queries, round(avg(recall), 6) AS recall20_r, round(avg(ndcg), 6) AS ndcg20_r, round(avg(ap), 6) AS ap20_r, round(avg(mrr), 6) AS mrr20_r FROM q",
    "popularity_holdout": f"""WITH {SPLIT}, pop AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS pop FROM train GROUP BY item),
r AS (SELECT t.ctx, pop.item, row_number() OVER (PARTITION BY t.ctx ORDER BY pop) AS rank FROM (SELECT DISTINCT ctx FROM target) t CROSS JOIN pop ANTI JOIN visible v ON v.ctx = t.ctx AND v.item = pop.item), {MEASURED}
SELECT count(*) AS queries, round(avg(recall), 6) AS recall20_r, round(avg(ndcg), 6) AS ndcg20_r FROM q""",
    "usage_lift": f"""WITH {CTX}, l AS (SELECT o_orderkey AS ctx, o_orderpriority AS label FROM orders), nl AS (SELECT label, count(*) AS n_label FROM l WHERE ctx IN (SELECT ctx FROM ctx) GROUP BY label HAVING count(*) >= 100),
b AS (SELECT item, label, count(*) AS n_both FROM ctx JOIN l USING (ctx) GROUP BY item, label)
SELECT b.item, b.label, n_both, round((n_both / n_label) / (freq / n), 9) AS lift, CAST(round((n_both / n_label) / (freq / n), 9) >= 2 AND n_both >= 5 AND freq >= 20 AS INTEGER) AS positive FROM b JOIN nl USING (label) JOIN f USING (item) CROSS JOIN n""",
    "source_neighbour_jaccard": f"WITH ctx AS (SELECT DISTINCT l_orderkey AS ctx, l_partkey AS item FROM lineitem), {NEAR.format(source='o_orderstatus', join=' JOIN orders ON o_orderkey = c.ctx', least=10)} SELECT anchor, src_a, src_b, round(jaccard, 9) AS jaccard_r FROM j",
    "incidence_baselines": f"""WITH {SPLIT}, f AS (SELECT item, count(*) AS freq FROM train GROUP BY item), w AS (SELECT v.ctx AS query, t.ctx, count(*) AS m FROM visible v JOIN train t ON t.item = v.item GROUP BY v.ctx, t.ctx),
h AS (SELECT query, item, CAST(sum(m) AS BIGINT) AS hits FROM w JOIN train USING (ctx) GROUP BY query, item), norm AS (SELECT query, sqrt(sum(m * m)) AS norm FROM w GROUP BY query),
s AS (SELECT h.query, h.item, hits, round(hits / (sqrt(freq) * norm), 9) AS cosine FROM h JOIN norm USING (query) JOIN f USING (item) ANTI JOIN visible v ON v.ctx = h.query AND v.item = h.item)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, item) AS rank FROM s QUALIFY rank <= 10""",
    "pessimistic_vs_name_rank": f"""WITH {CTX}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY joint DESC, b) AS rank_det, count(*) OVER (PARTITION BY a ORDER BY joint DESC) AS rank_pess FROM p)
SELECT a, count(*) AS n, max(joint) AS best, CAST(sum(rank_det) AS BIGINT) AS sum_det, CAST(sum(rank_pess) AS BIGINT) AS sum_pess, min(rank_pess) AS first_pess FROM r GROUP BY a""",
    "metric_ap_mrr": f"""WITH {CTX}, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY joint DESC, b) AS rank, x.p_brand = y.p_brand AS rel FROM p JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b),
h AS (SELECT *, sum(CAST(rel AS INTEGER)) OVER (PARTITION BY a ORDER BY rank) AS running FROM r),
q AS (SELECT a, count(*) FILTER (rel) AS n_rel, count(*) FILTER (rel AND rank <= 10) AS hits, coalesce(sum(running / rank) FILTER (rel AND rank <= 10), 0) AS ap, coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 10), 0) AS dcg, min(rank) FILTER (rel) AS first FROM h GROUP BY a HAVING count(*) FILTER (rel) > 0)
SELECT a AS query, hits, round(hits / 10, 9) AS prec_r, round(ap / least(10, n_rel), 9) AS ap_r, round(1.0 / first, 9) AS mrr_r, round(dcg / list_sum(list_transform(range(1, least(10, n_rel) + 1), lambda i: 1 / log2(i + 1))), 9) AS ndcg_r FROM q""",
    "boundary_ties": f"WITH {CTX}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY joint DESC, b) AS rank FROM p), k AS (SELECT a, joint AS kth FROM r WHERE rank = 10) SELECT a, count(*) AS ties FROM r JOIN k USING (a) WHERE joint = kth GROUP BY a",
    "seed_stability": f"WITH ctx AS (SELECT DISTINCT l_orderkey AS ctx, l_partkey AS item FROM lineitem), f AS (SELECT item, count(*) AS freq FROM ctx GROUP BY item), {NEAR.format(source='c.ctx % 3', join='', least=1)} SELECT CASE WHEN freq < 10 THEN '<10' WHEN freq < 100 THEN '<100' WHEN freq < 1000 THEN '<1000' WHEN freq < 10000 THEN '<10000' ELSE '>=10000' END AS bucket, count(*) AS pairs, round(avg(jaccard), 6) AS jaccard_r FROM j JOIN f ON f.item = anchor GROUP BY 1",
    "split_overlap_audit": f"""WITH ctx AS (SELECT DISTINCT l_orderkey AS ctx, l_partkey AS item FROM lineitem), s AS (SELECT ctx, item, CASE WHEN {FRACTION} < 0.8 THEN 'train' WHEN {FRACTION} < 0.9 THEN 'validation' ELSE 'test' END AS split FROM ctx), n AS (SELECT ctx, count(*) AS n FROM ctx GROUP BY ctx),
b AS (SELECT x.ctx AS a, y.ctx AS b, count(*) AS common FROM s x JOIN s y ON x.item = y.item AND x.ctx < y.ctx AND x.split <> y.split GROUP BY 1, 2)
SELECT CASE WHEN common = na.n AND na.n = nb.n THEN 'equal' WHEN common = least(na.n, nb.n) THEN 'contained' WHEN common >= 0.5 * (na.n + nb.n - common) THEN 'similar' ELSE 'touching' END AS category, count(*) AS cnt FROM b JOIN n na ON na.ctx = b.a JOIN n nb ON nb.ctx = b.b GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (ppmi_top_partners, incidence_cosine_top, pair_evidence, doc_frequency_vocab, global_popularity, popularity_by_key, cooccurrence_recommend, holdout_recall_ndcg, popularity_holdout, usage_lift, source_neighbour_jaccard, incidence_baselines, pessimistic_vs_name_rank, metric_ap_mrr, boundary_ties, seed_stability, split_overlap_audit)}
