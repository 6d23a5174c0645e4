"""Scores of pairs of vectors in two spaces, means over several queries, margins, cold starts, and checks of merges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.split import order_key
from sparkloom.operators.vectors import best_products, dot, unit

#: Each row of a table has two vectors: u of the item as a member, v of it as a context.
MODES = ("input_cosine", "context_cosine", "combined_cosine", "cross_dot", "cross_cosine", "symmetric_cross_dot", "symmetric_cross_cosine", "svd_dot", "compatibility")


def prepared(df: DataFrame, mode: str, u: str = "u", v: str = "v") -> DataFrame:
    """df with u and v as the mode compares them, so that a score is a dot product or two."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "combined_cosine":
        return df.withColumn(u, unit(F.zip_with(u, v, lambda x, y: x.cast("double") + y.cast("double"))))
    if mode in ("cross_dot", "symmetric_cross_dot", "svd_dot"):
        return df
    return df.withColumns({u: unit(F.col(u)), **({v: unit(F.col(v))} if v in df.columns else {})})


def pair_score(mode: str, a_u: Column, a_v: Column, b_u: Column, b_v: Column, weights: Column | None = None) -> Column:
    """Score of candidate b for query a, both prepared."""
    if mode in ("input_cosine", "combined_cosine", "svd_dot"):
        return dot(b_u, a_u)
    if mode == "context_cosine":
        return dot(b_v, a_v)
    if mode in ("cross_dot", "cross_cosine"):
        return dot(b_v, a_u)
    if mode == "compatibility":
        return dot(b_u, F.zip_with(weights, a_u, lambda w, x: w * x.cast("double")))
    return (dot(b_v, a_u) + dot(b_u, a_v)) / 2


def scored(queries: DataFrame, rows: DataFrame, key: str, mode: str, weights: Column | None = None, block: int = 2048) -> DataFrame:
    """query, key, score of a stated query set against all other rows, in blocks of queries that are sent to the rows."""
    asked, every = prepared(queries, mode).select(F.col(key).alias("query"), F.col("u").alias("__u"), F.col("v").alias("__v")), prepared(rows, mode)
    blocks = max(1, -(-asked.count() // block))
    out: DataFrame | None = None
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)
        one = every.join(F.broadcast(part), F.col(key) != F.col("query")).select("query", key, pair_score(mode, F.col("__u"), F.col("__v"), F.col("u"), F.col("v"), weights).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def best(queries: DataFrame, rows: DataFrame, key: str, mode: str, k: int, weights: Column | None = None, digits: int = 6) -> DataFrame:
    """query, key, score_r, rank: the k best of all other rows; every mode is one product of a vector of the query and one of the row."""
    asked, every = prepared(queries, mode), prepared(rows, mode)
    u, v = F.col("u"), F.col("v")
    q, r = {"context_cosine": (v, v), "cross_dot": (u, v), "cross_cosine": (u, v)}.get(mode, (u, u))
    if mode == "compatibility":
        q = F.zip_with(weights, u, lambda w, x: w * x.cast("double"))
    if mode.startswith("symmetric"):
        q, r = F.transform(F.concat(u, v), lambda x: x / 2), F.concat(v, u)
    found = best_products(asked.select(F.col(key).alias("qid"), q.cast("array<double>").alias("q")), every.select(F.col(key).alias("key"), r.cast("array<double>").alias("v")), k, digits)
    return found.select(F.col("qid").alias("query"), F.col("key").alias(key), F.col("score").alias("score_r"), "rank")


def mean_of_queries(scores: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """set, key, score: the mean over a set's queries; its own members are left out.  sets: set, query."""
    joined = scores.join(sets, "query").groupBy("set", key).agg(F.avg("score").alias("score"))
    return joined.join(sets.select("set", F.col("query").alias(key)), ["set", key], "left_anti")


def highest_mean(scores: DataFrame, group: list[str], score: str, k: int) -> DataFrame:
    """group, mean: of the k highest scores, of all where there are fewer."""
    placed = scores.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score)))).where(F.col("__n") <= k)
    return placed.groupBy(*group).agg(F.avg(score).alias("mean"))


def margins(triples: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """anchor, positive, negative, margin: the cosine of the positive less that of the negative."""
    side = vectors.select(key, unit(F.col(vector)).alias("__u"))
    out = triples
    for name in ("anchor", "positive", "negative"):
        out = out.join(side.select(F.col(key).alias(name), F.col("__u").alias(f"__{name}")), name)
    return out.select("anchor", "positive", "negative", (dot(F.col("__anchor"), F.col("__positive")) - dot(F.col("__anchor"), F.col("__negative"))).alias("margin"))


def cold_start(rows: DataFrame, selected: DataFrame, key: str, vector: str) -> DataFrame:
    """rows whose selected vectors are zeros."""
    marked = rows.join(selected.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    return marked.withColumn(vector, F.when(F.col("__k").isNull(), F.col(vector)).otherwise(F.transform(vector, lambda x: x * 0))).drop("__k")


def rms(df: DataFrame, vector: str) -> DataFrame:
    """rms of all components."""
    return df.select(F.explode(vector).alias("x")).agg(F.sqrt(F.avg(F.col("x").cast("double") * F.col("x").cast("double"))).alias("rms"))


def pooled(hidden: Column, mask: Column, method: str = "mean") -> Column:
    """A vector from those of a sequence: the mean of the masked ones, or the first."""
    if method == "first":
        return F.get(hidden, F.lit(0))
    kept = F.transform(F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda e: e["m"] > 0), lambda e: e["h"])
    total = F.reduce(F.slice(kept, 2, F.greatest(F.lit(0), F.size(kept) - 1)), F.get(kept, F.lit(0)), lambda s, h: F.zip_with(s, h, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(kept))


def masked_top(scores: DataFrame, allowed: DataFrame, row: str, item: str, k: int) -> DataFrame:
    """row, item, score, rank: the best allowed items; ties by item.  allowed: row, item."""
    fine = scores.join(allowed, [row, item], "left_semi").where(~F.isnan("score") & (F.abs("score") != float("inf")))
    return fine.withColumn("rank", F.row_number().over(Window.partitionBy(row).orderBy(F.desc("score"), item))).where(F.col("rank") <= k)


def merged_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails where the right side holds a key twice."""
    twice = right.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"not one row for each key: {twice[0].asDict()}")
    return left.join(right, keys, "left")


def disjoint_peers(rows: DataFrame, signature: list[str], key: str, uses: str) -> DataFrame:
    """a, b (a < b): rows of one signature without a common use.  Meant for signatures of bounded groups."""
    side = lambda n: rows.select(*signature, F.col(key).alias(n), F.col(uses).alias(f"__{n}"))
    return side("a").join(side("b"), signature).where((F.col("a") < F.col("b")) & ~F.arrays_overlap("__a", "__b")).select("a", "b")


def combinations(items: Column, size: int) -> Column:
    """All subsets of so many of an array's items, in order; meant for a few items."""
    out = F.transform(F.sequence(F.lit(1), F.size(items)), lambda i: F.array(i))
    out = F.when(F.size(items) == 0, F.array().cast("array<array<int>>")).otherwise(out)
    for _ in range(size - 1):
        out = F.flatten(F.transform(out, lambda s: F.transform(F.filter(F.sequence(F.lit(1), F.size(items)), lambda i: i > F.element_at(s, -1)), lambda i: F.concat(s, F.array(i)))))
    return F.transform(out, lambda s: F.transform(s, lambda i: F.element_at(items, i)))


def picked_subsets(members: DataFrame, group: str, member: str, size: int, subsets: int, seed: int) -> DataFrame:
    """group, subset, members: subsets of members in hashed order, no member twice in a group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order_key(seed, F.col(group), F.col(member)), member)) - 1
    dealt = members.withColumn("subset", F.floor(place / size).cast("int")).where(F.col("subset") < subsets)
    return dealt.groupBy(group, "subset").agg(F.array_sort(F.collect_list(member)).alias("members")).where(F.size("members") == size)


def mixed_in(corpus: int, share: float) -> int:
    """How many synthetic documents make that share of a corpus with theirs."""
    if not 0 <= share < 1:
        raise ValueError("the share lies between nought and one")
    return math.floor(corpus * share / (1 - share) + 0.5)


def pair_average_mrr(ranked: DataFrame, pairs: DataFrame, query: str, item: str) -> DataFrame:
    """mrr, pairs: the mean over all pairs of one over the item's rank (nought where it isn't ranked), not over first hits."""
    found = pairs.join(ranked.select(query, item, "rank"), [query, item], "left")
    return found.agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("pairs"))


def stale(rows: DataFrame, source: str, time: str, now: Column, hours: float) -> DataFrame:
    """source, last, stale: whether a source's last row is older than so many hours."""
    last = rows.groupBy(source).agg(F.max(time).alias("last"))
    return last.withColumn("stale", F.col("last") < now - F.make_dt_interval(secs=F.lit(hours * 3600)))
