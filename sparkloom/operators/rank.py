"""Ranks and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.split import prefix_sums


def by_name(df: DataFrame, query: list[str], score: str, name: str, out: str = "rank") -> DataFrame:
    """Deterministic rank: best score first, ties by name, absent scores last."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*query).orderBy(F.desc_nulls_last(score), name)))


def pessimistic(df: DataFrame, query: list[str], score: str, out: str = "rank") -> DataFrame:
    """Number of candidates at least as good: among equals, the worst rank."""
    return df.withColumn(out, F.count("*").over(Window.partitionBy(*query).orderBy(F.desc_nulls_last(score))))


def percentile_rank(rank: Column, n: Column) -> Column:
    """100 (rank - 1) / (n - 2), n counting the anchor; 0 without others."""
    return F.when(n <= 2, 0.0).otherwise(100.0 * (rank - 1) / (n - 2))


def top_k(df: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def boundary_ties(df: DataFrame, group: list[str], score: str, name: str, k: int) -> DataFrame:
    """group, ties: how many candidates have the k-th score."""
    ranked = by_name(df, group, score, name)
    kth = ranked.where(F.col("rank") == k).select(*group, F.col(score).alias("kth"))
    return ranked.join(kth, group).where(F.col(score) == F.col("kth")).groupBy(*group).agg(F.count("*").alias("ties"))


def metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """query, hits, recall, prec, ap, ndcg, mrr.

    ranked: query, item, rank over all candidates; relevant: query, item.  Average precision divides by the smaller of k
    and the number relevant; queries without anything relevant are not there; no hit gives zeros.
    """
    total = relevant.groupBy(query).agg(F.count("*").alias("n_rel"))
    hits = ranked.join(relevant.withColumn("rel", F.lit(1)), [query, item])
    along = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("running", F.sum("rel").over(along))
    inside = F.col("rank") <= k
    per = hits.groupBy(query).agg(
        F.count_if(inside).alias("hits"),
        F.sum(F.when(inside, F.col("running") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.min("rank").alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return total.join(per, query, "left").select(
        query,
        zero("hits").alias("hits"),
        (zero("hits") / F.col("n_rel")).alias("recall"),
        (zero("hits") / k).alias("prec"),
        (F.coalesce("ap_sum", F.lit(0.0)) / F.least(F.lit(k), F.col("n_rel"))).alias("ap"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by the rank sum, ties at their mean rank.  Equal scores are counted before anything is ordered."""
    at = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    ranks = prefix_sums(at, [score], F.col("n"), "below").withColumn("mean_rank", F.col("below") + (F.col("n") + 1) / 2)
    sums = ranks.agg(F.sum(F.col("mean_rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return sums.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of mean ranks."""

    def ranks(c: str) -> DataFrame:
        at = df.groupBy(c).agg(F.count("*").alias("__n"))
        return prefix_sums(at, [c], F.col("__n"), "__below").select(c, (F.col("__below") + (F.col("__n") + 1) / 2).alias(f"rank_{c}"))

    return df.join(ranks(x), x).join(ranks(y), y).agg(F.corr(f"rank_{x}", f"rank_{y}").alias("spearman"))


def label_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, f1: of each label; 0 where it is neither there nor guessed."""
    both = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g"), (F.col(truth) == F.col(guess)).cast("int").alias("b")), F.struct(F.col(guess).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("b")))).alias("e"))
    per = both.groupBy("e.label").agg(F.sum("e.t").alias("t"), F.sum("e.g").alias("g"), F.sum("e.b").alias("b"))
    return per.select("label", F.when(F.col("t") + F.col("g") == 0, 0.0).otherwise(2 * F.col("b") / (F.col("t") + F.col("g"))).alias("f1"))


def seed_summary(per_seed: DataFrame, dims: list[str], value: str) -> DataFrame:
    """dims, n, mean, sd (null for one seed), shown ('mean ± sd')."""
    out = per_seed.groupBy(*dims).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("shown", F.when(F.col("n") >= 3, F.format_string("%.4f ± %.4f", "mean", "sd")))


#: 0.975 quantiles of Student's t by degrees of freedom, 2 to 10.
T_975 = (4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139)


def paired_difference(per_seed: DataFrame, dims: list[str], seed: str, variant: str, value: str, first: str, second: str) -> DataFrame:
    """dims, n, difference, low, high: second minus first seed by seed with a 95 % interval; three to eleven seeds."""
    wide = per_seed.groupBy(*dims, seed).agg(F.max(F.when(F.col(variant) == first, F.col(value))).alias("a"), F.max(F.when(F.col(variant) == second, F.col(value))).alias("b")).where("a is not null and b is not null")
    per = wide.groupBy(*dims).agg(F.count("*").alias("n"), F.avg(F.col("b") - F.col("a")).alias("difference"), F.stddev_samp(F.col("b") - F.col("a")).alias("sd")).where("n >= 3")
    half = F.get(F.array(*map(F.lit, T_975)), (F.col("n") - 3).cast("int")) * F.col("sd") / F.sqrt("n")
    return per.select(*dims, "n", "difference", (F.col("difference") - half).alias("low"), (F.col("difference") + half).alias("high"))


def assessment(low: Column, high: Column, margin: float) -> Column:
    """What an interval says against a practical margin."""
    return F.when(low > margin, "better").when(high < -margin, "worse").when((low > -margin) & (high < margin), "equivalent").otherwise("unclear")


def rarity_recall(ranked: DataFrame, relevant: DataFrame, frequency: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """query, recall: rare targets weigh more, 1 / log2(2 + frequency)."""
    w = 1 / F.log2(2 + F.col("freq"))
    goal = relevant.join(frequency, item).withColumn("w", w)
    hit = goal.join(ranked.where(F.col("rank") <= k).select(query, item, F.lit(1).alias("hit")), [query, item], "left")
    return hit.groupBy(query).agg((F.sum(F.coalesce("hit", F.lit(0)) * F.col("w")) / F.sum("w")).alias("recall"))


def reliable_from(buckets: DataFrame, order: str, value: str, least: float) -> DataFrame:
    """The first bucket whose value reaches the least."""
    return buckets.where(F.col(value) >= least).orderBy(order).limit(1)
