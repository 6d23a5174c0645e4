"""Contexts (sets of items), their frequencies, co-occurrence, association scores and baselines built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.split import numbered


def contexts(rows: DataFrame, context: str, item: str) -> DataFrame:
    """Distinct (ctx, item): quantities and repeats don't count."""
    return rows.select(F.col(context).alias("ctx"), F.col(item).alias("item")).where("ctx is not null and item is not null").distinct()


def frequencies(ctx: DataFrame) -> DataFrame:
    return ctx.groupBy("item").agg(F.count("*").alias("freq"))


def vocabulary(ctx: DataFrame, least: int) -> DataFrame:
    """item, freq, idx: items of at least so many contexts, numbered by item from 2 (0 pads, 1 is unknown)."""
    kept = frequencies(ctx).where(F.col("freq") >= least)
    return numbered(kept, ["item"], "__place").select("item", "freq", (F.col("__place") + 1).cast("int").alias("idx"))


def cooccurrence(ctx: DataFrame) -> DataFrame:
    """a, b, joint for a < b: the join makes each pair once, callers mirror the counts."""
    left, right = ctx.select("ctx", F.col("item").alias("a")), ctx.select("ctx", F.col("item").alias("b"))
    return left.join(right, "ctx").where("a < b").groupBy("a", "b").agg(F.count("*").alias("joint"))


def mirrored(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Both directions of unordered pairs, without reading them twice."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    ends = F.array(F.struct(F.col(a).alias(a), F.col(b).alias(b)), F.struct(F.col(b).alias(a), F.col(a).alias(b)))
    return pairs.select(F.explode(ends).alias("e"), *rest).select(f"e.{a}", f"e.{b}", *rest)


def associations(ctx: DataFrame) -> DataFrame:
    """a, b (a < b), joint, fa, fb, n with the marginals that scores need."""
    freq, n = frequencies(ctx), ctx.agg(F.count_distinct("ctx").alias("n"))
    pairs = cooccurrence(ctx)
    pairs = pairs.join(freq.select(F.col("item").alias("a"), F.col("freq").alias("fa")), "a").join(freq.select(F.col("item").alias("b"), F.col("freq").alias("fb")), "b")
    return pairs.crossJoin(F.broadcast(n))  # n: one row


def ppmi() -> Column:
    """Positive pointwise mutual information in bits, unsmoothed."""
    return F.greatest(F.log2(F.col("joint") * F.col("n") / (F.col("fa") * F.col("fb"))), F.lit(0.0))


def smoothed_pmi() -> Column:
    """Add-half smoothed PMI in bits, for evidence tables."""
    return F.log2((F.col("joint") + 0.5) * F.col("n") / ((F.col("fa") + 0.5) * (F.col("fb") + 0.5)))


def incidence_cosine() -> Column:
    return F.col("joint") / F.sqrt(F.col("fa") * F.col("fb"))


def top_partners(ctx: DataFrame, score: Column, name: str, k: int, digits: int = 9) -> DataFrame:
    """item, partner, joint, <name>, rank: each item's best partners; ties by partner, after rounding."""
    scored = mirrored(associations(ctx).select("a", "b", "joint", F.round(score, digits).alias(name)))
    by = Window.partitionBy("a").orderBy(F.desc(name), "b")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(F.col("a").alias("item"), F.col("b").alias("partner"), "joint", name, "rank")


def popularity(ctx: DataFrame, keys: DataFrame | None = None, k: int = 20) -> DataFrame:
    """item, cnt, rank over all contexts, or for each key of `keys` (ctx, key)."""
    rows = ctx if keys is None else ctx.join(keys, "ctx")
    by = [] if keys is None else ["key"]
    counts = rows.groupBy(*by, "item").agg(F.count("*").alias("cnt"))
    if keys is None:
        best = counts.orderBy(F.desc("cnt"), "item").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "item")))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cnt"), "item"))).where(F.col("rank") <= k)


def recommend(train: DataFrame, visible: DataFrame, k: int) -> DataFrame:
    """ctx, item, score, rank: items not visible in a context, by the sum of their joint counts with the visible ones."""
    both = mirrored(cooccurrence(train))
    seen = visible.select("ctx", F.col("item").alias("a"))
    scored = seen.join(both, "a").groupBy("ctx", F.col("b").alias("item")).agg(F.sum("joint").alias("score")).join(visible, ["ctx", "item"], "left_anti")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("ctx").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= k)


def usage_lift(ctx: DataFrame, labels: DataFrame, least_item: int = 20, least_both: int = 5, lift: float = 2.0, least_label: int = 100) -> DataFrame:
    """item, label, lift, positive: share of a label's contexts that hold the item, over its share of all."""
    n = F.broadcast(ctx.agg(F.count_distinct("ctx").alias("n")))
    per_label = labels.join(ctx.select("ctx").distinct(), "ctx").groupBy("label").agg(F.count("*").alias("n_label")).where(F.col("n_label") >= least_label)
    both = ctx.join(labels, "ctx").groupBy("item", "label").agg(F.count("*").alias("n_both"))
    out = both.join(per_label, "label").join(frequencies(ctx), "item").crossJoin(n)
    value = F.round((F.col("n_both") / F.col("n_label")) / (F.col("freq") / F.col("n")), 9)
    positive = (F.col("lift") >= lift) & (F.col("n_both") >= least_both) & (F.col("freq") >= least_item)
    return out.withColumn("lift", value).withColumn("positive", positive.cast("int")).select("item", "label", "n_both", "lift", "positive")


def source_neighbours(ctx: DataFrame, sources: DataFrame, least: int, k: int) -> DataFrame:
    """source, anchor, partners: the k items seen most often with an anchor inside one source's contexts."""
    rows = ctx.join(sources, "ctx")
    anchors = rows.groupBy("source", "item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    left = rows.join(anchors.select("source", "item"), ["source", "item"]).select("source", "ctx", F.col("item").alias("anchor"))
    pairs = left.join(rows.select("source", "ctx", F.col("item").alias("partner")), ["source", "ctx"]).where("anchor <> partner").groupBy("source", "anchor", "partner").agg(F.count("*").alias("c"))
    best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("source", "anchor").orderBy(F.desc("c"), "partner"))).where(F.col("rank") <= k)
    return best.groupBy("source", "anchor").agg(F.array_sort(F.collect_set("partner")).alias("partners"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def incidence_baselines(ctx: DataFrame, visible: DataFrame) -> DataFrame:
    """query, item, hits, cosine: contexts weigh by how many of a query's visible items they hold."""
    weight = visible.join(ctx, "item").groupBy("query", "ctx").agg(F.count("*").alias("m"))
    hits = weight.join(ctx, "ctx").groupBy("query", "item").agg(F.sum("m").alias("hits"))
    norm = weight.groupBy("query").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    scored = hits.join(norm, "query").join(frequencies(ctx), "item").join(visible, ["query", "item"], "left_anti")
    return scored.select("query", "item", "hits", F.round(F.col("hits") / (F.sqrt("freq") * F.col("norm")), 9).alias("cosine"))


def popular_unseen(train: DataFrame, visible: DataFrame, contexts: DataFrame, k: int) -> DataFrame:
    """ctx, item, rank: the k most frequent items that a context doesn't show.

    A context that shows n of the items looks at the first k + n alone: as many ranks are made for each context as it needs, joined by rank.
    """
    shown = visible.join(contexts, "ctx", "left_semi").select("ctx", "item").distinct()
    wanted = contexts.join(shown.groupBy("ctx").agg(F.count("*").alias("n")), "ctx", "left").select("ctx", (F.coalesce("n", F.lit(0)) + k).alias("n"))
    most = wanted.agg(F.coalesce(F.max("n"), F.lit(k))).first()[0]
    top = popularity(train, k=most).select("item", F.col("rank").alias("pop"))
    offered = wanted.select("ctx", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("pop")).join(top, "pop").join(shown, ["ctx", "item"], "left_anti")
    by = Window.partitionBy("ctx").orderBy("pop")
    return offered.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("ctx", "item", "rank")
