"""Splits, masks, samples and expansions that a hash makes repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.tables import shared_table


def fraction(key: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of SHA-256."""
    return F.conv(F.substr(F.sha2(key.cast("string"), 256), F.lit(1), F.lit(12)), 16, 10).cast("long") / float(16**12)


def partition(key: Column, train: float = 0.8, validation: float = 0.1) -> Column:
    f = fraction(key)
    return F.when(f < train, "train").when(f < train + validation, "validation").otherwise("test")


def order_key(seed: int, *parts: Column) -> Column:
    """A repeatable shuffle: sort by this."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def prefix_sums(df: DataFrame, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """df with the sum of value over all rows before a row in the order, which must be total: rows are dealt out by ranges, and each range starts where the sums of those before it end."""
    keys = [f"__o{i}" for i in range(len(order))]
    keyed = df.withColumns({k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, order, strict=True)}).withColumn("__value", value)
    dealt = shared_table(keyed.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("__part").agg(F.sum("__value").alias("__n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__part", F.coalesce(F.sum("__n").over(before.orderBy("__part")), F.lit(0)).alias("__start"))  # a row a range
    inside = F.coalesce(F.sum("__value").over(before.partitionBy("__part").orderBy(*keys)), F.lit(0))
    return dealt.join(F.broadcast(starts), "__part").withColumn(out, inside + F.col("__start")).select(*df.columns, out)


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with its place (from 1) in the order."""
    return prefix_sums(df, order, F.lit(1).cast("long"), "__before").withColumn(out, (F.col("__before") + 1).cast("long")).drop("__before")


def group_split(groups: DataFrame, key: str, seed: int, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """key, split with exact shares: groups in hashed order, cut at floors."""
    places = numbered(groups.select(key).distinct(), [order_key(seed, F.col(key)), key], "__place")
    n = F.broadcast(places.agg(F.count("*").alias("__all")))
    split = F.when(F.col("__place") <= F.floor(F.col("__all") * train), "train").when(F.col("__place") <= F.floor(F.col("__all") * (train + validation)), "validation").otherwise("test")
    return places.crossJoin(n).select(key, split.alias("split"))


def mask(members: DataFrame, group: str, member: str, ratio: float, seed: int) -> DataFrame:
    """members with `hidden`: of each group, max(1, round half to even(n ratio)) by hashed order."""
    by = Window.partitionBy(group)
    hide = F.greatest(F.lit(1), F.bround(F.count("*").over(by) * ratio, 0).cast("int"))
    return members.withColumn("hidden", F.row_number().over(by.orderBy(order_key(seed, F.col(group), F.col(member)), member)) <= hide)


def leave_one_out(sets: DataFrame, group: str, items: str) -> DataFrame:
    """group, target, rest: one row for each member."""
    return sets.select(group, F.explode(items).alias("target"), F.col(items).alias("__all")).withColumn("rest", F.filter("__all", lambda x: x != F.col("target"))).drop("__all")


def replacement_slots(targets: DataFrame, context: list[str], target: str) -> DataFrame:
    """context, target: targets that fit the same slot, where there are several; a row each, so a slot that all fit stays bounded."""
    fits = targets.select(*context, target).distinct()
    several = fits.groupBy(*context).agg(F.min(target).alias("__a"), F.max(target).alias("__b")).where("__a <> __b")
    return fits.join(several.select(*context), context, "left_semi")


def stratified(df: DataFrame, stratum: str, key: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows of each stratum, by hashed order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(order_key(seed, F.col(key)), key))).where(F.col("__n") <= most).drop("__n")


def keep_probability(frequency: Column, threshold: float) -> Column:
    """Chance that a frequent item's pair is kept."""
    return F.least(F.lit(1.0), (F.sqrt(frequency / threshold) + 1) * threshold / frequency)


def round_robin(df: DataFrame, role: str, stratum: str, item: str, weight: str) -> DataFrame:
    """role, stratum, item, pick: turn by turn the best item left of each (role, stratum), roles first.

    An item with several roles is used once, at its earliest turn; its other places are closed up.
    """
    by = Window.partitionBy(role, stratum).orderBy(F.desc(weight), item)
    turn = df.withColumn("turn", F.row_number().over(by))
    first = turn.withColumn("__n", F.row_number().over(Window.partitionBy(item).orderBy("turn", role, stratum))).where("__n = 1").drop("__n", "turn")
    closed = first.withColumn("turn", F.row_number().over(by))
    return numbered(closed.select(role, stratum, item, "turn"), ["turn", role, stratum], "pick").select(role, stratum, item, "pick")


def balanced_groups(groups: DataFrame, key: str, size: str, shares: dict[str, float]) -> DataFrame:
    """key, split: largest groups first, each to the split that is least full for its share.

    Greedy, so one place must see the sizes; sizes are grouped first (groups of one size go round by share), and what the
    driver sees is one row for each distinct size.
    """
    counts = sorted(((r[0], r[1]) for r in groups.groupBy(size).agg(F.count("*").alias("__count")).collect()), reverse=True)
    full = dict.fromkeys(shares, 0.0)
    cuts: list[tuple[int, str, int, int]] = []
    for s, n in counts:
        given = {k: int(n * shares[k]) for k in shares}
        for _ in range(n - sum(given.values())):
            k = min(shares, key=lambda x: ((full[x] + given[x] * s) / shares[x], x))
            given[k] += 1
        at = 0
        for k in shares:
            full[k] += given[k] * s
            cuts.append((s, k, at, at + given[k]))
            at += given[k]
    table = groups.sparkSession.createDataFrame(cuts or [(0, "", 0, 0)], "__s long, split string, __from long, __to long")
    placed = groups.withColumn("__n", F.row_number().over(Window.partitionBy(size).orderBy(order_key(1, F.col(key)), key)) - 1)
    return placed.join(F.broadcast(table), (F.col(size) == F.col("__s")) & (F.col("__n") >= F.col("__from")) & (F.col("__n") < F.col("__to"))).select(key, size, "split")
