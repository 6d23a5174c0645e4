"""Connected components and families of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.tables import shared_table


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, root: the smallest id of its component, for every id in an edge between two ids.

    Large and small stars in turn until no edge moves.  Each round is two aggregations and two joins by
    node, written to the shared folder, so lineage stays short; rounds grow with the log of the longest path.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    def trace(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    now = shared_table(now.distinct(), "component-edges")
    seen = trace(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = down.join(low, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = shared_table(small, "component-edges")
        now, before, seen = after, seen, trace(after)
        if seen == before:  # nothing moved
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def families(members: DataFrame, group: str, member: str) -> DataFrame:
    """group, root: groups that share a member, directly or through others, have the same root (the smallest group).

    Members become star edges to the smallest group that holds them: linear in the rows, however many groups share a member.
    """
    lead = members.groupBy(member).agg(F.min(group).alias("lead"))
    edges = members.join(lead, member).select(F.col(group).alias("a"), F.col("lead").alias("b"))
    roots = components(edges, "a", "b")
    return members.select(F.col(group).alias("id")).distinct().join(roots, "id", "left").select(F.col("id").alias(group), F.coalesce("root", "id").alias("root"))
