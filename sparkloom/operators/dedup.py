"""Fingerprints, first-wins deduplication, quality rules and audits of contexts and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import families
from sparkloom.sources.tables import shared_table


def list_fingerprint(values: Column) -> Column:
    """SHA-256 of the JSON list of strings, in the order given, without spaces."""
    escaped = F.transform(values.cast("array<string>"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\\\\\"), '"', r'\\\\"'))
    return F.sha2(F.when(F.size(values) == 0, F.lit("[]")).otherwise(F.concat(F.lit('["'), F.array_join(escaped, '","'), F.lit('"]'))), 256)


def set_fingerprints(ctx: DataFrame) -> DataFrame:
    """ctx, items, n, fingerprint of each context's sorted distinct items."""
    sets = ctx.groupBy("ctx").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sets.select("ctx", "items", F.size("items").alias("n"), list_fingerprint(F.col("items")).alias("fingerprint"))


def multiset_fingerprints(rows: DataFrame, record: str, key: str, quantity: str) -> DataFrame:
    """record, fingerprint: quantities of a key are summed first, so the order and splitting of lines don't matter."""
    total = rows.groupBy(record, key).agg(F.sum(quantity).alias("q"))
    lists = total.groupBy(record).agg(F.array_sort(F.collect_list(F.struct(key, "q"))).alias("l"))
    shown = F.array_join(F.transform("l", lambda e: F.concat_ws(":", e[key].cast("string"), e["q"].cast("string"))), ",")
    return lists.select(record, F.sha2(shown, 256).alias("fingerprint"))


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """df with `kept`, true for the first row of each key, and `group_size`."""
    by = Window.partitionBy(*key)
    return df.withColumn("kept", F.row_number().over(by.orderBy(*order)) == 1).withColumn("group_size", F.count("*").over(by))


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key; combines before it exchanges, so hot keys cost a row a task."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*").select(*df.columns)


def two_key_first_wins(df: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """df with `kept`: a row goes if either key was kept earlier; rows that go don't register their keys.

    The decision depends on order inside a connected component of shared keys only.  Rounds decide all rows
    whose every earlier neighbour is decided: a row is kept once it is the first undecided one under both of its keys; its
    neighbours go.  Each round is two aggregations, whatever the sizes of the components.
    """
    undecided = shared_table(df.select(first, second, order), "two-key")
    kept = None
    while not undecided.isEmpty():
        a = undecided.groupBy(first).agg(F.min(order).alias("__a"))
        b = undecided.groupBy(second).agg(F.min(order).alias("__b"))
        now = undecided.join(a, first).join(b, second).where((F.col(order) == F.col("__a")) & (F.col(order) == F.col("__b"))).select(first, second, order)
        now = shared_table(now, "two-key-kept")
        kept = now if kept is None else kept.unionByName(now)
        undecided = undecided.join(now.select(first), first, "left_anti").join(now.select(second), second, "left_anti")
        undecided = shared_table(undecided, "two-key")
    if kept is None:
        return df.withColumn("kept", F.lit(True))
    return df.join(kept.select(order).withColumn("__kept", F.lit(True)), order, "left").withColumn("kept", F.coalesce("__kept", F.lit(False))).drop("__kept")


#: Titles that tell a large context isn't an ordinary one, in the order in which they are tried, and its least size.
QUALITY_TITLES = (
    ("explicit_cube", r"\bcube\b"),
    ("collection_or_pool", r"\b(collection|card pool|cardpool|inventory)\b"),
    ("aggregate_or_reference", r"\b(archetype reference|reference list|all cards|merged lists?)\b"),
)
QUALITY_SIZE = 120


def quality_reason(title: Column, size: Column) -> Column:
    """Why a large context isn't an ordinary one; null otherwise.  A title alone never tells."""
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(QUALITY_TITLES):
        out = F.when(F.lower(title).rlike(pattern), reason).otherwise(out)
    return F.when(size >= QUALITY_SIZE, out)


def context_status(sets: DataFrame, smallest: int, largest: int, order: str = "ctx") -> DataFrame:
    """sets with `status`, the first that applies: malformed, duplicate, too_small, quarantined, accepted.

    A set counts as seen for later duplicates even if it is rejected for its size.
    """
    n = F.size("items")
    ranked = sets.withColumn("__first", F.min(order).over(Window.partitionBy("fingerprint")))
    status = F.when(F.col("items").isNull(), "malformed").when(F.col(order) > F.col("__first"), "duplicate").when(n < smallest, "too_small").when(n > largest, "quarantined").otherwise("accepted")
    return ranked.withColumn("status", status).drop("__first")


def provenance(sets: DataFrame, tags: DataFrame) -> DataFrame:
    """fingerprint, contexts, labels (sorted), first: all contexts with equal sets, what they were tagged, the first of them."""
    return sets.join(tags, "ctx", "left").groupBy("fingerprint").agg(
        F.count_distinct("ctx").alias("contexts"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.min("ctx").alias("first")
    )


def report(rows: DataFrame, codes: str = "codes", source: str = "source") -> dict[str, DataFrame]:
    """Three tables on rows with an array of rejection codes: totals, rows a code (once a row), and a matrix by source."""
    rejected = F.size(codes) > 0
    totals = rows.agg(F.count("*").alias("total"), F.count_if(~rejected).alias("accepted"), F.count_if(rejected).alias("rejected"))
    by_code = rows.select(F.explode(F.array_distinct(codes)).alias("code")).groupBy("code").agg(F.count("*").alias("rows"))
    matrix = rows.groupBy(source).agg(F.count_if(~rejected).alias("accepted"), F.count_if(rejected).alias("rejected"))
    return {"totals": totals, "codes": by_code, "sources": matrix}


def reserved_families(members: DataFrame, group: str, member: str, reserved: DataFrame) -> DataFrame:
    """group, root, reserved: a whole family is reserved if any of its members is."""
    roots = families(members, group, member)
    touched = members.join(reserved, member, "left_semi").select(group).distinct().join(roots, group).select("root").distinct().withColumn("__r", F.lit(True))
    return roots.join(touched, "root", "left").select(group, "root", F.coalesce("__r", F.lit(False)).alias("reserved"))
