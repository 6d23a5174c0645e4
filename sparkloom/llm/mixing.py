"""Mixing sources to target weights in a tree of domain, language and source.

A token budget goes down the tree.  At every node the children share it by weight; a child that
holds too little (its tokens times the greatest number of epochs) keeps all it has, and what it
lacks goes to its siblings by their weights.  Only what a whole subtree lacks reaches the level
above, because a node's own capacity is the sum of its leaves'.  Each leaf then takes the
token-prefix of its epochs: whole epochs while its share lasts, and of one more epoch, in an order
that seed, epoch number and doc_id fix, the documents before the share runs out.

Tokens and shares are integers, so two engines agree to the row; what a division leaves over (less than one token a child) is not given out.
Nulls: a null domain, language or source is a value of its own, the empty one; a null or empty text has no tokens and is never selected.
Weights default to one; a weight of nought gets nothing.  Repeated rows count as often as they occur.  Input columns named domain, n_tokens or copies
give way to the operator's in `mix` and stay as they are in `repeated`.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import shared_table, text_or_empty

LEVELS = ("domain", "lang", "source")
#: Slices of an epoch's order; only the slice in which a leaf's share runs out is sorted.
SLICES = 4096


def domain_of(source: Column) -> Column:
    """The domain of a source of the test tables: source number modulo four."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (F.substr(number, F.lit(-4)).cast("int") % 4).cast("string")))


def token_count(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, value in weights.items():
        out = F.when(name == key, value).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Splits each parent's `budget` over its children (`capacity`, `weight`); adds `share`.

    Children in the order of capacity to weight: the first ones are full, and from the first that
    isn't, all have budget left x weight / weight left.
    """
    order = [F.when(F.col("weight") > 0, F.col("capacity") / F.nullif("weight", F.lit(0))).asc_nulls_last(), F.col(name)]
    by = Window.partitionBy(*parent, "budget").orderBy(*order)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    big = lambda c: c.cast("decimal(38,0)")
    full_before = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    out = nodes.withColumns({"rest": F.greatest(F.col("budget") - full_before, F.lit(0)), "left": F.sum("weight").over(after)})
    out = out.withColumn("full", (F.col("weight") > 0) & (big(F.col("capacity")) * F.col("left") <= big(F.col("rest")) * F.col("weight")))
    all_of = Window.partitionBy(*parent, "budget")
    out = out.withColumns({
        "spent": F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(all_of), F.lit(0)),
        "open": F.greatest(F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_of), F.lit(1)), F.lit(1)),
    })
    fair = F.expr("cast(cast((budget - spent) as decimal(38,0)) * weight div open as bigint)")
    return out.withColumn("share", F.when(F.col("full"), F.col("capacity")).otherwise(F.greatest(fair, F.lit(0)))).drop("rest", "left", "full", "spent", "open")


def leaf_shares(leaves: DataFrame, budget_percent: int, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """domain, lang, source, tokens, share for a table of leaves with their tokens."""
    base = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = base.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(F.expr(f"cast(least(cast(tokens as decimal(38,0)) * {int(budget_percent)} div 100, tokens * {int(max_epochs)}) as bigint)").alias("budget"))
    shares: DataFrame | None = None
    for depth, level in enumerate(LEVELS, 1):
        keys = list(LEVELS[:depth])
        nodes = base.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(F.col(level), weights.get(level, {})))
        if shares is None:
            nodes = nodes.crossJoin(F.broadcast(total))  # one row
        else:
            nodes = nodes.join(shares, keys[:-1])
        shares = _share(nodes, keys[:-1], level).select(*keys, F.col("share").alias("budget"))
    return base.join(shares, list(LEVELS)).select(*LEVELS, "tokens", F.col("budget").alias("share"))


def _placed(docs: DataFrame, budget_percent: int, weights: dict[str, dict[str, int]], max_epochs: int, seed: int, domain: Column | None, slices: int, texts: bool) -> DataFrame:
    """Rows of docs that were selected, with __domain, __n and __copies; without texts only id, language and source.

    Texts are read once for counts (twice where they are asked for) and never exchanged: counts per leaf and slice come first (one row for each leaf and
    slice a task holds), and each leaf's share, its slice and what is left there are joined back.
    """
    own = [f"__{x}" for x in LEVELS]
    keys = {"__domain": F.coalesce(domain if domain is not None else domain_of(F.col("source")), F.lit("")), "__lang": F.coalesce(F.col("lang"), F.lit("")), "__source": F.coalesce(F.col("source"), F.lit(""))}
    rows = docs.withColumns(keys | {"__n": token_count(text_or_empty())}).where(F.col("__n") > 0)
    slim = shared_table(rows.select("doc_id", "lang", "source", *own, "__n"), "mix-counts")  # one pass over the texts; all that follows reads this
    stats = shared_table(slim.groupBy(*own).agg(F.sum("__n").alias("tokens")), "mix-leaves").toDF(*LEVELS, "tokens")
    shares = shared_table(leaf_shares(stats, budget_percent, weights, max_epochs), "mix-shares")
    shares = shares.select(*(F.col(x).alias(f"__{x}") for x in LEVELS), F.expr("share div tokens").alias("__epochs"), (F.col("share") % F.col("tokens")).alias("__rest"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(shares, own).withColumn("__order", order).withColumn("__slice", F.floor(F.conv(F.substr("__order", F.lit(1), F.lit(8)), 16, 10).cast("long") * F.lit(slices) / F.lit(1 << 32)).cast("int"))

    counts = shared_table(placed(slim).groupBy(*own, "__rest", "__slice").agg(F.sum("__n").alias("tokens")), "mix-slices")
    before = Window.partitionBy(*own).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    edge = counts.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0))).where((F.col("first") <= F.col("__rest")) & (F.col("__rest") < F.col("first") + F.col("tokens")))
    edge = shared_table(edge.select(*own, F.col("__slice").alias("__edge"), (F.col("__rest") - F.col("first")).alias("__room")), "mix-edges")  # one row a leaf
    # the rows of the edge slices, by order: the ones before the room ends
    near = placed(slim).join(edge, own).where(F.col("__slice") == F.col("__edge"))
    along = Window.partitionBy(*own).orderBy("__order", "__n").rangeBetween(Window.unboundedPreceding, 0)
    last = near.withColumn("__sum", F.sum("__n").over(along)).where(F.col("__sum") <= F.col("__room"))
    last = last.groupBy(*own).agg(F.max(F.struct("__order", "__n")).alias("__last"))  # the last key inside, one row a leaf
    ends = shared_table(edge.join(last, own, "left").select(*own, "__edge", "__last"), "mix-ends")
    inside = (F.col("__slice") < F.col("__edge")) | ((F.col("__slice") == F.col("__edge")) & (F.struct("__order", "__n") <= F.col("__last")))
    copies = F.col("__epochs") + F.when(inside, 1).otherwise(0)
    return placed(rows if texts else slim).join(ends, own, "left").withColumn("__copies", copies.cast("long")).where(F.col("__copies") > 0)


def mix(docs: DataFrame, budget_percent: int, weights: dict[str, dict[str, int]], max_epochs: int, seed: int = 7, domain: Column | None = None, slices: int = SLICES, texts: bool = True) -> DataFrame:
    """docs that were selected, with domain, n_tokens and `copies`, the number of epochs they occur in; without texts id, language and source are kept alone."""
    chosen = _placed(docs, budget_percent, weights, max_epochs, seed, domain, slices, texts)
    kept = [c for c in (docs.columns if texts else ("doc_id", "lang", "source")) if c not in ("domain", "n_tokens", "copies")]
    return chosen.select(*kept, F.col("__domain").alias("domain"), F.col("__n").alias("n_tokens"), F.col("__copies").alias("copies"))


def repeated(docs: DataFrame, budget_percent: int, weights: dict[str, dict[str, int]], max_epochs: int, seed: int = 7, domain: Column | None = None, slices: int = SLICES) -> DataFrame:
    """The mixed table itself, with the columns of docs: a row for each epoch that it is in."""
    chosen = _placed(docs, budget_percent, weights, max_epochs, seed, domain, slices, True)
    return chosen.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
