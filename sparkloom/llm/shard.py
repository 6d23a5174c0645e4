"""Jump consistent hashing as DataFrame expressions.

A shard is a function of the key and the number of shards alone, so no ring table exists and
one more shard takes a fraction of 1/(n+1) of the keys, all of them into itself.

Nulls: a null key hashes like any other value, a null text has no bytes and CRC 0.  Repeated keys
share a shard and get slots of their own.  An empty table gives an empty table.  Other columns of
the input are ignored by `assign_slots` and kept by `with_shards`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import text_or_empty

#: Fixed values of the published algorithm: the multiplier of its 64-bit generator, as two halves.
JUMP_HIGH, JUMP_LOW = divmod(2862933555777941757, 1 << 32)
MASK = (1 << 32) - 1
#: Groups in which the rows of one shard are numbered; tables of counts have shards x BLOCKS rows.
BLOCKS = 1024


def _low_product(value: Column, factor: int) -> Column:
    """The low 32 bits of value * factor for two 32-bit numbers, without leaving 63 bits."""
    high = F.shiftright(value, 16) * F.lit(factor)
    return (value.bitwiseAND(0xFFFF) * F.lit(factor) + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def _advanced(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64, the key being held as two unsigned halves."""
    by_low, by_high = low.bitwiseAND(0xFFFF) * F.lit(JUMP_LOW), F.shiftright(low, 16) * F.lit(JUMP_LOW)
    small = by_low + F.shiftleft(by_high.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(small, 32) + F.shiftright(by_high, 16)
    return (carry + _low_product(high, JUMP_LOW) + _low_product(low, JUMP_HIGH)).bitwiseAND(MASK), small.bitwiseAND(MASK)


def jump_shards(key: Column, shards: int) -> Column:
    """A struct of two ints: `shard` among `shards` and `grown` among one more."""
    mixed = F.xxhash64(key)
    start = F.struct(
        F.shiftrightunsigned(mixed, 32).alias("high"),
        mixed.bitwiseAND(F.lit(MASK)).alias("low"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
        F.lit(0).cast("long").alias("next"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _advanced(state["high"], state["low"])
        jump = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            F.when(state["next"] < shards, state["next"]).otherwise(state["shard"]).alias("shard"),
            state["next"].alias("grown"),
            jump.cast("long").alias("next"),
        )
        return F.when(state["next"] <= shards, moved).otherwise(state)

    # every jump goes at least one further, so shards + 1 steps always reach the end
    last = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)
    return F.transform(F.array(last), lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))[0]


def with_shards(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """docs with `shard` and `grown_shard`; no exchange."""
    placed = docs.withColumn("__jump", jump_shards(F.col(key), shards))
    return placed.withColumns({"shard": F.col("__jump.shard"), "grown_shard": F.col("__jump.grown")}).drop("__jump")


def assign_slots(docs: DataFrame, shards: int, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs.

    Slots are numbered inside (shard, block) groups, and each group starts where the counts of
    the blocks before it end, so no task ever holds a whole shard.  Only ids and numbers are
    exchanged; the counting pass reads the ids alone.
    """
    block = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("slot")), F.lit(blocks)).cast("int")
    counts = with_shards(docs.select("doc_id"), shards).groupBy("shard", block.alias("block")).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x blocks rows of three numbers: small by construction
    starts = counts.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = with_shards(docs.select("doc_id", size.alias("size"), F.crc32(text_or_empty()).alias("text_crc32")), shards).withColumn("block", block)
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("number", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("number")).cast("long").alias("slot"), "grown_shard"
    )
