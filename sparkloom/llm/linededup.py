"""Repeated passages of lines, cut by content.

Lines are hashed, and a rolling hash runs over the hashes of WINDOW = 2 lines.  Places where it repeats anywhere in the table mark the runs of lines that can be
repeated passages; one line of LONG_WORDS words or more is a run by itself if it repeats, as passages often are a few long lines.  Inside a run a chunk ends
where the number of repetitions changes (there one passage ends or another begins), around long lines, and where the rolling hash has a local minimum among lines that repeat as often.  All of it
follows from the lines nearby, so text put in elsewhere moves no border, and a repeated passage has the same chunks wherever it stands.  A
chunk that occurs again anywhere is removed but for its first place (smallest doc_id, then digest of the text, then first line).  Chunks are grouped by their
bytes, not by a hash: equal means equal.

Null and empty texts have no chunks; chunks of blanks alone stay.  Rows with the same doc_id and text are one document, which is cut alike in each of its rows;
rows with the same doc_id and another text are other documents; a null doc_id sorts first.  Other columns are kept.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import shared_table, text_or_empty

WINDOW, LONG_WORDS = 2, 20
#: Base of the rolling hash over line hashes of HASH bits: two lines fit a long.
HASH = 30
_DOC = ["__id", "__text"]


def _number(digest: Column, digits: int) -> Column:
    return F.conv(F.substr(digest, F.lit(1), F.lit(digits)), 16, 10).cast("long")


def _document(text: Column) -> list[Column]:
    """The key of a document: its id and a digest of its text."""
    return [F.col("doc_id").alias("__id"), _number(F.md5(text), 15).alias("__text")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _is_long(line: Column) -> Column:
    return (F.length(line) >= 2 * LONG_WORDS - 1) & (F.regexp_count(line, F.lit(r"\S+")) >= LONG_WORDS)


def line_marks(docs: DataFrame) -> DataFrame:
    """Document key, i (from 1), hash, long: every line."""
    text = text_or_empty()
    mark = lambda x: F.struct((_number(F.md5(x), 8).bitwiseAND((1 << HASH) - 1)).alias("hash"), _is_long(x).alias("long"))
    marked = docs.where(F.length(text) > 0).select(*_document(text), F.transform(_lines(text), mark).alias("marks"))
    return marked


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Document key, i, pairs (how often the pair of lines i, i + 1 occurs; 0: once or no pair), roll, long: the lines of all runs."""
    marked = shared_table(line_marks(docs), "line-marks")  # one pass over the texts; a number a line
    rolled = lambda x, i: F.struct((i + 1).alias("i"), x["long"].alias("long"), F.when(i + 1 < F.size("marks"), x["hash"] * (1 << HASH) + F.get("marks", i + 1)["hash"]).alias("roll"), F.when(x["long"], -1 - x["hash"]).alias("alone"))
    lines = marked.select(*_DOC, F.explode(F.transform("marks", rolled)).alias("u")).select(*_DOC, "u.*")
    # pairs have keys from 0 on, long lines by themselves negative ones
    units = lines.select(*_DOC, "i", "long", F.explode(F.array("roll", "alone")).alias("key")).where("key is not null")
    often = units.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    found = units.join(often, "key")
    pair = F.col("key") >= 0
    here = F.struct("i", F.when(pair, F.col("times")).otherwise(0).alias("pairs"), F.when(pair, F.col("key")).otherwise(0).alias("roll"), F.col("long").cast("int").alias("long"))
    after = F.struct((F.col("i") + 1).alias("i"), F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("roll"), F.lit(0).alias("long"))
    both = found.select(*_DOC, F.explode(F.when(pair, F.array(here, after)).otherwise(F.array(here))).alias("l")).select(*_DOC, "l.*")
    return both.groupBy(*_DOC, "i").agg(F.max("pairs").alias("pairs"), F.max("roll").alias("roll"), F.max("long").alias("long"))


def chunk_places(docs: DataFrame) -> DataFrame:
    """Document key, chunks array<struct<first, n>>: the chunks of all runs."""
    rows = repeated_lines(docs)
    own = Window.partitionBy(*_DOC).orderBy("i")  # a document's lines, of its runs alone

    def near(name: str, by: int) -> Column:
        there = F.lag(F.struct("i", name), -by).over(own)
        return F.when(there["i"] == F.col("i") + by, there[name]).otherwise(F.lit(0))

    rows = rows.withColumns({"before": near("pairs", -1), "after": near("pairs", 1), "roll_before": near("roll", -1), "roll_after": near("roll", 1), "long_after": near("long", 1)})
    least = (F.col("before") == F.col("pairs")) & (F.col("after") == F.col("pairs")) & (F.col("roll") < F.col("roll_before")) & (F.col("roll") < F.col("roll_after"))
    ends = (F.col("pairs") == 0) | (F.col("long") == 1) | (F.col("long_after") == 1) | (F.col("before") > F.col("pairs")) | (F.col("after") > F.col("pairs")) | least
    number = F.sum(ends.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    chunks = rows.withColumn("k", F.coalesce(number, F.lit(0))).groupBy(*_DOC, "k").agg(F.min("i").alias("first"), F.count("*").cast("int").alias("n"))
    return chunks.groupBy(*_DOC).agg(F.collect_list(F.struct("first", "n")).alias("chunks"))


def removals(docs: DataFrame) -> DataFrame:
    """Document key, `cuts`, the sorted (first, n) line ranges to remove, and `cut_chars`; documents without any are absent.

    Numbers of lines are exchanged for all lines, texts for the documents of runs; every place of a repeated
    chunk is one row without its text, and the first place is found before, with partial minima.
    """
    text = text_or_empty()
    docs = docs.select("doc_id", "text")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.distinct()
    places = shared_table(chunk_places(docs), "line-chunks")
    texts = docs.where(F.length(text) > 0).select(*_document(text), _lines(text).alias("__lines"))
    keyed = [F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")) for c in _DOC]
    # texts are never the small side and the other one grows with them: one plan at every size
    parts = texts.alias("t").join(places.alias("p").hint("merge"), keyed[0] & keyed[1]).select("t.__id", "t.__text", "__lines", F.explode("chunks").alias("c"))
    parts = parts.select(*_DOC, "c.first", "c.n", F.array_join(F.slice("__lines", F.col("c.first"), F.col("c.n")), "\n").alias("part")).where(F.col("part").rlike(r"\S"))
    parts = shared_table(parts, "line-parts")
    place = F.struct(*_DOC, "first")
    whole = parts.groupBy("part").agg(F.count("*").alias("times"), F.min(place).alias("home")).where("times > 1")
    # a digest that two texts share names no text and is left alone
    homes = whole.groupBy(F.md5("part").alias("key"), F.length("part").alias("chars")).agg(F.count("*").alias("texts"), F.min("home").alias("home")).where("texts = 1").drop("texts")
    again = parts.select(*_DOC, "first", "n", F.md5("part").alias("key"), F.length("part").alias("chars")).join(homes, ["key", "chars"]).where(~place.eqNullSafe(F.col("home")))
    return again.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("cuts"), F.sum("chars").alias("cut_chars"))


def _with_cuts(docs: DataFrame) -> DataFrame:
    """docs with __cuts and __cut_chars, null where nothing goes."""
    cut = removals(docs).toDF("__i", "__t", "__cuts", "__cut_chars")
    keyed = docs.withColumns(dict(zip(_DOC, _document(text_or_empty()), strict=True)))
    return keyed.join(cut, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__text") == F.col("__t")), "left").drop(*_DOC, "__i", "__t")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with the repeated chunks cut out of `text`."""
    lines = _lines(text_or_empty())
    dead = F.flatten(F.transform("__cuts", lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1)))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), dead), lambda i: F.element_at(lines, i))
    return _with_cuts(docs).withColumn("text", F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), removed ('first:n' joined by commas), cut_text_chars; one row a row of docs."""
    text = text_or_empty()
    slim = docs.select("doc_id", "text")
    cut = removals(slim).toDF("__i", "__t", "__cuts", "__cut_chars")
    base = slim.select("doc_id", *_document(text), F.size(_lines(text)).cast("long").alias("n_lines"), F.length(text).cast("long").alias("n_all"))
    joined = base.join(cut, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__text") == F.col("__t")), "left")
    gone = F.coalesce(F.aggregate("__cuts", F.lit(0), lambda a, c: a + c["n"]), F.lit(0)).cast("long")
    listed = F.coalesce(F.array_join(F.transform("__cuts", lambda c: F.concat_ws(":", c["first"].cast("string"), c["n"].cast("string"))), ","), F.lit(""))
    return joined.select("doc_id", "n_lines", gone.alias("n_removed"), listed.alias("removed"), (F.col("n_all") - F.coalesce("__cut_chars", F.lit(0))).alias("cut_text_chars"))
