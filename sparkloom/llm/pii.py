"""Personal data: regular expressions propose, checksums confirm, words nearby adjust the score.

Everything is a DataFrame expression over one row; there is no exchange.  The patterns are written
so that Java's engine neither recurses nor rescans a run, whatever the length of the text: atoms
are possessive, and a match can only begin where a run begins or where the last match ended.

Nulls and empty texts have no spans.  Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import text_or_empty

#: kind: (cheap test that some text can hold it, pattern)
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){13}", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, and words that raise it when they stand in the REACH characters before it.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": r"mail|contact|write",
    "ip": r"\b(ip|address|host|server)\b",
    "card": r"card|visa|master|amex|credit|debit|pay",
    "phone": r"phone|tel|call|mobile|fax|whatsapp",
    "iban": r"iban|account|bank|konto|compte|cuenta",
}
REACH, RAISE = 40, 0.2
#: Matches whose offsets are summed one after another before a block's sum is carried on.
BLOCK = 256


def _proposed(text: Column, kind: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches that don't overlap, in code points."""
    test, pattern = PATTERNS[kind]
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(hits.alias("hit"), F.transform(F.slice(gaps, 1, F.size(hits)), lambda g: F.length(g)).alias("gap"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def block(pairs: Column, i: Column) -> Column:
        first = F.aggregate(F.slice(pairs, F.lit(1), i * BLOCK), F.lit(0), lambda n, p: n + p["gap"] + F.length(p["hit"]))
        begin = F.struct(first.alias("at"), empty.alias("out"))

        def step(state: Column, p: Column) -> Column:
            start = state["at"] + p["gap"]
            end = start + F.length(p["hit"])
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("value")))).alias("out"))

        return F.aggregate(F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)), begin, step, lambda s: s["out"])

    # the one-element array evaluates the matches once for all blocks
    spans = F.flatten(F.flatten(F.transform(F.array(pairs), lambda p: F.when(F.size(p) == 0, F.array(empty)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: block(p, i))))))
    possible = text.contains(test) if kind == "email" else text.rlike(test)
    return F.when(possible, spans).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number with spaces removed passes the mod-97 check."""
    moved = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(value, F.lit(" "), F.lit("")))
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<start, rank, end, kind, score>> of the confirmed spans of one kind."""
    rank = list(PATTERNS).index(kind)

    def scored(s: Column) -> Column:
        near = F.lower(F.substr(text, F.greatest(s["start"] + 1 - REACH, F.lit(1)), F.least(s["start"], F.lit(REACH))))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), RAISE).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    return F.transform(F.filter(_proposed(text, kind), lambda s: _confirmed(kind, s["value"])), scored)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `pii`: the spans of every whole text by start, then kind as listed in PATTERNS."""
    found = F.array_sort(F.concat(*(spans_of(text_or_empty(text), kind) for kind in PATTERNS)))
    return docs.withColumn("pii", found)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
