"""Scalar functions on names, lines, dates, markup and JSON, native unless Unicode decomposition is needed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _folded(s: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return unicodedata.normalize("NFKC", plain).casefold()


@F.pandas_udf(T.StringType())
def _fold(names: pd.Series) -> pd.Series:
    return names.map(_folded, na_action="ignore")


def folded(name: Column) -> Column:
    """Decomposed, without combining marks, case-folded.  ASCII names never leave the JVM."""
    return F.when(name.rlike(r"^\p{ASCII}*$"), F.lower(name)).otherwise(_fold(name))


def name_key(name: Column) -> Column:
    """Key of the front face: folded, trimmed, a leading `a-` dropped, blanks collapsed, cut at the first slash."""
    return _front(folded(name))


def _front(folded_name: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(folded_name, r"^\s+|\s+$", ""), r"^a-", "")
    return F.trim(F.split_part(F.regexp_replace(key, r"\s+", " "), F.lit("/"), F.lit(1)))


def _latin() -> tuple[str, str]:
    """Accented Latin letters and their plain ones, by Unicode's decompositions."""
    pairs = [(chr(c), _folded(chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(x, y) for x, y in pairs if len(y) == 1 and x != y]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


def _native_fold(name: Column) -> Column:
    return F.replace(F.lower(F.translate(name, *_latin())), F.lit("ß"), F.lit("ss"))


def native_key(name: Column) -> Column:
    """name_key without Python, which higher-order functions can't call: accents of Latin letters are dropped, other scripts in lower case."""
    return _front(_native_fold(name))


def _all_faces(folded_name: Column) -> Column:
    plain = F.translate(folded_name, "‘’‐‑–—", "''----")
    plain = F.regexp_replace(F.regexp_replace(plain, "…", "..."), r"\s*/{1,2}\s*", " // ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s*\.\s*\.\s*\.\s*", "..."), r"_{3,}", "_____")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def lookup_key(name: Column) -> Column:
    """Key with all faces: quotes and dashes made plain, ` // ` between faces, an ellipsis of three dots, runs of underscores as five."""
    return _all_faces(folded(name))


def native_lookup_key(name: Column) -> Column:
    """lookup_key without Python, as native_key is."""
    return _all_faces(_native_fold(name))


#: Shapes of dates in the order in which they are tried, with the groups of day, month and year; two digits from 69 on are of the last century.
DATE_SHAPES = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (3, 2, 1)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{2})$", (1, 2, 3)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (1, 2, 3)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (2, 1, 3)),
    (r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})(?:\s+(?:[01]?\d|2[0-3]):[0-5]?\d)?$", (1, 2, 3)),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def normal_date(text: Column) -> Column:
    """ISO where it can be read, the trimmed text where it can't, null for nothing."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    tried = [F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.substr(trimmed, F.lit(1), F.lit(10)))]
    for shape, (d, m, y) in DATE_SHAPES:
        day, month, year = (F.regexp_extract(trimmed, shape, g) for g in (d, m, y))
        named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month)).cast("string")
        month = F.when(month.rlike("^[0-9]"), month).otherwise(named)
        year = F.when(F.length(year) == 2, F.concat(F.when(year >= "69", "19").otherwise("20"), year)).otherwise(year)
        read = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
        tried.append(F.when(trimmed.rlike(shape), F.date_format(read, "yyyy-MM-dd")))
    return F.when(text == "", None).otherwise(F.coalesce(*tried, trimmed))


def is_iso_date(text: Column) -> Column:
    """Null and empty are fine."""
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.when(text.isNull() | (text == ""), True).otherwise(F.coalesce(F.date_format(day, "yyyy-MM-dd") == text, F.lit(False)))


def positive_quantity(value: Column) -> Column:
    """At least one; what can't be read is one."""
    return F.greatest(F.coalesce(value.try_cast("int"), F.lit(1)), F.lit(1))


#: A quantity before a name, and a set with a number behind it.
QUANTITY = r"^\s*(\d+)\s*(?:[xX]\s*)?(.+?)\s*$"
SET_SUFFIX = r"\s+\([A-Za-z0-9]{2,8}\)\s+[A-Za-z0-9-]+\s*$"


def parsed_line(line: Column) -> Column:
    """struct(sideboard, quantity, name) of `SB: 2x name`; null for blanks and comments.  A quantity of nought is one."""
    body = F.regexp_replace(line, r"^\s+|\s+$", "")
    rest = F.regexp_replace(body, r"^(?i:sb):\s*", "")
    counted = rest.rlike(QUANTITY)
    quantity = F.when(counted, F.greatest(F.lit(1), F.coalesce(F.regexp_extract(rest, QUANTITY, 1).try_cast("int"), F.lit(1)))).otherwise(1)
    name = F.when(counted, F.regexp_extract(rest, QUANTITY, 2)).otherwise(rest)
    return F.when((body != "") & ~body.rlike("^(#|//)"), F.struct(body.rlike("^(?i:sb):").alias("sideboard"), quantity.alias("quantity"), name.alias("name")))


def without_set_suffix(name: Column) -> Column:
    return F.regexp_replace(name, SET_SUFFIX, "")


def fill_forward(df: DataFrame, group: list[str], order: str, value: Column, out: str) -> DataFrame:
    """df with the last non-null value so far."""
    along = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(along))


#: Headings that open a zone of a list.
ZONES = {"commander": "commanders", "commanders": "commanders", "deck": "mainboard", "mainboard": "mainboard", "sideboard": "sideboard", "companion": "companion", "maybeboard": "ignored"}


def zones(df: DataFrame, key: str, text: str, initial: str = "mainboard") -> DataFrame:
    """key, zone, name, quantity of sectioned lists: a heading holds until the next, `SB:` for its line only."""
    lines = df.select(key, F.posexplode(F.split(text, "\r\n|[\n\r\u000b\u000c\u0085\u2028\u2029]")).alias("pos", "line"))
    word = F.regexp_replace(F.lower(F.regexp_replace("line", r"^\s+|\s+$", "")), ":+$", "")
    heading = F.lit(None).cast("string")
    for name, zone in ZONES.items():
        heading = F.when(word == name, zone).otherwise(heading)
    marked = fill_forward(lines.withColumn("__h", heading), [key], "pos", F.col("__h"), "__zone")
    entry = marked.where(F.col("__h").isNull()).withColumn("e", parsed_line(F.col("line"))).where("e is not null")
    zone = F.when(F.col("e.sideboard"), "sideboard").otherwise(F.coalesce("__zone", F.lit(initial)))
    return entry.withColumn("zone", zone).where("zone <> 'ignored'").groupBy(key, "zone", F.col("e.name").alias("name")).agg(F.sum("e.quantity").alias("quantity"))


def tags(text: Column, patterns: dict[str, str], default: str | None = None) -> Column:
    """Sorted names of the patterns found, or the default alone."""
    found = F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()))))
    return found if default is None else F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def evidence(text: Column, patterns: dict[str, str]) -> Column:
    """map of pattern name to the text it matched first."""
    entries = F.array_compact(F.array(*(F.when(text.rlike(p), F.struct(F.lit(n).alias("key"), F.regexp_extract(text, p, 0).alias("value"))) for n, p in patterns.items())))
    return F.map_from_entries(entries)


def without_names(text: Column, names: Column) -> Column:
    """Each of the names, longest first, replaced by [SELF] where it stands as words, in any case."""
    longest = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    quoted = lambda n: F.concat(F.lit(r"(?i)(?<!\w)\Q"), n, F.lit(r"\E(?!\w)"))
    return F.aggregate(longest, text, lambda t, n: F.regexp_replace(t, quoted(n), F.lit("[SELF]")))


def frequency_bucket(n: Column) -> Column:
    return F.when(n < 10, "<10").when(n < 100, "<100").when(n < 1000, "<1000").when(n < 10000, "<10000").otherwise(">=10000")


def log_bucket(n: Column) -> Column:
    return F.floor(F.log10(F.greatest(n, F.lit(1)))).cast("int")


def in_domain(value: Column, most: float) -> Column:
    """missing_or_invalid, negative, above_primary_range or included; nothing is clipped."""
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), "missing_or_invalid").when(n < 0, "negative").when(n > most, "above_primary_range").otherwise("included")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))


def url_parts(url: Column) -> Column:
    return F.struct(F.try_parse_url(url, F.lit("HOST")).alias("host"), F.try_parse_url(url, F.lit("PATH")).alias("path"), F.try_parse_url(url, F.lit("QUERY"), F.lit("page")).alias("page"))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"\s+", " "))


def plural(word: Column, n: Column) -> Column:
    #: Small numbers as words.
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
    shown = F.coalesce(F.get(F.array(*map(F.lit, names)), n.cast("int")), n.cast("string"))
    return F.concat_ws(" ", shown, F.when(n == 1, word).otherwise(F.concat(word, F.lit("s"))))


#: Seconds before the first tries anew.
RETRY_DELAYS = (60, 300, 900)


def retry_delay(exit_code: Column, attempt: Column, blocked: Column, most: int = 3) -> Column:
    """Seconds before a job that ended with exit_code runs again (attempt: from 0); null where it must not: only code 1 is tried anew, so often and no more."""
    delay = F.get(F.array(*map(F.lit, RETRY_DELAYS[:most])), attempt.cast("int"))
    return F.when((exit_code == 1) & ~blocked, delay)


def warm_up(step: Column, steps: int, most: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), step / steps)) * most
