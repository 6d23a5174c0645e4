"""Recorded exports and payloads of deck sites: text lists, nested JSON, and what a result page must show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import fill_forward, positive_quantity

#: Formats whose side list is the command zone, headings and the zones they open, and numbers and letters of formats and colours.
COMMAND_FORMATS = ("commander", "cedh", "duel-commander", "mtgo-commander", "pauper-commander")
HEADINGS = {"deck": "mainboard", "mainboard": "mainboard", "sideboard": "sideboard", "commander": "commanders", "commanders": "commanders", "companion": "companions", "companions": "companions"}
FOLDER_FORMATS = {1: "standard", 2: "modern", 3: "commander", 4: "legacy", 5: "vintage", 6: "pauper"}
COLORS = {"1": "W", "2": "U", "3": "B", "4": "R", "5": "G", "6": "colorless"}
SUB_DECKS = {"maindeck": "mainboard", "sideboard": "sideboard", "commanders": "commanders", "commander": "commanders", "companion": "companions"}
BOARDS = ("mainboard", "sideboard", "commanders", "companions")
EXPORT_LINE = r"^\s*(\d+)x?\s+(?:\[[^\]]*\]\s*)?(.+?)\s*$"


def export_entries(df: DataFrame, key: str, text: str, format_name: str) -> DataFrame:
    """key, zone, pos, name, quantity of text exports: a heading or an `SB:` holds until the next, and in formats with a command zone the side list is that zone."""
    lines = df.select(key, F.col(format_name).alias("__f"), F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("pos", "__l")).withColumn("__l", F.regexp_replace("__l", r"^\s+|\s+$", ""))
    lines = lines.where((F.col("__l") != "") & ~F.col("__l").startswith("//"))
    side = F.when(F.col("__f").isin(*COMMAND_FORMATS), "commanders").otherwise("sideboard")
    rest = F.regexp_replace("__l", r"^(?i:sb):\s*(?=\S)", "")
    word = F.regexp_replace(F.lower(rest), ":+$", "")
    zone = F.when(word == "sideboard", side)
    for heading, opened in HEADINGS.items():
        zone = zone if heading == "sideboard" else zone.when(word == heading, opened)
    opened = F.coalesce(zone, F.when(rest != F.col("__l"), side))
    marked = fill_forward(lines.withColumns({"__r": rest, "__o": opened, "__h": word.isin(*HEADINGS)}), [key], "pos", F.col("__o"), "zone")
    entries = marked.where(~F.col("__h") & F.col("__r").rlike(EXPORT_LINE))
    return entries.select(key, F.coalesce("zone", F.lit("mainboard")).alias("zone"), "pos", F.regexp_extract("__r", EXPORT_LINE, 2).alias("name"), positive_quantity(F.regexp_extract("__r", EXPORT_LINE, 1)).alias("quantity"))


def board_payload(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, zone, name, quantity of payloads whose boards hold cards by id: {boards: {zone: {cards: {id: {quantity, card: {name}}}}}}; other boards are left out."""
    schema = "struct<boards:map<string,struct<cards:map<string,struct<quantity:string,name:string,card:struct<name:string>>>>>>"
    rows = df.select(key, F.explode(F.from_json(payload, schema)["boards"]).alias("zone", "b")).where(F.col("zone").isin(*BOARDS))
    cards = rows.select(key, "zone", F.explode("b.cards").alias("id", "c"))
    return cards.select(key, "zone", F.coalesce("c.card.name", "c.name").alias("name"), positive_quantity(F.coalesce("c.quantity", F.lit("1"))).alias("quantity")).where("coalesce(name, '') <> ''")


def folder_payload(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, format, zone, name, quantity of decks with categories: a commander goes before a companion, it before the side list, and what no included category holds is left out."""
    schema = "struct<deckFormat:int,categories:array<struct<name:string,includedInDeck:boolean>>,cards:array<struct<deletedAt:string,companion:boolean,categories:array<string>,quantity:int,card:struct<oracleCard:struct<name:string>>>>>"
    formats = F.create_map(*(F.lit(x) for pair in FOLDER_FORMATS.items() for x in pair))
    decks = df.select(key, F.from_json(payload, schema).alias("d")).select(key, F.try_element_at(formats, F.col("d.deckFormat")).alias("format"), F.transform(F.filter("d.categories", lambda c: F.coalesce(c["includedInDeck"], F.lit(False))), lambda c: c["name"]).alias("__in"), F.explode("d.cards").alias("e"))
    cats = F.coalesce("e.categories", F.array().cast("array<string>"))
    zone = F.when(F.array_contains(cats, "Commander"), "commanders").when(F.coalesce("e.companion", F.lit(False)), "companions").when(F.array_contains(cats, "Sideboard"), "sideboard").when(F.arrays_overlap(cats, F.col("__in")), "mainboard")
    kept = decks.where(F.col("e.deletedAt").isNull() & F.col("format").isNotNull()).withColumn("zone", zone).where("zone is not null")
    return kept.select(key, "format", "zone", F.col("e.card.oracleCard.name").alias("name"), "e.quantity")


def creator_payload(df: DataFrame, key: str, payload: str, author: str) -> DataFrame:
    """key, format, zone, name, quantity of decks of an author whose sub-decks name cards by id, with the cards beside them."""
    schema = "struct<deck:struct<playerName:string,game:string,format:string,subDecks:map<string,array<struct<cardID:bigint,quantity:int>>>>,cards:map<string,struct<name:string>>>"
    zones = F.create_map(*(F.lit(x) for pair in SUB_DECKS.items() for x in pair))
    decks = df.select(key, F.from_json(payload, schema).alias("d")).where((F.lower("d.deck.playerName") == author.lower()) & (F.col("d.deck.game") == "magic"))
    rows = decks.select(key, F.lower("d.deck.format").alias("format"), F.col("d.cards").alias("__c"), F.explode("d.deck.subDecks").alias("__s", "l")).select(key, "format", "__c", F.try_element_at(zones, F.col("__s")).alias("zone"), F.explode("l").alias("e"))
    return rows.where("zone is not null").select(key, "format", "zone", F.try_element_at("__c", F.col("e.cardID").cast("string"))["name"].alias("name"), "e.quantity")


def whole_records(entries: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """entries of records all of whose copies have known names; a record with any other is left out whole.  names: name, one row each."""
    known = entries.join(names.select(F.col("name").alias("__n")).distinct(), F.col("name") == F.col("__n"), "left")
    bad = known.where("__n is null").select(key).distinct()
    return known.join(bad, key, "left_anti").drop("__n")


def sample_color(job: Column) -> Column:
    """The colour that a search's key names in its second part."""
    code = F.split_part(job, F.lit(":"), F.lit(2))
    names = F.create_map(*(F.lit(x) for pair in COLORS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), F.when(code.contains("."), "multicolor").otherwise("all"))


def result_count(page_text: Column) -> Column:
    """The number before `decks matching`; null where a page doesn't say."""
    return F.nullif(F.replace(F.regexp_extract(page_text, r"([\d,]+)\s+decks matching", 1), F.lit(",")), F.lit("")).try_cast("long")


def shown_page(page_text: Column) -> Column:
    """The number behind `Page`; null where a page doesn't say."""
    return F.regexp_extract(page_text, r"\bPage\s+(\d+)", 1).try_cast("int")


def checkpoint_format(path: Column) -> Column:
    """The format that a checkpoint's file name says; the one with a command zone where it names none."""
    stem = F.regexp_replace(F.element_at(F.split(path, "[/\\\\\\\\]"), -1), r"\.[^.]*$", "")
    named = F.regexp_extract(stem, r"^attention_oracleid_v2_(modern|legacy)_", 1)
    return F.when(named == "", "commander").otherwise(named)


def serving_checkpoints(files: DataFrame, path: str = "path", time: str = "modificationTime") -> DataFrame:
    """format, path: of each format the preferred file: premium, then static, then fine-tuned ones, then the last written, then by name."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    preference = F.struct(stem.contains("_premium_").alias("a"), stem.contains("_static_").alias("b"), stem.contains("finetuned").alias("c"), F.col(time).alias("d"), F.col(path).alias("e"))
    return files.groupBy(checkpoint_format(F.col(path)).alias("format")).agg(F.max_by(path, preference).alias("path"))
