"""Records of nested lists: older shapes brought to one, zones, contexts, catalogues and hyperedges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import lookup_key, name_key, native_key, normal_date, positive_quantity

ENTRY = "struct<name:string,quantity:int,oracle_id:string>"
#: Sites that a record's words, address or own keys name, keys of metadata with their older spellings, and further ones that are taken over.
SITES = {"moxfield": ("user_bracket", "auto_bracket"), "mtgtop8": ("mtgo_url", "cmds")}
METADATA = {"user_bracket": ("user_bracket", "userBracket"), "auto_bracket": ("auto_bracket", "autoBracket"), "placement": ("placement",), "players": ("players",), "hubs": ("hubs", "hubNames")}
MORE = ("bracket", "is_autobracket", "placement_of", "mtgo_url")
#: Where a source keeps its boards, in the order in which they are looked for.
BOARDS = {
    "moxfield": {"mainboard": ("mainboard", "main"), "commanders": ("commanders", "cmds")},
    "mtgtop8": {"mainboard": ("main", "mainboard"), "commanders": ("cmds", "commanders", "commander")},
    "": {"mainboard": ("mainboard", "main", "cards"), "commanders": ("commanders", "cmds", "commander")},
}


def board_entries(board: Column) -> Column:
    """Entries of a board in JSON: a list of names or of objects, or a map of names to quantities or to objects.  One entry for each name key, quantities summed, the first spelling kept."""

    def field(e: Column, *names: str) -> Column:
        return F.coalesce(*(F.get_json_object(e, f"$.{n}") for n in names))

    quantity = lambda e: positive_quantity(field(e, "quantity", "qty", "q"))
    entry = lambda name, q, oracle: F.struct(F.trim(name).alias("name"), q.alias("quantity"), oracle.alias("oracle_id"))
    none = F.lit(None).cast("string")

    def listed(e: Column) -> Column:
        own = entry(F.coalesce(F.nullif(field(e, "name", "n"), F.lit("")), field(e, "card.name")), quantity(e), F.nullif(field(e, "oracle_id"), F.lit("")))
        return F.when(e.startswith("{"), own).when(~e.startswith("["), entry(e, F.lit(1), none))

    def mapped(e: Column) -> Column:
        return entry(e["key"], F.when(e["value"].startswith("{"), quantity(e["value"])).otherwise(positive_quantity(e["value"])), none)

    text = F.trim(board)
    found = F.when(text.startswith("["), F.transform(F.from_json(text, "array<string>"), listed)).when(text.startswith("{"), F.transform(F.map_entries(F.from_json(text, "map<string,string>")), mapped))
    keyed = F.transform(F.filter(F.coalesce(found, F.array().cast(f"array<{ENTRY}>")), lambda e: e["name"].isNotNull()), lambda e: F.struct(native_key(e["name"]).alias("key"), e.alias("e")))
    kept = F.filter(keyed, lambda x: x["key"] != "")

    def total(key: Column) -> Column:
        same = F.filter(kept, lambda x: x["key"] == key)
        return F.struct(same[0]["e"]["name"].alias("name"), F.aggregate(same, F.lit(0), lambda n, x: n + x["e"]["quantity"]).alias("quantity"), same[0]["e"]["oracle_id"].alias("oracle_id"))

    return F.transform(F.array_distinct(F.transform(kept, lambda x: x["key"])), total)


def infer_source(hint: str | None, source: Column, url: Column, keys: Column) -> Column:
    """The hint without dashes, the site that the record's own word, address or keys name, its own word, or `local`."""
    if hint:
        return F.lit(hint.lower().replace("-", ""))
    word, where = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    out = F.when(word == "", "local").otherwise(word)
    for site, own in reversed(SITES.items()):
        out = F.when(word.contains(site) | where.contains(site) | F.arrays_overlap(keys, F.array(*map(F.lit, own))), site).otherwise(out)
    return out


def deck_fingerprint(commanders: Column, mainboard: Column, sideboard: Column) -> Column:
    """SHA-256 of the JSON of sorted name keys and quantities, `commanders` and all other `cards`: order, spelling and splitting of entries don't matter."""

    def pairs(entries: Column) -> Column:
        quoted = lambda k: F.regexp_replace(F.regexp_replace(k, r"\\", r"\\\\\\\\"), '"', r'\\\\"')
        shown = lambda e: F.concat(F.lit('["'), quoted(e["key"]), F.lit('",'), e["q"].cast("string"), F.lit("]"))
        return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(entries), shown), ","), F.lit("]"))

    keyed = lambda b: F.transform(b, lambda e: F.struct(native_key(e["name"]).alias("key"), e["quantity"].alias("q")))
    cards = keyed(F.concat(mainboard, sideboard))
    total = lambda k: F.struct(k.alias("key"), F.aggregate(F.filter(cards, lambda e: e["key"] == k), F.lit(0), lambda n, e: n + e["q"]).alias("q"))
    summed = F.transform(F.array_distinct(F.transform(cards, lambda e: e["key"])), total)
    return F.sha2(F.concat(F.lit('{"commanders":'), pairs(keyed(commanders)), F.lit(',"cards":'), pairs(summed), F.lit("}")), 256)


def normalized(raw: DataFrame, text: str, hint: str | None = None, version: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of this schema version from JSON texts: records of it, of either site's older shapes, and others.  keep: columns of raw to go with them."""
    get = lambda *names: F.coalesce(*(F.get_json_object(text, f"$.{n}") for n in names))
    current = F.coalesce(get("schema_version").try_cast("int") == version, F.lit(False))
    url, source = get("url", "deck_url"), infer_source(hint, get("source"), get("url", "deck_url"), F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")))
    own = F.coalesce(get("source_id"), F.when(source == "moxfield", get("id")).otherwise(get("deck_id")), F.when(current, F.regexp_replace(get("deck_id"), "^[^:]*:", "")))
    own = F.nullif(F.when(current & get("source_id").isNull() & (source != "moxfield"), F.regexp_replace(own, "^[^:]*:", "")).otherwise(own), F.lit(""))

    def board(zone: str) -> Column:
        of = lambda site: get(*BOARDS[site][zone])
        return board_entries(F.when(current, get(zone)).when(source == "moxfield", of("moxfield")).when(source == "mtgtop8", of("mtgtop8")).otherwise(of("")))

    inner = F.coalesce(F.from_json(get("metadata"), "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    known = {k: F.coalesce(F.try_element_at(inner, F.lit(k)), get(*old), *([F.lit("[]")] if k == "hubs" else [])) for k, old in METADATA.items()}
    more = {k: F.coalesce(F.try_element_at(inner, F.lit(k)), get(k)) for k in MORE}
    rest = F.map_filter(inner, lambda k, _: ~k.isin(*METADATA, *MORE))
    named = F.map_filter(F.create_map(*(x for k, v in (known | more).items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull() | k.isin(*METADATA))
    main, heads, side = board("mainboard"), board("commanders"), board_entries(get("sideboard"))
    made = raw.select(
        *keep, F.lit(version).alias("schema_version"), F.when(current, F.nullif(get("deck_id"), F.lit(""))).alias("__deck"), source.alias("source"), own.alias("source_id"), F.coalesce(F.nullif(url, F.lit("")), F.when((source == "moxfield") & own.isNotNull(), F.concat(F.lit("https://www.moxfield.com/decks/"), own))).alias("url"),
        get("name").alias("name"), F.lower(F.coalesce(get("format"), F.lit("commander"))).alias("format"), normal_date(get("date", "createdAt")).alias("date"), heads.alias("commanders"), main.alias("mainboard"), side.alias("sideboard"), board_entries(get("companions")).alias("companions"), F.map_concat(rest, named).alias("metadata"),
    )
    content = F.concat(F.lit("content-"), F.substr(deck_fingerprint(F.col("commanders"), F.col("mainboard"), F.col("sideboard")), F.lit(1), F.lit(16)))
    return made.withColumn("deck_id", F.coalesce("__deck", F.concat_ws(":", "source", F.coalesce("source_id", content)))).drop("__deck")


def known_entries(board: Column, names: Column) -> Column:
    """Entries whose name key is among an array of known keys (for small dictionaries; a semi-join of exploded entries otherwise)."""
    return F.filter(board, lambda e: F.array_contains(names, native_key(e["name"])))


def sane_context(items: Column) -> Column:
    """Sorted distinct keys; null if any element is null or blank."""
    fine = F.forall(items, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.when(fine, F.array_sort(F.array_distinct(F.transform(items, lambda x: F.lower(F.trim(x))))))


def flattened(records: DataFrame, key: str, zones: tuple[str, ...] = ("mainboard", "commanders", "sideboard")) -> DataFrame:
    """key, zone, pos, name, quantity of all zones, in one pass over the records."""
    boards = F.array(*(F.struct(F.lit(z).alias("zone"), F.col(z).alias("board")) for z in zones))
    return records.select(key, F.explode(boards).alias("b")).select(key, "b.zone", F.posexplode("b.board").alias("pos", "e")).select(key, "zone", "pos", "e.name", "e.quantity")


def all_names(cards: DataFrame) -> DataFrame:
    """Distinct keys of names and of faces."""
    faces = F.coalesce(F.transform("card_faces", lambda f: f["name"]), F.array().cast("array<string>"))
    return cards.select(F.explode(F.array_union(F.array("name"), faces)).alias("n")).select(name_key(F.col("n")).alias("key")).where("key is not null and key <> ''").distinct()


def last_by_key(cards: DataFrame, order: str) -> DataFrame:
    """The last card of each lookup key."""
    rest = F.struct(*cards.columns)
    return cards.groupBy(lookup_key(F.col("name")).alias("key")).agg(F.max_by(rest, F.col(order)).alias("r")).select("key", "r.*")


def words_of_type(line: Column, part: int) -> Column:
    """Words before (1) or behind (2) the long dash of a type line."""
    return F.filter(F.split(F.lower(F.trim(F.split_part(line, F.lit("—"), F.lit(part)))), r"\s+"), lambda w: w != "")


def structural_signature(colors: Column, line: Column, cost: Column, supertypes: tuple[str, ...] = ("basic", "legendary", "snow", "world", "token")) -> Column:
    """struct of sorted colours, types without supertypes, whole cost; null for costs outside 0 to 20."""
    types = F.array_except(words_of_type(line, 1), F.array(*map(F.lit, supertypes)))
    return F.when((cost >= 0) & (cost <= 20), F.struct(F.array_sort(colors).alias("colors"), F.array_sort(types).alias("types"), F.floor(cost).alias("cost")))


def hyperedges(variants: DataFrame, names: DataFrame) -> DataFrame:
    """id, cards (sorted), eligible, reasons: edges whose members all are known.

    variants: id, members array<string>; names: key, one row each.
    """
    rows = variants.select("id", F.explode_outer("members").alias("m")).join(names.select(F.col("key").alias("__k")), F.lower(F.trim("m")) == F.col("__k"), "left")
    per = rows.groupBy("id").agg(F.array_sort(F.collect_set("__k")).alias("cards"), F.count_if(F.col("__k").isNull()).alias("unknown"))
    reasons = F.array_compact(F.array(F.when(F.col("unknown") > 0, F.lit("unknown_member")), F.when(F.size("cards") < 2, F.lit("too_small"))))
    return per.select("id", "cards", (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"))


def pairs_of_roles(left: DataFrame, right: DataFrame, rule: Column) -> DataFrame:
    """Rows of left and right that may stand together; the rule should hold an equality, so that it can be hashed."""
    return left.join(right, rule)
