"""Lexical effects of rules texts: tags with the words that show them, serialisations of a card, reasons why two are hard negatives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as tx

#: The patterns of each field's tags, on lower-case text in which the card's own names read [self].
ACTIONS = {
    "counter": r"\bcounter target (?:\w+ )*spell", "destroy": r"\bdestroy\b", "exile": r"\bexile\b", "return": r"\breturn\b", "draw": r"\bdraw\b", "discard": r"\bdiscard\b", "search": r"\bsearch\b", "add_mana": r"\badd (?:\{|\w+ mana)", "copy": r"\bcopy\b",
    "sacrifice": r"\bsacrifice\b", "create_token": r"\bcreate\b[^.]*\btoken", "mill": r"\bmill\b", "damage": r"\bdeals?\b[^.]*\bdamage\b", "gain_life": r"\bgain\b[^.]*\blife\b", "blink": r"\bexile\b[^.]*\breturn\b",
    "reanimate": r"\breturn\b[^.]*\bgraveyard\b[^.]*\bbattlefield\b",
}
TARGETS = {t: rf"\b{t}\b" for t in ("spell", "creature", "permanent", "artifact", "enchantment", "planeswalker", "player")} | {"graveyard_card": r"\bcard\b[^.]*\bgraveyard\b"}
RESTRICTIONS = {
    "nonland": r"\bnonland\b", "noncreature": r"\bnoncreature\b", "mana_value_bound": r"\bmana value\b[^.]*?(?:less|greater|equal)", "color_restriction": r"\b(?:white|blue|black|red|green|colorless|multicolored) (?:spell|creature|permanent)", "tapped": r"\btapped\b",
    "untapped": r"\buntapped\b", "attacking": r"\battacking\b", "blocking": r"\bblocking\b", "controller": r"\b(?:you|they) control\b", "owner": r"\bowner'?s?\b", "once_per_turn": r"\bonly once each turn\b", "timing_condition": r"\b(?:only during|only as a sorcery)\b",
    "conditional": r"\b(?:if|unless)\b", "symmetric": r"\b(?:all|each) (?:creature|player|permanent)",
}
SPEEDS = {"activated": r":", "triggered": r"\b(?:when|whenever|at the beginning)\b", "static": r"\b(?:have|has|gets?|costs?)\b"}
RESOURCES = {"cards": r"\b(?:draw|discard)\b", "mana": r"\b(?:mana|add \{)\b", "life": r"\blife\b", "treasure": r"\btreasure\b", "tokens": r"\btokens?\b"}
SECONDARY = {"draw": r"\bdraw\b", "life_loss": r"\blose\b[^.]*\blife\b", "self_exile": r"\bexile \[self\]", "tokens": r"\bcreate\b[^.]*\btoken", "recursion": r"\breturn\b[^.]*\bgraveyard\b"}
REPLACEMENT = {"instead": r"\binstead\b", "return_to_hand": r"\b(?:return|put)\b[^.]*\bhand\b"}
FIELDS = {"actions": ("action", ACTIONS), "targets": ("target", TARGETS), "restrictions": ("restriction", RESTRICTIONS), "speed": ("speed", SPEEDS), "resources": ("resource", RESOURCES), "secondary": ("secondary", SECONDARY), "replacement": ("replacement", REPLACEMENT)}
MARKERS = ("[CARD]", "[MANA]", "[TYPE]", "[TEXT]", "[PT]", "[LOYALTY]", "[DEFENSE]", "[FACE]", "[SELF]", "[COST]", "[ACTION]", "[TARGET]", "[RESTRICTION]", "[RESOURCE]", "[SPEED]", "[SECONDARY]", "[REPLACEMENT]")
SHOWN = {"actions": "[ACTION]", "targets": "[TARGET]", "restrictions": "[RESTRICTION]", "resources": "[RESOURCE]", "speed": "[SPEED]", "secondary": "[SECONDARY]", "replacement": "[REPLACEMENT]"}


def rules_text(name: Column, text: Column, faces: Column) -> Column:
    """The texts of all faces, a line each, or the card's own; every name of it reads [SELF]."""
    whole = F.when(F.size(faces) > 0, F.array_join(F.transform(faces, lambda f: F.coalesce(f["oracle_text"], F.lit(""))), "\n")).otherwise(F.coalesce(text, F.lit("")))
    names = F.array_distinct(F.filter(F.concat(F.array(name), F.coalesce(F.transform(faces, lambda f: f["name"]), F.array().cast("array<string>"))), lambda n: F.coalesce(n, F.lit("")) != ""))
    return F.regexp_replace(tx.without_names(whole, names), r"^\s+|\s+$", "")


def signature(rules: Column, line: Column, cost: Column) -> Column:
    """struct of the sorted tags of each field, mana_value, and `evidence`: field and tag to the words that matched first."""
    low = F.lower(rules)
    kinds = [F.when(F.lower(line).contains(k), F.lit(k)) for k in ("instant", "sorcery")]
    tags = {f: tx.tags(low, patterns) for f, (_, patterns) in FIELDS.items()}
    tags["speed"] = F.array_sort(F.array_compact(F.concat(F.array(*kinds), tags["speed"])))
    shown = [F.when(low.rlike(p), F.struct(F.lit(f"{name}:{tag}").alias("key"), F.regexp_extract(low, p, 0).alias("value"))) for name, patterns in FIELDS.values() for tag, p in patterns.items()]
    shown += [F.when(k.isNotNull(), F.struct(F.concat(F.lit("speed:"), k).alias("key"), line.alias("value"))) for k in kinds]
    return F.struct(*(v.alias(f) for f, v in tags.items()), cost.cast("double").alias("mana_value"), F.map_from_entries(F.array_compact(F.array(*shown))).alias("evidence"))


def normalized_view(sig: Column, line: Column) -> Column:
    """A line each for the type, the cost and the tags of every field that has some."""
    parts = [F.concat(F.lit("[TYPE] "), F.lower(F.coalesce(line, F.lit("")))), F.when(sig["mana_value"].isNotNull(), F.concat(F.lit("[COST] "), sig["mana_value"].cast("string")))]
    parts += [F.when(F.size(sig[f]) > 0, F.concat(F.lit(f"{m} "), F.array_join(sig[f], ", "))) for f, m in SHOWN.items()]
    return F.concat_ws("\n", *parts)


def structured_view(name: Column, faces: Column) -> Column:
    """[CARD], then each face's cost, type and text behind markers, names hidden.  faces: array<struct<name,mana_cost,type_line,oracle_text>>, of a plain card the card itself."""

    def face(f: Column, i: Column) -> Column:
        own = rules_text(F.coalesce(f["name"], name), f["oracle_text"], F.array().cast("array<struct<name:string,oracle_text:string>>"))
        some = lambda marker, value, there: F.when(F.coalesce(there, F.lit("")) != "", F.concat(F.lit(f"[{marker}] "), value))
        return F.concat_ws("\n", F.when(i > 0, F.lit("[FACE]")), some("MANA", f["mana_cost"], f["mana_cost"]), some("TYPE", f["type_line"], f["type_line"]), some("TEXT", own, f["oracle_text"]))

    return F.concat_ws("\n", F.lit("[CARD]"), F.array_join(F.filter(F.transform(faces, face), lambda x: x != ""), "\n"))


def symbols(text: Column) -> Column:
    """Distinct symbols in braces, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{[^{}\s]+\}"), F.lit(0))))


def markers(text: Column) -> Column:
    """Distinct field markers, sorted."""
    return F.array_sort(F.array_intersect(F.regexp_extract_all(text, F.lit(r"\[[A-Z_]+\]"), F.lit(0)), F.array(*map(F.lit, MARKERS))))


def folded_rules(rules: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(rules), r"\s+", " "))


def description(rules: Column, line: Column, cost: Column) -> Column:
    """One sentence of cost, type and rules."""
    whole = F.when(cost == F.floor(cost), cost.cast("long").cast("string")).otherwise(cost.cast("string"))
    return F.concat(F.when(cost.isNotNull(), F.concat(whole, F.lit("-mana "))).otherwise(""), F.lower(F.coalesce(line, F.lit("card"))), F.lit(" with these rules: "), rules)


def hard_negative_reasons(a: Column, b: Column) -> Column:
    """In what two signatures differ, in order."""
    one_has = lambda field, tag: F.array_contains(a[field], tag) != F.array_contains(b[field], tag)
    both = F.concat(a["actions"], b["actions"])
    checks = {
        "same_role_wrong_target": a["targets"] != b["targets"], "same_effect_missing_cantrip": one_has("secondary", "draw"),
        "destroy_vs_exile": F.array_contains(both, "destroy") & F.array_contains(both, "exile") & (a["actions"] != b["actions"]), "temporary_vs_permanent_answer": one_has("replacement", "return_to_hand"),
        "mana_cost_mismatch": F.abs(a["mana_value"] - b["mana_value"]) >= 2, "timing_mismatch": a["speed"] != b["speed"], "restriction_mismatch": a["restrictions"] != b["restrictions"], "replacement_mismatch": a["replacement"] != b["replacement"],
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
