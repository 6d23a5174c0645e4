"""Effects of rules texts, and recorded exports and payloads."""

import json

from pyspark.sql import functions as F

from sparkloom.functions import effects, exports

FACES = "array<struct<name:string,mana_cost:string,type_line:string,oracle_text:string>>"


def test_effects(spark):
    cards = [
        ("Remand", "Instant", 2.0, "Counter target spell. If that spell is countered this way, put it into its owner's hand instead.\nDraw a card.", None),
        ("Bolt", "Instant", 1.0, "Bolt deals 3 damage to any target.", None),
        ("Fire // Ice", "Instant // Instant", 4.0, None, [("Fire", "{1}{R}", "Instant", "Fire deals 2 damage."), ("Ice", "{1}{U}", "Instant", "Tap target permanent.\nDraw a card.")]),
        ("Ash", "Sorcery", None, "Destroy all creatures. Exile Ash.", None),
    ]
    df = spark.createDataFrame(cards, f"name string, line string, cost double, text string, faces {FACES}").withColumn("rules", effects.rules_text(F.col("name"), F.col("text"), F.col("faces")))
    df = df.withColumn("sig", effects.signature(F.col("rules"), F.col("line"), F.col("cost")))
    got = {r.name: r for r in df.select("name", "rules", "sig", effects.normalized_view(F.col("sig"), F.col("line")).alias("view"), effects.description(F.col("rules"), F.col("line"), F.col("cost")).alias("said")).collect()}
    remand, bolt, fire, ash = (got[c[0]] for c in cards)
    assert remand.sig.actions == ["counter", "draw"] and remand.sig.replacement == ["instead", "return_to_hand"] and remand.sig.speed == ["instant"] and remand.sig.restrictions == ["conditional", "owner"]
    assert remand.sig.evidence["action:counter"] == "counter target spell" and remand.sig.evidence["speed:instant"] == "Instant"
    assert bolt.rules == "[SELF] deals 3 damage to any target." and bolt.view == "[TYPE] instant\n[COST] 1.0\n[ACTION] damage\n[SPEED] instant" and bolt.said == "1-mana instant with these rules: [SELF] deals 3 damage to any target."
    assert fire.rules == "[SELF] deals 2 damage.\nTap target permanent.\nDraw a card."
    assert ash.sig.actions == ["destroy", "exile"] and ash.sig.secondary == ["self_exile"] and ash.sig.restrictions == ["symmetric"]
    shown = spark.createDataFrame([("Fire // Ice", cards[2][4])], f"name string, faces {FACES}").select(effects.structured_view(F.col("name"), F.col("faces")).alias("v")).withColumns({"m": effects.markers(F.col("v")), "s": effects.symbols(F.col("v"))}).first()
    assert shown.v == "[CARD]\n[MANA] {1}{R}\n[TYPE] Instant\n[TEXT] [SELF] deals 2 damage.\n[FACE]\n[MANA] {1}{U}\n[TYPE] Instant\n[TEXT] Tap target permanent.\nDraw a card."
    assert shown.m == ["[CARD]", "[FACE]", "[MANA]", "[SELF]", "[TEXT]", "[TYPE]"] and shown.s == ["{1}", "{R}", "{U}"]
    pair = df.where("name = 'Remand'").select(F.col("sig").alias("a")).crossJoin(df.where("name = 'Ash'").select(F.col("sig").alias("b")))
    reasons = pair.select(effects.hard_negative_reasons(F.col("a"), F.col("b")), effects.hard_negative_reasons(F.col("a"), F.col("a"))).first()
    assert reasons[0] == ["same_role_wrong_target", "same_effect_missing_cantrip", "destroy_vs_exile", "temporary_vs_permanent_answer", "timing_mismatch", "restriction_mismatch", "replacement_mismatch"] and reasons[1] == []


def test_exports(spark):
    text = "4 [ABC] Bolt\r\n2x Shock\n// no\nSB: 1 Boss\n1 Mate\nDeck\n1 Late\nCompanion:\n1 Pal\nodd"
    df = spark.createDataFrame([(1, text, "cedh"), (2, text, "modern"), (3, "", "modern")], "k int, t string, f string")
    got = {(r.k, r.zone, r.name, r.quantity) for r in exports.export_entries(df, "k", "t", "f").collect()}
    own = {("mainboard", "Bolt", 4), ("mainboard", "Shock", 2), ("mainboard", "Late", 1), ("companions", "Pal", 1)}
    assert got == {(1, *e) for e in own | {("commanders", "Boss", 1), ("commanders", "Mate", 1)}} | {(2, *e) for e in own | {("sideboard", "Boss", 1), ("sideboard", "Mate", 1)}}
    boards = {"boards": {"mainboard": {"cards": {"a": {"quantity": 2, "card": {"name": "Bolt"}}, "b": {"quantity": "x", "name": "Shock"}}}, "maybeboard": {"cards": {"c": {"quantity": 9, "card": {"name": "No"}}}}}}
    folder = {"deckFormat": 3, "categories": [{"name": "In", "includedInDeck": True}, {"name": "Out", "includedInDeck": False}], "cards": [
        {"categories": ["Commander", "Sideboard"], "quantity": 1, "card": {"oracleCard": {"name": "Boss"}}}, {"categories": ["Sideboard"], "companion": True, "quantity": 1, "card": {"oracleCard": {"name": "Pal"}}},
        {"categories": ["Sideboard"], "quantity": 2, "card": {"oracleCard": {"name": "Side"}}}, {"categories": ["In"], "quantity": 3, "card": {"oracleCard": {"name": "Main"}}}, {"categories": ["Out"], "quantity": 4, "card": {"oracleCard": {"name": "Maybe"}}},
        {"categories": ["In"], "deletedAt": "2024", "quantity": 3, "card": {"oracleCard": {"name": "Gone"}}}]}
    creator = {"deck": {"playerName": "ANN", "game": "magic", "format": "Modern", "subDecks": {"maindeck": [{"cardID": 7, "quantity": 4}], "commander": [{"cardID": 8, "quantity": 1}], "other": [{"cardID": 7, "quantity": 1}]}}, "cards": {"7": {"name": "Bolt"}, "8": {"name": "Boss"}}}
    one = lambda x: spark.createDataFrame([(1, json.dumps(x))], "k int, p string")
    assert {(r.zone, r.name, r.quantity) for r in exports.board_payload(one(boards), "k", "p").collect()} == {("mainboard", "Bolt", 2), ("mainboard", "Shock", 1)}
    assert {(r.format, r.zone, r.name, r.quantity) for r in exports.folder_payload(one(folder), "k", "p").collect()} == {("commander", "commanders", "Boss", 1), ("commander", "companions", "Pal", 1), ("commander", "sideboard", "Side", 2), ("commander", "mainboard", "Main", 3)}
    assert {(r.format, r.zone, r.name, r.quantity) for r in exports.creator_payload(one(creator), "k", "p", "Ann").collect()} == {("modern", "mainboard", "Bolt", 4), ("modern", "commanders", "Boss", 1)}
    assert exports.creator_payload(one(creator), "k", "p", "Bob").count() == 0
    entries = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "z")], "k int, name string")
    assert {(r.k, r.name) for r in exports.whole_records(entries, "k", spark.createDataFrame([("a",), ("b",)], "name string")).collect()} == {(1, "a"), (1, "b"), (2, "a")}


def test_page_texts(spark):
    rows = [("colors:1:name:a", "W"), ("colors:1.2:name:a", "multicolor"), ("colors:all:x", "all"), ("colors:6:x", "colorless")]
    assert [r[0] for r in spark.createDataFrame(rows, "k string, w string").select(exports.sample_color(F.col("k"))).collect()] == [w for _, w in rows]
    pages = spark.createDataFrame([("1,234 decks matching Page 3 of 9",), ("none",)], "t string").select(exports.result_count(F.col("t")), exports.shown_page(F.col("t"))).collect()
    assert [tuple(r) for r in pages] == [(1234, 3), (None, None)]
    files = [("/m/attention_oracleid_v2_modern_static_premium_1.pt", 1), ("/m/attention_oracleid_v2_modern_static_2.pt", 9), ("/m/attention_oracleid_v2_variational_finetuned_896.pt", 2), ("/m/attention_oracleid_v2_variational_frozen_896.pt", 3)]
    got = {r.format: r.path for r in exports.serving_checkpoints(spark.createDataFrame(files, "path string, modificationTime int")).collect()}
    assert got == {"modern": files[0][0], "commander": files[2][0]}
