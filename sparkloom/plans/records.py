"""Queries on records: deduplication, audits, lookups, rules, splits, families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import cooc, dedup, lookup, neardup, rules, split
from sparkloom.operators.graph import components, families
from sparkloom.sources.tables import read, shared_table

#: Status that a part's type stands for in the rule queries.
LEGAL = {"ECONOMY": "legal", "STANDARD": "legal", "SMALL": "legal", "MEDIUM": "legal", "LARGE": "restricted", "PROMO": "banned"}

#: Titles of the quality query.
TITLES = ("My Cube of", "cubes by", "Card Pool", "pool", "cardpool from", "The Collection", "binder", "inventory", "archetype reference", "Reference List", "reference", "all cards of", "merged list", "merged lists", "every database", "collections")


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.set_fingerprints(cooc.contexts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"))


def exact_dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text may be a third of all rows: counts and firsts are combined before the exchange, and joined back by digest."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fp"))
    per = docs.groupBy("fp").agg(F.min("doc_id").alias("lead"), F.count("*").alias("group_size"))
    joined = docs.join(per.withColumnRenamed("fp", "__fp"), F.col("fp").eqNullSafe(F.col("__fp")))  # texts that are null are one group
    return joined.select("doc_id", (F.col("doc_id") == F.col("lead")).cast("int").alias("kept"), "group_size")


def first_of_each_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("fp"))
    return dedup.keep_first(docs, ["fp"], "doc_id")


def two_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.concat_ws(":", "user_id", F.to_date("ts").cast("string")).alias("k1"), F.concat_ws(":", "event_type", F.date_format("ts", "dd HH")).alias("k2"))
    return dedup.two_key_first_wins(rows, "k1", "k2", "pos").select("pos", F.col("kept").cast("int").alias("kept"))


def set_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select("ctx", "n", "fingerprint")


def multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return dedup.multiset_fingerprints(rows, "l_orderkey", "l_partkey", "q")


def context_quarantine_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = dedup.context_status(_sets(spark, sf_dir), 2, 10)
    return judged.groupBy("status").agg(F.count("*").alias("contexts"))


def context_size_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sets(spark, sf_dir)
    marks = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    return sizes.agg(F.count("*").alias("contexts"), F.round(F.avg("n"), 6).alias("mean_r"), F.round(F.stddev_samp("n"), 6).alias("sd_r"), *(F.percentile("n", F.lit(m)).alias(f"p{int(100 * m)}") for m in marks))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles made of a phrase and the source; only some phrases say that a large context is no ordinary one."""
    title = F.concat_ws(" ", F.array(*map(F.lit, TITLES))[(F.col("doc_id") % len(TITLES)).cast("int")], F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(dedup.quality_reason(title, F.col("n_chars")), F.lit("")).alias("reason"))


def provenance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return dedup.provenance(_sets(spark, sf_dir), tags.select(F.col("o_orderkey").alias("ctx"), F.col("n_name").alias("label")))


def _parts_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the status, bits and copy limit that their parts stand for; the first line is the head."""
    status = F.lit(None).cast("string")
    for kind, value in LEGAL.items():
        status = F.when(F.col("p_type") == kind, value).otherwise(status)
    part = read(spark, sf_dir, "part").select("p_partkey", status.alias("status"), (F.col("p_size") % 32).alias("bits"), F.when(F.col("p_size") < 5, None).otherwise(40).alias("limit"))
    rows = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("q"), "status", "bits", "limit", F.when(F.col("l_linenumber") == 1, "head").otherwise("main").alias("role"))


def set_rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.set_issues(_parts_of_orders(spark, sf_dir), "l_orderkey", "l_partkey", "q", "status", "bits", 100, "limit")
    return found.groupBy("code").agg(F.count("*").alias("issues"), F.count_distinct("l_orderkey").alias("orders"))


def accept_reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each code, counted once an order; `accepted` for those without issues."""
    found = rules.set_issues(_parts_of_orders(spark, sf_dir), "l_orderkey", "l_partkey", "q", "status", "bits", 100, "limit")
    codes = found.groupBy("l_orderkey").agg(F.collect_set("code").alias("codes"))
    every = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("source")).join(codes, "l_orderkey", "left")
    made = dedup.report(every.withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))))
    totals = made["totals"].select(F.lit("accepted").alias("code"), F.col("accepted").alias("rows"))
    return made["codes"].unionByName(totals)


def remaining_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.remaining(_parts_of_orders(spark, sf_dir), "l_orderkey", "l_partkey", "q", "limit")


def identity_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts each brand's identity (the union of its small parts' bits) allows."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") % 32).alias("bits"))
    identity = part.where("p_type = 'SMALL'").groupBy("p_brand").agg(F.bit_or("bits").alias("identity"))
    by_bits = part.groupBy("bits").agg(F.count("*").alias("n"))  # at most 32 rows
    return identity.crossJoin(F.broadcast(by_bits)).where(rules.allowed_mask(F.col("bits"), F.col("identity"))).groupBy("p_brand", "identity").agg(F.sum("n").alias("allowed"))


def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested records, some with faults that their keys put in."""
    k = F.col("o_orderkey")
    entry = F.struct("l_linenumber", F.when(F.col("l_partkey") % 97 == 0, " A- / x").otherwise(F.col("l_partkey").cast("string")).alias("name"), (F.col("l_quantity").cast("int") - F.when(F.col("l_partkey") % 89 == 0, 60).otherwise(0)).alias("quantity"))
    zone = lambda status: F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == status, entry)))
    boards = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(zone("O").alias("mainboard"), zone("F").alias("sideboard"))
    none = F.array().cast("array<struct<name:string,quantity:int>>")
    records = read(spark, sf_dir, "orders").join(boards, k == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.when(k % 50 == 0, 2).when(k % 51 != 0, 1).alias("schema_version"), F.when(k % 30 == 0, "").otherwise(k.cast("string")).alias("deck_id"), F.when(k % 40 != 0, F.col("o_orderstatus")).alias("source"),
        F.when(k % 60 != 0, F.create_map(F.lit("a"), F.lit("b"))).alias("metadata"), "mainboard", "sideboard", F.when(F.col("mainboard").isNotNull(), none).alias("commanders"), F.when(k % 2 == 0, none).alias("companions"),
    )
    return records.select("o_orderkey", F.array_join(rules.record_issues(), "; ").alias("issues"))


def prioritized_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts found by key among one brand's, else by name and brand, else by name: the dearest first."""
    part = read(spark, sf_dir, "part")
    best = [F.desc("p_retailprice"), F.asc("p_partkey")]
    exact = lookup.best_of(part.where("p_brand = 'Brand#1'").withColumn("k", F.col("p_partkey").cast("string")), "k", best)
    alias = lookup.best_of(part.where("p_size > 25").withColumn("k", F.concat_ws("|", "p_name", "p_type")), "k", best)
    name = lookup.best_of(part.where("p_size > 40").withColumn("k", F.col("p_name")), "k", best)
    asked = part.select("p_partkey", F.col("p_partkey").cast("string").alias("k1"), F.concat_ws("|", "p_name", "p_type").alias("k2"), F.col("p_name").alias("k3"))
    value = lambda d: d.select("k", F.col("p_partkey").alias("v"))
    found = lookup.prioritized(asked, [("id", "k1", value(exact), "k"), ("alias", "k2", value(alias), "k"), ("name", "k3", value(name), "k")], "v")
    return found.select("p_partkey", "resolved", "how")


def unique_dimension_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumn("k", F.concat_ws("|", "p_name", "p_brand", "p_type"))
    keys = lookup.unique_keys(part, "k", "p_partkey")
    return keys.select("k", "identities", F.coalesce("identity", F.lit(-1)).alias("identity"))


def lookup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumn("k", F.concat_ws("|", "p_name", "p_brand"))
    known = part.where("p_size > 10")
    judged = lookup.coverage(part, known, "k", lookup.unique_keys(part, "k", "p_partkey"))
    return judged.groupBy("p_brand", "status").agg(F.count("*").alias("parts"))


def signature_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return lookup.signature_peers(part, ["p_brand", "p_type", "p_size"], "p_partkey").groupBy("a").agg(F.count("*").alias("peers"))


def leakage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of test orders that no training order has."""
    ctx = cooc.contexts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    f = split.fraction(F.col("ctx"))
    pairs = cooc.cooccurrence(ctx.where(f >= 0.9))
    return lookup.without_leaks(pairs, cooc.cooccurrence(ctx.where(f < 0.9)), "a", "b").agg(F.count("*").alias("pairs"), F.sum("joint").alias("joint"))


def hash_partition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("fp"))
    return docs.groupBy(split.partition(F.col("fp")).alias("split")).agg(F.count("*").alias("docs"), F.count_distinct("fp").alias("groups"))


def exact_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "customer").select("c_custkey")
    return split.group_split(groups, "c_custkey", 42)


def masked_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = cooc.contexts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    hidden = split.mask(ctx, "ctx", "item", 0.25, 7)
    return hidden.where("hidden").select("ctx", "item")


def leave_one_out_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that fill the same place of otherwise equal orders, a row each."""
    loo = split.leave_one_out(_sets(spark, sf_dir), "ctx", "items").select("target", F.array_join("rest", ",").alias("context"))
    return split.replacement_slots(loo, ["context"], "target")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "event_type")
    return split.stratified(events, "event_type", "event_id", 50, 42)


def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users picked turn by turn over (event type, part of the day)."""
    events = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("role"), (F.floor(F.hour("ts") / 6)).cast("int").alias("stratum"), F.col("user_id").alias("item")).agg(F.count("*").alias("weight"))
    return split.round_robin(events, "role", "stratum", "item", "weight")


def balanced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return split.balanced_groups(sizes, "o_custkey", "n", {"train": 0.8, "validation": 0.1, "test": 0.1})


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sets = neardup.token_sets(docs, "doc_id", "text")
    return neardup.all_similar_pairs(sets, 0.9).select("a", "b", F.round("jaccard", 6).alias("jaccard_r"))


def family_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    pairs = shared_table(neardup.similar_pairs(neardup.token_sets(docs, "doc_id", "text"), 0.9), "near-pairs")
    roots = components(pairs, "a", "b")
    every = docs.select("doc_id").join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("root", "doc_id"))
    size = every.groupBy("component").agg(F.count("*").alias("size"))
    return every.join(size, "component").select("doc_id", "component", "size")


def hyperedge_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that share an order's exact part set, directly or through others; split by family."""
    owned = _sets(spark, sf_dir).join(read(spark, sf_dir, "orders"), F.col("ctx") == F.col("o_orderkey")).select("o_custkey", "fingerprint").distinct()
    return families(owned, "o_custkey", "fingerprint").select("o_custkey", "root", split.partition(F.col("root")).alias("split"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by the statuses of the orders that hold them."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    of = lambda s: rows.where(F.col("o_orderstatus") == s).select("l_partkey")
    named = {"union": of("F").union(of("P")).distinct(), "intersect": of("F").intersect(of("P")), "except": of("F").exceptAll(of("P")).distinct(), "minus": of("F").subtract(of("P"))}
    out = None
    for name, df in named.items():
        row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum("l_partkey"), F.lit(0)).alias("total")).select(F.lit(name).alias("op"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


def domain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    shown = F.when(F.col("p_size") % 10 == 0, "n/a").when(F.col("p_size") % 11 == 0, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    return part.groupBy(tx.in_domain(shown, 20).alias("status")).agg(F.count("*").alias("parts"))


def freq_bucket_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = cooc.contexts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    n = read(spark, sf_dir, "part").join(cooc.frequencies(ctx), F.col("p_partkey") == F.col("item"), "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    return n.groupBy(tx.frequency_bucket(F.col("freq")).alias("bucket"), tx.log_bucket(F.col("freq")).alias("magnitude"), "p_type").agg(F.count("*").alias("items"), F.count_distinct("p_brand").alias("brands"))


SET = """ctx AS (SELECT DISTINCT l_orderkey AS ctx, l_partkey AS item FROM lineitem), sets AS (SELECT ctx, count(*) AS n, sha256('["' || string_agg(CAST(item AS VARCHAR), '","' ORDER BY item) || '"]') AS fingerprint, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items FROM ctx GROUP BY ctx)"""
FRACTION = "(('0x' || substr(sha256(CAST({} AS VARCHAR)), 1, 12))::UBIGINT / 281474976710656.0)"
PARTITION = f"CASE WHEN {FRACTION} < 0.8 THEN 'train' WHEN {FRACTION} < 0.9 THEN 'validation' ELSE 'test' END"
LINES = """lines AS (SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS q, CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'SMALL', 'MEDIUM') THEN 'legal' WHEN p_type = 'LARGE' THEN 'restricted' WHEN p_type = 'PROMO' THEN 'banned' END AS status, p_size % 32 AS bits, CASE WHEN p_size < 5 THEN NULL ELSE 40 END AS lim, l_linenumber = 1 AS head FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
total AS (SELECT l_orderkey, sum(q) AS n, bit_or(CASE WHEN head THEN bits END) AS identity FROM lines GROUP BY l_orderkey),
issues AS (SELECT l_orderkey, 'wrong_size' AS code, NULL::BIGINT AS l_partkey FROM total WHERE n <> 100 UNION SELECT l_orderkey, 'no_head', NULL FROM total WHERE identity IS NULL
UNION SELECT l_orderkey, 'too_many_copies', l_partkey FROM lines GROUP BY l_orderkey, l_partkey HAVING sum(q) > first(lim) UNION SELECT l_orderkey, 'unresolved', l_partkey FROM lines WHERE status IS NULL UNION SELECT l_orderkey, 'banned', l_partkey FROM lines WHERE status = 'banned'
UNION SELECT l_orderkey, 'not_legal', l_partkey FROM lines WHERE status NOT IN ('legal', 'banned') UNION SELECT l.l_orderkey, 'outside_identity', l_partkey FROM lines l JOIN total t ON t.l_orderkey = l.l_orderkey AND identity IS NOT NULL WHERE bits & xor(31, identity) <> 0)"""
SHARED = """tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\\x{00C0}-\\x{024F}]+')) AS t FROM documents), size AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
share AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM tok x JOIN tok y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2)"""
JACCARD = f"""{SHARED},
own AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS lead FROM (SELECT doc_id, string_agg(t, ' ' ORDER BY t) AS s FROM tok GROUP BY doc_id)),
near AS (SELECT a, b, c / (x.n + y.n - c) AS jaccard FROM share JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b JOIN own l ON l.doc_id = a AND l.lead = a JOIN own m ON m.doc_id = b AND m.lead IN (a, b) WHERE c >= 0.9 * (x.n + y.n - c))"""

SQL = {
    "exact_dedup_documents": "SELECT doc_id, CAST(doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS INTEGER) AS kept, count(*) OVER (PARTITION BY sha256(text)) AS group_size FROM documents",
    "first_of_each_text": "SELECT doc_id, lang, source, sha256(text) AS fp FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1",
    "set_fingerprints": f"WITH {SET} SELECT ctx, n, fingerprint FROM sets",
    "multiset_fingerprints": "WITH t AS (SELECT l_orderkey, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, sha256(string_agg(l_partkey || ':' || q, ',' ORDER BY l_partkey)) AS fingerprint FROM t GROUP BY l_orderkey",
    "context_quarantine_audit": f"WITH {SET} SELECT CASE WHEN ctx > first THEN 'duplicate' WHEN n < 2 THEN 'too_small' WHEN n > 10 THEN 'quarantined' ELSE 'accepted' END AS status, count(*) AS contexts FROM (SELECT *, min(ctx) OVER (PARTITION BY fingerprint) AS first FROM sets) GROUP BY 1",
    "context_size_profile": f"WITH {SET} SELECT count(*) AS contexts, round(avg(n), 6) AS mean_r, round(stddev_samp(n), 6) AS sd_r, " + ", ".join(f"quantile_cont(n, {m / 100}) AS p{m}" for m in (25, 50, 75, 90, 95, 99)) + " FROM sets",
    "quality_rules": "SELECT doc_id, CASE WHEN n_chars < 120 THEN '' WHEN doc_id % 16 = 0 THEN 'explicit_cube' WHEN doc_id % 16 IN (2, 4, 5, 7) THEN 'collection_or_pool' WHEN doc_id % 16 IN (8, 9, 11, 12, 13) THEN 'aggregate_or_reference' ELSE '' END AS reason FROM documents",
    "provenance_labels": f"WITH {SET} SELECT fingerprint, count(DISTINCT ctx) AS contexts, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS labels, min(ctx) AS first FROM sets JOIN orders ON o_orderkey = ctx JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY fingerprint",
    "set_rule_issues": f"WITH {LINES} SELECT code, count(*) AS issues, count(DISTINCT l_orderkey) AS orders FROM issues GROUP BY code",
    "accept_reject_report": f"WITH {LINES} SELECT code, count(DISTINCT l_orderkey) AS rows FROM issues GROUP BY code UNION ALL SELECT 'accepted', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM issues)",
    "remaining_copies": f"WITH {LINES} SELECT l_orderkey, l_partkey, CASE WHEN count(lim) = count(*) THEN CAST(greatest(0, max(lim) - sum(q)) AS BIGINT) END AS remaining FROM lines GROUP BY 1, 2",
    "identity_mask": "WITH i AS (SELECT p_brand, bit_or(p_size % 32) AS identity FROM part WHERE p_type = 'SMALL' GROUP BY p_brand) SELECT i.p_brand, identity, count(*) AS allowed FROM i JOIN part p ON (p.p_size % 32) & xor(31, identity) = 0 GROUP BY 1, 2",
    "record_validation": """WITH z AS (SELECT l_orderkey, l_linestatus, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, CASE WHEN l_partkey % 97 = 0 THEN ' A- / x' ELSE CAST(l_partkey AS VARCHAR) END, CAST(l_quantity AS INTEGER) - CASE WHEN l_partkey % 89 = 0 THEN 60 ELSE 0 END) - 1 AS i, CASE WHEN l_partkey % 97 = 0 THEN '] must have a name' WHEN l_partkey % 89 = 0 AND CAST(l_quantity AS INTEGER) < 61 THEN '].quantity must be a positive integer' END AS what FROM lineitem),
m AS (SELECT l_orderkey, string_agg(CASE l_linestatus WHEN 'O' THEN 'mainboard[' ELSE 'sideboard[' END || i || what, '; ' ORDER BY l_linestatus DESC, i) AS said FROM z GROUP BY 1)
SELECT k AS o_orderkey, concat_ws('; ', CASE WHEN k % 50 <> 0 AND k % 51 = 0 THEN 'missing schema_version' END, CASE WHEN k % 40 = 0 THEN 'missing source' END, CASE WHEN l_orderkey IS NULL THEN 'missing commanders; missing mainboard; missing sideboard' END, CASE WHEN k % 60 = 0 THEN 'missing metadata' END,
CASE WHEN k % 50 = 0 OR k % 51 = 0 THEN 'schema_version must be 1' END, CASE WHEN k % 30 = 0 OR k % 40 = 0 THEN 'deck_id and source must be non-empty' END, CASE WHEN l_orderkey IS NULL THEN 'commanders must be a list; mainboard must be a list; sideboard must be a list' END, said, CASE WHEN k % 60 = 0 THEN 'metadata must be an object' END) AS issues
FROM (SELECT o_orderkey AS k FROM orders) LEFT JOIN m ON k = l_orderkey""",
    "prioritized_lookup": """WITH e AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1'), a AS (SELECT p_name || '|' || p_type AS k, p_partkey AS v FROM part WHERE p_size > 25 QUALIFY row_number() OVER (PARTITION BY p_name || '|' || p_type ORDER BY p_retailprice DESC, p_partkey) = 1), m AS (SELECT p_name AS k, p_partkey AS v FROM part WHERE p_size > 40 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) = 1)
SELECT p.p_partkey, coalesce(e.p_partkey, a.v, m.v) AS resolved, CASE WHEN e.p_partkey IS NOT NULL THEN 'id' WHEN a.v IS NOT NULL THEN 'alias' WHEN m.v IS NOT NULL THEN 'name' ELSE 'unresolved' END AS how FROM part p LEFT JOIN e ON e.p_partkey = p.p_partkey LEFT JOIN a ON a.k = p.p_name || '|' || p.p_type LEFT JOIN m ON m.k = p.p_name""",
    "unique_dimension_audit": "SELECT p_name || '|' || p_brand || '|' || p_type AS k, count(DISTINCT p_partkey) AS identities, CASE WHEN count(DISTINCT p_partkey) = 1 THEN min(p_partkey) ELSE -1 END AS identity FROM part GROUP BY 1",
    "lookup_coverage": "WITH k AS (SELECT p_name || '|' || p_brand AS k, p_brand, p_size FROM part), u AS (SELECT k, count(*) AS n, max(p_size) AS m FROM k GROUP BY k) SELECT p_brand, CASE WHEN m <= 10 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'included' END AS status, count(*) AS parts FROM k JOIN u USING (k) GROUP BY 1, 2",
    "signature_peers": "SELECT a.p_partkey AS a, count(*) AS peers FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey GROUP BY 1",
    "leakage_filter": f"WITH ctx AS (SELECT DISTINCT l_orderkey AS ctx, l_partkey AS item FROM lineitem), p AS (SELECT a.item AS a, b.item AS b, {FRACTION.format('a.ctx')} < 0.9 AS train FROM ctx a JOIN ctx b ON a.ctx = b.ctx AND a.item < b.item) SELECT count(*) AS pairs, CAST(sum(n) AS BIGINT) AS joint FROM (SELECT a, b, count(*) AS n FROM p GROUP BY a, b HAVING NOT bool_or(train))",
    "hash_partition_groups": f"WITH d AS (SELECT sha256(text) AS fp FROM documents) SELECT {PARTITION.format('fp', 'fp')} AS split, count(*) AS docs, count(DISTINCT fp) AS groups FROM d GROUP BY 1",
    "exact_group_split": "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('42:' || c_custkey), c_custkey) AS p, count(*) OVER () AS n FROM customer) SELECT c_custkey, CASE WHEN p <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN p <= floor(n * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM r",
    "masked_members": "WITH ctx AS (SELECT DISTINCT l_orderkey AS ctx, l_partkey AS item FROM lineitem) SELECT ctx, item FROM ctx QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY sha256('7:' || ctx || ':' || item), item) <= greatest(1, round_even(count(*) OVER (PARTITION BY ctx) * 0.25, 0))",
    "leave_one_out_slots": """WITH ctx AS (SELECT DISTINCT l_orderkey AS ctx, l_partkey AS item FROM lineitem), l AS (SELECT t.item AS target, coalesce(string_agg(CAST(r.item AS VARCHAR), ',' ORDER BY r.item), '') AS context FROM ctx t LEFT JOIN ctx r ON r.ctx = t.ctx AND r.item <> t.item GROUP BY t.ctx, t.item)
SELECT context, target FROM (SELECT DISTINCT context, target FROM l) QUALIFY count(*) OVER (PARTITION BY context) > 1""",
    "stratified_sample": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sha256('42:' || event_id), event_id) <= 50",
    "stratified_round_robin": """WITH e AS (SELECT event_type AS role, CAST(floor(hour(ts) / 6) AS INTEGER) AS stratum, user_id AS item, count(*) AS weight FROM events GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (PARTITION BY role, stratum ORDER BY weight DESC, item) AS turn FROM e),
o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY item ORDER BY turn, role, stratum) = 1), c AS (SELECT role, stratum, item, row_number() OVER (PARTITION BY role, stratum ORDER BY weight DESC, item) AS turn FROM o) SELECT role, stratum, item, row_number() OVER (ORDER BY turn, role, stratum) AS pick FROM c""",
    "near_duplicate_pairs": f"WITH {SHARED} SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard_r FROM share JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c >= 0.9 * (x.n + y.n - c)",
    "family_components": f"""WITH RECURSIVE {JACCARD}, e AS (SELECT a, b FROM near UNION SELECT b, a FROM near), walk AS (SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT w.s, e.b FROM walk w JOIN e ON e.a = w.t), c AS (SELECT s AS doc_id, min(t) AS component FROM walk GROUP BY s)
SELECT doc_id, component, count(*) OVER (PARTITION BY component) AS size FROM c""",
    "hyperedge_families": f"""WITH RECURSIVE {SET}, o AS (SELECT DISTINCT o_custkey, fingerprint FROM sets JOIN orders ON o_orderkey = ctx), e AS (SELECT DISTINCT x.o_custkey AS a, y.o_custkey AS b FROM o x JOIN o y USING (fingerprint)), walk AS (SELECT DISTINCT o_custkey AS s, o_custkey AS t FROM o UNION SELECT w.s, e.b FROM walk w JOIN e ON e.a = w.t), c AS (SELECT s AS o_custkey, min(t) AS root FROM walk GROUP BY s) SELECT o_custkey, root, {PARTITION.format('root', 'root')} AS split FROM c""",
    "set_operations": """WITH r AS (SELECT DISTINCT l_partkey, o_orderstatus AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey), m AS (SELECT l_partkey, o_orderstatus AS s, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), u AS (SELECT 'union' AS op, l_partkey FROM r WHERE s IN ('F', 'P') GROUP BY l_partkey UNION ALL SELECT 'intersect', l_partkey FROM r WHERE s IN ('F', 'P') GROUP BY l_partkey HAVING count(*) = 2
UNION ALL SELECT 'except', f.l_partkey FROM m f LEFT JOIN m p ON p.l_partkey = f.l_partkey AND p.s = 'P' WHERE f.s = 'F' AND f.n > coalesce(p.n, 0) UNION ALL SELECT 'minus', l_partkey FROM r WHERE s = 'F' AND l_partkey NOT IN (SELECT l_partkey FROM r WHERE s = 'P')), o AS (SELECT unnest(['union', 'intersect', 'except', 'minus']) AS op)
SELECT o.op, count(l_partkey) AS n, CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS total FROM o LEFT JOIN u USING (op) GROUP BY o.op""",
    "domain_audit": "SELECT CASE WHEN p_size % 10 = 0 THEN 'missing_or_invalid' WHEN p_size % 11 = 0 THEN 'negative' WHEN p_size > 20 THEN 'above_primary_range' ELSE 'included' END AS status, count(*) AS parts FROM part GROUP BY 1",
    "freq_bucket_coverage": "WITH f AS (SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS freq FROM lineitem GROUP BY 1), j AS (SELECT part.*, coalesce(freq, 0) AS freq FROM part LEFT JOIN f ON item = p_partkey) SELECT CASE WHEN freq < 10 THEN '<10' WHEN freq < 100 THEN '<100' WHEN freq < 1000 THEN '<1000' WHEN freq < 10000 THEN '<10000' ELSE '>=10000' END AS bucket, CAST(floor(log10(greatest(1, freq))) AS INTEGER) AS magnitude, p_type, count(*) AS items, count(DISTINCT p_brand) AS brands FROM j GROUP BY 1, 2, 3",
}
QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup_documents, first_of_each_text, two_key_dedup, set_fingerprints, multiset_fingerprints, context_quarantine_audit, context_size_profile, quality_rules, provenance_labels, set_rule_issues, accept_reject_report, remaining_copies,
        identity_mask, record_validation, prioritized_lookup, unique_dimension_audit, lookup_coverage, signature_peers, leakage_filter, hash_partition_groups, exact_group_split, masked_members, leave_one_out_slots, stratified_sample,
        stratified_round_robin, balanced_groups, near_duplicate_pairs, family_components, hyperedge_families, set_operations, domain_audit, freq_bucket_coverage,
    )
}
