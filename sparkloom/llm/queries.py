"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import ann, chat, decontam, linededup, minhash, mixing, pii, shard, tokencount, toxicity
from sparkloom.llm.common import read

SHARDS = 24
#: Production weights of the mixing tree; names that aren't listed weigh one.
MIX = {"budget_percent": 60, "weights": {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 5, "de": 2, "fr": 2}}, "max_epochs": 3, "seed": 7}


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign_slots(read(spark, sf_dir, "documents"), SHARDS)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    counts = [pii.count_of(F.col("pii"), kind).alias(f"n_{kind}") for kind in pii.BASE]
    top = F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"), top.alias("top_score"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), **MIX, texts=False)


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t")).select("t.*")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.read_back(chat.format_conversations(turns)))


def op3_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"))


def op9_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat, op2_jump_shards, op3_latent_decontam, op4_pii, op5_mix, op6_toxicity, op7_line_chunks, op8_token_counts, op9_collision_ann, op10_dart_minhash)
}


def _share(level: str, parent: str, keys: str, source: str, weight: str, budget: str) -> str:
    """SQL of one level of the tree: children of `source` share their parent's budget."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""n{level} AS (SELECT {keys}, sum(cap) AS cap, {weight} AS w FROM leaf GROUP BY {keys}), b{level} AS (SELECT n.*, budget::HUGEINT AS budget FROM n{level} n {budget}),
r{level} AS (SELECT *, greatest(budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {source} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rest, sum(w) OVER ({by} ORDER BY cap / w, {source} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM b{level}),
f{level} AS (SELECT *, cap * left_w <= rest * w AS full_ FROM r{level}),
s{level} AS (SELECT {keys}, CASE WHEN full_ THEN cap ELSE (budget - coalesce(sum(cap) FILTER (full_) OVER ({by}), 0)) * w // sum(w) FILTER (NOT full_) OVER ({by}) END AS budget FROM f{level})"""


def _mix_sql() -> str:
    def weight(name: str) -> str:
        own = MIX["weights"].get(name, {})
        return "CASE " + name + "".join(f" WHEN '{k}' THEN {v}" for k, v in own.items()) + " ELSE 1 END" if own else "1"

    number = "regexp_extract(source, '([0-9]+)$', 1)"
    return rf"""WITH rows_ AS (SELECT doc_id, CASE WHEN {number} = '' THEN 'other' ELSE 'domain' || (right({number}, 4)::INT % 4) END AS domain, lang, source, len(regexp_extract_all(text, '\S+')) AS n FROM documents WHERE len(regexp_extract_all(text, '\S+')) > 0),
leaf AS (SELECT domain, lang, source, sum(n)::HUGEINT AS tokens, {MIX["max_epochs"]} * sum(n)::HUGEINT AS cap FROM rows_ GROUP BY ALL), total AS (SELECT least(sum(tokens) * {MIX["budget_percent"]} // 100, sum(cap)) AS budget FROM leaf),
{_share("1", "", "domain", "domain", weight("domain"), "CROSS JOIN total")}, {_share("2", "domain", "domain, lang", "lang", weight("lang"), "JOIN s1 USING (domain)")}, {_share("3", "domain, lang", "domain, lang, source", "source", weight("source"), "JOIN s2 USING (domain, lang)")},
d AS (SELECT r.*, budget // tokens AS epochs, budget % tokens AS rest FROM rows_ r JOIN leaf USING (domain, lang, source) JOIN s3 USING (domain, lang, source)),
c AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX["seed"]}:' || epochs || ':' || doc_id), n) <= rest AS more FROM d)
SELECT doc_id, domain, lang, source, n::BIGINT AS n_tokens, (epochs + more::INT)::BIGINT AS copies FROM c WHERE epochs + more::INT > 0"""


SQL: dict[str, str] = {
    "op5_mix": _mix_sql(),
    "op7_line_chunks": r"""WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents), k AS (SELECT doc_id, ('0x' || left(md5(text), 15))::BIGINT AS t, string_split(text, chr(10)) AS l, length(text) AS n_all FROM d),
e AS (SELECT doc_id, t, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM k WHERE n_all > 0),
m AS (SELECT *, ('0x' || left(md5(line), 8))::BIGINT & 1073741823 AS h, length(line) >= 39 AND len(regexp_extract_all(line, '\S+')) >= 20 AS long FROM e),
u AS (SELECT *, h * 1073741824 + lead(h) OVER (PARTITION BY doc_id, t ORDER BY i) AS roll FROM m),
p AS (SELECT roll, count(*) AS n FROM u WHERE roll IS NOT NULL GROUP BY 1 HAVING count(*) > 1), s AS (SELECT h, count(*) AS n FROM u WHERE long GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT doc_id, t, i, line, u.roll, coalesce(p.n, 0) AS pairs, long, long AND s.n IS NOT NULL AS alone FROM u LEFT JOIN p ON u.roll = p.roll LEFT JOIN s ON u.h = s.h AND long),
w AS (SELECT *, coalesce(lag(pairs) OVER v, 0) AS b, coalesce(lead(pairs) OVER v, 0) AS a, lag(roll) OVER v AS rb, lead(roll) OVER v AS ra, coalesce(lead(long) OVER v, false) AS la FROM f WINDOW v AS (PARTITION BY doc_id, t ORDER BY i)),
c AS (SELECT *, pairs = 0 OR long OR la OR b > pairs OR a > pairs OR (b = pairs AND a = pairs AND roll < rb AND roll < ra) AS stop FROM w),
g AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY doc_id, t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c),
ch AS (SELECT doc_id, t, min(i) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS part FROM g WHERE pairs > 0 OR b > 0 OR alone GROUP BY doc_id, t, k),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, t, first) AS rn FROM ch WHERE regexp_matches(part, '\S')),
cut AS (SELECT doc_id, t, sum(n) AS n, string_agg(first || ':' || n, ',' ORDER BY first) AS cuts, sum(length(part)) AS chars FROM r WHERE rn > 1 GROUP BY doc_id, t)
SELECT q.doc_id, len(k.l)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(cuts, '') AS removed, (n_all - coalesce(chars, 0))::BIGINT AS cut_text_chars FROM documents q JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND ('0x' || left(md5(coalesce(q.text, '')), 15))::BIGINT = k.t LEFT JOIN cut ON k.doc_id IS NOT DISTINCT FROM cut.doc_id AND k.t = cut.t""",
}
