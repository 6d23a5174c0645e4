"""Queries on vectors, labels, texts, pages and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import rank, scorers, vectors
from sparkloom.sources.tables import read
from sparkloom.streaming import ingest

#: Patterns of the tag queries.
TAGS = {"number": r"[0-9]", "mail": r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", "licence": r"(?i)licen[sc]e", "secret": r"(?i)(token|password|secret)\s*[=:]", "shout": r"!!", "table": r" \| "}


def cosine_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return vectors.neighbours(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 10)


def centroid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each label's own vectors rank against its centroid: pessimistic ranks."""
    rows = read(spark, sf_dir, "embeddings")
    centres = vectors.mean(rows.withColumn("u", vectors.unit(F.col("embedding"))), ["label"], "u").withColumnRenamed("label", "of")
    scored = rows.join(F.broadcast(centres)).select("of", "vec_id", "label", F.round(vectors.cosine(F.col("embedding"), F.col("u")), 6).alias("cos_r"))
    ranked = rank.pessimistic(scored, ["of"], "cos_r").where(F.col("of") == F.col("label"))
    return ranked.select("label", "vec_id", "cos_r", "rank")


def vector_norm_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("label", F.round(vectors.norm(F.col("embedding")), 4).alias("norm"), F.size("embedding").alias("dims"))
    return rows.groupBy("label", "dims").agg(F.count("*").alias("n"), F.count_if(F.col("norm") == 0).alias("zeros"), F.round(F.min("norm"), 4).alias("least"), F.round(F.max("norm"), 4).alias("most"))


def fused_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of a vector brought to length one each and put side by side: shares of the first half."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.slice("embedding", 1, 32)).alias("a"), vectors.unit(F.slice("embedding", 33, 32)).alias("b"))
    both = F.concat("a", "b")
    return rows.select("vec_id", F.size(both).alias("dims"), F.round(vectors.norm(both), 6).alias("norm_r"), F.round(vectors.dot(F.col("a"), F.col("b")), 6).alias("dot_r"))


def linear_cka_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return spark.range(1).select(F.round(F.lit(vectors.linear_cka(rows, "a", "b")), 6).alias("cka_r"))


def probe_label_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    out = None
    for name in ("quality", "toxic"):
        one = rank.auc(both, "n_chars", name).select(F.lit(name).alias("label"), F.round("auc", 9).alias("auc_r"))
        out = one if out is None else out.unionByName(one)
    return out


def probe_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("guess", (F.col("n_chars") > 400).cast("int"))
    return rank.label_f1(both, "quality", "guess").select("label", F.round("f1", 9).alias("f1_r"))


def frequency_price_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    both = read(spark, sf_dir, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"))
    return rank.spearman(both, "n", "p_size").select(F.round("spearman", 6).alias("spearman_r"))


def seed_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five seeds' means of each event type: their mean, deviation and number."""
    per = read(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("m"))
    return per.groupBy("event_type").agg(F.count("*").alias("seeds"), F.round(F.avg("m"), 6).alias("mean_r"), F.round(F.stddev_samp("m"), 6).alias("sd_r"))


def seed_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("seed", F.col("user_id") % 3)
    wide = rows.groupBy("event_type").pivot("seed", [0, 1, 2]).agg(F.round(F.avg("value"), 6))
    return wide.toDF("event_type", "seed0", "seed1", "seed2")


def seed_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_pivot(spark, sf_dir).unpivot(["event_type"], ["seed0", "seed1", "seed2"], "metric", "value").where("value is not null")


def coverage_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups keep their nulls."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"))


def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "pages").select("page_id", tx.url_parts(F.col("url")).alias("u"))
    return parts.select("page_id", F.coalesce("u.host", F.lit("")).alias("host"), F.coalesce("u.path", F.lit("")).alias("path"), F.coalesce("u.page", F.lit("")).alias("page_param"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(tx.links(F.col("html"))).alias("pos", "href"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = tx.visible_text(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.length(shown).alias("chars"), F.sha2(shown, 256).alias("digest"))


def text_tag_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.tags(F.col("text"), TAGS, "other")
    return read(spark, sf_dir, "documents").select(F.explode(found).alias("tag"), "doc_id").groupBy("tag").agg(F.count("*").alias("docs"), F.sum("doc_id").alias("ids"))


def tag_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", tx.evidence(F.col("text"), TAGS).alias("e"))
    return docs.select("doc_id", F.explode("e").alias("tag", "span"))


def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in eleven styles and read back; three of them aren't known."""
    styles = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-M-d", "dd/MM/yy", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MMM-yyyy HH:mm", "d-MMM-yyyy", "yyyy/MM/dd", "MMMM d, yyyy", "yyyy-MM-ddX"]
    written = F.coalesce(*(F.when(F.col("o_orderkey") % 11 == i, F.date_format("o_orderdate", s.replace("X", "'.'"))) for i, s in enumerate(styles)))
    day = tx.normal_date(F.concat(F.lit(" "), written, F.lit(" ")))
    return read(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), tx.is_iso_date(day).cast("int").alias("iso"))


def sectioned_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn before each turn."""
    turns = read(spark, sf_dir, "conversations")
    filled = tx.fill_forward(turns, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "section")
    return filled.select("conv_id", "turn", F.coalesce("section", F.lit(-1)).alias("section"))


def year_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar years that a customer's orders span, each cut to that span."""
    spans = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    years = spans.select("o_custkey", "a", "b", F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y"))
    return years.select("o_custkey", F.col("y").alias("year"), F.date_format(F.greatest("a", F.make_date("y", F.lit(1), F.lit(1))), "yyyy-MM-dd").alias("first"), F.date_format(F.least("b", F.make_date("y", F.lit(12), F.lit(31))), "yyyy-MM-dd").alias("last"))


def repeated_page_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 25 events whose set of event types equals the page's before of the same job (user modulo three)."""
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("job"), F.floor(F.col("event_id") / 25).cast("long").alias("page"), F.col("event_type").alias("id"))
    return ingest.repeated_pages(rows, "job", "page", "id")


def upsert_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.col("event_id")).alias("last_type"))


def stream_dedup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of every (type, user), from a stream that is read twice into the same sink."""
    stream = ingest.file_stream(spark, f"{sf_dir}/events.parquet")
    out = ingest.deduplicated(stream, ["event_type", "user_id"], "event_id", runs=2)
    return out.select("event_type", "user_id", F.col("event_id").alias("first_event_id"))


def stream_dual_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sinks of one stream, each with keys of its own."""
    out = None
    for name, keys in (("combined", ["user_id"]), ("by_type", ["event_type", "user_id"])):
        rows = ingest.deduplicated(ingest.file_stream(spark, f"{sf_dir}/events.parquet"), keys, "event_id")
        one = rows.agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids")).select(F.lit(name).alias("sink"), "rows", "ids")
        out = one if out is None else out.unionByName(one)
    return out


COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
PIVOT = "SELECT event_type, " + ", ".join(f"round(avg(value) FILTER (user_id % 3 = {i}), 6) AS seed{i}" for i in range(3)) + " FROM events GROUP BY event_type"
AUC = "SELECT '{0}' AS label, round((sum(r) FILTER ({0} = 1) - count(*) FILTER ({0} = 1) * (count(*) FILTER ({0} = 1) + 1) / 2) / (count(*) FILTER ({0} = 1) * count(*) FILTER ({0} = 0)), 9) AS auc_r FROM (SELECT {0}, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM documents JOIN labels USING (doc_id))"
SQL = {
    "cosine_top10": f"WITH {VEC} SELECT a.vec_id AS qid, b.vec_id, round({COS}, 6) AS cos_r, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS rank FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10",
    "centroid_retrieval": f"""WITH {VEC}, u AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM v), c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i) GROUP BY label),
s AS (SELECT b.label AS of, a.vec_id, a.label, round({COS}, 6) AS cos_r FROM v a CROSS JOIN c b), r AS (SELECT *, count(*) OVER (PARTITION BY of ORDER BY cos_r DESC) AS rank FROM s) SELECT label, vec_id, cos_r, rank FROM r WHERE of = label""",
    "vector_norm_audit": f"WITH {VEC}, n AS (SELECT label, len(v) AS dims, round(sqrt(list_dot_product(v, v)), 4) AS norm FROM v) SELECT label, dims, count(*) AS n, count(*) FILTER (norm = 0) AS zeros, min(norm) AS least, max(norm) AS most FROM n GROUP BY label, dims",
    "fused_views": f"WITH {VEC}, h AS (SELECT vec_id, v[1:32] AS a, v[33:64] AS b FROM v), n AS (SELECT *, sqrt(list_dot_product(a, a)) AS na, sqrt(list_dot_product(b, b)) AS nb FROM h) SELECT vec_id, len(a) + len(b) AS dims, round(sqrt((na > 0)::INT + (nb > 0)::INT), 6) AS norm_r, round(list_dot_product(a, b) / (na * nb), 6) AS dot_r FROM n",
    "linear_cka_blocks": f"""WITH {VEC}, c AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM v), m AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM c), g AS (SELECT p.i, q.i AS j, sum(p.x * q.x) AS g FROM m p JOIN m q USING (vec_id) GROUP BY 1, 2)
SELECT round(sum(g * g) FILTER (i <= 32 AND j > 32) / (sqrt(sum(g * g) FILTER (i <= 32 AND j <= 32)) * sqrt(sum(g * g) FILTER (i > 32 AND j > 32))), 6) AS cka_r FROM g""",
    "probe_label_auc": AUC.format("quality") + " UNION ALL " + AUC.format("toxic"),
    "probe_f1": "WITH d AS (SELECT quality AS t, CAST(n_chars > 400 AS INTEGER) AS g FROM documents JOIN labels USING (doc_id)), l AS (SELECT DISTINCT t AS label FROM d UNION SELECT DISTINCT g FROM d) SELECT label, round(2 * count(*) FILTER (t = label AND g = label) / (count(*) FILTER (t = label) + count(*) FILTER (g = label)), 9) AS f1_r FROM d CROSS JOIN l GROUP BY label",
    "frequency_price_spearman": "WITH s AS (SELECT p_size AS y, count(*) AS x FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y FROM s) SELECT round(corr(x, y), 6) AS spearman_r FROM r",
    "seed_mean_sd": "WITH m AS (SELECT event_type, user_id % 5 AS seed, avg(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS seeds, round(avg(m), 6) AS mean_r, round(stddev_samp(m), 6) AS sd_r FROM m GROUP BY event_type",
    "seed_pivot": PIVOT,
    "seed_unpivot": f"UNPIVOT ({PIVOT}) ON seed0, seed1, seed2 INTO NAME metric VALUE value",
    "coverage_with_nulls": "SELECT lang, quality, toxic, count(*) AS docs, count(DISTINCT source) AS sources FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "url_params": r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page_param FROM pages",
    "page_text": r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS digest FROM t""",
    "html_links": "WITH l AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS l FROM pages) SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS href FROM l",
    "text_tag_signature": "WITH t AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in TAGS.items()) + "], lambda x: x IS NOT NULL) AS l FROM documents), e AS (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN ['other'] ELSE l END) AS tag FROM t) SELECT tag, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS ids FROM e GROUP BY tag",
    "tag_evidence": " UNION ALL ".join(f"SELECT doc_id, '{n}' AS tag, regexp_extract(text, '{TAGS[n]}', 0) AS span FROM documents WHERE regexp_matches(text, '{TAGS[n]}')" for n in TAGS),
    "date_normalize": "WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 5 AND day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') WHEN o_orderkey % 11 = 8 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN o_orderkey % 11 = 9 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN o_orderkey % 11 = 10 THEN strftime(o_orderdate, '%Y-%m-%d.') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders) SELECT o_orderkey, day, CAST(o_orderkey % 11 < 8 AS INTEGER) AS iso FROM d",
    "sectioned_fill_forward": "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS section FROM conversations",
    "year_windows": "WITH s AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1), y AS (SELECT *, unnest(range(year(a), year(b) + 1)) AS y FROM s) SELECT o_custkey, CAST(y AS INTEGER) AS year, strftime(greatest(a, make_date(y, 1, 1)), '%Y-%m-%d') AS first, strftime(least(b, make_date(y, 12, 31)), '%Y-%m-%d') AS last FROM y",
    "repeated_page_detect": "WITH p AS (SELECT user_id % 3 AS job, CAST(floor(event_id / 25) AS BIGINT) AS page, sha256(string_agg(DISTINCT event_type, chr(10) ORDER BY event_type)) AS fp FROM events GROUP BY 1, 2) SELECT job, page, CAST(coalesce(lag(fp) OVER (PARTITION BY job ORDER BY page) = fp, false) AS INTEGER) AS repeated FROM p",
    "upsert_counter": "SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id",
    "stream_dedup_replay": "SELECT event_type, user_id, min(event_id) AS first_event_id FROM events GROUP BY 1, 2",
    "stream_dual_sink": "SELECT 'combined' AS sink, count(*) AS rows, CAST(sum(e) AS BIGINT) AS ids FROM (SELECT min(event_id) AS e FROM events GROUP BY user_id) UNION ALL SELECT 'by_type', count(*), CAST(sum(e) AS BIGINT) FROM (SELECT min(event_id) AS e FROM events GROUP BY event_type, user_id)",
}
QUERIES = {
    f.__name__: f
    for f in (
        cosine_top10, centroid_retrieval, vector_norm_audit, fused_views, linear_cka_blocks, probe_label_auc, probe_f1, frequency_price_spearman, seed_mean_sd, seed_pivot, seed_unpivot, coverage_with_nulls, url_params, html_links, page_text,
        text_tag_signature, tag_evidence, date_normalize, sectioned_fill_forward, year_windows, repeated_page_detect, upsert_counter, stream_dedup_replay, stream_dual_sink,
    )
}


def _two_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("u"), F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double")).alias("v"))


def scorer_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of every fiftieth vector by each mode; the halves of a vector are its two spaces."""
    rows = _two_spaces(spark, sf_dir)
    weights = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: i / 32)
    out = None
    for mode in scorers.MODES:
        best = scorers.best(rows.where("vec_id % 50 = 0"), rows, "vec_id", mode, 3, weights).select(F.lit(mode).alias("mode"), "query", "vec_id", "score_r", "rank")
        out = best if out is None else out.unionByName(best)
    return out


def multi_query_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best for sets of queries (by label), scores averaged over a set."""
    rows = _two_spaces(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    asked = rows.where("vec_id % 25 = 0")
    means = scorers.mean_of_queries(scorers.scored(asked, rows, "vec_id", "input_cosine"), asked.select(F.col("label").alias("set"), F.col("vec_id").alias("query")), "vec_id").withColumn("score_r", F.round("score", 6))
    return rank.top_k(means, ["set"], [F.desc("score_r"), "vec_id"], 5).select("set", "vec_id", "score_r", "rank")


_U = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_DOT = "list_dot_product({0}, {1})"
_SCORES = {
    "input_cosine": _U.format("a.u", "b.u"), "context_cosine": _U.format("a.v", "b.v"), "combined_cosine": _U.format("a.s", "b.s"), "cross_dot": _DOT.format("a.u", "b.v"), "cross_cosine": _U.format("a.u", "b.v"),
    "symmetric_cross_dot": f"({_DOT.format('a.u', 'b.v')} + {_DOT.format('a.v', 'b.u')}) / 2", "symmetric_cross_cosine": f"({_U.format('a.u', 'b.v')} + {_U.format('a.v', 'b.u')}) / 2", "svd_dot": _DOT.format("a.u", "b.u"),
    "compatibility": "list_dot_product(a.w, b.u) / (sqrt(list_dot_product(a.u, a.u)) * sqrt(list_dot_product(b.u, b.u)))",
}
_HALVES = "h AS (SELECT vec_id, label, CAST(embedding[1:32] AS DOUBLE[]) AS u, CAST(embedding[33:64] AS DOUBLE[]) AS v FROM embeddings), t AS (SELECT *, list_transform(list_zip(u, v), lambda x: x[1] + x[2]) AS s, list_transform(list_zip(u, range(1, 33)), lambda x: x[1] * x[2] / 32) AS w FROM h)"
SQL["scorer_modes"] = f"WITH {_HALVES}, s AS (" + " UNION ALL ".join(f"SELECT '{m}' AS mode, a.vec_id AS query, b.vec_id, round({e}, 6) AS score_r FROM t a JOIN t b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0" for m, e in _SCORES.items()) + ") SELECT *, row_number() OVER (PARTITION BY mode, query ORDER BY score_r DESC, vec_id) AS rank FROM s QUALIFY rank <= 3"
SQL["multi_query_mean"] = f"WITH {_HALVES}, s AS (SELECT a.label AS set_, b.vec_id, round(avg({_SCORES['input_cosine']}), 6) AS score_r FROM t a JOIN t b ON a.vec_id <> b.vec_id WHERE a.vec_id % 25 = 0 GROUP BY 1, 2, b.label HAVING NOT (b.vec_id % 25 = 0 AND b.label = a.label)) SELECT set_ AS \"set\", vec_id, score_r, row_number() OVER (PARTITION BY set_ ORDER BY score_r DESC, vec_id) AS rank FROM s QUALIFY rank <= 5"
QUERIES |= {f.__name__: f for f in (scorer_modes, multi_query_mean)}
