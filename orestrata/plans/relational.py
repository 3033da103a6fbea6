"""Queries of rollups, joins, incremental building blocks and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orestrata.functions.vectors import usable
from orestrata.operators import evaluate as E
from orestrata.operators import incremental as I
from orestrata.operators import rollup as RU
from orestrata.operators.filters import Filters, violations
from orestrata.session import table

CUT = "2024-01-01"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def rollup_distinct(spark, sf_dir):
    columns = ["gpl", "source_name_ch1", "organism_ch1", "molecule_ch1"]
    rolled = RU.with_rollup(_t(spark, sf_dir, "series"), _t(spark, sf_dir, "gsm"), "gse", columns)
    return rolled.select("gse", "n_children", *[F.array_join(c, "|").alias(c) for c in columns])


def rollup_two_level(spark, sf_dir):
    kept = _t(spark, sf_dir, "gsm").where("molecule_ch1 is not null and gpl is not null")
    out = RU.two_level(kept, "gse", "molecule_ch1", "gpl")
    return out.select("gse", F.array_join(F.transform("entries", lambda e: F.concat(e["name"], F.lit("="), F.array_join(e["values"], ","))), ";").alias("entries"))


def sample_accessions(spark, sf_dir):
    return RU.accessions_sorted(_t(spark, sf_dir, "gsm"), "gse", "gsm").select("gse", F.array_join("accessions", ",").alias("accessions"))


def bridge_join(spark, sf_dir):
    samples, platforms = _t(spark, sf_dir, "gsm"), _t(spark, sf_dir, "platform")
    return samples.join(platforms.select("gpl", "technology"), "gpl").groupBy("technology").agg(F.count("*").alias("n_samples"), F.countDistinct("gse").alias("n_series"))


def left_join_coverage(spark, sf_dir):
    series = _t(spark, sf_dir, "series")
    vectors = series.where(usable(F.col("embedding"), 384)).select("gse")
    records = _t(spark, sf_dir, "record_ref")
    return I.coverage(series, {"series_384": vectors, "record_ref": records}, "gse")


def dup_keys(spark, sf_dir):
    return RU.duplicate_keys(_t(spark, sf_dir, "gsm"), ["gsm"])


def set_equality_audit(spark, sf_dir):
    declared = _t(spark, sf_dir, "documents").where("gse is not null and gpl is not null")
    return RU.set_audit(declared, _t(spark, sf_dir, "gsm").where("gse is not null and gpl is not null"), "gse", "gpl")


def anti_join_missing(spark, sf_dir):
    return I.missing(_t(spark, sf_dir, "series"), _t(spark, sf_dir, "record_ref"), "gse").select("gse")


def _delta(spark, sf_dir):
    return _t(spark, sf_dir, "series").where(F.col("last_update_date") >= F.lit(CUT).cast("date"))


def delta_keys(spark, sf_dir):
    return I.delta_keys(_t(spark, sf_dir, "series"), _t(spark, sf_dir, "record_ref"), _delta(spark, sf_dir), "gse")


def overlay_merge(spark, sf_dir):
    base = _t(spark, sf_dir, "record_ref").select("gse", F.col("embed_text").alias("text"))
    delta = _delta(spark, sf_dir).select("gse", F.col("search_text").alias("text"))
    merged = I.overlay(_t(spark, sf_dir, "series"), base, delta, "gse", "text")
    return merged.select("gse", "origin", F.md5("text").alias("digest"))


def _newest(name):
    """What makes a version of a sample the latest; equals in time go by their texts, so that the order is total."""
    return [F.col(c) for c in ("loaded_at", "last_update_date", "title", "source_name_ch1", "characteristics_ch1", "gse")]


def latest_version(spark, sf_dir):
    return I.latest(_t(spark, sf_dir, "gsm"), "gsm", _newest("gsm")).select("gsm", "gse", "title", F.col("loaded_at").cast("string").alias("loaded_at"))


def upsert_batch(spark, sf_dir):
    rows = I.latest(_t(spark, sf_dir, "gsm"), "gsm", _newest("gsm")).select("gsm", "gse", "loaded_at")
    late = F.col("loaded_at") >= F.lit(CUT).cast("timestamp_ntz")
    current = rows.where(~late | (F.length("gsm") % 2 == 0)).withColumn("origin", F.lit("current"))
    batch = rows.where(late).withColumn("origin", F.lit("batch"))
    return I.upsert(current, batch, "gsm").groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("gse").alias("n_series"))


def hash_sample(spark, sf_dir):
    h = F.conv(F.left(F.md5("gse"), F.lit(8)), 16, 10).cast("long")
    return _t(spark, sf_dir, "series").where(h % 1_000_000 < 100_000).select("gse")


def chunking(spark, sf_dir):
    return RU.chunks(_t(spark, sf_dir, "series").select("id", "gse"), ["id"], 250).groupBy("chunk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def length_buckets(spark, sf_dir):
    b = RU.length_bucket(F.length("search_text"))
    return _t(spark, sf_dir, "series").where("search_text is not null").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.length("search_text") > 8192).alias("n_truncated"))


def shard_packing(spark, sf_dir):
    rows = _t(spark, sf_dir, "series").select("id", F.octet_length("search_text").alias("bytes"))
    return RU.shards(rows, ["id"], "bytes", 1000, 200_000)


def shard_digests(spark, sf_dir):
    """The shards of request lines with their sizes and digests."""
    rows = _t(spark, sf_dir, "record_ref").select("gse", F.to_json(F.struct("gse", "title")).alias("line"))
    return RU.shard_digests(RU.shards(rows.withColumn("bytes", F.octet_length("line") + 1), ["gse"], "bytes", 1000, 50_000), "line", ["gse"]).drop("digest")


def _runs(spark, sf_dir):
    """Two rankings of series per platform, and graded judgments; all derived from the sample table."""
    pairs = _t(spark, sf_dir, "gsm").where("gpl is not null and gse is not null").groupBy("gpl", "gse").agg(F.count("*").alias("n"), F.countDistinct("molecule_ch1").alias("m"))
    one = Window.partitionBy("gpl").orderBy(F.desc("n"), "gse")
    two = Window.partitionBy("gpl").orderBy(F.desc("m"), F.desc("n"), "gse")
    base = pairs.withColumn("rank_a", F.row_number().over(one)).withColumn("rank_b", F.row_number().over(two))
    run = lambda c: base.select(F.col("gpl").alias("query_id"), F.col("gse").alias("doc_id"), F.col(c).alias("rank"))
    grades = _t(spark, sf_dir, "series").select(F.col("gse").alias("doc_id"), F.pmod("n_samples", F.lit(4)).alias("grade"))
    qrels = base.select(F.col("gpl").alias("query_id"), F.col("gse").alias("doc_id")).join(grades.where("grade is not null"), "doc_id")
    return run("rank_a"), run("rank_b"), qrels


def eval_metrics(spark, sf_dir):
    a, _, qrels = _runs(spark, sf_dir)
    m = E.query_metrics(a, qrels, 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "rr", "ndcg")])


def eval_summary(spark, sf_dir):
    a, _, qrels = _runs(spark, sf_dir)
    return E.summary(E.query_metrics(a, qrels, 10)).select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def overlap_at_k(spark, sf_dir):
    a, b, _ = _runs(spark, sf_dir)
    return E.overlap(a, b, 5)


def judgment_places(spark, sf_dir):
    a, b, qrels = _runs(spark, sf_dir)
    return E.judgment_places(qrels, a.where("rank <= 40"), b.where("rank <= 10"))


def percentiles(spark, sf_dir):
    rows = _t(spark, sf_dir, "series").select("organism_status", F.col("n_samples").cast("double").alias("x"))
    return E.percentiles(rows, ["organism_status"], "x").select("organism_status", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def constraint_violations(spark, sf_dir):
    samples = _t(spark, sf_dir, "gsm").select(F.col("gpl").alias("query_id"), "gse").distinct()
    results = samples.join(_t(spark, sf_dir, "series").select("gse", "sex_ids", "assay_categories"), "gse")
    return violations(results, Filters.of({"sex_ids": ["PATO:9000383"]}))


def latency_and_cost(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    total = E.total_latency(F.col("event_type") == "view", F.col("value"), F.col("value") / 2, F.lit(1.5))
    price = E.cost(F.col("event_id") % 1000, F.col("user_id") % 100, 3.0, 15.0)
    return e.groupBy("event_type").agg(F.round(F.max(total), 6).alias("latency"), F.round(F.avg(price), 9).alias("cost"))


QUERIES = {f.__name__: f for f in (
    rollup_distinct, rollup_two_level, sample_accessions, bridge_join, left_join_coverage, dup_keys, set_equality_audit, anti_join_missing, delta_keys,
    overlay_merge, latest_version, upsert_batch, hash_sample, chunking, length_buckets, shard_packing, shard_digests, eval_metrics, eval_summary, overlap_at_k,
    judgment_places, percentiles, constraint_violations, latency_and_cost)}

_SET = "array_to_string(coalesce(list_sort(list(DISTINCT {c}) FILTER (trim({c}, ' ') <> '')), []), '|') AS {c}"
_USABLE = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gsm ORDER BY loaded_at DESC NULLS LAST, last_update_date DESC NULLS LAST,
  title DESC NULLS LAST, source_name_ch1 DESC NULLS LAST, characteristics_ch1 DESC NULLS LAST, gse DESC NULLS LAST) AS rn FROM gsm) WHERE rn = 1)"""
_RUNS = """pairs AS (SELECT gpl, gse, count(*) AS n, count(DISTINCT molecule_ch1) AS m FROM gsm WHERE gpl IS NOT NULL AND gse IS NOT NULL GROUP BY gpl, gse),
base AS (SELECT gpl AS query_id, gse AS doc_id, row_number() OVER (PARTITION BY gpl ORDER BY n DESC, gse) AS rank_a, row_number() OVER (PARTITION BY gpl ORDER BY m DESC, n DESC, gse) AS rank_b FROM pairs),
qrels AS (SELECT query_id, doc_id, n_samples % 4 AS grade FROM base JOIN series ON doc_id = gse WHERE n_samples IS NOT NULL)"""
_METRICS = f"""{_RUNS}, j AS (SELECT query_id, doc_id, grade, rank_a AS rank, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS ideal FROM qrels LEFT JOIN base USING (query_id, doc_id)),
met AS (SELECT query_id, CASE WHEN sum((grade > 0)::INT) > 0 THEN sum((grade > 0 AND rank <= 10)::INT)::DOUBLE / sum((grade > 0)::INT) ELSE 0.0 END AS recall,
  coalesce(1.0 / min(CASE WHEN grade > 0 THEN rank END), 0.0) AS rr,
  CASE WHEN sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) > 0
    THEN sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 10 THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) ELSE 0.0 END AS ndcg
  FROM j GROUP BY query_id)"""
SQL = {
    "rollup_distinct": "SELECT s.gse, count(g.gse) AS n_children, " + ", ".join(_SET.format(c=c) for c in ("gpl", "source_name_ch1", "organism_ch1", "molecule_ch1")) + " FROM (SELECT gse FROM series) s LEFT JOIN gsm g USING (gse) GROUP BY s.gse",
    "rollup_two_level": """SELECT gse, string_agg(e, ';' ORDER BY molecule_ch1) AS entries FROM (SELECT gse, molecule_ch1, molecule_ch1 || '=' || array_to_string(list_sort(list(DISTINCT gpl)), ',') AS e
FROM gsm WHERE molecule_ch1 IS NOT NULL AND gpl IS NOT NULL GROUP BY gse, molecule_ch1) GROUP BY gse""",
    "sample_accessions": "SELECT gse, string_agg(gsm, ',' ORDER BY substr(gsm, 4)::BIGINT) AS accessions FROM (SELECT DISTINCT gse, gsm FROM gsm WHERE regexp_matches(gsm, '^[A-Za-z]+[0-9]{1,18}$')) GROUP BY gse",
    "bridge_join": "SELECT technology, count(*) AS n_samples, count(DISTINCT gse) AS n_series FROM gsm JOIN platform USING (gpl) GROUP BY technology",
    "left_join_coverage": f"""SELECT 'series_384' AS model, (SELECT count(*) FROM series) AS n_docs, (SELECT count(*) FROM series WHERE {_USABLE}) AS n_vectors
UNION ALL SELECT 'record_ref', (SELECT count(*) FROM series), (SELECT count(*) FROM series WHERE gse IN (SELECT gse FROM record_ref))""",
    "dup_keys": "SELECT gsm, count(*) AS n FROM gsm GROUP BY gsm HAVING count(*) > 1",
    "set_equality_audit": """WITH d AS (SELECT gse, gpl, count(*) AS n FROM documents WHERE gse IS NOT NULL AND gpl IS NOT NULL GROUP BY ALL), a AS (SELECT gse, gpl, count(*) AS n FROM gsm WHERE gse IS NOT NULL AND gpl IS NOT NULL GROUP BY ALL),
b AS (SELECT coalesce(d.gse, a.gse) AS gse, coalesce(d.n, 0) AS dn, coalesce(a.n, 0) AS an FROM d FULL OUTER JOIN a ON d.gse = a.gse AND d.gpl = a.gpl)
SELECT gse, sum(greatest(dn - an, 0))::BIGINT AS n_missing, sum(greatest(an - dn, 0))::BIGINT AS n_undeclared, bool_and(dn = an) AS equal FROM b GROUP BY gse""",
    "shard_packing": """WITH RECURSIVE r AS (SELECT id, strlen(search_text) AS bytes, row_number() OVER (ORDER BY id) AS rn FROM series),
c AS (SELECT id, bytes, rn, 0::BIGINT AS shard, 1 AS rows, greatest(coalesce(bytes, 0), 0) AS total FROM r WHERE rn = 1
  UNION ALL SELECT r.id, r.bytes, r.rn, CASE WHEN c.rows >= 1000 OR c.total + coalesce(r.bytes, 0) > 200000 THEN c.shard + 1 ELSE c.shard END,
    CASE WHEN c.rows >= 1000 OR c.total + coalesce(r.bytes, 0) > 200000 THEN 1 ELSE c.rows + 1 END,
    CASE WHEN c.rows >= 1000 OR c.total + coalesce(r.bytes, 0) > 200000 THEN coalesce(r.bytes, 0) ELSE c.total + coalesce(r.bytes, 0) END FROM c JOIN r ON r.rn = c.rn + 1)
SELECT id, bytes::INT AS bytes, shard FROM c""",
    "anti_join_missing": "SELECT gse FROM series WHERE gse NOT IN (SELECT gse FROM record_ref WHERE gse IS NOT NULL)",
    "delta_keys": f"SELECT DISTINCT gse FROM series WHERE gse NOT IN (SELECT gse FROM record_ref WHERE gse IS NOT NULL) OR last_update_date >= DATE '{CUT}'",
    "overlay_merge": f"""SELECT s.gse, CASE WHEN d.gse IS NOT NULL THEN 'delta' WHEN b.embed_text IS NOT NULL THEN 'base' ELSE 'none' END AS origin,
md5(CASE WHEN d.gse IS NOT NULL THEN d.search_text ELSE b.embed_text END) AS digest
FROM (SELECT DISTINCT gse FROM series) s LEFT JOIN (SELECT gse, search_text FROM series WHERE last_update_date >= DATE '{CUT}') d USING (gse) LEFT JOIN record_ref b USING (gse)""",
    "latest_version": f"WITH {_LATEST} SELECT gsm, gse, title, rtrim(rtrim(strftime(loaded_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS loaded_at FROM latest",
    "upsert_batch": f"""WITH {_LATEST}, l AS (SELECT gsm, gse, loaded_at >= TIMESTAMP '{CUT} 00:00:00' AS late FROM latest)
SELECT CASE WHEN late THEN 'batch' ELSE 'current' END AS origin, count(*) AS n, count(DISTINCT gse) AS n_series FROM l WHERE late IS NOT NULL OR length(gsm) % 2 = 0 GROUP BY 1""",
    "hash_sample": "SELECT gse FROM series WHERE ('0x' || left(md5(gse), 8))::BIGINT % 1000000 < 100000",
    "chunking": "SELECT chunk, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 250)::INT AS chunk FROM series) GROUP BY chunk",
    "length_buckets": """SELECT CASE WHEN length(search_text) <= 512 THEN 512 WHEN length(search_text) <= 2048 THEN 2048 WHEN length(search_text) <= 4096 THEN 4096 ELSE 8192 END AS bucket,
count(*) AS n, count(*) FILTER (length(search_text) > 8192) AS n_truncated FROM series WHERE search_text IS NOT NULL GROUP BY 1""",
    "eval_metrics": f"WITH {_METRICS} SELECT query_id, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM met",
    "eval_summary": f"WITH {_METRICS} SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM met",
    "overlap_at_k": f"WITH {_RUNS} SELECT query_id, count(*) FILTER (rank_a <= 5 AND rank_b <= 5) AS n_shared FROM base GROUP BY query_id",
    "judgment_places": f"WITH {_RUNS} SELECT query_id, doc_id, grade, CASE WHEN rank_a <= 40 THEN rank_a END AS pool_rank, CASE WHEN rank_b <= 10 THEN rank_b END AS final_rank FROM qrels JOIN base USING (query_id, doc_id)",
    "percentiles": "SELECT organism_status, round(coalesce(quantile_cont(n_samples::DOUBLE, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont(n_samples::DOUBLE, 0.95), 0), 6) AS p95 FROM series GROUP BY organism_status",
    "constraint_violations": """SELECT query_id, count(*) FILTER (NOT coalesce(list_has_any(sex_ids, ['PATO:9000383']), false)) AS n_violations
FROM (SELECT DISTINCT gpl AS query_id, gse FROM gsm) JOIN series USING (gse) GROUP BY query_id""",
    "latency_and_cost": """SELECT event_type, round(max(CASE WHEN event_type = 'view' THEN value + value / 2 ELSE greatest(value, value / 2) END + 1.5), 6) AS latency,
round(avg(((event_id % 1000) * 3.0::DOUBLE + (user_id % 100) * 15.0::DOUBLE) / 1e6), 9) AS cost FROM events GROUP BY event_type""",
}
