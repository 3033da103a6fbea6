"""Queries of vector tables, evaluation runs, model comparison, crawling, and study text."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from orestrata.functions.text import surface
from orestrata.functions.vectors import usable
from orestrata.operators import embed as EM
from orestrata.operators import evaluate as E
from orestrata.operators import incremental as I
from orestrata.operators import retrieval as R
from orestrata.plans import search as S
from orestrata.plans.relational import CUT, _METRICS, _USABLE, _runs, _t
from orestrata.session import settle
from orestrata.sources import crawl as C
from orestrata.sources import soft

MODEL = EM.variant("bge_small_v15")


def toy_encoder():
    """Vectors from a checksum of the text; stands for a model."""
    def encode(texts):
        seeds = np.array([zlib.crc32(t.encode()) for t in texts], dtype=np.float64)[:, None]
        return np.sin(seeds * 1e-6 + np.arange(1, MODEL.dimensions + 1)[None, :])

    return encode


def _records(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "series").select("gse", "title", F.col("search_text").alias("embed_text"), "last_update_date")


def vector_build(spark, sf_dir):
    """An incremental build: the base has the older inventory, late records are encoded anew, and gone ones vanish."""
    old = _t(spark, sf_dir, "record_ref").select("gse", "title", "embed_text")
    base, _ = EM.build_vectors(old, None, MODEL, toy_encoder)
    records = _records(spark, sf_dir)
    late = records.where(F.col("last_update_date") >= F.lit(CUT).cast("date"))
    vectors, report = EM.build_vectors(records, base, MODEL, toy_encoder, replace=late)
    sizes = vectors.agg(F.count("*").alias("n_vectors"), F.count_if(F.size("vector") == MODEL.dimensions).alias("n_sized"))
    return sizes.select("*", *[F.lit(report[k]).cast("long").alias(k) for k in ("encoded", "kept", "deleted")])


def vector_attach(spark, sf_dir):
    """Records with the vector columns of two models: how many have which."""
    series = _t(spark, sf_dir, "series")
    one = series.where(usable(F.col("embedding"), 384)).select("gse", F.col("embedding").alias("vector"))
    two = _t(spark, sf_dir, "record_ref").select("gse", F.array(F.length("embed_text").cast("float")).alias("vector"))
    docs = I.index_documents(series.select("gse"), {"series_384": one, "record_ref": two})
    return docs.groupBy(F.col("series_384").isNotNull().alias("has_384"), F.col("record_ref").isNotNull().alias("has_ref")).agg(F.count("*").alias("n"))


def coverage_audit(spark, sf_dir):
    series = _t(spark, sf_dir, "series")
    return I.audited(series, {"series_384": series.where(usable(F.col("embedding"), 384)), "record_ref": _t(spark, sf_dir, "record_ref"), "itself": series}, "gse")


def vector_rows(spark, sf_dir):
    """Rows of the vector table by the number of the accession."""
    return EM.in_order(_t(spark, sf_dir, "record_ref").select("gse")).select("row", "gse")


def truncation_counts(spark, sf_dir):
    """Documents that are longer than each model reads, by their words."""
    out = None
    for name in EM.VARIANTS:
        one = EM.truncations(_records(spark, sf_dir), EM.variant(name))
        out = one if out is None else out.unionByName(one)
    return out


def document_templates(spark, sf_dir):
    """The texts that each model takes."""
    r = _records(spark, sf_dir)
    return r.select("gse", *[F.md5(EM.document_text(EM.variant(n))).alias(n) for n in EM.VARIANTS])


def delta_problems(spark, sf_dir):
    """A declared delta against target and base: the late records of the inventory, once more those of the base."""
    records, base = _records(spark, sf_dir), _t(spark, sf_dir, "record_ref")
    late = records.where(F.col("last_update_date") >= F.lit(CUT).cast("date")).select("gse")
    delta = late.unionByName(late.join(base.select("gse"), "gse", "left_semi")).unionByName(late.limit(0))
    return EM.plan_problems(delta, records, base)


# --- evaluation

def _case_inputs(spark, sf_dir):
    pool, final, qrels = _runs(spark, sf_dir)
    pairs = _t(spark, sf_dir, "gsm").where("gpl is not null and gse is not null").groupBy("gpl", "gse").agg(F.countDistinct("molecule_ch1").alias("m"))
    source = pairs.select(F.col("gpl").alias("query_id"), F.col("gse").alias("doc_id"), F.when(F.col("m") > 1, "ncbi").otherwise("local").alias("source"))
    n = pool.groupBy("query_id").agg(F.count("*").alias("c"))
    cases = n.select(
        "query_id", (F.col("c") == 1).alias("exact"), (F.col("c") * 7).alias("local_ms"), (F.col("c") * 5 + 3).alias("native_ms"), (F.col("c") % 11).alias("reranker_ms"),
        (F.col("c") > 3).alias("attempted"), (F.col("c") > 5).alias("applied"), (F.col("c") % 2 == 0).alias("degraded"), (F.col("c") * 10).alias("tokens_in"), F.col("c").alias("tokens_out"),
        F.col("c").alias("n_local"), F.floor(F.col("c") / 2).alias("n_native"), F.col("c").alias("native_count"), F.when(F.col("c") % 3 == 0, F.col("c") + 1).alias("expected_count"))
    return cases, pool.join(source, ["query_id", "doc_id"]), final.join(source, ["query_id", "doc_id"]), qrels


def eval_cases(spark, sf_dir):
    """One report a case."""
    r = E.case_reports(*_case_inputs(spark, sf_dir))
    return r.select("query_id", "judged", *[F.round(c, 6).alias(c) for c in ("recall_at_40", "merged_recall", "ndcg_at_10", "mrr")], "n_merged", "ncbi_only", F.col("total_ms").cast("double").alias("total_ms"), "count_differs")


def eval_aggregate(spark, sf_dir):
    """All cases together."""
    out = E.aggregate(E.case_reports(*_case_inputs(spark, sf_dir)), 3.0, 15.0)
    return out.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in out.columns])


def eval_compared(spark, sf_dir):
    """Two final rankings of the same cases, each with its aggregate: the baseline and the reranked one."""
    cases, pool, final, qrels = _case_inputs(spark, sf_dir)
    parts = [E.aggregate(E.case_reports(cases, pool, run, qrels), 3.0, 15.0).select(F.lit(name).alias("run"), F.round("mean_ndcg_at_10", 6).alias("ndcg"), F.round("mean_mrr", 6).alias("mrr")) for name, run in (("baseline", pool), ("reranked", final))]
    return parts[0].unionByName(parts[1])


COMPARED = {"q1": "heat stress liver", "q2": "chromatin accessibility mapping"}


def _compared_runs(spark, sf_dir) -> dict[str, DataFrame]:
    index = S._index(spark, sf_dir)
    runs = {}
    for model in ("title", "summary", "search_text"):
        out = None
        for q, words in COMPARED.items():
            hits = R.Searcher(_t(spark, sf_dir, "series"), {model: 1.0}, index=index).hits(words, "bm25", settings=R.Settings(topk=5))
            one = hits.select(F.lit(q).alias("query_id"), F.lit("bm25").alias("mode"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), F.col("id").alias("doc_id"))
            out = one if out is None else out.unionByName(one)
        runs[model] = settle(out, "run")
    return runs


def model_comparison(spark, sf_dir):
    """The first five of three retrievers side by side."""
    return E.side_by_side(_compared_runs(spark, sf_dir))


def model_overlaps(spark, sf_dir):
    return E.overlaps(_compared_runs(spark, sf_dir))


# --- acquisition and study text

def _answer(path: str) -> tuple[int, bytes]:
    """A file server whose answers follow from the accession's number; some are never there, some always busy."""
    key = path.split("/")[1]
    n = int(key[3:])
    if n % 7 == 0:
        return 404, b""
    if n % 11 == 0:
        return 503, b""
    title = b"" if n % 5 == 0 else b"!Series_title = t\n"
    return 200, b"^SERIES = " + key.encode() + b"\n" + title + b"^SAMPLE = GSM1\n"


def fetch_outcomes(spark, sf_dir):
    """Files of every catalog key without a record, by what became of them."""
    catalog = _t(spark, sf_dir, "series").select("gse")
    fetched = C.fetch_files(C.todo(catalog, _t(spark, sf_dir, "record_ref").limit(0)), _answer, wait=lambda s: None)
    text = F.decode("content", "UTF-8")
    return C.outcomes(fetched.withColumn("problems", soft.problems(text, F.col("key"))))


def _texts(spark, sf_dir) -> DataFrame:
    """(file, text, error): study texts written from the tables, a sample once by its latest version."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")
    samples = I.latest(_t(spark, sf_dir, "gsm").where("gse is not null"), "gsm", [F.col(c) for c in ("loaded_at", "last_update_date", "title", "source_name_ch1", "characteristics_ch1", "gse")])
    block = F.concat_ws(
        "\n", F.concat(F.lit("^SAMPLE = "), "gsm"), F.concat(F.lit("!Sample_geo_accession = "), "gsm"), F.concat(F.lit("!Sample_title = t "), flat(F.col("title"))),
        F.concat(F.lit("!Sample_organism_ch1 = "), flat(F.col("organism_ch1"))), F.concat(F.lit("!Sample_molecule_ch1 = "), flat(F.col("molecule_ch1"))), F.lit("!sample_table_begin\nx\ty\n!sample_table_end"))
    own = samples.groupBy("gse").agg(F.array_sort(F.collect_list(F.struct("gsm", block.alias("b")))).alias("s"))
    series = _t(spark, sf_dir, "series").join(own, "gse")
    head = F.concat_ws(
        "\n", F.concat(F.lit("^SERIES = "), "gse"), F.concat(F.lit("!Series_geo_accession = "), "gse"), F.concat(F.lit("!Series_title = s "), flat(F.col("title"))),
        F.array_join(F.transform("s", lambda x: F.concat(F.lit("!Series_sample_id = "), x["gsm"])), "\n"), F.array_join(F.transform("s", lambda x: x["b"]), "\n"))
    return series.select(F.concat("gse", F.lit("_family.soft.gz")).alias("file"), head.alias("text"), F.lit(None).cast("string").alias("error"))


def soft_records(spark, sf_dir):
    """Records parsed back from study texts."""
    r = soft.parse_records(_texts(spark, sf_dir).withColumn("text", soft.strip_tables(F.col("text"))))
    return r.select("gse", "error", "title", "n_samples", F.array_join("sample_accessions", ",").alias("accessions"), F.array_join("molecules", "|").alias("molecules"), F.size("organisms").alias("n_organisms"))


def soft_audit(spark, sf_dir):
    """Stripped texts against the raw ones: broken rules, and whether stripping gives them again."""
    texts = settle(_texts(spark, sf_dir).select(F.regexp_extract("file", "^(GSE[0-9]+)", 1).alias("gse"), "text"), "texts")
    stripped = texts.withColumn("text", soft.strip_tables(F.col("text")))
    return soft.validation_outcomes(soft.reconstruction(stripped, texts))


QUERIES = {f.__name__: f for f in (
    vector_build, vector_attach, coverage_audit, vector_rows, truncation_counts, document_templates, delta_problems, eval_cases, eval_aggregate, eval_compared, model_comparison,
    model_overlaps, fetch_outcomes, soft_records, soft_audit)}



def _n_words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{S._SPACE}+'), lambda w: w <> ''))"


_TEMPLATES = {
    "bge_small_v15": "coalesce(search_text, '')", "medcpt_v1": "coalesce(title, '') || chr(10) || coalesce(search_text, '')", "qwen3_06b_1024_v1": "coalesce(search_text, '')",
    "gemini_embedding_2_3072_v1": "'document: title: ' || coalesce(title, '') || ' | text: ' || coalesce(search_text, '')"}


def _metric(run: str, k: int) -> str:
    """CTE of recall, rr and ndcg at k over the ranks of a run."""
    return f"""j_{run}_{k} AS (SELECT query_id, doc_id, grade, rank_{run} AS rank, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS ideal FROM qrels LEFT JOIN base USING (query_id, doc_id)),
m_{run}_{k} AS (SELECT query_id, CASE WHEN sum((grade > 0)::INT) > 0 THEN sum((grade > 0 AND rank <= {k})::INT)::DOUBLE / sum((grade > 0)::INT) ELSE 0.0 END AS recall,
  coalesce(1.0 / min(CASE WHEN grade > 0 AND rank <= {k} THEN rank END), 0.0) AS rr,
  CASE WHEN sum(CASE WHEN ideal <= {k} THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) > 0
    THEN sum(CASE WHEN rank <= {k} THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ideal <= {k} THEN (pow(2, grade) - 1) / log2(ideal + 1) ELSE 0 END) ELSE 0.0 END AS ndcg
  FROM j_{run}_{k} GROUP BY query_id)"""


_CASES = f"""{_METRICS.split(', j AS')[0]}, {_metric('a', 40)}, {_metric('a', 200)}, {_metric('b', 10)}, {_metric('a', 10)},
src AS (SELECT gpl AS query_id, gse AS doc_id, CASE WHEN count(DISTINCT molecule_ch1) > 1 THEN 'ncbi' ELSE 'local' END AS source FROM gsm WHERE gpl IS NOT NULL AND gse IS NOT NULL GROUP BY ALL),
sized AS (SELECT query_id, count(*) AS c, count(*) FILTER (rank_b <= 10 AND source = 'ncbi') AS ncbi_only FROM base JOIN src USING (query_id, doc_id) GROUP BY query_id),
graded AS (SELECT query_id, max(grade) > 0 AS judged FROM qrels GROUP BY query_id),
rep AS (SELECT s.query_id, coalesce(g.judged, false) AS judged, coalesce(p.recall, 0) AS recall_at_40, coalesce(m.recall, 0) AS merged_recall, coalesce(f.ndcg, 0) AS ndcg_at_10, coalesce(f.rr, 0) AS mrr,
  coalesce(fa.ndcg, 0) AS base_ndcg, coalesce(fa.rr, 0) AS base_mrr, c AS n_merged, ncbi_only, (CASE WHEN c = 1 THEN c * 7 + c * 5 + 3 ELSE greatest(c * 7, c * 5 + 3) END + c % 11)::DOUBLE AS total_ms, c % 3 = 0 AS count_differs, c
  FROM sized s LEFT JOIN graded g USING (query_id) LEFT JOIN m_a_40 p USING (query_id) LEFT JOIN m_a_200 m USING (query_id) LEFT JOIN m_b_10 f USING (query_id) LEFT JOIN m_a_10 fa USING (query_id))"""


def _compared_sql() -> str:
    parts, tops = [], []
    for q, words in COMPARED.items():
        for model in ("title", "summary", "search_text"):
            parts.append(S._bm25(f"coalesce({model}, '')", f"{q}_{model}", query=words))
            tops.append(f"SELECT '{q}' AS query_id, 'bm25' AS mode, '{model}' AS model, rank, id AS doc_id FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {q}_{model}) WHERE rank <= 5")
    return "WITH " + ", ".join(parts) + ", tops AS (" + " UNION ALL ".join(tops) + ")"


_LATE = f"(SELECT gse FROM series WHERE last_update_date >= DATE '{CUT}')"
_SAMPLES = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gsm ORDER BY loaded_at DESC NULLS LAST, last_update_date DESC NULLS LAST, title DESC NULLS LAST, source_name_ch1 DESC NULLS LAST,
  characteristics_ch1 DESC NULLS LAST, gse DESC NULLS LAST) AS rn FROM gsm WHERE gse IS NOT NULL) WHERE rn = 1)"""
_FLAT = "trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"
SQL = {
    "vector_build": f"""SELECT (SELECT count(*) FROM series) AS n_vectors, (SELECT count(*) FROM series) AS n_sized,
(SELECT count(*) FROM series WHERE gse NOT IN (SELECT gse FROM record_ref) OR gse IN {_LATE}) AS encoded, (SELECT count(*) FROM series WHERE gse IN (SELECT gse FROM record_ref) AND gse NOT IN {_LATE}) AS kept,
(SELECT count(*) FROM record_ref WHERE gse NOT IN (SELECT gse FROM series)) AS deleted""",
    "vector_attach": f"SELECT coalesce({_USABLE}, false) AS has_384, gse IN (SELECT gse FROM record_ref) AS has_ref, count(*) AS n FROM series GROUP BY ALL",
    "coverage_audit": f"""SELECT *, n_docs = n_vectors AS complete FROM (SELECT 'series_384' AS model, count(*) AS n_docs, count(*) FILTER ({_USABLE}) AS n_vectors FROM series
UNION ALL SELECT 'record_ref', count(*), count(*) FILTER (gse IN (SELECT gse FROM record_ref)) FROM series UNION ALL SELECT 'itself', count(*), count(*) FROM series)""",
    "vector_rows": "SELECT row_number() OVER (ORDER BY substr(gse, 4)::BIGINT, gse) - 1 AS row, gse FROM record_ref",
    "truncation_counts": " UNION ALL ".join(f"SELECT '{n}' AS model, count(*) AS n, count(*) FILTER ({_n_words(t)} > {EM.VARIANTS[n].most_tokens}) AS n_truncated FROM series" for n, t in _TEMPLATES.items()),
    "document_templates": "SELECT gse, " + ", ".join(f"md5({t}) AS {n}" for n, t in _TEMPLATES.items()) + " FROM series",
    "delta_problems": f"""SELECT 'repeated' AS problem, count(*) AS n FROM series WHERE gse IN {_LATE} AND gse IN (SELECT gse FROM record_ref) UNION ALL SELECT 'outside', 0
UNION ALL SELECT 'omitted', count(*) FROM series WHERE gse NOT IN (SELECT gse FROM record_ref) AND gse NOT IN {_LATE}""",
    "eval_cases": f"WITH {_CASES} SELECT query_id, judged, round(recall_at_40, 6) AS recall_at_40, round(merged_recall, 6) AS merged_recall, round(ndcg_at_10, 6) AS ndcg_at_10, round(mrr, 6) AS mrr, n_merged, ncbi_only, total_ms, count_differs FROM rep",
    "eval_aggregate": f"""WITH {_CASES}, a AS (SELECT count(*) AS n_cases, count(*) FILTER (judged) AS n_judged, avg(recall_at_40) FILTER (judged) AS mean_recall_at_40, avg(merged_recall) FILTER (judged) AS mean_merged_recall,
avg(ndcg_at_10) FILTER (judged) AS mean_ndcg_at_10, avg(mrr) FILTER (judged) AS mean_mrr, sum(ncbi_only) AS ncbi_only_recovery, count(*) FILTER (count_differs) AS count_mismatches, count(*) FILTER (c > 3) AS attempted,
count(*) FILTER (c > 5) AS applied, sum(c * 10) AS tokens_in, sum(c) AS tokens_out, avg((c % 2 = 0)::INT) AS degradation_rate, avg((c > 3 AND c <= 5)::INT) AS fallback_rate, quantile_cont(total_ms, 0.5) AS latency_p50,
quantile_cont(total_ms, 0.95) AS latency_p95, avg(c) AS n_local_mean, max(c) AS n_local_max, avg(c // 2) AS n_native_mean, max(c // 2) AS n_native_max, avg(c) AS n_merged_mean, max(c) AS n_merged_max, (sum(c * 10) * 3.0::DOUBLE + sum(c) * 15.0::DOUBLE) / 1e6 AS cost FROM rep)
SELECT round(COLUMNS(*)::DOUBLE, 6) FROM a""",
    "eval_compared": f"WITH {_CASES} SELECT 'reranked' AS run, round(avg(ndcg_at_10) FILTER (judged), 6) AS ndcg, round(avg(mrr) FILTER (judged), 6) AS mrr FROM rep UNION ALL SELECT 'baseline', round(avg(base_ndcg) FILTER (judged), 6), round(avg(base_mrr) FILTER (judged), 6) FROM rep",
    "model_comparison": f"{_compared_sql()} SELECT query_id, mode, rank, max(doc_id) FILTER (model = 'title') AS title, max(doc_id) FILTER (model = 'summary') AS summary, max(doc_id) FILTER (model = 'search_text') AS search_text FROM tops GROUP BY query_id, mode, rank",
    "model_overlaps": f"""{_compared_sql()}, pairs AS (SELECT * FROM (VALUES ('title', 'summary'), ('title', 'search_text'), ('summary', 'search_text')) v("left", "right")), qs AS (SELECT DISTINCT query_id FROM tops)
SELECT qs.query_id, pairs."left", pairs."right", (SELECT count(*) FROM tops a JOIN tops b ON a.query_id = b.query_id AND a.doc_id = b.doc_id WHERE a.query_id = qs.query_id AND a.model = pairs."left" AND b.model = pairs."right") AS n_shared FROM qs, pairs""",
    "fetch_outcomes": """WITH n AS (SELECT substr(gse, 4)::BIGINT AS n FROM series), s AS (SELECT n, CASE WHEN n % 7 = 0 THEN 'pending' WHEN n % 11 = 0 THEN 'fail' ELSE 'ok' END AS status FROM n)
SELECT status, count(*) AS n, count(*) FILTER (status = 'ok' AND n % 5 = 0) AS n_invalid FROM s GROUP BY status""",
    "soft_records": f"""WITH {_SAMPLES}, o AS (SELECT gse, count(*)::INT AS n, string_agg(gsm, ',' ORDER BY substr(gsm, 4)::BIGINT) AS accessions,
  coalesce(list_sort(list(DISTINCT {_FLAT.format(x='molecule_ch1')}) FILTER ({_FLAT.format(x='molecule_ch1')} <> '')), []) AS molecules, count(DISTINCT {_FLAT.format(x='organism_ch1')}) FILTER ({_FLAT.format(x='organism_ch1')} <> '') AS n_organisms FROM last GROUP BY gse)
SELECT s.gse, NULL::VARCHAR AS error, trim('s ' || {_FLAT.format(x='s.title')}) AS title, o.n AS n_samples, accessions, array_to_string(molecules, '|') AS molecules, n_organisms::INT AS n_organisms FROM series s JOIN o USING (gse)""",
    "soft_audit": "SELECT count(*) AS n_files, 0::BIGINT AS n_broken, count(*) AS n_checked, 0::BIGINT AS n_differing FROM series WHERE gse IN (SELECT gse FROM gsm)",
}
