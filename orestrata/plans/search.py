"""Queries of retrieval, facets and candidate handling over ``series`` and ``gse_catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orestrata.functions.normalize import ASSAY_CATEGORIES, ASSAY_LABELS, SPECIES
from orestrata.functions.text import snippet, surface
from orestrata.functions.vectors import first_usable
from orestrata.operators import candidates as C
from orestrata.operators import facade as FA
from orestrata.operators import facets as FC
from orestrata.operators import retrieval as R
from orestrata.operators.filters import FACETS, Filters, leaks, misplaced
from orestrata.session import scratch_dir, table

QUERY = "heat stress liver transcript profiling"
#: A query whose words all stand together in some catalog rows.
WORDS = "liver transcript profiling"
FIELDS = ["title", "summary", "overall_design"]
WANTED = {"sex_ids": ["PATO:9000383", "PATO:9000384"], "assay_categories": ["chromatin", "transcript (seq)"]}
DIMS = 384
#: Name of the joined text among the indexed fields.
ALL = "surface"
_indexes: dict[tuple[str, str], R.TextIndex] = {}
_vectors: dict[tuple[str, str], list[float]] = {}


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "series")


def _index(spark: SparkSession, sf_dir: str) -> R.TextIndex:
    """The stored index of a data folder, written to the shared folder by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        texts = {**{f: F.col(f) for f in R.BOOSTS}, ALL: surface(FIELDS)}
        source = _series(spark, sf_dir).select("id", *R.BOOSTS)
        _indexes[key] = R.TextIndex.build(source, texts, f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}")
    return _indexes[key]


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query's vector: that of the first usable row, as a model would give it; read once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _vectors:
        _vectors[key] = first_usable(_series(spark, sf_dir), "embedding", DIMS)
    return _vectors[key]


def _searcher(spark, sf_dir, boosts=None) -> R.Searcher:
    return R.Searcher(_series(spark, sf_dir), boosts, index=_index(spark, sf_dir))


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def bm25_single(spark, sf_dir):
    """By scan: one pass for the statistics, one for the scores."""
    return _scored(R.bm25(_series(spark, sf_dir), surface(FIELDS), QUERY, 20))


def bm25_filtered(spark, sf_dir):
    return _scored(R.bm25(_series(spark, sf_dir), surface(FIELDS), QUERY, 20, Filters.of(WANTED)))


def bm25_multifield(spark, sf_dir):
    """From the stored index: all fields in one pass over the postings of the query's terms."""
    return _scored(_searcher(spark, sf_dir).hits(QUERY, "bm25", settings=R.Settings(topk=20)))


def bm25_multifield_scan(spark, sf_dir):
    return _scored(R.bm25_fields(_series(spark, sf_dir), QUERY, 20))


def bm25_blank(spark, sf_dir):
    return R.bm25_fields(_series(spark, sf_dir), "  ", 20, Filters.of(WANTED))


def bm25_from_postings(spark, sf_dir):
    return _scored(_searcher(spark, sf_dir, {ALL: 1.0}).hits(QUERY, "bm25", settings=R.Settings(topk=20)))


def knn_cosine(spark, sf_dir):
    return _scored(R.dense(_series(spark, sf_dir), "embedding", _vector(spark, sf_dir), 20))


def knn_cosine_filtered(spark, sf_dir):
    return _scored(R.dense(_series(spark, sf_dir), "embedding", _vector(spark, sf_dir), 20, Filters.of(WANTED)))


def _hybrid(spark, sf_dir, tie, filters=Filters()):
    return _scored(_searcher(spark, sf_dir, {ALL: 1.0}).hits(QUERY, "hybrid", _vector(spark, sf_dir), filters, R.Settings(topk=20), tie))


def hybrid_rrf_native(spark, sf_dir):
    return _hybrid(spark, sf_dir, "row_number")


def hybrid_rrf_rank(spark, sf_dir):
    return _hybrid(spark, sf_dir, "rank")


def hybrid_rrf_filtered(spark, sf_dir):
    return _hybrid(spark, sf_dir, "row_number", Filters.of(WANTED))


def hit_checks(spark, sf_dir):
    """Of a filtered search of every mode: hits, hits that break a filter, hits out of order (both 0)."""
    out, filters = None, Filters.of(WANTED)
    for mode in ("bm25", "dense", "hybrid"):
        hits = _searcher(spark, sf_dir).hits(QUERY, mode, _vector(spark, sf_dir), filters, R.Settings(topk=50)).select("id", "score")
        ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
        full = R.hydrate(ranked, _series(spark, sf_dir), list(filters.wanted), page=50)
        one = full.agg(F.lit(mode).alias("mode"), F.count("*").alias("n_hits")).crossJoin(leaks(full, filters).agg(F.count("*").alias("n_leaks"))).crossJoin(misplaced(ranked).agg(F.count("*").alias("n_misplaced")))
        out = one if out is None else out.unionByName(one)
    return out


def filter_or_and(spark, sf_dir):
    return Filters.of(WANTED).apply(_series(spark, sf_dir)).select("id", "gse")


def facet_exact(spark, sf_dir):
    return FC.exact_facets(_series(spark, sf_dir), Filters.of(WANTED), limit=50)


def facet_unfiltered(spark, sf_dir):
    return FC.exact_facets(_series(spark, sf_dir), Filters(), limit=50)


def facet_candidate_pool(spark, sf_dir):
    """Four pools of the 1,000 best by words, from one scoring."""
    pools = _searcher(spark, sf_dir, {ALL: 1.0}).pools(QUERY, "bm25", filters=Filters.of(WANTED))
    return FC.pool_facets(pools, 50)


def facet_driver(spark, sf_dir):
    """Facets of a blank query: counts over all matches."""
    return FC.facets(_searcher(spark, sf_dir), "  ", "bm25", filters=Filters.of(WANTED))


def facet_vocabulary(spark, sf_dir):
    return FC.checked_vocabulary(_series(spark, sf_dir))


def facet_labels(spark, sf_dir):
    v = FC.vocabulary(_series(spark, sf_dir), ("sex_ids", "organism_ids"))
    label = F.when(F.col("field") == "sex_ids", FC.display_label("sex_ids", F.col("value"))).otherwise(FC.display_label("organism_ids", F.col("value")))
    return v.select("field", "value", label.alias("label"))


def facet_document(spark, sf_dir):
    series = _series(spark, sf_dir)
    first = series.agg(F.min("gse").alias("gse"))
    return FC.document_facets(series.join(F.broadcast(first), "gse"))


def status_distribution(spark, sf_dir):
    series = _series(spark, sf_dir)
    parts = [FC.status_distribution(series, c).withColumn("field", F.lit(c)) for c in ("organism_status", "sex_status", "assay_status")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def top_values(spark, sf_dir):
    series = _series(spark, sf_dir)
    a = FC.top_values(series, "assay_labels", 12).withColumn("field", F.lit("assay_labels"))
    return a.unionByName(FC.top_values(series, "organism_ids", 6).withColumn("field", F.lit("organism_ids")))


def exact_lookup(spark, sf_dir):
    series = _series(spark, sf_dir)
    key = series.agg(F.max("gse")).first()[0]
    return series.where(F.col("gse") == F.upper(F.trim(F.lit(f"  {key.lower()} ")))).select("gse", "title", "n_samples")


def _placed_hits(hits: DataFrame, name: str) -> DataFrame:
    return hits.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias(name), "score")


def multi_get(spark, sf_dir):
    series = _series(spark, sf_dir)
    hits = _placed_hits(R.bm25(series, surface(FIELDS), QUERY, 20), "rank").select("id", "rank")
    return R.hydrate(hits, series, ["gse", "title"], page=20).select("rank", "id", "gse", "title")


def grep_lines(spark, sf_dir):
    found = R.grep(_series(spark, sf_dir), "gse", "summary", "Half of the", keys=10, per_key=2)
    return found.select("key", "line_no", snippet(F.col("line"), "Half of the").alias("snippet"))


def native_candidates(spark, sf_dir):
    """Candidates of the keyword search of the catalog."""
    found = C.native_search(table(spark, sf_dir, "gse_catalog"), WORDS)
    return found.select("gse", "uid", "native_rank", "title", "snippet", "study_type", "taxon", F.array_join("organism_ids", "|").alias("organism_ids"), "organism_status", F.array_join("assay_labels", "|").alias("assay_labels"), "assay_status")


def native_catalog(spark, sf_dir):
    """Every study row of the catalog as a candidate, with its statuses."""
    return C.native_candidates(table(spark, sf_dir, "gse_catalog")).groupBy("organism_status", "sex_status", "assay_status").agg(F.count("*").alias("n"), F.countDistinct("gse").alias("n_keys"))


def native_membership(spark, sf_dir):
    """Which of the hits of a search the catalog's keyword search has too."""
    series, catalog = _series(spark, sf_dir), table(spark, sf_dir, "gse_catalog")
    hits = R.hydrate(R.bm25(series, surface(FIELDS), WORDS, 50).select("id"), series, ["gse"], page=50)
    return C.membership(hits, C.matching(catalog, WORDS))


def _local(spark, sf_dir, hits: DataFrame, page: int) -> DataFrame:
    columns = ["gse", "title", "summary", "type", "n_samples", "pubmed_id", *FACETS, "organism_status", "sex_status", "assay_status"]
    return C.local_candidates(R.hydrate(_placed_hits(hits, "original_rank"), _series(spark, sf_dir), columns, page=page))


def local_documents(spark, sf_dir):
    """Candidates from documents: of a page of hits every capped field."""
    found = _local(spark, sf_dir, R.bm25(_series(spark, sf_dir), surface(FIELDS), WORDS, 40), 40)
    arrays = ["organism_ids", "sex_ids", "assay_categories", "assay_labels", "truncated_fields"]
    return found.select("gse", "original_rank", "title", "snippet", "study_type", "n_samples", "pubmed_id", "sex_status", *[F.array_join(a, "|").alias(a) for a in arrays])


def _merged(spark, sf_dir):
    local = _local(spark, sf_dir, R.bm25(_series(spark, sf_dir), surface(FIELDS), WORDS, 40), 40)
    return C.merge(local, C.native_search(table(spark, sf_dir, "gse_catalog"), WORDS))


def merge_candidates(spark, sf_dir):
    return _merged(spark, sf_dir).select("gse", "original_rank", "native_rank", "source", "title")


def merge_filtered(spark, sf_dir):
    """Merged under a filter: native rows without the field can't prove it."""
    filters = Filters.of({"sex_ids": WANTED["sex_ids"]})
    local = _local(spark, sf_dir, R.bm25(_series(spark, sf_dir), surface(FIELDS), WORDS, 40, filters), 40)
    return C.merge(local, C.native_search(table(spark, sf_dir, "gse_catalog"), WORDS), filters).select("gse", "original_rank", "native_rank", "source")


def candidate_problems(spark, sf_dir):
    """Candidates and broken rules of the merged pool, by source."""
    merged = _merged(spark, sf_dir)
    bad = C.problems_of(merged).groupBy("gse").agg(F.count("*").alias("bad"))
    return merged.join(bad, "gse", "left").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("n_problems"))


def fallback_order(spark, sf_dir):
    return C.placed(_merged(spark, sf_dir), C.fallback_order(), 50).select("final_rank", "gse", "source")


def rerank_order(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    scores = merged.select("gse", F.pmod(F.length("title"), F.lit(101)).alias("rerank_score")).na.fill(0)
    return C.rerank(merged, scores, 50).select("final_rank", "gse", "rerank_score")


def candidate_caps(spark, sf_dir):
    rows = C.result_rows(_series(spark, sf_dir), {"title": 60, "summary": 300, "type": 30}, ["organism_ids", "assay_labels"])
    return rows.select("gse", "title", F.length("summary").alias("summary_chars"), F.array_join("truncated_fields", "|").alias("truncated_fields"))


def display_tags(spark, sf_dir):
    s = _series(spark, sf_dir)
    return s.select("gse", F.array_join(C.display_tags(F.col("organism_ids"), F.col("assay_labels"), F.col("type")), " / ").alias("tags"))


def study_urls(spark, sf_dir):
    return C.study_urls(_series(spark, sf_dir).select("gse", "pubmed_id"))


# --- the facade

def _engine(spark, sf_dir, rerank=None, vocabulary=None, index=True) -> FA.SearchEngine:
    vector = _vector(spark, sf_dir)
    searcher = _searcher(spark, sf_dir) if index else R.Searcher(_series(spark, sf_dir))
    return FA.SearchEngine(searcher, table(spark, sf_dir, "gse_catalog"), lambda q: vector, rerank, vocabulary, R.Settings(deep=200))


def unified_search(spark, sf_dir):
    """Hybrid local hits and native keyword hits, merged, in fallback order, with their metadata, as one plan."""
    hits = _searcher(spark, sf_dir).hits(WORDS, "hybrid", _vector(spark, sf_dir), settings=R.Settings(topk=100)).select("id", "score")
    local = _local(spark, sf_dir, hits, 100)
    native = C.native_search(table(spark, sf_dir, "gse_catalog"), WORDS)
    return C.placed(C.merge(local, native), C.fallback_order(), 50).select("final_rank", "gse", "source", "original_rank", "native_rank", "title")


def _by_title(query, candidates, limit):
    return FA.Scores({c["gse"]: len(c["title"] or "") % 101 for c in candidates}, 10 * len(candidates), len(candidates))


def unified_reranked(spark, sf_dir):
    """A request with a scorer: the page of 50 by its scores."""
    done = _engine(spark, sf_dir, _by_title).search_datasets(WORDS, limit=50)
    return done.frame(spark).select("rank", "gse", "score", "source", "original_rank", "native_rank", F.lit(done.provenance["rerank_applied"]).alias("applied"))


def unified_degraded(spark, sf_dir):
    """The same with a scorer that leaves a candidate out, and a native source that times out: fallback order, both reported."""
    def short(query, candidates, limit):
        return FA.Scores({c["gse"]: 1 for c in candidates[1:]})

    engine = _engine(spark, sf_dir, short)

    def late(query, limit):
        raise ConnectionError("no answer") from TimeoutError()

    engine._native_search = late
    done = engine.search_datasets(WORDS, limit=10)
    return done.frame(spark).select("rank", "gse", "source", F.lit("|".join(done.provenance["degradation"])).alias("degradation"))


def search_with_facets(spark, sf_dir):
    """Facets of a filtered request: hybrid pools of 1,000, each without its field's own condition."""
    done = _engine(spark, sf_dir, vocabulary=FC.vocabulary(_series(spark, sf_dir))).search_datasets(QUERY, Filters.of(WANTED), 10)
    return done.facets.select("field", "value", "n", "label", "scope", "candidate_count")


def facet_browse(spark, sf_dir):
    """Values of one facet under the filters of the others, without and with a query."""
    engine = _engine(spark, sf_dir)
    one, two = engine.facet_values("assay_labels", None, Filters.of(WANTED), 20), engine.facet_values("assay_labels", QUERY, Filters.of(WANTED), 20)
    return one.unionByName(two).select("field", "value", "n", "scope", "candidate_count")


def _accessions(spark, sf_dir) -> list[str]:
    """An accession the table has, one only the catalog has if there is any, one neither has."""
    series, catalog = _series(spark, sf_dir), C.native_candidates(table(spark, sf_dir, "gse_catalog"))
    only = catalog.select("gse").join(series.select("gse"), "gse", "left_anti").agg(F.min("gse")).first()[0]
    return [a for a in (series.agg(F.max("gse")).first()[0], only, "GSE999999999") if a is not None]


def exact_search(spark, sf_dir):
    """Requests by accession: from the own table, else from the catalog, else nothing."""
    engine, rows = _engine(spark, sf_dir, index=False), []
    for a in _accessions(spark, sf_dir):
        done = engine.search_datasets(a.lower())
        first = done.results[0] if done.results else {}
        rows.append((a, first.get("source"), first.get("title"), first.get("organism_status"), done.provenance["retrieval_version"], len(done.results)))
    return spark.createDataFrame(rows, "accession string, source string, title string, organism_status string, version string, n_results int")


def dataset_detail(spark, sf_dir):
    """One dataset in full, for the accession with the longest summary."""
    key = _series(spark, sf_dir).agg(F.max_by("gse", F.struct(F.length("summary"), "gse"))).first()[0]
    d = _engine(spark, sf_dir, index=False).get_dataset(key)
    return d.select("gse", "title", F.md5("summary").alias("summary"), F.length("overall_design").alias("design_chars"), "pubmed_id", "geo_url", "pubmed_url", F.array_join("truncated_fields", "|").alias("truncated_fields"))


QUERIES = {f.__name__: f for f in (
    bm25_single, bm25_filtered, bm25_multifield, bm25_multifield_scan, bm25_blank, bm25_from_postings, knn_cosine, knn_cosine_filtered, hybrid_rrf_native, hybrid_rrf_rank,
    hybrid_rrf_filtered, hit_checks, filter_or_and, facet_exact, facet_unfiltered, facet_candidate_pool, facet_driver, facet_vocabulary, facet_labels, facet_document,
    status_distribution, top_values, exact_lookup, multi_get, grep_lines, native_candidates, native_catalog, native_membership, local_documents, merge_candidates, merge_filtered,
    candidate_problems, fallback_order, rerank_order, candidate_caps, display_tags, study_urls, unified_search, unified_reranked, unified_degraded, search_with_facets,
    facet_browse, exact_search, dataset_detail)}

# --- SQL --------------------------------------------------------------------------------------------------------------



def _terms(query: str) -> str:
    return "[" + ", ".join(f"'{t}'" for t in query.split()) + "]"


def _words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


_SURFACE = "concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(overall_design, ''))"


def _condition(skip: str | None = None) -> str:
    parts = [f"coalesce(list_has_any({f}, [{', '.join(repr(v) for v in values)}]), false)" for f, values in WANTED.items() if f != skip]
    return " AND ".join(parts) or "true"


def _bm25(expr: str, name: str, condition: str = "true", boost: float = 1.0, query: str = QUERY) -> str:
    """CTE bodies that end in ``name`` (id, score)."""
    return f"""
{name}_w AS (SELECT id, {_words(expr)} AS w, {condition} AS ok FROM series),
{name}_d AS (SELECT id, w, ok, len(w) AS dl FROM {name}_w WHERE len(w) > 0),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_d),
{name}_f AS (SELECT id, ok, dl, t.term, len(list_filter(w, lambda x: x = t.term)) AS tf FROM {name}_d, (SELECT unnest({_terms(query)}) AS term) t),
{name}_q AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM {name}_f GROUP BY term),
{name} AS (SELECT id, {boost} * round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM {name}_f JOIN {name}_q USING (term), {name}_s WHERE tf > 0 AND ok GROUP BY id)"""


_USABLE = f"len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def _knn(name: str, condition: str = "true") -> str:
    return f"""
{name}_u AS (SELECT id, embedding::DOUBLE[] AS v, {condition} AS ok FROM series WHERE {_USABLE}),
{name} AS (SELECT u.id, round(list_cosine_similarity(u.v, q.v), 9) AS score FROM {name}_u u, (SELECT v FROM {name}_u ORDER BY id LIMIT 1) q WHERE u.ok)"""


def _top(name: str, k: int) -> str:
    return f"SELECT id, round(score, 6) AS score FROM (SELECT id, score FROM {name} ORDER BY score DESC, id LIMIT {k})"


def _fuse(tie: str, condition: str = "true", k: int = 20, deep: int = 200) -> str:
    place = "row_number() OVER (ORDER BY score DESC, id)" if tie == "row_number" else "rank() OVER (ORDER BY score DESC)"
    return f"""WITH {_bm25(_SURFACE, 'b', condition)}, {_knn('k', condition)},
bt AS (SELECT id, score FROM b ORDER BY score DESC, id LIMIT {deep}), kt AS (SELECT id, score FROM k ORDER BY score DESC, id LIMIT {deep}),
br AS (SELECT id, {place} AS rk FROM bt), kr AS (SELECT id, {place} AS rk FROM kt),
f AS (SELECT id, coalesce(1.0 / (60 + br.rk), 0) + coalesce(1.0 / (60 + kr.rk), 0) AS score, br.rk AS bm25_rank, kr.rk AS dense_rank FROM br FULL OUTER JOIN kr USING (id))"""


def _facets(source: str, conditions: dict[str, str], limit: int = 50) -> str:
    parts = [f"SELECT '{f}' AS field, unnest(list_distinct({f})) AS value FROM {source} WHERE {conditions[f]}" for f in FACETS]
    return f"""SELECT field, value, n FROM (SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rn FROM (
  SELECT field, value, count(*) AS n FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL GROUP BY field, value)) WHERE rn <= {limit}"""


_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _labels(x: str) -> str:
    return "list_filter([" + ", ".join("CASE WHEN regexp_matches(%s, '(?i)%s') THEN '%s' END" % (x, p.replace("'", "''"), label) for p, label in ASSAY_LABELS) + "], lambda x: x IS NOT NULL)"


def _kinds(x: str) -> str:
    return "list_filter([" + ", ".join("CASE WHEN regexp_matches(lower(%s), '(?i)%s') THEN '%s' END" % (x, p, label) for p, label in ASSAY_CATEGORIES) + "], lambda x: x IS NOT NULL)"


_SPECIES = "CASE lower(x) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPECIES.items()) + " END"
#: CTE ``cand``: every study row of the catalog as a candidate.
_CATALOG = f"""
nat0 AS (SELECT upper(trim(accession)) AS gse, uid, nullif(left(coalesce(title, ''), 500), '') AS title, nullif(left(coalesce(summary, ''), 1000), '') AS snippet,
   nullif(left(coalesce(gdstype, ''), 200), '') AS study_type, nullif(left(coalesce(taxon, ''), 256), '') AS taxon, pdat, crawled_at FROM {{source}}
  WHERE upper(trim(entrytype)) = 'GSE' AND regexp_matches(upper(trim(accession)), '^GSE[1-9][0-9]*$')),
nat1 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(taxon, '[,;]'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') AS names,
  concat_ws(' ', study_type, title, snippet) AS free FROM nat0),
nat2 AS (SELECT *, list_distinct(list_filter(list_transform(names, lambda x: {_SPECIES}), lambda x: x IS NOT NULL)) AS ids, {_labels('free')} AS labels, {_kinds("coalesce(study_type, '')")} AS kinds FROM nat1),
cand AS (SELECT *, array_to_string(coalesce(ids, []), '|') AS organism_ids, CASE WHEN taxon IS NULL THEN 'unavailable' WHEN len(names) = 0 THEN 'absent' WHEN len(ids) > 0 THEN 'mapped' ELSE 'unmapped' END AS organism_status,
  array_to_string(labels, '|') AS assay_labels, CASE WHEN len(labels) > 0 THEN 'detailed' WHEN len(kinds) > 0 THEN 'category' ELSE 'unavailable' END AS assay_status FROM nat2)"""
#: CTEs ``match`` (rows that hold all words) and ``native`` (ranked candidates).
_MATCH = f"""match AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY crawled_at DESC NULLS LAST, title DESC NULLS LAST) AS k FROM gse_catalog)
  WHERE k = 1 AND upper(trim(entrytype)) = 'GSE' AND list_has_all({_words("concat_ws(' ', title, summary)")}, {_terms(WORDS)}))"""
_NATIVE = f"""{_MATCH}, page AS (SELECT * FROM match ORDER BY pdat DESC NULLS LAST, uid LIMIT 100), {_CATALOG.replace('{source}', 'page')},
native AS (SELECT *, row_number() OVER (ORDER BY pdat DESC NULLS LAST, uid) AS native_rank FROM cand)"""


def _merge_sql(local: str, fits: str = "true") -> str:
    return f"""{local}, {_NATIVE}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gse ORDER BY native_rank) AS once FROM native) WHERE once = 1),
merged AS (SELECT coalesce(l.gse, n.gse) AS gse, l.original_rank, n.native_rank,
  CASE WHEN l.gse IS NOT NULL AND n.gse IS NOT NULL THEN 'both' WHEN l.gse IS NOT NULL THEN 'local' ELSE 'ncbi' END AS source,
  coalesce(nullif(l.title, ''), n.title) AS title FROM local l FULL OUTER JOIN first n ON l.gse = n.gse WHERE l.gse IS NOT NULL OR {fits})"""


def _local_sql(condition: str = "true") -> str:
    return f"""WITH {_bm25(_SURFACE, 'b', condition, query=WORDS)}, hits AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS original_rank FROM (SELECT id, score FROM b ORDER BY score DESC, id LIMIT 40)),
local AS (SELECT s.gse, h.original_rank, left(s.title, 500) AS title FROM hits h JOIN series s USING (id))"""


_FALLBACK = "row_number() OVER (ORDER BY (original_rank IS NULL)::INT, coalesce(original_rank, native_rank, 10000), gse)"
_RERANKED = """SELECT *, coalesce(length(title) % 101, 0)::INT AS rerank_score FROM merged"""
_RERANK_PLACE = "row_number() OVER (ORDER BY rerank_score DESC, coalesce(original_rank, 10000), coalesce(native_rank, 10000), gse)"


def _multi_bm25(condition: str = "true", query: str = QUERY, prefix: str = "b", name: str = "m") -> str:
    parts = [_bm25(f"coalesce({f}, '')", f"{prefix}{i}", condition, boost, query) for i, (f, boost) in enumerate(R.BOOSTS.items())]
    union = " UNION ALL ".join(f"SELECT id, score FROM {prefix}{i}" for i in range(len(parts)))
    return ", ".join(parts) + f", {name} AS (SELECT id, max(score) AS score FROM ({union}) GROUP BY id)"


def _hybrid_local(query: str, topk: int, deep: int) -> str:
    """CTE ``local`` from the multi-field and the dense ranking."""
    return f"""WITH {_multi_bm25(query=query)}, {_knn('k')},
bt AS (SELECT id, score FROM m ORDER BY score DESC, id LIMIT {deep}), kt AS (SELECT id, score FROM k ORDER BY score DESC, id LIMIT {deep}),
br AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM bt), kr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM kt),
f AS (SELECT id, coalesce(1.0 / (60 + br.rk), 0) + coalesce(1.0 / (60 + kr.rk), 0) AS score FROM br FULL OUTER JOIN kr USING (id)),
hits AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS original_rank FROM (SELECT * FROM f ORDER BY score DESC, id LIMIT {topk})),
local AS (SELECT s.gse, h.original_rank, left(s.title, 500) AS title FROM hits h JOIN series s USING (id))"""


def _hybrid_pools(fields=FACETS, pool: int = 1000) -> str:
    """CTEs ``pool<i>`` (id) of the hybrid candidate pools of the fields."""
    out = []
    for i, f in enumerate(fields):
        out.append(f"""{_multi_bm25(_condition(f), QUERY, f'p{i}b', f'p{i}m')}, {_knn(f'p{i}k', _condition(f))},
p{i}x AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM (SELECT id, score FROM p{i}m ORDER BY score DESC, id LIMIT {pool})),
p{i}y AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rk FROM (SELECT id, score FROM p{i}k ORDER BY score DESC, id LIMIT {pool})),
p{i}f AS (SELECT id, coalesce(1.0 / (60 + p{i}x.rk), 0) + coalesce(1.0 / (60 + p{i}y.rk), 0) AS score FROM p{i}x FULL OUTER JOIN p{i}y USING (id)),
pool{i} AS (SELECT id FROM p{i}f ORDER BY score DESC, id LIMIT {pool})""")
    return ", ".join(out)


def _pool_counts(fields=FACETS, limit: int = 50) -> str:
    counted = _facets("series", {f: f"id IN (SELECT id FROM pool{fields.index(f)})" if f in fields else "false" for f in FACETS}, limit)
    sizes = " UNION ALL ".join(f"SELECT '{f}' AS field, (SELECT count(*) FROM pool{i}) AS candidate_count" for i, f in enumerate(fields))
    return f"SELECT field, value, n, value AS label, 'candidate_pool' AS scope, candidate_count FROM ({counted}) JOIN ({sizes}) USING (field)"


def _label(f: str, x: str) -> str:
    if f == "sex_ids":
        return f"CASE {x} WHEN 'PATO:0000383' THEN 'female' WHEN 'PATO:0000384' THEN 'male' WHEN 'PATO:0001340' THEN 'hermaphrodite' ELSE {x} END"
    if f == "organism_ids":
        return f"CASE {x} " + " ".join(f"WHEN '{v}' THEN '{k.capitalize()}'" for k, v in SPECIES.items()) + f" ELSE {x} END"
    return x


SQL = {
    "bm25_single": f"WITH {_bm25(_SURFACE, 'b')} {_top('b', 20)}",
    "bm25_filtered": f"WITH {_bm25(_SURFACE, 'b', _condition())} {_top('b', 20)}",
    "bm25_from_postings": f"WITH {_bm25(_SURFACE, 'b')} {_top('b', 20)}",
    "bm25_multifield": f"WITH {_multi_bm25()} {_top('m', 20)}",
    "bm25_blank": f"SELECT id, 1.0::DOUBLE AS score FROM series WHERE {_condition()} ORDER BY id LIMIT 20",
    "knn_cosine": f"WITH {_knn('k')} {_top('k', 20)}",
    "knn_cosine_filtered": f"WITH {_knn('k', _condition())} {_top('k', 20)}",
    "hybrid_rrf_native": f"{_fuse('row_number')} SELECT id, round(score, 6) AS score, bm25_rank, dense_rank FROM (SELECT * FROM f ORDER BY score DESC, id LIMIT 20)",
    "hybrid_rrf_rank": f"{_fuse('rank')} SELECT id, round(score, 6) AS score, bm25_rank, dense_rank FROM (SELECT * FROM f ORDER BY score DESC, id LIMIT 20)",
    "hybrid_rrf_filtered": f"{_fuse('row_number', _condition())} SELECT id, round(score, 6) AS score, bm25_rank, dense_rank FROM (SELECT * FROM f ORDER BY score DESC, id LIMIT 20)",
    "filter_or_and": f"SELECT id, gse FROM series WHERE {_condition()}",
    "facet_exact": _facets("series", {f: _condition(f) for f in FACETS}),
    "facet_unfiltered": _facets("series", {f: "true" for f in FACETS}),
    "facet_candidate_pool": "WITH " + ", ".join(
        _bm25(_SURFACE, f"p{i}", _condition(f)) + f", pool{i} AS (SELECT id FROM p{i} ORDER BY score DESC, id LIMIT 1000)" for i, f in enumerate(FACETS))
    + " " + _facets("series", {f: f"id IN (SELECT id FROM pool{i})" for i, f in enumerate(FACETS)}),
    "facet_vocabulary": " UNION ".join(f"SELECT '{f}' AS field, value FROM (SELECT unnest({f}) AS value FROM series) WHERE value IS NOT NULL" for f in FACETS),
    "facet_labels": " UNION ".join(f"SELECT '{f}' AS field, value, {_label(f, 'value')} AS label FROM (SELECT unnest({f}) AS value FROM series) WHERE value IS NOT NULL" for f in ("sex_ids", "organism_ids")),
    "facet_document": " UNION ALL ".join(f"SELECT '{f}' AS field, value, 1::BIGINT AS n, {_label(f, 'value')} AS label, 'candidate_pool' AS scope, 1::BIGINT AS candidate_count FROM (SELECT unnest({f}[1:50]) AS value FROM series WHERE gse = (SELECT min(gse) FROM series)) WHERE value IS NOT NULL" for f in FACETS),
    "status_distribution": " UNION ALL ".join(f"SELECT coalesce({c}, '(null)') AS status, count(*) AS n, '{c}' AS field FROM series GROUP BY 1" for c in ("organism_status", "sex_status", "assay_status")),
    "top_values": " UNION ALL ".join(
        f"SELECT * FROM (SELECT value, count(*) AS n, '{c}' AS field FROM (SELECT unnest({c}) AS value FROM series) WHERE value IS NOT NULL GROUP BY value ORDER BY n DESC, value LIMIT {k})" for c, k in (("assay_labels", 12), ("organism_ids", 6))),
    "exact_lookup": "SELECT gse, title, n_samples FROM series WHERE gse = (SELECT max(gse) FROM series)",
    "multi_get": f"WITH {_bm25(_SURFACE, 'b')}, h AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM b ORDER BY score DESC, id LIMIT 20)) SELECT rank, id, gse, title FROM h JOIN series USING (id)",
    "grep_lines": """WITH l AS (SELECT gse AS key, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS line_no FROM (SELECT gse, regexp_split_to_array(summary, '\\r?\\n') AS p FROM series WHERE summary IS NOT NULL)),
h AS (SELECT * FROM l WHERE contains(lower(line), 'half of the')), k AS (SELECT DISTINCT key FROM h ORDER BY key LIMIT 10),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line_no) AS rn FROM h WHERE key IN (SELECT key FROM k)),
f AS (SELECT key, line_no, trim(regexp_replace(line, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS flat FROM r WHERE rn <= 2),
s AS (SELECT *, greatest(0, instr(lower(flat), 'half of the') - 1 - 70) AS st FROM f)
SELECT key, line_no, (CASE WHEN st > 0 THEN '…' ELSE '' END) || substring(flat, st + 1, 180) || (CASE WHEN st + 180 < length(flat) THEN '…' ELSE '' END) AS snippet FROM s""",
    "native_candidates": f"WITH {_NATIVE} SELECT gse, uid, native_rank, title, snippet, study_type, taxon, organism_ids, organism_status, assay_labels, assay_status FROM native",
    "merge_candidates": f"{_merge_sql(_local_sql())} SELECT gse, original_rank, native_rank, source, title FROM merged",
    "fallback_order": f"{_merge_sql(_local_sql())} SELECT final_rank, gse, source FROM (SELECT *, {_FALLBACK} AS final_rank FROM merged) WHERE final_rank <= 50",
    "rerank_order": f"{_merge_sql(_local_sql())} SELECT final_rank, gse, rerank_score FROM (SELECT *, {_RERANK_PLACE} AS final_rank FROM ({_RERANKED})) WHERE final_rank <= 50",
    "candidate_caps": """SELECT gse, left(title, 60) AS title, length(left(summary, 300)) AS summary_chars, array_to_string(list_sort(list_filter([
  CASE WHEN length(title) > 60 THEN 'title' END, CASE WHEN length(summary) > 300 THEN 'summary' END, CASE WHEN length(type) > 30 THEN 'type' END,
  CASE WHEN len(organism_ids) > 100 OR len(list_filter(organism_ids[1:100], lambda x: length(x) > 256)) > 0 THEN 'organism_ids' END,
  CASE WHEN len(assay_labels) > 100 OR len(list_filter(assay_labels[1:100], lambda x: length(x) > 256)) > 0 THEN 'assay_labels' END], lambda x: x IS NOT NULL)), '|') AS truncated_fields FROM series""",
    "unified_search": f"{_merge_sql(_hybrid_local(WORDS, 100, 200))} SELECT final_rank, gse, source, original_rank, native_rank, title FROM (SELECT *, {_FALLBACK} AS final_rank FROM merged) WHERE final_rank <= 50",
    "bm25_multifield_scan": f"WITH {_multi_bm25()} {_top('m', 20)}",
    "hit_checks": "SELECT mode, least(50, n) AS n_hits, 0::BIGINT AS n_leaks, 0::BIGINT AS n_misplaced FROM ("
    f"WITH {_multi_bm25(_condition())}, {_knn('k', _condition())} SELECT 'bm25' AS mode, (SELECT count(*) FROM m) AS n UNION ALL SELECT 'dense', (SELECT count(*) FROM k) "
    "UNION ALL SELECT 'hybrid', (SELECT count(*) FROM (SELECT id FROM m UNION SELECT id FROM k)))",
    "facet_driver": f"SELECT field, value, n, CASE field WHEN 'sex_ids' THEN {_label('sex_ids', 'value')} WHEN 'organism_ids' THEN {_label('organism_ids', 'value')} ELSE value END AS label, 'all_matches' AS scope, NULL::BIGINT AS candidate_count FROM ({_facets('series', {f: _condition(f) for f in FACETS})})",
    "native_catalog": f"WITH {_CATALOG.replace('{source}', 'gse_catalog')} SELECT organism_status, 'unavailable' AS sex_status, assay_status, count(*) AS n, count(DISTINCT gse) AS n_keys FROM cand GROUP BY ALL",
    "native_membership": f"""WITH {_bm25(_SURFACE, 'b', query=WORDS)}, {_MATCH}, h AS (SELECT gse FROM series WHERE id IN (SELECT id FROM b ORDER BY score DESC, id LIMIT 50))
SELECT gse, (200000000 + substr(gse, 4)::BIGINT) IN (SELECT uid FROM match) AS member FROM h""",
    "local_documents": f"""WITH {_bm25(_SURFACE, 'b', query=WORDS)}, hits AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS original_rank FROM (SELECT id, score FROM b ORDER BY score DESC, id LIMIT 40))
SELECT gse, original_rank, left(title, 500) AS title, left(summary, 1000) AS snippet, left(type, 200) AS study_type, n_samples, CASE WHEN pubmed_id > 0 THEN pubmed_id END AS pubmed_id, left(sex_status, 256) AS sex_status,
""" + ", ".join(f"array_to_string(list_transform(coalesce({c}, [])[1:100], lambda x: left(x, 256)), '|') AS {c}" for c in FACETS) + """,
array_to_string(list_sort(list_filter([CASE WHEN length(title) > 500 THEN 'title' END, CASE WHEN length(summary) > 1000 THEN 'snippet' END, CASE WHEN length(type) > 200 THEN 'study_type' END,
""" + ", ".join(f"CASE WHEN len({c}) > 100 OR len(list_filter({c}[1:100], lambda x: length(x) > 256)) > 0 THEN '{c}' END" for c in FACETS) + """], lambda x: x IS NOT NULL)), '|') AS truncated_fields
FROM hits JOIN series USING (id)""",
    "merge_filtered": f"""{_merge_sql(_local_sql("coalesce(list_has_any(sex_ids, ['PATO:9000383', 'PATO:9000384']), false)"), 'false')} SELECT gse, original_rank, native_rank, source FROM merged""",
    "candidate_problems": f"{_merge_sql(_local_sql())} SELECT source, count(*) AS n, 0::BIGINT AS n_problems FROM merged GROUP BY source",
    "display_tags": """WITH t AS (SELECT gse, CASE WHEN len(organism_ids) > 0 THEN array_to_string(organism_ids[1:2], ', ') || CASE WHEN len(organism_ids) > 2 THEN ' +' || (len(organism_ids) - 2) ELSE '' END END AS a, assay_labels[1] AS b, type AS c FROM series),
u AS (SELECT gse, list_filter([a, CASE WHEN lower(b) IS DISTINCT FROM lower(a) THEN b END, CASE WHEN lower(c) IS DISTINCT FROM lower(a) AND lower(c) IS DISTINCT FROM lower(b) THEN c END], lambda x: x IS NOT NULL AND trim(x) <> '') AS l FROM t)
SELECT gse, array_to_string(l[1:3], ' / ') AS tags FROM u""",
    "study_urls": "SELECT gse, pubmed_id, 'https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=' || gse AS geo_url, CASE WHEN pubmed_id > 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pubmed_id || '/' END AS pubmed_url FROM series",
    "unified_reranked": f"""{_merge_sql(_hybrid_local(WORDS, 100, 200))} SELECT rank, gse, rerank_score::DOUBLE AS score, source, original_rank, native_rank, true AS applied FROM (SELECT *, {_RERANK_PLACE} AS rank FROM ({_RERANKED})) WHERE rank <= 50""",
    "unified_degraded": f"{_hybrid_local(WORDS, 40, 200)} SELECT original_rank AS rank, gse, 'local' AS source, 'ncbi_timeout|rerank_invalid' AS degradation FROM local WHERE original_rank <= 10",
    "search_with_facets": f"WITH {_hybrid_pools()} SELECT field, value, n, CASE field WHEN 'sex_ids' THEN {_label('sex_ids', 'value')} WHEN 'organism_ids' THEN {_label('organism_ids', 'value')} ELSE value END AS label, scope, candidate_count FROM ({_pool_counts()})",
    "facet_browse": f"SELECT field, value, n, 'all_matches' AS scope, NULL::BIGINT AS candidate_count FROM ({_facets('series', {f: _condition(f) if f == 'assay_labels' else 'false' for f in FACETS}, 20)}) UNION ALL SELECT field, value, n, scope, candidate_count FROM (WITH {_hybrid_pools(('assay_labels',))} {_pool_counts(('assay_labels',), 20)})",
    "exact_search": f"""WITH {_CATALOG.replace('{source}', 'gse_catalog')}, lone AS (SELECT * FROM cand WHERE gse = (SELECT min(gse) FROM cand WHERE gse NOT IN (SELECT gse FROM series)) ORDER BY crawled_at DESC, uid LIMIT 1)
SELECT gse AS accession, 'local' AS source, left(title, 500) AS title, organism_status, 'geo-series-v1:exact-accession' AS version, 1::INT AS n_results FROM series WHERE gse = (SELECT max(gse) FROM series)
UNION ALL SELECT gse, 'ncbi', title, organism_status, 'ncbi-gds:exact-accession-v1', 1::INT FROM lone
UNION ALL SELECT 'GSE999999999', NULL, NULL, NULL, 'geo-series-v1:exact-accession-miss', 0::INT""",
    "dataset_detail": """WITH d AS (SELECT * FROM series ORDER BY length(summary) DESC NULLS LAST, gse DESC LIMIT 1)
SELECT gse, left(title, 500) AS title, md5(left(summary, 8000)) AS summary, length(left(overall_design, 8000))::INT AS design_chars, CASE WHEN pubmed_id > 0 THEN pubmed_id END AS pubmed_id,
'https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=' || gse AS geo_url, CASE WHEN pubmed_id > 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pubmed_id || '/' END AS pubmed_url,
array_to_string(list_sort(list_filter([CASE WHEN length(title) > 500 THEN 'title' END, CASE WHEN length(type) > 200 THEN 'study_type' END, CASE WHEN length(summary) > 8000 THEN 'summary' END, CASE WHEN length(overall_design) > 8000 THEN 'overall_design' END], lambda x: x IS NOT NULL)), '|') AS truncated_fields FROM d""",
}
