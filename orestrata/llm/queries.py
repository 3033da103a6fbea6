"""Queries of the subpackage's operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orestrata.llm.canonical import map_series
from orestrata.llm.mixing import mix
from orestrata.llm.neardup import NearDuplicates
from orestrata.llm.neighbours import HALF_ERROR, most_similar, nearest_of, verified
from orestrata.llm.packing import fill_report, pack
from orestrata.llm.sentences import split_sentences
from orestrata.llm.splitting import split_long
from orestrata.llm.tokens import with_sizes
from orestrata.session import settle, table

NEAR_FIELDS = ["title", "summary", "overall_design"]


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(table(spark, sf_dir, "series"), "id", NEAR_FIELDS, width=3, similarity=0.6)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of series of similarity 0.6 or more on runs of three words."""
    return _near(spark, sf_dir).pairs()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links in compact form: class of every series, and how many near-duplicates it has."""
    return _near(spark, sf_dir).groups()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of series of cosine 0.80 or more of which one is among the ten most similar of the other."""
    series = table(spark, sf_dir, "series")
    near = verified(most_similar(series, "id", "embedding", least=0.80 - HALF_ERROR), series, "id", "embedding", 0.80)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar series of every series with a usable embedding."""
    return most_similar(table(spark, sf_dir, "series"), "id", "embedding").withColumn("cosine", F.round("cosine", 4))


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the series whose id is divisible by 100: how many of their true ten most similar, by cosine to four digits, are found.

    The true ones come from comparing these queries with all vectors, block by block.
    """
    series = table(spark, sf_dir, "series")
    found = most_similar(series, "id", "embedding").where(F.col("id") % 100 == 0)
    true = nearest_of(series, series.where(F.col("id") % 100 == 0), "id", "embedding")
    last = true.groupBy("id").agg(F.min("cosine").alias("least"), F.count("*").alias("k"))
    hit = found.join(last, "id").groupBy("id").agg(F.count_if(F.col("cosine") >= F.col("least") - HALF_ERROR).alias("n"), F.first("k").alias("k"))
    return last.select("id").join(hit, "id", "left").agg(F.count("*").alias("n_queries"), (F.sum(F.coalesce(F.least("n", "k"), F.lit(0))) / F.sum("k") >= 0.9).alias("recall_reached"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of ``term_list`` meant by the freely typed values of four fields of ``series``."""
    return map_series(table(spark, sf_dir, "series"), table(spark, sf_dir, "term_list"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each field: series with a value, distinct entries met, series with an unmatched value."""
    found = p4_found(spark, sf_dir)
    missed = F.col("term_id") == "unmatched"
    return found.groupBy("field").agg(
        F.countDistinct("id").alias("n_series"), F.countDistinct(F.when(~missed, F.col("term_id"))).alias("n_terms"), F.count_if(missed).alias("n_unmatched"))


#: Fields that hold texts to be cut, and their tables.
LONG_FIELDS = {"search_text": "series", "embed_text": "record_ref"}
LIMIT, OVERLAP = 4000, 200


def _pieces(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    """Pieces of both fields, of texts above ``least`` characters."""
    out = None
    for field, name in LONG_FIELDS.items():
        source = table(spark, sf_dir, name).select("gse", field)
        source = source.where(F.length(field) > least) if least else source
        one = split_long(source, ["gse"], field, LIMIT, OVERLAP).withColumn("field", F.lit(field))
        out = one if out is None else out.unionByName(one)
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were cut into several pieces, and those among them with an unbroken stretch above the limit."""
    first = _pieces(spark, sf_dir, LIMIT).where("piece_no = 1 and n_pieces > 1")
    kinds = F.array_compact(F.array(F.lit("over"), F.when(F.col("unbroken") > LIMIT, F.lit("hard"))))
    return first.select("field", "gse", F.explode(kinds).alias("kind"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of both fields with their places."""
    return _pieces(spark, sf_dir).select("field", "gse", "piece_no", "start_pos", "end_pos", "cut", F.length("piece").alias("n_chars"))


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each field: texts, texts in several pieces, characters covered once, pieces out of bounds, pieces that don't join the one before."""
    p = _pieces(spark, sf_dir).select("field", "gse", "piece_no", "n_pieces", "start_pos", "end_pos", F.length("piece").alias("n_chars"))
    before = F.lag("end_pos").over(Window.partitionBy("field", "gse").orderBy("piece_no"))
    p = p.withColumn("expected", F.coalesce(before - OVERLAP, F.lit(0)))
    return p.groupBy("field").agg(
        F.count_if(F.col("piece_no") == 1).alias("n_texts"), F.count_if((F.col("piece_no") == 1) & (F.col("n_pieces") > 1)).alias("n_over"),
        F.sum(F.col("n_chars") - F.when(F.col("piece_no") > 1, OVERLAP).otherwise(0)).alias("n_covered"),
        F.count_if((F.col("n_chars") > LIMIT) | (F.col("n_chars") != F.col("end_pos") - F.col("start_pos"))).alias("n_bad"),
        F.count_if(F.col("start_pos") != F.col("expected")).alias("n_gaps"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document for every capacity."""
    sized = with_sizes(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return pack(sized, table(spark, sf_dir, "pack_container"), "doc_id").withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return fill_report(p6_containers(spark, sf_dir).withColumnRenamed("doc_id", "id"), table(spark, sf_dir, "pack_container"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each capacity: documents placed, containers above it, documents split that fit, parts missing."""
    kinds = table(spark, sf_dir, "pack_container").select("container_id", "capacity_tokens")
    parts = settle(p6_containers(spark, sf_dir), "packed")
    bins = parts.groupBy("container_id", "bin_id").agg(F.sum("tokens").alias("load")).join(kinds, "container_id")
    docs = parts.groupBy("container_id", "doc_id").agg(F.count("*").alias("n"), F.max("part_no").alias("last"), F.sum("tokens").alias("size")).join(kinds, "container_id")
    one = bins.groupBy("container_id").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("n_overfull"))
    two = docs.groupBy("container_id").agg(
        F.count("*").alias("n_items"), F.count_if((F.col("n") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("n_split"), F.count_if(F.col("n") != F.col("last")).alias("n_lost"))
    return two.join(one, "container_id")


#: Domains of the sources of ``documents``.
DOMAINS = {
    "series_summary": "study", "overall_design": "study", "sample_protocol": "bench", "qc_log": "bench", "field_diary": "bench", "platform_manual": "platform",
    "curation_note": "curation", "submitter_mail": "curation", "reanalysis_report": "curation"}


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sizes(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"], "text")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_target"), domains=DOMAINS)


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often each is used."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source of each mix."""
    return _mixed(spark, sf_dir)[1]


def p7_shares_at_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for mixes of the size of all documents, which the small sources can't fill: their shortage goes to the siblings, then further."""
    sized = settle(_sized(spark, sf_dir), "tokens")
    total = float(sized.agg(F.sum("tokens")).first()[0] or 0)
    return mix(sized, table(spark, sf_dir, "mix_target"), total=total, domains=DOMAINS)[1]


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each mix: sources asked for, documents used too often, of another source, twice, and whether every source of which there is any has its weight.

    It has if it is off by at most 0.02 and the size of one of its usual
    documents; what a source without documents leaves is dealt among others.
    """
    sized = settle(_sized(spark, sf_dir), "tokens")
    selection, shares = mix(sized, table(spark, sf_dir, "mix_target"), domains=DOMAINS)
    targets = table(spark, sf_dir, "mix_target").select("mix_id", "source", "max_repeats")
    chosen = settle(selection, "chosen")
    used = chosen.join(targets, ["mix_id", "source"], "left").groupBy("mix_id").agg(
        F.count_if(F.col("times") > F.col("max_repeats")).alias("n_too_often"), F.count_if(F.col("max_repeats").isNull()).alias("n_foreign"),
        (F.count("*") - F.countDistinct("id")).alias("n_twice"))
    usual = sized.where("tokens > 0").groupBy("source").agg(F.avg("tokens").alias("usual"))
    whole = Window.partitionBy("mix_id")
    rows = shares.join(usual, "source", "left").withColumns({
        "left": F.sum(F.when(F.col("available") == 0, F.col("weight")).otherwise(0.0)).over(whole), "all": F.sum("tokens").over(whole)})
    off = F.abs(F.col("share") - F.col("weight")) - F.col("left") - F.col("usual") / F.col("all")
    return rows.groupBy("mix_id").agg(F.count("*").alias("n_sources"), (F.max(F.when(F.col("available") > 0, off)) <= 0.02).alias("close")).join(used, "mix_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every document."""
    return split_sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (
    p2_found, p2_groups, p3_found, p3_neighbours, p3_recall, p4_found, p4_report, p5_found, p5_pieces, p5_coverage, p6_containers, p6_fill, p6_checks, p7_selection, p7_shares, p7_shares_at_total, p7_checks, p8_found)}
_PAIRS_SQL = r"""w AS (
  SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(overall_design, ''))), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS l FROM series),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) AS s FROM w WHERE len(l) >= 3),
n AS (SELECT id, count(*) AS c FROM g GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM g a JOIN g b USING (s) WHERE a.id < b.id GROUP BY a.id, b.id),
found AS (SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k / (x.c + y.c - k)::DOUBLE >= 0.6)"""
#: Equivalents for DuckDB where SQL can express the result on whole tables.
SQL: dict[str, str] = {
    "p2_found": f"WITH {_PAIRS_SQL} SELECT id_a, id_b FROM found",
    "p2_groups": f"""WITH RECURSIVE {_PAIRS_SQL}, e AS (SELECT id_a AS a, id_b AS b FROM found UNION ALL SELECT id_b, id_a FROM found),
reach AS (SELECT id AS a, id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT r.a AS id, min(r.b) AS group_id, any_value(coalesce(d.c, 0)) AS n_links FROM reach r LEFT JOIN (SELECT a, count(*) AS c FROM e GROUP BY a) d ON d.a = r.a GROUP BY r.a""",
    "p3_found": r"""
WITH v AS (
  SELECT id, embedding::DOUBLE[] AS v FROM series WHERE len(embedding) = 384
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a, v b WHERE a.id <> b.id),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM c)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE rn <= 10 AND s >= 0.80""",
    "p5_found": r"""
WITH t AS (
  SELECT 'search_text' AS field, gse, search_text AS x FROM series UNION ALL
  SELECT 'embed_text' AS field, gse, embed_text AS x FROM record_ref),
o AS (SELECT field, gse, x FROM t WHERE length(x) > 4000),
-- Stretches between white space and sentence marks; RE2 has no repeat counts above 1,000.
s AS (SELECT field, gse, max(length(p)) AS longest FROM (
  SELECT field, gse, unnest(regexp_split_to_array(x, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？．]')) AS p FROM o) GROUP BY field, gse)
SELECT field, gse, 'over' AS kind FROM o
UNION ALL SELECT field, gse, 'hard' AS kind FROM s WHERE longest > 4000""",
    "p5_coverage": """WITH t AS (SELECT 'search_text' AS field, search_text AS x FROM series UNION ALL SELECT 'embed_text', embed_text FROM record_ref)
SELECT field, count(*) AS n_texts, count(*) FILTER (length(x) > 4000) AS n_over, sum(length(x))::BIGINT AS n_covered, 0::BIGINT AS n_bad, 0::BIGINT AS n_gaps FROM t WHERE length(x) > 0 GROUP BY field""",
    "p6_checks": "SELECT container_id, (SELECT count(*) FROM documents) AS n_items, 0::BIGINT AS n_overfull, 0::BIGINT AS n_split, 0::BIGINT AS n_lost FROM pack_container",
    "p7_checks": "SELECT mix_id, count(*) AS n_sources, 0::BIGINT AS n_too_often, 0::BIGINT AS n_foreign, 0::BIGINT AS n_twice, true AS close FROM mix_target GROUP BY mix_id",
    "p3_recall": """SELECT count(*) AS n_queries, true AS recall_reached FROM series WHERE id % 100 = 0 AND len(embedding) = 384
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
}
