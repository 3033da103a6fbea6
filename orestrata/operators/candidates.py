"""Merging candidates of two sources, ordering them, and shaping result rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from orestrata.functions.normalize import map_assay, map_organisms
from orestrata.functions.text import accession_number, all_of, blank_to_null, cap_array, cap_text, lit_strings, strip, truncated_names
from orestrata.operators.filters import Filters

#: Rank of a candidate that a source doesn't rank, and bounds of the pool.
UNRANKED = 10_000
POOL_FLOOR, POOL_CAP = 40, 100


def pool_size(limit: int, floor: int = POOL_FLOOR) -> int:
    """Candidates to gather for a page: four times the limit within the bounds."""
    return min(POOL_CAP, max(POOL_FLOOR, floor, 4 * limit))


#: Fields of a candidate, in the order of the contract.
CANDIDATE = (
    "gse", "title", "snippet", "study_type", "n_samples", "pubmed_id", "organism_ids", "organism_status", "sex_ids", "sex_status", "assay_categories",
    "assay_labels", "assay_status", "source", "retrieval_score", "original_rank", "native_rank", "taxon", "truncated_fields")
#: Most characters of a result's texts.
TEXT_CAPS = {"title": 500, "snippet": 1000, "study_type": 200, "organism_status": 256, "sex_status": 256, "assay_status": 256}
ARRAY_FIELDS = ("organism_ids", "sex_ids", "assay_categories", "assay_labels")
ACCESSION = "^GSE[1-9][0-9]*$"


def _capped(columns: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Columns cut to their bounds, and the sorted names of what was cut."""
    out, flags = dict(columns), []
    for name, column in columns.items():
        if name in TEXT_CAPS or name == "taxon":
            out[name], cut = cap_text(column, TEXT_CAPS.get(name, 256))
            flags.append((name, cut))
        elif name in ARRAY_FIELDS:
            out[name], cut = cap_array(F.coalesce(column, F.array().cast("array<string>")))
            flags.append((name, cut))
    return out, truncated_names(flags)


def local_candidates(documents: DataFrame) -> DataFrame:
    """Candidates from documents of the own index with ``original_rank`` and ``score``: capped fields and what was cut."""
    columns, cut = _capped({
        "title": F.col("title"), "snippet": F.col("summary"), "study_type": F.col("type"), "organism_ids": F.col("organism_ids"),
        "organism_status": F.col("organism_status"), "sex_ids": F.col("sex_ids"), "sex_status": F.col("sex_status"), "assay_categories": F.col("assay_categories"),
        "assay_labels": F.col("assay_labels"), "assay_status": F.col("assay_status")})
    positive = F.col("pubmed_id").cast("long")
    columns |= {
        "gse": F.col("gse"), "n_samples": F.col("n_samples"), "pubmed_id": F.when(positive > 0, positive), "source": F.lit("local"), "retrieval_score": F.col("score"),
        "original_rank": F.col("original_rank"), "native_rank": F.lit(None).cast("int"), "taxon": F.lit(None).cast("string"), "truncated_fields": cut}
    return documents.select(*[columns[c].alias(c) for c in CANDIDATE])


def native_candidates(catalog: DataFrame) -> DataFrame:
    """Study rows of a catalog as candidates, texts cut, blank as null; what it doesn't know is ``unavailable``.

    Species and assays are mapped from the taxon and the texts. Rows of other
    kinds and without a study accession give none.
    """
    key = F.upper(F.trim("accession"))
    rows = catalog.where((F.upper(F.trim("entrytype")) == "GSE") & key.rlike(ACCESSION))
    rows = rows.select(
        key.alias("gse"), "uid", blank_to_null(F.col("title"), 500).alias("title"), blank_to_null(F.col("summary"), 1000).alias("snippet"),
        blank_to_null(F.col("gdstype"), 200).alias("study_type"), blank_to_null(F.col("taxon"), 256).alias("taxon"), "pdat", "crawled_at")
    organisms, organism_status = map_organisms(F.col("taxon"))
    kinds, labels, assay_status = map_assay(F.coalesce("study_type", F.lit("")), F.concat_ws(" ", "study_type", "title", "snippet"))
    return rows.withColumns({
        "organism_ids": organisms, "organism_status": F.when(F.col("taxon").isNull(), "unavailable").otherwise(organism_status),
        "sex_ids": F.array().cast("array<string>"), "sex_status": F.lit("unavailable"), "assay_categories": kinds, "assay_labels": labels,
        "assay_status": F.when(assay_status == "absent", "unavailable").otherwise(assay_status), "source": F.lit("ncbi")})


def matching(catalog: DataFrame, query: str) -> DataFrame:
    """Study rows of the catalog, one per uid (its latest crawl), whose title or summary holds every word of the query as a word."""
    words = [w for w in re.split(r"[^\w]+|_", query.lower()) if w]
    fits = all_of([F.lower(F.concat_ws(" ", "title", "summary")).rlike(rf"(?<![\p{{L}}\p{{N}}])\Q{w}\E(?![\p{{L}}\p{{N}}])") for w in dict.fromkeys(words)])
    last = catalog.groupBy("uid").agg(F.max_by(F.struct(*[c for c in catalog.columns if c != "uid"]), F.struct("crawled_at", "title")).alias("r")).select("uid", "r.*")
    return last.where((F.upper(F.trim("entrytype")) == "GSE") & fits)


#: Fixed value: candidates one source may give.
MOST_NATIVE = 100


def native_search(catalog: DataFrame, query: str, limit: int = MOST_NATIVE) -> DataFrame:
    """Candidates of a keyword search: of the newest ``min(3 * limit, 100)`` matching rows those accepted, ranked among themselves, at most ``limit``."""
    if not 1 <= limit <= MOST_NATIVE:
        raise ValueError(f"a limit of 1 to {MOST_NATIVE}")
    page = matching(catalog, query).orderBy(F.desc_nulls_last("pdat"), "uid").limit(min(3 * limit, MOST_NATIVE))
    accepted = native_candidates(page)
    return accepted.withColumn("native_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("pdat"), "uid"))).where(F.col("native_rank") <= limit)


def native_lookup(catalog: DataFrame, accession: str) -> DataFrame:
    """The candidate of exactly this accession, from its latest crawl, with rank 1; none where the catalog lacks it."""
    if not re.fullmatch(ACCESSION, accession):
        raise ValueError("not a normalized accession")
    own = native_candidates(catalog.where(F.upper(F.trim("accession")) == accession))
    return own.orderBy(F.desc("crawled_at"), "uid").limit(1).withColumn("native_rank", F.lit(1))


def membership(results: DataFrame, matched: DataFrame) -> DataFrame:
    """(gse, member): whether a keyword match (uid) contains each accession; uids are the accession's number above 200,000,000."""
    uid = F.lit(200_000_000) + accession_number(F.col("gse"))
    found = matched.select("uid").distinct().withColumn("__in", F.lit(True))
    return results.select("gse").distinct().withColumn("uid", uid).join(found, "uid", "left").select("gse", F.coalesce("__in", F.lit(False)).alias("member"))


def ranked_natives(rows: DataFrame, limit: int) -> DataFrame:
    """``native_rank``: place among the accepted rows, newest first, one row per key."""
    once = Window.partitionBy("gse").orderBy(F.desc_nulls_last("pdat"), "uid", F.desc("crawled_at"))
    first = rows.withColumn("__k", F.row_number().over(once)).where("__k = 1").drop("__k")
    top = first.orderBy(F.desc_nulls_last("pdat"), "uid").limit(limit)
    return top.withColumn("native_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("pdat"), "uid")))


#: Fields a candidate of both sources takes from the native side where the local one is blank.
SHARED = ("title", "snippet", "study_type", "taxon")


def merge(local: DataFrame, native: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Keyed union with the local side first; columns of ``CANDIDATE`` that either side has.

    A key of both sides keeps local values, takes native ones where they are
    blank, and has the source ``both``. A native-only row must itself satisfy
    every condition. Of repeated native keys the best ranked counts.
    """
    once = Window.partitionBy("gse").orderBy("native_rank")
    right = native.withColumn("__k", F.row_number().over(once)).where("__k = 1")
    have = [c for c in CANDIDATE if (c in local.columns or c in right.columns) and c not in ("gse", "source", "original_rank", "native_rank")]
    kinds = {**dict(right.dtypes), **dict(local.dtypes)}
    r = right.select("gse", F.col("native_rank").alias("__rank"), *[(F.col(c) if c in right.columns else F.lit(None).cast(kinds[c])).alias(f"n_{c}") for c in have], F.lit(True).alias("__native"))
    kept = [(F.col(c) if c in local.columns else F.lit(None).cast(kinds[c])).alias(c) for c in have]
    both = local.select("gse", "original_rank", *kept, F.lit(True).alias("__local")).join(r, "gse", "full_outer")
    fits = all_of([
        F.coalesce(F.arrays_overlap(F.col(f"n_{f}") if f in have else F.array().cast("array<string>"), lit_strings(v)), F.lit(False)) for f, v in filters.wanted.items()])
    both = both.where(F.col("__local") | fits)
    source = F.when(F.col("__local") & F.col("__native"), "both").when(F.col("__local"), "local").otherwise("ncbi")

    def value(c: str) -> Column:
        if c in SHARED:
            return F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"n_{c}"))
        return F.when(F.col("__local"), F.col(c)).otherwise(F.col(f"n_{c}"))

    return both.select("gse", "original_rank", F.col("__rank").alias("native_rank"), source.alias("source"), *[value(c).alias(c) for c in have])


def problems_of(candidates: DataFrame) -> DataFrame:
    """(gse, problem) of candidates that break the contract: accession, ranks from 1, ranks that agree with the source."""
    rules = [
        (~F.coalesce(F.col("gse").rlike(ACCESSION), F.lit(False)), "accession"), (F.col("source").isin("local", "both") & F.col("original_rank").isNull(), "no local rank"),
        (F.col("source").isin("ncbi", "both") & F.col("native_rank").isNull(), "no native rank"),
        (F.coalesce(F.col("original_rank") < 1, F.lit(False)) | F.coalesce(F.col("native_rank") < 1, F.lit(False)), "rank below 1")]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
    return candidates.select("gse", F.explode(found).alias("problem"))


def fallback_order() -> list[Column]:
    """Local candidates by their rank, then native ones by theirs, then by key."""
    return [F.col("original_rank").isNull().cast("int").asc(), F.coalesce("original_rank", "native_rank", F.lit(UNRANKED)).asc(), F.col("gse").asc()]


def rerank_order() -> list[Column]:
    """Score first, then local and native rank, then key."""
    return [F.col("rerank_score").desc(), F.coalesce("original_rank", F.lit(UNRANKED)).asc(), F.coalesce("native_rank", F.lit(UNRANKED)).asc(), F.col("gse").asc()]


def placed(candidates: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """``final_rank`` from 1 by the order, the first ``limit``. Candidates are at most two pools."""
    return candidates.withColumn("final_rank", F.row_number().over(Window.orderBy(*order))).where(F.col("final_rank") <= limit)


def rerank(candidates: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """By an external score (gse, rerank_score), all or nothing.

    If a candidate lacks a score from 0 to 100, has two, or a score has no
    candidate, the scores are ignored and the fallback order holds.
    """
    s = scores.groupBy("gse").agg(F.count("*").alias("__n"), F.max("rerank_score").alias("rerank_score"))
    joined = candidates.withColumn("__c", F.lit(1)).join(s, "gse", "full_outer")
    bad = F.max((F.col("__c").isNull() | F.col("__n").isNull() | (F.col("__n") != 1) | ~F.col("rerank_score").between(0, 100)).cast("int")).over(Window.partitionBy(F.lit(1)))
    kept = joined.withColumn("__bad", F.coalesce(bad, F.lit(1))).where("__c is not null")
    score = F.when(F.col("__bad") == 0, F.col("rerank_score"))
    first = kept.withColumn("rerank_score", score)
    order = [F.col("rerank_score").desc_nulls_last(), F.when(F.col("rerank_score").isNull(), F.col("original_rank").isNull().cast("int")).asc_nulls_first()]
    tail = [F.coalesce("original_rank", F.when(F.col("rerank_score").isNull(), F.col("native_rank")), F.lit(UNRANKED)).asc(), F.coalesce("native_rank", F.lit(UNRANKED)).asc(), F.col("gse").asc()]
    return placed(first, order + tail, limit).drop("__c", "__n", "__bad")


def result_rows(df: DataFrame, texts: dict[str, int], arrays: list[str]) -> DataFrame:
    """The key with capped fields and ``truncated_fields``, the sorted names of what was cut."""
    flags, columns = [], []
    for name, limit in texts.items():
        value, cut = cap_text(F.col(name), limit)
        columns.append(value.alias(name))
        flags.append((name, cut))
    for name in arrays:
        value, cut = cap_array(F.col(name))
        columns.append(value.alias(name))
        flags.append((name, cut))
    return df.select("gse", *columns, truncated_names(flags).alias("truncated_fields"))


def single_positive(values: Column) -> Column:
    """The number of a one-element list if it is positive, else null."""
    n = F.get(values, F.lit(0)).try_cast("bigint")
    return F.when((F.size(values) == 1) & (n > 0), n)


def study_urls(df: DataFrame, pubmed: str = "pubmed_id") -> DataFrame:
    """``df`` (gse, ...) with ``geo_url`` and ``pubmed_url``, null without a publication. The addresses."""
    paper = F.when(F.col(pubmed) > 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col(pubmed).cast("string"), F.lit("/")))
    return df.withColumns({"geo_url": F.concat(F.lit("https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc="), "gse"), "pubmed_url": paper})


def display_tags(organisms: Column, assays: Column, study_type: Column, most: int = 3) -> Column:
    """Short tags of a result: its species (two, and how many more), its first assay and its type, each once whatever the case."""
    names = F.coalesce(organisms, F.array().cast("array<string>"))
    more = F.size(names) - 2
    species = F.when(F.size(names) > 0, F.concat(F.array_join(F.slice(names, 1, 2), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise("")))
    raw = F.filter(F.array(species, F.get(assays, F.lit(0)), study_type), lambda t: t.isNotNull() & (strip(t) != ""))
    low = F.transform(raw, lambda t: F.lower(t))
    return F.slice(F.filter(raw, lambda t, i: F.array_position(low, F.lower(t)) == i + 1), 1, most)
