"""Facet counts: disjunctive over all matches, over a candidate pool, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from orestrata.functions.normalize import FEMALE, HERMAPHRODITE, MALE, SPECIES, lookup
from orestrata.functions.text import capitalized
from orestrata.operators.filters import FACETS, Filters


def _counted(tall: DataFrame, limit: int | None) -> DataFrame:
    """(field, value, n), by count descending then value, the first ``limit`` of each field."""
    counts = tall.groupBy("field", "value").agg(F.count("*").alias("n"))
    if limit is None:
        return counts
    order = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= limit).drop("__rn")


def _pair(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"))


def _tagged(field: str) -> Column:
    """Distinct values of an array column as (field, value); null as none."""
    return F.transform(F.array_distinct(F.coalesce(F.col(field), F.array().cast("array<string>"))), _pair(field))


def exact_facets(df: DataFrame, filters: Filters, fields=FACETS, limit: int | None = 50) -> DataFrame:
    """Disjunctive counts in one scan: each field counts the rows that pass all conditions but its own.

    A row counts once per distinct value. Null values and arrays count nowhere.
    """
    none = F.array().cast("array<string>")
    parts = [F.when(filters.without(f).condition(), _tagged(f)).otherwise(F.transform(none, _pair(f))) for f in fields]
    tall = df.select(F.explode(F.concat(*parts)).alias("x")).select("x.field", "x.value").where(F.col("value").isNotNull())
    return _counted(tall, limit)


def pool_facets(pools: DataFrame, limit: int | None = 50) -> DataFrame:
    """(field, value, n) over candidate pools (field, id, values): rows that hold the value, each once."""
    tall = pools.select("field", F.explode(F.array_distinct("values")).alias("value")).where(F.col("value").isNotNull())
    return _counted(tall, limit)


def candidate_counts(pools: DataFrame, fields=FACETS) -> DataFrame:
    """(field, candidate_count) of every field, 0 where the pool is empty."""
    every = pools.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return every.join(pools.groupBy("field").agg(F.count("*").alias("candidate_count")), "field", "left").na.fill(0, ["candidate_count"])


def facets(searcher, query: str, mode: str = "hybrid", vector_query=None, filters: Filters = Filters(), settings=None, fields=FACETS) -> DataFrame:
    """(field, value, n, label, scope, candidate_count): over all matches where the query is blank, else over the candidate pools."""
    from orestrata.operators.retrieval import Settings

    settings = settings or Settings()
    if not query.strip():
        counts = exact_facets(searcher.df, filters, fields, settings.bucket_limit).withColumns({"scope": F.lit("all_matches"), "candidate_count": F.lit(None).cast("long")})
    else:
        pools = searcher.pools(query, mode, vector_query, filters, settings, fields)
        counts = pool_facets(pools, settings.bucket_limit).join(candidate_counts(pools, fields), "field").withColumn("scope", F.lit("candidate_pool"))
    label = F.col("value")
    for f in fields:
        label = F.when(F.col("field") == f, display_label(f, F.col("value"))).otherwise(label)
    return counts.withColumn("label", label)


def document_facets(document: DataFrame, fields=FACETS, most: int = 50) -> DataFrame:
    """(field, value, n, label, scope, candidate_count) of a single document: its first values, each counted once."""
    parts = [F.transform(F.slice(F.coalesce(F.col(f), F.array().cast("array<string>")), 1, most), _pair(f)) for f in fields]
    tall = document.select(F.explode(F.concat(*parts)).alias("x")).select("x.field", "x.value").where(F.col("value").isNotNull())
    label = F.col("value")
    for f in fields:
        label = F.when(F.col("field") == f, display_label(f, F.col("value"))).otherwise(label)
    return tall.select("field", "value", F.lit(1).cast("long").alias("n"), label.alias("label"), F.lit("candidate_pool").alias("scope"), F.lit(1).cast("long").alias("candidate_count"))


#: Fixed value: values of one facet field that a closed vocabulary may hold.
VOCABULARY_LIMIT = 10_000


def vocabulary(df: DataFrame, fields=FACETS) -> DataFrame:
    """(field, value): every value of every facet field."""
    parts = [_tagged(f) for f in fields]
    return df.select(F.explode(F.concat(*parts)).alias("x")).select("x.field", "x.value").where(F.col("value").isNotNull()).distinct()


def checked_vocabulary(df: DataFrame, fields=FACETS, limit: int = VOCABULARY_LIMIT) -> DataFrame:
    """The vocabulary, an error where a field has more than ``limit`` values."""
    from orestrata.session import settle

    known = settle(vocabulary(df, fields), "vocabulary")
    over = [r.field for r in known.groupBy("field").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()]
    if over:
        raise ValueError(f"more than {limit} values in {sorted(over)}")
    return known


def display_label(field: str, value: Column) -> Column:
    """What a facet value is shown as: species and sexes by name where the identifier is known, else the value."""
    if field == "organism_ids":
        return F.coalesce(capitalized(lookup({i: name for name, i in SPECIES.items()}, value)), value)
    if field == "sex_ids":
        return F.coalesce(lookup({FEMALE: "female", MALE: "male", HERMAPHRODITE: "hermaphrodite"}, value), value)
    return value


def status_distribution(df: DataFrame, column: str) -> DataFrame:
    """(status, n) with null as ``(null)``."""
    return df.groupBy(F.coalesce(F.col(column), F.lit("(null)")).alias("status")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """The most frequent values of an array column, ties by value."""
    counts = df.select(F.explode(column).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(limit)
