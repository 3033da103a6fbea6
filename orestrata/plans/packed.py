"""Queries of the packed-field operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orestrata.operators.packed import split_packed
from orestrata.session import table

PACKED_FIELDS = ["source_names", "characteristics", "organisms"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the three packed fields of ``series`` with its place."""
    return split_packed(table(spark, sf_dir, "series"), "id", PACKED_FIELDS, tagged=["characteristics"])


def p1_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value occurs in each packed field, and in how many series."""
    values = p1_found(spark, sf_dir)
    return values.groupBy("field", "val").agg(F.count("*").alias("n_values"), F.countDistinct("id").alias("n_series"))


QUERIES = {"p1_found": p1_found, "p1_value_counts": p1_value_counts}
SQL: dict[str, str] = {}
