"""All query modules of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orestrata.plans import normalization, packed, pipeline, relational, search


def modules() -> list:
    return [packed, search, relational, normalization, pipeline]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.unified_search(spark, sf_dir)
