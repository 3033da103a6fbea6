"""Array filters: any of the values within a field, all fields together."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from orestrata.functions.text import all_of, lit_strings

#: The facet fields in their order.
FACETS = ("organism_ids", "sex_ids", "assay_categories", "assay_labels")

#: The form of identifiers in requests.
IDENTIFIERS = {"organism_ids": r"NCBITaxon:[1-9][0-9]*", "sex_ids": r"PATO:[0-9]{7}"}


@dataclass(frozen=True)
class Filters:
    """Wanted values of each facet field; no value of a field means no condition on it."""

    wanted: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict[str, list[str]] | None, most: int = 20, longest: int = 256) -> "Filters":
        """Checked and tidied: stripped, in order of first mention; unknown fields, blank and too many or too long values are errors."""
        out = {}
        for name, given in (values or {}).items():
            if name not in FACETS:
                raise ValueError(f"no facet {name!r}")
            tidy = tuple(dict.fromkeys(v.strip() for v in given))
            if any(not v for v in tidy):
                raise ValueError(f"blank value for {name!r}")
            if len(tidy) > most or any(len(v) > longest for v in tidy):
                raise ValueError(f"too many or too long values for {name!r}")
            if tidy:
                out[name] = tidy
        return cls(out)

    @classmethod
    def of_request(cls, values: dict[str, list[str]] | None) -> "Filters":
        """As ``of``, with identifiers of the form their field takes."""
        out = cls.of(values)
        for name, pattern in IDENTIFIERS.items():
            if any(not re.fullmatch(pattern, v) for v in out.wanted.get(name, ())):
                raise ValueError(f"ill-formed identifier for {name!r}")
        return out

    def without(self, name: str) -> "Filters":
        """The same without the condition on one field."""
        return Filters({k: v for k, v in self.wanted.items() if k != name})

    def condition(self) -> Column:
        """True where every wanted field shares a value; a null or empty array shares none."""
        return all_of([F.coalesce(F.arrays_overlap(F.col(k), lit_strings(v)), F.lit(False)) for k, v in self.wanted.items()])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition()) if self.wanted else df


def unknown_values(filters: Filters, vocabulary: DataFrame) -> list[tuple[str, str]]:
    """Wanted values a vocabulary (field, value) doesn't hold; only the wanted ones reach the driver."""
    pairs = [(f, v) for f, values in filters.wanted.items() for v in values]
    if not pairs:
        return []
    wanted = vocabulary.sparkSession.createDataFrame(pairs, "field string, value string")
    return [(r.field, r.value) for r in wanted.join(vocabulary, ["field", "value"], "left_anti").orderBy("field", "value").collect()]


def violations(results: DataFrame, constraints: Filters) -> DataFrame:
    """Per query: results of which a constrained field holds none of the wanted values."""
    return results.groupBy("query_id").agg(F.count_if(~constraints.condition()).alias("n_violations"))


def leaks(hits: DataFrame, filters: Filters) -> DataFrame:
    """Hits that a search with these filters should not have returned."""
    return hits.where(~filters.condition())


def misplaced(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hits (rank, id, score) that stand after one with a lower score, or with the same score and a larger id."""
    from pyspark.sql import Window

    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy("rank")
    score, key = F.lag("score").over(order), F.lag("id").over(order)
    return hits.withColumns({"__s": score, "__k": key}).where((F.col("__s") < F.col("score")) | ((F.col("__s") == F.col("score")) & (F.col("__k") > F.col("id")))).drop("__s", "__k")
