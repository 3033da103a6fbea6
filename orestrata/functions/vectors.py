"""Vector functions as Columns; everything accumulates in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def usable(a: Column, dims: int) -> Column:
    """Of the right length, finite throughout, not all zero; false for null."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dims) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def cosine(a: Column, query: list[float]) -> Column:
    """Cosine with a fixed vector, whose norm must not be 0."""
    length = sum(x * x for x in query) ** 0.5
    if not length > 0:
        raise ValueError("the query vector has no length")
    q = F.array(*[F.lit(float(x)) for x in query])
    return dot(a, q) / (norm(a) * F.lit(length))


def checked_vector(values, dims: int | None = None) -> list[float]:
    """A query vector as floats: one dimension, of ``dims`` numbers where given, finite throughout, not all zero; else an error."""
    v = np.asarray(values, dtype=np.float64)
    if v.ndim != 1 or not len(v) or dims is not None and len(v) != dims:
        raise ValueError("the query vector has the wrong dimension")
    if not np.isfinite(v).all() or not v.any():
        raise ValueError("the query vector isn't finite or has no length")
    return v.tolist()


def usable_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and float32 vectors of the rows of ``dims`` finite numbers that are not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(column), 0)) == dims)
    flat = pc.fill_null(column.take(pa.array(at)).flatten(), float("nan"))
    x = np.asarray(flat, dtype=np.float32).reshape(len(at), dims)
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[fine], x[fine]


def cosine_scores(df: DataFrame, vector: str, query: list[float], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with a usable vector, and ``score``, its cosine with the query in double precision.

    A batch of vectors is one matrix product; the vectors themselves don't leave the worker.
    """
    q = np.asarray(checked_vector(query))
    q, dims = q / np.sqrt(q @ q), len(query)

    def run(batches):
        for batch in batches:
            at, x = usable_rows(batch.column(0), dims)
            y = x.astype(np.float64)
            y /= np.abs(y).max(axis=1, keepdims=True, initial=1e-300)
            score = (y @ q) / np.sqrt((y * y).sum(axis=1))
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[1:]], pa.array(score)], names=[*keep, "score"])

    schema = df.select(*keep).schema.add("score", "double")
    return df.select(F.col(vector).cast("array<float>"), *keep).mapInArrow(run, schema)


def first_usable(df: DataFrame, vector: str, dims: int) -> list[float] | None:
    """The usable vector with the smallest id, one candidate a batch; None where there is none."""

    def run(batches):
        for batch in batches:
            at, _ = usable_rows(batch.column(1), dims)
            if len(at):
                ids = np.asarray(batch.column(0))[at]
                yield batch.take(pa.array([int(at[np.argmin(ids)])]))

    kept = df.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    row = kept.mapInArrow(run, kept.schema).orderBy("id").limit(1).first()
    return None if row is None else [float(x) for x in row.v]
