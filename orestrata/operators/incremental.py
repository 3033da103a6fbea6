"""Incremental building blocks: what is missing, deltas, overlays, keyed upserts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def missing(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output."""
    return inputs.join(outputs.select(key), key, "left_anti")


def delta_keys(target: DataFrame, base: DataFrame, replace: DataFrame, key: str) -> DataFrame:
    """Target keys that the base lacks or that are to be replaced."""
    wanted = target.select(key).distinct()
    new = wanted.join(base.select(key), key, "left_anti")
    again = wanted.join(replace.select(key), key, "left_semi")
    return new.unionByName(again).distinct()


def overlay(target: DataFrame, base: DataFrame, delta: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, origin): per target key the delta's value, else the base's; keys outside the target vanish."""
    d = delta.select(key, F.col(value).alias("__d"), F.lit(True).alias("__in"))
    b = base.select(key, F.col(value).alias("__b"))
    joined = target.select(key).distinct().join(d, key, "left").join(b, key, "left")
    origin = F.when(F.col("__in"), "delta").when(F.col("__b").isNotNull(), "base").otherwise("none")
    return joined.select(key, F.when(F.col("__in"), F.col("__d")).otherwise(F.col("__b")).alias(value), origin.alias("origin"))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the largest by the order, which must be total. Rows are compared map-side, so a key of many versions ships one of each task."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def upsert(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The current rows with those of the batch in place of theirs; loading a batch twice changes nothing."""
    return current.join(batch.select(key), key, "left_anti").unionByName(batch)


def coverage(documents: DataFrame, vectors: dict[str, DataFrame], key: str) -> DataFrame:
    """(model, n_docs, n_vectors) of every model."""
    out = None
    for name, v in vectors.items():
        held = v.select(key).distinct().withColumn("__held", F.lit(1))
        one = documents.select(key).join(held, key, "left").agg(F.count("*").alias("n_docs"), F.count("__held").alias("n_vectors")).select(F.lit(name).alias("model"), "n_docs", "n_vectors")
        out = one if out is None else out.unionByName(one)
    return out


def required(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of the wanted keys; a key without a row is an error when the result is read."""
    joined = wanted.select(key).distinct().join(rows.withColumn("__in", F.lit(True)), key, "left")
    missing_ = F.raise_error(F.concat(F.lit("missing: "), F.col(key).cast("string"))).cast("boolean")
    return joined.where(F.coalesce("__in", missing_)).drop("__in")


def audited(documents: DataFrame, vectors: dict[str, DataFrame], key: str) -> DataFrame:
    """(model, n_docs, n_vectors, complete) of every model: whether each document has a vector."""
    return coverage(documents, vectors, key).withColumn("complete", F.col("n_docs") == F.col("n_vectors"))


def index_documents(records: DataFrame, vectors: dict[str, DataFrame], key: str = "gse") -> DataFrame:
    """Records with a vector column for each model; null where the model lacks the record. Vectors (key, vector) are keyed once."""
    out = records
    for name, v in vectors.items():
        out = out.join(v.select(key, F.col("vector").alias(name)), key, "left")
    return out


def key_digest(keys: DataFrame, key: str, order: list[str], block: int = 100_000) -> str:
    """SHA-256 over all keys in order, each with its length before it, block by block and then over the blocks' digests."""
    from orestrata.operators.rollup import numbered

    placed = numbered(keys.select(*dict.fromkeys([key, *order])), order, "__row")
    text = F.concat(F.octet_length(key).cast("string"), F.lit(":"), F.col(key))
    rows = F.sort_array(F.collect_list(F.struct("__row", text.alias("t"))))
    blocks = placed.groupBy(F.floor(F.col("__row") / block).alias("b")).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["t"]), ""), 256).alias("d"))
    return blocks.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda r: r["d"]), ""), 256)).first()[0]


def delta_problems(delta: DataFrame, target: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """(problem, n) of a declared delta: repeated keys, keys outside the target, and target keys that neither the base nor the delta has."""
    repeated = delta.groupBy(key).agg(F.count("*").alias("c")).where("c > 1")
    outside = delta.select(key).distinct().join(target.select(key), key, "left_anti")
    omitted = target.select(key).distinct().join(base.select(key), key, "left_anti").join(delta.select(key), key, "left_anti")
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n") for name, d in (("repeated", repeated), ("outside", outside), ("omitted", omitted))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
