"""Rolling child rows up into their parents, duplicate checks, bin packing and chunking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from orestrata.functions.text import accession_number
from orestrata.session import settle


def rollup(children: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per parent: ``n_children`` and, of each column, the sorted distinct values that aren't blank.

    Sets are built map-side first, so a parent with very many children ships its
    distinct values only.
    """
    kept = [F.array_sort(F.collect_set(F.when(F.trim(F.col(c)) != "", F.col(c)))).alias(c) for c in columns]
    return children.groupBy(key).agg(F.count("*").alias("n_children"), *kept)


def with_rollup(parents: DataFrame, children: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Parents left-joined to the rollup; childless ones have 0 children and empty arrays."""
    rolled = rollup(children, key, columns)
    out = parents.select(key).join(rolled, key, "left")
    empty = F.array().cast("array<string>")
    return out.select(key, F.coalesce("n_children", F.lit(0)).alias("n_children"), *[F.coalesce(F.col(c), empty).alias(c) for c in columns])


def two_level(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, entries): per key an array of (name, values), both levels sorted and distinct."""
    inner = df.groupBy(key, name).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return inner.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), "values"))).alias("entries"))


def accessions_sorted(df: DataFrame, key: str, accession: str) -> DataFrame:
    """(key, accessions): distinct accessions by number; those without one are left out."""
    numbered = df.select(key, F.struct(accession_number(F.col(accession)).alias("n"), F.col(accession).alias("a")).alias("x")).where("x.n is not null")
    return numbered.groupBy(key).agg(F.transform(F.array_sort(F.collect_set("x")), lambda s: s["a"]).alias("accessions"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_audit(declared: DataFrame, actual: DataFrame, key: str, item: str) -> DataFrame:
    """Per parent: items declared more often than present, and present more often than declared, and whether both agree as multisets.

    Children are counted map-side before they meet.
    """
    a = declared.groupBy(key, item).agg(F.count("*").alias("__d"))
    b = actual.groupBy(key, item).agg(F.count("*").alias("__a"))
    both = a.join(b, [key, item], "full_outer").na.fill(0, ["__d", "__a"])
    return both.groupBy(key).agg(
        F.sum(F.greatest(F.col("__d") - F.col("__a"), F.lit(0))).alias("n_missing"), F.sum(F.greatest(F.col("__a") - F.col("__d"), F.lit(0))).alias("n_undeclared"),
        F.bool_and(F.col("__d") == F.col("__a")).alias("equal"))


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """``name``: the row's place from 0 in a total order, without bringing all rows into one task.

    Rows are range-partitioned and written once with their place in their
    partition; the partitions' sizes, a row each, give the offsets.
    """
    sorted_parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(sorted_parts.withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = placed.groupBy("__pid").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return placed.join(offsets, "__pid").withColumn(name, F.col("__off") + F.col("__at")).drop("__pid", "__at", "__off")


def _next_starts(sizes: np.ndarray, most_rows: int, most_bytes: int) -> np.ndarray:
    """Of every row as the first of a shard, where the next shard begins."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.arange(len(sizes))
    by_bytes = np.searchsorted(upto, upto[:-1] + most_bytes, "right") - 1
    return np.maximum(rows + 1, np.minimum(rows + most_rows, by_bytes))


def _sizes_of(table: pa.Table) -> np.ndarray:
    return np.maximum(0, np.asarray(table.column("__size").fill_null(0), dtype=np.int64))


def shards(df: DataFrame, order: list[str], size: str, most_rows: int, most_bytes: int, block: int = 100_000) -> DataFrame:
    """``shard``, from 0: consecutive rows by ``order`` while count and bytes stay within bounds, exactly as one sequential writer would cut.

    The rows are cut into blocks. A shard has at most ``most_rows`` rows, so it
    can reach into a block by at most so many: each block, with the beginning of
    the next, says for each of these entries where its last shard ends, and the
    answers of all blocks (``most_rows`` rows each) are followed from the first.
    A row above the byte bound is a shard of its own; a null size counts as 0.
    """
    spark, block = df.sparkSession, max(block, most_rows)
    columns = list(df.columns)
    placed = numbered(df, order, "__row").withColumns({"__block": F.floor(F.col("__row") / block).cast("int"), "__size": F.col(size).cast("long")})

    def exits(key, table):
        table = table.sort_by("__row")
        rows = np.asarray(table.column("__row"))
        own = int((rows < (key[0].as_py() + 1) * block).sum())
        following = _next_starts(_sizes_of(table), most_rows, most_bytes)
        at, count = np.arange(min(most_rows, own)), np.zeros(min(most_rows, own), dtype=np.int64)
        while (inside := at < own).any():
            count[inside] += 1
            at[inside] = following[at[inside]]
        n = len(at)
        return pa.table({"block": pa.array([key[0].as_py()] * n, pa.int32()), "entry": np.arange(n), "exit": at - own, "n": count})

    tall = placed.select("__row", "__size", F.explode(F.when((F.col("__block") > 0) & (F.col("__row") % block < most_rows), F.array("__block", F.col("__block") - 1)).otherwise(F.array("__block"))).alias("part"))
    jumps = tall.groupBy("part").applyInArrow(exits, "block int, entry long, exit long, n long").toArrow().sort_by([("block", "ascending"), ("entry", "ascending")])
    starts, entry, number, at = [], 0, 0, 0
    block_of, exit_of, n_of = (np.asarray(jumps.column(c)) for c in ("block", "exit", "n"))
    while at < len(block_of):
        end = at + int(np.searchsorted(block_of[at:], block_of[at], "right"))
        starts.append((int(block_of[at]), int(entry), int(number)))
        # An entry behind a short last block lies in no row of it.
        number, entry = (number + n_of[at + entry], exit_of[at + entry]) if at + entry < end else (number, 0)
        at = end
    known = spark.createDataFrame(starts, "__block int, __entry long, __first long")

    def assign(key, table):
        table = table.sort_by("__row")
        following = _next_starts(_sizes_of(table), most_rows, most_bytes)
        begins, at = np.zeros(table.num_rows, dtype=np.int64), table.column("__entry")[0].as_py()
        while at < table.num_rows:
            begins[at] = 1
            at = int(following[at])
        number = table.column("__first")[0].as_py() - 1 + np.cumsum(begins)
        return table.select(columns).append_column("shard", pa.array(number))

    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.LongType())])
    return placed.join(F.broadcast(known), "__block").groupBy("__block").applyInArrow(assign, schema)


def shard_digests(sharded: DataFrame, line: str, order: list[str]) -> DataFrame:
    """(shard, n_rows, n_bytes, digest): of each shard, whose rows are bounded, the SHA-256 of its lines in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(line).alias("__line"))))
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["__line"], F.lit("\n"))), "")
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), text.alias("t")).select("shard", "n_rows", F.octet_length("t").alias("n_bytes"), F.sha2("t", 256).alias("digest"))


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``chunk``: number from 0 of the run of ``size`` rows a row falls into."""
    return numbered(df, order, "__row").withColumn("chunk", F.floor(F.col("__row") / size).cast("int")).drop("__row")


def length_bucket(n):
    """Bucket of a length. The bounds."""
    return F.when(n <= 512, 512).when(n <= 2048, 2048).when(n <= 4096, 4096).otherwise(8192)
