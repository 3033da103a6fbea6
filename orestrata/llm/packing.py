"""Filling containers of fixed capacity with items, by the sum-of-squares rule.

The items of a capacity are dealt at random into groups of bounded total size;
each group is packed online by one task. A level array holds how many open
containers are filled to each level; an item goes where the sum of the squared
counts grows least, which keeps no level crowded and so leaves partners for
what is still to come. When a group's items are in, containers that fit
together are poured together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from orestrata.session import settle

#: Containers a group should come to; groups this large lose next to nothing at their end.
GROUP_CONTAINERS = 2000
#: Capacities one call takes.
MOST_CAPACITIES = 100


def pack_sizes(sizes: np.ndarray, capacity: int, pour: bool = True) -> np.ndarray:
    """Container number (from 0) of every item, none above the capacity, in order of arrival."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_at: dict[int, list[int]] = {}
    out = np.empty(len(sizes), dtype=np.int64)
    fill: list[int] = []
    highest = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            if not fill:
                fill.append(0)
                counts[0] += 1
                open_at[0] = [0]
            out[i] = 0
            continue
        best, cost = -1, (2 * counts[s] + 1 if s < capacity else 0)
        top = min(highest, capacity - s)
        if top >= 1:
            here = counts[1:top + 1]
            gain = 2 * counts[1 + s:top + s + 1] + 1
            if top + s == capacity:
                gain[-1] = 0
            change = np.where(here > 0, gain - 2 * here + 1, 1 << 40)
            # Of equal changes the fullest container, which is last.
            at = top - 1 - int(np.argmin(change[::-1]))
            if change[at] <= cost:
                best = at + 1
        if best < 0 and counts[0] > 0:
            best = 0
        if best < 0:
            bin_no = len(fill)
            fill.append(0)
            best = 0
        else:
            bin_no = open_at[best].pop()
            counts[best] -= 1
        level = best + s
        fill[bin_no] = level
        if level < capacity:
            counts[level] += 1
            open_at.setdefault(level, []).append(bin_no)
            highest = max(highest, level)
        out[i] = bin_no
    return _pour_together(out, np.array(fill, dtype=np.int64), capacity) if pour else out


def _pour_together(bins: np.ndarray, fill: np.ndarray, capacity: int) -> np.ndarray:
    """Containers that are not full, fullest first, each into the fullest one it still fits."""
    loose = [int(b) for b in np.argsort(-fill, kind="stable") if fill[b] < capacity]
    into = np.arange(len(fill))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    at_level: dict[int, list[int]] = {}
    for b in loose:
        f = int(fill[b])
        fits = np.flatnonzero(counts[:capacity - f + 1])
        if len(fits):
            level = int(fits[-1])
            host = at_level[level].pop()
            counts[level] -= 1
            into[b] = host
        else:
            host, level = b, 0
        level += f
        if level < capacity:
            counts[level] += 1
            at_level.setdefault(level, []).append(host)
    final = into[bins]
    _, dense = np.unique(final, return_inverse=True)
    return dense


def _pack_group(table: pa.Table, pour: bool = True) -> pa.Table:
    container = table.column("container_id")[0].as_py()
    capacity = int(table.column("capacity")[0].as_py())
    group = int(table.column("grp")[0].as_py())
    table = table.sort_by([("turn", "ascending"), ("part_no", "ascending")])
    bins = pack_sizes(np.asarray(table.column("tokens").combine_chunks()), capacity, pour)
    n = table.num_rows
    return pa.table({
        "container_id": pa.array([container] * n, table.column("container_id").type),
        "id": table.column("id"), "part_no": table.column("part_no"), "tokens": table.column("tokens"),
        "bin_id": pa.array(bins + (group << 32), pa.int64())})


def pack(items: DataFrame, containers: DataFrame, id_column: str, size_column: str = "tokens", pour: bool = True) -> DataFrame:
    """(container_id, id, part_no, tokens, bin_id): the container of every item for every capacity.

    An item is in one part unless it exceeds the capacity; then its parts fill
    containers of their own but for the last, which is packed like any item.
    Null sizes count as 0; items of size 0 take no room and share a container.
    Repeated and null ids are items of their own. Containers without a positive
    capacity are left out; more than ``MOST_CAPACITIES`` are an error. The
    result doesn't depend on how the table lies in files, but for items without
    an id, which go by their place. With ``pour``,
    containers that fit together are poured together after the online rule.
    """
    size = F.greatest(F.coalesce(F.col(size_column), F.lit(0)), F.lit(0)).cast("long")
    turn = F.coalesce(F.when(F.col(id_column).isNotNull(), F.xxhash64(F.col(id_column), size)), F.xxhash64(F.monotonically_increasing_id()))
    base = settle(items.select(F.col(id_column).alias("id"), size.alias("size"), turn.alias("turn")), "items")
    total = base.agg(F.sum("size")).first()[0] or 0
    kinds = containers.where("capacity_tokens > 0").select("container_id", F.col("capacity_tokens").cast("long").alias("capacity"))
    # The list of capacities is a few rows by contract, so it travels as a literal array instead of a join.
    few = kinds.limit(MOST_CAPACITIES + 1).collect()
    if len(few) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    if not few:
        few = [(None, 1)]
    pairs = F.array(*[F.struct(F.lit(c).cast(kinds.schema["container_id"].dataType).alias("container_id"), F.lit(int(k)).cast("long").alias("capacity")) for c, k in few])
    each = base.withColumn("kind", F.explode(pairs)).select("id", "size", "turn", "kind.*").where("container_id is not null")
    # Full parts of oversized items need no packing.
    over = F.when(F.col("size") > F.col("capacity"), F.floor((F.col("size") - 1) / F.col("capacity"))).otherwise(F.lit(0)).cast("int")
    each = each.withColumn("full", over)
    groups = F.greatest(F.lit(1), F.ceil(F.lit(float(total)) / (F.col("capacity") * GROUP_CONTAINERS))).cast("long")
    rest = each.select(
        "container_id", "capacity", "id", (F.col("full") + 1).alias("part_no"), (F.col("size") - F.col("full") * F.col("capacity")).alias("tokens"), "turn",
        F.pmod(F.col("turn"), groups).cast("int").alias("grp"))
    packed = rest.groupBy("container_id", "grp").applyInArrow(lambda t: _pack_group(t, pour), _schema(items, id_column, containers))
    filled = (
        each.where("full > 0").select("container_id", "id", "turn", F.col("capacity").alias("tokens"), F.explode(F.sequence(F.lit(1), F.col("full"))).alias("part_no"))
        .select("container_id", "id", "part_no", "tokens", (-F.abs(F.shiftright(F.xxhash64("turn", "part_no"), 1)) - 1).alias("bin_id")))
    return packed.unionByName(filled)


def _schema(items: DataFrame, id_column: str, containers: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("container_id", containers.schema["container_id"].dataType), T.StructField("id", items.schema[id_column].dataType),
        T.StructField("part_no", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("bin_id", T.LongType())])


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, n_items, n_bins, tokens, fill): how well each capacity is used."""
    used = packed.groupBy("container_id").agg(
        F.countDistinct("id").alias("n_items"), F.countDistinct("bin_id").alias("n_bins"), F.sum("tokens").alias("tokens"))
    return used.join(containers.select("container_id", "capacity_tokens"), "container_id").select(
        "container_id", "n_items", "n_bins", "tokens", F.round(F.col("tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6).alias("fill"))
