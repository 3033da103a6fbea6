"""Mixing sources to target weights.

Weights stand at the nodes of a tree of domains, sources and languages. A budget is propagated from the root: a node that can't use its share, because
its records times their allowed repeats don't reach it, gives the rest to its
siblings, and only what they can't take either goes up to the parent's
siblings. Languages stand below sources, as it is the share of a source that is
promised. Each leaf then repeats its records for whole epochs and takes the
prefix of one more epoch, in an order seeded by mix, leaf and epoch; where that
ends at a record too large for what is left, smaller ones after it fill the gap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from orestrata.session import settle

#: Leaves of all trees together, at most, that the driver budgets.
MOST_LEAVES = 200_000


class Node:
    """A node of a budget tree: a weight among its siblings, and children or a capacity."""

    def __init__(self, weight: float, capacity: float = 0.0, children: dict | None = None) -> None:
        self.weight = weight
        self.children: dict = children or {}
        self._capacity = capacity

    @property
    def capacity(self) -> float:
        return sum(c.capacity for c in self.children.values()) if self.children else self._capacity


def share_out(weights: list[float], capacities: list[float], budget: float) -> list[float]:
    """Amounts in proportion to the weights, none above its capacity; what one can't take goes to the others."""
    got = [0.0] * len(weights)
    left = min(budget, sum(capacities))
    free = [i for i in range(len(weights)) if capacities[i] > 0]
    while left > 1e-9 and free:
        total = sum(weights[i] for i in free)
        # Nodes without weight only help out when all others are exhausted.
        part = {i: left * weights[i] / total if total > 0 else left / len(free) for i in free}
        full = [i for i in free if got[i] + part[i] >= capacities[i] - 1e-9]
        if not full:
            for i in free:
                got[i] += part[i]
            break
        for i in full:
            left -= capacities[i] - got[i]
            got[i] = capacities[i]
            free.remove(i)
        # The others keep what they had; the rest is dealt again among them.
        left = min(budget, sum(capacities)) - sum(got)
    return got


def budgets(node: Node, budget: float, path: tuple = ()) -> dict[tuple, float]:
    """Budget of every leaf by path."""
    if not node.children:
        return {path: min(budget, node.capacity)}
    names = list(node.children)
    parts = share_out([node.children[n].weight for n in names], [node.children[n].capacity for n in names], budget)
    out: dict[tuple, float] = {}
    for n, part in zip(names, parts):
        out.update(budgets(node.children[n], part, (*path, n)))
    return out


def full_shares(node: Node, share: float = 1.0, path: tuple = (), levels: int = 2) -> dict[tuple, float]:
    """Share of the total that every node of a level gets while nothing is short; what holds nothing leaves its share to its siblings."""
    if levels == 0 or not node.children:
        return {path: share}
    held = {n: c for n, c in node.children.items() if c.capacity > 0 and c.weight > 0}
    weight = sum(c.weight for c in held.values())
    out: dict[tuple, float] = {}
    for n, c in held.items():
        out.update(full_shares(c, share * c.weight / weight, (*path, n), levels - 1))
    return out


def _at(node: Node, path: tuple) -> Node:
    for n in path:
        node = node.children[n]
    return node


def full_share_total(root: Node, levels: int = 1) -> float:
    """The largest total at which every node of a level that holds anything still gets its share."""
    shares = full_shares(root, levels=levels)
    return min((_at(root, p).capacity / s for p, s in shares.items() if p), default=0.0)


def primary_language(lang) -> F.Column:
    """The first subtag in lower case; anything else, and private codes, as ``und``."""
    code = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(F.coalesce(code, F.lit("")).isin("", "xx", "und"), F.lit("und")).otherwise(code)


#: Rows of a leaf that share a place in its seeded order, about; only the bucket in which a prefix ends is ever sorted.
BUCKET_ROWS = 2000


def _fill_edges(table: pa.Table) -> pa.Table:
    """Of the rows in which the prefixes of a source's leaves end, those that are taken.

    Each leaf takes what fits its room in the seeded order, past records too
    large for it; what all leaves together still lack is made up from the rest.
    """
    table = table.sort_by([("lang", "ascending"), ("turn", "ascending"), ("rid", "ascending")])
    sizes, langs, rooms = (table.column(c).to_pylist() for c in ("tokens", "lang", "room"))
    taken = np.zeros(table.num_rows, dtype=bool)
    lacking, at = 0.0, 0
    while at < len(sizes):
        lang, room = langs[at], rooms[at]
        while at < len(sizes) and langs[at] == lang:
            if sizes[at] <= room:
                taken[at], room = True, room - sizes[at]
            at += 1
        lacking += room
    for i in np.argsort(np.asarray(table.column("turn")), kind="stable").tolist():
        if not taken[i] and sizes[i] <= lacking:
            taken[i], lacking = True, lacking - sizes[i]
    return table.append_column("taken", pa.array(taken.astype(np.int32)))


def mix(
        records: DataFrame, targets: DataFrame, id_column: str = "doc_id", total: float | dict | None = None, seed: int = 11, languages: dict[str, float] | None = None,
        domains: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) from records (id, source, lang, tokens) and targets (mix_id, source, weight, max_repeats).

    The tree of a mix is domain, source, language. ``domains`` names the domain
    of a source, which is a domain of its own otherwise; a domain weighs what its
    sources do. ``languages`` weighs the languages within a source; one that
    isn't named only helps out, and without it a language weighs what it holds.
    ``total`` is the size of every mix, or of each by its id; without it a mix
    gets the largest size at which every source that holds anything reaches its
    share.

    ``selection``: (mix_id, id, source, lang, tokens, times), times between 1
    and ``max_repeats``. ``shares``: (mix_id, source, weight, max_repeats,
    tokens, share, available) for every target. The order of a leaf is a hash of
    id and size, so it doesn't depend on how the table lies in files, but for
    rows without an id, which go by their place. Records without size or with a
    source no mix names, null included, are not chosen; a repeated id is as many
    records; a null weight counts as 0 and null repeats as 1.
    """
    spark = records.sparkSession
    placed_id = F.coalesce(F.when(F.col(id_column).isNotNull(), F.xxhash64(F.col(id_column), "tokens")), F.xxhash64(F.monotonically_increasing_id()))
    base = settle(records.select(
        F.col(id_column).alias("id"), "source", primary_language(F.col("lang")).alias("lang"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), placed_id.alias("rid"))
        .where("tokens > 0 and source is not null"), "sized")
    wanted = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    held = base.groupBy("source", "lang").agg(F.sum("tokens").alias("held"), F.count("*").alias("n"))
    # Sources are those of the target list and languages are codes of two or three letters.
    leaves = wanted.join(held, "source", "left").limit(MOST_LEAVES + 1).collect()
    if len(leaves) > MOST_LEAVES:
        raise ValueError("too many leaves")
    roots: dict = {}
    domains, counts = domains or {}, {(r.source, r.lang): r.n for r in leaves}
    for r in leaves:
        root = roots.setdefault(r.mix_id, Node(1.0))
        domain = root.children.setdefault(domains.get(r.source, r.source), Node(0.0))
        if r.source not in domain.children:
            domain.children[r.source] = Node(max(0.0, r.weight))
            domain.weight += max(0.0, r.weight)
        if r.held:
            weight = float(r.held) if languages is None else languages.get(r.lang, 0.0)
            domain.children[r.source].children[r.lang] = Node(weight, float(r.held) * max(0, r.max_repeats))
    plan = []
    for mix_id, root in roots.items():
        size = total.get(mix_id) if isinstance(total, dict) else total
        size = full_share_total(root, 2) if size is None else size
        repeats = {r.source: max(1, r.max_repeats) for r in leaves if r.mix_id == mix_id}
        for path, tokens in budgets(root, size).items():
            if len(path) == 3 and tokens > 0:
                all_ = _at(root, path).capacity / repeats[path[1]]
                epochs = int((tokens + 1e-6) // all_)
                plan.append((mix_id, path[1], path[2], epochs, max(0.0, float(tokens - epochs * all_)), max(1, counts[path[1:]] // BUCKET_ROWS)))
    kinds = dict(targets.dtypes)
    leaf = spark.createDataFrame(plan, f"mix_id {kinds['mix_id']}, source string, lang string, epochs int, part double, buckets int")
    placed = base.join(leaf, ["source", "lang"]).withColumn("turn", F.xxhash64(F.lit(seed), "mix_id", "source", "lang", "epochs", "rid"))
    placed = placed.withColumn("bucket", F.pmod(F.shiftright("turn", 20), F.col("buckets").cast("long")).cast("int"))
    key = ["mix_id", "source", "lang"]
    sums = placed.groupBy(*key, "bucket").agg(F.sum("tokens").alias("sum"), F.first("part").alias("part"))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    # The bucket in which the prefix of the last epoch ends.
    edge = sums.where((F.col("before") < F.col("part")) & (F.col("before") + F.col("sum") >= F.col("part"))).select(*key, F.col("bucket").alias("edge"), (F.col("part") - F.col("before")).alias("room"))
    placed = placed.join(edge, key, "left").select(*key, "id", "rid", "tokens", "epochs", "turn", "bucket", "edge", F.coalesce("room", F.lit(0.0)).alias("room"))
    at_edge = placed.where(F.col("bucket") == F.col("edge"))
    filled = at_edge.groupBy("mix_id", "source").applyInArrow(_fill_edges, T.StructType([*at_edge.schema.fields, T.StructField("taken", T.IntegerType())]))
    others = placed.where(~F.col("bucket").eqNullSafe(F.col("edge"))).withColumn("taken", F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)))
    chosen = filled.unionByName(others).withColumn("times", F.col("epochs") + F.col("taken")).where("times > 0")
    selection = chosen.select("mix_id", "id", "source", "lang", "tokens", "times")
    got = selection.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"))
    sized = wanted.join(got, ["mix_id", "source"], "left").join(held.groupBy("source").agg(F.sum("held").alias("available")), "source", "left").na.fill(0, ["tokens", "available"])
    whole = Window.partitionBy("mix_id")
    shares = sized.select(
        "mix_id", "source", "weight", "max_repeats", "tokens", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(whole), F.lit(0)), F.lit(0.0)).alias("share"), "available")
    return selection, shares
