"""The k most similar vectors of every vector, along shifted Hilbert curves.

A projection is fitted on a bounded sample. Every vector is projected, rotated
and shifted once for each ordering, and its place on a Hilbert curve through
the projected space is its key. Each ordering is cut into ranges of keys; every
vector is compared with the window of its neighbours along the curve, across
the borders of its range, and the lists of all orderings are merged and
reranked by cosine. The number of orderings grows with the table; they are
worked on in rounds, of which each leaves the k best so far and nothing else,
so what lies on disk at once doesn't grow with their number.

Vectors travel as unit vectors in half precision: a cosine is off by about
2e-5 at most, and no list of ids or vectors reaches the driver but the sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from orestrata.functions.vectors import usable_rows
from orestrata.session import discard, dropping_shuffles, settle

#: Rows the projection is fitted on, at most.
SAMPLE_ROWS = 8192

#: Ranges that one task works on; the rows it only compares with are about window/2 at either end.
RANGES_A_TASK = 4

#: Orderings that are shuffled at once; each holds a copy of the vectors.
CURVES_A_ROUND = 3

#: Sampled keys for each half window, from which the borders of the ranges are taken.
KEYS_A_HALF = 128


@dataclass(frozen=True)
class Curves:
    """Parameters of the orderings: how many at least, dimensions and bits of each curve, window, rows of a range, principal directions that are mixed."""

    orderings: int = 5
    axes: int = 8
    bits: int = 7
    window: int = 8192
    range_rows: int = 8192
    directions: int = 32
    seed: int = 7

    def orderings_for(self, n: int) -> int:
        """How many orderings n rows take: measured on 96,916 vectors, for each n/window up to 189 more than a recall@10 of 0.9 needs."""
        return max(self.orderings, math.ceil(3 + 0.12 * n / self.window))


def unit_rows(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors of the usable rows: ``dims`` finite numbers that are not all zero."""
    at, x = usable_rows(column, dims)
    x = x.astype(np.float64)
    # Scaled by the largest part first, so that no square over- or underflows.
    x /= np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return at, x.astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates (n, axes), each below 2**bits; axes * bits is at most 63."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(axes):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] ^= np.where(on, p, swap)
            x[i] ^= np.where(on, 0, swap)
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[axes - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Projection:
    """Directions of every ordering and the span of their coordinates."""

    directions: np.ndarray  # (orderings, dims, axes)
    low: np.ndarray
    high: np.ndarray
    shift: np.ndarray

    def keys(self, x: np.ndarray, bits: int, orderings=None) -> list[np.ndarray]:
        out = []
        for o in range(len(self.directions)) if orderings is None else orderings:
            y = (x @ self.directions[o] - self.low[o]) / (self.high[o] - self.low[o])
            cells = np.clip(((y + self.shift[o]) / 2.0) * (1 << bits), 0, (1 << bits) - 1)
            out.append(hilbert_keys(cells.astype(np.int64), bits))
        return out


def fit_projection(sample: np.ndarray, curves: Curves) -> Projection:
    """Leading principal directions of the sample, mixed by a random rotation for each ordering, with a random shift each."""
    rng = np.random.default_rng(curves.seed)
    dims = sample.shape[1]
    centred = sample - sample.mean(axis=0)
    _, vectors = np.linalg.eigh(centred.T.astype(np.float64) @ centred)
    axes = min(curves.axes, dims)
    kept = min(dims, max(axes, curves.directions))
    lead = vectors[:, ::-1][:, :kept]
    directions, low, high, shift = [], [], [], []
    for _ in range(curves.orderings):
        q, _ = np.linalg.qr(rng.standard_normal((kept, kept)))
        d = (lead @ q[:, :axes]).astype(np.float32)
        y = sample @ d
        directions.append(d)
        low.append(y.min(axis=0))
        high.append(y.max(axis=0) + 1e-9)
        shift.append(rng.random(axes))
    return Projection(np.stack(directions), np.stack(low), np.stack(high), np.stack(shift).astype(np.float32))


def _sample(df: DataFrame, id_column: str, vector_column: str, dims: int, n: int) -> np.ndarray:
    """At most about SAMPLE_ROWS unit vectors, chosen by the hash of the id."""
    every = max(1, n // SAMPLE_ROWS)
    picked = df.where(F.pmod(F.xxhash64(F.col(id_column)), F.lit(every)) == 0).select(vector_column).limit(2 * SAMPLE_ROWS).toArrow()
    return unit_rows(picked.column(0), dims)[1]


@dataclass
class Ranges:
    """How every ordering is cut: ``count`` ranges of ``per`` bins; a bin begins at each (key, id) of ``keys`` and ``ids``.

    A bin holds at least about half a window, so the bins next to a range are what its outermost vectors are compared with.
    """

    count: int
    per: int
    keys: list[np.ndarray]
    ids: list[np.ndarray]

    def bins(self, o: int, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The bin of each row of an ordering: how many borders aren't after its (key, id)."""
        at, end = np.searchsorted(self.keys[o], key, "left"), np.searchsorted(self.keys[o], key, "right")
        tied = np.flatnonzero(at < end)
        for lo in np.unique(at[tied]).tolist():
            rows = tied[at[tied] == lo]
            at[rows] = lo + np.searchsorted(self.ids[o][lo:end[rows[0]]], ids[rows], "right")
        return at.astype(np.int32)


def _cut_ranges(vectors: DataFrame, projection, dims: int, curves: Curves) -> Ranges:
    """Borders from the keys of a part of the rows, chosen by the hash of the id; of n rows about n * KEYS_A_HALF / (window / 2) reach the driver."""
    half = max(1, curves.window // 2)
    every = max(1, half // KEYS_A_HALF)
    schema = "id long, " + ", ".join(f"key{o} long" for o in range(curves.orderings))
    part = vectors.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    got = part.mapInArrow(_keyed(projection, dims, curves.bits), schema).toArrow()
    # Somewhat more than half a window, as the sample is only a part.
    bin_rows = half + half // 8
    per = max(1, RANGES_A_TASK * curves.range_rows // bin_rows)
    count = max(1, got.num_rows * every // (per * bin_rows))
    ids = np.asarray(got.column(0))
    at = np.arange(1, count * per) * len(ids) // (count * per)
    keys_at, ids_at = [], []
    for o in range(curves.orderings):
        key = np.asarray(got.column(o + 1))
        order = np.lexsort((ids, key))[at] if len(ids) else at[:0]
        keys_at.append(key[order])
        ids_at.append(ids[order])
    return Ranges(count, per, keys_at, ids_at)


def _halved(dims: int):
    """Id and half-precision unit vector of the usable rows."""

    def run(batches):
        for batch in batches:
            at, x = unit_rows(batch.column(1), dims)
            if not len(at):
                continue
            offsets = pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * (dims * 2))
            flat = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(x.astype(np.float16).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), flat], names=["id", "vec"])

    return run


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """Half-precision vectors as rows of single precision."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float16).reshape(-1, dims).astype(np.float32)


def _keyed(projection, dims: int, bits: int):
    """Id and keys of all orderings."""

    def run(batches):
        fitted = projection.value
        for batch in batches:
            keys = fitted.keys(_whole(batch.column(1), dims), bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, keys)], names=["id", *[f"key{o}" for o in range(len(keys))]])

    return run


def _placed(projection, dims: int, bits: int, ranges, orderings: range):
    """Every row once for each ordering and each range that reads it: its own, and the one before or after it if its bin is next to that."""

    def run(batches):
        fitted, cut = projection.value, ranges.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for j, (o, key) in enumerate(zip(orderings, fitted.keys(_whole(batch.column(1), dims), bits, orderings))):
                at, place = np.divmod(cut.bins(o, key, ids), cut.per)
                before = np.flatnonzero((place == 0) & (at > 0))
                after = np.flatnonzero((place == cut.per - 1) & (at < cut.count - 1))
                rows = np.concatenate([np.arange(len(ids)), before, after])
                part = np.concatenate([at, at[before] - 1, at[after] + 1]) + j * cut.count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), pa.array(key[rows]), pa.array(ids[rows]), batch.column(1).take(pa.array(rows)), pa.array(np.arange(len(rows)) < len(ids))],
                    names=["part", "key", "id", "vec", "own"])

    return run


def _dealt(vectors: DataFrame, projection, dims: int, bits: int, shared, orderings: range) -> DataFrame:
    """(id, vec, own) along these orderings, a partition for each range of each: its own rows, and those of the bin before and after it."""
    placed = vectors.mapInArrow(_placed(projection, dims, bits, shared, orderings), "part int, key long, id long, vec binary, own boolean")
    return placed.repartitionById(len(orderings) * shared.value.count, F.col("part")).sortWithinPartitions("key", "id").select("id", "vec", "own")


def window_lists(x: np.ndarray, ids: np.ndarray, k: int, window: int, step: int = 512, begin: int = 0, end: int | None = None, least: float = -2.0):
    """For curve-sorted unit vectors from ``begin`` to ``end``: (positions, neighbour ids, cosines) of the k best of each within its window, cosines below ``least`` left out."""
    n, step = len(x), min(step, max(1, window // 2))
    end = n if end is None else end
    for a in range(begin, end, step):
        b = min(end, a + step)
        lo = max(0, min((a + b - window) // 2, n - window))
        hi = min(n, lo + window)
        s = x[a:b] @ x[lo:hi].T
        s[np.arange(b - a), np.arange(a - lo, b - lo)] = -2.0
        take = min(k, hi - lo - 1)
        if take < 1:
            continue
        if least > -1.0:
            close = np.flatnonzero(s >= least)
            if len(close) <= k * (b - a):  # no need to look for the best among all
                rows, near = np.divmod(close, hi - lo)
                near, score = ids[lo + near], s.ravel()[close]
                best, _ = best_of(rows, near, score, k)
                yield a + rows[best], near[best], score[best]
                continue
        top = np.argpartition(-s, take - 1, axis=1)[:, :take]
        score = np.take_along_axis(s, top, axis=1)
        # Of equals at the last place any may have been taken: there the smallest ids are chosen.
        last = score.min(axis=1)
        tied = np.flatnonzero((s >= last[:, None]).sum(axis=1) > take)
        for r in tied.tolist():
            at = np.flatnonzero(s[r] >= last[r])
            at = at[np.lexsort((ids[lo + at], -s[r, at]))[:take]]
            top[r], score[r] = at, s[r, at]
        held = score.ravel() >= least
        yield np.repeat(np.arange(a, b), take)[held], ids[lo + top].ravel()[held], score.ravel()[held]


def _neighbour_lists(k: int, dims: int, window: int, least: float):
    def run(batches):
        ids, parts, own = [], [], []
        for batch in batches:
            ids.append(np.asarray(batch.column(0)))
            own.append(np.asarray(batch.column(2).to_numpy(zero_copy_only=False), dtype=bool))
            parts.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float16).reshape(-1, dims))
        if not ids:
            return
        ids = np.concatenate(ids)
        x = np.concatenate(parts).astype(np.float32)
        del parts
        mine = np.flatnonzero(np.concatenate(own))
        if not len(mine):
            return
        for at, near, score in window_lists(x, ids, k, window, begin=int(mine[0]), end=int(mine[-1]) + 1, least=least):
            yield _lists(ids, at, near, score)

    return run


def _lists(ids: np.ndarray, at: np.ndarray, near: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """(id, near, score), a row for each run of equal positions."""
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.r_[starts, len(at)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[at[starts]]), pa.ListArray.from_arrays(offsets, pa.array(near)), pa.ListArray.from_arrays(offsets, pa.array(score, pa.float32()))], names=["id", "near", "score"])


def best_of(rows: np.ndarray, near: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ranks) of the k best of each row: every neighbour once with its best score, ties by the smaller neighbour."""
    order = np.lexsort((-score, near, rows))
    fresh = np.r_[True, (rows[order][1:] != rows[order][:-1]) | (near[order][1:] != near[order][:-1])] if len(order) else np.zeros(0, dtype=bool)
    once = order[fresh]
    once = once[np.lexsort((near[once], -score[once], rows[once]))]
    starts = np.flatnonzero(np.r_[True, rows[once][1:] != rows[once][:-1]]) if len(once) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(once)) - np.repeat(starts, np.diff(np.r_[starts, len(once)])) + 1
    return once[rank <= k], rank[rank <= k]


def _merge(k: int):
    """Of each id, whose lists stand in one row, the k best of all lists."""

    def run(batches):
        for batch in batches:
            lists = [batch.column(c).flatten() for c in (1, 2)]
            inner = np.asarray(lists[0].value_lengths())
            outer = np.asarray(batch.column(1).value_lengths())
            rows = np.repeat(np.repeat(np.arange(batch.num_rows), outer), inner)
            near, score = np.asarray(lists[0].flatten()), np.asarray(lists[1].flatten())
            at, _ = best_of(rows, near, score, k)
            yield _lists(np.asarray(batch.column(0)), rows[at], near[at], score[at])

    return run


def nearest_of(df: DataFrame, queries: DataFrame, id_column: str, vector_column: str, k: int = 10, dims: int = 384, block: int = 4096) -> DataFrame:
    """(id, neighbour, cosine): the k most similar vectors of a stated set of queries, exactly, against all rows in blocks.

    The queries are read in blocks of at most ``block`` vectors, one broadcast
    each; a batch of rows keeps k candidates for every query.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>").alias("v")).where(F.col("id").isNotNull())
    wanted = queries.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>").alias("v")).where(F.col("id").isNotNull())
    blocks = max(1, -(-wanted.count() * 5 // (4 * block)))
    out = None
    for b in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        at, q = unit_rows(part.column(1), dims)
        shared = spark.sparkContext.broadcast((np.asarray(part.column(0))[at], q))

        def run(batches, shared=shared):
            ids, q = shared.value
            for batch in batches:
                at, x = unit_rows(batch.column(1), dims)
                if not len(at) or not len(ids):
                    continue
                own = np.asarray(batch.column(0))[at]
                s = q @ x.T
                s[ids[:, None] == own[None, :]] = -2.0
                take = min(k, len(at))
                top = np.argpartition(-s, take - 1, axis=1)[:, :take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, take)), pa.array(own[top].ravel()), pa.array(np.take_along_axis(s, top, axis=1).ravel())], names=["id", "neighbour", "cosine"])

        one = base.mapInArrow(run, "id long, neighbour long, cosine float").where("cosine > -2")
        out = one if out is None else out.unionByName(one)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return out.withColumn("rank", place).where(F.col("rank") <= k)


#: How far the cosine of half-precision vectors may be off.
HALF_ERROR = 1e-4


def verified(near: DataFrame, df: DataFrame, id_column: str, vector_column: str, least: float, dims: int = 384) -> DataFrame:
    """Pairs (id, neighbour, cosine) whose cosine is at least ``least``; those too close to it to tell are computed from the full vectors.

    They are few, so only the vectors they need are read again and joined.
    """
    clear = near.where(F.col("cosine") >= least + HALF_ERROR).select("id", "neighbour", F.col("cosine").cast("double").alias("cosine"))
    close = near.where((F.col("cosine") >= least - HALF_ERROR) & (F.col("cosine") < least + HALF_ERROR)).select("id", "neighbour").distinct()
    needed = close.select(F.explode(F.array("id", "neighbour")).alias("vid")).distinct()
    vectors = df.select(F.col(id_column).cast("long").alias("vid"), F.col(vector_column).cast("array<float>").alias("v")).join(needed, "vid", "left_semi")

    def run(batches):
        for batch in batches:
            at, x = usable_rows(batch.column(2), dims)
            two, y = usable_rows(batch.column(3), dims)
            both, i, j = np.intersect1d(at, two, return_indices=True)
            x, y = x[i].astype(np.float64), y[j].astype(np.float64)
            for v in (x, y):
                v /= np.abs(v).max(axis=1, keepdims=True, initial=1e-300)
            score = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            rows = pa.array(both)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(score)], names=["id", "neighbour", "cosine"])

    pairs = close.join(vectors.select(F.col("vid").alias("id"), F.col("v").alias("a")), "id").join(vectors.select(F.col("vid").alias("neighbour"), F.col("v").alias("b")), "neighbour")
    exact = pairs.select("id", "neighbour", "a", "b").mapInArrow(run, "id long, neighbour long, cosine double").where(F.col("cosine") >= least)
    return clear.unionByName(exact)


def most_similar(df: DataFrame, id_column: str, vector_column: str, k: int = 10, dims: int = 384, curves: Curves = Curves(), least: float = -2.0) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar vectors of every usable vector.

    Usable are vectors of ``dims`` finite numbers that are not all zero; others,
    and null ids, give no row and are nobody's neighbour. Ties go to the smaller
    id. Rows with a repeated id are vectors of their own but not neighbours of
    themselves twice: per id the best cosine counts. With fewer than k + 1
    vectors all others are listed. Of these k, cosines below ``least`` may be
    asked to be left out, which saves looking for them.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<float>").alias("vec")).where(F.col("id").isNotNull())
    n = base.count()
    curves = replace(curves, orderings=curves.orderings_for(n))
    sample = _sample(base, "id", "vec", dims, n)
    if not len(sample):
        sample = np.eye(dims, dtype=np.float32)[:2]
    projection = spark.sparkContext.broadcast(fit_projection(sample, curves))
    vectors = settle(base.mapInArrow(_halved(dims), "id long, vec binary"), "vectors")
    shared = spark.sparkContext.broadcast(_cut_ranges(vectors, projection, dims, curves))
    schema = "id long, near array<long>, score array<float>"
    best = None
    with dropping_shuffles(spark):
        for first in range(0, curves.orderings, CURVES_A_ROUND):
            orderings = range(first, min(curves.orderings, first + CURVES_A_ROUND))
            lists = _dealt(vectors, projection, dims, curves.bits, shared, orderings).mapInArrow(_neighbour_lists(k, dims, curves.window, least), schema)
            every = lists if best is None else lists.unionByName(best)
            gathered = every.groupBy("id").agg(F.collect_list("near").alias("near"), F.collect_list("score").alias("score"))
            before, best = best, settle(gathered.mapInArrow(_merge(k), schema), "best")
            if before is not None:
                discard(before)
    discard(vectors)
    ranked = best.select("id", F.posexplode(F.arrays_zip("near", "score")).alias("at", "x"))
    return ranked.select("id", F.col("x.near").alias("neighbour"), F.col("x.score").alias("cosine"), (F.col("at") + 1).alias("rank")).where("id <> neighbour")
