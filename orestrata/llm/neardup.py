"""Near-duplicate records by bit-sliced comparison of fingerprints.

1. Every record becomes its set of word shingles; records with the same set are
   one representative from here on.
2. A fingerprint keeps one bit of each of ``BITS`` minimum hashes: two records
   of similarity s differ in about ``(1 - s) / 2`` of the bits.
3. Candidates are laid next to each other: a representative goes into one
   bucket for each band of minimum hashes.
4. In a bucket-sorted run the fingerprints are stored as vertical bit planes, 64
   records to a machine word. For each offset d one pass over the planes XORs
   all records with those d places on and adds the differing bits into
   vertical counters with carry-save adders; words all of whose lanes exceed
   the radius are abandoned between groups of planes.
5. What stays within the radius is verified exactly on the shingle sets.

Buckets above ``RUN`` members are dealt into sub-blocks and every pair of
sub-blocks is compared by its own task, so no bucket has to fit one task and no
member is dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orestrata.session import settle

BITS = 256
BANDS, ROWS = 40, 4
#: Members of a bucket up to which one task compares them all.
RUN = 4096
_MIX = np.random.default_rng(20240607).integers(1, 2**63 - 1, size=(BITS, 2), dtype=np.int64).astype(np.uint64)


def radius(similarity: float, bits: int = BITS, sigmas: float = 4.0) -> int:
    """Differing bits up to which a pair stays: the expected number at ``similarity`` and so many standard deviations."""
    p = (1.0 - similarity) / 2.0
    return min(bits, math.ceil(bits * p + sigmas * math.sqrt(bits * p * (1.0 - p))))


def joined_text(columns: list[str]) -> Column:
    """The columns joined by a space, null as empty, lower-cased."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def with_shingles(df: DataFrame, text: Column, width: int) -> DataFrame:
    """``df`` with ``shingles``: the distinct hashed runs of ``width`` consecutive words of ``text``, sorted.

    Words are the longest runs of letters and digits. Null for texts with fewer words.
    """
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        F.sequence(F.lit(0), F.size("__words") - width),
        lambda i: F.xxhash64(*[F.element_at("__words", i + k + 1) for k in range(width)]))
    sets = F.when(F.size("__words") >= width, F.array_sort(F.array_distinct(grams)))
    return df.withColumn("__words", words).withColumn("shingles", sets).drop("__words")


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of 64-bit shingle hashes."""
    h = (x ^ _MIX[k, 0]) * (_MIX[k, 1] | np.uint64(1))
    return h ^ (h >> np.uint64(32))


def signatures(batches):
    """Arrow batches (id, whole, n, shingles) to the same with fingerprint and band keys for the shingles."""
    for batch in batches:
        sets = batch.column(3)
        offsets = np.asarray(sets.offsets)
        flat = np.asarray(sets.values).view(np.uint64)[offsets[0]:offsets[-1]]
        starts = (offsets[:-1] - offsets[0]).astype(np.int64)
        n = len(starts)
        if not n:
            continue
        bits = np.zeros((n, BITS), dtype=np.uint8)
        bands = np.zeros((n, BANDS), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(BITS):
                least = np.minimum.reduceat(_mix(flat, k), starts)
                bits[:, k] = (least >> np.uint64(17)).astype(np.uint8) & 1
                if k < BANDS * ROWS:
                    b = k // ROWS
                    bands[:, b] = (bands[:, b] * np.uint64(0x9E3779B97F4A7C15)) ^ _mix(least, (k * 7 + 3) % BITS)
            bands = bands * np.uint64(64) + np.arange(BANDS, dtype=np.uint64)
        packed = np.packbits(bits, axis=1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([r.tobytes() for r in packed], pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))],
            names=["id", "whole", "n", "print", "bands"])


# --- the comparison proper -------------------------------------------------------------------------------------------

def planes_of(prints) -> np.ndarray:
    """Fingerprints (rows of bytes) as vertical planes: ``planes[b]`` holds bit b of all records, 64 to a word."""
    if not isinstance(prints, np.ndarray):
        prints = np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(prints), -1)
    rows = np.unpackbits(prints, axis=1)
    pad = -len(prints) % 64
    if pad:
        rows = np.vstack([rows, np.zeros((pad, rows.shape[1]), dtype=np.uint8)])
    return np.ascontiguousarray(np.packbits(rows.T, axis=1, bitorder="little")).view("<u8")


def _shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Each lane gets the bit of the lane d places on; lanes past the end get 0."""
    words, bits = divmod(d, 64)
    out = np.zeros_like(planes)
    n = planes.shape[1]
    if words < n:
        out[:, :n - words] = planes[:, words:] >> np.uint64(bits)
        if bits and words + 1 < n:
            out[:, :n - words - 1] |= planes[:, words + 1:] << np.uint64(64 - bits)
    return out


def _exceeds(counters: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose vertical counter is above ``limit``."""
    above = np.zeros_like(counters[0])
    equal = np.full_like(above, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(len(counters) - 1, -1, -1):
        if limit >> i & 1:
            equal &= counters[i]
        else:
            above |= equal & counters[i]
            equal &= ~counters[i]
    return above


def within(a: np.ndarray, b: np.ndarray, alive: np.ndarray, limit: int, group: int = 32) -> np.ndarray:
    """Lanes (as words) of which the planes ``a`` and ``b`` differ in at most ``limit`` bits.

    Carry-save counting: three planes of one weight become one of it and one of
    the next. After every group of planes the words without a live lane are
    dropped from all further work.
    """
    words = np.flatnonzero(alive)
    out = np.zeros_like(alive)
    if not len(words):
        return out
    live = alive[words]
    width = int(a.shape[0]).bit_length()
    counters = [np.zeros(len(words), dtype=np.uint64) for _ in range(width)]
    for start in range(0, a.shape[0], group):
        part = slice(start, min(start + group, a.shape[0]))
        pending: list[list[np.ndarray]] = [[counters[i]] for i in range(width)] + [[]]
        pending[0].extend(a[part][:, words] ^ b[part][:, words])
        for weight in range(width):
            level = pending[weight]
            while len(level) >= 3:
                x, y, z = level.pop(), level.pop(), level.pop()
                half = x ^ y
                level.insert(0, half ^ z)
                pending[weight + 1].append((x & y) | (half & z))
            if len(level) == 2:
                x, y = level
                level[:] = [x ^ y]
                pending[weight + 1].append(x & y)
            counters[weight] = level[0]
        live &= ~_exceeds(counters, limit)
        keep = np.flatnonzero(live)
        if len(keep) < len(words):
            words, live = words[keep], live[keep]
            if not len(words):
                return out
            counters = [c[keep] for c in counters]
    out[words] = live
    return out


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _mask(flags: np.ndarray, n_words: int) -> np.ndarray:
    full = np.zeros(n_words * 64, dtype=np.uint8)
    full[:len(flags)] = flags
    return np.ascontiguousarray(np.packbits(full, bitorder="little")).view("<u8")


def compare_run(keys: np.ndarray, sides: np.ndarray | None, prints, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of a key-sorted run that share a key and lie within ``limit``.

    With ``sides`` only pairs of different sides count.
    """
    n = len(prints)
    planes = planes_of(prints)
    left, right = [], []
    longest = int(np.max(np.diff(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])))) if n else 0
    for d in range(1, longest):
        same = keys[d:] == keys[:-d]
        if sides is not None:
            same &= sides[d:] != sides[:-d]
        if not same.any():
            continue
        hit = _lanes(within(planes, _shifted(planes, d), _mask(same, planes.shape[1]), limit))
        left.append(hit)
        right.append(hit + d)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _compare(limit: int, chunk: int = 16384):
    """Arrow batches (key, side, id, print), sorted by key, to (a, b). A run is flushed at a key change past ``chunk`` rows."""

    def pairs(keys, sides, ids, prints):
        for two_sided in (False, True):
            at = np.flatnonzero((sides >= 0) == two_sided)
            if len(at) < 2:
                continue
            i, j = compare_run(keys[at], sides[at] if two_sided else None, prints[at], limit)
            a, b = ids[at][i], ids[at][j]
            fine = a != b
            lo, hi = np.minimum(a, b)[fine], np.maximum(a, b)[fine]
            if len(lo):
                both = np.unique(np.stack([lo, hi], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        n = 0

        def joined():
            return [np.concatenate([h[c] for h in held]) for c in range(4)]

        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            held.append([np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)), prints])
            n += batch.num_rows
            # Only where the last key isn't the first one is there a run to flush.
            if n > chunk and held[-1][0][-1] != held[0][0][0]:
                columns = joined()
                cut = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1
                yield from pairs(*[c[:cut] for c in columns])
                held, n = [[c[cut:] for c in columns]], n - cut
        if held:
            yield from pairs(*joined())

    return run


def candidate_links(prints: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of fingerprints (id, print, bands) that share a band and lie within the radius."""
    keyed = prints.select("id", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(sizes, "key").join(prints.select("id", "print"), "id")
    small = members.where(F.col("n") <= RUN).select("key", F.lit(-1).cast("tinyint").alias("side"), "id", "print")
    # A large bucket of n members: n/RUN sub-blocks, and a task for every pair of them.
    blocks = F.ceil(F.col("n") / F.lit(RUN)).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    large = (
        members.where(F.col("n") > RUN).withColumn("blocks", blocks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
            F.when(F.col("mine") == F.col("other"), F.lit(-1)).otherwise((F.col("mine") > F.col("other")).cast("int")).cast("tinyint").alias("side"),
            "id", "print"))
    runs = small.unionByName(large).repartition("key").sortWithinPartitions("key", "side", "id")
    return runs.mapInArrow(_compare(radius(similarity)), "a long, b long").distinct()


def exact_similarity(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) whose shingle sets (id, shingles) reach the similarity: shared shingles over all of either."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = links.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    score = shared / (F.size("sa") + F.size("sb") - shared)
    return both.select("a", "b", score.alias("similarity")).where(F.col("similarity") >= similarity)


class NearDuplicates:
    """The operator's results over one table.

    ``members``: (id, rep), every record with at least one shingle and the
    smallest id of the records with the same shingle set. ``links``: (a, b,
    similarity), a < b, between different representatives. Records with null,
    empty or blank text, or with fewer words than a shingle, have no shingle and
    are in neither. Rows with a repeated or null id are read as one record each
    and meet in their representative.
    """

    def __init__(self, df: DataFrame, id_column: str, text_columns: list[str], width: int = 5, similarity: float = 0.8) -> None:
        base = df.select(F.col(id_column).cast("long").alias("id"), *text_columns).where(F.col("id").isNotNull())
        text = joined_text(text_columns)
        sets = with_shingles(base, text, width).where(F.col("shingles").isNotNull())
        # The same set: the same hash of the sorted shingles, and as many of them.
        whole = sets.select("id", F.xxhash64("shingles").alias("whole"), F.size("shingles").alias("n"), "shingles")
        prints = settle(whole.mapInArrow(signatures, "id long, whole long, n int, print binary, bands array<long>"), "prints")
        firsts = settle(prints.groupBy("whole", "n").agg(F.min_by(F.struct("id", "print", "bands"), "id").alias("first")).select("whole", "n", "first.*"), "firsts")
        self.members = prints.select("id", "whole", "n").join(firsts.select("whole", "n", F.col("id").alias("rep")), ["whole", "n"]).select("id", "rep").distinct()
        near = settle(candidate_links(firsts, similarity), "near")
        touched = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        again = with_shingles(base.join(touched, "id", "left_semi"), text, width).where(F.col("shingles").isNotNull())
        own = firsts.select(F.col("id").alias("fid"), F.col("whole").alias("fwhole"))
        # A repeated id may hold several texts; the representative's is the one whose hash it carries.
        verified = again.join(own, (F.col("id") == F.col("fid")) & (F.xxhash64("shingles") == F.col("fwhole"))).select("id", "shingles").dropDuplicates(["id"])
        self.links = exact_similarity(near, verified, similarity)

    def pairs(self) -> DataFrame:
        """All pairs of records (id_a, id_b), id_a < id_b: within a set of copies, and across linked ones."""
        one, two = self.members.select(F.col("id").alias("x"), "rep"), self.members.select(F.col("id").alias("y"), "rep")
        copied = self.members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
        copies = one.join(copied, "rep", "left_semi").join(two.join(copied, "rep", "left_semi"), "rep").where("x < y").select("x", "y")
        crossed = (
            self.links.select("a", "b")
            .join(one.withColumnRenamed("rep", "a"), "a").join(two.withColumnRenamed("rep", "b"), "b").select("x", "y"))
        every = copies.unionByName(crossed)
        return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """One row per record: (id, group_id, n_links), its class by transitive links, and of how many records it is a near-duplicate.

        Copies count: each of m copies has m - 1 links to the others and one to
        every copy of what its representative is linked to, as in ``pairs``, but
        no pair is written out.
        """
        settled = settle(self.links.select("a", "b"), "links")
        classes = connected(settled)
        sizes = self.members.groupBy("rep").agg(F.count("*").alias("m"))
        both = settled.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(settled.select(F.col("b").alias("rep"), F.col("a").alias("other")))
        degree = both.join(sizes.select(F.col("rep").alias("other"), "m"), "other").groupBy("rep").agg(F.sum("m").alias("crossed"))
        known = sizes.join(classes.select(F.col("id").alias("rep"), "root"), "rep", "left").join(degree, "rep", "left")
        known = known.select("rep", F.coalesce("root", "rep").alias("group_id"), (F.col("m") - 1 + F.coalesce("crossed", F.lit(0))).alias("n_links"))
        return self.members.join(known, "rep").select("id", "group_id", "n_links")


def connected(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, root): the smallest id reachable over the links (a, b).

    Alternates large-star and small-star steps; each round is written to the
    shared folder, and only the number of changed rows comes to the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    before = None
    for step in range(most_rounds):
        # Large star: every neighbour that is larger points to the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour, and the node itself, points to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = settle(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(),
            f"star{step}")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if before is not None and tuple(now) == tuple(before):
            break
        before = now
    else:
        raise RuntimeError(f"links not resolved in {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).groupBy("id").agg(F.min("root").alias("root"))
