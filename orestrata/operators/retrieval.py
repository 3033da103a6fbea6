"""Ranked retrieval: BM25 by scan or from a stored index, exact dense search, reciprocal-rank fusion, candidate pools.

A retrieval is a scoring plan (id, score) over all rows and a top-k behind it.
Filters never change a score, so one scoring serves a page of hits and the
candidate pools of every facet field at once: rows carry which conditions they
meet, and each condition keeps its own best rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from orestrata.functions.text import SPACE, any_of, tokens
from orestrata.functions.vectors import checked_vector, cosine_scores
from orestrata.operators.filters import FACETS, Filters
from orestrata.session import spread

K1, B = 1.2, 0.75
#: Digits of a score that count, so that the order of additions never decides a rank.
SCORE_DIGITS = 9
#: Fields and boosts of the multi-field query.
BOOSTS = {"title": 3.0, "summary": 2.0, "overall_design": 1.0, "search_text": 1.0}


@dataclass(frozen=True)
class Settings:
    """Depths of a search. The defaults."""

    topk: int = 15
    deep: int = 200
    k0: int = 60
    facet_pool: int = 1000
    bucket_limit: int = 50

    def checked(self) -> "Settings":
        if self.topk < 1 or self.deep < self.topk or self.k0 < 1 or self.facet_pool < 1 or self.bucket_limit < 1:
            raise ValueError("topk, deep, k0, facet_pool or bucket_limit out of bounds")
        return self


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(r"[^\w]+|_", query.lower()) if t))


# --- scoring by scan --------------------------------------------------------------------------------------------------

def _spaced(text: Column) -> Column:
    """Lower-cased words of letters and digits, each between two blanks of its own, so that words are counted by plain search."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def _frequency(spaced: Column, term: str) -> Column:
    """How often a word stands in spaced text."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(f" {term} "), F.lit("")))) / (len(term) + 2)).cast("int")


def _length(spaced: Column) -> Column:
    """Words of a spaced text: gaps of two blanks, less those at an end that no word follows or precedes."""
    inner = F.trim(spaced)
    return F.when(inner == "", 0).otherwise(((F.length(inner) - F.length(F.replace(inner, F.lit("  "), F.lit("")))) / 2).cast("int") + 1)


def _idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _saturated(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(avgdl))))


def corpus_stats(df: DataFrame, texts: dict[str, Column], query: str) -> dict[str, dict]:
    """Of each text: rows with a word, their mean length, and of each term of the query how many rows hold it. One aggregate over one scan."""
    terms = query_terms(query)
    spaced = df.select(*[_spaced(t).alias(f"t{i}") for i, t in enumerate(texts.values())])
    low = spaced.select(*[x for i in range(len(texts)) for x in (_length(F.col(f"t{i}")).alias(f"l{i}"), *[F.contains(f"t{i}", F.lit(f" {t} ")).alias(f"d{i}_{j}") for j, t in enumerate(terms)])])
    sums = []
    for i in range(len(texts)):
        sums += [F.count_if(F.col(f"l{i}") > 0).alias(f"n{i}"), F.sum(f"l{i}").alias(f"l{i}"), *[F.count_if(f"d{i}_{j}").alias(f"d{i}_{j}") for j in range(len(terms))]]
    row = low.agg(*sums).first()
    return {name: {"n": row[f"n{i}"], "avgdl": (row[f"l{i}"] or 0) / max(1, row[f"n{i}"]) or 1.0, "df": {t: row[f"d{i}_{j}"] for j, t in enumerate(terms)}} for i, name in enumerate(texts)}


def scan_scores(df: DataFrame, texts: dict[str, Column], query: str, keep: list[str], boosts: dict[str, float] | None = None, stats: dict | None = None) -> DataFrame:
    """The columns ``keep`` and ``score`` of the rows that hold a term of the query: the largest boosted BM25 of any text.

    One scan for the statistics and one for all scores. A blank query scores every row 1.
    """
    terms, boosts = query_terms(query), boosts or {}
    if not terms:
        return df.select(*keep, F.lit(1.0).alias("score"))
    stats = stats or corpus_stats(df, texts, query)
    names = list(texts)
    near = df.where(any_of([F.contains(F.lower(t), F.lit(w)) for t in texts.values() for w in terms]))
    low = near.select(*keep, *[_spaced(t).alias(f"__t{i}") for i, t in enumerate(texts.values())])
    counted = low.select(*keep, *[x for i in range(len(names)) for x in (
        _length(F.col(f"__t{i}")).alias(f"__dl{i}"), *[_frequency(F.col(f"__t{i}"), t).alias(f"__tf{i}_{j}") for j, t in enumerate(terms)])])
    scores = []
    for i, name in enumerate(names):
        s, score = stats[name], F.lit(0.0)
        for j, t in enumerate(terms):
            score = score + F.lit(_idf(s["n"], s["df"][t])) * _saturated(F.col(f"__tf{i}_{j}").cast("double"), F.col(f"__dl{i}"), s["avgdl"])
        hit = any_of([F.col(f"__tf{i}_{j}") > 0 for j in range(len(terms))])
        scores.append(F.when(hit, F.round(score, SCORE_DIGITS) * F.lit(boosts.get(name, 1.0))))
    best_ = F.greatest(*scores) if len(scores) > 1 else scores[0]
    # A generator drops the rows without a hit where a filter would be pushed down and count all words twice.
    return counted.select(*keep, F.explode(F.when(best_.isNotNull(), F.array(best_))).alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (id, score), ties by id."""
    return scored.select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def bm25(df: DataFrame, text: Column, query: str, k: int, filters: Filters = Filters(), stats: dict | None = None) -> DataFrame:
    """The ``k`` best rows (id, score) over one text. Conditions restrict what is ranked, never the statistics."""
    narrow = spread(df.select("id", text.alias("__text"), *filters.wanted))
    return best(filters.apply(scan_scores(narrow, {"text": F.col("__text")}, query, ["id", *filters.wanted], stats=stats)), k)


def bm25_fields(df: DataFrame, query: str, k: int, filters: Filters = Filters(), boosts: dict[str, float] | None = None) -> DataFrame:
    """The ``k`` best rows by the largest boosted score of any field, fields scored in one scan."""
    boosts = boosts or BOOSTS
    narrow = df.select("id", *boosts, *filters.wanted)
    narrow = spread(narrow) if query_terms(query) else narrow
    return best(filters.apply(scan_scores(narrow, {f: F.col(f) for f in boosts}, query, ["id", *filters.wanted], boosts)), k)


# --- scoring from a stored index --------------------------------------------------------------------------------------

class TextIndex:
    """An inverted index in a folder: postings (field, bucket, term, id, tf, dl), document frequencies and field statistics.

    Postings lie in folders by field and bucket of the term, sorted by term and
    id, so a query reads the row groups of its own terms only. Hot terms are cut
    across files by id. An existing folder is refused when building.
    """

    def __init__(self, spark, path: str) -> None:
        self.path = path
        self.postings = spark.read.parquet(f"{path}/postings")
        self.terms = spark.read.parquet(f"{path}/terms")
        rows = spark.read.parquet(f"{path}/stats").collect()  # one row a field
        self.stats = {r.field: {"n": r.n, "avgdl": r.avgdl} for r in rows}
        self.buckets = rows[0].buckets if rows else 1
        self._known: dict[tuple[str, str], int] = {}

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(buckets)).cast("int")

    @classmethod
    def build(cls, df: DataFrame, texts: dict[str, Column], path: str, buckets: int = 16, files: int | None = None) -> "TextIndex":
        """Writes the index of ``texts`` over (id, ...) and opens it. Texts without a word have no posting."""
        spark = df.sparkSession
        parts = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), tokens(t).alias("words")) for n, t in texts.items()]))
        words = spread(df.select("id", *{c for c in df.columns if c != "id"})).select("id", parts.alias("p")).select("id", "p.field", "p.words").where(F.size("words") > 0)
        rows = words.select("field", "id", F.size("words").alias("dl"), F.explode("words").alias("term"))
        counted = rows.groupBy("field", "term", "id").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))
        placed = counted.withColumn("bucket", cls._bucket(F.col("term"), buckets))
        order = ["field", "bucket", "term", "id"]
        ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
        ranged.sortWithinPartitions(*order).write.partitionBy("field", "bucket").mode("errorifexists").parquet(f"{path}/postings")
        back = spark.read.parquet(f"{path}/postings")
        back.groupBy("field", "bucket", "term").agg(F.count("*").alias("df")).repartitionByRange(*order[:3]).sortWithinPartitions(*order[:3]).write.partitionBy("field").parquet(f"{path}/terms")
        lengths = words.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))
        lengths.withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/stats")
        return cls(spark, path)

    def _of(self, table: DataFrame, fields: list[str], terms: list[str]) -> DataFrame:
        from zlib import crc32

        buckets = sorted({crc32(t.encode()) % self.buckets for t in terms})
        return table.where(F.col("field").isin(fields) & F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def _frequencies(self, fields: list[str], terms: list[str]) -> dict[tuple[str, str], int]:
        """Document frequencies of a query's terms; an index never changes, so what was read once stays known."""
        wanted = {(f, t) for f in fields for t in terms}
        if wanted - self._known.keys():
            if len(self._known) > 100_000:
                self._known.clear()
            self._known.update(dict.fromkeys(wanted, 0))
            self._known.update({(r.field, r.term): r.df for r in self._of(self.terms, fields, terms).select("field", "term", "df").collect()})
        return {k: self._known[k] for k in wanted if self._known[k]}

    def scores(self, query: str, boosts: dict[str, float]) -> DataFrame:
        """(id, score) of every document that holds a term of the query: the largest boosted score of any field."""
        terms, fields = query_terms(query), list(boosts)
        known = self._frequencies(fields, terms)
        pairs = [x for (f, t), n in known.items() for x in (F.lit(f"{f} {t}"), F.lit(_idf(self.stats[f]["n"], n)))] or [F.lit(""), F.lit(0.0)]
        hits = self._of(self.postings, fields, terms)
        idf = F.create_map(*pairs)[F.concat_ws(" ", F.col("field").cast("string"), "term")]
        parts = []
        for f in fields:
            part = idf * _saturated(F.col("tf").cast("double"), F.col("dl"), self.stats.get(f, {}).get("avgdl") or 1.0)
            parts.append(F.sum(F.when(F.col("field") == f, part)).alias(f"s_{f}"))
        summed = hits.groupBy("id").agg(*parts)
        scores = [F.round(F.col(f"s_{f}"), SCORE_DIGITS) * F.lit(boosts[f]) for f in fields]
        return summed.select("id", (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("score"))


# --- dense search and fusion ------------------------------------------------------------------------------------------

def dense_scores(df: DataFrame, vector: str, query: list[float], keep: list[str]) -> DataFrame:
    """``keep`` and ``score``, the rounded cosine, of every row with a usable vector."""
    return cosine_scores(df, vector, query, keep).withColumn("score", F.round("score", SCORE_DIGITS))


def dense(df: DataFrame, vector: str, query: list[float], k: int, filters: Filters = Filters()) -> DataFrame:
    """The ``k`` rows (id, score) of the largest cosine, conditions applied before; unusable vectors are left out."""
    fit = filters.apply(df.select("id", vector, *filters.wanted))
    return best(dense_scores(fit, vector, query, ["id"]), k)


def _ranked(hits: DataFrame, source: str, tie: str, depth: int, by: list[str]) -> DataFrame:
    order = [F.desc("score")] if tie == "rank" else [F.desc("score"), F.col("id")]
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    place = (F.rank() if tie == "rank" else F.row_number()).over(window)
    return hits.withColumn("rk", place).where(F.col("rk") <= depth).select(*by, "id", F.lit(source).alias("src"), "rk")


def _fused(sparse: DataFrame, thick: DataFrame, k0: int, tie: str, depth: int, by: list[str]) -> DataFrame:
    both = _ranked(sparse, "bm25", tie, depth, by).unionByName(_ranked(thick, "dense", tie, depth, by))
    return both.groupBy(*by, "id").agg(
        F.sum(F.lit(1.0) / (k0 + F.col("rk"))).alias("score"),
        F.max(F.when(F.col("src") == "bm25", F.col("rk"))).alias("bm25_rank"),
        F.max(F.when(F.col("src") == "dense", F.col("rk"))).alias("dense_rank"))


def fuse(sparse: DataFrame, thick: DataFrame, k: int, k0: int = 60, tie: str = "row_number", depth: int = 200) -> DataFrame:
    """Reciprocal-rank fusion of two hit lists (id, score): (id, score, bm25_rank, dense_rank), ties by id.

    With ``tie="rank"`` equal scores share a rank, else the id decides. Both
    lists are at most ``depth`` long, so the unpartitioned windows are small.
    """
    return _fused(sparse, thick, k0, tie, depth, []).orderBy(F.desc("score"), "id").limit(k)


def hydrate(hits: DataFrame, df: DataFrame, columns: list[str], key: str = "id", page: int | None = None) -> DataFrame:
    """The hits with columns of their rows. A hit without a row or with two is an error when the result is read.

    ``page`` states how many hits there can be: so many are read first, and
    their keys go into the scan of the rows, which prunes by them. Without it the
    tables are joined as any two.
    """
    if page is not None:
        few = hits.limit(page).toArrow()
        hits = df.sparkSession.createDataFrame(few, hits.schema) if few.num_rows else df.sparkSession.createDataFrame([], hits.schema)
        rows = df.where(F.col(key).isin(list(dict.fromkeys(few.column(key).to_pylist()))))
    else:
        rows = df.join(hits.select(key).distinct(), key, "left_semi")
    rows = rows.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*columns)).alias("__row"))
    joined = hits.join(rows, key, "left")
    wrong = F.raise_error(F.concat(F.lit("documents changed while they were read: "), F.col(key).cast("string"))).cast("boolean")
    return joined.where(F.when(F.coalesce("__n", F.lit(0)) == 1, True).otherwise(wrong)).select(*hits.columns, *[F.col(f"__row.{c}").alias(c) for c in columns])


# --- the searcher -----------------------------------------------------------------------------------------------------

class Searcher:
    """Retrieval over one table of documents: by an index where one is given, else by scan.

    ``boosts`` names the text fields that are scored; ``vector`` the column of
    embeddings. Facet fields are read from the table.
    """

    def __init__(self, df: DataFrame, boosts: dict[str, float] | None = None, vector: str = "embedding", index: TextIndex | None = None) -> None:
        self.df, self.boosts, self.vector, self.index = df, boosts or BOOSTS, vector, index

    def _checked(self, query: str, mode: str, vector_query, settings: Settings) -> list[float] | None:
        settings.checked()
        if mode not in ("bm25", "dense", "hybrid"):
            raise ValueError(f"no mode {mode!r}")
        if mode != "bm25" and (not query.strip() or vector_query is None):
            raise ValueError("dense and hybrid need a query and its vector")
        return None if mode == "bm25" else checked_vector(vector_query)

    def _sparse(self, query: str, keep: list[str]) -> DataFrame:
        """(id, keep, score) of all rows with a term; of all rows where the query is blank."""
        if self.index is None or not query_terms(query):
            texts = list(self.boosts) if query_terms(query) else []
            narrow = self.df.select("id", *dict.fromkeys([*texts, *keep]))
            return scan_scores(spread(narrow) if texts else narrow, {f: F.col(f) for f in texts}, query, ["id", *keep], self.boosts)
        scored = self.index.scores(query, self.boosts)
        return scored.join(self.df.select("id", *keep), "id") if keep else scored

    def hits(self, query: str, mode: str = "hybrid", vector_query=None, filters: Filters = Filters(), settings: Settings = Settings(), tie: str = "row_number") -> DataFrame:
        """(id, score) of the best ``topk``; in the mode ``hybrid`` also both ranks."""
        q = self._checked(query, mode, vector_query, settings)
        keep = list(filters.wanted)
        if mode == "bm25":
            return best(filters.apply(self._sparse(query, keep)), settings.topk)
        if mode == "dense":
            return dense(self.df, self.vector, q, settings.topk, filters)
        sparse = best(filters.apply(self._sparse(query, keep)), settings.deep)
        return fuse(sparse, dense(self.df, self.vector, q, settings.deep, filters), settings.topk, settings.k0, tie, settings.deep)

    def pools(self, query: str, mode: str = "bm25", vector_query=None, filters: Filters = Filters(), settings: Settings = Settings(), fields=FACETS) -> DataFrame:
        """(field, id, values): per facet field the ``facet_pool`` best rows without the field's own condition, with its values.

        Fields whose conditions agree share a pool. Every row is scored once; it
        goes to each pool whose conditions it meets, and a pool's best are kept
        before they are shuffled.
        """
        q = self._checked(query, mode, vector_query, settings)
        pools: dict[tuple, list[str]] = {}
        for f in fields:
            pools.setdefault(tuple(sorted(filters.without(f).wanted.items())), []).append(f)
        own = list(pools.values())
        meets = F.array_compact(F.array(*[F.when(Filters(dict(c)).condition(), F.lit(i)) for i, c in enumerate(pools)]))
        facets = list(dict.fromkeys([*fields, *filters.wanted]))
        deep = max(settings.deep, settings.facet_pool)

        def dealt(scored: DataFrame) -> DataFrame:
            return scored.select("id", "score", F.explode(meets).alias("pool"), *fields)

        def top(scored: DataFrame, depth: int) -> DataFrame:
            place = F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("score"), "id"))
            return scored.withColumn("__rk", place).where(F.col("__rk") <= depth).drop("__rk")

        if mode == "bm25":
            pool = top(dealt(self._sparse(query, facets)), settings.facet_pool)
        elif mode == "dense":
            pool = top(dealt(dense_scores(self.df, self.vector, q, ["id", *facets])), settings.facet_pool)
        else:
            sparse, thick = top(dealt(self._sparse(query, facets)), deep), top(dealt(dense_scores(self.df, self.vector, q, ["id", *facets])), deep)
            ranked = [h.withColumn("rk", F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("score"), "id"))) for h in (sparse, thick)]
            both = ranked[0].unionByName(ranked[1])
            fused = both.groupBy("pool", "id").agg(F.sum(F.lit(1.0) / (settings.k0 + F.col("rk"))).alias("score"), *[F.first(f).alias(f) for f in fields])
            pool = top(fused, settings.facet_pool)
        values = F.array(*[F.struct(F.lit(i).alias("pool"), F.lit(f).alias("field"), F.col(f).alias("values")) for i, group in enumerate(own) for f in group])
        return pool.select("id", F.explode(F.filter(values, lambda v: v["pool"] == F.col("pool"))).alias("v")).select("v.field", "id", "v.values")


def grep(df: DataFrame, key: str, text: str, needle: str, keys: int = 10, per_key: int = 2) -> DataFrame:
    """(key, line_no, line): case-insensitive literal matches, the first lines of each of the first keys in key order."""
    lines = df.where(F.contains(F.lower(text), F.lit(needle.lower()))).select(F.col(key).alias("key"), F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    hits = lines.where(F.contains(F.lower("line"), F.lit(needle.lower())))
    first = hits.select("key").distinct().orderBy("key").limit(keys)
    order = Window.partitionBy("key").orderBy("line_no")
    return hits.join(F.broadcast(first), "key").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_key).drop("rn")


def normalized_query(query: str, longest: int = 1000) -> str:
    """A query stripped and with single spaces; an error if blank or too long."""
    tidy = re.sub(SPACE.removeprefix("(?U)"), " ", query).strip()
    if not tidy or len(tidy) > longest:
        raise ValueError("query is blank or too long")
    return tidy
