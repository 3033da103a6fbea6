"""Ranking quality: recall, reciprocal rank, discounted gain, overlap, aggregates over queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def query_metrics(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, rr, ndcg) at ``k`` from (query_id, doc_id, rank) and (query_id, doc_id, grade).

    Every judged query has a row. Recall is 0 without a relevant document, nDCG
    is 0 where the ideal is.
    """
    judged = qrels.join(ranked.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    ideal_place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    judged = judged.withColumn("ideal", ideal_place)
    relevant, seen = F.col("grade") > 0, F.col("rank") <= k
    out = judged.groupBy("query_id").agg(
        F.count_if(relevant).alias("n_relevant"), F.count_if(relevant & seen).alias("n_found"), F.min(F.when(relevant, F.col("rank"))).alias("first"),
        F.sum(F.when(seen, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, gain(F.col("grade"), F.col("ideal"))).otherwise(0.0)).alias("best"))
    return out.select(
        "query_id", F.when(F.col("n_relevant") > 0, F.col("n_found") / F.col("n_relevant")).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))


def summary(metrics: DataFrame) -> DataFrame:
    """Means over all queries."""
    return metrics.agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"))


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and 95th percentile with linear interpolation, 0 for an empty group."""
    agg = [F.coalesce(F.percentile(value, p), F.lit(0.0)).alias(f"p{int(p * 100)}") for p in (0.5, 0.95)]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def overlap(left: DataFrame, right: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, n_shared): documents that both rankings have among their first ``k``."""
    a = left.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    b = right.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    queries = left.select("query_id").union(right.select("query_id")).distinct()
    shared = a.join(b, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("n_shared"))
    return queries.join(shared, "query_id", "left").na.fill(0, ["n_shared"])


def judgment_places(qrels: DataFrame, pool: DataFrame, final: DataFrame) -> DataFrame:
    """Of every judged document its grade, place in the pool and in the final ranking."""
    p = pool.select("query_id", "doc_id", F.col("rank").alias("pool_rank"))
    f = final.select("query_id", "doc_id", F.col("rank").alias("final_rank"))
    return qrels.join(p, ["query_id", "doc_id"], "left").join(f, ["query_id", "doc_id"], "left")


def total_latency(exact: Column, local: Column, native: Column, rerank: Column) -> Column:
    """Sources run one after the other for an exact key, else at the same time."""
    return F.when(exact, local + native).otherwise(F.greatest(local, native)) + rerank


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of tokens, given per million."""
    for p in (price_in, price_out):
        if not 0 <= p < float("inf"):
            raise ValueError("prices must be finite and not negative")
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


#: Depths of the case report.
POOL_DEPTH, FINAL_DEPTH, MERGED_DEPTH = 40, 10, 200


def case_reports(cases: DataFrame, pool: DataFrame, final: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row per case with everything the aggregate needs.

    ``cases``: (query_id, exact, local_ms, native_ms, reranker_ms, attempted,
    applied, degraded, tokens_in, tokens_out, n_local, n_native, native_count,
    expected_count). ``pool`` and ``final``: (query_id, doc_id, rank, source).
    Cases without a relevant judgment have metrics of 0 and are not ``judged``.
    """
    at_pool = query_metrics(pool, qrels, POOL_DEPTH).select("query_id", F.col("recall").alias("recall_at_40"))
    merged = query_metrics(pool, qrels, MERGED_DEPTH).select("query_id", F.col("recall").alias("merged_recall"))
    at_final = query_metrics(final.where(F.col("rank") <= FINAL_DEPTH), qrels, FINAL_DEPTH).select("query_id", F.col("ndcg").alias("ndcg_at_10"), F.col("rr").alias("mrr"))
    judged = qrels.groupBy("query_id").agg((F.max("grade") > 0).alias("judged"))
    sizes = pool.groupBy("query_id").agg(F.count("*").alias("n_merged"))
    recovered = final.where(F.col("rank") <= FINAL_DEPTH).groupBy("query_id").agg(F.count_if(F.col("source") == "ncbi").alias("ncbi_only"))
    out = cases
    for part in (at_pool, merged, at_final, judged, sizes, recovered):
        out = out.join(part, "query_id", "left")
    out = out.na.fill(0, ["recall_at_40", "merged_recall", "ndcg_at_10", "mrr", "n_merged", "ncbi_only"]).na.fill(False, ["judged"])
    return out.withColumns({
        "total_ms": total_latency(F.col("exact"), F.col("local_ms"), F.col("native_ms"), F.col("reranker_ms")),
        "count_differs": F.coalesce(F.col("native_count") != F.col("expected_count"), F.lit(False))})


def aggregate(reports: DataFrame, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """One row over all cases: means over the judged ones, sums and rates over all, percentiles of latency, pool sizes, tokens and cost."""
    good = F.col("judged")
    means = {f"mean_{c}": F.coalesce(F.avg(F.when(good, F.col(c))), F.lit(0.0)) for c in ("recall_at_40", "merged_recall", "ndcg_at_10", "mrr")}
    sums = {"ncbi_only_recovery": F.sum("ncbi_only"), "count_mismatches": F.count_if("count_differs"), "attempted": F.count_if("attempted"), "applied": F.count_if("applied"),
            "tokens_in": F.sum("tokens_in"), "tokens_out": F.sum("tokens_out")}
    rates = {"degradation_rate": F.avg(F.col("degraded").cast("double")), "fallback_rate": F.avg((F.col("attempted") & ~F.col("applied")).cast("double"))}
    spread_ = {f"latency_p{int(p * 100)}": F.coalesce(F.percentile("total_ms", p), F.lit(0.0)) for p in (0.5, 0.95)}
    pools = {f"{c}_{f}": agg(c) for c in ("n_local", "n_native", "n_merged") for f, agg in (("mean", F.avg), ("max", F.max))}
    every = {"n_cases": F.count("*"), "n_judged": F.count_if(good), **means, **sums, **rates, **spread_, **pools}
    out = reports.agg(*[c.alias(n) for n, c in every.items()])
    return out.withColumn("cost", cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out))


def side_by_side(runs: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """(query_id, mode, rank, one column a model): the first ``k`` documents of runs (query_id, mode, rank, doc_id) next to each other."""
    tall = None
    for name, run in runs.items():
        one = run.where(F.col("rank") <= k).select("query_id", "mode", "rank", F.lit(name).alias("model"), "doc_id")
        tall = one if tall is None else tall.unionByName(one)
    return tall.groupBy("query_id", "mode", "rank").agg(*[F.max(F.when(F.col("model") == n, F.col("doc_id"))).alias(n) for n in runs])


def overlaps(runs: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """(query_id, left, right, n_shared) of every two models' first ``k``."""
    names, out = list(runs), None
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            one = overlap(runs[a], runs[b], k).select("query_id", F.lit(a).alias("left"), F.lit(b).alias("right"), "n_shared")
            out = one if out is None else out.unionByName(one)
    return out
