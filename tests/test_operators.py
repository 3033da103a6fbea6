"""Rollups, incremental steps, evaluation, text functions and normalizers."""

import math

import pytest
from pyspark.sql import functions as F

from orestrata.functions import normalize as N
from orestrata.functions import text as X
from orestrata.operators import evaluate as E
from orestrata.operators import incremental as I
from orestrata.operators import rollup as RU


def test_rollup_keeps_childless_parents(spark):
    parents = spark.createDataFrame([("a",), ("b",)], "k string")
    children = spark.createDataFrame([("a", "y", 1), ("a", "x", 1), ("a", "y", 1), ("a", " ", 1), ("a", None, 1)], "k string, v string, n int")
    got = {r.k: r for r in RU.with_rollup(parents, children, "k", ["v"]).collect()}
    assert got["a"].v == ["x", "y"] and got["a"].n_children == 5 and got["b"].v == [] and got["b"].n_children == 0


def test_accessions_by_number(spark):
    df = spark.createDataFrame([("s", "GSM11"), ("s", "GSM2"), ("s", "bad"), ("s", None)], "k string, a string")
    assert RU.accessions_sorted(df, "k", "a").first().accessions == ["GSM2", "GSM11"]


def test_numbered_and_shards(spark):
    df = spark.createDataFrame([(i, 10 if i != 7 else 100) for i in range(50)], "i int, b int")
    assert [r.i for r in RU.numbered(df, ["i"]).orderBy("row_no").collect()] == list(range(50))
    rows = RU.shards(df, ["i"], "b", 5, 60).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.b)
    assert all(len(v) <= 5 and (sum(v) <= 60 or len(v) == 1) for v in sizes.values()) and len(rows) == 50
    assert RU.shards(df.limit(0), ["i"], "b", 5, 60).count() == 0


def test_set_audit(spark):
    a = spark.createDataFrame([("k", "x"), ("k", "y")], "k string, i string")
    b = spark.createDataFrame([("k", "x"), ("k", "z")], "k string, i string")
    r = RU.set_audit(a, b, "k", "i").first()
    assert (r.n_missing, r.n_undeclared) == (1, 1)


def test_overlay_and_upsert(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    base = spark.createDataFrame([("a", 1), ("b", 1), ("gone", 1)], "k string, v int")
    delta = spark.createDataFrame([("b", 2)], "k string, v int")
    assert {(r.k, r.v, r.origin) for r in I.overlay(t, base, delta, "k", "v").collect()} == {("a", 1, "base"), ("b", 2, "delta"), ("c", None, "none")}
    once = I.upsert(base, delta, "k")
    assert sorted(I.upsert(once, delta, "k").collect()) == sorted(once.collect())
    assert {r.k for r in I.delta_keys(t, base, delta, "k").collect()} == {"b", "c"}


def test_metrics_exact(spark):
    qrels = spark.createDataFrame([("q", "GSE1", 3), ("q", "GSE2", 2), ("q", "GSE3", 1), ("none", "x", 0)], "query_id string, doc_id string, grade int")
    ranked = spark.createDataFrame([("q", "other", 1), ("q", "GSE1", 2), ("q", "GSE2", 3)], "query_id string, doc_id string, rank int")
    m = {r.query_id: r for r in E.query_metrics(ranked, qrels, 3).collect()}
    assert m["q"].recall == pytest.approx(2 / 3) and m["q"].rr == 0.5
    best = 7 + 3 / math.log2(3) + 1 / 2
    assert m["q"].ndcg == pytest.approx((7 / math.log2(3) + 3 / 2) / best)
    assert (m["none"].recall, m["none"].rr, m["none"].ndcg) == (0, 0, 0)
    assert E.percentiles(ranked.limit(0), [], "rank").first().p50 == 0.0


def test_cost_checks_prices():
    with pytest.raises(ValueError):
        E.cost(F.lit(1), F.lit(1), float("inf"), 1.0)


@pytest.mark.parametrize(("raw", "reason"), [
    ("female", "exact"), ("Male.", "exact"), ("famale", "fuzzy"), ("both", "mixed"), ("0", "numeric_code"), ("68M", "leaked_age"), ("C57BL/6", "leaked_strain"),
    ("hermaphrodite", "exact"), ("n/a", "unknown"), ("adult", "leaked_stage"), ("xyz", "unrecognized"), ("", "unknown")])
def test_sex_reasons(spark, raw, reason):
    assert spark.createDataFrame([(raw,)], "v string").select(N.reason_of_token(N.token(F.col("v")))).first()[0] == reason


@pytest.mark.parametrize(("values", "ids", "status"), [
    ([], [], "absent"), (None, [], "absent"), (["unknown"], [], "unknown"), (["zz"], [], "unmapped"), (["zz", "Liver (left)", "LIVER"], ["UBERON:0002107"], "mapped")])
def test_curated(spark, values, ids, status):
    a, b = N.map_curated(F.col("v"), N.TISSUES)
    assert tuple(spark.createDataFrame([(values,)], "v array<string>").select(a, b).first()) == (ids, status)


@pytest.mark.parametrize(("raw", "age"), [("56", "56"), ("8 weeks", "8 week"), ("P21", None), ("adult", None), ("3.5 yrs", "3.5 year"), ("4 moons", None)])
def test_age(spark, raw, age):
    assert spark.createDataFrame([(raw,)], "v string").select(N.age_of(F.col("v"))).first()[0] == age


def test_organisms_in_order(spark):
    a, b = N.map_organisms(F.col("v"))
    df = spark.createDataFrame([("Mus musculus; Homo sapiens, Mus musculus",), (" ",), ("Nobody",), (None,)], "v string")
    assert [tuple(r) for r in df.select(a, b).collect()] == [(["NCBITaxon:10090", "NCBITaxon:9606"], "mapped"), ([], "absent"), ([], "unmapped"), ([], "absent")]


def test_text_functions(spark):
    df = spark.createDataFrame([("A.b, C d,, A.b", "x" * 300 + " Needle " + "y" * 300)], "a string, b string")
    r = df.select(
        X.list_blob(F.col("a")).alias("blob"), X.snippet(F.col("b"), "needle").alias("snip"), X.capitalized(F.lit("hOMO sapiens")).alias("cap"),
        X.storage_bucket(F.lit("GSE1234")).alias("b1"), X.storage_bucket(F.lit("GSE12")).alias("b2"), X.accession_number(F.lit("GSE007")).alias("n"),
        X.redacted(F.lit("Authorization: Bearer abc.def password=\"z zz\" api-key=yyy")).alias("red")).first()
    assert r.blob == "A.b | C d" and "Needle" in r.snip and r.snip[0] == r.snip[-1] == "…" and r.cap == "Homo sapiens"
    assert (r.b1, r.b2, r.n) == ("GSE1nnn", "GSEnnn", 7) and not any(x in r.red for x in ("abc", "zz", "yyy"))


def test_caps(spark):
    df = spark.createDataFrame([(["a" * 300, "b"],), (["x"] * 101,), (["ok"],), (None,)], "v array<string>")
    value, cut = X.cap_array(F.col("v"))
    assert [r[0] for r in df.select(cut).collect()] == [True, True, False, False]
    assert max(len(s) for s in df.select(value).first()[0]) == 256
