"""Vector tables, publishing, crawling, fetching, counts and shards on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from orestrata.operators import embed as EM
from orestrata.operators import incremental as I
from orestrata.operators import rollup as RU
from orestrata.operators.frequent import most_frequent
from orestrata.sources import crawl as C
from orestrata.sources import files as FS

MODEL = EM.Variant("toy", 3, "{title}: {embed_text}", "find {query}", 4)


def records(spark, rows):
    return spark.createDataFrame(rows, "gse string, title string, embed_text string")


def test_incremental_build(spark):
    def factory():
        return lambda texts: [[len(t), 1.0, t.count("a")] for t in texts]

    old = records(spark, [("GSE1", "a", "x"), ("GSE2", "b", "y"), ("GSE3", None, None)])
    base, report = EM.build_vectors(old, None, MODEL, factory)
    assert report["encoded"] == 3 and all(abs(np.linalg.norm(r.vector) - 1) < 1e-6 for r in base.collect())
    same, report = EM.build_vectors(old, base, MODEL, factory)
    assert report["skipped"] and same is base
    new = records(spark, [("GSE1", "a", "changed a lot"), ("GSE2", "b", "y"), ("GSE9", "n", "n")])
    out, report = EM.build_vectors(new, base, MODEL, factory, replace=new.where("gse = 'GSE1'").select("gse"))
    assert report == {"encoded": 2, "kept": 1, "deleted": 1, "skipped": False}
    before, after = ({r.gse: r.vector for r in d.collect()} for d in (base, out))
    assert set(after) == {"GSE1", "GSE2", "GSE9"} and after["GSE2"] == before["GSE2"] and after["GSE1"] != before["GSE1"]
    assert [r.gse for r in EM.in_order(records(spark, [("GSE10", "", ""), ("GSE2", "", "")]).select("gse")).orderBy("row").collect()] == ["GSE2", "GSE10"]


def test_encoding_is_checked(spark):
    assert np.allclose(EM.encode_query(MODEL, " q ", lambda t: [[3.0, 0.0, 4.0]]), [0.6, 0.0, 0.8])
    for query, answer in ((" ", [[1.0, 0, 0]]), ("q", [[1.0]]), ("q", [[0.0, 0, 0]]), ("q", [[float("nan"), 0, 1]])):
        with pytest.raises(ValueError):
            EM.encode_query(MODEL, query, lambda t, answer=answer: answer)
    r = records(spark, [("GSE1", "one two", "three four five"), ("GSE2", "x", "y")])
    assert tuple(EM.truncations(r, MODEL).first()) == ("toy", 2, 1)
    with pytest.raises(ValueError):
        EM.variant("nope")


def test_publish_and_recover(spark, tmp_path):
    final, staged = tmp_path / "final", tmp_path / "staged"
    for at, text in ((final, "old"), (staged, "new")):
        at.mkdir()
        (at / "x").write_text(text)
    EM.publish(spark, f"file://{staged}", f"file://{final}")
    assert (final / "x").read_text() == "new" and not staged.exists()
    backup = tmp_path / "final.backup"
    backup.mkdir()
    (backup / "x").write_text("older")
    with pytest.raises(FileExistsError):
        EM.publish(spark, f"file://{staged}", f"file://{final}")
    assert EM.recover(spark, f"file://{final}", lambda p: False) == "restored" and (final / "x").read_text() == "older"
    assert EM.recover(spark, f"file://{final}", lambda p: True) == "done"


def test_delta_and_digest(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "gse string")
    got = {r.problem: r.n for r in I.delta_problems(keys("a", "a", "z"), keys("a", "b", "c"), keys("c"), "gse").collect()}
    assert got == {"repeated": 1, "outside": 1, "omitted": 1}
    one = I.key_digest(keys("a", "bc"), "gse", ["gse"])
    assert one == I.key_digest(keys("bc", "a"), "gse", ["gse"]) != I.key_digest(keys("ab", "c"), "gse", ["gse"])
    with pytest.raises(Exception, match="missing: b"):
        I.required(keys("a"), keys("a", "b"), "gse").collect()
    docs = I.index_documents(keys("a", "b"), {"m": spark.createDataFrame([("a", [1.0])], "gse string, vector array<float>")})
    assert {r.gse: r.m for r in docs.collect()} == {"a": [1.0], "b": None}


def test_latest_is_a_total_order(spark):
    rows = [("k", 1, "x"), ("k", 3, None), ("k", 3, "b"), ("m", None, "y")]
    got = I.latest(spark.createDataFrame(rows, "k string, at int, v string"), "k", [F.col("at"), F.col("v")])
    assert {(r.k, r.at, r.v) for r in got.collect()} == {("k", 3, "b"), ("m", None, "y")}


class Service:
    def __init__(self, keys):
        self.keys, self.asked = keys, []

    def count(self, term):
        return len(self.keys)

    def page(self, term, start, size):
        self.asked.append(start)
        return [{"uid": i, "accession": k, "entrytype": "GSE", "title": "t", "summary": ""} for i, k in enumerate(self.keys[start:start + size])]


def test_crawl_resumes(spark, tmp_path):
    path, point = str(tmp_path / "rows"), C.Checkpoint(str(tmp_path / "at.json"), "term")
    assert C.crawl_into(spark, Service(["a", "b", None]), "term", path, point, page_size=2) == 3 and point.load() == 3
    later = Service(["a", "b", None, "c"])
    assert C.crawl_into(spark, later, "term", path, point, page_size=2) == 1 and later.asked == [3]
    newest = Service(["n", "a", "b", "x"])
    assert [r["accession"] for r in C.crawl(newest, "term", ["a", "b"], start=4, page_size=1, refresh=True)] == ["n"] and newest.asked == [0, 1]
    assert C.Checkpoint(point.path, "other").load() == 0
    assert C.page_rows({"uids": [2, 1, 3], "1": {"a": 1}, "2": {"a": 2}}) == [{"a": 2}, {"a": 1}]


def test_pacing():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    p = C.Pacer(2.0, clock=lambda: now[0], sleep=sleep)
    p.wait(), p.wait()
    assert slept == [0.5]
    with pytest.raises(TimeoutError):
        p.wait(deadline=0.6)


def test_fetching(spark):
    def get(path):
        if "GSE4nnn" in path:
            raise ConnectionError()
        return {"GSE1000": (200, b"x"), "GSE2000": (404, b""), "GSE3000": (503, b""), "GSE5000": (403, b"")}[path.split("/")[1]]

    keys = spark.createDataFrame([(f"GSE{i}000",) for i in range(1, 6)], "gse string")
    got = {r.key[3]: (r.status, r.detail) for r in C.fetch_files(keys, get, attempts=2, wait=lambda s: None).collect()}
    assert got == {"1": ("ok", None), "2": ("pending", "404"), "3": ("fail", "503"), "4": ("fail", "ConnectionError"), "5": ("fail", "403")}
    assert C.brief_text(200, "  ^SERIES = GSE1")[0] == "ok" and C.brief_text(200, "<html>")[0] == "fail" and C.brief_text(404, "")[0] == "pending"


def test_shards_as_a_sequential_writer_cuts(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 5, 30, 90, None]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, b int").repartition(5)
    want, shard, rows, total = [], 0, 0, 0
    for n in sizes:
        n = n or 0
        if rows and (rows >= 7 or total + n > 60):
            shard, rows, total = shard + 1, 0, 0
        rows, total = rows + 1, total + n
        want.append(shard)
    for block in (7, 50, 10_000):
        assert [r.shard for r in RU.shards(df, ["i"], "b", 7, 60, block).orderBy("i").collect()] == want


def test_most_frequent(spark):
    df = spark.createDataFrame([(i, float(2 ** (i % 5))) for i in range(50)], "k int, n double")
    assert most_frequent(df, F.col("n"), 100).count() == 50
    assert {r.n for r in most_frequent(df, F.col("n"), 25).collect()} == {16.0, 8.0}
    assert most_frequent(df, F.col("n"), 5).count() == 0


def test_contracts(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([("x", 1)], "b string, a int")
    assert FS.require_schema(df, schema).columns == ["a", "b"]
    for bad in (df.withColumn("c", F.lit(1)), df.drop("a"), df.withColumn("a", F.lit("x"))):
        with pytest.raises(ValueError):
            FS.require_schema(bad, schema)
    p = tmp_path / "q.jsonl"
    p.write_text('{"query_id": "a", "query": "x", "intent": "y", "filters": {}}\n')
    assert len(FS.load_live_queries(str(p))) == 1
    p.write_text('{"query_id": "a", "query": "x"}')
    with pytest.raises(ValueError):
        FS.load_live_queries(str(p))
    inv = FS.inventory(records(spark, [("GSE1", "t", "x"), ("GSE1", "t", "x"), ("bad", "t", "x"), ("GSE2", " ", "x"), (None, "t", "")]))
    assert sorted((r.gse or "", r.error or "") for r in inv.collect()) == [("", "bad key"), ("GSE1", "repeated key"), ("GSE1", "repeated key"), ("GSE2", "no title"), ("bad", "bad key")]
