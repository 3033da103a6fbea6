"""Filters, facets, retrieval and candidates on small fixtures."""

import pytest
from pyspark.sql import functions as F

from orestrata.functions.text import surface
from orestrata.operators import candidates as C
from orestrata.operators import facets as FC
from orestrata.operators import retrieval as R
from orestrata.operators.filters import Filters, unknown_values, violations

SCHEMA = ("id long, gse string, title string, summary string, overall_design string, search_text string, embedding array<float>, "
          "organism_ids array<string>, sex_ids array<string>, assay_categories array<string>, assay_labels array<string>, score int")
ROWS = [
    (1, "GSE10", "immune cells", "blood of donors", None, "immune cells blood", [1.0, 0.0], ["h"], ["f", "f"], ["seq"], [], 9),
    (2, "GSE2", "chromatin", "mouse chromatin cells", "", "chromatin mouse", [0.0, 1.0], ["m"], ["m"], ["seq"], ["x"], 9),
    (3, "GSE3", None, "", None, "", None, None, [], [None], ["x"], 9),
    (4, "GSE4", "cells cells", "cells", "cells", "cells", [0.0, 0.0], ["h", "m"], ["f"], ["array"], ["y"], 9),
    (5, "GSE5", "immune cells", "blood of donors", None, "immune cells blood", [float("nan"), 1.0], ["h"], ["f"], ["seq"], [], 9),
]


BOOSTS = {"title": 3.0, "summary": 2.0}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def test_or_within_and_across(docs):
    f = Filters.of({"organism_ids": ["h", "m"], "sex_ids": ["f"]})
    assert {r.id for r in f.apply(docs).collect()} == {1, 4, 5}
    assert Filters().apply(docs).count() == 5


def test_request_identifiers():
    assert Filters.of_request({"organism_ids": ["NCBITaxon:9606"]}).wanted
    for bad in ({"organism_ids": ["NCBITaxon:09"]}, {"sex_ids": ["PATO:38"]}):
        with pytest.raises(ValueError):
            Filters.of_request(bad)


@pytest.mark.parametrize("bad", [{"nope": ["x"]}, {"sex_ids": [" "]}, {"sex_ids": ["x" * 300]}, {"sex_ids": [str(i) for i in range(30)]}])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        Filters.of(bad)


def test_filter_values_are_tidied():
    assert Filters.of({"sex_ids": [" f ", "m", "f"]}).wanted == {"sex_ids": ("f", "m")}


def test_own_filter_is_left_out(docs):
    got = {(r.field, r.value): r.n for r in FC.exact_facets(docs, Filters.of({"sex_ids": ["f"]})).collect()}
    assert got["sex_ids", "m"] == 1 and got["sex_ids", "f"] == 3  # a repeated value counts once
    assert ("organism_ids", "m") in got and got["organism_ids", "h"] == 3
    assert got["assay_categories", "seq"] == 2


def test_empty_pool_has_no_buckets(docs):
    pools = R.Searcher(docs, BOOSTS).pools("absentword", "bm25")
    assert FC.pool_facets(pools).count() == 0
    assert {r.candidate_count for r in FC.candidate_counts(pools).collect()} == {0}


def test_each_pool_leaves_its_own_filter_out(docs):
    filters = Filters.of({"sex_ids": ["f"], "assay_categories": ["seq"]})
    for mode in ("bm25", "dense", "hybrid"):
        pools = R.Searcher(docs, BOOSTS).pools("cells", mode, [1.0, 0.0], filters, R.Settings(topk=1, deep=1, facet_pool=2))
        got = {}
        for r in pools.collect():
            got.setdefault(r.field, set()).add(r.id)
        for f, ids in got.items():
            one = {r.id for r in R.Searcher(docs, BOOSTS).hits("cells", mode, [1.0, 0.0], filters.without(f), R.Settings(topk=2, deep=2)).collect()}
            assert ids == one, (mode, f)


def test_vocabulary_check(docs):
    assert unknown_values(Filters.of({"sex_ids": ["f", "zz"]}), FC.vocabulary(docs)) == [("sex_ids", "zz")]
    assert unknown_values(Filters(), FC.vocabulary(docs)) == []


def test_ties_by_id_and_blank_query(docs):
    assert [r.id for r in R.bm25(docs, surface(["title", "summary"]), "immune", 5).collect()] == [1, 5]
    assert [r.id for r in R.bm25_fields(docs, "  ", 3).collect()] == [1, 2, 3]
    assert R.bm25(docs, surface(["title"]), "absentword", 5).count() == 0


def test_statistics_ignore_filters(docs):
    text = surface(["title", "summary"])
    free = {r.id: r.score for r in R.bm25(docs, text, "immune cells", 5).collect()}
    kept = {r.id: r.score for r in R.bm25(docs, text, "immune cells", 5, Filters.of({"organism_ids": ["m"]})).collect()}
    assert set(kept) == {2, 4} and all(kept[i] == pytest.approx(free[i]) for i in kept)


def test_index_gives_the_same_scores(spark, docs, tmp_path):
    index = R.TextIndex.build(docs.select("id", *BOOSTS), {f: F.col(f) for f in BOOSTS}, str(tmp_path / "index"), buckets=3)
    for query in ("immune cells", "CHROMATIN mouse cells", "absentword", "  "):
        one = {r.id: r.score for r in R.bm25_fields(docs, query, 9, boosts=BOOSTS).collect()}
        two = {r.id: r.score for r in R.Searcher(docs, BOOSTS, index=index).hits(query, "bm25").collect()}
        assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i]) for i in one)
    again = R.TextIndex(spark, str(tmp_path / "index"))
    assert again.scores("immune", BOOSTS).count() == 2
    with pytest.raises(Exception):
        R.TextIndex.build(docs.select("id", *BOOSTS), {f: F.col(f) for f in BOOSTS}, str(tmp_path / "index"))


def test_a_missing_document_is_an_error(spark, docs):
    hits = spark.createDataFrame([(1,), (99,)], "id long")
    with pytest.raises(Exception, match="documents changed"):
        R.hydrate(hits, docs, ["gse"], page=2).collect()
    assert [r.gse for r in R.hydrate(hits.where("id = 1"), docs, ["gse"]).collect()] == ["GSE10"]


def test_dense_leaves_unusable_vectors_out(docs):
    assert [r.id for r in R.dense(docs, "embedding", [1.0, 0.0], 9).collect()] == [1, 2]
    with pytest.raises(ValueError):
        R.dense(docs, "embedding", [0.0, 0.0], 9)


def test_fusion_rank_and_row_number(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0)], "id long, score double")
    b = spark.createDataFrame([(3, 1.0)], "id long, score double")
    rank = {r.id: r.bm25_rank for r in R.fuse(a, b, 9, tie="rank").collect()}
    row = {r.id: r.bm25_rank for r in R.fuse(a, b, 9).collect()}
    assert rank == {1: 1, 2: 1, 3: 3} and row == {1: 1, 2: 2, 3: 3}
    assert R.fuse(a, b, 1).first().id == 3


def test_search_checks_its_input(docs):
    search = R.Searcher(docs, BOOSTS)
    for query, mode, vector in (("x", "nope", None), (" ", "hybrid", [1.0, 0.0]), ("x", "dense", [float("nan"), 1.0]), ("x", "dense", [[1.0]])):
        with pytest.raises(ValueError):
            search.hits(query, mode, vector)
    assert search.hits("immune", "hybrid", [1.0, 0.0], settings=R.Settings(topk=3, deep=5)).first().id == 1


def test_empty_tables(docs):
    none = docs.limit(0)
    assert R.bm25(none, surface(["title"]), "cells", 5).count() == 0
    assert FC.exact_facets(none, Filters()).count() == 0
    assert R.dense(none, "embedding", [1.0, 0.0], 5).count() == 0


def test_pool_size():
    assert [C.pool_size(n) for n in (1, 10, 20, 50)] == [40, 40, 80, 100]


def _sides(spark):
    local = spark.createDataFrame([("GSE1", 1, "a", "", "t", None), ("GSE2", 2, "", "s", "t", "x")], "gse string, original_rank int, title string, snippet string, study_type string, taxon string")
    native = spark.createDataFrame([("GSE2", 5, "late", "n", "n", "n"), ("GSE2", 3, "B", "n", "n", "n"), ("GSE9", 4, "c", "n", "n", "n")], "gse string, native_rank int, title string, snippet string, study_type string, taxon string")
    return local, native


def test_merge_prefers_local_and_first_native(spark):
    got = {r.gse: r for r in C.merge(*_sides(spark)).collect()}
    assert got["GSE2"].source == "both" and got["GSE2"].title == "B" and got["GSE2"].snippet == "s" and got["GSE2"].native_rank == 3
    assert got["GSE9"].source == "ncbi" and got["GSE1"].source == "local"


def test_native_rows_must_prove_filters(spark):
    got = {r.gse for r in C.merge(*_sides(spark), Filters.of({"sex_ids": ["f"]})).collect()}
    assert got == {"GSE1", "GSE2"}


def test_orders(spark):
    merged = C.merge(*_sides(spark))
    assert [r.gse for r in C.placed(merged, C.fallback_order(), 9).orderBy("final_rank").collect()] == ["GSE1", "GSE2", "GSE9"]
    scores = spark.createDataFrame([("GSE1", 1), ("GSE2", 50), ("GSE9", 50)], "gse string, rerank_score int")
    assert [r.gse for r in C.rerank(merged, scores, 9).orderBy("final_rank").collect()] == ["GSE2", "GSE9", "GSE1"]
    for bad in ([("GSE1", 1)], [("GSE1", 1), ("GSE2", 101), ("GSE9", 2)], [("GSE1", 1), ("GSE2", 1), ("GSE9", 1), ("GSE7", 1)]):
        s = spark.createDataFrame(bad, "gse string, rerank_score int")
        assert [r.gse for r in C.rerank(merged, s, 9).orderBy("final_rank").collect()] == ["GSE1", "GSE2", "GSE9"]


def test_single_positive(spark):
    df = spark.createDataFrame([(["7"],), (["7", "8"],), (["-1"],), (["x"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(C.single_positive(F.col("v"))).collect()] == [7, None, None, None, None, None]


def test_violations(spark):
    df = spark.createDataFrame([("q", ["f"]), ("q", []), ("r", None)], "query_id string, sex_ids array<string>")
    assert {r.query_id: r.n_violations for r in violations(df, Filters.of({"sex_ids": ["f"]})).collect()} == {"q": 1, "r": 1}
