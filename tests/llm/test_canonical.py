"""Mapping typed values to a reference list."""

import pytest

from orestrata.llm.canonical import map_values

TERMS = [
    ("NCBITaxon:9000001", "organism", "Alba rotensis", ["hill fox"]), ("NCBITaxon:9000002", "organism", "Alba niger", []), ("NCBITaxon:9000003", "organism", "Beta niger", None),
    ("NCBITaxon:9000004", "organism", "Arva niger", []), ("PATO:9000383", "sex", "female", ["f", "woman", "♀"]), ("PATO:9000384", "sex", "male", ["m", "man", "♂"]),
    ("UBERON:9000007", "tissue", "liver", ["hepatic tissue"]), ("UBERON:9000020", "tissue", "left liver lobe", []), ("UBERON:9000540", "tissue", "lens", []),
]
CASES = [
    ("organism", "Alba rotensis", ["9000001"]), ("organism", "ALBA_ROTENSIS", ["9000001"]), ("organism", "Alba rotensis.", ["9000001"]), ("organism", "Alba rotesnis", ["9000001"]),
    ("organism", "A. rotensis", ["9000001"]), ("organism", "A rotensis", ["9000001"]), ("organism", "A. niger", ["unmatched"]), ("organism", "B.niger", ["9000003"]),
    ("organism", "Alba rotensis strain K12", ["9000001"]), ("organism", "Alba rotensis (isolate 4)", ["9000001"]), ("organism", "Alba rotensis, strain K5", ["9000001"]),
    ("organism", "Alba viridis", ["unmatched"]), ("organism", "Alba", ["unmatched"]), ("organism", "Hill Fox", ["9000001"]), ("organism", "dale fox", ["unmatched"]),
    ("organism", "NCBITaxon:9000002", ["9000002"]), ("organism", "txid9000002", ["9000002"]), ("organism", "obo/NCBITaxon_9000002", ["9000002"]), ("organism", " 9000002", ["9000002"]),
    ("organism", "NCBITaxon:9000009", ["unmatched"]), ("organism", "n/a", []), ("organism", "Unknown", []), ("organism", "?", []), ("organism", " ", []),
    ("sex", "Female", ["9000383"]), ("sex", "fmeale", ["9000383"]), ("sex", "fem", ["9000383"]), ("sex", "♀", ["9000383"]), ("sex", "M/F", ["9000383", "9000384"]),
    ("sex", "male and female", ["9000383", "9000384"]), ("sex", "mixed sex", ["9000383", "9000384"]), ("sex", "male (castrated)", ["9000384"]), ("sex", "2", ["unmatched"]),
    ("sex", "12 weeks", ["unmatched"]), ("sex", "C7/BL line", ["unmatched"]), ("sex", "not recorded", []), ("sex", "PATO:9000384", ["9000384"]),
    ("tissue", "Liver (FFPE block)", ["9000007"]), ("tissue", "left liver lobe", ["9000020"]), ("tissue", "lnes", ["9000540"]), ("tissue", "organoid batch 4", ["unmatched"]),
    ("tissue", "Hepatic tissue.", ["9000007"]), ("tissue", "12345678", ["unmatched"]), ("tissue", "x" * 5000, ["unmatched"]), ("tissue", "...", []),
]


@pytest.fixture(scope="module")
def mapped(spark):
    terms = spark.createDataFrame(TERMS, "term_id string, vocab string, label string, synonyms array<string>")
    values = spark.createDataFrame([(v, r) for v, r, _ in CASES] + [("tissue", None)], "vocab string, raw string")
    out = {}
    for r in map_values(values, terms).collect():
        out.setdefault((r.vocab, r.raw), []).append(r.term_id.split(":")[-1])
    return out


@pytest.mark.parametrize(("vocab", "raw", "want"), CASES)
def test_value(mapped, vocab, raw, want):
    assert sorted(mapped.get((vocab, raw), [])) == want


def test_empty(spark):
    terms = spark.createDataFrame(TERMS, "term_id string, vocab string, label string, synonyms array<string>")
    none = spark.createDataFrame([], "vocab string, raw string")
    assert map_values(none, terms).count() == 0
    some = spark.createDataFrame([("sex", "female")], "vocab string, raw string")
    assert [r.term_id for r in map_values(some, terms.limit(0)).collect()] == ["unmatched"]


def test_long_tag_names_count(spark):
    from orestrata.llm.canonical import typed_values

    rows = [(1, None, "sex " + "x" * 100 + ": female; tissue: liver", None, None), (2, None, None, [], None)]
    series = spark.createDataFrame(rows, "id long, organisms string, characteristics string, organism_ids array<string>, sex_ids array<string>")
    assert {(r.vocab, r.raw) for r in typed_values(series).collect()} == {("sex", "female"), ("tissue", "liver")}
