"""The mapped entries don't depend on how many values a field has."""

from orestrata.llm.canonical import map_series
from orestrata.operators import frequent, packed


def _mapped(spark):
    names = [f"Genus{chr(97 + i // 26)}{chr(97 + i % 26)} species{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    texts = [names[i // 2] for i in range(240)] + [f"{names[i]} and {names[i + 60]}" for i in range(60)]
    none = [None, [], []]
    series = spark.createDataFrame(
        [(i, x, *none) for i, x in enumerate(texts)], "id long, organisms string, characteristics string, organism_ids array<string>, sex_ids array<string>")
    terms = spark.createDataFrame(
        [(f"NCBITaxon:{10000 + i}", "organism", x, []) for i, x in enumerate(names)], "term_id string, vocab string, label string, synonyms array<string>")
    return {(r.id, r.field, r.term_id) for r in map_series(series, terms).collect()}


def test_all_counts_are_held_in_a_large_column(spark, monkeypatch):
    # A column of more values and words than the model was once allowed to hold.
    for bound in ("MOST_VALUES", "MOST_WORDS"):
        monkeypatch.setattr(packed, bound, 8, raising=False)
    joined = {(240 + i, "organisms", f"NCBITaxon:{10000 + j}") for i in range(60) for j in (i, i + 60)}
    assert {x for x in _mapped(spark) if x[0] >= 240} == joined


def test_no_choice_of_the_most_frequent(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("counts were cut")

    monkeypatch.setattr(frequent, "most_frequent", refuse)
    assert not hasattr(packed, "most_frequent")
    assert len({x[2] for x in _mapped(spark)}) == 120
