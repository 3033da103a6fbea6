"""Packed fields: cut points, cleaning, and the operator on awkward rows."""

import pytest

from orestrata.operators.packed import SplitModel, clean_value, cut_points, segment, split_packed


def values(text, tagged=False):
    return [v for v in (clean_value(s, tagged) for s in segment(text, SplitModel())[0]) if v]


@pytest.mark.parametrize(("text", "expected"), [
    ("liver; spleen", ["liver", "spleen"]),
    ("liver, left side, day 4 | lens", ["liver, left side, day 4", "lens"]),
    ("'liver, left side', lens", ["liver, left side", "lens"]),
    ("3,4 mM x, lens", ["3,4 mM x", "lens"]),
    ('"a ""b""", c', ['a "b"', "c"]),
    ("a\\, b, c\\; d", ["a, b", "c; d"]),
    ("a;; b ;", ["a", "b"]),
    ("a, b;", ["a", "b"]),
    ("a;a;a", ["a", "a", "a"]),
    ("\tx\ty\n", ["x", "y"]),
    ('"unclosed; b', ['"unclosed', "b"]),
    ("“p; q”|r", ["p; q", "r"]),
    ("seed biopsy// // root", ["seed biopsy", "root"]),
    ("3'-tagged lens", ["3'-tagged lens"]),
    ("", []), ("  ", []), (" ; , ", []),
])
def test_values(text, expected):
    assert values(text) == expected


def test_right_side_quotes():
    assert values('dose: "1; 2", note: labelled "X-1" at source', True) == ["dose: 1; 2", 'note: labelled "X-1" at source']


def test_comma_between_digits_is_no_cut():
    assert [c[2] for c in cut_points("1,2-diol, b")] == ["comma"]


def test_column_teaches_words(spark):
    names = ["Alba rota", "Beta nix", "Gamma lux", "Delta rex"]
    rows = [(i, names[i % 4], f"sex: {'male' if i % 2 else 'female'}") for i in range(80)]
    rows += [(100 + i, f"{names[i % 4]} and {names[(i + 1) % 4]}", "sex: male and female") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, organisms string, characteristics string")
    got = split_packed(df, "id", ["organisms", "characteristics"], tagged=["characteristics"]).collect()
    of = {}
    for r in got:
        of.setdefault((r.id, r.field), []).append((r.pos, r.val))
    assert sorted(of[100, "organisms"]) == [(1, "Alba rota"), (2, "Beta nix")]
    assert of[100, "characteristics"] == [(1, "sex: male and female")]


def test_awkward_rows(spark):
    long = "; ".join(f"value {i}" for i in range(5000))
    df = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "  ", 2), (4, long, 3), (5, "a;b", 4), (5, "a;b", 4), (None, "z", 5)], "id long, f string, val int")
    got = split_packed(df, "id", ["f"]).collect()
    assert sum(r.id == 4 for r in got) == 5000
    assert sorted((r.id, r.pos, r.val) for r in got if r.id == 5) == [(5, 1, "a"), (5, 1, "a"), (5, 2, "b"), (5, 2, "b")]
    assert [r.val for r in got if r.id is None] == ["z"]
    assert split_packed(df.limit(0), "id", ["f"]).count() == 0


def test_hostile_fields_stay_linear():
    """Thousands of doubtful delimiters, and quotation marks that nothing closes."""
    model = SplitModel()
    assert len(segment('"a; ' * 20000, model)[0]) == 20001
    assert len(segment("“;" * 20000, model)[0]) == 20001
    parts = segment(" and ".join(["x y"] * 500), model)[0]
    assert "".join("".join(parts).replace("and", "").split()) == "xy" * 500
