"""All counts that a field in doubt asks for are known, however many a column has."""

from orestrata.operators import packed


def _column(spark):
    """Values seen twice each, and joins of two that only their counts tell from names with a sign in them."""
    names = [f"Genus{chr(97 + i // 26)}{chr(97 + i % 26)} species{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [(i, names[i // 2]) for i in range(240)]
    rows += [(1000 + i, f"{names[i]} and {names[i + 60]}") for i in range(60)]
    rows += [(2000 + i, "salt and pepper stock") for i in range(40)]
    return names, spark.createDataFrame(rows, "id long, organisms string")


def _read(spark):
    names, df = _column(spark)
    got = {}
    for r in packed.split_packed(df, "id", ["organisms"]).collect():
        got.setdefault(r.id, {})[r.pos] = r.val
    return names, {i: [v[p] for p in sorted(v)] for i, v in got.items()}


def test_counts_are_not_cut_in_a_large_column(spark, monkeypatch):
    # A column of more values than the model was once allowed to hold.
    monkeypatch.setattr(packed, "MOST_VALUES", 8, raising=False)
    monkeypatch.setattr(packed, "MOST_WORDS", 8, raising=False)
    names, got = _read(spark)
    assert [got[1000 + i] for i in range(60)] == [[names[i], names[i + 60]] for i in range(60)]
    assert all(got[2000 + i] == ["salt and pepper stock"] for i in range(40))


def test_readings_do_not_depend_on_groups(spark, monkeypatch):
    _, whole = _read(spark)
    monkeypatch.setattr(packed, "GROUP_FIELDS", 3)
    assert _read(spark)[1] == whole


def test_all_a_reading_asks_for_is_noted():
    texts = ["a and b, c and d; e", "a + b, c & d", "x, y and z / w", " and ".join(f"p{i}, q{i}" for i in range(60)), "a/ + b", "k: a and b, l: c"]
    for known in (0.0, 50.0):
        for text in texts:
            asked = packed.Asked()
            asked.read(text)
            later = packed.Asked()
            later.cut = {k: 0.999 if known else 0.001 for k in packed.KINDS}
            packed._openers(text, later)
            packed.segment(text, later)
            assert all(later.asked[tab] <= asked.asked[tab] for tab in later.asked)


def test_unicode_space_around_a_sign(spark):
    df = spark.createDataFrame([(1, "a\u00a0and b;c"), (2, "d\u2009+\u2009e"), (3, "f")], "id long, x string")
    assert {r.id for r in packed.split_packed(df, "id", ["x"]).collect()} == {1, 2, 3}
