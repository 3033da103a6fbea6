"""Values that join many parts, and commas beside signs that don't separate."""

from orestrata.operators.packed import FULL_PARTS, SplitModel, segment


def _joins():
    """A model that has learned that no sign in doubt separates."""
    m = SplitModel()
    m.cut.update({k: 1e-5 for k in ("slash", "plus", "ampersand", "and")})
    return m


def test_long_joins_stay_whole():
    for n in (13, 30, FULL_PARTS + 20):
        text = " and ".join(f"part{i}" for i in range(n))
        assert segment(text, _joins())[0] == [text]
        assert [v.strip() for v in segment(f"{text}; b", _joins())[0]] == [text, "b"]


def test_commas_cut_beside_many_joins():
    values = [f"treatment: A{i} + B{i}" for i in range(15)]
    assert [v.strip() for v in segment(", ".join(values), _joins())[0]] == values
