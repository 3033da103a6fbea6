"""The sentence units don't depend on how many tokens a corpus has, nor on the groups its texts are read in."""

import random

from orestrata.llm import sentences as S


def _words(rng, n):
    return ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


def _texts():
    """Texts of sentences that hold an abbreviation of eighty before a name, and where each sentence begins and ends."""
    rng = random.Random(5)
    short = ["".join(rng.choice("bcdfghklmnpqrstvwxz") for _ in range(4)) for _ in range(80)]
    ends, names = _words(rng, 40), [w.capitalize() for w in _words(rng, 60)]
    rows = []
    for i in range(800):
        text, spans = "", []
        for k in range(4):
            text += ("\n\n" if k == 2 else " ") if k else ""
            unit = f"The {rng.choice(ends)} of {short[(4 * i + k) % 80]}. {rng.choice(names)} was {rng.choice(ends)}."
            spans.append((len(text), len(text) + len(unit)))
            text += unit
        rows.append((i, text, spans))
    return rows


def _split(spark, rows):
    df = spark.createDataFrame([(i, text) for i, text, _ in rows], "doc_id long, text string").repartition(3)
    return {tuple(r) for r in S.split_sentences(df, "doc_id", "text").collect()}


def test_all_counts_are_held_in_a_large_corpus(spark, monkeypatch):
    # A corpus of more tokens than the model was once allowed to hold.
    monkeypatch.setattr(S, "MOST_TOKENS", 8, raising=False)
    rows = _texts()
    assert _split(spark, rows) == {(i, a, b) for i, _, spans in rows for a, b in spans}


def test_groups_dont_matter(spark, monkeypatch):
    rows = _texts() + [(900 + k, "Wow! Aha! See fig. Bebebe was gone.", []) for k in range(2)] + [(None, "(", []), (None, "x. " * 500, [])]
    whole = _split(spark, rows)
    monkeypatch.setattr(S, "GROUP_CHARS", 700)
    assert _split(spark, rows) == whole


def test_tokens_asked_for_are_counted():
    one, two = "Wow! It is late.\n\nIt was early! It is", "They said wow. It was."
    asked = set().union(*S.count_tokens([one]))
    assert {S.token_key(t) for t in ("Wow", "early", "It", "late")} <= asked
    opens, after, closes, before = S.count_tokens([one, two])
    assert before[S.token_key("Wow")] == 0 and closes[S.token_key("early")] == 0 and before[S.token_key("wow")] == 1
