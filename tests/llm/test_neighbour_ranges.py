"""Vectors near the border of a range are compared with those across it, and orderings grow with the table."""

import numpy as np

from orestrata.llm.neighbours import Curves, most_similar

N, WINDOW, K = 300, 64, 10


def test_borders_are_crossed(spark):
    """Along an arc every vector meets those next to it, whatever range they are in."""
    angle = np.linspace(0.0, 1.5, N)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    curves = Curves(orderings=1, axes=1, bits=20, window=WINDOW, range_rows=16)
    got = {}
    for r in most_similar(df, "id", "embedding", K, 2, curves).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert len(got) == N
    # Halves round, so of ten about as near some on either side must be there, not all ten of them.
    missed = [i for i in range(20, N - 20) if not (min(got[i]) < i < max(got[i]))]
    assert not missed


def test_orderings_grow_with_rows():
    c = Curves()
    assert c.orderings_for(100_000) == c.orderings
    assert c.orderings_for(1_000_000) > 2 * c.orderings
    assert Curves(orderings=9).orderings_for(10) == 9


def test_recall_with_a_window_of_one_percent(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((400, 24))
    x = (centres[rng.integers(0, 400, 6400)] + 0.3 * rng.standard_normal((6400, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    got = {}
    for r in most_similar(df, "id", "embedding", K, 24, Curves(window=64, range_rows=64)).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q = np.arange(0, 6400, 100)
    s = u[q] @ u.T
    s[np.arange(len(q)), q] = -2
    top = np.argsort(-s, axis=1)[:, :K]
    assert np.mean([len(got[int(i)] & set(t.tolist())) / K for i, t in zip(q, top)]) >= 0.9


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30, 0, -1)] + [(50, [0.0, 1.0])]
    near = most_similar(spark.createDataFrame(rows, "id long, embedding array<float>"), "id", "embedding", 3, 2)
    assert {r.neighbour for r in near.where("id = 20").collect()} == {1, 2, 3}


def test_pairs_at_the_threshold_are_computed_in_full(spark):
    from orestrata.llm.neighbours import verified

    a = np.float32(0.8)
    rows = [(1, [1.0, 0.0]), (2, [float(a), float(np.sqrt(1 - np.float64(a) ** 2))]), (3, [0.79999, float(np.sqrt(1 - 0.79999**2))]), (4, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    near = spark.createDataFrame([(1, 2, 0.79995), (1, 3, 0.80003), (1, 4, 0.99)], "id long, neighbour long, cosine float")
    assert {r.neighbour for r in verified(near, df, "id", "embedding", 0.8 - 1e-7, 2).collect()} == {2, 4}
