"""Nearest vectors: curve properties, and the operator against brute force."""

import numpy as np
import pytest

from orestrata.llm.neighbours import Curves, hilbert_keys, most_similar


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3)])
def test_curve_visits_every_cell_in_unit_steps(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def _frame(spark, x, ids=None):
    rows = [(int(i) if i is not None else None, [float(v) for v in r] if r is not None else None, "x") for i, r in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, rank string")


def test_recall_in_several_ranges(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 32))).astype(np.float32)
    df = _frame(spark, x)
    got = {}
    for r in most_similar(df, "id", "embedding", 10, 32, Curves(window=512, range_rows=512)).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q = np.arange(0, 3000, 10)
    s = u[q] @ u.T
    s[np.arange(len(q)), q] = -2
    top = np.argsort(-s, axis=1)[:, :10]
    recall = np.mean([len(got[int(i)] & set(t.tolist())) / 10 for i, t in zip(q, top)])
    assert recall >= 0.9


def test_exact_when_one_window_holds_all(spark):
    x = np.eye(4, dtype=np.float32)[[0, 0, 1, 2, 3]] + np.float32(0.01)
    got = sorted((r.id, r.rank, r.neighbour) for r in most_similar(_frame(spark, x), "id", "embedding", 2, 4).collect())
    assert (0, 1, 1) in got and (1, 1, 0) in got and len(got) == 10


def test_awkward_rows(spark):
    rows = [[1.0, 0.0], [0.9, 0.1], None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1e30, 1e30], [2.0, 0.1]]
    df = _frame(spark, rows, [0, 1, 2, 3, 4, 5, 6, 7, 8, None])
    got = {(r.id, r.neighbour) for r in most_similar(df, "id", "embedding", 10, 2).collect()}
    assert got == {(a, b) for a in (0, 1, 8) for b in (0, 1, 8) if a != b}
    assert most_similar(df.limit(0), "id", "embedding", 10, 2).count() == 0
    one = _frame(spark, [[1.0, 1.0]])
    assert most_similar(one, "id", "embedding", 10, 2).count() == 0


def test_copies_share_windows(spark):
    """A third of the rows are one vector, spread over several ranges."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 8)).astype(np.float32)
    x[::3] = x[0]
    got = most_similar(_frame(spark, x), "id", "embedding", 5, 8, Curves(window=128, range_rows=128)).collect()
    of = {}
    for r in got:
        of.setdefault(r.id, []).append(r.cosine)
    assert len(of) == 900 and all(len(v) == 5 for v in of.values())
    assert all(min(of[i]) > 0.999 for i in range(0, 900, 3))
