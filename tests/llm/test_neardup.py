"""Near duplicates: the bit-sliced comparison against counting, and the operator against brute force."""

import random
import re

import numpy as np
import pytest

from orestrata.llm import neardup as ND


def test_within_counts_like_popcount():
    rng = np.random.default_rng(1)
    prints = [rng.integers(0, 256, 32, dtype=np.uint8).tobytes() for _ in range(150)]
    for i in range(0, 150, 3):  # near copies
        x = np.frombuffer(prints[i], np.uint8).copy()
        for b in rng.integers(0, 256, rng.integers(0, 90)):
            x[b // 8] ^= 1 << (b % 8)
        prints[(i + 1) % 150] = x.tobytes()
    keys = np.sort(rng.integers(0, 4, 150))
    for limit in (0, 20, 77, 128, 256):
        i, j = ND.compare_run(keys, None, prints, limit)
        got = set(zip(i.tolist(), j.tolist()))
        bits = np.array([np.unpackbits(np.frombuffer(p, np.uint8)) for p in prints])
        want = {(a, b) for a in range(150) for b in range(a + 1, 150) if keys[a] == keys[b] and (bits[a] != bits[b]).sum() <= limit}
        assert got == want


def test_sides():
    p = [bytes(32)] * 4
    i, j = ND.compare_run(np.zeros(4, np.int64), np.array([0, 0, 1, 1]), p, 0)
    assert set(zip(i.tolist(), j.tolist())) == {(0, 2), (0, 3), (1, 2), (1, 3)}


def _rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        rows.append((len(rows), " ".join(base), None))
        for _ in range(rng.choice([0, 0, 1, 3])):
            edit = list(base)
            for _ in range(rng.randint(0, 4)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            rows.append((len(rows), " ".join(edit), ""))
    rows += [(len(rows) + k, t, None) for k, t in enumerate(["same text of five words", "Same TEXT, of five  words!", "two words", "", "  ", None, "x"])]
    return rows


def _truth(rows, width, least):
    sets = {}
    for i, a, b in rows:
        w = re.findall(r"[^\W_]+", " ".join([a or "", b or ""]).lower())
        s = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}
        if s:
            sets[i] = s
    ids = sorted(sets)
    return {(x, y) for n, x in enumerate(ids) for y in ids[n + 1:] if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= least}


@pytest.mark.parametrize("run", [4096, 2])
def test_pairs_against_brute_force(spark, monkeypatch, run):
    """Also with buckets of more than two members dealt into sub-blocks."""
    monkeypatch.setattr(ND, "RUN", run)
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, title string, summary string")
    got = {(r.id_a, r.id_b) for r in ND.NearDuplicates(df, "id", ["title", "summary"], 3, 0.6).pairs().collect()}
    assert got == _truth(rows, 3, 0.6)


def test_groups(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, title string, summary string").withColumnRenamed("title", "text")
    nd = ND.NearDuplicates(df, "id", ["text", "summary"], 3, 0.6)
    groups = {r.id: r.group_id for r in nd.groups().collect()}
    truth = _truth(rows, 3, 0.6)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in truth:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert all(groups[i] == find(i) for i in groups)


def test_awkward_tables(spark):
    schema = "id long, title string, rep string, shingles int"
    empty = spark.createDataFrame([], schema)
    assert ND.NearDuplicates(empty, "id", ["title"]).pairs().count() == 0
    assert ND.NearDuplicates(empty, "id", ["title"]).groups().count() == 0
    long = " ".join(f"v{i}" for i in range(30000))
    df = spark.createDataFrame([(1, long, "x", 1), (2, long + " tail", "x", 1), (None, long, "x", 1), (3, None, None, None), (4, "a b c d e", "y", 2), (4, "a b c d e", "y", 2)], schema)
    assert {(r.id_a, r.id_b) for r in ND.NearDuplicates(df, "id", ["title"]).pairs().collect()} == {(1, 2)}


def test_hot_group_of_copies(spark):
    """A third of the rows are one text."""
    rows = [(i, "the very same text of some seven words" if i % 3 == 0 else f"row {i} holds words of its own {i * 7} and {i * 13}") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, title string")
    nd = ND.NearDuplicates(df, "id", ["title"])
    assert nd.pairs().count() == 30 * 29 // 2
    assert nd.members.where("rep = 0").count() == 30


def test_chain_of_links(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    roots = {r.id: r.root for r in ND.connected(df).collect()}
    assert all(roots[i] == 0 for i in range(201)) and roots[501] == 500


def test_links_of_copies_count(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, text) for i in range(5)] + [(9, text + " thirteen"), (10, text + " thirteen"), (20, "quite another text of some more words here")]
    nd = ND.NearDuplicates(spark.createDataFrame(rows, "id long, title string"), "id", ["title"], width=3, similarity=0.6)
    groups = {r.id: r for r in nd.groups().collect()}
    per = {}
    for a, b in nd.pairs().collect():
        per[a], per[b] = per.get(a, 0) + 1, per.get(b, 0) + 1
    assert {i: g.n_links for i, g in groups.items()} == {**{i: per.get(i, 0) for i in groups}} and groups[0].n_links == 6 and groups[20].n_links == 0
    assert {g.group_id for i, g in groups.items() if i < 20} == {0}
