import itertools
import math

import numpy as np
import pytest

from foliant.llm.ego_join import join_intervals, near_blocks, near_vectors

SCHEMA = "vec_id long, label int, embedding array<float>, h int"


def brute(rows, threshold):
    def fine(i, label, v):
        return i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, label, np.array(v, np.float32).astype(float)) for i, label, v in rows if fine(i, label, v)]
    count = {}
    low = {i: i for i, _, _ in good}
    linked = []
    for (i, la, a), (j, lb, b) in itertools.combinations(good, 2):
        if la == lb and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
            linked.append((i, j))
    for a, b in linked:
        count[a] = count.get(a, 0) + 1
        count[b] = count.get(b, 0) + 1
    for _ in linked:
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    return sorted(((i, count.get(i, 0) if fine(i, label, v) else 0, low[i] if fine(i, label, v) else i) for i, label, v in rows), key=repr)


def vectors(d=6, n=150):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((12, d))
    rows = [(i, int(rng.integers(0, 3)), (centers[rng.integers(0, 12)] * rng.uniform(0.5, 3) + rng.standard_normal(d) * 0.08).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, 1, rows[3][2]) for i in range(9)] + [(2000, 2, rows[3][2])]
    odd = [(3000, 1, None), (3001, 1, [0.0] * d), (3002, None, rows[0][2]), (3003, 1, [float("nan")] + [1.0] * (d - 1)), (3004, 1, [float("inf")] * d), (3005, 1, []), (3006, 1, [1.0, 2.0]), (3007, 1, [1.0, 2.0]), (3008, 0, [None] + [1.0] * (d - 1)), (None, 1, rows[3][2])]
    return rows + odd


def got(spark, rows, **how):
    frame = spark.createDataFrame([(i, label, v, 1) for i, label, v in rows], SCHEMA).repartition(4)
    out = near_vectors(frame, **how).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out if r["vec_id"] is not None)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=repr)


def test_against_brute_force(spark):
    rows = vectors()
    for how in ({"threshold": 0.98}, {"threshold": 0.9, "block_bytes": 400}):
        assert got(spark, rows, **how) == brute(rows, how["threshold"])


def test_wide_vectors(spark):
    rows = [(i, 1, v) for i, (_, _, v) in enumerate(vectors(d=300, n=30)[:40]) if v and len(v) == 300 and None not in v and np.isfinite(v).all()]
    assert got(spark, rows, threshold=0.98) == brute(rows, 0.98)


def test_recursion_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("foliant.llm.ego_join.FAN", 1)
    monkeypatch.setattr("foliant.llm.ego_join.RUN", 2)
    monkeypatch.setattr("foliant.llm.ego_join.LEAF", 3)
    rows = [r for r in vectors(d=4, n=400) if r[0] is not None]
    assert got(spark, rows, threshold=0.98, block_bytes=1, grid=3) == brute(rows, 0.98)


@pytest.mark.parametrize("run", [1, 3, 11])
def test_pairs_of_blocks_are_those_whose_boxes_are_near(spark, monkeypatch, run):
    monkeypatch.setattr("foliant.llm.ego_join.RUN", run)
    monkeypatch.setattr("foliant.llm.ego_join.FAN", 2)
    rng = np.random.default_rng(6)
    lo = np.sort(rng.uniform(-1, 1, (60, 3)), axis=0)
    hi = lo + rng.uniform(0, 0.1, (60, 3))
    rows = [(i * 3 + 5, i % 2, 3, lo[i].tolist(), hi[i].tolist()) for i in range(60)]
    blocks = spark.createDataFrame(rows, "block long, label int, d int, lo array<double>, hi array<double>")
    found = {(r["a"], r["b"]) for r in near_blocks(blocks, 5, 0.04, 59 * 3 + 5).collect()}
    gap = lambda i, j: sum(max(0, lo[i][k] - hi[j][k], lo[j][k] - hi[i][k]) ** 2 for k in range(3))
    assert found == {(i * 3 + 5, j * 3 + 5) for i in range(60) for j in range(i, 60) if i % 2 == j % 2 and gap(i, j) <= 0.04}


def test_many_lengths_share_the_bound(spark, monkeypatch):
    monkeypatch.setattr("foliant.llm.ego_join.CELLS", 40)
    rng = np.random.default_rng(7)
    rows = [(i, 1, (np.ones(d) + rng.standard_normal(d) * 0.2).tolist()) for i, d in enumerate([2, 3, 5, 8, 12, 20] * 8)]
    rows = [(i, label, np.array(v, np.float32).tolist()) for i, label, v in rows]
    assert got(spark, rows, threshold=0.95) == brute(rows, 0.95)


def test_cosine_of_just_the_threshold(spark):
    a, b = [3.0, 4.0], [4.0, 3.0]  # cosine 24 / 25
    rows = [(1, 0, a), (2, 0, b), (3, 1, [3.0, 4.0]), (4, 1, [4.0, 2.9990001])]
    assert got(spark, rows, threshold=0.96) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


def test_other_ids_and_repeated_ones(spark):
    rows = [("x", 1, [1.0, 0.0]), ("y", 1, [1.0, 0.001]), ("a", 1, [0.0, 1.0]), ("x", 1, [0.001, 1.0]), ("z", 1, [1.0, 1.0])]
    out = near_vectors(spark.createDataFrame(rows, "vec_id string, label int, embedding array<double>")).collect()
    assert sorted(map(tuple, out)) == [("a", 1, "a", True), ("x", 1, "a", False), ("x", 1, "x", True), ("y", 1, "x", False), ("z", 0, "z", True)]


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_intervals_lose_no_pair():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(np.floor(x / 0.2).T[::-1])]
    i, j = join_intervals(x, x, x, x, 0.98, 0.04 + 1e-9, True)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(i) == len(a)
