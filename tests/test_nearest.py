"""Nearest vectors against brute force; drift and similarity of whole conversations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textward.operators import nearest, semantic

KIND = "vec_id long, embedding array<double>, label string"


def vectors(seed=0, n=400):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)], f"c{i % 4}") for i in range(n)]
    rows += [(n, None, "c0"), (n + 1, [], "c1"), (n + 2, [0.0] * 6, "c2"), (n + 3, [1.0, 2.0], "c3"), (n + 4, [float("nan")] * 6, "c0"), (n + 5, [1.0, None, 0.0, 0.0, 0.0, 0.0], None)]
    rows += [(n + 10 + i, rows[3][1], "same") for i in range(30)] + [(None, rows[0][1], "c0")]
    return rows


def cosine(a, b):
    if not a or not b or len(a) != len(b) or None in a or None in b or not np.isfinite(a + b).all() or not any(a) or not any(b):
        return 0.0
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)


@pytest.mark.parametrize("block,row_block", [(2048, 262_144), (7, 33), (1, 1000)])
def test_nearest(spark, block, row_block):
    rows = [r for r in vectors() if r[0] is not None]
    df = spark.createDataFrame(vectors(), KIND)
    queries = df.filter("vec_id % 20 = 0 or vec_id > 399")
    got = nearest.nearest(queries, df, 5, block=block, row_block=row_block).collect()
    want = {}
    for i, v, _ in rows:
        if i % 20 == 0 or i > 399:
            want[i] = sorted((-cosine(v, w), j) for j, w, _ in rows)[:5]
    assert len(got) == 5 * len(want)
    for r in got:
        sim, row = want[r.query_id][r["rank"] - 1]
        assert r.row_id == row and r.similarity == pytest.approx(-sim, abs=2e-9)
    assert nearest.nearest(queries.limit(0), df).count() == 0 and nearest.nearest(queries, df.limit(0)).count() == 0


def test_best_classes(spark):
    rows = [r for r in vectors(1, 60) if r[0] is not None]
    df = spark.createDataFrame(vectors(1, 60), KIND)
    got = {r.query_id: r for r in nearest.best_classes(df, df, "label", block=9, row_block=20, but_self=True).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, v, _ in rows:
        best = {}
        for j, w, label in rows:
            if j != i and label is not None:
                best[label] = max(best.get(label, -9), cosine(v, w))
        order = sorted(((-s, c) for c, s in best.items() if s > 0))[:2]
        first, second = (order + [(0.0, None)] * 2)[:2]
        r = got[i]
        assert (r.primary, r.second) == (first[1], second[1])
        assert r.similarity == pytest.approx(-first[0], abs=2e-9) and r.second_similarity == pytest.approx(-second[0], abs=2e-9)


def test_cells(spark):
    df = spark.createDataFrame(vectors(2, 600), KIND)
    own = df.filter("vec_id < 600")
    exact = nearest.nearest(own, df, 5)
    whole = nearest.recall(nearest.nearest_by_cells(own, df, 5, cells=8, probes=8, block=100), exact).first()
    assert whole.recall == 1.0  # all cells: the same as the exact way
    some = nearest.recall(nearest.nearest_by_cells(own, df, 5, cells=8, probes=4), exact).first()
    assert 0.9 <= some.recall <= 1.0


def test_whole_conversation(spark):
    rows = [(1, 0, [1.0, 0.0, 0.0]), (1, 1, [1.0, 0.0, 0.0]), (1, 2, [0.0, 1.0, 0.0]), (1, 3, [0.0, 3.0, 0.0]), (1, 4, [0.0, 0.0, 30.0]), (2, 0, [0.0, 0.0, 0.0]), (2, 1, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "s long, t long, embedding array<double>")
    got = {(r.s, r.t): r for r in semantic.aggregate_drift(df, "s", "t").collect()}
    sums = np.cumsum([r[2] for r in rows[:5]], axis=0)
    want = [1 - float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) for a, b in zip(sums, sums[1:])]
    assert [round(got[1, t].aggregate_drift, 9) for t in range(1, 5)] == [round(x, 9) for x in want]
    assert want[1] < want[2] < want[3] and got[1, 4].acceleration == pytest.approx((want[3] - want[1]) / 2)
    assert got[1, 0].aggregate_drift is None and got[2, 1].aggregate_drift == 1.0 and got[1, 2].acceleration == 0.0
    assert {(r.s, r.t): r.aggregate for r in semantic.aggregate_vectors(df, "s", "t").collect()}[1, 3] == [2.0, 4.0, 0.0]


def test_trajectory_lift(spark):
    row = (0.0, 0.4, 0.0, "benign", 0.9, 0.1, False)
    df = spark.createDataFrame([(*row, 0.70), (*row, 0.95), (*row, None)], "attack_score double, aggregate_drift double, acceleration double, phase string, confidence double, distance double, suspicious boolean, aggregate_similarity double")
    got = [(round(r.risk, 9), r.block) for r in semantic.trajectory_risk(df).collect()]
    assert got == [(0.1, False), (0.76, True), (0.1, False)]
    assert semantic.trajectory_risk(df.drop("aggregate_similarity")).agg(F.max("risk")).first()[0] == pytest.approx(0.1)
