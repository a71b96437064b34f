import math
import pickle
import random

import numpy as np

from graphloom.llm import neighbours
from tests.llm.helpers import table_dir

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=20, top=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            out[i] = sorted(((-float(v @ w), j) for j, w in good if j != i))[:top]
    return out


def recall(spark, folder, rows):
    want, got = brute(rows), {}
    for r in neighbours.op5_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {q for q in want if want[q]}
    hit = total = 0
    score = {q: {j: -s for s, j in brute_all} for q, brute_all in brute(rows, top=10**9).items()}
    for q, x in got.items():
        x.sort()
        assert [r for r, *_ in x] == list(range(1, len(want[q]) + 1))
        assert all(math.isclose(s, score[q][j], rel_tol=1e-12, abs_tol=1e-12) for _, j, s in x)
        hit += len({j for _, j, _ in x} & {j for _, j in want[q]})
        total += len(want[q])
    return hit / max(total, 1)


def table(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]


def test_query_is_exact_on_a_small_table(spark):
    folder = "/root/testdata/sf0.001"
    assert recall(spark, folder, table(spark, folder)) == 1.0


def test_recall_at_the_registered_settings(spark):
    folder = "/root/testdata/sf0.1"
    assert 2000 / neighbours.LEAF >= 2  # there are trees, so leaves can be skipped
    assert recall(spark, folder, table(spark, folder)) >= 0.9


def test_recall_with_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 60)
    folder = "/root/testdata/sf0.1"
    assert recall(spark, folder, table(spark, folder)) >= 0.9


def test_forest_needs_no_module_of_ours():
    points = np.random.default_rng(1).normal(size=(200, 8))
    assert b"graphloom" not in pickle.dumps(neighbours.grow(points, 3))


def test_priority_queue_visits_by_margin():
    points = np.random.default_rng(2).normal(size=(400, 8))
    forest = neighbours.grow(points, 4)
    normals, cuts = forest
    for q in points[:20]:
        order = neighbours.visits(forest, q, 10**6)
        assert sorted(order) == list(range(neighbours.TREES * 16))
        missed = []
        for cell in order:
            t, leaf = divmod(cell, 16)
            node, worst = leaf + 15, 0.0
            while node:
                up = (node - 1) // 2
                m = float(normals[t, up] @ q - cuts[t, up])
                if (node == 2 * up + 2) != (m > 0):
                    worst = max(worst, abs(m))
                node = up
            missed.append(worst)
        assert missed == sorted(missed)


def test_doubles_keep_their_precision_and_ties_go_to_the_smaller_id(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in (9, 3, 5)] + [(200, [2 * x for x in rows[7][1]])]
    folder = table_dir(tmp_path, spark, "embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    vectors = {i: np.array(v) for i, v in rows}
    for r in neighbours.op5_neighbours(spark, folder).collect():
        assert math.isclose(r.score, float(vectors[r.query_id] @ vectors[r.vec_id]), rel_tol=1e-14, abs_tol=1e-14)
    got = [r.vec_id for r in sorted(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=200).collect(), key=lambda r: r.rank) if r.query_id == 200]
    assert got[:4] == [7, 103, 105, 109]


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0], i, "x") for i in range(50)], "vec_id long, embedding array<float>, node int, `a.b` string")
    assert neighbours.nearest(df).count() == 3 * 20


def test_awkward_and_empty(spark, tmp_path):
    rng = random.Random(2)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    same = vec()
    rows = [(i, same, 0) for i in range(0, 90)] + [(i, vec(), 0) for i in range(100, 130)]
    rows += [(200, None, 0), (220, [0.0] * 8, 0), (240, [float("nan")] + [1.0] * 7, 0), (260, [None] + [1.0] * 7, 0), (None, vec(), 0), (280, [float("inf")] * 8, 0), (300, [], 0)]
    folder = table_dir(tmp_path / "a", spark, "embeddings", spark.createDataFrame(rows, SCHEMA))
    assert recall(spark, folder, rows) == 1.0
    empty = table_dir(tmp_path / "b", spark, "embeddings", spark.createDataFrame([], SCHEMA))
    assert neighbours.op5_neighbours(spark, empty).count() == 0
    one = table_dir(tmp_path / "c", spark, "embeddings", spark.createDataFrame([(0, same, 1)], SCHEMA))
    assert neighbours.op5_neighbours(spark, one).count() == 0
