"""Solvers on graphs against dense or plain versions of the same."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twigspark.operators import geodesic, graphs, heat, joins, shoots, sparse, transport
from twigspark.plans import catalog, runs


def path(n):
    i = np.arange(n - 1)
    k = np.arange(n)
    root = np.sqrt(np.where((k == 0) | (k == n - 1), 1, 2))
    exact = root[:, None] * np.cos(np.pi * k[:, None] * np.arange(9) / (n - 1))
    return i, i + 1, 1 - np.cos(np.pi * np.arange(9) / (n - 1)), exact / np.linalg.norm(exact, axis=0)


@pytest.mark.parametrize("n", [40, 1000, 4000])
def test_smallest_vectors_of_a_long_path(n):
    i, j, values, exact = path(n)
    got, v, off = sparse.smallest(i, j, np.ones(n - 1), n, 9)
    assert np.allclose(got, values, atol=1e-12) and off.max() < 1e-9
    assert np.linalg.svd(exact.T @ v)[1].min() > 1 - 1e-9
    assert np.abs(v.T @ v - np.eye(9)).max() < 1e-9


def test_factor_solves_sparse_and_dense_parts():
    r = np.random.default_rng(2)
    n = 300
    i, j = np.nonzero(np.triu(r.random((n, n)) < np.where(np.arange(n) < 100, 0.9, 0.01), 1))
    v = -r.random(len(i))
    m = np.zeros((n, n))
    m[i, j] = m[j, i] = v
    d = 1 - m.sum(axis=1)
    b = r.random((n, 3))
    f = sparse.Factor(d, i, j, v)
    assert len(f.core) and f.steps
    assert np.allclose(f.solve(b), np.linalg.solve(m + np.diag(d), b))


def test_distances_equal_dijkstra():
    r = np.random.default_rng(3)
    for n in (2, 30, 200):
        xy = r.random((n, 2)) * 60
        e = [(a, b, math.dist(xy[a], xy[b])) for a in range(n) for b in range(a + 1, n) if math.dist(xy[a], xy[b]) <= 6]
        a, b, w = (np.array(x) for x in zip(*e, strict=True)) if e else (np.zeros(0, int),) * 3
        nodes = np.sort(r.choice(n, max(1, n // 4), replace=False))
        got = geodesic.distances(nodes, a, b, w)
        dense = transport.geodesic(xy, nodes, 6.0)[:, nodes]
        linked = np.isfinite(got)
        assert np.allclose(got[linked], dense[linked])
        assert all(dense[k, m] >= dense[linked].max() for k, m in zip(*np.nonzero(~linked), strict=True))


def test_paths_by_joins_equal_the_kernel(spark):
    rows = [(1, k, float(k), math.sin(k / 9) * 4) for k in range(90)] + [(1, 1000 + k, 40.0 + k / 2, 20.0 + k) for k in range(30)] + [(2, k, float(k), 0.0) for k in range(20)]
    p = spark.createDataFrame(rows, "image_id long, ord long, x double, y double")
    nodes = p.where("ord % 37 = 0 or ord = 1029")
    want = geodesic.geodesics(p, nodes, 3.0).collect()
    got = geodesic.geodesics(p, nodes, 3.0, few=200).collect()
    key = lambda rows: sorted((r.image_id, r.a, r.b, round(r.distance, 9)) for r in rows)
    assert key(got) == key(want) and {r.image_id for r in got} == {1}
    assert geodesic.contracted(geodesic.pixel_edges(p, 3.0), nodes, 200).groupBy("image_id").count().agg(F.max("count")).first()[0] <= 200


def plain_nodes(xy, target):
    n = len(xy)
    if n <= target:
        return list(range(n))
    x0, y0 = min(x for x, _ in xy), min(y for _, y in xy)
    span = max(max(x for x, _ in xy) - x0, max(y for _, y in xy) - y0, 1.0)
    low, high = span / (target * 4.0), span / 2.0
    for _ in range(20):
        size = 0.5 * (low + high)
        cells = {}
        for k, (x, y) in enumerate(xy):
            cells.setdefault((math.floor((x - x0) * (1.0 / size)), math.floor((y - y0) * (1.0 / size))), []).append(k)
        if len(cells) > target * 1.1:
            low = size
        elif len(cells) < target * 0.9:
            high = size
        else:
            break
    return sorted(g[len(g) // 2] for g in cells.values())


def test_nodes_of_each_image(spark):
    r = random.Random(5)
    images = {1: [(r.random() * 9, r.random() * 900) for _ in range(700)], 2: [(k / 10, 5.0) for k in range(400)], 3: [(1.0, 1.0)] * 70, 4: [(float(k), 0.0) for k in range(30)], 5: [(r.gauss(0, 1) ** 3, r.gauss(0, 1) ** 3) for _ in range(500)]}
    p = spark.createDataFrame([(i, k, x, y) for i, xy in images.items() for k, (x, y) in enumerate(xy)], "image_id long, ord long, x double, y double")
    got = {}
    for row in heat.sampled(p, 50).collect():
        got.setdefault(row.image_id, []).append(row.ord)
    assert {i: sorted(v) for i, v in got.items()} == {i: plain_nodes(xy, 50) for i, xy in images.items()}


def test_nearest_by_expansion_equals_all_pairs(spark):
    r = random.Random(6)
    points, targets = [], []
    for image, (n, scale) in {1: (80, 1.0), 2: (200, 500.0), 3: (5, 10.0), 4: (60, 0.0)}.items():
        points += [(image, k, r.gauss(0, 2) * scale, r.gauss(0, 2) * scale) for k in range(40)]
        targets += [(image, k % 5, k, round(r.gauss(0, 1) * scale, 1), round(r.gauss(0, 1) * scale, 1)) for k in range(n)]
    points += [(2, 900, 1e6, -1e6), (7, 1, 0.0, 0.0)]
    f, p = spark.createDataFrame(points, "image_id long, id long, x double, y double"), spark.createDataFrame(targets, "image_id long, branch_id long, ord long, x double, y double")
    f, p = f.repartition(3), p.repartition(3)
    odd = f.unionByName(spark.createDataFrame([(2, 901, float("nan"), 0.0), (2, 902, float("inf"), 0.0)], f.schema))
    by = {}
    for i, b, o, x, y in targets:
        by.setdefault(i, []).append((b, o, x, y))
    want, kth, of_branches = {}, {}, {}
    for i, k, x, y in points:
        near = sorted(((tx - x) ** 2 + (ty - y) ** 2, o, b) for b, o, tx, ty in by.get(i, []))
        if near:
            want[i, k] = near[0][1]
            kth[i, k] = [o for _, o, _ in near[:4]]
            least = {}
            for d, _, b in near:
                least.setdefault(b, d)
            of_branches[i, k] = [b for _, b in sorted((d, b) for b, d in least.items())[:3]]
    assert {(x.image_id, x.id): x.ord for x in joins.nearest(odd, p).collect()} == want

    def ranks(df, c):
        out = {}
        for x in df.orderBy("rank").collect():
            out.setdefault((x.image_id, x.id), []).append(x[c])
        return out

    assert ranks(joins.knn_targets(f, p, 4), "ord") == kth
    assert ranks(joins.knn_branches(f, p, 3), "branch_id") == of_branches


def tree(tmp_path):
    """Four horizontal branches and flowers near them; the readers number pixels and flowers from 0."""
    branches = [{"id": b, "pixels": [[200 + 60 * b, x] for x in range(60)]} for b in range(4)]
    name = "imgs_frame3_00000"
    (tmp_path / f"{name}_graph.json").write_text(json.dumps({"image": f"{name}.png", "nodes": [], "edges": [], "branches": branches}))
    flowers = [[3 + 5.5 * k, 200 + 60 * b - 3] for b in range(4) for k in range(10)]
    (tmp_path / "frame3.json").write_text(json.dumps({"shapes": [{"label": "flower", "points": [p]} for p in flowers]}))
    return [b for b in range(4) for _ in range(10)]


@pytest.mark.parametrize("name", sorted({*catalog.METHODS} - {"lsystem"}))
def test_every_method_on_files(spark, tmp_path, name):
    want = tree(tmp_path)
    flowers, pixels, _ = runs.load(spark, str(tmp_path / "*_graph.json"), str(tmp_path / "frame*.json"))
    got = {r.id: r.branch_id for r in catalog.methods(1.0, 7.0, 2.0)[name](flowers, pixels).collect()}
    # The flowers stand along the branches, not in shoots: what reconstructs shoots gives each a branch, but not always the nearest.
    assert len(got) == len(want) and (name in ("clusters", "rays") or got == dict(enumerate(want)))


def test_walk_by_components_equals_the_dense_solve(spark):
    r = random.Random(8)
    f = spark.createDataFrame([(i, k, r.random() * 900, r.random() * 900) for i in (1, 2) for k in range(60)], "image_id long, id long, x double, y double")
    p = spark.createDataFrame([(i, k % 4, k, r.random() * 900, r.random() * 900) for i in (1, 2) for k in range(80)], "image_id long, branch_id long, ord long, x double, y double")
    t = graphs.transitions(graphs.branch_weights(f, p), graphs.point_weights(f)).toPandas()
    want = {}
    for image, x in t.groupby("image_id"):
        q, b = np.zeros((60, 60)), np.zeros((60, 4))
        for s in x.itertuples():
            if pd.isna(s.branch_id):
                q[s.i, int(s.j)] += s.p
            else:
                b[s.i, int(s.branch_id)] += s.p
        solved = np.linalg.solve(np.eye(60) - q, b)
        for k, row in enumerate(solved / solved.sum(axis=1, keepdims=True)):
            want[image, k] = (int(row.argmax()), float(row.max()))
    for kernel in (1000, 10):  # one kernel for each component, or by joins
        got = graphs.random_walk(f, p, kernel_points=kernel).collect()
        assert len(got) == 120 and max(x.residual for x in got) < 1e-8
        for x in got:
            assert x.branch_id == want[x.image_id, x.id][0] and x.probability == pytest.approx(want[x.image_id, x.id][1], abs=1e-7)


def test_branch_scores_are_optimal():
    r = np.random.default_rng(9)
    for n in (1, 2, 12):
        w = pd.DataFrame([(k, b, r.random()) for k in range(30) for b in r.choice(n, min(3, n), replace=False)], columns=["id", "branch_id", "w"])
        e = pd.DataFrame([(k, k + 1) for k in range(n - 1)], columns=["a", "b"])
        branches, u, off = graphs.branch_scores(w, e, 1.0)
        # The same Laplacian as a matrix, and the gradient from it.
        m = np.zeros((n, n))
        for a, b in e.itertuples(index=False):
            m[a, b] = m[b, a] = 1
        for _, g in w.groupby("id"):
            i, x = g["branch_id"].to_numpy(), g["w"].to_numpy()
            m[np.ix_(i, i)] += np.outer(x, x) / x.sum()
        np.fill_diagonal(m, 0)
        s = np.exp(u - u.max(axis=1, keepdims=True))
        gradient = (s / s.sum(axis=1, keepdims=True) - np.eye(n)) / n + (np.diag(m.sum(axis=1)) - m) @ u
        assert len(branches) == n and np.abs(gradient).max() < 1e-8 and off < 1e-8


def test_methods_are_compared_on_one_image(spark):
    p = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(300)], "image_id long, ord long, x double, y double")
    at = lambda k, name: p.select("image_id", "ord", F.when(F.col("ord") == k, 1.0).otherwise(0.0).alias("heat"), F.lit(name).alias("method"))
    fields = at(0, "same").unionByName(at(100, "off")).unionByName(at(-1, "empty"))
    got = {r.method: r for r in transport.compared(at(0, "x").drop("method"), fields, p, spark.createDataFrame([(1, 2.0)], "image_id long, px_per_cm double"), 60).collect()}
    assert got["same"].wasserstein_px == pytest.approx(0, abs=1e-6) and got["same"].similarity == pytest.approx(1)
    assert got["off"].wasserstein_px == pytest.approx(100, rel=0.08) and got["off"].wasserstein_cm == pytest.approx(got["off"].wasserstein_px / 2)
    assert got["empty"].note == "no mass" and (got["empty"].similarity is None or math.isnan(got["empty"].similarity))
    assert 54 <= got["off"].nodes <= 66 and got["off"].diameter_cm == got["off"].diameter_px / 2


def points_in_lines(r, n):
    out = []
    while len(out) < n:
        x, y, turn = r.random() * 200, r.random() * 200, r.random() * 7
        out += [(x + 4 * k * math.cos(turn) + r.gauss(0, 0.5), y + 4 * k * math.sin(turn) + r.gauss(0, 0.5)) for k in range(r.randint(1, 9))]
    return out[:n] + out[:3]  # with points at one place


def test_lines_grown_sparsely_are_those_of_the_dense_version():
    r = random.Random(11)
    for n in (0, 1, 5, 60, 200):
        for grow, seed in ((7.0, 6.0), (5.0, 9.0)):
            xy = np.array(points_in_lines(r, n)).reshape(-1, 2) if n else np.zeros((0, 2))
            dense, sparsely = shoots.grown_labels(xy, grow, 18.0, seed), shoots.grown_sparsely(xy, grow, 18.0, seed)
            sets = lambda x: {frozenset(np.flatnonzero(x == k).tolist()) for k in set(x.tolist())}
            assert sets(dense) == sets(sparsely)


def test_lines_by_components(spark):
    r = random.Random(12)
    images = {i: points_in_lines(r, 80) for i in (1, 2)}
    f = spark.createDataFrame([(i, k, x, y) for i, xy in images.items() for k, (x, y) in enumerate(xy)], "image_id long, id long, x double, y double")
    got = {}
    for x in shoots.directional(f.repartition(3), 7.0, 18.0, 6.0).collect():
        got.setdefault((x.image_id, x.cluster), set()).add(x.id)
    for i, xy in images.items():
        dense = shoots.grown_labels(np.array(xy), 7.0, 18.0, 6.0)
        assert {frozenset(v) for (j, _), v in got.items() if j == i} == {frozenset(np.flatnonzero(dense == k).tolist()) for k in set(dense.tolist())}
        assert sorted(c for j, c in got if j == i) == list(range(len(set(dense.tolist()))))
