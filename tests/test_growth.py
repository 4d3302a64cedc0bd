"""Results of steps that work in another way on large images, and what queries take as their whole job."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twigspark.operators import evaluate, geodesic, graphs, heat, hierarchy, joins, raster, rays, shoots
from twigspark.plans import catalog, spaces
from twigspark.plans.catalog import ORACLES, QUERIES

from .test_catalog import rows


def test_walk_takes_the_labelled_space_as_one_image(spark):
    """Flowers whose nearest others lie beyond 250 vectors walk there too."""
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    assert "vec_id // 250" not in ORACLES["random_walk_iter5"]
    assert rows(QUERIES["random_walk_iter5"](spark, "/root/testdata/sf0.01").toPandas()) == rows(con.execute(ORACLES["random_walk_iter5"]).fetchdf())


def plain(f, p):
    """All pairs of an image: {(image, id): [(d2, ord, branch), ...]} in order."""
    out = {}
    for i, k, x, y in f:
        out[i, k] = sorted((float((x - u) * (x - u) + (y - v) * (y - v)), o, b) for j, b, o, u, v in p if i == j)
    return out


@pytest.mark.parametrize("limit", [10**6, 60, 0])
def test_kernels_and_grids_give_the_same(spark, monkeypatch, limit):
    """Images of 20, 40 and 80 targets with many ties: all in kernels, some, none."""
    monkeypatch.setattr(joins, "KERNEL_TARGETS", limit)
    g = np.random.default_rng(7)
    p = [(i, int(g.integers(1, 6)), 1000 * i + k, *map(float, g.integers(0, 12, 2))) for i in (1, 2, 3) for k in range(10 << i)]
    f = [(i, 1000 * i + 500 + k, *map(float, g.integers(-2, 14, 2))) for i in (1, 2, 3, 4) for k in range(15)]
    fs, ps = spark.createDataFrame(f, "image_id long, id long, x double, y double"), spark.createDataFrame(p, "image_id long, branch_id long, ord long, x double, y double")
    all_pairs = {k: v for k, v in plain(f, p).items() if v}
    first = {k: v[0] for k, v in all_pairs.items()}
    assert {(r.image_id, r.id): (r.distance, r.ord, r.branch_id) for r in joins.nearest(fs, ps).collect()} == {k: (d**0.5, o, b) for k, (d, o, b) in first.items()}
    assert {(r.image_id, r.id): (r.distance, r.ord) for r in joins.radius_nearest(fs, ps, 1.0).collect()} == {k: (d**0.5, o) for k, (d, o, _) in first.items() if d <= 1}
    least = {k: {b: min(d for d, _, c in v if c == b) ** 0.5 for b in {c for _, _, c in v}} for k, v in all_pairs.items()}
    assert {(r.image_id, r.id, r.branch_id): r.distance for r in joins.min_distance_matrix(fs, ps).collect()} == {(*k, b): d for k, v in least.items() for b, d in v.items()}
    ranks = {(*k, n + 1): (b, d) for k, v in least.items() for n, (d, b) in enumerate(sorted((d, b) for b, d in v.items())[:3])}
    assert {(r.image_id, r.id, r["rank"]): (r.branch_id, r.distance) for r in joins.knn_branches(fs, ps, 3).collect()} == ranks
    two = {(*k, n + 1): o for k, v in all_pairs.items() for n, (_, o, _) in enumerate(v[:2])}
    assert {(r.image_id, r.id, r["rank"]): r.ord for r in joins.knn_targets(fs, ps, 2).collect()} == two
    q = ps.select("image_id", F.col("ord").alias("id"), "x", "y")
    others = plain([(i, o, x, y) for i, _, o, x, y in p], p)
    want = {(*k, n + 1): o for k, v in others.items() for n, (_, o, _) in enumerate([r for r in v if r[1] != k[1]][:4])}
    assert {(r.image_id, r.id, r["rank"]): r.other for r in joins.knn_points(q, 4).collect()} == want
    mine = fs.withColumn("branch_id", F.col("id") % 5 + 1)
    got = joins.nearest_within(mine, ps.withColumn("section_id", F.col("ord") % 7)).collect()
    want = {(k, 1 + k % 5): min((d, o % 7) for d, o, b in v if b == 1 + k % 5) for (_, k), v in all_pairs.items() if any(b == 1 + k % 5 for _, _, b in v)}
    assert {(r.id, r.branch_id): (r.distance**2, r.section_id) for r in got} == {k: (pytest.approx(d), s) for k, (d, s) in want.items()}


def test_points_without_coordinates_keep_their_rows_of_the_matrix(spark):
    f = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, float("inf"), 0.0), (1, 3, 3.0, 4.0)], "image_id long, id long, x double, y double")
    p = spark.createDataFrame([(1, 7, 1, 0.0, 0.0), (1, 8, 2, None, 0.0)], "image_id long, branch_id long, ord long, x double, y double")
    got = {(r.id, r.branch_id): r.distance for r in joins.min_distance_matrix(f, p).collect()}
    assert got == {(1, 7): None, (1, 8): None, (2, 7): float("inf"), (2, 8): float("inf"), (3, 7): 5.0, (3, 8): None}


@pytest.mark.parametrize("limit", [10**6, 50, 0])
def test_adjacency_and_bridges_widen_in_large_images(spark, monkeypatch, limit):
    """Branches that touch early, late and never; images of 40 and 80 pixels."""
    monkeypatch.setattr(joins, "KERNEL_TARGETS", limit)
    g = np.random.default_rng(3)
    p = [(i, b, 1000 * i + 100 * b + k, float(x), float(y)) for i, n in ((1, 10), (2, 20)) for b, at in ((1, 0), (2, 1), (3, 9), (4, 60)) for k, (x, y) in enumerate(g.integers(0, 5, (n, 2)) + [at, 0])]
    ps = spark.createDataFrame(p, "image_id long, branch_id long, ord long, x double, y double")
    least = {}
    for i, a, u, x, y in p:
        for j, b, v, z, w in p:
            if i == j and a != b:
                least[i, a, b] = min(least.get((i, a, b), (np.inf,)), ((x - z) ** 2 + (y - w) ** 2, u, v))
    near = {k for k, m in least.items() if k[1] < k[2] and m[0] <= 49}
    assert {tuple(r) for r in hierarchy.adjacency(ps, 7.0).collect()} == near
    edges = [k for k in least if k[1] < k[2]] + [(2, 4, 1)]
    got = hierarchy.bridges(spark.createDataFrame(edges, "image_id long, a long, b long"), ps).collect()
    assert {(r.image_id, r.a, r.b): (r.distance, r.pixel_a, r.pixel_b) for r in got} == {k: (least[k][0] ** 0.5, *least[k][1:]) for k in edges} and len(got) == len(edges)


def test_masks_are_drawn_from_middle_cells(spark):
    """A row for each cell before it is spread, not nine; beyond the image all falls on the border."""
    cells = [(1, 0, 0), (1, 9, 4), (1, -1, 7), (1, 5, 10), (1, 10, 10)]
    got = raster.drawn(spark.createDataFrame(cells, "image_id long, x int, y int"), 10, 10, spread=1).first()
    want = np.zeros((10, 10), "u1")
    for _, x, y in cells:
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                want[min(max(y + j, 0), 9), min(max(x + i, 0), 9)] = 255
    assert got.data == want.tobytes()


def test_paths_by_many_rounds_keep_no_estimates(spark):
    """A line of 300 pixels takes some ten rounds by joins; Spark's estimate of the result, which checkpoints multiply in each, stays near the size of its files."""
    p = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(300)], "image_id long, ord long, x double, y double")
    nodes = p.where("ord in (0, 150, 299)")
    left = geodesic.contracted(geodesic.pixel_edges(p, 1.0), nodes, 2)
    assert sorted((r.a, r.b, r.w) for r in left.collect()) == [(0, 150, 150.0), (150, 299, 149.0)]
    assert left._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000


def test_branches_that_nothing_touches_are_nodes(spark):
    """Of five branches a point hangs on three, an edge joins a fourth; the fifth is a label as well, and its score of itself is the largest."""
    p = [(1, b, b, 100.0 * b, 0.0) for b in range(5)] + [(2, 7, 9, 0.0, 0.0)]
    ps = spark.createDataFrame(p, "image_id long, branch_id long, ord long, x double, y double")
    f, edges = spark.createDataFrame([(1, 1, 90.0, 0.0), (3, 1, 0.0, 0.0)], "image_id long, id long, x double, y double"), spark.createDataFrame([(1, 2, 3)], "image_id long, a long, b long")
    u = graphs.laplacian_scores(f, ps, edges)
    got = {(r.branch_id, r.label): r.score for r in u.where("image_id = 1").collect()}
    assert {*got} == {(a, b) for a in range(5) for b in range(5)} and all(got[4, 4] > got[4, b] for b in range(4))
    g = graphs.score_gradients(u, graphs.branch_weights(f, ps), edges).where("image_id = 1").toPandas()
    assert len(g) == 25 and g.gradient.abs().max() < 1e-7
    assert [(r.image_id, r.id, r.branch_id) for r in graphs.laplacian(f, ps, edges).collect()] == [(1, 1, 1)]


def test_scores_of_an_image_with_few_points(spark, tmp_path):
    """The last image of a table whose rows aren't a multiple of 250: its one flower is near three of its four branches."""
    con = duckdb.connect()
    con.execute(f"copy (select * from '/root/testdata/sf0.001/embeddings.parquet' where vec_id < 255 or vec_id >= 500) to '{tmp_path}/embeddings.parquet'")
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    got = rows(QUERIES["laplacian_optimality"](spark, str(tmp_path)).toPandas())
    assert got == rows(con.execute(ORACLES["laplacian_optimality"]).fetchdf()) and len(got[1]) == 2


def test_nodes_by_kernels_equal_those_by_joins(spark, monkeypatch):
    """Images that are sparse, dense, on one spot, small, and without coordinates; no row of a kernel's image is multiplied."""
    g = np.random.default_rng(5)
    p = [(i, 1000 * i + k, float(x), float(y)) for i, n, w in ((1, 300, 50), (2, 400, 3), (3, 80, 1), (4, 20, 9), (5, 200, 900)) for k, (x, y) in enumerate(g.integers(0, w, (n, 2)) / 4)] + [(6, k, None if k % 9 else 1.0, 2.0) for k in range(100)]
    df = spark.createDataFrame(p, "image_id long, ord long, x double, y double")
    assert "Generate" not in heat.sampled(df.where("image_id < 6"), 40)._jdf.queryExecution().toString()
    both = []
    for limit in (250, 0):
        monkeypatch.setattr(heat, "KERNEL_PIXELS", limit)
        both.append(sorted((r.image_id, r.ord) for r in heat.sampled(df, 40).collect()))
    assert both[0] == both[1] and len({i for i, _ in both[0]}) == 6


@pytest.mark.parametrize("limit", [10**6, 600, 0])
def test_rays_compete_alike_in_kernels_and_by_cells(spark, monkeypatch, limit):
    """Images of 24 x 10 and 24 x 40 pairs of origins and clusters: all in kernels, some, none; a cluster without length and one without coordinates."""
    monkeypatch.setattr(rays, "KERNEL_PAIRS", limit)
    g = np.random.default_rng(5)
    o = [(i, 100 * i + k, k % 4, *map(float, g.uniform(0, 60, 2)), float(np.sin(a)), -float(np.cos(a))) for i in (1, 2, 3) for k, a in enumerate(g.uniform(-1, 1, 24))]
    s = [(i, k, *map(float, np.r_[at, at + v])) for i, n in ((1, 10), (2, 40), (4, 3)) for k, (at, v) in enumerate(zip(g.uniform(0, 60, (n, 2)), g.uniform(-9, 9, (n, 2)), strict=True))]
    s += [(1, 50, 5.0, 5.0, 5.0, 5.0), (1, 51, None, 5.0, 5.0, 9.0), (1, 52, float("nan"), 5.0, 5.0, 9.0)]
    origins, segments = spark.createDataFrame(o, "image_id long, ord long, branch_id long, x double, y double, nx double, ny double"), spark.createDataFrame(s, "image_id long, cluster long, ax double, ay double, bx double, by double")
    found = lambda df: {(r.image_id, r.cluster): (r.ord, r.branch_id, *[pytest.approx(r[c], abs=1e-9) for c in ("ox", "oy", "hx", "hy", "score")]) for r in df.collect()}
    want = found(rays.winners(rays.ray_fan(origins), segments, 30.0))
    got = {(r.image_id, r.cluster): tuple(r)[2:] for r in rays.competed(origins, segments, 30.0).collect()}
    assert len(want) > 30 and got == want


@pytest.mark.parametrize("limit", [10**6, 60, 0])
def test_lines_grow_alike_by_image_and_by_component(spark, monkeypatch, limit):
    monkeypatch.setattr(shoots, "KERNEL_POINTS", limit)
    g = np.random.default_rng(6)
    xy = {i: g.uniform(0, 60, (n, 2)) for i, n in ((1, 40), (2, 90))}
    f = spark.createDataFrame([(i, k, float(x), float(y)) for i, v in xy.items() for k, (x, y) in enumerate(v)], "image_id long, id long, x double, y double")
    got = {}
    for r in shoots.directional(f, 7.0, 18.0, 6.0).collect():
        got.setdefault((r.image_id, r.cluster), set()).add(r.id)
    for i, v in xy.items():
        dense = shoots.grown_labels(v, 7.0, 18.0, 6.0)
        assert {frozenset(x) for (j, _), x in got.items() if j == i} == {frozenset(np.flatnonzero(dense == k).tolist()) for k in set(dense.tolist())}


def test_images_of_heavy_kernels_keep_their_partitions(spark):
    """Few bytes aren't merged into one task."""
    df = joins.dealt(spark.range(40).selectExpr("id image_id", "id"))
    assert len({r.part for r in df.groupBy("image_id").applyInPandas(lambda t: t, "image_id long, id long").select(F.spark_partition_id().alias("part")).collect()}) > 1


def test_hybrids_take_what_their_methods_solved(spark, monkeypatch):
    """method_accuracy solves each method once, and scores hybrids as the registry's own."""
    names = ("laplacian", "random_walk")
    every = {n: m for n, m in catalog.METHODS.items() if n in names or n in catalog.HYBRIDS}
    f, p = spaces.several(spark, "/root/testdata/sf0.001")
    truth = evaluate.true_branches(f, p)
    want = {n: evaluate.macro(evaluate.accuracy(every[n](f, p).withColumn("method", F.lit(n)), truth)).first().accuracy for n in catalog.HYBRIDS}
    calls = []
    monkeypatch.setattr(catalog, "METHODS", {n: lambda f, p, n=n, m=m: calls.append(n) or m(f, p) for n, m in every.items()})
    got = {r.method: r.accuracy for r in QUERIES["method_accuracy"](spark, "/root/testdata/sf0.001").collect()}
    assert sorted(calls) == ["laplacian", "random_walk"]
    assert {n: got[n] for n in want} == {n: pytest.approx(v, abs=1e-6) for n, v in want.items()}
