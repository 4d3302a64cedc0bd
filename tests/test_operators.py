"""Hand-computed fixtures and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twigspark.operators import cluster, counts, evaluate, fit, graphs, heat, hierarchy, joins, lsystem, raster, rays, shoots, skeleton, transport
from twigspark.operators.components import components, levels
from twigspark.sources import files
from twigspark.streaming import arrivals


def pts(spark, rows, **more):
    return spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(rows)], "image_id long, id long, x double, y double")


def pix(spark, rows):
    """rows: (branch, x, y)."""
    return spark.createDataFrame([(1, k, b, float(x), float(y)) for k, (b, x, y) in enumerate(rows)], "image_id long, ord long, branch_id long, x double, y double")


def test_calibration(spark):
    of = lambda rows: fit.px_per_cm(pix(spark, rows)).first().px_per_cm
    assert of([(0, 0, 0), (0, 0, 700)]) == 2.0 and of([(0, 0, 0)]) == 1.0 and of([(0, 0, 0), (0, 0, 1)]) == 1.0


def test_nearest_and_ties(spark):
    f, p = pts(spark, [(0, 0)]), pix(spark, [(0, 3, 0), (1, 0, 3)])
    for r in (joins.nearest(f, p).first(), joins.nearest_by_rings(f, p, 1.0).first()):
        assert (r.branch_id, r.distance) == (0, 3.0)


def test_rings_equal_all_pairs(spark):
    r = np.random.default_rng(0)
    f, p = pts(spark, r.normal(size=(60, 2)) * 100), pix(spark, [(int(k % 5), *v) for k, v in enumerate(r.normal(size=(300, 2)) * 40)])
    assert sorted(map(tuple, joins.nearest(f, p).collect())) == sorted(map(tuple, joins.nearest_by_rings(f, p, 2.0).collect()))


def test_ratio(spark):
    m = spark.createDataFrame([(1, 1, 0, 2.0), (1, 1, 1, 3.0), (1, 2, 0, 2.0), (1, 2, 1, 4.0), (1, 3, 0, 5.0)], "image_id long, id long, branch_id long, distance double")
    got = {r.id: (r.nearest, r.ratio) for r in counts.ambiguity(m).collect()}
    assert [got[k][0] for k in (1, 2, 3)] == [False, True, True] and math.isinf(got[3][1])


def test_random_walk(spark):
    t = spark.createDataFrame([(1, 7, 0, None, 0.75), (1, 7, 1, None, 0.25)], "image_id long, i long, branch_id long, j long, p double").toPandas()
    got = graphs._absorb(t).iloc[0]
    assert got.branch_id == 0 and got.probability == pytest.approx(0.75)


def test_walk_converges_to_the_solution(spark):
    r = np.random.default_rng(1)
    f, p = pts(spark, r.normal(size=(12, 2)) * 50), pix(spark, [(int(k % 3), *v) for k, v in enumerate(r.normal(size=(30, 2)) * 50)])
    t = graphs.transitions(graphs.branch_weights(f, p), graphs.point_weights(f)).cache()
    solved = {r.id: r.probability for r in graphs.random_walk(f, p).collect()}
    best = {r.id: r.f for r in graphs.walk_steps(t, 12).groupBy("id").agg(F.max("f").alias("f")).collect()}
    assert all(best[k] <= solved[k] + 1e-6 for k in solved)


def test_line_fits(spark):
    one = fit.line_fit(pts(spark, [(5, 5)]), ["image_id"]).first()
    assert (one.ux, one.uy, one.vx, one.vy) == (0.0, -1.0, 1.0, 0.0)
    s = fit.shoots(pts(spark, [(0, 0), (0, 1), (0, 2)]), ["image_id"]).first()
    assert (s.ux, s.uy, s.t_min, s.t_max, s.rms, s.bottom_x, s.bottom_y) == (0.0, 1.0, -1.0, 1.0, 0.0, 0.0, 2.0)


def test_clusters_by_half(spark):
    got = {r.id: r.cluster for r in cluster.aniso_components(pts(spark, [(0, 0), (0, 3), (2, 0), (0, 100)]), 4.0).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2}


def test_dbscan_noise_and_border(spark):
    got = {r.id: r.cluster for r in cluster.dbscan(pts(spark, [(0, 0), (0, 1), (0, 2), (0, 3), (50, 0)]), 1.0, 3, 1.0).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1}


def test_ray_hits(spark):
    ray = spark.createDataFrame([(1, 0.0, 0.0, 0.0, -1.0)], "image_id long, ox double, oy double, dx double, dy double")
    seg = spark.createDataFrame([(1, -1.0, -5.0, 1.0, -5.0), (1, 3.0, 0.0, 3.0, -9.0)], "image_id long, ax double, ay double, bx double, by double")
    (h,) = joins.ray_hits(ray, seg, 10.0).collect()
    assert (h.t, h.hx, h.hy, h.s) == (5.0, 0.0, -5.0, 0.5) and joins.ray_hits(ray, seg, 4.0).count() == 0


def test_bezier(spark):
    c = spark.createDataFrame([(0.0, 0.0, 0.0, -2.0, 2.0, -2.0)], "ox double, oy double, hx double, hy double, tx double, ty double")
    p = rays.smoothed(c, tension=0.0, samples=3).first().curve[1]
    assert (p.x, p.y) == (1.0, -1.0)


def test_heat(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 10), (1, None, 0.0, 5), (1, 0.0, 0.0, 0)], "image_id long, x double, y double, n int")
    assert heat.heat_field(b, pix(spark, [(0, 8, 0)]), 8.0).first().heat == pytest.approx(10 * math.exp(-0.5))


def test_trunk_and_levels(spark):
    b = spark.createDataFrame([(1, 0, 100, 9.0, 9.0), (1, 1, 100, 5.0, 5.0), (1, 2, 100, 4.0, 4.0), (1, 3, 20, 1.0, 1.0)], "image_id long, branch_id long, size_px long, avg_y double, max_y double")
    e = spark.createDataFrame([(1, 0, 3), (1, 0, 1), (1, 1, 2)], "image_id long, a long, b long")
    assert {r.branch_id for r in hierarchy.trunk(b, e).collect()} == {0, 3}
    n = spark.createDataFrame([(k,) for k in range(4)], "node long")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "a long, b long")
    assert {r.node: r.level for r in levels(n, e, n.where("node = 0")).collect()} == {0: 0, 1: 1, 2: 2, 3: -1}


def test_colour_key(spark):
    got = spark.range(1).select(hierarchy.quantised(F.lit(17), 25), hierarchy.quantised(F.lit(18), 25)).first()
    assert tuple(got) == (12, 24)


def test_pixel_classes(spark):
    p = spark.createDataFrame([(1, x, 0) for x in range(5)], "image_id long, x long, y long")
    got = [r["class"] for r in hierarchy.pixel_classes(p).collect()]
    assert sorted(got) == ["body"] * 3 + ["endpoint"] * 2


@pytest.mark.parametrize("few", [0, 5, 100_000])
def test_components(spark, monkeypatch, few):
    """By rounds alone, by rounds and one task, by one task; over plain, struct and repeated edges."""
    monkeypatch.setattr("twigspark.operators.components.FEW", few)
    edges = [(k, k + 1) for k in range(20)] + [(100, 101), (101, 102), (102, 101), (7, 7)]
    e = spark.createDataFrame(edges, "a long, b long")
    want = {k: 0 for k in range(21)} | {100: 100, 101: 100, 102: 100}
    assert {r.node: r.root for r in components(e).collect()} == want
    s = e.selectExpr("struct(struct(1 as image_id) as image_id, a as id) a", "struct(struct(1 as image_id) as image_id, b as id) b")
    assert {r.node.id: r.root.id for r in components(s).collect()} == want
    assert components(e.limit(0)).collect() == []


def test_lsystem(spark):
    s = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 2.0)], "x0 double, y0 double, theta double, kappa double, delta double")
    got = [(r.x, r.flower) for r in lsystem.forward(s, 3, 1).orderBy("node").collect()]
    assert got == [(0.0, False), (2.0, False), (4.0, True), (6.0, True)]
    true = np.array([3.0, 4.0, -1.2, 0.05])
    seen = lsystem.path(true[:2], true[2], true[3], 12, 5.0)[4:]
    assert lsystem.refined(seen, true + [2, -2, 0.2, -0.05], 12, 5.0, 4) == pytest.approx(true, abs=1e-6)


def test_transport():
    d = np.abs(np.subtract.outer(np.arange(5.0), np.arange(5.0)))
    a, b = np.array([1.0, 2, 3, 2, 1]), np.array([0.0, 0, 1, 2, 6])
    assert transport.divergence(a, a, d, 0.1) == 0.0 and transport.divergence(a, b, d, 0.1) == pytest.approx(np.abs(np.cumsum(a / a.sum() - b / b.sum())).sum(), rel=0.05)
    assert math.isnan(transport.sinkhorn(a * 0, b, d, 0.1))
    xy = np.array([[0.0, 0], [2, 0], [4, 0], [50, 0]])
    assert transport.geodesic(xy, np.array([0]), 3.0)[0].tolist() == [0, 2, 4, 8]


def test_accuracy(spark):
    p = spark.createDataFrame([(1, "m", 0, 5), (1, "m", 1, 6), (2, "m", 0, 1)], "image_id long, method string, id long, branch_id long")
    t = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (2, 0, 1), (2, 9, 1)], "image_id long, id long, true_branch long")
    s = evaluate.accuracy(p, t)
    assert {r.image_id: r.accuracy for r in s.collect()} == {1: 0.5, 2: 1.0} and evaluate.macro(s).first().accuracy == 0.75


def test_merge_keeps_cliques(spark):
    s = spark.createDataFrame([(1, k) for k in range(4)], "image_id long, shoot_id long")
    c = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 2, 2.0)], "image_id long, a long, b long, centre_distance double")
    assert {r.shoot_id: r.group_id for r in shoots.merge_groups(s, c).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_region_growing():
    line = np.array([[0, 0], [1, 1], [2, 2], [3, 3], [10, 0], [10, 1], [40, 40]], float)
    got = shoots.grown_labels(line, 2.0, 18.0, 2.0)
    assert len({*got[:4].tolist()}) == 1 and got[4] == got[5] != got[0] and got[6] not in got[:6]


def test_every_flower_has_a_branch(spark, sf):
    from twigspark.plans import spaces
    from twigspark.plans.catalog import METHODS

    f, p = spaces.labelled(spark, sf)
    for name in ("clusters", "rays", "lsystem"):
        got = METHODS[name](f, p)
        assert got.count() == f.count() == got.where("branch_id is not null").select("id").distinct().count()


def test_raster_kernels():
    m = np.zeros((20, 30), "u1")
    m[8:13, 3:27] = 200
    x = raster.binary(m)
    assert x.sum() == 120 and raster.binary(255 - m).sum() == 120
    assert raster.ellipse(3).tolist() == [[False, True, False], [True, True, True], [False, True, False]]
    d = raster.distance(x)
    assert d[8, 10] == 1.0 and d[10, 10] == 3.0
    t = raster.thinned(x)
    assert 15 <= t.sum() <= 30 and len(raster.endpoints(t)) == 2
    spur = np.zeros((20, 30), bool)
    spur[10, 2:28] = True
    spur[6:10, 15] = True
    assert not raster.pruned(spur, 6)[7, 15] and raster.pruned(spur, 3)[7, 15]
    gap = np.zeros((9, 20), bool)
    gap[4, 1:9] = gap[4, 10:19] = True
    filled = raster.repaired(gap)  # all three pixels between the parts lie equally far along the last step: the first in row order
    assert filled[3, 9] and raster.labelled(filled).max() == 1 and filled.sum() == gap.sum() + 1
    assert raster.features(m)["area_share"] == 120 / m.size


def test_tracing():
    on = {(x, 10) for x in range(21)} | {(10, y) for y in range(10)}
    b = skeleton.distinct_branches(skeleton.traced(on))
    assert len(b) == 3 and sorted(len(x["pixels"]) for x in b)[0] >= 9


def test_annotation_readers(spark, tmp_path):
    (tmp_path / "frame7.json").write_text('{"shapes": [{"label": "leaf", "points": [[1, 2]]}, {"label": "flower", "points": [[3, 4], [5, 6]]}, {"label": "flower", "points": []}, {"label": "flower", "points": [[7, 8]]}]}')
    got = files.flowers(files.read_json(spark, str(tmp_path / "frame*.json"), files.FLOWERS)).collect()
    assert [(r.frame, r.id, r.x, r.y) for r in got] == [(7, 0, 3.0, 4.0), (7, 1, 7.0, 8.0)]
    (tmp_path / "imgs_frame7_00000_graph.json").write_text('{"image": "i", "nodes": [{"id": 0, "level": 0}], "edges": [{"from": 0, "to": 1}], "branches": [{"id": 0, "pixels": [[9, 1], [10, 2]]}]}')
    g = files.graphs(spark, str(tmp_path / "*_graph.json"))
    assert [(r.branch_id, r.ord, r.x, r.y) for r in files.graph_pixels(g).orderBy("ord").collect()] == [(0, 0, 1.0, 9.0), (0, 1, 2.0, 10.0)]
    assert files.graph_edges(g).first()[2:] == (0, 1)
    pairs, missing = files.matched(g, files.read_json(spark, str(tmp_path / "frame7.json"), files.FLOWERS))
    assert pairs.count() == 1 and missing.count() == 0


def test_round_trip_of_graph_documents(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, 1.0, 2.0, 0, "Tronco", True, 2)], "image_id long, branch_id int, centroid_x double, centroid_y double, level int, level_name string, is_trunk boolean, size_px int")
    edges = spark.createDataFrame([(1, 0, 1)], "image_id long, a int, b int")
    pixels = spark.createDataFrame([(1, 0, 0, 1, 9), (1, 0, 1, 2, 10)], "image_id long, branch_id int, ord int, x int, y int")
    files.write_json(files.graph_documents(nodes, edges, pixels), str(tmp_path / "g"))
    back = files.graph_pixels(files.graphs(spark, str(tmp_path / "g"))).collect()
    assert [(r.x, r.y) for r in sorted(back, key=lambda r: r.ord)] == [(1.0, 9.0), (2.0, 10.0)]


def test_parameters_and_metrics(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"a.png": {"close_k": 3, "open_k": 5, "thick_dist": 1.5, "dilate_k": 7, "min_branch": 9}}')
    assert files.parameters(spark, str(tmp_path / "p.json")).first()[:3] == ("a.png", 3, 5)
    old = spark.createDataFrame([("i", "m", 1.0)], "image string, method string, w double")
    new = spark.createDataFrame([("i", "m", 2.0), ("i", "n", 3.0)], old.schema)
    assert sorted(r.w for r in files.upserted(old, new, ["image", "method"]).collect()) == [2.0, 3.0]
    assert files.metrics_table(spark.createDataFrame([(float("nan"),)], "w double"), {"w": 2}).first().w is None


def test_configured(tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text('{"data_dir": "x"}')
    (tmp_path / "bad.json").write_text("{")
    assert files.configured("data_dir", str(tmp_path / "c.json")) == "x" and files.configured("data_dir", str(tmp_path / "bad.json")) == "data"
    monkeypatch.setenv("TWIGSPARK_DATA_DIR", "y")
    assert files.active_paths(str(tmp_path / "c.json"))["data_dir"] == "y"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "frame1.json").write_text('{"shapes": [{"label": "flower", "points": [[3, 4]]}]}')
    stream = arrivals.stream_files(spark, str(tmp_path / "in"), files.FLOWERS)
    arrivals.run_batches(stream, lambda b: b.select(F.size("shapes").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 1


def test_repartitioning_changes_nothing(spark, sf):
    from twigspark.plans import spaces

    f, p = spaces.labelled(spark, sf)
    a = shoots.first_form(f, p, 6.0)[1].collect()
    b = shoots.first_form(f.repartition(7), p.repartition(5), 6.0)[1].collect()
    told = lambda rows: sorted((r.image_id, r.id, r.shoot_id, r.branch_id, round(r.confidence, 9)) for r in rows)
    assert told(a) == told(b)


def test_sinkhorn_converges():
    from twigspark.operators import transport

    def by_logs(a, b, d, reg, rounds=20_000):
        """The same plan by dual potentials, with many rounds."""
        top = lambda m, axis: m.max(axis=axis) + np.log(np.exp(m - m.max(axis=axis, keepdims=True)).sum(axis=axis))
        a, b, g = np.log(a / a.sum()), np.log(b / b.sum()), np.zeros(len(b))
        for _ in range(rounds):
            f = a - top(g[None] - d / reg, 1)
            g = b - top(f[:, None] - d / reg, 0)
        return float((np.exp(f[:, None] + g[None] - d / reg) * d).sum())

    r = np.random.default_rng(3)
    xy, a, b = r.uniform(0, 100, (12, 2)), r.uniform(0.1, 1, 12), r.uniform(0.1, 1, 12)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    reg = 0.05 * float(np.median(d[d > 0]))
    assert abs(transport.sinkhorn(a, b, d, reg, 5) - by_logs(a, b, d, reg)) < 1e-6
    assert abs(transport.sinkhorn(a, b, d, reg) - by_logs(a, b, d, reg)) < 1e-6


def plain_labels(x, near):
    """Components by a walk from pixel to pixel."""
    out, n = np.zeros(x.shape, int), 0
    for start in map(tuple, np.argwhere(x)):
        if out[start]:
            continue
        n += 1
        out[start], todo = n, [start]
        while todo:
            y, c = todo.pop()
            for dy, dx in near:
                q = (y + dy, c + dx)
                if 0 <= q[0] < x.shape[0] and 0 <= q[1] < x.shape[1] and x[q] and not out[q]:
                    out[q] = n
                    todo.append(q)
    return out


def test_labels_equal_a_walk():
    r = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.5, 0.8, 1.0):
        x = r.random((23, 31)) < share
        assert np.array_equal(raster.labelled(x), plain_labels(x, raster.AROUND))
        assert np.array_equal(raster.labelled(x, four=True), plain_labels(x, raster.AROUND[::2]))


def test_features_of_known_shapes():
    m = np.zeros((60, 80), "u1")
    m[10:50, 10:40] = 255  # 40 x 30 with a hole of 20 x 10 that holds a dot of 2 x 2
    m[20:40, 20:30] = 0
    m[28:30, 24:26] = 255
    m[5, 60] = 255  # one pixel
    m[20:30, 60:70] = 255
    f = raster.features(m)
    area = 40 * 30 - 20 * 10 + 4 + 1 + 100
    assert f["area_share"] == area / m.size and f["components"] == 4
    assert f["largest_share"] == (40 * 30 - 200) / area and f["small_components"] == 2 and f["medium_components"] == 1
    assert f["outline_share"] == (2 * 39 + 2 * 29 + 4 * 9) / area  # neither the dot inside nor the border of the hole; one pixel has no length
    assert (f["box_height"], f["box_width"], f["box_fill"]) == (44, 59, area / (44 * 59))
    assert f["holes"] == 0  # one hole smaller than the foreground, less one
    assert f["dist_max"] >= 5 and 0 < f["fine_share"] < 1
    assert raster.features(np.zeros((4, 4), "u1")) == dict.fromkeys(raster.FEATURES, 0.0)
    diagonal = np.eye(6, dtype="u1") * 255
    assert raster.outline(diagonal > 0) == pytest.approx(2 * 5 * 2**0.5)


def test_calibrator_and_tuner(spark):
    rows = [(1, *[0.0] * 16), (2, *[1.0] * 16), (3, *[float(k) for k in range(16)])]
    df = spark.createDataFrame(rows, "image_id long, " + ", ".join(f"{n} double" for n in raster.FEATURES))
    got = {x.image_id: x for x in raster.calibrated(df).collect()}
    for image, *x in rows:
        for k, (start, w) in raster.MODELS.items():
            assert got[image][k] == round(start + sum(a * b for a, b in zip(w, x, strict=True)))
        assert {k: got[image][k] for k in raster.CONSENSUS} == raster.CONSENSUS
    stored = spark.createDataFrame([(1, 3, 5, 2.5, 7, None)], "image_id long, close_k int, open_k int, thick_dist double, dilate_k int, min_branch int")
    t = {x.image_id: tuple(x)[1:] for x in raster.tuned(df, stored).collect()}
    assert t == {1: (3, 5, 2.5, 7, None), 2: tuple(raster.TUNER_DEFAULTS.values()), 3: tuple(raster.TUNER_DEFAULTS.values())}


def test_gaps_follow_the_last_step():
    x = np.zeros((9, 12), bool)
    x[1, 1:5] = True  # the end at (1, 4) came from the left
    x[1, 6:9] = True
    out = raster.repaired(x)  # of the three pixels that go on by a whole step, the first in row order
    assert out[0, 5] and out.sum() == x.sum() + 1


def test_distinct_branches_keep_the_longer_in_place():
    line = lambda a, b: {"pixels": [(k, 0) for k in range(a, b)]}
    given = [line(0, 10), line(100, 105), line(0, 12), line(1, 11), line(200, 203)]
    assert [b["pixels"][-1][0] for b in skeleton.distinct_branches(given)] == [11, 104, 202]


def test_medial_subsections(spark):
    """A bar three pixels wide, given in raster order, is cut across, and each pixel takes the run of the axis pixel nearest to it."""
    p = [(1, 1, k, float(x), float(y)) for k, (y, x) in enumerate((y, x) for y in range(10, 13) for x in range(20, 80))] + [(1, 2, 0, 5.0, 5.0), (1, 2, 1, 6.0, 5.0)]
    df = spark.createDataFrame(p, "image_id long, branch_id long, ord long, x double, y double")
    axis = {r.ord: (r.x, r.y) for r in skeleton.axes(df).where("branch_id = 1").collect()}
    chain = np.array([axis[k] for k in range(len(axis))])
    assert set(chain[:, 1]) == {11.0} and (np.abs(np.diff(chain[:, 0])) == 1).all()
    parts = max(1, len(chain) // 20)
    section = np.minimum(np.arange(len(chain)) // (len(chain) // parts), parts - 1)
    for r in heat.medial_subsections(df, 20).collect():
        want = section[((chain - (r.x, r.y)) ** 2).sum(axis=1).argmin()] if r.branch_id == 1 else 0
        assert r.section_id == want


def test_nearest_by_pairs_and_rings_agree(spark):
    r = np.random.default_rng(5)
    t = [(1 + k % 2, k % 3, k, float(x), float(y)) for k, (x, y) in enumerate(r.integers(0, 40, (400, 2)))] + [(3, 0, 1000, 1.0, 1.0)]
    p = [(1 + k % 4, k, float(x), float(y)) for k, (x, y) in enumerate(r.integers(-10, 60, (80, 2)))]
    points, targets = spark.createDataFrame(p, "image_id long, id long, x double, y double"), spark.createDataFrame(t, "image_id long, branch_id long, ord long, x double, y double")
    want = sorted(map(tuple, joins.nearest_of_all(points, targets).collect()))
    assert sorted(map(tuple, joins.nearest(points, targets).collect())) == want and len(want) == 60


def test_nearest_vector_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 16)
    r = np.random.default_rng(6)
    v = r.integers(0, 3, (120, 4)).astype(float)  # with many ties
    q = spark.createDataFrame([(k, v[k].tolist()) for k in range(40)], "id long, vector array<double>")
    t = spark.createDataFrame([(k, k % 5, v[k].tolist()) for k in range(40, 120)], "ord long, branch_id long, vector array<double>")
    want = {k: min((((v[k] - v[j]) ** 2).sum(), j) for j in range(40, 120))[::-1] for k in range(40)}
    assert {x.id: (x.ord, x.d2) for x in joins.nearest_vector(q, t).collect()} == want
