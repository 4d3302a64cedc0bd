"""Runs from files to results."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from twigspark.operators import shoots
from twigspark.plans import runs
from twigspark.plans.catalog import METHODS
from twigspark.sources import files


def tree(tmp_path, frame):
    """A horizontal branch and a vertical one; two shoots of flowers above the horizontal one."""
    branches = [{"id": 0, "pixels": [[200, x] for x in range(0, 200)]}, {"id": 1, "pixels": [[y, 100] for y in range(200, 300)]}]
    (tmp_path / f"imgs_frame{frame}_00000_graph.json").write_text(json.dumps({"image": f"imgs_frame{frame}_00000.png", "nodes": [], "edges": [{"from": 0, "to": 1}], "branches": branches}))
    flowers = [[20 + k % 2, 120 + 6 * k] for k in range(10)] + [[160, 110 + 6 * k] for k in range(10)]
    (tmp_path / f"frame{frame}.json").write_text(json.dumps({"shapes": [{"label": "flower", "points": [p]} for p in flowers]}))


def test_shoots_and_heat(spark, tmp_path):
    tree(tmp_path, 3), tree(tmp_path, 5)
    (tmp_path / "imgs_frame9_00000_graph.json").write_text('{"image": "x", "nodes": [], "edges": [], "branches": []}')
    for form in (shoots.first_form, shoots.second_form):
        out = runs.shoots_and_heat(spark, str(tmp_path / "*_graph.json"), str(tmp_path / "frame*.json"), 2.0, form)
        assert sorted(map(tuple, out["assignments"].groupBy("image_id").count().collect())) == [(3, 20), (5, 20)]
        assert {(r.image_id, r.branch_id): r.flowers for r in out["per_branch"].collect()} == {(3, 0): 20, (3, 1): 0, (5, 0): 20, (5, 1): 0}
        assert out["heat"].agg(F.min("heat"), F.count("*")).first()[1] == 600
        assert [r.frame for r in out["missing"].collect()] == [9]


def test_evaluation(spark, tmp_path):
    tree(tmp_path, 3)
    flowers, pixels, _ = runs.load(spark, str(tmp_path / "*_graph.json"), str(tmp_path / "frame*.json"))
    truth = pixels.where("ord % 20 = 0")
    scores, macro = runs.evaluated(flowers, pixels, truth, {k: METHODS[k] for k in ("nearest", "random_walk", "clusters")})
    assert scores.count() == 3 and {r.accuracy for r in macro.collect()} == {1.0}


def test_masks(spark):
    m = np.zeros((60, 60), "u1")
    m[5:55, 28:33] = 255
    m[28:33, 30:55] = 255
    masks = spark.createDataFrame([(1, 60, 60, bytearray(m.tobytes())), (2, 60, 60, bytearray(b"short"))], "image_id long, height int, width int, data binary")
    params = spark.createDataFrame([(1, 1, 1, 9.0, 1, 4)], "image_id long, close_k int, open_k int, thick_dist double, dilate_k int, min_branch int")
    out = runs.branches_of_masks(masks, params)
    assert {r.status: r.n for r in out["report"].collect()} == {"ok": 1, "error": 1}
    assert out["stats"].count() == 3 and out["trunk"].count() == 2


def test_hierarchy_of_a_raster(spark, tmp_path):
    rows = []
    for y in range(60):
        for x in range(60):
            c = (0, 0, 0)
            if 28 <= x <= 31 and y >= 20:
                c = (0, 0, 120)
            elif 10 <= y <= 13 and 28 <= x <= 55:
                c = (0, 120, 0)
            elif 2 <= x <= 5 and 2 <= y <= 20:
                c = (120, 0, 0)
            rows.append((1, x, y, *c))
    out = runs.hierarchy_of_rasters(spark.createDataFrame(rows, "image_id long, x long, y long, b int, g int, r int"), 2)
    nodes = {r.branch_id: r for r in out["nodes"].collect()}
    assert [(nodes[k].size_px, nodes[k].level) for k in (0, 1, 2)] == [(76, -1), (112, 1), (160, 0)]
    assert [tuple(r)[1:] for r in out["edges"].collect()] == [(1, 2)]
    files.write_json(files.graph_documents(out["nodes"], out["edges"], out["pixels"]), str(tmp_path / "g"))
    assert files.graph_pixels(files.graphs(spark, str(tmp_path / "g"))).count() == 348


def failing(on):
    """A method that fails inside its kernel on some images."""

    def run(f, p):
        def kernel(x):
            if x["image_id"].iloc[0] in on:
                raise ValueError("no")
            return x[["image_id", "id"]].assign(branch_id=0)

        return f.groupBy("image_id").applyInPandas(kernel, "image_id long, id long, branch_id long")

    return run


def test_a_method_that_fails_keeps_the_others(spark, tmp_path):
    for k in (3, 5, 7):
        tree(tmp_path, k)
    f, p, _ = runs.load(spark, str(tmp_path / "*_graph.json"), str(tmp_path / "frame*.json"))
    truth = p.where("ord % 20 = 0").withColumn("n", F.lit(1))
    loads = {"nearest": lambda f, p: f.select("image_id", "x", "y", F.lit(1).alias("n"))}
    out = {(r.image_id, r.method): r for r in runs.method_table(f, p, truth, {"nearest": METHODS["nearest"], "broken": failing({5})}, loads, nodes=60).collect()}
    assert len(out) == 6 and all(out[k, "nearest"].accuracy == 1.0 and out[k, "nearest"].note == "" for k in (3, 5, 7))
    assert out[5, "broken"].accuracy is None and out[5, "broken"].note.startswith("ERR:")
    assert out[3, "broken"].accuracy is not None and out[7, "broken"].note == ""
    one = out[3, "nearest"]
    assert one.wasserstein_cm > 0 and 0 < one.similarity < 1 and one.flowers == 20 and 54 <= one.nodes <= 66 and len(one.timestamp) == 19
    assert out[3, "broken"].wasserstein_cm is None


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    images = spark.createDataFrame([(k,) for k in range(12)], "image_id long")
    runs_of: list[int] = []
    path = str(tmp_path / "out")

    def method(stop):
        def run(part):
            ids = sorted(r.image_id for r in part.collect())
            runs_of.extend(ids)
            if stop and os.path.isdir(path):  # killed once a batch has been committed
                raise KeyboardInterrupt
            return part.withColumn("twice", F.col("image_id") * 2).where("image_id <> 4 or raise_error('bad') is null")

        return run

    try:
        runs.resumed(path, images, method(True), 4)
        raise AssertionError
    except KeyboardInterrupt:
        first = set(runs_of)
    runs_of.clear()
    got = {r.image_id: (r.twice, r.failed) for r in runs.resumed(path, images, method(False), 4).collect()}
    assert set(got) == set(range(12)) and got[4][0] is None and got[4][1].startswith("ERR:") and got[11] == (22, None)
    assert first and set(runs_of) < set(range(12))
    runs_of.clear()
    assert len(runs.resumed(path, images, method(False), 4).collect()) == 12 and set(runs_of) == {4}
