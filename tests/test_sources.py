"""Readers, lookups and writers on small files whose contents are known."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twigspark.operators import heat, raster, skeleton
from twigspark.sources import files


def png(path, pixels):
    """A gray PNG by hand."""
    h, w = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype("u1"))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    one = np.arange(12).reshape(3, 4) * 20
    png(tmp_path / "frame10.png", one), png(tmp_path / "frame9.PNG", one + 1)
    (tmp_path / "frame8.png").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    got = {r.name: r for r in files.images(spark, str(tmp_path)).collect()}
    assert set(got) == {"frame10.png", "frame9.PNG"}
    r = got["frame10.png"]
    assert (r.frame, r.height, r.width, r.channels) == (10, 3, 4, 1) and list(r.data) == one.ravel().tolist()


def test_order_and_lookups(spark):
    names = ["frame10.png", "frame9.png", "b.png", "frame9_a.png", "a.png"]
    assert [r.name for r in files.in_order(spark.createDataFrame([(n,) for n in names], "name string")).collect()] == ["frame9.png", "frame9_a.png", "frame10.png", "a.png", "b.png"]
    keys = spark.createDataFrame([(1,), (2,), (3,), (None,)], "frame int")
    a = spark.createDataFrame([(1, "a/1b"), (1, "a/1a"), (None, "a/x")], "frame int, path string")
    b = spark.createDataFrame([(1, "b/1"), (2, "b/2")], "frame int, path string")
    assert {r.frame: r.path for r in files.first_source(keys, a, b).collect()} == {1: "a/1a", 2: "b/2", 3: None, None: None}
    there, missing = files.work_list(keys, b)
    assert sorted(r.frame for r in there.collect()) == [1, 2] and {r.frame for r in missing.collect()} == {3, None}


def test_truth_and_shoots(spark, tmp_path):
    points = [{"x": 1.5, "y": 2.0, "num_flowers": 3, "rama_id": 7}, {"x": 4.0, "y": 5.0, "num_flowers": 1, "rama_id": None}]
    (tmp_path / "imgs_frame7_GT.json").write_text(json.dumps({"image": "i", "points": points}))
    (tmp_path / "imgs_frame8_GT.json").write_text(json.dumps({"image": "i", "graph_json": "other.json", "points": []}))
    t = files.read_json(spark, str(tmp_path / "*_GT.json"), files.TRUTH)
    assert [tuple(r) for r in files.truth_points(t).drop("name").collect()] == [(7, 0, 1.5, 2.0, 3, 7), (7, 1, 4.0, 5.0, 1, None)]
    assert {r.frame: r.graph_name for r in files.truth_graph(t).collect()} == {7: "imgs_frame7.json", 8: "other.json"}
    shoots = [{"varilla_id": 1, "rama_id": 2, "num_flowers": 3, "base_xy": [10.0, 20.0], "centroid": [0, 0], "confidence": 0.5, "flower_indices": [4, 5, 6]}]
    (tmp_path / "frame3.json").write_text(json.dumps({"image": "i", "n_flowers": 3, "varillas": shoots}))
    s = files.shoot_records(files.read_json(spark, str(tmp_path / "frame3.json"), files.SHOOTS)).first()
    assert tuple(s) == (3, "frame3.json", 1, 2, 3, 10.0, 20.0, 0.5, [4, 5, 6])


def test_branch_colours(spark, tmp_path):
    node = {"id": 4, "centroid_x": 1.0, "centroid_y": 2.0, "level": 0, "level_name": "Tronco", "is_trunk": True, "size_px": 9, "color_rgb": [1, 2, 3]}
    (tmp_path / "imgs_frame5_00000_graph.json").write_text(json.dumps({"image": "i", "nodes": [node], "edges": [], "branches": []}))
    assert [tuple(r) for r in files.branch_colours(files.graphs(spark, str(tmp_path / "*.json"))).collect()] == [(5, 4, [1, 2, 3])]


def test_metrics_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, float("nan")), ("b", 2.0, 0.5)], "name string, x double, y double")
    files.write_metrics(files.metrics_table(df, {"x": 2, "y": 3}).coalesce(1), str(tmp_path / "m"))
    text = next((tmp_path / "m").glob("*.csv")).read_text().split()
    assert text == ["name,x,y", "a,1.23,", "b,2.0,0.5"] or text == ["name,x,y", 'a,1.23,""', "b,2.0,0.5"]


def test_adaptive_thickness():
    m = np.zeros((60, 60), "u1")
    m[20:40, 5:55] = 255
    m[5:20, 29:31] = 255
    limit, k = raster.adaptive(m)
    assert 2.0 <= limit <= 0.8 * 10 and k == int(2 * limit) | 1
    assert raster.adaptive(np.zeros((5, 5), "u1")) == (2.0, 5)


def test_owner_chain_and_candidates(spark):
    p = spark.createDataFrame([(1, 1, 0, 0.0, 0.0), (1, 2, 0, 0.0, 0.0), (1, 1, 1, 5.0, 0.0)], "image_id long, branch_id long, ord long, x double, y double")
    assert sorted(map(tuple, skeleton.pixel_owner(p).collect())) == [(1, 0.0, 0.0, 2), (1, 5.0, 0.0, 1)]
    order = [3, 0, 4, 1, 2]
    line = spark.createDataFrame([(1, 1, k, float(x), 0.0) for k, x in enumerate(order)], "image_id long, branch_id long, ord long, x double, y double")
    got = [r.x for r in skeleton.chained(line).orderBy("ord").collect()]
    assert got in ([0.0, 1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.0, 0.0])
    two = spark.createDataFrame([(1, b, k, float(x), 0.0) for b, xs in ((1, range(10)), (2, range(3, 12)), (3, range(9, 20))) for k, x in enumerate(xs)], "image_id long, branch_id long, ord long, x double, y double")
    assert [(r.a, r.b, round(r.share, 3)) for r in skeleton.deduplicated_candidates(two).collect()] == [(1, 2, 0.7)]


def test_cell_size(spark):
    p = spark.createDataFrame([(1, float(x), float(y)) for x in range(40) for y in range(40)], "image_id long, x double, y double")
    size = heat.cell_size_for(p, 100)
    n = p.select(F.floor(F.col("x") / size), F.floor(F.col("y") / size)).distinct().count()
    assert n == pytest.approx(100, rel=0.35)
