import json
import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.operators import clusters, densify, ground, labels, nearest, rays, shapes, stems, tiles, woodleaf
from pointmill.plans import pipeline
from pointmill.schema import Config
from pointmill.sources import las, ply, treefile


def test_config_checks(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"ground_label": 1, "tree_label": 7, "grid_width": None}))
    assert Config.load(cfg_path=str(path)).tree_label == 7
    with pytest.raises(ValueError):
        Config.load()
    for bad in ({"wood_distance": -1}, {"wood_propagation_radius": 0}, {"wood_propagation_min_points": True}, {"wood_propagation_height": math.inf}):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(TypeError):
        Config.load({"unknown": 1})


def test_thinning_keeps_the_first_point(cloud):
    points = cloud([(0.1, 0.1, 0.1), (0.2, 0.2, 0.2), (1.5, 0, 0)])
    assert sorted(r[0] for r in ground.thinned(points).select("point_id").collect()) == [0, 2]


def test_ground_estimate_lowest_and_end(cloud):
    points = cloud([(0, 0, 5), (0.5, 0.5, 1), (3, 0.5, 2), (3.5, 3.5, 0)])
    assert sorted(r[0] for r in ground.estimated(points, 2.0).select("point_id").collect()) == [1, 2, 3]
    assert ground.estimated(cloud([(0, 0, 0), (4, 4, 0)]), 2.0).select("point_id").collect()[0][0] == 0
    assert ground.estimated(cloud([(1, 1, 1)]), 2.0).count() == 0


def test_subsample_takes_the_point_nearest_to_the_centre(cloud, column):
    points = cloud([(0.1, 0.1, 0.1), (0.25, 0.25, 0.25), (0.4, 0.4, 0.4), (0.6, 0.1, 0.1)])
    assert column(ground.subsampled(points, 0.5), "kept") == [False, True, False, True]


def test_tiles(cloud):
    points = cloud([(0, 0, 0), (99, 40, 0)])
    table = tiles.tile_table(points, 50, 3).orderBy("ix", "iy").collect()
    assert [(r["ix"], r["iy"], r["x_min"], r["cx_max"]) for r in table] == [(0, 0, -3.0, 50.0), (1, 0, 47.0, 100.0)]
    assert tiles.tile_table(cloud([(0, 0, 0), (0, 0, 1)])).count() == 0


def brute(queries, targets, k):
    out = {}
    for i, q in enumerate(queries):
        far = ((targets[:, :2] - q[:2]) ** 2).sum(axis=1)
        out[i] = sorted(range(len(targets)), key=lambda j: (far[j], j))[:k]
    return out


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    queries, targets = np.round(rng.random((40, 2)) * 200, 3), np.round(rng.random((60, 2)) * 50, 3)
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(queries)], "qid long, qx double, qy double")
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(targets)], "tid long, tx double, ty double")
    found = {}
    for r in nearest.nearest(q, t, 3).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["tid"])
    assert found == brute(queries, targets, 3)
    assert nearest.nearest(q, t.limit(0), 3).count() == 0


def test_nearest_of_far_queries(spark):
    rng = np.random.default_rng(8)
    queries = np.vstack([rng.random((15, 2)) * 10, rng.random((10, 2)) * 10 + [5000, -3000]])
    targets = np.vstack([rng.random((40, 2)) * 10, [[4000.0, -2500.0], [-70000.0, 9.0]]])
    queries, targets = np.round(queries, 3), np.round(targets, 3)
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(queries)], "qid long, qx double, qy double")
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(targets)], "tid long, tx double, ty double")
    found = {}
    for r in nearest.nearest(q, t, 4).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["tid"])
    assert found == brute(queries, targets, 4)


def plan_of(df):
    """The executed plan as text."""
    return df._jdf.queryExecution().toString().lower()


def test_tables_that_grow_are_never_broadcast(spark, cloud):
    points = spark.range(300).select(F.col("id").alias("point_id"), *((F.col("id") % k).cast("double").alias(a) for a, k in zip("xyz", (17, 13, 5))))
    q = points.select(F.col("point_id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    t = points.select(F.col("point_id").alias("tid"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    for found in (nearest.nearest(q, t, 5), nearest.height_above_ground(points, points), nearest.box_mean(q, points), ground.subsampled(points)):
        assert "broadcast" not in plan_of(found)


def test_box_mean_is_closed(spark, cloud):
    ground_points = cloud([(0.75, 0, 2), (0, -0.75, 4), (0.76, 0, 100)])
    q = spark.createDataFrame([(0, 0.0, 0.0), (1, 50.0, 50.0)], "qid long, qx double, qy double")
    assert [(r["qid"], r["ground_z"]) for r in nearest.box_mean(q, ground_points).collect()] == [(0, 3.0)]


def test_densify(cloud):
    heights = [0.0, 0.0625, 0.125, 0.1875, 0.6875, 0.75, 0.8125]
    found = densify.densified(cloud([(0.1, 0.1, z) for z in heights]), max_vertical_gap=0.5, density_factor=4.0).where("not original")
    assert sorted(r["z"] for r in found.select("z").collect()) == [0.25, 0.3125, 0.375, 0.4375, 0.5, 0.5625, 0.625]
    assert densify.densified(cloud([(0.1, 0.1, 0.25 * i) for i in range(9)])).where("not original").count() == 0
    with pytest.raises(ValueError):
        densify.densified(cloud([(0, 0, 0)]), density_factor=0.5)


def test_order_statistic_against_sorting(spark):
    from pointmill.functions.ranking import order_statistic

    rng = np.random.default_rng(2)
    values = [float(v) for v in np.round(rng.exponential(size=500), 2)] + [0.25] * 300
    df = spark.createDataFrame([(v,) for v in values], "gap double").repartition(6)
    for at in (0, 1, 199, 200, 400, 650, 799):
        assert order_statistic(df, "gap", at) == sorted(values)[at]


def test_densify_refuses_a_bad_spacing_only_where_it_counts(cloud):
    assert densify.densified(cloud([(0, 0, 0)]), vertical_spacing=-1).count() == 1
    with pytest.raises(ValueError):
        densify.densified(cloud([(0, 0, 0), (0, 0, 0.1)]), vertical_spacing=-1)


def test_rays_need_every_line(spark, cloud):
    xyz = [(float(i), 0.0, 0.0) for i in range(6)]
    good = cloud(xyz, gps_time=[0.0, 0.1, 0.2, 0.3, 0.4, 0.5], point_source_id=[1] * 6, scan_angle_deg=[10.0] * 6)
    found = rays.rays(good).orderBy("point_id").collect()
    assert found[0]["ray_x"] == pytest.approx(2.5) and found[0]["ray_z"] == pytest.approx(1.5 / math.tan(math.radians(10)), rel=1e-6)
    assert rays.rays(good.withColumn("scan_angle_deg", F.when(F.col("point_id") > 2, F.lit(1.0)).otherwise(F.col("scan_angle_deg"))).withColumn("point_source_id", (F.col("point_id") > 2).cast("int"))) is None
    assert rays.rays(good.drop("gps_time")) is None
    assert rays.rays(good.limit(0)) is None


def test_missing_heights_are_filled(spark):
    rows = [(1, 0, None), (1, 1, 4.0), (1, 5, None), (1, 6, 8.0), (1, 7, None)]
    found = rays.filled(spark.createDataFrame(rows, "point_source_id int, bin long, height double")).orderBy("bin").collect()
    assert [r["height"] for r in found] == [4.0, 4.0, 6.0, 8.0, 8.0]


def test_long_lines_are_filled_in_one_pass(spark):
    known = F.when(F.col("id") % 700 == 650, (F.col("id") % 11).cast("double"))
    found = rays.filled(spark.range(20000).select(F.lit(1).alias("point_source_id"), F.col("id").alias("bin"), known.alias("height")))
    assert "unboundedfollowing" not in plan_of(found)
    places = list(range(650, 20000, 700))
    for r in found.collect():
        before, after = [p % 11 for p in places if p <= r["bin"]][-1:], [p % 11 for p in places if p >= r["bin"]][:1]
        near = before + after
        assert r["height"] == sum(near) / len(near)


def test_rays_bin_the_points_once(spark):
    own = spark.range(400).select(F.col("id").alias("point_id"), *((F.col("id") % k).cast("double").alias(a) for a, k in zip("xyz", (3, 5, 7))), (F.col("id") / 8).alias("gps_time"), (F.col("id") % 2).cast("int").alias("point_source_id"), F.lit(10.0).alias("scan_angle_deg"))
    found = rays.rays(own)
    plan = plan_of(found).split("== physical plan ==")[1]
    assert "window" not in plan and "aggregate" not in plan and found.where("ray_z is null").isEmpty() and found.count() == 400


HEAD = "x,y,z,radius,parent_id,section_id"


def test_cylinders(spark, cloud, column, tmp_path):
    path = tmp_path / "trees.txt"
    path.write_text(f"# two trees\n\n{HEAD},age\n1,1,0,0.2,-1,0,7, 1,1,2,0.2,0,0,7, 3,1,2,0.1,1,0,7\n-4,0,1,0.3,-1,0,2, -4,3,1,0.3,0,0,2\n")
    segments = treefile.read_trees(spark, str(path))
    assert segments.groupBy("tree_no").count().orderBy("tree_no").collect() == [(0, 3), (1, 2)]
    inside = [(1, 1.15, 1), (2, 1, 2.08), (-4.25, 1.5, 1)]
    near = [(1.22, 1, 1.5), (3.04, 1, 2), (-4, -0.04, 1.1)]
    outside = [(1.3, 1, 1), (2, 1, 1.8), (-4, 4, 1)]
    points = cloud(inside + near + outside + inside[:1], tree_id=[4] * 9 + [-1])
    assert column(woodleaf.wood_leaf(points, segments, 0.05), "wood_leaf") == [0] * 6 + [1] * 3 + [-1]
    assert column(woodleaf.wood_leaf(points, segments, 0.0), "wood_leaf") == [0] * 3 + [1] * 6 + [-1]


@pytest.mark.parametrize("text", ["x,y,z\n0,0,0", HEAD, f"{HEAD}\n0,0,0,0.1,-1", f"{HEAD}\n0,0,nan,0.1,-1,0,0,0,1,0.1,0,0", f"{HEAD}\n0,0,0,0.1,-1,0,0,0,1,0.1,0.5,0"])
def test_bad_tree_files(spark, tmp_path, text):
    path = tmp_path / "bad.txt"
    path.write_text(text)
    with pytest.raises(ValueError):
        treefile.read_trees(spark, str(path))


@pytest.mark.parametrize("rows", [[(0, 0, 0.1, -1)], [(0, 0, 0.1, 0), (0, 1, 0.1, 0)], [(0, 0, 0.1, -1), (0, 1, 0.1, 1)], [(0, 0, 0.1, -1), (0, 1, -0.1, 0)]])
def test_bad_forests(spark, rows):
    segments = spark.createDataFrame([(0, i, float(x), 0.0, float(z), float(r), p, 0) for i, (x, z, r, p) in enumerate(rows)], "tree_no int, seg_no int, x double, y double, z double, radius double, parent_id int, section_id int")
    with pytest.raises(ValueError):
        woodleaf.checked_segments(segments)


def test_wood_spreads_until_stable(cloud, column):
    xyz = [(0.25 * i, 1.0, 0.125 * i) for i in range(9)]
    points = cloud(xyz, tree_id=[2] * 9, wood_leaf=[0, 0] + [1] * 7)
    level = cloud([(1, 1, -0.5)])
    assert column(woodleaf.propagated(points, level, 2.0, 0.625, 2), "wood_leaf") == [0] * 9
    assert column(woodleaf.propagated(points, level, 1.0, 0.625, 2), "wood_leaf") == [0] * 5 + [1] * 4
    assert column(woodleaf.propagated(points, level, 2.0, 0.2, 2), "wood_leaf") == [0, 0] + [1] * 7


def test_wood_does_not_cross_trees(cloud, column):
    points = cloud([(2, 3, 0.5)] * 6, tree_id=[5, 5, 8, 5, -1, 8], wood_leaf=[0, 0, 1, 1, -1, -1])
    assert column(woodleaf.propagated(points, cloud([(2, 2, 0)]), 1.0, 0.25, 2), "wood_leaf") == [0, 0, 1, 0, -1, -1]
    with pytest.raises(ValueError):
        woodleaf.propagated(points, cloud([(0, 0, 0)]).limit(0))


def test_cloud_and_labels(spark, cloud, tmp_path):
    path = str(tmp_path / "cloud.ply")
    assert ply.write_cloud(cloud([(1, 2, 3), (4, 5, 6)]), path) == 2
    rows = ply.parsed(Path(path).read_bytes())
    assert len(rows) == 2 and rows["nz"].tolist() == [10, 10] and rows["x"].tolist() == [1, 4]
    body = b"ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    Path(path).write_bytes(body + bytes([0, 0, 0, 0x80, 0, 0, 0, 0, 0, 0, 0x80, 0]))
    assert [r["label"] for r in ply.read_labels(spark, path).orderBy("point_id").collect()] == [-1, 1, -1, 0]


def test_ground_mesh(cloud, tmp_path):
    assert ply.write_ground_mesh(cloud([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0.5, 0.4, 1)]), str(tmp_path / "m.ply")) == 4
    with pytest.raises(ValueError):
        ply.write_ground_mesh(cloud([(0, 0, 0), (1, 0, 0)]), str(tmp_path / "m.ply"))


def test_las_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.las")
    las.write_las(path, np.array([[1.0, 2.0, 3.0], [4.5, 5.25, 6.0]]), np.array([1, 7]), gps_time=np.array([0.5, 1.5]), scan_angle_rank=np.array([-10, 12]), point_source_id=np.array([3, 4]))
    rows = las.read_las(spark, path).orderBy("point_id").collect()
    assert [(r["x"], r["z"], r["classification"], r["scan_angle_deg"], r["point_source_id"]) for r in rows] == [(1.0, 3.0, 1, -10.0, 3), (4.5, 6.0, 7, 12.0, 4)]
    report = las.inspected(spark, path).collect()[0]
    assert report["points"] == 2 and report["rays_possible"]
    assert las.inspected(spark, str(tmp_path / "none.las")).collect()[0]["readable"] is False


def test_las_by_ranges_with_extra_fields(spark, cloud, tmp_path, monkeypatch):
    n = 1000
    xyz = [(1000 + 0.25 * i, -5.5 + 0.125 * (i % 40), 0.001 * i) for i in range(n)]
    points = cloud(xyz, classification=[i % 9 for i in range(n)], gps_time=[0.5 * i for i in range(n)], point_source_id=[i % 3 for i in range(n)], scan_angle_deg=[0.6 * (i % 20) for i in range(n)], instance_id=[i % 7 - 1 for i in range(n)])
    target = las.save_ids(points.repartition(4), str(tmp_path / "new" / "b.las"))
    reader = las.LasReader([str(target)], las.read_head(str(target))[1])
    monkeypatch.setattr(las, "RANGE", 300)
    monkeypatch.setattr(las, "BATCH", 128)
    parts = reader.partitions()
    assert [p.end - p.begin for p in parts] == [300, 300, 300, 100]
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    whole = [r.asDict() for r in las.read_las(spark, str(target)).orderBy("point_id").collect()]
    assert rows == whole and [r["tree_ids"] for r in whole] == [i % 7 - 1 for i in range(n)]
    for r, (x, y, z) in zip(whole, xyz):
        assert (r["x"], r["y"], r["z"]) == pytest.approx((x, y, z), abs=1e-9)
        assert r["scan_angle_deg"] == pytest.approx(0.6 * (r["point_id"] % 20)) and r["classification"] == r["point_id"] % 9
    las.save_ids(points.limit(0), str(tmp_path / "new" / "c.las"))
    both = las.read_las(spark, str(tmp_path / "new"))
    assert both.count() == n and las.read_las(spark, str(tmp_path / "new" / "c.las")).count() == 0
    with pytest.raises(ValueError):
        las.read_las(spark, str(tmp_path / "d.laz")).count()
    with pytest.raises(ValueError):
        las.write_points(cloud([(0, 0, 0), (1e9, 0, 0)]), str(tmp_path / "e.las"))


def test_command_line_of_a_small_cloud(spark, cloud, tmp_path, capsys):
    from pointmill.plans import cli

    poles, soil = grove([(0, 0)])
    points = cloud(poles + soil, classification=[7] * len(poles) + [1] * len(soil), instance_id=[0] * (len(poles) + len(soil)))
    source, config = str(tmp_path / "in.las"), tmp_path / "c.json"
    las.write_points(points, source)
    config.write_text(json.dumps(SETTINGS))
    assert cli.main(["--input-path", source, "--config-path", str(config), "--plot"]) == 0
    found = las.read_las(spark, str(tmp_path / "in_segmented.las"))
    assert found.count() == len(poles) + len(soil) and "tree_ids" in found.columns
    with pytest.raises(SystemExit):
        cli.main(["--input-path", source, "--labels-path", "x.ply"])


def test_views(cloud):
    from pointmill.operators import views

    points = cloud([(0, 0, i) for i in range(4)], height=[0.5, float("nan"), 9.0, float("inf")], tree=[1, 1, 2, 2])
    row = views.colour_limits(points, "height", buffer_size=3).collect()[0]
    assert tuple(row) == (4, 0.5, 9.0, 2)
    assert {r["tree"]: r["high"] for r in views.colour_limits(points, "height", "tree").collect()} == {1: 0.5, 2: 9.0}
    assert [views.checked_view(points, f) for f in ("tree", "height", None)] == ["tab20", "viridis", "green"]
    for bad in (lambda: views.checked_view(points, "none"), lambda: views.checked_view(points, "z", 0), lambda: views.checked_view(points.drop("z"), None)):
        with pytest.raises(ValueError):
            bad()


def test_scan_angles_by_name(spark):
    df = spark.createDataFrame([(1.0, 2, 1000)], "gps_time double, point_source_id int, scan_angle int")
    assert rays.ray_columns(df).collect()[0]["scan_angle_deg"] == pytest.approx(6.0)
    assert "scan_angle_deg" not in rays.ray_columns(df.drop("gps_time")).columns
    both = df.withColumns({"scan_angle_rank": F.lit(4), "scan_angle_deg": F.lit(5.0)})
    with pytest.raises(ValueError):
        rays.ray_columns(both)
    assert rays.ray_columns(both, "scan_angle_rank").collect()[0]["scan_angle_deg"] == 4.0


def test_save_ids(spark, cloud, tmp_path):
    target = las.save_ids(cloud([(0, 0, 0)] * 2, instance_id=[-1, 4]), str(tmp_path / "new" / "out.parquet"))
    assert sorted(r["tree_ids"] for r in spark.read.parquet(str(target)).collect()) == [-1, 4]


def grove(places, height=5.0):
    """Square poles with a branch each on flat ground: points and classes."""
    poles, soil = [], []
    for px, py in places:
        for k in range(int(height / 0.125)):
            poles += [(px + x, py + y, 0.125 * k) for x in (-0.125, 0.125) for y in (-0.125, 0.125)]
        poles += [(px + 0.25 * i, py, 0.75 * height) for i in range(1, 7)]
        soil += [(px + x, py + y, 0.0) for x in (-2.5, -1, 1, 2.5) for y in (-2.5, 0.5, 2.5)]
        soil += [(px + 0.5, py, 0.0), (px + 1.0, py + 0.1, 0.0), (px + 1.25, py - 0.1, 0.0)]
    return poles, soil


SETTINGS = {"ground_label": 1, "tree_label": 7, "wood_distance": 0.1, "girth_height_ratio": 0.35}


def test_segment_of_poles_on_the_ground(cloud):
    poles, soil = grove([(0, 0), (12, 4)])
    points = cloud(poles + soil, classification=[7] * len(poles) + [1] * len(soil))
    found = pipeline.segment(points, Config(**SETTINGS), min_tree_points=100).orderBy("point_id").collect()
    half = len(poles) // 2
    assert {r["instance_id"] for r in found[:half]} == {0} and {r["instance_id"] for r in found[half : len(poles)]} == {1}
    assert {0, 1} <= {r["wood_leaf"] for r in found[: len(poles)]}
    assert {(r["instance_id"], r["species_id"], r["wood_leaf"]) for r in found[len(poles) :]} == {(-1, -1, -1)}


def test_settings_of_the_extraction(cloud):
    poles, soil = grove([(0, 0), (40, 0)])
    trees, ground = cloud(poles), cloud(soil)
    plain = {(r["tree_no"], r["seg_no"]): r["radius"] for r in stems.extracted(trees, ground, Config())[1].collect()}
    assert {k for k, _ in plain} == {0, 1} and max(plain.values()) > 0.1
    thin = stems.extracted(trees, ground, Config(max_diameter=0.1))[1].collect()
    assert max(r["radius"] for r in thin) == 0.05
    drawn = stems.extracted(trees, ground, Config(global_taper=0.02, global_taper_factor=0.5))[1]
    ends = {r["tree_no"]: r["max(z)"] for r in drawn.groupBy("tree_no").agg({"z": "max"}).collect()}
    for r in drawn.collect():
        assert r["radius"] == pytest.approx(0.5 * plain[r["tree_no"], r["seg_no"]] + 0.01 * (ends[r["tree_no"]] - r["z"]))
    square = stems.extracted(cloud(poles + [(90, 0, 0)]), ground, Config(grid_width=20.0))[0].where("label >= 0")
    assert square.agg(F.min("x")).head()[0] > 30
    with pytest.raises(ValueError):
        stems.extracted(trees, ground, Config(gravity_factor=0.5))


def test_segment_with_the_files_of_an_earlier_extraction(spark, cloud, tmp_path):
    poles, soil = grove([(0, 0), (12, 4)])
    half = len(poles) // 2
    colours = np.zeros(len(poles), np.dtype([("red", "u1"), ("green", "u1"), ("blue", "u1")]))
    colours["red"][:half], colours["blue"][half:] = 9, 200
    body = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(poles)}\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n".encode()
    (tmp_path / "c.ply").write_bytes(body + colours.tobytes())
    points = cloud(poles + soil, classification=[7] * len(poles) + [1] * len(soil))
    middle = points.agg(*(F.avg(a) for a in "xyz")).head()
    line = ", ".join(f"{0 - middle[0]},{0 - middle[1]},{z - middle[2]},0.2,{p},0" for z, p in ((0, -1), (5, 0)))
    (tmp_path / "t.txt").write_text(f"{HEAD}\n{line}\n")
    extract = stems.from_files(str(tmp_path / "c.ply"), str(tmp_path / "t.txt"))
    found = pipeline.segment(points, Config(**SETTINGS), extract, min_tree_points=100).orderBy("point_id").collect()
    first, second = {r["instance_id"] for r in found[:half]}, {r["instance_id"] for r in found[half : len(poles)]}
    assert {*first, *second} == {0, 1} and len(first) == len(second) == 1
    assert {r["wood_leaf"] for r in found[half : len(poles)]} == {1} and 0 in {r["wood_leaf"] for r in found[:half]}
    with pytest.raises(ValueError):
        pipeline.segment(points.where("point_id > 3"), Config(**SETTINGS), extract)


def test_groups_of_the_large_path_against_the_small_one(cloud):
    places = [(0, 0), (60, 0), (0, 60), (60, 60)]
    poles, soil = grove(places)
    points = cloud(poles + soil, classification=[7] * len(poles) + [1] * len(soil))
    flat = points.withColumns({a: F.col(a).cast("float") for a in "xyz"})
    found = pipeline.segmented_groups(flat, Config(**SETTINGS), n_groups=4, min_tree_points=100).orderBy("point_id").collect()
    size = len(poles) // 4
    ids = [{r["tree_id"] for r in found[size * k : size * (k + 1)]} for k in range(4)]
    assert all(len(x) == 1 for x in ids) and set().union(*ids) == {0, 1, 2, 3}
    assert len(found) == len(poles) and {r["shrub_id"] for r in found} == {-1}
    whole = pipeline.segment(points, Config(**SETTINGS), min_tree_points=100, single_pass=10).where("classification = 7")
    assert whole.select("instance_id").distinct().count() == 4
    with pytest.raises(ValueError, match="refused"):
        pipeline.segmented_groups(flat, Config(**SETTINGS), lambda *_: (_ for _ in ()).throw(ValueError("refused")), n_groups=2)


def test_postprocessing_of_a_group(cloud, column):
    close = [(0.0, 0, 0.1 * i) for i in range(12)] + [(0.25, 0, 0.1 * i) for i in range(10)] + [(9, 9, 0.1 * i) for i in range(4)]
    ids = [0] * 12 + [1] * 10 + [2] * 4
    points = cloud(close * 5, tree_id=ids * 5, shrub_id=[-1] * 130)
    assert column(pipeline.postprocessed(points, 30), "tree_id") == ([0] * 22 + [-1] * 4) * 5
    with_shrub = points.withColumn("shrub_id", F.when(F.col("point_id") == 4, F.lit(0)).otherwise(F.lit(-1)))
    assert column(pipeline.postprocessed(with_shrub, 30), "tree_id") == ids * 5


def test_rays_of_a_segmentation_are_checked(cloud):
    poles, soil = grove([(0, 0)])
    points = cloud(poles + soil, classification=[7] * len(poles) + [1] * len(soil))
    with pytest.raises(ValueError):
        pipeline.segment(points.withColumn("ray_x", F.lit(1.0)), Config(**SETTINGS))
    rays_of = lambda z: points.withColumns({"ray_x": F.lit(0.0), "ray_y": F.lit(0.0), "ray_z": z})
    with pytest.raises(ValueError):
        pipeline.segment(rays_of(F.when(F.col("point_id") == 3, F.lit(float("nan"))).otherwise(F.lit(5.0))), Config(**SETTINGS))
    seen = []

    def extract(points, ground, config):
        seen.append({"ray_x", "ray_y", "ray_z"} <= set(points.columns))
        return stems.extracted(points, ground, config)

    metadata = {"gps_time": F.col("point_id") / 100, "point_source_id": F.lit(1), "scan_angle_rank": F.lit(9)}
    for own in (rays_of(F.lit(5.0)), points.withColumns(metadata)):
        found = pipeline.segment(own, Config(**SETTINGS, use_rays=True), extract, min_tree_points=100)
        assert found.columns == [*own.columns, "instance_id", "species_id", "wood_leaf"]
    assert seen == [True, True]
    with pytest.raises(ValueError):
        pipeline.segment(points.withColumns(metadata | {"scan_angle_deg": F.lit(9.0)}), Config(**SETTINGS, use_rays=True))


def test_segment_without_trees(cloud):
    points = cloud([(0, 0, 1)] * 3, classification=[1, 2, 3])
    found = pipeline.segment(points, Config(tree_label=7)).collect()
    assert [(r["instance_id"], r["species_id"], r["wood_leaf"]) for r in found] == [(-1, -1, -1)] * 3


def test_command_line_help():
    root = str(Path(__file__).resolve().parent.parent)
    said = subprocess.run([sys.executable, "-m", "pointmill.plans.cli", "--help"], cwd=root, capture_output=True, text=True, check=True)
    assert "--input-path" in said.stdout


def test_stream_counts_per_tile(spark, cloud, tmp_path):
    from pointmill.streaming.tiles import tile_counts

    source = str(tmp_path / "in")
    cloud([(1, 1, 1), (2, 2, 3), (60, 1, 0)]).write.parquet(source)
    stream = spark.readStream.schema("point_id long, x double, y double, z double").parquet(source)
    query = tile_counts(stream).writeStream.outputMode("complete").format("memory").queryName("tile_counts").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["ix"], r["n"]) for r in spark.table("tile_counts").collect()) == [(0, 2), (1, 1)]


def test_wood_spreads_as_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    xyz, tree = rng.integers(0, 17, (240, 3)) * 0.125, rng.integers(0, 3, 240)
    is_wood = rng.random(240) < 0.2
    rows = [(i, *map(float, p), int(t), int(not w)) for i, (p, t, w) in enumerate(zip(xyz, tree, is_wood))]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double, tree_id int, wood_leaf int")
    plans, write = [], woodleaf.written
    monkeypatch.setattr(woodleaf, "written", lambda df, label: (plans.append((label, plan_of(df).split("== physical plan ==")[1])), write(df, label))[1])
    found = woodleaf.propagated(points, points.limit(1).withColumn("z", F.lit(0.0)), 9.0, 0.375, 3, 0.75).orderBy("point_id").collect()
    far = (((xyz[:, None] - xyz[None]) / [0.375, 0.375, 0.75]) ** 2).sum(axis=2)
    near, expected = (far <= 1) & (tree[:, None] == tree[None]), is_wood.copy()
    while True:
        more = expected | ((near & expected[None]).sum(axis=1) >= 3)
        if (more == expected).all():
            break
        expected = more
    assert [r["wood_leaf"] for r in found] == [int(not w) for w in expected] and expected.sum() > is_wood.sum()
    rounds = [plan for label, plan in plans if label == "counted"]
    assert len(rounds) > 1 and all(p.count("exchange hashpartitioning") <= 2 and "broadcast" not in p for p in rounds)


def test_steps_of_a_segmentation_broadcast_no_points(spark, cloud):
    poles, soil = grove([(0, 0), (12, 4)])
    points, level = cloud(poles, label=[1] * len(poles)), cloud(soil)
    own = points.withColumns({"tree_id": F.col("label"), "cluster": F.col("label")})
    segments = stems.segments(own, 1.0)
    for found in (segments, labels.without_small(points, 3), clusters.trunk_positions(points), tiles.gathered(points, tiles.group_boxes(points, "label"), "label"), shapes.shrub_points(own, level), woodleaf.wood_leaf(own, segments)):
        assert "broadcast" not in plan_of(found)


def test_a_cloud_of_any_size_is_segmented_whole(cloud, monkeypatch):
    poles, soil = grove([(0, 0)])
    points = cloud(poles + soil, classification=[7] * len(poles) + [1] * len(soil))
    monkeypatch.setattr(type(points), "count", lambda self: 20_000_000)
    monkeypatch.setattr(pipeline, "segmented_groups", lambda *a: pytest.fail("parted into groups"))
    found = pipeline.segment(points, Config(**SETTINGS), min_tree_points=100).where("classification = 7")
    assert [r["instance_id"] for r in found.select("instance_id").distinct().collect()] == [0]
