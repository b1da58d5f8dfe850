import math

import numpy as np
import pytest

from pointmill.operators import clusters, components, labels, shapes


def test_xy_components_ignore_height(cloud, column):
    points = cloud([(0.1, 0.1, 0), (0.6, 0.6, 10), (3, 3, 0)])
    assert column(clusters.grid_components(points, 0.5), "cluster") == [0, 0, 1]


def test_voxel_components_of_a_stair_and_a_wall(cloud, column):
    stair = [(0.4 * i, 0.0, 0.4 * i) for i in range(25)]
    wall = [(30.0, 0.5 * i, 0.5 * k) for i in range(6) for k in range(4)]
    apart = [(30.0, 0.0, 6.0)]
    found = clusters.grid_components(cloud(stair + wall + apart), 0.5, "xyz")
    assert column(found, "cluster") == [0] * 25 + [1] * 24 + [2]
    bounds = {r["cluster"]: r for r in clusters.bounds_of(found).collect()}
    assert (bounds[1]["y_max"], bounds[1]["min_z"], bounds[0]["x_max"]) == pytest.approx((2.5, 0.0, 9.6))


def test_empty_and_bad_size(cloud):
    points = cloud([(0, 0, 0)])
    assert clusters.grid_components(points.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        clusters.grid_components(points, 0)


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id as src", "id + 1 as dst")
    assert components.connected(edges).select("component").distinct().collect()[0][0] == 0


def test_floating_cluster_is_rejected(cloud, column):
    points = cloud([(0, 0, 0.5), (10, 10, 3)])
    ground = cloud([(0.1, 0.1, 0), (9, 9, 0.2), (9.5, 9.5, 0.1)])
    assert column(clusters.floating_filter(points, ground, voxel_size=0.5, max_gap=1.0, nearest_ground_points=2), "kept") == [True, False]
    assert column(clusters.floating_filter(points, None, max_gap=1.0), "kept") == [True, False]
    with pytest.raises(ValueError):
        clusters.floating_filter(points, ground, boundary_margin=-1)


def test_noise_stays_noise(cloud, column):
    points = cloud([(0, 0, 0), (0, 0, 9), (1, 1, 0), (1, 1, 1)], label=[-1, -1, 0, 0])
    assert column(clusters.connect_floating(points, cloud([(0, 0, 0)])), "label") == [-1, -1, 0, 0]


def test_floating_label_joins_the_lower_centroid(cloud, column):
    points = cloud([(0, 0, 0), (0, 0, 2), (5, 0, 0), (5, 0, 2), (1, 0, 6), (1, 0, 8)], label=[0, 0, 1, 1, 2, 2])
    assert column(clusters.connect_floating(points, cloud([(0, 0, 0)])), "label") == [0, 0, 1, 1, 0, 0]


def test_close_trunks_merge_into_the_larger(cloud, column):
    xyz = [(0, 0, 0), (0, 0, 1)] + [(1, 0, 0), (1, 0, 1), (1, 0, 1.5)] + [(9, 0, 0), (9, 0, 1)]
    points = cloud(xyz, label=[3, 3, 5, 5, 5, 7, 7])
    assert column(clusters.merge_trunks(points, 1.5, (0.5, 2.0), 2), "label") == [0, 0, 0, 0, 0, 1, 1]
    assert column(clusters.merge_trunks(points, 0.5, (0.5, 2.0), 2), "label") == [3, 3, 5, 5, 5, 7, 7]


def test_merge_instances_keeps_gaps(cloud, column):
    points = cloud([(0, 0, 0)] * 6, tree_id=[-1, 0, 2, -1, -1, -1], shrub_id=[-1, -1, -1, 0, 2, -1])
    found = labels.merged_instances(points)
    assert column(found, "instance_id") == [-1, 0, 2, 3, 5, -1]
    assert column(found, "species_id") == [-1, -1, -1, 17, 17, -1]


def test_merge_instances_refuses_overlap_and_overflow(cloud):
    with pytest.raises(ValueError):
        labels.merged_instances(cloud([(0, 0, 0)], tree_id=[1], shrub_id=[1]))
    with pytest.raises(OverflowError):
        labels.merged_instances(cloud([(0, 0, 0)] * 2, tree_id=[2**31 - 1, -1], shrub_id=[-1, 5]))


def test_reduce_and_remove_small(cloud, column):
    points = cloud([(0, 0, 0)] * 4, label=[-1, 4, 4, 9])
    assert column(labels.reduced(points), "label") == [-1, 0, 0, 1]
    assert column(labels.without_small(points, 2), "label") == [-1, 4, 4, -1]


def test_a_pole_is_a_trunk_and_a_hedge_is_not(cloud):
    pole = [(0.05 * (i % 3), 0.04 * (i % 5), 0.03 * i) for i in range(130)]
    hedge = [(0.03 * i, 0.05 * (i % 4), 0.1 * (i % 3)) for i in range(130)]
    points = cloud(pole + hedge, cluster=[0] * 130 + [1] * 130)
    found = {r["cluster"]: r["is_trunk"] for r in shapes.partial_trunks(points).collect()}
    assert found == {0: True, 1: False}
    assert shapes.without_trunks(points).select("cluster").distinct().collect()[0][0] == 1


#: A right triangle of area 3, so of width 3 / pi = 0.955 by the filter's measure.
LEGS = [(0.0, 0.0), (3.0, 0.0), (0.0, 2.0)]


def bush(height, foot=0.0, at=0.0):
    return [(at + x, y, foot + z) for z in (0.0, height) for x, y in LEGS]


@pytest.mark.parametrize(("height", "passes"), [(0.56, False), (0.58, True), (0.9, True), (1.33, True), (1.35, False)])
def test_shrub_shape_limits(cloud, height, passes):
    ground = cloud([(0.2, -0.1, 0), (-0.2, 0.1, 0), (0, 0.8, 50)])
    points = cloud(bush(height), cluster=[0] * 6)
    assert shapes.shrub_report(points, ground).collect()[0]["is_shrub"] is passes


@pytest.mark.parametrize(("foot", "passes"), [(0.1, True), (0.35, True), (0.45, False)])
def test_shrub_base_limits(cloud, foot, passes):
    ground = cloud([(0.5, 0.5, -7)])
    assert shapes.shrub_report(cloud(bush(1.1, foot - 7), cluster=[0] * 6), ground).collect()[0]["is_shrub"] is passes


def test_shrub_without_ground_or_area(cloud):
    line = cloud([(2.0 * i, 1.0 * i, 0.05 * i) for i in range(5)], cluster=[0] * 5)
    assert shapes.shrub_report(line, cloud([(0, 0, 0)])).collect()[0]["is_shrub"] is False
    assert shapes.shrub_points(line, None).count() == 0
    far = cloud([(-40, 25, 0)])
    assert shapes.shrub_report(cloud(bush(0.9), cluster=[0] * 6), far).collect()[0]["is_shrub"] is False


def test_hull_areas_of_many_clusters_in_small_batches(spark, cloud):
    rng = np.random.default_rng(11)
    centres = rng.random((12, 2)) * 50
    ids = rng.integers(0, 12, 4000)
    xy = np.round(centres[ids] + rng.normal(size=(4000, 2)), 3)
    points = cloud([(x, y, 0) for x, y in xy], cluster=[int(i) for i in ids]).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    found = {r["cluster"]: r["area"] for r in shapes.hull_areas(points).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def plain(own):
        own = sorted(map(tuple, own))
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        edges = [(a, b) for a in own for b in own if a != b and all(turn(a, b, c) >= 0 for c in own)]
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in edges) / 2

    for k in (0, 5, 11):
        assert found[k] == pytest.approx(plain(xy[ids == k][:]), rel=1e-9)
    assert len(found) == 12


def test_hull_areas_of_odd_clusters(cloud):
    flat = [(i, 2 * i, 0) for i in range(70)]
    same = [(4, 4, i) for i in range(80)]
    ring = [(5 * math.cos(a), 5 * math.sin(a), 0) for a in np.linspace(0, 2 * math.pi, 200, endpoint=False)]
    points = cloud(flat + same + ring, cluster=[3] * 70 + [-1] * 80 + [7] * 200)
    found = {r["cluster"]: r["area"] for r in shapes.hull_areas(points).collect()}
    assert found[3] is None and found[-1] is None and found[7] == pytest.approx(100 * math.sin(2 * math.pi / 200) * 25)
    assert shapes.hull_areas(points.limit(0)).count() == 0
