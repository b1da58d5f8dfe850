"""The registered point-cloud queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, densify, ground, labels, nearest, rays, shapes, tiles, views, woodleaf
from ..schema import UNASSIGNED, Config
from ..sources import las
from ..streaming.tiles import tile_counts
from . import fixtures, pipeline
from .joins import shuffled
from .scratch import written

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "xy_components"
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_POINTS = f"points AS ({fixtures.POINTS_SQL.format(events='events')})"


def _query(sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query, with the SQL that follows the cloud's definition."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{_POINTS}{',' if sql.lstrip()[:6] != 'SELECT' else ''} {sql}"
        return f

    return add


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.of_class(spark, sf_dir, 7)


def _ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.of_class(spark, sf_dir, 1)


def _seeds(df: DataFrame) -> DataFrame:
    """Tree points labelled by their seed."""
    return df.withColumn("label", F.col("tree_seed"))


@_query("SELECT classification, count(*) AS n FROM points GROUP BY classification")
def class_counts(spark, sf_dir):
    return labels.class_counts(fixtures.points(spark, sf_dir))


@_query("SELECT point_id, x, y, z FROM points WHERE classification = 7")
def tree_filter(spark, sf_dir):
    return labels.tree_points(fixtures.points(spark, sf_dir), 7).select("point_id", "x", "y", "z")


@_query("SELECT point_id, CAST(x - (SELECT avg(x) FROM points) AS FLOAT) AS x, CAST(y - (SELECT avg(y) FROM points) AS FLOAT) AS y, CAST(z - (SELECT avg(z) FROM points) AS FLOAT) AS z FROM points")
def center_cloud(spark, sf_dir):
    return labels.centred(fixtures.points(spark, sf_dir)).select("point_id", "x", "y", "z")


@_query("""SELECT min(point_id) AS point_id FROM points WHERE classification = 1
  GROUP BY floor(CAST(x AS FLOAT)), floor(CAST(y AS FLOAT)), floor(CAST(z AS FLOAT))""")
def ground_thin(spark, sf_dir):
    return ground.thinned(_ground(spark, sf_dir)).select("point_id")


@_query("""SELECT arg_min(point_id, (z, point_id)) AS point_id, min(z) AS z FROM
  (SELECT *, floor((x - min(x) OVER ()) / 2.0::DOUBLE) AS ix, floor((y - min(y) OVER ()) / 2.0::DOUBLE) AS iy,
    ceil((max(x) OVER () + 2.0::DOUBLE - min(x) OVER ()) / 2.0::DOUBLE) - 1 AS nx, ceil((max(y) OVER () + 2.0::DOUBLE - min(y) OVER ()) / 2.0::DOUBLE) - 1 AS ny
   FROM points WHERE classification = 7) WHERE ix < nx AND iy < ny GROUP BY ix, iy""")
def ground_estimate(spark, sf_dir):
    return ground.estimated(_trees(spark, sf_dir)).select("point_id", "z")


_HALF = "floor(CAST(x AS FLOAT) / 0.5::FLOAT) AS cx, floor(CAST(y AS FLOAT) / 0.5::FLOAT) AS cy, floor(CAST(z AS FLOAT) / 0.5::FLOAT) AS cz"
_KEPT = f"""kept AS (SELECT point_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY
    pow(x - (cx + 0.5) * 0.5, 2) + pow(y - (cy + 0.5) * 0.5, 2) + pow(z - (cz + 0.5) * 0.5, 2), point_id) AS n
  FROM (SELECT *, {_HALF} FROM points WHERE classification = 7)) WHERE n = 1)"""


@_query(f"{_KEPT} SELECT p.point_id, k.point_id IS NOT NULL AS kept FROM points p LEFT JOIN kept k USING (point_id) WHERE classification = 7")
def voxel_subsample(spark, sf_dir):
    return ground.subsampled(_trees(spark, sf_dir), 0.5).select("point_id", "kept")


_TILES = """ends AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points),
tiles AS (SELECT CAST(i AS INT) AS ix, CAST(j AS INT) AS iy, x0 + i * 10.0::DOUBLE AS cx_min, y0 + j * 10.0::DOUBLE AS cy_min,
    x0 + i * 10.0::DOUBLE + 10 AS cx_max, y0 + j * 10.0::DOUBLE + 10 AS cy_max
  FROM ends, range(0, 1000) a(i), range(0, 1000) b(j) WHERE i < ceil((x1 - x0) / 10.0::DOUBLE) AND j < ceil((y1 - y0) / 10.0::DOUBLE))"""


@_query(f"{_TILES} SELECT *, cx_min - 1 AS x_min, cy_min - 1 AS y_min, cx_max + 1 AS x_max, cy_max + 1 AS y_max FROM tiles")
def tile_list(spark, sf_dir):
    return tiles.tile_table(fixtures.points(spark, sf_dir), 10.0, 1.0)


@_query(f"{_TILES} SELECT ix, iy, count(*) AS n FROM tiles JOIN points ON x >= cx_min AND x < cx_max AND y >= cy_min AND y < cy_max GROUP BY ix, iy")
def tiles_core_counts(spark, sf_dir):
    return tiles.tiled(fixtures.points(spark, sf_dir), 10.0, 1.0).where("core").groupBy("ix", "iy").agg(F.count("*").alias("n"))


@_query(f"{_TILES} SELECT ix, iy, count(*) AS n FROM tiles JOIN points ON x >= cx_min - 1 AND x < cx_max + 1 AND y >= cy_min - 1 AND y < cy_max + 1 GROUP BY ix, iy")
def tiles_halo_counts(spark, sf_dir):
    return tiles.tiled(fixtures.points(spark, sf_dir), 10.0, 1.0).groupBy("ix", "iy").agg(F.count("*").alias("n"))


@_query("SELECT count(*) AS n FROM points WHERE x >= 4 AND x < 14 AND y >= 4 AND y < 14")
def core_mask_count(spark, sf_dir):
    tile = {"cx_min": 4.0, "cy_min": 4.0, "cx_max": 14.0, "cy_max": 14.0}
    return fixtures.points(spark, sf_dir).where(tiles.core_mask(tile)).agg(F.count("*").alias("n"))


@_query("SELECT CAST(floor(x / 10.0::DOUBLE) AS BIGINT) AS ix, CAST(floor(y / 10.0::DOUBLE) AS BIGINT) AS iy, count(*) AS n, min(z) AS min_z, max(z) AS max_z FROM points GROUP BY 1, 2")
def stream_tile_counts(spark, sf_dir):
    return tile_counts(fixtures.points(spark, sf_dir), 10.0)


def _components(axes: str, label: int = 7) -> str:
    keys = [f"c{a}" for a in axes]
    near = " AND ".join(f"abs(a.{k} - b.{k}) <= 1" for k in keys)
    listed = ", ".join(keys)
    return f"""own AS (SELECT *, {_HALF} FROM points WHERE classification = {label}),
cells AS (SELECT {listed}, row_number() OVER (ORDER BY {listed}) AS id FROM (SELECT DISTINCT {listed} FROM own)),
near AS (SELECT a.id AS u, b.id AS v FROM cells a JOIN cells b ON {near} AND a.id <> b.id),
reach AS (SELECT id AS u, id AS root FROM cells UNION SELECT near.v, reach.root FROM reach JOIN near ON near.u = reach.u WHERE reach.root < near.v),
roots AS (SELECT u, min(root) AS root FROM reach GROUP BY u),
numbered AS (SELECT u, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INT) AS cluster FROM roots),
member AS (SELECT own.*, cluster FROM own JOIN cells USING ({listed}) JOIN numbered ON u = id)"""


@_query(f"{_components('xy')} SELECT point_id, cluster FROM member", recursive=True)
def xy_components(spark, sf_dir):
    return clusters.grid_components(_trees(spark, sf_dir), 0.5).select("point_id", "cluster")


@_query(f"{_components('xyz')} SELECT point_id, cluster FROM member", recursive=True)
def voxel_components(spark, sf_dir):
    return clusters.grid_components(_trees(spark, sf_dir), 0.5, "xyz").select("point_id", "cluster")


@_query(f"{_components('xyz')} SELECT cluster, count(*) AS n, min(z) AS min_z, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM member GROUP BY cluster", recursive=True)
def component_bounds(spark, sf_dir):
    return clusters.bounds_of(clusters.grid_components(_trees(spark, sf_dir), 0.5, "xyz"))


_FLOATING = f"""{_components('xyz')},
boxes AS (SELECT cluster, min(z) AS min_z, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM member GROUP BY cluster),
soil AS (SELECT point_id, x, y, z FROM points WHERE classification = 1),
inside AS (SELECT cluster, avg(z) AS ground_z FROM boxes JOIN soil ON x BETWEEN x_min - 0.5 AND x_max + 0.5 AND y BETWEEN y_min - 0.5 AND y_max + 0.5 GROUP BY cluster),
around AS (SELECT cluster, avg(z) AS ground_z FROM (SELECT cluster, soil.z, row_number() OVER (PARTITION BY cluster ORDER BY pow((x_min + x_max) / 2 - x, 2) + pow((y_min + y_max) / 2 - y, 2), point_id) AS n
  FROM boxes ANTI JOIN inside USING (cluster), soil) WHERE n <= 10 GROUP BY cluster),
levels AS (SELECT * FROM inside UNION ALL SELECT * FROM around)"""


@_query(f"{_FLOATING} SELECT point_id, member.cluster, min_z - ground_z <= 0.4 AS kept FROM member JOIN boxes USING (cluster) JOIN levels USING (cluster)", recursive=True)
def floating_filter(spark, sf_dir):
    return clusters.floating_filter(_trees(spark, sf_dir), _ground(spark, sf_dir)).select("point_id", "cluster", "kept")


@_query(f"{_FLOATING} SELECT cluster, round(ground_z, 6) AS ground_z, round(min_z - ground_z, 6) AS gap, min_z - ground_z <= 0.4 AS accepted FROM boxes JOIN levels USING (cluster)", recursive=True)
def ground_gap_report(spark, sf_dir):
    _, report = clusters.ground_gaps(_trees(spark, sf_dir), _ground(spark, sf_dir))
    return report.select("cluster", F.round("ground_z", 6).alias("ground_z"), F.round("gap", 6).alias("gap"), "accepted")


@_query("""sparse AS (SELECT point_id, CASE WHEN tree_seed % 3 = 0 THEN -1 ELSE tree_seed END AS label FROM points WHERE classification = 7),
ranks AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS n FROM (SELECT DISTINCT label FROM sparse WHERE label <> -1))
SELECT point_id, coalesce(n, -1) AS label FROM sparse LEFT JOIN ranks USING (label)""")
def reduce_labels(spark, sf_dir):
    own = _trees(spark, sf_dir).withColumn("label", F.when(F.col("tree_seed") % 3 == 0, F.lit(UNASSIGNED)).otherwise(F.col("tree_seed")))
    return labels.reduced(own).select("point_id", "label")


@_query("SELECT point_id, CASE WHEN count(*) OVER (PARTITION BY tree_seed) < 40 THEN -1 ELSE tree_seed END AS label FROM points WHERE classification = 7")
def remove_small(spark, sf_dir):
    return labels.without_small(_seeds(_trees(spark, sf_dir)), 40).select("point_id", "label")


def _both(spark, sf_dir):
    own = fixtures.points(spark, sf_dir)
    tree = F.when((F.col("classification") == 7) & (F.col("tree_seed") % 2 == 0), F.col("tree_seed")).otherwise(F.lit(UNASSIGNED))
    return own.withColumn("tree_id", tree).withColumn("shrub_id", F.when(F.col("classification") == 2, F.col("tree_seed")).otherwise(F.lit(UNASSIGNED)))


@_query("""ids AS (SELECT point_id, CASE WHEN classification = 7 AND tree_seed % 2 = 0 THEN tree_seed ELSE -1 END AS tree, CASE WHEN classification = 2 THEN tree_seed ELSE -1 END AS shrub FROM points)
SELECT point_id, CAST(CASE WHEN shrub >= 0 THEN shrub + (SELECT max(tree) + 1 FROM ids) ELSE tree END AS INT) AS instance_id, CAST(CASE WHEN shrub >= 0 THEN 17 ELSE -1 END AS TINYINT) AS species_id FROM ids""")
def merge_instances(spark, sf_dir):
    return labels.merged_instances(_both(spark, sf_dir)).select("point_id", "instance_id", "species_id")


_OFFSETS = """ids AS (SELECT point_id, point_source_id, CASE WHEN tree_seed % 5 = 0 THEN -1 ELSE tree_seed END AS label FROM points WHERE classification = 7),
sizes AS (SELECT point_source_id, coalesce(max(label) FILTER (label >= 0), -1) + 1 AS n FROM ids GROUP BY point_source_id),
offsets AS (SELECT point_source_id, CAST(coalesce(sum(n) OVER (ORDER BY point_source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM sizes)"""


def _sources(spark, sf_dir):
    return _trees(spark, sf_dir).withColumn("label", F.when(F.col("tree_seed") % 5 == 0, F.lit(UNASSIGNED)).otherwise(F.col("tree_seed")))


@_query(f'{_OFFSETS} SELECT point_source_id, "offset" FROM offsets')
def group_offsets(spark, sf_dir):
    return labels.group_offsets(_sources(spark, sf_dir), "point_source_id", "label")


@_query(f'{_OFFSETS} SELECT point_id, CAST(CASE WHEN label >= 0 THEN label + "offset" ELSE -1 END AS INT) AS label FROM ids JOIN offsets USING (point_source_id)')
def offset_labels(spark, sf_dir):
    return labels.offset_labels(_sources(spark, sf_dir), "point_source_id", "label").select("point_id", "label")


@_query("""boxes AS (SELECT tree_seed, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points WHERE classification = 7 GROUP BY tree_seed)
SELECT b.tree_seed, count(*) AS n, sum(p.z) AS sum_z FROM boxes b JOIN points p ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1 GROUP BY b.tree_seed""")
def bbox_gather(spark, sf_dir):
    own = fixtures.points(spark, sf_dir)
    found = tiles.gathered(own, tiles.group_boxes(labels.tree_points(own, 7), "tree_seed"), "tree_seed")
    return found.groupBy("tree_seed").agg(F.count("*").alias("n"), F.sum("z").alias("sum_z"))


_SLOPE = repr(math.tan(math.radians(30.0)))


@_query(f"""own AS (SELECT * FROM points WHERE classification = 7),
stats AS (SELECT tree_seed AS label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, min(z) AS low, count(*) AS n FROM own GROUP BY tree_seed),
marked AS (SELECT *, low <= (SELECT max(z) FROM points WHERE classification = 1) - 0.7 OR n >= 55 AS fixed FROM stats),
pairs AS (SELECT f.label, g.label AS target, g.cz < f.cz AS below, sqrt(pow(f.cx - g.cx, 2) + pow(f.cy - g.cy, 2)) - {_SLOPE}::DOUBLE * (f.cz - g.cz) AS tilted,
    pow(f.cx - g.cx, 2) + pow(f.cy - g.cy, 2) + pow(f.cz - g.cz, 2) AS far FROM marked f, marked g WHERE NOT f.fixed AND g.fixed),
moves AS (SELECT label, coalesce(arg_min(target, (tilted, target)) FILTER (below), arg_min(target, (far, target))) AS target FROM pairs GROUP BY label)
SELECT point_id, coalesce(target, tree_seed) AS label FROM own LEFT JOIN moves ON moves.label = tree_seed""")
def connect_floating(spark, sf_dir):
    return clusters.connect_floating(_seeds(_trees(spark, sf_dir)), _ground(spark, sf_dir), -0.7, 55).select("point_id", "label")


_TRUNKS = """lows AS (SELECT tree_seed AS label, min(z) AS low, count(*) AS n FROM points WHERE classification = 7 GROUP BY tree_seed HAVING count(*) >= 30),
trunks AS (SELECT label, avg(x) FILTER (z BETWEEN low + 0.5 AND low + 2.0) AS x, avg(y) FILTER (z BETWEEN low + 0.5 AND low + 2.0) AS y, any_value(n) AS n
  FROM points JOIN lows ON label = tree_seed WHERE classification = 7 GROUP BY label)"""


@_query(f"{_TRUNKS} SELECT label, round(x, 9) AS x, round(y, 9) AS y, n FROM trunks")
def trunk_positions(spark, sf_dir):
    found = clusters.trunk_positions(_seeds(_trees(spark, sf_dir)), (0.5, 2.0), 30)
    return found.select("label", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "n")


@_query(
    f"""{_TRUNKS},
near AS (SELECT a.label AS u, b.label AS v FROM trunks a JOIN trunks b ON a.label <> b.label AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= {3.6 ** 2!r}::DOUBLE),
reach AS (SELECT DISTINCT u, u AS root FROM near UNION SELECT near.v, reach.root FROM reach JOIN near ON near.u = reach.u),
roots AS (SELECT u, min(root) AS root FROM reach GROUP BY u),
largest AS (SELECT root, arg_max(u, (n, -u)) AS big FROM roots JOIN trunks ON label = u GROUP BY root),
moved AS (SELECT point_id, coalesce(big, tree_seed) AS label FROM points LEFT JOIN roots ON u = tree_seed LEFT JOIN largest USING (root) WHERE classification = 7)
SELECT point_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS label FROM moved""",
    recursive=True,
)
def merge_trunks(spark, sf_dir):
    return clusters.merge_trunks(_seeds(_trees(spark, sf_dir)), 3.6, (0.5, 2.0), 30).select("point_id", "label")


@_query("""SELECT tree_seed AS cluster, count(*) AS n, round(covar_pop(x, x), 6) AS cov_xx, round(covar_pop(x, y), 6) AS cov_xy, round(covar_pop(x, z), 6) AS cov_xz,
  round(covar_pop(y, y), 6) AS cov_yy, round(covar_pop(y, z), 6) AS cov_yz, round(covar_pop(z, z), 6) AS cov_zz FROM points WHERE classification = 7 GROUP BY tree_seed""")
def cluster_covariance(spark, sf_dir):
    own = _trees(spark, sf_dir).withColumn("cluster", F.col("tree_seed"))
    return shapes.covariances(own).select("cluster", "n", *(F.round(f"cov_{p}", 6).alias(f"cov_{p}") for p in shapes.PAIRS))


def _axes(src: str, least: int) -> str:
    """Tables that end in trunks: eigenvalues of each cluster's covariance in closed form, and the upright part of the main axis."""
    return f"""covs AS (SELECT cluster, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM {src} GROUP BY cluster),
mids AS (SELECT *, (xx + yy + zz) / 3 AS q FROM covs),
scaled AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM mids),
turned AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 ELSE 0 END AS phi FROM scaled),
roots3 AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM turned),
minors AS (SELECT *, 3 * q - l1 - l3 AS l2, (yy - l1) * (zz - l1) - yz * yz AS mx, (xx - l1) * (zz - l1) - xz * xz AS my, (xx - l1) * (yy - l1) - xy * xy AS mz FROM roots3),
trunks3 AS (SELECT cluster, n, CASE WHEN l1 > 0 THEN (l1 - greatest(l2, 0)) / l1 ELSE 0 END AS linearity, CASE WHEN p > 0 THEN sqrt(greatest(mz / (mx + my + mz), 0)) ELSE 1 END AS upright, n >= {least} AS enough FROM minors),
trunks AS (SELECT *, enough AND linearity >= 0.55 AND upright >= 0.70 AS is_trunk FROM trunks3)"""


def _hulls(name: str, spots: str) -> str:
    """A table of hull areas from the different places (cluster, x, y) that ``spots`` gives."""
    return f"""{name}_spots AS ({spots}),
{name}_turns AS (SELECT a.cluster, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy, min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS least,
    max(CASE WHEN (b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND ((c.x - a.x) * (c.x - b.x) > 0 OR (c.y - a.y) * (c.y - b.y) > 0) THEN 1 ELSE 0 END) AS beyond
  FROM {name}_spots a JOIN {name}_spots b ON a.cluster = b.cluster AND (a.x <> b.x OR a.y <> b.y) JOIN {name}_spots c ON a.cluster = c.cluster GROUP BY a.cluster, a.x, a.y, b.x, b.y),
{name} AS (SELECT cluster, nullif(sum(ax * byy - bx * ay) / 2, 0) AS area FROM {name}_turns WHERE least >= 0 AND beyond = 0 GROUP BY cluster)"""


def _report(src: str) -> str:
    """Tables that end in report: what the shrub filter looks at."""
    return f"""lowest AS (SELECT cluster, arg_min(x, (z, point_id)) AS qx, arg_min(y, (z, point_id)) AS qy, min(z) AS low_z, max(z) - min(z) AS height FROM {src} GROUP BY cluster),
levels AS (SELECT cluster, avg(g.z) AS ground_z FROM lowest JOIN points g ON g.classification = 1 AND abs(g.x - qx) <= 0.75 AND abs(g.y - qy) <= 0.75 GROUP BY cluster),
section AS (SELECT s.* FROM {src} s JOIN levels USING (cluster) WHERE s.z BETWEEN ground_z AND ground_z + 0.4::DOUBLE),
counts AS (SELECT cluster, count(*) AS base_n FROM section GROUP BY cluster),
{_hulls('bases', 'SELECT DISTINCT cluster, x, y FROM section')},
{_hulls('wholes', f'SELECT DISTINCT cluster, x, y FROM {src}')},
widths AS (SELECT cluster, ground_z, low_z, height, coalesce(base_n, 0) AS base_n, bases.area / pi() AS base_width, wholes.area / pi() AS width
  FROM lowest LEFT JOIN levels USING (cluster) LEFT JOIN counts USING (cluster) LEFT JOIN bases USING (cluster) LEFT JOIN wholes USING (cluster)),
report AS (SELECT *, coalesce(base_n >= 3 AND base_width <= 5 AND abs(low_z - ground_z) <= 0.4::DOUBLE AND width > 0 AND height / width >= 0.6::DOUBLE AND height / width <= 1.4::DOUBLE, FALSE) AS is_shrub FROM widths)"""


_SEEDED = "mine AS (SELECT point_id, x, y, z, tree_seed AS cluster FROM points WHERE classification = 7)"


@_query(f"{_SEEDED}, {_axes('mine', 30)} SELECT cluster, n, round(linearity, 6) AS linearity, round(upright, 6) AS upright, is_trunk FROM trunks")
def partial_trunks(spark, sf_dir):
    own = _trees(spark, sf_dir).withColumn("cluster", F.col("tree_seed"))
    return shapes.partial_trunks(own, min_points=30).select("cluster", "n", F.round("linearity", 6).alias("linearity"), F.round("upright", 6).alias("upright"), "is_trunk")


@_query(f"{_SEEDED}, {_hulls('hulls', 'SELECT DISTINCT cluster, x, y FROM mine')} SELECT DISTINCT mine.cluster, round(area, 6) AS area FROM mine LEFT JOIN hulls USING (cluster)")
def hull_areas(spark, sf_dir):
    own = _trees(spark, sf_dir).withColumn("cluster", F.col("tree_seed"))
    return shapes.hull_areas(own).select("cluster", F.round("area", 6).alias("area"))


@_query(f"{_SEEDED}, {_report('mine')} SELECT cluster, round(ground_z, 6) AS ground_z, low_z, height, base_n, round(base_width, 6) AS base_width, round(width, 6) AS width, is_shrub FROM report")
def shrub_filter(spark, sf_dir):
    own = _trees(spark, sf_dir).withColumn("cluster", F.col("tree_seed"))
    found = shapes.shrub_report(own, _ground(spark, sf_dir))
    return found.select("cluster", F.round("ground_z", 6).alias("ground_z"), "low_z", "height", "base_n", F.round("base_width", 6).alias("base_width"), F.round("width", 6).alias("width"), "is_shrub")


@_query(
    f"""{_components('xy', 2)}, mine AS (SELECT point_id, x, y, z, cluster FROM member), {_report('mine')}, {_axes('mine', 100)},
passing AS (SELECT cluster, CAST(row_number() OVER (ORDER BY cluster) - 1 AS INT) AS shrub FROM report JOIN trunks USING (cluster) WHERE is_shrub AND NOT is_trunk)
SELECT p.point_id, coalesce(shrub, -1) AS shrub_id FROM points p LEFT JOIN mine USING (point_id) LEFT JOIN passing USING (cluster) WHERE classification <> 1""",
    recursive=True,
)
def shrub_instances(spark, sf_dir):
    own = fixtures.points(spark, sf_dir).where("classification <> 1").withColumn("tree_id", F.when(F.col("classification") == 2, F.lit(UNASSIGNED)).otherwise(F.col("tree_seed")))
    return shapes.shrubs(own, _ground(spark, sf_dir)).select("point_id", "shrub_id")


@_query("SELECT classification, count(*) AS n, min(z) AS low, max(z) AS high, CAST(ceil(count(*) / 100) AS BIGINT) AS chunks FROM points GROUP BY classification")
def view_limits(spark, sf_dir):
    return views.colour_limits(fixtures.points(spark, sf_dir), "z", "classification", 100)


_GAPS = """gaps AS (SELECT * FROM (SELECT *, lead(x) OVER w AS ax, lead(y) OVER w AS ay, lead(z) OVER w AS az FROM
  (SELECT point_id, x, y, z, floor(x * 4.0::DOUBLE) AS cx, floor(y * 4.0::DOUBLE) AS cy FROM points WHERE classification = 7) WINDOW w AS (PARTITION BY cx, cy ORDER BY z, point_id)) WHERE az IS NOT NULL),
ordered AS (SELECT az - z AS gap, row_number() OVER (ORDER BY az - z) - 1 AS k, count(*) OVER () AS n FROM gaps),
dense AS (SELECT gap AS d FROM ordered WHERE k = least(CAST(floor(n * 40 / 100) AS BIGINT), n - 1))"""


@_query(f"{_GAPS} SELECT d AS dense FROM dense")
def dense_gap(spark, sf_dir):
    found = densify.dense_gap(densify.vertical_gaps(_trees(spark, sf_dir)), 40.0)
    return spark.createDataFrame([(found,)], "dense double")


@_query(f"""{_GAPS},
wide AS (SELECT gaps.*, CAST(ceil((az - z) / d) AS INT) - 1 AS n FROM gaps, dense WHERE az - z BETWEEN 2.0::DOUBLE * d AND 6 AND d > 0)
SELECT point_id, x, y, z, TRUE AS original FROM points WHERE classification = 7 UNION ALL
SELECT point_id, round(x + (ax - x) * (i / (n + 1)::DOUBLE), 9), round(y + (ay - y) * (i / (n + 1)::DOUBLE), 9), round(z + (az - z) * (i / (n + 1)::DOUBLE), 9), FALSE FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM wide WHERE n > 0)""")
def densify_columns(spark, sf_dir):
    found = densify.densified(_trees(spark, sf_dir), 0.25, 6.0, 2.0, 40.0)
    return found.select("point_id", *(F.round(a, 9).alias(a) for a in "xyz"), "original")


_BINS = """lines AS (SELECT point_source_id, count(*) AS n, min(gps_time) AS t_min, max(gps_time) AS t_max, max(abs(scan_angle_deg)) > 5 AS valid,
    CASE WHEN max(gps_time) - min(gps_time) < 1 THEN 1 ELSE CAST(floor(max(gps_time) - min(gps_time)) AS BIGINT) + 1 END AS bins FROM points GROUP BY point_source_id),
raw AS (SELECT p.*, t_min, t_max, bins, (t_max - t_min) / bins AS step, CASE WHEN t_max > t_min THEN CAST(floor((gps_time - t_min) / ((t_max - t_min) / bins)) AS BIGINT) ELSE 0 END AS r FROM points p JOIN lines USING (point_source_id)),
binned AS (SELECT *, greatest(0, least(CASE WHEN gps_time < t_min + r * step THEN r - 1 WHEN gps_time >= t_min + (r + 1) * step THEN r + 1 ELSE r END, bins - 1)) AS bin FROM raw),
centres AS (SELECT point_source_id, bin, avg(x) AS cx, avg(y) AS cy, avg(z) FILTER (abs(scan_angle_deg) > 5) AS mz FROM binned GROUP BY ALL),
rises AS (SELECT point_source_id, bin, median(CASE WHEN abs(scan_angle_deg) > 5 THEN sqrt(pow(cx - x, 2) + pow(cy - y, 2)) / tan(radians(abs(scan_angle_deg))) END) AS rise FROM binned JOIN centres USING (point_source_id, bin) GROUP BY ALL),
raw_heights AS (SELECT point_source_id, bin, cx, cy, mz + rise AS h FROM centres JOIN rises USING (point_source_id, bin)),
both_sides AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY point_source_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
    first_value(h IGNORE NULLS) OVER (PARTITION BY point_source_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM raw_heights),
heights AS (SELECT point_source_id, bin, cx, cy, coalesce(h, (b + a) / 2, b, a) AS height FROM both_sides)"""


@_query(f"{_BINS} SELECT point_source_id, n, t_min, t_max, valid, CAST(bins AS BIGINT) AS bins FROM lines")
def flight_lines(spark, sf_dir):
    return rays.flight_lines(fixtures.points(spark, sf_dir))


@_query(f"{_BINS} SELECT point_id, CAST(bin AS BIGINT) AS bin FROM binned")
def rays_bins(spark, sf_dir):
    return rays.binned(fixtures.points(spark, sf_dir)).select("point_id", "bin")


@_query(f"{_BINS} SELECT point_source_id, CAST(bin AS BIGINT) AS bin, round(cx, 6) AS cx, round(cy, 6) AS cy, round(height, 6) AS height FROM heights")
def sensor_heights(spark, sf_dir):
    found = rays.sensor_heights(fixtures.points(spark, sf_dir))
    return found.select("point_source_id", "bin", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "height")))


@_query(f"{_BINS} SELECT point_id, round(CAST(CAST(cx - x AS FLOAT) AS DOUBLE), 3) AS ray_x, round(CAST(CAST(cy - y AS FLOAT) AS DOUBLE), 3) AS ray_y, round(CAST(CAST(height - z AS FLOAT) AS DOUBLE), 3) AS ray_z FROM binned JOIN heights USING (point_source_id, bin)")
def ray_vectors(spark, sf_dir):
    return rays.rays(fixtures.points(spark, sf_dir)).select("point_id", *(F.round(F.col(f"ray_{a}").cast("double"), 3).alias(f"ray_{a}") for a in "xyz"))


@_query("SELECT count(*) AS points, '' AS ray_dimensions, TRUE AS has_time, TRUE AS has_source, TRUE AS has_angle, TRUE AS rays_possible FROM points")
def schema_report(spark, sf_dir):
    return las.schema_report(fixtures.points(spark, sf_dir))


@_query("""SELECT p.point_id, p.z - arg_min(g.z, (pow(p.x - g.x, 2) + pow(p.y - g.y, 2), g.point_id)) AS height
  FROM points p JOIN points g ON p.classification = 7 AND g.classification = 1 AND abs(p.x - g.x) <= 8 AND abs(p.y - g.y) <= 8 GROUP BY p.point_id, p.z""")
def height_above_ground(spark, sf_dir):
    return nearest.height_above_ground(_trees(spark, sf_dir), _ground(spark, sf_dir)).select("point_id", "height")


@_query("""SELECT point_id, target_id, CAST(n AS INT) AS rank FROM (SELECT p.point_id, g.point_id AS target_id, row_number() OVER (PARTITION BY p.point_id ORDER BY pow(p.x - g.x, 2) + pow(p.y - g.y, 2), g.point_id) AS n
  FROM points p JOIN points g ON p.classification = 2 AND g.classification = 1) WHERE n <= 10""")
def nearest_ground(spark, sf_dir):
    queries = fixtures.of_class(spark, sf_dir, 2).select(F.col("point_id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    targets = _ground(spark, sf_dir).select(F.col("point_id").alias("tid"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    found = nearest.nearest(queries, targets, 10)
    return found.select(F.col("qid").alias("point_id"), F.col("tid").alias("target_id"), F.col("rank").cast("int").alias("rank"))


@_query("""SELECT p.point_id, round(avg(g.z), 9) AS ground_z, count(*) AS n FROM points p JOIN points g ON p.classification = 7 AND g.classification = 1
  AND abs(p.x - g.x) <= 0.75 AND abs(p.y - g.y) <= 0.75 GROUP BY p.point_id""")
def ground_box_mean(spark, sf_dir):
    queries = _trees(spark, sf_dir).select(F.col("point_id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return nearest.box_mean(queries, _ground(spark, sf_dir)).select(F.col("qid").alias("point_id"), F.round("ground_z", 9).alias("ground_z"), "n")


@_query(f"""{_KEPT}
SELECT p.point_id, arg_min(k.point_id, (pow(p.x - k.x, 2) + pow(p.y - k.y, 2) + pow(p.z - k.z, 2), k.point_id)) AS sample_id
FROM points p JOIN kept k ON p.classification = 7 AND abs(p.x - k.x) <= 1 AND abs(p.y - k.y) <= 1 AND abs(p.z - k.z) <= 1 GROUP BY p.point_id""")
def label_upsampling(spark, sf_dir):
    own = _trees(spark, sf_dir)
    sample = ground.subsampled(own, 0.5).where("kept").withColumn("sample_id", F.col("point_id"))
    return nearest.upsampled(own, sample, "sample_id", 0.5).select("point_id", "sample_id")


_WOOD = """feet AS (SELECT DISTINCT tree_seed AS s, (tree_seed % 16) * 4 + 1.0::DOUBLE AS px, floor(tree_seed / 16) * 4 + 1.0::DOUBLE AS py, (tree_seed % 8) * 0.125::DOUBLE AS pz FROM points),
wood AS (SELECT DISTINCT point_id FROM points JOIN feet ON z - pz BETWEEN -0.25 AND 8.25 AND (x - px) * (x - px) + (y - py) * (y - py) < 0.5625::DOUBLE WHERE classification = 7)"""


@_query(f"{_WOOD} SELECT point_id FROM wood")
def wood_cylinders(spark, sf_dir):
    own = _trees(spark, sf_dir)
    return woodleaf.in_cylinders(own, fixtures.cylinders(own), 0.25)


@_query(f"{_WOOD} SELECT point_id, CAST(CASE WHEN wood.point_id IS NULL THEN 1 ELSE 0 END AS TINYINT) AS wood_leaf FROM points LEFT JOIN wood USING (point_id) WHERE classification = 7")
def wood_leaf_labels(spark, sf_dir):
    own = _trees(spark, sf_dir).withColumn("tree_id", F.col("tree_seed"))
    tops = fixtures.cylinders(own)
    roots = tops.select("tree_no", F.lit(0).alias("seg_no"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), "radius", F.lit(-1).alias("parent_id"), F.lit(0).alias("section_id"))
    ends = tops.select("tree_no", "seg_no", "x", "y", "z", "radius", F.lit(0).alias("parent_id"), F.lit(0).alias("section_id"))
    return woodleaf.wood_leaf(own, roots.unionByName(ends), 0.25).select("point_id", "wood_leaf")


@_query(
    f"""{_WOOD},
soil AS (SELECT point_id, x, y, z FROM points WHERE classification = 1),
heights AS (SELECT p.point_id, p.z - arg_min(g.z, (pow(p.x - g.x, 2) + pow(p.y - g.y, 2), g.point_id)) AS h FROM points p JOIN soil g ON abs(p.x - g.x) <= 8 AND abs(p.y - g.y) <= 8 WHERE p.classification = 7 GROUP BY p.point_id, p.z),
own AS (SELECT p.point_id, p.tree_seed AS s, p.x, p.y, p.z, wood.point_id IS NOT NULL AS is_wood FROM points p JOIN heights ON heights.point_id = p.point_id AND h <= 6 LEFT JOIN wood ON wood.point_id = p.point_id WHERE p.classification = 7),
near AS (SELECT a.point_id AS u, b.point_id AS v FROM own a JOIN own b ON a.s = b.s AND NOT a.is_wood AND a.point_id <> b.point_id AND pow((a.x - b.x) / 0.5, 2) + pow((a.y - b.y) / 0.5, 2) + pow((a.z - b.z) / 1.0, 2) <= 1),
rounds AS (SELECT 0 AS r, list(point_id) AS ids FROM own WHERE is_wood
  UNION ALL SELECT r + 1, list_distinct(list_concat(ids, (SELECT list(u) FROM (SELECT u FROM near WHERE list_contains(rounds.ids, v) GROUP BY u HAVING count(*) >= 3)))) FROM rounds WHERE r < 12),
final AS (SELECT unnest(ids) AS point_id FROM rounds WHERE r = 12)
SELECT p.point_id, CAST(CASE WHEN f.point_id IS NOT NULL OR wood.point_id IS NOT NULL THEN 0 ELSE 1 END AS TINYINT) AS wood_leaf FROM points p LEFT JOIN final f ON f.point_id = p.point_id LEFT JOIN wood ON wood.point_id = p.point_id WHERE classification = 7""",
    recursive=True,
)
def wood_propagate(spark, sf_dir):
    own = _trees(spark, sf_dir).withColumn("tree_id", F.col("tree_seed"))
    wood = woodleaf.in_cylinders(own, fixtures.cylinders(own), 0.25).withColumn("w", F.lit(True))
    start = own.join(shuffled(wood), "point_id", "left").withColumn("wood_leaf", F.when(F.col("w"), F.lit(0)).otherwise(F.lit(1)).cast("byte")).drop("w")
    return woodleaf.propagated(written(start, "start"), _ground(spark, sf_dir), 6.0, 0.5, 3, 1.0).select("point_id", "wood_leaf")


@_query("SELECT point_id, CAST(CASE WHEN classification = 7 AND tree_seed % 2 = 0 THEN 1 ELSE -1 END AS TINYINT) AS wood_leaf FROM points")
def wood_reset(spark, sf_dir):
    own = _both(spark, sf_dir).withColumn("wood_leaf", F.lit(1).cast("byte"))
    return own.select("point_id", labels.wood_reset().alias("wood_leaf"))


@_query("SELECT point_id, CASE WHEN classification = 7 THEN tree_seed ELSE -1 END AS label FROM points")
def scatter_labels(spark, sf_dir):
    own = fixtures.points(spark, sf_dir)
    return labels.scattered(own, _seeds(_trees(spark, sf_dir)), "label").select("point_id", "label")


@_query("SELECT tree_seed AS label, arg_min(point_id, (z, point_id)) AS lowest, max(z) - min(z) AS height FROM points WHERE classification = 7 GROUP BY tree_seed")
def lowest_points(spark, sf_dir):
    return shapes.lowest_points(_seeds(_trees(spark, sf_dir)), "label").select("label", F.col("low.point_id").alias("lowest"), "height")


@_query()
def coarse_groups(spark, sf_dir):
    return pipeline.coarse_groups(_trees(spark, sf_dir), 4, 0.5).groupBy("group").agg(F.count("*").alias("n"))


@_query()
def segment_summary(spark, sf_dir):
    config = Config(ground_label=1, tree_label=7, height_min=1.0, distance_limit=0.6)
    found = pipeline.segment(fixtures.points(spark, sf_dir), config, min_tree_points=20, grounded_size=20)
    return found.groupBy("instance_id", "species_id", "wood_leaf").agg(F.count("*").alias("n"))
