"""PLY files: points with rays, ground meshes, and labels from colours."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import dense_index
from ..schema import UNASSIGNED

#: Field types of a PLY header.
KINDS = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}
VERTEX = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("time", "<f8"), ("nx", "<f4"), ("ny", "<f4"), ("nz", "<f4"), ("rgba", "u1", 4)])
DEFAULT_RAY = (0.0, 0.0, 10.0)


def header(n: int) -> bytes:
    """Header of a cloud of n vertices; the count has a fixed width."""
    names = ["float x", "float y", "float z", "double time", "float nx", "float ny", "float nz", "uchar red", "uchar green", "uchar blue", "uchar alpha"]
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {n:010d}", *(f"property {x}" for x in names), "end_header", ""]
    return "\n".join(lines).encode()


def write_cloud(points: DataFrame, path: str) -> int:
    """Points in the order of their ids; rays from ray_x, ray_y, ray_z if the table has them.

    The rows come to the driver partition by partition, sorted.
    """
    has_rays = {"ray_x", "ray_y", "ray_z"} <= set(points.columns)
    columns = ["x", "y", "z", *(("ray_x", "ray_y", "ray_z") if has_rays else ())]
    rows, n = points.select("point_id", *columns).orderBy("point_id"), 0
    with open(path, "wb") as sink:
        sink.write(header(0))
        chunk: list = []

        def flush() -> int:
            out = np.zeros(len(chunk), VERTEX)
            data = np.array(chunk, np.float64).reshape(-1, len(columns))
            for i, a in enumerate("xyz"):
                out[a] = data[:, i]
                out[f"n{a}"] = data[:, 3 + i] if has_rays else DEFAULT_RAY[i]
            out["rgba"] = 128
            sink.write(out.tobytes())
            return len(out)

        for row in rows.toLocalIterator(prefetchPartitions=True):
            chunk.append(tuple(row)[1:])
            if len(chunk) >= 100_000:
                n += flush()
                chunk.clear()
        n += flush() if chunk else 0
        sink.seek(0)
        sink.write(header(n))
    return n


def triangulated(xy: np.ndarray) -> np.ndarray:
    """Delaunay triangles of different points by incremental insertion."""
    centre, span = xy.mean(axis=0), max(float(np.ptp(xy, axis=0).max()), 1.0) * 1000
    pts = np.vstack([xy, centre + [[-span, -span], [span, -span], [0, span]]])
    n = len(xy)
    triangles = {(n, n + 1, n + 2)}

    def inside(t: tuple[int, int, int], p: np.ndarray) -> bool:
        (ax, ay), (bx, by), (cx, cy) = pts[list(t)] - p
        turn = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        det = (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)
        return det * np.sign(turn) > 1e-12

    for i in range(n):
        bad = [t for t in triangles if inside(t, pts[i])]
        edges: dict[frozenset, tuple[int, int]] = {}
        for t in bad:
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                key = frozenset((a, b))
                if edges.pop(key, None) is None:
                    edges[key] = (a, b)
        triangles.difference_update(bad)
        triangles.update((a, b, i) for a, b in edges.values())
    return np.array(sorted(t for t in triangles if max(t) < n), np.int32).reshape(-1, 3)


def write_ground_mesh(ground: DataFrame, path: str) -> int:
    """Ground points as a triangle mesh; the thinned ground is small, and is collected."""
    rows = ground.select("x", "y", "z", "point_id").orderBy("point_id").dropDuplicates(["x", "y"]).toPandas().sort_values("point_id")
    if len(rows) < 3:
        raise ValueError("a mesh needs three ground points")
    verts = rows[["x", "y", "z"]].to_numpy("<f4")
    faces = triangulated(verts[:, :2].astype(float))
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {len(verts)}", *(f"property float {a}" for a in "xyz"), f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header", ""]
    with open(path, "wb") as sink:
        sink.write("\n".join(lines).encode() + verts.tobytes())
        sink.write(b"".join(struct.pack("<Biii", 3, *map(int, f)) for f in faces))
    return len(faces)


def parsed(content: bytes) -> np.ndarray:
    """Vertices of a binary PLY file as a structured array."""
    end = content.find(b"end_header")
    end = content.index(b"\n", end) + 1
    kinds, n = [], 0
    for line in content[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:2] == ["element", "vertex"]:
            n = int(words[2])
        elif words[:1] == ["property"]:
            if words[1] not in KINDS:
                raise ValueError(f"unsupported property: {line}")
            kinds.append((words[2], KINDS[words[1]]))
    kind = np.dtype(kinds)
    if len(content) - end < n * kind.itemsize:
        raise ValueError("the file ends within its vertices")
    return np.frombuffer(content, kind, n, end)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """point_id, label from the colours of a segmented cloud: black is -1, others are ranked by packed colour from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                v = parsed(content)
                packed = v["red"].astype("i8") << 16 | v["green"].astype("i8") << 8 | v["blue"].astype("i8")
                for a in range(0, len(v), 1 << 20):
                    yield pd.DataFrame({"point_id": np.arange(a, min(len(v), a + (1 << 20))), "packed": packed[a : a + (1 << 20)]})

    colours = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "point_id long, packed long")
    index = dense_index(colours.where(F.col("packed") != 0), "packed", "label")
    return colours.join(index, "packed", "left").select("point_id", F.coalesce("label", F.lit(UNASSIGNED)).cast("int").alias("label"))
