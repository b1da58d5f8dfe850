"""LAS files: reading uncompressed points by ranges of bytes, header reports, and saving ids as extra bytes."""

from __future__ import annotations

import logging
import os
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Record layouts by point format, after the public LAS specification.
_OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("class_byte", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("class_byte", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_TIME, _RGB = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
FORMATS = {0: _OLD, 1: _OLD + _TIME, 2: _OLD + _RGB, 3: _OLD + _TIME + _RGB, 6: _NEW, 7: _NEW + _RGB}
log = logging.getLogger(__name__)


#: Extra-byte types of the specification that are one number each, by their code.
EXTRA = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
SPARK_KINDS = {"u1": "short", "i1": "byte", "<u2": "int", "<i2": "short", "<u4": "long", "<i4": "int", "<u8": "decimal(20,0)", "<i8": "long", "<f4": "float", "<f8": "double"}
POINTS = "point_id long, x double, y double, z double, classification int, gps_time double, point_source_id int, scan_angle_deg double"
#: Records of a range, and of a batch within it.
RANGE, BATCH = 1 << 21, 1 << 16


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path there."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else f"file://{os.path.abspath(uri)}")


def parse_header(head: bytes) -> dict:
    """Point format, record length, count, scales, offsets, and what follows the header."""
    if head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    size, start, n_records = struct.unpack_from("<HII", head, 94)
    kind, length = struct.unpack_from("<BH", head, 104)
    count = struct.unpack_from("<I", head, 107)[0]
    if head[25] >= 4 and size >= 375:
        count = struct.unpack_from("<Q", head, 247)[0]
    if kind & 0xC0:
        raise ValueError("compressed points need a decoder, and none is present")
    if kind not in FORMATS:
        raise ValueError(f"point format {kind} is not supported")
    values = struct.unpack_from("<6d", head, 131)
    return {"format": kind, "length": length, "count": count, "start": start, "size": size, "records": n_records, "scale": values[:3], "offset": values[3:]}


def extra_fields(info: dict, head: bytes) -> list[tuple[str, str, int]]:
    """Names, types and places of the extra bytes that the file describes; ``head`` reaches to the first point."""
    at, place, out = info["size"], np.dtype(FORMATS[info["format"]]).itemsize, []
    for _ in range(info["records"]):
        user, record, length = head[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", head, at + 18)
        body = head[at + 54 : at + 54 + length]
        at += 54 + length
        if (user, record) != (b"LASF_Spec", 4):
            continue
        for k in range(0, len(body) - 191, 192):
            code, name = body[k + 2], body[k + 4 : k + 36].rstrip(b"\0").decode("ascii", "replace")
            if code in EXTRA:
                out.append((name, EXTRA[code], place))
            place += np.dtype(EXTRA[code]).itemsize if code in EXTRA else body[k + 3] if code == 0 else 0
    return out


def read_head(uri: str) -> tuple[dict, list[tuple[str, str, int]]]:
    """A file's header and its extra fields."""
    system, path = opened(uri)
    with system.open_input_file(path) as source:
        info = parse_header(source.read(375))
        source.seek(0)
        return info, extra_fields(info, source.read(info["start"]))


def record_type(info: dict, extra: list[tuple[str, str, int]] = ()) -> np.dtype:
    """The records' layout; bytes that nothing describes are left out."""
    plain = np.dtype(FORMATS[info["format"]])
    names = [*plain.names, *(f"extra_{n}" for n, _, _ in extra)]
    formats = [*(plain[n] for n in plain.names), *(k for _, k, _ in extra)]
    places = [*(plain.fields[n][1] for n in plain.names), *(at for _, _, at in extra)]
    return np.dtype({"names": names, "formats": formats, "offsets": places, "itemsize": info["length"]})


def columns_of(r: np.ndarray, info: dict, extra: list[tuple[str, str, int]], ids: np.ndarray) -> pa.RecordBatch:
    """Records as a batch of ``POINTS`` and the extra fields."""
    own = set(r.dtype.names)
    flags = 31 if info["format"] < 6 else 255
    out = {"point_id": pa.array(ids, pa.int64())}
    out |= {x.lower(): pa.array(r[x] * info["scale"][i] + info["offset"][i], pa.float64()) for i, x in enumerate("XYZ")}
    out["classification"] = pa.array((r["class_byte"] & flags).astype("i4"))
    out["gps_time"] = pa.array(np.ascontiguousarray(r["gps_time"])) if "gps_time" in own else pa.nulls(len(r), pa.float64())
    out["point_source_id"] = pa.array(r["point_source_id"].astype("i4"))
    out["scan_angle_deg"] = pa.array(r["scan_angle_rank"].astype("f8") if "scan_angle_rank" in own else r["scan_angle"] * 0.006)
    wider = {"u1": "i2", "<u2": "i4", "<u4": "i8"}
    for name, kind, _ in extra:
        values = np.ascontiguousarray(r[f"extra_{name}"])
        out[name] = pa.array([int(v) for v in values], pa.decimal128(20, 0)) if kind == "<u8" else pa.array(values.astype(wider.get(kind, kind)))
    return pa.RecordBatch.from_pydict(out)


class Range(InputPartition):
    """A run of records of one file."""

    def __init__(self, uri: str, begin: int, end: int, base: int) -> None:
        self.uri, self.begin, self.end, self.base = uri, begin, end, base


class LasReader(DataSourceReader):
    """Reads runs of records by their bytes, so a file may be of any size and is read by many tasks."""

    def __init__(self, uris: list[str], extra: list[tuple[str, str, int]]) -> None:
        self.uris, self.extra = uris, extra

    def partitions(self) -> list[Range]:
        """Runs of ``RANGE`` records of each file."""
        out = []
        for i, uri in enumerate(self.uris):
            count = read_head(uri)[0]["count"]
            out += [Range(uri, a, min(a + RANGE, count), i << 40) for a in range(0, count, RANGE)]
        return out or [Range(self.uris[0], 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The run's records, batch by batch."""
        info, extra = read_head(partition.uri)
        if [x[:2] for x in extra] != [x[:2] for x in self.extra]:
            raise ValueError(f"{partition.uri} has other extra fields than the first file")
        kind = record_type(info, extra)
        system, path = opened(partition.uri)
        with system.open_input_file(path) as source:
            for a in range(partition.begin, partition.end, BATCH):
                n = min(BATCH, partition.end - a)
                source.seek(info["start"] + a * info["length"])
                data = source.read(n * info["length"])
                if len(data) < n * info["length"]:
                    raise ValueError(f"{partition.uri} ends within its points")
                yield columns_of(np.frombuffer(data, kind, n), info, extra, partition.base + np.arange(a, a + n))


class LasSource(DataSource):
    """``spark.read.format("las_points")``: points of uncompressed LAS files."""

    @classmethod
    def name(cls) -> str:
        return "las_points"

    def _found(self) -> tuple[list[str], list[tuple[str, str, int]]]:
        uris = listed(self.options["path"])
        return uris, read_head(uris[0])[1]

    def schema(self) -> str:
        return ", ".join([POINTS, *(f"`{n}` {SPARK_KINDS[k]}" for n, k, _ in self._found()[1])])

    def reader(self, schema) -> LasReader:
        return LasReader(*self._found())


def listed(path: str) -> list[str]:
    """The file itself, or the .las files of a folder, sorted."""
    system, own = opened(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.Directory:
        names = sorted(f.path for f in system.get_file_info(fs.FileSelector(own, recursive=True)) if f.is_file and f.extension.lower() == "las")
        prefix = path[: path.index("://") + 3] if "://" in path else ""
        found = [n if not prefix else prefix + n.lstrip("/") if prefix != "file://" else prefix + n for n in names]
    else:
        found = [path] if info.type == fs.FileType.File else []
    if not found:
        raise FileNotFoundError(f"no LAS file at {path}")
    return found


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """Points of one file, or of all .las files in a folder: ids, scaled coordinates, class, flight metadata and extra fields.

    Files are read by ranges of bytes; ids count within a file, with the file's
    place among the sorted paths in the high bits.  A .laz file needs the laspy
    package with one of its decoders, and is then one task; without it, it is
    refused.
    """
    if path.lower().endswith(".laz"):
        return _read_compressed(spark, path)
    spark.dataSource.register(LasSource)
    return spark.read.format("las_points").option("path", path).load()


def _read_compressed(spark: SparkSession, path: str) -> DataFrame:
    try:
        import laspy
    except ImportError as error:
        raise ValueError("compressed points need a decoder, and none is present") from error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in (name for batch in batches for name in batch.column(0).to_pylist()):
            at = 0
            with laspy.open(path) as source:
                for chunk in source.chunk_iterator(BATCH):
                    own = set(chunk.point_format.dimension_names)
                    angle = np.asarray(chunk.scan_angle_rank, "f8") if "scan_angle_rank" in own else np.asarray(chunk.scan_angle) * 0.006
                    time = np.asarray(chunk.gps_time, "f8") if "gps_time" in own else np.full(len(chunk), np.nan)
                    values = [at + np.arange(len(chunk)), *(np.asarray(getattr(chunk, a), "f8") for a in "xyz"), np.asarray(chunk.classification, "i4"), time, np.asarray(chunk.point_source_id, "i4"), angle]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], [c.split()[0] for c in POINTS.split(", ")])
                    at += len(chunk)

    return spark.createDataFrame([(path,)], "path string").mapInArrow(run, POINTS)


def inspected(spark: SparkSession, path: str) -> DataFrame:
    """A row about what a file offers for rays; a file that can't be read is logged and reported."""
    row: dict = {"path": path, "readable": False, "points": None, "dimensions": None, "ray_dimensions": None, "has_time": None, "has_source": None, "has_angle": None, "rays_possible": None}
    try:
        info = read_head(path)[0]
        dims = [n for n, _ in FORMATS[info["format"]]]
        time, angle = "gps_time" in dims, bool({"scan_angle", "scan_angle_rank"} & set(dims))
        row |= {"readable": True, "points": info["count"], "dimensions": dims, "ray_dimensions": [d for d in dims if any(w in d.lower() for w in ("sensor", "ray", "origin"))], "has_time": time, "has_source": True, "has_angle": angle, "rays_possible": time and angle}
    except (OSError, ValueError, struct.error) as error:
        log.error("%s can't be read: %s", path, error)
    schema = "path string, readable boolean, points long, dimensions array<string>, ray_dimensions array<string>, has_time boolean, has_source boolean, has_angle boolean, rays_possible boolean"
    return spark.createDataFrame([row], schema)


def schema_report(points: DataFrame) -> DataFrame:
    """The same report on a table's columns."""
    names = {c.lower() for c in points.columns}
    time, source, angle = "gps_time" in names, "point_source_id" in names, bool(names & {"scan_angle", "scan_angle_rank", "scan_angle_deg"})
    rays = sorted(c for c in names if any(w in c for w in ("sensor", "ray", "origin")))
    return points.agg(F.count("*").alias("points")).select("points", F.lit(",".join(rays)).alias("ray_dimensions"), *(F.lit(v).alias(n) for n, v in (("has_time", time), ("has_source", source), ("has_angle", angle), ("rays_possible", time and source and angle))))


def save_ids(points: DataFrame, out: str, field_name: str = "tree_ids", ids: str = "instance_id") -> Path:
    """Points with their instance ids as 32-bit integers; missing parents are made.

    A name that ends in .las makes a LAS file with the ids as an extra field, any
    other a Parquet table.
    """
    target = Path(out)
    os.makedirs(target.parent, exist_ok=True)
    named = points.withColumn(field_name, F.col(ids).cast("int"))
    if target.suffix == ".las":
        write_points(named, str(target), (field_name,))
    else:
        named.drop(*([ids] if ids != field_name else [])).write.mode("overwrite").parquet(str(target))
    return target


def write_points(points: DataFrame, path: str, extra: tuple[str, ...] = (), scale: float = 0.001) -> int:
    """A LAS 1.4 file of format 6 in the order of point ids, with 32-bit extra fields; the number of points.

    The records come to the driver sorted, a range at a time.  Coordinates beyond
    what 32 bits hold at the scale raise.
    """
    low = points.agg(*(F.min(a) for a in "xyz"), *(F.max(a) for a in "xyz"), F.count("*")).head()
    n, own = low[6], set(points.columns)
    offset = [float(np.floor(v)) if v is not None else 0.0 for v in low[:3]]
    if any(v is not None and (v - o) / scale > 2**31 - 1 for v, o in zip(low[3:6], offset)):
        raise ValueError("the cloud is too large for the scale")
    kind = np.dtype(FORMATS[6] + [(f"extra_{e}", "<i4") for e in extra])
    named = [c for c in ("classification", "gps_time", "point_source_id", "scan_angle_deg") if c in own]
    rows = points.select("point_id", "x", "y", "z", *named, *extra).orderBy("point_id").drop("point_id")
    with open(path, "wb") as sink:
        sink.write(las_head(n, kind.itemsize, scale, offset, low[:3], low[3:6], extra))
        for batch in _in_order(rows):
            out = np.zeros(batch.num_rows, kind)
            get = lambda c, batch=batch: batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
            for i, a in enumerate("xyz"):
                out[a.upper()] = np.round((get(a) - offset[i]) / scale)
            out["returns"] = 0x11
            for c, name in (("classification", "class_byte"), ("gps_time", "gps_time"), ("point_source_id", "point_source_id")):
                if c in own:
                    out[name] = get(c)
            if "scan_angle_deg" in own:
                out["scan_angle"] = np.round(get("scan_angle_deg") / 0.006)
            for e in extra:
                out[f"extra_{e}"] = get(e)
            sink.write(out.tobytes())
    return n


def _in_order(rows: DataFrame) -> Iterator[pa.RecordBatch]:
    """A sorted table's numbers, partition by partition, as doubles or whole numbers."""
    kinds = [pa.float64() if t in ("double", "float") else pa.int64() for _, t in rows.dtypes]
    batch = lambda chunk: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*chunk), kinds)], rows.columns)
    chunk: list = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        chunk.append(tuple(row))
        if len(chunk) >= BATCH:
            yield batch(chunk)
            chunk = []
    if chunk:
        yield batch(chunk)


def las_head(n: int, length: int, scale: float, offset: list[float], low, high, extra: tuple[str, ...] = ()) -> bytes:
    """Header of a LAS 1.4 file of format 6, with the description of its 32-bit extra fields."""
    described = b"".join(struct.pack("<HBB32s4s24s24s24s24s24s32s", 0, 6, 0, e.encode("ascii")[:32], b"", b"", b"", b"", b"", b"", b"") for e in extra)
    record = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(described), b"extra fields") + described if extra else b""
    head = bytearray(375)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 4))
    struct.pack_into("<HII", head, 94, 375, 375 + len(record), 1 if extra else 0)
    struct.pack_into("<BH", head, 104, 6, length)
    struct.pack_into("<6d", head, 131, scale, scale, scale, *offset)
    for i, (a, b) in enumerate(zip(high, low)):
        struct.pack_into("<2d", head, 179 + 16 * i, a or 0.0, b or 0.0)
    struct.pack_into("<Q", head, 247, n)
    return bytes(head) + record


def write_las(path: str, xyz: np.ndarray, classification: np.ndarray, scale: float = 0.001, **extra: np.ndarray) -> None:
    """A small LAS 1.2 file of format 1, for tests and exports."""
    rows = np.zeros(len(xyz), np.dtype(FORMATS[1]))
    for i, a in enumerate("XYZ"):
        rows[a] = np.round(xyz[:, i] / scale)
    rows["class_byte"] = classification
    for name, values in extra.items():
        rows[name] = values
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 2))
    struct.pack_into("<HI", head, 94, 227, 227)
    struct.pack_into("<BHI", head, 104, 1, rows.dtype.itemsize, len(rows))
    struct.pack_into("<6d", head, 131, scale, scale, scale, 0, 0, 0)
    Path(path).write_bytes(bytes(head) + rows.tobytes())
