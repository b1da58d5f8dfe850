"""Command line: segment a point file."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators import stems, views
from ..schema import Config
from ..sources import las
from . import pipeline
from .scratch import written


def parser() -> argparse.ArgumentParser:
    """The options."""
    out = argparse.ArgumentParser(description="Segment a point cloud into trees and shrubs.")
    out.add_argument("--input-path", required=True)
    out.add_argument("--config-path")
    out.add_argument("--output-path")
    out.add_argument("--verbose", action=argparse.BooleanOptionalAction, default=True)
    out.add_argument("--labels-path", help="cloud of an earlier extraction, coloured by instance (PLY); needs --trees-path")
    out.add_argument("--trees-path", help="branch cylinders of an earlier extraction (text)")
    out.add_argument("--plot", action=argparse.BooleanOptionalAction, default=False, help="print points per instance")
    return out


def main(argv: list[str] | None = None) -> int:
    """Read, segment, save."""
    args = parser().parse_args(argv)
    config = Config.load(cfg={} if args.config_path is None else None, cfg_path=args.config_path, verbose=args.verbose)
    spark = SparkSession.builder.getOrCreate()
    source = Path(args.input_path)
    points = spark.read.parquet(str(source)) if source.suffix == ".parquet" else las.read_las(spark, str(source))
    if (args.labels_path is None) != (args.trees_path is None):
        raise SystemExit("--labels-path and --trees-path go together")
    extract = stems.from_files(args.labels_path, args.trees_path) if args.labels_path else stems.extracted
    found = written(pipeline.segment(points, config, extract), "segmented")
    suffix = ".parquet" if source.suffix == ".parquet" else ".las"
    las.save_ids(found, args.output_path or str(source.with_name(f"{source.stem}_segmented{suffix}")))
    if args.plot:
        for row in views.colour_limits(found.where("instance_id >= 0 and wood_leaf >= 0"), "z", "instance_id").orderBy("instance_id").collect():
            print(f"tree {row['instance_id']}: {row['n']} points, z from {row['low']:.2f} to {row['high']:.2f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
