"""Sinks.  Files are written by the executors; a workbook by the driver, row by row."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.errors import SourceUnavailable

MODES = ("overwrite", "append", "error", "ignore")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local master may do without."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise SourceUnavailable("spark.checkpoint.dir is not set; a cluster needs a folder that all its machines share")
    return tempfile.mkdtemp(prefix="tarnwell-")


def write(df: DataFrame, kind: str, path: str, mode: str = "overwrite", options: dict | None = None) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    options = dict(options or {})
    match kind:
        case "parquet":
            df.write.mode(mode).options(**options).parquet(path)
        case "csv":
            nested = {n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))}
            void = {n for n, t in df.dtypes if t == "void"}
            flat = df.select(*[F.to_json(f"`{n}`").alias(n) if n in nested else F.col(f"`{n}`").cast("string").alias(n) if n in void else F.col(f"`{n}`") for n in df.columns])
            flat.write.mode(mode).option("header", True).option("escape", '"').options(**options).csv(path)
        case "json":
            df.write.mode(mode).options(**options).json(path)
        case "orc":
            df.write.mode(mode).options(**options).orc(path)
        case "excel":
            _excel(df, path, mode, options.get("sheet", "Sheet1"))
        case _:
            raise ValueError(f"no writer for {kind!r}")


def _excel(df: DataFrame, path: str, mode: str, sheet: str) -> None:
    from .excel import write_sheet

    if Path(path).exists():
        if mode == "error":
            raise FileExistsError(path)
        if mode == "ignore":
            return
    write_sheet(path, df.columns, (tuple(r) for r in df.toLocalIterator()), sheet, append=mode == "append")
