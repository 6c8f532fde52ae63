"""Sources: files, constant rows, Arrow tables, SQL databases, Mongo dumps, workbooks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.errors import SourceUnavailable, UnknownColumn


def read(spark: SparkSession, scan) -> DataFrame:
    """The DataFrame of a scan, with its columns selected where they are named."""
    reader = READERS.get(scan.kind)
    if reader is None:
        raise SourceUnavailable(f"no reader for {scan.kind!r}; there are {sorted(READERS)}")
    try:
        df = reader(spark, scan.location, dict(scan.options), scan.columns)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise SourceUnavailable(f"{scan.kind} at {scan.location}: {e.getCondition()}") from e
        raise
    if scan.columns:
        if missing := [c for c in scan.columns if c not in df.columns]:
            raise UnknownColumn(f"{scan.scope} has no column {missing[0]!r}; there are {df.columns}")
        df = df.select(*scan.columns)
    return df


def _dataframe(spark, df, options, columns):
    return df


def _parquet(spark, path, options, columns):
    return spark.read.parquet(path)


#: Bytes up to which a CSV is read whole by one task a file, so that quoted newlines need no search.
SMALL_CSV = 32 << 20


def _bytes_at(spark, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(s.getLen() if s.isFile() else system.getContentSummary(s.getPath()).getLength() for s in system.globStatus(place) or ())


def _has_quoted_newlines(spark, path: str) -> bool:
    """Whether some line has an odd number of quotes: one pass over splits, ended by the first."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def _csv(spark, path, options, columns):
    """``multi_line`` None: large files are split among tasks unless some field has a newline in it."""
    reader = spark.read.option("header", True).option("sep", options.get("delimiter") or ",")
    multi = options.get("multi_line")
    if multi is None:
        multi = _bytes_at(spark, path) <= SMALL_CSV or _has_quoted_newlines(spark, path)
    reader = reader.option("multiLine", bool(multi)).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    if options.get("schema"):
        return reader.schema(options["schema"]).csv(path)
    return reader.option("inferSchema", True).csv(path)


def _json(spark, path, options, columns):
    return spark.read.option("multiLine", bool(options.get("array"))).json(path)


def _const(spark, rows, options, columns):
    kinds = T._parse_datatype_string(options["schema"])
    if options.get("dicts"):
        rows = [tuple(dict(r).get(f.name) for f in kinds) for r in rows]
    return spark.createDataFrame(list(rows), kinds)


def _arrow(spark, table, options, columns):
    return spark.createDataFrame(table)


def _mongo(spark, path, options, columns):
    """JSON lines of extended JSON: ``{"$oid": x}`` and the like become x, nested values JSON text."""
    from .mongo import plain

    df = plain(spark.read.json(path))
    return df.where(options["match"].column()) if options.get("match") is not None else df


def _excel(spark, path, options, columns):
    from .excel import read_sheet, sheet_schema

    names, rows = read_sheet(path, **{k: v for k, v in options.items() if v is not None})
    # a workbook is a bounded table: a sheet has 1,048,576 rows at most
    return spark.createDataFrame(rows, sheet_schema(names, rows))


def _sql(spark, connection, options, columns):
    from .sql import read_sql

    return read_sql(spark, connection, columns=columns, **options)


READERS = {
    "dataframe": _dataframe,
    "parquet": _parquet,
    "csv": _csv,
    "json": _json,
    "const": _const,
    "arrow": _arrow,
    "mongo": _mongo,
    "excel": _excel,
    "sql": _sql,
    "orc": lambda spark, path, options, columns: spark.read.orc(path),
}
