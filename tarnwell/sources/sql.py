"""SQL databases: one statement with projection, predicate and limit inside it.

``sqlite:PATH`` is read with the standard library; anything else is a JDBC url,
whose pushdown Spark does itself.
"""

from __future__ import annotations

import sqlite3
import uuid
from contextlib import closing
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarnwell.errors import SourceUnavailable, UnmappableType
from tarnwell.plans.expr import Expr
from tarnwell.types import from_source

from .writers import shared_folder

# How a dialect quotes a name.
QUOTES = {"sqlite": '"', "postgresql": '"', "mysql": "`"}


def dialect_of(connection: str) -> str:
    head = connection.removeprefix("jdbc:").split(":", 1)[0].lower()
    if head not in QUOTES:
        raise SourceUnavailable(f"no dialect for {connection!r}; there are {sorted(QUOTES)}")
    return head


def quoted(name: str, dialect: str) -> str:
    q = QUOTES[dialect]
    return q + name.replace(q, q * 2) + q


def build_select(dialect: str, table: str | None = None, query: str | None = None, columns=(), predicate: Expr | None = None, limit: int | None = None) -> tuple[str, bool]:
    """The statement, and whether it has the predicate: an inexpressible one stays out as a whole."""
    if bool(table) == bool(query):
        raise ValueError("give a table or a query")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise ValueError("a limit is a whole number, not below 0")
    source = quoted(table, dialect) if table else f"({query.rstrip().rstrip(';')}) AS q"
    text = f"SELECT {', '.join(quoted(c, dialect) for c in columns) or '*'} FROM {source}"
    pushed = True
    if predicate is not None:
        try:
            text += f" WHERE {predicate.sql(QUOTES[dialect])}"
        except ValueError:
            pushed = False
    if limit is not None and pushed:
        text += f" LIMIT {limit}"
    return text, pushed


def read_sql(spark: SparkSession, connection: str, table=None, query=None, columns=(), predicate=None, limit=None, partition=None) -> DataFrame:
    """``partition`` is ``(column, lower, upper, n)``: JDBC reads the ranges in ``n`` tasks."""
    dialect = dialect_of(connection)
    # a predicate that can't be pushed needs its columns here
    text, pushed = build_select(dialect, table, query, columns, predicate, limit)
    if not pushed:
        text, _ = build_select(dialect, table, query)
    if dialect == "sqlite":
        df = _sqlite(spark, connection.split(":", 1)[1], text)
    else:
        df = jdbc_reader(spark, connection, text, partition).load()
    if not pushed:
        df = df.where(predicate.column())
        df = df.limit(limit) if limit is not None else df
    return df


def jdbc_reader(spark: SparkSession, connection: str, text: str, partition=None):
    url = connection if connection.startswith("jdbc:") else f"jdbc:{connection}"
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", BATCH_ROWS // 5)
    if partition is None:
        return reader.option("query", text)
    column, lower, upper, n = partition
    return reader.options(dbtable=f"({text}) q", partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(n))


#: Rows of a SQLite result that the driver holds at once; more go to the shared folder in parts.
BATCH_ROWS = 50_000


def _sqlite(spark: SparkSession, path: str, text: str) -> DataFrame:
    """SQLite is a file on the driver's machine; its rows leave it in batches."""
    if not path or path == ":memory:" or not Path(path).exists():
        raise SourceUnavailable(f"no SQLite database at {path!r}")
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        try:
            cursor = db.execute(f"SELECT * FROM ({text}) LIMIT 0")
            names = [d[0] for d in cursor.description]
            kinds = _kinds(db, text, names)
            cursor = db.execute(text)
        except sqlite3.Error as e:
            raise SourceUnavailable(f"{path}: {e}") from e
        schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
        batch = cursor.fetchmany(BATCH_ROWS)
        more = cursor.fetchmany(BATCH_ROWS) if len(batch) == BATCH_ROWS else []
        if not more:
            return spark.createDataFrame(_arrow(batch, schema), schema)
        place = f"{shared_folder(spark)}/sqlite-{uuid.uuid4().hex}"
        while batch:
            spark.createDataFrame(_arrow(batch, schema), schema).write.mode("append").parquet(place)
            batch, more = more, cursor.fetchmany(BATCH_ROWS)
    return spark.read.schema(schema).parquet(place)


def _kinds(db, text: str, names: list[str]) -> list[T.DataType]:
    """The columns' types from the storage classes of all their values, which SQLite finds itself."""
    classes = ("integer", "real", "blob", "text")
    asked = ", ".join(f"max(typeof({quoted(n, 'sqlite')}) = '{c}')" for n in names for c in classes)
    row = db.execute(f"SELECT {asked} FROM ({text})").fetchone()
    kinds = []
    for k in range(len(names)):
        integer, real, blob, some_text = (bool(x) for x in row[4 * k : 4 * k + 4])
        if some_text or not (integer or real or blob):
            kinds.append(T.StringType())
        elif blob:
            kinds.append(T.StringType() if integer or real else T.BinaryType())
        else:
            kinds.append(T.DoubleType() if real else T.LongType())
    return kinds


def _arrow(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)
    as_text = lambda v: v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
    cast = [as_text if isinstance(f.dataType, T.StringType) else float if isinstance(f.dataType, T.DoubleType) else (lambda v: v) for f in schema]
    columns = [[None if v is None else c(v) for v in column] for c, column in zip(cast, zip(*rows, strict=True), strict=True)] if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)


def discovery(connection: str) -> str:
    """The statement that lists a database's tables, columns and declared types, in order."""
    dialect = dialect_of(connection)
    if dialect == "sqlite":
        return "SELECT m.name AS table_name, p.name AS column_name, p.type AS data_type FROM sqlite_master m JOIN pragma_table_info(m.name) p WHERE m.type = 'table' ORDER BY m.name, p.cid"
    own = "table_schema = DATABASE()" if dialect == "mysql" else "table_schema NOT IN ('pg_catalog', 'information_schema')"
    return f"SELECT table_name, column_name, data_type FROM information_schema.columns WHERE {own} ORDER BY table_name, ordinal_position"


def discovered(spark: SparkSession, connection: str) -> DataFrame:
    """``table_name, column_name, data_type, spark_type`` of everything a database has; unknown types have no spark_type."""
    found = read_sql(spark, connection, query=discovery(connection))
    rows = [(r[0], r[1], r[2], _spark_type(dialect_of(connection), r[2])) for r in found.collect()]  # one row a column
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, spark_type string")


def _spark_type(dialect: str, name: str) -> str | None:
    try:
        return from_source(dialect, name)
    except UnmappableType:
        return None


def tables(path: str) -> dict[str, list[tuple[str, str]]]:
    """The tables of a SQLite database with their columns and declared types."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        return {n: [(r[1], r[2]) for r in db.execute(f"PRAGMA table_info({quoted(n, 'sqlite')})")] for n in names}
