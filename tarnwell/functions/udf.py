"""Python functions over rows or columns, in Arrow batches.

``row``: the function gets a dict for each row.  ``column``: it gets a dict of
lists and returns one value for each entry; Spark calls it a batch at a time,
or once over all rows with ``whole=True`` (one task: for small tables only).
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnwell.errors import FunctionFailed

#: Rows that a table function's output gathers before they are handed on.
TABLE_ROWS = 10_000
_ROW_NAMES = {"row", "record", "item", "r", "_row"}


def output_name(function: Callable, name: str | None = None) -> str:
    own = getattr(function, "__name__", "result")
    return name or ("result" if own == "<lambda>" else own)


def mode_of(function: Callable, mode: str) -> str:
    """``auto``: one positional parameter that isn't named like a row takes columns."""
    if mode in ("row", "column"):
        return mode
    if mode != "auto":
        raise ValueError(f"unknown mode {mode!r}")
    names = [p.name for p in inspect.signature(function).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    return "column" if len(names) == 1 and names[0] not in _ROW_NAMES else "row"


def _inferred(seen: set[str]) -> T.DataType:
    """The type that holds values of all the Python types of these names."""
    if seen == {"bool"}:
        return T.BooleanType()
    if seen == {"int"}:
        return T.LongType()
    if seen and seen <= {"int", "float"}:
        return T.DoubleType()
    return T.StringType()


def apply(df: DataFrame, function: Callable, name: str | None = None, mode: str = "auto", returns: T.DataType | str | None = None, whole: bool = False) -> DataFrame:
    """``df`` with the function's result as a column, typed even where ``df`` is empty.

    Without ``returns`` the type is found by a pass over all rows, in which the
    function runs once more; give it where that is dear.
    """
    mode, out = mode_of(function, mode), output_name(function, name)
    names = df.columns
    kept = [n for n in names if n != out]

    def called(columns: dict[str, list], n: int) -> list:
        try:
            got = list(function(columns)) if mode == "column" else [function(dict(zip(names, r, strict=True))) for r in zip(*columns.values(), strict=True)]
        except Exception as e:
            raise FunctionFailed(f"{out}: {type(e).__name__}: {e}") from e
        if len(got) != n:
            raise FunctionFailed(f"{out}: {len(got)} values for {n} rows")
        return got

    if returns is None:

        def types(parts):
            import pyarrow as pa

            found = {type(v).__name__ for part in parts for v in called(part.to_pydict(), part.num_rows) if v is not None}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["t"])

        seen = (df.coalesce(1) if whole else df).mapInArrow(types, "t string").distinct().collect()
        returns = _inferred({r["t"] for r in seen})
    kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
    text = isinstance(kind, T.StringType)
    schema = T.StructType([df.schema[n] for n in kept] + [T.StructField(out, kind)])

    def batches(parts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        for part in parts:
            got = called(part.to_pydict(), part.num_rows)
            if text:
                got = [None if v is None else str(v) for v in got]
            if isinstance(kind, T.DoubleType):
                got = [None if v is None else float(v) for v in got]
            arrays = [part.column(names.index(n)).cast(shape.field(n).type) for n in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(got, shape.field(out).type)], schema=shape)

    return (df.coalesce(1) if whole else df).mapInArrow(batches, schema)


def apply_table(df: DataFrame, function: Callable, returns: T.StructType | str, keep: Sequence[str] = ()) -> DataFrame:
    """A table function: for each row the function gives any number of rows (as tuples or dicts).

    The result has the ``keep`` columns of the row before the function's own.
    """
    kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
    names, kept = df.columns, list(keep)
    schema = T.StructType([*[df.schema[n] for n in kept], *kind])

    def batches(parts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        for part in parts:
            rows = []
            for r in zip(*part.to_pydict().values(), strict=True):
                row = dict(zip(names, r, strict=True))
                try:
                    for x in function(row):
                        own = tuple(x.get(f.name) for f in kind) if isinstance(x, dict) else tuple(x)
                        if len(own) != len(kind):
                            raise ValueError(f"{len(own)} values for {len(kind)} columns")
                        rows.append((*[row[n] for n in kept], *own))
                except Exception as e:
                    raise FunctionFailed(f"{output_name(function)}: {type(e).__name__}: {e}") from e
                if len(rows) >= TABLE_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    return df.mapInArrow(batches, schema)
