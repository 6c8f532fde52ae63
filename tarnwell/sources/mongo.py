"""Mongo: dumps of extended JSON as tables, and predicates as match documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.plans.expr import Binary, Col, Expr, IsNull, Lit, OneOf

# Wrappers of extended JSON with the types inside, and match operators.
WRAPPERS = {"$oid": None, "$numberLong": "bigint", "$numberInt": "int", "$numberDouble": "double", "$numberDecimal": "decimal(38,10)", "$date": "timestamp"}
OPERATORS = {"=": "$eq", "<>": "$nin", "!=": "$nin", "<": "$lt", "<=": "$lte", ">": "$gt", ">=": "$gte"}
FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def plain(df: DataFrame) -> DataFrame:
    """Wrapped values unwrapped, nested ones as JSON text."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType):
            names = f.dataType.names
            if len(names) == 1 and names[0] in WRAPPERS:
                kind = WRAPPERS[names[0]]
                c = c.getField(names[0])
                c = F.to_timestamp(c) if names[0] == "$date" else c.cast(kind) if kind else c
            else:
                c = F.to_json(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def render_match(predicate: Expr) -> dict | None:
    """The match document of a predicate, or None if any part of it has none: then all of it is done here.

    Comparisons of a field with a literal, IN, AND, OR and tests for NULL have one.
    NULL and an absent field are the same, and match no other comparison.
    """
    match predicate:
        case Binary("AND" | "OR" as op, left, right):
            sides = [render_match(left), render_match(right)]
            return None if None in sides else {f"${op.lower()}": sides}
        case IsNull(Col(name), negated, False):
            return {name: {"$ne" if negated else "$eq": None}}
        case OneOf(Col(name), values) if all(isinstance(v, Lit) and v.value is not None for v in values):
            return {name: {"$in": [v.value for v in values]}}
        case Binary(op, Lit(value), Col(name)) if op in OPERATORS:
            return render_match(Binary(FLIPPED.get(op, op), Col(name), Lit(value)))
        case Binary(op, Col(name), Lit(value)) if op in OPERATORS:
            if value is None or isinstance(value, (list, tuple)):
                return None
            # without the NULL, $ne would keep documents that lack the field
            return {name: {"$nin": [None, value]} if op in ("<>", "!=") else {OPERATORS[op]: value}}
    return None


def pipeline(match: Expr | None = None, columns: tuple[str, ...] = (), limit: int | None = None) -> tuple[list[dict], bool]:
    """The aggregation stages of a read, and whether they have the predicate; a limit needs it."""
    stages, pushed = [], True
    if match is not None:
        found = render_match(match)
        pushed = found is not None
        stages += [{"$match": found}] if pushed else []
    if pushed and limit is not None:
        stages.append({"$limit": limit})
    if pushed and columns:
        stages.append({"$project": {"_id": 0} | {c: 1 for c in columns}})
    return stages, pushed
