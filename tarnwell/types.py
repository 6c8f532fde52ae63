"""Type algebra over Spark's types: widening, loss, common types, source names."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .errors import UnmappableType

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_FLOATS = (T.FloatType, T.DoubleType)
_NUMBERS = (*INTEGERS, *_FLOATS, T.DecimalType)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, _NUMBERS)


def widen(a: T.DataType, b: T.DataType) -> T.DataType:
    """The wider of two integer or two float types, else the common type."""
    for family in (INTEGERS, _FLOATS):
        if isinstance(a, family) and isinstance(b, family):
            return max((a, b), key=lambda t: family.index(type(t)))
    return common_type(a, b)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds both without loss; text if there is nothing better."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, INTEGERS) and isinstance(b, INTEGERS):
        return max((a, b), key=lambda t: _BITS[type(t)])
    if is_number(a) and is_number(b):
        decimals = [t for t in (a, b) if isinstance(t, T.DecimalType)]
        if len(decimals) == 2:
            scale = max(t.scale for t in decimals)
            digits = max(t.precision - t.scale for t in decimals) + scale
            return T.DecimalType(digits, scale) if digits <= 38 else T.DoubleType()
        if decimals and isinstance(next(t for t in (a, b) if t is not decimals[0]), INTEGERS):
            digits = max(decimals[0].precision - decimals[0].scale, 19) + decimals[0].scale
            return T.DecimalType(min(38, digits), decimals[0].scale)
        return T.DoubleType()
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    return T.StringType()


def lossy(source: T.DataType, target: T.DataType) -> str | None:
    """Why casting may lose something, or None."""
    if source == target or isinstance(source, T.NullType):
        return None
    if isinstance(target, T.NullType):
        return "everything becomes null"
    if isinstance(source, INTEGERS):
        if isinstance(target, INTEGERS):
            return None if _BITS[type(target)] >= _BITS[type(source)] else f"{_BITS[type(source)]} bits into {_BITS[type(target)]}"
        if isinstance(target, T.DoubleType):
            return None if _BITS[type(source)] <= 32 else "63 bits into 53"
        if isinstance(target, T.FloatType):
            return None if _BITS[type(source)] <= 16 else "more digits than a 32-bit float holds"
        if isinstance(target, T.DecimalType):
            digits = {8: 3, 16: 5, 32: 10, 64: 19}[_BITS[type(source)]]
            return None if target.precision - target.scale >= digits else "too few digits"
    if isinstance(source, _FLOATS):
        if isinstance(target, INTEGERS):
            return "truncates fractions"
        if isinstance(target, T.FloatType):
            return "double into 32 bits"
        if isinstance(target, (T.DoubleType, T.DecimalType)):
            return None
    if isinstance(source, T.DecimalType):
        if isinstance(target, T.DecimalType):
            fits = target.scale >= source.scale and target.precision - target.scale >= source.precision - source.scale
            return None if fits else "fewer digits"
        if isinstance(target, INTEGERS):
            return "truncates fractions" if source.scale else ("too few digits" if source.precision > 18 else None)
        if isinstance(target, _FLOATS):
            return "binary fractions"
    if isinstance(source, T.TimestampType) != isinstance(target, T.TimestampType) and isinstance(target, (T.TimestampType, T.TimestampNTZType)):
        return "the meaning of the time zone changes"
    if isinstance(source, (T.TimestampType, T.TimestampNTZType)) and isinstance(target, T.DateType):
        return "the time of day goes"
    if isinstance(source, T.ArrayType) and isinstance(target, T.ArrayType):
        return lossy(source.elementType, target.elementType)
    if isinstance(source, T.MapType) and isinstance(target, T.MapType):
        return lossy(source.keyType, target.keyType) or lossy(source.valueType, target.valueType)
    if isinstance(source, T.StructType) and isinstance(target, T.StructType):
        there = {f.name: f.dataType for f in target}
        for f in source:
            if f.name not in there:
                return f"field {f.name} goes"
            if why := lossy(f.dataType, there[f.name]):
                return f"{f.name}: {why}"
        return None
    if isinstance(target, T.StringType):
        return None if not isinstance(source, T.BinaryType) else "bytes may not be text"
    if isinstance(source, T.StringType):
        return "text needs parsing"
    if isinstance(source, T.DateType) and isinstance(target, (T.TimestampNTZType,)):
        return None
    return f"no safe way from {source.simpleString()} to {target.simpleString()}"


# Type names of other systems.
_NAMES = {
    "postgresql": {
        "smallint": "smallint", "integer": "int", "bigint": "bigint", "real": "float", "double precision": "double",
        "boolean": "boolean", "text": "string", "character varying": "string", "varchar": "string", "char": "string",
        "uuid": "string", "json": "string", "jsonb": "string", "bytea": "binary", "date": "date",
        "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz",
        "timestamp with time zone": "timestamp", "interval": "interval day to second",
    },
    "mysql": {
        "tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float",
        "double": "double", "bool": "boolean", "varchar": "string", "char": "string", "text": "string", "json": "string",
        "blob": "binary", "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp",
    },
    "sqlite": {"integer": "bigint", "int": "bigint", "real": "double", "text": "string", "blob": "binary", "numeric": "double", "boolean": "boolean"},
    "mongodb": {"int": "int", "long": "bigint", "double": "double", "bool": "boolean", "string": "string", "objectid": "string", "date": "timestamp", "object": "string", "array": "string"},
    "excel": {"n": "double", "s": "string", "b": "boolean", "d": "timestamp_ntz"},
    "arrow": {
        "null": "void", "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
        "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float": "float",
        "double": "double", "string": "string", "large_string": "string", "binary": "binary", "date32": "date",
        "date64": "date", "time32": "bigint", "time64": "bigint", "timestamp": "timestamp_ntz",
        "duration": "interval day to second", "dictionary": "string",
    },
}


def from_source(system: str, name: str) -> str:
    """The Spark type string of another system's type; unknown ones raise."""
    names = _NAMES.get(system.lower())
    if names is None:
        raise UnmappableType(f"unknown system {system!r}")
    low = name.strip().lower()
    if m := re.fullmatch(r"(?:numeric|decimal)\((\d+)(?:,\s*(\d+))?\)", low):
        digits, scale = int(m[1]), int(m[2] or 0)
        if digits > 38:
            raise UnmappableType(f"{name}: more than 38 digits")
        return f"decimal({digits},{scale})"
    base = re.sub(r"\(.*\)", "", low).strip()
    if base not in names:
        raise UnmappableType(f"{system} has no known type {name!r}")
    return names[base]
