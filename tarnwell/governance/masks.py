"""Masks as column expressions; NULL stays NULL, and masked numbers become text where they must."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.errors import PolicyDenied
from tarnwell.types import is_number


def _partial(text: Column) -> Column:
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(4))))


def masked(column: Column, kind: str, type_: T.DataType) -> Column:
    """``full``, ``hash``, ``partial``, ``redact`` or ``email``; unknown kinds are denied."""
    text = column.cast("string")
    match kind:
        case "full":
            return F.lit(None).cast(type_)
        case "hash":
            return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)
        case "partial":
            return _partial(text)
        case "redact":
            if is_number(type_):
                return F.when(column.isNotNull(), F.lit(0).cast(type_))
            return F.when(column.isNotNull(), F.lit("[redacted]"))
        case "email":
            at = F.instr(text, "@")
            address = F.concat(F.substring(text, 1, 1), F.lit("***@"), F.substring_index(text, "@", -1))
            return F.when(at > 1, address).otherwise(_partial(text))
    raise PolicyDenied(f"unknown mask {kind!r}")
