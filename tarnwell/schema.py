"""Columns with classification tags, kept beside a DataFrame.

Spark keeps column metadata through some operators and drops it in others, so
tags are computed from the plan and only mirrored into the metadata.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import UnknownColumn
from .types import lossy

# The ladder of sensitivity, and tags that imply a rung.
LADDER = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")
IMPLIED = {"PII": "CONFIDENTIAL", "FINANCIAL": "CONFIDENTIAL", "PHI": "RESTRICTED", "SECRET": "RESTRICTED"}


def rank(tag: str) -> int:
    """The rung of a tag; unknown tags count as INTERNAL."""
    return LADDER.index(IMPLIED.get(tag, tag if tag in LADDER else "INTERNAL"))


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    nullable: bool = True
    tags: frozenset[str] = frozenset()
    description: str = ""

    @property
    def sensitivity(self) -> str:
        return LADDER[max((rank(t) for t in self.tags), default=0)]

    def tagged(self, tags: Iterable[str], description: str | None = None) -> Field:
        return replace(self, tags=self.tags | {t.upper() for t in tags}, description=description or self.description)

    def declassified(self, justification: str) -> Field:
        """Without tags; the written reason stays in the description."""
        if not justification.strip():
            raise ValueError("declassifying needs a written justification")
        note = f"declassified from {', '.join(sorted(self.tags)) or 'nothing'}: {justification.strip()}"
        return replace(self, tags=frozenset(), description=f"{self.description}; {note}".lstrip("; "))


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise ValueError(f"repeated column names: {sorted({n for n in names if names.count(n) > 1})}")

    @classmethod
    def of(cls, df: DataFrame, tags: dict[str, frozenset[str]] | None = None) -> Schema:
        tags = tags or {}
        return cls(
            tuple(
                Field(
                    f.name,
                    f.dataType,
                    f.nullable,
                    tags.get(f.name, frozenset((f.metadata or {}).get("classification", ()))),
                    (f.metadata or {}).get("comment", ""),
                )
                for f in df.schema
            )
        )

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise UnknownColumn(f"no column {name!r}; there are {self.names}")

    def __contains__(self, name: str) -> bool:
        return name in self.names

    @property
    def all_tags(self) -> frozenset[str]:
        return frozenset().union(*[f.tags for f in self.fields])

    @property
    def sensitivity(self) -> str:
        return LADDER[max((LADDER.index(f.sensitivity) for f in self.fields), default=0)]

    def select(self, *names: str) -> Schema:
        return Schema(tuple(self[n] for n in names))

    def drop(self, *names: str) -> Schema:
        return Schema(tuple(f for f in self.fields if f.name not in names))

    def rename(self, names: dict[str, str]) -> Schema:
        return Schema(tuple(replace(f, name=names.get(f.name, f.name)) for f in self.fields))

    def cast(self, types: dict[str, T.DataType]) -> Schema:
        return Schema(tuple(replace(f, type=types.get(f.name, f.type)) for f in self.fields))

    def with_nullability(self, nullable: dict[str, bool]) -> Schema:
        return Schema(tuple(replace(f, nullable=nullable.get(f.name, f.nullable)) for f in self.fields))

    def extend(self, *fields: Field) -> Schema:
        return Schema((*self.fields, *fields))

    def tagged(self, names: Iterable[str], tags: Iterable[str], descriptions: dict[str, str] | None = None) -> Schema:
        names, tags, descriptions = list(names), list(tags), descriptions or {}
        if not tags:
            raise ValueError("no tags given")
        for n in (*names, *descriptions):
            self[n]
        return Schema(tuple(f.tagged(tags if f.name in names else (), descriptions.get(f.name)) for f in self.fields))

    def mirror(self, df: DataFrame) -> DataFrame:
        """``df`` with tags and descriptions in its columns' metadata."""
        return df.select(
            *[
                F.col(f"`{f.name}`").alias(f.name, metadata={"classification": sorted(f.tags), "comment": f.description})
                if f.tags or f.description
                else F.col(f"`{f.name}`")
                for f in self.fields
            ]
        )


@dataclass(frozen=True)
class SchemaDiff:
    """How an actual schema differs from the expected one; true if it does.  Reported, never repaired."""

    added: tuple[str, ...]
    removed: tuple[str, ...]
    retyped: tuple[tuple[str, str, str, str | None], ...]
    nullability: tuple[tuple[str, bool, bool], ...]

    @classmethod
    def between(cls, expected: Schema, actual: Schema) -> SchemaDiff:
        both = [n for n in expected.names if n in actual]
        return cls(
            tuple(n for n in actual.names if n not in expected),
            tuple(n for n in expected.names if n not in actual),
            tuple(
                (n, expected[n].type.simpleString(), actual[n].type.simpleString(), lossy(actual[n].type, expected[n].type))
                for n in both
                if expected[n].type != actual[n].type
            ),
            tuple((n, expected[n].nullable, actual[n].nullable) for n in both if expected[n].nullable != actual[n].nullable),
        )

    def __bool__(self) -> bool:
        return bool(self.added or self.removed or self.retyped or self.nullability)
