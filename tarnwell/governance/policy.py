"""Policies: who may see which rows and columns, what may leave, and how small a group may be.

A policy is deny-by-default for anything that leaves the machine, and refuses
what it doesn't understand.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.errors import PolicyDenied, PrivacyViolation
from tarnwell.plans.expr import Binary, Col, Expr, Lit
from tarnwell.schema import LADDER, Schema

from .masks import masked


@dataclass(frozen=True)
class Subject:
    name: str = "anonymous"
    roles: tuple[str, ...] = ()


ANONYMOUS = Subject()


@dataclass(frozen=True)
class RowRule:
    role: str
    predicate: str
    source: str | None = None


@dataclass(frozen=True)
class DisclosureRule:
    """Groups of fewer than ``k`` rows are left out."""

    k: int
    role: str | None = None

    def __post_init__(self):
        if not isinstance(self.k, int) or isinstance(self.k, bool) or self.k < 2:
            raise ValueError("a disclosure rule needs k of at least 2")


# Kinds of sinks.
LOCAL_SINKS = frozenset({"file", "parquet", "csv", "json", "excel", "memory"})
NETWORK_SINKS = frozenset({"s3", "s3a", "gs", "abfss", "wasbs", "hdfs", "viewfs", "http", "https", "ftp", "jdbc", "postgresql", "mysql", "mongodb", "kafka"})


def sink_of(target: str) -> str:
    """``local``, or the kind of network sink; a scheme that isn't known counts as network."""
    m = re.match(r"^([a-zA-Z][a-zA-Z0-9+.-]+):", target)
    if not m or m[1].lower() == "file":
        return "network" if target.startswith(("\\\\", "//")) else "local"
    return m[1].lower()


@dataclass(frozen=True)
class Policy:
    name: str = "baseline"
    allow_network: bool = False
    allow_network_kinds: frozenset[str] = frozenset()
    max_sensitivity: str = "PUBLIC"
    mask_threshold: str = "RESTRICTED"
    mask_default: str = "redact"
    rls: tuple[RowRule, ...] = ()
    cls_drop: dict[str, frozenset[str]] = field(default_factory=dict)
    cls_mask: dict[str, dict[str, str]] = field(default_factory=dict)
    disclosure: tuple[DisclosureRule, ...] = ()

    # rows
    def row_rules(self, subject: Subject) -> list[RowRule]:
        return [r for r in self.rls if r.role == "*" or r.role in subject.roles]

    # columns
    def column_actions(self, schema: Schema, subject: Subject) -> dict[str, str]:
        """``drop`` or a mask for each column that doesn't pass as it is; dropping wins."""
        roles = ("*", *subject.roles)
        drop = frozenset().union(*[self.cls_drop.get(r, frozenset()) for r in roles])
        mask = {c: kind for r in roles for c, kind in self.cls_mask.get(r, {}).items()}
        actions = {}
        for f in schema.fields:
            if f.name in drop:
                actions[f.name] = "drop"
            elif f.name in mask:
                actions[f.name] = mask[f.name]
            elif self.mask_threshold in LADDER and LADDER.index(f.sensitivity) >= LADDER.index(self.mask_threshold):
                actions[f.name] = self.mask_default
        return actions

    def protect(self, df: DataFrame, schema: Schema, subject: Subject) -> DataFrame:
        actions = self.column_actions(schema, subject)
        kept = [f for f in schema.fields if actions.get(f.name) != "drop"]
        if not kept:
            raise PolicyDenied("the policy leaves no column")
        if not actions:
            return df
        return df.select(
            *[masked(F.col(f"`{f.name}`"), actions[f.name], f.type).alias(f.name) if f.name in actions else F.col(f"`{f.name}`") for f in kept]
        )

    # what leaves
    def check_egress(self, target: str, schema: Schema) -> None:
        kind = sink_of(target)
        if kind == "local":
            return
        if not self.allow_network or kind not in self.allow_network_kinds:
            raise PrivacyViolation(f"{self.name}: nothing may leave to {kind}")
        if LADDER.index(schema.sensitivity) > LADDER.index(self.max_sensitivity):
            raise PrivacyViolation(f"{self.name}: {schema.sensitivity} data may not leave; the most is {self.max_sensitivity}")

    # small groups
    def least_group(self, subject: Subject) -> int | None:
        ks = [r.k for r in self.disclosure if r.role in (None, "*") or r.role in subject.roles]
        return max(ks, default=None)


BASELINE = Policy()

_KEYS = {"name", "allow_network", "allow_network_kinds", "max_sensitivity", "mask_threshold", "mask_default", "rls", "cls_drop", "cls_mask", "disclosure"}


def policy_from_dict(data: dict) -> Policy:
    """Unknown keys are refused, at every level."""

    def only(d: dict, keys: set[str], where: str) -> dict:
        if not isinstance(d, dict):
            raise PolicyDenied(f"{where}: not an object")
        if odd := set(d) - keys:
            raise PolicyDenied(f"{where}: unknown keys {sorted(odd)}")
        return d

    only(data, _KEYS, "policy")
    for key in ("max_sensitivity", "mask_threshold"):
        if key in data and data[key].upper() not in LADDER:
            raise PolicyDenied(f"{key}: unknown sensitivity {data[key]!r}")
    rules = tuple(RowRule(**only(r, {"role", "predicate", "source"}, "rls")) for r in data.get("rls", ()))
    for r in rules:
        parse_row_predicate(r.predicate)
    for kinds in data.get("cls_mask", {}).values():
        for kind in kinds.values():
            if kind not in ("full", "hash", "partial", "redact", "email"):
                raise PolicyDenied(f"unknown mask {kind!r}")
    return Policy(
        name=data.get("name", "policy"),
        allow_network=bool(data.get("allow_network", False)),
        allow_network_kinds=frozenset(k.lower() for k in data.get("allow_network_kinds", ())),
        max_sensitivity=data.get("max_sensitivity", "PUBLIC").upper(),
        mask_threshold=data.get("mask_threshold", "RESTRICTED").upper(),
        mask_default=data.get("mask_default", "redact"),
        rls=rules,
        cls_drop={r: frozenset(c) for r, c in data.get("cls_drop", {}).items()},
        cls_mask={r: dict(c) for r, c in data.get("cls_mask", {}).items()},
        disclosure=tuple(DisclosureRule(**only(r, {"k", "role"}, "disclosure")) for r in data.get("disclosure", ())),
    )


def load_policy(path: str | Path) -> Policy:
    return policy_from_dict(json.loads(Path(path).read_text()))


_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")


def parse_row_predicate(text: str) -> Expr:
    """``column = literal`` terms joined by AND (in any case); anything else is refused."""
    out: Expr | None = None
    for term in _terms(text):
        name, eq, value = term.partition("=")
        name, value = name.strip(), value.strip()
        if not eq or not _NAME.match(name) or not value or value.startswith("="):
            raise PolicyDenied(f"not a row rule: {text!r}")
        e = Binary("=", Col(name), Lit(_literal(value, text)))
        out = e if out is None else Binary("AND", out, e)
    if out is None:
        raise PolicyDenied("an empty row rule")
    return out


def _terms(text: str) -> list[str]:
    """Split at AND outside quotes."""
    terms, word = [], ""
    for piece in re.split(r"('(?:[^']|'')*')", text):
        if piece.startswith("'"):
            word += piece
            continue
        first, *more = re.split(r"(?i)\s+and\s+", piece)
        word += first
        for m in more:
            terms.append(word)
            word = m
    return [*terms, word] if word.strip() else terms


def _literal(value: str, text: str):
    if re.fullmatch(r"'(?:[^']|'')*'", value):
        return value[1:-1].replace("''", "'")
    if re.fullmatch(r"-?\d+", value):
        return int(value)
    if re.fullmatch(r"-?\d+\.\d*(?:[eE][+-]?\d+)?", value):
        return float(value)
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    if _NAME.match(value) and value.lower() not in ("null", "or", "and", "not"):
        return value
    raise PolicyDenied(f"not a row rule: {text!r}")
