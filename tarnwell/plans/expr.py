"""Typed expressions that lower to Spark columns or render as SQL text.

``a == b`` and friends build expressions; ``&``, ``|`` and ``~`` combine them by
three-valued logic.  Division never raises: by zero it gives NULL.
"""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.functions.registry import PLAIN, lookup


class Expr:
    """Base; operators build new expressions."""

    def __eq__(self, other):  # type: ignore[override]
        return Binary("=", self, lit(other))

    def __ne__(self, other):  # type: ignore[override]
        return Binary("<>", self, lit(other))

    def __lt__(self, other):
        return Binary("<", self, lit(other))

    def __le__(self, other):
        return Binary("<=", self, lit(other))

    def __gt__(self, other):
        return Binary(">", self, lit(other))

    def __ge__(self, other):
        return Binary(">=", self, lit(other))

    def __and__(self, other):
        return Binary("AND", self, lit(other))

    def __or__(self, other):
        return Binary("OR", self, lit(other))

    def __invert__(self):
        return Not(self)

    def __add__(self, other):
        return Binary("+", self, lit(other))

    def __radd__(self, other):
        return Binary("+", lit(other), self)

    def __sub__(self, other):
        return Binary("-", self, lit(other))

    def __rsub__(self, other):
        return Binary("-", lit(other), self)

    def __mul__(self, other):
        return Binary("*", self, lit(other))

    def __rmul__(self, other):
        return Binary("*", lit(other), self)

    def __truediv__(self, other):
        return Binary("/", self, lit(other))

    def __rtruediv__(self, other):
        return Binary("/", lit(other), self)

    __hash__ = object.__hash__

    def is_null(self):
        return IsNull(self)

    def is_not_null(self):
        return IsNull(self, negated=True)

    def cast(self, type_name: str):
        return Cast(self, type_name)

    def isin(self, *values):
        return OneOf(self, tuple(lit(v) for v in values))

    # what the subclasses define
    def column(self, safe: bool = False) -> Column:
        raise NotImplementedError

    def names(self) -> frozenset[str]:
        return frozenset().union(*[p.names() for p in self.parts()])

    def parts(self) -> tuple[Expr, ...]:
        return ()

    def sql(self, quote: str = '"') -> str:
        raise NotImplementedError


@dataclass(frozen=True, eq=False)
class Col(Expr):
    name: str

    def column(self, safe=False):
        return F.col("`" + self.name.replace("`", "``") + "`")

    def names(self):
        return frozenset({self.name})

    def sql(self, quote='"'):
        return quote + self.name.replace(quote, quote * 2) + quote


@dataclass(frozen=True, eq=False)
class Lit(Expr):
    value: object

    def column(self, safe=False):
        if isinstance(self.value, (list, tuple)):
            return F.array(*[F.lit(v) for v in self.value])
        return F.lit(self.value)

    def names(self):
        return frozenset()

    def sql(self, quote='"'):
        return _sql_value(self.value)


def _sql_value(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("SQL has no portable text for a non-finite number")
        return repr(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return f"'{value.isoformat(sep=' ') if isinstance(value, dt.datetime) else value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "(" + ", ".join(map(_sql_value, value)) + ")"
    raise ValueError(f"no SQL text for a {type(value).__name__}")


_COMPARE = {"=", "<>", "<", "<=", ">", ">="}


@dataclass(frozen=True, eq=False)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def parts(self):
        return self.left, self.right

    def column(self, safe=False):
        a, b = self.left.column(safe), self.right.column(safe)
        match self.op:
            case "=":
                return a == b
            case "<>":
                return a != b
            case "<":
                return a < b
            case "<=":
                return a <= b
            case ">":
                return a > b
            case ">=":
                return a >= b
            case "AND":
                return a & b
            case "OR":
                return a | b
            case "/":
                return F.try_divide(a, b)
            case "+":
                return F.try_add(a, b) if safe else a + b
            case "-":
                return F.try_subtract(a, b) if safe else a - b
            case "*":
                return F.try_multiply(a, b) if safe else a * b
        raise ValueError(f"unknown operator {self.op!r}")

    def sql(self, quote='"'):
        if self.op not in _COMPARE | {"AND", "OR", "+", "-", "*", "/"}:
            raise ValueError(f"unknown operator {self.op!r}")
        right = f"NULLIF({self.right.sql(quote)}, 0)" if self.op == "/" else self.right.sql(quote)
        return f"({self.left.sql(quote)} {self.op} {right})"


@dataclass(frozen=True, eq=False)
class Not(Expr):
    of: Expr

    def parts(self):
        return (self.of,)

    def column(self, safe=False):
        return ~self.of.column(safe)

    def sql(self, quote='"'):
        return f"(NOT {self.of.sql(quote)})"


@dataclass(frozen=True, eq=False)
class IsNull(Expr):
    of: Expr
    negated: bool = False
    or_nan: bool = False

    def parts(self):
        return (self.of,)

    def column(self, safe=False):
        c = self.of.column(safe)
        null = c.isNull() | F.isnan(c) if self.or_nan else c.isNull()
        return ~null if self.negated else null

    def sql(self, quote='"'):
        if self.or_nan:
            raise ValueError("NaN as NULL has no portable SQL")
        return f"({self.of.sql(quote)} IS {'NOT ' * self.negated}NULL)"


@dataclass(frozen=True, eq=False)
class OneOf(Expr):
    of: Expr
    values: tuple[Expr, ...]

    def parts(self):
        return (self.of, *self.values)

    def column(self, safe=False):
        return self.of.column(safe).isin(*[v.column(safe) for v in self.values])

    def sql(self, quote='"'):
        return f"({self.of.sql(quote)} IN ({', '.join(v.sql(quote) for v in self.values)}))"


@dataclass(frozen=True, eq=False)
class Cast(Expr):
    of: Expr
    type_name: str

    def parts(self):
        return (self.of,)

    def column(self, safe=False):
        c = self.of.column(safe)
        return c.try_cast(self.type_name) if safe else c.cast(self.type_name)

    def sql(self, quote='"'):
        return f"CAST({self.of.sql(quote)} AS {self.type_name.upper()})"


#: Functions that every SQL dialect of the sources has under the same name.
_PORTABLE = {"lower", "upper", "length", "trim", "abs", "round", "coalesce"}


@dataclass(frozen=True, eq=False)
class Func(Expr):
    """An allow-listed function (see :mod:`tarnwell.functions.registry`)."""

    name: str
    args: tuple[Expr, ...]

    def parts(self):
        return self.args

    def column(self, safe=False):
        plain = PLAIN.get(self.name.lower(), ())
        return lookup(self.name)(*[a.value if k in plain and isinstance(a, Lit) else a.column(safe) for k, a in enumerate(self.args)])

    def sql(self, quote='"'):
        name = {"absolute": "abs"}.get(self.name.lower(), self.name.lower())
        if name not in _PORTABLE:
            raise ValueError(f"{self.name} has no portable SQL")
        return f"{name.upper()}({', '.join(a.sql(quote) for a in self.args)})"


@dataclass(frozen=True)
class Agg:
    """An aggregate: ``arg`` is an expression, or None for COUNT(*)."""

    func: str
    arg: Expr | None = None
    distinct: bool = False
    order_by: tuple[str, ...] = ()
    custom: object = None


def col(name: str) -> Col:
    return Col(name)


def lit(value) -> Expr:
    return value if isinstance(value, Expr) else Lit(value)


def func(name: str, *args) -> Func:
    return Func(name, tuple(lit(a) for a in args))


def and_(first, *more) -> Expr:
    out = lit(first)
    for e in more:
        out = out & e
    return out


def or_(first, *more) -> Expr:
    out = lit(first)
    for e in more:
        out = out | e
    return out


def not_(e) -> Expr:
    return Not(lit(e))


def _arg(x) -> Expr | None:
    return col(x) if isinstance(x, str) else (None if x is None else lit(x))


def sum_(x, distinct=False) -> Agg:
    return Agg("sum", _arg(x), distinct)


def count(x=None, distinct=False) -> Agg:
    return Agg("count", _arg(x), distinct)


def mean(x, distinct=False) -> Agg:
    return Agg("avg", _arg(x), distinct)


def min_(x) -> Agg:
    return Agg("min", _arg(x))


def max_(x) -> Agg:
    return Agg("max", _arg(x))


def first(x, *order_by: str) -> Agg:
    return Agg("first", _arg(x), order_by=order_by)


def last(x, *order_by: str) -> Agg:
    return Agg("last", _arg(x), order_by=order_by)


def list_(x, *order_by: str) -> Agg:
    return Agg("list", _arg(x), order_by=order_by)
