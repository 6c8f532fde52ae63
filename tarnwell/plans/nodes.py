"""The logical plan: frozen nodes, and the builders that make them.

Builders take the node first, and every node also has them as methods.  A plan
is lowered (see :mod:`tarnwell.plans.lower`) to one lazy DataFrame; Catalyst and
adaptive execution decide everything physical.
"""

from __future__ import annotations

import hashlib
import importlib.util
import inspect
import os
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, is_dataclass
from fnmatch import fnmatchcase
from pathlib import Path

from pyspark.sql import DataFrame

from tarnwell.operators.windows import WindowFunction
from tarnwell.plans.expr import Agg, Expr


@dataclass(frozen=True, eq=False)
class Node:
    @property
    def inputs(self) -> tuple[Node, ...]:
        return tuple(v for f in fields(self) for v in _nodes(getattr(self, f.name)))

    def walk(self):
        """This node and all below, each once, inputs first."""
        seen: set[int] = set()

        def visit(n: Node):
            if id(n) in seen:
                return
            seen.add(id(n))
            for i in n.inputs:
                yield from visit(i)
            yield n

        yield from visit(self)

    def semantic_id(self) -> str:
        """A hash of what the plan computes; the same for equal plans.

        Functions count with their source and what they capture.
        """
        return hashlib.sha256(_text(self).encode()).hexdigest()

    def cache_key(self) -> str:
        """As :meth:`semantic_id`, and different once a local file that is read has another size or time."""
        states = [f"{s.location}:{state}" for s in self.walk() if isinstance(s, Scan) for state in s.state()]
        return hashlib.sha256("\n".join([self.semantic_id(), *states]).encode()).hexdigest()

    # fluent forms of the builders
    def filter(self, predicate):
        return filter_(self, predicate)

    def project(self, *columns, **expressions):
        return project(self, *columns, **expressions)

    def join(self, right, on, how="inner"):
        return join(self, right, on, how)

    def group_by(self, *keys, aggs=None):
        return group_by(self, *keys, aggs=aggs)

    def aggregate(self, aggs):
        return aggregate(self, aggs)

    def sort(self, *keys):
        return sort(self, *keys)

    def limit(self, n):
        return limit(self, n)

    def window(self, *functions):
        return window(self, *functions)

    def deduplicate(self, *keys, keep="first", order_by=()):
        return deduplicate(self, *keys, keep=keep, order_by=order_by)

    def union(self, *more):
        return union(self, *more)


def _nodes(v) -> list[Node]:
    if isinstance(v, Node):
        return [v]
    return [x for x in v if isinstance(x, Node)] if isinstance(v, tuple) else []


def _text(v) -> str:
    if isinstance(v, DataFrame):
        return f"df:{v.semanticHash()}"
    if is_dataclass(v):
        return f"{type(v).__name__}({', '.join(f'{f.name}={_text(getattr(v, f.name))}' for f in fields(v))})"
    if isinstance(v, (tuple, list)):
        return f"[{', '.join(map(_text, v))}]"
    if isinstance(v, dict):
        return f"{{{', '.join(f'{k!r}: {_text(x)}' for k, x in v.items())}}}"
    if inspect.isfunction(v):
        return _function_text(v, frozenset())
    if callable(v):
        try:
            return f"fn:{inspect.getsource(type(v) if not inspect.isclass(v) else v)}:{_text(getattr(v, '__dict__', None)) if not inspect.isclass(v) else ''}"
        except (OSError, TypeError) as e:
            raise ValueError(f"{v!r} has no source to identify it by") from e
    return repr(v)


def _function_text(f, above: frozenset[int]) -> str:
    """Source, defaults, captured values and the plain globals and functions that a function uses."""
    if id(f) in above:
        return f"fn:{f.__qualname__}"
    above = above | {id(f)}
    try:
        source = inspect.getsource(f)
    except (OSError, TypeError) as e:
        raise ValueError(f"{f!r} has no source to identify it by") from e
    seen = inspect.getclosurevars(f)
    used = {**seen.nonlocals, **seen.globals}
    texts = []
    for name in sorted(used):
        v = used[name]
        if inspect.isfunction(v):
            texts.append(f"{name}={_function_text(v, above)}")
        elif inspect.ismodule(v) or inspect.isclass(v) or inspect.isbuiltin(v):
            texts.append(f"{name}={getattr(v, '__name__', v)}")
        else:
            texts.append(f"{name}={_text(v)}")
    return f"fn:{source}|{_text(f.__defaults__ or ())}|{_text(f.__kwdefaults__ or {})}|{'; '.join(texts)}"


@dataclass(frozen=True, eq=False)
class Scan(Node):
    """``kind`` is a key of :data:`tarnwell.sources.readers.READERS`, or ``dataframe``."""

    kind: str
    location: object
    options: tuple[tuple[str, object], ...] = ()
    columns: tuple[str, ...] = ()
    name: str = ""

    @property
    def scope(self) -> str:
        """What row rules call this source: its name, table, collection, or file's stem."""
        options = dict(self.options)
        for key in ("table", "collection"):
            if options.get(key):
                return str(options[key])
        return self.name or (Path(str(self.location)).stem if isinstance(self.location, (str, Path)) else self.kind)

    def state(self) -> list[str]:
        """Time and size of the local files that are read; empty for anything else."""
        if not isinstance(self.location, (str, Path)):
            return []
        place = str(self.location).removeprefix("sqlite:").removeprefix("file://")
        files = [os.path.join(d, f) for d, _, names in os.walk(place) for f in names] if os.path.isdir(place) else [place]
        return [f"{f}:{os.stat(f).st_mtime_ns}:{os.stat(f).st_size}" for f in sorted(files) if os.path.isfile(f)]

    def reads(self, source: str) -> bool:
        """Whether this may be the source of that name: by its own name, or by where it reads, whatever it is called.

        A place counts with each part of its path, with or without suffix and
        wildcards; a query with each word of it; a DataFrame with its files.
        """
        options = dict(self.options)
        names = {self.name, *(str(options[k]) for k in ("table", "collection") if options.get(k))}
        names |= {n.rpartition(".")[2] for n in names}
        names |= set(re.findall(r"\w+", options.get("query") or ""))
        places = [str(self.location)] if isinstance(self.location, (str, Path)) else []
        if isinstance(self.location, DataFrame):
            places = list({f.rpartition("/")[0] for f in self.location.inputFiles()} | set(self.location.inputFiles()[:1]))
        parts = {p for place in places for p in re.split(r"[/\\]", place) if p}
        parts |= {Path(p).stem for p in parts}
        low = source.lower()
        return low in {n.lower() for n in names if n} or any(fnmatchcase(low, p.lower()) for p in parts)


@dataclass(frozen=True, eq=False)
class Filter(Node):
    input: Node
    predicate: Expr


@dataclass(frozen=True, eq=False)
class Barrier(Node):
    """A row rule, directly above its scan."""

    input: Node
    predicate: Expr
    rule: str


@dataclass(frozen=True, eq=False)
class Project(Node):
    input: Node
    columns: tuple[str, ...]
    expressions: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True, eq=False)
class Join(Node):
    left: Node
    right: Node
    on: tuple[tuple[str, str], ...]
    how: str


@dataclass(frozen=True, eq=False)
class AsOf(Node):
    left: Node
    right: Node
    by: tuple[str, ...]
    left_time: str
    right_time: str
    tolerance: object = None
    slice_width: float | None = None


@dataclass(frozen=True, eq=False)
class Group(Node):
    """Without keys it is a global aggregate if ``whole``."""

    input: Node
    keys: tuple[str, ...]
    aggs: tuple[tuple[str, Agg], ...]
    whole: bool = False


@dataclass(frozen=True, eq=False)
class Windowed(Node):
    input: Node
    functions: tuple[WindowFunction, ...]


@dataclass(frozen=True, eq=False)
class Sort(Node):
    input: Node
    keys: tuple[str, ...]


@dataclass(frozen=True, eq=False)
class Limit(Node):
    input: Node
    n: int


@dataclass(frozen=True, eq=False)
class Union(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True, eq=False)
class SetOperation(Node):
    left: Node
    right: Node
    kind: str
    all_rows: bool = False


@dataclass(frozen=True, eq=False)
class Deduplicate(Node):
    input: Node
    keys: tuple[str, ...]
    keep: str
    order_by: tuple[str, ...]


@dataclass(frozen=True, eq=False)
class CastSafe(Node):
    input: Node
    types: tuple[tuple[str, str], ...]


@dataclass(frozen=True, eq=False)
class HandleNulls(Node):
    input: Node
    strategy: str
    columns: tuple[str, ...]
    value: object = None


@dataclass(frozen=True, eq=False)
class QualityCheck(Node):
    input: Node
    rules: tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True, eq=False)
class Classify(Node):
    input: Node
    columns: tuple[str, ...]
    tags: tuple[str, ...]
    descriptions: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True, eq=False)
class Declassify(Node):
    input: Node
    columns: tuple[str, ...]
    justification: str


@dataclass(frozen=True, eq=False)
class Function(Node):
    input: Node
    function: Callable
    output: str
    mode: str
    returns: str | None
    whole: bool = False


@dataclass(frozen=True, eq=False)
class TableFunction(Node):
    input: Node
    function: Callable
    returns: str
    keep: tuple[str, ...] = ()


@dataclass(frozen=True, eq=False)
class GroupingSets(Node):
    """``kind`` is ``rollup``, ``cube`` or ``sets``; ``sets`` lists the key sets of the last."""

    input: Node
    keys: tuple[str, ...]
    aggs: tuple[tuple[str, Agg], ...]
    kind: str = "rollup"
    sets: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True, eq=False)
class Cache(Node):
    input: Node


@dataclass(frozen=True, eq=False)
class Write(Node):
    """Writes what the policy lets through, and is that."""

    input: Node
    kind: str
    path: str
    mode: str
    options: tuple[tuple[str, object], ...] = ()


# builders -------------------------------------------------------------------


def dataframe(df: DataFrame, name: str = "dataframe") -> Scan:
    return Scan("dataframe", df, name=name)


def parquet(path: str, columns: Sequence[str] = (), name: str = "") -> Scan:
    return Scan("parquet", str(path), columns=tuple(columns), name=name)


def csv(path: str, delimiter: str = ",", schema: str | None = None, columns: Sequence[str] = (), name: str = "", multi_line: bool | None = None) -> Scan:
    """Without ``multi_line`` it is found out whether fields have newlines; files that have none are split among tasks."""
    return Scan("csv", str(path), (("delimiter", delimiter), ("schema", schema), ("multi_line", multi_line)), tuple(columns), name)


def json(path: str, array: bool = False, columns: Sequence[str] = (), name: str = "") -> Scan:
    return Scan("json", str(path), (("array", array),), tuple(columns), name)


def excel(
    path: str, sheet: str | None = None, cell_range: str | None = None, header_row: int | None = None, formulas: bool = False, name: str = "",
    named_range: str | None = None, table: str | None = None,
) -> Scan:
    """One of ``cell_range``, ``named_range`` (a defined name of the workbook) and ``table`` may say what is read."""
    if sum(x is not None for x in (cell_range, named_range, table)) > 1:
        raise ValueError("give one of cell_range, named_range and table")
    options = {"sheet": sheet, "cell_range": cell_range, "header_row": header_row, "formulas": formulas, "named_range": named_range, "table": table}
    return Scan("excel", str(path), tuple(options.items()), name=name)


def sql(
    connection: str, table: str | None = None, query: str | None = None, columns: Sequence[str] = (), predicate: Expr | None = None,
    limit: int | None = None, name: str = "", partition: tuple[str, object, object, int] | None = None,
) -> Scan:
    """``partition`` is ``(column, lower, upper, n)``: ranges that JDBC reads in parallel."""
    if bool(table) == bool(query):
        raise ValueError("give a table or a query")
    options = {"table": table, "query": query, "predicate": predicate, "limit": limit, "partition": partition}
    return Scan("sql", connection, tuple(options.items()), tuple(columns), name)


def mongo(dump: str, collection: str, match: Expr | None = None, name: str = "") -> Scan:
    """A collection dumped as JSON lines (extended JSON)."""
    return Scan("mongo", str(dump), (("collection", collection), ("match", match)), name=name)


def const(rows: Sequence[dict] | Sequence[tuple], schema: str, name: str = "const") -> Scan:
    return Scan("const", tuple(tuple(r.items()) if isinstance(r, dict) else tuple(r) for r in rows), (("schema", schema), ("dicts", bool(rows) and isinstance(rows[0], dict))), name=name)


def arrow(table, name: str = "arrow") -> Scan:
    return Scan("arrow", table, name=name)


def filter_(node: Node, predicate: Expr) -> Filter:
    return Filter(node, predicate)


def project(node: Node, *columns: str, **expressions: Expr) -> Project:
    if odd := [c for c in columns if not isinstance(c, str)]:
        raise TypeError(f"columns are names; give expressions by keyword: {odd}")
    return Project(node, tuple(columns), tuple(expressions.items()))


def join(left: Node, right: Node, on, how: str = "inner") -> Join:
    pairs = tuple(on.items()) if isinstance(on, dict) else tuple((k, k) for k in ([on] if isinstance(on, str) else on))
    if not pairs:
        raise ValueError("a join needs a key")
    return Join(left, right, pairs, how)


def asof_join(left: Node, right: Node, by: Sequence[str], left_time: str, right_time: str, tolerance=None, slice_width: float | None = None) -> AsOf:
    """``slice_width`` cuts long keys into slices of time, each of them a task's work."""
    return AsOf(left, right, tuple(by), left_time, right_time, tolerance, slice_width)


def group_by(node: Node, *keys: str, aggs: dict[str, Agg] | None = None) -> Group:
    if not keys:
        raise ValueError("group_by needs a key; aggregate has none")
    return Group(node, tuple(keys), tuple((aggs or {}).items()))


def aggregate(node: Node, aggs: dict[str, Agg]) -> Group:
    if not aggs:
        raise ValueError("aggregate needs an aggregate")
    return Group(node, (), tuple(aggs.items()), whole=True)


def window(node: Node, *functions: WindowFunction) -> Windowed:
    return Windowed(node, tuple(functions))


def sort(node: Node, *keys: str) -> Sort:
    return Sort(node, tuple(keys))


def limit(node: Node, n: int) -> Limit:
    if n < 0:
        raise ValueError("a limit can't be negative")
    return Limit(node, n)


def union(*nodes: Node) -> Union:
    return Union(tuple(nodes))


def intersect(a: Node, b: Node, all_rows: bool = False) -> SetOperation:
    return SetOperation(a, b, "intersect", all_rows)


def except_(a: Node, b: Node, all_rows: bool = False) -> SetOperation:
    return SetOperation(a, b, "except", all_rows)


def deduplicate(node: Node, *keys: str, keep: str = "first", order_by: Sequence[str] = ()) -> Deduplicate:
    return Deduplicate(node, tuple(keys), keep, tuple(order_by))


def cast(node: Node, types: dict[str, str]) -> CastSafe:
    return CastSafe(node, tuple(types.items()))


def handle_nulls(node: Node, strategy: str, *columns: str, value=None) -> HandleNulls:
    return HandleNulls(node, strategy, tuple(columns), value)


def quality_check(node: Node, rules: dict[str, Sequence[str] | str]) -> QualityCheck:
    return QualityCheck(node, tuple((n, (r,) if isinstance(r, str) else tuple(r)) for n, r in rules.items()))


def classify(node: Node, *columns: str, tags: Sequence[str], descriptions: dict[str, str] | None = None) -> Classify:
    return Classify(node, tuple(columns), tuple(tags), tuple((descriptions or {}).items()))


def declassify(node: Node, *columns: str, justification: str) -> Declassify:
    return Declassify(node, tuple(columns), justification)


def udf(node: Node, function: Callable, name: str | None = None, mode: str = "auto", returns: str | None = None, whole: bool = False) -> Function:
    from tarnwell.functions.udf import mode_of, output_name

    return Function(node, function, output_name(function, name), mode_of(function, mode), returns, whole)


def table_function(node: Node, function: Callable, returns: str, keep: Sequence[str] = ()) -> TableFunction:
    """Any number of rows for each row; ``returns`` is their schema as DDL."""
    return TableFunction(node, function, returns, tuple(keep))


def grouping_sets(node: Node, *keys: str, aggs: dict[str, Agg], kind: str = "rollup", sets: Sequence[Sequence[str]] = ()) -> GroupingSets:
    return GroupingSets(node, tuple(keys), tuple(aggs.items()), kind, tuple(map(tuple, sets)))


def cache(node: Node) -> Cache:
    return Cache(node)


def write_parquet(node: Node, path: str, mode: str = "overwrite") -> Write:
    return Write(node, "parquet", str(path), mode)


def write_csv(node: Node, path: str, mode: str = "overwrite") -> Write:
    return Write(node, "csv", str(path), mode)


def write_json(node: Node, path: str, mode: str = "overwrite") -> Write:
    return Write(node, "json", str(path), mode)


def write_excel(node: Node, path: str, sheet: str = "Sheet1", mode: str = "overwrite") -> Write:
    return Write(node, "excel", str(path), mode, (("sheet", sheet),))


#: Names under which a pipeline file may hold its plan.
ENTRY_NAMES = ("build", "pipeline", "PIPELINE", "build_pipeline")


def load_pipeline(path: str) -> Node:
    """The plan of a Python file, which is executed: trusted input only."""
    spec = importlib.util.spec_from_file_location(f"pipeline_{Path(path).stem}", path)
    if spec is None or not Path(path).exists():
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    for name in ENTRY_NAMES:
        if hasattr(module, name):
            found = getattr(module, name)
            node = found if isinstance(found, Node) else found()
            if not isinstance(node, Node):
                raise TypeError(f"{name} gives a {type(node).__name__}, not a plan")
            return node
    raise ValueError(f"{path} has none of {', '.join(ENTRY_NAMES)}")
