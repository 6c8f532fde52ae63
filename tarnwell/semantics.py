"""More registered queries: NULLs, frames, casts, tags, sources and refusals, each with its SQL.

What isn't data (tags, refusals, profiles) is shown as rows, so that it is compared like data.
"""

from __future__ import annotations

import csv
import json
import os
import sqlite3
import tempfile
from contextlib import closing
from itertools import batched
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tarnwell import errors, profile
from tarnwell.governance import rls
from tarnwell.governance.policy import BASELINE, DisclosureRule, Policy, RowRule, Subject, policy_from_dict
from tarnwell.ledger import Ledger
from tarnwell.operators import relational as rel
from tarnwell.operators.windows import WindowFunction, parse_frame
from tarnwell.plans import nodes as n
from tarnwell.plans.expr import Agg, IsNull, and_, col, count, first, func, last, list_, lit, max_, mean, min_, not_, sum_
from tarnwell.plans.lower import Context, lower
from tarnwell.registry import frame as _frame
from tarnwell.registry import plan as _plan
from tarnwell.registry import shared, table, tables
from tarnwell.service import Service
from tarnwell.sources.mongo import render_match
from tarnwell.sources.sql import build_select, discovered

#: Orders with NULLs: priorities of customers divisible by 7 and prices of those divisible by 5 are unknown.
HOLES = """(SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END AS priority,
    CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS cust FROM orders)"""


def _when(name: str, divisor: int):
    return func("if", func("pmod", col("o_custkey"), lit(divisor)) != 0, col(name), lit(None))


def _holes(t) -> n.Node:
    return n.project(t("orders"), "o_orderkey", "o_custkey", priority=_when("o_orderpriority", 7), price=_when("o_totalprice", 5), cust=_when("o_custkey", 3))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    """``rows`` as SQL; text, whole numbers, booleans and NULL only."""
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


def _refused(kind, action) -> bool:
    try:
        action()
    except kind:
        return True
    return False


# predicates -------------------------------------------------------------------


@_plan(f"SELECT o_orderkey FROM {HOLES} WHERE NOT (priority = '1-URGENT' AND price > 100000)")
def filter_not_three_valued(t):
    return n.project(n.filter_(_holes(t), not_(and_(col("priority") == "1-URGENT", col("price") > 100000))), "o_orderkey")


@_plan(f"SELECT o_orderkey FROM {HOLES} WHERE priority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (1, 2, 4)")
def filter_lists(t):
    return n.project(n.filter_(_holes(t), col("priority").isin("1-URGENT", "2-HIGH") & not_(col("o_custkey").isin(1, 2, 4))), "o_orderkey")


@_plan(f"SELECT o_orderkey, priority IS NULL AS a, price IS NOT NULL AS b, (price IS NULL OR isnan(price)) AS c FROM {HOLES}")
def null_tests(t):
    e = {"a": func("is_null", col("priority")), "b": func("is_not_null", col("price")), "c": IsNull(col("price"), or_nan=True)}
    return n.project(_holes(t), "o_orderkey", **e)


@_plan("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0")
def nan_as_null(t):
    x = func("if", func("pmod", col("o_orderkey"), lit(2)) == 0, lit(float("nan")), col("o_orderkey").cast("double"))
    return n.project(n.filter_(n.project(t("orders"), x=x, k=col("o_orderkey")), IsNull(col("x"), or_nan=True)), "k")


@_plan("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS text, CAST(o_custkey AS DOUBLE) AS number, CAST(o_orderkey AS DECIMAL(20, 2)) AS exact, CAST(o_orderkey > 100 AS INTEGER) AS flag FROM orders")
def cast_expressions(t):
    o = col("o_orderkey")
    return n.project(t("orders"), "o_orderkey", text=o.cast("string"), number=col("o_custkey").cast("double"), exact=o.cast("decimal(20,2)"), flag=(o > 100).cast("int"))


@_plan("""SELECT p_partkey, substr(p_name, 2, 3) AS a, replace(p_name, 'a', '#') AS b, lpad(p_brand, 12, '*') AS c, reverse(p_brand) AS d,
    regexp_replace(p_name, '[aeiou]', '_', 'g') AS e, instr(p_name, 'e')::INTEGER AS f, concat_ws('-', p_brand, p_name) AS g, upper(p_name) AS h, starts_with(p_brand, 'Brand#1') AS i FROM part""")
def text_functions(t):
    name, brand = col("p_name"), col("p_brand")
    return n.project(
        t("part"), "p_partkey", a=func("substring", name, lit(2), lit(3)), b=func("replace", name, lit("a"), lit("#")), c=func("lpad", brand, 12, "*"),
        d=func("reverse", brand), e=func("regexp_replace", name, lit("[aeiou]"), lit("_")), f=func("instr", name, "e"), g=func("concat_ws", "-", brand, name),
        h=func("upper", name), i=func("startswith", brand, lit("Brand#1")),
    )


@_plan("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, CAST(last_day(o_orderdate) AS DATE) AS e,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS s FROM orders""")
def date_functions(t):
    d = col("o_orderdate")
    s = func("date_trunc", "month", d).cast("date")
    return n.project(t("orders"), "o_orderkey", y=func("year", d), m=func("month", d), d=func("day", d), e=func("last_day", d), s=s)


@_plan("SELECT o_orderkey, greatest(o_custkey, 50) AS a, least(o_custkey, 50) AS b, nullif(o_custkey, 7) AS c, round(sqrt(o_custkey), 9) AS d, floor(o_totalprice)::BIGINT AS e, ceil(o_totalprice)::BIGINT AS f, sign(o_totalprice - 100000)::DOUBLE AS g FROM orders")
def number_functions(t):
    c, p = col("o_custkey"), col("o_totalprice")
    return n.project(
        t("orders"), "o_orderkey", a=func("greatest", c, lit(50)), b=func("least", c, lit(50)), c=func("nullif", c, lit(7)), d=func("round", func("sqrt", c), 9),
        e=func("floor", p), f=func("ceil", p), g=func("sign", p - 100000),
    )


@_plan("SELECT o_orderkey, o_custkey / nullif(o_custkey - 7, 0) AS r, CAST(length(o_orderpriority) AS INTEGER) AS l FROM orders WHERE abs(o_custkey - 20) < 30")
def divide_by_zero(t):
    near = n.filter_(t("orders"), func("abs", col("o_custkey") - 20) < 30)
    return n.project(near, "o_orderkey", r=col("o_custkey") / (col("o_custkey") - 7), l=func("length", col("o_orderpriority")))


@_frame(
    _values(
        [
            ("jdbc:mysql://h/d", "SELECT `a`, `b``c` FROM `t` WHERE ((`a` > 3) AND (`b``c` IS NOT NULL)) LIMIT 5"),
            ("jdbc:postgresql://h/d", 'SELECT "a", "b`c" FROM "t" WHERE (("a" > 3) AND ("b`c" IS NOT NULL)) LIMIT 5'),
            ("sqlite:/x.db", 'SELECT "a", "b`c" FROM "t" WHERE (("a" > 3) AND ("b`c" IS NOT NULL)) LIMIT 5'),
        ],
        "connection, statement",
    )
)
def sql_text(spark, sf_dir):
    predicate = and_(col("a") > 3, col("b`c").is_not_null())
    made = [(c, build_select(c.removeprefix("jdbc:").split(":")[0], "t", None, ("a", "b`c"), predicate, 5)[0]) for c in ("jdbc:mysql://h/d", "jdbc:postgresql://h/d", "sqlite:/x.db")]
    return _rows(spark, made, "connection string, statement string")


@_frame(
    _values(
        [
            ("compare", '{"$and": [{"a": {"$gt": 3}}, {"b": {"$eq": "x"}}]}'),
            ("flipped", '{"a": {"$gt": 3}}'),
            ("in", '{"a": {"$in": [1, 2]}}'),
            ("is_not_null", '{"a": {"$ne": null}}'),
            ("is_null", '{"a": {"$eq": null}}'),
            ("not_equal", '{"a": {"$nin": [null, 3]}}'),
            ("two_columns", "null"),
        ],
        "predicate, document",
    )
)
def mongo_match(spark, sf_dir):
    made = {
        "compare": and_(col("a") > 3, col("b") == "x"), "flipped": lit(3) < col("a"), "in": col("a").isin(1, 2), "is_null": col("a").is_null(),
        "is_not_null": col("a").is_not_null(), "not_equal": col("a") != 3, "two_columns": col("a") == col("b"),
    }
    return _rows(spark, [(k, json.dumps(render_match(e))) for k, e in made.items()], "predicate string, document string")


# aggregates -------------------------------------------------------------------


@_plan("SELECT o_orderstatus, CAST(sum(3) AS BIGINT) AS threes, count(1) AS ones, avg(2.5::DOUBLE) AS middle, max('x') AS x FROM orders GROUP BY 1")
def agg_literals(t):
    return n.group_by(t("orders"), "o_orderstatus", aggs={"threes": sum_(lit(3)), "ones": count(lit(1)), "middle": mean(lit(2.5)), "x": max_(lit("x"))})


@_plan(f"SELECT priority, count(*) AS n, count(price) AS known, round(sum(price), 2) AS total, min(cust) AS least FROM {HOLES} GROUP BY 1")
def agg_null_keys(t):
    g = n.group_by(_holes(t), "priority", aggs={"n": count(), "known": count("price"), "s": sum_("price"), "least": min_("cust")})
    return n.project(g, "priority", "n", "known", "least", total=func("round", col("s"), 2))


@_plan("SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders WHERE o_orderkey < 0 GROUP BY 1")
def agg_empty_groups(t):
    return n.group_by(n.filter_(t("orders"), col("o_orderkey") < 0), "o_orderstatus", aggs={"n": count(), "s": sum_("o_custkey")})


@_plan(f"SELECT o_custkey, arg_min(price, o_orderkey) FILTER (price IS NOT NULL) AS a, arg_max(priority, o_orderkey) FILTER (priority IS NOT NULL) AS b FROM {HOLES} GROUP BY 1")
def agg_first_last_nulls(t):
    return n.group_by(_holes(t), "o_custkey", aggs={"a": first("price", "o_orderkey"), "b": last("priority", "o_orderkey")})


@_frame("SELECT o_orderstatus, TRUE AS near FROM orders GROUP BY 1")
def agg_approx_distinct(spark, sf_dir):
    """Within 5 % of the exact count (three standard errors)."""
    orders = table(spark, sf_dir, "orders")
    out = rel.group_by(orders, ["o_orderstatus"], {"a": Agg("approx_distinct", col("o_custkey")), "e": count("o_custkey", distinct=True)})
    return out.select("o_orderstatus", (F.abs(F.col("a") - F.col("e")) <= 1 + 0.05 * F.col("e")).alias("near"))


@_plan("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS INTEGER) AS grouping_id FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(t):
    return n.grouping_sets(t("orders"), "o_orderstatus", "o_orderpriority", aggs={"n": count()}, kind="sets", sets=[("o_orderstatus",), ("o_orderpriority",), ()])


@_frame("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\" FROM orders GROUP BY 1")
def agg_pivot(spark, sf_dir):
    return rel.pivot(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"], count()).na.fill(0, ["F", "O"])


@_frame("SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 4) AS high, round(var_samp(o_totalprice), 0) AS spread FROM orders GROUP BY 1")
def agg_percentile(spark, sf_dir):
    high = Agg("custom", col("o_totalprice"), custom=lambda x: F.round(F.percentile(x, F.lit(0.9)), 4))
    out = rel.group_by(table(spark, sf_dir, "orders"), ["o_orderstatus"], {"high": high, "v": Agg("variance", col("o_totalprice"))})
    return out.select("o_orderstatus", "high", F.round("v", 0).alias("spread"))


@_frame("SELECT o_orderstatus, round(count(*) / sum(1 / o_totalprice), 4) AS harmonic FROM orders GROUP BY 1")
def agg_python(spark, sf_dir):
    """A user's aggregate in Python: it sees a group's values as one Arrow array."""

    @F.arrow_udf("double")
    def harmonic(x: pa.Array) -> float:
        import pyarrow.compute as pc

        return len(x) / pc.sum(pc.divide(1.0, x)).as_py()

    out = rel.group_by(table(spark, sf_dir, "orders"), ["o_orderstatus"], {"h": Agg("custom", col("o_totalprice"), custom=harmonic)})
    return out.select("o_orderstatus", F.round("h", 4).alias("harmonic"))


@_plan("SELECT DISTINCT o_orderstatus, o_custkey % 3 AS k FROM orders")
def distinct_expressions(t):
    return n.deduplicate(n.project(t("orders"), "o_orderstatus", k=func("pmod", col("o_custkey"), lit(3))))


# joins and order --------------------------------------------------------------


@_plan(f"SELECT h.o_orderkey, c.c_name FROM {HOLES} h LEFT JOIN customer c ON h.cust = c.c_custkey")
def join_null_keys(t):
    return n.project(n.join(_holes(t), t("customer"), {"cust": "c_custkey"}, "left"), "o_orderkey", "c_name")


@_plan(f"SELECT o_orderkey FROM {HOLES} h WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = h.cust AND c.c_acctbal > 0)")
def join_anti_null_keys(t):
    good = n.filter_(t("customer"), col("c_acctbal") > 0)
    return n.project(n.join(_holes(t), good, {"cust": "c_custkey"}, "anti"), "o_orderkey")


_LAST = "(SELECT ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1)"


@_plan(f"SELECT e.event_id, p.event_id AS purchase FROM events e ASOF LEFT JOIN {_LAST} p ON e.ts >= p.ts")
def join_asof_sliced(t):
    """Without a key all rows are one history, which is worked on in slices of six hours."""
    bought = n.group_by(n.filter_(t("events"), col("event_type") == "purchase"), "ts", aggs={"purchase": max_("event_id")})
    bought = n.project(bought, "purchase", at=col("ts"))
    return n.project(n.asof_join(n.project(t("events"), "event_id", "ts"), bought, [], "ts", "at", slice_width=6 * 3600), "event_id", "purchase")


@_plan("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate = o_orderdate")
def join_two_keys(t):
    return n.project(n.join(t("lineitem"), t("orders"), {"l_orderkey": "o_orderkey", "l_shipdate": "o_orderdate"}), "l_orderkey", "l_linenumber", "o_custkey")


@_frame(f"SELECT o_orderkey, CAST(row_number() OVER (ORDER BY priority DESC NULLS LAST, price NULLS LAST, o_orderkey) AS BIGINT) AS place FROM {HOLES} ORDER BY place LIMIT 500")
def sort_nulls_last(spark, sf_dir):
    """The place of a row is where it stands in the sorted result."""
    top = lower(n.limit(n.sort(_holes(tables(sf_dir)), "priority desc", "price asc", "o_orderkey"), 500), Context(spark)).df
    found = top.select("o_orderkey").toArrow().column(0).to_pylist()  # 500 rows
    return _rows(spark, [(k, i + 1) for i, k in enumerate(found)], "o_orderkey bigint, place bigint")


@_plan("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 0)")
def limit_zero(t):
    return n.aggregate(n.limit(t("orders"), 0), {"n": count()})


# windows ----------------------------------------------------------------------

_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN"


@_plan(
    f"""SELECT o_orderkey, round(avg(price) {_OVER} 2 PRECEDING AND CURRENT ROW), 4) AS a, min(price) {_OVER} 1 PRECEDING AND 1 FOLLOWING) AS b,
    last_value(priority IGNORE NULLS) {_OVER} 3 PRECEDING AND CURRENT ROW) AS c, CAST(sum(o_custkey) {_OVER} 1 FOLLOWING AND 3 FOLLOWING) AS BIGINT) AS d,
    count(price) {_OVER} UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM {HOLES}"""
)
def win_more_frames(t):
    w = {"partition_by": ("o_custkey",), "order_by": (("o_orderkey", True),)}
    made = n.window(
        _holes(t), WindowFunction("m", mean("price"), frame="2 preceding and current row", **w), WindowFunction("b", min_("price"), frame="1 preceding and 1 following", **w),
        WindowFunction("c", Agg("last", col("priority")), frame="3 preceding and current row", **w), WindowFunction("d", sum_("o_custkey"), frame="1 following and 3 following", **w),
        WindowFunction("e", count("price"), frame="unbounded preceding and 1 preceding", **w),
    )
    return n.project(made, "o_orderkey", "b", "c", "d", "e", a=func("round", col("m"), 4))


@_plan(f"SELECT o_orderkey, array_to_string(list(priority) FILTER (priority IS NOT NULL) {_OVER} 2 PRECEDING AND CURRENT ROW), '|') AS l FROM {HOLES}")
def win_list(t):
    w = WindowFunction("x", Agg("list", col("priority")), ("o_custkey",), (("o_orderkey", True),), "2 preceding and current row")
    return n.project(n.window(_holes(t), w), "o_orderkey", l=func("nullif", func("concat_ws", "|", col("x")), lit("")))


@_plan(
    f"""SELECT h.o_orderkey, k.n AS kinds, k.s AS total, k.a AS middle, (SELECT count(DISTINCT priority) FROM orders) AS every FROM {HOLES} h JOIN
    (SELECT priority, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, round(avg(DISTINCT o_custkey), 9) AS a FROM {HOLES} GROUP BY 1) k ON h.priority IS NOT DISTINCT FROM k.priority""".replace(
        "(SELECT count(DISTINCT priority) FROM orders)", f"(SELECT count(DISTINCT priority) FROM {HOLES})"
    )
)
def win_distinct(t):
    """DISTINCT over whole partitions, of which one is that of NULL."""
    w = {"partition_by": ("priority",), "frame": ""}
    made = n.window(
        _holes(t), WindowFunction("kinds", count("o_custkey", distinct=True), **w), WindowFunction("total", sum_("o_custkey", distinct=True), **w),
        WindowFunction("m", mean("o_custkey", distinct=True), **w), WindowFunction("every", count("priority", distinct=True), frame=""),
    )
    return n.project(made, "o_orderkey", "kinds", "total", "every", middle=func("round", col("m"), 9))


@_plan(
    f"""SELECT a.o_orderkey, (SELECT count(DISTINCT b.priority) FROM {HOLES} b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <= a.o_orderkey) AS kinds FROM {HOLES} a"""
)
def win_distinct_running(t):
    w = WindowFunction("kinds", count("priority", distinct=True), ("o_custkey",), (("o_orderkey", True),))
    return n.project(n.window(_holes(t), w), "o_orderkey", "kinds")


@_plan(
    f"""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY price ASC NULLS FIRST, o_orderkey) AS INTEGER) AS up,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY price DESC NULLS FIRST, o_orderkey) AS INTEGER) AS down FROM {HOLES}"""
)
def win_nulls_first(t):
    w = lambda name, up: WindowFunction(name, "row_number", ("o_custkey",), (("price", up), ("o_orderkey", True)))
    return n.project(n.window(_holes(t), w("up", True), w("down", False)), "o_orderkey", "up", "down")


_FRAME_TEXTS = ["2 following and 1 following", "unbounded following and current row", "current row and 1 preceding", "x preceding", "range 1 preceding", "1 preceding and 1 following"]


@_frame(_values([(f, f != "1 preceding and 1 following") for f in _FRAME_TEXTS], "frame, refused"))
def win_bad_frames(spark, sf_dir):
    return _rows(spark, [(f, _refused(ValueError, lambda f=f: parse_frame(f))) for f in _FRAME_TEXTS], "frame string, refused boolean")


# cleaning ---------------------------------------------------------------------


@_frame(_values([("bigint to double", True), ("double to int", True), ("int to decimal", True), ("text to int", True), ("whole numbers to double", False)], "cast_of, refused"))
def cast_refuses(spark, sf_dir):
    """Casts that would lose digits fail when the rows are read."""
    data = {
        "bigint to double": ([(9007199254740993,)], "x bigint", "double"), "double to int": ([(1.5,)], "x double", "int"), "text to int": ([("7x",)], "x string", "int"),
        "int to decimal": ([(1234,)], "x int", "decimal(3,0)"), "whole numbers to double": ([(9007199254740992,), (-5,), (None,)], "x bigint", "double"),
    }
    found = []
    for name, (rows, schema, to) in data.items():
        df = lower(n.cast(n.const(rows, schema), {"x": to}), Context(spark)).df
        found.append((name, _refused(Exception, df.collect)))
    return _rows(spark, found, "cast_of string, refused boolean")


@_frame("SELECT 'c_acctbal' AS what, count(*) AS bad FROM customer WHERE c_acctbal <= 0 UNION ALL SELECT 'c_nationkey', count(*) - count(DISTINCT c_nationkey) FROM customer")
def quality_failures(spark, sf_dir):
    found = rel.quality_failures(table(spark, sf_dir, "customer"), {"c_acctbal": ["positive"], "c_nationkey": ["unique"], "c_custkey": ["unique", "not_null"]})
    rows = [(f.split(":")[0], int(f.rpartition("(")[2].split()[0])) for f in found]
    return _rows(spark, rows, "what string, bad bigint")


@_plan("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT -1, count(*) FROM customer")
def cached_twice(t):
    kept = n.cache(n.project(t("customer"), "c_nationkey"))
    whole = n.project(n.aggregate(kept, {"n": count()}), c_nationkey=lit(-1).cast("int"), n=col("n"))
    return n.union(n.project(n.group_by(kept, "c_nationkey", aggs={"n": count()}), c_nationkey=col("c_nationkey").cast("int"), n=col("n")), whole)


# governance -------------------------------------------------------------------

_TAGGED = [
    ("aggregate", "n", ""), ("aggregate", "total", "FINANCIAL"), ("declassified", "c_name", ""), ("expression", "mix", "FINANCIAL,PII"), ("join", "o_orderkey", "FINANCIAL,PII"),
    ("project", "c_custkey", ""), ("union", "x", "PII"), ("window", "place", "FINANCIAL"),
]


@_frame(_values(_TAGGED, "plan, column_name, tags"))
def tags_travel(spark, sf_dir):
    t = tables(sf_dir)
    people = n.classify(n.classify(t("customer"), "c_name", tags=["PII"]), "c_acctbal", tags=["FINANCIAL"])
    plans = {
        "aggregate": n.aggregate(people, {"n": count(), "total": sum_("c_acctbal")}),
        "declassified": n.project(n.declassify(people, "c_name", justification="public register"), "c_name"),
        "expression": n.project(people, mix=func("concat", col("c_name"), col("c_acctbal").cast("string"))),
        "join": n.project(n.join(people, t("orders"), {"c_custkey": "o_custkey"}), "o_orderkey"),
        "project": n.project(people, "c_custkey"),
        "union": n.union(n.project(people, x=col("c_name")), n.project(people, x=col("c_mktsegment"))),
        "window": n.project(n.window(people, WindowFunction("place", "row_number", (), (("c_acctbal", True),))), "place"),
    }
    found = [(p, c, ",".join(sorted(x))) for p, plan in plans.items() for c, x in lower(plan, Context(spark)).tags.items()]
    return _rows(spark, sorted(found), "plan string, column_name string, tags string")


_TARGETS = ["/data/out", "file:///data/out", "s3a://bucket/out", "jdbc:postgresql://h/d", "unknown://x", "//server/share"]


@_frame(_values([(p, t, not (t.startswith("/data") or t.startswith("file") or p == "open" and t.startswith("s3a"))) for p in ("baseline", "open", "open_secret") for t in _TARGETS], "policy, target, refused"))
def egress_refused(spark, sf_dir):
    df = lower(tables(sf_dir)("nation"), Context(spark))
    secret = lower(n.classify(tables(sf_dir)("nation"), "n_name", tags=["SECRET"]), Context(spark))
    allowed = Policy("open", True, frozenset({"s3a"}), "INTERNAL")
    cases = {"baseline": (BASELINE, df), "open": (allowed, df), "open_secret": (allowed, secret)}
    rows = [(name, t, _refused(errors.PrivacyViolation, lambda p=p, d=d, t=t: p.check_egress(t, d.schema))) for name, (p, d) in cases.items() for t in _TARGETS]
    return _rows(spark, rows, "policy string, target string, refused boolean")


@_frame(_values([("barrier above a sort", True), ("barrier changed", True), ("no barrier", True), ("secured", False)], "plan, refused"))
def barriers_checked(spark, sf_dir):
    scan = tables(sf_dir)("customer")
    policy = Policy("rows", rls=(RowRule("*", "c_nationkey = 7", "customer"),))
    rule = rls.parse_row_predicate("c_nationkey = 7")
    plans = {
        "no barrier": n.sort(scan, "c_custkey"), "secured": rls.secure(n.sort(scan, "c_custkey"), policy),
        "barrier above a sort": n.Barrier(n.sort(scan, "c_custkey"), rule, "c_nationkey = 7"),
        "barrier changed": n.Barrier(scan, rls.parse_row_predicate("c_nationkey = 8"), "c_nationkey = 7"),
    }
    return _rows(spark, sorted((k, _refused(errors.BarrierBroken, lambda p=p: rls.verify(p, policy))) for k, p in plans.items()), "plan string, refused boolean")


@_frame("SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def rls_renamed_source(spark, sf_dir):
    """A source is guarded by where it lies too, whatever the plan calls it."""
    plan = n.project(n.parquet(f"{sf_dir}/customer.parquet", name="something"), "c_custkey")
    return Service(spark, Policy("rows", rls=(RowRule("*", "c_nationkey = 7", "customer"),))).run(plan).df


@_frame(_values([("decoy", True), ("renamed", False), ("rule without a source", True)], "plan, refused"))
def rls_decoys(spark, sf_dir):
    t = tables(sf_dir)
    policy = Policy("rows", rls=(RowRule("*", "c_nationkey = 7", "customer"),))
    renamed = n.parquet(f"{sf_dir}/customer.parquet", name="x")
    decoy = n.join(renamed, n.const([(7,)], "c_nationkey int", name="customer"), "c_nationkey")
    two = n.join(t("customer"), t("nation"), {"c_nationkey": "n_nationkey"})
    cases = {"decoy": (decoy, policy), "renamed": (renamed, policy), "rule without a source": (two, Policy("rows", rls=(RowRule("*", "c_nationkey = 7"),)))}
    rows = [(k, _refused(errors.PolicyDenied, lambda p=p, q=q: rls.secure(p, q))) for k, (p, q) in cases.items()]
    return _rows(spark, rows, "plan string, refused boolean")


@_frame("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def rls_written(spark, sf_dir):
    """A plan that was never secured still writes only the rows that its rules allow."""
    rules = (RowRule("analyst", "c_nationkey = '3'"), RowRule("*", "c_mktsegment = BUILDING"))
    path = shared(spark, "written")
    plan = n.write_parquet(n.project(tables(sf_dir)("customer"), "c_custkey", "c_nationkey", "c_mktsegment"), path)
    lower(plan, Context(spark, Policy("rows", rls=rules), Subject("a", ("analyst",))))
    return spark.read.parquet(path).select("c_custkey", "c_nationkey")


@_frame(
    """SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) >= 12 THEN round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) END AS total FROM orders"""
)
def disclosure_windows(spark, sf_dir):
    plan = n.window(tables(sf_dir)("orders"), WindowFunction("s", sum_("o_totalprice"), ("o_custkey",), frame=""))
    policy = Policy("groups", disclosure=(DisclosureRule(12),))
    return Service(spark, policy).run(n.project(plan, "o_orderkey", total=func("round", col("s"), 2))).df


@_frame(_values([("cls_mask", True), ("disclosure", True), ("fine", False), ("max_sensitivity", True), ("nmae", True), ("rls", True)], "policy, refused"))
def policies_refused(spark, sf_dir):
    fine = {"name": "x", "rls": [{"role": "a", "predicate": "r = 1 AND s = 'x'"}], "disclosure": [{"k": 3}], "cls_mask": {"a": {"c": "hash"}}, "mask_threshold": "restricted"}
    cases = {
        "fine": fine, "nmae": {"nmae": "x"}, "rls": {"rls": [{"role": "a", "predicate": "r > 1"}]}, "max_sensitivity": {"max_sensitivity": "HIGH"},
        "cls_mask": {"cls_mask": {"a": {"c": "rot13"}}}, "disclosure": {"disclosure": [{"k": 1}]},
    }
    return _rows(spark, sorted((k, _refused(Exception, lambda d=d: policy_from_dict(d))) for k, d in cases.items()), "policy string, refused boolean")


@_frame(_values([(k, e) for k, e in enumerate("run_started policy_bound barriers_verified node_lowered rows_restricted node_lowered node_lowered suppressed node_lowered node_lowered columns_restricted completed".split())], "n, event"))
def audit_chain(spark, sf_dir):
    """The events of one governed run, in order, from a chain that verifies."""
    from tarnwell.governance import audit

    policy = Policy("all", rls=(RowRule("*", "c_mktsegment = BUILDING", "customer"),), cls_mask={"*": {"total": "full"}}, disclosure=(DisclosureRule(2),))
    service = Service(spark, policy)
    plan = n.sort(n.group_by(n.filter_(tables(sf_dir)("customer"), col("c_acctbal") > 0), "c_nationkey", aggs={"total": sum_("c_acctbal")}), "c_nationkey")
    with service.run(plan) as result:
        events = [e["event"] for e in result.events]
    assert audit.verify(service.recorder.entries) and audit.restriction(result.events) == "applied"
    return _rows(spark, list(enumerate(events)), "n bigint, event string")


# functions --------------------------------------------------------------------


@_frame("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def udtf_words(spark, sf_dir):
    def words(row):
        for word in row["p_name"].split(" "):
            yield (word,)

    return lower(n.table_function(tables(sf_dir)("part"), words, "word string", keep=("p_partkey",)), Context(spark)).df


@_frame("SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 3 THEN o_orderkey / 2 ELSE o_orderkey::DOUBLE END AS half FROM orders")
def udf_inferred_type(spark, sf_dir):
    """Nearly all values are whole; the type comes from all rows, not from the first ones."""

    def half(row):
        return row["o_orderkey"] / 2 if row["o_orderkey"] % 1000 == 3 else row["o_orderkey"]

    out = n.project(n.udf(n.project(tables(sf_dir)("orders"), "o_orderkey"), half), "o_orderkey", half=col("half").cast("double"))
    return lower(out, Context(spark)).df


@_frame(_values([("raises", True), ("too few values", True), ("works", False)], "function, refused"))
def udf_failures(spark, sf_dir):
    data = n.project(tables(sf_dir)("nation"), "n_nationkey")
    made = {"raises": lambda columns: 1 / 0, "too few values": lambda columns: columns["n_nationkey"][1:], "works": lambda columns: columns["n_nationkey"]}

    def run(f):
        lower(n.udf(data, f, "out", "column", "bigint"), Context(spark)).df.collect()

    return _rows(spark, [(k, _refused(Exception, lambda f=f: run(f))) for k, f in made.items()], "function string, refused boolean")


@_frame(_values([("captured value", True), ("other literal", True), ("same plan", False)], "change, differs"))
def semantic_ids(spark, sf_dir):
    def made(limit, least):
        def f(columns):
            return [x > limit for x in columns["n_nationkey"]]

        return n.filter_(n.udf(tables(sf_dir)("nation"), f, "out", "column", "boolean"), col("n_nationkey") > least).semantic_id()

    a = made(1, 2)
    return _rows(spark, [("same plan", made(1, 2) != a), ("captured value", made(3, 2) != a), ("other literal", made(1, 3) != a)], "change string, differs boolean")


# sources ----------------------------------------------------------------------

_SOME = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _local(name: str) -> str:
    """A place on the driver for what only the driver reads and writes."""
    return os.path.join(tempfile.mkdtemp(prefix="tarnwell-"), name)


@_frame(_SOME)
def source_arrow(spark, sf_dir):
    return lower(n.arrow(_customers(spark, sf_dir).toArrow()), Context(spark)).df


@_frame(f"{_SOME} WHERE c_custkey % 5 = 0")
def io_excel(spark, sf_dir):
    path = _local("x.xlsx")
    data = n.filter_(n.project(tables(sf_dir)("customer"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment"), func("pmod", col("c_custkey"), lit(5)) == 0)
    lower(n.write_excel(data, path, "people"), Context(spark))
    return lower(n.project(n.excel(path, "people"), "c_custkey", "c_name", "c_mktsegment", c_acctbal=col("c_acctbal").cast("double")), Context(spark)).df


@_frame("SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 20 AND c_custkey > 3")
def excel_range(spark, sf_dir):
    path = _local("y.xlsx")
    data = n.sort(n.filter_(n.project(tables(sf_dir)("customer"), "c_custkey", "c_name"), col("c_custkey") <= 20), "c_custkey")
    lower(n.write_excel(data, path), Context(spark))
    return lower(n.filter_(n.excel(path, cell_range="A1:B40"), col("c_custkey") > 3), Context(spark)).df


def _database(spark, sf_dir) -> str:
    path = _local("x.db")
    with closing(sqlite3.connect(path)) as db:
        db.execute("CREATE TABLE people (c_custkey INTEGER, c_name TEXT, c_acctbal REAL, c_mktsegment TEXT)")
        db.executemany("INSERT INTO people VALUES (?, ?, ?, ?)", _customers(spark, sf_dir).toLocalIterator())
        db.commit()
    return path


@_frame(f"{_SOME} WHERE c_acctbal > 1000 AND c_mktsegment = 'BUILDING'")
def source_sqlite(spark, sf_dir):
    """The filter above the scan runs in the database."""
    scan = n.sql(f"sqlite:{_database(spark, sf_dir)}", table="people")
    return lower(n.filter_(scan, and_(col("c_acctbal") > 1000, col("c_mktsegment") == "BUILDING")), Context(spark)).df


@_frame("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def source_sqlite_query(spark, sf_dir):
    query = "SELECT c_mktsegment, count(*) AS n FROM people GROUP BY c_mktsegment"
    return lower(n.sql(f"sqlite:{_database(spark, sf_dir)}", query=query), Context(spark)).df


@_frame(_values([("people", "c_custkey", "INTEGER", "bigint"), ("people", "c_name", "TEXT", "string"), ("people", "c_acctbal", "REAL", "double"), ("people", "c_mktsegment", "TEXT", "string")], "table_name, column_name, data_type, spark_type"))
def sqlite_schema(spark, sf_dir):
    return discovered(spark, f"sqlite:{_database(spark, sf_dir)}")


@_frame(_values([("blocked", True), ("clean", False), ("pushed filter", False), ("unpushable filter", False)], "run, refused"))
def ledgers(spark, sf_dir):
    """A run with a blocking entry is no success; a filter that a database can't take is told, not hidden."""
    ledger = Ledger()
    clean = _refused(errors.TarnwellError, ledger.assert_clean)
    scan = n.sql(f"sqlite:{_database(spark, sf_dir)}", table="people")
    told = Service(spark).run(n.filter_(scan, func("regexp_count", col("c_name"), lit("1")) > 0)).ledger
    quiet = Service(spark).run(n.filter_(scan, col("c_custkey") > 0)).ledger
    assert told.counts() == {"PREDICATE_NOT_PUSHED": 1} and not quiet.entries
    ledger.failed(errors.QualityCheckFailed(["x: has nulls"]), "gate")
    rows = [("clean", clean), ("blocked", _refused(errors.TarnwellError, ledger.assert_clean)), ("unpushable filter", bool(told.blocking)), ("pushed filter", bool(quiet.blocking))]
    return _rows(spark, rows, "run string, refused boolean")


@_frame("SELECT c_custkey AS _id, c_name AS name, '{\"city\":\"' || c_mktsegment || '\"}' AS place FROM customer WHERE c_custkey > 10")
def source_mongo(spark, sf_dir):
    path = shared(spark, "dump")
    made = table(spark, sf_dir, "customer").select(
        F.struct(F.col("c_custkey").cast("string").alias("$numberLong")).alias("_id"), F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("city")).alias("place")
    )
    made.write.json(path)
    return lower(n.mongo(path, "people", match=col("_id") > 10), Context(spark)).df.select("_id", "name", "place")


@_frame("SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (3, NULL)) t(id, name)")
def source_json_array(spark, sf_dir):
    path = shared(spark, "array")
    spark.createDataFrame([('[{"id": 1, "name": "a"}, {"id": 2, "name": "b"}, {"id": 3}]',)], "value string").coalesce(1).write.text(path)
    return lower(n.json(path, array=True), Context(spark)).df.select("id", "name")


@_frame("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'two' || chr(10) || 'lines, \"quoted\"' ELSE c_name END AS note FROM customer")
def csv_quoted_newlines(spark, sf_dir):
    """Fields with newlines, quotes and separators come back as they were."""
    path = shared(spark, "csv")
    note = func("if", func("pmod", col("c_custkey"), lit(2)) == 0, lit('two\nlines, "quoted"'), col("c_name"))
    lower(n.write_csv(n.project(tables(sf_dir)("customer"), "c_custkey", note=note), path), Context(spark))
    return lower(n.csv(path, schema="c_custkey bigint, note string"), Context(spark)).df


@_frame("SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def chained_write(spark, sf_dir):
    """A write is what it wrote, so that writes chain; both places hold the same rows."""
    a, b = shared(spark, "chain"), shared(spark, "chain")
    rich = n.project(n.filter_(tables(sf_dir)("customer"), col("c_acctbal") > 0), "c_custkey")
    lower(n.write_json(n.write_parquet(rich, a), b), Context(spark))
    return spark.read.parquet(a).intersectAll(spark.read.json(b))


@_frame("SELECT 'parquet' AS source, count(*) AS n, TRUE AS exact FROM customer UNION ALL SELECT 'csv', count(*), TRUE FROM customer UNION ALL SELECT 'json', count(*), TRUE FROM customer UNION ALL SELECT 'sqlite', count(*), TRUE FROM customer UNION ALL SELECT 'excel', count(*), TRUE FROM customer")
def profile_sources(spark, sf_dir):
    """Each source is written and read in batches: the driver holds none of them whole."""
    people, made = _customers(spark, sf_dir), {}
    schema = to_arrow_schema(people.schema)
    places = {kind: _local(f"x.{kind}") for kind in ("csv", "json", "parquet")}
    with open(places["csv"], "w", newline="", encoding="utf-8") as c, open(places["json"], "w", encoding="utf-8") as j, pq.ParquetWriter(places["parquet"], schema) as p:
        lines = csv.writer(c, lineterminator="\n")
        lines.writerow(people.columns)
        for batch in batched(people.toLocalIterator(), 10_000):
            lines.writerows(batch)
            records = [r.asDict() for r in batch]
            j.writelines(json.dumps(r) + "\n" for r in records)
            p.write_table(pa.Table.from_pylist(records, schema))
    made["csv"] = profile.profile_csv(places["csv"], whole=True)
    made["json"] = profile.profile_json(places["json"], whole=True)
    path = _local("x.xlsx")
    lower(n.write_excel(n.dataframe(people), path), Context(spark))
    made["excel"] = profile.profile_excel(path)
    made["sqlite"] = profile.profile_sqlite(_database(spark, sf_dir), "people", whole=True)
    made["parquet"] = profile.profile_parquet(places["parquet"])
    return _rows(spark, [(k, p.rows, p.exact) for k, p in made.items()], "source string, n bigint, exact boolean")


@_frame("SELECT 'c_custkey' AS column_name, TRUE AS near FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'c_mktsegment', TRUE FROM region WHERE r_regionkey = 0")
def profile_distinct(spark, sf_dir):
    """The sketch is within 5 % of the exact number of distinct values."""
    people = _customers(spark, sf_dir).select("c_custkey", "c_mktsegment")
    exact = people.agg(*[F.count_distinct(c).alias(c) for c in people.columns]).first()
    found = profile.profile(people)
    return _rows(spark, [(c, abs(found[c].distinct - exact[c]) <= 1 + 0.05 * exact[c]) for c in people.columns], "column_name string, near boolean")


@_frame(_values([("a file changed", True), ("same files", False)], "change, differs"))
def source_keys(spark, sf_dir):
    path = _local("x.csv")
    Path(path).write_text("a,b\n1,2\n")
    key = n.csv(path).cache_key()
    same = n.csv(path).cache_key() != key
    Path(path).write_text("a,b\n1,2\n3,4\n")
    return _rows(spark, [("same files", same), ("a file changed", n.csv(path).cache_key() != key)], "change string, differs boolean")
