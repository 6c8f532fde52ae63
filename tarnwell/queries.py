"""The registered queries of the engine: each operator over whole tables, with its SQL.

Sums of doubles are rounded, since the order of addition differs by engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import profile as profiles
from tarnwell.governance.policy import DisclosureRule, Policy, RowRule, Subject
from tarnwell.operators import relational as rel
from tarnwell.operators.windows import WindowFunction
from tarnwell.plans import nodes as n
from tarnwell.plans.expr import Agg, and_, col, count, first, func, last, list_, lit, max_, mean, min_, not_, or_, sum_
from tarnwell import semantics  # noqa: F401  (registers its queries)
from tarnwell.plans.lower import Context, lower
from tarnwell.registry import FRAMES, SQL, table as _t, tables as _tables
from tarnwell.registry import frame as _frame
from tarnwell.registry import plan as _plan
from tarnwell.registry import shared as _shared
from tarnwell.service import Service
from tarnwell.streaming import events as streams

# scans, projections, filters --------------------------------------------------


@_plan(
    """SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders
    WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY total DESC LIMIT 100"""
)
def flagship(t):
    kept = n.filter_(t("orders"), col("o_totalprice") > 100000)
    grouped = n.group_by(kept, "o_orderstatus", aggs={"total": sum_("o_totalprice"), "n": count()})
    rounded = n.project(grouped, "o_orderstatus", total=func("round", col("total"), 2), n=col("n"))
    return n.limit(n.sort(rounded, "total desc"), 100)


@_plan("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_project(t):
    return n.project(t("lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


@_plan("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_discount <> 0.05")
def filter_cmp(t):
    kept = n.filter_(t("lineitem"), (col("l_quantity") >= 45) & (col("l_discount") != 0.05))
    return n.project(kept, "l_orderkey", "l_linenumber", "l_extendedprice")


@_plan(
    """SELECT o_orderkey, o_orderpriority FROM orders
    WHERE (o_orderstatus = 'F' AND o_totalprice < 50000) OR o_orderpriority = '1-URGENT'"""
)
def filter_and_or(t):
    p = or_(and_(col("o_orderstatus") == "F", col("o_totalprice") < 50000), col("o_orderpriority") == "1-URGENT")
    return n.project(n.filter_(t("orders"), p), "o_orderkey", "o_orderpriority")


@_plan("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' OR o_totalprice > 20000)")
def filter_not(t):
    return n.project(n.filter_(t("orders"), not_((col("o_orderstatus") == "O") | (col("o_totalprice") > 20000))), "o_orderkey")


@_plan(
    """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000
    WHERE o_orderkey IS NULL"""
)
def filter_null(t):
    big = n.filter_(t("orders"), col("o_totalprice") > 300000)
    joined = n.join(t("customer"), big, {"c_custkey": "o_custkey"}, "left")
    return n.project(n.filter_(joined, col("o_orderkey").is_null()), "c_custkey", "o_orderkey")


@_plan("SELECT event_id, user_id FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL AND event_type IN ('click', 'view')")
def filter_in_not_null(t):
    p = and_(col("event_type").is_not_null(), col("value").is_not_null(), col("event_type").isin("click", "view"))
    return n.project(n.filter_(t("events"), p), "event_id", "user_id")


@_plan("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) / nullif(l_quantity, 0) > 1500")
def filter_arith(t):
    p = col("l_extendedprice") * (1 - col("l_discount")) / col("l_quantity") > 1500
    return n.project(n.filter_(t("lineitem"), p), "l_orderkey", "l_linenumber")


@_plan("SELECT c_custkey, upper(c_mktsegment) AS segment, CAST(length(c_name) AS INTEGER) AS chars FROM customer WHERE lower(c_mktsegment) = 'building' AND abs(c_acctbal) < 1000")
def filter_func(t):
    p = and_(func("lower", col("c_mktsegment")) == "building", func("abs", col("c_acctbal")) < 1000)
    return n.project(n.filter_(t("customer"), p), "c_custkey", segment=func("upper", col("c_mktsegment")), chars=func("length", col("c_name")))


@_plan(
    """SELECT p_partkey, coalesce(trim(p_name), '') AS name, CAST(p_size AS BIGINT) AS size, round(p_retailprice * 2, 1) AS twice,
    p_retailprice / nullif(p_size - p_size, 0) AS by_zero FROM part"""
)
def computed_projection(t):
    return n.project(
        t("part"), "p_partkey", name=func("coalesce", func("trim", col("p_name")), lit("")), size=col("p_size").cast("bigint"),
        twice=func("round", col("p_retailprice") * 2, 1), by_zero=col("p_retailprice") / (col("p_size") - col("p_size")),
    )


# joins ------------------------------------------------------------------------

_SIDES = """(SELECT c_custkey AS k, c_name AS name, c_nationkey AS tag FROM customer WHERE c_acctbal > 0) l
    {how} JOIN (SELECT o_custkey AS k, o_orderkey AS ord, o_orderstatus AS status FROM orders WHERE o_totalprice > 250000) r ON l.k = r.k"""


def _sides(t):
    left = n.filter_(t("customer"), col("c_acctbal") > 0)
    right = n.filter_(t("orders"), col("o_totalprice") > 250000)
    return (
        n.project(left, k=col("c_custkey"), name=col("c_name"), tag=col("c_nationkey")),
        n.project(right, k=col("o_custkey"), ord=col("o_orderkey"), status=col("o_orderstatus")),
    )


def _join(how: str, sql: str):
    def make(t):
        return n.join(*_sides(t), "k", how)

    make.__name__ = f"join_{how}"
    _plan(sql)(make)


for _how in ("inner", "left", "right", "full"):
    _join(_how, f"SELECT l.k, l.name, l.tag, r.ord, r.status FROM {_SIDES.format(how=_how.upper())}")
_join("semi", f"SELECT l.k, l.name, l.tag FROM {_SIDES.format(how='SEMI')}")
_join("anti", f"SELECT l.k, l.name, l.tag FROM {_SIDES.format(how='ANTI')}")


@_plan("SELECT n_nationkey AS k, n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    left = n.project(t("nation"), "n_name", k=col("n_nationkey"))
    right = n.project(t("region"), "r_name", k=col("r_regionkey"))
    return n.project(n.join(left, right, "k", "cross"), "k", "n_name", "r_name")


@_plan(
    """SELECT l.k, r.v AS v, l.own, r.extra FROM (SELECT n_nationkey AS k, n_name AS v, n_regionkey AS own FROM nation) l
    LEFT JOIN (SELECT s_nationkey AS k, s_name AS v, s_acctbal AS extra FROM supplier WHERE s_acctbal > 5000) r ON l.k = r.k"""
)
def join_collision(t):
    left = n.project(t("nation"), k=col("n_nationkey"), v=col("n_name"), own=col("n_regionkey"))
    right = n.project(n.filter_(t("supplier"), col("s_acctbal") > 5000), k=col("s_nationkey"), v=col("s_name"), extra=col("s_acctbal"))
    return n.join(left, right, "k", "left")


@_plan(
    """SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""
)
def join_star(t):
    j = n.join(t("lineitem"), t("orders"), {"l_orderkey": "o_orderkey"})
    j = n.join(j, t("customer"), {"o_custkey": "c_custkey"})
    j = n.join(j, t("nation"), {"c_nationkey": "n_nationkey"})
    j = n.join(j, t("region"), {"n_regionkey": "r_regionkey"})
    j = n.project(j, "n_name", "r_name", rev=col("l_extendedprice") * (1 - col("l_discount")))
    g = n.group_by(j, "n_name", "r_name", aggs={"revenue": sum_("rev"), "n": count()})
    return n.project(g, "n_name", "r_name", "n", revenue=func("round", col("revenue"), 2))


@_plan(
    """SELECT e.event_id, e.user_id, p.event_id AS purchase FROM events e
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p
    ON e.user_id = p.user_id AND e.ts >= p.ts"""
)
def join_asof(t):
    bought = n.group_by(n.filter_(t("events"), col("event_type") == "purchase"), "user_id", "ts", aggs={"purchase": max_("event_id")})
    bought = n.project(bought, "user_id", "purchase", at=col("ts"))
    return n.project(n.asof_join(n.project(t("events"), "event_id", "user_id", "ts"), bought, ["user_id"], "ts", "at"), "event_id", "user_id", "purchase")


@_frame(
    """SELECT p_partkey, tier FROM part JOIN (SELECT s_suppkey AS tier, s_suppkey * 20.0 + 900 AS lo, s_suppkey * 20.0 + 915 AS hi FROM supplier) b
    ON p_retailprice >= lo AND p_retailprice < hi"""
)
def join_range(spark, sf_dir):
    bands = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tier"), (F.col("s_suppkey") * 20.0 + 900).alias("lo"), (F.col("s_suppkey") * 20.0 + 915).alias("hi"))
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return rel.range_join(parts, bands, "p_retailprice", "lo", "hi", 20.0).select("p_partkey", "tier")


# aggregates -------------------------------------------------------------------


@_plan(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
    min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n, count(l_discount) AS n_discount,
    CAST(sum(l_linenumber) AS BIGINT) AS sum_lines FROM lineitem GROUP BY 1, 2"""
)
def agg_basic(t):
    g = n.group_by(
        t("lineitem"), "l_returnflag", "l_linestatus",
        aggs={"q": sum_("l_quantity"), "p": mean("l_extendedprice"), "first_ship": min_("l_shipdate"), "last_ship": max_("l_shipdate"),
              "n": count(), "n_discount": count("l_discount"), "sum_lines": sum_("l_linenumber")},
    )
    return n.project(
        g, "l_returnflag", "l_linestatus", "first_ship", "last_ship", "n", "n_discount", "sum_lines",
        sum_qty=func("round", col("q"), 2), avg_price=func("round", col("p"), 4),
    )


@_plan(
    """SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS sum_keys,
    round(avg(DISTINCT o_custkey), 6) AS avg_key FROM orders GROUP BY 1"""
)
def agg_distinct(t):
    g = n.group_by(t("orders"), "o_orderpriority", aggs={"customers": count("o_custkey", distinct=True), "sum_keys": sum_("o_custkey", distinct=True), "a": mean("o_custkey", distinct=True)})
    return n.project(g, "o_orderpriority", "customers", "sum_keys", avg_key=func("round", col("a"), 6))


@_plan(
    """SELECT user_id, first(event_type ORDER BY ts, event_id) AS first_type, last(event_type ORDER BY ts, event_id) AS last_type,
    array_to_string(list(event_id ORDER BY ts, event_id), ',') AS ids FROM events GROUP BY 1"""
)
def agg_ordered(t):
    g = n.group_by(
        t("events"), "user_id",
        aggs={"first_type": first("event_type", "ts", "event_id"), "last_type": last("event_type", "ts", "event_id"), "l": list_(col("event_id").cast("string"), "ts", "event_id")},
    )
    return n.project(g, "user_id", "first_type", "last_type", ids=func("concat_ws", ",", col("l")))


@_plan("SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, CAST(sum(3) AS BIGINT) AS threes FROM lineitem WHERE l_quantity < 0")
def agg_global_empty(t):
    g = n.aggregate(n.filter_(t("lineitem"), col("l_quantity") < 0), {"n": count(), "s": sum_("l_quantity"), "threes": sum_(lit(3))})
    return n.project(g, "n", "threes", q=func("round", col("s"), 2))


@_plan("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem")
def agg_global_expression(t):
    g = n.aggregate(t("lineitem"), {"s": sum_(col("l_extendedprice") * col("l_discount")), "n": count()})
    return n.project(g, "n", revenue=func("round", col("s"), 2))


@_plan("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def group_distinct(t):
    return n.group_by(t("customer"), "c_mktsegment", "c_nationkey")


@_plan("SELECT l_partkey, l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1, 2")
def agg_many_groups(t):
    return n.group_by(t("lineitem"), "l_partkey", "l_suppkey", aggs={"n": count(), "lines": sum_("l_linenumber")})


@_frame("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::INTEGER AS grouping_id FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, sf_dir):
    return rel.grouping_sets(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": count()}, "rollup")


@_frame("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::INTEGER AS grouping_id FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, sf_dir):
    return rel.grouping_sets(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": count()}, "cube")


# windows ----------------------------------------------------------------------

_W = {"partition_by": ("user_id",), "order_by": (("ts", True), ("event_id", True))}
_OVER = "OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST"


@_plan(
    f"""SELECT event_id, user_id, row_number() {_OVER}) AS rn,
    rank() OVER (PARTITION BY user_id ORDER BY event_type DESC NULLS FIRST) AS rk,
    dense_rank() OVER (PARTITION BY user_id ORDER BY event_type NULLS FIRST) AS dr FROM events"""
)
def win_ranks(t):
    w = n.window(
        t("events"), WindowFunction("rn", "row_number", **_W), WindowFunction("rk", "rank", ("user_id",), (("event_type", False),)),
        WindowFunction("dr", "dense_rank", ("user_id",), (("event_type", True),)),
    )
    return n.project(w, "event_id", "user_id", rn=col("rn").cast("bigint"), rk=col("rk").cast("bigint"), dr=col("dr").cast("bigint"))


_FRAMES_TESTED = {
    "running": "rows between unbounded preceding and current row",
    "moving": "2 preceding and 2 following",
    "ahead": "current row and unbounded following",
    "before": "3 preceding and 1 preceding",
    "whole": "unbounded preceding and unbounded following",
}


@_plan(
    "SELECT event_id, "
    + ", ".join(f"CAST(sum(event_id) {_OVER} ROWS BETWEEN {f.removeprefix('rows between ')}) AS BIGINT) AS s_{k}" for k, f in _FRAMES_TESTED.items())
    + f", count(event_type) {_OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, max(value) {_OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3"
    + f", first_value(event_type) {_OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f3 FROM events"
)
def win_frames(t):
    frames = [WindowFunction(f"s_{k}", sum_("event_id"), frame=f, **_W) for k, f in _FRAMES_TESTED.items()]
    three = "2 preceding and current row"
    more = [WindowFunction("c3", count("event_type"), frame=three, **_W), WindowFunction("m3", max_("value"), frame=three, **_W), WindowFunction("f3", Agg("first", col("event_type")), frame=three, **_W)]
    return n.project(n.window(t("events"), *frames, *more), "event_id", *[f.output for f in (*frames, *more)])


@_plan(
    """SELECT o_orderkey, (SELECT count(DISTINCT x.o_orderpriority) FROM orders x WHERE x.o_custkey = o.o_custkey) AS kinds,
    lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next2 FROM orders o"""
)
def win_distinct_offset(t):
    w = (("o_custkey",), (("o_orderkey", True),))
    out = n.window(
        t("orders"), WindowFunction("kinds", count("o_orderpriority", distinct=True), ("o_custkey",), frame=""),
        WindowFunction("previous", "lag", *w, arg="o_orderkey"), WindowFunction("next2", "lead", *w, arg="o_orderkey", offset=2),
    )
    return n.project(out, "o_orderkey", "kinds", "previous", "next2")


# sorting, sets, cleaning ------------------------------------------------------


@_plan(
    """SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber) AS BIGINT) AS place
    FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100"""
)
def topk(t):
    top = n.limit(n.sort(t("lineitem"), "l_extendedprice desc", "l_orderkey", "l_linenumber"), 100)
    w = n.window(top, WindowFunction("place", "row_number", (), (("l_extendedprice", False), ("l_orderkey", True), ("l_linenumber", True))))
    return n.project(w, "l_orderkey", "l_linenumber", place=col("place").cast("bigint"))


@_plan("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey")
def sort_full(t):
    return n.sort(n.project(t("orders"), "o_orderkey", "o_totalprice"), "o_totalprice desc", "o_orderkey asc")


@_plan("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedup_first(t):
    return n.project(n.deduplicate(t("events"), "user_id", keep="first", order_by=("ts", "event_id")), "user_id", "event_id", "event_type")


@_plan("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedup_last(t):
    return n.project(n.deduplicate(t("events"), "user_id", keep="last", order_by=("ts", "event_id")), "user_id", "event_id", "event_type")


@_plan("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def dedup_all(t):
    return n.deduplicate(n.project(t("orders"), "o_custkey", "o_orderstatus"))


@_plan("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice FROM orders WHERE round(o_totalprice, 2) = o_totalprice")
def cast_safe(t):
    exact = n.filter_(t("orders"), func("round", col("o_totalprice"), 2) == col("o_totalprice"))
    return n.cast(n.project(exact, "o_orderkey", "o_custkey", "o_totalprice"), {"o_orderkey": "string", "o_custkey": "int", "o_totalprice": "decimal(18,2)"})


_GAPS = "(SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000)"


def _gaps(t):
    big = n.filter_(t("orders"), col("o_totalprice") > 300000)
    return n.project(n.join(t("customer"), big, {"c_custkey": "o_custkey"}, "left"), "c_custkey", "o_orderkey", "o_orderstatus")


@_plan(f"SELECT * FROM {_GAPS} WHERE o_orderkey IS NOT NULL AND o_orderstatus IS NOT NULL")
def null_drop(t):
    return n.handle_nulls(_gaps(t), "drop", "o_orderkey", "o_orderstatus")


@_plan(f"SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey, o_orderstatus FROM {_GAPS}")
def null_fill(t):
    return n.handle_nulls(_gaps(t), "fill", "o_orderkey", value=-1)


@_plan(f"SELECT c_custkey, coalesce(o_orderkey, 0) AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus FROM {_GAPS}")
def null_zero_empty(t):
    return n.handle_nulls(n.handle_nulls(_gaps(t), "zero", "o_orderkey"), "empty", "o_orderstatus")


@_plan("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def union_all(t):
    return n.union(n.project(t("supplier"), k=col("s_suppkey"), name=col("s_name")), n.project(t("customer"), name=col("c_name"), k=col("c_custkey")))


@_plan("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return n.intersect(n.project(n.filter_(t("customer"), col("c_acctbal") > 9000), k=col("c_nationkey")), n.project(t("supplier"), k=col("s_nationkey")))


@_plan("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_except(t):
    return n.except_(n.project(t("orders"), k=col("o_custkey")), n.project(n.filter_(t("customer"), col("c_acctbal") < 0), k=col("c_custkey")), all_rows=True)


@_plan("SELECT c_custkey, c_name FROM customer")
def quality_gate(t):
    return n.quality_check(n.project(t("customer"), "c_custkey", "c_name"), {"c_custkey": ("not_null", "unique"), "c_name": "required"})


@_plan("SELECT o_orderkey, o_totalprice * 0.2::DOUBLE AS tax, CAST(length(o_orderpriority) + 1 AS BIGINT) AS width FROM orders")
def udf_columns(t):
    def tax(columns):
        return [x * 0.2 for x in columns["o_totalprice"]]

    def width(row):
        return len(row["o_orderpriority"]) + 1

    taxed = n.udf(n.project(t("orders"), "o_orderkey", "o_totalprice", "o_orderpriority"), tax, returns="double")
    return n.project(n.udf(taxed, width, returns="bigint"), "o_orderkey", "tax", "width")


# governance -------------------------------------------------------------------


def _governed(spark: SparkSession, plan: n.Node, policy: Policy, *roles: str) -> DataFrame:
    return Service(spark, policy).run(plan, Subject("analyst", roles)).df


@_frame("SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def rls_single(spark, sf_dir):
    policy = Policy("rows", rls=(RowRule("analyst", "c_mktsegment = 'BUILDING'"),))
    g = n.group_by(_tables(sf_dir)("customer"), "c_nationkey", aggs={"n": count(), "b": mean("c_acctbal")})
    return _governed(spark, n.project(g, "c_nationkey", "n", balance=func("round", col("b"), 4)), policy, "analyst")


@_frame(
    """SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 7)
    LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey"""
)
def rls_join(spark, sf_dir):
    rules = (RowRule("eu", "c_mktsegment = MACHINERY", "customer"), RowRule("*", "c_nationkey = 7", "customer"), RowRule("eu", "o_orderstatus = 'F'", "orders"))
    t = _tables(sf_dir)
    return _governed(spark, n.project(n.join(t("customer"), t("orders"), {"c_custkey": "o_custkey"}, "left"), "c_custkey", "o_orderkey"), Policy("rows", rls=rules), "eu")


@_frame(
    """SELECT c_custkey, substr(sha256(c_name), 1, 12) AS c_name, 0.0::DOUBLE AS c_acctbal,
    CASE WHEN length(c_mktsegment) <= 4 THEN repeat('*', length(c_mktsegment))
         ELSE repeat('*', length(c_mktsegment) - 4) || right(c_mktsegment, 4) END AS c_mktsegment FROM customer"""
)
def mask_columns(spark, sf_dir):
    policy = Policy("columns", mask_threshold="CONFIDENTIAL", cls_drop={"*": frozenset({"c_nationkey"})}, cls_mask={"analyst": {"c_name": "hash", "c_mktsegment": "partial"}})
    return _governed(spark, n.classify(_tables(sf_dir)("customer"), "c_acctbal", tags=["FINANCIAL"]), policy, "analyst")


@_frame(
    """SELECT s_suppkey, CAST(NULL AS VARCHAR) AS full_mask, '[redacted]' AS redact_mask,
    substr(mail, 1, 1) || '***@' || split_part(mail, '@', 2) AS email_mask
    FROM (SELECT s_suppkey, lower(replace(s_name, '#', '')) || '@example.com' AS mail FROM supplier)"""
)
def mask_email(spark, sf_dir):
    mail = func("concat", func("lower", func("replace", col("s_name"), lit("#"), lit(""))), lit("@example.com"))
    plan = n.project(_tables(sf_dir)("supplier"), "s_suppkey", full_mask=mail, redact_mask=mail, email_mask=mail)
    policy = Policy("masks", cls_mask={"*": {"full_mask": "full", "redact_mask": "redact", "email_mask": "email"}})
    return _governed(spark, plan, policy, "analyst")


@_frame("SELECT o_custkey, o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1, 2 HAVING count(*) >= 4")
def disclosure_k(spark, sf_dir):
    policy = Policy("groups", disclosure=(DisclosureRule(4), DisclosureRule(2, "analyst")))
    return _governed(spark, n.group_by(_tables(sf_dir)("orders"), "o_custkey", "o_orderpriority", aggs={"n": count(), "keys": sum_("o_orderkey")}), policy, "analyst")


@_frame(
    """SELECT 'o_orderstatus' AS column_name, count(*) AS n_rows, count_if(o_orderstatus IS NULL)::BIGINT AS nulls, min(o_orderstatus) AS least, max(o_orderstatus) AS most, round(avg(length(o_orderstatus)), 6) AS mean_chars FROM orders
    UNION ALL SELECT 'o_orderpriority', count(*), count_if(o_orderpriority IS NULL)::BIGINT, min(o_orderpriority), max(o_orderpriority), round(avg(length(o_orderpriority)), 6) FROM orders
    UNION ALL SELECT 'o_custkey', count(*), count_if(o_custkey IS NULL)::BIGINT, CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR), NULL FROM orders"""
)
def profile_columns(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    return profiles.profile_frame(df).select("column_name", "n_rows", "nulls", "least", "most", F.round("mean_chars", 6).alias("mean_chars"))


# sources and sinks ------------------------------------------------------------


def _there_and_back(kind: str, mode: str, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    path = _shared(spark, f"io-{kind}")
    data = n.project(_tables(sf_dir)("customer"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    write = {"csv": n.write_csv, "json": n.write_json, "parquet": n.write_parquet}[kind]
    read = {"csv": n.csv, "json": n.json, "parquet": n.parquet}[kind]
    for _ in range(2 if mode == "append" else 1):
        lower(write(data, path, mode), Context(spark))
    return lower(n.project(read(path, **options), "c_custkey", "c_name", "c_acctbal", "c_mktsegment"), Context(spark)).df


_CUSTOMERS = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


@_frame(_CUSTOMERS)
def io_csv(spark, sf_dir):
    return _there_and_back("csv", "overwrite", spark, sf_dir, schema="c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@_frame(_CUSTOMERS)
def io_json(spark, sf_dir):
    return _there_and_back("json", "overwrite", spark, sf_dir)


@_frame(f"{_CUSTOMERS} UNION ALL {_CUSTOMERS}")
def io_parquet_append(spark, sf_dir):
    return _there_and_back("parquet", "append", spark, sf_dir)


@_frame("SELECT * FROM (VALUES (1::BIGINT, 'one', 1.5::DOUBLE), (2, NULL, NULL)) t(id, name, amount)")
def source_const(spark, sf_dir):
    return lower(n.const([{"id": 1, "name": "one", "amount": 1.5}, {"id": 2}], "id bigint, name string, amount double"), Context(spark)).df


@_frame("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def masked_write(spark, sf_dir):
    """What is written is what the policy lets through, and is the write's result."""
    policy = Policy("columns", cls_drop={"*": frozenset({"c_name"})})
    data = n.project(n.filter_(_tables(sf_dir)("customer"), col("c_acctbal") > 5000), "c_custkey", "c_acctbal", "c_name")
    path = _shared(spark, "masked")
    Service(spark, policy).run(n.write_parquet(data, path), Subject("analyst"))
    return spark.read.parquet(path)


# extensions -------------------------------------------------------------------


@_frame(
    """SELECT o_orderpriority, round(stddev(o_totalprice), 4) AS spread, round(median(o_totalprice), 4) AS middle FROM orders GROUP BY 1"""
)
def agg_spread(spark, sf_dir):
    out = rel.group_by(_t(spark, sf_dir, "orders"), ["o_orderpriority"], {"s": Agg("stddev", col("o_totalprice")), "m": Agg("median", col("o_totalprice"))})
    return out.select("o_orderpriority", F.round("s", 4).alias("spread"), F.round("m", 4).alias("middle"))


@_frame("SELECT l_returnflag, round(sum(l_quantity * l_quantity) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY 1")
def agg_custom(spark, sf_dir):
    """A user's aggregate as an expression of built-in ones: it keeps its partial sums."""
    own = Agg("custom", col("l_quantity"), custom=lambda x: F.round(F.sum(x * x) / F.sum(x), 4))
    return rel.group_by(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], {"weighted": own})


@_plan(
    """SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS quarter,
    round(percent_rank() OVER (PARTITION BY user_id ORDER BY ts, event_id), 9) AS place FROM events"""
)
def win_ntile(t):
    w = n.window(t("events"), WindowFunction("quarter", "ntile", offset=4, **_W), WindowFunction("p", "percent_rank", **_W))
    return n.project(w, "event_id", "quarter", place=func("round", col("p"), 9))


@_plan(f"""SELECT c_custkey, coalesce(o_orderkey, CAST(floor((SELECT avg(o_orderkey) FROM {_GAPS})) AS BIGINT)) AS o_orderkey,
    coalesce(o_orderstatus, (SELECT o_orderstatus FROM {_GAPS} WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus FROM {_GAPS}""")
def null_impute(t):
    return n.handle_nulls(_gaps(t), "impute", "o_orderkey", "o_orderstatus")


@_plan("SELECT c_custkey, coalesce(o_orderstatus, 'none') AS status FROM " + _GAPS + " WHERE coalesce(o_orderkey, 0) < 100")
def filter_coalesce(t):
    kept = n.filter_(_gaps(t), func("coalesce", col("o_orderkey"), lit(0)) < 100)
    return n.project(kept, "c_custkey", status=func("coalesce", col("o_orderstatus"), lit("none")))


# event time -------------------------------------------------------------------


@_frame(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"""
)
def events_tumbling(spark, sf_dir):
    out = streams.tumbling(_t(spark, sf_dir, "events"), "1 hour", ("event_type",), "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@_frame(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_sessions(spark, sf_dir):
    out = streams.sessions(_t(spark, sf_dir, "events"), "30 minutes", "user_id")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(FRAMES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
