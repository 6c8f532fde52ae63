import pytest
from pyspark.sql import types as T

from tarnwell import types as types_
from tarnwell.errors import BarrierBroken, CastFailed, FunctionFailed, PolicyDenied, PrivacyViolation, QualityCheckFailed, SourceUnavailable, UnknownColumn, UnmappableType, translated
from tarnwell.governance import audit, rls
from tarnwell.governance.policy import DisclosureRule, Policy, RowRule, Subject, parse_row_predicate, policy_from_dict, sink_of
from tarnwell.operators import relational as rel
from tarnwell.operators.windows import WindowFunction, parse_frame, with_windows
from tarnwell.plans import nodes as n
from tarnwell.plans.expr import Agg, and_, col, count, first, func, last, lit, mean, not_, sum_
from tarnwell.plans.lower import Context, lower
from tarnwell.schema import Field, Schema, SchemaDiff
from tarnwell.service import Service


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def sides(spark):
    return table(spark, [(1, "a"), (2, "b"), (3, "c")], "k long, lv string"), table(spark, [(2, "B"), (3, "C"), (4, "D")], "k long, rv string")


@pytest.mark.parametrize("how,expected", [("inner", 2), ("left", 3), ("right", 3), ("full", 4), ("semi", 2), ("anti", 1), ("cross", 9)])
def test_join_counts(sides, how, expected):
    assert rel.join(*sides, ["k"], how).count() == expected


def test_join_keys_and_collisions(spark, sides):
    assert (None, None, "D") in rows(rel.join(*sides, "k", "right"))
    assert (None, None, "D") in rows(rel.join(*sides, "k", "full"))
    left, right = table(spark, [(1, 10, "x"), (2, 20, "y")], "k int, v int, o string"), table(spark, [(2, 99, 7)], "k int, v int, e int")
    out = rel.join(left, right, "k", "left")
    assert out.columns == ["k", "v", "o", "e"] and rows(out) == [(1, None, "x", None), (2, 99, "y", 7)]


def test_null_keys_never_match(spark):
    left, right = table(spark, [(1, "a"), (None, "b")], "k long, lv string"), table(spark, [(None, "c"), (2, "d")], "k long, rv string")
    assert rel.join(left, right, "k").count() == 0
    assert rows(rel.join(left, right, "k", "anti")) == [(1, "a"), (None, "b")]
    with pytest.raises(UnknownColumn):
        rel.join(left, right, "nope")
    with pytest.raises(ValueError):
        rel.join(left, right, [], "inner")


def test_aggregates(spark):
    df = table(spark, [("a", 1), ("a", 1), ("a", 2), ("a", 2), ("b", None), (None, 7)], "k string, v long")
    got = rows(rel.group_by(df, ["k"], {"s": sum_("v"), "d": sum_("v", distinct=True), "c": count("v"), "n": count(), "m": mean("v")}))
    assert got == sorted([("a", 6, 3, 4, 4, 1.5), ("b", None, None, 0, 1, None), (None, 7, 7, 1, 1, 7.0)], key=repr)
    assert rows(rel.group_by(df, ["k"])) == [("a",), ("b",), (None,)]
    empty = df.where("false")
    assert rows(rel.aggregate(empty, {"n": count(), "s": sum_("v")})) == [(0, None)]
    assert rel.group_by(empty, ["k"], {"n": count()}).count() == 0
    with pytest.raises(ValueError):
        rel.group_by(df, ["k"], {"s": Agg("sum")})
    ordered = table(spark, [(1, None, 1), (1, "x", 2), (1, "y", 3), (1, None, 4)], "k int, v string, o int")
    assert rows(rel.group_by(ordered, ["k"], {"f": first("v", "o"), "l": last("v", "o"), "all": Agg("list", col("v"), order_by=("o",))})) == [(1, "x", "y", ["x", "y"])]


def test_rank_family(spark):
    df = table(spark, [(10,), (20,), (20,), (30,)], "v int")
    out = with_windows(df, [WindowFunction(f, f, (), (("v", True),)) for f in ("row_number", "rank", "dense_rank")])
    assert [tuple(r) for r in out.orderBy("row_number").collect()] == [(10, 1, 1, 1), (20, 2, 2, 2), (20, 3, 2, 2), (30, 4, 4, 3)]
    nulls = with_windows(table(spark, [(1,), (None,), (None,)], "v int"), [WindowFunction("r", "rank", (), (("v", False),))])
    assert rows(nulls) == [(1, 3), (None, 1), (None, 1)]


@pytest.mark.parametrize(
    "frame,expected",
    [("", [6, 6, 6]), ("unbounded preceding", [1, 3, 6]), ("current row and 1 following", [3, 5, 3]), ("1 preceding and current row", [1, 3, 5]), ("rows between 2 preceding and 1 preceding", [None, 1, 3])],
)
def test_frames(spark, frame, expected):
    df = table(spark, [(1,), (2,), (3,)], "v long")
    out = with_windows(df, [WindowFunction("s", sum_("v"), (), (("v", True),), frame)])
    assert [r.s for r in out.orderBy("v").collect()] == expected


@pytest.mark.parametrize("frame", ["nonsense", "2 following and 1 preceding", "unbounded following and current row", "current preceding"])
def test_bad_frames(frame):
    with pytest.raises(ValueError):
        parse_frame(frame)


def test_window_distinct(spark):
    df = table(spark, [("a", 1), ("a", 1), ("a", 2), ("b", None)], "k string, v int")
    fs = [WindowFunction(f, Agg(f, col("v"), True), ("k",), frame="") for f in ("count", "sum", "avg")]
    assert rows(with_windows(df, fs).distinct()) == [("a", 1, 2, 3, 1.5), ("a", 2, 2, 3, 1.5), ("b", None, 0, None, None)]


def test_filters_are_three_valued(spark):
    df = table(spark, [("a", 1), ("b", None), ("c", 3)], "region string, n int")
    assert len(rows(rel.filter_(df, col("n") > 0))) == 2
    assert len(rows(rel.filter_(df, col("n") != 1))) == 1
    assert len(rows(rel.filter_(df, not_(col("n") > 1)))) == 1
    assert len(rows(rel.filter_(df, col("n").is_null()))) == 1
    assert rows(rel.project(df, ["region"], {"q": col("n") / 0})) == [("a", None), ("b", None), ("c", None)]
    with pytest.raises(UnknownColumn):
        rel.filter_(df, col("nope") == 1)
    with pytest.raises(ValueError):
        func("no_such_function", col("n")).column()


def test_sort_puts_nulls_last(spark):
    df = table(spark, [(2,), (None,), (1,)], "v int")
    assert [r.v for r in rel.sort(df, "v").collect()] == [1, 2, None]
    assert [r.v for r in rel.sort(df, "v desc").collect()] == [2, 1, None]
    assert [r.v for r in rel.top_k(df, 1, "v desc").collect()] == [2]
    with pytest.raises(ValueError):
        rel.limit(df, -1)


def test_deduplicate(spark):
    df = table(spark, [(i, k) for i, k in enumerate("AABCBD")], "i int, k string")
    assert [r.i for r in rel.deduplicate(df, ["k"], "last", ["i"]).orderBy("i").collect()] == [1, 3, 4, 5]
    assert [r.i for r in rel.deduplicate(df, ["k"], "first", ["i"]).orderBy("i").collect()] == [0, 2, 3, 5]
    assert rel.deduplicate(table(spark, [(None,), (None,)], "k int")).count() == 1
    with pytest.raises(ValueError):
        rel.deduplicate(df, ["k"], "middle")


def test_cast_safe(spark):
    df = table(spark, [(1.0, "7"), (2.0, None)], "d double, s string")
    assert rows(rel.cast_safe(df, {"d": "int", "s": "int"})) == [(1, 7), (2, None)]
    for bad, kind in ((1.5, "int"), (1e12, "int")):
        with pytest.raises(Exception) as e:
            rel.cast_safe(table(spark, [(bad,)], "d double"), {"d": kind}).collect()
        assert isinstance(translated(e.value), CastFailed)
    with pytest.raises(Exception, match="cannot cast"):
        rel.cast_safe(table(spark, [("x",)], "s string"), {"s": "int"}).collect()


def test_nulls_and_quality(spark):
    df = table(spark, [(1, "a", 2.0), (None, None, 4.0), (3, "a", None)], "i int, s string, d double")
    assert rel.handle_nulls(df, "drop").count() == 1
    assert rows(rel.handle_nulls(df, "zero"))[0][0] is not None
    assert rows(rel.handle_nulls(df, "impute").select("i", "s", "d")) == [(1, "a", 2.0), (2, "a", 4.0), (3, "a", 3.0)]
    with pytest.raises(ValueError):
        rel.handle_nulls(df, "guess")
    with pytest.raises(QualityCheckFailed) as e:
        rel.quality_check(df, {"i": ["not_null", "odd_rule"], "s": "unique", "nope": "not_null", "d": "positive"})
    assert len(e.value.failures) == 4
    assert rel.quality_check(df, {"d": "positive"}) is df


def test_sets(spark):
    a, b = table(spark, [(1, "x"), (2, "y")], "i int, s string"), table(spark, [("y", 2)], "s string, i int")
    assert rows(rel.union(a, b)) == [(1, "x"), (2, "y"), (2, "y")]
    assert rows(rel.intersect(a, b)) == [(2, "y")] and rows(rel.except_(a, b)) == [(1, "x")]
    with pytest.raises(ValueError):
        rel.union(a, b.drop("s"))
    with pytest.raises(ValueError):
        rel.union(a, b.withColumn("i", b.i.cast("long")))


def test_asof_and_range(spark):
    left = table(spark, [("a", 5), ("a", 1), ("b", 9), (None, 3)], "k string, t int")
    right = table(spark, [("a", 2, "x"), ("a", 5, "y"), ("b", 1, "z")], "k string, u int, v string")
    assert rows(rel.asof_join(left, right, ["k"], "t", "u").select("k", "t", "v")) == sorted([("a", 1, None), ("a", 5, "y"), ("b", 9, "z"), (None, 3, None)], key=repr)
    assert ("b", 9, None) in rows(rel.asof_join(left, right, ["k"], "t", "u", 3).select("k", "t", "v"))
    bands = table(spark, [(0, 2, "low"), (2, 10, "high")], "lo int, hi int, name string")
    assert rows(rel.range_join(left.where("k = 'a'"), bands, "t", "lo", "hi", 3).select("t", "name")) == [(1, "low"), (5, "high")]


def test_functions(spark):
    df = table(spark, [(1,), (2,)], "v long")

    def twice(columns):
        return [2 * x for x in columns["v"]]

    node = n.udf(n.dataframe(df), twice)
    assert node.mode == "column" and node.output == "twice"
    out = lower(node, Context(spark)).df
    assert rows(out) == [(1, 2), (2, 4)] and out.schema["twice"].dataType == T.LongType()
    empty = lower(n.udf(n.dataframe(df.where("false")), lambda row: row["v"] + 1, returns="long"), Context(spark)).df
    assert empty.columns == ["v", "result"] and empty.count() == 0

    def bad(row):
        raise KeyError("x")

    with pytest.raises(FunctionFailed):
        Service(spark).run(n.udf(n.dataframe(df), bad))


# types, schemas, tags ---------------------------------------------------------


def test_types():
    byte, short, integer, long, double = T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType()
    assert types_.widen(byte, integer) == integer and types_.common_type(integer, double) == double
    assert types_.common_type(integer, T.StringType()) == T.StringType() and types_.common_type(T.NullType(), short) == short
    assert types_.lossy(long, integer) and not types_.lossy(integer, long)
    assert types_.lossy(double, integer) == "truncates fractions" and not types_.lossy(integer, double)
    assert types_.lossy(T.StringType(), integer) and not types_.lossy(integer, T.StringType())
    assert types_.lossy(T.ArrayType(long), T.ArrayType(short))
    assert types_.from_source("PostgreSQL", "numeric(12,2)") == "decimal(12,2)"
    for system, name in (("oracle", "x"), ("sqlite", "geometry"), ("postgresql", "numeric(50,2)")):
        with pytest.raises(UnmappableType):
            types_.from_source(system, name)


def test_schema_and_drift():
    s = Schema((Field("a", T.IntegerType(), False), Field("b", T.StringType(), tags=frozenset({"PII"}))))
    assert s["b"].sensitivity == "CONFIDENTIAL" and s.rename({"b": "c"})["c"].tags == {"PII"}
    d = SchemaDiff.between(s, Schema((Field("a", T.LongType()), Field("z", T.StringType()))))
    assert d and d.added == ("z",) and d.removed == ("b",) and d.retyped[0][0] == "a" and d.nullability
    assert not SchemaDiff.between(s, s)
    with pytest.raises(ValueError):
        Schema((Field("a", T.IntegerType()), Field("a", T.IntegerType())))
    with pytest.raises(ValueError):
        s.tagged(["a"], [])
    with pytest.raises(UnknownColumn):
        s.tagged(["q"], ["PII"])
    with pytest.raises(ValueError):
        s["b"].declassified(" ")


@pytest.fixture
def payroll(spark):
    df = table(spark, [("NA", 100, "1"), ("EU", 200, "2"), ("NA", 300, "3")], "region string, salary long, ssn string")
    return n.classify(n.classify(n.dataframe(df, "payroll"), "salary", tags=["confidential"]), "ssn", tags=["PII"])


def test_tags_travel(spark, payroll):
    tags = lambda node: lower(node, Context(spark)).tags
    kept = n.limit(n.sort(n.filter_(payroll, col("salary") > 0), "salary"), 2)
    assert tags(kept)["salary"] == {"CONFIDENTIAL"}
    g = tags(n.group_by(payroll, "region", aggs={"s": sum_("salary"), "n": count(), "c": count("ssn")}))
    assert g == {"region": frozenset(), "s": {"CONFIDENTIAL"}, "n": frozenset(), "c": {"PII"}}
    assert tags(n.project(payroll, x=col("salary") + lit(1)))["x"] == {"CONFIDENTIAL"}
    assert tags(n.udf(payroll, lambda row: 1, returns="int"))["result"] == {"CONFIDENTIAL", "PII"}
    w = tags(n.window(payroll, WindowFunction("r", "rank", ("region",), (("salary", True),))))
    assert w["r"] == {"CONFIDENTIAL"}
    clean = n.project(payroll, "region", salary=col("region"), ssn=col("region"))
    same = n.project(payroll, "region", salary=col("salary").cast("string"), ssn=col("ssn"))
    assert tags(n.union(clean, same))["ssn"] == {"PII"}
    assert tags(n.declassify(payroll, "ssn", justification="sample data"))["ssn"] == frozenset()


# governance -------------------------------------------------------------------

EMPLOYEES = [("EU", 100.0), ("NA", 200.0), ("EU", 300.0), ("APAC", 400.0), ("NA", 500.0)]


def test_row_rules_come_before_aggregates(spark):
    plan = n.aggregate(n.dataframe(table(spark, EMPLOYEES, "region string, salary double"), "staff"), {"m": mean("salary")})
    policy = Policy("p", rls=(RowRule("eu", "region = EU"), RowRule("eu", "salary = 100")))
    assert rows(Service(spark, policy).run(plan, Subject("x", ("eu",))).df) == [(100.0,)]
    assert rows(Service(spark, policy).run(plan).df) == [(300.0,)]
    everyone = Policy("p", rls=(RowRule("*", "region = 'EU'"),))
    assert rows(Service(spark, everyone).run(plan).df) == [(200.0,)]


def test_row_rules_are_exact_or_refused(spark):
    two = n.join(n.dataframe(table(spark, [(1,)], "k int"), "a"), n.dataframe(table(spark, [(1,)], "k int"), "b"), "k")
    for rule in (RowRule("*", "k = 1"), RowRule("*", "k = 1", "c")):
        with pytest.raises(PolicyDenied):
            rls.secure(two, Policy("p", rls=(rule,)))
    for text in ("", "k > 1", "k = 1 OR k = 2", "k == 1", "f(k) = 1", "k = NULL", "k = a b"):
        with pytest.raises(PolicyDenied):
            parse_row_predicate(text)
    assert parse_row_predicate("region = EU AND x = 1").sql() == "((\"region\" = 'EU') AND (\"x\" = 1))"
    assert parse_row_predicate("r = 'a and b' and y = true").sql() == "((\"r\" = 'a and b') AND (\"y\" = TRUE))"


def test_barriers_are_verified(spark):
    scan = n.dataframe(table(spark, [(1,)], "k int"), "a")
    policy = Policy("p", rls=(RowRule("*", "k = 1", "a"),))
    secured = rls.secure(n.sort(scan, "k"), policy)
    rls.verify(secured, policy)
    with pytest.raises(BarrierBroken):
        rls.verify(n.sort(scan, "k"), policy)
    moved = n.Barrier(n.sort(scan, "k"), parse_row_predicate("k = 1"), "k = 1")
    with pytest.raises(BarrierBroken):
        rls.verify(moved, policy)


def test_expressions_below_barriers_do_not_raise(spark):
    df = table(spark, [("EU", "7"), ("NA", "x")], "region string, v string")
    plan = n.filter_(n.dataframe(df, "d"), col("v").cast("int") > 1)
    assert rows(Service(spark, Policy("p", rls=(RowRule("*", "region = EU"),))).run(plan).df) == [("EU", "7")]


def test_columns_are_dropped_and_masked(spark, payroll):
    policy = Policy("p", mask_threshold="CONFIDENTIAL", cls_drop={"*": frozenset({"region"})}, cls_mask={"hr": {"ssn": "full"}})
    out = Service(spark, policy).run(payroll, Subject("x", ("hr",)))
    assert out.df.columns == ["salary", "ssn"] and rows(out.df) == [(0, None)] * 3
    assert out.schema["ssn"].tags == {"PII"}
    assert rows(Service(spark, policy).run(payroll).df) == [(0, "[redacted]")] * 3
    with pytest.raises(PolicyDenied):
        Service(spark, Policy("p", cls_drop={"*": frozenset({"region", "salary", "ssn"})})).run(payroll)


def test_masks(spark):
    import hashlib

    from tarnwell.governance.masks import masked

    df = table(spark, [("abcdef", 12345, "ann@x.org"), ("ab", None, "nobody"), (None, 1, None)], "s string, i int, e string")
    out = df.select(masked(df.s, "hash", T.StringType()), masked(df.i, "partial", T.IntegerType()), masked(df.e, "email", T.StringType()), masked(df.i, "redact", T.IntegerType()))
    got = [tuple(r) for r in out.collect()]
    assert got[0] == (hashlib.sha256(b"abcdef").hexdigest()[:12], "*2345", "a***@x.org", 0)
    assert got[1][1:] == (None, "**body", None) and got[2] == (None, "*", None, 0)
    with pytest.raises(PolicyDenied):
        masked(df.s, "rot13", T.StringType())


def test_egress(spark, payroll, tmp_path):
    assert sink_of("/a/b") == "local" and sink_of("file:///a") == "local" and sink_of("s3a://b/k") == "s3a" and sink_of("weird:x") == "weird"
    with pytest.raises(PrivacyViolation):
        Service(spark).run(n.write_parquet(payroll, "s3a://bucket/x"))
    some = Policy("p", allow_network=True, allow_network_kinds=frozenset({"s3a"}))
    with pytest.raises(PrivacyViolation):
        Service(spark, some).run(n.write_parquet(payroll, "s3a://bucket/x"))
    Service(spark).run(n.write_parquet(n.project(payroll, "region"), str(tmp_path / "out")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_small_groups(spark):
    data = [("north", x) for x in (10, 20, 30, 40, 50, 60)] + [("south", 100), ("south", 200)]
    plan = n.group_by(n.dataframe(table(spark, data, "region string, amount long"), "d"), "region", aggs={"m": mean("amount")})
    for k, expected in ((5, [("north", 35.0)]), (2, [("north", 35.0), ("south", 150.0)])):
        service = Service(spark, Policy("p", disclosure=(DisclosureRule(k),)))
        assert rows(service.run(plan).df) == expected
        found = [e for e in service.recorder.entries if e["event"] == "suppressed"]
        assert found[0]["details"] == {"k": k, "groups": 2, "suppressed": 2 - len(expected)}
    whole = n.aggregate(n.dataframe(table(spark, data[:3], "region string, amount long"), "d"), {"n": count()})
    assert rows(Service(spark, Policy("p", disclosure=(DisclosureRule(5),))).run(whole).df) == []
    with pytest.raises(ValueError):
        DisclosureRule(1)


def test_policy_files():
    policy = policy_from_dict({"name": "x", "rls": [{"role": "a", "predicate": "r = 1"}], "disclosure": [{"k": 3}], "cls_mask": {"a": {"c": "hash"}}})
    assert policy.rls[0].role == "a" and policy.least_group(Subject()) == 3
    for bad in ({"nmae": "x"}, {"rls": [{"role": "a", "predicate": "r = 1", "x": 1}]}, {"max_sensitivity": "HIGH"}, {"cls_mask": {"a": {"c": "rot13"}}}):
        with pytest.raises(PolicyDenied):
            policy_from_dict(bad)


def test_audit_chain(spark):
    service = Service(spark)
    service.run(n.dataframe(table(spark, [(1,)], "k int")))
    with pytest.raises(UnknownColumn):
        service.run(n.project(n.dataframe(table(spark, [(1,)], "k int")), "nope"))
    entries = service.recorder.entries
    assert [e["event"] for e in entries][-1] == "failed" and audit.verify(entries)
    changed = [dict(e) for e in entries]
    changed[1] = changed[1] | {"details": {"rules": ["x"]}}
    assert audit.first_break(changed) == 1 and audit.first_break(entries[1:]) == 0
    assert audit.view(entries, ["event:failed"])[0]["details"] == audit.REDACTED
    with pytest.raises(TypeError):
        audit.canonical({"x": 1.5})
    with pytest.raises(ValueError):
        audit.Recorder().add("party")


# sources, sinks, profile, files -------------------------------------------------


def read(spark, node):
    return lower(node, Context(spark)).df


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;note\n1;"two\nlines; ""quoted"""\n2;\n')
    assert rows(read(spark, n.csv(tmp_path / "a.csv", ";"))) == [(1, 'two\nlines; "quoted"'), (2, None)]
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}]')
    assert rows(read(spark, n.json(tmp_path / "a.json"))) == rows(read(spark, n.json(tmp_path / "b.json", array=True))) == [(1,), (2,)]
    with pytest.raises(SourceUnavailable):
        read(spark, n.parquet(tmp_path / "none.parquet"))
    data = n.const([{"a": 1, "b": "x"}, {"a": None, "b": "y"}], "a int, b string")
    out = n.write_csv(n.write_parquet(data, tmp_path / "p"), tmp_path / "c")
    assert rows(read(spark, out)) == rows(read(spark, n.parquet(tmp_path / "p"))) == rows(read(spark, n.csv(tmp_path / "c"))) == [(1, "x"), (None, "y")]
    lower(n.write_parquet(data, tmp_path / "p", "append"), Context(spark))
    assert read(spark, n.parquet(tmp_path / "p")).count() == 4
    with pytest.raises(UnknownColumn):
        read(spark, n.parquet(tmp_path / "p", columns=["z"]))
    import pyarrow as pa

    assert rows(read(spark, n.arrow(pa.table({"x": [1, 2]})))) == [(1,), (2,)]


def test_excel(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    data = n.const([(1, "a", 1.5), (2, None, 2.0)], "id long, name string, amount double")
    lower(n.write_excel(data, path, "Orders"), Context(spark))
    assert rows(read(spark, n.excel(path, "Orders"))) == [(1, "a", 1.5), (2, None, 2.0)]
    lower(n.write_excel(data, path, "Orders", "append"), Context(spark))
    assert read(spark, n.excel(path, cell_range="A1:C3")).count() == 2
    with pytest.raises(SourceUnavailable, match="Orders"):
        read(spark, n.excel(path, "Nope"))


def test_sqlite(spark, tmp_path):
    import sqlite3

    from tarnwell.sources.sql import build_select

    path = tmp_path / "d.db"
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "order" ("group" TEXT, n INTEGER, r REAL)')
        db.executemany('INSERT INTO "order" VALUES (?, ?, ?)', [("a", 1, 1.5), ("b", 2, None), (None, 3, 2.0)])
    p = and_(col("n") >= 2, col("group").is_not_null())
    assert rows(read(spark, n.sql(f"sqlite:{path}", table="order", columns=("group", "n"), predicate=p))) == [("b", 2)]
    assert rows(read(spark, n.sql(f"sqlite:{path}", query='SELECT n FROM "order"', limit=1))) == [(1,)]
    assert build_select("mysql", table="a`b", predicate=col("x") == "o'k")[0] == "SELECT * FROM `a``b` WHERE (`x` = 'o''k')"
    assert not build_select("sqlite", table="t", predicate=func("sha2", col("x"), 256) == "y")[1]
    for bad in (f"sqlite:{tmp_path}/none.db", "sqlite::memory:", "oracle:x"):
        with pytest.raises(SourceUnavailable):
            read(spark, n.sql(bad, table="t"))


def test_mongo_dump(spark, tmp_path):
    (tmp_path / "orders.json").write_text('{"_id": {"$oid": "a"}, "n": {"$numberLong": "5"}, "tags": ["x"]}\n{"_id": {"$oid": "b"}, "o": {"k": 1}}\n')
    got = {r["_id"]: r.asDict() for r in read(spark, n.mongo(tmp_path / "orders.json", "orders")).collect()}
    assert got["a"]["n"] == 5 and got["a"]["tags"] == '["x"]' and got["b"]["o"] == '{"k":1}' and got["b"]["n"] is None


def test_profiles(spark, tmp_path):
    from tarnwell import profile as p

    df = table(spark, [(1, "a"), (2, "bb"), (2, None)], "i int, s string")
    found = p.profile(df)
    assert found.rows == 3 and found["s"].nulls == 1 and found["i"].distinct == 2 and found["i"].selectivity() == 0.5
    df.write.parquet(str(tmp_path / "t"))
    assert p.profile_parquet(str(tmp_path / "t")).rows == 3 and p.profile_parquet(str(tmp_path / "t"))["s"].nulls == 1
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines"\n2,z\n')
    assert p.profile_csv(str(tmp_path / "x.csv")).rows == 2
    report = p.pushdown_report(spark.read.parquet(str(tmp_path / "t")).where("i > 1").select("i"))
    assert "GreaterThan(i,1)" in report["pushed_filters"][0] and report["read_schema"] == ["i:int"]
    log = p.EstimateLog()
    log.add("x", 50, 100)
    assert log.mean_error == 0.5


def test_pipeline_file_and_cli(spark, tmp_path, capsys):
    from tarnwell.cli import main

    path = tmp_path / "pipe.py"
    path.write_text("from tarnwell.plans.nodes import const, sort\n\ndef build():\n    return sort(const([(2,), (1,)], 'k int'), 'k')\n")
    assert [r.k for r in read(spark, n.load_pipeline(str(path))).collect()] == [1, 2]
    assert n.load_pipeline(str(path)).semantic_id() == n.load_pipeline(str(path)).semantic_id()
    assert main(["run", str(path), "--json"]) == 0 and '"k": 1' in capsys.readouterr().out
    assert main(["version"]) == 0 and main(["explain", str(tmp_path / "none.py")]) == 1


def test_streaming_equals_batch(spark, tmp_path):
    from tarnwell.streaming import events as s

    data = spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id * 7) AS ts, id % 3 AS user_id, id * 1.0D AS value FROM range(100)")
    data.write.parquet(str(tmp_path / "in"))
    batch = rows(s.tumbling(spark.read.parquet(str(tmp_path / "in")), "1 hour", ("user_id",), "value"))
    live = s.tumbling(s.read_stream(spark, str(tmp_path / "in"), data.schema), "1 hour", ("user_id",), "value", late="10 minutes")
    query = live.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("windows")) == batch


def test_plans_stay_native_and_pruned(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS v", "'x' AS s").write.parquet(str(tmp_path / "t"))
    plan = n.group_by(n.filter_(n.parquet(tmp_path / "t"), col("v") > 4), "s", aggs={"n": count()})
    text = read(spark, plan)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "GreaterThan(v,4)" in text and "id:" not in text.split("ReadSchema")[1]


def test_profiles_of_large_files(tmp_path, monkeypatch):
    from tarnwell import profile as p

    monkeypatch.setattr(p, "SAMPLE_BYTES", 3000)
    path = tmp_path / "x.csv"
    path.write_text("a,b\n" + "".join(f'{i},"two\nlines ""{i}"""\n' for i in range(2000)))
    found = p.profile_csv(str(path))
    assert not found.exact and found.provenance == "sampled" and abs(found.rows - 2000) < 100
    assert found["a"].type == "bigint" and found["b"].type == "string" and found["a"].least == 0
    path = tmp_path / "x.json"
    path.write_text("".join(f'{{"a": {i}, "b": null}}\n' for i in range(2000)))
    found = p.profile_json(str(path))
    assert abs(found.rows - 2000) < 50 and found["b"].distinct == 0
    with pytest.raises(SourceUnavailable):
        p.profile_csv(str(tmp_path / "none.csv"))


def test_workbooks_and_profiles_are_read_in_batches(spark, tmp_path, monkeypatch):
    import tracemalloc

    from tarnwell import profile as p
    from tarnwell.sources import excel

    monkeypatch.setattr(p, "BATCH_ROWS", 500)

    def most(rows: int) -> int:
        """Bytes held at most while a sheet of so many rows is written and profiled."""
        path = str(tmp_path / f"{rows}.xlsx")
        tracemalloc.start()
        excel.write_sheet(path, ["a", "b"], ((i, f"text {i:06}") for i in range(rows)))
        found = p.profile_excel(path)
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.rows == rows and (found["a"].type, found["a"].least, found["a"].most) == ("bigint", 0, rows - 1)
        assert (found["b"].distinct, found["b"].most, found["b"].mean_chars) == (rows, f"text {rows - 1:06}", 11)
        return held

    most(10)
    assert most(12_000) < 2 * most(3_000)
    # wider rows below have names as in the reader; a column's values of two types are text
    excel.write_sheet(str(tmp_path / "w.xlsx"), ["a", "b"], [(1, "x"), (None, None), (2.5, 7, True), (3, None, False)])
    found = p.profile_excel(str(tmp_path / "w.xlsx"))
    assert found.rows == 3 and [(c.name, c.type, c.nulls, c.distinct) for c in found.columns] == [("a", "double", 0, 3), ("b", "string", 1, 2), ("column_3", "boolean", 1, 2)]
    assert excel.read_sheet(str(tmp_path / "w.xlsx")) == (["a", "b", "column_3"], [(1.0, "x", None), (2.5, "7", True), (3.0, None, False)])


def test_profiled_sources_are_never_held_whole(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from tarnwell import semantics

    def refused(self, *args, **kwargs):
        raise AssertionError("all rows went to the driver")

    with monkeypatch.context() as m:
        for name in ("collect", "toPandas", "toArrow"):
            m.setattr(DataFrame, name, refused)
        found = semantics.profile_sources(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert rows(found) == sorted((k, n, True) for k in ("csv", "excel", "json", "parquet", "sqlite"))


def test_whole_profiles_do_not_depend_on_size(spark, tmp_path, monkeypatch):
    import json
    import sqlite3

    from tarnwell import profile as p
    from tarnwell import semantics

    text = "a,b\n" + "".join(f'{i},"two\nlines ""{i % 50}"""\n' if i % 3 else f"{i},\n" for i in range(2000))
    (tmp_path / "x.csv").write_text(text)
    (tmp_path / "x.json").write_text("".join(f'{{"a": {i}}}\n' if i < 1500 else f'{{"a": {i}, "late": "{i}"}}\n' for i in range(2000)))
    (tmp_path / "array.json").write_text(json.dumps([{"a": i} for i in range(2000)]))
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("CREATE TABLE t (a INTEGER)")
    db.executemany("INSERT INTO t VALUES (?)", [(i,) for i in range(2000)])
    db.execute("CREATE INDEX i ON t (a)")
    db.execute("ANALYZE")
    db.execute("INSERT INTO t VALUES (2000)")
    db.commit()
    db.close()
    made = lambda: [p.profile_csv(str(tmp_path / "x.csv"), whole=True), p.profile_json(str(tmp_path / "x.json"), whole=True), p.profile_json(str(tmp_path / "array.json"), whole=True), p.profile_sqlite(str(tmp_path / "x.db"), "t", whole=True)]
    small = made()
    for name, value in (("SAMPLE_BYTES", 3000), ("SAMPLE_ROWS", 10), ("BATCH_ROWS", 7)):
        monkeypatch.setattr(p, name, value)
    assert made() == small and all(f.exact for f in small) and [f.rows for f in small] == [2000, 2000, 2000, 2001]
    csv, lines, _, table_ = small
    assert (csv["a"].type, csv["a"].most, csv["a"].distinct) == ("bigint", 1999, 2000)
    assert (csv["b"].nulls, csv["b"].distinct, csv["b"].mean_chars) == (667, 50, sum(12 + len(str(i % 50)) for i in range(2000) if i % 3) / 1333)
    assert (lines["late"].nulls, lines["late"].type, lines["late"].least) == (1500, "bigint", 1500) and table_["a"].most == 2000
    monkeypatch.setattr(p, "KEPT_HASHES", 1000)
    assert abs(p.profile_csv(str(tmp_path / "x.csv"), whole=True)["a"].distinct - 2000) < 200
    assert all(r[2] for r in rows(semantics.profile_sources(spark, "/root/testdata/sf0.001")))


def test_csv_is_split_unless_fields_have_newlines(spark, tmp_path, monkeypatch):
    from tarnwell.sources import readers

    monkeypatch.setattr(readers, "SMALL_CSV", 10)
    (tmp_path / "plain.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "lines.csv").write_text('a,b\n1,"x\nz"\n2,y\n')
    assert not readers._has_quoted_newlines(spark, str(tmp_path / "plain.csv"))
    assert rows(lower(n.csv(str(tmp_path / "plain.csv")), Context(spark)).df) == [(1, "x"), (2, "y")]
    assert rows(lower(n.csv(str(tmp_path / "lines.csv")), Context(spark)).df) == [(1, "x\nz"), (2, "y")]


def test_large_sqlite_results_leave_in_parts(spark, tmp_path, monkeypatch):
    import sqlite3

    from tarnwell.sources import sql

    monkeypatch.setattr(sql, "BATCH_ROWS", 7)
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE t (a, b)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i if i < 30 else i + 0.5, None if i % 3 else "x") for i in range(40)])
    df = lower(n.sql(f"sqlite:{tmp_path}/x.db", table="t"), Context(spark)).df
    assert df.dtypes == [("a", "double"), ("b", "string")] and df.count() == 40
    assert df.where("b IS NULL").count() == 26


def test_jdbc_reads_in_ranges(spark):
    from tarnwell.sources import sql

    reader = sql.jdbc_reader(spark, "postgresql://h/d", 'SELECT "a" FROM "t"', ("a", 0, 100, 4))
    assert reader is not None
    assert "information_schema.columns" in sql.discovery("jdbc:mysql://h/d")


def test_caches_are_released(spark):
    data = n.cache(n.dataframe(spark.range(100).toDF("k"), "d"))
    with Service(spark).run(n.union(data, data)) as result:
        assert result.df.count() == 200 and result.context.cached
        kept = result.context.cached[0]
        assert kept.storageLevel.useMemory
    assert not result.context.cached and not kept.storageLevel.useMemory


def test_workbench(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from tarnwell.workbench import Workbench

    (tmp_path / "x.py").write_text("from tarnwell.plans.nodes import const, sort\n\ndef build():\n    return sort(const([(2,), (1,)], 'k int'), 'k')\n")
    with Workbench(Service(spark), str(tmp_path)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_address[1]}"

        def ask(path, body=None, kind="application/json"):
            data = None if body is None else json.dumps(body).encode()
            try:
                with urllib.request.urlopen(urllib.request.Request(base + path, data, {"Content-Type": kind})) as r:
                    return r.status, r.read()
            except urllib.error.HTTPError as e:
                return e.code, e.read()

        status, body = ask("/run", {"pipeline": "x.py"})
        assert status == 200 and json.loads(body)["rows"] == [{"k": 1}, {"k": 2}]
        assert ask("/explain", {"pipeline": "x.py"})[0] == 200 and ask("/")[0] == 200
        assert ask("/run", {"pipeline": "../x.py"})[0] == 400 and ask("/run", {"pipeline": "x.py"}, "text/plain")[0] == 415
        assert json.loads(ask("/health")[1])["verified"] and ask("/nothing")[0] == 404
        server.shutdown()
