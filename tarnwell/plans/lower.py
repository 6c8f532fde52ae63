"""From a logical plan to one lazy DataFrame and the tags of its columns.

Shared nodes are lowered once.  Nothing runs but what has to before the plan is
known to be right: quality gates, and the writes that the plan asks for.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark import StorageLevel

from tarnwell.functions import udf as udfs
from tarnwell.governance import disclosure, rls, tags as tagging
from tarnwell.governance.policy import ANONYMOUS, BASELINE, Policy, Subject
from tarnwell.ledger import Ledger
from tarnwell.operators import relational as rel
from tarnwell.operators.windows import with_windows
from tarnwell.plans import nodes as n
from tarnwell.plans.expr import Agg, Binary
from tarnwell.schema import Schema
from tarnwell.sources import readers, writers


@dataclass
class Context:
    spark: SparkSession
    policy: Policy = BASELINE
    subject: Subject = ANONYMOUS
    #: Called with (event, details) as the plan is carried out.
    on_event: object = None
    #: What went less well than it should.
    ledger: Ledger = field(default_factory=Ledger)
    #: What :meth:`release` frees once the result has been used.
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Free what the plan keeps in memory or on disk; its results can still be computed, anew."""
        while self.cached:
            self.cached.pop().unpersist()

    def say(self, event: str, **details) -> None:
        if self.on_event:
            self.on_event(event, details)


@dataclass(frozen=True)
class Lowered:
    df: DataFrame
    tags: tagging.Tags
    #: Below a barrier user expressions must not raise: they might meet hidden rows.
    guarded: bool = False

    @property
    def schema(self) -> Schema:
        return Schema.of(self.df, {c: self.tags.get(c, frozenset()) for c in self.df.columns})


def pushed(plan: n.Node, ledger: Ledger | None = None) -> n.Node:
    """The plan with predicates directly above SQL scans inside these, unless a limit comes first there.

    Nothing goes through a barrier: a database might evaluate it on hidden rows.
    """
    uses = Counter(id(i) for node in plan.walk() for i in node.inputs)
    change: dict[int, n.Node] = {}
    for node in plan.walk():
        if not (isinstance(node, n.Filter) and isinstance(node.input, n.Scan) and node.input.kind == "sql"):
            continue
        options = dict(node.input.options)
        if uses[id(node.input)] > 1 or options.get("limit") is not None:
            continue
        try:
            node.predicate.sql()
        except ValueError as e:
            if ledger is not None:
                ledger.record("PREDICATE_NOT_PUSHED", node.input.scope, str(e))
            continue
        old = options.get("predicate")
        options["predicate"] = node.predicate if old is None else Binary("AND", old, node.predicate)
        change[id(node)] = replace(node, input=replace(node.input, options=tuple(options.items())))
    return rls.rewired(plan, change) if change else plan


def lower(plan: n.Node, context: Context) -> Lowered:
    plan = pushed(plan, context.ledger)
    done: dict[int, Lowered] = {}
    for node in plan.walk():
        out = done[id(node)] = _lower(node, [done[id(i)] for i in node.inputs], context)
        context.say("node_lowered", node=type(node).__name__, columns=out.df.columns)
    return done[id(plan)]


def _kept(tags: tagging.Tags, df: DataFrame) -> tagging.Tags:
    return {c: tags.get(c, frozenset()) for c in df.columns}


def _lower(node: n.Node, ins: list[Lowered], context: Context) -> Lowered:
    a = ins[0] if ins else None
    safe = any(i.guarded for i in ins)
    match node:
        case n.Scan():
            df = readers.read(context.spark, node)
            return Lowered(df, {f.name: f.tags for f in Schema.of(df).fields})
        case n.Barrier():
            context.say("rows_restricted", rule=node.rule)
            return Lowered(rel.filter_(a.df, rls.retyped(node.predicate, a.df), safe=True), a.tags, True)
        case n.Filter():
            return Lowered(rel.filter_(a.df, node.predicate, safe), a.tags, safe)
        case n.Project():
            expressions = dict(node.expressions)
            df = rel.project(a.df, node.columns, expressions, safe)
            tags = {c: a.tags.get(c, frozenset()) for c in node.columns}
            tags |= {c: tagging.of_expression(e, a.tags) for c, e in expressions.items()}
            return Lowered(df, tags, safe)
        case n.Join():
            b = ins[1]
            df = rel.join(a.df, b.df, dict(node.on), node.how)
            return Lowered(df, tagging.of_join(a.tags, b.tags, df.columns), safe)
        case n.AsOf():
            b = ins[1]
            df = rel.asof_join(a.df, b.df, node.by, node.left_time, node.right_time, node.tolerance, node.slice_width)
            return Lowered(df, tagging.of_join(a.tags, b.tags, df.columns), safe)
        case n.Group():
            return _group(node, a, context)
        case n.Windowed():
            k = context.policy.least_group(context.subject)
            guarded = [w.output for w in node.functions if isinstance(w.func, Agg)] if k is not None else []
            if guarded:
                context.say("suppressed", k=k, windows=guarded)
            df = with_windows(a.df, list(node.functions), k)
            tags = dict(a.tags)
            for w in node.functions:
                own = tagging.of_aggregate(w.func, a.tags) if isinstance(w.func, Agg) else a.tags.get(w.arg or "", frozenset())
                for c in (*w.partition_by, *[c for c, _ in w.order_by]):
                    own = own | a.tags.get(c, frozenset())
                tags[w.output] = own
            return Lowered(df, tags, safe)
        case n.Sort():
            return Lowered(rel.sort(a.df, *node.keys), a.tags, safe)
        case n.Limit():
            return Lowered(rel.limit(a.df, node.n), a.tags, safe)
        case n.Union():
            return Lowered(rel.union(*[i.df for i in ins]), tagging.of_union([i.tags for i in ins]), safe)
        case n.SetOperation():
            both = rel.intersect if node.kind == "intersect" else rel.except_
            return Lowered(both(a.df, ins[1].df, node.all_rows), tagging.of_union([a.tags, ins[1].tags]), safe)
        case n.Deduplicate():
            return Lowered(rel.deduplicate(a.df, node.keys, node.keep, node.order_by), a.tags, safe)
        case n.CastSafe():
            return Lowered(rel.cast_safe(a.df, dict(node.types)), a.tags, safe)
        case n.HandleNulls():
            return Lowered(rel.handle_nulls(a.df, node.strategy, node.columns, node.value), a.tags, safe)
        case n.QualityCheck():
            df = rel.quality_check(a.df, dict(node.rules))
            context.say("quality_passed", rules=len(node.rules))
            return Lowered(df, a.tags, safe)
        case n.Classify():
            schema = a.schema.tagged(node.columns, node.tags, dict(node.descriptions))
            return Lowered(schema.mirror(a.df), {f.name: f.tags for f in schema.fields}, safe)
        case n.Declassify():
            for c in node.columns:
                a.schema[c].declassified(node.justification)
            context.say("declassified", columns=list(node.columns), justification=node.justification)
            tags = {c: frozenset() if c in node.columns else t for c, t in a.tags.items()}
            return Lowered(_without_metadata(a.df, node.columns), tags, safe)
        case n.Function():
            df = udfs.apply(a.df, node.function, node.output, node.mode, node.returns, node.whole)
            return Lowered(df, {**_kept(a.tags, df), node.output: tagging.everything(a.tags)}, safe)
        case n.TableFunction():
            df = udfs.apply_table(a.df, node.function, node.returns, node.keep)
            every = tagging.everything(a.tags)
            return Lowered(df, {c: a.tags.get(c, frozenset()) if c in node.keep else every for c in df.columns}, safe)
        case n.GroupingSets():
            df = rel.grouping_sets(a.df, node.keys, dict(node.aggs), node.kind, node.sets, context.policy.least_group(context.subject))
            tags = {c: a.tags.get(c, frozenset()) for c in node.keys} | {c: tagging.of_aggregate(x, a.tags) for c, x in node.aggs}
            return Lowered(df, tags | {"grouping_id": frozenset()}, safe)
        case n.Cache():
            df = a.df.persist(StorageLevel.MEMORY_AND_DISK)
            context.cached.append(df)
            return Lowered(df, a.tags, safe)
        case n.Write():
            schema = a.schema
            context.say("egress_attempted", target=node.path, sensitivity=schema.sensitivity)
            context.policy.check_egress(node.path, schema)
            allowed = rls.written_rows(a.df, node, context.policy, context.subject)
            out = context.policy.protect(allowed, schema, context.subject)
            if hidden := context.policy.column_actions(schema, context.subject):
                context.say("columns_restricted", columns=hidden)
            writers.write(out, node.kind, node.path, node.mode, dict(node.options))
            context.say("written", kind=node.kind, target=node.path, columns=out.columns)
            return Lowered(out, _kept(a.tags, out), safe)
    raise TypeError(f"unknown node {type(node).__name__}")


def _without_metadata(df: DataFrame, columns) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{c}`").alias(c, metadata={}) if c in columns else F.col(f"`{c}`") for c in df.columns])


def _group(node: n.Group, a: Lowered, context: Context) -> Lowered:
    aggs = dict(node.aggs)
    tags = {c: a.tags.get(c, frozenset()) for c in node.keys} | {c: tagging.of_aggregate(x, a.tags) for c, x in aggs.items()}
    k = context.policy.least_group(context.subject) if aggs else None
    if k is not None:
        counted = disclosure.guarded(a.df, node.keys, aggs, k).persist(StorageLevel.MEMORY_AND_DISK)
        context.cached.append(counted)
        found = disclosure.evidence(counted, k)
        context.say("suppressed", k=k, groups=found.groups, suppressed=found.suppressed)
        return Lowered(disclosure.shown(counted, k), tags, a.guarded)
    df = rel.aggregate(a.df, aggs) if node.whole else rel.group_by(a.df, node.keys, aggs)
    return Lowered(df, tags, a.guarded)
