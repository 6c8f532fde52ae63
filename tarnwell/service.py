"""From a plan to a governed result: secure, verify, lower, record."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tarnwell.errors import PolicyDenied, translated
from tarnwell.governance import audit, rls
from tarnwell.governance.policy import ANONYMOUS, BASELINE, NETWORK_SINKS, Policy, Subject
from tarnwell.ledger import Ledger
from tarnwell.plans.lower import Context, Lowered, lower
from tarnwell.plans.nodes import Node
from tarnwell.profile import pushdown_report
from tarnwell.schema import Schema


#: What holds where a policy is switched off.
UNRESTRICTED = Policy("off", True, NETWORK_SINKS | {"network"}, "RESTRICTED", mask_threshold="NEVER")


@dataclass
class Result:
    """``df`` is what the subject may see; ``schema`` has its columns' tags."""

    df: DataFrame
    schema: Schema
    events: list[dict] = field(default_factory=list)
    context: Context | None = None
    ledger: Ledger = field(default_factory=Ledger)

    def release(self) -> None:
        """Free what the plan cached; call it when the result has been used."""
        if self.context:
            self.context.release()

    def __enter__(self) -> Result:
        return self

    def __exit__(self, *_) -> None:
        self.release()


@dataclass
class Service:
    spark: SparkSession
    policy: Policy = BASELINE
    recorder: audit.Recorder = field(default_factory=audit.Recorder)
    #: Off only for local debugging: no row rules, masks, egress checks or suppression.
    enforced: bool = True

    def prepare(self, plan: Node, subject: Subject = ANONYMOUS) -> Node:
        if not self.enforced:
            return plan
        secured = rls.secure(plan, self.policy, subject)
        rls.verify(secured, self.policy, subject)
        return secured

    def run(self, plan: Node, subject: Subject = ANONYMOUS, protect: bool = True) -> Result:
        """Carry out a plan; whatever happens is recorded."""
        start = len(self.recorder.entries)
        self.recorder.add("run_started", {"subject": subject.name, "roles": list(subject.roles), "policy": self.policy.name})
        policy = self.policy if self.enforced else UNRESTRICTED
        ledger = Ledger(sinks=(lambda d: self.recorder.add("degraded", {"kind": d.kind, "where": d.where, "severity": d.severity}),))
        context = Context(self.spark, policy, subject, self.recorder.add, ledger=ledger)
        try:
            self.recorder.add("policy_bound", {"policy": policy.name, "enforced": self.enforced})
            secured = self.prepare(plan, subject)
            if self.enforced:
                self.recorder.add("barriers_verified", {"rules": [r.predicate for r in self.policy.row_rules(subject)]})
            done = lower(secured, context)
            result = self._shown(done, subject) if protect and self.enforced else (done.df, done.schema)
            ledger.assert_clean()
            self.recorder.add("completed", {"columns": result[1].names})
            return Result(*result, self.recorder.entries[start:], context, ledger)
        except PolicyDenied as e:
            context.release()
            self.recorder.add("denied", {"kind": e.kind, "reason": str(e)})
            raise
        except Exception as e:
            context.release()
            ours = translated(e)
            self.recorder.add("failed", {"kind": getattr(ours, "kind", type(ours).__name__), "reason": str(ours)[:2000]})
            if ours is e:
                raise
            raise ours from e

    def _shown(self, done: Lowered, subject: Subject) -> tuple[DataFrame, Schema]:
        schema = done.schema
        if hidden := self.policy.column_actions(schema, subject):
            self.recorder.add("columns_restricted", {"columns": hidden})
        df = self.policy.protect(done.df, schema, subject)
        return df, Schema.of(df, {c: schema[c].tags for c in df.columns})

    def explain(self, plan: Node, subject: Subject = ANONYMOUS) -> str:
        """The secured plan, what is pushed into its scans, and Spark's own plan."""
        secured = self.prepare(plan, subject)
        df = lower(secured, Context(self.spark, self.policy, subject)).df
        report = pushdown_report(df)
        lines = [f"plan {secured.semantic_id()[:12]}: " + " > ".join(type(n).__name__ for n in secured.walk())]
        lines += [f"pushed filters: {x or '-'}" for x in report["pushed_filters"]]
        lines += [f"columns read: {x or '-'}" for x in report["read_schema"]]
        return "\n".join([*lines, df._jdf.queryExecution().toString()])
