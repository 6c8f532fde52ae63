"""What went less well than it should: nothing degrades in silence, and nothing that blocks counts as success."""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass, field

from tarnwell.errors import TarnwellError

# Kinds of failure and how grave each is.
INFO, DEGRADED, BLOCKING = "info", "degraded", "blocking"
KINDS = {
    "SCHEMA_DRIFT": DEGRADED,
    "TYPE_MISMATCH": BLOCKING,
    "NETWORK_PARTITION": BLOCKING,
    "SOURCE_UNAVAILABLE": BLOCKING,
    "CARDINALITY_ERROR": INFO,
    "EXCEL_FORMAT_CHANGE": DEGRADED,
    "EXCEL_FORMULA_ERROR": DEGRADED,
    "UDF_FAILURE": BLOCKING,
    "ARROW_IPC_FAILURE": DEGRADED,
    "WORKER_FAILURE": DEGRADED,
    "MEMORY_SPILL": INFO,
    "CACHE_INVALIDATED": INFO,
    "CONCURRENT_ACCESS": DEGRADED,
    "QUALITY_FAILURE": BLOCKING,
    "PRIVACY_VIOLATION": BLOCKING,
    "ENGINE_ABSENT": DEGRADED,
    "NO_FEASIBLE_PLAN": BLOCKING,
    "PREDICATE_NOT_PUSHED": INFO,
}

#: The kinds that errors of this library stand for.
OF_ERROR = {
    "source_unavailable": "SOURCE_UNAVAILABLE",
    "unknown_column": "SCHEMA_DRIFT",
    "unmappable_type": "TYPE_MISMATCH",
    "cast_failed": "TYPE_MISMATCH",
    "quality_failed": "QUALITY_FAILURE",
    "policy_denied": "PRIVACY_VIOLATION",
    "privacy_violation": "PRIVACY_VIOLATION",
    "barrier_broken": "PRIVACY_VIOLATION",
    "function_failed": "UDF_FAILURE",
}


@dataclass(frozen=True)
class Degradation:
    kind: str
    where: str
    detail: str
    severity: str
    at_ns: int

    def __str__(self) -> str:
        return f"{self.kind} ({self.severity}) at {self.where}: {self.detail}"


@dataclass
class Ledger:
    """A run's entries, only ever added to; ``sinks`` are told of each, and a broken sink hides none."""

    entries: list[Degradation] = field(default_factory=list)
    sinks: tuple = ()

    def record(self, kind: str, where: str, detail: str = "") -> Degradation:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of failure {kind!r}")
        entry = Degradation(kind, where, detail, KINDS[kind], time.time_ns())
        self.entries.append(entry)
        for sink in self.sinks:
            try:
                sink(entry)
            except Exception:  # noqa: BLE001, S112
                continue
        return entry

    def failed(self, error: Exception, where: str) -> Degradation:
        """An entry for an error, by its kind; an unknown one is a worker's failure."""
        return self.record(OF_ERROR.get(getattr(error, "kind", ""), "WORKER_FAILURE"), where, str(error)[:500])

    @property
    def blocking(self) -> list[Degradation]:
        return [e for e in self.entries if e.severity == BLOCKING]

    def counts(self) -> dict[str, int]:
        return dict(Counter(e.kind for e in self.entries))

    def assert_clean(self) -> None:
        """Raise if anything that blocks was recorded: such a run is no success."""
        if self.blocking:
            raise TarnwellError("; ".join(map(str, self.blocking)))

    def __str__(self) -> str:
        return "\n".join(map(str, self.entries)) or "nothing degraded"
