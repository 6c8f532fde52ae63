"""A run's record as a hash chain: any change to an entry breaks every later one."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

#: The events that a record may hold.
EVENTS = frozenset(
    """run_started policy_loaded policy_bound policy_bind_failed plan_secured barriers_verified rows_restricted
    columns_restricted node_lowered lowered quality_passed declassified suppressed egress_attempted written denied
    failed degraded completed""".split()
)
START = "0" * 64
REDACTED = "[redacted]"


def canonical(value) -> str:
    """One text for equal values; floats are refused, since their text isn't stable."""

    def checked(v):
        if v is None or isinstance(v, (bool, int, str)):
            return v
        if isinstance(v, (list, tuple)):
            return [checked(x) for x in v]
        if isinstance(v, dict):
            return {str(k): checked(x) for k, x in v.items()}
        raise TypeError(f"a record can't hold a {type(v).__name__}")

    return json.dumps(checked(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def digest(previous: str, body: dict) -> str:
    return hashlib.sha256(f"{previous}\n{canonical(body)}".encode()).hexdigest()


@dataclass
class Recorder:
    """Entries in memory and, with a path, as JSON lines."""

    path: str | None = None
    entries: list[dict] = field(default_factory=list)
    clock: object = time.time_ns

    def add(self, event: str, details: dict | None = None) -> dict:
        if event not in EVENTS:
            raise ValueError(f"unknown event {event!r}")
        previous = self.entries[-1]["digest"] if self.entries else START
        body = {"n": len(self.entries), "at_ns": self.clock(), "event": event, "details": details or {}}
        entry = body | {"digest": digest(previous, body)}
        self.entries.append(entry)
        if self.path:
            with Path(self.path).open("a") as f:
                f.write(canonical(entry) + "\n")
        return entry


def first_break(entries: Iterable[dict]) -> int | None:
    """The first entry that doesn't follow from those before it, or None."""
    previous = START
    for k, entry in enumerate(entries):
        body = {x: v for x, v in entry.items() if x != "digest"}
        if entry.get("n") != k or digest(previous, body) != entry.get("digest"):
            return k
        previous = entry["digest"]
    return None


def verify(entries: Iterable[dict]) -> bool:
    return first_break(entries) is None


#: Details that count rows a subject may not see.
COUNTS = ("groups", "suppressed", "rows_before", "rows_after", "rows_removed")


def view(entries: Iterable[dict], capabilities: Iterable[str], subject: str | None = None) -> list[dict]:
    """The entries as someone with ``capabilities`` may see them.

    ``details`` shows them all but counts of hidden rows, which need ``counts``;
    ``event:<name>`` shows one kind's.  With ``subject`` runs of others are left
    out unless ``others`` is among the capabilities.  What may not be seen says
    so, which differs from what isn't there.
    """
    may, out, own = set(capabilities), [], True
    for e in entries:
        if e["event"] == "run_started":
            own = subject is None or "others" in may or e["details"].get("subject") == subject
        if not own:
            continue
        if "details" not in may and f"event:{e['event']}" not in may:
            out.append(e | {"details": REDACTED})
        elif "counts" not in may and isinstance(e["details"], dict):
            out.append(e | {"details": {k: REDACTED if k in COUNTS else v for k, v in e["details"].items()}})
        else:
            out.append(e)
    return out


def restriction(entries: Iterable[dict]) -> str:
    """Whether row rules governed a run: ``applied``, ``not_applicable``, ``not_evaluated`` (the
    policy was switched off) or ``unknown`` (the run ended before that was settled)."""
    seen = {e["event"]: e["details"] for e in entries}
    if seen.get("policy_bound", {}).get("enforced") is False:
        return "not_evaluated"
    if "barriers_verified" not in seen:
        return "unknown"
    return "applied" if seen["barriers_verified"].get("rules") else "not_applicable"
