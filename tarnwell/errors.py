"""What can go wrong, as one small hierarchy; Spark's own errors are mapped onto it."""

from __future__ import annotations


class TarnwellError(Exception):
    """Base of all errors of this library."""

    kind = "internal"


class SourceUnavailable(TarnwellError):
    kind = "source_unavailable"


class UnknownColumn(TarnwellError, KeyError):
    kind = "unknown_column"

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class UnmappableType(TarnwellError, TypeError):
    kind = "unmappable_type"


class CastFailed(TarnwellError, ValueError):
    kind = "cast_failed"


class QualityCheckFailed(TarnwellError):
    kind = "quality_failed"

    def __init__(self, failures: list[str]):
        super().__init__("; ".join(failures))
        self.failures = failures


class PolicyDenied(TarnwellError):
    kind = "policy_denied"


class PrivacyViolation(PolicyDenied):
    kind = "privacy_violation"


class BarrierBroken(PolicyDenied):
    kind = "barrier_broken"


class FunctionFailed(TarnwellError):
    kind = "function_failed"


#: Spark error classes (by prefix) and the errors they stand for here.
_BY_CONDITION = (
    ("PATH_NOT_FOUND", SourceUnavailable),
    ("UNABLE_TO_INFER_SCHEMA", SourceUnavailable),
    ("UNRESOLVED_COLUMN", UnknownColumn),
    ("CAST_", CastFailed),
    ("USER_RAISED_EXCEPTION", CastFailed),
    ("NUMERIC_VALUE_OUT_OF_RANGE", CastFailed),
    ("UNSUPPORTED_", UnmappableType),
)


def translated(error: Exception) -> Exception:
    """The library's error for one of Spark's, or the error itself."""
    if isinstance(error, TarnwellError):
        return error
    text = str(error)
    if type(error).__name__ == "PythonException" or "PythonException" in text[:200]:
        return FunctionFailed(text)
    condition = getattr(error, "getCondition", lambda: None)() or ""
    for prefix, ours in _BY_CONDITION:
        if condition.startswith(prefix) or f"[{prefix}" in text:
            return ours(text.splitlines()[0])
    return error
