"""How classification tags travel: computed from the plan, at no cost in data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from tarnwell.plans.expr import Agg, Expr

Tags = dict[str, frozenset[str]]


def of_expression(e: Expr, tags: Mapping[str, frozenset[str]]) -> frozenset[str]:
    return everything({n: tags.get(n, frozenset()) for n in e.names()})


def everything(tags: Mapping[str, frozenset[str]]) -> frozenset[str]:
    return frozenset().union(*tags.values())


def of_aggregate(a: Agg, tags: Mapping[str, frozenset[str]]) -> frozenset[str]:
    """COUNT(*) is clean; any other aggregate has what its argument has."""
    got = of_expression(a.arg, tags) if a.arg is not None else frozenset()
    return got | everything({n: tags.get(n, frozenset()) for n in a.order_by})


def of_join(left: Tags, right: Tags, columns: Iterable[str]) -> Tags:
    """Which rows meet tells about both sides: every column has all tags."""
    both = everything(left) | everything(right)
    return {c: both for c in columns}


def of_union(sides: Iterable[Tags]) -> Tags:
    out: Tags = {}
    for side in sides:
        for n, t in side.items():
            out[n] = out.get(n, frozenset()) | t
    return out
