"""SQL over the arrays of one row: running values, runs and groups in linear or near-linear time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: str, name: str, then: str) -> str:
    """``then`` with ``value`` evaluated once and bound to ``name``."""
    return f"transform(array({value}), {name} -> {then})[0]"


def once(columns: str) -> Column:
    """Columns (SQL of a struct's fields) that Spark evaluates once: no filter behind them is pushed before them."""
    return F.inline_outer(F.expr(f"array(struct({columns}))"))


def held(array: str) -> str:
    """The array as objects: ``slice`` unpacks the whole of one that a row holds packed, each time."""
    return f"transform({array}, h -> h)"


def running(array: str, merge: str = "x + y") -> str:
    """Values merged up to each place, itself included: ``y`` the earlier ones, ``x`` the place's own.
    Doubles the reach a step, so nothing is copied for each place."""
    step = "transform(a, (x, i) -> if(i >= shiftleft(1, j), transform(array(a[i - shiftleft(1, j)]), y -> MERGE)[0], x))".replace("MERGE", merge)
    return bound(array, "r0", f"if(size(r0) < 2, r0, aggregate(sequence(0, length(bin(size(r0) - 1)) - 1), r0, (a, j) -> {step}))")


def starts(array: str, new: str) -> str:
    """Places (from 0) where ``new`` holds of an element ``b.x`` and the one before it, ``b.y``; the first too."""
    test = new.replace("b.x", "s0[i]").replace("b.y", "s0[i - 1]")
    return bound(array, "s0", f"if(size(s0) = 0, cast(array() AS array<int>), filter(sequence(0, size(s0) - 1), i -> i = 0 OR {test}))")


def runs(array: str, new: str) -> str:
    """The array cut where ``new`` holds of ``b.x`` and the element before it, ``b.y``."""
    cut = "transform(c0, (p, k) -> slice(g0, p + 1, coalesce(get(c0, k + 1), size(g0)) - p))"
    return bound(array, "g0", bound(starts("g0", new), "c0", cut))
