"""Numbers as Spark columns: exact rounded rates, nearest ranks, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division of non-negative numbers."""
    return F.call_function("div", a, b)


def int_rate(part: Column, whole: Column, digits: int = 6, default: float | None = 0.0) -> Column:
    """part / whole rounded half up by integer arithmetic, the same in any engine; `default` where whole is 0."""
    a, b = part.cast("bigint"), whole.cast("bigint")
    safe = F.when(b > 0, b).otherwise(F.lit(1))
    rounded = int_div(2 * a * 10**digits + safe, 2 * safe) / F.lit(float(10**digits))
    return F.when(b > 0, rounded).otherwise(F.lit(default).cast("double"))


def nearest_rank(n: Column, share: float) -> Column:
    """The 1-based rank of a quantile among n values: (n - 1) * share rounded half to even, plus one."""
    return F.bround((n - 1) * F.lit(share), 0).cast("bigint") + 1


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts, rounded to four digits; 0.0 for none."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x)
    bits = F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, (x / total) * F.log2(x / total)).otherwise(0.0))
    return F.when(total > 0, F.round(bits, 4) + F.lit(0.0)).otherwise(F.lit(0.0))
