"""Numbers that rank and size the works of a graph, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sizes of drawn works: fixed values.
LEAST_RADIUS, BASE_RADIUS, SPAN, MOST_RADIUS, UNKNOWN_RADIUS, UNIT = 3.0, 3.0, 17.0, 28.0, 2.0, 4.0


def round3(c: Column) -> Column:
    return F.round(c, 3)


def gap_score(cited_by: Column, known_globally: Column) -> Column:
    """Citations from held works, discounted by the logarithm of the citations anywhere, if known."""
    return F.when(known_globally.isNull(), cited_by.cast("double")).otherwise(cited_by / F.log10(F.lit(10.0) + F.greatest(F.lit(0), known_globally)))


def reference_count(counts: Column) -> Column:
    """Aggregate: of 20 and more known counts the one at 95 % of their order, else the largest; 1 at least, 1 for none."""
    ordered = F.array_sort(F.collect_list(counts))
    n = F.size(ordered)
    at = F.when(n >= 20, F.floor(F.lit(0.95) * (n - 1)).cast("int")).otherwise(n - 1)
    return F.greatest(F.lit(1), F.coalesce(F.when(n > 0, F.get(ordered, at)), F.lit(1)))


def global_radius(count: Column, reference: Column) -> Column:
    share = F.sqrt(F.greatest(count, F.lit(0)) / reference)
    share = F.when(share > 1, 1 + F.log10(share)).otherwise(share)
    return F.when(count.isNull(), F.lit(UNKNOWN_RADIUS)).otherwise(F.least(F.lit(MOST_RADIUS), F.lit(BASE_RADIUS) + F.lit(SPAN) * share))


def area(radius: Column) -> Column:
    return F.pow(radius / UNIT, F.lit(2.0))


def local_value(in_degree: Column) -> Column:
    return 1 + 2 * in_degree


def local_radius(in_degree: Column) -> Column:
    return UNIT * F.sqrt(local_value(in_degree))


def link_strength(pull: Column, deg_a: Column, deg_b: Column) -> Column:
    return pull / F.greatest(F.lit(1), F.least(deg_a, deg_b))


def year_position(year: Column, first: Column, last: Column) -> Column:
    """Where a year stands between the first (0) and the last (1) shown; the middle if they are one."""
    return F.when(last > first, (year - first) / (last - first)).otherwise(F.lit(0.5))


def mix(a: Column, b: Column, t: Column) -> Column:
    """The colour `t` of the way from `a` to `b`, both 0xRRGGBB."""
    part = lambda x, s: F.shiftright(x, s).bitwiseAND(F.lit(255))
    channel = lambda s: F.round(part(a, s) + (part(b, s) - part(a, s)) * t).cast("int")
    return F.shiftleft(channel(16), 16).bitwiseOR(F.shiftleft(channel(8), 8)).bitwiseOR(channel(0))


def nearest_rank(values: Column, p: float) -> Column:
    """Aggregate: the value at floor(p * n) of the ordered values."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(F.lit(p) * F.size(ordered)).cast("int")))
