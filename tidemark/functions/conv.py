"""Conventions that change answers: missing values, quantiles, rounding, angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    """NaN compares as the largest number in Spark, so it must not reach a predicate."""
    return F.when(~F.isnan(x), x)


def sentinel_to_null(x: Column, *values: int) -> Column:
    return F.when(~x.isin(*values), x)


def floor_quantile(x: Column, q: float) -> Column:
    """Aggregate: the member at floor(q * n) of the sorted values, at most the last one."""
    a = F.array_sort(F.collect_list(x))
    return F.when(F.size(a) > 0, F.element_at(a, F.least(F.size(a), F.floor(F.lit(q) * F.size(a)) + 1).cast("int")))


def upper_median(x: Column) -> Column:
    return floor_quantile(x, 0.5)


def linear_quantile(x: Column, q: float) -> Column:
    return F.percentile(x, F.lit(q))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def floor_div(a: Column, n: int) -> Column:
    """Towards minus infinity, which neither div nor // of the engines does."""
    return F.floor(a / F.lit(float(n))).cast("long")


def wrap_pi(x: Column) -> Column:
    """An angle in (-pi, pi]."""
    return F.lit(math.pi) - F.pmod(F.lit(math.pi) - x, F.lit(2 * math.pi))


def wrap_pi_low(x: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def code_name(code: Column, names: dict[int, str]) -> Column:
    """Name of a code, or code_<n> for one that has none."""
    table = F.create_map(*(F.lit(v) for kv in names.items() for v in kv))
    return F.coalesce(F.try_element_at(table, code), F.concat(F.lit("code_"), code.cast("string")))


def rate_hz(t_us: Column) -> Column:
    """Aggregate: events a second between the first and the last; 0 for less than two or no span."""
    span = (F.max(t_us) - F.min(t_us)) / 1e6
    return F.coalesce((F.count(t_us) - 1) / F.nullif(span, F.lit(0.0)), F.lit(0.0))


def first_match(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Name of the first rule that holds; a rule that is null does not."""
    out = F
    for rule, name in rules:
        out = out.when(rule, name)
    return out.otherwise(otherwise)
