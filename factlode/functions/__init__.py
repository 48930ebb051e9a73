"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r2(x: Column) -> Column:
    """Two decimals, half away from zero; the same in every engine, unlike round() on doubles."""
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def r2_sql(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 100 + 0.5) / 100)"


def ratio(num: Column, den: Column, times: float = 1.0, at_zero: float | None = 0.0) -> Column:
    """num / den * times, with a fixed result for a zero denominator."""
    return F.when(den == 0, F.lit(at_zero).cast("double")).otherwise(r2(num / den * times))


def ratio_sql(num: str, den: str, times: float = 1.0, at_zero: float | None = 0.0) -> str:
    zero = "CAST(NULL AS DOUBLE)" if at_zero is None else f"CAST({at_zero} AS DOUBLE)"
    return f"(CASE WHEN {den} = 0 THEN {zero} ELSE {r2_sql(f'(({num}) / ({den}) * {times}e0)')} END)"


def contains(text: Column, part: Column) -> Column:
    return F.contains(text, part)
