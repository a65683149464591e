"""Grouped aggregates with conditions on groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.conditions import COMPARE, filtered
from millrace.plans.selection import aggregate, limited, ordered

RESULT = "agg_result"


@dataclass(frozen=True)
class Having:
    """One aggregate, which needn't be the selected one, compared with a number."""

    function: str
    column: str
    op: str
    value: float


def aggregated(df: DataFrame, function: str, column: str = "*", by: list[str] = (), conditions=None, having: Having | None = None, distinct: bool = False, names=None) -> DataFrame:
    """The keys, then ``agg_result``. Partial sums are built before the only shuffle. ``names`` gives columns their real names."""
    df = filtered(df, conditions, names=names)
    if names:
        column, by = column if column == "*" else names(column), [names(b) for b in by]
    exprs = [aggregate(function, column, distinct).alias(RESULT)]
    if having:
        exprs.append(aggregate(having.function, having.column).alias("__having"))
    out = df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)
    if having:
        out = out.where(COMPARE[having.op](F.col("__having"), F.lit(having.value))).drop("__having")
    return out


def several(df: DataFrame, wanted: list[dict], by: list[str] = (), conditions=None, order=None, limit: int | None = None) -> DataFrame:
    """Several aggregates ``{"field", "aggregate", "alias"}`` at once, ordered and limited after grouping."""
    df = filtered(df, conditions)
    exprs = [aggregate(w["aggregate"], w["field"], w.get("distinct", False)).alias(w["alias"]) for w in wanted]
    out = df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)
    out = ordered(out, order) if order else out
    return limited(out, limit) if limit else out
