"""Structured conditions and the Column they stand for.

A condition is ``{"field", "op", "value", "link"}``; lists are flat, AND binds before OR, and the first link counts
for nothing. Literals take the column's type where it holds them exactly, so the source can prune on them, and else a
wider one. Names may be resolved first, as by :meth:`TableSpec.resolve`.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType, NumericType, StringType

COMPARE = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
LISTS, RANGES, PATTERNS, NULLS = ("IN", "NOT IN"), ("BETWEEN", "NOT BETWEEN"), ("LIKE", "NOT LIKE"), ("IS NULL", "IS NOT NULL")
#: What separates the parts of one enumerated value.
SEPARATORS = re.compile("或|、|，|,")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str = "="
    value: object = None
    link: str = "AND"


def parsed(given):
    """Conditions or rows that come as JSON text."""
    if not isinstance(given, str):
        return given
    try:
        return json.loads(given) if given.strip() else []
    except json.JSONDecodeError as e:
        raise ValueError(f"no JSON: {e}") from e


def normalised(given: str | dict | Iterable[dict | Condition], split_values: bool = True) -> list[Condition]:
    """Conditions from any form, without those of empty value; equalities of one field and enumerations become IN."""
    given = parsed(given)
    if isinstance(given, dict):
        given = [{"field": f, "op": "IN" if isinstance(v, list | tuple) else "=", "value": v} for f, v in given.items()]
    out = []
    for x in given:
        c = x if isinstance(x, Condition) else Condition(x["field"], x.get("op", "="), x.get("value"), x.get("link") or "AND")
        op = " ".join(str(c.op).upper().split())
        value = [_bare(v) for v in c.value] if isinstance(c.value, list | tuple) else _bare(c.value)
        if op not in NULLS and (value is None or value == "" or value == []):
            continue
        if op not in (*COMPARE, *LISTS, *RANGES, *PATTERNS, *NULLS):
            raise ValueError(f"unknown operator {c.op!r}")
        if op == "=" and split_values and isinstance(value, str) and SEPARATORS.search(value):
            op, value = "IN", [v.strip() for v in SEPARATORS.split(value) if v.strip()]
        out.append(Condition(c.field, op, value, "OR" if str(c.link).upper() == "OR" else "AND"))
    return _merged(out)


def _bare(value: object) -> object:
    """Text without the blanks around it and one pair of quotes."""
    if isinstance(value, str):
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
    return value


def _merged(conditions: list[Condition]) -> list[Condition]:
    """Different equalities of one field, all linked by AND, become one IN: no row could meet them all."""
    if any(c.link == "OR" for c in conditions[1:]):
        return conditions
    values: dict[str, list] = {}
    for c in conditions:
        if c.op == "=":
            own = values.setdefault(c.field, [])
            if c.value not in own:
                own.append(c.value)
    out, done = [], set()
    for c in conditions:
        if c.op == "=" and len(values[c.field]) > 1:
            if c.field not in done:
                out.append(Condition(c.field, "IN", values[c.field], c.link))
                done.add(c.field)
        elif c not in out:
            out.append(c)
    return out


def _type_of(df: DataFrame, name: str) -> DataType:
    return df.select(name).schema[0].dataType


#: Bits of Spark's whole numbers.
BITS = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def _number(value: object, kind: NumericType) -> Column | None:
    try:
        number = Decimal(int(value)) if isinstance(value, int) else Decimal(str(value).strip())
    except InvalidOperation:
        return None
    if isinstance(kind, FloatType | DoubleType):
        return F.lit(float(number)).cast(kind)
    if not number.is_finite():
        return None  # only floating columns hold these
    if isinstance(kind, IntegralType) and number == number.to_integral_value() and abs(number) < 1 << BITS[kind.simpleString()]:
        return F.lit(int(number)).cast(kind)
    digits = number.as_tuple()
    wide = max(len(digits.digits), -digits.exponent, len(digits.digits) + digits.exponent) > 38
    return F.lit(float(number)) if wide else F.lit(number)


def _literal(df: DataFrame, value: object, kind: DataType) -> Column | None:
    """The value as a literal that compares with a column of this type; None if it can't be one."""
    if isinstance(kind, NumericType):
        return _number(value, kind)
    if isinstance(kind, StringType) or not isinstance(value, str):
        return F.lit(value).cast(kind)
    # dates, times and truth values are read as Spark does; this needs no job
    read = df.sparkSession.sql("SELECT 1").select(F.lit(value).try_cast(kind).isNull()).first()[0]
    return None if read else F.lit(value).cast(kind)


def _parts(value: object) -> list:
    return [_bare(v) for v in (value if isinstance(value, list | tuple) else str(value).split(","))]


def predicate(df: DataFrame, c: Condition, ignore_case: bool = False) -> Column:
    """One condition over ``df``. An equality with what the type can't hold is false, a range raises."""
    column, kind = F.col(c.field), _type_of(df, c.field)
    if c.op in NULLS:
        return column.isNull() if c.op == "IS NULL" else column.isNotNull()
    if c.op in PATTERNS:
        text = column.cast("string")
        found = text.ilike(str(c.value)) if ignore_case else text.like(str(c.value))
        return found if c.op == "LIKE" else ~found
    if c.op in LISTS:
        held = [x for x in (_literal(df, v, kind) for v in _parts(c.value)) if x is not None]
        found = column.isin(*held) if held else F.when(column.isNotNull(), F.lit(False))
        return found if c.op == "IN" else ~found
    if c.op in RANGES:
        ends = _parts(c.value)[:2]
        if len(ends) < 2:
            raise ValueError(f"{c.op} of {c.field} takes two values")
        low, high = [_literal(df, v, kind) for v in ends]
        if low is None or high is None:
            raise ValueError(f"{c.field} can't be compared with {c.value!r}")
        found = column.between(low, high)
        return found if c.op == "BETWEEN" else ~found
    value = _literal(df, c.value, kind)
    if value is None:
        if c.op not in ("=", "!=", "<>"):
            raise ValueError(f"{c.field} can't be compared with {c.value!r}")
        return F.when(column.isNotNull(), F.lit(c.op != "="))
    return COMPARE[c.op](column, value)


def folded(df: DataFrame, given: str | dict | Iterable[dict | Condition], split_values: bool = True, ignore_case: bool = False, names: Callable[[str], str] | None = None) -> Column | None:
    """All conditions as one Column, runs of AND joined by OR; None for no condition. ``names`` gives fields their real names."""
    runs: list[list[Column]] = []
    for i, c in enumerate(normalised(given, split_values)):
        if i == 0 or c.link == "OR":
            runs.append([])
        runs[-1].append(predicate(df, replace(c, field=names(c.field)) if names else c, ignore_case))
    if not runs:
        return None
    return reduce(operator.or_, [reduce(operator.and_, run) for run in runs])


def filtered(df: DataFrame, given: str | dict | Iterable[dict | Condition] | None, **options) -> DataFrame:
    found = folded(df, given or [], **options)
    return df if found is None else df.where(found)


def signals(df: DataFrame, given, total: int | None = None) -> list[dict]:
    """Facts that may explain a surprising result: values that aren't numbers on number columns, and no rows in spite of conditions."""
    checks = normalised(given or [])
    kinds = {f.name: f.dataType for f in df.schema}
    out = []
    for c in checks:
        if isinstance(kinds.get(c.field), NumericType) and c.op not in NULLS:
            bad = [v for v in (_parts(c.value) if c.op in LISTS + RANGES else [c.value]) if _number(v, kinds[c.field]) is None]
            out += [{"type": "type_mismatch", "field": c.field, "value": str(v), "field_type": kinds[c.field].simpleString()} for v in bad]
    if checks and total == 0:
        out.append({"type": "empty_with_condition", "conditions": len(checks)})
    return out
