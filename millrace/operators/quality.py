"""Row rules, check templates, type changes and other tests of data, each one pass over it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.text import clean_number, converts, spark_dialect
from millrace.plans.catalog import TableSpec, family, spark_type

# row rules


def violations(df: DataFrame, rules: dict[str, dict], key: str) -> DataFrame:
    """(key, column, rule) of the first rule that a row breaks, in the order given.

    Rules are ``min``, ``max``, ``pattern`` (from the start of the text) and ``enum``; the last two apply to texts. Nulls
    break none.
    """
    found = []
    for column, own in rules.items():
        text = isinstance(df.schema[column].dataType, StringType)
        tests = {"min": lambda c, v: c < v, "max": lambda c, v: c > v}
        if text:
            tests |= {"pattern": lambda c, v: ~c.rlike(f"^(?:{v})"), "enum": lambda c, v: ~c.isin(*v)}
        for rule, value in own.items():
            if rule in tests:
                found.append(F.when(tests[rule](F.col(column), value), F.struct(F.lit(column).alias("column"), F.lit(rule).alias("rule"))))
    first = F.coalesce(*found) if found else F.lit(None).cast("struct<column:string,rule:string>")
    return df.select(F.col(key), first.alias("broken")).where("broken is not null").select(key, "broken.column", "broken.rule")


# check templates: a comparison that several types share is written once; names are fixed values


def _positive(c: Column) -> Column:
    return c > 0


def _non_negative(c: Column) -> Column:
    return c >= 0


def _range(c: Column, min, max) -> Column:
    return c.between(min, max)


def _greater(c: Column, n) -> Column:
    return c > n


def _less(c: Column, n) -> Column:
    return c < n


def _enum(c: Column, values) -> Column:
    return c.isin(*values)


def _custom(c: Column, expression: str) -> Column:
    return F.expr(guarded(expression))


def _day(c: Column, text: str) -> Column:
    return F.to_date(F.lit(text))


def _moment(c: Column, text: str) -> Column:
    return F.to_timestamp(F.lit(text))


NUMBERS = {"positive": _positive, "non_negative": _non_negative, "range": _range, "greater": _greater, "less": _less}
TEMPLATES = {
    "INTEGER": {f"int_{k}": f for k, f in NUMBERS.items()} | {"int_enum": _enum, "int_bool_flag": lambda c: c.isin(0, 1), "int_id_positive": _positive},
    "REAL": {f"real_{k}": f for k, f in NUMBERS.items()} | {"real_ratio_0_1": lambda c: c.between(0, 1), "real_percent_0_100": lambda c: c.between(0, 100), "real_enum": _enum},
    "NUMERIC": {f"num_{k}": f for k, f in NUMBERS.items()},
    "TEXT": {
        "text_non_empty": lambda c: F.length(c) > 0,
        "text_not_blank": lambda c: c != "",
        "text_max_length": lambda c, max: F.length(c) <= max,
        "text_min_length": lambda c, min: F.length(c) >= min,
        "text_length_range": lambda c, min, max: F.length(c).between(min, max),
        "text_enum": _enum,
        "text_email_like": lambda c: c.like("%_@_%._%"),
        "text_phone_like": lambda c: c.like("1_________"),
        "text_upper_no_space": lambda c: ~c.contains(" "),
    },
    "DATE": {
        "date_not_future": lambda c: c <= F.current_date(),
        "date_not_past": lambda c: c >= F.current_date(),
        "date_after": lambda c, date: c >= _day(c, date),
        "date_before": lambda c, date: c <= _day(c, date),
        "date_range": lambda c, start, end: c.between(_day(c, start), _day(c, end)),
    },
    "DATETIME": {
        "dt_not_future": lambda c: c <= F.current_timestamp(),
        "dt_not_past": lambda c: c >= F.current_timestamp(),
        "dt_after": lambda c, dt: c >= _moment(c, dt),
        "dt_before": lambda c, dt: c <= _moment(c, dt),
        "dt_range": lambda c, start, end: c.between(_moment(c, start), _moment(c, end)),
    },
    "BLOB": {},
}
for own in TEMPLATES.values():
    own["custom"] = _custom
#: What a check expression may call, and its words.
CALLS = {"LENGTH", "CHAR_LENGTH", "DATE", "DATETIME", "NOW", "CURDATE", "ABS", "LOWER", "UPPER", "TRIM", "COALESCE", "ROUND", "CAST"}
WORDS = {"AND", "OR", "NOT", "IN", "LIKE", "BETWEEN", "IS", "NULL", "TRUE", "FALSE", "AS", "INT", "INTEGER", "DOUBLE", "STRING"}


def guarded(expression: str, columns: set[str] | None = None) -> str:
    """A check expression in Spark's spelling, if it only has columns, literals, operators and the allowed functions."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", expression)
    if re.search(r"--|/\*|;|`|\"", bare) or not re.fullmatch(r"[\w\s().,'<>=!+\-*/%]*", bare):
        raise ValueError("a check may not hold comments, quotes or several statements")
    for name, call in re.findall(r"([A-Za-z_]\w*)\s*(\()?", bare):
        upper = name.upper()
        if call and upper not in CALLS and upper not in WORDS:
            raise ValueError(f"{name} may not be called in a check")
        if not call and upper not in WORDS and upper not in CALLS and columns is not None and name not in columns:
            raise ValueError(f"no column {name}")
    return spark_dialect(expression)


def check(kind: str, template: str, column: str, **params) -> Column:
    """A template over a column; true, false, or null for nulls."""
    own = TEMPLATES[kind.upper()]
    if template not in own:
        raise ValueError(f"{kind} has no check {template!r}")
    return own[template](F.col(column), **params)


def failures(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n) rows that fail each check, in one pass."""
    row = df.agg(*[F.coalesce(F.sum(F.when(~c, 1)), F.lit(0)).alias(name) for name, c in checks.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("n")) for n in checks])).alias("x")).select("x.*")


# inserted values and type changes


def typed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Text columns cleaned and cast to their declared types, with the names of the columns that failed in ``bad``."""
    out, bad = [], []
    for c in df.columns:
        own = spec.column(c)
        if not own or not isinstance(df.schema[c].dataType, StringType):
            out.append(F.col(c))
            continue
        value = clean_number(F.col(c)) if family(own.type) in ("int", "float") else F.col(c)
        cast = value.try_cast(spark_type(own.type))
        out.append(cast.alias(c))
        bad.append(F.when(value.isNotNull() & cast.isNull() | (F.lit(own.not_null) & value.isNull()), F.lit(c)))
    return df.select(*out, F.array_compact(F.array(*bad) if bad else F.array().cast("array<string>")).alias("bad"))


@dataclass(frozen=True)
class Risk:
    level: str
    needs_force: bool = False
    needs_scan: bool = False


#: Changes of family that lose nothing, and those that lose a part.
SAFE = {("int", "float"), ("int", "text"), ("float", "text"), ("date", "datetime"), ("text", "blob"), ("blob", "text"), ("bool", "int"), ("int", "bool")}
PARTIAL = {("float", "int"), ("datetime", "date")}


def change_risk(old: str, new: str) -> Risk:
    """What may be lost when a column changes its type."""
    pair = family(old), family(new)
    if not old or not new or pair[0] == pair[1] or pair in SAFE:
        return Risk("safe")
    return Risk("warning" if pair in PARTIAL else "danger", True, True)


def compatibility(df: DataFrame, column: str, new_type: str, sample: int | None = None) -> DataFrame:
    """(n, n_ok, ok_rate, examples) of a column's non-null values as the new type; all of them, or a sample's."""
    text = df.select(F.col(column).cast("string").alias("v")).where("v is not null")
    text = (text.limit(sample) if sample else text).withColumn("ok", F.coalesce(converts(F.col("v"), new_type), F.lit(False)))
    counts = text.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))
    # each task keeps five examples of its own
    bad = text.where(~F.col("ok")).select(F.substring("v", 1, 50).alias("v")).distinct().orderBy("v").limit(5).agg(F.array_sort(F.collect_list("v")).alias("examples"))
    return counts.select("n", "n_ok", F.when(F.col("n") > 0, F.round(F.col("n_ok") / F.col("n"), 4)).otherwise(1.0).alias("ok_rate"), bad.scalar().alias("examples"))


def narrow_risk(old: str, new: str) -> bool:
    """Whether a precision gets smaller, which needs force."""
    numbers = lambda t: [int(x) for x in re.findall(r"\d+", t)] or [10**9]
    return any(b < a for a, b in zip(numbers(old), numbers(new), strict=False))


# signals about values, keys and texts


def unknown_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Those of the values that no row holds."""
    asked = df.sparkSession.createDataFrame([(v,) for v in values], df.select(column).schema)
    return asked.join(df.select(column).where(F.col(column).isNotNull()).distinct(), column, "left_anti").distinct()


def orphans(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """Rows whose key is set but has no parent; nulls among the parents change nothing."""
    parents = ref.select(F.col(ref_column).alias("__parent")).where("__parent is not null").distinct()
    return df.where(F.col(column).isNotNull()).join(parents, F.col(column) == F.col("__parent"), "left_anti")


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that several rows hold, with how many."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def data_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_lines, n_data): lines of a text, and those of two words or more with a digit."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    data = F.filter(lines, lambda x: x.rlike(r"\d") & (F.size(F.split(F.trim(x), r"\s+")) >= 2))
    return df.select(key, F.size(lines).alias("n_lines"), F.size(data).alias("n_data"))


def without_lines(df: DataFrame, text: str, values: str) -> DataFrame:
    """``df`` with ``text`` less the lines that hold any of the array ``values`` of two characters or more."""
    long = F.filter(values, lambda v: F.length(v) >= 2)
    kept = F.filter(F.split(F.col(text), "\n"), lambda x: ~F.exists(long, lambda v: F.contains(x, v)))
    return df.withColumn(text, F.array_join(kept, "\n"))
