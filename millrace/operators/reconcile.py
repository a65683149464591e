"""Differences between sets of names or ids, and checks of what a write did."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct keys that one side lacks, with ``side`` saying which has them; nulls equal nulls."""
    a, b = left.select(*columns).distinct(), right.select(*columns).distinct()
    marked = a.withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0)).unionByName(b.withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1)))
    # one shuffle serves both directions
    both = marked.groupBy(*columns).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r")).where("__l <> __r")
    return both.select(*columns, F.when(F.col("__l") == 1, "left").otherwise("right").alias("side"))


def presence(sides: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Distinct keys of any number of sides (up to 63), with ``has`` and ``lacks``: names of the sides, in their order.

    Each side is a bit, and one shuffle brings the bits of a key together; nulls equal nulls.
    """
    if not 0 < len(sides) < 64:
        raise ValueError("one to 63 sides are compared")
    marked = [df.select(*columns).withColumn("__bit", F.lit(1 << i).cast("long")) for i, df in enumerate(sides.values())]
    bits = reduce(DataFrame.unionByName, marked).groupBy(*columns).agg(F.bit_or("__bit").alias("__bits"))
    told = lambda yes: F.array_compact(F.array(*[F.when((F.col("__bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0) == yes, F.lit(n)) for i, n in enumerate(sides)]))
    return bits.select(*columns, told(True).alias("has"), told(False).alias("lacks"))


def union_of_names(frames: list[DataFrame], column: str) -> DataFrame:
    return reduce(DataFrame.union, [f.select(column) for f in frames]).distinct().orderBy(column)


def common_columns(old: DataFrame, new: list[str]) -> DataFrame:
    """What of a table a rebuild under new columns keeps."""
    return old.select(*[c for c in old.columns if c in set(new)])


def absent(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of ``df`` whose key ``other`` lacks."""
    return df.join(other.select(F.col(right).alias("__key")).distinct(), F.col(left) == F.col("__key"), "left_anti")


def reference_counts(df: DataFrame, key: str, references: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(table_name, n): rows of each referencing table (name, frame, column) that point at ``df``'s keys."""
    own = df.select(F.col(key).alias("__key")).distinct()
    each = [f.join(own, F.col(c) == F.col("__key"), "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, f, c in references]
    return reduce(DataFrame.unionByName, each)


def _ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    return df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], df.select(key).schema)


def _holds(df: DataFrame, values: dict) -> Column:
    out: Column = F.lit(True)
    for c, v in values.items():
        kind = df.schema[c].dataType
        literal = F.lit(v).try_cast(kind)
        equal = F.abs(F.col(c) - literal) < 1e-9 if kind.typeName() in ("double", "float") and v is not None else F.col(c).eqNullSafe(literal)
        out = out & F.coalesce(equal, F.lit(False))
    return out


def verify_deleted(after: DataFrame, key: str, ids: list) -> bool | None:
    """Whether none of the ids is left; None if there are none to look for."""
    return None if not ids else after.join(F.broadcast(_ids(after, key, ids)), key, "left_semi").limit(1).count() == 0


def verify_present(after: DataFrame, key: str, ids: list, values: dict | None = None) -> bool | None:
    """Whether all ids are there and hold the values; None if nothing can be said."""
    if not ids:
        return None
    row = after.join(F.broadcast(_ids(after, key, ids)), key, "left_semi").agg(F.count_distinct(key).alias("n"), F.bool_and(_holds(after, values or {})).alias("ok")).first()
    return row["n"] == len(set(ids)) and bool(row["ok"])


def verify_inserted(after: DataFrame, rows: list[dict]) -> bool | None:
    """Whether each row is there with all its values; None without rows. One pass serves them all."""
    if not rows:
        return None
    return bool(after.agg(*[F.bool_or(_holds(after, r)).alias(f"r{i}") for i, r in enumerate(rows)]).select(F.coalesce(F.least(*[F.col(f"r{i}") for i in range(len(rows))]), F.lit(False)) if len(rows) > 1 else F.coalesce("r0", F.lit(False))).first()[0])


def verify(after: DataFrame, key: str, action: str, affected: int | None = None, ids: list = (), values: dict | None = None, rows: list[dict] = ()) -> tuple[bool | None, list[str]]:
    """What a change claims, looked at again in the table after it: true, false, or None where nothing can be said; and what differs."""
    found = {"DELETE": lambda: verify_deleted(after, key, list(ids)), "UPDATE": lambda: verify_present(after, key, list(ids), values), "INSERT": lambda: verify_inserted(after, list(rows))}
    if action.upper() not in found:
        return None, [f"unknown action {action}"]
    ok, differs = found[action.upper()](), []
    if ok is None:
        return None, ["nothing to look for"]
    if not ok:
        differs.append({"DELETE": "rows are still there", "UPDATE": "rows are missing or hold other values", "INSERT": "inserted rows are missing"}[action.upper()])
    if ids and affected is not None and affected != len(ids):
        differs.append(f"{affected} rows claimed, {len(ids)} named")
    return not differs, differs
