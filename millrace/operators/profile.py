"""Column profiles, and which of several rows of a key to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def columns(df: DataFrame, names: list[str] | None = None, samples: int = 5) -> DataFrame:
    """(column, non_null, distinct, ratio, samples) of each column.

    Values are counted by (column, value) first, so distinct values meet as counts and one pass serves all columns.
    """
    names = names or df.columns
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value")) for n in names]))
    values = df.select(stack.alias("x")).select("x.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("value").asc_nulls_last()))
    first = values.where("value is not null").withColumn("rank", rank).where(F.col("rank") <= samples)
    first = first.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    totals = values.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"), F.count("value").alias("distinct"), F.sum("n").alias("total"))
    ratio = F.round(F.col("distinct") / F.greatest("total", F.lit(1)), 3)
    return totals.select("column", "non_null", "distinct", ratio.alias("ratio")).join(first, "column", "left").select("column", "non_null", "distinct", "ratio", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def wide_table_suspects(profile: DataFrame) -> DataFrame:
    """Columns that repeat enough to be a table of their own: three values or more, under half of the rows."""
    return profile.where("distinct >= 3 and ratio < 0.5")


def fullest(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Of the distinct rows of each key, the one with most values that aren't blank; and the others.

    Ties go to the smallest row, so that a rerun chooses alike.
    """
    own = [c for c in df.columns if c != key]
    filled = sum((F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", 1).otherwise(0) for c in own), F.lit(0))
    order = Window.partitionBy(key).orderBy(filled.desc(), *[F.col(c).asc_nulls_last() for c in own])
    ranked = df.distinct().withColumn("__rank", F.row_number().over(order))
    return ranked.where("__rank = 1").drop("__rank"), ranked.where("__rank > 1").drop("__rank")


def commonest_reason(failed: DataFrame, reason: str, groups: int, width: int = 60) -> DataFrame:
    """(reason, n, systemic): the commonest start of the reasons, systemic if it is as frequent as there are groups."""
    found = failed.groupBy(F.substring(reason, 1, width).alias("reason")).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "reason").limit(1).withColumn("systemic", F.col("n") >= groups)


def newest(df: DataFrame, time: str, n: int, by: list[str] = (), ties: list[str] = ()) -> DataFrame:
    """The newest ``n`` rows, of each group if ``by`` is given."""
    order = [F.col(time).desc_nulls_last(), *[F.col(t) for t in ties]]
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def ranked_candidates(df: DataFrame, key: str, priority: str, target: str) -> DataFrame:
    """(key, target, ambiguous): a key's candidates of the highest priority; ambiguous if they name several targets."""
    best = df.withColumn("__rank", F.rank().over(Window.partitionBy(key).orderBy(F.desc(priority)))).where("__rank = 1")
    return best.groupBy(key).agg(F.min(target).alias(target), (F.count_distinct(target) > 1).alias("ambiguous"))
