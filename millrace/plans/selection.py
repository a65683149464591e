"""Projection, order, pages, and saved sets of rows."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.conditions import filtered

AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
_ITEM = re.compile(r"(?:(?P<agg>\w+)\s*\(\s*(?P<arg>[\w.]+|\*)\s*\)|(?P<col>[\w.]+(?:\.\*)?|\*))(?:\s+AS\s+(?P<alias>\w+))?\s*\Z", re.I)


def projected(df: DataFrame, fields: str | list[str], names=None) -> DataFrame:
    """``*``, columns, ``t.*`` and aggregates, each with an optional ``AS`` name; ``names`` gives columns their real names."""
    real = lambda name: name if names is None or name.endswith("*") else names(name)
    plain: list[Column] = []
    summed: list[Column] = []
    keys: list[str] = []
    for item in fields.split(",") if isinstance(fields, str) else fields:
        found = _ITEM.match(item.strip())
        if not found:
            raise ValueError(f"can't select {item!r}")
        if found["agg"]:
            out = aggregate(found["agg"], real(found["arg"])).alias(found["alias"] or f"{found['agg'].lower()}_{found['arg']}".replace("*", "rows"))
            summed.append(out)
        else:
            column = F.col(real(found["col"]))
            plain.append(column.alias(found["alias"]) if found["alias"] else column)
            keys.append(found["col"])
    if not summed:
        return df.select(*plain)
    return df.groupBy(*plain).agg(*summed) if plain else df.agg(*summed)


def aggregate(function: str, column: str, distinct: bool = False) -> Column:
    name = function.upper()
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {function!r}")
    if column == "*":
        if name != "COUNT" or distinct:
            raise ValueError("only COUNT takes all rows")
        return F.count("*")
    if distinct:
        return {"COUNT": F.count_distinct, "SUM": F.sum_distinct}.get(name, lambda c: AGGREGATES[name](F.col(c)))(column) if name != "AVG" else F.expr(f"avg(DISTINCT `{column}`)")
    return AGGREGATES[name](column)


def ordered(df: DataFrame, order: str | list[str]) -> DataFrame:
    """By items ``column [ASC|DESC]``; nulls come last either way."""
    out = []
    for item in order.split(",") if isinstance(order, str) else order:
        name, *way = item.split()
        out.append(F.col(name).desc_nulls_last() if way and way[0].upper() == "DESC" else F.col(name).asc_nulls_last())
    return df.orderBy(*out)


def limited(df: DataFrame, n: int) -> DataFrame:
    if not isinstance(n, int) or n < 1:
        raise ValueError("a limit is a positive whole number")
    return df.limit(n)


@dataclass
class Page:
    rows: DataFrame
    total: int
    pages: int
    has_more: bool


def page(df: DataFrame, key: str | list[str], number: int = 1, size: int = 100, conditions=None, fields: str | list[str] = "*", names=None) -> Page:
    """One page of the rows that meet the conditions, in the order of ``key``, and how many there are in all."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("pages count from 1 and hold 1 to 500 rows")
    df = filtered(df, conditions, names=names)
    total = df.count()
    rows = projected(ordered(df, key).offset((number - 1) * size).limit(size), fields, names)
    return Page(rows, total, -(-total // size), number * size < total)


@dataclass
class Seek:
    """Rows of a page, how many there are in all, and the token of the next page (None after the last)."""

    rows: DataFrame
    total: int
    token: str | None


def _after(df: DataFrame, keys: list[tuple[str, bool]], last: list) -> Column:
    """Rows that come after some key values, in the order of ``keys`` (name, falling) with nulls last.

    The first key's own range stands beside the exact condition, so that it reaches the scan.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    exact, same = F.lit(False), F.lit(True)
    for (name, falling), value in zip(keys, last, strict=True):
        held = F.lit(value).cast(kinds[name])
        if value is not None:
            beyond = F.col(name) < held if falling else F.col(name) > held
            exact = exact | (same & (beyond | F.col(name).isNull()))
        same = same & F.col(name).eqNullSafe(held)
    (name, falling), value = keys[0], last[0]
    held = F.lit(value).cast(kinds[name])
    first = F.col(name).isNull() if value is None else (F.col(name) <= held if falling else F.col(name) >= held) | F.col(name).isNull()
    return first & exact


def page_after(df: DataFrame, keys: str | list[str], token: str | None = None, size: int = 100, conditions=None, fields: str | list[str] = "*", names=None) -> Seek:
    """The page that follows a token, which holds the last key values: a range is read, nothing is counted off.

    ``keys`` are items ``column [ASC|DESC]`` that together tell rows apart; nulls come last either way. The total is
    counted for the first page only, and goes along in the token.
    """
    if not 1 <= size <= 500:
        raise ValueError("pages hold 1 to 500 rows")
    df = filtered(df, conditions, names=names)
    items = [(i.split()[0], i.split()[-1].upper() == "DESC") for i in (keys.split(",") if isinstance(keys, str) else keys)]
    try:
        held = json.loads(token) if token else {"total": df.count(), "seen": 0, "last": None}
        total, seen, last = held["total"], held["seen"], held["last"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a page token") from e
    rest = df if last is None else df.where(_after(df, items, last))
    rows = ordered(rest, keys).limit(size)
    text = [F.col(n).cast("string").alias(f"k{i}") for i, (n, _) in enumerate(items)]
    end = rows.select(*text).tail(1)  # of one page
    seen += size
    after = json.dumps({"total": total, "seen": seen, "last": list(end[0])}) if end and seen < total else None
    return Seek(projected(rows, fields, names), total, after)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    if column == "*":
        raise ValueError("a distinct list is of one column")
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last())


class Selections:
    """Saved sets of ids, as parquet beside a manifest; the newest ``keep`` stay."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 50):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self.saved: list[dict] = []

    def save(self, df: DataFrame, table: str, key: str = "id", query: str = "") -> dict:
        path = f"{self.folder}/selection-{uuid.uuid4().hex}"
        df.select(key).write.parquet(path)
        sample = [json.loads(x) for x in df.limit(2).toJSON().collect()]
        entry = {"number": 1 + max((s["number"] for s in self.saved), default=0), "table": table, "key": key, "path": path, "count": self.spark.read.parquet(path).count(), "query": query, "sample": sample}
        self.saved = [*self.saved, entry][-self.keep :]
        return entry

    def rows(self, number: int, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose id is in the set."""
        entry = next((s for s in self.saved if s["number"] == number), None)
        if entry is None:
            raise ValueError(f"no selection {number}")
        return df.join(self.spark.read.parquet(entry["path"]), entry["key"], "left_semi")

    def export(self, number: int, df: DataFrame, path: str) -> None:
        """The set's rows as they are now, as CSV part files with a header, written where they are."""
        from millrace.sources.sinks import folder_csv

        folder_csv(self.rows(number, df), path)
