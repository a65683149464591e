"""Declared tables, their foreign keys, and where their data lies.

A catalog holds small declarations only; data stays in DataFrames. Joins are inferred from the foreign-key graph.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]{0,63}\Z")

#: Type names and the family of each; the tool-facing ones fold into TEXT, VARCHAR, INTEGER, FLOAT.
FAMILIES = {
    "int": ("INT", "INTEGER", "BIGINT", "SMALLINT", "SERIAL"),
    "float": ("FLOAT", "DOUBLE", "REAL", "DECIMAL", "NUMERIC"),
    "text": ("TEXT", "VARCHAR", "CHAR", "STRING"),
    "date": ("DATE",),
    "datetime": ("DATETIME", "TIMESTAMP", "TIMESTAMP_NTZ"),
    "blob": ("BLOB", "BINARY"),
    "bool": ("BOOLEAN", "BOOL"),
}
SPARK_TYPES = {"int": "bigint", "float": "double", "text": "string", "date": "date", "datetime": "timestamp", "blob": "binary", "bool": "boolean"}


def family(name: str) -> str:
    """Family of a type name, its precision left aside; ``other`` for unknown names."""
    head = re.sub(r"\(.*\)", "", name or "").strip().upper()
    return next((f for f, names in FAMILIES.items() if head in names), "other")


def spark_type(name: str) -> str:
    """Spark's type for a declared one; decimals keep their precision, (20, 4) by default."""
    found = re.fullmatch(r"(?:DECIMAL|NUMERIC)(?:\((\d+)\s*,\s*(\d+)\))?", (name or "").strip().upper())
    if found:
        return f"decimal({found[1] or 20},{found[2] or 4})"
    return SPARK_TYPES.get(family(name), "string")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "TEXT"
    business_name: str = ""
    description: str = ""
    pk: bool = False
    unique: bool = False
    not_null: bool = False
    rules: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class ForeignKey:
    """A key, and what becomes of its rows when what they point to is deleted (RESTRICT, CASCADE or SET NULL) or
    changes (CASCADE or RESTRICT)."""

    column: str
    references: str
    ref_column: str
    on_delete: str = "RESTRICT"
    on_update: str = "CASCADE"

    def __post_init__(self):
        if self.on_delete not in ("RESTRICT", "CASCADE", "SET NULL") or self.on_update not in ("RESTRICT", "CASCADE"):
            raise ValueError(f"unknown action {self.on_delete} or {self.on_update}")


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    business_name: str = ""
    description: str = ""
    source: str = "main"
    aliases: tuple[tuple[str, str], ...] = ()

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    def resolve(self, name: str) -> str:
        """A column's real name for its own, its business name or an alias."""
        if self.column(name):
            return name
        found = dict(self.aliases).get(name) or next((c.name for c in self.columns if c.business_name == name), None)
        if not found or not self.column(found):
            raise ValueError(f"{self.name} has no column {name}")
        return found

    @property
    def key(self) -> str | None:
        """The first unique column that isn't the primary key."""
        return next((c.name for c in self.columns if c.unique and not c.pk), None)


@dataclass(frozen=True)
class Edge:
    """An equality that joins two tables, read from either side."""

    left: str
    left_column: str
    right: str
    right_column: str

    def flipped(self) -> Edge:
        return Edge(self.right, self.right_column, self.left, self.left_column)


class Catalog:
    """Specs by table name, and the DataFrames of their data."""

    def __init__(self, spark: SparkSession, specs: list[TableSpec] = ()):
        self.spark = spark
        self.specs: dict[str, TableSpec] = {}
        self.frames: dict[str, DataFrame] = {}
        for s in specs:
            self.declare(s)

    def declare(self, spec: TableSpec, df: DataFrame | None = None) -> None:
        for name in (spec.name, *[c.name for c in spec.columns]):
            if not IDENTIFIER.match(name):
                raise ValueError(f"not an identifier: {name!r}")
        self.specs[spec.name] = spec
        if df is not None:
            self.frames[spec.name] = df

    def table(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise ValueError(f"no table {name}")
        return self.frames[name]

    @classmethod
    def of_directory(cls, spark: SparkSession, path: str, keys: dict[str, list[ForeignKey]] | None = None, tables: list[str] | None = None) -> Catalog:
        """A catalog over ``path``'s parquet tables; columns and types come from the files."""
        out = cls(spark)
        for name in tables or TEST_TABLES:
            df = spark.read.parquet(f"{path}/{name}.parquet")
            columns = tuple(ColumnSpec(f.name, f.dataType.simpleString().upper()) for f in df.schema)
            out.declare(TableSpec(name, columns, tuple((keys if keys is not None else TEST_KEYS).get(name, ()))), df)
        return out

    # foreign-key graph

    def edges(self) -> list[Edge]:
        return [Edge(s.name, k.column, k.references, k.ref_column) for s in self.specs.values() for k in s.foreign_keys]

    def direct(self, a: str, b: str) -> Edge | None:
        """The first declared key from a to b, else from b to a, read from a."""
        forward = next((e for e in self.edges() if (e.left, e.right) == (a, b)), None)
        back = next((e for e in self.edges() if (e.left, e.right) == (b, a)), None)
        return forward or (back.flipped() if back else None)

    def path(self, joined: list[str], target: str) -> list[Edge]:
        """The shortest chain of keys from any joined table to ``target``; earlier tables and declarations win ties."""
        if target in joined:
            return []
        seen, queue = set(joined), deque((t, []) for t in joined)
        while queue:
            at, chain = queue.popleft()
            around = [e for e in self.edges() if e.left == at] + [e.flipped() for e in self.edges() if e.right == at]
            for e in around:
                if e.right in seen:
                    continue
                if e.right == target:
                    return [*chain, e]
                seen.add(e.right)
                queue.append((e.right, [*chain, e]))
        raise ValueError(f"no foreign keys lead to {target}")

    def ordered(self, names: list[str], referenced_first: bool = True) -> list[str]:
        """Tables so that references come first (to create) or last (to delete); a cycle goes by name."""
        left, out = list(names), []
        while left:
            needs = lambda t: {k.references for k in self.specs[t].foreign_keys if k.references in left and k.references != t}
            free = [t for t in left if not needs(t)] or sorted(left)
            out += free
            left = [t for t in left if t not in free]
        return out if referenced_first else out[::-1]

    # metadata as DataFrames

    def meta_tables(self) -> DataFrame:
        rows = [(s.name, s.business_name, s.description, s.source, len(s.columns)) for s in self.specs.values()]
        return self.spark.createDataFrame(rows, "name string, business_name string, description string, source string, n_columns int")

    def meta_columns(self) -> DataFrame:
        rows = [(s.name, i, c.name, c.type, c.business_name, c.description, c.pk, c.unique, c.not_null) for s in self.specs.values() for i, c in enumerate(s.columns)]
        return self.spark.createDataFrame(rows, "table_name string, position int, name string, type string, business_name string, description string, pk boolean, is_unique boolean, not_null boolean")

    def meta_keys(self) -> DataFrame:
        rows = [(e.left, e.left_column, e.right, e.right_column) for e in self.edges()]
        return self.spark.createDataFrame(rows, "from_table string, from_column string, to_table string, to_column string")

    def search(self, words: str) -> DataFrame:
        """Tables of which a name or description, or a column's, holds the words (as a LIKE pattern's middle)."""
        like = f"%{words}%"
        t, c = self.meta_tables(), self.meta_columns()
        own = t.where(F.col("name").like(like) | F.col("business_name").like(like) | F.col("description").like(like)).select(F.col("name").alias("table_name"))
        of_columns = c.where(F.col("name").like(like) | F.col("business_name").like(like) | F.col("description").like(like)).select("table_name")
        return own.union(of_columns).distinct().orderBy("table_name")

    def counts(self) -> DataFrame:
        """Rows of every table: (table_name, n_rows)."""
        out = None
        for name, df in self.frames.items():
            one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            out = one if out is None else out.unionByName(one)
        return out

    def overview(self) -> DataFrame:
        """Numbers of tables, columns and foreign keys."""
        return self.spark.createDataFrame([(len(self.specs), sum(len(s.columns) for s in self.specs.values()), len(self.edges()))], "tables long, columns long, foreign_keys long")

    def preview(self, name: str, rows: int = 5) -> tuple[list[tuple[str, str]], DataFrame, int]:
        """A table's columns with types, its first rows and its number of rows."""
        df = self.table(name)
        return df.dtypes, df.limit(rows), df.count()

    def adjacent(self, name: str) -> DataFrame:
        """Tables one key away: edges joined to both their ends."""
        k, t = self.meta_keys(), self.meta_tables().select("name", "business_name")
        left, right = t.toDF("from_table", "from_business"), t.toDF("to_table", "to_business")
        return k.where((F.col("from_table") == name) | (F.col("to_table") == name)).join(left, "from_table").join(right, "to_table")


    def describe(self, name: str) -> DataFrame:
        """A table's columns in order, with what each refers to as ``table.column``."""
        k = self.meta_keys().where(F.col("from_table") == name).select(F.col("from_column").alias("name"), F.concat_ws(".", "to_table", "to_column").alias("references"))
        c = self.meta_columns().where(F.col("table_name") == name).join(F.broadcast(k), "name", "left")
        return c.orderBy("position").select("table_name", "position", "name", "type", "business_name", "description", "pk", "is_unique", "not_null", "references")

    def nodes(self) -> DataFrame:
        """The tables as nodes of the graph: (node_id, name, source)."""
        return self.meta_tables().select(F.concat_ws(".", "source", "name").alias("node_id"), "name", "source")

    def links(self) -> DataFrame:
        """The keys as edges between nodes of one source: (from_id, to_id, column)."""
        n = self.nodes()
        left, right = (n.select(F.col("name").alias(f"{x}_table"), F.col("node_id").alias(f"{x}_id"), F.col("source").alias(f"{x}_source")) for x in ("from", "to"))
        both = self.meta_keys().join(left, "from_table").join(right, "to_table").where("from_source = to_source")
        return both.select("from_id", "to_id", F.col("from_column").alias("column")).distinct()

    def forget(self, name: str) -> None:
        """Take a table's declaration and data, and other tables' keys to it, out of the catalog."""
        self.specs.pop(name, None)
        self.frames.pop(name, None)
        for other, spec in self.specs.items():
            self.specs[other] = replace(spec, foreign_keys=tuple(k for k in spec.foreign_keys if k.references != name))


#: How much a name counts by which a text may mean a table.
MAPPED, BUSINESS, OWN = 100, 80, 50


def mentioned(text: str, specs: list[TableSpec], words: dict[str, str] | None = None) -> tuple[str | None, list[str]]:
    """The table that a text means, and if several are named equally well, those instead.

    Words declared for tables count most, then business names (or descriptions, where there is none), then own names.
    """
    low, found = text.lower(), [(MAPPED, table) for word, table in (words or {}).items() if word in text]
    for s in specs:
        called = s.business_name or s.description
        found += [(OWN, s.name)] * (s.name.lower() in low) + [(BUSINESS, s.name)] * bool(called and called.lower() in low)
    best = sorted({t for n, t in found if n == max(found)[0]})
    return (best[0], []) if len(best) == 1 else (None, best)


def parsed_definition(name: str, text: str) -> TableSpec:
    """A spec from ``column:type[:pk][:nn][:uq][:fk(table)]`` items, separated by commas."""
    columns, keys = [], []
    for item in filter(None, (x.strip() for x in re.split(r",(?![^(]*\))", text))):
        column, kind, *flags = item.split(":")
        marks = {f.strip().lower() for f in flags}
        rules = {"default": f.split("=", 1)[1] for f in flags if f.lower().startswith("default=")}
        columns.append(ColumnSpec(column.strip(), kind.strip().upper(), pk="pk" in marks, unique="uq" in marks, not_null="nn" in marks, rules=rules))
        keys += [ForeignKey(column.strip(), m[1], "id") for f in flags if (m := re.fullmatch(r"fk\((\w+)\)", f.strip(), re.I))]
    return TableSpec(name, tuple(columns), tuple(keys))


def changes(old: TableSpec, new: TableSpec) -> list[tuple[str, str, str]]:
    """What differs between two specs: (kind, name, detail)."""
    out = []
    if old.name != new.name:
        out.append(("rename_table", old.name, new.name))
    for c in new.columns:
        was = old.column(c.name)
        if not was:
            out.append(("add_column", c.name, c.type))
            continue
        if was.type != c.type:
            out.append(("alter_precision" if family(was.type) == family(c.type) else "modify_type", c.name, f"{was.type} to {c.type}"))
        for mark in ("not_null", "unique", "pk"):
            if getattr(was, mark) != getattr(c, mark):
                out.append((f"{'set' if getattr(c, mark) else 'drop'}_{mark}", c.name, ""))
        if was.rules != c.rules:
            out.append(("change_rules", c.name, str(c.rules)))
    out += [("drop_column", c.name, c.type) for c in old.columns if not new.column(c.name)]
    out += [("add_foreign_key", k.column, k.references) for k in new.foreign_keys if k not in old.foreign_keys]
    out += [("drop_foreign_key", k.column, k.references) for k in old.foreign_keys if k not in new.foreign_keys]
    return out


def renamed(catalog: Catalog, old: str, new: str) -> None:
    """Rename a table, and the references to it in other specs."""
    for name, spec in list(catalog.specs.items()):
        keys = tuple(replace(k, references=new) if k.references == old else k for k in spec.foreign_keys)
        catalog.specs[name] = replace(spec, foreign_keys=keys)
    catalog.declare(replace(catalog.specs.pop(old), name=new), catalog.frames.pop(old, None))


def inconsistencies(spec: TableSpec, df: DataFrame) -> list[tuple[str, str]]:
    """How data differs from its declaration: missing and undeclared columns, other type families."""
    held = {f.name: f.dataType.simpleString().upper() for f in df.schema}
    out = [("missing_column", c.name) for c in spec.columns if c.name not in held]
    out += [("extra_column", n) for n in held if not spec.column(n)]
    out += [("type_family", c.name) for c in spec.columns if c.name in held and family(c.type) != family(held[c.name])]
    return out


def catalog_inconsistencies(catalog: Catalog) -> DataFrame:
    """(kind, table_name, name): tables without data or declaration, columns that differ, keys that lead nowhere, unique columns that repeat."""
    out = [("missing_table", t, "") for t in catalog.specs if t not in catalog.frames]
    out += [("undeclared_table", t, "") for t in catalog.frames if t not in catalog.specs]
    unique = []
    for name, spec in catalog.specs.items():
        df = catalog.frames.get(name)
        if df is not None:
            out += [(kind, name, column) for kind, column in inconsistencies(spec, df)]
            unique += [(name, c.name, df) for c in spec.columns if (c.unique or c.pk) and c.name in df.columns]
        for k in spec.foreign_keys:
            target = catalog.specs.get(k.references)
            if target is None or not target.column(k.ref_column):
                out.append(("key_target", name, f"{k.column} to {k.references}.{k.ref_column}"))
            elif not spec.column(k.column):
                out.append(("key_column", name, k.column))
            elif family(spec.column(k.column).type) != family(target.column(k.ref_column).type):
                out.append(("key_type", name, f"{k.column} to {k.references}.{k.ref_column}"))
    found = catalog.spark.createDataFrame(out, "kind string, table_name string, name string")
    for name, column, df in unique:
        again = df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").limit(1)
        found = found.unionByName(again.select(F.lit("not_unique").alias("kind"), F.lit(name).alias("table_name"), F.lit(column).alias("name")))
    return found


def claims(specs: list[TableSpec], profiles: list[DataFrame] = ()) -> list[tuple[str, str]]:
    """What speaks against a design, given profiles of its source columns: (kind, detail).

    Keys lead to tables of the design and to their ids; a design with keys needs a source column that repeats; one
    table alone is suspect where two columns or more repeat like entities of their own.
    """
    names = {s.name for s in specs}
    out = [("key_table", f"{s.name}.{k.column} to {k.references}") for s in specs for k in s.foreign_keys if k.references not in names]
    out += [("key_not_id", f"{s.name}.{k.column} to {k.ref_column}") for s in specs for k in s.foreign_keys if k.ref_column != "id"]
    if not profiles:
        return out
    rows = [r for p in profiles for r in p.select("column", "distinct", "ratio", F.round(F.col("distinct") / F.greatest("ratio", F.lit(0.001))).alias("rows")).collect()]
    total = max((r["rows"] for r in rows), default=0)
    if any(s.foreign_keys for s in specs) and not any(1 < r["distinct"] < total for r in rows):
        out.append(("no_repeated_column", ""))
    entities = [r["column"] for r in rows if r["distinct"] >= 3 and r["ratio"] < 0.5]
    if len(specs) == 1 and len(entities) >= 2:
        out.append(("single_wide_table", ", ".join(entities)))
    return out


#: The test tables, and the foreign keys that their columns' names imply.
TEST_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
TEST_KEYS = {
    "lineitem": [ForeignKey("l_orderkey", "orders", "o_orderkey"), ForeignKey("l_partkey", "part", "p_partkey"), ForeignKey("l_suppkey", "supplier", "s_suppkey")],
    "orders": [ForeignKey("o_custkey", "customer", "c_custkey")],
    "customer": [ForeignKey("c_nationkey", "nation", "n_nationkey")],
    "supplier": [ForeignKey("s_nationkey", "nation", "n_nationkey")],
    "nation": [ForeignKey("n_regionkey", "region", "r_regionkey")],
    "labels": [ForeignKey("doc_id", "documents", "doc_id")],
    "events": [ForeignKey("user_id", "customer", "c_custkey")],
}
