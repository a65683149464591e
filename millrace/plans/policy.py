"""What a role may read: rules on tables and columns, checked before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from millrace.plans.catalog import Catalog


class Denied(PermissionError):
    pass


@dataclass
class Policy:
    """A table's rule comes before its source's, that before the default; a role's denials win over both."""

    default: bool = True
    sources: dict[str, bool] = field(default_factory=dict)
    tables: dict[str, bool] = field(default_factory=dict)
    denied_columns: dict[str, set[str]] = field(default_factory=dict)
    roles: dict[str, Policy] = field(default_factory=dict)

    def allows(self, table: str, source: str = "main", role: str | None = None) -> bool:
        own = self.tables.get(table, self.sources.get(source, self.default))
        over = self.roles.get(role)
        if over is None:
            return own
        said = over.tables.get(table, over.sources.get(source))
        return own if said is None else said and (own or table in over.tables)

    def hidden(self, table: str, role: str | None = None) -> set[str]:
        over = self.roles.get(role)
        return self.denied_columns.get(table, set()) | (over.denied_columns.get(table, set()) if over else set())

    def check(self, table: str, columns: list[str] = (), source: str = "main", role: str | None = None) -> None:
        """Refuse a table, or any mention of a hidden column."""
        if not self.allows(table, source, role):
            raise Denied(f"{table} may not be read")
        if bad := sorted(self.hidden(table, role) & {c.rpartition(".")[2] for c in columns}):
            raise Denied(f"{', '.join(bad)} of {table} may not be read")

    def view(self, df: DataFrame, table: str, source: str = "main", role: str | None = None) -> DataFrame:
        """All columns that the role may see; the scan prunes the others."""
        self.check(table, (), source, role)
        return df.drop(*self.hidden(table, role))


    def visible(self, catalog: Catalog, role: str | None = None) -> Catalog:
        """The catalog as a role sees it: allowed tables without hidden columns, and the keys between what is left."""
        out = Catalog(catalog.spark)
        seen = {n: self.hidden(n, role) for n, s in catalog.specs.items() if self.allows(n, s.source, role)}
        for name, hidden in seen.items():
            spec = catalog.specs[name]
            keys = tuple(k for k in spec.foreign_keys if k.column not in hidden and k.ref_column not in seen.get(k.references, {k.ref_column}))
            columns = tuple(c for c in spec.columns if c.name not in hidden)
            aliases = tuple(a for a in spec.aliases if a[1] not in hidden)
            out.declare(replace(spec, columns=columns, foreign_keys=keys, aliases=aliases), catalog.frames[name].drop(*hidden) if name in catalog.frames else None)
        return out

    def check_fields(self, catalog: Catalog, main: str, tables: list[str], fields: list[str], role: str | None = None) -> None:
        """Refuse tables and any mention of a hidden column, as ``column`` of any of the tables or as ``table.column``."""
        for table in (main, *tables):
            spec = catalog.specs.get(table)
            own = []
            for f in fields:
                of, dot, name = f.rpartition(".")
                if not dot or of == table:
                    try:
                        own.append(spec.resolve(name) if spec else name)
                    except ValueError:
                        own.append(name)
            self.check(table, own, spec.source if spec else "main", role)


def read_only(spark, sql: str) -> DataFrame:
    """Run one SELECT or WITH statement; anything else is refused."""
    head = sql.strip().split(None, 1)[0].upper() if sql.strip() else ""
    if head not in ("SELECT", "WITH", "EXPLAIN") or ";" in sql.strip().rstrip(";"):
        raise Denied("only single SELECT statements")
    return spark.sql(sql)
