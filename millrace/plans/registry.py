"""Named tools with typed parameters, as other programs call them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable
    params: dict[str, type] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    risk: str = "read"
    tags: tuple[str, ...] = ()
    #: Tables that a call touches, and the columns of each that it names; None stands for all columns.
    touches: Callable[[dict], dict[str, list[str] | None]] | None = None


@dataclass
class Result:
    """What a tool returns to programs: rows as a DataFrame or a value, or a code and a reason."""

    ok: bool
    code: str = "ok"
    reason: str = ""
    data: Any = None


class Registry:
    """Tools by name; ``gate`` is asked before any that isn't reading only, ``guard`` before any that names its tables."""

    def __init__(self, gate: Callable[[Tool, dict], bool] = lambda tool, args: tool.risk == "read"):
        self.tools: dict[str, Tool] = {}
        self.gate = gate
        self.guard: Callable[[dict[str, list[str] | None]], None] = lambda touched: None

    def add(self, tool: Tool) -> None:
        if tool.name in self.tools:
            raise ValueError(f"{tool.name} exists")
        self.tools[tool.name] = tool

    def call(self, name: str, /, **args) -> Result:
        tool = self.tools.get(name)
        if tool is None:
            return Result(False, "unknown_tool", name)
        if missing := [p for p in tool.required if p not in args]:
            return Result(False, "missing", ", ".join(missing))
        if extra := [a for a in args if a not in tool.params]:
            return Result(False, "unknown_parameter", ", ".join(extra))
        try:
            given = {k: v if v is None or isinstance(v, tool.params[k]) else tool.params[k](v) for k, v in args.items()}
        except (TypeError, ValueError) as e:
            return Result(False, "bad_value", str(e))
        try:
            if tool.touches:
                self.guard(tool.touches(given))
            if not self.gate(tool, given):
                return Result(False, "denied", f"{name} needs a confirmation")
            return Result(True, data=tool.run(**given))
        except PermissionError as e:
            return Result(False, "denied", str(e))
        except KeyError as e:
            return Result(False, "unknown_name", str(e))
        except ValueError as e:
            return Result(False, "invalid", str(e))


def fields_of(conditions) -> list[str]:
    """All columns that conditions mention, values that are columns included."""
    from millrace.plans.conditions import normalised

    found = normalised(conditions or [], split_values=False)
    return [c.field for c in found] + [c.value for c in found if isinstance(c.value, str) and re.fullmatch(r"\w+\.\w+", c.value)]


def _words(items) -> list[str]:
    """The columns of a selection's items, the arguments of aggregates included."""
    items = items.split(",") if isinstance(items, str) else items
    return [w for i in items for w in re.findall(r"[A-Za-z_][\w.]*", re.sub(r"(?i)\s+(as\s+\w+|asc|desc)\s*$", "", i.strip())) if not re.search(rf"\b{re.escape(w)}\s*\(", i)]


def of_catalog(catalog, policy=None, role: str | None = None) -> Registry:
    """The reading tools over a catalog: ``catalog`` is one, or what returns the present one.

    With a policy, each call first refuses tables and columns that the role may not see, in whatever part of it they
    are mentioned, and then runs on what is left of the catalog.
    """
    from millrace.plans import aggregates, joins, selection
    from millrace.plans.catalog import mentioned

    out = Registry()

    def seen(main: str = "", tables: list[str] = (), fields: list[str] = ()):
        whole = catalog() if callable(catalog) else catalog
        if policy is None:
            return whole
        if main:
            policy.check_fields(whole, main, list(tables), [f for f in fields if f], role)
        return policy.visible(whole, role)

    def named(held, table: str):
        return held.specs[table].resolve if table in held.specs else None

    def query(table, conditions=None, key=None, page=1, page_size=100, fields="*"):
        held = seen(table, fields=[*fields_of(conditions), key or "", *_words(fields)])
        df = held.table(table)
        return selection.page(df, key or df.columns[0], page, page_size, conditions, fields, named(held, table))

    def aggregate(table, function, column="*", by=(), conditions=None):
        held = seen(table, fields=[*fields_of(conditions), column, *by])
        return aggregates.aggregated(held.table(table), function, column, list(by), conditions, names=named(held, table))

    def join(main, tables, kind="LEFT", conditions=None, fields=None, on=None):
        held = seen(main, tables, [*fields_of(conditions), *_words(fields or []), *re.findall(r"\w+\.\w+", on or "")])
        j = joins.joined(held, main, tables, kind, conditions, on)
        return joins.select(j, fields, catalog=held) if fields else j.frame

    def describe(table=None, words=""):
        held = seen(table or "")
        return held.describe(table) if table else held.search(words)

    rows, schema = ("rows",), ("schema",)
    out.add(Tool("query", query, {"table": str, "conditions": object, "key": str, "page": int, "page_size": int, "fields": object}, ("table",), tags=rows))
    out.add(Tool("aggregate_query", aggregate, {"table": str, "function": str, "column": str, "by": list, "conditions": object}, ("table", "function"), tags=rows))
    out.add(Tool("join_query", join, {"main": str, "tables": list, "kind": str, "conditions": object, "fields": list, "on": str}, ("main", "tables"), tags=rows))
    out.add(Tool("describe_schema", describe, {"table": str, "words": str}, tags=schema))
    out.add(Tool("list_tables", lambda: seen().counts(), tags=schema))
    out.add(Tool("list_databases", lambda: seen().meta_tables().groupBy("source").count(), tags=schema))
    out.add(Tool("which_table", lambda text: mentioned(text, list(seen().specs.values())), {"text": str}, ("text",), tags=schema))
    return out


def of_store(store, selections, policy=None, role: str | None = None, vectors=None, standard: list = (), gate=None) -> Registry:
    """The tools over a store: reading, changing rows that a saved selection names, changing tables, files and search.

    ``gate(tool, args)`` decides on every call that changes something; without it such calls are refused. With a
    policy, a call first names the tables and columns it touches, and is refused if the role may not see one of them: a
    table that is dropped, emptied or replaced is touched in all its columns.
    """
    from millrace.operators import retrieval
    from millrace.plans.catalog import ColumnSpec, ForeignKey, parsed_definition
    from millrace.plans.conditions import parsed
    from millrace.plans.selection import projected
    from millrace.sources import files, sinks

    out = of_catalog(lambda: store.catalog, policy, role)
    if gate:
        out.gate = lambda tool, args: tool.risk == "read" or gate(tool, args)
    templates: dict[str, list] = {}

    def guard(touched: dict[str, list[str] | None]) -> None:
        for table, columns in touched.items():
            policy.check_fields(store.catalog, table, [], sorted(policy.hidden(table, role)) if columns is None else [c for c in columns if c], role)

    if policy:
        out.guard = guard

    def every(args: dict) -> dict:
        return dict.fromkeys(store.catalog.specs)

    def one(table: str, *columns: str) -> Callable[[dict], dict]:
        return lambda args: {args[table]: [str(args[c]) for c in columns if args.get(c)]}

    def of_specs(specs) -> dict:
        found = dict.fromkeys(s.name for s in specs)
        return {**{k.references: [k.ref_column] for s in specs for k in s.foreign_keys if k.references not in found}, **found}

    def own(table: str, fields: list[str] = ()):
        if policy:
            policy.check_fields(store.catalog, table, [], list(fields), role)
        return store.catalog.table(table)

    def select(table, conditions=None, query=""):
        from millrace.plans.conditions import filtered

        df = filtered(own(table, fields_of(conditions)), conditions, names=store.catalog.specs[table].resolve)
        return selections.save(df.drop(*(policy.hidden(table, role) - {"id"})) if policy else df, table, "id", query)

    def listed(number=None):
        found = [s for s in selections.saved if number in (None, s["number"])]
        if policy is None:
            return found
        specs = store.catalog.specs
        found = [s for s in found if policy.allows(s["table"], specs[s["table"]].source if s["table"] in specs else "main", role)]
        return [{**s, "sample": [{k: v for k, v in x.items() if k not in policy.hidden(s["table"], role)} for x in s["sample"]]} for s in found]

    def chosen(number: int):
        entry = next((s for s in selections.saved if s["number"] == number), None)
        if entry is None:
            raise ValueError(f"no selection {number}")
        return entry["table"], [r[0] for r in selections.spark.read.parquet(entry["path"]).limit(10_001).collect()]

    def edit(selection, values):
        table, ids = chosen(selection)
        values = parsed(values)
        own(table, list(values))
        store.update(table, [{"field": "id", "op": "IN", "value": ids}], values)
        return len(ids)

    def delete(selection):
        table, ids = chosen(selection)
        own(table)
        store.delete(table, [{"field": "id", "op": "IN", "value": ids}])
        return len(ids)

    def insert(table, data):
        rows = parsed(data)
        own(table, [c for r in ([rows] if isinstance(rows, dict) else rows) for c in r])
        return store.insert(table, rows)

    def export(path, table=None, selection=None, kind="csv", fields="*"):
        df = own(table, _words(fields)) if table else None
        if selection is not None:
            name, _ = chosen(selection)
            df = selections.rows(selection, own(name, _words(fields)))
        if df is None:
            raise ValueError("a table or a selection is exported")
        hidden = policy.hidden(table or name, role) if policy else set()
        df = projected(df.drop(*hidden), fields, store.catalog.specs[table or name].resolve)
        return {"csv": sinks.csv, "xlsx": sinks.sheet}[kind](df, path)

    def documents(words, query, k=5):
        if vectors is None:
            raise ValueError("no vectors")
        return retrieval.hybrid(vectors, query, words, k)

    def index(table, column, unique=True):
        if not unique:
            raise ValueError("only unique indexes mean something here")
        store.set_unique(table, column)

    def made(definitions):
        specs = [parsed_definition(n, text) for n, text in parsed(definitions).items()]
        return store.create(specs)

    def changes(name, run, params, required=None, risk="write", tags=("schema",), touches=None):
        out.add(Tool(name, run, params, tuple(required if required is not None else params), risk, tags, touches))

    defined = lambda args: of_specs([parsed_definition(n, d) for n, d in parsed(args["definitions"]).items()])
    saved = lambda args: of_specs(templates.get(args["name"], []))

    text, rows = str, ("rows",)
    changes("insert_data", insert, {"table": text, "data": object}, tags=rows)
    changes("batch_insert_data", insert, {"table": text, "data": object}, tags=rows)
    changes("select_data", select, {"table": text, "conditions": object, "query": text}, ["table"], "read", rows)
    changes("list_selections", listed, {"number": int}, [], "read", rows)
    changes("edit_data", edit, {"selection": int, "values": object}, tags=rows)
    changes("delete_data", delete, {"selection": int}, risk="danger", tags=rows)
    changes("mutate_data", lambda action, selection, values=None: edit(selection, values) if action == "update" else delete(selection), {"action": text, "selection": int, "values": object}, ["action", "selection"], "danger", rows)
    changes("batch_create_tables", made, {"definitions": object}, touches=defined)
    changes("create_standard_tables", lambda: store.create_standard(list(standard)), {}, touches=lambda args: of_specs(standard))
    changes("repair_tables", lambda: store.repair(list(standard)), {}, touches=lambda args: of_specs(standard))
    changes("drop_table", store.drop_table, {"name": text}, risk="danger", touches=lambda args: {args["name"]: None})
    changes("add_column", lambda table, column, type="TEXT", default=None: store.add_column(table, ColumnSpec(column, type, rules={"default": default} if default is not None else {})), {"table": text, "column": text, "type": text, "default": text}, ["table", "column"], touches=one("table", "column"))
    changes("drop_column", store.drop_column, {"name": text, "column": text, "force": bool}, ["name", "column"], "danger", touches=one("name", "column"))
    changes("modify_column", store.modify_type, {"name": text, "column": text, "new": text, "force": bool}, ["name", "column", "new"], touches=one("name", "column"))
    changes("alter_precision", store.alter_precision, {"name": text, "column": text, "new": text, "force": bool}, ["name", "column", "new"], touches=one("name", "column"))
    changes("set_not_null", store.set_not_null, {"name": text, "column": text}, touches=one("name", "column"))
    changes("add_foreign_key", lambda table, column, references: store.add_foreign_key(table, ForeignKey(column, references, "id")), {"table": text, "column": text, "references": text}, touches=lambda args: {args["references"]: ["id"], args["table"]: [args["column"]]})
    changes("drop_foreign_key", store.drop_foreign_key, {"name": text, "column": text}, touches=one("name", "column"))
    changes("create_index", index, {"table": text, "column": text, "unique": bool}, ["table", "column"], touches=one("table", "column"))
    changes("drop_index", store.drop_unique, {"name": text, "column": text}, touches=one("name", "column"))
    changes("save_template", lambda name: templates.update({name: list(store.catalog.specs.values())}), {"name": text}, touches=every)
    changes("list_templates", lambda: sorted(templates), {}, risk="read")
    changes("import_template", lambda name: store.create_standard(templates[name]), {"name": text}, touches=saved)
    changes("drop_template", lambda name: templates.pop(name, None) is not None, {"name": text})
    changes("clear_db", lambda drop=False: store.clear(drop), {"drop": bool}, [], "danger", touches=every)
    changes("backup_database", lambda keep=7: store.backup(keep), {"keep": int}, [], touches=every)
    changes("restore_database", store.restore, {"number": int}, risk="danger", touches=every)
    changes("process_file", lambda path, pattern="*": files.units(store.spark, path, pattern), {"path": text, "pattern": text}, ["path"], "read", ("files",))
    changes("search_files", lambda path, words, pattern="*": files.search(store.spark, path, words, pattern), {"path": text, "words": text, "pattern": text}, ["path", "words"], "read", ("files",))
    changes("search_documents", documents, {"words": text, "query": list, "k": int}, ["words", "query"], "read", ("files",))
    changes("list_vector_collections", lambda: retrieval.collections(vectors), {}, risk="read", tags=("files",))
    changes("export_data", export, {"path": text, "table": text, "selection": int, "kind": text, "fields": object}, ["path"], "write", ("files",))
    return out
