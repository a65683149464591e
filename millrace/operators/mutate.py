"""Changes to stored tables as new folders behind one manifest.

A table is a list of folders that no change touches: rows that were added, and ids of rows that are gone from the
folders before it. An insert adds a folder of its rows, an update or delete one of ids, and no old row is written
again; :meth:`Store.vacuum` folds a table into one folder. A change writes its folders, and then one manifest that names
each table's folders and declaration. Undoing is naming the earlier folders and declarations again.

One session at a time changes a store. It claims the next manifest's number by creating a file that nobody else can
create, and keeps the claim alive by touching it. What it is about to write is noted in a journal. Opening a store
never touches a live session's change. Only when a claim hasn't been touched for ``patience`` seconds is it taken
over: the change is finished if all its folders are complete; else the number is used up by a manifest without it, so
that its owner, should it still live, can't publish it any more, and only then its folders go.

What is inserted or updated must meet its table's declaration: types (texts are cleaned first), values that must be
there, row rules and checks, unique columns, and keys with parents. A change that breaks one is refused as a whole.
Keys act as declared: a row that others point to is deleted only if they go too (CASCADE), let go of it (SET NULL), or
are deleted by the same change; a referenced value that changes takes its children along (CASCADE) or stays (RESTRICT).
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.quality import change_risk, compatibility, guarded, narrow_risk, orphans, typed, violations
from millrace.plans.catalog import Catalog, ColumnSpec, ForeignKey, TableSpec, family, renamed, spark_type
from millrace.sources.places import shared_folder

MOST_INSERTED, MOST_UPDATED, MOST_CONFIRMED = 1_000, 10_000, 100


class Refused(ValueError):
    """A change that a rule forbids; nothing was written."""


# what a change makes of a frame: plans, nothing is written


def with_ids(rows: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """New rows numbered on from the largest id there is; rows are few by the insert limit."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    order = Window.orderBy(*[F.col(c).asc_nulls_first() for c in rows.columns])
    return rows.withColumn(key, F.lit(top) + F.row_number().over(order))


def upserted(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows whose key ``rows`` has replaced by them, and the new ones added."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def updated(table: DataFrame, where: Column, values: dict) -> DataFrame:
    out = [F.when(where, F.lit(values[c]).cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns]
    return table.select(*out)


def deleted(table: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition isn't true; an unknown condition deletes nothing."""
    return table.where(~F.coalesce(where, F.lit(False)))


def conflicts(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return rows.join(table.select(key), key, "left_semi")


def impact(catalog: Catalog, name: str, where: Column) -> dict:
    """How many rows a change touches, two of them, and how many rows of other tables point at them."""
    df = catalog.table(name)
    hit = df.where(where)
    references = {}
    for e in catalog.edges():
        if e.right == name:
            other = catalog.table(e.left)
            references[e.left] = other.join(hit.select(F.col(e.right_column).alias("__key")).distinct(), F.col(e.left_column) == F.col("__key"), "left_semi").count()
    return {"affected": hit.count(), "total": df.count(), "sample": [r.asDict() for r in hit.limit(2).collect()], "references": references}


# stored tables


def as_json(spec: TableSpec) -> dict:
    return asdict(spec)


def of_json(held: dict) -> TableSpec:
    columns = tuple(ColumnSpec(**c) for c in held["columns"])
    return TableSpec(**{**held, "columns": columns, "foreign_keys": tuple(ForeignKey(**k) for k in held["foreign_keys"]), "aliases": tuple(map(tuple, held["aliases"]))})


def folders(table: str | list[dict]) -> list[dict]:
    """A manifest's entry for a table as its folders in order; an older manifest names one folder."""
    return [{"rows": table}] if isinstance(table, str) else table


class Folder:
    """A folder's small files, each written whole by whoever comes first, and never replaced."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, start: str) -> list[str]:
        fs, p = self._fs(self.folder)
        if not fs.exists(p):
            return []
        return sorted(n for f in fs.listStatus(p) if (n := f.getPath().getName()).startswith(start) and n.endswith(".json"))

    def _get(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0])

    def _local(self, p):
        """The same place for java.nio, if it is on a local file system; that of Hadoop can't create exclusively."""
        return self.spark._jvm.java.nio.file.Paths.get(p.toUri()) if p.toUri().getScheme() == "file" else None

    def _exclusive(self, name: str) -> bool:
        """Create an empty file; whether it wasn't there."""
        fs, p = self._fs(f"{self.folder}/{name}")
        fs.mkdirs(p.getParent())
        nio = self.spark._jvm.java.nio.file
        try:
            if (own := self._local(p)) is not None:
                nio.Files.createFile(own, self.spark.sparkContext._gateway.new_array(nio.attribute.FileAttribute, 0))
            else:
                fs.create(p, False).close()
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            return False
        return True

    def _put(self, name: str, held: dict) -> None:
        """A whole file or none: it is written aside, then linked or renamed, and never replaces another."""
        fs, aside = self._fs(f"{self.folder}/.{name}-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        _, p = self._fs(f"{self.folder}/{name}")
        try:
            if (own := self._local(p)) is not None:
                self.spark._jvm.java.nio.file.Files.createLink(own, self._local(aside))
                done = True
            else:
                done = not fs.exists(p) and fs.rename(aside, p)
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            done = False
        if fs.exists(aside):
            fs.delete(aside, False)
        if not done:
            raise Refused(f"{name} exists: another session has been here first")

    def _drop(self, *paths: str) -> None:
        for path in paths:
            fs, p = self._fs(path)
            fs.delete(p, True)


class Store(Folder):
    """Snapshots of a catalog's tables under one folder, which may have been written by an earlier session."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 7, patience: float = 60):
        super().__init__(spark, folder)
        self.keep, self.patience = keep, patience
        self.catalog = Catalog(spark)
        self.number = -1
        self.current: dict[str, str | list[dict]] = {}
        self._claim: str | None = None
        self._by: str | None = None
        self._open()

    # claims

    def _claims(self, number: int) -> list[str]:
        """Claims on a manifest's number, the latest last."""
        return self._names(f"claim-{number:08d}-")

    def _alive(self, name: str) -> bool:
        """Whether a claim has been touched lately, by the clock of the file system that keeps it."""
        fs, p = self._fs(f"{self.folder}/{name}")
        probe = f".now-{uuid.uuid4().hex}"
        self._exclusive(probe)
        _, now = self._fs(f"{self.folder}/{probe}")
        try:
            age = fs.getFileStatus(now).getModificationTime() - fs.getFileStatus(p).getModificationTime()
        except Exception as e:
            if "FileNotFound" not in str(e):
                raise
            return False  # let go of meanwhile
        finally:
            fs.delete(now, False)
        return age < 1000 * self.patience

    def _owned(self) -> bool:
        """Whether nobody has taken this session's claim over."""
        return self._claim is not None and self._claims(int(self._claim.split("-")[1]))[-1:] == [self._claim]

    @contextmanager
    def _claimed(self) -> Iterator[None]:
        """The right to write the next manifest, kept alive meanwhile."""
        if self._claim:
            yield
            return
        number = self.number + 1
        before = self._claims(number)
        if before and self._alive(before[-1]):
            raise Refused("another session is changing the store")
        if self._names("manifest-")[-1:] > [f"manifest-{self.number:08d}.json"]:
            raise Refused("another session has changed the store")
        epoch = 1 + max((int(n.split("-")[2][:4]) for n in before), default=0)
        name = f"claim-{number:08d}-{epoch:04d}.json"
        if not self._exclusive(name):
            raise Refused("another session is changing the store")
        self._claim, over = name, threading.Event()
        fs, p = self._fs(f"{self.folder}/{name}")

        def beat() -> None:
            while not over.wait(max(0.05, self.patience / 4)):
                try:
                    status = fs.getFileStatus(p)
                    fs.setTimes(p, max(self.spark._jvm.System.currentTimeMillis(), status.getModificationTime()), -1)
                except Exception:  # the claim was taken over, or the session ends: publishing will tell
                    return

        beating = threading.Thread(target=beat, daemon=True)
        beating.start()
        try:
            if before:
                self._take_over(number)
            yield
        finally:
            over.set()
            beating.join()
            self._claim = None
            self._drop(*[f"{self.folder}/{n}" for n in self._claims(number) if n <= name])

    def _take_over(self, number: int) -> None:
        """Finish what a dead session left of a change, or fence it off and clear it."""
        for name in self._names(f"journal-{number:08d}"):
            note = self._get(name)
            whole = all(fs.exists(p) for fs, p in (self._fs(f"{x}/_SUCCESS") for x in note["new"]))
            if whole:
                self._publish(note["tables"], {n: of_json(x) for n, x in note["specs"].items()}, note.get("by"))
            else:
                self._publish(self.current, dict(self.catalog.specs), note.get("by"))
                self._drop(*note["new"])
            self._drop(f"{self.folder}/{name}")
            self.recovered[name] = "committed" if whole else "compensated"

    # manifests

    def _open(self) -> None:
        """Take the newest manifest's state, and finish or clear what dead sessions have left."""
        self.recovered: dict[str, str] = {}
        names = self._names("manifest-")
        for i, name in enumerate(reversed(names)):
            held = self._get(name)
            try:
                self._take(held)
            except AnalysisException as e:  # a folder is gone: what was there before still opens
                if i + 1 == len(names):
                    raise
                self.recovered[name] = str(e).splitlines()[0]
                continue
            self.number = int(names[-1][9:17])
            break
        for name in self._names("journal-"):
            self._recover(name)

    def _recover(self, name: str) -> None:
        number = int(name[8:16])
        claims = self._claims(number)
        if claims and self._alive(claims[-1]):
            self.recovered[name] = "running"
            return
        try:
            note = self._get(name)
        except AnalysisException:
            return  # its session has just ended it
        if number <= self.number:
            # the number went to this change or to another one: what no manifest names is left over
            named = {x for held in self.history() for t in held["tables"].values() for f in folders(t) for x in f.values()}
            self._drop(*[x for x in note["new"] if x not in named], f"{self.folder}/{name}", *[f"{self.folder}/{n}" for n in claims])
            self.recovered[name] = "committed" if set(note["new"]) <= named else "compensated"
        elif claims:
            try:
                with self._claimed():
                    pass
            except Refused:
                self.recovered[name] = "running"
        else:  # nobody holds a claim any more, so nobody can publish it
            whole = number == self.number + 1 and all(fs.exists(p) for fs, p in (self._fs(f"{x}/_SUCCESS") for x in note["new"]))
            if whole:
                with self._claimed():
                    self._publish(note["tables"], {n: of_json(x) for n, x in note["specs"].items()}, note.get("by"))
            else:
                self._drop(*note["new"])
            self._drop(f"{self.folder}/{name}")
            self.recovered[name] = "committed" if whole else "compensated"

    def _read(self, table: str | list[dict]) -> DataFrame:
        """A table's rows: those of its folders whose ids no later folder takes away."""
        parts = folders(table)
        rows = [(i, f["rows"]) for i, f in enumerate(parts) if "rows" in f]
        gone = [(i, f["gone"]) for i, f in enumerate(parts) if "gone" in f]
        schema = self.spark.read.parquet(rows[0][1]).schema
        if not gone:
            return self.spark.read.schema(schema).parquet(*[p for _, p in rows])
        untouched = [p for i, p in rows if i > gone[-1][0]]
        touched = [self.spark.read.schema(schema).parquet(p).withColumn("__at", F.lit(i)) for i, p in rows if i < gone[-1][0]]
        ids = reduce(DataFrame.unionByName, [self.spark.read.parquet(p).select(F.col("id").alias("__id"), F.lit(i).alias("__to")) for i, p in gone])
        left = reduce(DataFrame.unionByName, touched)
        left = left.join(ids, (F.col("id") == F.col("__id")) & (F.col("__to") > F.col("__at")), "left_anti").drop("__at")
        return left.unionByName(self.spark.read.schema(schema).parquet(*untouched)) if untouched else left

    def _take(self, held: dict) -> None:
        frames = {n: self._read(p) for n, p in held["tables"].items()}
        self.number, self.current = held["number"], held["tables"]
        self.catalog = Catalog(self.spark)
        for spec in held["specs"].values():
            self.catalog.declare(of_json(spec))
        self.catalog.frames = frames

    def _publish(self, tables: dict[str, str | list[dict]], specs: dict[str, TableSpec], by: str | None = None) -> None:
        held = {"number": self.number + 1, "tables": tables, "specs": {n: as_json(x) for n, x in specs.items()}, "by": by or self._by}
        if not self._owned():
            raise Refused("another session has taken this change over")
        self._put(f"manifest-{held['number']:08d}.json", held)
        self._take(held)

    @contextmanager
    def signed(self, change: str) -> Iterator[None]:
        """Manifests that are written meanwhile name a change that spans several places."""
        self._by = change
        try:
            yield
        finally:
            self._by = None

    def history(self) -> list[dict]:
        """The manifests that are still there, the oldest first."""
        return [self._get(n) for n in self._names("manifest-")]

    def write(self, frames: dict[str, DataFrame], specs: dict[str, TableSpec | None] | None = None, added: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None) -> None:
        """New snapshots of several tables, rows added to some, ids gone from some, and changed declarations.

        All are written, then all become current together. Of a table, ids go first and then rows are added.
        """
        planned = [(n, "gone", df) for n, df in (gone or {}).items()] + [(n, "rows", df) for n, df in {**frames, **(added or {})}.items()]
        new = [(n, kind, f"{self.folder}/{n}-{uuid.uuid4().hex}", df) for n, kind, df in planned]
        with self._claimed():
            declared = {n: x for n, x in {**self.catalog.specs, **(specs or {})}.items() if x is not None}
            tables = {n: [] if n in frames else list(folders(self.current.get(n, []))) for n in {**self.current, **{n: 0 for n, *_ in new}}}
            for name, kind, path, _ in new:
                tables[name].append({kind: path})
            tables = {n: p for n, p in tables.items() if n in declared or n in frames}
            note = f"journal-{self.number + 1:08d}.json"
            paths = [path for _, _, path, _ in new]
            self._put(note, {"number": self.number + 1, "new": paths, "tables": tables, "specs": {n: as_json(x) for n, x in declared.items()}, "by": self._by})
            try:
                for _, _, path, df in new:
                    df.write.parquet(path)
                self._publish(tables, declared)
            except Exception:
                if self._owned():  # else whoever took over decides on the folders
                    self._drop(*paths, f"{self.folder}/{note}")
                raise
            self._drop(f"{self.folder}/{note}")

    def undo(self) -> None:
        """Tables and declarations as they were before the last change."""
        held = self.history()
        if len(held) < 2:
            raise Refused("nothing to undo")
        with self._claimed():
            self._publish(held[-2]["tables"], {n: of_json(x) for n, x in held[-2]["specs"].items()})

    def vacuum(self, most: int = 16) -> int:
        """Fold tables of more than ``most`` folders into one, forget all manifests but the newest ``keep``, and delete
        the folders that only they name; how many."""
        if many := [n for n, t in self.current.items() if len(folders(t)) > most]:
            self.write({n: self.catalog.frames[n] for n in many})
        held = self.history()
        old, kept = held[: -self.keep], held[-self.keep :]
        named = [{x for m in some for t in m["tables"].values() for f in folders(t) for x in f.values()} for some in (old, kept)]
        gone = named[0] - named[1]
        self._drop(*[f"{self.folder}/manifest-{x['number']:08d}.json" for x in old], *gone)
        return len(gone)

    # backups

    def backup(self, keep: int = 7) -> int:
        """Copy the current tables and declarations aside, keep the newest ``keep`` backups; the backup's number."""
        numbers = [int(n[7:15]) for n in self._names("backup-")]
        number = 1 + max(numbers, default=0)
        folder = f"{self.folder}/backup-{number:08d}"
        for name, df in self.catalog.frames.items():
            df.write.parquet(f"{folder}/{name}")
        self._put(f"backup-{number:08d}.json", {"tables": {n: f"{folder}/{n}" for n in self.catalog.frames}, "specs": {n: as_json(x) for n, x in self.catalog.specs.items()}})
        for old in sorted([*numbers, number])[:-keep]:
            self._drop(f"{self.folder}/backup-{old:08d}", f"{self.folder}/backup-{old:08d}.json")
        return number

    def restore(self, number: int) -> None:
        """The tables and declarations of a backup, as new snapshots; the change can be undone."""
        name = f"backup-{number:08d}.json"
        if name not in self._names("backup-"):
            raise Refused(f"no backup {number}")
        held = self._get(name)
        specs = {n: of_json(x) for n, x in held["specs"].items()}
        self.write({n: self.spark.read.parquet(p) for n, p in held["tables"].items()}, {**dict.fromkeys(self.catalog.specs), **specs})

    # maintenance

    def _empty(self, spec: TableSpec) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"`{c.name}` {spark_type(c.type)}" for c in spec.columns))

    def repair(self, specs: list[TableSpec], drop_extra: bool = False) -> list[tuple[str, str]]:
        """Make tables be as declared: missing ones and columns are added empty, other types cast where all values convert."""
        done, frames = [], {}
        for s in specs:
            df = self.catalog.frames.get(s.name)
            if df is None:
                frames[s.name] = self._empty(s)
                done.append(("create_table", s.name))
                continue
            out = []
            for c in s.columns:
                want = spark_type(c.type)
                if c.name not in df.columns:
                    out.append(F.lit(None).cast(want).alias(c.name))
                    done.append(("add_column", f"{s.name}.{c.name}"))
                elif family(df.schema[c.name].dataType.simpleString()) != family(c.type):
                    if df.where(F.col(c.name).isNotNull() & F.col(c.name).try_cast(want).isNull()).limit(1).count():
                        raise Refused(f"{s.name}.{c.name} has values that aren't {c.type}")
                    out.append(F.col(c.name).try_cast(want).alias(c.name))
                    done.append(("modify_type", f"{s.name}.{c.name}"))
                else:
                    out.append(F.col(c.name))
            extra = [c for c in df.columns if not s.column(c)]
            if drop_extra:
                done += [("drop_column", f"{s.name}.{c}") for c in extra]
            if len(done) and (done[-1][1].partition(".")[0] == s.name):
                frames[s.name] = df.select(*out, *([] if drop_extra else extra))
        if frames:
            self.write(frames, {s.name: s for s in specs})
        return done

    def create_standard(self, specs: list[TableSpec]) -> list[str]:
        """Those of the declared tables that aren't there yet, referenced ones first."""
        missing = [s for s in specs if s.name not in self.catalog.specs]
        return self.create(missing) if missing else []

    def clear(self, drop: bool = False) -> None:
        """Empty all tables, or drop them all, in one change."""
        if drop:
            self.write({}, dict.fromkeys(self.catalog.specs))
        else:
            self.write({n: df.limit(0) for n, df in self.catalog.frames.items()})

    def create(self, specs: list[TableSpec]) -> list[str]:
        """Empty tables, referenced ones first. Each gets an id; a declared primary key becomes unique and not null."""
        fresh = {}
        for s in specs:
            if s.name in self.catalog.specs:
                raise Refused(f"{s.name} exists")
            columns = tuple(replace(c, pk=False, unique=True, not_null=True) if c.pk and c.name != "id" else c for c in s.columns if c.name != "id")
            fresh[s.name] = replace(s, columns=(ColumnSpec("id", "BIGINT", pk=True, unique=True, not_null=True), *columns))
        planned = Catalog(self.spark, [*self.catalog.specs.values(), *fresh.values()])
        order = planned.ordered(list(fresh))
        self.write({n: self._empty(fresh[n]) for n in order}, fresh)
        return order

    def _refuse_broken(self, spec: TableSpec, rows: DataFrame, others: DataFrame) -> None:
        """Refuse ``rows``, which are to stand beside ``others``, if one breaks the declaration."""
        if nulls := [c.name for c in spec.columns if c.not_null and rows.where(F.col(c.name).isNull()).limit(1).count()]:
            raise Refused(f"no value for {', '.join(nulls)}")
        rules = {c.name: own for c in spec.columns if (own := {k: v for k, v in c.rules.items() if k in ("min", "max", "pattern", "enum")})}
        if rules and (broken := violations(rows.withColumn("__row", F.lit(0)), rules, "__row").first()):
            raise Refused(f"{broken['column']} breaks its rule {broken['rule']}")
        names = {c.name for c in spec.columns}
        for c in spec.columns:
            if "check" in c.rules and rows.where(~F.expr(guarded(c.rules["check"], names))).limit(1).count():
                raise Refused(f"{c.name} fails its check")
        for c in spec.columns:
            if c.unique and not c.pk:
                if rows.where(F.col(c.name).isNotNull()).groupBy(c.name).count().where("count > 1").limit(1).count():
                    raise Refused(f"{c.name} repeats")
                if conflicts(others, rows, c.name).limit(1).count():
                    raise Refused(f"{c.name} is taken")
        for k in spec.foreign_keys:
            parents = self.catalog.frames.get(k.references)
            if parents is not None and orphans(rows, k.column, parents, k.ref_column).limit(1).count():
                raise Refused(f"{k.column} has values without a parent")

    def _held(self, rows: DataFrame) -> DataFrame:
        """At most the rows that a call may bring, fixed: whatever computes them is asked once."""
        held = rows.limit(MOST_INSERTED + 1).collect()
        if len(held) > MOST_INSERTED:
            raise Refused(f"at most {MOST_INSERTED} rows at a time")
        return self.spark.createDataFrame(held, rows.schema)

    def _typed(self, spec: TableSpec, rows: DataFrame, schema) -> DataFrame:
        """Cleaned rows at their table's types; values that can't be are refused by name."""
        own = replace(spec, columns=tuple(replace(c, not_null=False) for c in spec.columns))
        out = typed(rows, own)
        if bad := out.where(F.size("bad") > 0).select(F.explode("bad").alias("c")).distinct().orderBy("c").collect():
            raise Refused(f"values that don't fit: {', '.join(r['c'] for r in bad)}")
        cast = out.select(*[F.col(c).try_cast(schema[c].dataType).alias(c) for c in rows.columns], *[F.col(c).alias(f"__{c}") for c in rows.columns])
        lost = [c for c in rows.columns if cast.where(F.col(c).isNull() & F.col(f"__{c}").isNotNull()).limit(1).count()]
        if lost:
            raise Refused(f"values that don't fit: {', '.join(lost)}")
        return cast.select(*rows.columns)

    def insert(self, name: str, rows: DataFrame | list[dict] | dict | str, overwrite: bool = False) -> list[int]:
        """Add rows (or dicts of them, or these as JSON), which may not bring ids; the ids they get.

        A unique value that is there refuses them all, unless they overwrite: then they take the places of all rows
        that share one with them.
        """
        spec, table = self.catalog.specs[name], self.catalog.table(name)
        rows = self._held(rows if isinstance(rows, DataFrame) else self._frame(rows))
        if "id" in rows.columns:
            raise Refused("ids are given by the system")
        if unknown := [c for c in rows.columns if not spec.column(c)]:
            raise Refused(f"{name} has no column {', '.join(unknown)}")
        rows = self._typed(spec, rows, table.schema)
        for c in spec.columns:
            if c.name not in rows.columns:
                rows = rows.withColumn(c.name, F.lit(c.rules.get("default")).try_cast(table.schema[c.name].dataType))
        others = table
        if overwrite:
            for c in spec.columns:
                if c.unique and not c.pk:
                    others = others.join(rows.select(c.name), c.name, "left_anti")
        rows = self._held(with_ids(rows.drop("id"), table).select(*table.columns))
        self._refuse_broken(spec, rows, others)
        replaced = table.join(others.select("id"), "id", "left_anti").select("id") if overwrite else None
        self._change({name: replaced} if overwrite else {}, {name: rows})
        return [r["id"] for r in rows.select("id").orderBy("id").collect()]

    def _frame(self, rows: list[dict] | dict | str) -> DataFrame:
        from millrace.plans.conditions import parsed

        rows = parsed(rows)
        rows = [rows] if isinstance(rows, dict) else list(rows)
        if not rows or not all(isinstance(r, dict) and r for r in rows):
            raise Refused("rows are objects with columns")
        names = list(dict.fromkeys(c for r in rows for c in r))
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v) if isinstance(v, bool | list | dict) else str(v)
        return self.spark.createDataFrame([tuple(text(r.get(c)) for c in names) for r in rows], ", ".join(f"`{c}` string" for c in names))

    def _guard(self, name: str, conditions: list, most: int) -> Column:
        """A condition that names a key in each of its alternatives, over a bounded number of rows."""
        from millrace.plans.conditions import folded, normalised

        spec, table = self.catalog.specs[name], self.catalog.table(name)
        runs: list[list[str]] = []
        for i, c in enumerate(normalised(conditions)):
            if i == 0 or c.link == "OR":
                runs.append([])
            runs[-1].append(c.field)
        keys = {"id"} | {c.name for c in spec.columns if c.unique}
        if not runs or not all(keys & set(run) for run in runs):
            raise Refused("a change names an id or another unique column")
        where = folded(table, conditions)
        if table.where(where).limit(most + 1).count() > most:
            raise Refused(f"more than {most} rows")
        return where

    def update(self, name: str, conditions: list, values: dict) -> None:
        """Set values in rows that the conditions name; the rows must then meet the declaration."""
        if "id" in values:
            raise Refused("ids stay")
        spec, table = self.catalog.specs[name], self.catalog.table(name)
        if unknown := [c for c in values if not spec.column(c)]:
            raise Refused(f"{name} has no column {', '.join(unknown)}")
        where = self._guard(name, conditions, MOST_UPDATED)
        values = {c: self._value(spec, c, v, table) for c, v in values.items()}
        hit = F.coalesce(where, F.lit(False))
        rows = updated(table.where(hit), F.lit(True), values)
        self._refuse_broken(spec, rows, table.where(~hit))
        if "id" not in table.columns:
            self._unheld(name, table.where(hit), list(values))
            self.write({name: updated(table, where, values)})
            return
        gone, added = {name: table.where(hit).select("id")}, {name: rows}
        for column, value in values.items():
            moved = table.where(hit & F.col(column).isNotNull() & ~F.col(column).eqNullSafe(F.lit(value)))
            self._follow(name, moved.select(F.col(column).alias("__old"), F.lit(value).cast(table.schema[column].dataType).alias("__new")), column, gone, added)
        self._change(gone, added)

    def _unheld(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> None:
        """Refuse to change rows of a table without ids, in the columns named, if others point to them."""
        for child, k in self._children(name):
            if columns is None or k.ref_column in columns:
                keys = rows.select(F.col(k.ref_column).alias("__key"))
                if self.catalog.table(child).join(keys, F.col(k.column) == F.col("__key"), "left_semi").limit(1).count():
                    raise Refused(f"{child}.{k.column} points to rows of {name}")

    def _children(self, name: str, column: str | None = None) -> list[tuple[str, ForeignKey]]:
        """Keys of all tables that point to a table, or to a column of it."""
        return [(s.name, k) for s in self.catalog.specs.values() for k in s.foreign_keys if k.references == name and column in (None, k.ref_column) and s.name in self.catalog.frames]

    def _follow(self, name: str, moved: DataFrame, column: str, gone: dict, added: dict) -> None:
        """Give children the new values of the keys they hold, and theirs in turn; ``moved`` has old and new values."""
        for child, k in self._children(name, column):
            table = self.catalog.table(child)
            # the child as this change leaves it so far
            rows = table.join(gone[child], "id", "left_anti").select(*table.columns).unionByName(added[child].select(*table.columns)) if child in added else table
            met = rows.join(moved, F.col(k.column) == F.col("__old"))
            if not met.limit(1).count():
                continue
            if k.on_update != "CASCADE":
                raise Refused(f"{child}.{k.column} holds what {name}.{column} would lose")
            fresh = met.select(*[F.col("__new").cast(table.schema[c].dataType).alias(c) if c == k.column else F.col(c) for c in table.columns])
            rest = [added[child].join(met.select("id"), "id", "left_anti").select(*table.columns)] if child in added else []
            gone[child] = gone[child].union(met.select("id")) if child in gone else met.select("id")
            added[child] = reduce(DataFrame.unionByName, [*rest, fresh])
            self._follow(child, met.select("__old", "__new"), k.column, gone, added)

    def _change(self, gone: dict[str, DataFrame], added: dict[str, DataFrame]) -> None:
        """Take rows away by id and add others, in one commit over all their tables."""
        self.write({}, None, {n: df.select(*self.catalog.table(n).columns) for n, df in added.items()}, gone)

    def _value(self, spec: TableSpec, column: str, value, table: DataFrame):
        """A value as its column takes it: text is cleaned, and refused where it doesn't fit."""
        if not isinstance(value, str):
            return value
        one = self._typed(spec, self.spark.createDataFrame([(value,)], f"`{column}` string"), table.schema)
        return one.first()[0]

    def delete(self, name: str, conditions: list) -> dict[str, int]:
        """Delete rows that the conditions name, and what their keys' children take with them; rows gone by table.

        The closure goes level by level over the keys: children of the rows found last, by semi joins.
        """
        where = F.coalesce(self._guard(name, conditions, MOST_UPDATED), F.lit(False))
        if "id" not in self.catalog.table(name).columns:
            hit = self.catalog.table(name).where(where)
            self._unheld(name, hit)
            count = hit.count()
            self.write({name: deleted(self.catalog.table(name), where)})
            return {name: count}
        doomed = {name: self.catalog.table(name).where(where).select("id")}
        bare: dict[str, list[tuple[str, DataFrame]]] = {}
        restricted: list[tuple[str, ForeignKey, str, DataFrame]] = []
        level = dict(doomed)
        while level:
            found: dict[str, DataFrame] = {}
            for parent, ids in level.items():
                rows = self.catalog.table(parent).join(ids, "id", "left_semi")
                for child, k in self._children(parent):
                    table = self.catalog.table(child)
                    met = table.join(rows.select(F.col(k.ref_column).alias("__key")), F.col(k.column) == F.col("__key"), "left_semi").select("id")
                    if k.on_delete == "CASCADE":
                        met = met.join(doomed[child], "id", "left_anti") if child in doomed else met
                        found[child] = found[child].union(met).distinct() if child in found else met
                    elif k.on_delete == "SET NULL":
                        bare.setdefault(child, []).append((k.column, met))
                    else:
                        restricted.append((child, k, parent, met))
            level = {}
            for child, ids in found.items():
                ids = self._fixed(ids)
                if ids.limit(1).count():
                    level[child] = ids
                    doomed[child] = doomed[child].union(ids) if child in doomed else ids
        for child, k, parent, met in restricted:
            # children that this change deletes as well don't hold it up
            if (met.join(doomed[child], "id", "left_anti") if child in doomed else met).limit(1).count():
                raise Refused(f"{child}.{k.column} points to rows of {parent}")
        gone, added = dict(doomed), {}
        for child, columns in bare.items():
            table = self.catalog.table(child)
            rows = table
            for column, met in columns:
                rows = rows.join(met.select("id", F.lit(True).alias("__bare")), "id", "left").withColumn(column, F.when(F.col("__bare").isNull(), F.col(column))).drop("__bare")
            hit = reduce(DataFrame.union, [met for _, met in columns]).distinct()
            hit = hit.join(doomed[child], "id", "left_anti") if child in doomed else hit
            rows = rows.join(hit, "id", "left_semi").select(*table.columns)
            if any(self.catalog.specs[child].column(c).not_null for c, _ in columns) and hit.limit(1).count():
                raise Refused(f"{child} needs {', '.join(c for c, _ in columns)}")
            gone[child], added[child] = gone[child].union(hit) if child in gone else hit, rows
        counts = {n: df.count() for n, df in doomed.items()}
        self._change(gone, added)
        return counts

    def _fixed(self, ids: DataFrame) -> DataFrame:
        """Ids of a level, written down: the next level doesn't compute them again."""
        path = shared_folder(self.spark, "level")
        ids.write.parquet(path)
        return self.spark.read.schema(ids.schema).parquet(path)

    def change_confirmed(self, name: str, where: Column, change, confirm) -> int:
        """Apply ``change(table, where)`` to at most 100 rows, if ``confirm(sample)`` agrees; how many there were."""
        table = self.catalog.table(name)
        hit = table.where(where).limit(MOST_CONFIRMED + 1).collect()
        if len(hit) > MOST_CONFIRMED:
            raise Refused(f"more than {MOST_CONFIRMED} rows")
        if hit and confirm([r.asDict() for r in hit[:2]]):
            self.write({name: change(table, where)})
            return len(hit)
        return 0

    # changes of declarations

    def _declare(self, spec: TableSpec) -> None:
        """A changed declaration over the same rows."""
        self.write({}, {spec.name: spec})

    def drop_table(self, name: str) -> None:
        if users := [e.left for e in self.catalog.edges() if e.right == name and e.left != name]:
            raise Refused(f"{name} is referenced by {', '.join(users)}")
        self.write({}, {name: None})

    def _alter(self, name: str, spec: TableSpec, df: DataFrame) -> None:
        self.write({name: df}, {name: spec})

    def add_column(self, name: str, column: ColumnSpec) -> None:
        spec = self.catalog.specs[name]
        if family(column.type) == "other":
            raise Refused(f"unknown type {column.type}")
        if spec.column(column.name):
            raise Refused(f"{column.name} exists")
        fresh = F.lit(column.rules.get("default")).cast(spark_type(column.type))
        self._alter(name, replace(spec, columns=(*spec.columns, column)), self.catalog.table(name).withColumn(column.name, fresh))

    def drop_column(self, name: str, column: str, force: bool = False) -> None:
        spec = self.catalog.specs[name]
        if column == "id" or any(e.right == name and e.right_column == column for e in self.catalog.edges()):
            raise Refused(f"{column} is the id or referenced")
        if any(k.column == column for k in spec.foreign_keys) and not force:
            raise Refused(f"{column} is a foreign key")
        left = replace(spec, columns=tuple(c for c in spec.columns if c.name != column), foreign_keys=tuple(k for k in spec.foreign_keys if k.column != column))
        self._alter(name, left, self.catalog.table(name).drop(column))

    def modify_type(self, name: str, column: str, new: str, force: bool = False) -> None:
        """Cast a column; a change that may lose values needs force or a scan in which all of them convert."""
        spec, table = self.catalog.specs[name], self.catalog.table(name)
        own = spec.column(column)
        if any((e.left, e.left_column) == (name, column) or (e.right, e.right_column) == (name, column) for e in self.catalog.edges()):
            raise Refused(f"{column} takes part in a foreign key")
        risky = change_risk(own.type, new).needs_scan or family(own.type) == family(new) and narrow_risk(own.type, new)
        if risky and not force and compatibility(table, column, new).first()["ok_rate"] < 1:
            raise Refused(f"{column} has values that aren't {new}")
        columns = tuple(replace(c, type=new) if c.name == column else c for c in spec.columns)
        self._alter(name, replace(spec, columns=columns), table.withColumn(column, F.col(column).try_cast(spark_type(new))))

    def set_not_null(self, name: str, column: str) -> None:
        if self.catalog.table(name).where(F.col(column).isNull()).limit(1).count():
            raise Refused(f"{column} has nulls")
        spec = self.catalog.specs[name]
        self._declare(replace(spec, columns=tuple(replace(c, not_null=True) if c.name == column else c for c in spec.columns)))

    def set_unique(self, name: str, column: str) -> None:
        if self.catalog.table(name).where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").limit(1).count():
            raise Refused(f"{column} repeats")
        self._mark(name, column, True)

    def drop_unique(self, name: str, column: str) -> None:
        if column == "id":
            raise Refused("ids stay unique")
        self._mark(name, column, False)

    def _mark(self, name: str, column: str, unique: bool) -> None:
        spec = self.catalog.specs[name]
        if not spec.column(column):
            raise Refused(f"{name} has no column {column}")
        self._declare(replace(spec, columns=tuple(replace(c, unique=unique) if c.name == column else c for c in spec.columns)))

    def add_foreign_key(self, name: str, key: ForeignKey, force: bool = False) -> None:
        """Declare a key whose values all have parents; a missing column is added, empty."""
        target = self.catalog.specs[key.references].column(key.ref_column)
        if not self.catalog.specs[name].column(key.column):
            self.add_column(name, ColumnSpec(key.column, target.type))
        spec, table = self.catalog.specs[name], self.catalog.table(name)
        if family(spec.column(key.column).type) != family(target.type):
            raise Refused(f"{key.column} and {key.ref_column} differ in type")
        if not force and orphans(table, key.column, self.catalog.table(key.references), key.ref_column).limit(1).count():
            raise Refused(f"{key.column} has values without a parent")
        self._declare(replace(spec, foreign_keys=(*spec.foreign_keys, key)))

    def drop_foreign_key(self, name: str, column: str) -> None:
        """Forget a key; its column stays."""
        spec = self.catalog.specs[name]
        self._declare(replace(spec, foreign_keys=tuple(k for k in spec.foreign_keys if k.column != column)))

    def alter_precision(self, name: str, column: str, new: str, force: bool = False) -> None:
        """Another precision of the same family; a narrower one needs force or values that all fit."""
        if family(self.catalog.specs[name].column(column).type) != family(new):
            raise Refused(f"{new} is another type: modify it")
        self.modify_type(name, column, new, force)

    def rename(self, old: str, new: str) -> None:
        """Rename a table, and the references to it, over the same rows."""
        if new in self.catalog.specs:
            raise Refused(f"{new} exists")
        planned = Catalog(self.spark, list(self.catalog.specs.values()))
        renamed(planned, old, new)
        tables = {new if n == old else n: p for n, p in self.current.items()}
        with self._claimed():
            self._publish(tables, planned.specs)
