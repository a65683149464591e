"""Stores that are opened again, writes that are checked, backups, repair and the tools over them."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import mutate, reconcile
from millrace.plans.catalog import ColumnSpec, ForeignKey, TableSpec, catalog_inconsistencies, claims, mentioned
from millrace.plans.conditions import signals
from millrace.plans.policy import Policy
from millrace.plans.registry import of_catalog, of_store
from millrace.plans.selection import Selections

KINDS = TableSpec("kinds", (ColumnSpec("label", "TEXT", unique=True, not_null=True),))
ITEMS = TableSpec(
    "items",
    (ColumnSpec("code", "TEXT", "item code", unique=True), ColumnSpec("slot", "INTEGER", unique=True), ColumnSpec("price", "FLOAT", rules={"min": 0, "check": "price < 1000", "default": "5"}), ColumnSpec("kind_id", "BIGINT")),
    (ForeignKey("kind_id", "kinds", "id"),),
    aliases=(("cost", "price"),),
)


@pytest.fixture
def store(spark, tmp_path):
    out = mutate.Store(spark, f"file://{tmp_path}/store")
    out.create([ITEMS, KINDS])
    out.insert("kinds", [{"label": "a"}, {"label": "b"}])
    return out


def rows(store, name="items", *columns):
    df = store.catalog.table(name)
    return sorted(map(tuple, df.select(*(columns or [c for c in df.columns if c != "id"])).collect()), key=str)


def test_inserts_are_cleaned_checked_and_given_defaults(store):
    assert store.insert("items", '[{"code": "x", "slot": "１", "price": " ２.5 "}, {"code": "y", "slot": 2, "price": "—"}]') == [1, 2]
    assert rows(store) == [("x", 1, 2.5, None), ("y", 2, None, None)]
    store.insert("items", {"code": "z", "kind_id": 2})
    assert rows(store, "items", "code", "price")[2] == ("z", 5.0)
    bad = [{"code": "x"}, {"slot": 2}, {"price": -1}, {"price": 1000}, {"slot": "1.5"}, {"kind_id": 9}, {"other": 1}, {"id": 4}]
    for one in bad:
        with pytest.raises(mutate.Refused):
            store.insert("items", one)
    for broken in ("[]", "[1]", "{"):
        with pytest.raises(ValueError):
            store.insert("items", broken)
    with pytest.raises(mutate.Refused, match="repeats"):
        store.insert("items", [{"slot": 7}, {"slot": 7}])
    assert len(rows(store)) == 3


def test_a_source_that_changes_is_asked_once(store, spark):
    drawn = spark.range(20).select((F.rand() * 1e6).cast("int").alias("slot"))
    store.insert("items", drawn)
    assert len(rows(store)) == 20


def test_overwriting_takes_the_place_of_every_row_that_shares_a_unique_value(store):
    store.insert("items", [{"code": "a", "slot": 1}, {"code": "b", "slot": 2}, {"code": "c", "slot": 3}])
    store.insert("items", [{"code": "a", "slot": 2, "price": 9}], overwrite=True)
    assert rows(store, "items", "code", "slot", "price") == [("a", 2, 9.0), ("c", 3, 5.0)]


def test_updates_meet_the_declaration(store):
    store.insert("items", [{"code": "a", "slot": 1}, {"code": "b", "slot": 2}])
    store.update("items", [{"field": "code", "value": "a"}], {"price": "７", "kind_id": 1})
    assert rows(store, "items", "code", "price", "kind_id") == [("a", 7.0, 1), ("b", 5.0, None)]
    for values in ({"slot": 2}, {"price": -4}, {"kind_id": 77}, {"price": "dear"}, {"nothing": 1}):
        with pytest.raises(mutate.Refused):
            store.update("items", [{"field": "code", "value": "a"}], values)
    with pytest.raises(mutate.Refused, match="no value"):
        store.update("kinds", [{"field": "label", "value": "a"}], {"label": None})


def test_a_second_session_sees_and_goes_on(store, spark):
    store.insert("items", [{"code": "a"}])
    again = mutate.Store(spark, store.folder)
    assert rows(again) == rows(store) and again.catalog.specs == store.catalog.specs
    again.insert("items", [{"code": "b"}])
    with pytest.raises(mutate.Refused, match="another session"):
        store.insert("items", [{"code": "c"}])
    assert len(rows(mutate.Store(spark, store.folder))) == 2


def test_undo_brings_back_rows_and_declarations(store, spark):
    store.insert("items", [{"code": "a"}])
    store.add_column("items", ColumnSpec("note"))
    store.rename("items", "things")
    assert {e.left for e in store.catalog.edges()} == {"things"}
    store.undo()
    assert "items" in store.catalog.specs and store.catalog.specs["items"].column("note")
    store.vacuum()
    assert rows(mutate.Store(spark, store.folder), "items", "code") == [("a",)]


def test_vacuum_leaves_nothing_that_undo_could_name(spark, tmp_path):
    store = mutate.Store(spark, f"file://{tmp_path}/s", keep=2)
    for i in range(4):
        store.write({"t": spark.range(i + 1)}, {"t": TableSpec("t", (ColumnSpec("id", "BIGINT"),))})
    assert store.vacuum() == 2 and len(store.history()) == 2
    store.undo()
    assert store.catalog.table("t").count() == 3


def test_an_interrupted_change_is_finished_or_cleared(store, spark):
    spec = TableSpec("late", (ColumnSpec("id", "BIGINT"),))
    whole, half = f"{store.folder}/late-whole", f"{store.folder}/late-half"
    spark.range(3).write.parquet(whole)
    note = {"number": store.number + 1, "new": [whole], "tables": {**store.current, "late": whole}, "specs": {**{n: mutate.as_json(s) for n, s in store.catalog.specs.items()}, "late": mutate.as_json(spec)}}
    store._put(f"journal-{store.number + 1:08d}.json", note)
    again = mutate.Store(spark, store.folder)
    assert list(again.recovered.values()) == ["committed"] and again.catalog.table("late").count() == 3
    again._put(f"journal-{again.number + 1:08d}.json", {**note, "number": again.number + 1, "new": [half]})
    last = mutate.Store(spark, store.folder)
    assert list(last.recovered.values()) == ["compensated"] and last.number == again.number
    assert mutate.Store(spark, store.folder).recovered == {}


def test_backups_are_kept_and_restored(store, spark):
    store.insert("items", [{"code": "a"}])
    numbers = [store.backup(keep=2) for _ in range(3)]
    store.clear(drop=True)
    assert store.catalog.specs == {}
    with pytest.raises(mutate.Refused):
        store.restore(numbers[0])
    store.restore(numbers[-1])
    assert rows(store, "items", "code") == [("a",)] and store.catalog.specs["items"].foreign_keys


def test_repair_makes_tables_as_declared(spark, tmp_path):
    store = mutate.Store(spark, f"file://{tmp_path}/s")
    declared = TableSpec("t", (ColumnSpec("id", "BIGINT"), ColumnSpec("n", "INTEGER"), ColumnSpec("new", "DATE")))
    store.write({"t": spark.createDataFrame([(1, "7", "x")], "id long, n string, extra string")}, {"t": declared})
    done = store.repair([declared, TableSpec("u", (ColumnSpec("id", "BIGINT"),))], drop_extra=True)
    assert sorted(done) == [("add_column", "t.new"), ("create_table", "u"), ("drop_column", "t.extra"), ("modify_type", "t.n")]
    assert store.repair([declared]) == [] and rows(store, "t") == [(7, None)]
    store.write({"t": spark.createDataFrame([(1, "z")], "id long, n string")})
    with pytest.raises(mutate.Refused):
        store.repair([declared])


def test_tools_refuse_what_a_policy_hides(store):
    store.insert("items", [{"code": "a", "price": 3}])
    tools = of_catalog(lambda: store.catalog, Policy(denied_columns={"items": {"price"}}, roles={"guest": Policy(tables={"kinds": False})}), "guest")
    assert tools.call("query", table="items").data.rows.columns == ["id", "code", "slot", "kind_id"]
    denied = [
        ("query", dict(table="items", conditions=[{"field": "price", "op": ">", "value": 1}])), ("query", dict(table="items", conditions=[{"field": "cost", "op": ">", "value": 1}])),
        ("query", dict(table="items", key="price")), ("query", dict(table="items", fields="MAX(price) AS m")), ("aggregate_query", dict(table="items", function="SUM", column="price")),
        ("aggregate_query", dict(table="items", function="COUNT", by=["price"])), ("query", dict(table="kinds")), ("join_query", dict(main="items", tables=["kinds"])),
        ("join_query", dict(main="items", tables=[], conditions=[{"field": "items.code", "op": "=", "value": "items.price"}])), ("describe_schema", dict(table="kinds")),
    ]
    for name, args in denied:
        assert tools.call(name, **args).code == "denied", (name, args)
    assert [r["name"] for r in tools.call("describe_schema", table="items").data.collect()] == ["id", "code", "slot", "kind_id"]
    assert tools.call("aggregate_query", table="items", function="COUNT", conditions='[{"field": "item code", "value": "a"}]').data.first()[0] == 1


def test_tools_change_what_a_selection_names(store, spark, tmp_path):
    said = []
    tools = of_store(store, Selections(spark, f"file://{tmp_path}/sel"), standard=[ITEMS, KINDS], gate=lambda tool, args: said.append(tool.name) or tool.risk != "danger")
    assert tools.call("insert_data", table="items", data={"code": "a", "price": 3}).data == [1]
    assert tools.call("batch_insert_data", table="items", data='[{"code": "b"}, {"code": "c"}]').data == [2, 3]
    number = tools.call("select_data", table="items", conditions=[{"field": "cost", "op": "=", "value": "5"}]).data["number"]
    assert tools.call("edit_data", selection=number, values={"price": 8}).data == 2
    assert rows(store, "items", "code", "price") == [("a", 3.0), ("b", 8.0), ("c", 8.0)]
    assert tools.call("delete_data", selection=number).code == "denied" and "delete_data" in said
    path = f"file://{tmp_path}/out.csv"
    assert tools.call("export_data", path=path, selection=number, fields="code, cost").data == 2
    assert tools.call("export_data", path=path, table="items", fields="code, price").data == 3
    assert tools.call("create_index", table="items", column="price").code == "invalid"
    assert tools.call("batch_create_tables", definitions={"more": "name:TEXT:nn, kind_id:INTEGER:fk(kinds)"}).data == ["more"]
    assert tools.call("save_template", name="t").ok and tools.call("list_templates").data == ["t"] and tools.call("import_template", name="none").code == "unknown_name"
    assert tools.call("backup_database").data == 1 and tools.call("unknown").code == "unknown_tool"
    assert len(tools.tools) > 35


def test_verification_looks_at_every_id(spark):
    after = spark.range(5000).withColumn("v", F.col("id") % 7)
    ids = list(range(150))
    assert reconcile.verify_present(after, "id", ids) is True and reconcile.verify_present(after, "id", [*ids, 9999]) is False
    assert reconcile.verify_deleted(after, "id", [*range(5000, 5150), 4]) is False and reconcile.verify_deleted(after, "id", list(range(5000, 5200))) is True
    assert reconcile.verify(after, "id", "UPDATE", affected=2, ids=[1], values={"v": "1"}) == (False, ["2 rows claimed, 1 named"])
    assert reconcile.verify(after, "id", "INSERT", rows=[{"id": 8, "v": 1}])[0] and reconcile.verify(after, "id", "MERGE")[0] is None


def test_claims_signals_and_meanings(spark):
    design = [TableSpec("a", (ColumnSpec("id"), ColumnSpec("b_id")), (ForeignKey("b_id", "b", "code"),))]
    profile = spark.createDataFrame([("x", 10, 1.0), ("y", 3, 0.3), ("z", 4, 0.4)], "column string, distinct long, ratio double")
    assert [k for k, _ in claims(design)] == ["key_table", "key_not_id"]
    assert [k for k, _ in claims(design, [profile])] == ["key_table", "key_not_id", "single_wide_table"]
    assert ("no_repeated_column", "") in claims(design, [profile.where("column = 'x'")])
    df = spark.createDataFrame([(1, "x")], "n int, t string")
    found = signals(df, [{"field": "n", "op": "=", "value": "three"}, {"field": "t", "op": "=", "value": "y"}], total=0)
    assert [x["type"] for x in found] == ["type_mismatch", "empty_with_condition"] and signals(df, []) == []
    specs = [TableSpec("patients", business_name="patient table"), TableSpec("orders", description="order table")]
    assert mentioned("rows of patients", specs) == ("patients", []) and mentioned("the Order Table of patients", specs) == ("orders", [])
    assert mentioned("sick and order", specs, {"sick": "patients", "order": "orders"}) == (None, ["orders", "patients"]) and mentioned("nothing", specs) == (None, [])


def test_a_consistent_store_has_no_findings(store):
    assert catalog_inconsistencies(store.catalog).collect() == []
    assert sorted(json.loads(x)["node_id"] for x in store.catalog.nodes().select("node_id").toJSON().collect()) == ["main.items", "main.kinds"]
    assert [tuple(r) for r in store.catalog.links().collect()] == [("main.items", "main.kinds", "kind_id")]
    store.catalog.forget("kinds")
    assert store.catalog.specs["items"].foreign_keys == ()


def test_a_live_change_is_left_alone_and_a_dead_one_taken_over(store, spark):
    late = {"late": TableSpec("late", (ColumnSpec("id", "BIGINT"),))}
    seen, publish = [], store._publish

    def met(*args):
        other = mutate.Store(spark, store.folder)
        with pytest.raises(mutate.Refused, match="is changing"):
            other.insert("kinds", {"label": "z"})
        seen.append(other.recovered)
        publish(*args)

    store._publish = met
    store.write({"late": spark.range(3)}, late)
    assert [list(x.values()) for x in seen] == [["running"]]
    again = mutate.Store(spark, store.folder)
    assert again.catalog.table("late").count() == 3 and again.recovered == {} and not again._names("claim-") and not again._names("journal-")
    again.insert("kinds", {"label": "z"})

    # a session that stops before it publishes: its claim is no longer touched
    def paused(*args):
        stopped = mutate.Store(spark, again.folder, patience=0)
        assert list(stopped.recovered.values()) == ["committed"] and stopped.catalog.table("late").count() == 5
        kept.append(stopped)
        return publish_again(*args)

    kept, publish_again = [], again._publish
    again._publish = paused
    with pytest.raises(mutate.Refused, match="taken this change over|has changed"):
        again.write({"late": spark.range(5)}, late)
    assert mutate.Store(spark, again.folder).catalog.table("late").count() == 5
    kept[0].insert("kinds", {"label": "y"})


def test_a_dead_change_that_is_not_whole_is_fenced_off_before_its_folders_go(store, spark):
    number, half = store.number + 1, f"{store.folder}/half"
    store._put(f"journal-{number:08d}.json", {"number": number, "new": [half], "tables": {**store.current, "half": half}, "specs": {}})
    assert store._exclusive(f"claim-{number:08d}-0001.json") and not store._exclusive(f"claim-{number:08d}-0001.json")
    assert list(mutate.Store(spark, store.folder).recovered.values()) == ["running"]
    after = mutate.Store(spark, store.folder, patience=0)
    assert list(after.recovered.values()) == ["compensated"] and after.number == number and rows(after, "kinds") == rows(store, "kinds")
    with pytest.raises(mutate.Refused):  # the dead session comes back
        store._claim = f"claim-{number:08d}-0001.json"
        store._publish({**store.current, "half": half}, {})


def test_a_manifest_whose_folders_are_gone_falls_back(store, spark):
    before = rows(store, "kinds")
    store.insert("kinds", {"label": "c"})
    store._drop(mutate.folders(store.current["kinds"])[-1]["rows"])
    again = mutate.Store(spark, store.folder)
    assert rows(again, "kinds") == before and again.number == store.number
    again.insert("kinds", {"label": "d"})
    assert len(rows(mutate.Store(spark, store.folder), "kinds")) == len(before) + 1


def test_changes_add_folders_and_vacuum_folds_them(store, spark):
    for i in range(3):
        store.insert("items", [{"code": f"a{i}", "slot": i, "kind_id": 1}])
    first = mutate.folders(store.current["items"])
    store.update("items", [{"field": "code", "value": "a1"}], {"price": 9})
    store.delete("items", [{"field": "code", "value": "a0"}])
    store.insert("items", [{"code": "a0", "slot": 0}])
    now = mutate.folders(store.current["items"])
    assert now[: len(first)] == first and [list(f) for f in now[len(first) :]] == [["gone"], ["rows"], ["gone"], ["rows"]]
    expected = [("a0", 0, 5.0), ("a1", 1, 9.0), ("a2", 2, 5.0)]
    assert rows(store, "items", "code", "slot", "price") == expected
    store.vacuum(most=2)
    assert len(mutate.folders(store.current["items"])) == 1 and rows(mutate.Store(spark, store.folder), "items", "code", "slot", "price") == expected
    store.undo()
    assert rows(store, "items", "code", "slot", "price") == expected


def test_keys_restrict_cascade_and_let_go(spark, tmp_path):
    def made(name, **actions):
        out = mutate.Store(spark, f"file://{tmp_path}/{name}")
        label = ColumnSpec("label", "TEXT", unique=True)
        out.create([TableSpec("a", (label,)), TableSpec("b", (label, ColumnSpec("a_label")), (ForeignKey("a_label", "a", "label", **actions),)), TableSpec("c", (label, ColumnSpec("b_label")), (ForeignKey("b_label", "b", "label", **actions),)), TableSpec("d", (label, ColumnSpec("up")), (ForeignKey("up", "d", "label", **actions),))])
        out.insert("a", [{"label": "x"}, {"label": "y"}])
        out.insert("b", [{"label": "bx", "a_label": "x"}, {"label": "by", "a_label": "y"}, {"label": "b0"}])
        out.insert("c", [{"label": "cx", "b_label": "bx"}, {"label": "cy", "b_label": "by"}])
        out.insert("d", [{"label": "1"}])
        out.insert("d", [{"label": "2", "up": "1"}])
        out.insert("d", [{"label": "3", "up": "2"}])
        return out

    x, one = [{"field": "label", "value": "x"}], [{"field": "label", "value": "1"}]
    store = made("restrict")
    number = store.number
    with pytest.raises(mutate.Refused, match="b.a_label"):
        store.delete("a", x)
    with pytest.raises(mutate.Refused):
        store.delete("d", one)
    assert store.number == number
    assert store.delete("d", [{"field": "label", "op": "IN", "value": ["1", "2", "3"]}]) == {"d": 3}  # all that point go as well
    store.update("a", x, {"label": "X"})
    assert rows(store, "b", "label", "a_label") == [("b0", None), ("bx", "X"), ("by", "y")]
    store = made("cascade", on_delete="CASCADE")
    assert store.delete("a", x) == {"a": 1, "b": 1, "c": 1} and rows(store, "c", "label") == [("cy",)] and rows(store, "b", "label") == [("b0",), ("by",)]
    assert store.delete("d", one) == {"d": 3}
    store.undo()
    assert len(rows(store, "d")) == 3
    store.update("d", one, {"label": "9"})
    assert rows(store, "d", "label", "up") == [("2", "9"), ("3", "2"), ("9", None)]
    store = made("null", on_delete="SET NULL", on_update="RESTRICT")
    assert store.delete("a", x) == {"a": 1} and rows(store, "b", "label", "a_label") == [("b0", None), ("bx", None), ("by", "y")]
    with pytest.raises(mutate.Refused, match="would lose"):
        store.update("a", [{"field": "label", "value": "y"}], {"label": "z"})
    assert mutate.Store(spark, store.folder).catalog.specs["b"].foreign_keys[0].on_delete == "SET NULL"
    with pytest.raises(ValueError):
        ForeignKey("a", "b", "c", "DROP")
