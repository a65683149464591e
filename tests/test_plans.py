import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.plans import aggregates, joins, registry, selection
from millrace.plans.catalog import Catalog, ColumnSpec, ForeignKey, TableSpec, changes, family, inconsistencies, parsed_definition, renamed, spark_type
from millrace.plans.conditions import Condition, filtered, folded, normalised
from millrace.plans.policy import Denied, Policy, read_only


@pytest.fixture(scope="module")
def pairs(spark):
    """A pair of tables of which one row has no parent, with null keys."""
    c = Catalog(spark)
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "id int, name string")
    right = spark.createDataFrame([(1, 1, "r1"), (2, 1, "r1b"), (3, 2, "r2"), (4, 9, "orphan"), (5, None, "null")], "id int, j_id int, label string")
    c.declare(TableSpec("a", (ColumnSpec("id", "INT", pk=True), ColumnSpec("name"))), left)
    c.declare(TableSpec("b", (ColumnSpec("id", "INT", pk=True), ColumnSpec("j_id", "INT"), ColumnSpec("label")), (ForeignKey("j_id", "a", "id"),)), right)
    return c


def test_joins_keep_and_drop_unmatched_rows(pairs):
    count = lambda kind: joins.joined(pairs, "a", ["b"], kind).frame.count()
    assert (count("INNER"), count("left"), count("RIGHT")) == (3, 5, 5)
    for bad in ("FULL", "CROSS"):
        with pytest.raises(ValueError):
            joins.joined(pairs, "a", ["b"], bad)


def test_join_conditions(pairs):
    assert joins.joined(pairs, "a", ["b"], "LEFT", [{"field": "a.id", "op": "=", "value": "b.j_id"}]).frame.count() == 5
    assert joins.joined(pairs, "a", ["b"], "INNER", [{"field": "b.label", "value": "r1"}]).frame.count() == 1
    assert joins.joined(pairs, "a", ["b"], "INNER", on_condition="a.id < b.id").frame.count() == 9
    for bad in ("a.id = b.id; drop table a", "a.id = 1", "a.id = b.id OR a.id = b.j_id"):
        with pytest.raises(ValueError):
            joins.joined(pairs, "a", ["b"], on_condition=bad)


def test_join_projection(pairs):
    j = joins.joined(pairs, "b", ["a"], "LEFT")
    assert joins.select(j, ["a.*", "label"]).columns == ["a__id", "a__name", "b__label"]
    assert joins.select(j, ["nothing"], on_missing="all").columns == j.frame.columns
    with pytest.raises(ValueError):
        joins.select(j, ["nothing"])
    rows, total, more = joins.capped(j.frame, ["b__id"], 2)
    assert (rows.count(), total, more) == (2, 5, True)


def test_bridges_follow_the_shortest_path(spark, data):
    c = Catalog.of_directory(spark, data)
    assert joins.joined(c, "orders", ["region"], "INNER").tables == ["orders", "customer", "nation", "region"]
    assert joins.joined(c, "customer", ["nation", "region"]).tables == ["customer", "nation", "region"]
    with pytest.raises(ValueError):
        joins.joined(c, "orders", ["pages"])
    assert c.ordered(["lineitem", "orders", "customer", "nation", "region"])[0] == "region"
    assert c.ordered(["region", "nation", "customer"], referenced_first=False)[0] == "customer"


def test_normalising_conditions():
    assert normalised({"a": 1, "b": [1, 2]}) == [Condition("a", "=", 1), Condition("b", "IN", [1, 2])]
    assert normalised([{"field": "a", "value": "'x'"}, {"field": "a", "value": "y"}, {"field": "b", "op": ">", "value": ""}]) == [Condition("a", "IN", ["x", "y"])]
    assert normalised([{"field": "a", "value": "x或y,z"}]) == [Condition("a", "IN", ["x", "y", "z"])]
    assert normalised([{"field": "a", "value": "x,y"}], split_values=False) == [Condition("a", "=", "x,y")]
    assert normalised([{"field": "a", "value": ""}, {"field": "b", "value": 1, "link": "or"}])[0].field == "b"
    with pytest.raises(ValueError):
        normalised([{"field": "a", "op": "~", "value": 1}])


def test_odd_literals(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "n int, s string")
    assert filtered(df, [{"field": "n", "value": "abc"}]).count() == 0
    assert filtered(df, [{"field": "n", "op": "!=", "value": "abc"}]).count() == 1
    assert filtered(df, [{"field": "s", "op": "LIKE", "value": "A%"}], ignore_case=True).count() == 1
    with pytest.raises(ValueError):
        filtered(df, [{"field": "n", "op": "<", "value": "abc"}])
    assert folded(df, []) is None


def test_random_conditions_agree_with_sql(spark, data):
    part = spark.read.parquet(f"{data}/part.parquet")
    db, rnd = duckdb.connect(), random.Random(7)
    for _ in range(12):
        given, sql = [], ""
        for i in range(rnd.randint(1, 4)):
            op, v = rnd.choice(["=", "!=", "<", ">="]), rnd.randint(1, 50)
            field = rnd.choice(["p_size", "p_partkey"])
            link = rnd.choice(["AND", "OR"]) if i else "AND"
            given.append({"field": field, "op": op, "value": v, "link": link})
            sql += (f" {link} " if i else "") + f"{field} {op} {v}"
        merged = normalised(given)
        if any(c.op == "IN" for c in merged):
            continue  # several equalities mean an enumeration
        want = db.sql(f"SELECT p_partkey FROM '{data}/part.parquet' WHERE {sql}").fetchall()
        assert sorted(r[0] for r in filtered(part, given).select("p_partkey").collect()) == sorted(x for (x,) in want)


def test_filters_and_columns_reach_the_scan(spark, data):
    out = selection.projected(filtered(spark.read.parquet(f"{data}/part.parquet"), [{"field": "p_size", "op": ">", "value": "40"}]), "p_partkey")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,40)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_pages_and_selections(spark, data, tmp_path):
    customer = spark.read.parquet(f"{data}/customer.parquet")
    first, last = selection.page(customer, "c_custkey", 1, 40), selection.page(customer, "c_custkey", 4, 40)
    assert (first.total, first.pages, first.has_more, last.has_more) == (150, 4, True, False)
    assert last.rows.count() == 30
    for bad in ((0, 10), (1, 501), (1, 0)):
        with pytest.raises(ValueError):
            selection.page(customer, "c_custkey", *bad)
    with pytest.raises(ValueError):
        selection.limited(customer, 0)
    saved = selection.Selections(spark, f"file://{tmp_path}", keep=2)
    one = saved.save(customer.where("c_custkey < 5"), "customer", "c_custkey")
    assert one["count"] == saved.rows(one["number"], customer).count()
    for _ in range(2):
        saved.save(customer.limit(1), "customer", "c_custkey")
    with pytest.raises(ValueError):
        saved.rows(one["number"], customer)


def test_aggregates_refuse_what_has_no_meaning(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None)], "k int, v double")
    assert aggregates.aggregated(df, "AVG", "v", distinct=True).first()["agg_result"] == 2.5
    assert {r["k"]: r["agg_result"] for r in aggregates.aggregated(df, "COUNT", "v", ["k"]).collect()} == {1: 2, 2: 0}
    for bad in (("SUM", "*"), ("MEDIAN", "v")):
        with pytest.raises(ValueError):
            aggregates.aggregated(df, *bad)
    with pytest.raises(ValueError):
        selection.projected(df, "v; drop")
    with pytest.raises(ValueError):
        selection.distinct_values(df, "*")


def test_declarations():
    assert (family("DECIMAL(10,2)"), family("varchar(9)"), family("JSON")) == ("float", "text", "other")
    assert (spark_type("NUMERIC"), spark_type("decimal(8,2)"), spark_type("BOOL")) == ("decimal(20,4)", "decimal(8,2)", "boolean")
    old = parsed_definition("t", "code:varchar:uq:nn,price:decimal(10,2),a_id:int:fk(a)")
    assert old.key == "code" and old.foreign_keys == (ForeignKey("a_id", "a", "id"),)
    new = parsed_definition("t", "code:text:uq,price:decimal(8,2),size:int")
    assert {k for k, *_ in changes(old, new)} == {"alter_precision", "drop_not_null", "add_column", "drop_column", "drop_foreign_key"}
    assert changes(old, old) == []
    with pytest.raises(ValueError):
        Catalog(None, [TableSpec("1bad")])


def test_aliases_and_consistency(spark, pairs):
    spec = TableSpec("t", (ColumnSpec("n", "INT", "number"), ColumnSpec("gone")), aliases=(("how many", "n"),))
    assert spec.resolve("how many") == spec.resolve("number") == spec.resolve("n") == "n"
    with pytest.raises(ValueError):
        spec.resolve("other")
    df = spark.createDataFrame([("x", 1)], "n string, extra int")
    assert set(inconsistencies(spec, df)) == {("missing_column", "gone"), ("extra_column", "extra"), ("type_family", "n")}
    c = Catalog(spark, list(pairs.specs.values()))
    renamed(c, "a", "c")
    assert c.specs["b"].foreign_keys[0].references == "c"
    assert c.meta_keys().count() == 1 and c.overview().first()["columns"] == 5 and c.adjacent("c").count() == 1
    types, rows, n = pairs.preview("b", 2)
    assert (len(types), rows.count(), n) == (3, 2, 5)


def test_policy(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    p = Policy(tables={"secret": False}, denied_columns={"t": {"b"}}, roles={"guest": Policy(tables={"t": False}), "clerk": Policy(denied_columns={"t": {"a"}})})
    assert p.view(df, "t").columns == ["a"] and p.view(df, "t", role="clerk").columns == []
    for args in (("secret",), ("t", ["t.b"]), ("t", [], "main", "guest")):
        with pytest.raises(Denied):
            p.check(*args)
    assert read_only(spark, "SELECT 1 AS x").first()["x"] == 1
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", ""):
        with pytest.raises(Denied):
            read_only(spark, bad)


def test_registry(spark, data):
    tools = registry.of_catalog(Catalog.of_directory(spark, data), Policy(tables={"labels": False}))
    assert tools.call("query", table="nation", page="1").data.total == 25
    assert tools.call("aggregate_query", table="nation", function="COUNT").data.first()[0] == 25
    codes = [tools.call(*a, **k).code for a, k in ((["nothing"], {}), (["query"], {}), (["query"], {"table": "labels"}), (["query"], {"table": "nation", "page": "x"}), (["query"], {"table": "nation", "odd": 1}), (["query"], {"table": "none"}))]
    assert codes == ["unknown_tool", "missing", "denied", "bad_value", "unknown_parameter", "invalid"]
    tools.add(registry.Tool("wipe", lambda: 1, risk="write"))
    assert tools.call("wipe").code == "denied"


def test_seek_pages_give_every_row_once_in_order(spark):
    from millrace.plans import selection

    rows = [(i, None if i % 7 == 0 else i % 5, f"t{i % 3}" if i % 11 else None) for i in range(83)]
    df = spark.createDataFrame(rows, "id long, n int, t string")
    for keys in (["n", "id"], ["n DESC", "t", "id DESC"], "t DESC, n DESC, id", ["id"]):
        wanted = [tuple(r) for r in selection.ordered(df, keys).collect()]
        got, token, pages = [], None, 0
        while pages == 0 or token:
            out = selection.page_after(df, keys, token, 9)
            got += [tuple(r) for r in out.rows.collect()]
            token, pages = out.token, pages + 1
            assert out.total == 83
        assert got == wanted and pages == 10
    assert selection.page_after(df.where("false"), "id").token is None
    for bad in ("x", "{}", "[1]"):
        with pytest.raises(ValueError, match="token"):
            selection.page_after(df, "id", bad)


def test_seek_pages_read_a_range(spark, tmp_path):
    from millrace.plans import selection

    spark.range(5000).selectExpr("id", "id % 10 AS n").write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    token = selection.page_after(df, "id", size=100).token
    plan = selection.page_after(df, "id", token, 100).rows._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,99)" in plan and "Offset" not in plan


def test_presence_on_several_sides(spark):
    from millrace.operators import reconcile

    side = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    out = {r["k"]: (r["has"], r["lacks"]) for r in reconcile.presence({"specs": side(1, 2, 2, None), "meta": side(2, 3), "files": side(3, 4, None)}, ["k"]).collect()}
    assert out == {1: (["specs"], ["meta", "files"]), 2: (["specs", "meta"], ["files"]), 3: (["meta", "files"], ["specs"]), 4: (["files"], ["specs", "meta"]), None: (["specs", "files"], ["meta"])}
    with pytest.raises(ValueError):
        reconcile.presence({}, ["k"])
