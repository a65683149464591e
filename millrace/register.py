"""The library's queries over the test tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import mapping, mutate, profile, quality, reconcile, retrieval
from millrace.operators.several import SeveralSources, Sources, Step, changes, commit
from millrace.plans import aggregates, joins, registry, selection
from millrace.plans.catalog import Catalog, ColumnSpec, ForeignKey, TableSpec, catalog_inconsistencies
from millrace.plans.conditions import filtered
from millrace.plans.policy import Policy
from millrace.sources.live import LiveSource
from millrace.sources.places import shared_folder
from millrace.streaming import rollup
from millrace.streaming.units import tier, two_tiers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(run):
        QUERIES[name or run.__name__] = run
        if sql:
            SQL[name or run.__name__] = sql
        return run

    return put


def _c(spark: SparkSession, path: str, *tables: str) -> Catalog:
    return Catalog.of_directory(spark, path, tables=list(tables))


def _t(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _money(column: str):
    """Money sums are exact, so that their order doesn't show."""
    return F.col(column).cast("decimal(18,4)")


# aggregates


def _aggregate(name: str, table: str, function: str, column: str, by: list[str] = (), sql: str = "", **options) -> None:
    def run(spark: SparkSession, path: str) -> DataFrame:
        df = _t(spark, path, table)
        df = df.withColumn(column, _money(column)) if function in ("SUM", "AVG") and column != "p_size" else df
        out = aggregates.aggregated(df, function, column, list(by), **options)
        return out.withColumn("agg_result", F.col("agg_result").cast("double")) if function in ("SUM", "AVG") and column != "p_size" else out

    query(sql, name)(run)


_EXACT = "CAST({}(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"
_aggregate("agg_count_star", "lineitem", "COUNT", "*", sql="SELECT count(*) AS agg_result FROM lineitem")
_aggregate("agg_count_col", "orders", "COUNT", "o_orderstatus", sql="SELECT count(o_orderstatus) AS agg_result FROM orders")
_aggregate("agg_sum_grouped", "lineitem", "SUM", "l_extendedprice", ["l_returnflag"], f"SELECT l_returnflag, {_EXACT.format('sum', 'l_extendedprice')} AS agg_result FROM lineitem GROUP BY l_returnflag")
_aggregate("agg_min_grouped", "lineitem", "MIN", "l_quantity", ["l_returnflag", "l_linestatus"], "SELECT l_returnflag, l_linestatus, min(l_quantity) AS agg_result FROM lineitem GROUP BY ALL")
_aggregate("agg_max_grouped", "lineitem", "MAX", "l_extendedprice", ["l_returnflag", "l_linestatus"], "SELECT l_returnflag, l_linestatus, max(l_extendedprice) AS agg_result FROM lineitem GROUP BY ALL")
_aggregate("agg_count_distinct", "orders", "COUNT", "o_custkey", sql="SELECT count(DISTINCT o_custkey) AS agg_result FROM orders", distinct=True)
_aggregate("agg_sum_distinct", "part", "SUM", "p_size", sql="SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS agg_result FROM part", distinct=True)
_aggregate("agg_having", "orders", "COUNT", "*", ["o_custkey"], "SELECT o_custkey, count(*) AS agg_result FROM orders GROUP BY o_custkey HAVING count(*) > 15", having=aggregates.Having("COUNT", "*", ">", 15))
_aggregate("agg_having_other_func", "orders", "SUM", "o_totalprice", ["o_custkey"], f"SELECT o_custkey, {_EXACT.format('sum', 'o_totalprice')} AS agg_result FROM orders GROUP BY o_custkey HAVING count(*) >= 12", having=aggregates.Having("COUNT", "*", ">=", 12))


@query("SELECT l_returnflag, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS agg_result FROM lineitem GROUP BY l_returnflag")
def agg_avg_grouped(spark, path):
    out = aggregates.several(_t(spark, path, "lineitem").withColumn("l_quantity", _money("l_quantity")), [{"field": "l_quantity", "aggregate": "SUM", "alias": "s"}, {"field": "*", "aggregate": "COUNT", "alias": "n"}], ["l_returnflag"])
    return out.select("l_returnflag", F.round(F.col("s").cast("double") / F.col("n"), 6).alias("agg_result"))


@query("SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1")
def distinct_list(spark, path):
    return selection.distinct_values(_t(spark, path, "orders"), "o_orderpriority")


@query(f"SELECT p_brand, count(*) AS n, {_EXACT.format('sum', 'p_retailprice')} AS total, max(p_size) AS largest, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def agg_multi(spark, path):
    wanted = [{"field": "*", "aggregate": "COUNT", "alias": "n"}, {"field": "p_retailprice", "aggregate": "SUM", "alias": "total"}, {"field": "p_size", "aggregate": "MAX", "alias": "largest"}, {"field": "p_type", "aggregate": "COUNT", "alias": "types", "distinct": True}]
    df = _t(spark, path, "part").withColumn("p_retailprice", _money("p_retailprice"))
    return aggregates.several(df, wanted, ["p_brand"], order="n DESC, p_brand", limit=10).withColumn("total", F.col("total").cast("double"))


# conditions

_PART, _ORDERS = "SELECT p_partkey, p_size FROM part WHERE ", "SELECT o_orderkey FROM orders WHERE "
_LABELLED = "(SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"


def _filter(name: str, table: str, fields: str, conditions: list, sql: str) -> None:
    query(sql, name)(lambda spark, path: selection.projected(filtered(_t(spark, path, table), conditions), fields))


def _one(field, op, value=None, link="AND") -> dict:
    return {"field": field, "op": op, "value": value, "link": link}


_filter("filter_compare", "part", "p_partkey, p_size", [_one("p_size", ">=", "40"), _one("p_retailprice", "<", "1500")], _PART + "p_size >= 40 AND p_retailprice < 1500")
_filter("filter_in", "part", "p_partkey, p_size", [_one("p_size", "IN", "1, 5,'9'")], _PART + "p_size IN (1, 5, 9)")
_filter("filter_not_in", "part", "p_partkey, p_size", [_one("p_size", "not in", [1, 5, 9])], _PART + "p_size NOT IN (1, 5, 9)")
_filter("filter_between", "part", "p_partkey, p_size", [_one("p_size", "BETWEEN", "10,20")], _PART + "p_size BETWEEN 10 AND 20")
_filter("filter_not_between", "part", "p_partkey, p_size", [_one("p_size", "NOT BETWEEN", [10, 40])], _PART + "p_size NOT BETWEEN 10 AND 40")
_filter("filter_like", "part", "p_partkey, p_size", [_one("p_name", "LIKE", "%wi_get")], _PART + "p_name LIKE '%wi_get'")
_filter("filter_not_like", "part", "p_partkey, p_size", [_one("p_name", "NOT LIKE", "% b%")], _PART + "p_name NOT LIKE '% b%'")
_filter("filter_and_or", "orders", "o_orderkey", [_one("o_orderstatus", "=", "F"), _one("o_totalprice", ">", "100000"), _one("o_orderpriority", "=", "1-URGENT", "OR")], _ORDERS + "o_orderstatus = 'F' AND o_totalprice > 100000 OR o_orderpriority = '1-URGENT'")
_filter("filter_eq_merge_in", "nation", "n_nationkey, n_name", [_one("n_nationkey", "=", "3"), _one("n_nationkey", "=", "7")], "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 7)")
_filter("filter_value_split_in", "orders", "o_orderkey", [_one("o_orderstatus", "=", "F、P")], _ORDERS + "o_orderstatus IN ('F', 'P')")
_filter("filter_dict", "part", "p_partkey, p_size", {"p_size": [3, 4]}, _PART + "p_size IN (3, 4)")


@query(f"SELECT doc_id FROM {_LABELLED} WHERE quality IS NULL")
def filter_is_null(spark, path):
    return filtered(_t(spark, path, "documents").join(_t(spark, path, "labels"), "doc_id", "left"), [_one("quality", "IS NULL")]).select("doc_id")


@query(f"SELECT doc_id FROM {_LABELLED} WHERE quality IS NOT NULL")
def filter_is_not_null(spark, path):
    return filtered(_t(spark, path, "documents").join(_t(spark, path, "labels"), "doc_id", "left"), [_one("quality", "IS NOT NULL")]).select("doc_id")


_ODD = [
    ("int_equals_text", "p_size", "=", "abc", "FALSE"), ("int_differs_from_text", "p_size", "!=", "abc", "TRUE"), ("int_equals_fraction", "p_size", "=", "1.5", "p_size = 1.5"),
    ("int_above_fraction", "p_size", ">=", 1.5, "p_size >= 1.5"), ("int_between_fractions", "p_size", "BETWEEN", "1.5, 3.5", "p_size BETWEEN 1.5 AND 3.5"),
    ("int_equals_nan", "p_size", "=", "nan", "FALSE"), ("int_below_huge", "p_size", "<", "99999999999999999999", "TRUE"), ("int_in_mixed", "p_size", "IN", "7, x, 8.0", "p_size IN (7, 8)"),
    ("double_equals_exponent", "p_retailprice", "<", "1.2e3", "p_retailprice < 1200"), ("text_equals_number", "p_name", "=", 7, "FALSE"),
]


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"case\", count(*) FILTER ({sql}) AS n FROM part" for n, *_, sql in _ODD) + " UNION ALL SELECT 'date_equals_text', 0 UNION ALL SELECT 'date_from', count(*) FILTER (o_orderdate >= DATE '1995-06-01') FROM orders")
def filter_odd_literals(spark, path):
    part, orders = _t(spark, path, "part"), _t(spark, path, "orders").withColumn("day", F.to_date("o_orderdate"))
    counts = [filtered(part, [_one(field, op, value)]).agg(F.count("*").alias("n")).select(F.lit(n).alias("case"), "n") for n, field, op, value, _ in _ODD]
    counts += [filtered(orders, [_one("day", op, value)]).agg(F.count("*").alias("n")).select(F.lit(n).alias("case"), "n") for n, op, value in (("date_equals_text", "=", "abc"), ("date_from", ">=", "1995-06-01"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_CUSTOMER = TableSpec("customer", tuple(ColumnSpec(n, t, b) for n, t, b in (("c_custkey", "BIGINT", "number"), ("c_name", "TEXT", "customer_name"), ("c_acctbal", "DOUBLE", "balance"), ("c_mktsegment", "TEXT", ""))), aliases=(("segment", "c_mktsegment"),))


@query("SELECT c_custkey AS \"no\", c_name, c_mktsegment FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def alias_filter(spark, path):
    df = filtered(_t(spark, path, "customer"), [_one("balance", ">", "5000"), _one("segment", "=", "BUILDING")], names=_CUSTOMER.resolve)
    return selection.projected(df, "number AS no, customer_name, segment", _CUSTOMER.resolve)


# projection, order, pages


@query("SELECT c_custkey AS customer, c_name, c_acctbal AS balance FROM customer")
def project_alias(spark, path):
    return selection.projected(_t(spark, path, "customer"), "c_custkey AS customer, c_name, c_acctbal AS balance")


@query("SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY c_mktsegment")
def project_aggregates(spark, path):
    return selection.projected(_t(spark, path, "customer"), "c_mktsegment, COUNT(*) AS n, MAX(c_acctbal) AS top")


@query("SELECT n_nationkey AS nation__n_nationkey, n_name AS nation__n_name, n_regionkey AS nation__n_regionkey, r_name AS region__r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def project_qualified_star(spark, path):
    return joins.select(joins.joined(_c(spark, path, "nation", "region"), "nation", ["region"]), ["nation.*", "r_name"])


for _name, _number, _size, _offset in (("page_first", 1, 100, 0), ("page_middle", 3, 50, 100), ("page_beyond", 10**6, 100, 99_999_900)):
    query(f"SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT {_size} OFFSET {_offset}", _name)(
        lambda spark, path, n=_number, s=_size: selection.page(_t(spark, path, "customer"), "c_custkey", n, s, fields="c_custkey, c_name").rows
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, path):
    return selection.limited(selection.ordered(selection.projected(_t(spark, path, "orders"), "o_orderkey, o_totalprice"), "o_totalprice DESC, o_orderkey"), 20)


# joins

_OL = "SELECT o_orderkey AS orders__o_orderkey, l_linenumber AS lineitem__l_linenumber, l_partkey AS lineitem__l_partkey FROM orders {} JOIN lineitem ON l_orderkey = o_orderkey"
_OL_FIELDS = ["orders.o_orderkey", "lineitem.l_linenumber", "lineitem.l_partkey"]


def _order_lines(spark, path, kind, conditions=None):
    return joins.select(joins.joined(_c(spark, path, "orders", "lineitem"), "orders", ["lineitem"], kind, conditions), _OL_FIELDS)


query(_OL.format("LEFT"), "join_fk_left")(lambda spark, path: _order_lines(spark, path, "LEFT"))
query(_OL.format("INNER"), "join_fk_inner")(lambda spark, path: _order_lines(spark, path, "inner"))
query(_OL.format("RIGHT"), "join_fk_right")(lambda spark, path: _order_lines(spark, path, "RIGHT"))
query(_OL.format("LEFT"), "join_left_fk_in_where")(lambda spark, path: _order_lines(spark, path, "LEFT", [_one("orders.o_orderkey", "=", "lineitem.l_orderkey")]))


@query("SELECT n_nationkey AS nation__n_nationkey, r_regionkey AS region__r_regionkey FROM nation JOIN region ON n_nationkey < r_regionkey")
def join_theta(spark, path):
    return joins.select(joins.joined(_c(spark, path, "nation", "region"), "nation", ["region"], "INNER", on_condition="nation.n_nationkey < region.r_regionkey"), ["n_nationkey", "r_regionkey"])


@query("SELECT s_suppkey AS supplier__s_suppkey, n_name AS nation__n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND s_suppkey > n_nationkey")
def join_manual_on(spark, path):
    on = "supplier.s_nationkey = nation.n_nationkey AND supplier.s_suppkey > nation.n_nationkey"
    return joins.select(joins.joined(_c(spark, path, "supplier", "nation"), "supplier", ["nation"], "LEFT", on_condition=on), ["s_suppkey", "n_name"])


@query(f"SELECT n_name, o_orderstatus, count(*) AS n, {_EXACT.format('sum', 'l_extendedprice')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 10 GROUP BY n_name, o_orderstatus")
def join_multi(spark, path):
    j = joins.joined(_c(spark, path, "lineitem", "orders", "customer", "nation"), "lineitem", ["orders", "customer", "nation"], "INNER", [_one("lineitem.l_quantity", ">", 10)])
    wanted = [{"field": "*", "aggregate": "COUNT", "alias": "n"}, {"field": "lineitem__l_extendedprice", "aggregate": "SUM", "alias": "revenue"}]
    df = j.frame.withColumn("lineitem__l_extendedprice", _money("lineitem__l_extendedprice"))
    out = aggregates.several(df, wanted, ["nation__n_name", "orders__o_orderstatus"])
    return out.select(F.col("nation__n_name").alias("n_name"), F.col("orders__o_orderstatus").alias("o_orderstatus"), "n", F.col("revenue").cast("double").alias("revenue"))


@query("SELECT r_name AS region__r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_bridge(spark, path):
    return joins.joined(_c(spark, path, "customer", "nation", "region"), "customer", ["region"], "INNER").frame.groupBy("region__r_name").agg(F.count("*").alias("n"))


@query("SELECT r_name AS region__r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_bridge_two(spark, path):
    return joins.joined(_c(spark, path, "orders", "customer", "nation", "region"), "orders", ["region"], "INNER").frame.groupBy("region__r_name").agg(F.count("*").alias("n"))


@query("SELECT a.n_nationkey AS nation__n_nationkey, b.r_name AS region__r_name FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation) a LEFT JOIN (SELECT nullif(r_regionkey, 2) AS k, r_name FROM region) b USING (k)")
def join_null_keys(spark, path):
    c = _c(spark, path, "nation", "region")
    c.frames = {"nation": c.table("nation").withColumn("n_regionkey", F.nullif("n_regionkey", F.lit(1))), "region": c.table("region").withColumn("r_regionkey", F.nullif("r_regionkey", F.lit(2)))}
    return joins.select(joins.joined(c, "nation", ["region"]), ["n_nationkey", "r_name"])


@query("SELECT o_orderkey AS orders__o_orderkey, c_custkey AS customer__c_custkey, c_name AS customer__c_name, c_nationkey AS customer__c_nationkey, c_mktsegment AS customer__c_mktsegment, 4 AS refused FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def policy_join(spark, path):
    """A join through the tools under a policy that hides a column and a table; four other calls are refused."""
    tools = registry.of_catalog(_c(spark, path, "orders", "customer", "nation"), Policy(denied_columns={"customer": {"c_acctbal"}}, tables={"nation": False}))
    ask = {"main": "orders", "tables": ["customer"], "kind": "INNER"}
    out = tools.call("join_query", **ask, conditions=[_one("orders.o_totalprice", ">", 200000)], fields=["orders.o_orderkey", "customer.*"])
    refused = [
        tools.call("join_query", **ask, conditions=[_one("customer.c_acctbal", ">", 0)]), tools.call("join_query", **ask, fields=["customer.c_acctbal"]),
        tools.call("join_query", main="customer", tables=["nation"]), tools.call("query", table="customer", conditions=[_one("c_acctbal", ">", 0)]),
    ]
    return out.data.withColumn("refused", F.lit(sum(r.code == "denied" for r in refused)))


@query("""
SELECT tool, code, CASE WHEN tool = 'select_data' THEN n END AS n FROM (SELECT count(*) AS n FROM customer WHERE c_custkey < 50), (VALUES ('select_data', 'ok'), ('select hidden', 'denied'), ('list_selections', 'ok'),
  ('edit_data', 'ok'), ('edit hidden', 'denied'), ('query', 'denied'), ('insert_data', 'denied'), ('drop_column', 'denied'), ('drop hidden', 'denied'), ('drop_table', 'denied'), ('drop whole', 'denied'),
  ('modify_column', 'denied'), ('create_index', 'denied'), ('clear_db', 'denied'), ('restore_database', 'denied'), ('set_not_null', 'denied'), ('add_foreign_key', 'denied'), ('set_visible', 'ok')) t(tool, code)
""")
def policy_tools(spark, path):
    """Tools over a store under a policy that hides a table and a column: what each call is told, and what a sample shows."""
    from millrace.plans.selection import Selections

    store = _families(spark, path)
    hidden = Policy(tables={"lines": False}, denied_columns={"buyers": {"name"}})
    tools = registry.of_store(store, Selections(spark, shared_folder(spark, "selections")), hidden, gate=lambda tool, args: True)
    chosen = tools.call("select_data", table="buyers", conditions=[_one("code", "<", 50)])
    listed = tools.call("list_selections")
    safe = all("name" not in x for s in (chosen.data, *listed.data) for x in s["sample"])
    calls = [
        ("select hidden", "select_data", dict(table="buyers", conditions=[_one("name", "=", "x")])), ("edit_data", "edit_data", dict(selection=1, values={})), ("edit hidden", "edit_data", dict(selection=1, values={"name": "x"})),
        ("query", "query", dict(table="lines")), ("insert_data", "insert_data", dict(table="lines", data={"sale": 1})), ("drop_column", "drop_column", dict(name="lines", column="sale")), ("drop hidden", "drop_column", dict(name="buyers", column="name")),
        ("drop_table", "drop_table", dict(name="lines")), ("drop whole", "drop_table", dict(name="buyers")), ("modify_column", "modify_column", dict(name="buyers", column="name", new="TEXT")), ("create_index", "create_index", dict(table="lines", column="sale")),
        ("clear_db", "clear_db", {}), ("restore_database", "restore_database", dict(number=1)), ("set_not_null", "set_not_null", dict(name="buyers", column="name")), ("add_foreign_key", "add_foreign_key", dict(table="sales", column="buyer", references="lines")),
        ("set_visible", "set_not_null", dict(name="buyers", column="code")),
    ]
    told = [("select_data", chosen.code if safe else "shown", chosen.data["count"]), ("list_selections", listed.code if safe else "shown", None)]
    told += [(name, tools.call(tool, **args).code, None) for name, tool, args in calls]
    return spark.createDataFrame(told, "tool string, code string, n long")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_selection(spark, path):
    chosen = filtered(_t(spark, path, "labels"), [_one("toxic", "=", 1)]).select("doc_id")
    return _t(spark, path, "documents").join(chosen, "doc_id", "left_semi").select("doc_id", "lang")


@query("""
WITH k AS (SELECT c_custkey AS k, 'customer' AS side FROM customer UNION SELECT o_custkey, 'orders' FROM orders UNION SELECT user_id, 'events' FROM events), s AS (
  SELECT k, bool_or(side = 'customer') AS c, bool_or(side = 'orders') AS o, bool_or(side = 'events') AS e FROM k GROUP BY k)
SELECT concat_ws(',', CASE WHEN c THEN 'customer' END, CASE WHEN o THEN 'orders' END, CASE WHEN e THEN 'events' END) AS has,
  concat_ws(',', CASE WHEN NOT c THEN 'customer' END, CASE WHEN NOT o THEN 'orders' END, CASE WHEN NOT e THEN 'events' END) AS lacks, count(*) AS n FROM s GROUP BY ALL
""")
def reconcile_three(spark, path):
    """Customers by which of three tables know them."""
    sides = {n: _t(spark, path, n).select(F.col(c).cast("long").alias("k")) for n, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"))}
    found = reconcile.presence(sides, ["k"])
    return found.select(F.array_join("has", ",").alias("has"), F.array_join("lacks", ",").alias("lacks")).groupBy("has", "lacks").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS total FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_after(spark, path):
    """The third page of orders by price, reached by two tokens."""
    token, out = None, None
    for _ in range(3):
        out = selection.page_after(_t(spark, path, "orders"), ["o_totalprice DESC", "o_orderkey"], token, 50, [_one("o_orderstatus", "!=", "P")], ["o_orderkey", "o_totalprice"])
        token = out.token
    return out.rows.withColumn("total", F.lit(out.total).cast("long"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_absent(spark, path):
    return reconcile.absent(_t(spark, path, "documents").select("doc_id"), _t(spark, path, "labels"), "doc_id", "doc_id")


@query("SELECT n_name, r_regionkey AS region_id FROM (SELECT n_name, r_name AS code FROM nation LEFT JOIN region r ON n_regionkey = r_regionkey AND r_regionkey <> 2) LEFT JOIN region ON r_name = code")
def code_to_id(spark, path):
    region = _t(spark, path, "region")
    codes = _t(spark, path, "nation").join(region.where("r_regionkey <> 2"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.col("r_name").alias("code"))
    return joins.code_to_id(codes, "code", region, "r_name", "r_regionkey", "region_id").drop("code")


# profiles and quality


@query("SELECT r_regionkey, r_name FROM region")
def fullest_row(spark, path):
    region = _t(spark, path, "region")
    blank = region.select("r_regionkey", F.lit("").alias("r_name"))
    return profile.fullest(region.unionByName(blank).unionByName(region), "r_regionkey")[0]


_PROFILE = "SELECT '{0}' AS \"column\", count({0}) AS non_null, count(DISTINCT {0}) AS \"distinct\", round(count(DISTINCT {0}) / greatest(count(*), 1), 3) AS ratio FROM part"


@query(" UNION ALL ".join(_PROFILE.format(c) for c in ("p_brand", "p_type", "p_size", "p_partkey")))
def profile_columns(spark, path):
    return profile.columns(_t(spark, path, "part"), ["p_brand", "p_type", "p_size", "p_partkey"]).drop("samples")


@query("SELECT \"column\", value FROM (SELECT 'p_brand' AS \"column\", v AS value FROM (SELECT DISTINCT p_brand AS v FROM part ORDER BY v LIMIT 5)) UNION ALL SELECT 'p_type', v FROM (SELECT DISTINCT p_type AS v FROM part ORDER BY v LIMIT 5)")
def profile_samples(spark, path):
    return profile.columns(_t(spark, path, "part"), ["p_brand", "p_type"]).select("column", F.explode("samples").alias("value"))


_COUNTED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _COUNTED))
def table_counts(spark, path):
    return _c(spark, path, *_COUNTED).counts()


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def set_diff_both(spark, path):
    return reconcile.differences(_t(spark, path, "documents"), _t(spark, path, "labels"), ["doc_id"])


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 'p_size' WHEN p_size > 45 THEN 'p_size' ELSE 'p_name' END AS \"column\", CASE WHEN p_size < 5 THEN 'min' WHEN p_size > 45 THEN 'max' ELSE 'pattern' END AS rule FROM part WHERE p_size < 5 OR p_size > 45 OR NOT regexp_matches(p_name, '^(?:.*[0-4]$)')")
def rule_violations(spark, path):
    return quality.violations(_t(spark, path, "part"), {"p_size": {"min": 5, "max": 45}, "p_name": {"pattern": ".*[0-4]$"}}, "p_partkey")


_CHECKS = {
    "quantity": ("REAL", "real_range", "l_quantity", {"min": 5, "max": 40}, "l_quantity >= 5 AND l_quantity <= 40"),
    "discount": ("REAL", "real_ratio_0_1", "l_discount", {}, "l_discount BETWEEN 0 AND 1"),
    "line": ("INTEGER", "int_less", "l_linenumber", {"n": 6}, "l_linenumber < 6"),
    "flag": ("TEXT", "text_enum", "l_returnflag", {"values": ["A", "N"]}, "l_returnflag IN ('A', 'N')"),
    "shipped": ("DATETIME", "dt_after", "l_shipdate", {"dt": "1995-01-01 00:00:00"}, "l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'"),
    "status": ("TEXT", "text_max_length", "l_linestatus", {"max": 1}, "length(l_linestatus) <= 1"),
    "tax": ("REAL", "custom", "l_tax", {"expression": "ABS(l_tax) <= 0.05 OR l_quantity IS NULL"}, "abs(l_tax) <= 0.05 OR l_quantity IS NULL"),
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER (NOT ({c[4]})) AS n FROM lineitem" for n, c in _CHECKS.items()))
def check_templates(spark, path):
    checks = {n: quality.check(kind, template, column, **params) for n, (kind, template, column, params, _) in _CHECKS.items()}
    return quality.failures(_t(spark, path, "lineitem"), checks)


@query("SELECT count(*) AS n, count(*) FILTER (p_partkey % 3 <> 0) AS n_ok, round(count(*) FILTER (p_partkey % 3 <> 0) / count(*), 4) AS ok_rate, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT p_name AS v FROM part WHERE p_partkey % 3 = 0 ORDER BY v LIMIT 5)) AS examples FROM part")
def cast_compat(spark, path):
    df = _t(spark, path, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("k"))
    return quality.compatibility(df, "k", "INTEGER").withColumn("examples", F.array_join("examples", "|"))


@query("SELECT v AS o_orderstatus FROM (VALUES ('X'), ('F'), ('Q')) t(v) WHERE v NOT IN (SELECT o_orderstatus FROM orders)")
def value_domain(spark, path):
    return quality.unknown_values(_t(spark, path, "orders"), "o_orderstatus", ["X", "F", "Q"])


@query("SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0")
def fk_orphans(spark, path):
    parents = _t(spark, path, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("doc_id"))
    return quality.orphans(_t(spark, path, "labels").select("doc_id", "quality"), "doc_id", parents, "doc_id")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys(spark, path):
    return quality.duplicate_keys(_t(spark, path, "orders"), ["o_custkey"])


@query("SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n_lines, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '' AND regexp_matches(x, '[0-9]') AND len(regexp_split_to_array(trim(x), '\\s+')) >= 2)) AS n_data FROM documents")
def line_stats(spark, path):
    return quality.data_lines(_t(spark, path, "documents"), "doc_id", "text").select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_data").cast("long").alias("n_data"))


@query("SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, 'License') AND NOT contains(x, 'token')), chr(10))) AS digest FROM documents")
def strip_lines(spark, path):
    df = _t(spark, path, "documents").withColumn("found", F.array(F.lit("License"), F.lit("token"), F.lit("x")))
    return quality.without_lines(df, "text", "found").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT DISTINCT table_name FROM duckdb_columns() WHERE column_name LIKE '%key%' AND table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem')")
def meta_search(spark, path):
    return Catalog.of_directory(spark, path).search("key")


# changes, as plans


def _store(spark, path, table: str, *specs: TableSpec, **marks) -> mutate.Store:
    """A store with one of the test tables, its columns marked as told, and further empty tables."""
    df = _t(spark, path, table)
    spec = TableSpec(table, tuple(ColumnSpec(f.name, f.dataType.simpleString().upper(), **marks.get(f.name, {})) for f in df.schema))
    store = mutate.Store(spark, shared_folder(spark, "store"))
    store.write({table: df}, {table: spec})
    if specs:
        store.create(list(specs))
    return store


@query("SELECT p_partkey, p_name, p_brand, p_type, p_retailprice, CAST(NULL AS VARCHAR) AS note FROM part")
def add_drop_column(spark, path):
    store = _store(spark, path, "part")
    store.add_column("part", ColumnSpec("note", "TEXT"))
    store.drop_column("part", "p_size")
    return store.catalog.table("part")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, CAST(CAST(p_retailprice AS DECIMAL(20,2)) AS DOUBLE) AS p_retailprice FROM part")
def modify_type(spark, path):
    store = _store(spark, path, "part")
    store.modify_type("part", "p_size", "DOUBLE")
    store.modify_type("part", "p_retailprice", "DECIMAL(20,2)", force=True)
    return store.catalog.table("part").select("p_partkey", "p_size", F.col("p_retailprice").cast("double").alias("p_retailprice"))


@query("SELECT 'p_size' AS name, true AS not_null UNION ALL SELECT 'p_name', false")
def not_null_check(spark, path):
    store = _store(spark, path, "part")
    store.write({"part": store.catalog.table("part").withColumn("p_name", F.when(F.col("p_partkey") > 1, F.col("p_name")))})
    for name in ("p_size", "p_name"):
        try:
            store.set_not_null("part", name)
        except mutate.Refused:
            pass
    return store.catalog.describe("part").where(F.col("name").isin("p_size", "p_name")).select("name", "not_null")


_ITEMS = TableSpec("items", (ColumnSpec("code", "TEXT", unique=True, not_null=True), ColumnSpec("price", "FLOAT", rules={"min": 0, "max": 20, "check": "ABS(price) < 100"}), ColumnSpec("region_id", "BIGINT")), (ForeignKey("region_id", "region", "r_regionkey"),))


@query("SELECT n_name AS code, CAST(nullif(n_nationkey, 3) AS DOUBLE) AS price, CAST(n_regionkey AS BIGINT) AS region_id, 5 AS refused FROM nation WHERE n_nationkey <= 20")
def insert_checked(spark, path):
    """Inserts of cleaned texts; five others break a rule, a unique column, a key, a type, or a value that must be there."""
    store = _store(spark, path, "region", _ITEMS, r_regionkey={"unique": True})
    price = F.when(F.col("n_nationkey") == 3, "—").otherwise(F.translate(F.col("n_nationkey").cast("string"), "0123456789", "０１２３４５６７８９"))
    rows = _t(spark, path, "nation").select(F.col("n_name").alias("code"), price.alias("price"), F.col("n_regionkey").alias("region_id"), "n_nationkey")
    store.insert("items", rows.where("n_nationkey <= 20").drop("n_nationkey"))
    refused = 0
    for bad in ({"code": "a", "price": "２１", "region_id": 1}, {"code": rows.where("n_nationkey = 5").first()["code"], "price": 1}, {"code": "b", "region_id": 99}, {"code": "c", "price": "dear"}, {"price": 2}):
        try:
            store.insert("items", bad)
        except mutate.Refused:
            refused += 1
    return store.catalog.table("items").drop("id").withColumn("refused", F.lit(refused))


@query("SELECT n_name AS code, CASE WHEN n_nationkey = 4 THEN 7.5 ELSE CAST(n_nationkey AS DOUBLE) END AS price, 'committed' AS state, 3 AS backups FROM nation WHERE n_nationkey <= 20 AND n_nationkey <> 6")
def store_reopened(spark, path):
    """A store's tables as a second store over its folder sees them, after a backup, a wrong change and its restoring."""
    store = _store(spark, path, "region", _ITEMS, r_regionkey={"unique": True})
    rows = _t(spark, path, "nation").where("n_nationkey <= 20").select(F.col("n_name").alias("code"), F.col("n_nationkey").alias("price"), F.col("n_regionkey").alias("region_id"))
    store.insert("items", rows)
    code = {r["price"]: r["code"] for r in rows.collect()}
    store.update("items", [_one("code", "=", code[4])], {"price": "7.5"})
    store.delete("items", [_one("code", "=", code[6])])
    number = [store.backup(keep=2) for _ in range(3)][-1]
    store.clear()
    again = mutate.Store(spark, store.folder)
    again.restore(number)
    again = mutate.Store(spark, store.folder)
    state = "committed" if again.catalog.specs["items"] == store.catalog.specs["items"] and not again.recovered else "lost"
    return again.catalog.table("items").select("code", "price", F.lit(state).alias("state"), F.lit(number).alias("backups"))


@query("SELECT n_name AS code, CAST(n_nationkey AS DOUBLE) AS price, CASE WHEN n_nationkey < 10 THEN 'running' ELSE 'after' END AS opened FROM nation WHERE n_nationkey <= 20")
def store_two_sessions(spark, path):
    """A second session opens a store while the first is about to publish a change; both go on, one after the other."""
    store = _store(spark, path, "region", _ITEMS, r_regionkey={"unique": True})
    rows = _t(spark, path, "nation").select(F.col("n_name").alias("code"), F.col("n_nationkey").alias("price"), F.col("n_regionkey").alias("region_id"))
    opened, publish = [], store._publish

    def met(*args):
        opened.append(mutate.Store(spark, store.folder))
        publish(*args)

    store._publish = met
    store.insert("items", rows.where("price < 10"))
    [state] = {*opened[0].recovered.values()}
    early = opened[0].catalog.table("items").count()
    late = mutate.Store(spark, store.folder)
    late.insert("items", rows.where("price BETWEEN 10 AND 20"))
    found = mutate.Store(spark, store.folder).catalog.table("items")
    return found.where(F.lit(early == 0)).select("code", "price", F.when(F.col("price") < 10, state).otherwise("after").alias("opened"))


def _families(spark, path, **actions) -> mutate.Store:
    """Customers and their orders as tables with ids; every customer's number is a key that orders hold."""
    buyers = _t(spark, path, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    sales = _t(spark, path, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("buyer"), F.col("o_orderkey").alias("number"))
    lines = _t(spark, path, "lineitem").select(F.monotonically_increasing_id().alias("id"), F.col("l_orderkey").alias("sale"))
    number = lambda name, **marks: ColumnSpec(name, "BIGINT", **marks)
    specs = [
        TableSpec("buyers", (number("id", pk=True, unique=True), number("code", unique=True), ColumnSpec("name"))),
        TableSpec("sales", (number("id", pk=True, unique=True), number("buyer"), number("number", unique=True)), (ForeignKey("buyer", "buyers", "code", **actions),)),
        TableSpec("lines", (number("id", pk=True, unique=True), number("sale")), (ForeignKey("sale", "sales", "number", **actions),)),
    ]
    store = mutate.Store(spark, shared_folder(spark, "store"))
    store.write({"buyers": buyers, "sales": sales, "lines": lines}, {s.name: s for s in specs})
    return store


@query("""
WITH free AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) ORDER BY c_custkey LIMIT 1), gone AS (SELECT * FROM free UNION ALL SELECT 1 WHERE 1 NOT IN (SELECT o_custkey FROM orders))
SELECT c_custkey AS code, CASE WHEN 1 IN (SELECT o_custkey FROM orders) THEN 'refused' ELSE 'gone' END AS first FROM customer WHERE c_custkey NOT IN (SELECT * FROM gone)
""")
def delete_restricted(spark, path):
    """A customer with orders stays, one without any goes."""
    store = _families(spark, path)
    try:
        store.delete("buyers", [_one("code", "=", 1)])
        first = "gone"
    except mutate.Refused:
        first = "refused"
    free = store.catalog.table("buyers").join(store.catalog.table("sales"), F.col("code") == F.col("buyer"), "left_anti").agg(F.min("code")).first()[0]
    if free is not None:
        store.delete("buyers", [_one("code", "=", free)])
    return store.catalog.table("buyers").select("code", F.lit(first).alias("first"))


@query("""
WITH gone AS (SELECT o_orderkey FROM orders WHERE o_custkey < 50)
SELECT 'buyers' AS name, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer WHERE c_custkey >= 50
UNION ALL SELECT 'sales', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_custkey >= 50
UNION ALL SELECT 'lines', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM gone)
""")
def delete_cascaded(spark, path):
    """Customers go with their orders and the lines of these, in one change."""
    store = _families(spark, path, on_delete="CASCADE")
    store.delete("buyers", [_one("code", "IN", list(range(50)))])
    sums = [store.catalog.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(c).alias("total")) for n, c in (("buyers", "code"), ("sales", "number"), ("lines", "sale"))]
    return sums[0].union(sums[1]).union(sums[2])


@query("SELECT o_orderkey AS number, CASE WHEN o_custkey = 7 THEN -7 ELSE o_custkey END AS buyer, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def update_cascaded(spark, path):
    """A customer's number changes, and its orders hold the new one."""
    store = _families(spark, path)
    store.update("buyers", [_one("code", "=", 7)], {"code": -7})
    return store.catalog.table("sales").join(store.catalog.table("buyers"), F.col("buyer") == F.col("code")).select("number", "buyer", "name")


@query("SELECT c_custkey AS code, 3 AS folders, true AS small FROM customer UNION ALL SELECT -r_regionkey - 1, 3, true FROM region")
def insert_appends(spark, path):
    """Two inserts add a folder each, smaller by far than the table, and touch no folder that was there."""
    store = _families(spark, path)
    before = mutate.folders(store.current["buyers"])
    for keys in ("r_regionkey < 3", "r_regionkey >= 3"):
        store.insert("buyers", _t(spark, path, "region").where(keys).select((-F.col("r_regionkey") - 1).alias("code"), F.col("r_name").alias("name")))
    after = mutate.folders(store.current["buyers"])

    def size(place: str) -> int:
        fs, p = store._fs(place)
        return fs.getContentSummary(p).getLength()

    small = after[: len(before)] == before and all(size(f["rows"]) < 5000 for f in after[len(before) :])
    return store.catalog.table("buyers").select("code", F.lit(len(after)).alias("folders"), F.lit(small).alias("small"))


# several places


def _live(spark) -> LiveSource:
    """An empty database within the driver's process; only a session without other machines reaches it."""
    name = f"live{uuid.uuid4().hex[:12]}"
    return LiveSource(spark, name, f"jdbc:derby:memory:{name};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver", "APP")


@query("""
SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, 'main' AS of_none, 'main' AS of_one, 'live' AS of_both, 'several' AS of_three, true AS pushed
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY n_name
""")
def federated_routing(spark, path):
    """Customers by nation, counted in a live database, and their orders, which lie in files."""
    live = _live(spark)
    live.create("nation", _t(spark, path, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name VARCHAR(100)")
    live.create("customer", _t(spark, path, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey", parents={"c_nationkey": ("nation", "n_nationkey")})
    sources = Sources(spark)
    sources.add("main", _c(spark, path, "orders"))
    sources.add(live.name, live)
    found = []
    for tables in ([], ["orders"], ["customer", "nation"], ["orders", "customer", "nation"]):
        try:
            found.append("live" if sources.owner(tables) == live.name else sources.owner(tables))
        except SeveralSources:
            found.append("several")
    counted = sources.catalog.table("customer").where("c_acctbal > 0").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    pushed = "PushedAggregates: [COUNT(*)]" in plan and "c_acctbal > 0" in plan.replace("`", "").replace('"', "").replace("0.0", "0")
    all_three = joins.joined(sources.catalog, "customer", ["nation", "orders"], "LEFT", [_one("customer.c_acctbal", ">", 0)]).frame
    ordered = all_three.groupBy("nation__n_nationkey", F.col("nation__n_name").alias("nation")).agg(F.count("orders__o_orderkey").alias("orders"))
    names = ("of_none", "of_one", "of_both", "of_three")
    return ordered.join(counted, F.col("nation__n_nationkey") == F.col("c_nationkey")).select("nation", "customers", "orders", *[F.lit(v).alias(n) for n, v in zip(names, found, strict=True)], F.lit(pushed).alias("pushed"))


@query("""
SELECT c_custkey AS code, c_name AS name, CASE c_custkey WHEN 3 THEN 10.5 WHEN 4 THEN NULL ELSE c_acctbal END AS balance, 'committed,compensated' AS states FROM customer
UNION ALL SELECT -1, 'new', 0.5, 'committed,compensated'
""")
def commit_two_sources(spark, path):
    """Customers' names in a store, their balances in a live database; of two changes to both, the first fails at its last step."""
    live, store = _live(spark), mutate.Store(spark, shared_folder(spark, "store"))
    live.create("accounts", _t(spark, path, "customer").select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("balance")), "code")
    spec = TableSpec("buyers", (ColumnSpec("id", "BIGINT", pk=True, unique=True), ColumnSpec("code", "BIGINT", unique=True), ColumnSpec("name")))
    store.write({"buyers": _t(spark, path, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))}, {"buyers": spec})
    sources = Sources(spark)
    sources.add("main", store)
    sources.add(live.name, live)
    folder = shared_folder(spark, "changes")
    account = lambda code, balance: spark.createDataFrame([(code, balance)], live.frame("accounts").schema)
    failing = [
        Step("buyers", "update", conditions=[_one("code", "=", 1)], values={"name": "wrong"}),
        Step("buyers", "delete", conditions=[_one("code", "=", 2)]),
        Step("accounts", "delete", conditions=[_one("balance", ">", 1000), _one("code", ">", 1)]),
        Step("accounts", "update", conditions=[_one("code", "<", 50)], values={"balance": -1}),
        Step("accounts", "insert", account(1, 0.0)),
    ]
    try:
        commit(sources, failing, folder)
    except Exception as e:
        if "duplicate key" not in str(e):
            raise
    commit(sources, [
        Step("buyers", "insert", [{"code": -1, "name": "new"}]),
        Step("accounts", "insert", account(-1, 0.5)),
        Step("accounts", "update", conditions=[_one("code", "=", 3)], values={"balance": 10.5}),
        Step("accounts", "delete", conditions=[_one("code", "=", 4)]),
    ], folder)
    states = ",".join(sorted(c["state"] for c in changes(spark, folder).values()))
    return sources.catalog.table("buyers").join(sources.catalog.table("accounts"), "code", "left").select("code", "name", "balance", F.lit(states).alias("states"))


@query("SELECT * FROM (VALUES ('INSERT', 'yes'), ('INSERT of other values', 'no'), ('UPDATE', 'yes'), ('UPDATE of missing rows', 'no'), ('DELETE', 'yes'), ('DELETE of rows still there', 'no'), ('DELETE of none', 'unknown')) t(claim, verified)")
def verify_insert(spark, path):
    after = _t(spark, path, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    held = [r.asDict() for r in after.orderBy("o_orderkey").limit(3).collect()]
    ids, gone = [r["o_orderkey"] for r in held], [-1, -2]
    said = {
        "INSERT": dict(action="INSERT", rows=held), "INSERT of other values": dict(action="INSERT", rows=[held[0], {**held[1], "o_custkey": -5}]),
        "UPDATE": dict(action="UPDATE", ids=ids[:1], affected=1, values={"o_custkey": str(held[0]["o_custkey"])}), "UPDATE of missing rows": dict(action="UPDATE", ids=[*ids, -1]),
        "DELETE": dict(action="DELETE", ids=gone, affected=2), "DELETE of rows still there": dict(action="DELETE", ids=[*gone, *range(1000), ids[0]]), "DELETE of none": dict(action="DELETE"),
    }
    names = {True: "yes", False: "no", None: "unknown"}
    return spark.createDataFrame([(claim, names[reconcile.verify(after, "o_orderkey", **x)[0]]) for claim, x in said.items()], "claim string, verified string")


@query("SELECT * FROM (VALUES ('missing_table', 'ghost', ''), ('key_target', 'nation', 'n_regionkey to region.code'), ('key_type', 'nation', 'n_name to region.r_regionkey'), ('missing_column', 'region', 'code2'), ('undeclared_table', 'part', '')) t(kind, table_name, name) UNION ALL SELECT 'not_unique', 'nation', 'n_regionkey' WHERE EXISTS (SELECT 1 FROM nation GROUP BY n_regionkey HAVING count(*) > 1)")
def consistency_keys(spark, path):
    c = _c(spark, path, "nation", "region")
    nation, region = c.specs["nation"], c.specs["region"]
    marked = tuple(ColumnSpec(x.name, x.type, unique=x.name in ("n_regionkey", "n_nationkey")) for x in nation.columns)
    c.specs = {"nation": TableSpec("nation", marked, (ForeignKey("n_regionkey", "region", "code"), ForeignKey("n_name", "region", "r_regionkey"))), "region": TableSpec("region", (*region.columns, ColumnSpec("code2")))}
    c.specs["ghost"] = TableSpec("ghost", (ColumnSpec("x"),))
    c.frames["part"] = _t(spark, path, "part")
    return catalog_inconsistencies(c)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def selection_export(spark, path):
    folder = shared_folder(spark, "selections")
    held = selection.Selections(spark, folder)
    df = _t(spark, path, "customer").select("c_custkey", "c_name", "c_mktsegment")
    entry = held.save(filtered(df, [_one("c_mktsegment", "=", "BUILDING")]), "customer", "c_custkey")
    held.export(entry["number"], df, f"{folder}/export")
    return spark.read.option("header", True).csv(f"{folder}/export").select("c_custkey", "c_name")


@query("SELECT 'orders' AS table_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'events', count(*) FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING'")
def reverse_ref_counts(spark, path):
    own = filtered(_t(spark, path, "customer"), [_one("c_mktsegment", "=", "BUILDING")])
    return reconcile.reference_counts(own, "c_custkey", [("orders", _t(spark, path, "orders"), "o_custkey"), ("events", _t(spark, path, "events"), "user_id")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 100 = 1")
def upsert_snapshot(spark, path):
    old = _t(spark, path, "customer").select("c_custkey", "c_name")
    changed = old.where("c_custkey % 10 = 0").union(old.where("c_custkey % 100 = 1").select(-F.col("c_custkey"), "c_name")).select("c_custkey", F.lit("new").alias("c_name"))
    return mutate.upserted(old, changed, "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_snapshot(spark, path):
    return mutate.updated(_t(spark, path, "customer"), F.col("c_mktsegment") == "BUILDING", {"c_acctbal": 0.0}).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 1000, false)")
def delete_snapshot(spark, path):
    return mutate.deleted(_t(spark, path, "customer"), F.col("c_acctbal") < 1000).select("c_custkey")


# retrieval

_L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: power(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))"


def _first_vector(spark, path) -> list[float]:
    return list(_t(spark, path, "embeddings").orderBy("vec_id").limit(1).first()["embedding"])


@query(f"SELECT e.vec_id, round({_L2}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY {_L2}, e.vec_id LIMIT 10")
def vector_topk(spark, path):
    return retrieval.nearest(_t(spark, path, "embeddings"), "vec_id", "embedding", _first_vector(spark, path), 10).select("vec_id", F.round("distance", 6).alias("distance"))


_HYBRID = f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), p AS (
  SELECT d.lang AS collection, d.source, d.doc_id // 10 AS page, substr(d.text, 1, 5000) AS text, {_L2} AS distance
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, q
), n AS (SELECT count(DISTINCT collection) AS n FROM p), near AS (
  SELECT p.*, row_number() OVER (PARTITION BY collection ORDER BY distance, source, page) AS rank FROM p
), c AS (SELECT near.* FROM near, n WHERE rank <= greatest(15, 500 // n) ORDER BY collection, rank LIMIT 500), s AS (
  SELECT *, 0.7 * greatest(0.0, 1 - distance) + 0.3 * (CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'version') AS INT)) / 2 AS score,
    row_number() OVER (PARTITION BY source, page ORDER BY distance, collection) AS best FROM c
) SELECT collection, source, page, round(score, 6) AS score FROM s WHERE best = 1 ORDER BY s.score DESC, source, page LIMIT 10
"""


@query(_HYBRID)
def hybrid_topk(spark, path):
    pieces = _t(spark, path, "documents").join(_t(spark, path, "embeddings"), F.col("vec_id") == F.col("doc_id"))
    pieces = pieces.select(F.col("lang").alias("collection"), "source", F.floor(F.col("doc_id") / 10).alias("page"), "text", "embedding")
    return retrieval.hybrid(pieces, _first_vector(spark, path), "the license and the version", 5).select("collection", "source", "page", F.round("score", 6).alias("score"))


# metrics

_MINUTE = "SELECT time_bucket(INTERVAL 60 seconds, ts) AS minute, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total_ms FROM events GROUP BY 1"


def _minutes(spark, path) -> DataFrame:
    events = _t(spark, path, "events").withColumn("value", _money("value"))
    return rollup.by_minute(events, "ts", F.col("event_type") == "error", F.col("value")).withColumn("total_ms", F.col("total_ms").cast("double")).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


query(_MINUTE, "minute_rollup")(_minutes)


@query(f"WITH m AS ({_MINUTE}), f AS (SELECT unnest(generate_series(min(minute), max(minute), INTERVAL 60 seconds)) AS minute FROM m) SELECT f.minute, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors, coalesce(total_ms, 0) AS total_ms FROM f LEFT JOIN m USING (minute)")
def minute_rollup_filled(spark, path):
    return rollup.filled(_minutes(spark, path))


@query(f"WITH m AS ({_MINUTE}) SELECT minute, 'error_rate' AS kind, round(errors / n, 6) AS value FROM m WHERE errors / n > 0.05")
def minute_alerts(spark, path):
    return rollup.alerts(_minutes(spark, path)).select("minute", "kind", F.round("value", 6).alias("value"))


@query("SELECT event_id, ts, value FROM events WHERE value > 50 ORDER BY ts DESC, event_id LIMIT 20")
def slow_events(spark, path):
    return rollup.slow(_t(spark, path, "events"), "ts", "value", "event_id", above=50).select("event_id", "ts", "value")


@query("SELECT '/' || event_type || '/:id' AS path, count(*) AS n, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS avg_ms, CAST(max(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS max_ms FROM events GROUP BY event_type ORDER BY n DESC, path LIMIT 20")
def type_rollup(spark, path):
    events = _t(spark, path, "events").withColumn("value", _money("value"))
    own = rollup.endpoints(events, F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), F.col("user_id")), F.col("event_type") == "error", F.col("value"))
    return own.select("path", "n", "errors", F.round(F.col("avg_ms").cast("double"), 6).alias("avg_ms"), F.col("max_ms").cast("double").alias("max_ms"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_limit_window(spark, path):
    return rollup.rate_limited(_t(spark, path, "events"), "user_id", "ts", "event_id", 3, seconds=3600).select("event_id", "recent")


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def masked_star(spark, path):
    return Policy(denied_columns={"customer": {"c_acctbal"}}).view(_t(spark, path, "customer"), "customer")


# mapping

_PARTS = [TableSpec("items", (ColumnSpec("id", "BIGINT", pk=True), ColumnSpec("code", "TEXT", "code", unique=True), ColumnSpec("name", "TEXT", "name"), ColumnSpec("price", "FLOAT", "price")))]


@query("SELECT p_partkey AS code, p_name AS name, p_retailprice AS price FROM part")
def map_headers(spark, path):
    """Source tables of at most a thousand rows each, as files bring them."""
    row = F.array(F.col("p_partkey").cast("string"), "p_name", F.col("p_retailprice").cast("string"))
    rows = _t(spark, path, "part").select(F.floor(F.col("p_partkey") / 1000).alias("source_id"), row.alias("row"))
    tables = rows.groupBy("source_id").agg(F.collect_list("row").alias("rows")).withColumn("headers", F.array(F.lit("Code"), F.lit("Name"), F.lit("Price (EUR)")))
    good, _ = mapping.mapped(tables, _PARTS)
    return good.select(F.col("values")["code"].cast("long").alias("code"), F.col("values")["name"].alias("name"), F.col("values")["price"].cast("double").alias("price"))


@query("SELECT p_partkey AS code, p_name AS name, CAST(count(*) FILTER (p_partkey % 2 = 1) OVER () AS BIGINT) AS waiting FROM part QUALIFY p_partkey % 2 = 0")
def mapping_replayed(spark, path):
    """Parts in tables under two unknown headings; rules confirmed later solve one of them, the other goes on waiting."""
    row = F.array(F.col("p_partkey").cast("string"), "p_name", F.col("p_retailprice").cast("string"))
    heads = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Nr"), F.lit("Title"), F.lit("Cost"))).otherwise(F.array(F.lit("Nr"), F.lit("Words"), F.lit("Cost")))
    rows = _t(spark, path, "part").select(heads.alias("headers"), F.concat_ws("-", F.col("p_partkey") % 2, F.floor(F.col("p_partkey") / 1000)).alias("source_id"), row.alias("row"))
    tables = rows.groupBy("source_id", "headers").agg(F.collect_list("row").alias("rows"))
    kept = mapping.Retained(spark, shared_folder(spark, "retained"))
    kept.keep(tables, mapping.mapped(tables, _PARTS)[1])
    kept.confirm({"Nr": {"table": "items", "field": "code"}, "Title": {"table": "items", "field": "name"}})
    good, _ = kept.replay(_PARTS)
    left = kept.waiting().agg(F.coalesce(F.sum(F.size("rows")), F.lit(0)).cast("long").alias("waiting"))
    return good.select(F.col("values")["code"].cast("long").alias("code"), F.col("values")["name"].alias("name"), F.lit(left.first()[0]).alias("waiting"))


@query("SELECT r_name AS name, CAST(r_regionkey AS VARCHAR) AS code FROM region")
def transpose_map(spark, path):
    rows = _t(spark, path, "region").agg(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("x"))
    one = lambda head, get: F.concat(F.array(F.lit(head)), F.transform("x", get))
    headers = F.concat(F.array(F.lit("#")), F.transform("x", lambda r: F.concat(F.lit("no "), r["r_name"])))
    tables = rows.select(F.lit(1).alias("source_id"), headers.alias("headers"), F.array(one("code", lambda r: r["r_regionkey"].cast("string")), one("name", lambda r: r["r_name"])).alias("rows"))
    good, _ = mapping.mapped(tables, _PARTS)
    return good.select(F.col("values")["name"].alias("name"), F.col("values")["code"].alias("code"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity >= 5)) OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def grouped_ingest(spark, path):
    main = _t(spark, path, "orders").withColumnRenamed("o_orderkey", "code")
    details = _t(spark, path, "lineitem").withColumnRenamed("l_orderkey", "code")
    return mapping.grouped_ingest(main, details, "code", F.lit(True), F.col("l_quantity") >= 5)["main"].select(F.col("code").alias("o_orderkey"))


@query("SELECT l_orderkey AS code, 'detail invalid' AS reason FROM lineitem GROUP BY l_orderkey HAVING NOT bool_and(l_quantity >= 5)")
def grouped_rejects(spark, path):
    main = _t(spark, path, "orders").withColumnRenamed("o_orderkey", "code")
    details = _t(spark, path, "lineitem").withColumnRenamed("l_orderkey", "code")
    return mapping.grouped_ingest(main, details, "code", F.lit(True), F.col("l_quantity") >= 5)["rejects"]


@query("SELECT doc_id, batch, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT conv_id AS doc_id, turn + 1 AS u, unnest(CASE WHEN turn % 3 = 2 THEN [turn // 3, turn // 3 + 1] ELSE [turn // 3] END) AS batch FROM conversations) t WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = t.doc_id AND c.turn // 3 = t.batch) GROUP BY doc_id, batch")
def batches_with_overlap(spark, path):
    units = _t(spark, path, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("unit_no"), "text")
    return mapping.unit_batches(units).select("doc_id", F.col("batch").cast("long").alias("batch"), F.size("texts").cast("long").alias("n"))


@query(r"""
    WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    sizes(tier, size, again) AS (VALUES ('batches', 3, 1), ('flushes', 5, 0)),
    u AS (SELECT tier, conv_id, turn, text, size, turn // size AS batch FROM c, sizes
          UNION ALL SELECT tier, conv_id, turn, text, size, turn // size + 1 FROM c, sizes WHERE again = 1 AND turn % size = size - 1)
    SELECT tier, conv_id AS doc_id, batch, string_agg(text, chr(10) ORDER BY turn) AS texts FROM u
    WHERE EXISTS (SELECT 1 FROM c WHERE c.conv_id = u.conv_id AND c.turn // u.size = u.batch) GROUP BY ALL""")
def unit_stream(spark, path):
    """Conversations as a stream of turns, through both tiers; a stream takes a single file by pattern only."""
    rows = _t(spark, path, "conversations")
    units = rows.groupBy("conv_id").agg(F.count("*").alias("units"))
    arriving = spark.readStream.schema(rows.schema).parquet(f"{path}/conversations.parque[t]").join(units, "conv_id")
    folder = shared_folder(spark, "units")
    for q in two_tiers(arriving.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("unit_no"), "text", "units"), folder):
        q.awaitTermination()
    each = [tier(spark, folder, name).withColumn("tier", F.lit(name)) for name in ("flushes", "batches")]
    texts = F.array_join("texts", "\n", "")
    return each[0].union(each[1]).select("tier", F.col("doc_id").cast("long").alias("doc_id"), "batch", texts.alias("texts"))
