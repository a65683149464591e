import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as fn
from millrace.operators import mapping, mutate, profile, quality, reconcile, retrieval
from millrace.plans.catalog import ColumnSpec, ForeignKey, TableSpec
from millrace.sources import files, sinks
from millrace.streaming import rollup


def column(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(expr(F.col("v"))).collect()]


def test_value_cleaning(spark):
    assert column(spark, ["１２３．４５", " 7 ", "—", "无", "n/a", "", None, "x"], fn.clean_number) == ["123.45", "7", None, None, None, None, None, "x"]
    assert column(spark, ["Ａ１⁃１９", "A 1–25", "一"], fn.clean_code) == ["A1-19", "A1-25", "-"]
    assert column(spark, ["一"], lambda c: fn.clean_code(c, numeral_dash=False)) == ["一"]
    headers = ["订 单 编 号", "Price (EUR)", "全费用（元）", "", "a(b)c"]
    assert column(spark, headers, fn.clean_key) == [fn.key_of(h) for h in headers] == ["订单编号", "price", "全费用", "", "a(b)c"]
    assert column(spark, ["/a/12/b", "/u/123e4567-e89b-12d3-a456-42661417400a"], fn.plain_path)[0] == "/a/:id/b"
    assert column(spark, ["12", "x", None, "１２"], lambda c: fn.converts(c, "INT")) == [True, False, None, True]
    assert column(spark, ["abcd"], lambda c: fn.similarity(c, F.lit("abxd"))) == [0.75]
    assert column(spark, ["hello", " "], lambda c: fn.stable_code(c, F.lit("z"))) == ["5D41402A", "FBADE9E3"]


def test_rules_and_checks(spark):
    df = spark.createDataFrame([(1, 5, "abc"), (2, 50, "xbc"), (3, None, None), (4, 7, "zz")], "id int, n int, s string")
    out = quality.violations(df, {"n": {"min": 1, "max": 10, "enum": [1]}, "s": {"pattern": "a|x", "enum": ["abc", "zz"]}}, "id")
    assert sorted(map(tuple, out.collect())) == [(2, "n", "max"), (4, "s", "pattern")]
    assert quality.violations(df, {}, "id").count() == 0
    assert quality.guarded("LENGTH(s) > 1 AND n >= 0", {"s", "n"})
    for bad in ("n > 0; drop", "sleep(1) > 0", "n > 0 -- x", "other = 1", "n > (SELECT 1)"):
        with pytest.raises(ValueError):
            quality.guarded(bad, {"n", "s"})
    assert sum(len(t) - 1 for t in quality.TEMPLATES.values()) == 40
    with pytest.raises(ValueError):
        quality.check("BLOB", "int_positive", "n")
    assert df.where(quality.check("INTEGER", "int_range", "n", min=1, max=10)).count() == 2


def test_types(spark):
    levels = [quality.change_risk(*p).level for p in (("INT", "BIGINT"), ("INT", "FLOAT"), ("FLOAT", "INT"), ("TEXT", "INT"), ("INT", "TEXT"), ("DATE", "DATETIME"), ("DATETIME", "DATE"), ("TEXT", "BLOB"), ("BOOL", "INT"), ("DATE", "INT"), ("", "INT"))]
    assert levels == ["safe", "safe", "warning", "danger", "safe", "safe", "warning", "safe", "safe", "danger", "safe"]
    df = spark.createDataFrame([("1",), ("x",), (None,), ("２",)], "v string")
    row = quality.compatibility(df, "v", "INT").first()
    assert (row["n"], row["n_ok"], row["examples"]) == (3, 2, ["x"])
    assert quality.compatibility(df.where("false"), "v", "INT").first()["ok_rate"] == 1.0
    spec = TableSpec("t", (ColumnSpec("v", "INT", not_null=True),))
    assert [(r["v"], r["bad"]) for r in quality.typed(df, spec).collect()] == [(1, []), (None, ["v"]), (None, ["v"]), (2, [])]


def test_profile_and_fullest(spark):
    df = spark.createDataFrame([("a", 1, ""), ("a", 1, "x"), ("a", 1, "x"), ("b", None, None)], "k string, n int, s string")
    kept, others = profile.fullest(df, "k")
    assert sorted(map(tuple, kept.collect())) == [("a", 1, "x"), ("b", None, None)] and others.count() == 1
    rows = {r["column"]: r for r in profile.columns(df).collect()}
    assert (rows["n"]["non_null"], rows["n"]["distinct"], rows["n"]["samples"]) == (3, 1, ["1"])
    assert profile.columns(df.where("false")).count() == 0
    reasons = spark.createDataFrame([("bad x",), ("bad x",), ("other",)], "r string")
    assert tuple(profile.commonest_reason(reasons, "r", 2).first()) == ("bad x", 2, True)
    found = spark.createDataFrame([("t", 100, "a"), ("t", 100, "b"), ("u", 80, "a"), ("u", 50, "b")], "k string, p int, target string")
    assert {r["k"]: r["ambiguous"] for r in profile.ranked_candidates(found, "k", "p", "target").collect()} == {"t": True, "u": False}
    assert profile.newest(found, "p", 1, ["k"], ["target"]).count() == 2


def test_reconciliation(spark):
    a, b = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(map(tuple, reconcile.differences(a, b, ["k"]).collect()), key=str) == [(1, "left"), (3, "right"), (None, "left")]
    assert reconcile.verify_deleted(b, "k", [1]) and not reconcile.verify_deleted(b, "k", [2]) and reconcile.verify_deleted(b, "k", []) is None
    assert reconcile.verify_present(b, "k", [2, 3]) and not reconcile.verify_present(b, "k", [2, 9])
    assert reconcile.verify_present(b, "k", [2], {"k": 3}) is False
    assert quality.orphans(a, "k", b, "k").count() == 2
    assert reconcile.common_columns(a.withColumn("x", F.lit(1)), ["x", "y"]).columns == ["x"]


@pytest.fixture
def store(spark, tmp_path):
    s = mutate.Store(spark, f"file://{tmp_path}/store")
    s.create([TableSpec("b", (ColumnSpec("a_id", "BIGINT"), ColumnSpec("note")), (ForeignKey("a_id", "a", "id"),)), TableSpec("a", (ColumnSpec("code", unique=True, not_null=True), ColumnSpec("price", "FLOAT")))])
    s.insert("a", spark.createDataFrame([("x", "1.5"), ("y", "2")], "code string, price string"))
    return s


def test_inserts_updates_and_deletes(spark, store):
    rows = lambda: sorted((r["id"], r["code"], r["price"]) for r in store.catalog.table("a").collect())
    assert rows() == [(1, "x", 1.5), (2, "y", 2.0)]
    one = spark.createDataFrame([("y", 9.0)], "code string, price double")
    for bad in (one, one.withColumn("id", F.lit(5)), one.union(one), spark.createDataFrame([(None, 1.0)], one.schema)):
        with pytest.raises(mutate.Refused):
            store.insert("a", bad)
    store.insert("a", one, overwrite=True)
    assert rows() == [(1, "x", 1.5), (3, "y", 9.0)]
    store.update("a", [{"field": "code", "value": "x"}], {"price": "7"})
    store.delete("a", [{"field": "id", "value": 3}])
    assert rows() == [(1, "x", 7.0)]
    for bad in ([], [{"field": "price", "value": 7}], [{"field": "id", "value": 1}, {"field": "price", "value": 7, "link": "OR"}]):
        with pytest.raises(mutate.Refused):
            store.delete("a", bad)
    store.undo()
    assert len(rows()) == 2
    assert store.change_confirmed("a", F.col("price") > 0, mutate.deleted, lambda sample: False) == 0 and len(rows()) == 2
    assert store.vacuum() >= 0


def test_declared_changes(spark, store):
    store.insert("b", spark.createDataFrame([(1, "n")], "a_id long, note string"))
    assert mutate.impact(store.catalog, "a", F.col("code") == "x")["references"] == {"b": 1}
    for change in (lambda: store.drop_table("a"), lambda: store.drop_column("a", "id"), lambda: store.drop_column("b", "a_id"), lambda: store.modify_type("b", "a_id", "TEXT"), lambda: store.modify_type("a", "code", "INT"), lambda: store.add_column("a", ColumnSpec("z", "JSON"))):
        with pytest.raises(mutate.Refused):
            change()
    store.add_column("a", ColumnSpec("size", "INT"))
    with pytest.raises(mutate.Refused):
        store.set_not_null("a", "size")
    store.set_unique("a", "code")
    store.modify_type("a", "price", "INT", force=True)
    assert dict(store.catalog.table("a").dtypes)["price"] == "bigint"
    store.drop_column("a", "size")
    store.add_foreign_key("b", ForeignKey("other_id", "a", "id"))
    store.drop_foreign_key("b", "other_id")
    assert "other_id" in store.catalog.table("b").columns
    store.rename("a", "c")
    assert store.catalog.specs["b"].foreign_keys[0].references == "c" and store.catalog.table("c").count() == 2
    store.drop_table("b")
    assert "b" not in store.current


ITEMS = [
    TableSpec("items", (ColumnSpec("id", "INT", pk=True), ColumnSpec("quota_code", "TEXT", "定额编号", unique=True), ColumnSpec("quota_name", "TEXT", "定额名称"), ColumnSpec("base_price", "FLOAT", "全费用基价"))),
    TableSpec("materials", (ColumnSpec("id", "INT", pk=True), ColumnSpec("item_id", "INT"), ColumnSpec("material_name", "TEXT", "材料名称"), ColumnSpec("unit_price", "FLOAT", "材料单价"))),
]


def tables(spark, *given):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(given)], "source_id int, headers array<string>, rows array<array<string>>")


def test_header_matching():
    index = mapping.FieldIndex.of(ITEMS, rules={"旧名": {"table": "items", "field": "quota_name"}, "备注": {"ignore": True}})
    assert index.match("定额编号") == (("items", "quota_code"), 1.0)
    assert index.match("全费用(元)") == (("items", "base_price"), 0.7)
    assert index.match("旧名") == (("items", "quota_name"), 1.0) and index.match("备注") == (None, -1.0)
    assert index.match("名称") == (None, 0.0) and index.match("id") == (("materials", "item_id"), 0.7)
    assert index.suggestion("定额编码")[0] == ("items", "quota_code") and index.suggestion("zzz") == (None, 0.0)


def test_tables_are_mapped_turned_or_kept(spark):
    straight = (["定额编号", "定额名称", "全费用（元）"], [["A1", "one", "１２．５"], ["", " ", ""], ["A2", "two"]])
    turned = (["定额编号", "B1", "B2"], [["定额名称", "three", "four"], ["全费用", "3", "4"]])
    half = (["定额编号", "unknown"], [["C1", "x"]])
    detail = (["定额编号", "材料名称", "单价"], [["A1", "sand", "2"]])
    twice = (["定额名称", "定额名称"], [["x", "y"]])
    good, rest = mapping.mapped(tables(spark, straight, turned, half, detail, twice), ITEMS)
    rows = sorted((r["source_id"], r["table"], tuple(sorted(r["values"].items())), tuple((r["links"] or {}).items())) for r in good.collect())
    assert rows == [
        (0, "items", (("base_price", "12.5"), ("quota_code", "A1"), ("quota_name", "one")), ()),
        (0, "items", (("quota_code", "A2"), ("quota_name", "two")), ()),
        (1, "items", (("base_price", "3"), ("quota_code", "B1"), ("quota_name", "three")), ()),
        (1, "items", (("base_price", "4"), ("quota_code", "B2"), ("quota_name", "four")), ()),
        (3, "materials", (("material_name", "sand"), ("unit_price", "2")), (("quota_code", "A1"),)),
    ]
    assert sorted((r["source_id"], r["kind"]) for r in rest.collect()) == [(2, "table"), (4, "table")]
    assert mapping.mapped(tables(spark, half), ITEMS, confirmed=True)[0].count() == 1
    assert mapping.mapped(tables(spark, straight).where("false"), ITEMS)[0].count() == 0


def test_pairs_codes_groups_and_batches(spark):
    pairs = spark.createDataFrame([(1, {"定额编号": "A", "定额名称": "n", "odd": "z"}), (2, {"定额编号": "A"})], "source_id int, kv map<string,string>")
    good, rest = mapping.mapped_pairs(pairs, ITEMS)
    assert [(r["source_id"], r["values"]) for r in good.collect()] == [(1, {"quota_code": "A", "quota_name": "n"})]
    assert sorted((r["source_id"], r["key"]) for r in rest.collect()) == [(1, "odd"), (2, "定额编号")]
    coded = mapping.with_codes(spark.createDataFrame([("Ａ 1", "x"), (None, "hello"), ("", "hello")], "code string, name string"), "code", ["name"])
    assert sorted(r["code"] for r in coded.collect()) == ["5D41402A", "5D41402A", "A1"]
    main = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0), ("d", 1), ("d", 1), ("e", 1)], "code string, ok int")
    detail = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 0), ("z", 1)], "code string, fine int")
    out = mapping.grouped_ingest(main, detail, "code", F.col("ok") == 1, F.col("fine") == 1, spark.createDataFrame([("e",)], "code string"))
    assert [r["code"] for r in out["main"].collect()] == ["a"] and out["details"].count() == 2
    assert {r["code"]: r["reason"] for r in out["rejects"].collect()} == {"b": "detail invalid", "c": "main row invalid", "d": "several main rows", "e": "code exists", "z": "no main row"}
    units = spark.createDataFrame([("d", i, f"u{i}") for i in range(1, 8)], "doc_id string, unit_no int, text string")
    assert {r["batch"]: r["texts"] for r in mapping.unit_batches(units).collect()} == {0: ["u1", "u2", "u3"], 1: ["u3", "u4", "u5", "u6"], 2: ["u6", "u7"]}


def test_retrieval(spark):
    assert retrieval.keywords("the License of a Version 20 材料的单价 查询混凝土价格") == ["license", "version", "20", "材料", "单价", "混凝", "凝土", "土价", "价格", "混凝土", "凝土价", "土价格"]
    rows = spark.createDataFrame([("a", "s1", 1, "license", [0.0, 0.0]), ("b", "s1", 1, "license version", [0.1, 0.0]), ("a", "s2", 1, "none", [0.2, 0.0]), ("a", "s3", 1, "version", [9.0, 0.0])], "collection string, source string, page int, text string, embedding array<double>")
    out = retrieval.hybrid(rows, [0.0, 0.0], "license version", 2).collect()
    assert [(r["source"], r["collection"], round(r["score"], 3)) for r in out] == [("s1", "a", 0.85), ("s2", "a", 0.672), ("s3", "a", 0.15)]
    assert [r["source"] for r in retrieval.nearest(rows, "source", "embedding", [9.0, 0.0], 1, "l2").collect()] == ["s3"]
    assert retrieval.collections(rows).first()["n"] == 3
    assert retrieval.upserted(rows, rows.where("source = 's2'").withColumn("text", F.lit("new")), "source").where("text = 'new'").count() == 1
    with pytest.raises(ValueError):
        retrieval.nearest(rows, "source", "embedding", [1.0, 2.0], 1, "other")


def test_rollups_in_batch_and_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    bad, took = F.col("event_type") == "error", F.col("value")
    batch = {r["minute"]: (r["n"], r["errors"]) for r in rollup.by_minute(events, "ts", bad, took).collect()}
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    query = rollup.stream_minutes(stream, "ts", bad, took, "minutes", f"file://{tmp_path}/state")
    query.awaitTermination()
    assert {r["minute"]: (r["n"], r["errors"]) for r in spark.table("minutes").collect()} == batch
    end = max(batch) + timedelta(seconds=30)
    series = rollup.series(rollup.by_minute(events, "ts", bad, took), end.isoformat(sep=" "), 5).collect()
    assert len(series) == 5 and max(r["minute"] for r in series) == max(batch)


def test_alerts_and_rates(spark):
    at = datetime(2024, 1, 1)
    minutes = spark.createDataFrame([(at, 100, 6, 0.0), (at + timedelta(minutes=1), 10, 0, 200_000.0), (at + timedelta(minutes=2), 10, 0, 10.0)], "minute timestamp, n long, errors long, total_ms double")
    assert sorted(r["kind"] for r in rollup.alerts(minutes).collect()) == ["error_rate", "mean_ms"]
    calls = spark.createDataFrame([("u", at + timedelta(seconds=s), i) for i, s in enumerate((0, 10, 59, 60, 200))], "u string, ts timestamp, id int")
    out = {r["id"]: (r["recent"], r["allowed"]) for r in rollup.rate_limited(calls, "u", "ts", "id", 2).collect()}
    assert out == {0: (1, True), 1: (2, True), 2: (3, False), 3: (3, False), 4: (1, True)}
    (log := '{"ts":"2024-01-01 00:00:00","role":"r","model":"m","in":1,"out":2,"cache_hit":0,"trace":"t"}')
    assert spark.read.schema("`in` long").json(spark.sparkContext.parallelize([log])).first()[0] == 1


def test_sources_and_sinks(spark, tmp_path):
    folder = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, s string").orderBy("id")
    assert sinks.csv(df, f"{folder}/out/a.csv") == 2
    assert (tmp_path / "out/a.csv").read_bytes().startswith(b"\xef\xbb\xbfid,s")
    assert [tuple(r) for r in files.delimited(spark, f"{folder}/out/a.csv").collect()] == [("1", "a,b"), ("2", None)]
    with pytest.raises(ValueError):
        sinks.csv(df.where("false"), f"{folder}/out/b.csv")
    assert sinks.sheet(df, f"{folder}/out/b.xlsx", "t" * 40) == 2
    assert {n for n, _ in sinks.listing(spark, f"{folder}/out")} == {"a.csv", "b.xlsx"}
    assert sinks.markdown(df.where("id = 1")) == "- **id**: 1\n- **s**: a,b" and sinks.markdown(df.select("id")).startswith("**id**") and sinks.markdown(df, {"s"}).count("\n") == 2
    assert files.search(spark, f"{folder}/out", "A,B", "*.csv").first()["line_no"] == 2
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>p{i}</w:t></w:r></w:p>" for i in range(60)) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "out/c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>')
    units = sorted((r["path"][-6:], r["unit_no"], r["table_count"], r["text"][:6]) for r in files.units(spark, f"{folder}/out").collect())
    assert [u[:3] for u in units] == [("b.xlsx", 1, 1), ("c.docx", 1, 0), ("c.docx", 2, 0), ("c.docx", 3, 1)]


def test_links_of_one_field_name_are_told_apart(spark):
    from millrace.plans.catalog import ColumnSpec, TableSpec

    code = lambda word: ColumnSpec("code", "TEXT", word, unique=True)
    specs = [TableSpec("a", (code("first code"),)), TableSpec("b", (code("second code"),)), TableSpec("c", (ColumnSpec("size"), ColumnSpec("shape"), ColumnSpec("shade")))]
    given = (["size", "shape", "shade", "first code", "second code", "First Code"], [["1", "round", "red", "x", "y", "z"]])
    good, rest = mapping.mapped(tables(spark, given), specs)
    assert [r["links"] for r in good.collect()] == [] and rest.count() == 1  # half of the headers are too few
    good, rest = mapping.mapped(tables(spark, (given[0][:5], given[1])), specs)
    assert [(r["table"], r["links"]) for r in good.collect()] == [("c", {"a.code": "x", "b.code": "y"})]


def test_retained_tables_are_mapped_once_their_headers_are_known(spark, tmp_path):
    kept = mapping.Retained(spark, f"file://{tmp_path}/kept")
    first, second = (["Nr", "定额名称", "?"], [["A1", "one", "!"]]), (["x", "y"], [["1", "2"]])
    given = tables(spark, first, second).withColumn("rows", mapping.F.col("rows"))
    kept.keep(given, mapping.mapped(given, ITEMS)[1])
    assert kept.waiting().count() == 2 and kept.replay(ITEMS)[0].count() == 0
    kept.confirm({"Nr": {"table": "items", "field": "quota_code"}, "?": {"ignore": True}})
    good, rest = kept.replay(ITEMS)
    assert [(r["source_id"], r["values"]) for r in good.collect()] == [("0", {"quota_code": "A1", "quota_name": "one"})] and rest.count() == 0
    assert [r["source_id"] for r in kept.waiting().collect()] == ["1"] and kept.replay(ITEMS)[0].count() == 0
    kept.keep(given, mapping.mapped(given, ITEMS)[1])  # the same headers again: they wait for the next replay
    assert kept.waiting().count() == 3 and kept.replay(ITEMS)[0].count() == 1 and kept.waiting().count() == 2
