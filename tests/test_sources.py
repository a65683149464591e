"""Sources and small functions that no query reaches."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import stable_code, vector_id
from millrace.operators import reconcile, retrieval
from millrace.plans.catalog import Catalog, ColumnSpec, ForeignKey, TableSpec
from millrace.plans.selection import Selections
from millrace.sources import files
from millrace.streaming import rollup

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_a_live_database_is_read_in_ranges(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = spark.range(200).select(F.col("id").alias("K"), F.concat(F.lit("n"), F.col("id")).alias("NAME"))
    rows.write.format("jdbc").options(url=url, dbtable="T", driver=DERBY).save()
    whole = files.jdbc(spark, url, "T", driver=DERBY)
    ranged = files.jdbc(spark, url, "T", "K", (0, 200), 4, driver=DERBY)
    assert whole.count() == 200 and ranged.rdd.getNumPartitions() == 4
    assert sorted(r["K"] for r in ranged.where("K >= 150").collect()) == list(range(150, 200))


def test_usage_lines_in_batch_and_stream(spark, tmp_path):
    lines = [{"ts": f"2024-01-01T00:0{i}:00Z", "role": "x", "model": "m", "in": i, "out": 2, "cache_hit": 0, "trace": "t"} for i in range(4)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    folder = f"file://{tmp_path}/log"
    assert rollup.usage_log(spark, folder, stream=False).agg(F.sum("in")).first()[0] == 6
    q = rollup.usage_log(spark, folder).writeStream.format("memory").queryName("usage").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("usage").where("role is not null").count() == 4


def test_ids_and_codes_of_content(spark):
    df = spark.createDataFrame([("f.pdf", 3, "text"), (None, None, "text"), ("f.pdf", None, "text")], "source string, page int, text string")
    ids = [r[0] for r in df.select(vector_id(F.col("source"), F.col("page"), F.col("text"))).collect()]
    assert len(set(ids)) == 2 and ids[1] == ids[2] and all(len(i) == 32 for i in ids)
    codes = spark.createDataFrame([("", "b"), (None, "b"), ("a", "b")], "x string, y string").select(stable_code(F.col("x"), F.col("y"))).collect()
    assert codes[0] == codes[1] != codes[2] and len(codes[0][0]) == 8


def test_rebuilt_tables_keep_common_columns(spark):
    assert reconcile.common_columns(spark.range(3).withColumn("x", F.lit(1)).withColumn("y", F.lit(2)), ["y", "z", "id"]).columns == ["id", "y"]


def test_collections_are_dropped_whole(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "collection string, n int")
    assert sorted(r["n"] for r in retrieval.without(df, "a").collect()) == [3, 4]


def test_keyword_pieces():
    assert retrieval.keywords("the Price of 12 steel, or 7 x") == ["price", "12", "steel"]
    assert retrieval.keywords("钢筋单价") == ["钢筋", "筋单", "单价", "钢筋单", "筋单价"]
    assert retrieval.keywords("钢筋") == ["钢筋"] and retrieval.keywords("") == []


def test_descriptions_and_graph(spark):
    c = Catalog(spark, [TableSpec("a", (ColumnSpec("id"), ColumnSpec("b_id", "BIGINT", "the b")), (ForeignKey("b_id", "b", "id"),)), TableSpec("b", (ColumnSpec("id"),), source="other")])
    assert [(r["name"], r["references"]) for r in c.describe("a").collect()] == [("id", None), ("b_id", "b.id")]
    assert c.nodes().count() == 2 and c.links().count() == 0  # edges stay within a source
    assert Catalog(spark, [TableSpec(n, (ColumnSpec("id"), ColumnSpec("k")), (ForeignKey("k", m, "id"),)) for n, m in (("z", "y"), ("y", "z"))]).ordered(["z", "y"]) == ["y", "z"]


def test_an_export_of_an_unknown_selection_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        Selections(spark, f"file://{tmp_path}").export(4, spark.range(1), f"file://{tmp_path}/x")


def test_sheets_without_references_and_with_typed_cells():
    import io
    import zipfile

    from millrace.sources import files

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="s" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/x.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;x&quot;"/><numFmt numFmtId="171" formatCode="0.00&quot;days&quot;[Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        cells = '<c><v>1</v></c><c t="b"><v>1</v></c><c s="1"><v>45292</v></c><c s="2"><v>45292.5</v></c><c s="3"><v>2.5</v></c>'
        z.writestr("xl/worksheets/x.xml", f'<worksheet {main}><sheetData><row>{cells}</row><row><c t="inlineStr"><is><t>a</t></is></c><c r="D2" t="b"><v>0</v></c><c s="1"><v>0.25</v></c></row><row r="5"><c s="1"><v>59</v></c><c s="1"><v>61</v></c></row><row><c/><c s="1"/></row></sheetData></worksheet>')
    [(title, rows)] = files.sheet_rows(data.getvalue())
    assert title == "s" and rows == [
        ["1", "True", "2024-01-01 00:00:00", "2024-01-01 12:00:00", "2.5"], ["a", "", "", "False", "06:00:00"], [""] * 5, [""] * 5,
        ["1900-02-28 00:00:00", "1900-03-01 00:00:00", "", "", ""], [""] * 5,
    ]
