"""Streams of metrics, and files as tables."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import clean_key, key_of
from millrace.operators import mapping
from millrace.plans.conditions import filtered
from millrace.sources import files, sinks
from millrace.streaming import rollup, units


def events(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id long, at double, kind string, ms double").withColumn("ts", F.timestamp_seconds("at"))
    df.coalesce(1).write.parquet(f"file://{tmp_path}/events")
    return df, spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/events")


def test_rate_limits_in_batch_and_stream_agree(spark, tmp_path):
    rows = [(i, i % 2, 100.0 + (i * 7) % 190, "view", 1.0) for i in range(120)] + [(500, None, 100.0, "view", 1.0)]
    batch, stream = events(spark, tmp_path, rows)
    known = {(u, e): sum(1 for _, v, b, *_ in rows if v == u and a - 60 < b <= a) for e, u, a, *_ in rows}
    own = rollup.rate_limited(batch, "user_id", "ts", "event_id", 5)
    assert own.count() == len(rows)
    assert {(r["user_id"], r["event_id"]): r["recent"] for r in own.collect()} == known
    assert all(r["allowed"] == (r["recent"] <= 5) for r in own.collect())
    q = rollup.stream_rate_limited(stream.where("user_id is not null"), "user_id", "ts", "event_id", 5).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = {(int(r["caller"]), int(r["event"])): r["recent"] for r in spark.table("limited").collect()}
    # of events at one moment a batch counts all, a stream those that came before
    first = {}
    for e, u, a, *_ in sorted(rows, key=lambda r: (r[2], str(r[0]))):
        first.setdefault((u, a), []).append(e)
    assert all(out[u, group[-1]] == known[u, group[-1]] for (u, _), group in first.items() if u is not None)


def test_a_busy_callers_events_go_to_many_slices(spark):
    df = spark.range(2000).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    out = rollup.rate_limited(df, "user_id", "ts", "event_id", 3)
    assert out.groupBy("recent").count().orderBy("recent").collect()[-1].asDict() == {"recent": 6, "count": 1995}


def test_alerts_of_closed_minutes_and_progress(spark, tmp_path):
    rows = [(i, 1, 60.0 * (i // 10) + i % 10, "error" if i % 10 == 0 and i < 20 else "view", 20_000.0 if i >= 40 else 5.0) for i in range(50)] + [(99, 1, 9_000.0, "view", 1.0)]
    _, stream = events(spark, tmp_path, rows)
    listener = rollup.Progress()
    spark.streams.addListener(listener)
    try:
        q = rollup.stream_alerts(stream, "ts", F.col("kind") == "error", F.col("ms"), f"file://{tmp_path}/alerts", f"file://{tmp_path}/check")
        q.awaitTermination(120)
        for _ in range(50):
            if str(q.id) in listener.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    out = spark.read.parquet(f"file://{tmp_path}/alerts").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in out} == {"error_rate": 2, "mean_ms": 1}
    assert sum(b["rows"] for b in listener.batches[str(q.id)]) == len(rows) and listener.ended[str(q.id)] is None


def workbook_with_moved_sheets():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda rows: f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="second" sheetId="5" r:id="r9"/><sheet name="first" sheetId="1" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r2" Target="worksheets/sheet1.xml" Type="x"/><Relationship Id="r9" Target="/xl/worksheets/sheet7.xml" Type="x"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([["a"], ["1"]]))
        z.writestr("xl/worksheets/sheet7.xml", sheet([["name", "", "name"], ["x", "y", "z"], *[[str(i), "", ""] for i in range(1200)]]))
    return out.getvalue()


def test_sheets_are_found_by_relation_and_read_as_tables(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook_with_moved_sheets())
    assert [(t, r[0]) for t, r in files.sheet_rows(workbook_with_moved_sheets())] == [("second", ["name", "", "name"]), ("first", ["a"])]
    path = f"file://{tmp_path}/b.xlsx"
    df = files.workbook(spark, path)
    assert df.columns == ["name", "column_2", "name_3"] and df.count() == 1201 and tuple(df.first()) == ("x", "y", "z")
    assert files.workbook(spark, path, "first").collect()[0][0] == "1" and files.workbook(spark, path, rows=2).count() == 2
    assert files.units(spark, path).count() == 4
    with pytest.raises(ValueError):
        files.workbook(spark, path, "third")


def test_several_tables_in_one_text(spark):
    text = sinks.markdown_tables({"one": spark.createDataFrame([(1, "x")], "a int, b string"), "none": spark.range(0)})
    assert "### one" in text and "- **a**: 1" in text and text.endswith("### none\n\nno rows")


def test_search_reads_large_files_unless_told(spark, tmp_path):
    (tmp_path / "big.txt").write_text("x\n" * 1_500_000 + "needle\n")
    assert files.search(spark, f"file://{tmp_path}", "NEEDLE").count() == 1
    assert files.search(spark, f"file://{tmp_path}", "needle", most_bytes=1000).count() == 0


@pytest.mark.parametrize("text, want", [("a(b)c)", "a(b)c)"), ("a(b(c)", "a"), ("Price (EUR) ", "price"), ("单价（元）", "单价"), ("a\u3000b c", "abc"), ("(x", "(x"), (None, ""), ("（a）b（c）", "（a）b")])
def test_keys_are_the_same_on_the_driver_and_in_tasks(spark, text, want):
    assert key_of(text) == want
    assert (spark.createDataFrame([(text,)], "t string").select(clean_key(F.col("t"))).first()[0] or "") == want


def test_rows_of_unmapped_tables_are_all_kept(spark):
    tables = spark.createDataFrame([(1, ["odd", "names"], [[str(i), "x"] for i in range(700)])], "source_id int, headers array<string>, rows array<array<string>>")
    specs = [mapping.TableSpec("t", ())]
    assert mapping.mapped(tables, specs)[1].selectExpr("size(rows)").first()[0] == 700
    assert mapping.mapped(tables, specs, kept_rows=500)[1].selectExpr("size(rows)").first()[0] == 500


def test_flushes_and_call_limits(spark):
    units = spark.range(1, 13).selectExpr("1 as doc_id", "cast(id as int) as unit_no", "'t' as text")
    assert [r[0] for r in mapping.flushes(units).groupBy("flush").count().orderBy("flush").select("count").collect()] == [5, 5, 2]
    sent, left = mapping.within_calls(mapping.unit_batches(units), most=3)
    assert (sent.count(), left.count()) == (3, 1)


def test_ranges_need_two_values(spark):
    with pytest.raises(ValueError, match="two values"):
        filtered(spark.range(3), [{"field": "id", "op": "BETWEEN", "value": "1"}])
    with pytest.raises(ValueError, match="can't be compared"):
        filtered(spark.range(3), [{"field": "id", "op": "<", "value": "x"}])


def test_what_is_held_of_an_idle_caller_goes(spark, tmp_path):
    import os
    import time as clock

    hours = [[(1, 1, 0.0), (2, 2, 1.0), (3, 2, 2.0)], [(4, 3, 7200.0)], [(5, 3, 14400.0)], [(6, 2, 21600.0)]]
    schema = "event_id long, user_id long, at double"
    for i, rows in enumerate(hours):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        for name in os.listdir(f"{tmp_path}/in/{i}"):
            os.utime(f"{tmp_path}/in/{i}/{name}", (clock.time() - 1000 + i,) * 2)  # files are taken by age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000))
    q = rollup.stream_rate_limited(stream, "user_id", "ts", "event_id", 5).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {int(r["event"]): r["recent"] for r in spark.table("idle").collect()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held[0] == 2 and max(held) <= 3 and held[-1] <= 2


def arrivals(spark, tmp_path, runs):
    import os
    import time as clock

    schema = "doc_id long, unit_no long, text string, units long"
    for i, rows in enumerate(runs):
        at = len(os.listdir(tmp_path / "in")) if (tmp_path / "in").exists() else 0
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{at}")
        for name in os.listdir(f"{tmp_path}/in/{at}"):
            os.utime(f"{tmp_path}/in/{at}/{name}", (clock.time() - 1000 + at,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")


def test_units_in_any_order_make_the_batches_of_a_table(spark, tmp_path):
    import random

    sizes = {1: 7, 2: 3, 3: 1, 4: 12, 5: 4}
    rows = [(d, u, None if u == 2 else f"{d}-{u}", n) for d, n in sizes.items() for u in range(1, n + 1)]
    random.Random(2).shuffle(rows)
    rows += rows[:6] + [(None, 1, "x", 1), (1, None, "x", 7)]  # units again, and rows that are none
    folder = f"file://{tmp_path}/out"
    for half in (rows[:15], rows[15:]):  # the second call goes on from the checkpoint of the first
        for q in units.two_tiers(arrivals(spark, tmp_path, [half[:8], half[8:]]), folder):
            q.awaitTermination(120)
    table = spark.createDataFrame([r for r in rows[:27] if r[0] and r[1]], "doc_id long, unit_no long, text string, units long")
    got = sorted((int(r["doc_id"]), r["batch"], r["texts"]) for r in units.tier(spark, folder, "batches").collect())
    assert got == sorted((r["doc_id"], r["batch"], r["texts"]) for r in mapping.unit_batches(table).collect()) and len(got) == 3 + 1 + 1 + 4 + 2
    got = sorted((int(r["doc_id"]), r["batch"], r["numbers"]) for r in units.tier(spark, folder, "flushes").collect())
    assert got == sorted((d, b, list(range(5 * b + 1, min(n, 5 * b + 5) + 1))) for d, n in sizes.items() for b in range(-(-n // 5)))


class State:
    """A group's state as the units see it."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut = None, False, False

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutTimestamp(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeMs(self):
        return 5000

    def getCurrentWatermarkMs(self):
        return -1


def test_batches_leave_while_a_document_arrives_and_at_its_end():
    import pandas as pd

    def come(own, state, *numbers, of=None):
        part = pd.DataFrame({"unit_no": numbers, "text": [str(n) for n in numbers], "units": [of] * len(numbers)})
        return [(b, n) for x in own(("d",), iter([part]), state) for b, n in zip(x["batch"], x["numbers"])]

    own, state = units.Batches(3, 1), State()
    assert come(own, state, 2, 4, 1) == [] and come(own, state, 3) == [(0, [1, 2, 3])]
    assert sorted(state.get[3]) == [3, 4] and state.ms == 5001  # the overlap, and what waits
    assert come(own, state, 3, 1) == [] and come(own, state, 6, 5, 8) == [(1, [3, 4, 5, 6])]
    state.hasTimedOut = True  # unit 7 never comes, nor was the number of units said
    assert [(b, n) for x in own(("d",), iter([]), state) for b, n in zip(x["batch"], x["numbers"])] == [(2, [6, 8])] and not state.exists
    state = State()
    assert come(own, state, 1, 3, of=2) == [(0, [1, 3])] and state.get[0] == -1 and come(own, state, 3, of=2) == []
    with pytest.raises(ValueError, match="overlap"):
        units.batches(None, 3, 4)
