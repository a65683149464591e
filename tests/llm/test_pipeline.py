import corpus_pipeline
from brute import base_spans, near_duplicates

from millrace.llm import quality, toxicity
from millrace.llm.common import table


def rows_of(df):
    return sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def test_each_stage_does_what_its_operator_says(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"]
    rows = rows_of(docs)
    model = toxicity.fit(docs, labels)
    kept = rows_of(stages["toxicity"](spark, docs, data))
    assert kept == [r for r, s in zip(rows, toxicity.scores(model, [r[1] for r in rows])) if s < 0.7]
    model = quality.fit(docs, labels)
    kept = rows_of(stages["quality"](spark, docs, data))
    import numpy as np

    assert kept == [r for r, s in zip(rows, quality.scores(model, np.stack([quality.features(r[1]) for r in rows]))) if s >= 0.3]
    kept = rows_of(stages["near_duplicates"](spark, docs, data))
    ids = {i for i, _, _, k in near_duplicates([r[:2] for r in rows], 5, 80) if k}
    assert kept == [r for r in rows if r[0] in ids]
    for before, after in zip(rows, rows_of(stages["personal_data"](spark, docs, data))):
        assert before[0] == after[0] and after[4] == len(after[1])
        assert (before[1] == after[1]) == (not base_spans(before[1])) and not base_spans(after[1])


def test_run_and_odd_tables(spark, data, tmp_path):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    odd = spark.createDataFrame([(1, "same text here for all of us", "en", None, 5), (1, "same text here for all of us", "en", None, 5), (None, None, None, None, None), (2, "", None, None, 0), (3, "mail a@b.org now " * 500, None, None, 0)], table(spark, data, "documents").schema)
    labels = table(spark, data, "labels").where("false")
    for name, df in (("full", odd), ("none", odd.where("false"))):
        df.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}/full").collect()} == {1, None, 2, 3}
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").collect() == []


def test_near_copies_under_one_id_and_clashing_columns(spark, data):
    words = " ".join(f"w{i}" for i in range(60))
    near, other = words + " more", " ".join(f"v{i}" for i in range(60))
    rows = [(1, words), (1, near), (1, other), (2, near), (None, words), (None, None), (3, ""), (3, ""), (4, other), (5, other), (5, other)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], table(spark, data, "documents").schema)
    docs = docs.selectExpr("*", "1 as kept", "2 as own", "'x' as cls", "3 as component_id", "4 as score", "5 as rows", "6 as spans")
    kept = sorted([(r[0], (r[1] or "")[:3], len(r[1] or "")) for r in corpus_pipeline.one_of_each(spark, docs, data).collect()], key=str)
    # of id 1 the smaller key of each group stays: one of the two near copies, and the other text
    assert [x for x in kept if x[0] != 1] == [(3, "", 0), (None, "", 0)]
    assert sorted(x[1] for x in kept if x[0] == 1) == ["v0 ", "w0 "]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
        assert out.count() > 0
