import random

import numpy as np
import pytest
from brute import near_duplicates

from millrace.llm import neardup, queries
from millrace.llm.common import table
from millrace.llm.components import components


def rows_of():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  B"), (4, "a"), (5, "\n"), (None, "x y z"), (6, "x y z"), (6, "x y z"), (None, "solo one here now"), (7, "b a"), (8, "É b c"), (9, "é b c")]
    n = 10
    for _ in range(12):
        size = rnd.choice([5, 12, 30, 80, 200, 600])
        base = [rnd.choice(words) for _ in range(size)]
        for _ in range(rnd.choice([2, 30])):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, int(size * 0.02), int(size * 0.04)])):
                own[rnd.randrange(size)] = rnd.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,threshold,block", [(3, 85, 8), (5, 80, 128)])
def test_components_match_brute_force(spark, words, threshold, block):
    rows = rows_of()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, cls int").repartition(5)
    out = neardup.dedup(df, "doc_id", neardup.Settings(words=words, threshold=threshold, block=block))
    assert sorted(map(tuple, out.collect()), key=str) == near_duplicates(rows, words, threshold)


def test_empty_table(spark):
    assert neardup.dedup(spark.createDataFrame([], "doc_id long, text string"), "doc_id").collect() == []


def test_estimates_follow_jaccard():
    s = neardup.Settings()
    rng = np.random.default_rng(0)
    probes, own = neardup.probe_table(s), neardup.seeds(s)
    for n in (20, 200, 5000):
        errors = []
        for _ in range(20):
            x = rng.integers(0, 1 << 63, n * 2).astype(np.uint64)
            a, b = np.unique(x[: n + n // 4]), np.unique(x[n // 4 :][: n + n // 4])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(neardup.estimate(neardup.sketch(a, s, probes, own), neardup.sketch(b, s, probes, own), np.float64(len(a)), np.float64(len(b)), s) - true)
        assert abs(np.mean(errors)) < 0.06


def test_bounded_products_count_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, 200).astype(np.uint64)) for _ in range(9)]
    assert (neardup.intersections(sets, columns=37) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(out[i] == 0 for i in range(41)) and all(out[i] == 100 for i in range(100, 160)) and out[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query_matches_brute_force(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    assert sorted(map(tuple, queries.op9_minhash(spark, data).collect()), key=str) == near_duplicates(rows, 3, 85)


def test_no_link_of_a_larger_table_is_missed(spark):
    """Recall at sf0.01 against an exact search by prefixes of rare shingles: op9's SQL."""
    import duckdb

    path = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    rows = db.sql(queries.SQL["op9_minhash"])
    wanted = sorted((dict(zip(rows.columns, r)) for r in rows.fetchall()), key=lambda r: r["doc_id"])
    got = sorted((r.asDict() for r in queries.op9_minhash(spark, path).collect()), key=lambda r: r["doc_id"])
    assert got == wanted and sum(not r["kept"] for r in got) > 10


def test_rows_that_share_a_key_meet_their_own_class_only(spark):
    texts = [f"w{i} " + " ".join(f"x{i // 2}y{k}" for k in range(60)) for i in range(600)]
    rows = [(None if i % 3 else 7, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    s = neardup.Settings(words=3, threshold=85)
    signed = neardup.named(neardup.signatures(docs, "doc_id", s), "signed")
    wanted = signed.groupBy("cls").agg(neardup.F.min(neardup.F.struct("key", "own", "digest")).alias("first")).select("cls", "first.*")
    pairs = neardup.texts_of(docs, "doc_id")
    assert pairs.join(wanted, pairs["key"].eqNullSafe(wanted["key"]) & (pairs["own"] == wanted["own"])).count() == 600
    assert neardup.sets_of(docs, "doc_id", wanted, s).count() == 600
    out = neardup.dedup(docs, "doc_id", s).collect()
    assert len(out) == 600 and {r["component_id"] for r in out} == {7, None}


def test_digests_that_share_a_name_stay_apart(spark):
    rows = [(1, bytes(8) + b"a" * 8), (2, bytes(8) + b"b" * 8), (3, bytes(8) + b"a" * 8), (4, b"c" * 16), (5, None)]
    out = {r["key"]: r["cls"] for r in neardup.named(spark.createDataFrame(rows, "key long, digest binary"), "named").collect()}
    assert out[1] == out[3] and len({out[1], out[2], out[4]}) == 3 and out[5] is None
