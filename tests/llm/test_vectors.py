import numpy as np
import pytest
from brute import cosine_links, top_products
from pyspark.sql import functions as F

from millrace.llm import covertree, mtree, queries
from millrace.llm.common import table
from millrace.llm.vectors import Dealing, apart, squares


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    one = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    rows = [(1, None), (2, []), (3, [0.0] * 6), (4, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5, [float("nan")] + [1.0] * 5), (None, one), (6, one), (7, [2 * x for x in one]), (7, one), (8, [1.0, 2.0]), (10, [1.0, 2.0]), (10, [float("inf")] * 6), (11, [1e-30] * 6)]
    n = 20
    for _ in range(20):
        base = rng.normal(size=6)
        for _ in range(rng.choice([1, 6, 30])):
            rows.append((n, (base + rng.normal(size=6) * rng.choice([0, 0.05, 0.2])).tolist()))
            n += 1
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cls", F.lit("clash")).withColumn("dim", F.lit(3))


def plain(df):
    return [(r["vec_id"], r["embedding"]) for r in df.collect()]


@pytest.mark.parametrize("s", [covertree.Settings(), covertree.Settings(dealing=Dealing(least_rows=40, parts=10), leaf=3)])
def test_links_match_brute_force(vectors, s):
    out = covertree.dedup(vectors, "vec_id", "embedding", s)
    assert sorted(map(tuple, out.collect()), key=str) == cosine_links(plain(vectors), 0.95)


@pytest.mark.parametrize("s", [mtree.Settings(), mtree.Settings(dealing=Dealing(least_rows=40, parts=10), page=4, block=3)])
def test_top_products_match_brute_force(vectors, s):
    out = mtree.top_k(vectors, "vec_id", mtree.scaled(F.col("embedding"), 256), F.col("vec_id") % 5 == 0, s)
    assert sorted(map(tuple, out.collect())) == top_products(plain(vectors), 256, 5, 5)


def test_empty_tables(vectors):
    none = vectors.where("false")
    assert covertree.dedup(none, "vec_id", "embedding").collect() == []
    assert mtree.top_k(none, "vec_id", mtree.scaled(F.col("embedding"), 256), F.col("vec_id") % 5 == 0).collect() == []


def test_covers_nest_and_halve():
    x = np.random.default_rng(3).normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    stack = [(covertree.build(x, 4), 2.0)]
    while stack:
        node, reach = stack.pop()
        assert np.linalg.norm(x[node.members] - x[node.centre], axis=1).max() <= node.radius + 1e-9
        assert node.radius <= reach + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
            assert any(c.centre == node.centre for c in node.children)
            stack += [(c, min(reach, node.radius) / 2) for c in node.children]


def test_a_core_of_near_copies_counts_as_a_whole(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * (0.02 if i < 300 else 0.25 if i < 360 else 3)).tolist()) for i in range(420)]
    out = covertree.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", covertree.Settings(dealing=Dealing(least_rows=20, parts=40)))
    assert sorted(map(tuple, out.collect()), key=str) == cosine_links(rows, 0.95)


def test_every_near_pair_meets_once():
    """A row's home and its visits to lower cells bring each pair within reach together in one cell."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = apart(x, 12, 0.3)
    square = squares(x, p)
    home = square.argmin(1)
    offset = (square - square.min(1, keepdims=True)) / 2
    visits = (offset <= 0.3 * np.sqrt(squares(p[home], p)) + 1e-6) & (np.arange(len(p))[None] < home[:, None])
    near = np.sqrt(squares(x, x)) <= 0.3
    for a, b in np.argwhere(near):
        if a < b:
            met = int(home[a] == home[b]) + int(visits[a, home[b]]) * (home[a] != home[b]) + int(visits[b, home[a]]) * (home[a] != home[b])
            assert met == 1
    assert len(p) == 12 and (squares(p, p) + np.eye(12)).min() > 0.09


def test_many_lengths_in_one_pass(spark):
    rows = [(n, [float(1 + (n * k) % 7) for k in range(1, 2 + n // 2)]) for n in range(2400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {r["vec_id"]: r["n_links"] for r in covertree.dedup(df, "vec_id", "embedding").collect()}
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    assert all(out[n] == out[n + 1] == int(unit[n] @ unit[n + 1] >= 0.95) for n in range(0, 2400, 2))
    top = mtree.top_k(df, "vec_id", mtree.scaled(F.col("embedding"), 256), F.col("vec_id") % 50 == 0)
    assert sorted((r[0], r[2]) for r in top.collect()) == [(n, n + 1) for n in range(0, 2400, 50)]


def test_products_beyond_64_bits_are_refused(spark):
    big = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        mtree.top_k(big, "vec_id", mtree.scaled(F.col("embedding"), 256), F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        mtree.top_k(big, "vec_id", mtree.scaled(F.col("embedding"), 2**40), F.col("vec_id") == 0).collect()
    wide = spark.createDataFrame([(0, [2.0**22, 1.0]), (1, [2.0**22, 2.0]), (2, [-(2.0**22), 5.0])], "vec_id long, embedding array<double>")
    out = mtree.top_k(wide, "vec_id", mtree.scaled(F.col("embedding"), 256), F.col("vec_id") == 0)
    assert sorted(map(tuple, out.collect())) == top_products([(0, [2.0**22, 1.0]), (1, [2.0**22, 2.0]), (2, [-(2.0**22), 5.0])], 256, 3, 5)


def test_queries_match_brute_force(spark, data):
    rows = plain(table(spark, data, "embeddings"))
    assert sorted(map(tuple, queries.op5_cover_tree(spark, data).collect()), key=str) == cosine_links(rows, 0.95)
    assert sorted(map(tuple, queries.op6_mtree(spark, data).collect())) == top_products(rows, 256, 50, 5)


def test_queries_are_routed_in_steps(spark):
    """20,000 pivots and some hundred queries: what a step holds doesn't grow with either, and no visit is lost."""
    rng = np.random.default_rng(3)
    p, q = rng.integers(-99, 99, (20_000, 4)).astype(np.float64), rng.integers(-99, 99, (150, 4))
    cover = np.full(len(p), 5.0)
    asked = spark.createDataFrame([(i, x.tolist(), 9000, i % 2 == 0) for i, x in enumerate(q)], "id long, v array<long>, least long, again boolean")
    found = sorted((r["id"], r["cell"]) for r in mtree.routed(asked, {4: (p, cover)}).collect())
    want = []
    for i, x in enumerate(q):
        nearest = ((p - x) ** 2).sum(1).argmin()
        reach = np.flatnonzero(p @ x + np.sqrt((x**2).sum()) * cover >= 9000 - 0.5) if i % 2 == 0 else [nearest]
        want += [(i, int(c)) for c in reach if i % 2 or c != nearest]
    assert set(want) >= set(found) and len(set(want) - set(found)) < len(want) / 100
    exact = [(i, int(c)) for i, c in want if i % 2 or p[c] @ q[i] + np.sqrt((q[i] ** 2).sum()) * 5 >= 9000 + 1e-6]
    assert set(exact) <= set(found)
