from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import queries, whitening
from millrace.llm.common import table


def plain(vectors, scale=1024, shift=100_000):
    """Exact integers, sums, deviations, and the covariance as fractions rounded once."""
    x = [[int(np.floor(scale * float(c))) + shift for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    centred = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    return n, centred, v


def check(rows, vectors, components=8):
    n, centred, v = plain([x for _, x in vectors])
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    found = {}
    for r in rows:
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(found) == len(vectors)
    for (key, _), c in zip(vectors, centred):
        own = found[key]
        assert sorted(own) == list(range(1, min(components, len(v)) + 1))
        for k, r in own.items():
            assert r["n"] == n and int(r["deviation"]) == sum(y * y for y in c)
            assert r["explained"] == pytest.approx(values[k - 1] / np.trace(v), rel=1e-9) and r["identity_error"] < 1e-9
    for k in range(1, min(components, len(v)) + 1):
        got = np.array([found[key][k]["whitened"] for key, _ in vectors])
        wanted = np.array(centred, float) / n @ basis[:, k - 1] / np.sqrt(values[k - 1])
        assert np.abs(got - wanted).max() < 1e-6 or np.abs(got + wanted).max() < 1e-6


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(0)
    for most in (100, 2**17, 2**40, 2**61):
        x = rng.integers(-most, most, (37, 5))
        assert (whitening.products(x) == x.astype(object).T @ x.astype(object)).all()
    values = np.array([0, -1, 1 << 140, -(1 << 140) + 17, 2**30], object)
    parts = whitening.digits(values)
    assert (sum(p.astype(object) << (whitening.DIGIT * k) for k, p in enumerate(parts)) == values).all()


def test_whitening_matches_fractions(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, x) for i, x in enumerate((rng.normal(size=(150, 10)) @ rng.normal(size=(10, 10))).tolist())]
    df = spark.createDataFrame([(k, v, 1.0) for k, v in vectors], "vec_id long, embedding array<double>, n double").repartition(5)
    check(whitening.whiten(df, "vec_id", "embedding").collect(), vectors)


def test_deviations_beyond_64_bits(spark):
    vectors = [(i, [float(2.0**44 * (i % 7 - 3)), float(i * i), 1.5 * i]) for i in range(30)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = whitening.whiten(df, "vec_id", "embedding", whitening.Settings(scale=1, shift=5)).collect()
    n, centred, _ = plain([v for _, v in vectors], 1, 5)
    wanted = {k: sum(y * y for y in c) for (k, _), c in zip(vectors, centred)}
    assert max(wanted.values()) > 2**63 and all(int(r["deviation"]) == wanted[r["vec_id"]] for r in rows) and rows


def test_odd_vectors_take_no_part(spark):
    good = [(i, [float(i), float(i * i % 7), float(i % 3)]) for i in range(12)]
    odd = [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [float("nan"), 1.0, 2.0]), (24, [float("inf"), 1.0, 2.0]), (25, [1e300, 0.0, 0.0]), (26, [1.0] * 5)]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    check(whitening.whiten(df, "vec_id", "embedding").collect(), good)
    other = [(30 + i, [float(i), 1.0 - i]) for i in range(5)]  # a length of its own, of one component
    rows = whitening.whiten(spark.createDataFrame(good + other, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    check([r for r in rows if r["vec_id"] < 30], good)
    assert [r["component"] for r in rows if r["vec_id"] >= 30] == [1] * 5 and {r["n"] for r in rows if r["vec_id"] >= 30} == {5}


def test_repeated_rows_null_keys_and_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 5.0])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(df, "vec_id", "embedding").collect()
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: str(r["vec_id"]))] == [1, 1, None]
    assert whitening.whiten(df.where("vec_id = 1"), "vec_id", "embedding").collect() == []
    assert whitening.whiten(df.where("false"), "vec_id", "embedding").collect() == []
    with pytest.raises(ValueError, match="models"):
        whitening.whiten(df, "vec_id", "embedding", whitening.Settings(model_bytes=10))


def test_query_covers_its_table(spark, data):
    vectors = [(r["vec_id"], r["embedding"]) for r in table(spark, data, "embeddings").collect()]
    check(queries.op12_whitening(spark, data).collect(), vectors)
