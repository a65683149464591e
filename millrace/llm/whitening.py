"""Whitening of embeddings by an exact covariance of integers.

Entries become integers, and these split into limbs of 16 bits, so that every product that BLAS sums in float64 is
exact. The products of limbs are put together as big integers and leave a task in digits of 30 bits, which Spark sums;
n times the sums of products less the products of sums is the covariance without any rounding, rounded once to
doubles for its eigenvectors. Vectors of each length are whitened on their own.

Defined results: vectors that are null, empty, or hold null or non-finite entries, or one beyond 61 bits as an
integer, take no part and have no rows. Keys may repeat or be null; each row counts. A component whose variance is
zero to double precision is left out, so a single vector, or copies of one, have no rows. Empty tables give empty
results; other columns of the input are dropped. Deviations are decimals of 38 digits, and an error beyond them. A
table of so many lengths that their models take more than ``model_bytes`` is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.vectors import matrix, usable

#: Bits of a limb, rows of a product of limbs (each sum then stays below 2**53), bits and number of the digits of a sum.
LIMB, ROWS, DIGIT, DIGITS = 16, 1 << 14, 30, 6


@dataclass(frozen=True)
class Settings:
    """What entries are multiplied by and moved by before they are integers, components, and bytes of all models."""

    scale: float = 1024
    shift: int = 100_000
    components: int = 8
    model_bytes: int = 64 << 20


def integers(column: pa.Array, dim: int, s: Settings) -> np.ndarray:
    return np.floor(matrix(column, dim) * float(s.scale)).astype(np.int64) + s.shift


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` as float64 limbs, the lowest first; only the last has a sign."""
    most, out = int(np.abs(x).max(initial=0)), []
    while most >> LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x, most = x >> LIMB, most >> LIMB
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` as Python integers, exactly."""
    own = limbs(x)
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for low in range(0, len(x), ROWS):
        part = [a[low : low + ROWS] for a in own]
        for i, a in enumerate(part):
            for j, b in enumerate(part[: i + 1]):
                g = (a.T @ b).astype(np.int64).astype(object)
                total += (g if i == j else g + g.T) << LIMB * (i + j)
    return total


def digits(values: np.ndarray) -> list[np.ndarray]:
    """Big integers as arrays of digits, the lowest first; only the last has a sign."""
    out = []
    for _ in range(DIGITS - 1):
        out.append((values & ((1 << DIGIT) - 1)).astype(np.int64))
        values = values >> DIGIT
    return [*out, values.astype(np.int64)]


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        yield int(dim), batch.take(pa.array(np.flatnonzero(lengths == dim)))


@dataclass
class Model:
    """Of the vectors of one length: how many, sums, projections (a column a component), shares of variance."""

    n: int
    sums: list[int]
    whitener: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def nbytes(self) -> int:
        return self.whitener.nbytes + 16 * len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as integers: of 64 bits if they fit, else Python's."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.whitener


def deviations(centred: np.ndarray) -> pa.Array:
    """Sums of squares of rows, exactly."""
    kind = pa.decimal128(38, 0)
    if centred.dtype != object and centred.shape[1] * int(np.abs(centred).max(initial=0)) ** 2 < 1 << 63:
        return pa.array((centred * centred).sum(1)).cast(kind)
    from decimal import Context, Decimal

    exact = Context(prec=60)
    own = centred.astype(object)
    return pa.array([exact.create_decimal(Decimal(v)) for v in (own * own).sum(1)], kind)


def model(n: int, sums: list[int], grams: np.ndarray, components: int) -> Model:
    """Eigenvectors of the covariance (n * G - S S') / n**2, which is exact until it is rounded to doubles."""
    s = np.array(sums, object)
    exact = n * grams - np.outer(s, s)
    v = np.array([[a / (n * n) for a in row] for row in exact])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > len(v) * np.finfo(float).eps * max(values.max(), 0)]
    trace = sum(exact[i, i] for i in range(len(v))) / (n * n)
    return Model(n, sums, vectors[:, order] / np.sqrt(values[order]), values[order] / trace if trace else values[order])


def fitted(rows: DataFrame, s: Settings) -> dict[int, Model]:
    """A model for each length: sums of digits come to the driver, as many as pairs of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the column of ones in front gives n and the sums
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, own in by_length(batch):
                x = np.insert(integers(own.column("v"), dim, s), 0, 1, axis=1)
                g = products(x)
                held[dim] = held[dim] + g if dim in held else g
                if sum(g.nbytes for g in held.values()) > s.model_bytes:
                    yield from map(out, held.items())
                    held = {}
        yield from map(out, held.items())

    def out(one: tuple[int, np.ndarray]) -> pa.RecordBatch:
        dim, g = one
        i, j = np.triu_indices(len(g))
        columns = [pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, digits(g[i, j]))]
        return pa.RecordBatch.from_arrays(columns, ["dim", "i", "j", *names])

    names = [f"d{k}" for k in range(DIGITS)]
    found = rows.select("v").mapInArrow(run, "dim int, i int, j int, " + ", ".join(f"{c} long" for c in names))
    found = found.groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in names])
    need = found.where("i = 0 AND j = 0").agg(F.coalesce(F.sum(F.col("dim").cast("long") * 8 * (s.components + 2)), F.lit(0))).first()[0]
    if need > s.model_bytes:
        raise ValueError(f"the models of all lengths take {need} bytes")
    sums = found.toArrow()
    models = {}
    dims = sums.column("dim").to_numpy()
    for dim in np.unique(dims):
        own = sums.filter(pa.array(dims == dim))
        values = sum(own.column(c).to_numpy().astype(object) << (DIGIT * k) for k, c in enumerate(names))
        g = np.zeros((dim + 1, dim + 1), object)
        i, j = own.column("i").to_numpy(), own.column("j").to_numpy()
        g[i, j] = g[j, i] = values
        own = model(g[0, 0], list(g[0, 1:]), g[1:, 1:], s.components)
        if own.whitener.shape[1]:
            models[int(dim)] = own
    return models


def measured(rows: DataFrame, models: dict[int, Model], s: Settings) -> dict[int, Model]:
    """The models with their identity errors: the covariance of what they whiten, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, own in by_length(batch):
                if m := shared.value.get(dim):
                    z = np.insert(m.whitened(m.centred(integers(own.column("v"), dim, s))), 0, 1, axis=1)
                    held[dim] = held.get(dim, 0) + z.T @ z
        for dim, g in held.items():
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g[i, j])], ["dim", "i", "j", "g"])

    sums = rows.select("v").mapInArrow(run, "dim int, i int, j int, g double").groupBy("dim", "i", "j").agg(F.sum("g").alias("g")).collect()
    grams = {dim: np.zeros((m.whitener.shape[1] + 1,) * 2) for dim, m in models.items()}
    for r in sums:
        grams[r["dim"]][r["i"], r["j"]] = grams[r["dim"]][r["j"], r["i"]] = r["g"]
    for dim, g in grams.items():
        mean = g[0, 1:] / models[dim].n
        covariance = g[1:, 1:] / models[dim].n - np.outer(mean, mean)
        models[dim].identity_error = float(np.abs(covariance - np.eye(len(mean))).max())
    return models


def whiten(df: DataFrame, key: str, vector: str, s: Settings = Settings()) -> DataFrame:
    """A row for each vector and component: the key, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    kind = dict(df.dtypes)[key]
    v = F.col(vector).cast("array<double>")
    small = F.forall(v, lambda x: F.abs(x * float(s.scale)) < float(1 << 61))
    rows = df.select(F.col(key).alias("key"), v.alias("v")).where(usable(F.col("v"))).where(small)
    models = measured(rows, fitted(rows, s), s)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own in by_length(batch):
                if m := shared.value.get(dim):
                    centred = m.centred(integers(own.column("v"), dim, s))
                    z = m.whitened(centred)
                    many, k = z.shape
                    at = pa.array(np.repeat(np.arange(many), k))
                    columns = [own.column("key").take(at), pa.array(np.tile(np.arange(1, k + 1), many), pa.int32()), pa.array(np.full(many * k, m.n), pa.int64()), deviations(centred).take(at)]
                    columns += [pa.array(z.ravel()), pa.array(np.tile(m.explained, many)), pa.array(np.full(many * k, m.identity_error))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, out).withColumnRenamed("key", key)
