"""Vectors dealt into cells of near neighbours, for the operators that build metric trees over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates that are drawn for each pivot.
DRAWN = 4


@dataclass(frozen=True)
class Dealing:
    """Bytes of the vectors of a chunk, least rows of one, chunks that a small table is cut into, bytes of all pivots.

    Cells grow in number with the table as long as their pivots keep within ``pivot_bytes`` (those are what is
    broadcast); beyond, cells get larger and are dealt into more chunks. A chunk never gets larger.
    """

    chunk_bytes: int = 16 << 20
    least_rows: int = 2048
    parts: int = 6
    pivot_bytes: int = 8 << 20

    def rows(self, n: int, dim: int) -> int:
        """Rows of a chunk, of ``n`` vectors of ``dim`` components."""
        return max(1, min(self.chunk_bytes // (4 * max(1, dim)), max(self.least_rows, -(-n // self.parts))))


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column whose lists all have ``dim`` finite values, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled first so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def apart(x: np.ndarray, most: int, distance: float, step: int = 256) -> np.ndarray:
    """The first rows of ``x``, ``most`` at most, of which no two lie within ``distance``: a net over ``x``."""
    kept = np.zeros((0, x.shape[1]))
    for low in range(0, len(x), step):
        part = x[low : low + step]
        if len(kept):
            part = part[(squares(part, kept) > distance * distance).all(1)]
        near = squares(part, part) <= distance * distance
        chosen: list[int] = []
        for i in range(len(part)):
            if not near[i, chosen].any():
                chosen.append(i)
        kept = np.concatenate([kept, part[chosen]])
        if len(kept) >= most:
            break
    return kept[:most]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def sizes(rows: DataFrame, d: Dealing) -> tuple[dict[int, int], int]:
    """Numbers of rows by length, for the lengths of more rows than a chunk has (few, as each has so many); and of all rows."""
    counts = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    large = counts.where(F.col("n") > d.least_rows).orderBy(F.desc("n"), "dim").limit(d.pivot_bytes // 8)
    return {r["dim"]: r["n"] for r in large.collect() if r["n"] > d.rows(r["n"], r["dim"])}, counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def pivots(rows: DataFrame, key: str, large: dict[int, int], d: Dealing, net: float = 0.0, units: bool = False) -> dict[int, np.ndarray]:
    """Pivots by vector length, of the lengths in ``large``; no two within ``net`` of each other.

    Candidates are drawn by a hash of the key, in one job for all lengths.
    """
    wanted = {dim: -(-n // d.rows(n, dim)) for dim, n in large.items()}
    share = min(1.0, d.pivot_bytes / max(1, sum(4 * dim * k for dim, k in wanted.items())))
    wanted = {dim: max(1, int(k * share)) for dim, k in wanted.items()}
    if not wanted:
        return {}
    spark = rows.sparkSession
    rates = spark.createDataFrame([(dim, min(1.0, DRAWN * k / large[dim])) for dim, k in wanted.items()], "dim int, rate double")
    drawn = rows.withColumn("dim", F.size("v")).withColumn("h", F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1 << 30)))
    drawn = drawn.join(F.broadcast(rates), "dim").where(F.col("h") <= F.col("rate") * (1 << 30)).select("dim", "h", key, "v").toArrow()
    out = {}
    dims = drawn.column("dim").to_numpy()
    for dim in np.unique(dims):
        own = drawn.filter(pa.array(dims == dim)).sort_by([("h", "ascending"), (key, "ascending")])
        x = matrix(own.column("v").combine_chunks(), int(dim))
        out[int(dim)] = apart(unit(x) if units else x, wanted[int(dim)], net)
    return out


def placed(rows: DataFrame, own: dict[int, np.ndarray], units: bool = False, reach: float | None = None) -> DataFrame:
    """``rows`` with ``dim``, ``cell`` (the nearest pivot's number, 0 without any), ``home`` and ``far``, the distance to the pivot.

    With ``reach``, a row also visits each lower cell that may hold a row within ``reach`` of it (``home`` is then
    false), so that any two rows so near meet once: at home, or one as the other's visitor. A member u of cell c is no
    nearer to the pivot k than to c's, hence ``<v, k - c> <= |u - v| |k - c|`` for every v of unit length.
    """
    shared = rows.sparkSession.sparkContext.broadcast(own)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.int32)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                p = shared.value.get(int(dim))
                if p is None:
                    yield out(batch, at, dim, np.zeros(len(at), np.int32), np.ones(len(at), bool), np.zeros(len(at)))
                    continue
                step = max(1, (1 << 22) // len(p))
                for low in range(0, len(at), step):
                    part = at[low : low + step]
                    x = matrix(batch.column("v").take(pa.array(part)), int(dim))
                    x = unit(x) if units else x
                    square = squares(x, p)
                    home = square.argmin(1)
                    row = np.arange(len(part))
                    yield out(batch, part, dim, home, np.ones(len(part), bool), np.sqrt(square[row, home]))
                    if reach is not None and len(p) > 1:
                        # half the differences of squared distances are the products' differences
                        offset = (square - square[row, home][:, None]) / 2
                        between = np.sqrt(squares(p, p) if len(p) <= 2048 else np.zeros((1, 1)))
                        between = between[home] if len(p) <= 2048 else np.sqrt(squares(p[home], p))
                        i, c = np.nonzero((offset <= reach * between + 1e-6) & (np.arange(len(p))[None] < home[:, None]))
                        yield out(batch, part[i], dim, c, np.zeros(len(i), bool), np.sqrt(square[i, c]))

    def out(batch: pa.RecordBatch, at: np.ndarray, dim: int, cell: np.ndarray, home: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
        taken = [batch.column(c).take(pa.array(at)) for c in names]
        more = [pa.array(np.full(len(at), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(home), pa.array(far, pa.float64())]
        return pa.RecordBatch.from_arrays([*taken, *more], [*names, "dim", "cell", "home", "far"])

    schema = rows.withColumns({"dim": F.lit(0), "cell": F.lit(0), "home": F.lit(True), "far": F.lit(0.0)}).schema
    return rows.mapInArrow(run, schema)
