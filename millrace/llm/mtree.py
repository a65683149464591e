"""Exact top-k inner products of integer vectors by best-first search of M-trees.

Vectors are dealt into cells of near neighbours, the entries of the M-tree's root page: a pivot and a covering radius
each. A cell's chunks of bounded size are M-trees of pages whose entries store a covering radius and the distance to
the page's own centre; they are built once and stored. For a query q at distance d from a page's centre, an entry at
stored distance s lies at least ``|d - s|`` from q, which bounds its inner product by
``(|q|^2 + |o|^2 - (|d - s|)^2) / 2`` without computing it; a subtree of radius r around c has none above
``<q, c> + |q| r``.

The search is best-first on both levels. A query first goes to the cell of its nearest pivot, and with the k-th score
it finds there only to those other cells whose bound reaches it. Queries meet a chunk in blocks: a block visits pages
by descending bound, the highest of its queries'; at each page only those queries are left whose own bound reaches
their k-th score so far.

Defined results: rows without id, and vectors that are null, empty or hold null or non-finite components take no
part; only vectors of a query's length are its candidates. Rows with the query's id are its own, and a repeated id
asks once, with the least of its vectors. Repeated rows of other ids are candidates each. Ties go to the smaller id.
Components and scores are 64-bit integers; what lies beyond them is refused with an error, never wrapped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, stored
from millrace.llm.vectors import Dealing, pivots, placed, sizes, usable


#: Products of queries and pivots that are worked on at a time.
PRODUCTS = 1 << 20
#: The score of a place that no candidate takes.
NONE = -np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    """Results a query, how vectors are dealt out, entries of a page, and queries of a block."""

    k: int = 5
    dealing: Dealing = Dealing()
    page: int = 64
    block: int = 4096


@dataclass
class Page:
    """Entries with their distance to the page's centre; a leaf's are vectors, others' are centres of child pages."""

    centre: int
    entries: np.ndarray
    stored: np.ndarray
    radius: np.ndarray
    children: list[Page] = field(default_factory=list)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(-1))


def build(x: np.ndarray, page: int) -> Page:
    """An M-tree over the rows of ``x``, loaded from the top: a page's centres are spread over its members."""
    f = x.astype(np.float64)

    def grow(centre: int, members: np.ndarray) -> Page:
        to_centre = norms(f[members] - f[centre])
        if len(members) <= page:
            return Page(centre, members, to_centre, np.zeros(len(members)))
        wanted = min(page, -(-2 * len(members) // page))  # so that leaves are about half full
        chosen = members[np.unique(np.linspace(0, len(members) - 1, max(2, wanted)).astype(np.int64))]
        square = (f[members] ** 2).sum(1)[:, None] + (f[chosen] ** 2).sum(1)[None] - 2 * f[members] @ f[chosen].T
        nearest = square.argmin(1)
        groups = [members[nearest == k] for k in range(len(chosen))]
        kept = [k for k, g in enumerate(groups) if len(g)]
        if len(kept) == 1:  # equal vectors: cut by count
            groups = np.array_split(members, -(-len(members) // page))
            chosen, kept = np.array([g[0] for g in groups]), list(range(len(groups)))
        out = Page(centre, chosen[kept], norms(f[chosen[kept]] - f[centre]), np.zeros(len(kept)))
        for i, k in enumerate(kept):
            out.radius[i] = norms(f[groups[k]] - f[chosen[k]]).max()
            out.children.append(grow(int(chosen[k]), groups[k]))
        return out

    return grow(0, np.arange(len(x)))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in integers of any size; an error if one needs more than 64 bits."""
    out = q.astype(object) @ x.astype(object).T
    if max(map(abs, out.ravel()), default=0) >= 1 << 63:
        raise OverflowError("an inner product is beyond 64 bits")
    return out.astype(np.int64)


def flat(root: Page) -> list[np.ndarray]:
    """A tree in preorder: (centre, entries, children) of each page; then all entries, stored distances and radii."""
    shape, entries, stored_at, radius = [], [], [], []

    def visit(page: Page) -> None:
        shape.append((page.centre, len(page.entries), len(page.children)))
        for held, own in ((entries, page.entries), (stored_at, page.stored), (radius, page.radius)):
            held.append(own)
        for child in page.children:
            visit(child)

    visit(root)
    return [np.array(shape, np.int64), np.concatenate(entries).astype(np.int64), np.concatenate(stored_at), np.concatenate(radius)]


def tree(shape: np.ndarray, entries: np.ndarray, stored_at: np.ndarray, radius: np.ndarray) -> Page:
    """The tree again."""
    rows, at = iter(shape.reshape(-1, 3).tolist()), 0

    def visit() -> Page:
        nonlocal at
        centre, n, children = next(rows)
        page = Page(centre, entries[at : at + n], stored_at[at : at + n], radius[at : at + n])
        at += n
        page.children = [visit() for _ in range(children)]
        return page

    return visit()


def search(x: np.ndarray, ids: np.ndarray, root: Page, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best k for each row of ``q``; the larger score, then the smaller id. Places left over score NONE."""
    length, size = norms(x), norms(q)
    reach = float(length.max(initial=0.0))
    if reach * float(size.max(initial=0.0)) < 2**52:  # then products in double precision are exact
        xf, qf = x.astype(np.float64), q.astype(np.float64)
        products = lambda who, entries: np.rint(qf[who] @ xf[entries].T).astype(np.int64)
    elif reach * float(size.max(initial=0.0)) < 2**62:
        xi, qi = x.astype(np.int64), q.astype(np.int64)
        products = lambda who, entries: qi[who] @ xi[entries].T
    else:
        products = lambda who, entries: exact(q[who], x[entries])
    best, names = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
    slack = 1e-6 * (1 + (size + reach) ** 2)
    heap = [(-np.inf, 0, root, np.arange(len(q)), norms(q.astype(np.float64) - x[root.centre]), np.full(len(q), np.inf))]
    number = 0
    while heap:
        _, _, page, who, far, bound = heapq.heappop(heap)
        still = bound + slack[who] >= best[who, -1]
        who, far = who[still], far[still, None]
        least, own_size, own_slack = best[who, -1:], size[who, None], slack[who, None]
        # by the stored distances alone: no entry's subtree comes nearer than this
        near = np.maximum(np.abs(far - page.stored) - page.radius, 0)
        longest = length[page.entries] + page.radius
        bounds = (own_size * own_size + longest * longest - near * near) / 2
        left = bounds + own_slack >= least
        at = np.flatnonzero(left.any(0))
        if not len(at):
            continue
        entries, left, bounds = page.entries[at], left[:, at], bounds[:, at]
        scores = products(who, entries)
        if page.children:
            bounds = np.minimum(bounds, scores + own_size * page.radius[at])
            left &= bounds + own_slack >= least
            distance = np.sqrt(np.maximum(own_size * own_size + length[entries] ** 2 - 2.0 * scores, 0))
            for j, child in enumerate(at):
                on = np.flatnonzero(left[:, j])
                if len(on):
                    number += 1
                    heapq.heappush(heap, (-float(bounds[on, j].max()), number, page.children[child], who[on], distance[on, j], bounds[on, j]))
        else:
            scores[~left | (ids[entries][None] == own[who, None])] = NONE
            on = np.flatnonzero((scores >= least).any(1))
            seen = np.concatenate([best[who[on]], scores[on]], 1)
            called = np.concatenate([names[who[on]], np.broadcast_to(ids[entries], (len(on), len(entries)))], 1)
            order = np.lexsort((called, -seen), axis=-1)[:, :k]
            best[who[on]], names[who[on]] = np.take_along_axis(seen, order, 1), np.take_along_axis(called, order, 1)
    return best, names


def scaled(vector: Column, by: int) -> Column:
    """Components times ``by``, rounded down, as integers; null for vectors that take no part."""

    def whole(x: Column) -> Column:
        x = x.cast("double") * by
        return F.when(F.abs(x) < float(1 << 63), F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a scaled component is beyond 64 bits")).cast("long"))

    return F.when(usable(vector), F.transform(vector, whole))


def integers(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and their vectors in the narrowest type that holds them."""
    ids = table.column("id").to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    x = table.column("v").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(ids), dim)[order]
    kind = np.result_type(np.min_scalar_type(x.min(initial=0)), np.min_scalar_type(x.max(initial=0)), np.int8)
    return ids[order], x.astype(kind if kind.kind == "i" else np.int64)


#: What a chunk carries, and the types of its parts; the vectors' own is named beside them.
PARTS = {"ids": "<i8", "shape": "<i8", "entries": "<i8", "stored": "<f8", "radius": "<f8"}


def chunks(rows: DataFrame, s: Settings) -> DataFrame:
    """One row a chunk (dim, cell, chunk): ids, vectors and the M-tree as bytes."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, x = integers(table, key[0].as_py())
        parts = [ids, *flat(build(x, s.page)), x]
        columns = [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([part.tobytes()], pa.binary()) for part in parts] + [pa.array([x.dtype.str])]
        return pa.Table.from_arrays(columns, ["dim", "cell", "chunk", *PARTS, "vectors", "kind"])

    columns = "dim int, cell int, chunk int, " + ", ".join(f"{p} binary" for p in PARTS) + ", vectors binary, kind string"
    return rows.select("dim", "cell", "chunk", "id", "v").groupBy("dim", "cell", "chunk").applyInArrow(run, columns)


def routed(asked: DataFrame, root: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(dim, cell, id, v, first): the cells that queries (id, v, least) go to.

    Without ``least``, the k-th score so far, that is the nearest pivot's cell; with it, all other cells whose bound
    reaches it. ``root`` holds pivots and covering radii by vector length; other lengths have the one cell 0.
    """
    shared = asked.sparkSession.sparkContext.broadcast(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.int32)
            first = ~np.array(batch.column("again").to_numpy(zero_copy_only=False), bool)
            score = np.nan_to_num(batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                if int(dim) not in shared.value:
                    at = at[first[at]]
                    yield visits(batch, dim, at, np.zeros(len(at), np.int64))
                    continue
                p, cover = shared.value[int(dim)]
                square, length = (p * p).sum(1), norms(p)
                step = max(1, PRODUCTS // len(p))
                for low in range(0, len(at), step):
                    part = at[low : low + step]
                    q = batch.column("v").take(pa.array(part)).flatten().to_numpy().astype(np.float64).reshape(-1, int(dim))
                    size, product = norms(q), q @ p.T
                    nearest = (square[None] - 2 * product).argmin(1)
                    own = np.flatnonzero(first[part])
                    yield visits(batch, dim, part[own], nearest[own])
                    again = np.flatnonzero(~first[part])
                    if len(again):
                        bound = product[again] + size[again, None] * cover[None]
                        slack = 1e-6 * (1 + (size[again, None] + cover[None] + length[None]) ** 2)
                        others = bound + slack >= score[part[again]][:, None]
                        others[np.arange(len(again)), nearest[again]] = False
                        i, cell = np.nonzero(others)
                        yield visits(batch, dim, part[again[i]], cell)

    def visits(batch: pa.RecordBatch, dim: int, at: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        taken = pa.array(at, pa.int64())
        columns = [pa.array(np.full(len(at), dim), pa.int32()), pa.array(cell, pa.int32()), batch.column("id").take(taken), batch.column("v").take(taken)]
        return pa.RecordBatch.from_arrays(columns, ["dim", "cell", "id", "v"])

    return asked.select("id", "v", "least", "again").mapInArrow(run, "dim int, cell int, id long, v array<long>")


def searched(visits: DataFrame, trees: DataFrame, s: Settings) -> DataFrame:
    """(query_id, vec_id, score): the best k of each chunk of the cells that queries visit, by blocks of queries."""

    def blob(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, q = integers(table, key[0].as_py())
        columns = [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([b], pa.binary()) for b in (ids.tobytes(), q.tobytes())] + [pa.array([q.dtype.str])]
        return pa.Table.from_arrays(columns, ["dim", "cell", "block", "qids", "queries", "qkind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                of = {p: np.frombuffer(row[p].as_buffer(), t) for p, t in PARTS.items()}
                dim, ids, qids = row["dim"].as_py(), of.pop("ids"), np.frombuffer(row["qids"].as_buffer(), np.int64)
                x, q = (np.frombuffer(row[c].as_buffer(), row[t].as_py()).reshape(-1, dim) for c, t in (("vectors", "kind"), ("queries", "qkind")))
                best, names = search(x, ids, tree(of["shape"], of["entries"], of["stored"], of["radius"]), q, qids, s.k)
                found = best > NONE
                columns = np.repeat(qids, found.sum(1)), names[found], best[found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    blocks = visits.groupBy("dim", "cell").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    dealt = visits.join(blocks, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int"))
    asked = dealt.groupBy("dim", "cell", "block").applyInArrow(blob, "dim int, cell int, block int, qids binary, queries binary, qkind string")
    met = trees.join(asked, ["dim", "cell"]).repartition(F.col("dim"), F.col("cell"), F.col("chunk"), F.col("block"))
    return met.select("dim", *PARTS, "vectors", "kind", "qids", "queries", "qkind").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, key: str, vector: Column, is_query: Column, s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query; ``vector`` is an integer array, null where it takes no part."""
    d = s.dealing
    rows = df.select(F.col(key).cast("long").alias("id"), vector.cast("array<long>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stored(rows.where("id is not null and v is not null"), "vectors")
    large, _ = sizes(rows, d)
    own = pivots(rows.select("id", "v"), "id", large, d)
    dealt = placed(rows.select("id", "v"), own)
    of = stored(dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")), "cells")
    # the root page: as many entries as there are pivots, whose bytes are bounded
    root = {dim: (p, np.full(len(p), -np.inf)) for dim, p in own.items()}
    for r in of.where(F.col("dim").isin(list(own))).collect():
        root[r["dim"]][1][r["cell"]] = r["far"] * (1 + 1e-9) + 1e-9
    spark = df.sparkSession
    dims = spark.createDataFrame([(dim, d.rows(n, dim)) for dim, n in large.items()], "dim int, size int")
    small = F.least(F.lit(d.chunk_bytes) / (4 * F.col("dim")), F.lit(d.least_rows)).cast("int")
    of_chunks = of.join(F.broadcast(dims), "dim", "left").select("dim", "cell", F.ceil(F.col("n") / F.greatest(F.coalesce("size", small), F.lit(1))).alias("chunks"))
    dealt = dealt.join(of_chunks, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int"))
    trees = stored(chunks(dealt, s), "trees")
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)
    visits = routed(asked.select("id", "v", F.lit(None).cast("long").alias("least"), F.lit(False).alias("again")), root)
    first = stored(best(searched(visits, trees, s)), "first")
    kth = first.where(F.col("rank") == s.k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    visits = routed(asked.join(kth, "id", "left").select("id", "v", "least", F.lit(True).alias("again")), root)
    out = stored(best(first.drop("rank").unionByName(searched(visits, trees, s))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top")
    discard(rows, of, trees, first)
    return out
