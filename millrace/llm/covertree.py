"""Vector near-duplicates by cosine: exact threshold pairs from dual traversals of cover trees.

Equal vectors are one class. Classes are dealt into cells of near neighbours (:mod:`millrace.llm.vectors`), the top
level of the cover; a class also visits the cells that may hold a vector within the threshold's distance, so that each
pair which may link meets in just one cell. A cell's members and visitors come in chunks of bounded size. Where two
chunks meet, each gets a cover tree: nested levels of centres at halving radii, every node with the exact radius that
covers what lies below it. A dual traversal drops a pair of nodes whose covers lie too far apart, and counts one whose
covers lie wholly within the threshold without a look at its vectors. Levels stop where halving the radius would need
nearly as many centres as there are members, as no cover prunes there.

A large cell's core, all within half the threshold's distance of its pivot, links with itself as a whole; only classes
around it meet its chunks. A group of near copies of any size so costs one row a class. Results are, for each class
with links, their number and a local component, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links and are
their own component; so are vectors of different lengths to each other. Repeated rows and equal vectors link with
each other. A null id takes its component's smallest id, or null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, stored
from millrace.llm.components import components, smallest_keys
from millrace.llm.vectors import Dealing, matrix, pivots, placed, sizes, unit, usable

#: What rounding may move a distance by.
SLACK = 1e-7


@dataclass(frozen=True)
class Settings:
    """Cosine threshold, how vectors are dealt out, and vectors of a leaf."""

    cosine: float = 0.95
    dealing: Dealing = Dealing()
    leaf: int = 16

    @property
    def limit(self) -> float:
        """The threshold as a distance of unit vectors."""
        return float(np.sqrt(2 - 2 * self.cosine))


@dataclass
class Node:
    """A centre, the radius that covers all below it, its members, and children unless it is a leaf."""

    centre: int
    radius: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def build(x: np.ndarray, leaf: int, rows: np.ndarray | None = None) -> Node:
    """The cover tree of ``rows`` (or all) of the unit vectors ``x``, built from the top."""

    def grow(centre: int, members: np.ndarray, far: np.ndarray, reach: float) -> Node:
        radius = float(far.max())
        node = Node(centre, radius, members)
        if len(members) <= leaf or radius < SLACK:
            return node
        # the next level: centres more than half the reach apart, the node's own first; each member goes to the nearest
        half = min(reach, radius) / 2
        chosen, best, nearest = [], np.full(len(members), np.inf), np.zeros(len(members), np.int64)
        new, own = int(np.flatnonzero(members == centre)[0]), x[members]
        while True:
            d = distances(own, own[new][None])[:, 0]
            d[new] = 0
            closer = d < best
            best[closer], nearest[closer] = d[closer], len(chosen)
            chosen.append(new)
            if best.max() <= half:
                break
            if len(chosen) >= 32 and len(chosen) & (len(chosen) - 1) == 0 and (best <= half).sum() < 2 * len(chosen):
                return node  # a level of nearly as many centres as members prunes nothing
            new = int(best.argmax())
        for k, c in enumerate(chosen):
            of = nearest == k
            node.children.append(grow(int(members[c]), members[of], best[of], half))
        return node

    everyone = np.arange(len(x)) if rows is None else rows
    return grow(int(everyone[0]), everyone, distances(x[everyone], x[everyone[:1]])[:, 0], 2.0)


class Links:
    """Numbers of links and local components of the vectors of one or two chunks."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.counts, self.label = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def root(self, i: int) -> int:
        label = self.label
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return int(i)

    def join(self, members: np.ndarray) -> None:
        roots = {self.root(int(i)) for i in members}
        least = min(roots)
        for i in roots:
            self.label[i] = least

    def add(self, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> None:
        """Links of a block; each pair comes once."""
        self.counts[rows] += linked @ self.weights[columns]
        self.counts[columns] += linked.T @ self.weights[rows]
        # equal rows of a block join the same members: each distinct one is joined once
        some = np.flatnonzero(linked.any(1))
        _, first, which = np.unique(np.packbits(linked[some], axis=1), axis=0, return_index=True, return_inverse=True)
        for k, i in enumerate(some[first]):
            self.join(np.concatenate([columns[linked[i]], rows[some[which.ravel() == k]]]))

    def all(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """All pairs of two nodes, or of one."""
        if same:
            self.counts[a] += self.weights[a].sum() - self.weights[a]
        else:
            self.counts[a] += self.weights[b].sum()
            self.counts[b] += self.weights[a].sum()
        self.join(np.concatenate([a, b]))

    def labels(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.label))], np.int64)


def walk(x: np.ndarray, a: Node, b: Node, links: Links, s: Settings, step: int = 512) -> None:
    """Dual traversal of two trees over the rows of ``x``; the same tree twice visits each pair once."""
    limit, short = s.limit + SLACK, x.astype(np.float32)

    def compare(rows: np.ndarray, columns: np.ndarray, same: bool) -> None:
        for low in range(0, len(rows), step):
            part = rows[low : low + step]
            others = columns[low:] if same else columns  # of one node, the pairs not met yet
            for left in range(0, len(others), 8192):
                other = others[left : left + 8192]
                # single precision finds what may link, double precision decides
                maybe = short[part] @ short[other].T >= s.cosine - 1e-4
                if same:
                    maybe &= np.arange(len(part))[:, None] < np.arange(left, left + len(other))[None]
                if not maybe.any():
                    continue
                i, j = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
                linked = (x[part[i]] @ x[other[j]].T >= s.cosine) & maybe[np.ix_(i, j)]
                if linked.any():
                    links.add(part[i], other[j], linked)

    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if p is q and 2 * p.radius <= s.limit - SLACK:
            links.all(p.members, p.members[:0], True)
            continue
        if not p.children and not q.children:
            compare(p.members, q.members, p is q)
            continue
        left, right = p.children or [p], q.children or [q]
        lc, rc = np.array([n.centre for n in left]), np.array([n.centre for n in right])
        lr, rr = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        l1, r1 = np.array([len(n.members) == 1 for n in left]), np.array([len(n.members) == 1 for n in right])
        # single vectors are compared as a block; other pairs of nodes go on if their covers come near enough
        if l1.any() and r1.any():
            compare(lc[l1], rc[r1], p is q)
        for rows, columns in ((np.flatnonzero(~l1), np.arange(len(right))), (np.flatnonzero(l1), np.flatnonzero(~r1))):
            for low in range(0, len(rows) if len(columns) else 0, step):
                part = rows[low : low + step]
                gap, cover = distances(x[lc[part]], x[rc[columns]]), lr[part, None] + rr[columns][None]
                near = gap - cover <= limit
                if p is q:
                    near &= part[:, None] <= columns[None]
                for i, j in np.argwhere(near):
                    one, other = left[part[i]], right[columns[j]]
                    if one is not other and gap[i, j] + cover[i, j] <= s.limit - SLACK:
                        links.all(one.members, other.members, False)
                    else:
                        stack.append((one, other))


def met(one: pa.Table, dim: int, same: bool, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes with links among two chunks (``side`` 0 and 1) or within one, their numbers of links and local components."""
    side = one.column("side").to_numpy()
    order = np.lexsort((one.column("cls").to_numpy(), side))
    ids, weights = (one.column(c).to_numpy()[order].astype(np.int64) for c in ("cls", "m"))
    first = int((side == 0).sum())
    if not same and first in (0, len(ids)):
        return ids[:0], ids[:0], ids[:0]
    x = unit(matrix(one.column("v").combine_chunks(), dim)[order])
    links = Links(weights)
    if same:
        root = build(x, s.leaf)
        walk(x, root, root, links, s)
    else:
        walk(x, build(x, s.leaf, np.arange(first)), build(x, s.leaf, np.arange(first, len(ids))), links, s)
    found, label = np.flatnonzero(links.counts), links.labels()
    # local components are named by their smallest class
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return ids[found], links.counts[found], least[label[found]]


def cells(rows: DataFrame, dims: DataFrame, s: Settings) -> DataFrame:
    """One row a cell: chunks of its members, visitors, core and of what is near the core (0 without one); the members' reach, the core's weight and name."""
    core = F.col("home") & (F.col("far") <= s.limit / 2 - SLACK)
    near = ~core & (F.col("far") <= 1.5 * s.limit + SLACK)
    found = rows.groupBy("dim", "cell").agg(
        F.count_if("home").alias("members"), F.count_if(~F.col("home")).alias("visitors"), F.max(F.when(F.col("home"), F.col("far"))).alias("covers"),
        F.count_if(core).alias("core"), F.count_if(near).alias("near"), F.sum(F.when(core, F.col("m"))).alias("core_m"), F.min(F.when(core, F.col("cls"))).alias("core_cls"),
    )
    small = F.least(F.lit(s.dealing.chunk_bytes) / (4 * F.col("dim")), F.lit(s.dealing.least_rows)).cast("int")
    found = found.join(F.broadcast(dims), "dim", "left").withColumn("size", F.greatest(F.coalesce("size", small), F.lit(1)))
    whole = (F.col("members") > 2 * F.col("size")) & (F.col("core") > 1)
    found = found.withColumns({"core": F.when(whole, F.col("core")).otherwise(0), "near": F.when(whole, F.col("near")).otherwise(0)})
    chunks = lambda n: F.ceil(n / F.col("size")).cast("int")
    return found.select(
        "dim", "cell", "covers", "core_m", "core_cls", chunks(F.col("members") - F.col("core")).alias("homes"), chunks(F.col("visitors")).alias("guests"),
        chunks(F.col("core")).alias("cores"), chunks(F.col("near")).alias("around"),
    )


def meetings(rows: DataFrame, of: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Rows once for each meeting of chunks they take part in (dim, cell, kind, a, b, side); and the rows of cores."""
    rows = rows.join(of, ["dim", "cell"]).where(F.col("home") | (F.col("far") <= F.col("covers") + s.limit + SLACK))
    core = (F.col("cores") > 0) & F.col("home") & (F.col("far") <= s.limit / 2 - SLACK)
    near = (F.col("cores") > 0) & (F.col("far") <= 1.5 * s.limit + SLACK)
    own = lambda n: F.pmod(F.xxhash64("cls", F.lit(1)), F.greatest(F.col(n), F.lit(1))).cast("int")

    def each(n: str, kind: str, a, b, side) -> Column:
        """A meeting for each number below ``n``."""
        upto = F.filter(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1), lambda i: i < F.col(n))
        return F.transform(upto, lambda i: F.struct(F.lit(kind).alias("kind"), a(i).alias("a"), b(i).alias("b"), side(i).alias("side")))

    left, right = (lambda i: F.lit(0)), (lambda i: F.lit(1))
    homes = each("homes", "h", lambda i: F.least(own("homes"), i), lambda i: F.greatest(own("homes"), i), lambda i: (own("homes") > i).cast("int"))
    guests = each("guests", "v", lambda i: own("homes"), lambda i: i, left)
    around = each("cores", "k", lambda i: i, lambda i: own("around"), right)
    none = F.array().cast("array<struct<kind:string,a:int,b:int,side:int>>")
    takes = F.when(core, each("around", "k", lambda i: own("cores"), lambda i: i, left)).otherwise(
        F.concat(F.when(F.col("home"), F.concat(homes, guests)).otherwise(each("homes", "v", lambda i: i, lambda i: own("guests"), right)), F.when(near, around).otherwise(none))
    )
    return rows.select("dim", "cell", "cls", "m", "v", F.explode(takes).alias("t")).select("dim", "cell", "t.*", "cls", "m", "v"), rows.where(core)


def class_links(classes: DataFrame, s: Settings) -> DataFrame:
    """(cls, n, label) of each meeting: links of each class with any, and its local component's smallest class."""
    spark, rows, d = classes.sparkSession, classes.select("cls", "m", "v"), s.dealing
    large, _ = sizes(rows, d)
    found = pivots(rows, "cls", large, d, s.limit, units=True)
    dealt = placed(rows, found, units=True, reach=s.limit)
    dims = spark.createDataFrame([(dim, d.rows(n, dim)) for dim, n in large.items()], "dim int, size int")
    of = stored(cells(dealt, dims, s), "cells")
    pairs = F.col("homes") * (F.col("homes") + 1) / 2 + F.col("homes") * F.col("guests") + F.col("cores") * F.col("around")
    number, cores = of.agg(F.coalesce(F.sum(pairs), F.lit(0)).cast("long"), F.coalesce(F.max("cores"), F.lit(0))).first()
    rows, core = meetings(dealt, of, s)
    key = ["dim", "cell", "kind", "a", "b"]

    def run(names: tuple[pa.Scalar, ...], one: pa.Table) -> pa.Table:
        dim, _, kind, a, b = (x.as_py() for x in names)
        return pa.table([pa.array(x, pa.int64()) for x in met(one, dim, kind == "h" and a == b, s)], ["cls", "n", "label"])

    rows = rows.repartition(max(1, min(number, 20_000)), *key)
    links = rows.groupBy(*key).applyInArrow(run, "cls long, n long, label long")
    if cores:
        links = links.unionByName(core.select("cls", (F.col("core_m") - F.col("m")).alias("n"), F.col("core_cls").alias("label")))
    links = stored(links, "links")
    discard(of)
    return links


def dedup(df: DataFrame, key: str, vector: str, s: Settings = Settings()) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Equal vectors are found, and given their results, by a digest of 128 bits; should equal ones differ in it (as 0.0
    and -0.0 do), they link like any others.
    """
    ok = usable(F.col(vector)) & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(key).alias("key"), F.when(F.coalesce(ok, F.lit(False)), F.col(vector)).alias("v"))
    rows = rows.select("key", "v", *[F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(i), "v")).alias(f"d{i}") for i in (1, 2)])
    classes = rows.where("v is not null").groupBy("d1", "d2").agg(F.any_value("v").alias("v"), F.min("key").alias("key"), F.count("*").alias("m"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    links = class_links(classes, s)
    comp = components(links.select(F.col("cls").alias("a"), F.col("label").alias("b")))
    least = smallest_keys(classes, comp.select(F.col("node").alias("cls"), F.col("component").alias("comp")))
    counts = links.groupBy("cls").agg(F.sum("n").alias("n"))
    every = classes.select("cls", "m", "d1", "d2").join(counts, "cls", "left").join(least, "cls")
    every = stored(every.select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "by-vector")
    discard(classes, links, comp, least)
    out = rows.drop("v").withColumn("alone", F.col("d1").isNull()).join(every, ["d1", "d2"], "left")
    own = F.when(F.col("alone"), F.col("key")).otherwise(F.col("component_id"))
    out = out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
