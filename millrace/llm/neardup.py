"""Near duplicates by HyperMinHash: compressed registers choose candidates, full shingle sets confirm them.

A document is its set of word shingles, held as 64-bit hashes. Equal sets form one class at once. Of each class, a
HyperMinHash sketch keeps for every register the leading-zero count of the least hash in its bucket and some bits
after it (the mantissa); registers of empty buckets take another bucket's value by fixed probes, or the least of a
hash of their own. Bands of registers are hashed to keys. Then, without ever listing the pairs of a group:

1. every class meets the smallest class of each of its keys (a star); the collision-corrected Jaccard estimate of
   two sketches drops pairs that are far below the threshold, full sets confirm the others, and connected
   components of the links are found;
2. keys whose classes are still in different components are settled exactly: the components that such keys join
   form groups, a group's classes are dealt into blocks of bounded size, and each pair of blocks counts the
   intersections of all its candidate pairs by matrix products, returning only links that join components.

No cap is set on partners or on a group's size; a larger group makes more blocks.

Defined results: null and empty texts have no set and link with nothing. Fewer words than a shingle give one
shingle, the whole sequence. Repeated rows and equal texts are one class. A null id gets the smallest id of its
component, or null if it stands alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, stored
from millrace.llm.components import components, smallest_keys

#: Words that a worker remembers, and bytes of the longest that it does.
CACHE, LONGEST = 200_000, 64
MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Settings:
    """Shingle length, threshold in hundredths, registers in bands, mantissa bits, and members of a block."""

    words: int = 5
    threshold: int = 80
    bands: int = 45
    rows: int = 7
    mantissa: int = 10
    probes: int = 16
    deviations: float = 5.0
    block: int = 128
    block_shingles: int = 500_000

    @property
    def registers(self) -> int:
        return self.bands * self.rows


class Words(dict):
    """Hash of each word that a worker has seen."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) > CACHE:
                self.clear()
            self[word] = found
        return found


_words = Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; words are split at ASCII white space, A-Z in lower case."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out + h[i : len(h) - n + 1 + i] * np.uint64(2 * i + 1))
    return np.unique(out)


def digest_of(found: np.ndarray) -> bytes:
    """128 bits that tell sets apart; :func:`named` makes names of 64 bits from them."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def probe_table(s: Settings) -> np.ndarray:
    return np.random.default_rng(11).integers(0, s.registers, (s.probes, s.registers))


def seeds(s: Settings) -> np.ndarray:
    return np.random.default_rng(12).integers(0, 1 << 63, s.registers).astype(np.uint64)


def sketch(found: np.ndarray, s: Settings, probes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Registers: leading zeros of the least 48-bit hash of a bucket (6 bits), then mantissa bits."""
    k = s.registers
    x = mixed(found + np.uint64(0x9E3779B97F4A7C15))
    bucket = (x >> np.uint64(48)) * np.uint64(k) >> np.uint64(16)
    low = np.sort((bucket << np.uint64(48)) | (x & np.uint64((1 << 48) - 1)))
    which = (low >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    value = np.full(k, (1 << 64) - 1, np.uint64)
    value[which[first]] = low[first] & np.uint64((1 << 48) - 1)
    filled = np.zeros(k, bool)
    filled[which[first]] = True
    empty = np.flatnonzero(~filled)
    for row in probes:
        if not len(empty):
            break
        hit = filled[row[empty]]
        value[empty[hit]] = value[row[empty[hit]]]
        empty = empty[~hit]
    for part in np.array_split(empty, max(1, len(empty) * len(x) // 2_000_000)):
        if len(part):
            value[part] = (mixed(x[None] ^ own[part][:, None]) >> np.uint64(16)).min(1)
    zeros = 48 - np.ceil(np.log2(value.astype(np.float64) + 1)).astype(np.int64)  # leading zeros of 48 bits
    shift = 48 - zeros - 1 - s.mantissa
    bits = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64))
    return ((zeros.astype(np.uint64) << np.uint64(s.mantissa)) | (bits & np.uint64((1 << s.mantissa) - 1))).astype(np.uint16)


def band_keys(registers: np.ndarray, s: Settings) -> np.ndarray:
    flat = np.ascontiguousarray(registers.reshape(s.bands, s.rows))
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(flat)], np.uint64).astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, s: Settings) -> np.ndarray:
    """Jaccard estimates of sketches, less the matches that unrelated sets of sizes n and m would have by chance."""
    same = (a == b).sum(-1)
    ratio = n / np.maximum(m, 1)
    # the constant of the HyperMinHash paper's approximation of expected collisions, a register
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 * 2.0**-s.mantissa
    return np.clip((same / s.registers - chance) / (1 - chance), 0, 1)


def plausible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, s: Settings) -> np.ndarray:
    """Pairs whose sizes allow the threshold, and whose estimate isn't ``deviations`` standard errors below it."""
    t = s.threshold / 100
    error = s.deviations * np.sqrt(t * (1 - t) / np.minimum(s.registers, np.maximum(np.minimum(n, m), 1)))
    return (100 * np.minimum(n, m) >= s.threshold * np.maximum(n, m)) & (estimate(a, b, n, m, s) >= t - error)


def signatures(docs: DataFrame, key: str, s: Settings) -> DataFrame:
    """(key, own, n, digest, keys, regs) of every document, ``own`` a digest of its text; the last three are null without shingles."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, own = probe_table(s), seeds(s)
        for batch in batches:
            n, digests, keys, regs = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, s.words)
                n.append(len(found))
                if len(found):
                    r = sketch(found, s, probes, own)
                    digests.append(digest_of(found))
                    keys.append(band_keys(r, s))
                    regs.append(r.tobytes())
                else:
                    for column in (digests, keys, regs):
                        column.append(None)
            columns = [batch.column("key"), batch.column("own"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "own", "n", "digest", "keys", "regs"])

    return texts_of(docs, key).mapInArrow(run, f"key {kind}, own binary, n long, digest binary, keys array<long>, regs binary")


def texts_of(docs: DataFrame, key: str) -> DataFrame:
    """(key, text, own): documents, and a digest that finds a text again among rows that share a key."""
    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("own", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def part_of(digest: Column, which: int) -> Column:
    """One half of a digest as a long; the first is a class's name unless two digests share it."""
    return F.conv(F.hex(F.substring(digest, 1 + 8 * which, 8)), 16, -10).cast("long")


def named(signed: DataFrame, name: str) -> DataFrame:
    """``signed`` with ``cls``: 64 bits of the digest, and other 64 bits where different digests share the first."""
    out = stored(signed.withColumn("cls", part_of(F.col("digest"), 0)), name)
    shared = out.where("cls IS NOT NULL").groupBy("cls").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("cls", F.lit(True).alias("shared"))
    if shared.limit(1).count():
        again = stored(out.join(shared, "cls", "left").withColumn("cls", F.when(F.col("shared"), part_of(F.col("digest"), 1)).otherwise(F.col("cls"))).drop("shared"), name)
        discard(out)
        return again
    return out


def sets_of(docs: DataFrame, key: str, wanted: DataFrame, s: Settings) -> DataFrame:
    """(cls, shingles) of the wanted (cls, key, own, digest): their texts are read again and must give the digest once more.

    Texts are found by key and own digest, so that rows that share a key meet their own class only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, blobs = [], []
            for cls, digest, text in zip(batch.column("cls").to_pylist(), batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = shingles(text, s.words)
                if digest_of(found) == digest:
                    names.append(cls)
                    blobs.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["cls", "shingles"])

    rows = texts_of(docs, key)
    rows = rows.join(wanted, rows["key"].eqNullSafe(wanted["key"]) & (rows["own"] == wanted["own"])).select("cls", "digest", "text")
    return rows.mapInArrow(run, "cls long, shingles binary").dropDuplicates(["cls"])


def likely(pairs: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose sketches make the threshold plausible."""
    left = sketches.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    right = sketches.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, s.registers) for c in ("ra", "rb")]
            keep = plausible(*r, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), s)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * s.threshold
    both = pairs.join(left, "a").join(right, "b").where(near)
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= s.threshold * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
    rows = rows.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def intersections(sets: list[np.ndarray], columns: int = 20_000) -> np.ndarray:
    """Sizes of all intersections, by products of membership matrices of bounded width."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for low in range(0, len(distinct), columns):
        x, y = np.searchsorted(place, [low, low + columns])
        held = np.zeros((len(sets), min(columns, len(distinct) - low)), np.float32)
        held[owner[x:y], place[x:y] - low] = 1
        out += held @ held.T
    return out.astype(np.int64)


def block_links(g: pd.DataFrame, s: Settings) -> list[tuple[int, int]]:
    """Links that join components among the classes of two blocks (side 0 and 1; both 0 if it is one block)."""
    comp, side = g["comp"].to_numpy(), g["side"].to_numpy()
    n = g["n"].to_numpy()
    keys = np.stack(g["keys"].to_numpy())
    regs = np.frombuffer(b"".join(g["regs"]), np.uint16).reshape(len(g), s.registers)
    cross = side.max() > 0
    wanted = []
    for i in range(len(g)):
        others = np.arange(i + 1, len(g))
        others = others[(comp[others] != comp[i]) & ((side[others] != side[i]) if cross else True)]
        others = others[(keys[others] == keys[i]).any(1)] if len(others) else others
        if len(others):
            others = others[plausible(regs[others], regs[i], n[others], np.full(len(others), n[i]), s)]
            wanted.append((i, others))
    if not any(len(o) for _, o in wanted):
        return []
    shared = intersections([np.frombuffer(b, np.uint64) for b in g["shingles"]])
    parent = {int(c): int(c) for c in comp}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, others in wanted:
        both = shared[i, others]
        for j in others[100 * both >= s.threshold * (n[i] + n[others] - both)]:
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((x, y))
    return out


def settled(keys: DataFrame, sketches: DataFrame, sets: DataFrame, comp: DataFrame, s: Settings) -> DataFrame:
    """Further links (a, b) between components, from keys (key, cls) whose classes lie in several components."""
    held = keys.join(comp, "cls")
    mixed_keys = held.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    held = stored(held.join(mixed_keys.select("key", "low"), "key"), "unsettled")
    groups = components(held.select(F.col("comp").alias("a"), F.col("low").alias("b")).distinct())
    groups = groups.select(F.col("node").alias("comp"), F.col("component").alias("grp"))
    members = held.select("cls", "comp").distinct().join(groups, "comp").join(sketches.select("cls", "n"), "cls")
    sizes = members.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / s.block), F.ceil(F.sum("n") / s.block_shingles)).cast("int").alias("blocks"))
    members = members.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # a block meets itself and each other block of its group once
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))))
    rows = members.select("cls", "comp", "grp", "block", pair.alias("p")).select("cls", "comp", "grp", "p.i", "p.j", (F.col("block") != F.col("p.i")).cast("int").alias("side"))
    rows = rows.join(sketches, "cls").join(sets, "cls")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(g, s), columns=["a", "b"], dtype="int64")

    return rows.groupBy("grp", "i", "j").applyInPandas(run, "a long, b long")


def dedup(docs: DataFrame, key: str, s: Settings = Settings()) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs`` (columns ``key`` and ``text``)."""
    signed = named(signatures(docs, key, s), "signatures")
    known = signed.where("cls is not null")
    classes = stored(known.groupBy("cls").agg(F.min("key").alias("key"), F.min(F.struct("key", "own", "digest")).alias("first")), "classes")
    sketches = stored(known.select("cls", "n", "keys", "regs").dropDuplicates(["cls"]), "sketches")
    keys = sketches.select("cls", F.explode("keys").alias("key"))
    stars = keys.groupBy("key").agg(F.min("cls").alias("b"), F.count("*").alias("size")).where("size > 1").select("key", "b")
    keys = stored(keys.join(stars, "key"), "keys")
    pairs = stored(likely(keys.where("cls <> b").select(F.col("cls").alias("a"), "b").distinct(), sketches, s), "pairs")
    wanted = keys.select("cls").distinct()
    few = stored(sketches.join(wanted, "cls"), "few")
    sets = stored(sets_of(docs, key, classes.join(wanted, "cls").select("cls", "first.*"), s), "sets")
    links = stored(confirmed(pairs, sets, s), "links")
    first = components(links)
    comp = wanted.join(first.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls", "left")
    comp = stored(comp.select("cls", F.coalesce("comp", "cls").alias("comp")), "components")
    discard(links, pairs, first)
    second = components(settled(keys.select("cls", "key"), few, sets, comp, s))
    more = second.select(F.col("node").alias("comp"), F.col("component").alias("final"))
    every = smallest_keys(classes, comp.join(more, "comp", "left").select("cls", F.coalesce("final", "comp").alias("comp")))
    discard(keys, few, sets, sketches, classes, comp, second)
    out = signed.select("key", "n", "cls").join(every, "cls", "left")
    own = F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id"))
    out = out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
