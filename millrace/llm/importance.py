"""Resampling of documents towards a target distribution, by hashed word runs counted in an external sort.

Texts become streams of 16-bit buckets, written in blocks together with where each document starts. A block's stream
is sorted and run-length encoded, and the runs of all blocks are summed; so are those of the target's texts. From both
comes a bucket's gain, how much likelier the target is to hold it. A document's weight is the mean of its buckets'
gains, gathered from the written streams by ``np.add.reduceat``. Weights plus a Gumbel variate of the id are scores,
and the highest are drawn. Ranks come from one range partitioning by score: rows are numbered within their part.

Defined results: null and empty texts, and texts without words, have no features and weight 0. A null id is hashed
like an empty one and comes last among ties; rows of one id are drawn each. Repeated rows get ranks of their own.
Without a target or without documents every gain is that of empty counts. Empty tables give empty results; other
columns of the input are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: ASCII digits and letters after lower-casing, and the bytes of every other character: what a word is made of.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLOCK = "keys array<{}>, words array<int>, counts array<int>, stream binary"


@dataclass(frozen=True)
class Settings:
    """Buckets (65,536 at most), words of the longest run, percent drawn, words that a document needs to be drawn,
    what gains and variates are multiplied by, the variates' seed, and features of a block."""

    buckets: int = 10_000
    longest: int = 1
    percent: int = 10
    least_words: int = 20
    unit: int = 1000
    seed: str = "2024"
    block: int = 4 << 20

    def __post_init__(self):
        if not 0 < self.buckets <= 1 << 16:
            raise ValueError("buckets are numbers of 16 bits")


def features(text: str | None, s: Settings) -> tuple[int, list[int]]:
    """Number of words of a text, and crc32 of each run of words."""
    words = WORD.findall((text or "").encode().translate(LOWER))
    out = list(map(zlib.crc32, words))
    runs = words
    for n in range(2, s.longest + 1):
        runs = [a + b" " + b for a, b in zip(runs, words[n - 1 :])]
        out += map(zlib.crc32, runs)
    return len(words), out


def streams(df: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """A row a block: keys of its documents, how many words and features each has, and all their buckets."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, counts, parts, held, of_key = [], [], [], [], 0, None

        def block() -> pa.RecordBatch:
            lists = [pa.concat_arrays(keys), pa.array(words, pa.int32()), pa.array(counts, pa.int32())]
            stream = np.concatenate(parts).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([*[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], pa.array([stream], pa.binary())], ["keys", "words", "counts", "stream"])

        for batch in batches:
            of_key = batch.column("key")
            for i, t in enumerate(batch.column("text")):
                n, found = features(t.as_py(), s)
                keys.append(of_key.slice(i, 1))
                words.append(n)
                counts.append(len(found))
                parts.append(np.array(found, np.uint32) % s.buckets)
                held += len(found)
                if held >= s.block:
                    yield block()
                    keys, words, counts, parts, held = [], [], [], [], 0
        if keys:
            yield block()

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, BLOCK.format(kind))


def counted(blocks: DataFrame, s: Settings) -> np.ndarray:
    """How often each bucket occurs: blocks are sorted and run-length encoded, runs are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("stream"):
                sorted_ = np.sort(np.frombuffer(x.as_py(), "<u2"))
                starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
                lengths = np.diff(np.append(starts, len(sorted_)))
                yield pa.RecordBatch.from_arrays([pa.array(sorted_[starts].astype(np.int32)), pa.array(lengths, pa.int64())], ["bucket", "n"])

    found = blocks.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(s.buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(own: np.ndarray, target: np.ndarray, s: Settings) -> np.ndarray:
    """Log ratios of smoothed shares, floored at ``unit`` to one."""
    part = (target + 1.0) * float(int(own.sum()) + s.buckets) / ((own + 1.0) * float(int(target.sum()) + s.buckets))
    return np.floor(s.unit * np.log(part)).astype(np.int64)


def weighed(blocks: DataFrame, table: np.ndarray, kind: str) -> DataFrame:
    """``key``, ``n_words``, ``n_features`` and ``weight`` of each document, by the written streams."""
    shared = blocks.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, words, counts = (batch.column(c)[row].values for c in ("keys", "words", "counts"))
                n = counts.to_numpy().astype(np.int64)
                gained = shared.value[np.frombuffer(batch.column("stream")[row].as_py(), "<u2")]
                some = n > 0
                weight = np.zeros(len(n), np.int64)
                if len(gained):
                    starts = np.cumsum(n) - n
                    weight[some] = np.add.reduceat(gained, starts[some]) // n[some]
                yield pa.RecordBatch.from_arrays([keys, pc.cast(words, pa.int64()), pa.array(n), pa.array(weight)], ["key", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` from 1 in an order, by one range partitioning; ties of the whole order may be split."""
    salted = rows.withColumn("__tie", F.monotonically_increasing_id())
    placed = salted.repartitionByRange(*order, F.col("__tie")).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("__at", F.monotonically_increasing_id()).drop("__tie"), "ranked")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()  # a row a partition
    before, base = 0, []
    for r in sizes:
        base.append((r["__part"], before))
        before += r["n"]
    bases = rows.sparkSession.createDataFrame(base, "__part long, __base long")
    return placed.withColumn("__part", part).join(F.broadcast(bases), "__part").select(*rows.columns, (F.col("__base") + within + 1).alias("rank"))


def resample(docs: DataFrame, key: str, text: str, target: DataFrame, target_text: str, s: Settings = Settings()) -> DataFrame:
    """``key``, ``n_features``, ``weight``, ``score`` and ``rank`` (null unless drawn) of every document."""
    kind = dict(docs.dtypes)[key]
    own = stored(streams(docs, key, text, s), "bucket-streams")
    wanted = counted(streams(target.select(F.lit(0).alias("key"), F.col(target_text).alias("text")), "key", "text", s), s)
    rows = weighed(own, gains(counted(own, s), wanted, s), kind)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long").cast("double")
    noise = F.floor(-float(s.unit) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stored(rows.withColumn("score", F.col("weight") + noise), "weights")
    able = rows.where(F.col("n_words") >= s.least_words)
    most = s.percent * able.count() // 100
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    ranked = numbered(able, order).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = rows.where(F.col("n_words") < s.least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
