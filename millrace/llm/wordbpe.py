"""Byte-level BPE by a table of distinct words, and decoding by a join of ids with pieces.

Texts are cut where no token can span. Each task codes its texts by a dictionary of the words they have, a block at a
time: what is stored is a block's words, and its texts as numbers of words. The distinct words of all blocks are one
table, in which each word is encoded once; its ids join the pieces of the vocabulary, which gives what they decode to.
Ids return to the blocks by word and place in the block's dictionary, and each text's ids are those of its words in
order. Blocks lie in buckets, so that only dictionaries are shuffled and no text is.

Defined results: null and empty texts have no ids and decode to an empty text. Added tokens of the vocabulary that a
text quotes get their own ids. Keys may repeat or be null: rows are told apart by their place in a block. Ids that the
vocabulary lacks decode to nothing, a null list of ids to null. Other columns of the input are dropped. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import new_path
from millrace.llm.packing import encoder

#: First bytes of characters of several bytes among which there is white space: no text is cut beside them.
UNSURE = [0xC2, 0xE1, 0xE2, 0xE3, 0xEF]
SPACE, LETTER, MARK = 1, 2, 4
#: Words of a row of a dictionary, and words of one that come first as the most frequent.
WORDS = FREQUENT = 1 << 16
#: What the name of a long word starts with, and bytes of the longest that is its own name.
LONG, LONGEST = "#", 64
#: Words whose ids and bytes are put together at once.
AT_ONCE = 1 << 17


@dataclass(frozen=True)
class Settings:
    """Bytes of text that make a block, bytes that are cut at once, and the most buckets that blocks are dealt into.

    A block's dictionary grows much more slowly than its text, and dictionaries are what is shuffled: a task takes
    several input splits where those are smaller than a block.
    """

    block_bytes: int = 64 << 20
    step_bytes: int = 4 << 20
    most_buckets: int = 20_000


def _kinds() -> np.ndarray:
    """Of each byte, whether it may be white space, is an ASCII letter, or is another visible ASCII character."""
    kind = np.zeros(256, np.uint8)
    kind[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = SPACE
    for b in range(0x21, 0x7F):
        kind[b] = LETTER if chr(b).isalpha() else MARK
    return kind


KIND = _kinds()
SURE = np.ones(256, bool)
SURE[UNSURE] = False


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a word starts at each byte of valid UTF-8.

    One does at a space between two characters that aren't white space, and at a digit or mark that follows a letter:
    no token of the vocabulary's pattern spans either place.
    """
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    kind = KIND[data]
    out[1:] = (kind[:-1] == LETTER) & (kind[1:] == MARK)
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    before, after = data[at - 1], data[at + 1]
    ok = (kind[at - 1] != SPACE) & (kind[at + 1] != SPACE) & SURE[after]
    wide = before >= 0x80  # then its first byte lies one to three bytes further back
    for back, most in ((2, 0xE0), (3, 0xF0)):
        first = data[np.maximum(at - back, 0)]
        ok &= ~wide | SURE[first] | (first < 0xC0) | (first >= most)
    out[at[ok]] = True
    return out


def words_of(texts: pa.Array, quoted=None) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    # what follows a text's last space is another text
    start = np.append(cuts(whole), True)
    last = ends[1:][ends[1:] > ends[:-1]] - 1
    start[last[whole[last] == 0x20]] = False
    start[ends] = True
    if quoted is not None:
        text = whole.tobytes()
        if quoted.search(text):
            for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                for m in quoted.finditer(text, low, high):
                    start[m.start() + 1 : m.end()] = False
                    start[[m.start(), m.end()]] = True
    begin = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(begin, ends))
    n = len(begin) - 1
    if n <= 0:
        return pa.array([], pa.large_string()), counts
    found = pa.LargeStringArray.from_buffers(n, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(whole.tobytes()))
    return found, counts


def of_planes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<u4").ravel()


def value(data: np.ndarray) -> pa.Array:
    """One binary value, of the bytes of ``data`` where they are."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.nbytes], np.int32)), pa.py_buffer(data)])


class Block:
    """Texts coded by a dictionary of their own words, the most frequent first."""

    def __init__(self):
        self.keys: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.size = 0

    def add(self, keys: pa.Array, texts: pa.Array, quoted) -> None:
        words, counts = words_of(texts, quoted)
        coded = words.dictionary_encode()
        self.codes.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32))
        self.words.append(coded.dictionary)
        self.counts.append(counts)
        self.keys.append(keys)
        self.size += texts.nbytes

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The block as small rows: first its words, then its texts step by step.

        Codes are written byte by byte, all first bytes first, which compresses better.
        """
        merged = pa.concat_arrays(self.words).dictionary_encode()
        ends = np.cumsum(list(map(len, self.words)))
        of_step = np.split(merged.indices.to_numpy(zero_copy_only=False).astype(np.uint32), ends[:-1])
        often = np.zeros(len(merged.dictionary), np.int64)
        for codes, own in zip(self.codes, of_step, strict=True):
            often[own] += np.bincount(codes, minlength=len(own))
        # frequent words have small numbers, the others stand in order: both compress
        order = np.argsort(-often, kind="stable")
        rest = order[FREQUENT:]
        order[FREQUENT:] = rest[pc.sort_indices(merged.dictionary.take(pa.array(rest))).to_numpy()]
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)

        def row(first: int, **values: pa.Array) -> pa.RecordBatch:
            empty = {"keys": pa.array([None], pa.list_(self.keys[0].type)), "counts": pa.array([None], pa.list_(pa.int32())), "codes": pa.array([None], pa.binary()), "words": pa.array([None], pa.list_(pa.string()))}
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "first": pa.array([first], pa.int32()), **empty, **values})

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        for low in range(0, len(order), WORDS):
            yield row(low, words=one(merged.dictionary.take(pa.array(order[low : low + WORDS])).cast(pa.string())))
        for i, (keys, counts, own) in enumerate(zip(self.keys, self.counts, of_step, strict=True)):
            codes, self.codes[i] = rank[own][self.codes[i]], None
            planes = np.ascontiguousarray(codes.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
            yield row(i, keys=one(keys), counts=one(pa.array(counts, pa.int32())), codes=value(planes))


def quoted_tokens(path: str):
    """The pattern of the vocabulary's added tokens over bytes, the longest first, or None."""
    import re

    longest = sorted(encoder(path).added, key=len, reverse=True)
    return re.compile(b"|".join(re.escape(x.encode()) for x in longest)) if longest else None


def blocks(df: DataFrame, key: str, text: str, path: str, s: Settings) -> DataFrame:
    """Rows of blocks: its dictionary from word ``first`` on; or keys, numbers of words, and words as numbers of some texts."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own, quoted = TaskContext.get().partitionId() << 32, Block(), quoted_tokens(path)
        for batch in batches:
            ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())).to_numpy()
            low = 0
            while low < len(ends):
                before = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + s.step_bytes, "right")))
                own.add(batch.column("key").slice(low, high - low), batch.column("text").slice(low, high - low), quoted)
                low = high
                if own.size >= s.block_bytes:
                    yield from own.rows(number)
                    number, own = number + 1, Block()
        if own.keys:
            yield from own.rows(number)
        pa.default_memory_pool().release_unused()  # the worker serves other tasks

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    spark = df.sparkSession
    splits = s.block_bytes // (2 * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if splits > 1:
        rows = rows.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // splits)))
    return rows.mapInArrow(run, f"block long, first int, keys array<{kind}>, counts array<int>, codes binary, words array<string>")


def encoded(word: Column, path: str) -> Column:
    """Ids of single words."""

    @F.pandas_udf("array<int>")
    def run(words: pd.Series) -> pd.Series:
        own = encoder(path)
        plain, added = own.engine.encode_ordinary, own.added
        return pd.Series([np.frombuffer(added[w], "<i4") if w in added else np.array(plain(w), np.int32) for w in words])

    return run(word)


def named(word: Column) -> tuple[Column, Column]:
    """A name of bounded length for a word: itself, or a digest and the word beside it if it is long."""
    plain = (F.octet_length(word) <= LONGEST) & ~F.startswith(word, F.lit(LONG))
    return F.when(plain, word).otherwise(F.concat(F.lit(LONG), F.sha2(word.cast("binary"), 256))), F.when(~plain, word)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The piece of each id as bytes: as many rows as the tokenizer file has tokens."""
    return spark.createDataFrame(pd.DataFrame(encoder(path).pieces(), columns=["id", "piece"]), "id int, piece binary")


def with_pieces(df: DataFrame, by: str, pieces: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``by``, columns that it determines, ``ids``, and what they decode to, as bytes: each id joins its piece."""
    rows = df.select(by, *also, F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(pieces), "id", "left")
    rows = rows.groupBy(by).agg(*[F.first(c).alias(c) for c in also], F.sort_array(F.collect_list(F.struct("at", "id", "piece"))).alias("run"))
    run = F.filter("run", lambda x: x["id"].isNotNull())
    joined = F.unhex(F.array_join(F.transform(run, lambda x: F.hex(x["piece"])), ""))
    return rows.select(by, *also, F.transform(run, lambda x: x["id"]).alias("ids"), joined.alias("decoded"))


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """``key`` and ``text``: what lists of ids decode to, special tokens included; broken UTF-8 is marked."""
    rows = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    known = rows.where("ids IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    out = with_pieces(known, "row", vocabulary(df.sparkSession, path), ("key",)).select("key", F.make_valid_utf8(F.coalesce("decoded", F.lit(b"")).cast("string")).alias("text"))
    return out.unionByName(rows.where("ids IS NULL").select("key", F.lit(None).cast("string").alias("text"))).withColumnRenamed("key", key)


def joined(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and where each starts and the last ends."""
    values = pa.concat_arrays(values.chunks).cast(pa.large_binary()) if values.num_chunks else pa.array([], pa.large_binary())
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def gathered(data: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some values, one after the other, and where each starts and the last ends."""
    lengths = (ends[1:] - ends[:-1])[which]
    out = np.append(0, np.cumsum(lengths))
    return data[np.repeat(ends[:-1][which] - out[:-1], lengths) + np.arange(out[-1])], out


def in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Blocks as a table of the shared folder in buckets by their number; the session's catalog names it."""
    name = f"millrace_blocks_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("compression", "zstd").option("path", new_path(rows.sparkSession, "word-blocks")).bucketBy(buckets, "block").saveAsTable(name)
    return rows.sparkSession.table(name)


def encode(df: DataFrame, key: str, text: str, path: str, digests: bool = False, s: Settings = Settings()) -> DataFrame:
    """``key``, ``ids`` and ``text`` decoded from them; with ``digests``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    buckets = min(s.most_buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = in_buckets(blocks(df, key, text, path, s), buckets)
    short, long = named(F.col("word"))
    places = held.where("words IS NOT NULL").select("block", "first", F.posexplode("words").alias("at", "word"))
    places = places.select("block", (F.col("first") + F.col("at")).alias("k"), short.alias("name"), long.alias("long")).repartition("name")
    # with its first place a word takes the same exchange as the join below, which is made once
    words = places.groupBy("name").agg(F.min(F.struct("block", "k", "long")).alias("first"))
    words = words.select("name", encoded(F.coalesce("first.long", "name"), path).alias("ids")).repartition("name")
    words = with_pieces(words, "name", vocabulary(spark, path))
    # what decodes to the word itself is in the block already; ids go back as bytes, two of each if all fit
    wide = 2 if max(i for i, _ in encoder(path).pieces()) < 1 << 16 else 4
    packed = F.unhex(F.array_join(F.transform("ids", lambda x: F.lpad(F.hex(x), 2 * wide, "0")), ""))
    words = words.select("name", packed.alias("ids"), "decoded")
    other = F.when(F.col("decoded") != F.coalesce("long", "name").cast("binary"), F.col("decoded"))
    back = places.join(words, "name").select(F.col("block").alias("home"), "k", "ids", other.alias("decoded"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("k").combine_chunks()
        words = left.select(["first", "words"]).filter(pc.is_valid(left.column("words"))).sort_by("first").column("words")
        ids, said = joined(right.column("ids")), joined(pc.coalesce(right.column("decoded"), pc.cast(pc.list_flatten(words), pa.binary())))
        del right, words
        out, keys = [], []
        for step in range(left.num_rows):
            if not left.column("codes")[step].is_valid:
                continue
            codes = of_planes(np.frombuffer(left.column("codes")[step].as_buffer(), np.uint8))
            counts = left.column("counts")[step].values.to_numpy()
            keys.append(left.column("keys")[step].values)
            low, first, ends = 0, 0, np.cumsum(counts)
            while first < len(counts):
                last = max(first + 1, int(np.searchsorted(ends, low + AT_ONCE, "right")))
                some, n = codes[low : int(ends[last - 1])], counts[first:last]
                low, first = low + len(some), last
                bounds = np.append(0, np.cumsum(n))
                taken, of_ids = gathered(*ids, some)
                # ids came as big-endian numbers
                taken = taken.view(f">u{wide}").astype("<u4")
                text, of_text = gathered(*said, some)
                text, of_ids, of_text = text.tobytes(), (of_ids[bounds] // wide).tolist(), of_text[bounds].tolist()
                for a, b, c, d in zip(of_ids, of_ids[1:], of_text, of_text[1:]):
                    decoded = text[c:d].decode("utf-8", "replace")
                    if digests:
                        out.append((b - a, hashlib.sha256(taken[a:b]).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        out.append((taken[a:b], decoded))
        pa.default_memory_pool().release_unused()
        kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.Table.from_arrays([pa.concat_arrays(keys), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=names)

    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["key", "ids", "text"]
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, text string"
    out = held.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(run, f"key {kind}, {more}")
    return out.withColumnRenamed("key", key)
