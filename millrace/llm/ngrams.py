"""Language-model scores from a log-frequency Bloom filter.

Texts are cut into chunks, which are stored. A chunk's distinct words, word pairs and triples (with one end token a
document) go by hash, with their counts in training texts, to the segment of the model that they belong to. Words are
counted exactly; a segment of pairs or triples builds its part of a Bloom filter that holds quantised counts: what was
counted c times is inserted with the levels 1 to ``1 + floor(log_base c)``, so the level is read back by probing level
after level until one is missing. Each segment answers every chunk that it heard of, and where a chunk's answers meet its
texts, these are scored. The model is never in one place: neither the driver nor a task has more than a segment.

A token's probability interpolates discounted relative frequencies with the add-one word probability ``p(w)``:

    ``p(w | v) = (1 - l2) p(w) + l2 max(count(v w) - d, 0) / count(v)``, and likewise
    ``p(w | u v) = (1 - l3) p(w | v) + l3 max(count(u v w) - d, 0) / count(u v)``;

after a history that was never seen, the lower order stands alone. Triples counted less than ``least_triples`` times
(2 by default, as is usual) aren't held, and so count as unseen.

Chunks and segments of any size give the same scores, but for the filter's false answers.

Defined results: null and empty texts are the end token alone. Without training rows N, V and every count are 0,
so the add-one probability is 1. Repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: Most bytes of text in a chunk of several texts.
HELD = 10 << 20
END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds a line end
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Pairs and triples keep the upper 48 bits of their hashes, which is what blocks carry of them.
UPPER = np.uint64(0xFFFFFFFFFFFF0000)
WORDS, PAIRS, TRIPLES = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """Quantisation base, bits and probes of an insertion, discount, weights of pairs and triples, least count of a triple, tokens of a segment, bytes of a chunk's texts if fewer than ``HELD``."""

    base: float = 1.5
    bits: float = 8.0
    probes: int = 5
    discount: float = 0.75
    pair_weight: float = 0.4
    triple_weight: float = 0.4
    least_triples: int = 2
    segment: int = 400_000
    round_bytes: int = 64 << 20


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words (A-Z in lower case, split at ASCII white space), each text's followed by the end's; and where each starts."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = words.flatten()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    there = pc.binary_length(flat).to_numpy() > 0
    if not there.all():
        flat, of = flat.filter(pa.array(there)), of[there]
    distinct = flat.dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(x) for x in distinct.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    starts = np.cumsum([0, *(np.bincount(of, minlength=len(texts)) + 1)])
    out, ends = np.empty(starts[-1], np.uint64), np.zeros(starts[-1], bool)
    ends[starts[1:] - 1] = True
    out[ends] = END
    out[~ends] = names[distinct.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    return out, starts[:-1]


def groups(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + 1)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
        yield low, high
        low = high


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def grams_of(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token with the one before it, and with the two before; a document's first token follows the end of another."""
    own, before = mixed(h), np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = END
    pairs = mixed(before * np.uint64(3) + own) & UPPER
    history = np.empty_like(h)
    history[1:] = pairs[:-1]
    history[starts] = END
    return pairs, mixed(history * np.uint64(5) + own) & UPPER


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def packed(h: np.ndarray, width: int) -> bytes:
    """The upper ``width`` bytes of each hash."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()


def unpacked(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, 8 - width :] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def block(kind: int, h: np.ndarray) -> bytes:
    """Hashes in order: words whole; pairs and triples by the first and steps of four bytes, or of six bytes each if a step is larger."""
    if kind == WORDS:
        return b"w" + packed(h, 8)
    steps = np.diff(h >> np.uint64(16))
    if len(steps) and steps.max() >> np.uint64(32):
        return b"h" + packed(h, 6)
    return b"s" + h[:1].astype("<u8").tobytes() + steps.astype("<u4").tobytes()


def of_block(blob: bytes) -> np.ndarray:
    if blob[:1] != b"s":
        return unpacked(blob[1:], 8 if blob[:1] == b"w" else 6)
    first, steps = np.frombuffer(blob, "<u8", 1, 1), np.frombuffer(blob, "<u4", -1, 9)
    return first + np.append(np.zeros(1, np.uint64), np.cumsum(steps, dtype=np.uint64) << np.uint64(16))


def chunks(docs: DataFrame, s: Settings) -> DataFrame:
    """(chunk, rows): rows (key, text, counted) in runs of a bounded size of text, each as one compressed value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, high in groups(batch.column("text"), min(HELD, s.round_bytes)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])
                number += 1

    return docs.mapInArrow(run, "chunk long, rows binary")


def of_chunk(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all().combine_chunks()


def texts_of(rows: pa.Table) -> pa.Array:
    found = rows.column("text")
    return found.chunk(0) if found.num_chunks else pa.array([], pa.string())


def counts(chunked: DataFrame, segments: int, asked: bool) -> DataFrame:
    """(kind, segment, chunk, hashes, times): a chunk's distinct hashes by segment, and how often counted rows have each; without a chunk, if it isn't ``asked`` for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                rows = of_chunk(blob)
                h, starts = hashed(texts_of(rows))
                counted = np.repeat(rows.column("counted").to_numpy().astype(bool), np.diff([*starts, len(h)]))
                for kind, found in zip((WORDS, PAIRS, TRIPLES), (h, *grams_of(h, starts)), strict=True):
                    distinct, at = np.unique(found, return_inverse=True)
                    n = np.bincount(at[counted], minlength=len(distinct))
                    names, low = np.unique(segment_of(distinct, segments), return_index=True)
                    ends = [*low[1:], len(distinct)]
                    hashes = [block(kind, distinct[x:y]) for x, y in zip(low, ends, strict=True)]
                    times = [n[x:y].astype("<u1" if n[x:y].max() < 256 else "<u4").tobytes() for x, y in zip(low, ends, strict=True)]
                    columns = [pa.array(np.full(len(names), kind), pa.int32()), pa.array(names.astype(np.int32)), pa.array([chunk if asked else None] * len(names), pa.int64()), pa.array(hashes, pa.binary()), pa.array(times, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "segment", "chunk", "hashes", "times"])

    return chunked.mapInArrow(run, "kind int, segment int, chunk long, hashes binary, times binary")


def levels_of(n: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(n) / np.log(base) + 1e-9).astype(np.int64)


def positions(h: np.ndarray, level: np.ndarray | int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    """Bit of one probe of a pair or triple at a level, in a segment of so many bits."""
    salt = np.atleast_1d(np.asarray(level, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((probe * 0xD1B54A32D192ED03) & (2**64 - 1))
    return ((mixed(h + salt) >> np.uint64(32)) * np.asarray(bits, np.uint64)) >> np.uint64(32)


def segment_bits(h: np.ndarray, n: np.ndarray, s: Settings) -> bytes:
    """One segment of the filter with all levels of what it holds."""
    level = levels_of(n, s.base)
    size = max(64, int(level.sum() * s.bits) + 7 >> 3 << 3)
    held = np.zeros(size, bool)
    for at in range(1, int(level.max(initial=0)) + 1):
        own = h[level >= at]
        for probe in range(s.probes):
            held[positions(own, at, probe, size)] = True
    return np.packbits(held, bitorder="little").tobytes()


@dataclass
class Share:
    """Part of the model: sorted word hashes with counts, and segments of the filter."""

    words: np.ndarray
    counts: np.ndarray
    bits: np.ndarray
    start: np.ndarray  # first bit of each segment of pairs, then of triples; -1 if it isn't in this share
    size: np.ndarray


def levels_in(share: Share, kind: int, h: np.ndarray, s: Settings) -> np.ndarray:
    """Levels of pairs or triples read from the filter: the last of the consecutive levels whose probes all hit.

    Each distinct hash is probed once, in order, so that neighbours read the same segment.
    """
    distinct, inverse = np.unique(h, return_inverse=True)
    out = np.zeros(len(distinct), np.uint8)
    number = len(share.start) // 2
    seg = segment_of(distinct, number).astype(np.int64) + number * (kind == TRIPLES)
    active = np.flatnonzero(share.start[seg] >= 0)
    level = 0
    while len(active) and level < 255:
        level += 1
        for probe in range(s.probes):
            own = seg[active]
            bit = share.start[own] + positions(distinct[active], level, probe, share.size[own]).astype(np.int64)
            active = active[(share.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
            if not len(active):
                break
        out[active] = level
    return out[inverse]


def log_probabilities(word: np.ndarray, context: np.ndarray, pair: np.ndarray, history: np.ndarray, triple: np.ndarray, total: int, distinct: int, s: Settings) -> np.ndarray:
    """log10 of the smoothed probability of each token, from its own count and its context's, and the counts of its pair, history and triple."""
    p = (word + 1) / (total + distinct + 1)
    for count, before, weight in ((pair, context, s.pair_weight), (triple, history, s.triple_weight)):
        share = np.clip(count - s.discount, 0, None) / np.maximum(before, 1)
        p = np.where(before > 0, (1 - weight) * p + weight * np.minimum(share, 1), p)
    return np.log10(p)


def least_counts(level: np.ndarray, s: Settings) -> np.ndarray:
    """The least count of each level, so that what a history is followed by doesn't exceed its own count; 0 for none."""
    table = np.ceil(s.base ** (np.arange(256) - 1.0) - 1e-9)
    table[0] = 0
    return table[level]


def answered(blocks: DataFrame, s: Settings) -> DataFrame:
    """(chunk, kind, segment, found, n, words): for each chunk's hashes in order, counts of words or levels of pairs or
    triples; and, without a chunk, how many tokens a segment counts and how many distinct ones these are."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, segment = (k.as_py() for k in key)
        named = table.column("chunk").to_pylist()
        hashes = [of_block(x) for x in table.column("hashes").to_pylist()]
        times = [np.frombuffer(x, "<u1" if len(x) == len(own) else "<u4") for x, own in zip(table.column("times").to_pylist(), hashes, strict=True)]
        h, at = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.zeros(len(h), np.int64)
        np.add.at(n, at, np.concatenate(times).astype(np.int64))
        if kind == WORDS:
            found = n.astype("<i8")
        else:
            kept = n >= (s.least_triples if kind == TRIPLES else 1)
            bits = np.frombuffer(segment_bits(h[kept], n[kept], s), np.uint8)
            none = np.zeros(0, np.int64)
            found = levels_in(Share(none, none, bits, np.zeros(2, np.int64), np.full(2, len(bits) * 8)), kind, h, s)
        ends = np.cumsum([0, *map(len, hashes)])
        own = [(c, found[at[x:y]].tobytes()) for c, x, y in zip(named, ends[:-1], ends[1:], strict=True) if c is not None]
        rows = len(own) + 1
        columns = [pa.array([*[c for c, _ in own], None], pa.int64()), pa.array([kind] * rows, pa.int32()), pa.array([segment] * rows, pa.int32()), pa.array([*[x for _, x in own], None], pa.binary())]
        columns += [pa.array([None] * len(own) + [int(x)], pa.int64()) for x in (n.sum(), (n > 0).sum())]
        return pa.Table.from_arrays(columns, ["chunk", "kind", "segment", "found", "n", "words"])

    return blocks.groupBy("kind", "segment").applyInArrow(run, "chunk long, kind int, segment int, found binary, n long, words long")


def score(docs: DataFrame, key: str, training: DataFrame | Column, s: Settings = Settings()) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``, learnt from ``training``'s texts.

    Where ``training`` is a condition on ``docs``, texts are read and sent once for both.
    """
    kind = dict(docs.dtypes)[key]
    text, apart = F.col("text").cast("string").alias("text"), isinstance(training, DataFrame)
    counted = F.lit(False) if apart else F.coalesce(training, F.lit(False))
    asked = stored(chunks(docs.select(F.col(key).alias("key"), text, counted.alias("counted")), s), "chunks")
    # a word has about six bytes: segments of a size that is even, whatever the table's
    sizes = [x.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] for x in ([docs, training] if apart else [docs])]
    number = max(4, -(-sum(sizes) // (6 * s.segment)))
    blocks = counts(asked, number, True)
    if apart:
        blocks = blocks.unionByName(counts(chunks(training.select(F.lit(None).cast(kind).alias("key"), text, F.lit(True).alias("counted")), s), number, False))
    answers = stored(answered(blocks, s), "answers")
    total, distinct = answers.where((F.col("kind") == WORDS) & F.col("chunk").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    found = answers.where(F.col("chunk").isNotNull()).select("chunk", "kind", "segment", "found")
    columns = f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return asked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_scored(total, distinct, s), columns).withColumnRenamed("key", key)


def _scored(total: int, distinct: int, s: Settings):
    def read(found: np.ndarray, answers: pa.Table, kind: int) -> np.ndarray:
        """What the segments answered for each token: their answers one after another are those of the distinct hashes in order."""
        own = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("segment")
        values = np.frombuffer(b"".join(own.column("found").to_pylist()), "<i8" if kind == WORDS else np.uint8)
        names, at = np.unique(found, return_inverse=True)
        if len(names) != len(values):
            raise RuntimeError(f"{len(values)} answers to {len(names)} hashes")
        return values[at]

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = of_chunk(chunk.column("rows")[0].as_py())
        h, starts = hashed(texts_of(rows))
        pairs, triples = grams_of(h, starts)
        starts = np.append(starts, len(h))
        word = read(h, answers, WORDS)
        pair, triple = (least_counts(read(x, answers, kind), s) for x, kind in ((pairs, PAIRS), (triples, TRIPLES)))
        context, history = np.empty_like(word), np.empty_like(pair)
        context[1:], history[1:] = word[:-1], pair[:-1]
        # a text follows the end of another
        context[starts[:-1]] = history[starts[:-1]] = word[starts[1:] - 1]
        base = np.log10((word + 1) / (total + distinct + 1))
        p = log_probabilities(word, context, pair, history, triple, total, distinct, s)
        known, base, p = (np.add.reduceat(v, starts[:-1]) for v in ((word > 0).astype(np.int64), base, p))
        n = np.diff(starts)
        columns = [rows.column("key"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), total), pa.int64()), pa.array(base, pa.float64()), pa.array(p, pa.float64())]
        return pa.Table.from_arrays(columns, ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run
