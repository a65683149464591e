"""Cost-balanced packing of documents into token sequences.

A document's ids end with a separator. Whole runs of ``size`` ids are sequences of their own; what is left of each
document joins a pool. A pool opens just as many sequences as its ids fill: full ones, and for the rest powers of
two, which need no padding. In descending length, each remainder goes whole to the sequence of the lowest estimated
cost (linear plus quadratic attention cost of its pieces) that can take it; if none can, it is cut at the lowest-cost
sequence that has room. Pools are bounded and belong to one input partition, so nothing is shuffled and a lost
task's rerun gives the same sequences.

Defined results: null and empty texts are one separator. Repeated rows are packed as often as they come; ties in
cost go to the sequence opened first, ties in length to the row read first. Other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that a worker remembers before it starts over, characters of the longest that it does (longer ones are
#: encoded anew, so that a worker holds 50 MB at most), and documents whose remainders make one pool.
CACHE, LONGEST, POOL = 200_000, 48, 4096


class ByteBPE:
    """Ids of a byte-level BPE vocabulary, as the ``tokenizers`` library gives them by default without its template.

    The file's added tokens are looked for first, the longest at each place, and get their own ids wherever a text
    quotes them. In the parts between, words repeat, so these are cut where no token can span (before a space that a
    word follows) and each distinct chunk is encoded once a worker, by a merge engine built from the same vocabulary.
    """

    #: White space that a space may join: texts with such a place are encoded whole.
    ODD = re.compile(r" (?=\s|$)")
    CUT = re.compile(r" (?! )")

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        if any(x.get(how) for x in added for how in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in or look at their neighbours are not supported")
        self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.quoted = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        # the printable stand-ins of byte-level vocabularies
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
        ranks = {bytes(stand_in[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.ranks = ranks
        self.engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[str, bytes] = {}

    def pieces(self) -> list[tuple[int, bytes]]:
        """Each id of the vocabulary, added tokens included, and the bytes that it stands for."""
        return [(i, t) for t, i in self.ranks.items()] + [(int.from_bytes(i, "little"), t.encode()) for t, i in self.added.items()]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if self.quoted is None or not self.quoted.search(text):
            return self.between(text)
        # by turns between and at the added tokens
        return b"".join([self.added[x] if i % 2 else self.between(x) for i, x in enumerate(self.quoted.split(text)) if x])

    def between(self, text: str) -> bytes:
        """Ids of a text or part of one, added tokens taken as ordinary text."""
        if self.ODD.search(text):
            return np.array(self.engine.encode_ordinary(text), "<u4").tobytes()
        words = text.split(" ")
        chunks = words[:1] + [" " + w for w in words[1:]]
        seen = self.seen
        try:
            return b"".join([seen[c] for c in chunks])
        except KeyError:
            if len(seen) > CACHE:
                seen.clear()
            return b"".join([seen[c] if c in seen else self.learnt(c) for c in chunks])

    def learnt(self, chunk: str) -> bytes:
        found = np.array(self.engine.encode_ordinary(chunk), "<u4").tobytes()
        if len(chunk) <= LONGEST:
            self.seen[chunk] = found
        return found


_encoders: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    if path not in _encoders:
        _encoders[path] = ByteBPE(path)
    return _encoders[path]


@dataclass(frozen=True)
class Packing:
    """Sequence size, separator id, and the cost of a piece of n tokens: ``linear * n + quadratic * n * n``."""

    tokenizer: str
    size: int = 1024
    separator: int = 0
    linear: float = 1.0
    quadratic: float = 1 / 1024


@dataclass
class Pieces:
    """Columns of the output as they fill."""

    key: list = field(default_factory=list)
    start: list = field(default_factory=list)
    length: list = field(default_factory=list)
    ids: list = field(default_factory=list)
    doc_tokens: list = field(default_factory=list)
    sequence: list = field(default_factory=list)
    offset: list = field(default_factory=list)

    def put(self, key, start: int, ids: bytes, doc_tokens: int, sequence: int, offset: int) -> None:
        for column, value in ((self.key, key), (self.start, start), (self.length, len(ids) // 4), (self.ids, ids), (self.doc_tokens, doc_tokens), (self.sequence, sequence), (self.offset, offset)):
            column.append(value)


def assign(lengths: list[int], p: Packing) -> list[tuple[int, int, int, int, int]]:
    """Where remainders go: (which, its start, length, sequence, offset), filling every sequence to its end."""
    total = sum(lengths)
    room = [p.size] * (total // p.size)
    room += [1 << b for b in reversed(range(p.size.bit_length())) if (total % p.size) >> b & 1]
    room, cost = np.array(room, np.int64), np.zeros(len(room))
    used = np.zeros(len(room), np.int64)
    out = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[i]
        while left:
            fits = room >= left
            to = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            n = min(left, int(room[to]))
            out.append((i, start, n, to, int(used[to])))
            cost[to] += p.linear * n + p.quadratic * n * n
            room[to] -= n
            used[to] += n
            start, left = start + n, left - n
    return out


def pack(df: DataFrame, key: str, text: str, p: Packing, with_ids: bool = False) -> DataFrame:
    """One row a piece: the key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``; and ``ids`` if asked for."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(p.tokenizer), np.array([p.separator], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        pool: list[tuple] = []

        def settle(out: Pieces) -> None:
            nonlocal sequence
            placed = assign([len(x[2]) // 4 for x in pool], p)
            for i, start, n, to, offset in placed:
                k, before, ids, tokens = pool[i]
                out.put(k, before + start, ids[4 * start : 4 * (start + n)], tokens, sequence + to, offset)
            sequence += 1 + max((x[3] for x in placed), default=-1)
            pool.clear()

        def batch_of(out: Pieces) -> pa.RecordBatch:
            columns = [pa.array(out.key, kinds), *[pa.array(x, pa.int64()) for x in (out.start, out.length, [zlib.crc32(x) for x in out.ids], out.doc_tokens, out.sequence, out.offset)]]
            names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out.ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        kinds = None
        for batch in batches:
            kinds = batch.column("key").type
            out = Pieces()
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = own.ids(t or "") + end
                tokens, full = len(ids) // 4, len(ids) // 4 // p.size
                for i in range(full):
                    out.put(k, i * p.size, ids[4 * i * p.size : 4 * (i + 1) * p.size], tokens, sequence, 0)
                    sequence += 1
                if tokens % p.size:
                    pool.append((k, full * p.size, ids[4 * full * p.size :], tokens))
                if len(pool) >= POOL:
                    settle(out)
            if out.key:
                yield batch_of(out)
        if pool:
            settle(out := Pieces())
            yield batch_of(out)

    columns = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, columns).withColumnRenamed("key", key)
