"""SentencePiece encoding and decoding that keeps byte offsets.

Texts are normalised here, by the longest prefix that the model's compiled character map holds at each place; every
normalised byte remembers the source bytes it stands for. The normalised text is cut before each word mark (no piece
spans one), each distinct chunk gets its pieces from the model's merges once a worker, and pieces are projected back
to byte spans of the original text through the recorded alignment.

Defined results: null and empty texts give the begin and end ids alone and decode to an empty text. A byte piece
spans its own byte of a character that normalisation left alone, else all that its character came from. The dummy
prefix spans nothing. Repeated rows give repeated results; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks that a worker remembers before it starts over, and characters of the longest that it does: longer ones are
#: encoded anew, so that a worker holds 100 MB at most.
CACHE, LONGEST = 300_000, 48


class CharsMap:
    """A compiled character map: a double-array trie of source sequences, and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement for the longest sequence that starts at ``at``, and that sequence's length."""
        if not self.units:
            return None
        units, found = self.units, None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.replacements[start : self.replacements.index(b"\0", start)], found[1]


@dataclass
class Rules:
    """What the model says about white space."""

    dummy_prefix: bool
    remove_extra: bool


def aligned(text: str, chars: CharsMap, rules: Rules) -> tuple[str, np.ndarray, np.ndarray]:
    """The normalised text, and for each of its bytes where its source starts and ends in ``text``'s bytes."""
    data = text.encode()
    if not data:
        return "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not chars.units and not rules.remove_extra:
        width = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
        begin = np.repeat(np.arange(len(data)), width)
        end = begin + 1
        out = text.replace(" ", MARK)
        if rules.dummy_prefix:
            return MARK + out, np.concatenate([[0, 0, 0], begin]), np.concatenate([[0, 0, 0], end])
        return out, begin, end

    # units of the normalised text: (bytes, start, end in the source, whether bytes are the source's own)
    found: list[tuple[bytes, int, int, bool]] = []
    at = 0
    while at < len(data):
        if hit := chars.longest(data, at):
            new, n = hit
        else:
            n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
            new = data[at : at + n]
        found.append((new, at, at + n, not hit or new == data[at : at + n]))
        at += n
    parts: list[bytes] = []
    begin, end = [], []

    def put(byte: bytes, b: int, e: int, own: bool) -> None:
        parts.append(byte)
        begin.extend(range(b, b + len(byte)) if own else [b] * len(byte))
        end.extend(range(b + 1, b + len(byte) + 1) if own else [e] * len(byte))

    mark = MARK.encode()
    flat: list[tuple[bytes, int, int, bool]] = []
    for new, b, e, own in found:
        for bit in re.split(rb"( )", new) if b" " in new and new != b" " else [new]:
            if bit:
                flat.append((bit, b, e, own and bit == new))
    if rules.remove_extra:
        while flat and flat[0][0] == b" ":
            flat.pop(0)
        while flat and flat[-1][0] == b" ":
            flat.pop()
        flat = [x for i, x in enumerate(flat) if x[0] != b" " or i == 0 or flat[i - 1][0] != b" "]
    if rules.dummy_prefix and (flat or not rules.remove_extra):
        at = flat[0][1] if flat else 0
        put(mark, at, at, False)
    for new, b, e, own in flat:
        put(*((mark, b, e, False) if new == b" " else (new, b, e, own)))
    return b"".join(parts).decode("utf-8", "replace"), np.array(begin, np.int64), np.array(end, np.int64)


class Codec:
    """One model's encoder and decoder, with the chunks it has seen."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        spec = model.normalizer_spec
        self.chars, self.rules = CharsMap(spec.precompiled_charsmap), Rules(spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        kinds = {i: p.type for i, p in enumerate(model.pieces)}
        if 4 in kinds.values() or any(MARK in p.piece.lstrip(MARK) for p in model.pieces) or model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback:
            raise ValueError("only models with byte pieces, without user-defined pieces and with marks before words")
        # the merges work on normalised text: what the model would do to raw text is switched off
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.begin, self.end = self.merges.bos_id(), self.merges.eos_id()
        self.surface = [bytes([int(p.piece[3:-1], 16)]) if kinds[i] == 6 else b"" if kinds[i] == 3 else p.piece.encode() for i, p in enumerate(model.pieces)]
        self.shown = [s if kinds[i] == 6 else s.replace(MARK.encode(), b" ") for i, s in enumerate(self.surface)]
        self.width = np.array([len(s) for s in self.surface])
        self.seen: dict[str, tuple[bytes, bytes]] = {}

    #: A chunk: word marks, then all up to the next one.
    CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def learn(self, chunks: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids and decoded bytes of chunks; short ones stay known."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        new = [c for c in chunks if c not in self.seen]
        found = {}
        for chunk, ids in zip(new, self.merges.encode(new, num_threads=1), strict=True):
            found[chunk] = np.array(ids, "<u4").tobytes(), b"".join([self.shown[i] for i in ids])
        self.seen.update((c, x) for c, x in found.items() if len(c) <= LONGEST)
        return found

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]:
        """Of each text: ids with begin and end, the pieces' byte spans (starts, ends), and the decoded bytes."""
        for text in texts:
            normal, begin, end = aligned(text or "", self.chars, self.rules)
            chunks = self.CHUNK.findall(normal)
            try:
                got = [self.seen[c] for c in chunks]
            except KeyError:
                new = self.learn(set(chunks))
                got = [new[c] if c in new else self.seen[c] for c in chunks]
            ids = np.frombuffer(b"".join([x[0] for x in got]), "<u4")
            stops = np.cumsum(self.width[ids]) if len(ids) else np.zeros(0, np.int64)
            starts = stops - self.width[ids] if len(ids) else stops
            spans = (begin[starts], end[stops - 1]) if len(ids) else (begin, end)
            shown = b"".join([x[1] for x in got])
            if shown[:1] == b" " and (self.rules.dummy_prefix or self.rules.remove_extra):
                shown = shown[1:]
            yield np.concatenate([[self.begin], ids, [self.end]]).astype("<u4"), *spans, shown


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """A worker's codec for a model; it stays for the worker's next tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


PIECES = "key {key}, ids array<int>, starts array<int>, ends array<int>, decoded string"
DIGESTS = "key {key}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"


def encode(df: DataFrame, key: str, text: str, model: str, digests: bool = False) -> DataFrame:
    """Ids, byte spans of the pieces between begin and end, and the decoded text of every row; or their digests.

    Returns ``key`` under its own name. No shuffle: each partition is encoded where it is read.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            encoded = own.encode(batch.column("text").to_pylist())
            if digests:  # one text's ids and spans at a time
                rows = [(len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(shown).hexdigest(), int((ends - starts).sum())) for ids, starts, ends, shown in encoded]
                columns = [pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))]
                names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"]
            else:
                rows = list(encoded)
                columns = [pa.array([x[i].astype(np.int32) for x in rows], pa.list_(pa.int32())) for i in range(3)]
                columns.append(pa.array([x[3].decode("utf-8", "replace") for x in rows], pa.string()))
                names = ["key", "ids", "starts", "ends", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names)

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, (DIGESTS if digests else PIECES).format(key=kind)).withColumnRenamed("key", key)
