"""Toxicity by a convolutional text classifier, trained in numpy, with thresholds set by language.

Words and their first four and six letters, which inflected words share, are hashed into 2**19 buckets; buckets that
at least ``min_docs`` training documents hold have an embedding, all others a zero vector. A word's embedding is the
sum of its buckets'. Filters of several widths slide over the whole text; the largest response of each
filter feeds a logistic output. The language that sets a document's threshold is guessed from its own function
words, never read from a column. Scores are shifted so that each language's threshold lies at 0.7.

All training documents are learned from. Where they are few (``per_class`` of each label, within ``sample_bytes``), one
task fits them. Else such a sample, by a hash of the id, gives no more than the weights to start from: the buckets that
have an embedding are counted over all, and in each of ``rounds`` rounds every task (of ``tasks`` at most) takes its
share of all training documents in steps, and what the tasks changed is averaged, each row of weights over the tasks
that changed it, by their documents. A task holds a few thousand documents at a time and the model, which the number of
buckets bounds.

Every document is scored whole; very long ones are learned from and scored in slices. A language's threshold has the
fewest errors among its own documents of a fifth kept out of the fit, and among all others with the weight of ``lent``
documents; beyond the small case that fifth is of all training documents, counted by steps of 1/``GRID`` of a logit.

Defined results: null and empty texts have no words and get the score of a text without known words. Where either
label is missing from the training rows, all scores are 0. Repeated rows are scored alike; a document with several
labels counts as toxic if any says so; null labels are left out. Columns to keep may not be called ``score`` or
``predicted``.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import clashing, discard, remainder, stored

BUCKETS = 1 << 19
#: Words that are taken together, in fits and in scores.
CHUNK = 100_000
#: Steps of a logit by which thresholds of all training documents are counted, and the largest logit that is told apart.
GRID, FARTHEST = 256, 64
#: Training documents that a task holds at a time, twice as many at its end.
PORTION = 2000
#: Bits that tell labelled documents' ids from others before texts are moved.
MARKS = 1 << 26
#: The languages whose thresholds are set apart, with common function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that was for on with as are be this by from it at an or",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le la les et des un une du que qui dans pour pas sur par au avec",
    "es": "el los las y del se por con para una su al lo como más",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
#: Upper-case letters become lower-case, other ASCII than letters and digits becomes a space.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Words that a worker remembers, and bytes of the longest that it does.
CACHE, LONGEST = 150_000, 64


@dataclass(frozen=True)
class Settings:
    """Sizes of the sample that a fit starts from (rows of each label, bytes of its words), of the network and of its training.

    ``rounds`` are taken over all training documents if they are more than that sample, in at most ``tasks`` tasks, each of which sends the weights that it changed. ``lent`` is the number of documents that all other languages together count for where a language's threshold is set.
    """

    per_class: int = 3000
    sample_bytes: int = 32 << 20
    min_docs: int = 4
    width: int = 16
    filters: int = 16
    spans: tuple[int, ...] = (1, 2, 3)
    epochs: int = 8
    rounds: int = 2
    tasks: int = 256
    batch: int = 64
    least_steps: int = 120
    rate: float = 0.05
    decay: float = 1e-5
    lent: float = 40.0
    seed: int = 7
    cut: float = 0.7


@dataclass
class Model:
    """Embeddings by bucket (row 0 is zero), filters by width, the output layer, and thresholds by language."""

    buckets: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    cut: float = 0.7


def bucket(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) & (BUCKETS - 1)


class Words(dict):
    """Buckets of each word that a worker has seen: its own, and those of its first four and six letters (else -1)."""

    def __missing__(self, word: bytes) -> bytes:
        letters = word[:24].decode("utf-8", "ignore")  # six letters have no more bytes
        starts = [bucket(b"%d:" % n + letters[:n].encode()) if len(letters) >= n else -1 for n in (4, 6)]
        found = struct.pack("=3i", bucket(word), *starts)
        if len(word) <= LONGEST:
            if len(self) > CACHE:
                self.clear()
            self[word] = found
        return found


_words = Words()


def buckets(text: str | None) -> np.ndarray:
    """Rows of three buckets, one row a word."""
    words = (text or "").lower().encode().translate(PLAIN).split()
    return np.frombuffer(b"".join(map(_words.__getitem__, words)), np.int32).reshape(-1, 3)


_function_words = {bucket(w.encode()): i for i, x in enumerate(FUNCTION_WORDS.values()) for w in x.split()}
_function_buckets = np.array(sorted(_function_words), np.int32)
_function_language = np.array([_function_words[b] for b in sorted(_function_words)])


def language(found: np.ndarray) -> str:
    """The language with most function words among the buckets of a text; ties to the first, none: other."""
    found = found[:, 0]
    at = np.minimum(np.searchsorted(_function_buckets, found), len(_function_buckets) - 1)
    hits = np.bincount(_function_language[at[_function_buckets[at] == found]], minlength=len(FUNCTION_WORDS))
    return LANGUAGES[int(hits.argmax())] if hits.any() else "other"


def rows_of(model: Model, found: np.ndarray) -> np.ndarray:
    """Embedding rows of buckets; row 0 for unknown ones."""
    if not len(model.buckets):
        return np.zeros(found.shape, np.int64)
    at = np.minimum(np.searchsorted(model.buckets, found), len(model.buckets) - 1)
    return np.where(model.buckets[at] == found, at + 1, 0)


def joined(docs: list[np.ndarray], spans: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all documents, zero rows before each and after the last, and where each one's zero rows start.

    A window that starts in a document or the zero rows before it ends before the next document's first word.
    """
    pad = np.zeros((max(spans), 3), np.int64)
    parts = [x for d in docs for x in (pad, d)]
    ids = np.concatenate([*parts, pad])
    starts = np.cumsum([0, *[len(d) + len(pad) for d in docs]])[:-1]
    return ids, starts


def responses(model: Model, ids: np.ndarray) -> Iterator[np.ndarray]:
    """Filter outputs at each place, width by width, before the cut at zero: sums of the words' projected embeddings."""
    n = len(ids) - max(len(f) for f in model.filters)
    # words repeat: each distinct one is projected once
    words, inverse = distinct(ids)
    vectors = model.embedding[words].sum(1)
    for filters, bias in zip(model.filters, model.bias, strict=True):
        out = np.tile(bias, (n, 1))
        for o, part in enumerate(filters):
            out += (vectors @ part)[inverse[o : o + n]]
        yield out


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and each row's place among them. A row of zeros is the commonest, and unknown words share it."""
    keys = (ids[:, 0] * 1_000_003 + ids[:, 1]) * 1_000_003 + ids[:, 2]
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return ids[first], inverse


def together(docs: list[np.ndarray], chunk: int) -> Iterator[list[np.ndarray]]:
    """Documents in groups of at most ``chunk`` words; a longer one is alone."""
    held, size = [], 0
    for doc in docs:
        if held and size + len(doc) > chunk:
            yield held
            held, size = [], 0
        held.append(doc)
        size += len(doc)
    if held:
        yield held


def slices(doc: np.ndarray, pad: int, step: int) -> Iterator[np.ndarray]:
    """The rows of one document with ``pad`` zero rows around it, ``step`` windows at a time."""
    for low in range(0, len(doc) + pad, step):
        high = min(low + step + pad, len(doc) + 2 * pad)
        ids = np.zeros((high - low, 3), np.int64)
        first, last = max(low, pad), min(high, pad + len(doc))
        ids[first - low : max(first, last) - low] = doc[first - pad : max(first, last) - pad]
        yield ids


def winners(model: Model, docs: list[np.ndarray], chunk: int = CHUNK) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each document's largest response to every filter before the cut at zero, and by width the words of the first
    windows that gave it (word of the window, document, filter, bucket)."""
    spans = tuple(len(f) for f in model.filters)
    z, windows = [], [[] for _ in spans]
    for group in together(docs, chunk):
        long = len(group) == 1 and len(group[0]) > chunk
        parts = [(x, np.zeros(1, int)) for x in slices(group[0], max(spans), chunk)] if long else [joined(group, spans)]
        best = [None] * len(spans)
        for ids, starts in parts:
            ends = np.append(starts[1:], len(ids) - max(spans))
            for (k, w), out in zip(enumerate(spans), responses(model, ids), strict=True):
                at = np.stack([x + out[x:y].argmax(0) for x, y in zip(starts, ends, strict=True)])
                found = np.take_along_axis(out, at, 0), np.stack([ids[at + o] for o in range(w)])
                if best[k] is not None:
                    more = found[0] > best[k][0]
                    found = np.where(more, found[0], best[k][0]), np.where(more[None, ..., None], found[1], best[k][1])
                best[k] = found
        z.append(np.concatenate([found for found, _ in best], 1))
        for k, (_, own) in enumerate(best):
            windows[k].append(own)
    return np.concatenate(z), [np.concatenate(x, 1) for x in windows]


def new_model(buckets: np.ndarray, rng: np.random.Generator, s: Settings) -> Model:
    """Random weights for these buckets."""
    model = Model(buckets, np.zeros((1, s.width), np.float32), cut=s.cut)
    model.embedding = rng.normal(0, 0.1, (len(buckets) + 1, s.width)).astype(np.float32)
    model.embedding[0] = 0
    model.filters = [rng.normal(0, 1 / np.sqrt(s.width * w), (w, s.width, s.filters)).astype(np.float32) for w in s.spans]
    model.bias = [np.zeros(s.filters, np.float32) for _ in s.spans]
    model.out = rng.normal(0, 0.3, s.filters * len(s.spans)).astype(np.float32)
    return model


def flat(model: Model) -> np.ndarray:
    """All weights in rows of an embedding's width; the embedding's own rows are the last."""
    width = model.embedding.shape[1]
    dense = np.concatenate([*[f.ravel() for f in model.filters], *model.bias, model.out, [model.out_bias]]).astype(np.float32)
    return np.concatenate([np.pad(dense, (0, -len(dense) % width)).reshape(-1, width), model.embedding])


def unflat(rows: np.ndarray, like: Model) -> Model:
    """A model whose weights are these rows; its arrays are its own."""
    head = len(rows) - len(like.embedding)
    dense, at, parts = rows[:head].ravel(), 0, []
    for x in (*like.filters, *like.bias, like.out):
        parts.append(dense[at : at + x.size].reshape(x.shape).copy())
        at += x.size
    k = len(like.filters)
    return replace(like, embedding=rows[head:].copy(), filters=parts[:k], bias=parts[k : 2 * k], out=parts[-1], out_bias=float(dense[at]))


class Trainer:
    """A model in training by steps of a batch, with the sums of squared gradients, which are kept like a model."""

    def __init__(self, model: Model, weight: dict[int, float], s: Settings, squares: Model | None = None):
        self.model, self.weight, self.s = model, weight, s
        self.squares = squares or unflat(np.full_like(flat(model), 1e-3), model)

    def step(self, value: np.ndarray, old: np.ndarray, grad: np.ndarray) -> None:
        old += grad * grad
        value -= self.s.rate * 3 * grad / np.sqrt(old)

    def batch(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """One step on documents as rows of the embedding, with their labels."""
        s, model, squares = self.s, self.model, self.squares
        z, windows = winners(model, docs)
        feats = np.maximum(z, 0)
        error = 1 / (1 + np.exp(-(feats @ model.out + model.out_bias))) - y
        error = (error * np.where(y == 1, self.weight[1], self.weight[0]) / len(docs)).astype(np.float32)
        back = error[:, None] * model.out[None] * (z > 0)
        model.out_bias -= s.rate * 3 * float(error.sum())
        self.step(model.out, squares.out, feats.T @ error + s.decay * model.out)
        touched, moved = [], []
        for k, w in enumerate(s.spans):
            own = back[:, k * s.filters : (k + 1) * s.filters]
            grad = np.zeros_like(model.filters[k])
            for o in range(w):
                row = windows[k][o]
                grad[o] = np.einsum("bfd,bf->df", model.embedding[row].sum(2), own)
                change = (own[..., None] * model.filters[k][o].T[None]).reshape(-1, s.width)
                for j in range(3):
                    touched.append(row[..., j].ravel())
                    moved.append(change)
            self.step(model.filters[k], squares.filters[k], grad + s.decay * model.filters[k])
            self.step(model.bias[k], squares.bias[k], own.sum(0))
        rows_hit, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        grad = np.zeros((len(rows_hit), s.width), np.float32)
        np.add.at(grad, inverse, np.concatenate(moved))
        grad += s.decay * model.embedding[rows_hit]
        squares.embedding[rows_hit] += grad * grad
        model.embedding[rows_hit] -= s.rate * 3 * grad / np.sqrt(squares.embedding[rows_hit])
        model.embedding[0] = 0

    def epoch(self, docs: list[np.ndarray], labels: np.ndarray, order: np.ndarray) -> None:
        for b in range(0, len(order), self.s.batch):
            at = order[b : b + self.s.batch]
            self.batch([docs[i] for i in at], labels[at])


def balance(labels: dict[int, int]) -> dict[int, float]:
    """Weights by which both labels count alike, of how many documents have each."""
    return {y: sum(labels.values()) / 2 / max(1, labels.get(y, 0)) for y in (0, 1)}


def train(docs: list[np.ndarray], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Fit the network to bucket arrays and 0/1 labels; every fifth document only sets thresholds."""
    return trained(docs, labels, s).model


def trained(docs: list[np.ndarray], labels: np.ndarray, s: Settings) -> Trainer:
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(docs))
    held, used = order[::5], np.setdiff1d(order, order[::5])
    seen, counts = np.unique(np.concatenate([np.unique(docs[i]) for i in used] or [np.zeros(0, np.int32)]), return_counts=True)
    counts[seen < 0] = 0
    model = new_model(seen[counts >= s.min_docs], rng, s)
    ids_of = [rows_of(model, d).astype(np.int32) for d in docs]
    epochs = max(s.epochs, -(-s.least_steps * s.batch // max(1, len(used))))
    fit = Trainer(model, balance({y: int((labels[used] == y).sum()) for y in (0, 1)}), s)
    for _ in range(epochs):
        rng.shuffle(used)
        fit.epoch(ids_of, labels, used)
    z = whole_logits(model, [docs[i] for i in held])
    model.thresholds = thresholds(z, labels[held], np.array([LANGUAGES.index(language(docs[i])) for i in held], int), np.ones(len(held)), s)
    return fit


def thresholds(z: np.ndarray, y: np.ndarray, tongue: np.ndarray, times: np.ndarray, s: Settings) -> dict[str, float]:
    """By language, from logits with label and language and how often they occur.

    A language's own documents count one each, all others together like ``lent`` documents.
    """
    out = {}
    for i, name in enumerate(LANGUAGES):
        own = tongue == i
        out[name] = threshold(z, y, times * np.where(own, 1.0, s.lent / max(1, times[~own].sum())))
    return out


def threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The middle of the widest range of logits with the least weight of errors; 0 without both labels."""
    if not len(z) or not 0 < y.sum() < len(y):
        return 0.0
    weight = np.ones(len(z)) if weight is None else weight
    z, at = np.unique(z, return_inverse=True)
    toxic, clean = (np.bincount(at, weight * (y == k), len(z)) for k in (1, 0))
    missed = np.append(0, np.cumsum(toxic))
    wrong = clean.sum() - np.append(0, np.cumsum(clean))
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    loss = missed + wrong
    best = np.flatnonzero(np.isclose(loss, loss.min()))
    wide = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[wide] + edges[wide + 1]) / 2)


def logits(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    if not docs:
        return np.zeros(0)
    ids, starts = joined([rows_of(model, d) for d in docs], tuple(len(f) for f in model.filters))
    pooled = [np.maximum.reduceat(out, starts) for out in responses(model, ids)]
    return np.maximum(np.concatenate(pooled, 1), 0) @ model.out + model.out_bias


def long_logit(model: Model, doc: np.ndarray, step: int) -> np.ndarray:
    """As :func:`logits`, of one document in slices of ``step`` windows."""
    best = [np.full(f.shape[2], -np.inf) for f in model.filters]
    for ids in slices(rows_of(model, doc), max(len(f) for f in model.filters), step):
        best = [np.maximum(x, out.max(0)) for x, out in zip(best, responses(model, ids), strict=True)]
    return np.array([np.maximum(np.concatenate(best), 0) @ model.out + model.out_bias])


def whole_logits(model: Model, docs: list[np.ndarray], chunk: int = CHUNK) -> np.ndarray:
    """Logits of documents in groups, and of long ones in slices, of up to ``chunk`` words at a time."""
    groups = together(docs, chunk)
    return np.concatenate([np.zeros(0), *[long_logit(model, g[0], chunk) if len(g) == 1 and len(g[0]) > chunk else logits(model, g) for g in groups]])


def scores(model: Model, texts: list[str | None], chunk: int = CHUNK) -> np.ndarray:
    """Scores of whole texts; documents are taken together, and long ones in slices, up to ``chunk`` words at a time."""
    out, docs, size = [], [], 0
    shift = np.log(model.cut / (1 - model.cut))

    def settle(z: np.ndarray, of: list[np.ndarray]) -> None:
        z = z - np.array([model.thresholds[language(d)] for d in of])
        out.append(1 / (1 + np.exp(-np.clip(z + shift, -30, 30))))

    for text in texts:
        found = buckets(text)
        if docs and size + len(found) > chunk:
            settle(logits(model, docs), docs)
            docs, size = [], 0
        if len(found) > chunk:
            settle(long_logit(model, found, chunk), [found])
            continue
        docs.append(found)
        size += len(found)
    if docs:
        settle(logits(model, docs), docs)
    return np.concatenate(out) if out else np.zeros(0)


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, y, words) of every labelled document whose crc32 modulo 3 isn't 1, h a hash of its id."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [buckets(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(words, pa.binary())], ["h", "y", "words"])

    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("y").isin(0, 1) & (remainder("doc_id", 3) != 1))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    own = docs.where(remainder("doc_id", 3) != 1).select("doc_id", F.col("text").cast("string").alias("text"))
    # by shuffle at any size: what is moved grows with the labelled texts, and no labels pass through the driver
    own = marked(own, known).join(known.hint("shuffle_hash"), "doc_id")
    return own.select(F.xxhash64("doc_id").alias("h"), "y", "text").mapInArrow(hashed, "h long, y int, words binary")


def marked(docs: DataFrame, known: DataFrame) -> DataFrame:
    """All documents whose id is among the ``known`` ones, and few others, so that a join moves no more texts than it needs.

    Ids are told apart by ``MARKS`` bits in pages of 4 KB, 8 MB in all, which every task gets; if they are no whole
    numbers, all documents are moved.
    """
    if not {dict(x.dtypes)["doc_id"] for x in (docs, known)} <= {"tinyint", "smallint", "int", "bigint"}:
        return docs
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(MARKS))
    place = known.select(F.bitmap_bucket_number(slot).alias("__page"), F.bitmap_bit_position(slot).alias("bit"))
    pages = place.repartition("__page").groupBy("__page").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    bit = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("__page", F.bitmap_bucket_number(slot)).join(F.broadcast(pages), "__page")
    return found.where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("__page", "__bits")


def within(rows: list, most: int) -> list[tuple[int, int]]:
    """(h, y) of the rows that are taken: of each label, in the order of h, all that still fit; others are passed over."""
    taken, used = [], {}
    for h, y, size in sorted(map(tuple, rows)):
        if used.get(y, 0) + size <= most:
            used[y] = used.get(y, 0) + size
            taken.append((h, y))
    return taken


def started(rows: DataFrame, s: Settings) -> Trainer | None:
    """The fit to ``per_class`` ids of each label, as far as their words keep within ``sample_bytes``; None if a label is missing."""
    # one row an id: of several texts the shortest, then the first by its words
    one = rows.select("h", "y", F.struct(F.length("words").alias("bytes"), F.xxhash64("words").alias("digest")).alias("one")).groupBy("h", "y").agg(F.min("one").alias("one")).select("h", "y", "one.*")
    picked = [one.where(F.col("y") == y).orderBy("h").limit(s.per_class) for y in (0, 1)]
    found = picked[0].unionByName(picked[1]).collect()
    kept = set(within([(r["h"], r["y"], r["bytes"]) for r in found], s.sample_bytes // 2))
    kept = rows.sparkSession.createDataFrame([tuple(r) for r in found if (r["h"], r["y"]) in kept], "h long, y int, bytes int, digest long")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {x[:2]: x for b in batches for x in zip(*[b.column(c).to_pylist() for c in ("h", "y", "words")], strict=True)}
        held = [held[k] for k in sorted(held)]
        if len({y for _, y, _ in held}) == 2:
            fit = trained([of_bytes(words) for *_, words in held], np.array([y for _, y, _ in held]), s)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit)], pa.binary())], ["fit"])

    # the sample is bounded, so one task takes it all; the driver gets the model only
    same = rows.select("h", "y", F.length("words").alias("bytes"), F.xxhash64("words").alias("digest"), "words")
    own = same.join(F.broadcast(kept), ["h", "y", "bytes", "digest"]).dropDuplicates(["h", "y"]).select("h", "y", "words")
    found = own.repartition(1).mapInArrow(fitted, "fit binary").collect()
    return pickle.loads(found[0]["fit"]) if found else None


def of_bytes(words: bytes) -> np.ndarray:
    return np.frombuffer(words, np.int32).reshape(-1, 3)


def counted(rows: DataFrame, s: Settings) -> np.ndarray:
    """Buckets that at least ``min_docs`` of all these rows hold, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words in batch.column("words").to_pylist():
                own = np.unique(of_bytes(words))
                held[own[own >= 0]] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["bucket", "n"])

    found = rows.select("words").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= s.min_docs)
    return np.sort(found.select("bucket").toArrow().column(0).to_numpy())


def carried(fit: Trainer | None, found: np.ndarray, weight: dict[int, float], s: Settings) -> Trainer:
    """A fit to the buckets ``found`` that starts from another's weights; random ones where that has none."""
    out = Trainer(new_model(found, np.random.default_rng(s.seed), s), weight, s)
    if fit:
        known = rows_of(fit.model, found)
        for new, old in ((out.model, fit.model), (out.squares, fit.squares)):
            new.embedding[1:][known > 0] = old.embedding[known[known > 0]]
            new.filters, new.bias, new.out, new.out_bias = old.filters, old.bias, old.out, old.out_bias
    return out


def portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Documents and labels of a task by ``PORTION`` or ``most`` bytes; the last has what is left, up to twice that."""
    docs, labels, size = [], [], 0
    for batch in batches:
        for y, words in zip(batch.column("y").to_pylist(), batch.column("words").to_pylist(), strict=True):
            if len(docs) >= 2 * PORTION or size >= most:
                yield docs[:PORTION], np.array(labels[:PORTION])
                docs, labels = docs[PORTION:], labels[PORTION:]
                size = sum(d.nbytes for d in docs)
            docs.append(of_bytes(words))
            labels.append(y)
            size += len(words)
    if docs:
        yield docs, np.array(labels)


def averaged(fit: Trainer, rows: DataFrame, number: int) -> Trainer:
    """The fit after a round over all ``rows``: what each task changed, averaged over those that did, by their documents.

    Sums of squared gradients go on within a task and start anew from the fit's in each round.
    """
    s = fit.s
    names = [f"v{i}" for i in range(s.width)]
    shared = rows.sparkSession.sparkContext.broadcast(fit)
    least = -(-s.least_steps // s.rounds) * s.batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        before = flat(start.model)
        own = Trainer(unflat(before, start.model), start.weight, s, unflat(flat(start.squares), start.squares))
        rng, n = np.random.default_rng([s.seed, number]), 0
        for docs, labels in portions(batches, s.sample_bytes):
            ids = [rows_of(own.model, d).astype(np.int32) for d in docs]
            for _ in range(1 if n else max(1, -(-least // len(docs)))):  # a task with few documents takes them more often
                own.epoch(ids, labels, rng.permutation(len(docs)))
            n += len(docs)
        if n:
            moved = flat(own.model) - before
            at = np.flatnonzero(moved.any(1))
            columns = [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), n)), *[pa.array(c) for c in moved[at].T]]
            yield pa.RecordBatch.from_arrays(columns, ["i", "n", *names])

    # no task has a row twice, so the rows are moved as they are: single precision, summed in double where they meet
    out = rows.select("y", "words").mapInArrow(run, ", ".join(["i int", "n long", *[f"{c} float" for c in names]])).repartition("i")
    found = out.groupBy("i").agg(*[(F.sum(F.col(c).cast("double") * F.col("n")) / F.sum("n")).cast("float").alias(c) for c in names]).toArrow()
    shared.destroy()
    at = found.column("i").to_numpy()
    after = flat(fit.model)
    if len(at):
        after[at] += np.stack([found.column(c).to_numpy() for c in names], 1)
    return Trainer(unflat(after, fit.model), fit.weight, s, fit.squares)


def thresholds_of(model: Model, rows: DataFrame, s: Settings) -> dict[str, float]:
    """Thresholds by all ``rows``; the driver gets how often each step of a logit occurs."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, labels in portions(batches, s.sample_bytes):
            z = np.clip(np.rint(whole_logits(shared.value, docs) * GRID), -FARTHEST * GRID, FARTHEST * GRID).astype(np.int32)
            tongue = np.array([LANGUAGES.index(language(d)) for d in docs], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tongue), pa.array(labels.astype(np.int32)), pa.array(z)], ["tongue", "y", "z"])

    found = rows.select("y", "words").mapInArrow(run, "tongue int, y int, z int").groupBy("tongue", "y", "z").count().toArrow()
    shared.destroy()
    tongue, y, z, times = (found.column(c).to_numpy() for c in ("tongue", "y", "z", "count"))
    return thresholds(z / GRID, y, tongue, times.astype(float), s)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """Train on all labelled documents whose crc32 modulo 3 isn't 1; None if a label is missing."""
    rows = stored(training(docs, labels), "training")
    aside = F.pmod("h", F.lit(5)) == 0
    sizes = rows.groupBy("y", aside.alias("aside")).agg(F.count("*").alias("n"), F.sum(F.length("words")).alias("bytes")).collect()
    of_label = {y: [sum(r[c] for r in sizes if r["y"] == y) for c in ("n", "bytes")] for y in {r["y"] for r in sizes}}
    model = None
    if len(of_label) == 2 and all(n <= s.per_class and size <= s.sample_bytes // 2 for n, size in of_label.values()):
        found = started(rows, s)
        model = found.model if found else None
    elif len(of_label) == 2:
        n = {r["y"]: r["n"] for r in sizes if not r["aside"]}
        used = rows.where(~aside).coalesce(max(1, min(s.tasks, sum(n.values()) // (2 * PORTION))))  # each task has enough for steps of its own
        found = carried(started(used, s), counted(used, s), balance(n), s)
        for number in range(s.rounds):
            found = averaged(found, used, number)
        model = found.model
        model.thresholds = thresholds_of(model, rows.where(aside), s)
    discard(rows)
    return model


def classify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, with ``score`` and ``predicted`` (1 at 0.7 and above)."""
    clashing(keep, ["score", "predicted", "__text"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            found = scores(shared.value, texts) if shared.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(found, pa.float64())], [*keep, "score"])

    out = docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= (model.cut if model else 0.7)).cast("int"))
