"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are training documents labelled 1; the unlabelled side is all training documents, labelled or not,
and no other label is looked at. A document is seen by measures of its make-up and by the shares of its byte triples,
hashed into ``GRAMS`` buckets. A small network first separates the two sides; its scores of all training documents
against those of positives it wasn't fitted to bound the share of positives among the unlabelled (the class prior). It
is then fitted to the risk ``prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))``, taking a step back on the
negative part where that is below zero. The cut lies where that risk sees both classes alike.

The fit starts from bounded samples: ``per_side`` (4,000) trusted positives, one row an id, and as many rows of all
training documents, each chosen by a hash. From there ``passes`` steps follow the risk itself, whose unlabelled side is
a sum over every training document: features are stored once, and each pass adds up gradients on Spark. The prior and
the scores come from every document, whole, too.

Defined results: null and empty texts have features of an empty text and a score like any other. Without positives,
or without any text, all scores are 0. Repeated rows are scored alike; of several labels the largest counts; null
labels are left out. Columns to keep may not be called ``score`` or ``predicted``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import clashing, discard, remainder, stored

FEATURES = (
    "log_words", "mean_word", "long_words", "short_words", "distinct", "distinct_lower", "adjacent_same", "top_word",
    "upper", "capital_words", "title_words", "digits", "pipes", "exclamations", "stops", "commas", "symbols", "brackets",
    "lines", "distinct_lines", "non_ascii", "marked_words", "other_controls", "line_length",
)
#: Buckets of byte triples, and bytes of a text that are hashed at a time.
GRAMS, SLICE = 256, 1 << 20
WIDTH = len(FEATURES) + GRAMS
#: Rows whose features are worked on at a time.
ROWS = 1024


@dataclass(frozen=True)
class Settings:
    """Rows of each side's sample, sizes of the network and its training, and passes over all training documents."""

    per_side: int = 4000
    hidden: int = 24
    epochs: int = 30
    passes: int = 12
    batch: int = 256
    rate: float = 0.01
    decay: float = 1e-3
    seed: int = 5
    cut: float = 0.3
    bins: int = 400
    gram_weight: float = 0.1


def gram_shares(data: bytes) -> np.ndarray:
    """Square roots of the shares of a text's byte triples in each bucket."""
    b, found = np.frombuffer(data, np.uint8), np.zeros(GRAMS, np.int64)
    for low in range(0, max(0, len(b) - 2), SLICE):
        x = b[low : low + SLICE + 2].astype(np.uint32)
        h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        found += np.bincount(h >> np.uint32(24), minlength=GRAMS)
    return np.sqrt(found / max(1, found.sum()))


def features(text: str | None) -> np.ndarray:
    """Measures of a whole text, each at most a few units large, then the shares of its byte triples."""
    text = text or ""
    return np.concatenate([measures(text), gram_shares(text.encode())]).astype("<f4")


def measures(text: str) -> np.ndarray:
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    distinct = set(words)
    lines = [x for x in text.split("\n") if x]
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    top = 0.0
    if words:
        _, repeats = np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_counts=True)
        top = repeats.max() / n
    share = lambda *c: float(sum(counts[ord(x)] for x in c)) / n
    return np.array([
        np.log1p(len(words)) / 5, lengths.mean() / 6 if words else 0, (lengths > 12).sum() / n, (lengths <= 3).sum() / n,
        len(distinct) / n, len(set(map(str.lower, distinct))) / n, sum(map(eq, words, words[1:])) / n, top,
        counts[65:91].sum() / letters, sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, counts[48:58].sum() / size,
        share("|"), share("!"), share("."), share(","), share(*"*#%&$@^~_=+<>\\"), share(*"()[]{}"),
        len(lines) / n * 5, len(set(lines)) / max(1, len(lines)), counts[128:].sum() / size, sum(1 for w in words if not w[-1].isalnum()) / n,
        counts[:9].sum() / size, np.log1p(len(text) / max(1, len(lines))) / 6,
    ], np.float64)


class Net:
    """One hidden layer on standardised features."""

    def __init__(self, x: np.ndarray, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.scale[len(FEATURES) :] /= s.gram_weight  # many and noisy: together they weigh like a few measures
        self.params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(1)]
        self.moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.params]
        self.steps, self.s = 0, s

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        a, b, c, d = self.params
        return np.tanh(x @ a + b) @ c + d[0]

    def grads(self, x: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        a, b, c, _ = self.params
        h = np.tanh(x @ a + b)
        back = dz[:, None] * c[None] * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ dz, np.array([dz.sum()])]

    def step(self, grads: list[np.ndarray]) -> None:
        self.steps += 1
        for p, (m, v), g in zip(self.params, self.moments, grads, strict=True):
            g = g + self.s.decay * p
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= self.s.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sums(net: Net, x: np.ndarray) -> np.ndarray:
    """Sums over rows of the logistic loss of calling them negative, its gradients one after another, and the rows."""
    z = net.logits(x)
    return np.concatenate([[np.logaddexp(0, z).sum()], *[g.ravel() for g in net.grads(x, sigmoid(z))], [len(x)]])


def risk_step(net: Net, p: np.ndarray, of_all: np.ndarray, prior: float) -> None:
    """One step down the non-negative risk of positives ``p`` and of the unlabelled rows that ``of_all`` sums up."""
    zp, n = net.logits(p), of_all[-1]
    cuts = np.cumsum([w.size for w in net.params])[:-1]
    of_u = [g.reshape(w.shape) / n for g, w in zip(np.split(of_all[1:-1], cuts), net.params, strict=True)]
    of_p = net.grads(p, sigmoid(zp) / len(p))
    away = [x - prior * y for x, y in zip(of_u, of_p, strict=True)]
    if of_all[0] / n - prior * np.logaddexp(0, zp).mean() < 0:
        net.step([-x for x in away])
    else:
        # d/dz of log(1 + e^-z) is sig(z) - 1; of log(1 + e^z), sig(z)
        toward = net.grads(p, (sigmoid(zp) - 1) / len(p))
        net.step([prior * x + y for x, y in zip(toward, away, strict=True)])


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, s: Settings, non_negative: bool = True) -> Net:
    """Minimise the non-negative unbiased risk with the logistic loss; without ``non_negative``, positives against unlabelled."""
    net, rng = Net(np.concatenate([positive, unlabelled]), s), np.random.default_rng(s.seed + 1)
    for _ in range(s.epochs):
        u_order = rng.permutation(len(unlabelled))
        for b in range(0, len(u_order), s.batch):
            u = unlabelled[u_order[b : b + s.batch]]
            p = positive[rng.integers(0, len(positive), min(len(positive), s.batch))]
            if non_negative:
                risk_step(net, p, sums(net, u), prior)
            else:
                toward, away = net.grads(p, (sigmoid(net.logits(p)) - 1) / len(p)), net.grads(u, sigmoid(net.logits(u)) / len(u))
                net.step([0.5 * x + 0.5 * y for x, y in zip(toward, away, strict=True)])
    return net


def separator(positive: np.ndarray, unlabelled: np.ndarray, s: Settings) -> tuple[Net, np.ndarray]:
    """A network fitted to half of the positives against half of the unlabelled, and cuts at quantiles of the other positives' scores."""
    net = fit_risk(positive[::2], unlabelled[::2], 0.5, s, non_negative=False)
    zp = net.logits(positive[1::2])
    return net, np.unique(np.quantile(zp, np.linspace(0, 0.99, s.bins))) if len(zp) else np.zeros(0)


def above(z: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many scores reach each cut."""
    return len(z) - np.searchsorted(np.sort(z), cuts, "left")


def class_prior(zp: np.ndarray, cuts: np.ndarray, reached: np.ndarray, total: int, delta: float = 0.1) -> float:
    """Share of positives among ``total`` unlabelled, of which ``reached`` reach each cut: the best bin's ratio."""
    if not len(zp) or not total:
        return 0.5
    above_p, above_u = above(zp, cuts) / len(zp), reached / total
    slack = np.sqrt(np.log(4 / delta) / 2 / total) + np.sqrt(np.log(4 / delta) / 2 / len(zp))
    best = np.argmin((above_u + slack) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.05, 0.99))


@dataclass
class Model:
    net: Net
    prior: float
    cut: float


def scores(model: Model | None, x: np.ndarray) -> np.ndarray:
    """Scores of features; the risk's own cut, a logit of 0, lies at ``cut``."""
    if model is None:
        return np.zeros(len(x))
    return sigmoid(model.net.logits(x) + np.log(model.cut / (1 - model.cut)))


def matrix(x: pa.Array) -> np.ndarray:
    """Stored features as rows of numbers."""
    return np.frombuffer(b"".join(x.to_pylist()), "<f4").reshape(len(x), WIDTH)


def featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, and ``__x``, the features of its whole text as 32-bit numbers in bytes."""
    clashing(keep, ["__x", "__text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(x, pa.binary())], [*keep, "__x"])

    schema = docs.select(*keep).withColumn("__x", F.lit(b"")).schema
    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def trusted(rows: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(h, __x): training rows of at most ``per_side`` positive ids, one row an id however often it occurs.

    The chosen ids are bounded, so they are broadcast against the rows.
    """
    known = labels.where((F.col("quality").cast("int") == 1) & (remainder("doc_id", 5) != 0)).select("doc_id").distinct()
    chosen = known.join(rows.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(s.per_side)
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("h", "doc_id").agg(F.min("__x").alias("__x")).select("h", "__x")


def added_up(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> dict[int, float]:
    """Sums over all rows of the numbers that ``of`` gives for features, by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                found = of(matrix(batch.column("__x").slice(low, ROWS)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "s"])

    return dict(map(tuple, rows.select("__x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()))


def refined(net: Net, positive: np.ndarray, rows: DataFrame, prior: float, s: Settings) -> Net:
    """The network after ``passes`` more steps, each on the risk over all ``rows`` as the unlabelled side."""
    size = sum(w.size for w in net.params) + 2
    for _ in range(s.passes):
        shared = rows.sparkSession.sparkContext.broadcast(net)
        found = added_up(rows, lambda x, shared=shared: sums(shared.value, x))
        risk_step(net, positive, np.array([found[i] for i in range(size)]), prior)
        shared.destroy()
    return net


def fit_features(rows: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """Train on stored rows (doc_id, __x) whose crc32 modulo 5 isn't 0; None without positives or texts."""
    rows = rows.where(remainder("doc_id", 5) != 0)

    def drawn(sample: DataFrame) -> np.ndarray:
        return matrix(sample.toArrow().sort_by([("h", "ascending"), ("__x", "ascending")]).column("__x").combine_chunks())

    positive = drawn(trusted(rows, labels, s))
    if not len(positive):
        return None
    # by a number of each row, so that a row that is often repeated has no more than its share
    each = rows.select(F.xxhash64("doc_id", "__x", F.monotonically_increasing_id()).alias("h"), "__x")
    unlabelled = drawn(each.orderBy("h", "__x").limit(s.per_side))
    net, cuts = separator(positive, unlabelled, s)
    shared = rows.sparkSession.sparkContext.broadcast((net, cuts))
    found = added_up(rows, lambda x: np.array([*above(shared.value[0].logits(x), shared.value[1]), len(x)], np.float64))
    shared.destroy()
    prior = class_prior(net.logits(positive[1::2]), cuts, np.array([found[i] for i in range(len(cuts))]), int(found[len(cuts)]))
    return Model(refined(fit_risk(positive, unlabelled, prior, s), positive, rows, prior, s), prior, s.cut)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """Train on documents whose crc32 modulo 5 isn't 0; None without positives or texts."""
    rows = stored(featured(docs.where(remainder("doc_id", 5) != 0), ["doc_id"]), "features")
    model = fit_features(rows, labels, s)
    discard(rows)
    return model


def scored(rows: DataFrame, model: Model | None, keep: list[str], column: str, of: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The columns ``keep``, ``score`` and ``predicted`` of rows whose features ``of`` reads from ``column``."""
    clashing(keep, ["score", "predicted", "__text", "__x"])
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select(*keep).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(scores(shared.value, of(batch.column(column))), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], found], [*keep, "score"])

    out = rows.select(*keep, column).mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= (model.cut if model else 0.3)).cast("int"))


def classify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, with ``score`` and ``predicted`` (1 at 0.3 and above)."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    return scored(rows, model, keep, "__text", lambda texts: np.array([features(t) for t in texts.to_pylist()]).reshape(len(texts), WIDTH))


def classify_features(rows: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """:func:`classify` of rows whose features are stored."""
    return scored(rows, model, keep, "__x", matrix)
