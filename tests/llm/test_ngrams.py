import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ngrams, queries
from millrace.llm.common import table


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def test_query_matches_exact_counts_and_beats_the_base(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = collections.Counter(x for i, t in docs if i not in held for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = {r["doc_id"]: r for r in queries.op1_ngram_scores(spark, data).collect()}
    for i, t in docs:
        w, r = tokens(t), out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
    assert sum(out[i]["score"] for i in held) > sum(out[i]["base_score"] for i in held)


def level_counts(times, base=1.5):
    """What a filter without false answers gives back for counts."""
    return {x: math.ceil(base ** math.floor(math.log(n) / math.log(base) + 1e-9) - 1e-9) for x, n in times.items()}


def test_scores_are_those_of_a_dictionary(spark, data):
    """The model's smoothing over exact dictionaries of quantised counts, but for the filter's false answers."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    words, pairs, triples = collections.Counter(), collections.Counter(), collections.Counter()

    def grams(text):
        w = [b"\n", b"\n", *tokens(text)]
        return list(zip(w[2:], w[1:], w))

    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w, v, u in grams(t):
                words[w] += 1
                pairs[v, w] += 1
                triples[u, v, w] += 1
    n, v = sum(words.values()), len(words)
    pairs, triples = level_counts(pairs), level_counts({x: n for x, n in triples.items() if n > 1})
    out = {r["doc_id"]: r["score"] for r in queries.op1_ngram_scores(spark, data).collect()}
    close = 0
    for i, t in docs:
        want = 0.0
        for at, (w, before, first) in enumerate(grams(t)):
            p = (words[w] + 1) / (n + v + 1)
            for count, history in ((pairs.get((before, w), 0), words[before]), (triples.get((first, before, w), 0), words[before] if at == 0 else pairs.get((first, before), 0))):
                if history:
                    p = 0.6 * p + 0.4 * min(max(count - 0.75, 0) / history, 1)
            want += math.log10(p)
        assert abs(out[i] - want) < 0.05 * abs(want) + 5
        close += abs(out[i] - want) < 0.03 * abs(want)
    assert close > 0.9 * len(docs)


def test_a_text_seen_twice_scores_above_one_seen_once(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 80) % 5000) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["score"] / r["n_tokens"] for r in ngrams.score(df, "doc_id", df).collect()}
    twice, once = [out[i] for i in range(100)], [out[i] for i in range(100, 300)]
    assert np.mean([x > np.quantile(once, 0.9) for x in twice]) > 0.8


def test_any_number_of_rounds_gives_the_same_scores(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text")
    one = ngrams.score(docs, "doc_id", docs).toPandas().sort_values("doc_id")
    many = ngrams.score(docs, "doc_id", docs, ngrams.Settings(round_bytes=1 << 17)).toPandas().sort_values("doc_id")
    assert np.allclose(one.score, many.score) and np.allclose(one.base_score, many.base_score) and (one.n_known == many.n_known).all()


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "A a\x0ba\u00a0b"), (3, "w " * 50_000), (4, "y" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id as score", "text", "1 as n_tokens")
    out = ngrams.score(docs, "score", docs).collect()
    assert sorted(r[1] for r in out) == [1, 1, 1, 2, 4, 50_001]
    none = ngrams.score(docs, "score", docs.where("false")).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in none)
    assert ngrams.score(docs.where("false"), "score", docs).collect() == []


def test_filter_levels_hold_every_count():
    s = ngrams.Settings()
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) & ngrams.UPPER)
    assert (ngrams.unpacked(ngrams.packed(h, 6), 6) == h).all()
    n = rng.geometric(0.2, len(h))
    bits = np.frombuffer(ngrams.segment_bits(h, n, s), np.uint8)
    share = ngrams.Share(np.zeros(0, np.uint64), np.zeros(0, np.int64), bits, np.array([0, -1]), np.array([len(bits) * 8, 0]))
    read, true = ngrams.levels_in(share, ngrams.PAIRS, h, s), ngrams.levels_of(n, s.base)
    assert (read >= true).all() and (read == true).mean() > 0.95
    strange = ngrams.levels_in(share, ngrams.PAIRS, rng.integers(0, 1 << 63, 20_000).astype(np.uint64), s)
    assert (strange > 0).mean() < 0.05


def test_probabilities_of_a_context_sum_to_one_at_most():
    s = ngrams.Settings()
    words, pairs, triples = np.array([6, 3, 1]), np.array([2, 3, 1]), np.array([1, 2, 0])
    p = 10 ** ngrams.log_probabilities(words, np.full(3, 6), pairs, np.full(3, 3), triples, 10, 3, s)
    assert 0 < p.sum() <= 1
    alone = 10 ** ngrams.log_probabilities(words, np.zeros(3), pairs, np.zeros(3), triples, 10, 3, s)
    assert np.allclose(alone, (words + 1) / 14)


def test_a_condition_learns_as_a_table_does_and_the_driver_gets_no_model(spark, data, monkeypatch):
    docs = table(spark, data, "documents").select("doc_id", "text")
    apart = ngrams.score(docs, "doc_id", docs.where("doc_id % 3 = 0")).toPandas().sort_values("doc_id")

    def refused(*_):
        raise AssertionError("the model goes through the driver")

    for kind, name in ((type(docs), "toArrow"), (type(spark.sparkContext), "broadcast")):
        monkeypatch.setattr(kind, name, refused)
    once = ngrams.score(docs, "doc_id", F.col("doc_id") % 3 == 0)
    monkeypatch.undo()
    once = once.toPandas().sort_values("doc_id")
    assert np.allclose(apart.base_score, once.base_score) and (apart.n_known == once.n_known).all() and (apart.train_tokens == once.train_tokens).all()
    assert np.allclose(apart.score, once.score, rtol=0.02)


def test_blocks_give_back_their_hashes():
    rng = np.random.default_rng(1)
    for n, most in ((1, 63), (2, 63), (5, 40), (50_000, 63)):
        h = np.unique(rng.integers(0, 1 << most, n).astype(np.uint64))
        assert (ngrams.of_block(ngrams.block(ngrams.WORDS, h)) == h).all()
        h = np.unique(h & ngrams.UPPER)
        assert (ngrams.of_block(ngrams.block(ngrams.PAIRS, h)) == h).all()
