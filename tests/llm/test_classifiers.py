import dataclasses
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import quality, queries, toxicity
from millrace.llm.common import table

ODD = [None, "", "   ", "x" * 100_000, "bad " * 30_000, "é😀", "|||"]


def corpus(n, seed):
    """Documents of random words; toxic ones hold an inflected stem, poor ones are shouted."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            text.insert(rnd.randrange(len(text)), "vlorx" + rnd.choice(["", "ing", "ed", "ish"]))
        text = " ".join(text)
        poor = i % 7 == 0
        rows.append((i, text.upper().replace(" ", "!! ") if poor else text, int(toxic), int(not poor)))
    return rows


def frames(spark, n=700, seed=1):
    rows = corpus(n, seed)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _, _ in rows], "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, q, t) for i, _, t, q in rows] + [(None, 1, 1), (5, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_toxicity_on_held_out_rows(spark):
    docs, labels, rows = frames(spark)
    model = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.classify(docs, model, ["doc_id"]).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()}
    held = [(out[i]["predicted"], t) for i, _, t, _ in rows if out[i]["held"]]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())


def test_toxicity_takes_odd_rows_and_no_labels(spark):
    docs, labels, _ = frames(spark, 200)
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (1, ""), (1, "")], "doc_id long, text string")
    out = toxicity.classify(odd, model, ["doc_id"]).collect()
    assert len(out) == len(ODD) + 3 and len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert toxicity.fit(docs, labels.where("false")) is None and toxicity.fit(docs, labels.where("toxic = 1")) is None
    assert {r["score"] for r in toxicity.classify(odd, None, ["doc_id"]).collect()} == {0.0}
    assert toxicity.classify(odd.where("false"), model, ["doc_id"]).collect() == []


def test_scores_do_not_depend_on_the_batch():
    rows = corpus(60, 3)
    model = toxicity.train([toxicity.buckets(t) for _, t, _, _ in rows], np.array([t for _, _, t, _ in rows]), toxicity.Settings(min_docs=2))
    texts = [t for _, t, _, _ in rows] + ["", None]
    alone = [toxicity.scores(model, [t])[0] for t in texts]
    assert np.allclose(toxicity.scores(model, texts), alone) and np.allclose(toxicity.scores(model, texts, chunk=50), alone)


def test_pooling_sees_whole_texts():
    rows = corpus(400, 3)
    model = toxicity.train([toxicity.buckets(t) for _, t, _, _ in rows], np.array([t for _, _, t, _ in rows]))
    plain = next(t for _, t, toxic, poor in rows if not toxic and poor)
    long = " ".join([plain] * 2000)
    assert toxicity.scores(model, [long])[0] < 0.7 <= toxicity.scores(model, [long + " vlorxing"])[0]


def test_threshold_has_the_fewest_errors():
    z, y = np.array([0.0, 1, 2, 5, 6]), np.array([0, 0, 1, 1, 1])
    assert toxicity.threshold(z, y) == 1.5
    assert toxicity.threshold(z, np.ones(5, int)) == 0.0 and toxicity.threshold(z[:0], y[:0]) == 0.0


def test_language_is_guessed_from_function_words():
    assert toxicity.language(toxicity.buckets("Le chat et les souris dans une maison")) == "fr"
    assert toxicity.language(toxicity.buckets("Das Haus und der Baum ist nicht hier")) == "de"
    assert toxicity.language(toxicity.buckets("")) == "other"


def test_quality_on_held_out_rows(spark):
    docs, labels, rows = frames(spark)
    model = quality.fit(docs, labels)
    assert 0.6 < model.prior < 0.99
    out = {r["doc_id"]: r for r in quality.classify(docs, model, ["doc_id"]).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()}
    assert np.mean([out[i]["predicted"] == q for i, _, _, q in rows if out[i]["held"]]) > 0.95


def test_quality_takes_odd_rows_and_no_labels(spark):
    docs, labels, _ = frames(spark, 200)
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "x")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality.classify(odd, model, ["doc_id"]).collect())
    assert quality.fit(docs, labels.where("quality = 0")) is None and quality.fit(docs.where("false"), labels) is None
    assert {r["score"] for r in quality.classify(odd, None, ["doc_id"]).collect()} == {0.0}
    assert quality.classify(odd.where("false"), model, ["doc_id"]).collect() == []


def test_risk_learns_without_negative_labels():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, (600, 3))
    mixed = np.concatenate([rng.normal(2, 1, (700, 3)), rng.normal(-2, 1, (300, 3))])
    s = quality.Settings()
    net, cuts = quality.separator(positive, mixed, s)
    assert abs(quality.class_prior(net.logits(positive[1::2]), cuts, quality.above(net.logits(mixed), cuts), len(mixed)) - 0.7) < 0.12
    net = quality.fit_risk(positive, mixed, 0.7, s)
    assert (net.logits(mixed[:700]) > 0).mean() > 0.93 and (net.logits(mixed[700:]) < 0).mean() > 0.93


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_unlabelled_documents_are_the_other_side(spark):
    """Nearly all labels are on good documents, while half of all documents are poor: the prior is that of all."""
    rows = [(i, t if i % 2 else t.upper().replace(" ", "!! ")) for i, (_, t, _, q) in enumerate(x for x in corpus(1400, 4) if x[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2) for i, _ in rows if (i % 4 == 1) or i % 60 == 0]
    assert np.mean([q for _, q in labels]) > 0.9
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert 0.35 < model.prior < 0.65
    out = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, model, ["doc_id"]).collect()}
    assert np.mean([out[i] == i % 2 for i, _ in rows if held(i)]) > 0.95


def test_byte_triples_decide_where_measures_are_alike(spark):
    """Good and poor documents differ in their words alone, which are the same letters in another order."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(4, 9))) for _ in range(60)]
    rows = [(i, " ".join(w if i % 2 else w[::-1] for w in rnd.choices(words, k=rnd.randint(40, 90)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    right = {}
    for weight in (quality.Settings().gram_weight, 1e-9):
        model = quality.fit(docs, labels, dataclasses.replace(quality.Settings(), gram_weight=weight))
        out = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, model, ["doc_id"]).collect()}
        right[weight] = np.mean([out[i] == i % 2 for i, _ in rows if held(i)])
    print(right)
    assert right[quality.Settings().gram_weight] > 0.95 and right[1e-9] < 0.65


def test_passes_add_up_all_rows_and_one_row_an_id_is_trusted(spark):
    docs, labels, rows = frames(spark, 300)
    many = docs.union(docs.where("doc_id = 1").crossJoin(spark.range(500).drop("id")))
    table_of = quality.featured(many, ["doc_id"])
    x = np.stack([quality.features(t) for _, t, _, _ in rows])
    net = quality.Net(x, quality.Settings())
    found = quality.added_up(quality.featured(docs, ["doc_id"]), lambda x: quality.sums(net, x))
    assert np.allclose([found[i] for i in range(len(found))], quality.sums(net, x))
    assert quality.trusted(table_of, labels, quality.Settings()).groupBy("h").count().where("count > 1").count() == 0
    assert quality.trusted(table_of, labels, dataclasses.replace(quality.Settings(), per_side=7)).count() == 7


def forward(model, text):
    """The network's logit and the document's threshold in plain Python."""
    words = (text or "").lower().encode().translate(toxicity.PLAIN).split()
    row = {int(b): i + 1 for i, b in enumerate(model.buckets)}
    width = model.embedding.shape[1]
    vectors = []
    for w in words:
        letters = w.decode("utf-8", "replace")
        names = [w] + [b"%d:" % n + letters[:n].encode() for n in (4, 6) if len(letters) >= n]
        found = [row.get(xxhash.xxh3_64_intdigest(x) % toxicity.BUCKETS, 0) for x in names]
        vectors.append([sum(float(model.embedding[i][k]) for i in found) for k in range(width)])
    pad = [[0.0] * width] * max(len(f) for f in model.filters)
    places, z, at = pad + vectors + pad, float(model.out_bias), 0
    for filters, bias in zip(model.filters, model.bias):
        for f in range(filters.shape[2]):
            best = max(
                sum(places[p + o][k] * float(filters[o][k][f]) for o in range(len(filters)) for k in range(width))
                for p in range(len(pad) + len(vectors))
            ) + float(bias[f])
            z += max(best, 0.0) * float(model.out[at])
            at += 1
    hits = {name: sum(w.decode("utf-8", "replace") in said.split() for w in words) for name, said in toxicity.FUNCTION_WORDS.items()}
    name = max(hits, key=hits.get) if any(hits.values()) else "other"
    return z - model.thresholds[name]


def test_scores_are_those_of_a_plain_forward_pass():
    rows = corpus(200, 3)
    model = toxicity.train([toxicity.buckets(t) for _, t, _, _ in rows], np.array([t for _, _, t, _ in rows]), toxicity.Settings(width=3, filters=2, min_docs=2))
    texts = [t for _, t, _, _ in rows[:25]] + ["", None, "vlorxing", "x " * 30]
    want = [1 / (1 + math.exp(-(forward(model, t) + math.log(0.7 / 0.3)))) for t in texts]
    assert np.allclose(toxicity.scores(model, texts), want, atol=1e-4)
    assert np.allclose(toxicity.scores(model, texts, chunk=7), want, atol=1e-4)  # all in slices


def test_wider_filters_find_phrases_of_harmless_words():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    phrases = [(words[2 * i], words[2 * i + 1]) for i in range(3)]

    def made(n):
        docs, labels = [], []
        for i in range(n):
            text, (a, b) = [rnd.choice(words[6:]) for _ in range(rnd.randint(20, 60))], rnd.choice(phrases)
            if i % 2:
                at = rnd.randrange(len(text))
                text[at:at] = [a, b]
            else:  # both words, the second far before the first
                text.insert(rnd.randrange(1, len(text)), a)
                text.insert(0, b)
            docs.append(toxicity.buckets(" ".join(text)))
            labels.append(i % 2)
        return docs, np.array(labels)

    (docs, y), (new, want) = made(2000), made(500)
    right = {}
    for spans in ((1, 2, 3), (1,)):
        model = toxicity.train(docs, y, dataclasses.replace(toxicity.Settings(), spans=spans))
        right[spans] = ((toxicity.logits(model, new) >= model.thresholds["other"]) == want).mean()
    assert right[1, 2, 3] > 0.95 and right[(1,)] < 0.6


@pytest.mark.parametrize("name, held, label, least", [("op2_toxicity", "crc32(cast(doc_id as string)) % 3 = 1", "toxic", 0.95), ("op8_quality", "crc32(cast(doc_id as string)) % 5 = 0", "quality", 0.98)])
def test_held_out_labels_of_the_test_documents(spark, name, held, label, least):
    path = "/root/testdata/sf0.1"
    out = queries.QUERIES[name](spark, path).where("held_out").join(table(spark, path, "labels"), "doc_id")
    right = out.where(held).selectExpr(f"avg(cast(predicted = {label} as int))", "count(*)").first()
    assert right[1] > 700 and right[0] > least


def test_columns_to_keep_may_not_clash(spark):
    docs, _, _ = frames(spark, 20)
    for operator in (toxicity, quality):
        with pytest.raises(ValueError, match="score"):
            operator.classify(docs, None, ["doc_id", "score"])


def test_queries_score_every_document(spark, data):
    n = table(spark, data, "documents").count()
    for name in ("op2_toxicity", "op8_quality"):
        out = queries.QUERIES[name](spark, data)
        assert out.count() == n and dict(out.dtypes)["held_out"] == "boolean" and dict(out.dtypes)["predicted"] == "int"


def test_a_text_beyond_the_bytes_is_passed_over(spark):
    rows = [(h, y, 100) for h in range(5) for y in (0, 1)]
    assert toxicity.within(rows, 300) == [(h, y) for h in range(3) for y in (0, 1)]
    assert toxicity.within([(-9, 1, 10_000), *rows], 300) == [(h, y) for h in range(3) for y in (0, 1)]
    assert toxicity.within([], 300) == []


def test_a_long_or_often_repeated_first_text_leaves_a_model(spark):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1][:300]
    first = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    toxic = {i: int(k % 3 == 0) for k, i in enumerate(ids)}
    longest = min((i for i in ids if toxic[i]), key=first.get)
    docs = [(i, ("vile " * 9 if toxic[i] else "kind ") + "word " * 5) for i in ids if i != longest] + [(longest, "vile " * 40_000), (longest, "vile again " * 20_000)]
    s = toxicity.Settings(sample_bytes=400_000)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels, s)
    assert model is not None


def test_documents_beyond_the_sample_are_learned_from(spark):
    """Toxic documents of the sample have another word than all later ones, which a fit to the sample can't know."""
    plain = [(i, t) for i, t, toxic, _ in corpus(3000, 8) if not toxic]
    ids = {r["doc_id"]: r["h"] for r in spark.createDataFrame(plain, "doc_id long, text string").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    trained = sorted((i for i in ids if zlib.crc32(str(i).encode()) % 3 != 1 and i % 4 == 0), key=ids.get)
    early = set(trained[:100])
    docs = [(i, t if i % 4 else f"{t} {'vlorx' if i in early else 'grumb'} so") for i, t in plain]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r["predicted"] for r in toxicity.classify(frame, toxicity.fit(frame, labels, toxicity.Settings(per_class=60)), ["doc_id"]).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    caught, left = (np.mean([out[i] == y for i in held if (i % 4 == 0) == y]) for y in (True, False))
    print(caught, left)
    assert caught > 0.95 and left > 0.95


def test_buckets_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(i, f"all w{i // 3} w{i // 4}x") for i in range(24)], "doc_id long, text string")
    rows = toxicity.training(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")).repartition(5)
    held = [toxicity.of_bytes(r["words"]) for r in rows.collect()]
    assert len(held) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(24))
    names, n = np.unique(np.concatenate([np.unique(x[x >= 0]) for x in held]), return_counts=True)
    for least in (1, 3, 4):
        assert (toxicity.counted(rows, toxicity.Settings(min_docs=least)) == names[n >= least]).all()


def test_long_documents_are_learned_from_in_slices():
    rows = corpus(40, 3)
    model = toxicity.train([toxicity.buckets(t) for _, t, _, _ in rows], np.array([t for _, _, t, _ in rows]), toxicity.Settings(min_docs=2))
    docs = [toxicity.rows_of(model, toxicity.buckets(t)) for t in [*[t for _, t, _, _ in rows], ""]]
    z, windows = toxicity.winners(model, docs)
    for chunk in (7, 90):
        again, same = toxicity.winners(model, docs, chunk)
        assert np.allclose(again, z, atol=1e-5) and np.mean([(a == b).mean() for a, b in zip(windows, same)]) > 0.99


def test_labels_meet_texts_by_shuffle_at_any_size_and_few_other_texts_move(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(-2000, 3000)] + [(None, "x"), (7, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(-200, 9000, 10)] + [(None, 1)], "doc_id long, toxic int")
    plan = toxicity.training(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [doc_id" in plan and "BroadcastHashJoin [doc_id" not in plan
    for kind in ("long", "int"):
        found = [r["doc_id"] for r in toxicity.marked(docs, labels.select(F.col("doc_id").cast(kind), "toxic")).collect() if r["doc_id"] is not None]
        assert set(range(-200, 3000, 10)) <= set(found) and len(found) <= 325
    assert sorted(toxicity.marked(docs, labels.select(F.col("doc_id").cast("string"))).collect(), key=str) == sorted(docs.collect(), key=str)
    want = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(-200, 3000, 10))
    assert toxicity.training(docs, labels).count() == want


def test_a_round_takes_all_rows_in_a_bounded_number_of_tasks_whose_changes_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PORTION", 20)
    docs, labels, rows = frames(spark, 900)
    seen, whole = [], toxicity.averaged

    def averaged(fit, rows, number):
        seen.append((rows.rdd.getNumPartitions(), rows.count()))
        return whole(fit, rows, number)

    monkeypatch.setattr(toxicity, "averaged", averaged)
    out = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, toxicity.fit(docs.repartition(8), labels, toxicity.Settings(per_class=50, tasks=2)), ["doc_id"]).collect()}
    assert len(seen) == 2 and all(parts <= 2 and n > 400 for parts, n in seen)
    assert np.mean([out[i] == t for i, _, t, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.95


def test_changes_of_tasks_are_averaged_by_their_documents(spark):
    rows = toxicity.training(*frames(spark, 400)[:2]).collect()
    whole, part = (spark.createDataFrame(spark.sparkContext.parallelize(x, 1), "h long, y int, words binary") for x in (rows, rows[:100]))
    assert whole.union(part).rdd.getNumPartitions() == 2
    s = toxicity.Settings(least_steps=1, min_docs=2)
    start = toxicity.carried(None, toxicity.counted(whole, s), {0: 1.0, 1: 1.0}, s)
    both = toxicity.averaged(start, whole.union(part), 0)
    alone = [toxicity.averaged(start, x, 0) for x in (whole, part)]
    n, before = (len(rows), 100), toxicity.flat(start.model)
    moved = [toxicity.flat(x.model) - before for x in alone]
    took = [k * (m != 0).any(1, keepdims=True) for k, m in zip(n, moved, strict=True)]
    want = before + sum(m * k for m, k in zip(moved, n, strict=True)) / np.maximum(1, sum(took))
    assert np.allclose(toxicity.flat(both.model), want, atol=1e-5)
