import hashlib
import random
import re

from brute import base_spans
from pyspark.sql import functions as F

from millrace.llm import pii, queries
from millrace.llm.common import table

RANDOM = random.Random(3)
BITS = ["@", ".", "-", " ", "+", "1", "23", "4111111111111111", "a", "b.c", "(", ")", "é", "_", "%", "\n", "255", "x@y.z", "1.2.3.4", "😀"]
ODD = [
    None, "", "a@b.c@d.e f@g.h_i@j.k", "1.2.3.4.5.6.7.8 1.2.3.4", "256.1.1.1 0000255.1.1.1 1.1.1.999999999999999", "4111 1111 1111 1111 4111-1111-1111-1111",
    "+1 (234) 555-1234 +12", "5 5 5 4111111111111111 5", "\x01a@b.c\x01 4111111111111111\x02", "9" * 5000, "a@b" + ".c" * 20000, "1 " * 20000, "x" * 30000 + "@y.z", "+1" + "2-" * 9000 + "3",
]
ODD += ["".join(RANDOM.choice(BITS) for _ in range(RANDOM.randint(1, 30))) for _ in range(1500)]


def test_base_spans_match_plain_regular_expressions(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "spans long, text string")
    for row in df.select("text", pii.base_spans(F.col("text")).alias("found")).collect():
        assert [tuple(x) for x in row["found"]] == base_spans(row["text"])


def seeded(spark):
    values = ["a@b.com", "10.0.0.1", "c@d.org", "+1 (234) 555-1234", "e@f.net", "g@h.io", "i@j.co"] * 3 + ["QX-99812-77120", "\"ZZ81923399\","]
    rows = [(i, f"word{i} other text user id: {x.replace('@', f'{i}@')} done{i} more") for i, x in enumerate(values)]
    rows += [(100 + i, f"order number {i}{i}{i}812399 shipped") for i in range(30)] + [(200, None), (200, None), (None, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("row", F.lit(2))


def test_contexts_of_seeds_discover_unseen_identifiers(spark):
    docs = seeded(spark)
    out = pii.find(docs, ["doc_id", "text"]).collect()
    assert len(out) == docs.count()
    added = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s not in r["base"]] for r in out if len(r["spans"]) > len(r["base"])}
    assert added == {21: ["QX-99812-77120"], 22: ["ZZ81923399"]}
    assert pii.find(docs.where("false"), ["doc_id"]).collect() == []


def test_copies_of_a_text_do_not_make_a_pattern(spark):
    rows = [(i, "the same words before mail me@x.org here") for i in range(50)] + [(99, "words before mail 12345678 there")]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).where("size(spans) > size(base)").collect()
    assert out == []


def test_redaction_takes_overlapping_spans_as_one(spark):
    df = spark.createDataFrame([("ab cd@e.f 1.2.3.4 z", [("email", 3, 9), ("ip", 10, 17), ("card", 5, 12)]), ("é", []), (None, [])], "text string, spans array<struct<kind:string,start:long,end:long>>")
    assert [r[0] for r in df.select(pii.redacted(F.col("text"), F.col("spans"))).collect()] == ["ab [EMAIL] z", "é", ""]


def test_query_digests(spark, data):
    out = {r["doc_id"]: r for r in queries.op7_pii(spark, data).collect()}
    for r in table(spark, data, "documents").collect():
        spans = base_spans(r["text"])
        assert out[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        for kind in pii.KINDS:
            assert out[r["doc_id"]][f"n_{kind}"] == sum(k == kind for k, _, _ in spans)
        own = [x for x in out[r["doc_id"]]["spans"].split(",") if x]
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(own) and len(set(own)) == len(own)
        assert own == sorted(own, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1]), int(x.split(":")[2])))


def context(text, start):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text[:start].lower()) if w]
    return [f"{n}:{' '.join(words[-n:])}" for n in (1, 2) if len(words) >= n]


def test_patterns_hold_whole_words_of_any_length(spark):
    long = ["w" * n for n in (5, 79, 80, 81, 200, 999, 1500, 30_000)]
    texts = [f"{a} {b}\t {x}" for a in long for b in long[:5] for x in ("12345", "a@b.cd")] + ["1234", " 1234", "x 1234 y@z.io 99999 é 5555"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.instances(df, ["doc_id"]).select("k0", F.explode("found").alias("f")).select("k0", "f.start", pii.patterns(F.col("f.before")).alias("p")).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        assert r["p"] == context(texts[r["k0"]], r["start"])


def test_very_many_finds_in_one_text(spark):
    text = "\n".join(f"entry {i} a{i}@b.org from 10.0.{i % 256}.{i // 256 % 256} code 77{i:06d}" for i in range(4000))
    out = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    assert [tuple(x) for x in out["base"]] == base_spans(text) and len(out["base"]) == 8000


def found_beside_base(spark, rows):
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]).where("size(spans) > size(base)").collect()
    return {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s not in r["base"]] for r in out}


def test_contexts_discover_spaced_and_short_identifiers(spark):
    seeds = [(i, f"please reach me at: a{i}@b.org today") for i in range(60)]
    unseen = ["030 123 4567", "(030) 123 4568", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "4111 1111 1111 1112", "4821", "48213"]
    rows = [(100 + i, f"please reach me at: {x}, or not") for i, x in enumerate(unseen)]
    rows += [(200, "please reach me at: 5550001 done7 now"), (201, "please reach me at: 123 then"), (202, "please reach me at: 10.0.0.1 5550 reach me at: 77 0012. 5 x")]
    wanted = {100 + i: [x.lstrip("(")] for i, x in enumerate(unseen)} | {200: ["5550001"], 202: ["77 0012"]}
    assert found_beside_base(spark, seeds + rows) == wanted


def test_discovered_instances_raise_patterns_of_later_rounds(spark):
    rows = [(i, f"the user id: a{i}@b.org here") for i in range(60)]
    rows += [(100 + i, f"the user id: QX-1000{i} here") for i in range(8)]
    rows += [(200 + i, f"wears badge no: QX-1000{i} here") for i in range(8)] + [(300, "wears badge no: ZZ-99887 here")]
    rows += [(400 + i, f"costs about some: {5000 + i} here") for i in range(9)]
    found = found_beside_base(spark, rows)
    assert found[300] == ["ZZ-99887"] and set(found) == {*range(100, 108), *range(200, 208), 300}
