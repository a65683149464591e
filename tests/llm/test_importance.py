import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from millrace.llm import importance, queries
from millrace.llm.common import table
from millrace.llm.importance import Settings

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(docs, aims, s=Settings()):
    def runs(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % s.buckets for n in range(1, s.longest + 1) for i in range(len(words) - n + 1)]

    own, target = Counter(), Counter()
    held = [(k, *runs(t)) for k, t in docs]
    for _, _, f in held:
        own.update(f)
    for t in aims:
        target.update(runs(t)[1])
    S, T = sum(own.values()), sum(target.values())
    gain = {b: math.floor(s.unit * math.log((target[b] + 1) * (S + s.buckets) / ((own[b] + 1) * (T + s.buckets)))) for b in own}
    rows = []
    for k, n, f in held:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, n, len(f), weight, weight + math.floor(-s.unit * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= s.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    most = s.percent * len(able) // 100
    drawn = [(*r[:1], *r[2:], i + 1 if i < most else None) for i, r in enumerate(able)]
    return sorted(drawn + [(*r[:1], *r[2:], None) for r in rows if r[1] < s.least_words], key=str)


DOCS = [(i, " ".join(f"W{(i * k) % 17}é" for k in range(1, 2 + i % 40))) for i in range(90)]
DOCS += [(100, None), (101, ""), (102, "., \n-"), (7, DOCS[7][1]), (7, "other " * 30), (None, "no id " * 12), (None, "no id " * 12), (103, "x " * 60_000), (104, "日本語 ＡＢ ÀÉ a_b 1-2")]
AIMS = ["w3é w4é W5É", None, "", "no x"]


@pytest.mark.parametrize("s", [Settings(), Settings(longest=3, percent=50, buckets=97, least_words=5, block=50), Settings(percent=100, least_words=0)])
def test_draw_matches_brute_force(spark, s):
    docs = spark.createDataFrame([(k, t, 3) for k, t in DOCS], "rank long, text string, weight int").repartition(4)
    aims = spark.createDataFrame([(t,) for t in AIMS], "text string")
    assert sorted(map(tuple, importance.resample(docs, "rank", "text", aims, "text", s).collect()), key=str) == plain(DOCS, AIMS, s)


def test_empty_tables(spark):
    docs, aims = spark.createDataFrame(DOCS, "k long, t string"), spark.createDataFrame([], "t string")
    assert importance.resample(docs.where("false"), "k", "t", aims, "t").collect() == []
    assert sorted(map(tuple, importance.resample(docs, "k", "t", aims, "t").collect()), key=str) == plain(DOCS, [])


def test_ranks_count_across_parts_and_ties_are_split(spark):
    rows = spark.range(0, 20_000, 1, 7).selectExpr("id % 3 AS k", "cast(5 AS long) AS score")
    out = importance.numbered(rows, [rows["score"].desc(), rows["k"].asc()]).toPandas().sort_values("rank")
    assert out["rank"].tolist() == list(range(1, 20_001)) and out["k"].is_monotonic_increasing
    with pytest.raises(ValueError):
        Settings(buckets=70_000)


def test_query_matches_brute_force(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    aims = [r["text"] for r in table(spark, data, "benchmark").collect()]
    assert sorted(map(tuple, queries.op13_importance(spark, data).collect()), key=str) == plain(docs, aims)
