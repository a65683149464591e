"""Nearest vectors, keywords, and both scores fused."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words and characters that are no keywords, and characters that part phrases.
STOP_WORDS = set("the a an is are was were in on at to for of and or not from by with as".split())
STOP_CHARACTERS = set("的了在是我就不人都一个上也到说要去你会看着好自己和这那他她它们")
PART_CHARACTERS = set("查询找请帮告诉下一上左右中")
#: Weights of the two scores, candidates in all, and characters of a text that count.
VECTOR_WEIGHT, KEYWORD_WEIGHT, CANDIDATES, TEXT_LENGTH = 0.7, 0.3, 500, 5_000


#: What counts as Latin words, numbers and runs of Chinese characters, and the lengths of keywords cut from these.
WORD, RUN, GRAM_LENGTHS = re.compile(r"[a-zA-Z]{2,}|[0-9]+"), re.compile(r"[一-鿿]+"), (2, 3)


def keywords(query: str) -> list[str]:
    """Latin words of two letters or more but stop words, numbers, and short pieces of Chinese phrases, by place.

    Stop characters end a phrase. A phrase of a piece's length is one keyword; of longer ones all pieces are.
    """
    held = [(m.start(), m[0].lower()) for m in WORD.finditer(query) if m[0].isdigit() and len(m[0]) > 1 or m[0].lower() not in STOP_WORDS and not m[0].isdigit()]
    breaks = str.maketrans(dict.fromkeys(STOP_CHARACTERS | PART_CHARACTERS, " "))
    for phrase in RUN.finditer(query.translate(breaks)):
        text = phrase[0]
        sizes = [len(text)] if len(text) in GRAM_LENGTHS else [n for n in GRAM_LENGTHS if n < len(text)]
        held += [(phrase.start(), text[i : i + n]) for n in sizes for i in range(len(text) - n + 1)]
    return [word for _, word in sorted(held, key=lambda x: x[0])]


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared distance, cosine distance, or negated inner product, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if metric == "ip":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """The ``k`` rows nearest to one query vector with ``distance``; each task keeps its own k, ties to the smaller key."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.size(vector) == len(query)).withColumn("distance", distance(F.col(vector), asked, metric))
    return rows.orderBy("distance", key).limit(k)


def upserted(vectors: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return vectors.join(new.select(key), key, "left_anti").unionByName(new)


def collections(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("collection").agg(F.count("*").alias("n")).orderBy("collection")


def without(vectors: DataFrame, collection: str) -> DataFrame:
    """All vectors but a collection's."""
    return vectors.where(~F.col("collection").eqNullSafe(F.lit(collection)))


def hybrid(pieces: DataFrame, query: list[float], words: str, k: int = 5, metric: str = "l2") -> DataFrame:
    """Pieces (collection, source, page, text, embedding) by vector and keyword score.

    Each collection gives its nearest candidates, all together at most 500 by collection and distance; of each source
    and page the nearest stays; the best ``2k`` by fused score are returned.
    """
    asked, found = F.array(*[F.lit(float(x)) for x in query]), keywords(words)
    rows = pieces.withColumn("distance", distance(F.col("embedding"), asked, metric)).drop("embedding")
    near = Window.partitionBy("collection").orderBy("distance", "source", "page")
    # no collection gives more than all may; how many each may give depends on how many there are
    rows = rows.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= max(3 * k, CANDIDATES))
    number = rows.where("rank = 1").agg(F.greatest(F.lit(1), F.count("*")).alias("n"))
    rows = rows.where(F.col("rank") <= F.greatest(F.lit(3 * k), F.floor(F.lit(CANDIDATES) / number.scalar())))
    rows = rows.orderBy("collection", "rank").limit(CANDIDATES).drop("rank")
    rows = rows.withColumn("text", F.substring("text", 1, TEXT_LENGTH)).withColumn("vector_score", F.greatest(F.lit(0.0), 1 - F.col("distance")))
    if found:
        hits = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in found), F.lit(0))
        rows = rows.withColumn("keyword_score", hits / len(found)).withColumn("score", VECTOR_WEIGHT * F.col("vector_score") + KEYWORD_WEIGHT * F.col("keyword_score"))
    else:
        rows = rows.withColumn("keyword_score", F.lit(0.0)).withColumn("score", F.col("vector_score"))
    best = Window.partitionBy("source", "page").orderBy("distance", "collection")
    rows = rows.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
    return rows.orderBy(F.desc("score"), "source", "page").limit(2 * k)
