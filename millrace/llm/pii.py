"""Personal data: four fixed shapes, and identifiers that contexts learned from them give away.

Base spans come from four regular expressions. Bootstrapping then works on one table of instances: every base span
and everything else in a text that could be an identifier, each with the lexical patterns around it: the word before
it, and its two words before. What could be an identifier is a token with four digits or an at sign, or a run of
tokens, one space apart, that all hold digits and no small letters (as in spaced numbers; four capitals may follow
the first group of an IBAN), with four digits together. Base entities are the seeds. In each round the patterns take
part that at least ``least_seeds`` known instances support: seeds, and what accepted patterns have named in earlier
rounds. Such a pattern scores the mean confidence of its distinct instances, shrunk towards zero for patterns with
few of them, and an instance takes 1 - prod(1 - score) over the patterns that hold it; seeds stay at 1. Patterns at
or above ``accept`` name the unseen instances in their places, with the kind of most of their known ones.

The main path has DataFrame functions only. Scoring joins and groups on patterns after counting distinct
(pattern, instance) pairs, so a pattern that a third of all rows share meets as counts.

Defined results: null and empty texts have no spans. Positions count code points, ends are exclusive. Tokens that
overlap a base span are not added. Copies of a text count once in the scores, as instances are distinct by value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
# The shapes below match just what these do, but in one pass: a match starts where a run of its characters starts,
# or where the last match ended, and repeats give nothing back.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+ of 16 to 19 digits               phone \+[0-9][\x20().0-9-]+[0-9]
SHAPES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a shape to be looked for.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Marks around matches, what hides base spans, and what stands for either in texts that hold them: no shape has any.
MARK, MASK, OTHER = "\x01", "\x03", "\x02"
#: Pieces of a text that are scanned together, and characters that are hidden together.
BLOCK, STRETCH = 256, 4_096
#: Bytes of found spans up to which they are broadcast.
BROADCAST = 8 << 20
SPAN = "struct<kind:string,start:long,end:long>"


@dataclass(frozen=True)
class Settings:
    """Rounds of scoring; the score that accepts a pattern; the count that shrinks rare patterns; least known instances of a pattern."""

    rounds: int = 3
    accept: float = 0.75
    shrink: float = 1.0
    least_seeds: int = 5


def _cut(text: Column, shape: str) -> Column:
    """Pieces of a text, by turns outside and inside of the matches."""
    return F.split(F.regexp_replace(text, f"({shape})", f"{MARK}$1{MARK}"), MARK)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        # parts of more digits than an int holds are over 255 as well; leading zeros don't count
        return F.forall(F.split(found, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(found, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use(value)``, which takes the value as often as it likes though it is computed once."""
    return F.transform(F.array(value), use)[0]


def _scanned(pieces: Column, begin, step) -> Column:
    """All that ``step`` finds in the pieces of a text, from ``begin(position)`` on.

    An aggregate copies what it has found with each find, so pieces are taken in blocks whose finds are joined last:
    texts with very many finds then cost little more than others.
    """
    length = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, p: n + F.length(p["text"]))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda b: F.slice(pieces, b * BLOCK + 1, BLOCK))

    def found(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda at, b: F.concat(at, F.array(F.element_at(at, -1) + length(b))))
        offsets = F.when(F.size(blocks) > 1, offsets).otherwise(F.array(F.lit(0).cast("long")))
        return _let(offsets, lambda at: F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, begin(F.get(at, i)), step)["found"])))

    return _let(blocks, found)


def _spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind as an array of (kind, start, end)."""
    begin = lambda at: F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece["text"])
        one = F.array(F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end")))
        kept = F.when((piece["i"] % 2 == 1) & _valid(kind, piece["text"]), F.concat(acc["found"], one)).otherwise(acc["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    pieces = F.transform(_cut(text, SHAPES[kind]), lambda x, i: F.struct(x.alias("text"), i.alias("i")))
    return F.when(text.rlike(NEEDS[kind]), _let(pieces, lambda x: _scanned(x, begin, step))).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then by start."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK + MASK, OTHER * 2)
    return F.concat(*[_spans(plain, kind) for kind in KINDS])


#: A group of a spaced number, and what follows it if the next token is another; hidden characters count as letters.
_DIGIT, _CHARS = r"(?=[A-Z+()./-]*+[0-9])", r"[A-Z0-9+()./-]++"
_GROUP = _DIGIT + _CHARS + r"(?<=[A-Z0-9)])(?:(?<=(?<![A-Za-z0-9\x03])[A-Z]{2}[0-9]{2})\x20[A-Z]{4}(?=\x20))?+"
_NEXT = r"\x20(?=" + _DIGIT + _CHARS + r"[^A-Za-z0-9@\x03\x20\x09-\x0D]*+(?:[\x20\x09-\x0D]|$))"
#: What may hold an identifier: a token with a digit or an at sign, or a run of tokens that are groups.
CANDIDATE = r"(?:^|(?<=[\x20\x09-\x0D]))(?=[^\x20\x09-\x0D]*[@0-9])[^A-Za-z0-9@+\x03\x20\x09-\x0D]*+(?:" + _GROUP + _NEXT + r")*+[^\x20\x09-\x0D]+"
#: An identifier has an at sign inside, or at least so many digits.
DIGITS = 4
#: Characters looked at for the two words before an instance: the next number, and at last all, where these hold no two whole words.
WINDOWS = (80, 1_000, 20_000)
TWO_WORDS = r"[\x20\x09-\x0D][^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$"


def _before(get, length: Column, everything: Column) -> Column:
    """The shortest end ``get(n)`` of a text of this length that holds its last two words whole, or all of it."""
    held = lambda further: lambda x: F.when(x.rlike(TWO_WORDS), x).otherwise(further)
    out = everything
    for n in reversed(WINDOWS):
        out = _let(get(n), held(out))
    return F.when(length <= WINDOWS[0], everything).otherwise(out)


def _before_at(text: Column, at: Column) -> Column:
    """What stands before a position of a text, as far as its last two words."""
    return _before(lambda n: F.substr(text, F.greatest(at - (n - 1), F.lit(1)), F.least(at, F.lit(n))), at, F.substr(text, F.lit(1), at))


def _masked(text: Column, spans: Column) -> Column:
    """The text with the spans' characters hidden, so that a candidate that runs into them shows it.

    It is put together from stretches of bounded length with their own spans, as a string grows by copies.
    """

    def stretch(low: Column, own: Column) -> Column:
        part = F.substr(text, low + 1, F.lit(STRETCH))
        start = F.struct(low.alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            first, last = F.greatest(s["start"], acc["at"]), F.least(s["end"], low + STRETCH)
            between = F.substr(part, acc["at"] - low + 1, F.greatest(first - acc["at"], F.lit(0)))
            hidden = F.repeat(F.lit(MASK), F.greatest(last - first, F.lit(0)).cast("int"))
            return F.struct(F.greatest(acc["at"], last).alias("at"), F.concat(acc["out"], between, hidden).alias("out"))

        return _let(F.aggregate(own, start, step), lambda done: F.concat(done["out"], F.substr(part, done["at"] - low + 1, F.lit(STRETCH))))

    def parts(ordered: Column) -> Column:
        lows = F.sequence(F.lit(0).cast("long"), F.length(text).cast("long"), F.lit(STRETCH).cast("long"))
        return F.array_join(F.transform(lows, lambda low: stretch(low, F.filter(ordered, lambda s: (s["start"] < low + STRETCH) & (s["end"] > low)))), "")

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
    return F.when(F.size(spans) == 0, text).otherwise(_let(ordered, parts))


def instances(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(k0, k1 and so on for ``keep``, spans, found): base spans, and all instances as (kind or null, start, end, value, before1, before2).

    A candidate's edges are trimmed of quotes, brackets and punctuation. The words before are lower-cased.
    """
    plain = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK + MASK, OTHER * 2)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, names, strict=True)], plain.alias("text")).withColumn("spans", base_spans(F.col("text")))
    rows = rows.withColumn("masked", _masked(F.col("text"), F.col("spans")))
    pieces = F.transform(_cut(F.col("masked"), CANDIDATE), lambda x, i: F.struct(x.alias("text"), i.alias("i")))
    none = F.expr("cast(array() as array<struct<start:long,end:long,value:string,before:string>>)")
    start = lambda at: F.struct(at.alias("at"), F.when(at == 0, "").otherwise(_before_at(F.col("masked"), at)).alias("before"), none.alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        left = F.length(F.regexp_extract(piece["text"], r"^([^A-Za-z0-9@+\x03]*)", 1))
        value = F.regexp_replace(piece["text"], r"^[^A-Za-z0-9@+\x03]+|[^A-Za-z0-9\x03]+$", "")
        digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
        fits = (piece["i"] % 2 == 1) & ~F.contains(value, F.lit(MASK)) & ((digits >= DIGITS) | value.rlike("^[^@]+@[^@]+$"))
        begin = acc["at"] + left
        # what was masked is read from the text itself
        before = F.when(F.contains(acc["before"], F.lit(MASK)), _before_at(F.col("text"), acc["at"])).otherwise(acc["before"])
        one = F.array(F.struct(begin.alias("start"), (begin + F.length(value)).alias("end"), value.alias("value"), before.alias("before")))
        tail = _let(F.concat(acc["before"], piece["text"]), lambda x: _before(lambda n: F.right(x, F.lit(n)), F.length(x), x))
        return F.struct(
            (acc["at"] + F.length(piece["text"])).alias("at"), tail.alias("before"),
            F.when(fits, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"),
        )

    found = F.when(F.col("masked").rlike("[0-9@]"), _let(pieces, lambda x: _scanned(x, start, step)))
    # a base span's value and context are read from the text itself
    seeds = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"], s["end"], F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("value"),
            _before_at(F.col("text"), s["start"]).alias("before"), s["kind"].alias("kind"),
        ),
    )
    loose = F.coalesce(found, none)
    loose = F.transform(loose, lambda f: F.struct(f["start"], f["end"], f["value"], f["before"], F.lit(None).cast("string").alias("kind")))
    return rows.select(*names, "spans", F.concat(seeds, loose).alias("found"))


def patterns(before: Column) -> Column:
    """The lexical patterns that the text before an instance gives: its last word, and its last two words."""
    words = F.filter(F.split(F.lower(before), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    last = F.when(F.size(words) >= 1, F.concat(F.lit("1:"), F.element_at(words, -1)))
    two = F.when(F.size(words) >= 2, F.concat(F.lit("2:"), F.element_at(words, -2), F.lit(" "), F.element_at(words, -1)))
    return F.array_compact(F.array(last, two))


def learned(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(pattern, kind) of the accepted patterns, from rows (kind, value, before)."""
    pairs = found.select("kind", F.lower("value").alias("value"), F.explode(patterns(F.col("before"))).alias("pattern"))
    pairs = stored(pairs.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pairs")
    held, scores = pairs.withColumn("trust", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)).withColumn("as", F.col("kind")), None
    for i in range(s.rounds):
        # only patterns with enough known instances can be accepted; the others take no part in this round
        known = held.where(F.col("as").isNotNull()).groupBy("pattern", "as").agg(F.count("*").alias("n"))
        known = known.groupBy("pattern").agg(F.max_by("as", F.struct("n", "as")).alias("of"), F.sum("n").alias("n")).where(F.col("n") >= s.least_seeds).select("pattern", "of")
        scores = held.join(known, "pattern").groupBy("pattern").agg((F.sum("trust") / (F.count("*") + s.shrink)).alias("score"), F.max("of").alias("of"))
        scores = stored(scores, "scores")
        if i + 1 < s.rounds:
            each = pairs.where("kind is null").join(scores, "pattern").groupBy("value").agg(
                (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("belief"),
                F.max_by("of", F.when(F.col("score") >= s.accept, F.struct("score", "of"))).alias("named"),
            )
            held = pairs.join(stored(each, "beliefs"), "value", "left")
            held = held.select("pattern", "kind", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("belief", F.lit(0.0))).alias("trust"), F.coalesce("kind", "named").alias("as"))
    return scores.where(F.col("score") >= s.accept).select("pattern", F.col("of").alias("kind"))


def find(docs: DataFrame, keep: list[str], s: Settings = Settings()) -> DataFrame:
    """The columns ``keep``, ``base`` and ``spans`` of every row of ``docs``, the last two arrays of (kind, start, end).

    Rows are told apart by a number of their own, so repeated ids stay apart.
    """
    rows = stored(instances(docs, keep).withColumn("row", F.monotonically_increasing_id()), "instances")
    each = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    known = learned(each.select("kind", "value", "before"), s)
    fresh = each.where("kind is null").select("row", "start", "end", F.explode(patterns(F.col("before"))).alias("pattern"))
    added = fresh.join(known, "pattern").groupBy("row", "start", "end").agg(F.min("kind").alias("kind"))
    added = stored(added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")), "added")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.concat("spans", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    ordered = F.transform(F.array_sort(F.transform(every, lambda x: F.struct(F.element_at(rank, x["kind"]).alias("rank"), x["start"], x["end"], x["kind"]))), lambda x: F.struct(x["kind"], x["start"], x["end"]))
    # few rows gain spans as a rule: where their number is small, the others needn't be shuffled
    few = added.agg(F.coalesce(F.sum(F.size("added") * 40 + 16), F.lit(0))).first()[0] <= BROADCAST
    out = rows.join(F.broadcast(added) if few else added, "row", "left")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("spans").alias("base"), ordered.alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], between).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, start, step)
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))
