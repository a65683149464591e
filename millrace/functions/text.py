"""Value cleaning and small text functions, built in where Spark has them and vectorised where it doesn't."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Texts that stand for no number.
NO_NUMBER = ["", "—", "－", "-", "─", "无", "N/A", "n/a", "null", "NULL", "None", "/"]
#: What business codes write for a hyphen.
DASHES = "⁃—−–一"


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normal(text: Column) -> Column:
    """NFKC; ASCII texts, which it leaves alone, don't go through Python's values."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(text)).otherwise(text)


@pandas_udf(ArrayType(StringType()))
def nfkc_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda row: [x if x is None else unicodedata.normalize("NFKC", x) for x in row], na_action="ignore")


def normal_all(texts: Column) -> Column:
    """NFKC of all texts of an array; only arrays with one that isn't ASCII go through Python."""
    return F.when(F.exists(texts, lambda x: x.rlike(r"[^\x00-\x7F]")), nfkc_all(texts)).otherwise(texts)


def clean_number(text: Column) -> Column:
    """A number's text, normalised and trimmed; null where it stands for none."""
    found = F.trim(normal(text))
    return F.when(~found.isin(*NO_NUMBER), found)


def clean_code(text: Column, numeral_dash: bool = True) -> Column:
    """A business code in one form: NFKC, one hyphen, no white space. ``numeral_dash`` also takes the numeral one for a hyphen."""
    dashes = DASHES if numeral_dash else DASHES[:-1]
    return F.regexp_replace(F.translate(normal(text), dashes, "-" * len(dashes)), r"\s+", "")


#: Fixed value: a unit in brackets at the end of a header.
UNIT = r"[（(][^）)]*[）)]\s*$"


def clean_key(text: Column) -> Column:
    """A header without its unit in brackets and without white space, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "(?U)" + UNIT, ""), r"(?U)\s+", ""))


def key_of(text: str | None) -> str:
    """:func:`clean_key` of one text, for plans made on the driver."""
    return re.sub(r"\s+", "", re.sub(UNIT, "", text or "")).lower()


def stable_code(*values: Column) -> Column:
    """Eight upper-case hex digits of the first value that isn't blank."""
    first = F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])
    return F.upper(F.substring(F.md5(first.cast("binary")), 1, 8))


def vector_id(source: Column, page: Column, text: Column) -> Column:
    """A piece's id by its source and page, else by its content."""
    placed = F.concat(source, F.lit("_p"), page.cast("string"))
    return F.md5(F.coalesce(placed, F.concat(F.lit("content:"), text)).cast("binary"))


#: What of a path is a number and a UUID, looked for in this order.
PATH_PARTS = ((r"/\d+", "/:id"), (r"/[a-f0-9-]{36}", "/:uuid"))


def plain_path(path: Column) -> Column:
    """A request path with numbers, then UUIDs, replaced by their kinds."""
    for pattern, kind in PATH_PARTS:
        path = F.regexp_replace(path, pattern, kind)
    return path


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, 0 to 1."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def converts(text: Column, type_name: str) -> Column:
    """Whether a text can be a value of the type; null stays null."""
    from millrace.plans.catalog import family, spark_type

    cleaned = clean_number(text) if family(type_name) in ("int", "float") else F.trim(text)
    return F.when(cleaned.isNotNull(), cleaned.try_cast(spark_type(type_name)).isNotNull())


#: Other dialects' clocks, and Spark's.
DIALECT = {"datetime('now')": "current_timestamp()", "date('now')": "current_date()", "now()": "current_timestamp()", "curdate()": "current_date()"}


def spark_dialect(expression: str) -> str:
    """Other dialects' clock functions and their one-argument date functions, as Spark spells them."""
    for theirs, ours in DIALECT.items():
        expression = re.sub(re.escape(theirs), ours, expression, flags=re.I)
    expression = re.sub(r"\bdatetime\(", "to_timestamp(", expression, flags=re.I)
    return re.sub(r"\bdate\(", "to_date(", expression, flags=re.I)
