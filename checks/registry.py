"""Query registry and the SQL fragments the oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LANGS = ["en", "fr", "de", "es"]
CATS = "cats(category, pos) AS (VALUES ('en', 0), ('fr', 1), ('de', 2), ('es', 3))"

WS = r"\t\n\x0b\f\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table for work that is heavy per row."""
    return spread(table(spark, sf, name), key)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as captioned files: category = language, file name = zero-padded id."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("lang").alias("category"),
        F.format_string("%08d.jpg", F.col("doc_id")).alias("filename"),
        F.col("text").alias("caption"),
        F.col("doc_id").alias("pos"),
        F.col("source"),
    )


DOCS = (
    "docs AS (SELECT lang AS category, lpad(doc_id::varchar, 8, '0') || '.jpg' AS filename, text AS caption, "
    "doc_id AS pos, source FROM documents)"
)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.format_string("%08d.jpg", F.col("doc_id")).alias("filename"))


DONE = "done AS (SELECT lpad(doc_id::varchar, 8, '0') || '.jpg' AS filename FROM labels)"


def md5_text(c):
    return F.md5(F.encode(c, "utf-8"))


def choose(index, options: list[str]):
    """One of the options by a number column."""
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(index, F.lit(len(options))).cast("int"))


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_choose(index: str, options: list[str]) -> str:
    return f"([{', '.join(quote(o) for o in options)}])[({index}) % {len(options)} + 1]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return f"regexp_replace({sql_strip(x)}, '[{WS}]+', ' ', 'g')"


def sql_words(x: str) -> str:
    """Number of white-space separated words."""
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


def sql_values(rows) -> str:
    def one(v):
        return "NULL" if v is None else quote(v) if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
