"""Fixed values as small tables with their order in ``pos``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hemline.functions import fixed


def category_dim(spark: SparkSession, names: list[str] = fixed.CATEGORIES) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "category string, pos int")


def tool_dim(spark: SparkSession) -> DataFrame:
    rows = [(t, p, r, d, i) for i, (t, p, r, d) in enumerate(fixed.TOOL_PARAMETERS)]
    return spark.createDataFrame(
        rows, "tool string, parameter string, required boolean, default string, pos int"
    )


def media_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(a, s, i) for i, (a, s) in enumerate(fixed.MEDIA_ALIASES)], "alias string, slug string, pos int"
    )


def city_dim(spark: SparkSession) -> DataFrame:
    points = {name: (lat, lon) for name, lat, lon in fixed.CITY_POINTS}
    rows = [(c, fixed.CITY_SLUGS[c], *points.get(c, (None, None)), i) for i, c in enumerate(fixed.CITIES)]
    return spark.createDataFrame(rows, "city string, slug string, lat double, lon double, pos int")


def content_type_dim(spark: SparkSession, content_types: list[tuple]) -> DataFrame:
    rows = [(c, t, w, length, i) for i, (c, t, w, length) in enumerate(content_types)]
    return spark.createDataFrame(
        rows, "category string, content_type string, weight int, length string, pos int"
    )


def transform_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(fixed.TRANSFORMS)], "transform string, pos int")


def rule_dim(spark: SparkSession, rules: dict) -> DataFrame:
    """Scoring rules: name -> expected words, or name -> (must, must_not)."""
    rows = []
    for i, (name, rule) in enumerate(rules.items()):
        must, must_not = rule if isinstance(rule, tuple) else (rule, [])
        rows.append((name, must, must_not, i))
    return spark.createDataFrame(rows, "test string, must array<string>, must_not array<string>, pos int")
