"""Planned file names and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.operators.scale import HOT_ROWS, Ordered, largest_group, ranked, small_side


def _number_after(name: str, start: Column, rest: str) -> Column:
    """Number in what follows ``start`` in a name, by one constant pattern; null when the name is not of that form."""
    tail = F.when(F.startswith(F.col(name), start), F.substr(F.col(name), F.char_length(start) + 1))
    return F.regexp_extract(tail, rest, 1).try_cast("bigint")


def assign_names(files: DataFrame, prefixes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """New name ``prefix_i.ext`` per file: numbered from 1 by lower-cased name inside its category.

    ``files`` is (category, filename). Numbers already used by names of that form in the category are
    skipped, whatever their extension; extensions are lower-cased. Files of a category without prefix stay, with a
    null ``new_name``.
    """
    named = files.join(small_side(prefixes), "category", "left").select(
        "category", "filename", "prefix", F.lower("filename").alias("low")
    )
    # taken numbers are never more than files, so twice the files bounds every group below
    split = 2 * largest_group(files, ["category"]) > hot_rows
    extension = F.regexp_extract("low", r"(\.[^.]*)$", 1)
    number = _number_after("low", F.concat(F.lower("prefix"), F.lit("_")), r"^([1-9][0-9]{0,17})\.[^.]*$")
    taken = named.select("category", number.alias("t")).filter("t IS NOT NULL").distinct()
    # the j-th taken number t has t - j free numbers before it, so file k moves up once per taken with t - j < k
    gaps = ranked(taken, ["category"], ["t"], "j", split=split).select(
        "category",
        (F.col("t") - F.col("j")).alias("at"),
        F.lit(1).alias("kind"),
        F.col("t").cast("string").alias("tie"),
        F.lit(None).cast("string").alias("filename"),
        F.lit(None).cast("string").alias("stem"),
        F.lit(None).cast("string").alias("ext"),
    )
    rows = ranked(named, ["category"], ["low", "filename"], "k", split=split).select(
        "category",
        F.col("k").alias("at"),
        F.lit(0).alias("kind"),
        F.col("filename").alias("tie"),
        "filename",
        F.col("prefix").alias("stem"),
        extension.alias("ext"),
    )
    merged = Ordered(rows.unionByName(gaps), ["category"], ["at", "kind", "tie"], split=split)
    numbered = merged.running(skipped=("sum", F.col("kind"))).done().filter("kind = 0")
    i = F.col("at") + F.col("skipped")
    return numbered.select(
        "category", "filename", F.concat("stem", F.lit("_"), i.cast("string"), "ext").alias("new_name")
    )


def next_index(existing: DataFrame, new: DataFrame, order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number new items on from the largest index of names ``category_<i>.jpg``; from 0 when there is none."""
    found = _number_after("filename", F.concat("category", F.lit("_")), r"^([0-9]+)\.jpg$")
    start = existing.select("category", found.alias("_found")).groupBy("category").agg((F.max("_found") + 1).alias("start"))
    numbered = ranked(new, ["category"], order, "_k", hot_rows)
    return (
        numbered.join(small_side(start), "category", "left")
        .withColumn("index", F.coalesce("start", F.lit(0)) + F.col("_k") - 1)
        .withColumn("new_name", F.concat("category", F.lit("_"), F.col("index").cast("string"), F.lit(".jpg")))
        .drop("start", "_k")
    )
