"""Caption CSV files: one header CSV per category, named ``captions_<Season>_<Gender>.csv``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.functions import fixed
from hemline.sources.dims import category_dim

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
ROW = "filename string, caption string"


def read_captions(spark: SparkSession, root: str) -> DataFrame:
    """Captions of every category file under ``root``. Missing files simply add no rows."""
    df = (
        spark.read.schema(ROW)
        .options(**CSV_OPTIONS, recursiveFileLookup=True, pathGlobFilter="captions_*.csv")
        .csv(root)
    )
    name = F.regexp_extract("_metadata.file_name", r"^captions_(.+)\.csv$", 1)
    return _with_parts(df.withColumn("category", name))


def append_captions(df: DataFrame, root: str) -> None:
    """Append captions as CSV, one folder per category; every new file brings its own header."""
    (
        df.select("category", "filename", "caption")
        .write.mode("append")
        .options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False)
        .partitionBy("category")
        .csv(root)
    )


def read_caption_table(spark: SparkSession, root: str) -> DataFrame:
    """Captions written by :func:`append_captions`; a category filter prunes whole folders."""
    df = spark.read.schema(ROW + ", category string").options(**CSV_OPTIONS).csv(root)
    return _with_parts(df)


def _with_parts(df: DataFrame) -> DataFrame:
    return df.select(
        "category",
        F.split_part("category", F.lit("_"), F.lit(1)).alias("season"),
        F.split_part("category", F.lit("_"), F.lit(2)).alias("gender"),
        "filename",
        "caption",
    )


def caption_file_counts(captions: DataFrame, categories: list[str] = fixed.CATEGORIES) -> DataFrame:
    """(category, pos, n) in category order; categories without captions stay with n = 0."""
    counts = captions.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    dim = F.broadcast(category_dim(captions.sparkSession, categories))
    # counts has at most one row per category name, so the small side drives the join
    return (
        dim.join(counts, "category", "left")
        .select("category", "pos", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )
