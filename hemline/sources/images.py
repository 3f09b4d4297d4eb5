"""Image folders ``<root>/<Season>/<Gender>/<file>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.functions import fixed
from hemline.sources.dims import category_dim


def _glob(extensions: list[str]) -> str:
    # file name globs are case sensitive, so each letter accepts both cases
    each = ["".join(f"[{ch}{ch.upper()}]" if ch.isalpha() else ch for ch in e) for e in extensions]
    return "*.{" + ",".join(each) + "}"


def _place(path: Column) -> list[Column]:
    pattern = r"/([^/]+)/([^/]+)/([^/]+)$"
    season, gender = F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)
    return [
        F.concat_ws("_", season, gender).alias("category"),
        F.regexp_extract(path, pattern, 3).alias("filename"),
        path.alias("path"),
    ]


def read_images(spark: SparkSession, root: str, use: str = "audit") -> DataFrame:
    """Decoded images. Unreadable files stay with width, height and channels of -1. ``use`` picks the extensions."""
    df = (
        spark.read.format("image")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _glob(fixed.IMAGE_EXTENSIONS[use]))
        .load(root)
    )
    return df.select(
        *_place(F.col("image.origin")),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )


def list_images(spark: SparkSession, root: str, use: str = "augmenting") -> DataFrame:
    """File list without reading any content."""
    df = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _glob(fixed.IMAGE_EXTENSIONS[use]))
        .load(root)
    )
    return df.select(*_place(F.col("path")), "length", F.col("modificationTime").alias("modified"))


def image_inventory(images: DataFrame, categories: list[str] = fixed.CATEGORIES) -> DataFrame:
    """(category, pos, n, missing) for every expected folder plus a last row with the total."""
    counts = images.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    dim = F.broadcast(category_dim(images.sparkSession, categories))
    per = dim.join(counts, "category", "left").select(
        "category", "pos", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.col("n").isNull().alias("missing")
    )
    total = per.agg(
        F.lit("total").alias("category"),
        F.lit(len(categories)).alias("pos"),
        F.sum("n").alias("n"),
        F.max("missing").alias("missing"),
    )
    return per.unionByName(total)
