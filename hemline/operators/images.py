"""Size audits over image tables, and pixel jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.operators.scale import draw, first_n, hash_bucket

def _size_columns(images: DataFrame) -> DataFrame:
    ok = F.col("width") > 0
    return (
        images.withColumn("readable", ok)
        .withColumn("short", F.when(ok, F.least("width", "height")))
        .withColumn("long", F.when(ok, F.greatest("width", "height")))
        .withColumn("aspect", F.when(ok, F.col("width") / F.col("height")))
    )


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def image_stats(images: DataFrame, sample: int | None = None) -> DataFrame:
    """Per category averages, five disjoint size bins, extreme aspects and format issues.

    ``sample`` looks only at so many images by file name, as a quick audit; by default all count.
    """
    s, l = F.col("short"), F.col("long")
    if sample is not None:
        images = first_n(images, ["category"], ["filename"], sample)
    bad = ~F.col("readable") | ~F.col("n_channels").isin(3, 4)
    return (
        _size_columns(images)
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("checked"),
            F.avg(F.when(F.col("readable"), F.col("width"))).alias("avg_width"),
            F.avg(F.when(F.col("readable"), F.col("height"))).alias("avg_height"),
            F.avg("aspect").alias("avg_aspect"),
            _n(s < 256).alias("tiny"),
            _n((s >= 256) & (s < 512)).alias("small"),
            _n((s >= 512) & (l < 1024)).alias("good"),
            _n((s >= 512) & (l >= 1024) & (l < 2048)).alias("large"),
            _n((s >= 512) & (l >= 2048)).alias("huge"),
            _n((F.col("aspect") < 0.5) | (F.col("aspect") > 2.0)).alias("extreme_aspect"),
            _n(bad).alias("format_issues"),
            (_n(s < 256) + _n(bad)).alias("issues"),
        )
    )


def image_overview(images: DataFrame) -> DataFrame:
    """One row over all readable images. The upper bins test the long side only, so bins overlap."""
    s, l = F.col("short"), F.col("long")
    bins = {
        "tiny": s < 256,
        "small": (s >= 256) & (s < 512),
        "good": (l >= 512) & (l < 1024),
        "large": (l >= 1024) & (l < 2048),
        "huge": l >= 2048,
    }
    out = _size_columns(images).filter("readable").agg(
        F.count(F.lit(1)).alias("checked"),
        F.min("width").alias("min_width"), F.max("width").alias("max_width"), F.avg("width").alias("avg_width"),
        F.min("height").alias("min_height"), F.max("height").alias("max_height"), F.avg("height").alias("avg_height"),
        *[_n(c).alias(name) for name, c in bins.items()],
    )
    return out.select(
        "*", *[(F.try_divide(F.col(b), F.col("checked")) * 100).alias(f"{b}_pct") for b in bins]
    )


# --- pixels -----------------------------------------------------------------------------------------------

def augment_images(plan: DataFrame) -> DataFrame:
    """Apply ``transform`` of each row to its image. Adds RGB-ordered ``pixels`` of the same size.

    ``plan`` carries width, height, n_channels, data and transform; unreadable images give null pixels.
    """
    from hemline.functions import pixels

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema if f.name != "data")
    return plan.mapInPandas(pixels.shipped(pixels.augment_batches), schema + ", pixels binary")


def random_plan(images: DataFrame, level: str, key: Column, seed: str = "42") -> DataFrame:
    """Draw the parameters of a random augmentation per image; every step is taken with chance one half."""
    from hemline.functions.fixed import AUGMENT_LEVELS

    rotation, bright, contrast, noise, blur = AUGMENT_LEVELS[level]

    def unit(tag: str) -> Column:
        return hash_bucket(F.concat(F.lit(f"{seed}|{level}|{tag}|"), key.cast("string"))) / F.lit(2.0**32)

    def maybe(tag: str, chance: float, value: Column) -> Column:
        return F.when(unit(tag) < chance, value)

    def around(tag: str, width: float) -> Column:
        return (unit(tag + "-value") * 2 - 1) * width

    half = 0.0 if level == "none" else 0.5
    return images.select(
        "*",
        maybe("rotate", half, around("rotate", rotation)).alias("angle"),
        maybe("bright", half, 1 + around("bright", bright)).alias("brightness"),
        maybe("contrast", half, 1 + around("contrast", contrast)).alias("contrast"),
        maybe("noise", noise, draw(F.concat(F.lit(f"{seed}|noise|"), key.cast("string")), 2**31)).alias("noise_seed"),
        maybe("blur", blur, F.lit(0.5)).alias("blur"),
    )


def augment_random(plan: DataFrame) -> DataFrame:
    """Apply the parameters drawn by :func:`random_plan`."""
    from hemline.functions import pixels

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema if f.name != "data")
    return plan.mapInPandas(pixels.shipped(pixels.random_batches), schema + ", pixels binary")


def prepare_images(images: DataFrame, size: int = 512) -> DataFrame:
    """Square RGB planes scaled to [-1, 1] as ``values``; unreadable images become zeros with ok = false."""
    from hemline.functions import pixels

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name != "data")
    return images.mapInPandas(
        pixels.shipped(pixels.prepare_batches, size), schema + ", ok boolean, values array<float>"
    )
