"""Pairing, pending work and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.operators.scale import HOT_ROWS, first_n, ranked, small_side


def pair_images_captions(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Images with the caption of the same (category, filename); of repeated captions the last one counts."""
    last = captions.groupBy("category", "filename").agg(F.max_by("caption", "pos").alias("caption"))
    return images.join(last, ["category", "filename"])


def _first_place(images: DataFrame) -> DataFrame:
    return images.groupBy("filename").agg(F.min_by("path", "prio").alias("path"), F.min("prio").alias("prio"))


def pair_first_location(captions: DataFrame, images: DataFrame) -> DataFrame:
    """Captions with the path of their file in the first folder (lowest ``prio``) that holds it."""
    return captions.join(_first_place(images), "filename")


def captions_without_image(captions: DataFrame, images: DataFrame) -> DataFrame:
    return captions.join(images, "filename", "left_anti")


def item_columns(items: DataFrame, other: DataFrame, key: str = "filename", category: str = "category") -> list[str]:
    """Columns that identify an item in ``other``: file names repeat over categories, so both where it has both."""
    return [c for c in (category, key) if c in other.columns and c in items.columns]


def pending_items(
    items: DataFrame, done: DataFrame, ledger: DataFrame | None = None, limit: int | None = None,
    key: str = "filename", category: str = "category",
) -> DataFrame:
    """Items neither done nor handled today, the first ``limit`` per category by key."""
    rest = items
    for other in (done, ledger):
        if other is not None:
            on = item_columns(items, other, key, category)
            rest = rest.join(other.select(*on), on, "left_anti")
    return rest if limit is None else first_n(rest, [category], [key], limit)


def assign_keys(
    items: DataFrame, n_keys: int, batch: int, order: list[str], by: list[str] | None = None,
    hot_rows: int = HOT_ROWS, split: bool | None = None,
) -> DataFrame:
    """Item i goes to key i div batch, inside each group of ``by``; items beyond n_keys * batch stay, with a null key."""
    numbered = ranked(items, by or [], order, "_i", hot_rows, split)
    key = F.floor((F.col("_i") - 1) / batch)
    return numbered.withColumn("key_id", F.when(F.col("_i") <= n_keys * batch, key)).drop("_i")


def lookup(df: DataFrame, dim: DataFrame, on: list[str] | str, value: str, default) -> DataFrame:
    """Left lookup of ``value`` with a default for keys the table does not know."""
    keys = [on] if isinstance(on, str) else list(on)
    joined = df.join(small_side(dim.select(*keys, value)), keys, "left")
    fill: Column = default if isinstance(default, Column) else F.lit(default)
    return joined.withColumn(value, F.coalesce(value, fill))


def union_categories(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def replicate_levels(pairs: DataFrame, k: int) -> DataFrame:
    """Every pair once per augmentation level: none, normal from k = 2 on, strong from k = 3 on."""
    levels = ["none", "normal", "strong"][: min(max(k, 1), 3)]
    return pairs.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))


def dedupe_ordered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order. Combined before the shuffle, so repeats never travel."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)
