"""The daily captioning plan: which items to caption today, in what order, with which key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.operators.balance import allocate_quota
from hemline.operators.joins import assign_keys, item_columns, pending_items
from hemline.sources.captions import caption_file_counts


def daily_captioning_plan(
    items: DataFrame, done: DataFrame, categories: list[str], quota: int, n_keys: int, batch: int,
    ledger: DataFrame | None = None,
) -> DataFrame:
    """Share the day's quota over the categories by what they lack, take the first pending items of each, and
    spread every category over the keys in order.

    At most ``quota`` items per category can be chosen, so each task cuts its list to that before the shuffle.
    """
    captioned = items.join(done, item_columns(items, done), "left_semi")
    targets = allocate_quota(caption_file_counts(captioned, categories), quota).select("category", "target")
    chosen = (
        pending_items(items, done, ledger, limit=quota)
        .join(F.broadcast(targets), "category")
        .filter(F.col("rank") <= F.col("target"))
        .drop("rank", "target")
    )
    return assign_keys(chosen, n_keys, batch, ["filename"], by=["category"])
