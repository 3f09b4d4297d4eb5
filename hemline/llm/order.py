"""A table cut into ranges of a key, so that work in key order needs no task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows aimed at in one range, and most ranges; ranges are only a division of the work, results do not depend on them.
ROWS, MOST = 512, 4096


def range_column(df: DataFrame, key: str, rows: int = ROWS, most: int = MOST) -> Column:
    """Number of the key range a row falls in, rising with the key; rows without a key fall in the first.

    The borders are approximate quantiles from one pass over the key column alone. Equal keys share a range.
    """
    n = df.select(F.count(key).alias("n")).first()["n"]
    parts = min(most, -(-n // rows))
    if parts < 2:
        return F.lit(0)
    at = [i / parts for i in range(1, parts)]
    borders = df.select(F.percentile_approx(key, at, 20 * parts).alias("b")).first()["b"]
    array = F.array(*[F.lit(b) for b in sorted(set(borders))])
    return F.coalesce(F.size(F.filter(array, lambda b: b <= F.col(key))), F.lit(0))


def before_in_order(totals: DataFrame, part: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all earlier ranges. One row a range, so the single window stays short."""
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("bigint")))
