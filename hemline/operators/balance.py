"""Counts per category: balance, gaps, quotas, needs and readiness.

``counts`` always has one row per category (category, pos, n), so windows over it see a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemline.functions import text

def _all() -> Window:
    return Window.partitionBy(F.lit(0))


def balance_stats(counts: DataFrame) -> DataFrame:
    spread = F.col("imbalance")
    verdict = (
        F.when(F.col("total") == 0, "none found")
        .when(spread == 0, "perfect")
        .when(spread <= 5, "very well balanced")
        .when(spread <= 20, "moderately balanced")
        .when(spread <= 50, "somewhat imbalanced")
        .otherwise("significantly imbalanced")
    )
    return (
        counts.agg(
            F.sum("n").alias("total"), F.avg("n").alias("average"), F.min("n").alias("smallest"),
            F.max("n").alias("largest"),
        )
        .withColumn("imbalance", F.col("largest") - F.col("smallest"))
        .withColumn("verdict", verdict)
    )


def balance_gaps(counts: DataFrame) -> DataFrame:
    """Gap of each category to the largest one, and its priority: fewest first, ties in category order."""
    order = _all().orderBy("n", "pos")
    return (
        counts.withColumn("gap", F.max("n").over(_all()) - F.col("n"))
        .withColumn("total_gap", F.sum("gap").over(_all()))
        .withColumn("priority", F.row_number().over(order))
    )


def allocate_quota(counts: DataFrame, quota: int) -> DataFrame:
    """Share ``quota`` out: evenly when balanced, gaps first when they fit, else by size of gap.

    Remainders of the divisions stay unused.
    """
    k = F.count(F.lit(1)).over(_all())
    gaps = balance_gaps(counts).withColumn("k", k)
    gap, total, q = F.col("gap"), F.col("total_gap"), F.lit(quota)
    target = (
        F.when(total == 0, F.floor(q / F.col("k")))
        .when(total <= q, gap + F.floor((q - total) / F.col("k")))
        .otherwise(F.floor(q * F.try_divide(gap, total)))
    )
    return gaps.select("category", "pos", "n", "gap", target.cast("bigint").alias("target"))


def needed(counts: DataFrame, target: int) -> DataFrame:
    more = F.greatest(F.lit(target) - F.col("n"), F.lit(0))
    return (
        counts.withColumn("needed", more)
        .withColumn("after", F.col("n") + F.col("needed"))
        .withColumn("total_before", F.sum("n").over(_all()))
        .withColumn("total_after", F.sum("after").over(_all()))
    )


def sample_advice(counts: DataFrame) -> DataFrame:
    n = F.col("n")
    return counts.withColumn(
        "advice", F.when(n < 50, "needs more").when(n < 100, "could use more").otherwise("good")
    ).withColumn("missing", F.when(n < 50, 50 - n).when(n < 100, 100 - n).otherwise(0).cast("bigint"))


def readiness(counts: DataFrame, image_totals: DataFrame) -> DataFrame:
    """One row (ready, issues). ``image_totals`` is one row (checked, tiny, issues).

    The test of the smallest category is only made when the total is large enough.
    """
    c = counts.agg(F.sum("n").alias("total"), F.min("n").alias("smallest"))
    both = c.unionByName(image_totals.select("checked", "tiny", "issues"), allowMissingColumns=True)
    facts = both.agg(*[F.max(x).alias(x) for x in both.columns])
    found = F.array(
        F.when(F.col("total") < 200, "dataset too small").when(F.col("smallest") < 30, "some categories too small"),
        F.when(F.col("issues") > 10, "image quality issues"),
        F.when(F.col("tiny") > F.col("checked") * 0.1, "too many tiny images"),
    )
    return facts.select(F.filter(found, lambda x: x.isNotNull()).alias("issues")).select(
        (F.size("issues") == 0).alias("ready"), "issues"
    )


def caption_format_audit(captions: DataFrame) -> DataFrame:
    """Per category: captions, how many start the expected way, and the first caption in file order."""
    good = text.has_good_start(F.col("caption"))
    return captions.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(good, 1)).alias("n_good"),
        F.min_by("caption", "pos").alias("sample"),
    )


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """Captioned and failed per category plus a total row (category = null), in one pass."""
    return outcomes.rollup("category").agg(
        F.sum("captioned").alias("captioned"),
        F.sum("failed").alias("failed"),
        (F.sum("captioned") + F.sum("failed")).alias("total"),
    )


def capacity_summary(keys: DataFrame, n_categories: int = 4) -> DataFrame:
    """One row over the checked keys (status, capacity): how many images can still be captioned today."""
    valid = F.col("status") == "valid"
    room = F.when(valid & F.contains("capacity", F.lit("40+")), 40).when(valid, 50).otherwise(0)
    overall = (
        F.when(F.col("valid") == 0, "no working keys")
        .when(F.col("exhausted") == F.col("keys"), "all quotas exhausted")
        .when(F.col("exhausted") > 0, "some keys exhausted")
        .otherwise("all keys working")
    )
    return (
        keys.agg(
            F.count(F.lit(1)).alias("keys"),
            F.count(F.when(valid, 1)).alias("valid"),
            F.count(F.when(F.col("status") == "quota", 1)).alias("exhausted"),
            F.coalesce(F.sum(room), F.lit(0)).cast("bigint").alias("remaining"),
        )
        .withColumn("per_category", F.floor(F.col("remaining") / n_categories))
        .withColumn("overall", overall)
    )
