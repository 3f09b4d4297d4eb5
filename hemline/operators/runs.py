"""Training-run and call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemline.operators.scale import HOT_ROWS, Ordered


def epoch_losses(steps: DataFrame) -> DataFrame:
    """Mean loss per run and epoch over usable steps; an epoch without any is infinite.

    ``is_best`` marks epochs strictly better than all before. ``steps`` is (run, epoch, loss).
    """
    usable = F.col("loss").isNotNull() & ~F.isnan("loss")
    per = steps.groupBy("run", "epoch").agg(
        F.avg(F.when(usable, F.col("loss"))).alias("mean"), F.count(F.when(usable, 1)).alias("valid")
    )
    per = per.select("run", "epoch", F.coalesce("mean", F.lit(float("inf"))).alias("avg_loss"), "valid")
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.min("avg_loss").over(before), F.lit(float("inf")))
    return per.withColumn("is_best", F.col("avg_loss") < best)


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Highest epoch per run. ``checkpoints`` is (run, name, recorded); "final" counts by its recorded epochs.

    Names without a number, and a final one without a record, are skipped.
    """
    number = F.regexp_extract("name", r"^checkpoint-([0-9]+)(-.*)?$", 1).try_cast("bigint")
    epoch = F.when(F.col("name") == "checkpoint-final", F.col("recorded")).otherwise(number)
    return (
        checkpoints.withColumn("epoch", epoch.cast("bigint"))
        .filter("epoch IS NOT NULL")
        .groupBy("run")
        .agg(F.max("epoch").alias("epoch"), F.max_by("name", F.struct("epoch", "name")).alias("name"))
    )


def failure_runs(
    calls: DataFrame, order: list[str], max_consecutive: int = 10, max_total: int = 50,
    hot_rows: int = HOT_ROWS, key: str = "key_id",
    split: bool | None = None,
) -> DataFrame:
    """Running failures per key: in a row (a success starts over) and in total.

    ``stop`` names the limit reached, consecutive before total; ``first_stop`` marks the row a key stops at.
    """
    fail = F.when(F.col("ok"), 0).otherwise(1)
    rows = Ordered(calls, [key], order, hot_rows, split).running(total_failures=("sum", fail.cast("bigint")))
    rows.running(_base=("max", F.when(F.col("ok"), F.col("total_failures"))))
    in_a_row = F.col("total_failures") - F.coalesce("_base", F.lit(0))
    rows.df = rows.df.withColumn("consecutive", in_a_row).drop("_base")
    stop = F.when(F.col("consecutive") >= max_consecutive, "consecutive").when(
        F.col("total_failures") >= max_total, "total"
    )
    rows.df = rows.df.withColumn("stop", stop)
    rows.running(_stops=("sum", F.col("stop").isNotNull().cast("bigint")))
    first = (F.col("_stops") == 1) & F.col("stop").isNotNull()
    return rows.done().withColumn("first_stop", first).drop("_stops")


def running_mean_loss(
    steps: DataFrame, order: list[str], key: str = "run", hot_rows: int = HOT_ROWS, split: bool | None = None
) -> DataFrame:
    """Mean loss of a run up to each step; other columns such as the learning rate stay.

    Losses are summed as decimals with twelve places, so the result does not depend on how the rows were divided.
    From a loss on that is no finite number the mean is NaN.
    """
    loss = F.col("loss").cast("double")
    wrong = F.isnan(loss) | (F.abs(loss) == float("inf"))
    rows = Ordered(steps, [key], order, hot_rows, split).running(
        _sum=("sum", F.when(~wrong, loss).try_cast("decimal(27,12)")),
        _wrong=("sum", F.when(wrong, 1).otherwise(0).cast("bigint")),
        step_no=("sum", F.lit(1).cast("bigint")),
    )
    mean = F.when(F.col("_wrong") > 0, float("nan")).otherwise(F.col("_sum").cast("double") / F.col("step_no"))
    return rows.done().withColumn("avg_loss", mean).drop("_sum", "_wrong")
