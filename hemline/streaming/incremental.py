"""Daily loops with saved state as streams. State lives in tables with one folder per micro-batch.

A batch reads the state the previous batch left and writes its own folder, so a batch that is run again after a
failure overwrites its own output and nothing else. State by key is a table in levels (``levels.py``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.operators.balance import balance_gaps
from hemline.operators.chats import apply_changes
from hemline.session import stored
from hemline.sources.dims import category_dim
from hemline.streaming.levels import LeveledTable


def _folder(root: str, batch_id: int) -> str:
    return f"{root}/batch={batch_id}"


def read_state(spark: SparkSession, root: str, schema: str, batch_id: int | None = None) -> DataFrame:
    """Rows of one batch folder, or of all of them. Empty before the first batch; any other missing folder is an error."""
    if batch_id is not None:
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(_folder(root, batch_id))
    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_available(stream: DataFrame, each_batch, checkpoint: str, mode: str = "append") -> None:
    """Work through everything that has arrived, then stop."""
    (
        stream.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


LEDGER = "item string, first_seen timestamp"


def ledger_table(spark: SparkSession, root: str, **sizes) -> LeveledTable:
    return LeveledTable(spark, root, LEDGER, "item", once=True, **sizes)


def stream_new_items(items: DataFrame, root: str, checkpoint: str, **sizes) -> None:
    """Ledger of items seen for the first time (item, first_seen). Restarts never hand out an item twice.

    A batch opens only those pages of the ledger whose filters say that one of its items may be there. Rows
    without an item are left out. ``sizes`` are those of :class:`LeveledTable`.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        ledger = ledger_table(batch.sparkSession, root, **sizes)
        found = batch.filter("item IS NOT NULL").groupBy("item").agg(F.min("ts").alias("first_seen")).persist()
        n = found.count()  # lost blocks of it are read again from the source
        seen = ledger.look_up(found.select("item"), n, batch_id).select("item")
        new = found.join(seen, "item", "left_anti").withColumn("gone", F.lit(False))
        ledger.append(new, n, batch_id)
        found.unpersist()

    run_available(items, step, checkpoint)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    return ledger_table(spark, root).read()


USAGE = "day date, key_id bigint, used bigint"


def stream_daily_usage(calls: DataFrame, root: str, checkpoint: str) -> None:
    """Calls per key and day that each batch adds. No state and no watermark: a call counts however late it comes."""

    def step(batch: DataFrame, batch_id: int) -> None:
        added = batch.groupBy(F.to_date("ts").alias("day"), "key_id").agg(F.count(F.lit(1)).alias("used"))
        added.write.mode("overwrite").parquet(_folder(root, batch_id))

    run_available(calls, step, checkpoint)


def daily_usage(spark: SparkSession, root: str, cap: int) -> DataFrame:
    """Counters by key and day from what the batches of :func:`stream_daily_usage` added, with the part above the cap."""
    used = read_state(spark, root, USAGE).groupBy("day", "key_id").agg(F.sum("used").alias("used"))
    return used.withColumn("over_cap", F.greatest(F.col("used") - cap, F.lit(0)))


GAPS = "category string, pos int, n bigint, gap bigint, total_gap bigint, priority int"


def stream_balance(captions: DataFrame, categories: list[str], root: str, checkpoint: str) -> None:
    """Counts, gaps and priorities per category, refreshed with every batch of captions.

    The counts are written whole before they are joined: a partition of them that a join passes over commits no state.
    """
    counts = captions.groupBy("category").agg(F.count(F.lit(1)).alias("n"))

    def step(batch: DataFrame, batch_id: int) -> None:
        totals = stored(batch, "category-counts").filter(F.col("category").isin(categories))
        spread = _as_counts(totals, categories)
        balance_gaps(spread).write.mode("overwrite").parquet(_folder(root, batch_id))

    run_available(counts, step, checkpoint, "complete")


def _as_counts(totals: DataFrame, categories: list[str]) -> DataFrame:
    dim = F.broadcast(category_dim(totals.sparkSession, categories))
    return dim.join(totals, "category", "left").select(
        "category", "pos", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


CHATS = "id string, title string, user_id string, created_at timestamp, updated_at timestamp"


def chat_table(spark: SparkSession, root: str, **sizes) -> LeveledTable:
    return LeveledTable(spark, root, CHATS, "id", **sizes)


def stream_chat_state(log: DataFrame, root: str, checkpoint: str, **sizes) -> None:
    """Chat table after every batch of the change log, read with :func:`chat_state`.

    A batch looks up the chats its log names and writes those alone: their new rows, and marks for the ones that are gone.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        table = chat_table(batch.sparkSession, root, **sizes)
        batch = batch.persist()  # read several times; lost blocks are read again from the source
        ids = batch.filter("id IS NOT NULL").select("id").distinct()
        n = ids.count()
        before = table.look_up(ids, n, batch_id).persist()
        after = stored(apply_changes(before, batch), "chats-after")
        gone = before.join(after, "id", "left_anti").withColumn("gone", F.lit(True))
        table.append(after.withColumn("gone", F.lit(False)).unionByName(gone), n, batch_id)
        before.unpersist()
        batch.unpersist()

    run_available(log, step, checkpoint)


def chat_state(spark: SparkSession, root: str) -> DataFrame:
    """Chats after the newest batch."""
    return chat_table(spark, root).read()


def latest_batch(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """State of the newest batch folder."""
    rows = read_state(spark, root, schema + ", batch bigint")
    newest = rows.agg(F.max("batch").alias("b")).first()["b"]
    return rows.filter(F.col("batch") == F.lit(newest)).drop("batch")
