"""Streams over the event and document files; each must end where the batch job ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.listings import FLOW, links_of, numbered_pages
from checks.logs import FAILURES
from checks.registry import CATS, LANGS, query
from checks.store import APPLIED_TO_EMPTY, shown_chats
from hemline.session import shared_path, stored
from hemline.streaming import crawl
from hemline.streaming import incremental as inc
from hemline.streaming import limits


SLICES = 5


def _stream(spark, sf, name, order):
    """The table as a stream of five files in ``order``, a file to each micro-batch."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    root = shared_path(spark, f"slices-{name}")
    # equal shares of a sorted table; the border between two files is a border of the order
    parts = rows.repartitionByRange(SLICES, *order).sortWithinPartitions(*order)
    parts.withColumn("slice", F.spark_partition_id()).write.partitionBy("slice").parquet(root)
    folders = sorted({r["slice"] for r in spark.read.parquet(root).select("slice").distinct().collect()})
    for slice_ in folders:  # written one after the other, so the source takes them in this order
        spark.read.schema(rows.schema).parquet(f"{root}/slice={slice_}").coalesce(1).write.mode("append").parquet(f"{root}-files")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}-files")


def _events(spark, sf):
    return _stream(spark, sf, "events", ["ts", "event_id"]).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "str_01_stream_new_items",
    "SELECT 'item' || (event_id % 1000) AS item, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM events GROUP BY 1",
)
def _(spark, sf):
    root = shared_path(spark, "ledger")
    item = F.concat(F.lit("item"), (F.col("event_id") % 1000).cast("string"))
    # the second run starts over from the first one's checkpoint and must hand out nothing twice
    events = _events(spark, sf).select(item.alias("item"), "ts")
    for _ in range(2):
        inc.stream_new_items(events, f"{root}/data", f"{root}/checkpoint")
    return inc.ledger(spark, f"{root}/data").select("item", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_seen"))


@query(
    "str_02_daily_usage",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS key_id, count(*) AS used, greatest(count(*) - 3, 0) AS over_cap FROM events GROUP BY ALL",
)
def _(spark, sf):
    root = shared_path(spark, "usage")
    calls = _events(spark, sf).select("ts", F.col("user_id").alias("key_id"))
    inc.stream_daily_usage(calls, f"{root}/data", f"{root}/checkpoint")
    usage = inc.daily_usage(spark, f"{root}/data", 3)
    return usage.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "key_id", "used", "over_cap")


@query(
    "str_03_stream_failure_runs",
    f"WITH {FAILURES} SELECT key_id, event_id, stop FROM s WHERE stop IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key_id ORDER BY ts, event_id) = 1",
)
def _(spark, sf):
    root = shared_path(spark, "failures")
    calls = _events(spark, sf).select(
        F.col("user_id").alias("key_id"), "ts", "event_id", (F.col("event_type") != "error").alias("ok")
    )
    limits.stream_failure_runs(calls, f"{root}/data", f"{root}/checkpoint", 3, 12)
    return spark.read.schema(limits.STOPS).parquet(f"{root}/data/stops").select("key_id", "event_id", "stop")


@query(
    "str_04_stream_balance",
    f"WITH {CATS}, counts AS (SELECT category, pos, count(d.doc_id) AS n FROM cats LEFT JOIN documents d ON d.lang = category GROUP BY ALL) SELECT category, n, max(n) OVER () - n AS gap, row_number() OVER (ORDER BY n, pos) AS priority FROM counts",
)
def _(spark, sf):
    root = shared_path(spark, "balance")
    captions = _stream(spark, sf, "documents", ["doc_id"]).select(F.col("lang").alias("category"))
    inc.stream_balance(captions, LANGS, f"{root}/data", f"{root}/checkpoint")
    return inc.latest_batch(spark, f"{root}/data", inc.GAPS).select("category", "n", "gap", "priority")


@query("str_05_stream_chat_state", APPLIED_TO_EMPTY)
def _(spark, sf):
    root = shared_path(spark, "chats")
    e = _events(spark, sf)
    op = F.when(F.col("event_type") == "signup", "insert").when(
        (F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), "delete"
    ).otherwise("update")
    log = e.select(
        op.alias("op"), F.col("user_id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"),
        F.concat(F.lit("u"), (F.col("event_id") % 3).cast("string")).alias("user_id"), "ts", F.col("event_id").alias("seq"),
    )
    inc.stream_chat_state(log, f"{root}/data", f"{root}/checkpoint")
    return shown_chats(inc.chat_state(spark, f"{root}/data"))


@query("ext_04_page_flow_stream", FLOW)
def _(spark, sf):
    root = shared_path(spark, "crawl")
    numbered = stored(numbered_pages(spark, sf), "numbered-pages")
    at = [1 / 3, 2 / 3]
    borders = numbered.select(F.percentile_approx("page_no", at).alias("b")).first()["b"] or []
    cut = sorted(set(borders))
    # a site's pages arrive in order: each part is written by all tasks and worked off as one batch before the next comes
    for low, high in zip([0, *cut], [*cut, None]):
        part = numbered.filter(F.col("page_no") > low)
        part = part if high is None else part.filter(F.col("page_no") <= high)
        part.write.mode("append").parquet(f"{root}/pages")
        arrived = spark.readStream.schema(numbered.schema).parquet(f"{root}/pages")
        crawl.stream_page_flow(links_of(arrived), f"{root}/data", f"{root}/checkpoint")
    return crawl.flow(spark, f"{root}/data")
