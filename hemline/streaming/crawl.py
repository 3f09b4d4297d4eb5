"""How the crawl of each site goes on, page by page as pages arrive, with the urls of a site kept as bitmaps.

Every url has a number, given once. The numbers of a site's urls lie in bitmaps of 32,768 bits, one for each stretch of
numbers that occurs: they merge by OR and count without being unpacked. A batch numbers its own urls, looks up the bitmaps
it touches and leaves all others alone, so what a page adds is exact although no run compares urls with those of earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hemline.operators.scale import HOT_ROWS, ranked
from hemline.session import stored
from hemline.streaming.incremental import read_state, run_available
from hemline.streaming.levels import LeveledTable

NUMBERS = "url string, number bigint"
BITMAPS = "chunk string, site string, bucket bigint, bits binary"
SITES = "site string, pages bigint, total bigint, last_new bigint, stopped boolean"
FLOW = "site string, page_no bigint, n bigint, n_new bigint, total bigint, stop string"
NEXT = "next bigint"


def url_numbers(spark: SparkSession, root: str, **sizes) -> LeveledTable:
    return LeveledTable(spark, f"{root}/numbers", NUMBERS, "url", once=True, **sizes)


def site_bitmaps(spark: SparkSession, root: str, **sizes) -> LeveledTable:
    return LeveledTable(spark, f"{root}/bitmaps", BITMAPS, "chunk", **sizes)


def site_states(spark: SparkSession, root: str, **sizes) -> LeveledTable:
    return LeveledTable(spark, f"{root}/sites", SITES, "site", **sizes)


def _alive(df: DataFrame) -> DataFrame:
    return df.withColumn("gone", F.lit(False))


def _numbered(links: DataFrame, root: str, batch_id: int, hot_rows: int, sizes: dict) -> DataFrame:
    """(url, number) of all urls of the batch; new ones are numbered on from those given before and kept."""
    spark = links.sparkSession
    table = url_numbers(spark, root, **sizes)
    urls = stored(links.select("url").filter("url IS NOT NULL").distinct(), "batch-urls")
    n = urls.count()
    known = stored(table.look_up(urls, n, batch_id), "known-urls")
    fresh = stored(urls.join(known, "url", "left_anti"), "fresh-urls")
    start = read_state(spark, f"{root}/next", NEXT, batch_id - 1).first()
    start = start["next"] if start else 1  # the bitmap functions count from 1
    added = ranked(fresh, [], ["url"], "_rank", hot_rows).select("url", (F.col("_rank") + F.lit(start - 1)).alias("number"))
    added = stored(added, "numbered-urls")
    n_added = added.count()
    table.append(_alive(added), n_added, batch_id)
    spark.createDataFrame([(start + n_added,)], NEXT).coalesce(1).write.mode("overwrite").parquet(f"{root}/next/batch={batch_id}")
    return known.unionByName(added)


def _growth(page_bits: DataFrame, root: str, batch_id: int, sizes: dict) -> DataFrame:
    """(site, page_no, n, n_new) of every page with urls; the bitmaps of the sites take them in."""
    spark = page_bits.sparkSession
    table = site_bitmaps(spark, root, **sizes)
    chunks = page_bits.select("chunk").distinct()
    n = chunks.count()
    old = stored(table.look_up(chunks, n, batch_id), "old-bitmaps")
    rows = old.select("chunk", "site", "bucket", F.lit(None).cast("bigint").alias("page_no"), "bits").unionByName(
        page_bits.select("chunk", "site", "bucket", "page_no", "bits")
    )
    upto = Window.partitionBy("chunk").orderBy(F.asc_nulls_first("page_no"))
    seen = F.bitmap_count(F.bitmap_or_agg("bits").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counted = rows.withColumn("_seen", seen).withColumn("_before", F.coalesce(F.lag("_seen").over(upto), F.lit(0)))
    grown = counted.filter("page_no IS NOT NULL").groupBy("site", "page_no").agg(
        F.sum(F.bitmap_count("bits")).alias("n"), F.sum(F.col("_seen") - F.col("_before")).alias("n_new")
    )
    merged = rows.groupBy("chunk", "site", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    table.append(_alive(stored(merged, "new-bitmaps")), n, batch_id)
    return grown


def stream_page_flow(
    links: DataFrame, root: str, checkpoint: str, idle: int = 3, max_pages: int | None = None, hot_rows: int = HOT_ROWS, **sizes
) -> None:
    """:func:`hemline.operators.pages.page_flow` as pages arrive; read it with :func:`flow`.

    ``links`` is (site, page_no, url, has_next) with all rows of a page in one batch; pages without links come with url =
    null. Pages of a site arrive in rising page_no, also over batches. Rows without a site or page number are left
    out. After its stop a site's later pages are passed over.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter("site IS NOT NULL AND page_no IS NOT NULL")
        if max_pages is not None:
            rows = rows.filter(F.col("page_no") <= max_pages)
        states = site_states(spark, root, **sizes)
        rows = stored(rows.select("site", F.col("page_no").cast("bigint").alias("page_no"), "url", "has_next"), "batch-links")
        sites = rows.select("site").distinct()
        n_sites = sites.count()
        before = stored(states.look_up(sites, n_sites, batch_id), "old-sites")
        going = stored(rows.join(before.filter("stopped").select("site"), "site", "left_anti"), "going")
        numbers = _numbered(going, root, batch_id, hot_rows, sizes)
        position = [F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("_bit")]
        placed = going.join(numbers, "url").select("site", "page_no", *position)
        page_bits = placed.groupBy("site", "page_no", "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))
        chunk = F.concat_ws("\x00", F.col("bucket").cast("string"), "site")
        page_bits = stored(page_bits.withColumn("chunk", chunk), "page-bitmaps")
        grown = _growth(page_bits, root, batch_id, sizes)
        pages = going.groupBy("site", "page_no").agg(F.max("has_next").alias("has_next")).join(grown, ["site", "page_no"], "left")
        flow_ = stored(_with_stops(pages.na.fill({"n": 0, "n_new": 0}), before, idle, max_pages), "flow")
        flow_.select("site", "page_no", "n", "n_new", "total", "stop").write.mode("overwrite").parquet(f"{root}/flow/batch={batch_id}")
        last = flow_.groupBy("site").agg(
            F.max("_no").alias("pages"), F.max("total").alias("total"), F.max("_last_new").alias("last_new"),
            F.max(F.col("stop").isNotNull()).alias("stopped"),
        )
        states.append(_alive(last), n_sites, batch_id)

    run_available(links, step, checkpoint)


def _with_stops(pages: DataFrame, before: DataFrame, idle: int, max_pages: int | None) -> DataFrame:
    """Running values of each page on top of what its site had before, up to and with the page the site stops at."""
    held = before.select("site", F.col("pages").alias("_p"), F.col("total").alias("_t"), F.col("last_new").alias("_l"))
    rows = pages.join(held, "site", "left").na.fill({"_p": 0, "_t": 0, "_l": 0})
    upto = Window.partitionBy("site").orderBy("page_no")
    here = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_no", F.col("_p") + F.row_number().over(upto))
    rows = rows.withColumns(
        {
            "total": F.col("_t") + F.sum("n_new").over(here),
            "_last_new": F.coalesce(F.max(F.when(F.col("n_new") > 0, F.col("_no"))).over(here), F.col("_l")),
        }
    )
    stop = F.when(F.col("_no") - F.col("_last_new") >= idle, "no growth").when(~F.col("has_next"), "last page")
    if max_pages is not None:
        stop = stop.when(F.col("page_no") >= max_pages, "page limit")
    rows = rows.withColumn("stop", stop)
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_stops", F.count("stop").over(earlier)).filter("_stops = 0")


def flow(spark: SparkSession, root: str) -> DataFrame:
    """(site, page_no, n, n_new, total, stop) of all pages up to each site's stop."""
    return read_state(spark, f"{root}/flow", FLOW).select("site", "page_no", "n", "n_new", "total", "stop")


def distinct_urls(spark: SparkSession, root: str) -> DataFrame:
    """(site, n): distinct urls of every site, counted from its bitmaps."""
    return site_bitmaps(spark, root).read().groupBy("site").agg(F.sum(F.bitmap_count("bits")).alias("n"))
