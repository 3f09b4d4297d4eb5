"""Search for a piece of text in titles through an index of three-letter runs that grows by batches.

A title is listed under each run of three characters it holds. Titles of a batch stand in slabs of 64, and a list has one
row a slab, a mask of the titles in it, so a long title adds few rows of its own. A search reads the lists of the query's
rarest runs alone, keeps the titles that are on all of them and compares only those with the query. Lists are only ever
added to: a title that has changed or gone is still on its old lists, but what is compared is its newest text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.session import stored
from hemline.streaming.levels import LeveledTable

RUN = 3
# Folders the lists of a batch are dealt to by run, and lists a search reads at most: the rarest are enough to narrow it down.
BUCKETS, RAREST = 64, 4
# Titles of a slab: bits of a mask. Titles whose lists one task makes, and titles a file of a bucket has lists of.
SLAB, TASK_TITLES, FILE_TITLES = 64, 4096, 1 << 20


def runs_of(low: Column) -> Column:
    """Distinct runs of three characters of a lowered text."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?s)(?=({'.' * RUN}))"), 1))


def _bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


class TitleIndex:
    """Titles (id bigint, title string) under ``root``; ``sizes`` are those of :class:`LeveledTable`."""

    def __init__(self, spark: SparkSession, root: str, **sizes):
        self.spark, self.root = spark, root.rstrip("/")
        self.titles = LeveledTable(spark, f"{self.root}/titles", "id bigint, title string", "id", **sizes)

    def add(self, titles: DataFrame, batch_id: int) -> None:
        """New and changed titles (id, title, and optionally ``gone``), one row an id; batches count up from 0.

        A null title counts as empty. Rows without an id are left out. A batch that is run again overwrites its own part.
        """
        gone = F.coalesce("gone", F.lit(False)) if "gone" in titles.columns else F.lit(False)
        rows = titles.filter("id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.coalesce("title", F.lit("")).alias("title"), gone.alias("gone"))
        # numbers are written with the rows, so that slabs and lists agree whatever is run again
        rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "titles")
        n_rows = rows.count()
        slab, place = F.shiftright("at", SLAB.bit_length() - 1).alias("slab"), F.expr(f"cast(at % {SLAB} AS int)").alias("place")
        placed = rows.filter("NOT gone").select("id", slab, place, "title")
        slabs = placed.groupBy("slab").agg(F.collect_list(F.struct("place", "id")).alias("titles"))
        slabs.write.mode("overwrite").parquet(f"{self.root}/slabs/batch={batch_id}")
        # a slab is in one task, so the rows of single titles are never moved
        placed = placed.repartition(-(-n_rows // TASK_TITLES) or 1, "slab")
        listed = placed.select("slab", F.expr("shiftleft(1L, place)").alias("bit"), F.explode(runs_of(F.lower("title"))).alias("run"))
        masks = listed.groupBy("slab", "run").agg(F.bit_or("bit").alias("mask")).withColumn("bucket", _bucket(F.col("run")))
        # by slabs too: the list of a run that nearly every title holds is written by many tasks
        files = -(-n_rows // FILE_TITLES) or 1
        spread = masks.repartition(BUCKETS * files, "bucket", F.pmod(F.xxhash64("slab"), F.lit(files))).sortWithinPartitions("bucket", "run", "slab")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/lists/batch={batch_id}")
        written = self.spark.read.schema("run string, mask bigint, bucket int").parquet(f"{self.root}/lists/batch={batch_id}")
        lengths = written.groupBy("bucket", "run").agg(F.sum(F.bit_count("mask").cast("bigint")).alias("n")).repartition("bucket")
        lengths.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/lengths/batch={batch_id}")
        self.titles.append(rows.drop("at"), n_rows, batch_id)

    def _of(self, name: str, columns: str, runs: list[str]) -> DataFrame:
        """Rows of the lists or lengths of some runs: other folders are not opened, other runs skipped by the scan."""
        buckets = self.spark.createDataFrame([(r,) for r in runs], "run string").select(_bucket(F.col("run")).alias("b"))
        wanted = sorted({r["b"] for r in buckets.collect()})
        rows = self.spark.read.schema(f"{columns}, batch int, bucket int").parquet(f"{self.root}/{name}")
        return rows.filter(F.col("bucket").isin(wanted) & F.col("run").isin(runs))

    def candidates(self, query: str) -> DataFrame | None:
        """Ids on all lists of the query's rarest runs; None for a query too short to have a run."""
        low = self.spark.createDataFrame([(query,)], "q string").select(F.lower("q").alias("low"))
        runs = low.select(runs_of(F.col("low")).alias("r")).first()["r"]
        if not runs:
            return None
        found = self._of("lengths", "run string, n bigint", runs).groupBy("run").agg(F.sum("n").alias("n")).collect()
        lengths = {r["run"]: r["n"] for r in found}  # one number for each run of the query
        if len(lengths) < len(runs):
            return self.spark.createDataFrame([], "id bigint")
        rarest = sorted(runs, key=lambda r: (lengths[r], r))[:RAREST]
        lists = self._of("lists", "run string, slab bigint, mask bigint", rarest)
        # bit_and of a slab counts only if each of the runs has a row for it
        on_all = lists.groupBy("batch", "slab").agg(F.bit_and("mask").alias("mask"), F.count(F.lit(1)).alias("n"))
        on_all = on_all.filter((F.col("n") == len(rarest)) & (F.col("mask") != 0)).select("batch", "slab", "mask")
        slabs = self.spark.read.schema("slab bigint, titles array<struct<place:int,id:bigint>>, batch int").parquet(f"{self.root}/slabs")
        found = on_all.join(slabs, ["batch", "slab"]).select("mask", F.explode("titles").alias("t"))
        return found.filter(F.expr("shiftrightunsigned(mask, t.place) & 1 = 1")).select("t.id").distinct()

    def search(self, query: str) -> DataFrame:
        """(id, title) of the titles that contain the query in any case; all of them for a blank query."""
        at = self.titles.newest()
        if not query.strip():
            return self.titles.read(at)
        matches = F.contains(F.lower("title"), F.lower(F.lit(query)))
        ids = self.candidates(query) if at >= 0 else None
        if ids is None:
            return self.titles.read(at).filter(matches)
        ids = stored(ids, "candidates")
        return self.titles.look_up(ids, ids.count(), at + 1).filter(matches)


def search_all(index: TitleIndex, queries: list[str]) -> DataFrame:
    """(query, id) for each of a few queries."""
    parts = [index.search(q).select(F.lit(q).alias("query"), "id") for q in queries]
    return reduce(DataFrame.unionByName, parts)
