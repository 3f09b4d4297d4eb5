"""Title search through the index against a plain scan."""

import os

from hemline.functions import text as T
from hemline.operators.title_index import TitleIndex
from pyspark.sql import functions as F

TITLES = "id bigint, title string, gone boolean"


def test_search_equals_a_scan_over_batches(spark, tmp_path):
    words = ["Summer", "winter", "ÉTÉ", "sale", "Sa", "a", "the an", "😀😀x", "100%", "İstanbul"]
    first = [(i, " ".join(words[(i * k) % len(words)] for k in (1, 3, 7)), False) for i in range(200)] + [(500, None, False), (None, "Summer", False)]
    second = [(3, "renamed", False), (4, "", True), (900, "brand new Summer", False), (5, "summer summer", False)]
    index = TitleIndex(spark, f"{tmp_path}/index", page_rows=64)
    now = {}
    for n, batch in enumerate([first, second]):
        index.add(spark.createDataFrame(batch, TITLES), n)
        now |= {i: t or "" for i, t, _ in batch if i is not None}
        for i, _, gone in batch:
            if gone:
                now.pop(i)
    df = spark.createDataFrame(list(now.items()), "id bigint, title string")
    for q in ("summer", "SUMMER W", "été", "a", "sa", "  ", "the an", "😀😀x", "0%", "renamed", "nowhere", "istan", "İSTAN"):
        want = sorted(r["id"] for r in df.filter(T.title_matches(F.col("title"), q)).collect())
        assert sorted(r["id"] for r in index.search(q).collect()) == want, q


def test_a_search_opens_the_lists_of_its_own_runs(spark, tmp_path):
    index = TitleIndex(spark, f"{tmp_path}/index")
    index.add(spark.createDataFrame([(i, f"title number {i}", False) for i in range(300)] + [(999, "zebra", False)], TITLES), 0)
    wanted = {r["b"] for r in spark.createDataFrame([("zeb",), ("ebr",), ("bra",)], "run string").select(F.pmod(F.xxhash64("run"), F.lit(64)).alias("b")).collect()}
    for folder, _, files in os.walk(f"{tmp_path}/index/lists"):
        if "bucket=" in folder and int(folder.split("bucket=")[1]) not in wanted:
            for f in files:  # nothing else may be opened
                if f.endswith(".parquet"):
                    with open(f"{folder}/{f}", "r+b") as other:
                        other.write(b"no")
    assert [r["id"] for r in index.search("ZEBRA").collect()] == [999]


def test_a_list_has_a_row_a_slab_of_titles(spark, tmp_path):
    index = TitleIndex(spark, f"{tmp_path}/index")
    titles = spark.createDataFrame([(i * 1000, f"title number {i}", i % 3 == 0) for i in range(1000)], TITLES).coalesce(1)
    index.add(titles, 0)
    rows = spark.read.parquet(f"{tmp_path}/index/lists").filter("run = 'num'")
    assert rows.count() <= 16  # 1000 titles, 64 a slab
    lengths = spark.read.parquet(f"{tmp_path}/index/lengths").filter("run = 'num'")
    assert lengths.first()["n"] == sum(i % 3 > 0 for i in range(1000))  # counted in titles
    want = [i * 1000 for i in range(1000) if i % 3 and "77" in str(i)]
    assert sorted(r["id"] for r in index.search("77").collect()) == want  # too short for a run
    want = [i * 1000 for i in range(1000) if i % 3 and str(i).startswith("77")]
    assert sorted(r["id"] for r in index.search("number 77").collect()) == want
