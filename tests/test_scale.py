"""Split groups, draws and splits against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hemline.operators import chats, naming, runs, scale


def skewed(spark, n=600):
    """A third of the rows under one key, some under none."""
    rnd = random.Random(5)
    data = [(rnd.choice(["hot", "hot", "a", "b", "c", None]), i, rnd.randint(0, 9)) for i in range(n)]
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "k string, t int, v int").repartition(5)


@pytest.mark.parametrize("hot_rows", [0, 10_000])
def test_ranks_and_running_values(spark, hot_rows):
    data, df = skewed(spark)
    ordered = scale.Ordered(df, ["k"], ["t"], hot_rows).rank("r")
    ordered.running(total=("sum", F.col("v")), top=("max", F.col("v")), low=("min", F.when(F.col("v") > 3, F.col("v"))))
    got = {r["t"]: (r["r"], r["total"], r["top"], r["low"]) for r in ordered.done().collect()}
    groups = defaultdict(list)
    for k, t, v in sorted(data, key=lambda x: x[1]):
        g = groups[k]
        g.append(v)
        big = [x for x in g if x > 3]
        assert got[t] == (len(g), sum(g), max(g), min(big) if big else None)
    assert ordered.split == (hot_rows == 0)


def test_repeated_covers_every_index(spark, rows):
    df = spark.createDataFrame([("a", 25), ("b", 0), ("c", 1), ("d", 10)], "k string, n int")
    got = rows(scale.repeated(df, "n", "i", chunk=10), "k", "i")
    assert got == sorted([(k, i) for k, n in [("a", 25), ("c", 1), ("d", 10)] for i in range(n)], key=repr)


@pytest.mark.parametrize("prefix", [1, 5])
def test_smallest_share_has_exact_size(spark, prefix):
    df = spark.range(997).withColumn("g", F.when(F.col("id") < 600, "big").otherwise("small"))
    marked = scale.smallest_share(df, ["g"], F.col("id"), 0.1, "7", "pick", prefix)
    assert {r["g"]: r["n"] for r in marked.filter("pick").groupBy("g").agg(F.count("*").alias("n")).collect()} == {
        "big": 60, "small": 39,
    }
    assert marked.count() == 997
    none = scale.smallest_share(spark.range(5), [], F.col("id"), 0.1, "7", "pick", prefix)
    assert none.filter("pick").count() == 0


def brute_names(files, prefix):
    taken = set()
    for f in files:
        stem, _, ext = f.lower().rpartition(".")
        if stem.startswith(prefix + "_") and stem[len(prefix) + 1 :].isdigit() and stem[len(prefix) + 1] != "0":
            taken.add(int(stem[len(prefix) + 1 :]))
    out, i = {}, 0
    for f in sorted(files, key=lambda x: (x.lower(), x)):
        i += 1
        while i in taken:
            i += 1
        out[f] = f"{prefix}_{i}.{f.lower().rpartition('.')[2]}"
    return out


@pytest.mark.parametrize("hot_rows", [0, 10_000])
def test_assign_names_skips_taken_numbers(spark, hot_rows):
    files = ["b.JPG", "a.png", "sm_2.jpg", "sm_3.jpg", "SM_7.jpg", "z.webp", "sm_x.jpg", "c.jpg", "sm_02.jpg"]
    df = spark.createDataFrame([("Summer_Men", f) for f in files], "category string, filename string")
    prefixes = spark.createDataFrame([("Summer_Men", "sm")], "category string, prefix string")
    got = {r["filename"]: r["new_name"] for r in naming.assign_names(df, prefixes, hot_rows).collect()}
    assert got == brute_names(files, "sm")
    assert len(set(got.values())) == len(files)


@pytest.mark.parametrize("hot_rows", [0, 10_000])
def test_next_index(spark, rows, hot_rows):
    existing = spark.createDataFrame(
        [("a", "a_4.jpg"), ("a", "a_9.png"), ("a", "a_x.jpg"), ("b", "other.jpg")], "category string, filename string"
    )
    new = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("b", "m1"), ("c", "k1")], "category string, filename string")
    assert rows(naming.next_index(existing, new, ["filename"], hot_rows), "category", "filename", "index") == [
        ("a", "n1", 5), ("a", "n2", 6), ("b", "m1", 0), ("c", "k1", 0),
    ]


@pytest.mark.parametrize("hot_rows", [0, 10_000])
def test_confirm_pending_cancels_one_for_one(spark, rows, hot_rows):
    server = spark.createDataFrame(
        [(1, "user", "hi", 1), (1, "user", "hi", 2), (1, "assistant", "yo", 3)], "chat_id int, role string, content string, seq int"
    )
    local = spark.createDataFrame(
        [(1, "user", "hi", 11), (1, "user", "hi", 12), (1, "user", "hi", 13), (1, "assistant", "y", 14), (2, "user", "hi", 15)],
        "chat_id int, role string, content string, seq int",
    )
    out = chats.confirm_pending(server, local, ["seq"], hot_rows).filter("origin = 'local'")
    assert rows(out, "chat_id", "content", "seq") == [(1, "hi", 13), (1, "y", 14), (2, "hi", 15)]


@pytest.mark.parametrize("hot_rows", [0, 10_000])
def test_failure_runs_limits(spark, hot_rows):
    data = []
    for key, pattern in {1: "FFFFFFFFFSFFFFFFFFFFF", 2: ("F" * 9 + "S") * 7, 3: "SSFS"}.items():
        data += [(key, i, c == "S") for i, c in enumerate(pattern)]
    calls = spark.createDataFrame(data, "key_id int, t int, ok boolean")
    out = runs.failure_runs(calls, ["t"], hot_rows=hot_rows)
    first = {r["key_id"]: (r["t"], r["stop"], r["consecutive"], r["total_failures"]) for r in out.filter("first_stop").collect()}
    assert first == {1: (19, "consecutive", 10, 19), 2: (54, "total", 5, 50)}
    assert out.count() == len(data)


def test_small_side_checks_its_size(spark):
    df = spark.range(10)
    hinted = scale.small_side(df, 10)._jdf.queryExecution().analyzed().toString()
    plain = scale.small_side(df, 9)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hinted and "broadcast" not in plain


@pytest.mark.parametrize("hot_rows", [20, 10_000])
def test_attach_deals_hot_keys_and_loses_nothing(spark, rows, hot_rows):
    data, df = skewed(spark)
    facts = spark.createDataFrame([("hot", 1), ("a", 2), ("zz", 3)], "k string, fact int")
    got = rows(scale.attach(df, facts, "k", hot_rows), "k", "t", "fact")
    assert got == sorted([(k, t, {"hot": 1, "a": 2}.get(k)) for k, t, _ in data], key=repr)


def test_attach_deals_equal_rows_and_maps(spark):
    df = spark.createDataFrame([("hot", {"m": 1})] * 50 + [("a", None)], "k string, m map<string,int>").repartition(1)
    facts = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, fact int")
    got = scale.attach(df, facts, "k", 5)
    assert got.select("k", "fact").distinct().count() == 2 and got.count() == 51


def test_slabs_grow_with_the_rows(spark):
    slabs = {}
    for n in (3_000, 30_000):
        df = spark.range(n).select(F.lit("one").alias("k"), "id")
        ordered = scale.Ordered(df, ["k"], ["id"], hot_rows=10, slab_rows=100)
        slabs[n] = ordered.df.select("_slab").distinct().count()
        ranks = ordered.rank("r").done()
        assert ranks.filter("r <> id + 1").count() == 0 and ranks.count() == n
    assert 0.8 < slabs[30_000] / slabs[3_000] / 10 < 1.2
