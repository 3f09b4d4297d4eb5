"""Streams over files that arrive one after another must end where the batch job ends."""

import datetime
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hemline.operators import balance, chats, runs
from hemline.streaming import incremental as inc
from hemline.streaming import limits

CALLS = "key_id bigint, ts timestamp, event_id bigint, ok boolean"
START = datetime.datetime(2024, 3, 1)


def arrive(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(f"{folder}/{name}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/*")


def calls():
    data, i = [], 0
    for key, pattern in {1: "SFFFFFFFFFF", 2: ("F" * 9 + "S") * 6, 3: "FSFS"}.items():
        for c in pattern:
            data.append((key, START + datetime.timedelta(minutes=i), i, c == "S"))
            i += 1
    return data


def stops(spark, root):
    return spark.read.schema(limits.STOPS).parquet(f"{root}/out/stops")


@pytest.mark.parametrize("slice_seconds, parts", [(60, 2), (10**9, 3)])
def test_failure_runs_over_batches(spark, tmp_path, rows, slice_seconds, parts):
    data, root = calls(), str(tmp_path)
    for n, at in enumerate(range(0, len(data), 17)):
        arrive(spark, f"{root}/in", f"f{n}", data[at : at + 17], CALLS)
    half = stream(spark, f"{root}/in", CALLS)
    options = {"max_total": 40, "slice_seconds": slice_seconds, "parts": parts}
    limits.stream_failure_runs(half, f"{root}/out", f"{root}/cp", **options)
    # a second run starts from the checkpoint and the state store of the first
    more = [(k, ts + datetime.timedelta(days=1), i + 1000, ok) for k, ts, i, ok in data]
    arrive(spark, f"{root}/in", "late", more, CALLS)
    limits.stream_failure_runs(half, f"{root}/out", f"{root}/cp", **options)
    batch = runs.failure_runs(spark.createDataFrame(data + more, CALLS), ["ts", "event_id"], max_total=40).filter("first_stop")
    got = stops(spark, root)
    assert rows(got, "key_id", "ts", "event_id", "stop") == rows(batch, "key_id", "ts", "event_id", "stop")
    assert got.count() == 2
    counters = {r["key_id"]: (r["total"], r["stopped"]) for r in limits.read_counters(spark, f"{root}/cp").collect()}
    assert counters[3] == (4, False) and counters[1][1] and counters[2][1]


def test_a_batch_writes_the_state_of_its_own_keys(spark, tmp_path):
    root = str(tmp_path)
    many = [(k, START, k, False) for k in range(200)]
    arrive(spark, f"{root}/in", "a", many, CALLS)
    limits.stream_failure_runs(stream(spark, f"{root}/in", CALLS), f"{root}/out", f"{root}/cp")
    arrive(spark, f"{root}/in", "b", [(5, START, 900, False), (6, START, 901, True), (None, START, 902, False)], CALLS)
    query = limits.stream_failure_runs(stream(spark, f"{root}/in", CALLS), f"{root}/out", f"{root}/cp")
    state = query.recentProgress[0]["stateOperators"][0]
    assert state["numRowsUpdated"] <= 2
    counters = {r["key_id"]: r["consecutive"] for r in limits.read_counters(spark, f"{root}/cp").collect()}
    assert len(counters) == 200 and counters[5] == 2 and counters[6] == 0 and counters[7] == 1


def test_a_silent_key_is_forgotten_by_its_timer(spark, tmp_path):
    root = str(tmp_path)
    for n, key in enumerate([1, 2, 2]):
        arrive(spark, f"{root}/in", f"f{n}", [(key, START, n, False)] * 3, CALLS)
        limits.stream_failure_runs(stream(spark, f"{root}/in", CALLS), f"{root}/out", f"{root}/cp", forget_ms=1)
    counters = {r["key_id"]: r["total"] for r in limits.read_counters(spark, f"{root}/cp").collect()}
    assert 1 not in counters


def test_sliced_and_fold_equal_a_plain_loop():
    import random

    rnd = random.Random(4)
    for trial in range(200):
        most, total = rnd.randint(1, 6), rnd.randint(1, 12)
        rows_ = [(rnd.randint(0, 2), rnd.randint(0, 30), i, rnd.random() < 0.35) for i in range(rnd.randint(1, 60))]
        want, run, seen = {}, {}, {}
        for key, at, event, ok in sorted(rows_, key=lambda r: (r[1], r[2])):
            run[key] = 0 if ok else run.get(key, 0) + 1
            seen[key] = seen.get(key, 0) + (not ok)
            stop = "consecutive" if run[key] >= most and not ok else "total" if seen[key] >= total and not ok else None
            if stop and key not in want:
                want[key] = (at, event, stop)
        table = pa.table({"key_id": [r[0] for r in rows_], "slice": [r[1] // 7 for r in rows_], "at": [r[1] for r in rows_], "event_id": [r[2] for r in rows_], "ok": [r[3] for r in rows_]})
        got = {}
        state = {}
        for s in limits.sliced(table, most, total).to_pandas().sort_values(["key_id", "slice"]).itertuples(index=False):
            state[s.key_id], found = limits.fold(state.get(s.key_id, (0, 0)), s, most, total)
            if found and s.key_id not in got:
                got[s.key_id] = (s.at[found[0] - 1], s.ids[found[0] - 1], found[2])
        assert got == want


def test_new_items_are_handed_out_once(spark, tmp_path, rows):
    root, schema = str(tmp_path), "item string, ts timestamp"
    arrive(spark, f"{root}/in", "a", [("x", START), ("y", START), ("x", START), (None, START)], schema)
    inc.stream_new_items(stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/cp")
    arrive(spark, f"{root}/in", "b", [("y", START), ("z", START)], schema)
    inc.stream_new_items(stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/cp")
    assert rows(inc.ledger(spark, f"{root}/out"), "item") == [("x",), ("y",), ("z",)]
    assert inc.ledger_table(spark, f"{root}/out").opened(1) == {"0": 1}


def test_new_items_open_no_old_ledger_file(spark, tmp_path, rows):
    root, schema = str(tmp_path), "item string, ts timestamp"
    sizes = {"page_rows": 64, "fanout": 100}
    for n in range(3):
        arrive(spark, f"{root}/in", f"f{n}", [(f"{n}-{i}", START) for i in range(300)], schema)
        inc.stream_new_items(stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/cp", **sizes)
    table = inc.ledger_table(spark, f"{root}/out", **sizes)
    live = table.runs(2)
    assert [r.bits for r in live] == [3, 3, 3]
    # filters of 10 bits a key: of 300 new items few are held for old ones, of 8 pages a run some are never opened
    assert sum(table.opened(2).values()) < 16
    few = [("fresh-1", START)]
    arrive(spark, f"{root}/in", "g", few, schema)
    for folder, _, files in os.walk(f"{root}/out"):
        if "/rows/" in folder:
            for f in files:  # nothing that is older may be opened now
                if f.endswith(".parquet"):
                    with open(f"{folder}/{f}", "r+b") as old:
                        old.write(b"no")
    inc.stream_new_items(stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/cp", **sizes)
    assert table.opened(3) == {}
    assert rows(table._rows(table.runs(3)[-1]), "item") == [("fresh-1",)]


def test_runs_are_merged_in_levels(spark, tmp_path, rows):
    root, schema = str(tmp_path), "item string, ts timestamp"
    sizes = {"page_rows": 8, "fanout": 2}
    for n in range(7):
        arrive(spark, f"{root}/in", f"f{n}", [(f"i{i}", START + datetime.timedelta(days=n)) for i in range(5 * n, 5 * n + 10)], schema)
    inc.stream_new_items(stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/cp", **sizes)
    table = inc.ledger_table(spark, f"{root}/out", **sizes)
    live = table.runs(table.newest())
    assert [(r.level, r.first, r.last) for r in live] == [(2, 0, 3), (1, 4, 5), (0, 6, 6)]
    got = {r["item"]: r["first_seen"].day for r in table.read().collect()}
    assert got == {f"i{i}": max(0, i // 5 - 1) + 1 for i in range(40)}


def test_filters_hold_what_they_were_made_of():
    import numpy as np

    from hemline.streaming.levels import bloom, may_hold

    rng = np.random.default_rng(0)
    for n in (0, 1, 10, 5000):
        held, other = rng.integers(-(2**63), 2**63 - 1, (2, n + 2000))
        held = held[:n]
        f = bloom(held)
        assert may_hold(f, held).all() and len(f) < 8 + 1.3 * n + 16
        assert may_hold(f, other).mean() < 0.05


def test_daily_usage_resets(spark, tmp_path, rows):
    root, schema = str(tmp_path), "ts timestamp, key_id bigint"
    day = datetime.timedelta(days=1)
    for name, data in {"a": [(START, 1)] * 3, "b": [(START, 1), (START + day, 1)], "c": [(START + day, 2)]}.items():
        arrive(spark, f"{root}/in", name, data, schema)
        inc.stream_daily_usage(stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/cp")
    got = inc.daily_usage(spark, f"{root}/out", 3).select(F.date_format("day", "dd"), "key_id", "used", "over_cap")
    assert rows(got) == [("01", 1, 4, 1), ("02", 1, 1, 0), ("02", 2, 1, 0)]


def test_balance_follows_arrivals(spark, tmp_path, rows):
    root = str(tmp_path)
    for name, data in {"a": [("p",), ("p",), ("q",)], "b": [("q",), ("q",), ("zz",)]}.items():
        arrive(spark, f"{root}/in", name, data, "category string")
        inc.stream_balance(stream(spark, f"{root}/in", "category string"), ["p", "q", "r"], f"{root}/out", f"{root}/cp")
    counts = spark.createDataFrame([("p", 0, 2), ("q", 1, 3), ("r", 2, 0)], "category string, pos int, n bigint")
    want = rows(balance.balance_gaps(counts), "category", "n", "gap", "priority")
    assert rows(inc.latest_batch(spark, f"{root}/out", inc.GAPS), "category", "n", "gap", "priority") == want


def test_balance_commits_the_state_of_partitions_no_category_is_in(spark, tmp_path, rows):
    root = str(tmp_path)
    conf = {"spark.sql.shuffle.partitions": "13", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as with inputs of any size
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        arrive(spark, f"{root}/in", "a", [(f"c{i}",) for i in range(60)] + [("p",), (None,)], "category string")
        inc.stream_balance(stream(spark, f"{root}/in", "category string"), ["p", "q"], f"{root}/out", f"{root}/cp")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert rows(inc.latest_batch(spark, f"{root}/out", inc.GAPS), "category", "n", "gap", "priority") == [("p", 1, 0, 2), ("q", 0, 1, 1)]


def test_chat_state_over_batches(spark, tmp_path, rows):
    root, schema = str(tmp_path), "op string, id string, title string, user_id string, ts timestamp, seq bigint"
    ops = [("insert", "a"), ("insert", "b"), ("update", "a"), ("delete", "b"), ("update", "b"), ("insert", "b"), ("update", "b"), ("delete", "a")]
    data = [(op, i, f"t{n}", "u", START + datetime.timedelta(hours=n), n) for n, (op, i) in enumerate(ops)]
    for n in range(0, len(data), 3):
        arrive(spark, f"{root}/in", f"f{n}", data[n : n + 3], schema)
        inc.stream_chat_state(stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/cp")
    empty = spark.createDataFrame([], inc.CHATS)
    assert rows(inc.chat_state(spark, f"{root}/out")) == rows(chats.apply_changes(empty, spark.createDataFrame(data, schema)))


def written(root):
    """Bytes of row pages by run."""
    out = {}
    for folder, _, files in os.walk(root):
        if "/rows/" in folder:
            run = folder.split("/run=")[1].split("/")[0]
            out[run] = out.get(run, 0) + sum(os.path.getsize(f"{folder}/{f}") for f in files)
    return out


def test_a_batch_writes_its_own_chats_alone(spark, tmp_path):
    root, schema = str(tmp_path), "op string, id string, title string, user_id string, ts timestamp, seq bigint"
    first = [("insert", f"c{i}", f"title {i}", "u", START, i) for i in range(3000)]
    later = [("update", "c7", "new", "u", START, 9001), ("delete", "c8", "", "u", START, 9002), ("delete", "c9", "", "other", START, 9003), ("update", "none", "", "u", START, 9004)]
    for n, data in enumerate([first, later]):
        arrive(spark, f"{root}/in", f"f{n}", data, schema)
        inc.stream_chat_state(stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/cp")
    size = written(f"{root}/out")
    assert size["1"] < size["0"] / 5
    state = {r["id"]: r["title"] for r in inc.chat_state(spark, f"{root}/out").collect()}
    assert state == {f"c{i}": "new" if i == 7 else f"title {i}" for i in range(3000) if i != 8}


def test_deleted_chats_stay_deleted_through_merges(spark, tmp_path, rows):
    root, schema = str(tmp_path), "op string, id string, title string, user_id string, ts timestamp, seq bigint"
    ops = [("insert", "a"), ("insert", "b"), ("delete", "a"), ("update", "b"), ("insert", "a"), ("delete", "b"), ("update", "a")]
    data = [(op, i, f"t{n}", "u", START + datetime.timedelta(hours=n), n) for n, (op, i) in enumerate(ops)]
    for n, row in enumerate(data):
        arrive(spark, f"{root}/in", f"f{n}", [row], schema)
    inc.stream_chat_state(stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/cp", fanout=2, page_rows=1)
    table = inc.chat_table(spark, f"{root}/out")
    for n in range(len(data)):  # also what each batch left, read through the runs that were live then
        want = chats.apply_changes(spark.createDataFrame([], inc.CHATS), spark.createDataFrame(data[: n + 1], schema))
        assert rows(table.read(n)) == rows(want)
    assert len(table.runs(len(data) - 1)) < 4


def test_missing_state_is_an_error(spark, tmp_path):
    assert inc.read_state(spark, f"{tmp_path}/none", inc.CHATS, -1).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        inc.read_state(spark, f"{tmp_path}/none", inc.CHATS, 40).count()
    assert inc.chat_state(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        inc.chat_table(spark, f"{tmp_path}/none").runs(40)


def test_late_calls_count(spark, tmp_path, rows):
    root, schema = str(tmp_path), "ts timestamp, key_id bigint"
    for name, day in {"a": 9, "b": 1, "c": 30, "d": 1}.items():
        arrive(spark, f"{root}/in", name, [(START + datetime.timedelta(days=day), 1)] * 2, schema)
        inc.stream_daily_usage(stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/cp")
    assert rows(inc.daily_usage(spark, f"{root}/out", 3), "used", "over_cap") == [(2, 0), (2, 0), (4, 1)]


def test_page_flow_as_pages_arrive(spark, tmp_path, rows):
    import random

    from hemline.operators.pages import page_flow
    from hemline.streaming import crawl

    rnd, root, schema = random.Random(2), str(tmp_path), "site string, page_no int, url string, has_next boolean"
    data = []
    for site, n_pages, pool in (("big", 30, 200_000), ("small", 12, 6), ("ends", 5, 50), ("big2", 9, 40_000)):
        for page in range(1, n_pages + 1):
            urls = [f"{site}/{rnd.randrange(pool)}" for _ in range(rnd.randint(0, 6))] or [None]
            data += [(site, page, u, not (site == "ends" and page == 4)) for u in urls]
    for name, low, high in (("a", 0, 3), ("b", 3, 10), ("c", 10, 99)):
        arrive(spark, f"{root}/in", name, [r for r in data if low < r[1] <= high], schema)
        # a run for each arrival: from the checkpoint and the bitmaps of the one before
        crawl.stream_page_flow(stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/cp", fanout=2)
    want = page_flow(spark.createDataFrame(data, schema))
    assert rows(crawl.flow(spark, f"{root}/out")) == rows(want)
    totals = {r["site"]: r["n"] for r in crawl.distinct_urls(spark, f"{root}/out").collect()}
    ends = {r["site"]: max(r["total"], 0) for r in want.orderBy("page_no").collect()}
    assert all(totals[s] >= ends[s] for s in totals) and totals["big"] == ends["big"]


def test_pages_of_the_flow_query_are_written_by_many_tasks(spark, monkeypatch):
    import os

    from checks import streams
    from checks.registry import QUERIES

    pages = spark.range(300).selectExpr("'s' AS site", "id + 1 AS page_no", "id AS page_id", "'x' AS html").repartition(6)
    files = []
    monkeypatch.setattr(streams, "numbered_pages", lambda *_: pages)
    monkeypatch.setattr(streams, "links_of", lambda df: df)
    monkeypatch.setattr(streams, "stored", lambda df, name: df)
    count = lambda root: len([f for f in os.listdir(os.path.dirname(root) + "/pages") if f.endswith(".parquet")])
    monkeypatch.setattr(streams.crawl, "stream_page_flow", lambda _, root, checkpoint: files.append(count(root)))
    monkeypatch.setattr(streams.crawl, "flow", lambda *_: None)
    QUERIES["ext_04_page_flow_stream"](spark, "")
    assert files[-1] > 3 and len(files) == 3
