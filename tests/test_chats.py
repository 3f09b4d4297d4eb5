import pytest
from pyspark.sql import functions as F

from hemline.operators import chats

LOG = "op string, id string, title string, user_id string, ts timestamp, seq bigint"


def replay(base, log):
    state = dict(base)
    for op, id_, title, user, ts, seq in sorted(log, key=lambda r: (r[4], r[5])):
        if op == "insert" and id_ not in state and user is not None:
            state[id_] = (title, user, ts, ts)
        elif id_ in state and state[id_][1] == user and user is not None:
            if op == "update":
                state[id_] = (title, *state[id_][1:3], ts)
            elif op == "delete":
                state.pop(id_)
    return state


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_apply_changes_equals_replay(spark, hot_rows):
    import datetime
    import random

    rnd = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    base = {f"c{i}": (f"b{i}", None if i == 4 else f"u{i % 3}", start, start) for i in range(0, 12, 2)}
    log = []
    for seq in range(400):
        id_ = "c0" if seq % 3 == 0 else f"c{rnd.randint(0, 15)}"
        user = None if seq % 50 == 0 else f"u{rnd.randint(0, 2)}"
        log.append((rnd.choice(["insert", "update", "update", "delete"]), id_, f"t{seq}", user, start + datetime.timedelta(hours=rnd.randint(1, 200)), seq))
    b = spark.createDataFrame([(k, *v) for k, v in base.items()], "id string, title string, user_id string, created_at timestamp, updated_at timestamp")
    got = {r.id: (r.title, r.user_id, r.created_at, r.updated_at) for r in chats.apply_changes(b, spark.createDataFrame(log, LOG), hot_rows).collect()}
    assert got == replay(base, log)


def test_others_change_nothing(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    base = spark.createDataFrame([("a", "mine", "ann", at, at), ("b", "gone", "bob", at, at)], "id string, title string, user_id string, created_at timestamp, updated_at timestamp")
    ops = [("update", "a", "x", "bob"), ("delete", "a", "", "bob"), ("insert", "a", "y", "bob"), ("update", "a", "z", None), ("delete", "b", "", "bob"), ("insert", "b", "new", "ann"), ("update", "b", "old owner", "bob"), ("delete", "b", "", "bob")]
    log = spark.createDataFrame([(*o, at + datetime.timedelta(days=n + 1), n) for n, o in enumerate(ops)], LOG)
    got = {r.id: (r.title, r.user_id, r.updated_at) for r in chats.apply_changes(base, log).collect()}
    assert got == {"a": ("mine", "ann", at), "b": ("new", "ann", at + datetime.timedelta(days=6))}


def test_recency_borders(spark):
    days = ["2024-05-15", "2024-05-14", "2024-05-12", "2024-05-18", "2024-05-11", "2024-05-31", "2024-04-30"]
    df = spark.createDataFrame([(d, None) for d in days], "c string, u string").select(
        F.col("c").cast("timestamp").alias("created_at"), F.col("u").cast("timestamp").alias("updated_at")
    )
    now = F.lit("2024-05-15 12:00:00").cast("timestamp")
    got = [r.recency for r in chats.recency_groups(df, now).orderBy("created_at").collect()]
    want = dict(zip(days, ["Today", "Yesterday", "This week", "This week", "This month", "This month", "Older"]))
    assert got == [want[d] for d in sorted(days)]
    early = F.lit("2024-05-14 20:00:00").cast("timestamp")
    assert df.limit(1).select(chats.recency_group(F.col("updated_at"), F.lit("2024-05-14 19:30:00").cast("timestamp"), early, "Asia/Karachi")).first()[0] == "Today"


def test_context_has_system_first_and_current_last(spark):
    data = [(1, t, "system" if t == 0 else ("user", "assistant")[t % 2], f"m{t}") for t in range(6)] + [(1, 6, "tool", "skip")]
    m = spark.createDataFrame(data, "chat_id int, turn int, role string, text string")
    context = chats.context_window(m, ["turn"], 3)
    now = spark.createDataFrame([(1, "now"), (2, "new")], "chat_id int, text string")
    got = {r.chat_id: r.prompt for r in chats.render_conversation(chats.with_frame(context, "S", now)).collect()}
    assert [got[1].index(x) for x in ("S<", "m4", "m5", "now")] == sorted(got[1].index(x) for x in ("S<", "m4", "m5", "now"))
    assert "m3" not in got[1] and "skip" not in got[1] and got[1].endswith("assistant<|end_header_id|>\n\n")
    assert got[2].count("<|eot_id|>") == 2


def test_latest_media_skips_videos(spark):
    data = [(1, 1, "image", "a"), (1, 2, "text", "b"), (1, 3, "video", "c"), (1, 4, "text", None), (1, 5, "text", "")]
    m = spark.createDataFrame(data, "chat_id int, t int, message_type string, s3_url string")
    assert chats.latest_media(m, ["t"]).first().s3_url == "b"
    assert chats.latest_media(m, ["t"], within_first=1).first().s3_url == "a"
