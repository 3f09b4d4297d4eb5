"""Conversation store: scoped reads, recency, context, change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemline.functions import text
from hemline.operators.scale import HOT_ROWS, Ordered, attach, first_n, largest_group, ranked
from hemline.session import stored


def recent_chats(chats: DataFrame, limit: int) -> DataFrame:
    return chats.orderBy(F.desc("updated_at"), F.asc("id")).limit(limit)


def chat_messages(messages: DataFrame, chat_id, order: list[str], limit: int) -> DataFrame:
    return messages.filter(F.col("chat_id") == chat_id).orderBy(*order).limit(limit)


def oldest_n(messages: DataFrame, n: int, order: list[str]) -> DataFrame:
    return first_n(messages, ["chat_id"], order, n)


def chat_with_messages(chats: DataFrame, messages: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Chats with their first ``limit`` messages as an ordered array, empty for chats without any."""
    kept = oldest_n(messages, limit, order)
    fields = [c for c in messages.columns if c != "chat_id"]
    nested = kept.groupBy("chat_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("messages")
    )
    joined = chats.join(nested, chats["id"] == nested["chat_id"], "left").drop("chat_id")
    empty = F.array().cast(nested.schema["messages"].dataType)
    return joined.withColumn("messages", F.coalesce("messages", empty))


def visible_messages(messages: DataFrame, chats: DataFrame, user_id) -> DataFrame:
    """Messages of the chats ``user_id`` owns; ownership comes from the parent chat alone."""
    mine = chats.filter(F.col("user_id") == user_id).select(F.col("id").alias("chat_id"))
    return messages.join(mine, "chat_id", "left_semi")


def delete_cascade(chats: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats and messages left after the chats in ``ids`` (column id) are deleted."""
    gone = ids.select("id")
    return (
        chats.join(gone, "id", "left_anti"),
        messages.join(gone, messages["chat_id"] == gone["id"], "left_anti"),
    )


def context_window(messages: DataFrame, order: list[str], n: int = 10, skip_system: bool = True) -> DataFrame:
    """Last ``n`` messages per chat in their own order, numbered from 1 in ``place``; by default without system rows."""
    latest = [F.desc(c) for c in order]
    said = messages.filter("role <> 'system'") if skip_system else messages
    kept = first_n(said, ["chat_id"], latest, n, "_back")
    size = F.count(F.lit(1)).over(Window.partitionBy("chat_id"))
    return kept.withColumn("place", size - F.col("_back") + 1).drop("_back")


def with_frame(context: DataFrame, system_text: str, current: DataFrame | None = None) -> DataFrame:
    """Context rows (chat_id, place, role, text) with the system message first and the current user message last."""
    rows = context.select("chat_id", F.col("place").cast("bigint").alias("place"), "role", "text")
    heads = rows.select("chat_id")
    if current is not None:
        heads = heads.union(current.select("chat_id"))
    system = heads.distinct().select(
        "chat_id", F.lit(0).cast("bigint").alias("place"), F.lit("system").alias("role"), F.lit(system_text).alias("text")
    )
    out = rows.unionByName(system)
    if current is not None:
        last = current.select(
            "chat_id", F.lit(2**62).cast("bigint").alias("place"), F.lit("user").alias("role"), "text"
        )
        out = out.unionByName(last)
    return out


def render_conversation(rows: DataFrame) -> DataFrame:
    """Chat-markup prompt per chat from its context rows (at most the context size plus two per chat)."""
    known = rows.filter(F.col("role").isin("system", "user", "assistant"))
    block = F.concat(
        F.lit("<|start_header_id|>"), "role", F.lit("<|end_header_id|>\n\n"), "text", F.lit("<|eot_id|>")
    )
    parts = F.array_sort(F.collect_list(F.struct("place", block.alias("block"))))
    return known.groupBy("chat_id").agg(parts.alias("parts")).select(
        "chat_id",
        F.concat(
            F.lit("<|begin_of_text|>"),
            F.array_join(F.col("parts.block"), ""),
            F.lit("<|start_header_id|>assistant<|end_header_id|>\n\n"),
        ).alias("prompt"),
    )


def latest_media(messages: DataFrame, order: list[str], within_first: int | None = None) -> DataFrame:
    """Per chat the newest row that has a URL and is no video. ``within_first`` looks at the oldest n rows only."""
    if within_first:
        messages = oldest_n(messages, within_first, order).drop("rank")
    fits = messages.filter(F.col("s3_url").isNotNull() & (F.col("s3_url") != "") & (F.col("message_type") != "video"))
    rest = [c for c in messages.columns if c != "chat_id"]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return fits.groupBy("chat_id").agg(newest).select("chat_id", "_row.*")


def confirm_pending(
    server: DataFrame, local: DataFrame, order: list[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Local rows the server has not confirmed: each server row cancels one local row of equal role and content.

    Of equal local rows the earliest are cancelled. Result rows are the server's, then the surviving local ones.
    """
    key = ["chat_id", "role", "content"]
    confirmed = server.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    numbered = ranked(local, key, order, "_i", hot_rows)
    rest = numbered.join(confirmed, key, "left").filter(F.col("_i") > F.coalesce("_n", F.lit(0)))
    return server.withColumn("origin", F.lit("server")).unionByName(
        rest.drop("_i", "_n").withColumn("origin", F.lit("local"))
    )


def apply_changes(base: DataFrame, log: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Chats after a change log (op insert/update/delete, id, title, user_id, ts, seq) in (ts, seq) order.

    The log's user acts; the owner of a chat is the user who inserted it. Updates of the owner set the title and
    updated_at, a delete of the owner ends the chat, and an insert after it, by whomever, starts a new one. What other users
    do to a chat changes nothing, nor do inserts of a living chat, changes of a missing one, and rows without a user or id.

    A chat's lives are a chain: the owner's next delete ends a life, the next insert starts one. Where each insert leads
    follows from running counts, which may be split over many tasks; the ends of the chains are found by doubling. Updates
    are combined per id before they are shuffled and dealt to several tasks where they are joined.
    """
    log = log.filter("user_id IS NOT NULL AND id IS NOT NULL").withColumn("seq", F.col("seq").cast("bigint"))
    when = F.struct("ts", "seq")
    lives = _last_lives(base, log, hot_rows)
    owned = lives.select("id", F.col("user_id").alias("_owner"), "_new", "_born")
    later = (
        attach(log.filter("op = 'update'"), owned, "id", hot_rows)
        .filter((F.col("user_id") == F.col("_owner")) & ((F.col("_new") == 0) | (when > F.col("_born"))))
        .groupBy("id")
        .agg(F.max_by("title", when).alias("_title"), F.max("ts").alias("_ts"), F.lit(True).alias("_changed"))
    )
    return lives.join(later, "id", "left").select(
        "id",
        F.when(F.col("_changed"), F.col("_title")).otherwise(F.col("title")).alias("title"),
        "user_id",
        "created_at",
        F.coalesce("_ts", "updated_at").alias("updated_at"),
    )


def _last_lives(base: DataFrame, log: DataFrame, hot_rows: int) -> DataFrame:
    """The life each chat is in after the log: id, title, user_id, created_at, updated_at, ``_new`` (0: from ``base``) and
    ``_born``. Dead chats are left out."""
    chat = ["title", "user_id", "created_at", "updated_at"]
    first = base.select(
        "id", *chat, F.lit(0).alias("_new"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("seq"),
        F.lit(True).alias("_insert"),
    )
    rest = log.filter("op <> 'update'").select(
        "id", "title", "user_id", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.lit(1).alias("_new"), "ts",
        "seq", (F.col("op") == "insert").alias("_insert"),
    )
    steps = stored(first.unionByName(rest), "life-steps")
    order, one = ["_new", "ts", "seq"], F.col("_insert").cast("bigint")
    split = largest_group(steps, ["id"]) > hot_rows
    counted = Ordered(steps, ["id"], order, split=split).running(_n=("sum", one)).done()
    counted = Ordered(counted, ["id", "user_id"], order, split=split).running(_ended=("sum", 1 - one)).done()
    counted = stored(counted, "life-counts")
    born = counted.filter("_insert")
    # a life that starts with insert n of a chat is followed by the insert after its owner's next delete, if there is one
    ends = counted.filter("NOT _insert").select("id", "user_id", (F.col("_ended") - 1).alias("_ended"), (F.col("_n") + 1).alias("_to"))
    next_ = born.join(ends, ["id", "user_id", "_ended"], "left").select("id", "_n", F.coalesce("_to", "_n").alias("_to"))
    next_ = stored(next_, "lives")
    # only chats whose first life ended need to be followed further
    moved = next_.join(next_.filter("_n = 1 AND _to > 1").select("id"), "id", "left_semi")
    most = moved.agg(F.max("_n").alias("n")).first()["n"] or 1
    for _ in range((most - 1).bit_length()):
        ahead = moved.select("id", F.col("_n").alias("_to"), F.col("_to").alias("_on"))
        moved = stored(moved.join(ahead, ["id", "_to"], "left").select("id", "_n", F.coalesce("_on", "_to").alias("_to")), "lives-ahead")
    last = moved.filter("_n = 1").select("id", F.col("_to").alias("_n")).unionByName(
        next_.filter("_n = 1 AND _to = 1").select("id", "_n")
    )
    lives = born.join(last, ["id", "_n"], "left_semi")
    return lives.select("id", *chat, "_new", F.struct("ts", "seq").alias("_born"))


RECENCY = ["Today", "Yesterday", "This week", "This month", "Older"]


def recency_group(changed: Column, created: Column, now: Column, tz: str = "UTC") -> Column:
    """Sidebar group of a chat. Weeks start on Sunday and reach into the future, like months do."""
    day = F.to_date(F.from_utc_timestamp(F.coalesce(changed, created), tz))
    today = F.to_date(F.from_utc_timestamp(now, tz))

    def week(d: Column) -> Column:
        return F.date_sub(d, F.dayofweek(d) - 1)

    return (
        F.when(day == today, RECENCY[0])
        .when(day == F.date_sub(today, 1), RECENCY[1])
        .when(week(day) == week(today), RECENCY[2])
        .when(F.trunc(day, "month") == F.trunc(today, "month"), RECENCY[3])
        .otherwise(RECENCY[4])
    )


def recency_groups(chats: DataFrame, now: Column, tz: str = "UTC") -> DataFrame:
    """Chats with ``recency`` and its place; groups without chats simply do not occur."""
    group = recency_group(F.col("updated_at"), F.col("created_at"), now, tz)
    place = F.array_position(F.array(*[F.lit(g) for g in RECENCY]), F.col("recency"))
    return chats.withColumn("recency", group).withColumn("place", place)


def message_mix(messages: DataFrame) -> DataFrame:
    """Per chat how many messages of each role and type; replies of tools are typed by the tool."""
    kind = F.coalesce(F.col("message_type"), text.message_type_for_tool(F.col("tool")))
    roles = [F.count(F.when(F.col("role") == r, 1)).alias(r) for r in ("system", "user", "assistant")]
    types = [F.count(F.when(F.col("_kind") == t, 1)).alias(t) for t in ("text", "image", "video", "website")]
    return messages.withColumn("_kind", kind).groupBy("chat_id").agg(*roles, *types)
