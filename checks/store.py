"""Conversation store: conversations as messages, orders as chats, lineitem as their messages, events as a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import md5_text, query, table
from hemline.operators import chats
from hemline.session import shared_path
from hemline.sources import chats as chat_tables


def _conv(spark, sf):
    return table(spark, sf, "conversations").withColumnRenamed("conv_id", "chat_id")


def _orders(spark, sf):
    """Orders as chats; one in six was never changed after it was created."""
    o = table(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("user_id"),
        at.alias("created_at"), F.when(F.col("o_orderkey") % 6 > 0, at).alias("updated_at"),
    )


def _lines(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(F.col("l_orderkey").alias("chat_id"), F.col("l_linenumber").alias("turn"), "l_partkey")


@query(
    "src_13_chats_and_messages",
    "SELECT (conv_id % 5)::int AS day, role, count(*) AS n, sum(length(text))::bigint AS chars FROM conversations GROUP BY ALL",
)
def _(spark, sf):
    c = _conv(spark, sf)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("chat_id") % 5) * 86_400 + F.col("turn"))
    rows = c.select(
        F.concat_ws("-", F.col("chat_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("chat_id").cast("string").alias("chat_id"),
        "role", F.col("text").alias("content"), F.lit("text").alias("message_type"), F.lit(None).cast("string").alias("s3_url"),
        F.create_map().cast("map<string,string>").alias("metadata"), at.alias("created_at"),
    )
    path = shared_path(spark, "messages")
    chat_tables.write_messages(rows, path)
    # a filter on the day reads only its folders; both readings together are the whole table
    m = chat_tables.read_messages(spark, path)
    whole = m.filter("day < DATE'2024-01-04'").unionByName(m.filter("day >= DATE'2024-01-04'"))
    return whole.groupBy(F.datediff("day", F.lit("2024-01-01").cast("date")).alias("day"), "role").agg(
        F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")
    )


@query(
    "src_14_city_dim",
    "WITH c AS (SELECT c_custkey, (['lahore', 'karachi', 'wah cantt', 'quetta', 'nowhere'])[c_custkey % 5 + 1] AS city FROM customer) SELECT c_custkey, city, CASE city WHEN 'wah cantt' THEN 'wah-cantt' WHEN 'nowhere' THEN 'unknown' ELSE city END AS slug FROM c",
)
def _(spark, sf):
    from hemline.operators.joins import lookup
    from hemline.sources.dims import city_dim

    names = F.array(*[F.lit(x) for x in ("lahore", "karachi", "wah cantt", "quetta", "nowhere")])
    c = table(spark, sf, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 5).cast("int")).alias("city"))
    return lookup(c, city_dim(spark), "city", "slug", "unknown").select("c_custkey", "city", "slug")


@query(
    "join_10_lookup",
    "SELECT n_name, coalesce(r_name, 'elsewhere') AS r_name FROM nation LEFT JOIN (FROM region WHERE r_regionkey < 4) ON n_regionkey = r_regionkey",
)
def _(spark, sf):
    from hemline.operators.joins import lookup

    regions = table(spark, sf, "region").filter("r_regionkey < 4").withColumnRenamed("r_regionkey", "n_regionkey")
    return lookup(table(spark, sf, "nation"), regions, "n_regionkey", "r_name", "elsewhere").select("n_name", "r_name")


@query(
    "join_04_chat_with_messages",
    "WITH u AS (SELECT conv_id AS id FROM conversations UNION SELECT conv_id + 1000000 FROM conversations WHERE conv_id % 10 = 0), m AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations QUALIFY r <= 4) "
    "SELECT id, count(m.turn) AS n, coalesce(string_agg(m.turn::varchar || ':' || md5(text), '|' ORDER BY m.turn), '') AS body FROM u LEFT JOIN m ON id = conv_id GROUP BY id",
)
def _(spark, sf):
    c = _conv(spark, sf)
    ids = c.select(F.col("chat_id").alias("id")).union(c.filter("chat_id % 10 = 0").select((F.col("chat_id") + 1_000_000).alias("id")))
    nested = chats.chat_with_messages(ids.distinct(), c.select("chat_id", "turn", "text"), ["turn"], 4)
    line = F.transform("messages", lambda m: F.concat(m["turn"].cast("string"), F.lit(":"), md5_text(m["text"])))
    return nested.select("id", F.size("messages").cast("bigint").alias("n"), F.array_join(line, "|").alias("body"))


@query(
    "join_05_visible_messages",
    "SELECT l_orderkey AS chat_id, l_linenumber AS turn, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)",
)
def _(spark, sf):
    return chats.visible_messages(_lines(spark, sf), _orders(spark, sf), 7)


_GONE = "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000"


@query(
    "join_06_delete_cascade",
    f"SELECT 'chat' AS kind, o_orderkey AS id, 0 AS turn FROM orders WHERE o_orderkey NOT IN ({_GONE}) UNION ALL SELECT 'message', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN ({_GONE})",
)
def _(spark, sf):
    gone = table(spark, sf, "orders").filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("id"))
    left, messages = chats.delete_cascade(_orders(spark, sf), _lines(spark, sf), gone)
    a = left.select(F.lit("chat").alias("kind"), "id", F.lit(0).alias("turn"))
    return a.union(messages.select(F.lit("message").alias("kind"), F.col("chat_id").alias("id"), "turn"))


@query(
    "join_08_confirm_pending",
    "WITH s AS (SELECT user_id AS chat_id, 'user' AS role, event_type AS content, event_id AS seq FROM events WHERE event_id % 3 = 0), l AS (SELECT user_id AS chat_id, 'user' AS role, event_type AS content, event_id AS seq FROM events WHERE event_id % 3 > 0), "
    "c AS (SELECT chat_id, content, count(*) AS k FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY chat_id, content ORDER BY seq) AS i FROM l) "
    "SELECT chat_id, role, content, seq, 'server' AS origin FROM s UNION ALL SELECT r.chat_id, r.role, r.content, seq, 'local' FROM r LEFT JOIN c USING (chat_id, content) WHERE i > coalesce(k, 0)",
)
def _(spark, sf):
    m = table(spark, sf, "events").select(
        F.col("user_id").alias("chat_id"), F.lit("user").alias("role"), F.col("event_type").alias("content"), F.col("event_id").alias("seq")
    )
    return chats.confirm_pending(m.filter("seq % 3 = 0"), m.filter("seq % 3 > 0"), ["seq"])


@query(
    "win_03_context_window",
    "WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> 'system') "
    "SELECT conv_id AS chat_id, turn, role, least(n, 3) - back + 1 AS place FROM k WHERE back <= 3",
)
def _(spark, sf):
    return chats.context_window(_conv(spark, sf), ["turn"], 3).select("chat_id", "turn", "role", F.col("place").cast("bigint").alias("place"))


def _block(role: str, text: str) -> str:
    return f"'<|start_header_id|>' || {role} || '<|end_header_id|>' || chr(10) || chr(10) || {text} || '<|eot_id|>'"


@query(
    "txt_22_render_conversation",
    "WITH k AS (SELECT * FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10), p AS (SELECT conv_id, string_agg("
    + _block("role", "text") + ", '' ORDER BY turn) AS body FROM k GROUP BY conv_id) SELECT conv_id AS chat_id, md5('<|begin_of_text|>' || " + _block("'system'", "'Help.'")
    + " || body || " + _block("'user'", "'and chat ' || conv_id")
    + " || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)) AS prompt FROM p",
)
def _(spark, sf):
    context = chats.context_window(_conv(spark, sf), ["turn"], 10)
    now = context.select("chat_id").distinct().withColumn("text", F.concat(F.lit("and chat "), F.col("chat_id").cast("string")))
    prompts = chats.render_conversation(chats.with_frame(context, "Help.", now))
    return prompts.select("chat_id", md5_text("prompt").alias("prompt"))


def _media(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "video").when(F.col("event_type") == "click", "image").otherwise("text")
    url = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("s3://b/"), F.col("event_id").cast("string")))
    return e.select(F.col("user_id").alias("chat_id"), "event_id", kind.alias("message_type"), url.alias("s3_url"))


@query(
    "win_04_latest_media",
    "SELECT user_id AS chat_id, max(event_id) AS event_id, 's3://b/' || max(event_id) AS s3_url FROM events WHERE event_type <> 'view' AND event_id % 4 > 0 GROUP BY user_id",
)
def _(spark, sf):
    return chats.latest_media(_media(spark, sf), ["event_id"]).select("chat_id", "event_id", "s3_url")


@query(
    "win_04_latest_media_in_first_50",
    "WITH f AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 50) SELECT user_id AS chat_id, max(event_id) AS event_id FROM f WHERE event_type <> 'view' AND event_id % 4 > 0 GROUP BY user_id",
)
def _(spark, sf):
    return chats.latest_media(_media(spark, sf), ["event_id"], 50).select("chat_id", "event_id")


@query(
    "win_05_oldest_n",
    "SELECT conv_id AS chat_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations QUALIFY rank <= 2",
)
def _(spark, sf):
    return chats.oldest_n(_conv(spark, sf), 2, ["turn"]).select("chat_id", "turn", "rank")


@query(
    "ord_01_recent_chats",
    "SELECT o_orderkey AS id, o_orderdate::varchar AS updated_at FROM orders WHERE o_orderkey % 6 > 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
)
def _(spark, sf):
    return chats.recent_chats(_orders(spark, sf), 50).select("id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("ord_02_messages", "SELECT turn, role, md5(text) AS text FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 100")
def _(spark, sf):
    return chats.chat_messages(_conv(spark, sf), 3, ["turn"], 100).select("turn", "role", md5_text("text").alias("text"))


def change_log(spark, sf):
    """Events as a chat log: id = user, five kinds of events as inserts, title updates and deletes, of three users in turn:
    most of what is done to a chat is done by users who don't own it."""
    e = table(spark, sf, "events")
    op = (
        F.when(F.col("event_type") == "signup", "insert").when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), "delete")
        .otherwise("update")
    )
    return e.select(
        op.alias("op"), F.col("user_id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"),
        F.concat(F.lit("u"), (F.col("event_id") % 3).cast("string")).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def base_chats(spark, sf):
    c = table(spark, sf, "customer").withColumn("owner", F.concat(F.lit("u"), (F.col("c_custkey") % 4).cast("string")))
    c = c.withColumn("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 10_000_000))
    at = F.lit("2023-12-01 00:00:00").cast("timestamp")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.col("owner").alias("user_id"),
        at.alias("created_at"), at.alias("updated_at"),
    )


# Lives of a chat one after the other: the owner's next delete ends one, the next insert of any user starts one.
CHANGES = (
    "log AS (SELECT CASE WHEN event_type = 'signup' THEN 'insert' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'delete' ELSE 'update' END AS op, user_id::varchar AS id, 't' || event_id AS title, 'u' || (event_id % 3) AS user_id, ts, event_id AS seq FROM events), "
    "steps AS (SELECT id, title, user_id, ts, seq FROM log WHERE op = 'insert' UNION ALL FROM old), "
    "ended AS (SELECT *, (SELECT min(seq) FROM log d WHERE d.op = 'delete' AND d.id = s.id AND d.user_id = s.user_id AND d.seq > s.seq) AS e FROM steps s), "
    "linked AS (SELECT *, (SELECT min(seq) FROM log i WHERE i.op = 'insert' AND i.id = s.id AND i.seq > e) AS nxt FROM ended s), "
    "life AS (SELECT * FROM linked QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1 UNION ALL SELECT n.* FROM life l JOIN linked n ON n.id = l.id AND n.seq = l.nxt), "
    "alive AS (FROM life WHERE e IS NULL), "
    "up AS (SELECT l.id, max_by(l.title, l.seq) AS t, max(l.ts) AS at_ FROM log l JOIN alive a ON a.id = l.id AND a.user_id = l.user_id WHERE op = 'update' AND l.seq > a.seq GROUP BY l.id) "
    "SELECT id, coalesce(up.t, title) AS title, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(coalesce(up.at_, ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM alive LEFT JOIN up USING (id)"
)


def shown_chats(df):
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return df.select("id", "title", "user_id", F.date_format("created_at", fmt).alias("created_at"), F.date_format("updated_at", fmt).alias("updated_at"))


APPLIED_TO_EMPTY = (
    f"WITH RECURSIVE old AS (SELECT '' AS id, '' AS title, '' AS user_id, TIMESTAMP '2023-12-01' AS ts, -1::bigint AS seq WHERE false), {CHANGES}"
)


@query(
    "tab_01_apply_changes",
    "WITH RECURSIVE old AS (SELECT (CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey + 10000000 END)::varchar AS id, c_name AS title, 'u' || (c_custkey % 4) AS user_id, TIMESTAMP '2023-12-01' AS ts, -1::bigint AS seq FROM customer), "
    + CHANGES,
)
def _(spark, sf):
    return shown_chats(chats.apply_changes(base_chats(spark, sf), change_log(spark, sf)))


@query(
    "tab_02_recency_groups",
    "WITH c AS (SELECT o_orderkey AS id, o_orderdate::date AS d, DATE '1997-03-12' AS t FROM orders), g AS (SELECT id, CASE WHEN d = t THEN 'Today' WHEN d = t - 1 THEN 'Yesterday' WHEN d BETWEEN DATE '1997-03-09' AND DATE '1997-03-15' "
    "THEN 'This week' WHEN d BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' THEN 'This month' ELSE 'Older' END AS recency FROM c) SELECT id, recency, list_position(['Today', 'Yesterday', 'This week', 'This month', 'Older'], recency)::bigint AS place FROM g",
)
def _(spark, sf):
    now = F.lit("1997-03-12 15:00:00").cast("timestamp")
    return chats.recency_groups(_orders(spark, sf), now).select("id", "recency", F.col("place").cast("bigint").alias("place"))


@query(
    "tab_03_message_mix",
    "WITH m AS (SELECT conv_id AS chat_id, role, CASE WHEN role = 'assistant' THEN (['image', 'text', 'video', 'website', 'text'])[turn % 5 + 1] ELSE 'text' END AS k FROM conversations) SELECT chat_id, "
    + ", ".join(f"count(*) FILTER (role = '{r}') AS {r}" for r in ("system", "user", "assistant")) + ", "
    + ", ".join(f"count(*) FILTER (k = '{t}') AS {t}" for t in ("text", "image", "video", "website")) + " FROM m GROUP BY chat_id",
)
def _(spark, sf):
    tools = ["image_generation", "text_generation", "video_generation", "website_generation", "billboard_search"]
    tool = F.get(F.array(*[F.lit(t) for t in tools]), (F.col("turn") % 5).cast("int"))
    m = _conv(spark, sf).select(
        "chat_id", "role", F.when(F.col("role") != "assistant", "text").alias("message_type"), tool.alias("tool")
    )
    return chats.message_mix(m)
