"""Call logs and training runs from events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, table
from hemline.operators import balance, runs


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "agg_15_outcome_totals",
    "WITH o AS (SELECT 'bucket' || (user_id % 4) AS category, count(*) FILTER (event_type <> 'error') AS captioned, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1) "
    "SELECT category, sum(captioned)::bigint AS captioned, sum(failed)::bigint AS failed, (sum(captioned) + sum(failed))::bigint AS total FROM o GROUP BY GROUPING SETS ((category), ())",
)
def _(spark, sf):
    e = _events(spark, sf)
    fail = F.col("event_type") == "error"
    rows = e.select(
        F.concat(F.lit("bucket"), (F.col("user_id") % 4).cast("string")).alias("category"),
        F.when(fail, 0).otherwise(1).alias("captioned"), F.when(fail, 1).otherwise(0).alias("failed"),
    )
    return balance.outcome_totals(rows)


@query(
    "agg_16_capacity_summary",
    "WITH l AS (SELECT user_id, max_by(event_type, event_id) AS t FROM events GROUP BY user_id), s AS (SELECT count(*) AS keys, count(*) FILTER (t NOT IN ('error', 'signup')) AS valid, count(*) FILTER (t = 'error') AS exhausted, "
    "sum(CASE t WHEN 'click' THEN 40 WHEN 'error' THEN 0 WHEN 'signup' THEN 0 ELSE 50 END)::bigint AS remaining FROM l) SELECT *, remaining // 4 AS per_category, "
    "CASE WHEN valid = 0 THEN 'no working keys' WHEN exhausted = keys THEN 'all quotas exhausted' WHEN exhausted > 0 THEN 'some keys exhausted' ELSE 'all keys working' END AS overall FROM s",
)
def _(spark, sf):
    last = _events(spark, sf).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"))
    status = F.when(F.col("t") == "error", "quota").when(F.col("t") == "signup", "invalid").otherwise("valid")
    capacity = F.when(F.col("t") == "click", "Available (Est. 40+ images)").otherwise("Available")
    return balance.capacity_summary(last.select(status.alias("status"), capacity.alias("capacity")))


@query(
    "agg_17_epoch_losses",
    "WITH s AS (SELECT user_id AS run, date_diff('day', TIMESTAMP '2024-01-01', ts) AS epoch, CASE WHEN event_id % 11 = 0 OR event_type = 'signup' OR user_id % 10 = 3 AND day(ts) = 2 THEN NULL ELSE value END AS loss FROM events), "
    "p AS (SELECT run, epoch, coalesce(avg(loss), 'infinity'::double) AS avg_loss, count(loss) AS valid FROM s GROUP BY ALL), b AS (SELECT *, min(avg_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p) "
    "SELECT run, epoch::int AS epoch, round(CASE WHEN avg_loss = 'infinity' THEN -1 ELSE avg_loss + 1e-9 END, 6) AS avg_loss, valid, avg_loss < coalesce(prev, 'infinity'::double) AS is_best FROM b",
)
def _(spark, sf):
    e = _events(spark, sf)
    blank = (F.col("event_type") == "signup") | ((F.col("user_id") % 10 == 3) & (F.dayofmonth("ts") == 2))
    loss = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(~blank, F.col("value"))
    steps = e.select(
        F.col("user_id").alias("run"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("epoch"), loss.alias("loss")
    )
    out = runs.epoch_losses(steps)
    shown = F.when(F.col("avg_loss") == float("inf"), -1.0).otherwise(F.col("avg_loss") + 1e-9)
    return out.select("run", "epoch", F.round(shown, 6).alias("avg_loss"), "valid", "is_best")


@query(
    "agg_18_latest_checkpoint",
    "WITH c AS (SELECT o_custkey AS run, CASE o_orderkey % 5 WHEN 0 THEN 'checkpoint-final' WHEN 1 THEN 'checkpoint-bad' ELSE 'checkpoint-' || (o_orderkey % 40) END AS name, CASE WHEN o_orderkey % 5 < 2 THEN CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 = 0 THEN o_orderkey % 25 END ELSE o_orderkey % 40 END AS epoch FROM orders) "
    "SELECT run, max(epoch) AS epoch, max_by(name, (epoch, name)) AS name FROM c WHERE epoch IS NOT NULL GROUP BY run",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, "checkpoint-final").when(k % 5 == 1, "checkpoint-bad").otherwise(
        F.concat(F.lit("checkpoint-"), (k % 40).cast("string"))
    )
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"), name.alias("name"), F.when(k % 10 == 0, k % 25).alias("recorded")
    )
    return runs.latest_checkpoint(rows)


@query(
    "ord_05_latest_checkpoint_overall",
    "SELECT 'checkpoint-' || (o_orderkey % 40) AS name, o_orderkey % 40 AS epoch FROM orders ORDER BY epoch DESC LIMIT 1",
)
def _(spark, sf):
    k = F.col("o_orderkey") % 40
    rows = table(spark, sf, "orders").select(
        F.lit(0).alias("run"), F.concat(F.lit("checkpoint-"), k.cast("string")).alias("name"), F.lit(None).cast("bigint").alias("recorded")
    )
    return runs.latest_checkpoint(rows).select("name", "epoch")


def calls(spark, sf):
    return _events(spark, sf).select(
        F.col("user_id").alias("key_id"), "ts", "event_id", (F.col("event_type") != "error").alias("ok")
    )


FAILURES = (
    "c AS (SELECT user_id AS key_id, event_id, ts, event_type <> 'error' AS ok FROM events), i AS (SELECT *, sum(ok::int) OVER (PARTITION BY key_id ORDER BY ts, event_id) AS isl FROM c), "
    "f AS (SELECT *, sum((NOT ok)::int) OVER (PARTITION BY key_id ORDER BY ts, event_id)::bigint AS total_failures, sum((NOT ok)::int) OVER (PARTITION BY key_id, isl ORDER BY ts, event_id)::bigint AS consecutive FROM i), "
    "s AS (SELECT *, CASE WHEN consecutive >= 3 THEN 'consecutive' WHEN total_failures >= 12 THEN 'total' END AS stop FROM f)"
)
_RUNS = f"WITH {FAILURES} SELECT key_id, event_id, total_failures, consecutive, stop, stop IS NOT NULL AND count(stop) OVER (PARTITION BY key_id ORDER BY ts, event_id) = 1 AS first_stop FROM s"


@query("win_09_failure_runs", _RUNS)
def _(spark, sf):
    out = runs.failure_runs(calls(spark, sf), ["ts", "event_id"], 3, 12)
    return out.select("key_id", "event_id", "total_failures", "consecutive", "stop", "first_stop")


@query("win_09_failure_runs_split_groups", _RUNS)
def _(spark, sf):
    # the way taken when one key holds more rows than a task should sort
    out = runs.failure_runs(calls(spark, sf), ["ts", "event_id"], 3, 12, hot_rows=0)
    return out.select("key_id", "event_id", "total_failures", "consecutive", "stop", "first_stop")


@query(
    "win_10_running_mean_loss",
    "SELECT user_id AS run, event_id, row_number() OVER w AS step_no, round(avg(value) OVER w + 1e-9, 6) AS avg_loss, (event_id % 7)::double AS lr FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def _(spark, sf):
    steps = _events(spark, sf).select(
        F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("loss"), (F.col("event_id") % 7).cast("double").alias("lr")
    )
    out = runs.running_mean_loss(steps, ["ts", "event_id"])
    return out.select("run", "event_id", "step_no", F.round(F.col("avg_loss") + 1e-9, 6).alias("avg_loss"), "lr")
