"""Readers over files that are written from the tables first, in the places and shapes they are found in."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import DOCS, documents, md5_text, query, sql_values, table
from hemline.functions import fixed
from hemline.operators import sampling
from hemline.session import shared_path, stored
from hemline.sources import captions, chats, dims, reports
from hemline.sources.recorded import read_recorded, write_recorded


@query(
    "src_01_read_captions_files",
    f"WITH {DOCS} SELECT 'Lang_' || category AS category, filename, 'Lang' AS season, category AS gender, md5(caption) AS caption FROM docs",
)
def _(spark, sf):
    """Many files of each language, written by the tasks that hold its documents."""
    root = shared_path(spark, "caption-files")
    d = documents(spark, sf)
    cell = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(cell(F.col("filename")), F.lit(","), cell(F.coalesce("caption", F.lit(""))))
    # a few hundred documents a file, however many there are of a language
    files = d.groupBy("category", F.floor(F.col("pos") / 256).alias("_part")).agg(F.collect_list(line).alias("lines"))
    write_recorded(
        files.select(
            F.concat_ws("/", "category", F.col("_part").cast("string")).alias("folder"),
            F.concat(F.lit("captions_Lang_"), "category", F.lit(".csv")).alias("name"),
            F.concat(F.lit('"filename","caption"\n'), F.array_join("lines", "\n"), F.lit("\n")).alias("text"),
        ),
        root,
    )
    found = captions.read_captions(spark, root)
    return found.select("category", "filename", "season", "gender", md5_text("caption").alias("caption"))


# a report for each user and day
_BY_USER = "t AS (SELECT 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS one, count(*) AS n, sum(event_id % 50)::bigint AS s, max(event_id) AS last FROM events GROUP BY 1)"


def _by_user(spark, sf):
    e = table(spark, sf, "events")
    one = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    return e.groupBy(one.alias("one")).agg(F.count("*").alias("n"), F.sum(F.col("event_id") % 50).alias("s"), F.max("event_id").alias("last"))


def _reports(spark, sf, name, body):
    """Each user's and day's report as a file that spans lines, in the packs of a folder for the day."""
    root = shared_path(spark, name)
    day = F.substring_index("one", "-", -1)
    text = F.to_json(body, {"pretty": "true"}) if not isinstance(body, str) else F.expr(body)
    files = _by_user(spark, sf).select(day.alias("folder"), F.concat("one", F.lit(".json")).alias("name"), text.alias("text"))
    write_recorded(files, root, pack_depth=1)
    return root


@query(
    "src_09_read_eval_report",
    f"WITH {_BY_USER} SELECT 'content' AS section, one AS test, 'score' AS metric, s::varchar AS value FROM t UNION ALL SELECT 'content', one, 'note', 'n' || n FROM t "
    "UNION ALL SELECT 'content', NULL, 'average_score', n::varchar FROM t UNION ALL SELECT 'rules', NULL, 'overall_rate', last::varchar FROM t",
)
def _(spark, sf):
    body = """format_string('{\n "content": {"%s": {"score": %d, "note": "n%d"}, "average_score": %d},\n "rules": {"overall_rate": %d}\n}', one, s, n, n, last)"""
    root = _reports(spark, sf, "eval-reports", body)
    return reports.flatten_report(read_recorded(spark, root).select(F.col("text").alias("json"))).select("section", "test", "metric", "value")


@query(
    "src_09_read_eval_report_of_a_day",
    f"WITH {_BY_USER} SELECT one AS test, s::varchar AS value FROM t WHERE right(one, 8) = '20240102'",
)
def _(spark, sf):
    """One day's reports: the condition goes to the source, other folders are not opened."""
    body = """format_string('{"content": {"%s": {"score": %d}}}', one, s)"""
    found = read_recorded(spark, _reports(spark, sf, "eval-reports", body)).filter("folder = '20240102'")
    return reports.flatten_report(found.select(F.col("text").alias("json"))).select("test", "value")


@query(
    "src_09_write_eval_report",
    f"WITH {_BY_USER} SELECT 'content' AS section, one AS test, 'n' AS metric, n::varchar AS value FROM t UNION ALL SELECT 'rules', one, 's', s::varchar FROM t",
)
def _(spark, sf):
    row = lambda section, c: F.struct(F.lit(section).alias("section"), F.col("one").alias("test"), F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"))
    rows = _by_user(spark, sf).select(F.explode(F.array(row("content", "n"), row("rules", "s"))).alias("r")).select("r.*")
    root = shared_path(spark, "eval-rows")
    reports.write_eval_report(rows, root)
    return spark.read.json(root).select("section", "test", "metric", "value")


_SCORES = (
    f"{_BY_USER}, c(criterion, i) AS (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate([*fixed.CRITERIA, "overall"])) + ")"
    ", j AS (SELECT one AS title, model, criterion, CASE WHEN model = 'base' THEN n + i ELSE s END::double AS score FROM t, c, (VALUES ('base'), ('finetuned')) m(model))"
)


def _judged(spark, sf):
    def evaluation(score):
        parts = [F.struct(score(i).alias("score"), F.lit("j").alias("justification")).alias(c) for i, c in enumerate(fixed.CRITERIA)]
        return F.struct(*parts, score(5).alias("overall_score"), F.lit("f").alias("overall_feedback"))

    one = F.struct(
        F.col("one").alias("title"), evaluation(lambda i: F.col("n") + i).alias("base_evaluation"),
        evaluation(lambda i: F.col("s")).alias("finetuned_evaluation"),
    )
    root = _reports(spark, sf, "judge-reports", F.struct(F.lit("x").alias("timestamp"), F.array(one).alias("results")))
    schema = reports.judge_schema()
    found = read_recorded(spark, root).select(F.from_json("text", schema).alias("r")).select("r.*")
    return reports.judge_rows(found)


@query("src_10_read_judge_report", f"WITH {_SCORES} FROM j")
def _(spark, sf):
    return _judged(spark, sf)


@query("src_10_write_judge_report", f"WITH {_SCORES} SELECT model, count(*) AS n, sum(score) AS score FROM j GROUP BY model")
def _(spark, sf):
    root = shared_path(spark, "judge-rows")
    reports.write_judge_report(_judged(spark, sf), root)
    return spark.read.json(root).groupBy("model").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query(
    "src_11_read_runs",
    f"WITH {_BY_USER} SELECT 'run-' || one AS run_id, last AS _step, CASE WHEN n % 2 = 0 THEN s / 8 END AS train_loss, NULL::double AS val_loss, CASE WHEN n % 3 <> 0 THEN s::varchar END AS epochs FROM t",
)
def _(spark, sf):
    root = shared_path(spark, "runs")
    t = stored(_by_user(spark, sf), "runs-of-users")
    folder = F.concat(F.lit("run-"), "one", F.lit("/files")).alias("folder")
    loss = F.when(F.col("n") % 2 == 0, F.col("s") / 8).alias("train_loss")
    summary = t.select(folder, F.lit("x-summary.json").alias("name"), F.to_json(F.struct(F.col("last").alias("_step"), loss)).alias("text"))
    args = F.format_string('{\n "args": ["--flag", "--epochs", "%d"]\n}', "s")
    launch = t.filter("n % 3 > 0").select(folder, F.lit("x-metadata.json").alias("name"), args.alias("text"))
    write_recorded(summary.unionByName(launch), root, pack_depth=0)
    runs = reports.read_runs(spark, root)
    return runs.select("run_id", "_step", "train_loss", "val_loss", F.try_element_at("args", F.lit("epochs")).alias("epochs"))


@query(
    "src_12_read_outcomes",
    f"WITH {_BY_USER} SELECT one AS category, n AS captioned, s AS failed, n + s AS total FROM t",
)
def _(spark, sf):
    body = """format_string('{\n "%s": {"captioned": %d, "failed": %d, "total": %d},\n "timestamp": "2025-01-01", "total_captioned": %d\n}', one, n, s, n + s, n)"""
    root = _reports(spark, sf, "outcomes", body)
    return reports.outcome_rows(read_recorded(spark, root).select(F.col("text").alias("json")))


@query(
    "src_13_read_chats",
    "SELECT o_orderkey::varchar AS id, o_orderpriority AS title, o_custkey::varchar AS user_id, strftime(o_orderdate, '%Y-%m-%d') AS created, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS updated FROM orders",
)
def _(spark, sf):
    root = shared_path(spark, "chats")
    o = table(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").cast("string").alias("user_id"),
        at.alias("created_at"), (at + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
    ).write.parquet(root)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return chats.read_chats(spark, root).select("id", "title", "user_id", day("created_at").alias("created"), day("updated_at").alias("updated"))


def _dims(spark) -> dict:
    return {
        "category": (dims.category_dim(spark, fixed.CATEGORIES), "category", fixed.CATEGORIES),
        "tool": (dims.tool_dim(spark), "parameter", [p for _, p, _, _ in fixed.TOOL_PARAMETERS]),
        "media": (dims.media_dim(spark), "alias", [a for a, _ in fixed.MEDIA_ALIASES]),
        "city": (dims.city_dim(spark), "city", fixed.CITIES),
        "content": (dims.content_type_dim(spark, sampling.CONTENT_TYPES), "content_type", [t for _, t, _, _ in sampling.CONTENT_TYPES]),
        "transform": (dims.transform_dim(spark), "transform", list(fixed.TRANSFORMS)),
    }


@query(
    "src_14_all_dims",
    "WITH d(dim, pos, name) AS (VALUES "
    + sql_values(
        [("category", i, c) for i, c in enumerate(fixed.CATEGORIES)]
        + [("tool", i, p) for i, (_, p, _, _) in enumerate(fixed.TOOL_PARAMETERS)]
        + [("media", i, a) for i, (a, _) in enumerate(fixed.MEDIA_ALIASES)]
        + [("city", i, c) for i, c in enumerate(fixed.CITIES)]
        + [("content", i, t) for i, (_, t, _, _) in enumerate(sampling.CONTENT_TYPES)]
        + [("transform", i, t) for i, t in enumerate(fixed.TRANSFORMS)]
    )
    + ") SELECT dim, d.pos, name, count(c_custkey) AS n FROM d LEFT JOIN customer ON c_custkey % 40 = d.pos GROUP BY ALL",
)
def _(spark, sf):
    """Every small table, each row met by the customers that fall on its place."""
    parts = [df.select(F.lit(n).alias("dim"), "pos", F.col(column).alias("name")) for n, (df, column, _) in _dims(spark).items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 40).alias("place"), "c_custkey")
    counts = c.groupBy("place").agg(F.count("*").alias("n"))
    joined = whole.join(counts, F.col("pos") == F.col("place"), "left")
    return joined.select("dim", "pos", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
