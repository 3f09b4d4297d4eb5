"""Recorded outputs: evaluation reports, judge reports, run summaries and outcome counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.functions import fixed
from hemline.sources.recorded import read_recorded


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))


def read_eval_report(spark: SparkSession, path: str) -> DataFrame:
    """Nested report JSON as long rows (file, section, test, metric, value).

    Sections mix objects (one per test) and plain numbers (section totals); totals get test = null.
    """
    return flatten_report(_whole_files(spark, path).select("file", F.col("value").alias("json")))


def flatten_report(reports: DataFrame) -> DataFrame:
    """Same for reports held in a column ``json``; other columns are kept."""
    tvf = reports.sparkSession.tvf
    keep = [c for c in reports.columns if c != "json"]
    tests = (
        reports.select(*keep, F.try_parse_json("json").alias("doc"))
        .lateralJoin(tvf.variant_explode(F.col("doc").outer()).alias("s"))
        .select(*keep, F.col("s.key").alias("section"), F.col("s.value").alias("body"))
        .lateralJoin(tvf.variant_explode(F.col("body").outer()).alias("t"))
        .select(*keep, "section", F.col("t.key").alias("test"), F.col("t.value").alias("body"))
    )
    # a plain number counts as a metric of the section itself
    metrics = tests.lateralJoin(tvf.variant_explode_outer(F.col("body").outer()).alias("m"))
    plain = F.col("m.value").isNull()
    return metrics.select(
        *keep,
        "section",
        F.when(~plain, F.col("test")).alias("test"),
        F.coalesce(F.col("m.key"), F.col("test")).alias("metric"),
        F.when(plain, F.col("body")).otherwise(F.col("m.value")).cast("string").alias("value"),
    )


def write_eval_report(scores: DataFrame, folder: str) -> None:
    """Long rows (section, test, metric, value) as JSON lines, one folder per section."""
    scores.write.mode("overwrite").partitionBy("section").json(folder)


def judge_schema() -> str:
    crit = ", ".join(f"{c}: struct<score: double, justification: string>" for c in fixed.CRITERIA)
    ev = f"struct<{crit}, overall_score: double, overall_feedback: string>"
    return (
        "timestamp string, results array<struct<title: string, instruction: string, base_output: string, "
        f"base_evaluation: {ev}, finetuned_output: string, finetuned_evaluation: {ev}>>"
    )


def read_judge_report(spark: SparkSession, path: str) -> DataFrame:
    """Judge results as long rows (title, model, criterion, score); the overall score is criterion 'overall'."""
    return judge_rows(spark.read.schema(judge_schema()).option("multiLine", True).json(path))


def judge_rows(reports: DataFrame) -> DataFrame:
    """Long rows of judge reports held as rows with a ``results`` array."""
    one = (
        reports.select(F.explode("results").alias("r"))
        .select(
            F.col("r.title").alias("title"),
            F.explode(
                F.array(
                    F.struct(F.lit("base").alias("model"), F.col("r.base_evaluation").alias("e")),
                    F.struct(F.lit("finetuned").alias("model"), F.col("r.finetuned_evaluation").alias("e")),
                )
            ).alias("m"),
        )
    )
    names = [*fixed.CRITERIA, "overall"]
    pairs = [F.col(f"m.e.{c}.score") for c in fixed.CRITERIA] + [F.col("m.e.overall_score")]
    stacked = F.explode(
        F.array(*[F.struct(F.lit(n).alias("criterion"), p.alias("score")) for n, p in zip(names, pairs)])
    )
    return one.select("title", F.col("m.model").alias("model"), stacked.alias("s")).select(
        "title", "model", "s.criterion", "s.score"
    )


def write_judge_report(scores: DataFrame, folder: str) -> None:
    """Long judge rows as JSON lines, one folder per model."""
    scores.write.mode("overwrite").partitionBy("model").json(folder)


RUN = (
    "_step bigint, _runtime bigint, _timestamp double, epoch bigint, step bigint, train_loss double, "
    "val_loss double, learning_rate double, sample_epoch bigint, sample_generation_step bigint"
)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Sparse metric summaries of many runs under ``<root>/<run>/files/`` with their launch arguments as a map.

    Files are read as :func:`read_recorded` finds them, loose or in packs. Hidden ones are passed over.
    """
    place = F.concat_ws("/", F.lit(root.rstrip("/")), F.when(F.col("folder") != "", F.col("folder")))
    run_id = F.regexp_extract(place, r"/([^/]+)/files$", 1)

    def parsed(ending: str, schema: str) -> DataFrame:
        files = read_recorded(spark, root).filter(F.endswith("name", F.lit(ending)) & ~F.rlike("folder", F.lit(r"(^|/)[._]")))
        # an array is a row for each element, an empty file none, what is no JSON one of nulls
        rows = F.from_json("text", f"array<struct<{schema}>>")
        none = F.array(F.from_json(F.lit("{}"), schema))
        rows = F.when(F.rlike("text", F.lit(r"\S")), F.coalesce(rows, none))
        return files.select(run_id.alias("run_id"), F.explode(rows).alias("r")).select("run_id", "r.*")

    summary = parsed("-summary.json", RUN)
    launch = parsed("-metadata.json", "args array<string>").select("run_id", argument_map(F.col("args")).alias("args"))
    return summary.join(launch, "run_id", "left")


def argument_map(args):
    """["--a", "1", "--flag"] as {a: 1, flag: null}: a value belongs to the option right before it."""
    marked = F.transform(
        args,
        lambda a, i: F.when(
            F.startswith(a, F.lit("--")),
            F.struct(
                F.substr(a, F.lit(3)).alias("name"),
                F.when(~F.startswith(F.get(args, i + 1), F.lit("--")), F.get(args, i + 1)).alias("value"),
            ),
        ),
    )
    return F.map_from_entries(F.filter(marked, lambda m: m.isNotNull()))


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcome counters (category, captioned, failed, total); scalars next to the categories are left out."""
    return outcome_rows(_whole_files(spark, path).select(F.col("value").alias("json")))


def outcome_rows(reports: DataFrame) -> DataFrame:
    """Same for counters held in a column ``json``; other columns are kept."""
    keep = [c for c in reports.columns if c != "json"]
    body = reports.select(*keep, F.from_json("json", "map<string,string>").alias("m"))
    rows = body.select(*keep, F.explode("m").alias("category", "json")).select(
        *keep, "category", F.from_json("json", "captioned bigint, failed bigint, total bigint").alias("c")
    )
    return rows.filter("c.total IS NOT NULL").select(*keep, "category", "c.*")
