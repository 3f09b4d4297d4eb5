"""Lexical rule scores, judge scores and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.functions import fixed, text
from hemline.operators.scale import settled, small_side


def _hits(rules: Column, response: Column) -> Column:
    """Rules found in the response. The outer array holds the lower-cased text, so it is made once, not per rule."""
    found = F.transform(
        F.array(F.lower(response)), lambda low: F.filter(rules, lambda r: F.contains(low, F.lower(r)))
    )
    return F.get(found, F.lit(0))


def coverage_score(responses: DataFrame, rules: DataFrame) -> DataFrame:
    """Share of expected words found as substrings, in percent. ``rules`` is (test, must), one row per test."""
    joined = responses.join(small_side(rules.select("test", F.col("must").alias("expected"))), "test")
    return (
        joined.withColumn("found", _hits(F.col("expected"), F.col("text")))
        .withColumn("score", F.coalesce(F.try_divide(F.size("found"), F.size("expected")) * 100, F.lit(0.0)))
        .withColumn("n_words", text.n_words(F.col("text")))
    )


def diversity_score(samples: DataFrame, groups: list[str], approximate: bool = False) -> DataFrame:
    """Distinct words per hundred words over all samples of a group; 0 for groups without words.

    Words are counted per (group, word) first, so a hot group is spread over its words.
    """
    kept = samples.select(*groups, F.explode_outer(text.words(F.lower("text"))).alias("word"))
    if approximate:
        out = kept.groupBy(*groups).agg(
            F.count("word").alias("n_words"), F.approx_count_distinct("word").alias("n_distinct")
        )
    else:
        counts = kept.groupBy(*groups, "word").agg(F.count("word").alias("n"))
        out = counts.groupBy(*groups).agg(
            F.sum("n").alias("n_words"), F.count("word").alias("n_distinct")
        )
    return out.withColumn(
        "score", F.coalesce(F.try_divide(F.col("n_distinct"), F.col("n_words")) * 100, F.lit(0.0))
    )


def constraint_score(responses: DataFrame, rules: DataFrame, penalty: float = 20) -> DataFrame:
    """Percent of required words found, less a penalty per forbidden word, never below 0, with its band."""
    joined = responses.join(small_side(rules.select("test", "must", "must_not")), "test")
    score = F.coalesce(F.try_divide(F.size("found"), F.size("must")) * 100, F.lit(0.0)) - F.size("forbidden") * penalty
    return (
        joined.withColumn("found", _hits(F.col("must"), F.col("text")))
        .withColumn("forbidden", _hits(F.col("must_not"), F.col("text")))
        .withColumn("score", F.greatest(F.lit(0.0), score))
        .withColumn("band", F.when(F.col("score") >= 70, "pass").when(F.col("score") >= 40, "warn").otherwise("fail"))
    )


def prompt_rules(c: Column, low: Column) -> dict[str, Column]:
    """The six checks of a response and its lower-cased form. Any non-ASCII character counts as an emoji, any
    hyphen as a list."""
    newlines = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    markers = ["1.", "•", "-", "1)"]
    return {
        "word_count": text.n_words(c) <= 30,
        "list_format": text.any_of([F.contains(c, F.lit(m)) for m in markers]) | (newlines >= 3),
        "emoji": F.rlike(c, F.lit(r"[^\x00-\x7f]")),
        "hashtag": F.contains(c, F.lit("#")),
        "question": F.contains(c, F.lit("?")),
        "call_to_action": text.any_of([F.contains(low, F.lit(t)) for t in fixed.CALLS_TO_ACTION]),
    }


def rule_pass_rate(responses: DataFrame, groups: list[str]) -> DataFrame:
    """Pass rate of every check and over all checks, in percent. One pass, no row explosion."""
    lowered = responses.select(*groups, "text", F.lower("text").alias("_low"))
    checks = prompt_rules(F.col("text"), F.col("_low"))
    marked = lowered.select(*groups, *[ok.cast("int").alias(name) for name, ok in checks.items()])
    passed = sum([F.col(name) for name in checks], F.lit(0))
    return marked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        *[(F.avg(name) * 100).alias(name) for name in checks],
        (F.avg(passed / F.lit(len(checks))) * 100).alias("overall"),
    )


def overall_verdict(parts: DataFrame) -> DataFrame:
    """Mean of the section scores that exist (rows section, score) and its verdict."""
    s = F.col("overall")
    return parts.agg(F.avg("score").alias("overall")).withColumn(
        "verdict", F.when(s >= 80, "excellent").when(s >= 60, "good").when(s >= 40, "fair").when(s.isNotNull(), "poor")
    )


def compare_models(scores: DataFrame, keys: list[str], base: str = "base", tuned: str = "finetuned") -> DataFrame:
    """Scores of both models side by side with the change and its direction."""
    wide = scores.groupBy(*keys).pivot("model", [base, tuned]).agg(F.avg("score"))
    delta = F.col(tuned) - F.col(base)
    return wide.withColumn("delta", delta).withColumn(
        "direction", F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "same")
    )


def judge_summary(scores: DataFrame) -> DataFrame:
    """Mean score per criterion and over all criteria (criterion = null) for both models, with improvement."""
    means = scores.rollup("model", "criterion").agg(F.avg("score").alias("score")).filter("model IS NOT NULL")
    wide = means.groupBy("criterion").pivot("model", ["base", "finetuned"]).agg(F.first("score"))
    return wide.withColumn("improvement", F.col("finetuned") - F.col("base"))


def judgement_type() -> str:
    each = ", ".join(f"{c}: struct<score: double, justification: string>" for c in fixed.CRITERIA)
    return f"struct<{each}, overall_score: double, overall_feedback: string>"


def parse_judgements(replies: DataFrame, column: str = "text") -> DataFrame:
    """Add ok, one (score, justification) struct per criterion, overall and feedback.

    Text that is no full judgement scores 0 throughout. A missing overall score is the mean of the criteria; a
    stated one is trusted.
    """
    body, parsed, ok = F.col("_body"), F.col("_parsed"), F.col("ok")
    scores = [parsed[k]["score"] for k in fixed.CRITERIA]
    mean = F.round(sum(scores[1:], scores[0]) / len(scores), 2)
    overall = F.coalesce(parsed["overall_score"], mean)
    failed = F.lit("JSON parsing failed")
    criteria = {
        k: F.struct(
            F.when(ok, parsed[k]["score"]).otherwise(F.lit(0.0)).alias("score"),
            F.when(ok, parsed[k]["justification"]).otherwise(failed).alias("justification"),
        )
        for k in fixed.CRITERIA
    }
    unwrapped = replies.withColumn("_body", text.unwrap_fence(F.col(column)))
    return (
        settled(unwrapped, "_parsed", F.from_json(body, judgement_type(), {"allowSingleQuotes": "false"}))
        .withColumn("ok", F.coalesce(F.rlike(body, F.lit(r"(?s)^\{.*\}$")) & overall.isNotNull(), F.lit(False)))
        .withColumns(criteria)
        .withColumn("overall", F.when(ok, overall).otherwise(F.lit(0.0)))
        .withColumn("feedback", F.when(ok, parsed["overall_feedback"]).otherwise(failed))
        .drop("_body", "_parsed")
    )
