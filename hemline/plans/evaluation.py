"""The evaluation plan: content, constraint and prompt-rule scores of a response table, and one verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.operators.scoring import constraint_score, coverage_score, overall_verdict, rule_pass_rate


def evaluation_verdict(responses: DataFrame, expected: DataFrame, limits: DataFrame) -> DataFrame:
    """Mean score of each section, averaged over the sections that have any responses."""
    parts = [
        coverage_score(responses, expected).agg(F.lit("content").alias("section"), F.avg("score").alias("score")),
        constraint_score(responses, limits).agg(F.lit("constraints").alias("section"), F.avg("score").alias("score")),
        rule_pass_rate(responses, []).select(F.lit("rules").alias("section"), F.col("overall").alias("score")),
    ]
    return overall_verdict(parts[0].unionByName(parts[1]).unionByName(parts[2]))
