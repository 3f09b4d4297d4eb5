"""Instruction examples as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLE = (
    "instruction string, input string, output string, content_type string, category string, "
    "metadata struct<clothing:string, season:string, style:string, platform:string, context:string, "
    "length_spec:string>"
)


def read_examples(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.jsonl`` and partitioned JSON files under ``folder`` with their file name. Blank lines add no rows;
    a folder without files is an error."""
    df = (
        spark.read.schema(EXAMPLE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json*")
        .json(folder)
    )
    if not df.inputFiles():
        raise FileNotFoundError(f"no JSON lines files in {folder}")
    return df.withColumn("file", F.col("_metadata.file_path"))


def examples_per_file(examples: DataFrame) -> DataFrame:
    return examples.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def write_examples(df: DataFrame, folder: str) -> None:
    """One folder of JSON lines per category. Only the categories present in ``df`` are rewritten."""
    named = df.select(
        "instruction", "input", "output", "content_type", "category", "metadata",
        F.col("category").alias("dataset"),
    )
    (
        named.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", False)
        .partitionBy("dataset")
        .json(folder)
    )
