"""Chat and message tables in parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHAT = "id string, title string, user_id string, created_at timestamp, updated_at timestamp"
MESSAGE = (
    "id string, chat_id string, role string, content string, message_type string, s3_url string, "
    "metadata map<string,string>, created_at timestamp"
)
ROLES = ["system", "user", "assistant"]
MESSAGE_TYPES = ["text", "image", "video", "website"]


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHAT).parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE + ", day date").parquet(path)


def write_messages(df: DataFrame, path: str) -> None:
    """Append messages, one folder per day; a filter on ``day`` reads only those folders.

    A row with an unknown or missing role or type fails the write, so none is lost unnoticed; see ``valid_messages``.
    """
    wrong = F.concat(F.lit("message "), F.coalesce("id", F.lit("?")), F.lit(" has an unknown role or type"))
    fine = F.coalesce(_is_valid(), F.lit(False))
    (
        df.withColumn("role", F.when(fine, F.col("role")).otherwise(F.raise_error(wrong)))
        .withColumn("day", F.to_date("created_at"))
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )


def _is_valid() -> Column:
    return F.col("role").isin(ROLES) & F.col("message_type").isin(MESSAGE_TYPES)


def valid_messages(df: DataFrame) -> DataFrame:
    return df.filter(_is_valid())


def rejected_messages(df: DataFrame) -> DataFrame:
    """Rows that ``write_messages`` would fail on."""
    return df.filter(~F.coalesce(_is_valid(), F.lit(False)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages (page_id, url, html). Jobs that need no html never read that column."""
    return spark.read.parquet(path).select("page_id", "url", "html")
