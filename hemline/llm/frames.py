"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.session import shared_path

# Characters worked on at once inside a task; bounds the arrays a Python worker holds.
SLICE_CHARS = 1_000_000
# A lookup table up to this many bytes is sent to every executor; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20
# Whether shuffle files go with the query that made them.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names in any case, so that new columns of the same names cannot clash."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that are made and run inside go when a query ends, not when the driver next collects garbage.

    For steps that store what they find: a query that is run again would have to make its shuffles again.
    """
    was = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if was is None else spark.conf.set(FREED, was)


def if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a stored table for broadcast when its rows, written as text, are known to be small."""
    row = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 64
    size = df.agg(F.sum(row.cast("bigint")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= most else df


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``most`` characters; a longer text is a run of its own."""
    return runs_of_sizes([len(t) for t in texts], most)


def runs_of_sizes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def release() -> None:
    """Give freed memory back to the system, which the allocators of Arrow and C would keep for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_texts(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str]], Iterable]],
    chars: int = SLICE_CHARS,
) -> DataFrame:
    """Columns made from whole texts in Arrow batches: all columns of ``df`` but ``text``, and ``fields``.

    ``make`` runs once in each task and returns the function that turns a list of texts (null: empty) into one
    sequence for each field. Columns of ``df`` named like a field are replaced by it. Beside the Arrow batch a
    worker holds one slice of about ``chars`` characters and its results, however many slices it has done.
    """
    kept = without(df, text, *[f.name for f in fields]).columns
    schema = T.StructType([df.schema[c] for c in kept] + fields)

    def run(batches):
        work = make()
        for batch in batches:
            sizes = pc.utf8_length(batch.column(len(kept))).fill_null(0).to_pylist()
            for a, b in runs_of_sizes(sizes, chars):
                part = batch.slice(a, b - a)
                made = work([t or "" for t in part.column(len(kept)).to_pylist()])
                arrays = part.columns[: len(kept)] + [pa.array(v) for v in made]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + [f.name for f in fields])
                del made, arrays
                release()

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_whole_text")).mapInArrow(run, schema)
