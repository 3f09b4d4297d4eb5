"""Repeated runs of lines: distributed prefix doubling over line-ID sequences.

Lines that occur once cannot be in a repeated run; the others are the sequence. Prefix doubling ranks its suffixes by
their first 1, 2, 4, ... lines: each round sorts pairs of the ranks half as deep, by range over the whole cluster, and
names equal pairs alike. The ranks are the suffix array's order to that depth, and suffixes of equal rank form a
longest-common-prefix interval. Any window of lines is told by two overlapping ranks, so the interval at the depth of
each smallest window of enough words is known; all members of an interval but the first in document order are later
copies, and the union of their windows is what is deleted. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemline.llm.frames import stored, without
from hemline.operators.scale import Ordered

WORD = r"[^\x20\x09-\x0D]+"


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with words: document (``k``, ``mark``), number of the line, ``id`` and words. Equal rows count once."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("mark"), F.col(text).alias("t"))
    lines = rows.select("k", "mark", F.posexplode(F.split("t", "\n", -1)).alias("line", "l"))
    lines = lines.select("k", "mark", "line", F.xxhash64("l", F.char_length("l")).alias("id"), F.regexp_count("l", F.lit(WORD)).alias("words"))
    return lines.filter("words > 0")


def repeated_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The lines that occur more than once, numbered in document order by ``pos``; ``i`` counts the lines of a document."""
    lines = stored(_lines(docs, key, text).dropDuplicates(["k", "mark", "line"]), "lines")
    ids = stored(lines.groupBy("id").count().filter("count > 1").select("id"), "repeated-ids")
    within = Window.partitionBy("k", "mark").orderBy("line")
    numbered = lines.withColumn("i", F.row_number().over(within))
    active = numbered.join(ids, "id", "left_semi").withColumn("_null", F.col("k").isNull())
    order = Ordered(active, [], ["_null", "k", "mark", "line"], split=True).rank("pos").done()
    return stored(order.drop("_null"), "sequence")


def _ahead(column: str, steps: int) -> Column:
    """``column`` of the line ``steps`` further in the same run of active lines; null behind its end."""
    w = Window.partitionBy("k", "mark").orderBy("line")
    far = F.lead(F.struct("i", column), steps).over(w)
    return F.when(far["i"] == F.col("i") + steps, far[column])


def suffix_ranks(sequence: DataFrame, depth: int) -> DataFrame:
    """Add ``rank0``, ``rank1``, ...: ranks of the suffixes by their first 1, 2, 4, ... lines, up to ``depth`` lines.

    A suffix that ends before is ranked before all that go on. Each round is one sort by range: ties are told apart
    by position, so equal suffixes spread over tasks; the rank is the smallest number among equals.
    """
    first = stored(sequence.groupBy("id").agg(F.min("pos").alias("rank0")), "names")
    ranked = stored(sequence.join(first, "id"), "ranks")
    level, length = 0, 1
    while length * 2 <= depth:
        have, name = f"rank{level}", f"rank{level + 1}"
        pairs = stored(ranked.withColumn("_next", F.coalesce(_ahead(have, length), F.lit(-1).cast("bigint"))), "pairs")
        line = Ordered(pairs.select(have, "_next", "pos"), [], [have, "_next", "pos"], split=True).rank("_n").done()
        heads = stored(line.groupBy(have, "_next").agg(F.min("_n").alias(name)), "names")
        ranked = stored(pairs.join(heads, [have, "_next"]).drop("_next"), "ranks")
        level, length = level + 1, length * 2
    return ranked


def later_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 3) -> DataFrame:
    """``k``, ``mark`` and ``gone``: the numbers of the lines that lie in a later copy of a repeated run.

    A run counts when its lines have ``min_words`` words or more together. Its smallest windows, counted from either
    end, cover it, so only windows of at most ``min_words`` lines are compared, whatever the length of the run.
    """
    ranked = suffix_ranks(repeated_lines(docs, key, text), min_words)
    names = sorted((c for c in ranked.columns if c.startswith("rank")), key=lambda c: int(c[4:]))
    w = Window.partitionBy("k", "mark").orderBy("line").rowsBetween(0, min_words - 1)
    ahead = F.collect_list(F.struct("i", "line", "words", F.array(*names).alias("names"))).over(w)
    at = ranked.select("k", "mark", "pos", "i", ahead.alias("a"))
    run = F.filter("a", lambda x, j: x["i"] == F.col("i") + j)  # up to the first gap
    at = at.withColumn("run", run)
    words = lambda a, n: F.aggregate(F.slice("run", a, F.greatest(n, F.lit(0))), F.lit(0), lambda s, x: s + x["words"])

    def smallest(n):
        whole = words(1, n)
        return (whole >= min_words) & ((words(1, n - 1) < min_words) | (words(2, n - 1) < min_words))

    sizes = F.filter(F.sequence(F.lit(1), F.size("run")), smallest)
    windows = at.select("k", "mark", "pos", "run", F.explode(sizes).alias("n"))
    level = F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("int")
    back = F.col("n") - F.pow(F.lit(2), level).cast("int")
    windows = windows.select(
        "k", "mark", "pos", "n",
        F.get(F.get("run", F.lit(0))["names"], level).alias("a"),
        F.get(F.get("run", back)["names"], level).alias("b"),
        F.transform(F.slice("run", F.lit(1), F.col("n")), lambda x: x["line"]).alias("covered"),
    )
    windows = stored(windows, "windows")
    interval = ["n", "a", "b"]
    first = stored(windows.groupBy(*interval).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c"), "intervals")
    copies = windows.join(first, interval).filter(F.col("pos") > F.col("first"))
    gone = copies.select("k", "mark", F.explode("covered").alias("line")).distinct()
    return stored(gone.groupBy("k", "mark").agg(F.collect_list("line").alias("gone")), "later-copies")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 3) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from ``text``, and ``n_lines``, ``n_deleted``.

    Copies are told by document order (``key``, null last), then line; the first stays. Runs end with the document;
    lines without words are never deleted and do not break a run. A null text stays null (0 lines), an empty one has
    one line. Rows that agree in key and text are one document and have the same result, so repeats stay. An empty
    table gives an empty result. Columns of ``docs`` named like a result are replaced.
    """
    gone = later_copies(docs, key, text, min_words).select(F.col("k").alias("_k"), F.col("mark").alias("_m"), F.col("gone").alias("_gone"))
    docs = without(docs, "n_lines", "n_deleted", "_k", "_m", "_gone", "_lines")
    both = docs.join(gone, F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(text) == F.col("_m")), "left")
    both = both.withColumn("_lines", F.split(text, "\n", -1))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    left = F.array_join(F.transform(keep, lambda i: F.get("_lines", i)), "\n")
    n = F.coalesce(F.size("_lines"), F.lit(0))
    return both.withColumns(
        {
            text: F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left),
            "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(n).cast("bigint"),
            "n_deleted": F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint"),
        }
    ).drop("_k", "_m", "_gone", "_lines")
