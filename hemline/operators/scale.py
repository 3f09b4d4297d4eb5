"""Building blocks that keep exact per-group results when one group holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemline.session import stored

# A group up to this many rows is sorted by one task; larger groups are split over the whole cluster.
HOT_ROWS = 2_000_000
# A lookup table up to this many rows and bytes is sent to every executor; larger ones are joined by shuffle.
SMALL_ROWS, SMALL_BYTES = 100_000, 16 << 20


# Rows of a slab: what one task sorts when a large table is spread over order.
SLAB_ROWS = 500_000


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows in all and rows of the largest group. Counts are combined before the shuffle and two numbers reach the driver."""
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    sizes = counts.agg(F.sum("count").alias("rows"), F.max("count").alias("n")).first()
    return sizes["rows"] or 0, sizes["n"] or 0


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return group_sizes(df, keys)[1]


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when it is known to be small; leave the join strategy open otherwise.

    Bytes are those of the rows written as text, counted over no more than ``rows`` + 1 of them.
    """
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    size = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= rows and size["b"] <= SMALL_BYTES else df


def attach(left: DataFrame, facts: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join to ``facts``, which has one row per key, when ``left`` may hold very many rows of one key.

    Rows of such keys are dealt to several tasks by their place in a stored copy of ``left``, equal rows too, and their
    facts are copied to each of them. There can be no more such keys than rows / hot_rows, so the list of them stays short.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = counts.select(key, F.ceil(F.col("_n") / max(hot_rows, 1)).alias("_parts"))
    if hot.isEmpty():
        return left.join(facts, key, "left")
    hot = small_side(stored(hot, "hot"))
    parts = F.coalesce("_parts", F.lit(1))
    # the copy pins the places: a task that runs again deals its rows as before
    placed = stored(left, "dealt").withColumn("_place", F.monotonically_increasing_id())
    dealt = placed.join(hot, key, "left").withColumn("_part", F.pmod("_place", parts)).drop("_parts", "_place")
    copied = (
        facts.join(hot, key, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        .drop("_parts")
    )
    return dealt.join(copied, [key, "_part"], "left").drop("_part")


class Ordered:
    """Rows in order inside their groups, with ranks and running values.

    When every group fits one task this is a plain window. Otherwise rows are spread by range over keys and
    order together, so one group covers many partitions; each partition works alone and adds what the
    partitions before it sum up to. ``order`` must tell all rows of a group apart. ``split`` and ``rows`` say what is
    already known about the group sizes and the table; otherwise both are counted in one pass. There are as many
    partitions as the rows make at ``slab_rows`` each, where that is more than the session's own number.
    """

    def __init__(
        self, df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS, split: bool | None = None,
        rows: int | None = None, slab_rows: int = SLAB_ROWS,
    ):
        self.keys, self.order = list(keys), list(order)
        if split is None:
            rows, largest = group_sizes(df, self.keys)
            split = largest > hot_rows
        self.split = split
        if self.split:
            slabs = -(-(df.count() if rows is None else rows) // slab_rows)
            own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            # The stored copy pins which row sits in which partition: every later pass must agree on it.
            placed = (
                df.repartitionByRange(*([slabs] if slabs > own else []), *self.keys, *self.order)
                .sortWithinPartitions(*self.keys, *self.order)
                .withColumn("_at", F.monotonically_increasing_id())
            )
            # the id counts up inside a partition, with the partition number in its upper bits
            df = stored(placed, "ordered").withColumn("_slab", F.shiftright("_at", 33))
        self.df = df

    def _local(self) -> Window:
        if self.split:
            return Window.partitionBy(*self.keys, "_slab").orderBy("_at")
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def running(self, **values: tuple[str, Column]) -> Ordered:
        """Add running values up to and including each row: ``name=("sum" | "max" | "min", column)``."""
        fold = {"sum": F.sum, "max": F.max, "min": F.min}
        here = self._local().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = self.df
        for name, (how, col) in values.items():
            df = df.withColumn(name, fold[how](col).over(here))
        if self.split:
            df = _join_null_safe(df, self._carried(values, fold), [*self.keys, "_slab"])
            for name, (how, _) in values.items():
                # in the column's own type: decimals added in a wider one would lose places
                before = F.col(f"_{name}").cast(df.schema[name].dataType)
                if how == "sum":
                    both = F.coalesce(F.col(name) + before, F.col(name), before)
                else:
                    both = (F.greatest if how == "max" else F.least)(F.col(name), before)
                df = df.withColumn(name, both).drop(f"_{name}")
        self.df = df
        return self

    def _carried(self, values: dict[str, tuple[str, Column]], fold: dict) -> DataFrame:
        """What the earlier slabs of a group come to, for groups that go on from one slab into the next.

        Slabs are ranges, so at most one group crosses from each slab into the next: this table never has more
        rows than there are slabs and is safe to broadcast.
        """
        totals = self.df.groupBy(*self.keys, "_slab").agg(
            *[fold[how](col).alias(f"_{name}") for name, (how, col) in values.items()]
        )
        earlier = Window.partitionBy(*self.keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *self.keys,
            "_slab",
            *[fold[how](f"_{name}").over(earlier).alias(f"_{name}") for name, (how, _) in values.items()],
            F.count(F.lit(1)).over(earlier).alias("_earlier"),
        )
        return F.broadcast(carried.filter("_earlier > 0").drop("_earlier"))

    def rank(self, name: str) -> Ordered:
        """Add the row number from 1 inside each group."""
        if self.split:
            return self.running(**{name: ("sum", F.lit(1).cast("bigint"))})
        self.df = self.df.withColumn(name, F.row_number().over(self._local()).cast("bigint"))
        return self

    def done(self) -> DataFrame:
        return self.df.drop("_at", "_slab")


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that also matches null keys; keeps the key columns of the left side."""
    renamed = right.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in right.columns if c not in on])
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(renamed[f"_k_{c}"])
    return left.join(F.broadcast(renamed), match, "left").drop(*[f"_k_{c}" for c in on])


def ranked(
    df: DataFrame, keys: list[str], order: list[str], name: str, hot_rows: int = HOT_ROWS, split: bool | None = None
) -> DataFrame:
    return Ordered(df, keys, order, hot_rows, split).rank(name).done()


# Spark cuts a group to its first rows inside each task up to this many (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def first_n(
    df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank", hot_rows: int = HOT_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """First ``n`` rows of each group.

    Up to ``GROUP_LIMIT`` each task keeps only its own first ``n`` before the shuffle. More are ranked with groups of
    over ``hot_rows`` rows split over the cluster.
    """
    if n > GROUP_LIMIT:
        return ranked(df, keys, order, name, hot_rows, split).filter(F.col(name) <= n).withColumn(name, F.col(name).cast("int"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def repeated(df: DataFrame, times: str, index: str, chunk: int = 10_000) -> DataFrame:
    """Each row ``times`` times with ``index`` from 0. Long runs are cut in chunks and spread over the tasks."""
    n = F.col(times).cast("bigint")
    chunks = (
        df.filter(n > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / chunk))))
        .repartition("_chunk", times)
    )
    last = F.least((F.col("_chunk") + 1) * chunk, n) - 1
    return chunks.withColumn(index, F.explode(F.sequence(F.col("_chunk") * chunk, last))).drop("_chunk")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that later filters and projections read it instead of computing it again.

    The optimizer copies a plain expression into every filter pushed below it; it cannot copy a generated row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def hash_bucket(text: Column, digits: int = 8) -> Column:
    """Number in [0, 16^digits) from the md5 of ``text``: the same draw on every run and in every engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def draw(text: Column, n) -> Column:
    """Evenly drawn index in [0, n)."""
    return F.pmod(hash_bucket(text), n if isinstance(n, Column) else F.lit(n))


def smallest_share(
    df: DataFrame, groups: list[str], key: Column, fraction: float, seed: str, name: str, prefix: int = 5,
    unique: bool = False,
) -> DataFrame:
    """Mark exactly floor(n * fraction) distinct keys of each group: those with the smallest seeded hashes.

    A histogram over hash prefixes finds the prefix the border falls in, and only the keys of that one
    prefix (one in 16^prefix) are ranked, so no group is ever sorted as a whole. ``unique`` says that no key
    repeats, which saves the pass that makes them distinct.
    """
    marked = df.withColumn("_key", key).withColumn(
        "_hash", F.md5(F.concat(F.lit(f"{seed}|"), F.col("_key").cast("string")))
    )
    if not groups:
        marked = marked.withColumn("_all", F.lit(0))
    by = groups or ["_all"]
    items = marked.select(*by, "_key", "_hash")
    items = (items if unique else items.distinct()).withColumn("_bin", F.left("_hash", F.lit(prefix)))
    bins = items.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*by)
    border = (
        bins.withColumn("_quota", F.floor(F.sum("_n").over(over) * F.lit(fraction)))
        .withColumn("_upto", F.sum("_n").over(over.orderBy("_bin")))
        .filter((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select(*by, "_bin", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_take"))
    )
    last = (
        items.join(border, [*by, "_bin"])
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "_bin").orderBy("_hash")))
        .filter(F.col("_rank") == F.col("_take"))
        .select(*by, F.col("_hash").alias("_last"))
    )
    if groups:
        # one row per group, stored so that its size can be checked without computing it twice
        side = small_side(stored(last, "borders"))
        out = marked.join(side, by, "left").withColumn(name, F.col("_hash") <= F.col("_last"))
    else:
        out = marked.withColumn(name, F.col("_hash") <= last.select("_last").scalar())
    return out.withColumn(name, F.coalesce(name, F.lit(False))).drop("_key", "_hash", "_last", "_all")
