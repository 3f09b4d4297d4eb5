"""Sources mixed to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash and queue up, the whole source twice in a row. A copy finishes at
the words of its source up to and with it, divided by the source's target. All copies are range-sorted by that virtual
time over all sources, and the mix is cut where its words reach the total budget. Running sums go through range slabs,
so neither a source with a third of all rows nor the whole table passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.llm.frames import if_small, stored, without
from hemline.operators.scale import Ordered, ranked

WORDS = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Target of each row of ``sources`` (``source``, ``source_size``): ``share`` of all sizes by weight, at most ``most``
    times the size; what is above is shared again by weight among the others until no target is above.

    Weights repeat over the sources in code point order, null last. Each round is one aggregate over the sources and
    brings one pair of numbers to the driver.
    """
    order = sources.withColumn("_null", F.col("source").isNull())
    turn = ranked(order, [], ["_null", "source"], "_turn").drop("_null")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_turn") - 1, F.lit(len(weights))).cast("int"))
    rows = stored(turn.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))), "sources")
    budget = float(rows.agg(F.sum("source_size").alias("n")).first()["n"] or 0) * share
    level, capped = 0.0, -1
    while True:
        above = F.col("_cap") <= F.col("_weight") * level
        got = rows.agg(
            F.count_if(above).alias("n"),
            F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if got["n"] == capped or got["open"] == 0:
            break
        capped, level = got["n"], (budget - got["fixed"]) / got["open"]
    target = F.least(F.col("_cap"), F.col("_weight") * level) if budget else F.lit(0.0)
    return rows.withColumn("target", target)


def mix_rows(
    docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 7, text: str = "text"
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` (words the mix takes, repeats counted) and
    ``copies`` (0 to ``most``) for every row of ``docs``.

    A null text has size 0; a null source is a source of its own; repeated rows each count; rows that agree in all of
    doc_id, source and size may stand for each other. An empty table gives an empty result, sources without words have
    target 0. Whole documents are taken, so a source differs from its target by less than its largest document and
    the mix as a whole by less than the next document. Other columns of ``docs`` are left out.
    """
    sizes = stored(docs.select("doc_id", "source", text_size(F.col(text)).alias("size")), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(totals, list(weights), share, most), "targets")
    facts = targets.select(F.col("source").alias("_of"), "source_size", "target", "_turn")
    queued = sizes.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "size"))
    queue = Ordered(queued, ["source"], ["_hash", "doc_id", "size"], split=True)
    queue = queue.running(_upto=("sum", F.col("size"))).rank("_place").done().drop("_hash")
    queue = stored(queue.join(if_small(facts), F.col("source").eqNullSafe(F.col("_of"))).drop("_of"), "queue")
    copies = queue.filter((F.col("target") > 0) & (F.col("size") > 0)).withColumn(
        "_pass", F.explode(F.array(*[F.lit(i) for i in range(most)]))
    )
    finish = (F.col("_upto") + F.col("_pass") * F.col("source_size")) / F.col("target")
    order = ["_finish", "_turn", "_pass", "_place"]
    line = Ordered(copies.select(finish.alias("_finish"), "_turn", "_pass", "_place", "size"), [], order, split=True)
    # round: sums of targets carry float noise that must not cut the last document
    budget = targets.agg(F.round(F.sum("target")).alias("n")).first()["n"] or 0.0
    inside = line.running(_total=("sum", F.col("size"))).done().filter(F.col("_total") <= budget)
    last = inside.agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    if last is None:
        taken = F.lit(0)
    else:
        kinds = {"_finish": "double", "_turn": "bigint", "_pass": "int", "_place": "bigint"}
        cut = F.struct(*[F.lit(last[c]).cast(kinds[c]).alias(c) for c in order])
        copy = {"_turn": F.col("_turn"), "_place": F.col("_place")}
        ok = []
        for i in range(most):
            at = copy | {
                "_finish": (F.col("_upto") + F.lit(i) * F.col("source_size")) / F.col("target"), "_pass": F.lit(i)
            }
            ok.append(F.struct(*[at[c].cast(kinds[c]).alias(c) for c in order]) <= cut)
        taken = sum((F.when(o & (F.col("target") > 0) & (F.col("size") > 0), 1).otherwise(0) for o in ok), F.lit(0))
    return queue.withColumn("copies", taken).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "copies"
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken. Needs ``doc_id``, ``source`` and ``text``; other columns
    stay. Rows that agree in doc_id, source and size, nulls like any value, are taken as often as the most taken of them."""
    key = ["doc_id", "source", "size"]
    copies = mix_rows(docs, **options).groupBy(*key).agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    copies = copies.select(*[F.col(c).alias(f"_of_{c}") for c in key], "_copies")
    text = options.get("text", "text")
    own = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": text_size(F.col(text))}
    held = without(docs, "_copies", *[f"_of_{c}" for c in key])
    both = held.join(copies, [own[c].eqNullSafe(F.col(f"_of_{c}")) for c in key]).drop(*[f"_of_{c}" for c in key])
    return both.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
