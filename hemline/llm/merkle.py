"""Merkle manifest of a dataset: one hash tree a source, one over the sources, and a proof for every row.

Rows are range-sorted by source and key into slabs, which gives every leaf its place without a task that sees a whole
source. Each level of all trees is one aggregation over runs of 16 neighbours, so no group is larger than a run.

Proofs are those of an octopus multiproof. The leaves go, in order, into partitions of neighbours. What a partition
lacks to rebuild the way to the root are the few nodes beside its first and last leaf on every level: their coordinates
are worked out from the partition's ends alone, joined to the nodes once, and everything between is derived in the
partition. The single proofs are then read off locally.
"""

from __future__ import annotations

import dataclasses
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.llm.frames import if_small, stored

ARITY = 16
BITS = 4  # of a place number, for each level
# Rows of a slab of the sorted leaves, and leaves whose proofs are worked out together.
SLAB, CHUNK = 1 << 18, 4096
# Number of the tree over the sources; those of sources count from 0.
TOP = -1


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """Unambiguous text of a value: ``-`` for null, else its UTF-8 bytes after their count."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(text, upper, upper.lower())


def _placed(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Leaves with ``tree``, ``at``, ``size`` (leaves of the tree) and ``chunk``, and the number of trees.

    ``leaves`` is stored and has ``named``, ``name`` (of the source), ``doc_id``, ``leaf`` and other columns.
    """
    slabs = max(1, -(-leaves.count() // SLAB))
    order = ["named", "name", "doc_id", "leaf", "tie"]
    # tie: rows equal in all else may stand for each other, but must not all fall into one slab
    tied = leaves.withColumn("tie", F.monotonically_increasing_id())
    sorted_ = tied.repartitionByRange(slabs, *order).sortWithinPartitions(*order).drop("tie")
    rows = stored(sorted_.withColumn("id", F.monotonically_increasing_id()), "leaves-sorted")
    rows = rows.withColumn("slab", F.shiftright("id", 33))
    source = Window.partitionBy("named", "name")
    runs = rows.groupBy("slab", "named", "name").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(source.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumns({"before": F.coalesce(earlier, F.lit(0)), "size": F.sum("n").over(source)})
    runs = stored(runs.withColumn("starts", F.when(F.col("before") == 0, 1).otherwise(0)), "runs")
    # one row a slab
    upto = Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    of_slab = runs.groupBy("slab").agg(F.sum("n").alias("rows"), F.sum("starts").alias("trees"))
    of_slab = of_slab.select("slab", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("rows", "trees")])
    within = F.sum("starts").over(Window.partitionBy("slab").orderBy("first"))
    runs = runs.join(if_small(stored(of_slab, "slabs")), "slab").withColumn("tree", F.col("trees") + within - 1)
    runs = stored(runs.drop("n", "starts", "trees"), "runs-numbered")
    slab_start = F.shiftleft("slab", 33)
    placed = rows.join(if_small(runs), ["slab", "named", "name"]).withColumns(
        {
            "at": F.col("before") + F.col("id") - F.col("first"),
            "chunk": F.floor((F.col("rows") + F.col("id") - slab_start) / CHUNK),
        }
    )
    trees = runs.agg(F.max("tree").alias("n")).first()["n"]
    return stored(placed.drop("id", "slab", "first", "before", "rows", "named", "name"), "leaves-placed"), trees + 1


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels of all trees, from ``nodes`` (tree, at, size, hash) up to the level where every tree has one node."""
    levels = [nodes]
    while (levels[-1].agg(F.max("size").alias("n")).first()["n"] or 0) > 1:
        children = F.array_sort(F.collect_list(F.struct("at", "hash")))
        runs = levels[-1].filter("size > 1").groupBy("tree", F.shiftright("at", BITS).alias("up"))
        up = runs.agg(F.ceil(F.max("size") / ARITY).alias("size"), children.alias("c")).select(
            "tree", F.col("up").alias("at"), "size", F.sha2(F.array_join("c.hash", "").cast("binary"), 256).alias("hash")
        )
        levels.append(stored(up, "level"))
    return levels


@dataclasses.dataclass
class Manifest:
    """``leaves`` (placed, with the columns that were carried), ``nodes`` (tree, level, at, size, hash), the number of
    trees and the root, None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def build(docs: DataFrame, columns: list[str], source: str, key: str, carried: dict[str, Column]) -> Manifest:
    """Manifest of ``docs``: leaves hash ``columns`` in order, trees are those of ``source`` with leaves by ``key``.

    ``carried`` are further columns the leaves keep. Null sources and keys come first; rows that share a key are in the
    order of their hashes. A null source differs from an empty one.
    """
    leaves = docs.select(
        F.col(source).isNotNull().alias("named"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"),
        F.col(key).alias("doc_id"),
        leaf_hash([F.col(c) for c in columns]).alias("leaf"),
        *[c.alias(name) for name, c in carried.items()],
    )
    leaves = stored(leaves, "leaves")
    if leaves.isEmpty():
        nothing = "tree bigint, level int, at bigint, size bigint, hash string"
        return Manifest(leaves, docs.sparkSession.createDataFrame([], nothing), 0, None)
    leaves, trees = _placed(leaves)
    below = _levels(leaves.select("tree", "at", "size", F.col("leaf").alias("hash")))
    roots = [n.filter("size = 1").select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("at"),
                                         F.lit(trees).cast("bigint").alias("size"), "hash") for n in below]
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.unionByName(r)
    above = _levels(stored(subroots, "subroots"))
    root = above[-1].first()["hash"]
    nodes = None
    for levels in (below, above):
        for i, level in enumerate(levels):
            level = level.withColumn("level", F.lit(i))
            nodes = level if nodes is None else nodes.unionByName(level)
    return Manifest(leaves, nodes, trees, root)


def missing(manifest: Manifest) -> DataFrame:
    """``chunk``, ``tree``, ``level``, ``at`` of the nodes each partition of leaves cannot derive: the least union.

    A partition covers an unbroken stretch of leaves of each of its trees and an unbroken stretch of trees. On every
    level it lacks the rest of the run its first node is in and the rest of that of its last one.
    """
    ends = [F.min("at").alias("a"), F.max("at").alias("b"), F.max("size").alias("size")]
    stretches = manifest.leaves.groupBy("chunk", "tree").agg(*ends)
    total = F.lit(manifest.trees).cast("bigint")
    tops = manifest.leaves.groupBy("chunk").agg(F.min("tree").alias("a"), F.max("tree").alias("b"))
    tops = tops.select("chunk", F.lit(TOP).cast("bigint").alias("tree"), "a", "b", total.alias("size"))
    partial = stretches.unionByName(tops).filter("a > 0 OR b < size - 1")
    levels = partial.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(64 // BITS - 1))))
    here = {c: F.expr(f"shiftright({c}, {BITS} * level)") for c in ("a", "b")}
    here["size"] = F.expr(f"shiftright(size - 1, {BITS} * level) + 1")
    levels = levels.withColumns(here).filter("size > 1")
    first = F.col("a").bitwiseAND(F.lit(-ARITY))
    last = F.least(F.col("b").bitwiseOR(F.lit(ARITY - 1)), F.col("size") - 1)
    none = F.array().cast("array<bigint>")
    before = F.when(F.col("a") > first, F.sequence(first, F.col("a") - 1)).otherwise(none)
    after = F.when(F.col("b") < last, F.sequence(F.col("b") + 1, last)).otherwise(none)
    return levels.select("chunk", "tree", "level", F.explode(F.concat(before, after)).alias("at"))


class Octopus:
    """The runs of one partition of leaves: ``derive`` rebuilds a tree from a stretch of its nodes and what was fetched."""

    def __init__(self, fetched: dict[tuple[int, int, int], str]):
        self.fetched = fetched
        self.runs: dict[tuple[int, int, int], list[str]] = {}

    def derive(self, tree: int, nodes: dict[int, str], size: int) -> str:
        """Root of ``tree``; ``nodes`` are the hashes known on its lowest level, of ``size`` nodes."""
        level = 0
        while size > 1:
            up = {}
            for run in dict.fromkeys(at >> BITS for at in nodes):
                places = range(run << BITS, min((run + 1) << BITS, size))
                hashes = [nodes[p] if p in nodes else self.fetched[tree, level, p] for p in places]
                self.runs[tree, level, run] = hashes
                up[run] = digest("".join(hashes))
            nodes, size, level = up, ((size - 1) >> BITS) + 1, level + 1
        return nodes[0]

    def path(self, tree: int, at: int, size: int):
        """(place in its run, run) on the way from a node to the root of its tree."""
        level = 0
        while size > 1:
            yield at & (ARITY - 1), self.runs[tree, level, at >> BITS]
            at, size, level = at >> BITS, ((size - 1) >> BITS) + 1, level + 1


def proof_digest(paths) -> str:
    h = hashlib.sha256()
    for place, run in paths:
        h.update("".join(run[:place] + run[place + 1 :]).encode())
    return h.hexdigest()


def folded(leaf: str, paths) -> str:
    """Root that follows from a leaf and its siblings."""
    for place, run in paths:
        leaf = digest("".join([*run[:place], leaf, *run[place + 1 :]]))
    return leaf


def proofs(manifest: Manifest, key_type: T.DataType = T.LongType()) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` of every leaf.

    ``presented``, a column the leaves carry, is the hash of the row as presented; null where the row itself is.
    """
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType(
        [T.StructField("doc_id", key_type), *[T.StructField(n, T.StringType()) for n in names], T.StructField("verified", T.BooleanType())]
    )
    if manifest.root is None:
        return manifest.leaves.sparkSession.createDataFrame([], schema)
    root, trees = manifest.root, manifest.trees

    def expand(leaves: pa.Table, found: pa.Table) -> pa.Table:
        f = found.to_pydict()
        octopus = Octopus(dict(zip(zip(f["tree"], f["level"], f["at"]), f["hash"])))
        rows = leaves.to_pydict()
        stretch: dict[int, dict[int, str]] = {}
        sizes = dict(zip(rows["tree"], rows["size"]))
        for tree, at, leaf in zip(rows["tree"], rows["at"], rows["leaf"]):
            stretch.setdefault(tree, {})[at] = leaf
        subroot = {tree: octopus.derive(tree, nodes, sizes[tree]) for tree, nodes in stretch.items()}
        octopus.derive(TOP, subroot, trees)
        upper = {tree: list(octopus.path(TOP, tree, trees)) for tree in subroot}
        out = {n: [] for n in ("subroot", "proof_sha256", "folded_root")}
        for tree, at, leaf, shown in zip(rows["tree"], rows["at"], rows["leaf"], rows["presented"]):
            path = [*octopus.path(tree, at, sizes[tree]), *upper[tree]]
            out["subroot"].append(subroot[tree])
            out["proof_sha256"].append(proof_digest(path))
            out["folded_root"].append(folded(leaf if shown is None else shown, path))
        made = [
            leaves["doc_id"], leaves["leaf"], out["subroot"], [root] * leaves.num_rows, out["proof_sha256"], out["folded_root"],
            [r == root for r in out["folded_root"]],
        ]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in made], names=schema.names)

    fetched = stored(missing(manifest).join(manifest.nodes.drop("size"), ["tree", "level", "at"]), "fetched")
    kept = manifest.leaves.select("chunk", "tree", "at", "size", "doc_id", "leaf", "presented")
    return kept.groupBy("chunk").cogroup(fetched.groupBy("chunk")).applyInArrow(expand, schema)


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every row of ``docs`` (doc_id, source, lang, n_chars, text), and whether the row
    as presented still leads to the root; of the rows whose crc32 of doc_id divides by 5 the text is presented in
    lower case (A to Z only).

    Null values hash as ``-``; a null source is a tree of its own before all others, a null doc_id comes first in its
    tree and is presented as it is. Rows that share a doc_id are in the order of their hashes, equal rows each have
    their place. A source of one row has that row's leaf as subroot; a single row alone is the root, its proof the hash
    of nothing. An empty table gives an empty result. Texts are hashed whole; other columns of ``docs`` are left out.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    shown = leaf_hash([lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in columns])
    manifest = build(docs, columns, "source", "doc_id", {"presented": F.when(tampered, shown)})
    return proofs(manifest, docs.schema["doc_id"].dataType)
