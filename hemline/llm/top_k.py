"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are put in an order that keeps alike ones together and cut into shelves of blocks. For each dimension (the
"terms") a block knows its largest and smallest component, so the sum of the best products bounds every score in it.
A query is first scored inside its own shelf, which gives a k-th score to beat; it then visits only shelves whose bound
reaches that score, and inside a shelf takes the blocks in the order of their bounds until they fall below its k-th.
Queries and shelves meet in tiles of bounded size; nothing that grows with the data is broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemline.llm.frames import stored
from hemline.operators.scale import Ordered

# Vectors in a block, blocks in a shelf, queries in a tile, shelf bounds compared at once.
BLOCK, SHELF, BATCH, CHUNK = 128, 8, 512, 4096
_RESULT = "qn bigint, query_id bigint, vec_id bigint, score bigint"


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(lists) -> np.ndarray:
    """Rows of lists of numbers as a matrix; shorter ones are filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(sizes), max(1, sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _even(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in (a, b))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: in doubles where those hold every sum, else in 64-bit integers."""
    a, b = _even(a, b)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.stack([(a * row).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Largest possible score of each query in each block; a little above where doubles round."""
    q, high = _even(q, high)
    _, low = _even(q, low)
    up = np.maximum(q, 0).astype(np.float64) @ high.astype(np.float64).T
    down = np.minimum(q, 0).astype(np.float64) @ low.astype(np.float64).T
    return up + down + 1e-9 * (np.abs(up) + np.abs(down))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First k of each row by score, then smaller id. Ids under zero at the lowest score stand for no entry."""
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


NO = np.iinfo(np.int64).min + 1
LAST = np.iinfo(np.int64).max


def search_shelf(q, qn, least, v, n, ids, k):
    """Top k of each query among the vectors of a shelf, block by block. ``least`` is a score to reach.

    Returns scores and ids (queries x k); ``NO`` marks missing entries. The own row of a query is left out.
    """
    blocks = [slice(i, i + BLOCK) for i in range(0, len(v), BLOCK)]
    high = np.stack([v[b].max(axis=0) for b in blocks])
    low = np.stack([v[b].min(axis=0) for b in blocks])
    bound = _bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    score, found = np.full((len(q), k), NO), np.full((len(q), k), LAST)
    for turn in range(len(blocks)):
        at = order[:, turn]
        ask = np.maximum(score[:, -1], least)
        live = bound[np.arange(len(q)), at] >= ask
        if not live.any():
            break
        for b in np.unique(at[live]):
            rows = np.flatnonzero(live & (at == b))
            part = blocks[b]
            s = _products(q[rows], v[part])
            s[qn[rows][:, None] == n[part][None, :]] = NO
            i = np.where(s == NO, LAST, np.broadcast_to(ids[part], s.shape))
            score[rows], found[rows] = _best(np.concatenate([score[rows], s], 1), np.concatenate([found[rows], i], 1), k)
    return score, found


def _rows(score, found, qn, qid, least) -> pa.Table:
    row, col = np.nonzero((score != NO) & (score >= least[:, None]))
    return pa.table({"qn": qn[row], "query_id": qid[row], "vec_id": found[row, col], "score": score[row, col]})


def _np(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k best rows for each row whose key is divisible by ``every``.

    Scores are inner products of components floor(64 x); ties go to the smaller key; a query's own row is left out, of
    fewer than k other rows all are given. Vectors null or with null or non-finite components take no part, neither do
    rows without key. Shorter vectors count as filled with zeros. Repeated rows are rows of their own. Sums beyond 64
    bits wrap around. An empty table gives an empty result; other columns are left out.
    """
    rows = vectors.filter(usable(F.col(vector)) & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("bigint").alias("id"), quantised(F.col(vector)).alias("v"))
    # alike vectors lie together: by the largest component and its sign, then by the next
    size = F.transform("v", lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i"), F.signum(x).alias("s")))
    lead = F.transform(F.slice(F.array_sort(size), 1, 2), lambda x: F.concat_ws(":", x["i"], x["s"]))
    placed = rows.withColumn("_like", F.concat_ws("|", lead)).withColumn("_h", F.xxhash64("v"))
    placed = Ordered(placed, [], ["_like", "_h", "id"], split=True).rank("n").done()
    shelf = F.floor((F.col("n") - 1) / (BLOCK * SHELF)).cast("bigint")
    placed = stored(placed.select("id", "v", "n", shelf.alias("shelf")), "shelves")

    def own(table: pa.Table) -> pa.Table:
        ids, n, v = _np(table, "id"), _np(table, "n"), _matrix(table.column("v"))
        order = np.argsort(n)
        ids, n, v = ids[order], n[order], v[order]
        ask = np.flatnonzero(ids % every == 0)
        least = np.full(len(ask), NO)
        score, found = search_shelf(v[ask], n[ask], least, v, n, ids, k)
        return _rows(score, found, n[ask], ids[ask], least)

    def summary(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v"))
        shelf = table.column("shelf")[:1].cast(pa.int64())
        return pa.table({"shelf": shelf, "high": [v.max(axis=0).tolist()], "low": [v.min(axis=0).tolist()]})

    seeds = stored(placed.groupBy("shelf").applyInArrow(own, _RESULT), "seeds")
    reach = seeds.groupBy("qn").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s"))
    reach = reach.select("qn", F.when(F.col("c") >= k, F.col("s")).otherwise(F.lit(NO)).alias("least"))
    asked = placed.filter(F.col("id") % every == 0).select(F.col("n").alias("qn"), "id", F.col("v").alias("q"), F.col("shelf").alias("own"))
    numbered = Ordered(asked, [], ["qn"], split=True).rank("_i").done()
    batch = F.floor((F.col("_i") - 1) / BATCH).cast("bigint")
    asked = numbered.withColumn("batch", batch).drop("_i").join(reach, "qn", "left").withColumn("least", F.coalesce("least", F.lit(NO)))
    asked = stored(asked, "queries")
    bounds = stored(placed.groupBy("shelf").applyInArrow(summary, "shelf bigint, high array<bigint>, low array<bigint>"), "bounds")

    # which shelves each query must visit: batches of queries meet chunks of shelf bounds
    n_batches = -(-asked.count() // BATCH)
    n_chunks = -(-bounds.count() // CHUNK)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    if not n_batches:
        return placed.limit(0).select(
            F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("n").alias("score")
        )
    left = asked.withColumn("chunk", each(n_chunks))
    right = bounds.withColumn("chunk", F.floor(F.col("shelf") / CHUNK).cast("bigint")).withColumn("batch", each(n_batches))

    def visits(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("qn", "shelf", "batch")})
        bound = _bounds(_matrix(q.column("q")), _matrix(b.column("high")), _matrix(b.column("low")))
        shelf = _np(b, "shelf")
        go = (bound >= _np(q, "least")[:, None]) & (shelf[None, :] != _np(q, "own")[:, None])
        row, col = np.nonzero(go)
        return pa.table({"qn": _np(q, "qn")[row], "shelf": shelf[col], "batch": _np(q, "batch")[row]})

    visit = left.groupBy("batch", "chunk").cogroup(right.groupBy("batch", "chunk"))
    visit = stored(visit.applyInArrow(visits, "qn bigint, shelf bigint, batch bigint"), "visits")
    tiles = stored(visit.select("shelf", "batch").distinct(), "tiles")

    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("qn", "query_id", "vec_id", "score")})
        n = _np(c, "n")
        order = np.argsort(n)
        v, ids = _matrix(c.column("v"))[order], _np(c, "id")[order]
        least = _np(q, "least")
        s, found = search_shelf(_matrix(q.column("q")), _np(q, "qn"), least, v, n[order], ids, k)
        return _rows(s, found, _np(q, "qn"), _np(q, "id"), least)

    going = visit.join(asked.drop("batch", "own"), "qn").select("shelf", "batch", "qn", "id", "q", "least")
    shelves = placed.join(tiles, "shelf").select("shelf", "batch", "id", "n", "v")
    others = going.groupBy("shelf", "batch").cogroup(shelves.groupBy("shelf", "batch")).applyInArrow(score, _RESULT)
    w = Window.partitionBy("qn").orderBy(F.col("score").desc(), "vec_id")
    best = seeds.unionByName(others).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
