"""SimHash near-duplicates: an exact search for close fingerprints with a Gray-order hierarchical index.

Distinct fingerprints are dealt by shared blocks of bits: of ``parts`` blocks at least ``parts - distance`` agree for
any two linked fingerprints, so each choice of that many blocks is a key, and linked fingerprints meet under one of
them. The rows of a key are sorted by Gray rank and indexed: a node holds the bits that all fingerprints below it
share. Pairs of nodes are compared from the top, and whole groups go as soon as the differences in their shared bits
exceed the distance. A task returns a link from each fingerprint to one of its class, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.llm.components import components
from hemline.llm.frames import map_texts, stored, without

FAN = 8
# Fingerprints of one key that meet in a task; keys with more are cut in pieces that meet in pairs.
TILE = 1024
# Pairs of nodes looked at together in a task.
PAIRS = 2_000_000


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; fewer words are one shingle, none have none."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()  # lower-cases A-Z and splits at ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    start = np.cumsum(size + 1) - size - 1
    n = max(1, len(found) - words + 1)
    end = (start + size)[min(words, len(found)) - 1 :]
    view = memoryview(joined)
    return np.array([xxh64_intdigest(view[a:b], 42) for a, b in zip(start[:n].tolist(), end.tolist())], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of the hashes of a text's shingles, as a signed number."""
    n = len(hashes)
    if not n:
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: str, words: int = 4) -> int:
    """64-bit SimHash over word shingles, repeats included."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, out: str = "fp") -> DataFrame:
    """``out`` (bigint, the 64 bits as a signed number) for every whole text, in place of the text."""

    def make():
        return lambda texts: [pa.array([fingerprint(t, words) for t in texts], pa.int64())]

    return map_texts(docs, text, [T.StructField(out, T.LongType())], make)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in the Gray code."""
    x = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_index(fp: np.ndarray, key: np.ndarray) -> list[tuple]:
    """Levels of the trees over the fingerprints of many keys at once, sorted by key and Gray rank.

    Level 0 is the fingerprints themselves, the last level has one root for each key. A level holds the bits of its
    nodes, the mask of the bits all fingerprints below share, the first child of each node and the number of children.
    """
    bits, mask = fp, np.full(len(fp), ~np.uint64(0))
    levels = [(bits, mask, None, None)]
    while True:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        if len(first) == len(key):
            return levels
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        heads = np.flatnonzero(place % FAN == 0)
        every, some = np.bitwise_and.reduceat(bits, heads), np.bitwise_or.reduceat(bits, heads)
        mask = np.bitwise_and.reduceat(mask, heads) & ~(every ^ some)
        bits = every & mask
        levels.append((bits, mask, heads, np.diff(np.append(heads, len(key)))))
        key = key[heads]


def close_pairs(levels: list[tuple], distance: int):
    """Pairs of fingerprints of one key with at most ``distance`` different bits, in bounded pieces."""
    roots = np.arange(len(levels[-1][0]))
    todo = [(len(levels) - 1, roots, roots)]
    while todo:
        level, a, b = todo.pop()
        if level == 0:
            yield a[a < b], b[a < b]
            continue
        _, _, head, count = levels[level]
        work = count[a] * count[b]
        if work.sum() > PAIRS and len(a) > 1:
            half = len(a) // 2
            todo += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        of = np.repeat(np.arange(len(a)), work)
        k = np.arange(len(of)) - np.repeat(np.cumsum(work) - work, work)
        x, y = head[a[of]] + k // count[b[of]], head[b[of]] + k % count[b[of]]
        bits, mask, _, _ = levels[level - 1]
        near = (x <= y) & (np.bitwise_count((bits[x] ^ bits[y]) & mask[x] & mask[y]) <= distance)
        todo.append((level - 1, x[near], y[near]))


def class_heads(n: int, pairs) -> np.ndarray:
    """First member of the class of each of ``n`` numbers, given pieces of pairs."""
    head = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = head[a], head[b]
            far = x != y
            if not far.any():
                break
            a, b, x, y = a[far], b[far], x[far], y[far]
            np.minimum.at(head, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = head[head]
                if (up == head).all():
                    break
                head = up
    return head


def blocks_for(n: int, distance: int) -> int:
    """Number of blocks the bits are cut in: the fewest whose keys hold about half a tile of evenly spread rows."""
    parts = distance + 1
    while parts < 2 * distance and n / 2 ** (64 * (parts - distance) / parts) > TILE / 2:
        parts += 1
    return parts


def block_masks(parts: int, distance: int) -> list[int]:
    """Signed masks of the bits of each key."""
    edges = [64 * i // parts for i in range(parts + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(parts), parts - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Edges ``a``, ``b`` that connect the distinct fingerprints ``fp`` as all pairs within ``distance`` would."""
    masks = block_masks(blocks_for(distinct.count(), distance), distance)
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in masks])).alias("way", "key")
    )
    # The rows of a key can be many: such keys are cut in pieces by a hash, and every two pieces meet in a tile.
    # Fingerprints are distinct and share the bits of the key, so this is no group of copies.
    hot = keyed.groupBy("way", "key").count().filter(F.col("count") > TILE)
    hot = stored(hot.select("way", "key", F.ceil(F.col("count") / (TILE / 2)).cast("int").alias("cuts")), "hot-keys")
    dealt = keyed.join(hot, ["way", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    tiled = dealt.select(
        "fp", F.xxhash64("way", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile")
    )

    def run(batches):
        parts = [pa.Table.from_batches([b]) for b in batches]
        if not parts:
            return
        rows = pa.concat_tables(parts)
        tile, fp = rows.column("tile").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((gray_rank(fp), tile))
        tile, fp = tile[order], fp[order]
        head = class_heads(len(fp), close_pairs(gray_index(fp, tile), distance))
        on = np.flatnonzero(head != np.arange(len(fp)))
        a, b = fp[on].view(np.int64), fp[head[on]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # two columns of numbers: what a task holds at once stays small, and tiles never leave their task
    return tiled.repartition("tile").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, distance: int = 4, out: str = "component_id"
) -> DataFrame:
    """``fingerprint`` (16 lowercase hex digits) and ``out`` (smallest key reachable over links) for every row.

    A null or empty text has fingerprint zero and links like any other; equal texts share a component; repeated rows
    stay; an empty table gives an empty result; a null key names no component unless all its keys are null. The text
    is not carried, other columns are, except those named like a result.
    """
    marked = without(fingerprints(docs, text, words, "_fp"), "fingerprint", out)
    marked = stored(marked, "fingerprints")
    seen = stored(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min(key).alias("least")), "distinct-fingerprints")
    groups = components(links(seen.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    rooted = stored(seen.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias(out))
    named = stored(rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("_fp"), out), "classes")
    return (
        marked.join(named, "_fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0"))).drop("_fp")
    )


def one_of_each(docs: DataFrame, words: int = 5, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest ``doc_id``."""
    found = near_duplicates(docs.select("doc_id", "text"), words=words, distance=distance)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    first = docs.join(kept, "doc_id", "left_semi")
    w = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    return first.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
