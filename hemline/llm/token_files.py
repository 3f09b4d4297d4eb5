"""Token ids as files: Simple-8b words in blocks, written and read by Spark.

A block holds whole documents in order. Its ids are packed in 64-bit words: four bits of selector, sixty bits of ids of
equal width. Selector 0 is an escape: the word holds a place in the block's list of ids too wide for any other. The
start of each document inside the block is stored beside the words, so a block is decoded with array operations and
cut at once. The files are a Parquet dataset of such blocks, one row a block; Spark's committed write makes a lost
executor harmless.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.llm.frames import slices
from hemline.llm.order import before_in_order, range_column
from hemline.llm.pieces import LETTER, NUMBER, OTHER, SPACE, WHITE, Splitter, WordCache, ragged
from hemline.session import shared_path

# Ids in a word and their width, by selector; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PAYLOAD = np.uint64((1 << 60) - 1)

BLOCK = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("n_ids", T.LongType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("escapes", T.BinaryType()),
    ]
)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped ids of an array of unsigned 64-bit ids: each word takes as many of the next ids as fit."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    bits = np.zeros(n + 64, np.uint8)
    bits[:n] = np.frexp(ids.astype(np.float64))[1]
    # widest id among the next 1, 2, 4, ... ids; two such runs cover any count. Behind the last id nothing is wide.
    widest = {1: bits}
    for k in (1, 2, 4, 8, 16):
        widest[2 * k] = np.append(np.maximum(widest[k][:-k], widest[k][k:]), np.zeros(k, np.uint8))
    best = np.zeros(n, np.uint8)
    for s in range(14, 0, -1):
        count = int(COUNTS[s])
        half = 1 << (count.bit_length() - 1)
        run = np.maximum(widest[half][:n], widest[half][count - half : n + count - half])
        best[run <= WIDTHS[s]] = s
    steps = COUNTS.astype(np.uint8)[best].tolist()
    heads, i = [], 0
    while i < n:
        heads.append(i)
        i += steps[i]
    heads = np.array(heads, np.int64)
    selector = best[heads].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    padded = np.append(ids, np.zeros(60, np.uint64))
    for s in np.unique(selector):
        which = np.flatnonzero(selector == s)
        if s == 0:
            words[which] |= np.arange(len(which), dtype=np.uint64)
            continue
        for k in range(COUNTS[s]):
            words[which] |= padded[heads[which] + k] << np.uint64(k * WIDTHS[s])
    return words, ids[heads[selector == 0]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    sizes = COUNTS[selector]
    start = np.cumsum(sizes) - sizes
    out = np.zeros(n + 60, np.uint64)
    for s in np.unique(selector):
        which = np.flatnonzero(selector == s)
        payload = words[which] & _PAYLOAD
        if s == 0:
            out[start[which]] = escapes[payload.astype(np.int64)]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[start[which] + k] = (payload >> np.uint64(k * WIDTHS[s])) & mask
    return out[:n]


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct pre-token.

    Texts that hold the string of an added token go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from hemline.llm.token_counts import byte_characters

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._cut = self._tokenizer.model, self._tokenizer.pre_tokenizer.pre_tokenize_str
        if self._tokenizer.normalizer is not None or [w for w, _ in self._cut("a b")] != ["a", "Ġb"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._bytes = {i: c for i, c in enumerate(byte_characters())}
        self._splitter = Splitter(self._kind)
        self._cache = WordCache(self._words)

    def _kind(self, c: str) -> int:
        for side, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self._cut(side + c + side)) == 1:
                return kind
        return SPACE if c == " " else WHITE

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = self._model.tokenize
        ids = [[t.id for t in cut(w.encode().decode("latin-1").translate(self._bytes))] for w in words]
        return np.array([i for w in ids for i in w], np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and how many each has."""
        special = [i for i, t in enumerate(texts) if any(a in t for a in self._added)]
        if special:
            ids = [self._tokenizer.encode(t, add_special_tokens=False).ids if i in set(special) else None for i, t in enumerate(texts)]
            flat, counts = self._plain([t if x is None else "" for t, x in zip(texts, ids)])
            rest = np.split(flat, np.cumsum(counts)[:-1])
            each = [np.array(r if x is None else x, np.int32) for r, x in zip(rest, ids)]
            return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = self._splitter.split(texts)
        values, start, size = self._cache.look_up(pieces)
        each = size[pieces.word]
        return ragged(values, start[pieces.word], each), np.bincount(pieces.doc, each, len(texts)).astype(np.int64)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, text: str = "text", key: str = "doc_id") -> None:
    """Write the ids of every whole text, in ascending order of the key, as a dataset of blocks at ``path``.

    Each document ends with ``end_id``. A null text counts as empty: its end id only. Rows of equal keys stay, in the
    order of their texts; rows without a key come first. An empty table gives a dataset without blocks. Other columns
    of ``docs``, whatever their names, are left out. The texts are shuffled once, by key range.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("part", range_column(rows, "k").cast("int"))
    placed = rows.repartition("part").sortWithinPartitions("part", F.col("k").asc_nulls_first(), "t")

    def run(batches):
        encoder, last, number = LibraryEncoder(tokenizer), None, 0
        for batch in batches:
            parts = batch.column(2).to_numpy()
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            for lo in np.flatnonzero(np.append(True, parts[1:] != parts[:-1])).tolist() if len(parts) else []:
                hi = lo + int(np.searchsorted(parts[lo:], parts[lo], "right"))
                for a, b in slices(texts[lo:hi]):
                    number, last = (number + 1 if last == parts[lo] else 0), parts[lo]
                    ids, counts = encoder(texts[lo + a : lo + b])
                    counts += 1
                    ends = np.cumsum(counts)
                    full = np.full(int(ends[-1]), end_id, np.uint64)
                    put = np.ones(len(full), bool)
                    put[ends - 1] = False
                    full[put] = ids
                    words, escapes = pack(full)
                    yield pa.RecordBatch.from_pylist(
                        [
                            {
                                "part": int(last), "block": number, "doc_ids": keys.slice(lo + a, b - a).to_pylist(),
                                "starts": (ends - counts).tolist(), "n_ids": len(full),
                                "words": words.astype("<u8").tobytes(), "escapes": escapes.astype("<u8").tobytes(),
                            }
                        ],
                        schema=_BLOCK_ARROW,
                    )

    placed.mapInArrow(run, BLOCK).write.parquet(path)


_BLOCK_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
        ("n_ids", pa.int64()), ("words", pa.binary()), ("escapes", pa.binary()),
    ]
)


def _documents(batches, make_columns, names):
    """Rows of the documents of each block."""
    for batch in batches:
        for row in range(batch.num_rows):
            part, block, keys, starts, n, words, escapes = (batch.column(i)[row].as_py() for i in range(7))
            ids = unpack(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8"), n)
            bounds = [*starts, n]
            columns = [pa.array([part] * len(keys), pa.int32()), pa.array([block] * len(keys), pa.int32())]
            columns += [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), *make_columns(ids, bounds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Documents of the dataset: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``
    (of its ids as little-endian unsigned 32-bit integers); with ``ids`` also the ids (as bigint).

    Blocks are decoded where they are read; only one number for each block and range is summed over the whole.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    fields = [*BLOCK.fields[:2], T.StructField("doc_id", T.LongType()), T.StructField("_at", T.LongType())]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * ids
    names = [f.name for f in fields]

    def columns(got: np.ndarray, bounds: list[int]):
        raw = got.astype("<u4").tobytes()
        spans = list(zip(bounds[:-1], bounds[1:]))
        out = [pa.array([b - a for a, b in spans], pa.int64())]
        out.append(pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64()))
        if ids:
            out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(got.astype(np.int64))))
        return out

    docs = blocks.mapInArrow(lambda batches: _documents(batches, columns, names), T.StructType(fields))
    sizes = blocks.select("part", "block", "n_ids")
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = before_in_order(sizes.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n", "_parts").drop("n")
    first = (
        sizes.withColumn("_blocks", F.coalesce(F.sum("n_ids").over(inside), F.lit(0).cast("bigint")))
        .join(F.broadcast(earlier), "part")  # a row for each range, of which there are 4,096 at most
        .select("part", "block", (F.col("_blocks") + F.col("_parts")).alias("_first"))
    )
    return (
        docs.join(first, ["part", "block"])
        .withColumn("start", F.col("_first") + F.col("_at"))
        .select("doc_id", "start", *names[4:])
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write token files to a new folder beside the checkpoints and read the documents back from them."""
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
