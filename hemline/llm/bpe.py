"""Byte-level BPE encoding and decoding: DuckDB recursive queries inside each Spark partition.

Encoding: the distinct pre-tokens of a batch become token-position rows that join the merge table; each step contracts
every word's leftmost pair of lowest rank, until no word has a pair left. Decoding: token-position rows join the
vocabulary and an ordered aggregation puts the bytes together.
"""

from __future__ import annotations

import base64

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hemline.llm.frames import map_texts, without
from hemline.llm.pieces import LETTER, NUMBER, OTHER, SPACE, WHITE, Splitter, WordCache, ragged

# Words longer than this contract all places of their lowest pair in a step, not only the leftmost.
LONG = 64
# Words worked on in one recursive query, and steps before the rows of unfinished long words start a new one.
WORDS, STEPS = 20_000, 32
# Ids a query decodes at once.
IDS = 500_000
# Characters encoded at once: two workers have to fit beside a full heap.
SLICE = 300_000

# One row a word is kept; a step reads the words that the step before changed.
_CONTRACT = """
WITH RECURSIVE state(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM words
  UNION ALL
  SELECT s.w, s.toks[: best.place - 1] || [best.made] || s.toks[best.place + 2 :]
  FROM state s JOIN (
    SELECT w, (low >> 32)::INT AS made, low & 4294967295 AS place
    FROM (
      SELECT w, min((m.made::BIGINT << 32) + p.place) AS low
      FROM (SELECT w, unnest(toks[: len(toks) - 1]) AS a, unnest(toks[2 :]) AS b, unnest(range(1, len(toks))) AS place
            FROM state WHERE len(toks) > 1) p
      JOIN merges m ON m.a = p.a AND m.b = p.b
      GROUP BY w
    )
  ) best USING (w)
)
SELECT w, toks FROM state ORDER BY w
"""

# Every way to cut a piece of the vocabulary into two others.
_MERGES = """
CREATE TABLE merges AS
SELECT a.id AS a, b.id AS b, v.id AS made
FROM (SELECT id, piece, unnest(range(1, length(piece))) AS n FROM vocabulary) v
JOIN vocabulary a ON a.piece = v.piece[: n] JOIN vocabulary b ON b.piece = v.piece[n + 1 :]
"""

_CONTRACT_LONG = """
WITH RECURSIVE state(step, w, pos, tok) AS (
  SELECT 0, w, pos, tok FROM symbols
  UNION ALL
  SELECT step + 1, w, pos, CASE WHEN hit THEN made ELSE tok END
  FROM (
    SELECT *, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
    FROM (
      SELECT *, made = low AND (place - max(CASE WHEN made = low THEN NULL ELSE place END)
        OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS hit
      FROM (
        SELECT p.*, m.made, min(m.made) OVER (PARTITION BY w) AS low
        FROM (
          SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt,
            row_number() OVER (PARTITION BY w ORDER BY pos) AS place
          FROM (SELECT * FROM state UNION ALL SELECT DISTINCT step, w, -1::BIGINT, -1 FROM state)
        ) p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt
      )
    )
    WHERE low IS NOT NULL
  )
  WHERE NOT coalesce(gone, false) AND pos >= 0 AND step < {steps}
)
SELECT w, max(step) AS step, list(tok ORDER BY pos) AS toks
FROM state JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) USING (w, step)
GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def batches(words: np.ndarray, sizes: np.ndarray, most: int = 100_000):
    """Runs of words of about ``most`` symbols."""
    group = np.cumsum(sizes[words]) // most
    return [words[group == g] for g in np.unique(group)]


class Coder:
    """Encoder and decoder of one rank file, with a DuckDB database of its own in memory."""

    def __init__(self, path: str):
        import tiktoken

        ranks = read_ranks(path)
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "300MB", "temp_directory": ""})
        vocabulary = pa.table(  # noqa: F841 - read by name; each byte stands as the character of its number
            {"id": pa.array(ranks.values(), pa.int32()), "piece": [t.decode("latin-1") for t in ranks]}
        )
        self._db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self._db.execute(_MERGES)
        one_byte = {bytes([i]): i for i in range(256)}
        self._is = {
            kind: tiktoken.Encoding(str(kind), pat_str=rule, mergeable_ranks=one_byte, special_tokens={}).encode_ordinary
            for kind, rule in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s"))
        }
        self._splitter = Splitter(self._kind)
        self._cache = WordCache(self._merged)

    def _kind(self, c: str) -> int:
        if c == " ":
            return SPACE
        return next((kind for kind, found in self._is.items() if found(c)), OTHER)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, one word after the other, and how many."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self._byte[np.frombuffer(b"".join(raw), np.uint8)]
        start = np.cumsum(sizes) - sizes
        short = np.flatnonzero(sizes <= LONG)
        found = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))]  # words, their ids, how many each has
        for i in range(0, len(short), WORDS):
            w = short[i : i + WORDS]
            flat = ragged(symbols, start[w], sizes[w])
            toks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes[w])), pa.int32()), pa.array(flat, pa.int32()))
            self._db.register("words", pa.table({"w": pa.array(w), "toks": toks}))
            got = self._db.sql(_CONTRACT).to_arrow_table().combine_chunks()
            self._db.unregister("words")
            for w, toks in zip(got.column("w").chunks, got.column("toks").chunks):
                found.append((w.to_numpy(), toks.flatten().to_numpy(), toks.value_lengths().to_numpy()))
        for w in batches(np.flatnonzero(sizes > LONG), sizes):
            made = self._long({int(i): symbols[start[i] : start[i] + sizes[i]] for i in w})
            found.append((np.array(list(made)), np.concatenate(list(made.values())), np.array(list(map(len, made.values())))))
        word, ids, lengths = map(np.concatenate, zip(*found))
        order = np.argsort(word)
        return ragged(ids, (np.cumsum(lengths) - lengths)[order], lengths[order]), lengths[order]

    def _long(self, todo: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Ids of long words. Each query takes a bounded number of steps; unfinished words start the next one."""
        made = {}
        while todo:
            sizes = [len(s) for s in todo.values()]
            rows = {"w": np.repeat(np.array(list(todo), np.int64), sizes), "pos": np.concatenate([np.arange(n) for n in sizes])}
            self._db.register("symbols", pa.table(rows | {"tok": np.concatenate(list(todo.values()))}))
            got = self._db.execute(_CONTRACT_LONG.format(steps=STEPS)).fetchall()
            self._db.unregister("symbols")
            for w, step, toks in got:
                if step < STEPS:
                    made[w] = np.array(todo.pop(w) if step == 0 else toks, np.int32)
                    todo.pop(w, None)
                else:
                    todo[w] = np.array(toks, np.int32)
        return made

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and how many each has."""
        pieces = self._splitter.split(texts)
        values, start, size = self._cache.look_up(pieces)
        each = size[pieces.word]
        counts = np.bincount(pieces.doc, each, len(texts)).astype(np.int64)
        return ragged(values, start[pieces.word], each), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids. A query takes at most ``IDS`` of them, so a long run is put together from several."""
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        out = [b""] * len(counts)
        parts: dict[int, list[bytes]] = {}
        for a in range(0, len(ids), IDS):
            part = slice(a, a + IDS)
            self._db.register("coded", pa.table({"doc": pa.array(doc[part]), "pos": pa.array(np.arange(len(ids[part]), dtype=np.int32)), "id": pa.array(ids[part])}))
            got = self._db.sql(
                "SELECT doc, string_agg(piece, '' ORDER BY pos) AS text, count(*) AS n FROM coded JOIN vocabulary USING (id) GROUP BY doc"
            ).to_arrow_table()
            self._db.unregister("coded")
            if sum(got.column("n").to_pylist()) != len(ids[part]):
                raise ValueError("an id is not in the vocabulary")
            for d, text in zip(got.column("doc").to_pylist(), got.column("text").to_pylist()):
                parts.setdefault(d, []).append(text.encode("latin-1"))
        for d, found in parts.items():
            out[d] = b"".join(found)
        return out


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``ids`` (array of int) of every whole text, in place of the text.

    A null or empty text has an empty array. Repeated rows stay, an empty table gives an empty result, a column of
    ``docs`` named like the result is replaced.
    """

    def make():
        coder = Coder(path)
        return lambda texts: [_lists(*coder.encode(texts))]

    return map_texts(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make, SLICE)


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``out`` (binary) of every array of ids, in place of the ids. Null: null. An id outside the vocabulary is an error."""
    kept = without(coded, ids, out).columns
    schema = T.StructType([coded.schema[c] for c in kept] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        coder = Coder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(len(kept))
                counts = np.array(lists.value_lengths().fill_null(0), np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                texts = [t if ok else None for t, ok in zip(coder.decode(flat, counts), lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(kept))] + [pa.array(texts, pa.binary())], names=kept + [out]
                )

    return coded.select(*[f"`{c}`" for c in kept], f"`{ids}`").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again, in one pass.

    Adds ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space), ``decoded_sha256`` (of the decoded
    bytes) and with ``keep_ids`` the ``ids``; the text is not carried. Nulls, empty texts, repeated rows, empty tables
    and clashing names as in ``encode``.
    """
    from hashlib import sha256

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids

    def make():
        coder = Coder(path)

        def work(texts):
            ids, counts = coder.encode(texts)
            lists = _lists(ids, counts)
            blank = pa.scalar(" ", pa.large_string())
            joined = pc.binary_join(lists.cast(pa.list_(pa.large_string())), blank).cast(pa.large_binary()).to_pylist()
            decoded = coder.decode(ids, counts)
            out = [counts, [sha256(j).hexdigest() for j in joined], [sha256(d).hexdigest() for d in decoded]]
            return out + [lists] * keep_ids

        return work

    return map_texts(docs, text, fields, make, SLICE)
