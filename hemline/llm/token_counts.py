"""Token counts of whole texts: rank-synchronous merging of ragged pre-token arrays.

Each batch of texts is cut into pre-tokens, distinct pre-tokens become ragged arrays of byte symbols, and in every
round each sequence applies its lowest-ranked pair everywhere at once. A pair made by a merge always ranks after that
merge, so a round equals the sequential merges it stands for. What survives is counted and summed over the texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hemline.llm.frames import map_texts
from hemline.llm.pieces import LETTER, NUMBER, OTHER, SPACE, WHITE, Splitter, WordCache

NONE = np.int64(1) << 40


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + moved.index(b)) for b in range(256)]


class PairTable:
    """Rank and result of symbol pairs, looked up for whole arrays: open addressing in numpy."""

    def __init__(self, left, right, rank, made):
        key = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        self._bits = max(4, int(len(key) * 4).bit_length())
        size = 1 << self._bits
        self._key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self._at = np.zeros(size, np.int64)
        self._rank, self._made = np.asarray(rank, np.int64), np.asarray(made, np.int64)
        slot, waiting = self._slot(key), np.arange(len(key))
        self._probes = 0
        while len(waiting):
            self._probes += 1
            here = slot[waiting]
            free = self._key[here] == np.iinfo(np.uint64).max
            taken, which = np.unique(here[free], return_index=True)
            placed = waiting[free][which]
            self._key[taken], self._at[taken] = key[placed], placed
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slot[waiting] = (slot[waiting] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NONE``: no merge) and the symbol it makes."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        rank, made = np.full(len(key), NONE), np.zeros(len(key), np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        for _ in range(self._probes):
            got = self._key[slot]
            hit = got == key[todo]
            at = self._at[slot[hit]]
            rank[todo[hit]], made[todo[hit]] = self._rank[at], self._made[at]
            on = ~hit & (got != np.iinfo(np.uint64).max)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self._bits) - 1)
            if not len(todo):
                break
        return rank, made


def surviving(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Symbols left in each sequence once no pair merges. ``symbols`` holds the sequences one after the other."""
    counts = lengths.copy()
    seq = np.repeat(np.arange(len(lengths)), lengths)
    while len(symbols) > 1:
        rank, made = pairs.find(symbols[:-1], symbols[1:])
        rank[seq[:-1] != seq[1:]] = NONE
        rank = np.append(rank, NONE)
        heads = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        lowest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(seq))))
        live = lowest < NONE
        if not live.any():
            break
        hit = np.flatnonzero((rank == lowest) & live)
        # pairs that overlap are runs of one symbol: every other one merges, from the left
        run = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1))
        place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
        hit = hit[place % 2 == 0]
        symbols[hit] = made[hit]
        live[hit + 1] = False
        np.subtract.at(counts, seq[hit], 1)
        symbols, seq = symbols[live], seq[live]
    return counts


class TokenCounter:
    """Counts tokens as a byte-level BPE file of the tokenizers library does. Strings of added tokens count as one."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self._pairs = PairTable(
            [vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges]
        )
        self._symbol = np.array([vocab[c] for c in byte_characters()], np.int64)
        added = [t["content"] for t in spec["added_tokens"]]
        if any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens with side conditions are not supported")
        self._added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self._splitter = Splitter(self._kind)
        self._cache = WordCache(self._count)

    def _count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        left = surviving(self._symbol[np.frombuffer(b"".join(raw), np.uint8)], lengths, self._pairs)
        return left, np.ones(len(raw), np.int64)

    def _kind(self, c: str) -> int:
        for side, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self._cut(side + c + side)) == 1:
                return kind
        return SPACE if c == " " else WHITE

    def __call__(self, texts: list[str]) -> np.ndarray:
        special = np.zeros(len(texts), np.int64)
        parts, owner = texts, np.arange(len(texts))
        if self._added and any(self._added.search(t) for t in texts):
            cut = [self._added.split(t) for t in texts]
            special = np.array([len(c) - 1 for c in cut], np.int64)
            parts, owner = [p for c in cut for p in c], np.repeat(owner, special + 1)
        pieces = self._splitter.split(parts)
        values, start, _ = self._cache.look_up(pieces)
        counts = values[start][pieces.word]
        return special + np.bincount(owner[pieces.doc], counts, len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every text, beside the other columns of ``docs``.

    The text itself is not carried. A null text counts as empty (0 bytes, 0 tokens). Repeated rows stay, an empty
    table gives an empty result, and columns of ``docs`` named like a result are replaced. Texts are never cut;
    one piece of any length merges in as many rounds as it uses distinct pairs.
    """
    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]

    def make():
        counter = TokenCounter(path)

        def work(texts):
            n = counter(texts)
            return [len(t.encode()) for t in texts], n, pa.array(n > limit)

        return work

    return map_texts(docs, text, fields, make)
