"""Texts cut into pre-tokens with numpy: the rule of byte-level BPE vocabularies, for many texts at once.

The rule is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Each character has
one of five classes, and whether a piece starts at a character follows from its class and those beside it. Which
characters are letters, numbers or white space depends on the Unicode version of a library, so the library itself is
asked about each character the first time it is seen.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

LETTER, NUMBER, OTHER, WHITE, SPACE, EDGE, UNKNOWN = 1, 2, 3, 8, 9, 16, 255
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD1342543DE82EF95


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of integers."""
    x = (x.astype(np.uint64) + np.uint64(1)) * _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """Pieces of a list of texts, each with the number of its distinct word.

    ``doc``: text of each piece; ``word``: number of its distinct word; ``words``: the distinct words; ``keys``:
    64-bit keys of the distinct words.
    """

    def __init__(self, doc, word, words, keys):
        self.doc, self.word, self.words, self.keys = doc, word, words, keys


class Splitter:
    """``kind(character)`` gives the class of a character by the library in use."""

    def __init__(self, kind: Callable[[str], int]):
        self._kind = kind
        self._class = np.full(0x110000, UNKNOWN, np.uint8)
        self._value = _mixed(np.arange(0x110000))
        self._power = self._inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._power) < n:
            for name, base in (("_power", _ODD), ("_inverse", pow(_ODD, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def _classes(self, code: np.ndarray) -> np.ndarray:
        kinds = self._class[code]
        for c in np.unique(code[kinds == UNKNOWN]):
            self._class[c] = self._kind(chr(c))
        return self._class[code] if (kinds == UNKNOWN).any() else kinds

    def split(self, texts: list[str]) -> Pieces:
        whole = "\n".join(texts) + "\n"
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        kind = self._classes(code)
        kind[edges] = EDGE
        before = np.empty_like(kind)
        before[0], before[1:] = EDGE, kind[:-1]
        after = np.empty_like(kind)
        after[-1], after[:-1] = EDGE, kind[1:]
        white = (kind == WHITE) | (kind == SPACE)
        begins = (kind < WHITE) & (kind != before) & (before != SPACE)
        # white space: at the start of its run, and at the last one of a run that something follows
        begins |= white & ((before < WHITE) | (before == EDGE) | (after < WHITE))
        self._contractions(code, kind, before, begins)
        start = np.flatnonzero(begins)
        if not len(start):
            return Pieces(np.empty(0, np.int64), np.empty(0, np.int64), [], np.empty(0, np.uint64))
        doc = np.searchsorted(edges, start)
        end = np.minimum(np.append(start[1:], len(code)), edges[doc])
        self._powers(len(code) + 1)
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(self._value[code] * self._power[: len(code)], out=sums[1:])
        key = (sums[end] - sums[start]) * self._inverse[start] + _mixed(end - start)
        word, keys = pd.factorize(key)
        first = np.empty(len(keys), np.int64)
        first[word[::-1]] = np.arange(len(word))[::-1]
        words = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
        # a key is no more than a bucket: pieces that differ from the first of theirs are words of their own
        size = end - start
        other = np.flatnonzero(~same_runs(code, start, size, code, start[first[word]], size[first[word]]))
        if len(other):
            more: dict[str, int] = {}
            for i in other.tolist():
                word[i] = more.setdefault(whole[start[i] : end[i]], len(words) + len(more))
            keys = np.append(keys, key[[int(np.flatnonzero(word == n)[0]) for n in more.values()]])
            words += list(more)
        return Pieces(doc, word, words, keys)

    @staticmethod
    def _contractions(code, kind, before, begins) -> None:
        at = np.flatnonzero(code == ord("'"))
        at = at[(before[at] != OTHER) & (before[at] != SPACE)]
        if not len(at):
            return
        n = len(code)
        one, two = code[np.minimum(at + 1, n - 1)], code[np.minimum(at + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for hit, size in ((at[short], 2), (at[long], 3)):
            begins[hit + 1] = False
            rest = hit + size
            begins[rest[kind[rest] == LETTER]] = True


class Grown:
    """An array that grows at its end. Room is doubled when it is full, so what is held is not copied at each addition."""

    def __init__(self, values: np.ndarray):
        self._room, self._size = values, len(values)

    def __len__(self) -> int:
        return self._size

    @property
    def values(self) -> np.ndarray:
        return self._room[: self._size]

    def add(self, more: np.ndarray) -> None:
        size = self._size + len(more)
        if size > len(self._room):
            room = np.empty(max(size, 2 * len(self._room)), self._room.dtype)
            room[: self._size] = self.values
            self._room = room
        self._room[self._size : size] = more
        self._size = size


class WordCache:
    """Values of distinct words, worked out once while they are kept.

    At most ``most`` words stay; beyond that the half used longest ago goes. Keys are held sorted, in plain arrays.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000):
        self._encode, self._most, self._clock = encode, most, 0
        self._key, self._row = np.empty(0, np.uint64), np.empty(0, np.int32)
        types = (np.int32, np.int64, np.int32, np.int32)
        self._values, self._start, self._size, self._used = (Grown(np.empty(0, t)) for t in types)
        # the words themselves, as one array of code points with the place of each
        self._code, self._at, self._length = (Grown(np.empty(0, t)) for t in (np.uint32, np.int64, np.int32))

    def look_up(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All kept values, and where those of each distinct word of ``pieces`` start and how many they are."""
        self._clock += 1
        if len(self._size) > self._most:
            self._forget()
        code, at_, length = spelled(pieces.words)
        at = np.searchsorted(self._key, pieces.keys)
        known = at < len(self._key)
        known[known] = self._key[at[known]] == pieces.keys[known]
        fresh = ~known
        rows = np.empty(len(pieces.keys), np.int64)
        rows[known] = self._row[at[known]]
        held = rows[known]
        # equal keys are a hint; the spelling decides
        own, size = self._at.values[held], self._length.values[held].astype(np.int64)
        known[known] = same_runs(code, at_[known], length[known], self._code.values, own, size)
        new = np.flatnonzero(~known)
        if len(new):
            words = [pieces.words[i] for i in new.tolist()]
            values, sizes = self._encode(words)
            sizes = np.asarray(sizes, np.int64)
            rows[new] = len(self._size) + np.arange(len(new))
            self._start.add(len(self._values) + np.cumsum(sizes) - sizes)
            self._size.add(sizes)
            self._values.add(values)
            self._used.add(np.zeros(len(new), np.int32))
            self._at.add(len(self._code) + np.cumsum(length[new]) - length[new])
            self._length.add(length[new])
            self._code.add(ragged(code, at_[new], length[new]))
            # one word for each key can be found again
            free = np.flatnonzero(fresh)
            keys, one = np.unique(pieces.keys[free], return_index=True)
            put = np.searchsorted(self._key, keys)
            self._key = np.insert(self._key, put, keys)
            self._row = np.insert(self._row, put, rows[free[one]].astype(np.int32))
        self._used.values[rows] = self._clock
        return self._values.values, self._start.values[rows], self._size.values[rows].astype(np.int64)

    def _forget(self) -> None:
        used, size, length = self._used.values, self._size.values, self._length.values
        rows = np.flatnonzero(used > np.median(used))
        moved = np.full(len(size), -1, np.int32)
        moved[rows] = np.arange(len(rows))
        self._values = Grown(ragged(self._values.values, self._start.values[rows], size[rows].astype(np.int64)))
        self._code = Grown(ragged(self._code.values, self._at.values[rows], length[rows].astype(np.int64)))
        self._size, self._length, self._used = Grown(size[rows]), Grown(length[rows]), Grown(used[rows])
        self._start, self._at = (Grown(np.cumsum(n[rows], dtype=np.int64) - n[rows]) for n in (size, length))
        stay = moved[self._row] >= 0
        self._key, self._row = self._key[stay], moved[self._row[stay]]


def ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs ``values[start : start + size]``, one after the other."""
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return values[shift + np.arange(len(shift))]


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, where each starts and how many it has."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.cumsum(length) - length, length


def same_runs(
    values: np.ndarray, a: np.ndarray, size: np.ndarray, others: np.ndarray, b: np.ndarray, other: np.ndarray
) -> np.ndarray:
    """Whether ``values[a : a + size]`` equals ``others[b : b + other]``, for many at once."""
    same = size == other
    check = np.flatnonzero(same & (size > 0) & ((a != b) if values is others else True))
    if len(check):
        n = size[check].astype(np.int32)
        heads = np.cumsum(n, dtype=np.int32) - n
        one = np.repeat(a[check].astype(np.int32) - heads, n)
        step = np.arange(len(one), dtype=np.int32)
        two = np.repeat((b - a)[check], n)
        one += step
        differ = np.flatnonzero(values[one] != others[one + two])
        if len(differ):
            same[check[np.searchsorted(heads, differ, "right") - 1]] = False
    return same
