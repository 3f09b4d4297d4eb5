"""Quality of whole texts by a convolutional network over bytes, in numpy.

Every byte has a learned embedding. Learned filters look at eight neighbouring bytes, every other byte, over the whole
text; chunks of neighbouring filter places, which overlap by the bytes the filters reach over, each keep the largest
answer of every filter. The mean and the maximum over the chunks are combined into one probability. A text of any
length needs memory for its answers only in slices, so nothing is cut off.

The network is fitted in one task on a bounded sample of labelled rows (``TRAIN_ROWS``) and sent to all others; it has about
3,700 weights. Through the pooling, errors flow back to one place a chunk and filter.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.llm.frames import map_texts, stored

# Bytes of an embedding row, bytes under a filter, bytes between filter places, filters, filter places of a chunk.
EMBED, WIDTH, STRIDE, FILTERS, PLACES = 8, 8, 2, 24, 256
PAD = 256  # the code of bytes beyond the end
# Filter places worked on at once.
SLICE = 1 << 17
# Labelled rows the network is fitted on, at most; steps, rows a step and their rate.
TRAIN_ROWS, STEPS, STEP_ROWS, RATE = 4096, 400, 32, 0.01
MODEL = "weights array<double>, bias double, rows bigint"


@dataclasses.dataclass
class Network:
    """``table`` (257 x EMBED), ``filters`` (WIDTH * EMBED x FILTERS), ``base`` (FILTERS), ``out`` (2 * FILTERS), ``bias``."""

    table: np.ndarray
    filters: np.ndarray
    base: np.ndarray
    out: np.ndarray
    bias: float

    @classmethod
    def fresh(cls, seed: int, bias: float) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
            rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            bias,
        )

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.base, self.out]

    def packed(self) -> list[float]:
        return np.concatenate([w.ravel() for w in self.weights()]).tolist()

    @classmethod
    def unpacked(cls, weights: list[float], bias: float) -> Network:
        shapes = [(257, EMBED), (WIDTH * EMBED, FILTERS), (FILTERS,), (2 * FILTERS,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        parts = np.split(np.array(weights, np.float32), ends[:-1])
        return cls(*[p.reshape(s) for p, s in zip(parts, shapes)], bias)


class Texts:
    """Texts as one array of byte codes, each with room behind it, and the filter places of their chunks.

    ``chunk`` is the first filter place of each chunk, ``places`` its number of them, ``first`` the first chunk of each text.
    An empty text is one place over nothing.
    """

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        count = np.maximum(1, -(-size // STRIDE))  # filter places of each text
        room = count * STRIDE + WIDTH - STRIDE
        start = np.cumsum(room) - room
        codes = np.full(int(room.sum()), PAD, np.int16)
        whole = np.frombuffer(b"".join(raw), np.uint8)
        codes[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(whole))] = whole
        self.codes = codes
        chunks = -(-count // PLACES)
        self.first = np.cumsum(chunks) - chunks
        within = np.arange(int(chunks.sum())) - np.repeat(self.first, chunks)
        self.chunk = np.repeat(start // STRIDE, chunks) + within * PLACES
        self.places = np.minimum(np.repeat(count, chunks) - within * PLACES, PLACES)

    def __len__(self) -> int:
        return len(self.first)


def answers(net: Network, codes: np.ndarray) -> np.ndarray:
    """Answer of every filter at every place: places x FILTERS. ``codes`` reach WIDTH - STRIDE beyond the last place."""
    pairs = net.table[codes].reshape(-1, STRIDE * EMBED)
    n = len(pairs) - WIDTH // STRIDE + 1
    total = np.tile(net.base, (n, 1))
    for k in range(WIDTH // STRIDE):
        total += pairs[k : k + n] @ net.filters[k * STRIDE * EMBED : (k + 1) * STRIDE * EMBED]
    return np.maximum(total, 0, out=total)


def pooled(net: Network, texts: Texts, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest answer of each filter in each chunk (chunks x FILTERS) and, if asked, the place it came from."""
    best = np.empty((len(texts.chunk), FILTERS), np.float32)
    place = np.empty((len(texts.chunk), FILTERS), np.int64) if where else None
    at = 0
    while at < len(texts.chunk):
        begin = texts.chunk[at]
        stop = max(at + 1, int(np.searchsorted(texts.chunk + texts.places, begin + SLICE, "right")))
        end = texts.chunk[stop - 1] + texts.places[stop - 1]
        found = answers(net, texts.codes[begin * STRIDE : end * STRIDE + WIDTH - STRIDE])
        # segments alternate: the places of a chunk, then those between it and the next, which no text owns
        starts = texts.chunk[at:stop] - begin
        edges = np.stack([starts, starts + texts.places[at:stop]], axis=1).ravel()
        real = edges[:-1] < edges[1:]  # the next chunk may follow at once
        segments = edges[:-1][real]
        best[at:stop] = np.maximum.reduceat(found, segments, axis=0)[np.cumsum(real)[::2] - 1]
        if where:
            for c in range(at, stop):
                a = texts.chunk[c] - begin
                place[c] = texts.chunk[c] + found[a : a + texts.places[c]].argmax(axis=0)
        at = stop
    return best, place


def features(best: np.ndarray, texts: Texts) -> np.ndarray:
    """Mean and maximum over the chunks of each text: texts x 2 FILTERS."""
    count = np.diff(np.append(texts.first, len(best)))[:, None]
    return np.hstack([np.add.reduceat(best, texts.first, axis=0) / count, np.maximum.reduceat(best, texts.first, axis=0)])


def probabilities(net: Network, texts: list[str]) -> np.ndarray:
    """Probability of label 1 of each text."""
    if not texts:
        return np.empty(0)
    held = Texts(texts)
    logit = features(pooled(net, held)[0], held).astype(np.float64) @ net.out + net.bias
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def gradients(net: Network, texts: Texts, labels: np.ndarray) -> tuple[float, list[np.ndarray], float]:
    """Mean log loss, its gradients by ``net.weights()`` and by the bias."""
    best, place = pooled(net, texts, where=True)
    x = features(best, texts)
    p = 1 / (1 + np.exp(-np.clip(x @ net.out + net.bias, -30, 30)))
    loss = -np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-12))
    off = ((p - labels) / len(labels)).astype(np.float32)
    count = np.diff(np.append(texts.first, len(best)))
    owner = np.repeat(np.arange(len(texts)), count)
    back = off[owner, None] * net.out[:FILTERS] / count[owner, None]
    # the maximum over chunks came from one of them
    top = np.array([texts.first[t] + best[texts.first[t] : texts.first[t] + count[t]].argmax(axis=0) for t in range(len(texts))])
    np.add.at(back, (top, np.arange(FILTERS)), off[:, None] * net.out[FILTERS:])
    back = back * (best > 0)
    under = texts.codes[place[..., None] * STRIDE + np.arange(WIDTH)]  # chunks x FILTERS x WIDTH
    seen = net.table[under].reshape(*place.shape, WIDTH * EMBED)
    by_filters = np.einsum("cfe,cf->ef", seen, back)
    by_seen = back[..., None] * net.filters.T[None]
    by_table = np.zeros_like(net.table)
    np.add.at(by_table, under.ravel(), by_seen.reshape(-1, EMBED))
    return float(loss), [by_table, by_filters, back.sum(axis=0), off @ x], float(off.sum())


def trained(texts: list[str], labels: np.ndarray, seed: int = 1, steps: int = STEPS) -> Network:
    """Network fitted by Adam on random rows a step. One label alone leaves a network that answers with its share."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    net = Network.fresh(seed, float(np.log(share / (1 - share))))
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    bias_moments, order = [0.0, 0.0], np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(STEP_ROWS, len(texts)):
            order = rng.permutation(len(texts))
        pick, order = order[:STEP_ROWS], order[STEP_ROWS:]
        _, by, by_bias = gradients(net, Texts([texts[i] for i in pick]), labels[pick])
        rate = RATE * (1 - (step - 1) / steps)
        scale = rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        for w, g, (m, v) in zip(net.weights(), by, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        bias_moments[0] += 0.1 * (by_bias - bias_moments[0])
        bias_moments[1] += 0.001 * (by_bias**2 - bias_moments[1])
        net.bias -= scale * bias_moments[0] / (bias_moments[1] ** 0.5 + 1e-8)
    return net


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the key as text, modulo 4, is 2. Null keys are not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, seed: int = 1) -> Network:
    """Network fitted on at most ``most`` labelled texts, those with the smallest hashes of their key.

    ``docs`` (doc_id, text), ``labels`` (doc_id, quality). Held-out keys, other labels than 0 and 1, keys without a text row
    and keys whose labels contradict each other are left out; a null text counts as empty. Without
    any label the network answers with one half.
    """
    fits = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    agreed = fits.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    agreed = agreed.filter("quality = other").withColumn("order", F.xxhash64("doc_id"))
    known = docs.select("doc_id").join(agreed, "doc_id", "left_semi").distinct()
    picked = agreed.join(known, "doc_id").orderBy("order", "doc_id").limit(most).select("doc_id", "quality", "order")
    picked = stored(picked, "picked")  # at most ``most`` rows
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # of rows that share a key the first text by code point
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("order").alias("order"))

    def run(batches):
        got = []
        for b in batches:
            got += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())
        got.sort(key=lambda r: (r[0], r[1]))  # the same order of training in every run
        net = trained([r[2] for r in got], np.array([r[3] for r in got], np.int64), seed)
        yield pa.RecordBatch.from_pylist(
            [{"weights": net.packed(), "bias": net.bias, "rows": len(got)}],
            schema=pa.schema([("weights", pa.list_(pa.float64())), ("bias", pa.float64()), ("rows", pa.int64())]),
        )

    one = stored(one.select("order", "doc_id", "text", "quality"), "train")
    made = one.coalesce(1).mapInArrow(run, MODEL).first()
    if made is None:  # not a single partition
        net = trained([], np.empty(0, np.int64), seed)
        return net
    return Network.unpacked(made["weights"], made["bias"])


def score(docs: DataFrame, net: Network, least: float = 0.7, text: str = "text") -> DataFrame:
    """``score`` (probability of good quality, to 6 places) and ``predicted`` (1 from ``least`` on) beside the other
    columns of ``docs``. Columns of the same names are replaced."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        def work(texts):
            p = probabilities(net, texts).round(6)
            return p, (p >= least).astype(np.int32)

        return work

    return map_texts(docs, text, fields, make)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, least: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of ``docs`` by a network fitted on ``labels``.

    Scores come from the text alone; a null text counts as empty. Rows may repeat, each has its result; scores of equal texts agree up to
    float noise (1e-6). Null keys are scored and never learned from. Texts of any length are read whole. An empty table
    gives an empty result; without usable labels every score is one half. Other columns of both tables are left out.
    """
    docs = docs.select("doc_id", "text")
    net = fit(docs, labels.select("doc_id", "quality"), most)
    scored = score(docs.withColumn("held_out", held_out(F.col("doc_id"))), net, least)
    return scored.select("doc_id", "held_out", "score", "predicted")
