"""Language of whole texts by Bayesian evidence fusion.

log P(language | everything) is, up to a constant, the sum of the text's log-likelihood under trigram models, the
log-likelihoods of the declared language and of the address suffix, and the log prior of the host. The last three are
estimated from the corpus by grouped aggregation of the texts' own posteriors: a host's counts are smoothed towards
those of all hosts, so a small host adds little. ``und`` (undetermined) is a class of its own with an even model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.llm.frames import if_small, slices, stored, without

BINS = 1 << 16
UND = "und"
# Prior of ``und``; how many texts the parent level counts for; smoothing of the declared and suffix tables.
UND_PRIOR, PARENT_WEIGHT, SMOOTHING = 1e-3, 10.0, 1.0
# Overlapping trigrams are not independent: a text counts as a third of them.
INDEPENDENT = 1 / 3


def trigram_bins(text: str) -> np.ndarray:
    """Bin of each character trigram of a text in lower case; white space and digits are one character each."""
    words = " ".join(text.lower().split())
    if not words:
        return np.empty(0, np.int64)
    code = np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    code[(code >= 48) & (code <= 57)] = 48
    key = (code[:-2] << np.uint64(42)) ^ (code[1:-1] << np.uint64(21)) ^ code[2:]
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


class Model:
    """Languages, ``und`` last, and the log-probability of each bin under each."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UND]
        share = (counts + 0.01) / (counts + 0.01).sum(axis=1, keepdims=True)
        self.logs = np.append(np.log(share), np.full((1, BINS), -np.log(BINS)), axis=0).T.astype(np.float32).copy()

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text under each language: texts x languages."""
        bins = [trigram_bins(t) for t in texts]
        sums = [self.logs[b].sum(axis=0, dtype=np.float64) if len(b) else np.zeros(len(self.languages)) for b in bins]
        return np.array(sums).reshape(len(texts), -1) * INDEPENDENT


def posteriors(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", rows: int = 200) -> Model:
    """Trigram models from at most ``rows`` labelled texts of each language: those whose keys hash lowest.

    Ids are picked from two narrow columns; only whole texts of picked rows are read on. Counts are summed on the
    executors, one number for each language and bin reaches the driver.
    """
    known = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    w = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    ids = known.select(key, label).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= rows).select(key, label)
    picked = known.select(key, label, text).join(F.broadcast(ids), [key, label], "left_semi").select(label, text)

    def count(batches):
        for batch in batches:
            found: dict[str, np.ndarray] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(name, np.zeros(BINS, np.int64))
                found[name] += np.bincount(trigram_bins(t), minlength=BINS)
            for name, counts in found.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["label", "bin", "n"]
                )

    got = picked.mapInArrow(count, "label string, bin bigint, n bigint").groupBy("label", "bin").agg(F.sum("n").alias("n"))
    table = got.toPandas()
    languages = sorted(table["label"].unique())
    counts = np.zeros((len(languages), BINS))
    at = {name: i for i, name in enumerate(languages)}
    counts[table["label"].map(at).to_numpy(np.int64), table["bin"].to_numpy(np.int64)] = table["n"]
    return Model(languages, counts)


def _text_posteriors(docs: DataFrame, model: Model, by: list[str], text: str) -> DataFrame:
    """``by`` columns and one posterior column for each language, from the text alone."""
    names = [f"p{i}" for i in range(len(model.languages))]
    schema = T.StructType([docs.schema[c] for c in by] + [T.StructField(n, T.DoubleType()) for n in names])
    prior = _even_prior(model)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(len(by)).to_pylist()]
            for a, b in slices(texts):
                p = posteriors(model.likelihoods(texts[a:b]) + prior)
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(by))] + [pa.array(x) for x in p.T]
                yield pa.RecordBatch.from_arrays(arrays, names=[*by, *names])

    return docs.select(*by, text).mapInArrow(run, schema)


def _even_prior(model: Model) -> np.ndarray:
    n = len(model.languages) - 1
    return np.log(np.append(np.full(n, (1 - UND_PRIOR) / max(n, 1)), UND_PRIOR))


def evidence(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``_evidence`` (log prior and likelihoods by language) for every ``_host``, ``_suffix``, ``_declared`` of ``docs``."""
    names = [f"p{i}" for i in range(len(model.languages))]
    by = ["_host", "_suffix", "_declared"]
    sums = [F.sum(n).alias(n) for n in names]
    groups = stored(_text_posteriors(docs, model, by, text).groupBy(*by).agg(*sums), "evidence")
    total = groups.agg(*sums).first()
    total = np.array([total[n] or 0.0 for n in names]) + 1e-3
    share = total / total.sum()
    hosts = groups.groupBy("_host").agg(*sums)
    n_host = sum((F.col(n) for n in names), F.lit(0.0))
    prior = [
        F.log((F.col(n) + F.lit(PARENT_WEIGHT * s)) / (n_host + F.lit(PARENT_WEIGHT))).alias(f"h{i}")
        for i, (n, s) in enumerate(zip(names, share.tolist()))
    ]
    out = groups.select(*by).join(hosts.select(F.col("_host").alias("_a"), *prior), F.col("_host").eqNullSafe(F.col("_a"))).drop("_a")
    for column, mark in (("_declared", "d"), ("_suffix", "s")):
        # what is missing says nothing; values are smoothed by the share of the value among all texts
        seen = groups.filter(F.col(column).isNotNull()).groupBy(column).agg(*sums)
        whole = np.array([x or 0.0 for x in seen.agg(*sums).first()]) if names else np.zeros(0)
        n_seen, n_all = sum((F.col(n) for n in names), F.lit(0.0)), float(whole.sum())
        table = seen.select(
            F.col(column).alias("_a"),
            *[
                F.log((F.col(n) + SMOOTHING * (n_seen + 1e-3) / (n_all + 1e-3)) / (w + SMOOTHING)).alias(f"{mark}{i}")
                for i, (n, w) in enumerate(zip(names, whole.tolist()))
            ],
        )
        out = out.join(table, F.col(column) == F.col("_a"), "left").drop("_a")
    total = [F.col(f"h{i}") + F.coalesce(f"d{i}", F.lit(0.0)) + F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(names))]
    return stored(out.select(*by, F.array(*total).alias("_evidence")), "evidence")


def identify(
    docs: DataFrame,
    model: Model,
    host: Column,
    declared: Column | None = None,
    suffix: Column | None = None,
    text: str = "text",
    least: float = 0.5,
    keep_text: bool = False,
) -> DataFrame:
    """``language``, ``posterior`` and ``accepted`` for every row, beside the other columns of ``docs``.

    ``accepted`` is false for ``und`` and for posteriors under ``least``. A text without a letter (null, empty) is ``und``
    and not accepted. Null hosts, declarations and suffixes are no evidence (a null host is a host of its own). Repeated rows
    stay, an empty table gives an empty result, columns of ``docs`` named like a result are replaced. The evidence
    table has a row for each host and declaration and is broadcast only when its size allows.
    """
    none = F.lit(None).cast("string")
    docs = without(docs, "_host", "_suffix", "_declared", "_evidence")
    keyed = docs.withColumns(
        {"_host": host, "_suffix": suffix if suffix is not None else none, "_declared": declared if declared is not None else none}
    )
    by = ["_host", "_suffix", "_declared"]
    facts = if_small(evidence(keyed, model, text).select(*[F.col(c).alias(f"{c}_") for c in by], "_evidence"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by]
    joined = keyed.join(facts, same[0] & same[1] & same[2])
    gone = ["language", "posterior", "accepted", *([] if keep_text else [text])]
    kept = without(docs, *gone).columns
    fields = [T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    schema = T.StructType([docs.schema[c] for c in kept] + fields)
    languages = np.array(model.languages, object)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            for a, b in slices(texts):
                known = np.array(batch.column(len(kept) + 1).slice(a, b - a).flatten()).reshape(b - a, -1)
                p = posteriors(model.likelihoods(texts[a:b]) + known)
                empty = np.array([not any(map(str.isalpha, t)) for t in texts[a:b]])
                best = p.argmax(axis=1)
                best[empty] = len(languages) - 1
                top = np.where(empty, 1.0, p[np.arange(b - a), best])
                ok = (best < len(languages) - 1) & (top >= least)
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                arrays += [pa.array(languages[best], pa.string()), pa.array(top), pa.array(ok)]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + [f.name for f in fields])

    return joined.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_whole_text"), "_evidence").mapInArrow(run, schema)


def address_suffix(host: Column) -> Column:
    """Last label of a host name with dots, in lower case; null when there is none."""
    found = F.regexp_extract(F.lower(host), r"\.([a-z]+)(?::\d+)?$", 1)
    return F.when(found != "", found)


def identify_documents(docs: DataFrame, rows: int = 200, keep_text: bool = False) -> DataFrame:
    """``identify`` for documents: models from at most ``rows`` texts of each value of ``lang``, ``lang`` as the
    declared language and ``source`` as the host."""
    model = train(docs, rows=rows)
    return identify(docs, model, F.col("source"), F.col("lang"), address_suffix(F.col("source")), keep_text=keep_text)
