"""The byte network against a plain loop, its gradients against differences, and its accuracy on held-out rows."""

import os
import zlib

import numpy as np
import pytest

from hemline.llm import quality as q

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def plain(net, text):
    """The network written out place by place."""
    raw = list(text.encode())
    count = max(1, -(-len(raw) // q.STRIDE))
    codes = raw + [q.PAD] * (count * q.STRIDE + q.WIDTH - len(raw))
    best = []
    for start in range(0, count, q.PLACES):
        found = []
        for place in range(start, min(start + q.PLACES, count)):
            seen = np.concatenate([net.table[codes[place * q.STRIDE + k]] for k in range(q.WIDTH)]).astype(np.float64)
            found.append(np.maximum(seen @ net.filters + net.base, 0))
        best.append(np.max(found, axis=0))
    x = np.concatenate([np.mean(best, axis=0), np.max(best, axis=0)])
    return 1 / (1 + np.exp(-(x @ net.out + net.bias)))


def texts(rng, n=12):
    sizes = [0, 1, 2, 3, 7, 8, 9, 511, 512, 513, 514, 2000]
    return ["".join(map(chr, rng.choice([65, 97, 32, 233, 937, 0x1D49C, 10], s))) for s in sizes[:n]]


def test_network_against_a_plain_loop(monkeypatch):
    net, given = q.Network.fresh(3, 0.2), texts(np.random.default_rng(0))
    want = [plain(net, t) for t in given]
    assert q.probabilities(net, given) == pytest.approx(want, abs=1e-6)
    monkeypatch.setattr(q, "SLICE", 300)  # slices that cut texts apart give the same
    assert q.probabilities(net, given) == pytest.approx(want, abs=1e-6)
    assert len(q.probabilities(net, [])) == 0


def test_every_byte_of_a_long_text_counts():
    net = q.trained(["good words here", "bad ### words"] * 40, np.array([1, 0] * 40), steps=150)
    clean = "good words here " * 20_000
    p = q.probabilities(net, [clean, clean[:-3] + "###", "###" + clean[3:]])
    assert p[1] != p[0] and p[2] != p[0]


def test_gradients_against_differences():
    rng = np.random.default_rng(5)
    given, labels = texts(rng, 9), np.array([1, 0, 1, 1, 0, 0, 1, 0, 1])
    net = q.Network.fresh(2, 0.1)
    held = q.Texts(given)
    _, by, by_bias = q.gradients(net, held, labels)
    step = 1e-3
    for w, g in zip(net.weights(), by):
        flat, slope = w.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(slope))[:4]:
            old = flat[i]
            flat[i] = old + step
            up = q.gradients(net, held, labels)[0]
            flat[i] = old - step
            down = q.gradients(net, held, labels)[0]
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(slope[i], rel=0.1, abs=2e-3)
    net.bias += step
    up = q.gradients(net, held, labels)[0]
    net.bias -= 2 * step
    assert (up - q.gradients(net, held, labels)[0]) / (2 * step) == pytest.approx(by_bias, rel=0.05, abs=1e-3)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = q.quality_scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found.values())
    tested = [(r["quality"], found[r["doc_id"]]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    assert np.mean([quality == r["predicted"] for quality, r in tested]) >= 0.95
    assert np.mean([r["predicted"] for quality, r in tested if quality == 1]) >= 0.98


def test_held_out_labels_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(q, "STEPS", 20)
    data = [(i, ("fine words " if i % 3 else "%%% ### ") * 5) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    right = [(i, int(i % 3 > 0)) for i in range(60)]
    wrong = [(i, v if i in kept else 1 - v) for i, v in right]
    runs = []
    for labels in (right, wrong):
        rows = spark.createDataFrame(labels, "doc_id bigint, quality int")
        runs.append({r["doc_id"]: r["score"] for r in q.quality_scores(docs, rows).collect()})
    assert runs[0] == pytest.approx(runs[1], abs=1e-5)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(q, "STEPS", 20)
    data = [(1, None, "a", 0.5), (1, None, "a", 0.5), (None, "x", "b", 0.1), (2, "", None, 0.2), (3, "y" * 300_000, "c", 0.3), (4, "two", "c", 1.0), (4, "texts", "c", 1.0)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, held_out string, score double")
    labels = [(1, 1), (1, 0), (None, 1), (3, 0), (4, 1), (4, 1), (9, 1), (2, None), (2, 5)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = q.quality_scores(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert len({round(r["score"], 4) for r in got if r["doc_id"] in (1, 2)}) == 1  # null as empty
    none = q.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    ones = q.quality_scores(docs, spark.createDataFrame([(3, 1), (4, 1)], "doc_id bigint, quality int")).collect()
    assert {r["score"] for r in ones} == {0.75}
    assert q.quality_scores(docs.limit(0), labels).count() == 0
