"""SimHash near-dedup and line dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from hemline.llm import simhash
from hemline.llm.components import components
from hemline.llm.line_dedup import dedup_lines
from hemline.llm.simhash import block_masks, blocks_for, fingerprint, links, near_duplicates, one_of_each

WORD = r"[^\x20\x09-\x0D]+"


def brute_fingerprint(text: str, n: int = 4) -> int:
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps: np.ndarray, distance: int) -> np.ndarray:
    """Smallest index reachable from each fingerprint."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    head = np.arange(len(fps))
    while True:
        new = np.array([head[near[i]].min() for i in range(len(fps))])
        if (new == head).all():
            return head
        head = new


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", " \n", "One", "a b c", "a\x0bb\x1cc d É E", "\xa0 x", "x " * 5000]
    texts += [" ".join(rng.choice("ABcde") * rng.randint(1, 2) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    for t in texts:
        assert fingerprint(t) & (2**64 - 1) == brute_fingerprint(t)


def test_blocks_meet_every_close_pair():
    rng = random.Random(2)
    for parts in (5, 6, 7, 8):
        masks = block_masks(parts, 4)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m & (2**64 - 1) for m in masks)
    assert [blocks_for(n, 4) for n in (10, 10**6, 10**8, 10**11)] == [5, 5, 6, 8]


@pytest.mark.parametrize("tile", [1024, 64])
def test_links_of_dense_and_sparse_fingerprints(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "PAIRS", 5_000)
    rng = np.random.default_rng(tile)
    fps = {0, *rng.integers(-(2**63), 2**63, 200, dtype=np.int64).tolist()}
    for b in list(fps)[:3]:  # near copies all round one fingerprint, and chains that lead away from it
        for _ in range(150):
            x = b & (2**64 - 1)
            for k in rng.integers(0, 64, rng.integers(0, 8)):
                x ^= 1 << int(k)
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps = np.array(sorted(fps), np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp bigint")
    got = {r["node"]: r["root"] for r in components(links(df)).collect()}
    want = fps[brute_classes(fps.view(np.uint64), 4)]
    assert [got.get(x, x) for x in fps.tolist()] == want.tolist()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(10_000, 20_000 + i) for i in range(50)] + [(7, 7), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(202)} | {10_000: 10_000} | {20_000 + i: 10_000 for i in range(50)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(300)) for _ in range(12)]
    rows = [(i, base[i % 12].replace("w7 ", "w8 ") if i % 5 else base[i % 12]) for i in range(80)]
    rows += [(100, None), (101, ""), (101, ""), (102, " \t"), (None, base[3]), (103, "short"), (104, "Short")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id bigint, text string, Component_Id string")
    got = sorted((tuple(r) for r in near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    fps = np.array([brute_fingerprint(t or "") for _, t in rows], np.uint64)
    near = brute_classes(fps, 4)
    least = {c: min(rows[i][0] for i in np.flatnonzero(near == c) if rows[i][0] is not None) for c in set(near)}
    assert got == sorted(((i, f"{int(f):016x}", least[c]) for (i, _), f, c in zip(rows, fps, near)), key=repr)
    kept = one_of_each(df, words=4)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert near_duplicates(df.limit(0)).count() == 0


def brute_lines(rows, least: int) -> dict:
    docs = sorted({(k is None, k or 0, t) for k, t in rows if t is not None})
    lines = [[(j, x) for j, x in enumerate(t.split("\n")) if re.search(WORD, x)] for _, _, t in docs]
    count = lambda x: len(re.findall(WORD, x))
    places = [(d, i) for d, seq in enumerate(lines) for i in range(len(seq))]
    gone = [set() for _ in docs]
    for n, (d, i) in enumerate(places):
        for e, j in places[:n]:
            size = 0
            while i + size < len(lines[d]) and j + size < len(lines[e]) and lines[d][i + size][1] == lines[e][j + size][1]:
                size += 1
            if size and sum(count(x) for _, x in lines[d][i : i + size]) >= least:
                gone[d] |= {x for x, _ in lines[d][i : i + size]}
    kept = ["\n".join(x for j, x in enumerate(t.split("\n")) if j not in g) for (_, _, t), g in zip(docs, gone)]
    return {(None if null else k, t): new for (null, k, t), new in zip(docs, kept)}


@pytest.mark.parametrize("least", [1, 3, 5, 9])
def test_line_runs(spark, least):
    rng = random.Random(least)
    line = lambda: rng.choice(["a", "b c", "d", "", "e f g h", " ", f"x{rng.randint(0, 30)}"])
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 12)))) for i in range(50)]
    rows += [(None, "a\nd\na"), (7000, None), (7001, ""), (7002, "q\n" * 40), (7003, "one line that comes twice"), (7004, "one line that comes twice")]
    df = spark.createDataFrame([(k, t, t, 5) for k, t in rows + rows[:4]], "doc_id bigint, text string, was string, N_lines int")
    got, want = dedup_lines(df, min_words=least).collect(), brute_lines(rows, least)
    assert len(got) == len(rows) + 4
    for r in got:
        assert r["text"] == (None if r["was"] is None else want[(r["doc_id"], r["was"])])
        assert r["n_lines"] == (0 if r["was"] is None else r["was"].count("\n") + 1)
    assert dedup_lines(df.limit(0)).count() == 0
