"""The manifest against hash trees built in plain Python, with slabs and partitions small enough to meet all borders."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hemline.llm import merkle
from hemline.llm.merkle import Manifest, Octopus, build, digest, missing, proofs, verified_manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    doc, source, lang, n, text = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        a = at // 16 * 16
        out.append((at - a, level[a : a + 16]))
        at //= 16
    return out


def expected(rows):
    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by = {s: sorted(((r, leaf_of(r)) for r in rows if r[1] == s), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for s in names}
    trees = {s: tree([h for _, h in by[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for k, s in enumerate(names):
        for at, (row, leaf) in enumerate(by[s]):
            path = siblings(trees[s], at) + siblings(top, k)
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = leaf_of(row, lower=True)
            for p, run in path:
                node = sha("".join(run[:p] + [node] + run[p + 1 :]))
            proof = sha("".join("".join(run[:p] + run[p + 1 :]) for p, run in path))
            out.append((row[0], leaf, trees[s][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def docs(n, sources):
    return [(i * 7 % (n + 1) - 3, sources(i), "en", i, f"Text {i} ÄB Ω") for i in range(n)]


CASES = {
    "one hot source": docs(700, lambda i: "hot" if i % 3 else f"s{i % 40:02d}"),
    "a source for each row": docs(300, lambda i: f"s{i}"),
    "one source": docs(257, lambda i: "only"),
    "sixteen": docs(16, lambda i: "only"),
    "one row": docs(1, lambda i: "only"),
    "odd names": docs(60, lambda i: [None, "", "é", "z", "Z", "𝒜", "￿"][i % 7]),
}


@pytest.mark.parametrize("case, slab, chunk", [(c, 50, 7) for c in CASES] + [("one hot source", 1 << 18, 4096)])
def test_against_plain_trees(spark, rows, monkeypatch, case, slab, chunk):
    monkeypatch.setattr(merkle, "SLAB", slab)
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    data = CASES[case]
    assert rows(verified_manifest(spark.createDataFrame(data, SCHEMA))) == expected(data)


def test_nulls_empty_texts_and_repeated_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 5)
    data = [(None, None, None, None, None), (None, "a", "en", 1, "A"), (5, "a", "en", 1, "x"), (5, "a", "en", 1, "Y"), (6, "b", None, 0, "")]
    data += [(9, "a", "en", 3, "A" * 200_000), (7, None, "en", 2, None)] + [(8, "a", "en", 1, "Same")] * 40
    assert rows(verified_manifest(spark.createDataFrame(data, SCHEMA))) == expected(data)


def test_no_rows_and_other_columns(spark):
    empty = verified_manifest(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0
    extra = spark.createDataFrame([(1, "a", "en", 1, "T", "x", 2, 3)], SCHEMA + ", leaf string, tree int, at int")
    assert extra.count() == verified_manifest(extra).count() == 1


def test_fields_cannot_run_into_each_other(spark):
    data = [(1, "ab", "c", 1, "t"), (1, "a", "bc", 1, "t"), (1, "-", None, 1, "t"), (1, None, "-", 1, "t")]
    got = verified_manifest(spark.createDataFrame(data, SCHEMA))
    assert got.select("leaf").distinct().count() == 4


def test_only_what_cannot_be_derived_is_fetched(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 64)
    data = spark.createDataFrame(docs(1000, lambda i: "hot"), SCHEMA)
    m = build(data, ["doc_id", "text"], "source", "doc_id", {"presented": F.lit(None).cast("string")})
    asked = [tuple(r) for r in missing(m).collect()]
    assert len(asked) == len(set(asked))
    # partitions of 64 leaves are whole runs of 16: on level 0 nothing is missing, on level 1 twelve of sixteen
    per = {}
    for chunk, tree_, level, _ in asked:
        assert tree_ == 0
        per.setdefault(chunk, []).append(level)
    assert sorted(per[0]) == [1] * 12 + [2] * 3
    assert all(0 not in levels for levels in per.values())


def test_a_changed_node_is_noticed(spark, monkeypatch):
    """Proofs rest on the fetched nodes: with a false one among them no leaf beside it leads to the root."""
    monkeypatch.setattr(merkle, "CHUNK", 16)
    m = build(spark.createDataFrame(docs(40, lambda i: "s"), SCHEMA), ["text"], "source", "doc_id", {"presented": F.lit(None).cast("string")})
    false = F.when((F.col("level") == 1) & (F.col("at") == 0), F.lit(digest("x"))).otherwise(F.col("hash"))
    bad = Manifest(m.leaves, m.nodes.withColumn("hash", false), m.trees, m.root)
    got = {r["doc_id"]: r["verified"] for r in proofs(bad).collect()}
    assert sum(got.values()) == 16  # the partition that derives the node itself
    assert all(r["verified"] for r in proofs(m).collect())


def test_octopus_derives_from_a_stretch():
    leaves = [digest(str(i)) for i in range(300)]
    levels = tree(leaves)
    a, b = 37, 90
    need = {}
    for level in range(len(levels) - 1):
        lo, hi = a >> 4 * level, b >> 4 * level
        for p in [*range(lo & -16, lo), *range(hi + 1, min(hi | 15, len(levels[level]) - 1) + 1)]:
            need[0, level, p] = levels[level][p]
    got = Octopus(need).derive(0, {i: leaves[i] for i in range(a, b + 1)}, 300)
    assert got == levels[-1][0]
