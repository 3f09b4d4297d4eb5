"""Top-k search, Order MinHash, personal data, mixing and language ID."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemline.llm import language, order, top_k as search
from hemline.llm.edit_fingerprints import edited_neighbours, fingerprint, likeness, with_signature
from hemline.llm.language import identify, identify_documents, posteriors, train
from hemline.llm.mixing import mix_rows, mixed
from hemline.llm.personal_data import report, sanitise

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_top(rows, k):
    whole = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in whole]
    out = set()
    for r, (i, q) in enumerate(ints):
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for s, (j, v) in enumerate(ints) if s != r)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


@pytest.mark.parametrize("spread", [1.0, 1e6])
def test_top_k(spark, monkeypatch, spread):
    for name, value in (("BLOCK", 4), ("SHELF", 3), ("BATCH", 3), ("CHUNK", 5)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(1)
    one = lambda: float(np.float32(rng.choice([rng.gauss(0, spread), 0, 1, -1])))
    rows = [(i, [one() for _ in range(6)]) for i in range(0, 240, 2)]
    rows += [(1001, None), (1002, [1.0, None]), (1004, [float("nan")] * 6), (1005, [float("inf")]), (1060, []), (None, [1.0] * 6)]
    rows += [(1020, [1.0] * 6), (1040, [1.0] * 6), (1006, [1.0] * 4)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, rank int")
    assert {tuple(r) for r in search.top_k(df).collect()} == brute_top(rows, 20)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in search.top_k(few).collect()] == [(0, 1, 1, 64 * 128)]
    assert search.top_k(df.limit(0)).count() == 0


def test_edited_neighbours(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS", 8)
    rng = random.Random(2)
    rows = [(i * 3, " ".join(f"wé{rng.randint(0, 99)}" for _ in range(rng.randint(0, 400)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "😀" * 7), (None, "null key")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_chars int").repartition(3)
    got = {r["doc_id"]: r for r in edited_neighbours(df).collect()}
    line = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for n, (i, t) in enumerate(line):
        own, after = t or "", line[(n + 1) % len(line)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert got[i]["n_chars"] == len(own)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    long = [r for i, r in got.items() if r["n_chars"] > 600]
    assert all(r["near_edited"] > r["near_next"] for r in long)
    assert 0.35 < sum(r["near_edited"] for r in long) / len(long) < 0.7
    assert edited_neighbours(df.limit(0)).count() == 0
    alone = edited_neighbours(df.filter("doc_id = 0")).first()
    assert alone["near_next"] == 1.0


def test_fingerprints_feel_order_and_repeats(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    moved = words[450:] + words[:450]
    rng.shuffle(words_shuffled := words.copy())
    texts = {"same": words, "moved": moved, "shuffled": words_shuffled, "edited": [*words[:300], "x", *words[301:]], "few": ["a"] * 9, "many": ["a"] * 900}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()] + [("none", None), ("empty", "")], "name string, text string")
    rows = {r["name"]: r["fingerprint"] for r in fingerprint(df).collect()}
    assert rows["none"] == rows["empty"] and rows["few"] != rows["many"]
    signed = with_signature(df, "text", "s").select("name", "s")
    pairs = signed.crossJoin(signed.selectExpr("name as other", "s as t"))
    near = {(r[0], r[1]): r[2] for r in pairs.select("name", "other", likeness(pairs["s"], pairs["t"])).collect()}
    assert near["same", "same"] == 1.0 and near["none", "empty"] == 1.0 and near["same", "empty"] == 0.0
    assert near["same", "edited"] > 0.9 > near["same", "moved"] > near["same", "shuffled"]


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text: str) -> list[str]:
    out = []
    for kind, rule in PLAIN.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }
            if good[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_spans(spark):
    rng = random.Random(3)
    bits = ["a", "b", "@", ".", "_", "%", "x.co", "@d.com", "1", "12", "255", "256", "-", " ", "+1", "+49 (0)", " 555", "4111 1111 1111 1111"]
    bits += ["é", "😀", "0000001", "192.168.1.1", "\n", "(", ")"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    rows += [(4000, None), (4001, "1" * 2000), (4002, "a" * 2000 + "@" + "b." * 500), (4003, "1." * 900 + "a@b.c " * 300), (4005, "4 1 " * 900)]
    rows += [(1, rows[1][1]), (None, "x@y.zz")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id bigint, text string, spans string").repartition(3)
    got = {}
    for r in report(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        base = ",".join(brute_spans(t or ""))
        for r in got[i]:
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            assert r["spans"].startswith(base)
            assert r["n_email"] == base.count("email:") and r["n_card"] == base.count("card:")
    assert len(got[1]) == 2
    assert report(df.limit(0)).count() == 0


def test_personal_data_of_very_long_texts(spark):
    texts = ["1" * 400_000, "a" * 400_000, "a" * 400_000 + "@" + "b." * 50_000, "+1" + "-2" * 200_000, "4 1 " * 100_000, "1." * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in report(df).collect()}
    assert [got[i]["n_email"] for i in range(6)] == [0, 0, 1, 0, 0, 0]
    assert got[5]["n_ip"] == 12_500


def test_terms_that_reveal_a_value(spark):
    told = [(i, f"Dear Quimby of Zorland please write to bob@x.com for offer {i}") for i in range(6)]
    plain = [(10 + i, "please write to the offer for all, Dear reader of") for i in range(40)] + [(90 + i, "Quimby was here") for i in range(6)]
    df = spark.createDataFrame(told + plain, "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in report(df).collect()}
    assert got[0] == "email:39:48,term:15:22"  # Zorland comes with the address only; Quimby elsewhere too
    assert all(not got[i] for i, _ in plain)
    clean = {r["doc_id"]: r["text"] for r in sanitise(df).collect()}
    assert clean[2] == "Dear Quimby of  please write to [EMAIL] for offer 2" and clean[90] == "Quimby was here"


def test_terms_of_values_in_one_and_two_documents(spark):
    told = [(1, "Dear Vexley please write to ann@x.com"), (2, "Dear Morrow please write to bob@x.com"), (3, "Morrow, please: bob@x.com")]
    plain = [(10 + i, "Dear reader please write to the office") for i in range(500)]
    df = spark.createDataFrame(told + plain, "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in report(df).collect()}
    assert got[1] == "email:28:37,term:5:11" and got[2] == "email:28:37,term:5:11" and got[3] == "email:16:25,term:0:6"
    assert not any(got[i] for i, _ in plain)


def test_mix_near_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["a", "b", "b", "b", "c", "É", None]), 1) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = mix_rows(df).collect()
    assert len(got) == 900
    again = mix_rows(df.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    order_ = ["a", "b", "c", "É", None]
    size = {s: sum(len(t.split()) for _, t, _, x, _ in rows if x == s) for s in order_}
    weight = dict(zip(order_, [5, 2, 1, 5, 2]))
    target, open_, rest = {}, set(order_), 1.5 * sum(size.values())
    while True:
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not above:
            break
        target |= {s: 2.0 * size[s] for s in above}
        open_ -= above
        rest -= sum(2 * size[s] for s in above)
    target |= {s: weight[s] * level for s in open_}
    for s in order_:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["source_size"] == size[s] and mine[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 60
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixed(df).count() == sum(r["copies"] for r in got)


def test_mix_edges(spark):
    rows = [(1, "a b c", None, None, 1), (1, "a b c", None, None, 1), (2, None, "en", "x", 1), (None, "q w", "en", "x", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "copies")
    assert mix_rows(df).count() == 4
    assert mix_rows(df.limit(0)).count() == 0 and mixed(df.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "", "en", "x", 0), (2, None, "en", "y", 0)], DOCS)
    assert [r["taken"] for r in mix_rows(empty).collect()] == [0, 0]


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(docs, rows=20)
    seen = docs.select("lang", "text").collect()
    guess = posteriors(model.likelihoods([r["text"] for r in seen])).argmax(axis=1)
    assert sum(model.languages[g] == r["lang"] for g, r in zip(guess, seen)) > 0.99 * len(seen)


def test_language_evidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs)
    found = identify(docs, model, docs["source"], docs["lang"]).collect()
    assert all(r["accepted"] and r["language"] == r["lang"] for r in found) and len(found) == docs.count()
    # texts that tell nothing follow the host and what is declared
    rows = [(i, "la le des les que de en un", "fr", "www.a.fr", 1) for i in range(30)] + [(i, "the of and that with for", "en", "b.com", 1) for i in range(30)]
    rows += [(100, "x", "fr", "www.a.fr", 1), (101, "x", "en", "b.com", 1)]
    df = spark.createDataFrame(rows, DOCS)
    own = train(df.filter("doc_id < 100"))
    got = {r["doc_id"]: r["language"] for r in identify(df, own, df["source"], df["lang"], language.address_suffix(df["source"])).collect()}
    assert (got[100], got[101]) == ("fr", "en")


def test_language_edges(spark):
    rows = [(1, None, None, None, 1), (1, "", "en", "x", 1), (2, "12 %% 漢字", None, "x", 1), (3, "the of and to in with", "en", "x", 1), (3, "the of and to in with", "en", "x", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "Language")
    model = train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = sorted((r["doc_id"], r["accepted"]) for r in identify(df, model, df["source"], df["lang"]).collect())
    assert got == [(1, False), (1, False), (2, False), (3, True), (3, True)]
    assert identify_documents(df.limit(0)).count() == 0


def test_one_alphabet_at_every_length(spark):
    """One word more is a small change, also where texts are short."""
    words = [f"w{i * 7919 % 1000:03d}" for i in range(200)]
    rows = []
    for n in (60, 120, 240, 253, 255, 257, 262, 600):
        text = " ".join(words)[:n]
        cut = text[: n // 2].rindex(" ")
        rows.append((n, text, text[:cut] + " x" + text[cut:]))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    both = with_signature(with_signature(df, "a", "s"), "b", "t").select("n", likeness(F.col("s"), F.col("t")).alias("l"))
    found = {r["n"]: r["l"] for r in both.collect()}
    assert min(found.values()) > 0.75 and min(v for n, v in found.items() if n > 100) > 0.85
