"""Every stage of the pipeline against a brute-force version of it, and the registered queries."""

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare
from hemline.llm.bpe import read_ranks
from hemline.llm.registry import ORACLES, QUERIES
from tests.llm.test_near_copies import brute_lines

SF = "/root/testdata/sf0.001"


def smallest_ids(rows) -> set:
    """Smallest id of each group of texts linked by a Jaccard similarity of 0.8 or more of five-word shingles."""

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [grams(t) for _, t in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return {rows[find(i)][0] for i in range(len(rows))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).union(
        spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "12 34", "en", None, 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    )
    docs = spark.createDataFrame([(*r, "kept") for r in docs.collect()], "doc_id bigint, text string, lang string, source string, n_chars bigint, accepted string")
    steps = dict(zip(["language", "lines", "copies", "mix", "bpe"], [f for _, f in corpus_pipeline.STAGES]))
    take = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)

    known = steps["language"](spark, docs, SF)
    assert known.columns == docs.columns
    assert take(known) == take(docs.filter("doc_id < 9000"))  # the last three have no letters

    lines = steps["lines"](spark, known, SF)
    want = brute_lines([(r["doc_id"], r["text"]) for r in known.collect()], 3)
    want = {k: v for (k, t), v in want.items() if v == t or re.search(r"[^\x20\x09-\x0D]", v)}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) and r["accepted"] == "kept" for r in lines.collect())

    # near copies: a text of 60 words and the same with one more share over 0.8 of their five-word shingles
    base = " ".join(f"word{i}" for i in range(60))
    more = [(8001, base, "en", "src1", len(base), "kept"), (8002, base + " end", "en", "src2", len(base) + 4, "kept")]
    lines = lines.unionByName(spark.createDataFrame(more, lines.schema))
    rows = [(r["doc_id"], r["text"]) for r in lines.orderBy("doc_id").collect()]
    one = steps["copies"](spark, lines, SF)
    kept = {r["doc_id"] for r in one.collect()}
    assert kept == smallest_ids(rows) and 8001 in kept and 8002 not in kept

    mix = steps["mix"](spark, one, SF)
    taken = [r["doc_id"] for r in mix.collect()]
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in df.collect())
    assert mix.columns == docs.columns and max(taken.count(i) for i in taken) <= 2
    assert words(mix) <= 1.5 * words(one) and words(mix) > 1.2 * words(one)

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in mix.collect()}
    coded = steps["bpe"](spark, mix, SF).collect()
    assert sorted(r["doc_id"] for r in coded) == sorted(taken)
    for r in coded:
        assert r["ids"] == encoding.encode_ordinary(text[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_run_and_empty_input(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_registered():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLES[name]) == ""
