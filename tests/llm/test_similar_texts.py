"""Similar texts against brute-force Jaccard."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from hemline.llm import similar_texts
from hemline.llm.frames import FREED
from hemline.llm.mixing import mix_rows, mixed
from hemline.llm.simhash import shingle_hashes
from hemline.llm.similar_texts import one_of_each_similar


def brute_kept(rows, words: int) -> set:
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets, head = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 10 * both >= 8 * len(sets[i] | sets[j]):
                a, b = head[i], head[j]
                head = [min(a, b) if h in (a, b) else h for h in head]
    return {rows[h] for h in head}


@pytest.mark.parametrize("sample", [1, 16_000_000])
def test_against_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(similar_texts, "SAMPLE", sample)
    monkeypatch.setattr(similar_texts, "PAIRS", 50)
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 40)}"
    rows, key = [], 0
    for size in (1, 3, 5, 6, 9, 14, 30, 60, 200, 400):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for changes in (0, 1, 1, 2, 3, 5, 9):
                near = base.copy()
                for _ in range(changes):
                    near[rng.randrange(size)] = word()
                rows.append((key := key + 1, " ".join(near)))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (5, "a text of its own under an id that repeats"), (None, "no id but like no other text")]
    rows += [(None, "another text that has no id at all"), (None, rows[3][1]), rows[7], rows[7]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, more string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in one_of_each_similar(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kept(rows, 5)
    assert one_of_each_similar(df.limit(0)).count() == 0


def test_stage_takes_copies_with_a_few_changed_words(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    rows = [(0, " ".join(base), "en", "s", 1)]
    for i in range(1, 9):
        near = base.copy()
        for at in rng.choice(58, 4, replace=False) * 5:
            near[at] = f"new{i}"
        rows.append((i, " ".join(near), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, "").collect()] == [0]


def test_mix_takes_rows_with_null_and_repeated_ids(spark):
    texts = ["no id here", "an id twice", "the same id with some more words in it"]
    rows = [(None, texts[0], "a"), (1, texts[1], "a"), (1, texts[2], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    counts = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mix_rows(docs, share=2.0).collect()}
    got = [r["text"] for r in mixed(docs, share=2.0).collect()]
    assert [got.count(t) for t in texts] == [counts[k, s, len(t.split())] for k, t, s in rows] and got.count(texts[0]) > 0


def test_simhash_classes_come_first_and_copies_in_a_class_are_never_paired(spark, monkeypatch):
    """Near copies that the fingerprints link are one class: they add links in proportion, not all pairs."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 9000)}" for _ in range(600)]
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(120)] + [(500 + i, " ".join(f"x{i}y{j}" for j in range(40))) for i in range(5)]
    tables = {}

    def keep(df, name, stored=similar_texts.stored):
        tables[name] = stored(df, name)
        return tables[name]

    monkeypatch.setattr(similar_texts, "stored", keep)
    got = [r["doc_id"] for r in one_of_each_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == [0, *range(500, 505)]
    assert tables["simhash-classes"].filter("node <> root").count() >= 100
    assert tables["simhash-pairs"].count() < 6 * 120 and tables["pairs"].count() < 20 * 120  # 7,140 would be all


def test_links_between_classes_that_fingerprints_miss(spark, monkeypatch):
    monkeypatch.setattr(similar_texts, "DISTANCE", 0)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 200 - i])) for i in range(30)]
    got = one_of_each_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r["doc_id"] for r in got] == [0]


def test_texts_that_share_a_shingle_by_chance_are_not_verified(spark, monkeypatch):
    """Such pairs grow with the square of the table, and each would bring two whole sets to disk."""
    monkeypatch.setattr(similar_texts, "SAMPLE", 1)  # no shingle is known to be common
    phrases = (f"p{i} q{i} r{i} s{i} t{i}" for i in range(10_000))
    phrase = next(p for p in phrases if int(shingle_hashes(p, 5)[0]) < 1 << 56)  # it comes first in all prefixes
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + " " + phrase) for i in range(50)]
    rows.append((90, rows[3][1] + " and more"))
    tables, freed = {}, set()

    def keep(df, name, stored=similar_texts.stored):
        tables.setdefault(name, []).append(stored(df, name))
        freed.add(spark.conf.get(FREED, None))
        return tables[name][-1]

    monkeypatch.setattr(similar_texts, "stored", keep)
    monkeypatch.setattr(similar_texts, "DISTANCE", 0)
    got = [r["doc_id"] for r in one_of_each_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert sorted(got) == list(range(50))
    assert tables["pairs"][0].count() == 1 and tables["sets"][-1].count() == 2  # 1,275 pairs share the phrase
    assert freed == {"true"} and spark.conf.get(FREED, None) is None


@pytest.mark.parametrize("similarity", ["0.8", "0.5", "1", "0.05", "2/3"])
@pytest.mark.parametrize("n_common", [0, 50])
def test_similar_sets_share_as_many_prefix_shingles_as_are_asked_for(similarity, n_common):
    bound, rng, sets = Fraction(similarity), np.random.default_rng(n_common), {}
    hashes = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for n in (1, 2, 3, 4, 5, 6, 8, 11, 20, 60, 150, 400):
        base = hashes(n)
        for changes in (0, n // 10 + 1, n // 8, n // 5, n // 3):
            other = base.copy()
            other[rng.choice(n, min(n, changes), replace=False)] = hashes(min(n, changes))
            for x in (other, base[: max(1, n - changes)], np.append(base, hashes(changes))):
                sets[similar_texts.set_hash(np.unique(x))] = np.unique(x)
    common = np.sort(rng.choice(np.unique(np.concatenate(list(sets.values()))), n_common, replace=False))
    rank = rng.permutation(n_common).astype(np.int32)
    first = [similar_texts.prefix(s, common, rank, bound) for s in sets.values()]
    count = [len(p) for p in first]
    name, size = np.repeat(list(sets), count), np.repeat([len(s) for s in sets.values()], count).astype(np.int32)
    place = np.concatenate([np.arange(k, dtype=np.int32) for k in count])
    met, least = Counter(), {}
    for x, y, need in similar_texts.meeting(np.concatenate(first).view(np.int64), name, size, place, name, bound):
        both = [tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())]
        met.update(both)
        least |= dict(zip(both, need.tolist()))
    similar = 0
    for a in sets:
        for b in sets:
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True)) if a < b else 0
            if shared and Fraction(shared, len(sets[a]) + len(sets[b]) - shared) >= bound:
                similar += 1
                assert met[a, b] >= least[a, b]
    assert similar > 5 or similarity == "1"
