"""Token counts, BPE encoding and decoding, and token files against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from hemline.llm.bpe import Coder, decode, encode, read_ranks, round_trip
from hemline.llm.pieces import WordCache, ragged
from hemline.llm.token_counts import PairTable, TokenCounter, count_tokens, surviving
from hemline.llm.token_files import LibraryEncoder, pack, read_token_files, token_files, unpack, write_token_files
from hemline.session import shared_path

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def odd_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    letters = "ab 'sdtrevlm\n\t  12!é日本　 \x00\x1c\x85😀́ªⅫ"
    out = ["", " ", "a" * 3000, "ab" * 2000, " '", "''s'll've're' s", "  \n x", "x  ", "'S 's", "\n\n", "a\x00b"]
    out += ["<|endoftext|>", "x<|endoftext|>  y <|endoftext|>", "<|endoftext", "<|endoftext|><|endoftext|>"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    out += ["".join(rng.choice("aabc") for _ in range(rng.randint(65, 300))) for _ in range(20)]
    points = [chr(rng.randrange(0x110000)) for _ in range(n)]
    return out + [c + "a" for c in points if not 0xD800 <= ord(c) < 0xE000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranked():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_counts_equal_library(library):
    texts = odd_texts(3000)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(JSON)(texts).tolist() == want


def test_decode_in_ranges_of_ids(ranked, monkeypatch):
    from hemline.llm import bpe

    texts = ["", "one two three " * 40, "x", "", "日本 é " * 30, ""]
    coder = Coder(RANKS)
    ids, counts = coder.encode(texts)
    for most in (1, 7, 10**6):
        monkeypatch.setattr(bpe, "IDS", most)
        assert coder.decode(ids, counts) == [t.encode() for t in texts]


def thue_morse(n: int) -> tuple[str, str]:
    """A word of a and b and its complement: polynomial hashes modulo 2^64 are equal under any odd base."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_equal_hash_stay_apart(library, ranked, n):
    pair = thue_morse(n)
    texts = [*pair, " ".join(pair), pair[0]]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    together, apart = TokenCounter(JSON), TokenCounter(JSON)
    assert together(texts).tolist() == want
    assert [int(apart([t])[0]) for t in texts * 2] == want * 2
    ids = [ranked.encode_ordinary(t) for t in texts]
    if n == 1024:
        ids_, counts = Coder(RANKS).encode(texts)
        assert np.split(ids_, np.cumsum(counts)[:-1])[1].tolist() == ids[1] and counts.tolist() == list(map(len, ids))


def test_overlapping_pairs_merge_from_the_left():
    pairs = PairTable([1, 2], [1, 2], [0, 1], [2, 3])
    assert surviving(np.array([1] * 5 + [1] * 8 + [7]), np.array([5, 8, 1]), pairs).tolist() == [2, 2, 1]


def test_count_tokens_keeps_rows_and_defines_edges(spark, library):
    rows = [(1, None, 9, "x"), (1, None, 9, "x"), (None, "", 9, "y"), (3, "a b" * 2000, 9, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, N_Tokens int, extra string")
    got = sorted(map(tuple, count_tokens(df, JSON).select("extra", "n_bytes", "n_tokens", "over_limit").collect()))
    n = len(library.encode("a b" * 2000, add_special_tokens=False).ids)
    assert got == [("x", 0, 0, False), ("x", 0, 0, False), ("y", 0, 0, False), ("z", 6000, n, n > 1024)]
    assert count_tokens(df.limit(0), JSON).count() == 0


def test_coder_equals_library(ranked):
    texts, coder = odd_texts(1500, 2), Coder(RANKS)
    ids, counts = coder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [ranked.encode_ordinary(t) for t in texts]
    assert [d.decode() for d in coder.decode(ids, counts)] == texts


def test_long_words_finish_over_several_queries(ranked):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (65, 900, 1500)] + ["z" * 5000]
    ids, counts = Coder(RANKS).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [ranked.encode_ordinary(t) for t in texts]


def test_encode_and_decode_frames(spark, ranked):
    rows = [(1, None, "x"), (2, "", "x"), (2, "the cat's é", "y"), (2, "the cat's é", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    coded = encode(df, RANKS)
    assert sorted(tuple(r) for r in coded.selectExpr("doc_id", "size(ids)").collect())[0] == (1, 0)
    back = decode(coded, RANKS).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in back) == ["", "", "the cat's é", "the cat's é"]
    got = {r["decoded_sha256"]: r for r in round_trip(df, RANKS).collect()}
    row = got[hashlib.sha256("the cat's é".encode()).hexdigest()]
    ids = ranked.encode_ordinary("the cat's é")
    assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert round_trip(df.limit(0), RANKS).count() == 0


def test_merge_query_holds_one_row_a_word(ranked):
    """Words of few and many steps: what a step left behind is not carried to the end."""
    import pyarrow as pa

    from hemline.llm import bpe

    coder, rng = Coder(RANKS), random.Random(6)
    words = ["".join(rng.choice("eainst") for _ in range(n)) for n in (1, 2, 9, 30, 64) for _ in range(40)]
    toks = [coder._byte[list(w.encode())].tolist() for w in words]
    coder._db.register("words", pa.table({"w": range(len(words)), "toks": pa.array(toks, pa.list_(pa.int32()))}))
    held = bpe._CONTRACT.rsplit("SELECT", 1)[0] + "SELECT count(*) FROM state"
    assert coder._db.sql(held).fetchall() == [(len(words),)]
    ids, lengths = coder._merged(words + ["x" * 70, "tain" * 20])
    want = [ranked.encode_ordinary(w) for w in words + ["x" * 70, "tain" * 20]]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want


def test_merge_table_holds_every_cut():
    ranks = read_ranks(RANKS)
    want = {(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    got = Coder(RANKS)._db.sql("SELECT a, b, made FROM merges").fetchall()
    assert len(got) == len(want) and set(got) == want


def test_unknown_id_is_an_error():
    with pytest.raises(ValueError):
        Coder(RANKS).decode(np.array([60_000]), np.array([1]))


def test_simple8b_round_trip():
    rng = random.Random(2)
    for n in [0, 1, 59, 60, 61, *(rng.randint(0, 400) for _ in range(150))]:
        ids = np.array([rng.getrandbits(rng.choice([0, 1, 1, 3, 8, 15, 16, 31, 60, 61, 64])) for _ in range(n)], np.uint64)
        words, escapes = pack(ids)
        assert (unpack(words, escapes, n) == ids).all()
    assert len(pack(np.zeros(600, np.uint64))[0]) == 10


def test_word_cache_forgets_but_stays_right():
    class P:
        def __init__(self, words):
            self.words, self.keys = words, np.array([hash(w) & (2**63 - 1) for w in words], np.uint64)

    cache = WordCache(lambda ws: (np.array([ord(c) for w in ws for c in w]), np.array([len(w) for w in ws])), most=50)
    rng = random.Random(3)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(20)})
        values, start, size = cache.look_up(P(words))
        assert "".join(map(chr, ragged(values, start, size))) == "".join(words)


def test_word_cache_does_not_copy_what_it_holds():
    """A look-up that adds a few words to many must not move the others."""
    cache = WordCache(lambda ws: (np.arange(len(ws)), np.ones(len(ws), np.int64)))

    class P:
        def __init__(self, numbers):
            self.words, self.keys = [f"w{i}" for i in numbers], np.array(numbers, np.uint64)

    cache.look_up(P(range(5000)))
    moved, last = 0, cache.look_up(P([1]))[0]
    for i in range(200):
        values, start, size = cache.look_up(P([7, 5000 + i]))
        assert values[start].tolist() == [7, 0] and size.tolist() == [1, 1]
        moved, last = moved + (not np.shares_memory(last, values)), values
    assert moved <= 1


def test_library_encoder(library):
    texts = odd_texts(800, 3)
    ids, counts = LibraryEncoder(JSON)(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [
        e.ids for e in library.encode_batch(texts, add_special_tokens=False)
    ]


def test_token_files(spark, library):
    rows = [(i * 7 % 1201, t, "e") for i, t in enumerate(odd_texts(500, 5)) if i < 1100] + [(5000, None, "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(5)
    at, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files(df, JSON).collect()) == want


def test_token_files_edges(spark, library):
    rows = [(2, "b", 1), (2, "b", 1), (None, "a a", 1), (2, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part int")
    path = shared_path(spark, "test-token-files")
    write_token_files(df, path, JSON, end_id=7)
    got = sorted((r["start"], r["doc_id"], r["ids"]) for r in read_token_files(spark, path, ids=True).collect())
    of = lambda t: library.encode(t, add_special_tokens=False).ids + [7]
    assert got == [(0, None, of("a a")), (3, 2, of("a")), (5, 2, of("b")), (7, 2, of("b"))]
    assert token_files(df.limit(0), JSON).count() == 0


def test_slices_do_not_follow_the_batch(spark):
    """One Arrow batch of texts is worked on a few at a time, and what a slice took is given back before the next one."""
    from pyspark.sql import types as T

    from hemline.llm.frames import map_texts

    docs = spark.createDataFrame([(i, None if i % 7 == 0 else "x" * (i % 50)) for i in range(400)] + [(400, "y" * 900)], "id int, text string").coalesce(1)

    def make():
        import re
        from pathlib import Path

        kept = []

        def work(texts):
            held = int(re.search(r"Anonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1])
            small = [b"%d" % i * 100 for i in range(400_000)]  # over 200 MB in small blocks of C's allocator
            kept.append(small[::40_000])  # a few stay, so the heap does not shrink by itself
            return [[sum(map(len, texts))] * len(texts), [held >> 10] * len(texts)]

        return work

    fields = [T.StructField("chars", T.LongType()), T.StructField("held", T.LongType())]
    got = map_texts(docs, "text", fields, make, 1000).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(401)) and max(r["chars"] for r in got) <= 1000
    assert got[-1]["held"] - got[0]["held"] < 100
