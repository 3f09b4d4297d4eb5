"""Document fingerprints that feel edits: Order MinHash with column expressions only.

The letters are the words of a text cut into pieces of up to four characters, at every length of text; a k-mer is three
letters in a row. Each k-mer carries the number of its earlier occurrences in the text, so repeats count. The hash of a numbered
k-mer picks one of 128 bins; each bin keeps its two smallest, puts them back in text order and hashes the pair. Moving,
inserting or deleting words changes pairs as well as k-mers, which plain MinHash would not see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemline.llm.frames import stored, without
from hemline.llm.order import range_column

PIECE = r"[^\x20\x09-\x0D]{1,4}"
BINS_BITS = 7
# Bits of a sort key that hold the place in the text; the bits above hold the hash.
PLACE = 28
_PLACES = (1 << PLACE) - 1


def _hash(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE)


def _keyed(h: Column, place: Column) -> Column:
    return F.shiftleft(h, PLACE).bitwiseOR(place.cast("bigint"))


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: struct of ``n`` (pieces) and ``bins`` (array of bin number and 16 bits of its pair's hash).

    Every step is a column of its own that the next one reads several times, so the optimizer keeps it worked out once.
    """
    words, kmers, marked = f"_{out}_words", f"_{out}_kmers", f"_{out}_marked"
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(words, F.regexp_extract_all(whole, F.lit(PIECE), F.lit(0)))
    kmer = lambda x, i: _keyed(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)), i)
    df = df.withColumn(kmers, F.sort_array(F.transform(words, kmer)))
    jumps = F.array(*[F.lit(1 << b) for b in range(PLACE - 1, -1, -1)])

    def numbered(x, i):
        same = lambda t: F.coalesce(_hash(F.get(kmers, i - t)) == _hash(x), F.lit(False))
        # equal k-mers stand side by side: how many lie before is found by halving steps
        count = F.aggregate(jumps, F.lit(0), lambda t, p: F.when((i >= t + p) & same(t + p), t + p).otherwise(t))
        earlier = F.when((i > 0) & same(F.lit(1)), F.coalesce(count, F.lit(0))).otherwise(F.lit(0))
        return _keyed(F.xxhash64(_hash(x), earlier), x.bitwiseAND(F.lit(_PLACES)))

    df = df.withColumn(marked, F.sort_array(F.transform(kmers, numbered)))
    slot = lambda x: F.shiftrightunsigned(x, 64 - BINS_BITS)
    place = lambda x: x.bitwiseAND(F.lit(_PLACES))

    def pair(x, i):
        after = F.get(marked, i + 1)
        both = F.when(place(x) < place(after), F.xxhash64(_hash(x), _hash(after))).otherwise(F.xxhash64(_hash(after), _hash(x)))
        code = F.when(slot(x) == slot(after), both).otherwise(F.xxhash64(_hash(x)))
        entry = F.shiftleft(slot(x), 16).bitwiseOR(code.bitwiseAND(F.lit(0xFFFF))).cast("int")
        return F.when((i == 0) | (slot(F.get(marked, i - 1)) != slot(x)), entry)

    bins = F.filter(F.transform(marked, pair), lambda e: e.isNotNull())
    return df.withColumn(out, F.struct(F.size(marked).alias("n"), bins.alias("bins"))).drop(words, kmers, marked)


def as_text(signature: Column) -> Column:
    """A signature as a string: the number of pieces, then six hex digits for each filled bin."""
    return F.concat(
        F.hex(signature["n"]), F.lit(":"), F.array_join(F.transform(signature["bins"], lambda e: F.lpad(F.hex(e), 6, "0")), "")
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of words two texts have in common in the same order, estimated from their signatures: 0 to 1.

    Bins agree about as often as the Jaccard similarity of the numbered k-mers to the power of the k-mers in a bin;
    that is turned back, and into the share of the mean length. Two empty signatures are alike, an empty and a
    filled one are not.
    """
    slots = lambda s: F.transform(s["bins"], lambda e: F.shiftright(e, 16))
    agree = F.size(F.array_intersect(a["bins"], b["bins"]))
    filled = F.size(F.array_union(slots(a), slots(b)))
    in_bin = F.least(F.lit(2.0), (a["n"] + b["n"]) / (F.size(a["bins"]) + F.size(b["bins"])))
    jaccard = F.pow(agree / filled, 1 / in_bin)
    return F.when(filled == 0, 1.0).otherwise(2 * jaccard / (1 + jaccard))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``out`` for every whole text, beside all columns of ``docs`` (one of that name is replaced). Equal texts have
    equal fingerprints; a null text counts as empty."""
    signed = with_signature(without(docs, out, "_signature"), text, "_signature")
    return signed.withColumn(out, as_text(F.col("_signature"))).drop("_signature")


def with_next(docs: DataFrame, key: str, text: str, carried: list[str], prepare=lambda df: df) -> DataFrame:
    """Add ``_next_<c>`` for each column of ``carried``: that of the row next in descending order of the key, after the
    last one the first. Equal keys follow the order of their texts, null keys come last. ``prepare`` adds columns to the
    rows once it is known which of them are needed twice.

    Texts are shuffled once, by key range. The first row of each range is looked up beforehand and also put at the
    end of the range before it, so no window spans ranges.
    """
    rows = docs.withColumn("_part", range_column(docs, key))
    tops = rows.groupBy("_part").agg(F.max(key).alias("_top"))
    order = Window.orderBy(F.col("_part").desc())  # a row for each range, of which there are 4,096 at most
    tops = tops.select("_part", F.lead("_part").over(order).alias("_after"), F.first("_part").over(order).alias("_first"), "_top")
    tops = stored(tops, "range-tops")
    giver = tops.select(F.col("_part").alias("_giver"), "_top")
    ends = tops.select("_part", F.coalesce("_after", "_first").alias("_giver")).join(F.broadcast(giver), "_giver")
    ends = stored(ends.select(F.col("_part").alias("_to"), F.col("_giver"), "_top"), "range-ends")
    # the first row of a range, of equal keys the one whose text is first: a row for each range again
    found = rows.join(F.broadcast(ends), (F.col("_part") == F.col("_giver")) & F.col(key).eqNullSafe(F.col("_top")))
    least = Window.partitionBy("_to").orderBy(text)
    found = found.withColumn("_n", F.row_number().over(least)).filter("_n = 1")
    extra = found.select(*[F.col(c) for c in docs.columns], F.col("_to").alias("_part"), F.lit(1).alias("_extra"))
    whole = prepare(rows.withColumn("_extra", F.lit(0)).unionByName(extra))
    w = Window.partitionBy("_part").orderBy("_extra", F.col(key).desc_nulls_last(), text)
    shifted = whole.repartition("_part").withColumns({f"_next_{c}": F.lead(c).over(w) for c in carried})
    return shifted.filter("_extra = 0").drop("_extra", "_part")


def edited_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text beside itself with its second half replaced by the start of the next document's text.

    Returns the key, ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``. Null texts count as empty. Repeated rows stay and follow each other; one row
    alone is its own next. An empty table gives an empty result; other columns of ``docs`` are left out.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    both = with_next(rows, "_key", "_text", ["_text", "_own"], lambda df: with_signature(df, "_text", "_own"))
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - half), F.substring("_next__text", F.lit(1), half))
    both = with_signature(both.withColumn("_edited", edited), "_edited", "_new")
    return both.select(
        F.col("_key").alias(key),
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.encode("_edited", "utf-8"), 256).alias("edited_sha256"),
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next__own")).alias("near_next"),
    )
