"""Personal data in whole texts: four patterns, and terms that give a protected value away.

The patterns are matched leftmost and without overlaps. Possessive repeats and look-behinds keep them linear and off the
stack on texts of any length; they find what the plain patterns find, since a match that cannot start at the first
character of a run cannot start further on in it.

Terms near a protected value (a found one) are weighed by how much they reveal it: with N documents, n(e) that hold the
value, n(t) that hold the term and n(e,t) that hold the term beside the value, the disclosure is PMI(e;t) / IC(e) = ln(p(e|t) N / n(e)) / ln(N / n(e)), which nears 1
when the term always comes with the value. Every pair is scored: p(e|t) = (n(e,t) + k n(e) / N) / (n(t) + k) backs off to
the share of documents that hold the value, the more the fewer hold the term.
Terms over a first threshold are generalised, over a second one removed, beside that value only. All counts are grouped
aggregations over the whole corpus; only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.llm.frames import if_small, stored, without

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = r"[A-Za-z0-9._%+-]"
_START = r"(?:(?<!{0})|\G)"
PATTERNS = {
    "email": _START.format(_LOCAL) + _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _START.format("[0-9]") + r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold at least for the pattern to be worth trying.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
# Code points on either side of a value in which terms count as beside it.
CONTEXT = 100
TERM = r"\p{L}{3,}"
# Documents the back-off counts for; disclosure from which terms are generalised and removed.
BACKOFF, GENERALISE, REMOVE = 0.5, 0.8, 0.95


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.char_length(plain(p)) <= 3) & (F.lpad(plain(p), 3, "0") <= "255"))
    n = F.char_length(_digits(m))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(m))).otherwise(False)
    return (n >= 8) & (n <= 15)


def _places(gaps: Column, matches: Column) -> Column:
    """Start of each match, given the texts between the matches: running sums of lengths."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(a, i):
        start = a["at"] + F.char_length(F.get(gaps, i))
        return F.struct((start + F.char_length(F.get(matches, i))).alias("at"), F.concat(a["out"], F.array(start)).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step, lambda a: a["out"]))


def base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Add ``out``: array of (kind, start, end, value, left, right), by kind and start; code points, end exclusive.

    ``left`` and ``right`` are the context on either side. A null text has none.
    """
    parts = []
    for kind in KINDS:
        m, g, s = f"_{kind}_m", f"_{kind}_g", f"_{kind}_s"
        whole, pattern = F.col(text), PATTERNS[kind]
        hint = whole.contains("@") if kind == "email" else whole.rlike(HINTS[kind])
        docs = docs.withColumns(
            {
                m: F.when(hint, F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))),
                g: F.when(hint, F.split(whole, pattern, -1)),
            }
        )
        docs = docs.withColumn(s, _places(F.col(g), F.col(m)))
        one = lambda x, i: F.struct(  # noqa: B023, E731 - called at once
            F.lit(kind).alias("kind"),
            F.get(s, i).alias("start"),
            (F.get(s, i) + F.char_length(x)).alias("end"),
            x.alias("value"),
            F.right(F.get(g, i), F.lit(CONTEXT)).alias("left"),
            F.left(F.get(g, i + 1), F.lit(CONTEXT)).alias("right"),
        )
        good = F.filter(F.transform(m, one), lambda p: _valid(kind, p["value"]))
        parts.append(F.when(F.size(m) > 0, good))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>")
    docs = docs.withColumn(out, F.concat(*[F.coalesce(p, none) for p in parts]))
    return docs.drop(*[f"_{k}_{x}" for k in KINDS for x in "mgs"])


def entity(span: Column) -> Column:
    """What two spellings of one value have in common."""
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _terms(context: Column, at: Column) -> Column:
    """Terms of a context that starts at ``at``: (term, start, end)."""
    words, gaps = F.regexp_extract_all(context, F.lit(TERM), F.lit(0)), F.split(context, TERM, -1)
    bound = F.transform(F.array(F.struct(words.alias("w"), gaps.alias("g"))), lambda b: F.transform(
        F.coalesce(_places(b["g"], b["w"]), F.array().cast("array<int>")),
        lambda start, i: F.struct(
            F.lower(F.get(b["w"], i)).alias("term"),
            (at + start).alias("start"),
            (at + start + F.char_length(F.get(b["w"], i))).alias("end"),
        ),
    ))
    return F.get(bound, F.lit(0))


def beside(found: DataFrame, keys: list[str]) -> DataFrame:
    """Terms beside protected values: ``keys``, entity, term, start, end. ``found`` has the array ``base``.

    Words that a context cuts off are left out: a context as long as ``CONTEXT`` may begin or end inside one.
    """
    one = found.select(*keys, F.explode("base").alias("s"))
    left, right = F.col("s.left"), F.col("s.right")
    whole_left = F.when(F.char_length(left) < CONTEXT, left).otherwise(F.regexp_replace(left, r"^\p{L}+", ""))
    whole_right = F.when(F.char_length(right) < CONTEXT, right).otherwise(F.regexp_replace(right, r"\p{L}+$", ""))
    one = one.select(*keys, entity(F.col("s")).alias("entity"), F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                     whole_left.alias("l"), whole_right.alias("r"))
    terms = F.concat(_terms(F.col("l"), F.col("start") - F.char_length("l")), _terms(F.col("r"), F.col("end")))
    return one.select(*keys, "entity", F.explode(terms).alias("t")).select(*keys, "entity", "t.*")


def disclosures(docs: DataFrame, near: DataFrame, keys: list[str], found: DataFrame, text: str = "text") -> DataFrame:
    """``entity``, ``term``, ``disclosure`` for the pairs, whatever their support, whose disclosure reaches ``GENERALISE``."""
    together = near.select(*keys, "entity", "term").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et"))
    together = stored(together, "together")
    names = if_small(stored(together.select(F.col("term").alias("word")).distinct(), "terms"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))
    # counted in the tasks before anything is joined: what is shuffled is a vocabulary, however the join is done
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_t"))
    holding = counted.join(names, "word")
    values = found.select(*keys, F.explode("base").alias("s")).select(*keys, entity(F.col("s")).alias("entity")).distinct()
    n_e = values.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    n = docs.count()
    pairs = together.join(n_e, "entity").join(holding, F.col("term") == F.col("word"))
    chance = F.col("n_e") / F.lit(float(n))
    pmi = F.log((F.col("n_et") + BACKOFF * chance) / ((F.col("n_t") + BACKOFF) * chance))
    content = F.log(F.lit(float(n)) / F.col("n_e"))
    scored = pairs.filter(content > 0).withColumn("disclosure", F.least(F.lit(1.0), pmi / content))
    return scored.filter(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``base`` (the pattern spans) and ``terms`` (start, end, action) of every row.

    A null text has neither. Rows that agree in key and text have one result and all stay; keys may be null or repeat
    with different texts. An empty table gives an empty result; other columns of ``docs`` are left out. Term spans
    never overlap base spans; a term beside several values takes the strongest action.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    based = stored(base_spans(rows.withColumn("_mark", F.xxhash64("_text")), "_text").drop("_text"), "base-spans")
    keys = ["_key", "_mark"]
    found = based.filter(F.size("base") > 0).dropDuplicates(keys)
    near = stored(beside(found, keys), "terms-beside")
    risky = stored(disclosures(rows, near, keys, found, "_text"), "disclosures")
    hits = near.join(if_small(risky), ["entity", "term"])
    spans = hits.groupBy(*keys, "start", "end").agg(F.max("disclosure").alias("d"))
    action = F.when(F.col("d") >= REMOVE, "remove").otherwise("generalise")
    listed = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", action.alias("action")))).alias("terms"))
    listed = listed.select(F.col("_key").alias("_k"), F.col("_mark").alias("_m"), "terms")
    out = based.join(listed, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m")), "left")
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return out.select(F.col("_key").alias(key), "_mark", "base", F.coalesce(apart, none).alias("terms"))


def span_list(spans: Column, kind=None) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind) if kind else s["kind"], s["start"], s["end"])), ","
    )


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, ``base_sha256`` and ``spans`` for every row; see ``find_personal_data``."""
    found = find_personal_data(docs, key, text)
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    base, terms = span_list(F.col("base")), span_list(F.col("terms"), "term")
    joined = F.concat(base, F.when((base != "") & (terms != ""), ",").otherwise(""), terms)
    return found.select(
        key, *counts, F.sha2(F.encode(base, "utf-8"), 256).alias("base_sha256"), joined.alias("spans"),
        F.size("terms").cast("bigint").alias("n_terms"),
    )


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with values replaced by their kind in brackets, risky terms by ``[TERM]`` or nothing.

    Of spans that overlap the one that starts first is replaced, of those the longest. Other columns stay.
    """
    found = find_personal_data(docs, key, text).dropDuplicates([key, "_mark"])
    marks = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("with"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("with"))),
    )
    found = found.select(F.col(key).alias("_k"), F.col("_mark").alias("_m"), F.array_sort(marks).alias("_marks"))
    both = without(docs, "_k", "_m", "_marks").join(
        found, F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(text) == F.col("_m")), "left"
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        between = F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"])
        new = F.struct((-s["end"]).alias("at"), F.concat(a["out"], between, s["with"]).alias("out"))
        return F.when(s["start"] >= a["at"], new).otherwise(a)

    rest = lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.char_length(F.col(text))))
    clean = F.when(F.size("_marks") > 0, F.aggregate("_marks", zero, step, rest)).otherwise(F.col(text))
    return both.withColumn(text, clean).drop("_k", "_m", "_marks")
