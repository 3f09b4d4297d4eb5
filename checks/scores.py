"""Scores of texts and judge results. Rule words are frequent words of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import WS, query, spread_table, sql_words, table
from hemline.functions import fixed
from hemline.operators import scoring
from hemline.sources import reports
from hemline.sources.dims import rule_dim

EXPECTED = {
    "en": ["The", "ing of", "with", "zebra", "!"],
    "fr": ["les", "eau", "AVEC", "zèbre"],
    "de": ["der", "sch", "ung", "über"],
    "es": ["los", "ción", "xyz"],
}
LIMITS = {
    "en": (["the", "tion", "zebra"], ["whth", "haha", "qq"]),
    "fr": (["le", "de"], ["ç", "eauou", "zz", "aux", "vi", "pa"]),
    "de": (["der"], ["sch"]),
    "es": (["de", "los", "ñandú"], []),
}


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]::varchar[]"


def _responses(spark, sf):
    d = spread_table(spark, sf, "documents", "doc_id")
    return d.select("doc_id", F.col("lang").alias("test"), "source", "text")


_RULES = "rules(test, expected) AS (VALUES " + ", ".join(f"('{k}', {_list(v)})" for k, v in EXPECTED.items()) + ")"
_COVER = (
    f"{_RULES}, w AS (SELECT test, unnest(expected) AS word, len(expected) AS k, generate_subscripts(expected, 1) AS i FROM rules), "
    "h AS (SELECT doc_id, lang AS test, count(*) FILTER (contains(lower(text), lower(word))) AS hits, any_value(k) AS k, "
    "coalesce(string_agg(word, '|' ORDER BY i) FILTER (contains(lower(text), lower(word))), '') AS found, any_value(text) AS text "
    f"FROM documents JOIN w ON w.test = lang GROUP BY doc_id, lang), cov AS (SELECT doc_id, test, found, hits / k * 100 AS score, {sql_words('text')} AS n_words FROM h)"
)


@query("agg_09_coverage_score", f"WITH {_COVER} SELECT doc_id, test, found, round(score, 4) AS score, n_words::bigint AS n_words FROM cov")
def _(spark, sf):
    c = scoring.coverage_score(_responses(spark, sf), rule_dim(spark, EXPECTED))
    return c.select(
        "doc_id", "test", F.array_join("found", "|").alias("found"), F.round("score", 4).alias("score"),
        F.col("n_words").cast("bigint").alias("n_words"),
    )


@query(
    "agg_10_diversity_score",
    "WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[^" + WS + "]+')) AS word FROM documents) "
    "SELECT source, count(*) AS n_words, count(DISTINCT word) AS n_distinct, round(count(DISTINCT word) / count(*) * 100, 4) AS score FROM w GROUP BY source",
)
def _(spark, sf):
    out = scoring.diversity_score(_responses(spark, sf), ["source"])
    return out.withColumn("score", F.round("score", 4))


_LIM = "lim(test, must, must_not) AS (VALUES " + ", ".join(f"('{k}', {_list(a)}, {_list(b)})" for k, (a, b) in LIMITS.items()) + ")"
_CONS = (
    f"{_LIM}, cons AS (SELECT doc_id, lang AS test, len(list_filter(must, lambda x: contains(lower(text), x))) AS a, len(must) AS k, "
    "len(list_filter(must_not, lambda x: contains(lower(text), x))) AS b FROM documents JOIN lim ON test = lang), "
    "con AS (SELECT doc_id, test, b, greatest(0.0, a / k * 100 - b * 20)::double AS score FROM cons)"
)


@query(
    "agg_11_constraint_score",
    f"WITH {_CONS} SELECT doc_id, test, b::bigint AS n_forbidden, round(score, 4) AS score, CASE WHEN score >= 70 THEN 'pass' WHEN score >= 40 THEN 'warn' ELSE 'fail' END AS band FROM con",
)
def _(spark, sf):
    c = scoring.constraint_score(_responses(spark, sf), rule_dim(spark, LIMITS))
    return c.select(
        "doc_id", "test", F.size("forbidden").cast("bigint").alias("n_forbidden"), F.round("score", 4).alias("score"), "band"
    )


_CHECKS = {
    "word_count": f"{sql_words('text')} <= 30",
    "list_format": "contains(text, '1.') OR contains(text, '•') OR contains(text, '-') OR contains(text, '1)') OR length(text) - length(replace(text, chr(10), '')) >= 3",
    "emoji": r"regexp_matches(text, '[^\x00-\x7f]')",
    "hashtag": "contains(text, '#')",
    "question": "contains(text, '?')",
    "call_to_action": " OR ".join(f"contains(lower(text), '{t}')" for t in fixed.CALLS_TO_ACTION),
}
_PASS = ", ".join(f"avg(({c})::int) * 100 AS {n}" for n, c in _CHECKS.items())


@query(
    "agg_12_rule_pass_rate",
    f"WITH p AS (SELECT source, count(*) AS n, {_PASS} FROM documents GROUP BY source) SELECT source, n, "
    + ", ".join(f"round({n}, 4) AS {n}" for n in _CHECKS)
    + ", round((" + " + ".join(_CHECKS) + ") / 6, 4) AS overall FROM p",
)
def _(spark, sf):
    out = scoring.rule_pass_rate(_responses(spark, sf), ["source"])
    return out.select("source", "n", *[F.round(c, 4).alias(c) for c in [*_CHECKS, "overall"]])


@query(
    "agg_13_overall_verdict",
    f"WITH {_COVER}, {_CONS}, p AS (SELECT {_PASS} FROM documents), s AS (SELECT avg(score) AS score FROM cov UNION ALL SELECT avg(score) FROM con UNION ALL SELECT ("
    + " + ".join(_CHECKS) + ") / 6 FROM p) SELECT round(avg(score), 4) AS overall, CASE WHEN avg(score) >= 80 THEN 'excellent' WHEN avg(score) >= 60 THEN 'good' WHEN avg(score) >= 40 THEN 'fair' ELSE 'poor' END AS verdict FROM s",
)
def _(spark, sf):
    from hemline.plans.evaluation import evaluation_verdict

    out = evaluation_verdict(_responses(spark, sf), rule_dim(spark, EXPECTED), rule_dim(spark, LIMITS))
    return out.select(F.round("overall", 4).alias("overall"), "verdict")


# --- judge scores from events -----------------------------------------------------------------------------

def _judged(spark, sf):
    e = table(spark, sf, "events")
    model = F.when(F.col("user_id") % 2 == 0, "base").otherwise("finetuned")
    return e.select(
        (F.col("event_id") % 40).alias("case_id"), model.alias("model"), F.col("event_type").alias("criterion"),
        F.col("value").alias("score"),
    )


_JUDGED = (
    "j AS (SELECT event_id % 40 AS case_id, CASE WHEN user_id % 2 = 0 THEN 'base' ELSE 'finetuned' END AS model, event_type AS criterion, value AS score FROM events)"
)
_BOTH = "avg(score) FILTER (model = 'base') AS base, avg(score) FILTER (model = 'finetuned') AS finetuned"


@query(
    "join_09_compare_models",
    f"WITH {_JUDGED}, w AS (SELECT case_id, criterion, {_BOTH} FROM j GROUP BY ALL) SELECT case_id, criterion, round(base, 4) AS base, round(finetuned, 4) AS finetuned, round(finetuned - base, 4) AS delta, "
    "CASE WHEN finetuned > base THEN 'up' WHEN finetuned < base THEN 'down' WHEN finetuned = base THEN 'same' END AS direction FROM w",
)
def _(spark, sf):
    out = scoring.compare_models(_judged(spark, sf), ["case_id", "criterion"])
    return out.select(
        "case_id", "criterion", *[F.round(c, 4).alias(c) for c in ("base", "finetuned", "delta")], "direction"
    )


@query(
    "agg_14_judge_summary",
    f"WITH {_JUDGED}, s AS (SELECT criterion, {_BOTH} FROM j GROUP BY GROUPING SETS ((criterion), ())) SELECT criterion, round(base, 4) AS base, round(finetuned, 4) AS finetuned, round(finetuned - base, 4) AS improvement FROM s",
)
def _(spark, sf):
    out = scoring.judge_summary(_judged(spark, sf))
    return out.select("criterion", *[F.round(c, 4).alias(c) for c in ("base", "finetuned", "improvement")])


def _judgement_texts(spark, sf):
    e = spread_table(spark, sf, "events", "event_id")
    k = F.col("event_id")
    scores = [((k * (i + 3)) % 10 + 1).cast("string") for i in range(5)]
    fields = F.concat_ws(
        ", ",
        *[
            F.concat(F.lit(f'"{c}": {{"score": '), s, F.lit(', "justification": "so '), "event_type", F.lit('"}'))
            for c, s in zip(fixed.CRITERIA, scores)
        ],
    )
    overall = F.when(k % 3 == 0, F.concat(F.lit(', "overall_score": '), ((k % 90) / 10 + 1).cast("string"))).otherwise("")
    body = F.concat(F.lit("{"), fields, overall, F.lit(', "overall_feedback": "fine"}'))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nbye")))
        .when(k % 5 == 1, F.concat(F.lit("```\n"), body, F.lit("```")))
        .when(k % 5 == 2, body)
        .when(k % 5 == 3, F.concat(body, F.lit(" and more")))
        .otherwise(F.concat(F.lit("no "), "event_type"))
    )
    return e.select("event_id", F.explode(F.array(text)).alias("text"))


_SC = ["(event_id * %d) %% 10 + 1" % (i + 3) for i in range(5)]


@query(
    "txt_18_parse_judgements",
    "SELECT event_id, event_id % 5 < 3 AS ok, (CASE WHEN event_id % 5 < 3 THEN " + _SC[0] + " ELSE 0 END)::double AS relevance, (CASE WHEN event_id % 5 < 3 THEN " + _SC[4] + " ELSE 0 END)::double AS effect, "
    "CASE WHEN event_id % 5 >= 3 THEN 0.0::double WHEN event_id % 3 = 0 THEN (event_id % 90)::double / 10 + 1 ELSE round((" + " + ".join(_SC) + ")::double / 5, 2) END AS overall, "
    "CASE WHEN event_id % 5 < 3 THEN 'so ' || event_type ELSE 'JSON parsing failed' END AS why, CASE WHEN event_id % 5 < 3 THEN 'fine' ELSE 'JSON parsing failed' END AS feedback FROM events",
)
def _(spark, sf):
    return scoring.parse_judgements(_judgement_texts(spark, sf)).select(
        "event_id", "ok", F.col("relevance.score").alias("relevance"), F.col("marketing_effectiveness.score").alias("effect"),
        "overall", F.col("creativity.justification").alias("why"), "feedback",
    )


# --- recorded reports -------------------------------------------------------------------------------------

@query(
    "src_09_flatten_eval_report",
    "SELECT doc_id, 'content' AS section, 'length' AS test, 'chars' AS metric, n_chars::varchar AS value FROM documents UNION ALL "
    "SELECT doc_id, 'content', 'length', 'lang', lang FROM documents UNION ALL SELECT doc_id, 'content', 'origin', 'source', source FROM documents UNION ALL "
    "SELECT doc_id, 'content', NULL, 'average_score', (doc_id % 100)::varchar FROM documents UNION ALL SELECT doc_id, 'rules', NULL, 'overall_rate', (doc_id % 7)::varchar FROM documents",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    doc = F.format_string(
        '{"content": {"length": {"chars": %d, "lang": "%s"}, "average_score": %d, "origin": {"source": "%s"}}, "rules": {"overall_rate": %d}}',
        "n_chars", "lang", F.col("doc_id") % 100, "source", F.col("doc_id") % 7,
    )
    return reports.flatten_report(d.select("doc_id", doc.alias("json")))


@query(
    "src_10_judge_rows",
    "WITH e AS (SELECT event_id::varchar AS title, value, (event_id % 10)::double AS m FROM events), c(criterion, i) AS (VALUES "
    + ", ".join(f"('{c}', {i})" for i, c in enumerate([*fixed.CRITERIA, "overall"]))
    + ") SELECT title, model, criterion, CASE WHEN model = 'base' THEN m + i ELSE value END AS score FROM e, c, (VALUES ('base'), ('finetuned')) t(model)",
)
def _(spark, sf):
    e = spread_table(spark, sf, "events", "event_id")

    def evaluation(score):
        parts = [F.struct(score(i).alias("score"), F.lit("").alias("justification")).alias(c) for i, c in enumerate(fixed.CRITERIA)]
        return F.struct(*parts, score(5).alias("overall_score"), F.lit("").alias("overall_feedback"))

    result = F.struct(
        F.col("event_id").cast("string").alias("title"),
        evaluation(lambda i: (F.col("event_id") % 10 + i).cast("double")).alias("base_evaluation"),
        evaluation(lambda i: F.col("value")).alias("finetuned_evaluation"),
    )
    as_json = e.select(F.to_json(F.struct(F.array(result).alias("results"))).alias("j"))
    parsed = as_json.select(F.explode(F.array(F.from_json("j", reports.judge_schema()))).alias("r"))
    return reports.judge_rows(parsed.select("r.*"))


@query(
    "src_11_run_arguments",
    "SELECT event_id, user_id::varchar AS epochs, value::varchar AS rate, true AS has_flag, NULL::varchar AS flag FROM events",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    args = F.array(
        F.lit("--epochs"), F.col("user_id").cast("string"), F.lit("--use_log"), F.lit("--learning_rate"), F.col("value").cast("string"),
    )
    m = e.select("event_id", reports.argument_map(args).alias("m"))
    return m.select(
        "event_id", F.try_element_at("m", F.lit("epochs")).alias("epochs"), F.try_element_at("m", F.lit("learning_rate")).alias("rate"),
        F.map_contains_key("m", F.lit("use_log")).alias("has_flag"), F.try_element_at("m", F.lit("use_log")).alias("flag"),
    )


@query(
    "src_12_outcome_rows",
    "SELECT event_id, c AS category, event_id % 50 + i AS captioned, event_id % 3 AS failed, event_id % 50 + i + event_id % 3 AS total FROM events, (VALUES ('Summer_Men', 0), ('Winter_Men', 1)) t(c, i)",
)
def _(spark, sf):
    e = spread_table(spark, sf, "events", "event_id")
    k = F.col("event_id")
    one = '"%s": {"captioned": %d, "failed": %d, "total": %d}, '
    doc = F.format_string(
        "{" + one + one + '"timestamp": "2025-01-01", "total_captioned": 5}',
        F.lit("Summer_Men"), k % 50, k % 3, k % 50 + k % 3, F.lit("Winter_Men"), k % 50 + 1, k % 3, k % 50 + 1 + k % 3,
    )
    return reports.outcome_rows(e.select("event_id", doc.alias("json")))
