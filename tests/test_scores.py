import json

import pytest
from pyspark.sql import functions as F

from hemline.functions import fixed
from hemline.operators import joins, runs, sampling, scoring
from hemline.plans.captioning import daily_captioning_plan
from hemline.sources.dims import rule_dim
from tests.rules import CONSTRAINT_RULES, COVERAGE_RULES


def responses(spark, pairs):
    return spark.createDataFrame(pairs, "test string, text string")


def test_coverage_counts_substrings(spark):
    df = responses(spark, [("product_description", "Soft FABRIC for women, a moment of summer"), ("slogan", ""), ("ad_copy", "luxury pashmina")])
    got = {r.test: (r.score, r.found, r.n_words) for r in scoring.coverage_score(df, rule_dim(spark, COVERAGE_RULES)).collect()}
    assert got["product_description"] == (50.0, ["fabric", "summer", "men"], 8)
    assert got["slogan"] == (0.0, [], 0)
    assert got["ad_copy"][0] == pytest.approx(40.0)


def test_diversity(spark):
    # 74 distinct of 149, 99 of 162 and 86 of 120 words, over three samples each
    data = []
    for level, (distinct, total) in {"low": (74, 149), "medium": (99, 162), "high": (86, 120)}.items():
        words = [f"w{i % distinct}" for i in range(total)]
        third = total // 3
        data += [(level, " ".join(words[:third])), (level, " ".join(words[third : 2 * third]).upper()), (level, "  ".join(words[2 * third :]))]
    df = spark.createDataFrame(data + [("none", ""), ("none", None)], "level string, text string")
    got = {r.level: round(r.score, 2) for r in scoring.diversity_score(df, ["level"]).collect()}
    assert got == {"low": 49.66, "medium": 61.11, "high": 71.67, "none": 0.0}
    close = scoring.diversity_score(df, ["level"], approximate=True).filter("level = 'low'").first().score
    assert close == pytest.approx(49.66, abs=6)


def test_constraints(spark):
    df = responses(spark, [("winter_men", "winter wool waistcoat"), ("summer_women", "summer lawn winter wool khaddar shawl"), ("summer_men", "cotton only")])
    got = {r.test: (round(r.score, 2), r.band) for r in scoring.constraint_score(df, rule_dim(spark, CONSTRAINT_RULES)).collect()}
    assert got == {"winter_men": (100.0, "pass"), "summer_women": (0.0, "fail"), "summer_men": (50.0, "warn")}


def test_prompt_rules(spark):
    df = responses(spark, [("a", "Shop now? #sale ✨ 1. x"), ("a", "word " * 31 + "\n\n\n")])
    r = scoring.rule_pass_rate(df, []).first()
    assert (r.word_count, r.list_format, r.emoji, r.hashtag, r.question, r.call_to_action) == (50.0, 100.0, 50.0, 50.0, 50.0, 50.0)
    assert r.overall == pytest.approx((100 + 100 / 6) / 2)


def test_overall_verdict(spark):
    parts = spark.createDataFrame([("content", 73.0), ("season", 100.0), ("rules", 100.0)], "section string, score double")
    assert tuple(scoring.overall_verdict(parts).first()) == (91.0, "excellent")
    none = spark.createDataFrame([("content", None)], "section string, score double")
    assert tuple(scoring.overall_verdict(none).first()) == (None, None)


def test_judgements(spark):
    full = {c: {"score": s, "justification": "j"} for c, s in zip(fixed.CRITERIA, (8, 7, 9, 6, 5))}
    texts = [
        json.dumps(full | {"overall_feedback": "f"}), "```json\n" + json.dumps(full | {"overall_score": 2.5}) + "\n```",
        json.dumps(full) + " trailing", "no json", json.dumps({"relevance": {"score": 1, "justification": ""}}), "```\n" + json.dumps(full) + "\n```",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = scoring.parse_judgements(df).orderBy("id").collect()
    assert [(r.ok, r.overall) for r in got] == [(True, 7.0), (True, 2.5), (False, 0.0), (False, 0.0), (False, 0.0), (True, 7.0)]
    assert got[3].creativity == (0.0, "JSON parsing failed") and got[0].creativity.score == 9.0


def test_judge_summary(spark, rows):
    data = [("c1", "base", "creativity", 4.0), ("c1", "finetuned", "creativity", 7.0), ("c1", "base", "relevance", 6.0), ("c1", "finetuned", "relevance", 5.0)]
    df = spark.createDataFrame(data, "case_id string, model string, criterion string, score double")
    assert rows(scoring.judge_summary(df)) == [("creativity", 4.0, 7.0, 3.0), ("relevance", 6.0, 5.0, -1.0), (None, 5.0, 6.0, 1.0)]
    assert rows(scoring.compare_models(df, ["criterion"]), "criterion", "direction") == [("creativity", "up"), ("relevance", "down")]


def test_epochs_and_checkpoints(spark, rows):
    nan = float("nan")
    steps = spark.createDataFrame([("r", 1, 2.0), ("r", 1, nan), ("r", 2, None), ("r", 3, 2.0), ("r", 4, 1.0)], "run string, epoch int, loss double")
    assert rows(runs.epoch_losses(steps)) == [
        ("r", 1, 2.0, 1, True), ("r", 2, float("inf"), 0, False), ("r", 3, 2.0, 1, False), ("r", 4, 1.0, 1, True),
    ]
    names = [("r", "checkpoint-3", None), ("r", "checkpoint-final", 20), ("r", "checkpoint-x", None), ("s", "checkpoint-final", None), ("s", "checkpoint-7", None)]
    assert rows(runs.latest_checkpoint(spark.createDataFrame(names, "run string, name string, recorded int"))) == [("r", 20, "checkpoint-final"), ("s", 7, "checkpoint-7")]


def test_split_has_no_leak_and_plan_stays_within_quota(spark):
    copies = joins.replicate_levels(spark.range(105), 3)
    split = sampling.train_eval_split(copies, "id")
    assert split.groupBy("id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert split.filter("split = 'eval'").count() == 30 and split.count() == 315
    items = spark.range(400).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("category"), F.format_string("%05d", "id").alias("filename"))
    done = items.filter("filename < '00100'").select("filename")
    plan = daily_captioning_plan(items, done, ["a", "b"], quota=50, n_keys=3, batch=10)
    per = {r.category: (r.n, r.k) for r in plan.groupBy("category").agg(F.count("*").alias("n"), F.max("key_id").alias("k")).collect()}
    # 34 and 66 captioned: the gap of 32 goes to a, the rest is shared; 30 fit on three keys, the others have none
    assert per == {"a": (41, 2), "b": (9, 0)}
    assert plan.filter("key_id IS NULL").count() == 11

    many = daily_captioning_plan(items, done, ["a", "b"], quota=5000, n_keys=3, batch=10)
    assert many.select("filename").distinct().count() == many.count() == 300


def test_augmentation_plan_meets_the_need_whatever_is_taken(spark):
    from hemline.functions import fixed

    images = [("c", "i0.jpg"), ("c", "i1.jpg")]
    # all names of slots 0 to 2 exist already for the first image, all but one of slot 3 for both
    names = [("c", f"i0_aug_{i}_{t}.jpg") for i in range(3) for t in fixed.TRANSFORMS]
    names += [("c", f"i{k}_aug_3_{t}.jpg") for k in (0, 1) for t in list(fixed.TRANSFORMS)[1:]]
    n = len(images) + len(names)
    have = spark.createDataFrame(images + names, "category string, filename string")
    counts = spark.createDataFrame([("c", 0, n)], "category string, pos int, n bigint")
    plan = sampling.augmentation_plan(have, counts, n + 6).collect()
    assert sorted(r.i for r in plan) == list(range(6))
    assert not {r.new_name for r in plan} & {f for _, f in images + names}


def test_augmentation_plan_draws_again_once(spark):
    images = spark.createDataFrame([("c", f"i{k}.jpg") for k in range(3)], "category string, filename string")
    counts = spark.createDataFrame([("c", 0, 3)], "category string, pos int, n bigint")
    plan = sampling.augmentation_plan(images, counts, 43)
    assert plan.count() == 40 and plan.select("new_name").distinct().count() == 40
    taken = images.union(plan.select("category", "new_name").limit(10))
    again = sampling.augmentation_plan(taken, counts, 43)
    assert again.join(taken, again.new_name == taken.filename).count() == 0
    split = sampling.augmentation_plan(images, counts, 43, hot_rows=0)
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in plan.collect()}


def test_weights_are_met(spark):
    df = spark.range(4000).select(F.col("id"), F.lit("social_media").alias("category"))
    share = sampling.weighted_choice(df, F.col("id")).filter("content_type = 'caption'").count() / 4000
    assert share == pytest.approx(0.75, abs=0.03)


def test_pending_items_know_their_category(spark, rows):
    items = spark.createDataFrame([("a", "1.jpg"), ("b", "1.jpg"), ("b", "2.jpg")], "category string, filename string")
    done = spark.createDataFrame([("a", "1.jpg")], "category string, filename string")
    today = spark.createDataFrame([("2.jpg",)], "filename string")
    assert rows(joins.pending_items(items, done), "category", "filename") == [("b", "1.jpg"), ("b", "2.jpg")]
    assert rows(joins.pending_items(items, done, today), "category", "filename") == [("b", "1.jpg")]
    assert rows(joins.pending_items(items, done.select("filename")), "category", "filename") == [("b", "2.jpg")]
