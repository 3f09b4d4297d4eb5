import csv
import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from hemline.functions import fixed
from hemline.operators import balance, images, sampling
from hemline.sources import captions, dims, examples, reports
from hemline.sources import images as image_files
from tests.rules import CONSTRAINT_RULES


def write_png(path, width, height, channels, color):
    kind = {1: 0, 3: 2, 4: 6}[channels]
    row = b"\x00" + bytes(color) * width

    def chunk(tag, body):
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    path.parent.mkdir(parents=True, exist_ok=True)
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(row * height)) + chunk(b"IEND", b"")
    )


def test_read_captions_and_counts(spark, tmp_path, rows):
    for category, body in {"Summer_Men": [("a.jpg", 'A man, "tall"\nwearing'), ("b.jpg", "x")], "Winter_Men": []}.items():
        with open(tmp_path / f"captions_{category}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f)
            w.writerow(["filename", "caption"])
            w.writerows(body)
    df = captions.read_captions(spark, str(tmp_path))
    assert rows(df) == [("Summer_Men", "Summer", "Men", "a.jpg", 'A man, "tall"\nwearing'), ("Summer_Men", "Summer", "Men", "b.jpg", "x")]
    counts = captions.caption_file_counts(df)
    assert rows(counts) == [("Summer_Men", 0, 2), ("Summer_Women", 1, 0), ("Winter_Men", 2, 0), ("Winter_Women", 3, 0)]


def test_append_keeps_earlier_captions(spark, tmp_path):
    df = spark.createDataFrame([("Summer_Men", "a.jpg", ' "q", \n two ')], "category string, filename string, caption string")
    for _ in range(2):
        captions.append_captions(df, str(tmp_path / "t"))
    got = captions.read_caption_table(spark, str(tmp_path / "t"))
    assert got.count() == 2 and {r.caption for r in got.collect()} == {' "q", \n two '}


def test_examples(spark, tmp_path):
    row = {"instruction": "i", "input": "", "output": "o", "content_type": "caption", "category": "social_media", "metadata": {"season": "summer"}}
    (tmp_path / "a.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps(row) + "\n")
    (tmp_path / "b.jsonl").write_text(json.dumps(row) + "\n")
    df = examples.read_examples(spark, str(tmp_path))
    assert sorted(r.n for r in examples.examples_per_file(df).collect()) == [1, 2]
    assert df.first().metadata.season == "summer"
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        examples.read_examples(spark, str(tmp_path / "none"))


def test_images_and_inventory(spark, tmp_path, rows):
    write_png(tmp_path / "Summer/Men/a.PNG", 3, 2, 3, (10, 20, 30))
    write_png(tmp_path / "Summer/Men/g.png", 2, 2, 1, (7,))
    (tmp_path / "Summer/Men/bad.png").write_bytes(b"junk")
    (tmp_path / "Summer/Men/note.txt").write_text("x")
    write_png(tmp_path / "Winter/Women/w.webp", 2, 2, 3, (1, 2, 3))
    df = image_files.read_images(spark, str(tmp_path))
    assert rows(df, "category", "filename", "width", "height", "n_channels") == [
        ("Summer_Men", "a.PNG", 3, 2, 3), ("Summer_Men", "bad.png", -1, -1, -1), ("Summer_Men", "g.png", 2, 2, 1),
    ]
    listed = image_files.list_images(spark, str(tmp_path))
    assert rows(image_files.image_inventory(listed)) == [
        ("Summer_Men", 0, 3, False), ("Summer_Women", 1, 0, True), ("Winter_Men", 2, 0, True), ("Winter_Women", 3, 1, False), ("total", 4, 4, True),
    ]
    stats = images.image_stats(df).first()
    assert (stats.checked, stats.tiny, stats.format_issues, stats.issues, stats.avg_width) == (3, 2, 2, 4, 2.5)
    flipped = images.augment_images(df.withColumn("transform", F.lit("horizontal_flip"))).collect()
    assert {r.filename: r.pixels and bytes(r.pixels[:3]) for r in flipped} == {"a.PNG": b"\x0a\x14\x1e", "g.png": b"\x07\x07\x07", "bad.png": None}


def test_size_bins_at_their_edges(spark):
    sides = [(255, 300), (256, 256), (511, 4000), (512, 1023), (512, 1024), (600, 2047), (600, 2048)]
    df = spark.createDataFrame([("c", f"{i}", w, h, 3) for i, (w, h) in enumerate(sides)], "category string, filename string, width int, height int, n_channels int")
    r = images.image_stats(df).first()
    assert (r.tiny, r.small, r.good, r.large, r.huge, r.extreme_aspect) == (1, 2, 1, 2, 1, 3)
    o = images.image_overview(df).first()
    assert (o.tiny, o.small, o.good, o.large, o.huge) == (1, 2, 1, 2, 2)


def test_eval_report(spark, tmp_path, rows):
    doc = {"content": {"a": {"score": 80.5, "found": ["x"]}, "average_score": 70}, "rules": {"overall_rate": 100.0}}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    got = reports.read_eval_report(spark, str(tmp_path / "r.json"))
    assert rows(got, "section", "test", "metric", "value") == [
        ("content", "a", "found", '["x"]'), ("content", "a", "score", "80.5"), ("content", None, "average_score", "70"), ("rules", None, "overall_rate", "100"),
    ]
    reports.write_eval_report(got.drop("file"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_judge_report(spark, tmp_path, rows):
    def evaluation(s):
        return {c: {"score": s, "justification": ""} for c in fixed.CRITERIA} | {"overall_score": s + 0.5, "overall_feedback": ""}

    doc = {"timestamp": "t", "results": [{"title": "x", "base_evaluation": evaluation(3), "finetuned_evaluation": evaluation(6)}]}
    (tmp_path / "j.json").write_text(json.dumps(doc, indent=1))
    got = rows(reports.read_judge_report(spark, str(tmp_path / "j.json")))
    assert len(got) == 12 and ("x", "base", "overall", 3.5) in got and ("x", "finetuned", "creativity", 6.0) in got


def test_runs(spark, tmp_path):
    for run, summary, args in [("r1", {"_step": 5, "train_loss": 0.5, "_runtime": 9}, ["--epochs", "20", "--use_log"]), ("r2", {"_runtime": 1}, None)]:
        files = tmp_path / run / "files"
        files.mkdir(parents=True)
        (files / "x-summary.json").write_text(json.dumps(summary))
        if args:
            (files / "x-metadata.json").write_text(json.dumps({"args": args}, indent=1))
    got = {r.run_id: r for r in reports.read_runs(spark, str(tmp_path)).collect()}
    assert got["r1"].args == {"epochs": "20", "use_log": None} and got["r1"].train_loss == 0.5
    assert got["r2"]._runtime == 1 and got["r2"].train_loss is None and got["r2"].args is None


def test_outcomes_and_balance_of_recorded_counts(spark, tmp_path, rows):
    counts = {"Winter_Women": 1359, "Winter_Men": 1213, "Summer_Women": 1400, "Summer_Men": 1245}
    doc = {c: {"captioned": n, "failed": 0, "total": n} for c, n in counts.items()} | {"timestamp": "t", "total_captioned": 5217}
    (tmp_path / "o.json").write_text(json.dumps(doc, indent=1))
    out = reports.read_outcomes(spark, str(tmp_path / "o.json"))
    total = balance.outcome_totals(out).filter("category IS NULL").first()
    assert (total.captioned, total.failed) == (5217, 0)
    order = {c: i for i, c in enumerate(counts)}
    n = out.select("category", F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])[F.col("category")].alias("pos"), F.col("captioned").alias("n"))
    stats = balance.balance_stats(n).first()
    assert (stats.total, stats.average, stats.imbalance, stats.verdict) == (5217, 1304.25, 187, "significantly imbalanced")
    gaps = rows(balance.balance_gaps(n), "pos", "gap", "priority")
    assert gaps == [(0, 41, 3), (1, 187, 1), (2, 0, 4), (3, 155, 2)]
    assert rows(balance.allocate_quota(n, 160), "category", "target") == [("Summer_Men", 64), ("Summer_Women", 0), ("Winter_Men", 78), ("Winter_Women", 17)]
    assert rows(balance.allocate_quota(n, 400), "category", "target") == [("Summer_Men", 159), ("Summer_Women", 4), ("Winter_Men", 191), ("Winter_Women", 45)]


@pytest.mark.parametrize("total, smallest, issues, tiny, want", [
    (100, 1, 11, 2, ["dataset too small", "image quality issues", "too many tiny images"]), (300, 20, 0, 1, ["some categories too small"]), (300, 40, 0, 0, []),
])
def test_readiness(spark, total, smallest, issues, tiny, want):
    counts = spark.createDataFrame([("a", 0, smallest), ("b", 1, total - smallest)], "category string, pos int, n bigint")
    totals = spark.createDataFrame([(10, tiny, issues)], "checked int, tiny int, issues int")
    r = balance.readiness(counts, totals).first()
    assert (r.ready, r.issues) == (not want, want)


def test_capacity(spark):
    keys = spark.createDataFrame([("valid", "Available (Est. 40+ images)"), ("valid", "Available"), ("quota", ""), ("error", "")], "status string, capacity string")
    r = balance.capacity_summary(keys).first()
    assert (r["keys"], r.valid, r.exhausted, r.remaining, r.per_category, r.overall) == (4, 2, 1, 90, 22, "some keys exhausted")


def test_dims(spark):
    assert dims.media_dim(spark).count() == 35 and dims.transform_dim(spark).count() == 33
    assert dims.city_dim(spark).filter("lat IS NOT NULL").count() == 10
    assert dims.content_type_dim(spark, sampling.CONTENT_TYPES).agg(F.sum("weight")).first()[0] == 24
    assert dims.tool_dim(spark).filter("required").count() == 5
    assert dims.rule_dim(spark, CONSTRAINT_RULES).filter("test = 'winter_men'").first().must_not == ["summer", "lawn", "cotton kurta"]


def test_recorded_files_are_written_by_tasks_and_pruned_by_place(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    from hemline.sources.recorded import _Reader, read_recorded, write_recorded

    root = f"file://{tmp_path}/recorded"
    data = [(f"day={i % 3}/u{i}", f"r{i % 2}.json", f"text {i}\nü") for i in range(30)] + [("", "top.json", None)]
    write_recorded(spark.createDataFrame(data, "folder string, name string, text string").repartition(4), root)
    got = {(r["folder"], r["name"], r["text"]) for r in read_recorded(spark, root, partition_bytes=40).collect()}
    assert got == {(f, n, t or "") for f, n, t in data}
    assert read_recorded(spark, root, partition_bytes=40).rdd.getNumPartitions() > 5
    reader = _Reader(root, 1000)
    assert list(reader.pushFilters([EqualTo(("name",), "r1.json"), StringStartsWith(("folder",), "day=1/"), EqualTo(("text",), "x")])) == [EqualTo(("text",), "x")]
    assert sum(len(p.paths) for p in reader.partitions()) == 5
    found = read_recorded(spark, root).filter("name = 'r1.json' AND folder LIKE 'day=1/%'")
    assert found.count() == 5
    with pytest.raises(Exception, match="no place below the root"):
        write_recorded(spark.createDataFrame([("../x", "a", "t")], "folder string, name string, text string"), root)


def test_packs_read_back_as_the_files_in_them(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    from hemline.sources.recorded import _Reader, read_recorded, write_recorded

    data = [(f"day={i % 3}/u{i}", f"r{i % 2}.json", f"text {i}\nü") for i in range(300)] + [("", "top.json", None)]
    df = spark.createDataFrame(data, "folder string, name string, text string").repartition(4)
    for depth, most in ((0, 8), (1, 8 * 3 + 1)):  # two tasks a core
        root = f"{tmp_path}/packs {depth}"
        write_recorded(df, root, pack_depth=depth)
        got = sorted((r["folder"], r["name"], r["text"]) for r in read_recorded(spark, root).collect())
        assert got == sorted((f, n, t or "") for f, n, t in data)
        assert sum(len(f) for _, _, f in os.walk(root)) <= most  # not one file for each row
        assert read_recorded(spark, root).filter("name = 'r1.json' AND folder LIKE 'day=1/%'").count() == 50
    reader = _Reader(root, 1000)
    list(reader.pushFilters([StringStartsWith(("folder",), "day=1/")]))
    assert {p.split("/")[-2] for part in reader.partitions() for p in part.paths} <= {"day=1", "packs 1"}
    reader = _Reader(root, 1000)
    list(reader.pushFilters([EqualTo(("folder",), "day=2/u5")]))
    assert [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()] == [{"folder": "day=2/u5", "name": "r1.json", "text": "text 5\nü"}]
    write_recorded(spark.createDataFrame([("day=1", "later.json", "x")], df.schema), root)  # loose files beside packs
    assert read_recorded(spark, root).count() == 302
    with pytest.raises(Exception, match="no place below the root"):
        write_recorded(spark.createDataFrame([("../x", "a", "t")], df.schema), root, pack_depth=0)
    assert read_recorded(spark, root).count() == 302


def test_runs_in_packs_and_odd_summaries(spark, tmp_path):
    from hemline.sources.recorded import write_recorded

    texts = {
        "a b": '{"_step": 3,\n "train_loss": 0.25}', "broken": '{"_step": 3, ', "empty": " ", "many": '[{"_step": 1}, {"_step": 2}]', "wrong": '{"_step": "x", "epoch": 4}',
    }
    data = [(f"{r}/files", "x-summary.json", t) for r, t in texts.items()] + [("a b/files", "x-metadata.json", '{"args": ["--epochs", "2"]}'), (".old/files", "x-summary.json", "{}")]
    write_recorded(spark.createDataFrame(data, "folder string, name string, text string"), f"{tmp_path}/packed", pack_depth=0)
    found = reports.read_runs(spark, f"{tmp_path}/packed")
    assert found.columns[0] == "run_id" and found.columns[-1] == "args"
    got = sorted(((r.run_id, r._step, r.epoch, r.train_loss, r.args) for r in found.collect()), key=repr)
    assert got == sorted([("a b", 3, None, 0.25, {"epochs": "2"}), ("broken", None, None, None, None), ("many", 1, None, None, None), ("many", 2, None, None, None), ("wrong", None, 4, None, None)], key=repr)
