"""Caption files, balance, pending work, names, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import CATS, DOCS, DONE, LANGS, documents, labelled, md5_text, query, sql_values, table
from hemline.functions import fixed
from hemline.operators import balance, images, joins, naming, sampling
from hemline.operators.scale import first_n
from hemline.plans.captioning import daily_captioning_plan
from hemline.session import shared_path
from hemline.sources import captions as caption_files
from hemline.sources import examples as example_files
from hemline.sources import images as image_files


def doc_counts(spark, sf):
    return caption_files.caption_file_counts(documents(spark, sf), LANGS)


def done_counts(spark, sf):
    done = documents(spark, sf).join(labelled(spark, sf), "filename", "left_semi")
    return caption_files.caption_file_counts(done, LANGS)


COUNTS = (
    f"{CATS}, counts AS (SELECT category, pos, count(d.doc_id) AS n FROM cats "
    "LEFT JOIN documents d ON d.lang = category GROUP BY ALL)"
)
DONE_COUNTS = (
    f"{CATS}, counts AS (SELECT category, pos, count(d.doc_id) AS n FROM cats LEFT JOIN "
    "(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) d ON d.lang = category GROUP BY ALL)"
)


# --- files ------------------------------------------------------------------------------------------------

@query(
    "src_01_read_captions",
    f"WITH {DOCS} SELECT category, filename, category AS season, '' AS gender, md5(caption) AS caption, "
    "length(caption) AS n FROM docs",
)
def _(spark, sf):
    root = shared_path(spark, "captions")
    caption_files.append_captions(documents(spark, sf), root)
    return caption_files.read_caption_table(spark, root).select(
        "category", "filename", "season", "gender", md5_text("caption").alias("caption"),
        F.length("caption").cast("bigint").alias("n"),
    )


@query("src_02_append_captions", "SELECT lang AS category, count(*) * 2 AS n FROM documents GROUP BY lang")
def _(spark, sf):
    root = shared_path(spark, "captions")
    caption_files.append_captions(documents(spark, sf), root)
    caption_files.append_captions(documents(spark, sf), root)
    return caption_files.read_caption_table(spark, root).groupBy("category").agg(F.count("*").alias("n"))


@query("src_03_caption_file_counts", f"WITH {COUNTS} SELECT * FROM counts")
def _(spark, sf):
    return doc_counts(spark, sf)


def _examples(spark, sf):
    meta = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("clothing", "season", "style", "platform")],
                    F.col("source").alias("context"), F.lit("short").alias("length_spec"))
    return documents(spark, sf).select(
        F.concat(F.lit("Describe "), "filename").alias("instruction"), F.lit("").alias("input"),
        F.col("caption").alias("output"), F.lit("caption").alias("content_type"), "category",
        meta.alias("metadata"), F.lit(0).alias("i"),
    )


@query(
    "src_04_read_examples",
    f"WITH {DOCS} SELECT category, 'Describe ' || filename AS instruction, md5(caption) AS output, "
    "source AS context FROM docs",
)
def _(spark, sf):
    root = shared_path(spark, "examples")
    example_files.write_examples(_examples(spark, sf), root)
    return example_files.read_examples(spark, root).select(
        "category", "instruction", md5_text("output").alias("output"), "metadata.context"
    )


@query("src_05_write_examples", "SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def _(spark, sf):
    root = shared_path(spark, "examples")
    rows = _examples(spark, sf)
    example_files.write_examples(rows, root)
    # writing one category again replaces that category only
    example_files.write_examples(rows.filter("category = 'fr'"), root)
    files = example_files.read_examples(spark, root).groupBy("file", "category").agg(F.count("*").alias("n"))
    return files.groupBy("category").agg(F.sum("n").alias("n"))


@query(
    "src_07_image_inventory",
    f"WITH {CATS}, wanted AS (SELECT * FROM cats UNION ALL SELECT 'it', 4), "
    "per AS (SELECT category, pos, count(d.doc_id) AS n, count(d.doc_id) = 0 AS missing FROM wanted "
    "LEFT JOIN documents d ON d.lang = category GROUP BY ALL) "
    "SELECT * FROM per UNION ALL SELECT 'total', 5, sum(n)::bigint, bool_or(missing) FROM per",
)
def _(spark, sf):
    return image_files.image_inventory(documents(spark, sf), [*LANGS, "it"])


# --- balance ----------------------------------------------------------------------------------------------

@query(
    "agg_01_balance_stats",
    f"WITH {COUNTS}, s AS (SELECT sum(n)::bigint AS total, avg(n) AS average, min(n) AS smallest, max(n) AS largest "
    "FROM counts) SELECT total, average, smallest, largest, largest - smallest AS imbalance, "
    "CASE WHEN total = 0 THEN 'none found' WHEN largest = smallest THEN 'perfect' WHEN largest - smallest <= 5 THEN "
    "'very well balanced' WHEN largest - smallest <= 20 THEN 'moderately balanced' WHEN largest - smallest <= 50 THEN "
    "'somewhat imbalanced' ELSE 'significantly imbalanced' END AS verdict FROM s",
)
def _(spark, sf):
    return balance.balance_stats(doc_counts(spark, sf))


GAPS = (
    f"WITH {COUNTS} SELECT category, pos, n, max(n) OVER () - n AS gap, "
    "(max(n) OVER () * count(*) OVER () - sum(n) OVER ())::bigint AS total_gap, "
    "row_number() OVER (ORDER BY n, pos) AS priority FROM counts"
)


@query("agg_02_balance_gaps", GAPS)
def _(spark, sf):
    return balance.balance_gaps(doc_counts(spark, sf))


@query(
    "ord_03_priority_order",
    f"WITH {DONE_COUNTS} SELECT category, n, row_number() OVER (ORDER BY n, pos) AS priority FROM counts",
)
def _(spark, sf):
    return balance.balance_gaps(done_counts(spark, sf)).orderBy("n", "pos").select("category", "n", "priority")


def _quota_sql(quota: int) -> str:
    return (
        f"SELECT {quota} AS quota, category, n, gap, CASE WHEN tg = 0 THEN {quota} // k WHEN tg <= {quota} THEN "
        f"gap + ({quota} - tg) // k ELSE floor({quota} * (gap::double / tg))::bigint END AS target FROM g"
    )


@query(
    "agg_03_allocate_quota",
    f"WITH {DONE_COUNTS}, g0 AS (SELECT category, pos, n, max(n) OVER () - n AS gap, count(*) OVER () AS k FROM counts), "
    "g AS (SELECT *, (sum(gap) OVER ())::bigint AS tg FROM g0) "
    + " UNION ALL ".join(_quota_sql(q) for q in (100, 160, 1_000_000)),
)
def _(spark, sf):
    counts = done_counts(spark, sf)
    parts = [
        balance.allocate_quota(counts, q).select(F.lit(q).alias("quota"), "category", "n", "gap", "target")
        for q in (100, 160, 1_000_000)
    ]
    return joins.union_categories(*parts)


@query(
    "agg_04_needed",
    f"WITH {COUNTS}, m AS (SELECT *, greatest(500 - n, 0) AS needed, n + greatest(500 - n, 0) AS after FROM counts) "
    "SELECT *, (sum(n) OVER ())::bigint AS total_before, (sum(after) OVER ())::bigint AS total_after FROM m",
)
def _(spark, sf):
    return balance.needed(doc_counts(spark, sf), 500)


@query(
    "agg_05_sample_advice",
    f"WITH {DONE_COUNTS} SELECT *, CASE WHEN n < 50 THEN 'needs more' WHEN n < 100 THEN 'could use more' ELSE 'good' END "
    "AS advice, CASE WHEN n < 50 THEN 50 - n WHEN n < 100 THEN 100 - n ELSE 0 END AS missing FROM counts",
)
def _(spark, sf):
    return balance.sample_advice(done_counts(spark, sf))


# --- image sizes from part --------------------------------------------------------------------------------

def part_images(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("category"),
        F.format_string("%08d.jpg", k).alias("filename"),
        F.when(k % 41 == 0, -1).otherwise(120 + (k * 37) % 2600).cast("int").alias("width"),
        F.when(k % 41 == 0, -1).otherwise(120 + (k * 53) % 2300).cast("int").alias("height"),
        F.when(k % 41 == 0, -1).when(k % 13 == 0, 1).otherwise(3).cast("int").alias("n_channels"),
    )


IMAGES = (
    "img AS (SELECT p_brand AS category, p_partkey AS k, p_partkey % 41 <> 0 AS ok, 120 + (p_partkey * 37) % 2600 AS w, "
    "120 + (p_partkey * 53) % 2300 AS h, p_partkey % 13 = 0 AS gray FROM part), "
    "sized AS (SELECT *, CASE WHEN ok THEN least(w, h) END AS s, CASE WHEN ok THEN greatest(w, h) END AS l, "
    "CASE WHEN ok THEN w::double / h END AS a FROM img)"
)


def _rounded(df, names):
    return df.select([F.round(c, 4).alias(c) if c in names else F.col(c) for c in df.columns])


STATS = (
    "count(*) AS checked, round(avg(w) FILTER (ok), 4) AS avg_width, round(avg(h) FILTER (ok), 4) AS avg_height, "
    "round(avg(a), 4) AS avg_aspect, count(*) FILTER (s < 256) AS tiny, count(*) FILTER (s >= 256 AND s < 512) AS small, "
    "count(*) FILTER (s >= 512 AND l < 1024) AS good, count(*) FILTER (s >= 512 AND l >= 1024 AND l < 2048) AS large, "
    "count(*) FILTER (s >= 512 AND l >= 2048) AS huge, count(*) FILTER (a < 0.5 OR a > 2.0) AS extreme_aspect, "
    "count(*) FILTER (NOT ok OR gray) AS format_issues, "
    "count(*) FILTER (s < 256) + count(*) FILTER (NOT ok OR gray) AS issues"
)


@query(
    "agg_06_image_stats",
    f"WITH {IMAGES} SELECT category, {STATS} FROM sized GROUP BY category",
)
def _(spark, sf):
    return _rounded(images.image_stats(part_images(spark, sf)), {"avg_width", "avg_height", "avg_aspect"})


OVERVIEW = (
    "count(*) AS checked, min(w)::int AS min_width, max(w)::int AS max_width, round(avg(w), 4) AS avg_width, "
    "min(h)::int AS min_height, max(h)::int AS max_height, round(avg(h), 4) AS avg_height, "
    "count(*) FILTER (s < 256) AS tiny, count(*) FILTER (s >= 256 AND s < 512) AS small, "
    "count(*) FILTER (l >= 512 AND l < 1024) AS good, count(*) FILTER (l >= 1024 AND l < 2048) AS large, "
    "count(*) FILTER (l >= 2048) AS huge"
)


@query(
    "agg_07_image_overview",
    f"WITH {IMAGES}, o AS (SELECT {OVERVIEW} FROM sized WHERE ok) SELECT *, "
    + ", ".join(f"round({b} / checked * 100, 4) AS {b}_pct" for b in ("tiny", "small", "good", "large", "huge"))
    + " FROM o",
)
def _(spark, sf):
    o = images.image_overview(part_images(spark, sf))
    return _rounded(o, {"avg_width", "avg_height", *[c for c in o.columns if c.endswith("_pct")]})


@query(
    "agg_08_readiness",
    f"WITH {DONE_COUNTS}, {IMAGES}, c AS (SELECT sum(n) AS total, min(n) AS smallest FROM counts), i AS (SELECT count(*) "
    "FILTER (ok) AS checked, count(*) FILTER (s < 256) AS tiny, count(*) FILTER (s < 256) + count(*) FILTER (NOT ok OR gray) "
    "AS issues FROM sized), f AS (SELECT list_filter([CASE WHEN total < 200 THEN 'dataset too small' WHEN smallest < 30 THEN "
    "'some categories too small' END, CASE WHEN issues > 10 THEN 'image quality issues' END, CASE WHEN tiny > checked * 0.1 "
    "THEN 'too many tiny images' END], lambda x: x IS NOT NULL) AS found FROM c, i) "
    "SELECT len(found) = 0 AS ready, array_to_string(found, '; ') AS issues FROM f",
)
def _(spark, sf):
    stats = images.image_stats(part_images(spark, sf), sample=None)
    totals = stats.agg(
        F.sum("tiny").alias("tiny"), F.sum("issues").alias("issues"),
        F.sum(F.col("tiny") + F.col("small") + F.col("good") + F.col("large") + F.col("huge")).alias("checked"),
    )
    out = balance.readiness(done_counts(spark, sf), totals)
    return out.select("ready", F.array_join("issues", "; ").alias("issues"))


# --- pairing and pending ----------------------------------------------------------------------------------

@query(
    "join_01_pair_images_captions",
    f"WITH {DOCS}, caps AS (SELECT category, filename, 'v' || g.i || ' ' || md5(caption) AS caption, g.i AS pos FROM docs, "
    "range(2) g(i) WHERE docs.pos % 3 = 0 OR g.i = 0) SELECT d.category, d.filename, max_by(c.caption, c.pos) AS caption "
    f"FROM docs d JOIN caps c USING (category, filename) JOIN labels l ON l.doc_id = d.pos GROUP BY ALL",
)
def _(spark, sf):
    docs = documents(spark, sf)
    copies = docs.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).filter("pos % 3 = 0 OR i = 0")
    caps = copies.select(
        "category", "filename",
        F.concat(F.lit("v"), F.col("i").cast("string"), F.lit(" "), md5_text("caption")).alias("caption"),
        F.col("i").alias("pos"),
    )
    imgs = docs.select("category", "filename").join(labelled(spark, sf), "filename", "left_semi")
    return joins.pair_images_captions(imgs.select("category", "filename"), caps)


FOLDERS = (
    "places AS (SELECT filename, p.prio, 'f' || p.prio || '/' || filename AS path FROM done, (VALUES (0), (1), (2), (3), (4)) "
    "p(prio) WHERE (substr(filename, 1, 8)::bigint + p.prio * 3) % 5 < 2)"
)


def _places(spark, sf):
    n = F.substring("filename", 1, 8).cast("bigint")
    return (
        labelled(spark, sf)
        .withColumn("prio", F.explode(F.array(*[F.lit(i) for i in range(5)])))
        .filter((n + F.col("prio") * 3) % 5 < 2)
        .withColumn("path", F.concat(F.lit("f"), F.col("prio").cast("string"), F.lit("/"), "filename"))
    )


@query(
    "join_02_pair_first_location",
    f"WITH {DOCS}, {DONE}, {FOLDERS} SELECT category, filename, min_by(path, prio) AS path, min(prio) AS prio "
    "FROM docs JOIN places USING (filename) GROUP BY ALL",
)
def _(spark, sf):
    return joins.pair_first_location(documents(spark, sf).select("category", "filename"), _places(spark, sf))


@query(
    "join_02_captions_without_image",
    f"WITH {DOCS}, {DONE}, {FOLDERS} SELECT category, filename FROM docs ANTI JOIN places USING (filename)",
)
def _(spark, sf):
    return joins.captions_without_image(documents(spark, sf).select("category", "filename"), _places(spark, sf))


PENDING = (
    f"{DOCS}, {DONE}, rest AS (SELECT category, filename, pos FROM docs WHERE filename NOT IN (FROM done) AND pos % 10 <> 3)"
)


def _pending(spark, sf, limit=None):
    docs = documents(spark, sf).select("category", "filename", "pos")
    handled = docs.filter("pos % 10 = 3")
    return joins.pending_items(docs, labelled(spark, sf), handled, limit)


@query(
    "join_03_pending_items",
    f"WITH {PENDING} SELECT category, filename, row_number() OVER (PARTITION BY category ORDER BY filename) AS rank "
    "FROM rest QUALIFY rank <= 25",
)
def _(spark, sf):
    return _pending(spark, sf, 25).select("category", "filename", "rank")


@query("set_05_difference", f"WITH {PENDING} SELECT category, filename FROM rest")
def _(spark, sf):
    return _pending(spark, sf).select("category", "filename")


@query(
    "win_02_first_n_per_category",
    f"WITH {DOCS} SELECT category, filename, row_number() OVER (PARTITION BY category ORDER BY filename) AS rank "
    "FROM docs QUALIFY rank <= 20",
)
def _(spark, sf):
    return first_n(documents(spark, sf).select("category", "filename"), ["category"], ["filename"], 20)


@query(
    "win_08_assign_keys",
    f"WITH {PENDING}, o AS (SELECT category, filename, row_number() OVER (ORDER BY filename) - 1 AS i FROM rest) "
    "SELECT category, filename, CASE WHEN i < 9 * 15 THEN i // 15 END AS key_id FROM o",
)
def _(spark, sf):
    todo = _pending(spark, sf).select("category", "filename")
    return joins.assign_keys(todo, n_keys=9, batch=15, order=["filename"])


PREFIXES = [("en", "sm"), ("fr", "sw"), ("de", "wm"), ("es", "ww")]


def _files(spark, sf):
    docs = documents(spark, sf)
    prefix = F.coalesce(*[F.when(F.col("category") == c, F.lit(p)) for c, p in PREFIXES])
    name = F.when(
        F.col("pos") % 7 == 0, F.concat(prefix, F.lit("_"), (F.col("pos") % 97).cast("string"), F.lit(".jpg"))
    ).otherwise(F.concat(F.lit("Img"), F.md5(F.col("pos").cast("string")), F.lit(".JPG")))
    return docs.select("category", name.alias("filename")).distinct()


@query(
    "win_06_assign_names",
    f"WITH p(category, prefix) AS (VALUES {sql_values(PREFIXES)}), files AS (SELECT DISTINCT lang AS category, prefix, CASE WHEN "
    "doc_id % 7 = 0 THEN prefix || '_' || (doc_id % 97) || '.jpg' ELSE 'Img' || md5(doc_id::varchar) || '.JPG' END AS filename "
    "FROM documents JOIN p ON p.category = lang), taken AS (SELECT category, try_cast(regexp_extract(filename, '^' || prefix || "
    "'_([1-9][0-9]*)[.]', 1) AS bigint) AS t FROM files WHERE regexp_matches(filename, '^' || prefix || '_[1-9][0-9]*[.]')), "
    "free AS (SELECT p.category, i, row_number() OVER (PARTITION BY p.category ORDER BY i) AS k FROM p, range(1, (SELECT count(*) "
    "+ 200 FROM files)) r(i) WHERE NOT EXISTS (FROM taken WHERE taken.category = p.category AND t = i)), "
    "ordered AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY lower(filename), filename) AS k FROM files) "
    "SELECT o.category, o.filename, o.prefix || '_' || f.i || '.jpg' AS new_name FROM ordered o JOIN free f USING (category, k)",
)
def _(spark, sf):
    prefixes = spark.createDataFrame(PREFIXES, "category string, prefix string")
    return naming.assign_names(_files(spark, sf), prefixes)


@query(
    "win_07_next_index",
    f"WITH {DOCS}, ex AS (SELECT category, max(pos) AS top FROM docs WHERE pos IN (SELECT doc_id FROM labels) AND category <> 'es' "
    "GROUP BY category), nw AS (SELECT category, filename, row_number() OVER (PARTITION BY category ORDER BY filename) AS k "
    'FROM docs WHERE pos NOT IN (SELECT doc_id FROM labels)) SELECT category, filename, coalesce(top + 1, 0) + k - 1 AS "index", '
    "category || '_' || (coalesce(top + 1, 0) + k - 1) || '.jpg' AS new_name FROM nw LEFT JOIN ex USING (category)",
)
def _(spark, sf):
    docs = documents(spark, sf)
    marked = docs.join(labelled(spark, sf), "filename", "left_semi").filter("category <> 'es'")
    existing = marked.select(
        "category", F.concat("category", F.lit("_"), F.col("pos").cast("string"), F.lit(".jpg")).alias("filename")
    )
    new = docs.join(labelled(spark, sf), "filename", "left_anti").select("category", "filename")
    return naming.next_index(existing, new, ["filename"])


# --- unions, copies, draws --------------------------------------------------------------------------------

@query(
    "set_01_union_categories",
    f"WITH {DOCS} SELECT category, filename, CASE WHEN category = 'fr' THEN source END AS source FROM docs "
    "WHERE category IN ('en', 'fr', 'de', 'es')",
)
def _(spark, sf):
    docs = documents(spark, sf)
    parts = [docs.filter(F.col("category") == c) for c in ("en", "fr", "de", "es")]
    return joins.union_categories(
        parts[0].select("category", "filename"), parts[1].select("category", "filename", "source"),
        parts[2].select("category", "filename"), parts[3].select("category", "filename"),
    )


@query(
    "set_02_replicate_levels",
    f"WITH {DOCS} SELECT filename, level FROM docs, (VALUES ('none'), ('normal'), ('strong')) l(level)",
)
def _(spark, sf):
    return joins.replicate_levels(documents(spark, sf).select("filename"), 3)


BUCKET = "('0x' || substr(md5({0}), 1, 8))::bigint"


def _type_of(spark, sf):
    types = list(fixed.EXAMPLE_TARGETS)
    return documents(spark, sf).withColumn(
        "category", F.get(F.array(*[F.lit(t) for t in types]), (F.col("pos") % len(types)).cast("int"))
    )


@query(
    "sam_01_weighted_choice",
    "WITH ct(category, content_type, weight, length_spec, pos) AS (VALUES "
    + sql_values([(c, t, w, s, i) for i, (c, t, w, s) in enumerate(sampling.CONTENT_TYPES)])
    + "), r AS (SELECT *, sum(weight) OVER (PARTITION BY category ORDER BY pos) AS upto, sum(weight) OVER (PARTITION BY category) "
    "AS total FROM ct), d AS (SELECT doc_id, (["
    + ", ".join(f"'{t}'" for t in fixed.EXAMPLE_TARGETS)
    + "])[doc_id % 7 + 1] AS category FROM documents) "
    "SELECT doc_id AS pos, category, content_type, length_spec FROM d JOIN r USING (category) WHERE "
    + BUCKET.format("'42|type|' || doc_id")
    + " % total BETWEEN upto - weight AND upto - 1",
)
def _(spark, sf):
    rows = _type_of(spark, sf).select("pos", "category")
    return sampling.weighted_choice(rows, F.col("pos"))


def _pick_sql(values, tag):
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "])[" + BUCKET.format(
        f"'42|{tag}|' || category || '|' || i"
    ) + f" % {len(values)} + 1]"


@query(
    "sam_02_generate_instructions",
    "WITH t AS (SELECT (["
    + ", ".join(f"'{t}'" for t in fixed.EXAMPLE_TARGETS)
    + "])[doc_id % 7 + 1] AS category, count(*) AS target FROM documents GROUP BY 1), e AS (SELECT category, unnest(range(target)) "
    "AS i FROM t), p AS (SELECT category, i, "
    + ", ".join(
        f"{_pick_sql(v, n)} AS {n}"
        for n, v in (
            *sampling.DEFAULT_CATALOGUE.items(), ("template", sampling.DEFAULT_TEMPLATES),
        )
    )
    + " FROM e) SELECT category, i, replace(replace(replace(replace(template, '{style}', style), '{clothing}', clothing), "
    "'{season}', season), '{context}', context) AS instruction, platform FROM p",
)
def _(spark, sf):
    targets = _type_of(spark, sf).groupBy("category").agg(F.count("*").alias("target"))
    return sampling.generate_instructions(targets).select("category", "i", "instruction", "metadata.platform")


SPLIT = "md5('42|' || {0})"


@query(
    "sam_03_train_eval_split",
    "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY "
    + SPLIT.format("doc_id")
    + ") AS r, floor(count(*) OVER () * 0.1) AS q FROM documents) SELECT doc_id AS pos, CASE WHEN r <= q THEN 'eval' ELSE 'train' END "
    "AS split FROM o",
)
def _(spark, sf):
    return sampling.train_eval_split(documents(spark, sf).select("pos"), "pos", unique=True)


@query(
    "sam_03_split_by_source_image",
    "WITH items AS (SELECT DISTINCT lang, doc_id FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY "
    + SPLIT.format("doc_id")
    + ") AS r, floor(count(*) OVER (PARTITION BY lang) * 0.2) AS q FROM items) SELECT lang AS category, doc_id AS pos, level, "
    "CASE WHEN r <= q THEN 'eval' ELSE 'train' END AS split FROM o, (VALUES ('none'), ('normal')) l(level)",
)
def _(spark, sf):
    copies = joins.replicate_levels(documents(spark, sf).select("category", "pos"), 2)
    return sampling.train_eval_split(copies, "pos", 0.2, within=["category"])


TRANSFORM_LIST = ", ".join(f"'{t}'" for t in fixed.TRANSFORMS)


@query(
    "sam_04_augmentation_plan",
    f"WITH {DOCS}, c AS (SELECT category, count(*) AS n, 400 - count(*) AS need FROM docs GROUP BY category), num AS (SELECT category, "
    "filename, row_number() OVER (PARTITION BY category ORDER BY filename) AS k FROM docs), d AS (SELECT category, i, n, "
    + BUCKET.format("'42|image|' || category || '|' || i || '|0'")
    + f" % n + 1 AS k, ([{TRANSFORM_LIST}])["
    + BUCKET.format("'42|transform|' || category || '|' || i || '|0'")
    + f" % {len(fixed.TRANSFORMS)} + 1] AS transform FROM (SELECT *, unnest(range(need)) AS i FROM c WHERE need > 0)) "
    "SELECT d.category, i, filename AS source, transform, replace(filename, '.jpg', '') || '_aug_' || i || '_' || transform || '.jpg' "
    "AS new_name FROM d JOIN num USING (category, k)",
)
def _(spark, sf):
    files = documents(spark, sf).select("category", "filename")
    return sampling.augmentation_plan(files, doc_counts(spark, sf), 400)


# --- the daily plan ---------------------------------------------------------------------------------------

@query(
    "daily_captioning_plan",
    f"WITH {DONE_COUNTS}, g0 AS (SELECT category, n, max(n) OVER () - n AS gap, count(*) OVER () AS k FROM counts), "
    "g AS (SELECT *, (sum(gap) OVER ())::bigint AS tg FROM g0), tgt AS (SELECT category, CASE WHEN tg = 0 THEN 160 // k WHEN "
    "tg <= 160 THEN gap + (160 - tg) // k ELSE floor(160 * (gap::double / tg))::bigint END AS target FROM g), "
    f"{DOCS}, {DONE}, rest AS (SELECT category, filename, row_number() OVER (PARTITION BY category ORDER BY filename) AS r FROM docs "
    "WHERE filename NOT IN (FROM done)), sel AS (SELECT * FROM rest JOIN tgt USING (category) WHERE r <= target), "
    "ord AS (SELECT category, filename, row_number() OVER (PARTITION BY category ORDER BY filename) - 1 AS i FROM sel) "
    "SELECT category, filename, i // 20 AS key_id FROM ord",
)
def _(spark, sf):
    return daily_captioning_plan(
        documents(spark, sf).select("category", "filename"), labelled(spark, sf), LANGS, quota=160, n_keys=8, batch=20
    )
