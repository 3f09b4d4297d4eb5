"""Pixel jobs on small images that Spark builds from the embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, quote, table
from hemline.functions import fixed
from hemline.operators import images
from hemline.operators.scale import draw
from hemline.session import shared_path
from hemline.sources import images as image_files


def _images(spark, sf):
    """Eight by (length / 8) gray images, one byte per number; one in fifty is unreadable."""
    e = table(spark, sf, "embeddings")
    gray = F.transform("embedding", lambda x: F.lpad(F.hex(F.pmod(F.floor(F.abs(x) * 1000), F.lit(256)).cast("bigint")), 2, "0"))
    bad = F.col("vec_id") % 50 == 49
    rows = e.select(
        "vec_id",
        F.when(bad, -1).otherwise(F.lit(8)).cast("int").alias("width"),
        F.when(bad, -1).otherwise(F.floor(F.size("embedding") / 8)).cast("int").alias("height"),
        F.when(bad, -1).otherwise(F.lit(1)).cast("int").alias("n_channels"),
        F.unhex(F.array_join(F.slice(gray, F.lit(1), (F.floor(F.size("embedding") / 8) * 8).cast("int")), "")).alias("data"),
    )
    return rows.repartition(spark.sparkContext.defaultParallelism, "vec_id")


_GRAY = (
    "g AS (SELECT vec_id, len(embedding) // 8 AS h, unnest(embedding[1:len(embedding) // 8 * 8]) AS x, generate_subscripts(embedding[1:len(embedding) // 8 * 8], 1) - 1 AS i FROM embeddings WHERE vec_id % 50 <> 49), "
    "p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, (floor(abs(x) * 1000)::bigint % 256) AS v FROM g)"
)


@query(
    "src_06_read_images",
    f"WITH {_GRAY} SELECT 'Summer_Men' AS category, vec_id || '.png' AS filename, 8 AS width, any_value(h)::int AS height, 1 AS n_channels, md5(string_agg(printf('%02X', v), '' ORDER BY y, x)) AS pixels "
    "FROM p JOIN (SELECT DISTINCT vec_id, h FROM g) USING (vec_id) GROUP BY vec_id UNION ALL SELECT 'Summer_Men', vec_id || '.png', -1, -1, -1, md5('') FROM embeddings WHERE vec_id % 50 = 49",
)
def _(spark, sf):
    root = shared_path(spark, "images")

    def write(rows):
        """Each task writes its images as PNG files into the shared folder."""
        import struct
        import zlib

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(f"{base}/Summer/Men", recursive=True)

        def chunk(tag, body):
            return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

        for r in rows:
            png = b"no image"
            if r.width > 0:
                lines = b"".join(b"\0" + bytes(r.data[i : i + r.width]) for i in range(0, len(r.data), r.width))
                head = struct.pack(">IIBBBBB", r.width, r.height, 8, 0, 0, 0, 0)
                png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
            with store.open_output_stream(f"{base}/Summer/Men/{r.vec_id}.png") as out:
                out.write(png)

    _images(spark, sf).foreachPartition(write)
    return image_files.read_images(spark, root).select(
        "category", "filename", "width", "height", "n_channels",
        F.md5(F.encode(F.when(F.col("width") > 0, F.hex("data")).otherwise(""), "utf-8")).alias("pixels"),
    )


def _checked(df):
    """Sum of pixel values weighted by place: equal only for equal images."""
    digits = F.expr("transform(sequence(0, length(pixels) div 3 - 1), i -> conv(hex(substring(pixels, i * 3 + 1, 1)), 16, 10) * (i + 1))")
    total = F.aggregate(digits, F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", F.when(F.col("pixels").isNotNull(), total).cast("bigint").alias("mark"))


@query(
    "sam_05_horizontal_flip",
    f"WITH {_GRAY} SELECT vec_id, sum(v * (y * 8 + (7 - x) + 1))::bigint AS mark FROM p GROUP BY vec_id UNION ALL SELECT vec_id, NULL FROM embeddings WHERE vec_id % 50 = 49",
)
def _(spark, sf):
    plan = _images(spark, sf).withColumn("transform", F.lit("horizontal_flip"))
    return _checked(images.augment_images(plan))


@query(
    "sam_05_brightness",
    f"WITH {_GRAY} SELECT vec_id, sum(least(255, floor(v * 1.25 + 0.5)) * (y * 8 + x + 1))::bigint AS mark FROM p GROUP BY vec_id UNION ALL SELECT vec_id, NULL FROM embeddings WHERE vec_id % 50 = 49",
)
def _(spark, sf):
    plan = _images(spark, sf).withColumn("transform", F.lit("brightness_medium_high"))
    return _checked(images.augment_images(plan))


_BUCKET = "('0x' || substr(md5({0}), 1, 8))::bigint"


@query(
    "sam_05_augment_images",
    "SELECT vec_id, (" + "[" + ", ".join(quote(t) for t in fixed.TRANSFORMS) + "])[" + _BUCKET.format("vec_id::varchar")
    + f" % {len(fixed.TRANSFORMS)} + 1] AS transform, CASE WHEN vec_id % 50 <> 49 THEN len(embedding) // 8 * 24 END AS n_bytes FROM embeddings",
)
def _(spark, sf):
    names = F.array(*[F.lit(t) for t in fixed.TRANSFORMS])
    drawn = F.get(names, draw(F.col("vec_id").cast("string"), len(fixed.TRANSFORMS)))
    out = images.augment_images(_images(spark, sf).withColumn("transform", drawn))
    return out.select("vec_id", "transform", F.length("pixels").cast("bigint").alias("n_bytes"))


def _drawn(tag: str, value: str) -> str:
    """SQL of a step taken with chance one half; U in ``value`` is the second draw."""
    unit = lambda t: "(" + _BUCKET.format(f"'42|strong|{t}|' || vec_id") + " / 4294967296.0)"
    return f"round(CASE WHEN {unit(tag)} < 0.5 THEN {value.replace('U', unit(tag + '-value'))} END, 6)"


@query(
    "sam_06_augment_random",
    f"SELECT vec_id, {_drawn('rotate', '(U * 2 - 1) * 30')} AS angle, {_drawn('bright', '1 + (U * 2 - 1) * 0.4')} AS brightness, "
    f"{_drawn('contrast', '1 + (U * 2 - 1) * 0.3')} AS contrast, CASE WHEN vec_id % 50 <> 49 THEN len(embedding) // 8 * 24 END AS n_bytes FROM embeddings",
)
def _(spark, sf):
    plan = images.random_plan(_images(spark, sf), "strong", F.col("vec_id"))
    out = images.augment_random(plan)
    drawn = [F.round(c, 6).alias(c) for c in ("angle", "brightness", "contrast")]
    return out.select("vec_id", *drawn, F.length("pixels").cast("bigint").alias("n_bytes"))


@query(
    "sam_07_prepare_images",
    f"WITH {_GRAY}, m AS (SELECT vec_id, h, round(avg(v / 127.5 - 1) + 1e-5, 3) AS mean FROM p JOIN (SELECT DISTINCT vec_id, h FROM g) USING (vec_id) GROUP BY ALL) SELECT vec_id, true AS ok, 192::bigint AS n, mean FROM m UNION ALL SELECT vec_id, false, 192, 0 FROM embeddings WHERE vec_id % 50 = 49",
)
def _(spark, sf):
    rows = images.prepare_images(_images(spark, sf), 8)
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.size("values")
    return rows.select("vec_id", "ok", F.size("values").cast("bigint").alias("n"), F.round(F.when(F.col("ok"), mean + 1e-5).otherwise(0.0), 3).alias("mean"))


@query(
    "sam_07_resize_plain_images",
    "SELECT vec_id, vec_id % 50 <> 49 AS ok, 48::bigint AS n, CASE WHEN vec_id % 50 <> 49 THEN round((vec_id % 256) / 127.5 - 1, 4) ELSE 0 END AS low, CASE WHEN vec_id % 50 <> 49 THEN round((vec_id % 256) / 127.5 - 1, 4) ELSE 0 END AS high FROM embeddings",
)
def _(spark, sf):
    """Images of one shade made smaller: every value must still be that shade."""
    shade = F.lpad(F.hex(F.col("vec_id") % 256), 2, "0")
    plain = _images(spark, sf).withColumn("data", F.unhex(F.repeat(shade, F.lit(8) * F.greatest("height", F.lit(0)))))
    rows = images.prepare_images(plain, 4)
    low, high = (F.round(f("values").cast("double"), 4) for f in (F.array_min, F.array_max))
    zero = lambda c: F.when(F.col("ok"), c).otherwise(0.0)
    return rows.select("vec_id", "ok", F.size("values").cast("bigint").alias("n"), zero(low).alias("low"), zero(high).alias("high"))
