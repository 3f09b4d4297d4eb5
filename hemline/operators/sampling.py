"""Weighted draws, generated instructions, splits and augmentation plans.

All randomness is an md5 draw on a seed and the row's own key, so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.functions import fixed, text
from hemline.operators.balance import needed
from hemline.operators.scale import HOT_ROWS, draw, ranked, repeated, small_side, smallest_share
from hemline.session import stored

# Own wordings; callers pass their own catalogue. Every placeholder is optional.
DEFAULT_TEMPLATES = [
    "Write a {style} text about {clothing} for the {season}, made for {context}.",
    "Introduce our {clothing} ({season}) to customers looking for {context}.",
    "Present the {style} {clothing} as the piece of the {season}.",
]
# Own short catalogue of what the placeholders stand for; callers pass theirs.
DEFAULT_CATALOGUE = {
    "clothing": ["linen shirt", "denim jacket", "knit cardigan", "silk scarf", "wool coat", "pleated skirt"],
    "season": ["spring", "summer", "autumn", "winter"],
    "style": ["plain", "elegant", "playful", "sporty"],
    "platform": ["photo feed", "short video", "newsletter", "web shop"],
    "context": ["work", "travel", "evenings", "weekends at home"],
}
# Content types by category with the weights of their draws (fixed values); the lengths are our own words.
CONTENT_TYPES = [
    ("social_media", "caption", 3, "short"),
    ("social_media", "engagement_post", 1, "short"),
    ("product_content", "description", 2, "medium"),
    ("product_content", "meta_description", 1, "one line"),
    ("product_content", "category_description", 1, "medium"),
    ("advertising", "ad_copy", 2, "short, with a headline"),
    ("advertising", "sale_promo", 1, "short"),
    ("video_creative", "reel_idea", 2, "medium, scene by scene"),
    ("video_creative", "story_content", 1, "medium"),
    ("campaigns", "campaign_idea", 2, "long"),
    ("campaigns", "launch_announcement", 1, "medium"),
    ("email_marketing", "email", 2, "medium, with a subject"),
    ("email_marketing", "whatsapp_broadcast", 1, "short"),
    ("brand_strategy", "slogan", 1, "one line each"),
    ("brand_strategy", "influencer_brief", 1, "long"),
    ("brand_strategy", "marketing_copy", 2, "medium"),
]


def _tag(seed: str, name: str, key: Column) -> Column:
    return F.concat(F.lit(f"{seed}|{name}|"), key.cast("string"))


def _pick(values: list[str], seed: str, name: str, key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), draw(_tag(seed, name, key), len(values)))


def weighted_choice(
    df: DataFrame, key: Column, content_types=CONTENT_TYPES, seed: str = "42", category: str = "category"
) -> DataFrame:
    """Draw a content type within each row's category, by weight. The catalogue is a constant, so no join."""
    choice, length = [], []
    by_category: dict[str, list] = {}
    for c, name, weight, spec in content_types:
        by_category.setdefault(c, []).append((name, weight, spec))
    for c, options in by_category.items():
        slots = [(name, spec) for name, weight, spec in options for _ in range(weight)]
        at = draw(_tag(seed, "type", key), len(slots))
        here = F.col(category) == c
        choice.append(F.when(here, F.get(F.array(*[F.lit(n) for n, _ in slots]), at)))
        length.append(F.when(here, F.get(F.array(*[F.lit(s) for _, s in slots]), at)))
    return df.withColumn("content_type", F.coalesce(*choice)).withColumn("length_spec", F.coalesce(*length))


def generate_instructions(
    targets: DataFrame, templates: list[str] = DEFAULT_TEMPLATES, seed: str = "42", content_types=CONTENT_TYPES,
    catalogue: dict[str, list[str]] = DEFAULT_CATALOGUE,
) -> DataFrame:
    """``target`` instruction rows per category, with content type, filled template and their metadata.

    The answer text (``output``) comes from a model later on and stays null here.
    """
    rows = repeated(targets.select("category", "target"), "target", "i")
    key = F.concat_ws("|", "category", F.col("i").cast("string"))
    rows = weighted_choice(rows, key, content_types, seed)
    for name, values in catalogue.items():
        rows = rows.withColumn(name, _pick(values, seed, name, key))
    filled = text.fill_template(
        _pick(templates, seed, "template", key),
        **{n: F.col(n) for n in ("style", "clothing", "season", "context")},
    )
    return rows.select(
        filled.alias("instruction"),
        F.lit("").alias("input"),
        F.lit(None).cast("string").alias("output"),
        "content_type",
        "category",
        F.struct("clothing", "season", "style", "platform", "context", "length_spec").alias("metadata"),
        "i",
    )


def train_eval_split(
    df: DataFrame, key: str, fraction: float = 0.1, seed: int = 42, within: list[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add ``split``: exactly floor(n * fraction) keys go to eval. Rows with the same key stay together, so
    copies of one source never land on both sides. ``unique`` promises that no key repeats."""
    marked = smallest_share(df, within or [], F.col(key), fraction, str(seed), "_eval", unique=unique)
    return marked.withColumn("split", F.when(F.col("_eval"), "eval").otherwise("train")).drop("_eval")


def augmentation_plan(
    images: DataFrame, counts: DataFrame, target: int, seed: str = "42", hot_rows: int = HOT_ROWS,
    split: bool | None = None,
) -> DataFrame:
    """Planned copies for categories below ``target``: (category, source, transform, new_name, i).

    Draw i takes any image of the category and any transform, with repeats allowed. If that name exists already, the
    next transforms in their order are tried, then the next images, so each slot gets a free name as long as there is
    one. ``images`` is (category, filename), ``counts`` is (category, pos, n).

    A name says which slot, image and transform it stands for, so an existing one is a place in the order its slot tries
    them in. The first place of a slot that is not among those is found by ranking them: no slot is tried twice,
    whatever is taken.
    """
    many = len(fixed.TRANSFORMS)
    short = needed(counts, target).filter("needed > 0 AND n > 0").select("category", "n", "needed")
    key = F.concat_ws("|", "category", F.col("i").cast("string"), F.lit("0"))
    first = {"k0": draw(_tag(seed, "image", key), F.col("n")), "t0": draw(_tag(seed, "transform", key), many)}
    usable = images.join(small_side(short.select("category")), "category", "left_semi")
    numbered = ranked(usable, ["category"], ["filename"], "k", hot_rows, split).withColumnRenamed("filename", "source")
    numbered = stored(numbered.select("category", "k", "source"), "numbered")

    # existing names that a slot could stand for, as (slot, place in its order)
    part = lambda n: F.regexp_extract("filename", _COPY, n)
    copies = usable.select(
        "category", F.concat(part(1), part(4)).alias("source"), part(2).try_cast("bigint").alias("i"),
        (F.array_position(F.array(*[F.lit(t) for t in fixed.TRANSFORMS]), part(3)) - 1).alias("t"),
    ).filter("i IS NOT NULL AND t >= 0")
    taken = copies.join(short, "category").filter("i < needed").join(numbered, ["category", "source"]).withColumns(first)
    place = F.pmod(F.col("k") - 1 - F.col("k0"), F.col("n")) * many + F.pmod(F.col("t") - F.col("t0"), F.lit(many))
    places = taken.select("category", "i", place.alias("place")).distinct()
    in_a_row = ranked(places, ["category", "i"], ["place"], "r", hot_rows).filter("place = r - 1")
    passed = in_a_row.groupBy("category", "i").agg(F.count(F.lit(1)).alias("passed"))

    slots = repeated(short, "needed", "i").select("category", "i", "n").join(passed, ["category", "i"], "left").na.fill({"passed": 0})
    slots = slots.filter(F.col("passed") < F.col("n") * many).withColumns(first)
    transforms = F.array(*[F.lit(t) for t in fixed.TRANSFORMS])
    slots = slots.select(
        "category", "i", (F.pmod(F.col("k0") + F.floor(F.col("passed") / many), F.col("n")) + 1).alias("k"),
        F.get(transforms, ((F.col("t0") + F.col("passed")) % many).cast("int")).alias("transform"),
    )
    stem, ext = F.regexp_replace("source", r"\.[^.]*$", ""), F.regexp_extract("source", r"(\.[^.]*)$", 1)
    name = F.concat(stem, F.lit("_aug_"), F.col("i").cast("string"), F.lit("_"), "transform", ext)
    return slots.join(numbered, ["category", "k"]).select("category", "i", "source", "transform", name.alias("new_name"))


# A copy's name: image without its ending, slot, transform, ending.
_COPY = r"(?s)^(.*)_aug_(0|[1-9][0-9]{0,17})_([^.]*)(\.[^.]*)?$"
