"""Ranking, enriching and reporting listings; resolving where a request means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.functions import fixed, geo
from hemline.functions import text as T
from hemline.operators.places import nearest_of, resolve_places
from hemline.operators.scale import first_n


NO_CITY = "Which city should be searched? Name one, or share your location to search near you."


def top_n(listings: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return first_n(listings, by, order, n)


def enrich_top(
    listings: DataFrame, details: DataFrame, by: list[str], order: list, n: int, key: str, on: str, value: str
) -> DataFrame:
    """Attach ``value`` from ``details`` to the first ``n`` listings per group; later listings get null.

    Only the first n are ranked and looked up; they are then matched back by ``key``, which is unique. Of repeated
    details the smallest value counts.
    """
    known = details.filter(F.col(value).isNotNull()).groupBy(on).agg(F.min(value).alias(value))
    top = first_n(listings, by, order, n).select(*by, key, on).join(known, on).select(*by, key, value)
    return listings.join(top, [*by, key], "left")


def listing_summary(listings: DataFrame, by: list[str], top: int, total_found: str | None = None) -> DataFrame:
    """Per query how many listings are shown and how many remain, counting on a larger stated total."""
    known = F.max(total_found) if total_found else F.lit(None).cast("bigint")
    out = listings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), known.alias("total_found"))
    shown = F.least(F.col("n"), F.lit(top).cast("bigint"))
    total = F.col("total_found")
    return out.withColumn("shown", shown).withColumn(
        "remaining", F.when(total > F.col("shown"), total - F.col("shown")).otherwise(F.col("n") - F.col("shown"))
    )


def resolve_city(
    requests: DataFrame, default_city: str = "Rawalpindi", max_km: float = 120.0, names: DataFrame | None = None,
    cities: DataFrame | None = None, key: str = "id",
) -> DataFrame:
    """City a request means and how it was found.

    By default place names and city points are the fixed ones. ``names`` (a :func:`places.name_table`) and ``cities``
    (name, lat, lon, pos) take tables of any size in their stead; ``key`` then tells the requests apart.

    ``requests`` has message, city (the tool's guess), and as available current_city, lat, lon, places (array
    of locality names for the coordinates) and ip_city. Only near-me messages use the writer's location:
    coordinates first, then the stated city, the address lookup, the default.
    """
    have = set(requests.columns)
    known, near_city = F.lit(None).cast("string"), None
    if names is not None and "places" in have:
        found = resolve_places(requests, names, key, "places").withColumnRenamed("place", "_place")
        requests, known = requests.join(found, key, "left"), F.col("_place")
    if cities is not None and {"lat", "lon"} <= have:
        spot = nearest_of(requests.select(key, "lat", "lon"), cities, key, max_km).select(key, F.col("name").alias("_nearest"))
        requests, near_city = requests.join(spot, key, "left"), F.col("_nearest")

    def column(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    lat, lon = column("lat", "double"), column("lon", "double")
    if names is None:
        said = F.filter(F.transform(column("places", "array<string>"), _known_place), lambda x: x.isNotNull())
        known = F.get(said, F.lit(0))
    if near_city is None:
        near_city = geo.nearest_city(lat, lon, max_km=max_km)["city"]
    by_point = F.when(lat.isNotNull() & lon.isNotNull(), F.coalesce(known, near_city))
    stated = T.strip(T.null_if_placeholder(column("current_city")))
    by_ip = F.when(column("ip_city") != "", column("ip_city"))
    fallback = default_city.strip() or fixed.LAST_RESORT_CITY
    near = T.is_near_me(F.col("message"))
    guess = T.null_if_placeholder(column("city"))
    city = F.when(near, F.coalesce(by_point, stated, by_ip, F.lit(fallback))).otherwise(guess)
    how = F.when(
        near,
        F.when(by_point.isNotNull(), "coordinates").when(stated.isNotNull(), "stated").when(by_ip.isNotNull(), "address")
        .otherwise("default"),
    ).otherwise(F.when(guess.isNotNull(), "named").otherwise("unknown"))
    return requests.withColumn("resolved_city", city).withColumn("how", how).drop("_place", "_nearest")


def _known_place(name: Column) -> Column:
    slug_to_city = T.literal_map([(s, c) for c, s in fixed.CITY_SLUGS.items()])
    return F.coalesce(T.city_in_text(name), F.try_element_at(slug_to_city, T.city_slug(name)))


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def render_listing_report(
    listings: DataFrame, queries: DataFrame, order: list, top: int = 5, site: str = "the site"
) -> DataFrame:
    """Markdown report per query: header, counts, the first ``top`` listings and what remains.

    ``queries`` is (query, city, ad_type, total_found, search_url); ``listings`` carries query and the listing
    columns. Only the first ``top`` listings per query are gathered. A query without a city was no search: its report
    asks for one, whatever listings carry its name.
    """
    best = first_n(listings, ["query"], order, top, "place")

    def line(label: str, value: Column, after: str = "") -> Column:
        return F.when(value != "", F.concat(F.lit(f"- **{label}:** "), value, F.lit(after)))

    url = F.coalesce("detail_url", F.lit(""))
    tags = F.array_join(F.col("labels"), " | ")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("\n### "), F.col("place").cast("string"), F.lit(". ["), "title", F.lit("]("), url, F.lit(")")),
        F.when(tags != "", tags),
        line("Location", F.col("city")),
        line("Price", F.coalesce("price", F.lit(fixed.NO_PRICE))),
        line("Size", F.col("dimensions"), " ft"),
        line("Contact", F.col("contact")),
        F.when(F.col("image_url") != "", F.concat(F.lit("\n!["), "title", F.lit("]("), "image_url", F.lit(")"))),
        F.when(url != "", F.concat(F.lit("- [View Details]("), url, F.lit(")"))),
    )
    blocks = best.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("blocks")
    )
    counts = listings.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    whole = queries.join(counts, "query", "left").join(blocks, "query", "left")
    n = F.coalesce("n", F.lit(0))
    shown = F.least(n, F.lit(top).cast("bigint"))
    total = F.col("total_found")
    left = F.when(total > shown, total - shown).otherwise(n - shown)
    city = title_case(F.col("city"))
    kind = title_case(F.coalesce("ad_type", F.lit("")))
    search = F.coalesce("search_url", F.lit(""))
    link = lambda before, label, after: F.when(
        search != "", F.concat(F.lit(f"{before}["), label, F.lit("]("), search, F.lit(f"){after}"))
    ).otherwise("")
    header = F.concat(
        F.lit("## Billboard Listings in "), city,
        F.when(kind != "", F.concat(F.lit(" ("), kind, F.lit(")"))).otherwise(""),
        F.when(total.isNotNull(), F.concat(F.lit("\n**"), total.cast("string"), F.lit(f" total listings found** on {site}")))
        .otherwise(""),
        F.lit("\n*First "), shown.cast("string"), F.lit(" shown"), link(" | ", F.lit("All results"), ""), F.lit("*\n"),
    )
    footer = F.when(
        left > 0,
        F.concat(
            F.lit("\n---\n### "), F.format_number(left, 0), F.lit(" further listings"),
            link("\n**", F.concat(F.lit("See every listing in "), city), "**"),
        ),
    ).otherwise(F.concat(F.lit("\n---\n*From "), link("", F.lit(site), ""), F.when(search == "", site).otherwise(""), F.lit("*")))
    body = F.array_join(F.col("blocks.block"), "\n")
    none = F.lit("\n\nNothing fits this search; another city or type of media may have more.")
    report = F.when(n == 0, F.concat(header, none)).otherwise(F.concat_ws("\n", header, body, footer))
    nowhere = F.coalesce("city", F.lit("")) == ""
    return whole.select("query", F.when(nowhere, F.lit(NO_CITY)).otherwise(report).alias("report"))


def render_details(details: DataFrame) -> DataFrame:
    """Markdown of one detail row: known fields in fixed order, then the rest in page order."""
    fields = F.map_entries("details")
    lead = F.array(*[F.lit(f) for f in fixed.DETAIL_FIELDS_FIRST])
    known = F.filter(
        F.transform(lead, lambda k: F.struct(k.alias("key"), F.try_element_at(F.col("details"), k).alias("value"))),
        lambda e: e["value"].isNotNull(),
    )
    others = F.filter(fields, lambda e: ~F.array_contains(lead, e["key"]))

    def bullets(entries: Column) -> Column:
        return F.array_join(
            F.transform(entries, lambda e: F.concat(F.lit("- **"), e["key"], F.lit(":** "), e["value"])), "\n"
        )

    images = F.array_join(
        F.transform(F.col("images"), lambda u, i: F.concat((i + 1).cast("string"), F.lit(". "), u)), "\n"
    )
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), "title"),
        F.concat(F.lit("*Source: "), "detail_url", F.lit("*\n")),
        F.when(F.col("price") != "", F.concat(F.lit("**Price:** "), "price")),
        F.when(F.size("details") > 0, F.concat(F.lit("\n### Details\n"), bullets(F.concat(known, others)))),
        F.when(F.size("address") > 0, F.concat(F.lit("\n### Address\n"), bullets(F.map_entries("address")))),
        F.when(F.col("map_url") != "", F.concat(F.lit("- [Open map]("), "map_url", F.lit(")"))),
        F.when(
            F.col("lat").isNotNull() & F.col("lon").isNotNull(),
            F.concat(F.lit("- **Coordinates:** "), F.col("lat").cast("string"), F.lit(", "), F.col("lon").cast("string")),
        ),
        F.when(F.col("description") != "", F.concat(F.lit("\n### Description\n"), "description")),
        F.when(
            F.size("images") > 0,
            F.concat(F.lit("\n### Images ("), F.size("images").cast("string"), F.lit(")\n"), images),
        ),
    )
    return details.select("page_id", lines.alias("report"))
