"""Listings, details and links from raw pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemline.functions import html as H
from hemline.functions import text as T
from hemline.operators.scale import HOT_ROWS, Ordered, settled


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _is_price(n: Column) -> Column:
    return F.array_contains(F.split(n["cls"], " "), "price")


def extract_listings(
    pages: DataFrame, source: str | None = None, dedupe: str = "page", carry: list[str] = ()
) -> DataFrame:
    """Listing cards of each page (page_id, pos, title, …), with the page's stated total and its columns in ``carry``.

    Cards are elements with an "item-wrap" class, else articles with a listing class, else any article. Cards
    without a title are dropped; a repeated url (title where there is no url) keeps its first card, inside a
    page or, with ``dedupe="all"``, over all pages.

    Every step finds its elements once and the next one reads them, so no search is repeated.
    """
    n, s = F.col("nodes"), F.col("sub")
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("struct<none:int>")
    parsed = pages.select("page_id", F.col("url").alias("page_url"), carried.alias("with"), H.html_nodes(F.col("html")).alias("raw"))
    nodes = settled(parsed, "nodes", H.placed(F.col("raw"))).drop("raw")
    found = nodes.select(
        "page_id", "page_url", "with", "nodes",
        H.where(n, "div", "article", "li", test=lambda x: F.contains(x["cls"], F.lit("item-wrap"))).alias("wrapped"),
        H.where(n, "article").alias("articles"),
        H.first(n, "#text", test=lambda x: T.total_in_text(x["text"]).isNotNull()).alias("counted"),
    )
    listed = H.where(F.col("articles"), cls=["property-item", "property_item", "listing"])
    cards = (
        F.when(F.size("wrapped") > 0, F.col("wrapped")).when(F.size(listed) > 0, listed).otherwise(F.col("articles"))
    )
    cut = found.select(
        "page_id", "page_url", "with", T.total_in_text(F.col("counted.text")).alias("total_found"),
        F.posexplode(
            F.transform(cards, lambda c: F.struct((c["at"] + 1).alias("start"), H.below(n, c).alias("sub")))
        ).alias("card", "c"),
    ).select("page_id", "page_url", "with", "total_found", "card", "c.start", "c.sub")

    def under(node: str | Column) -> Column:
        return H.below(s, F.col(node) if isinstance(node, str) else node, F.col("start"))

    heads = H.where(s, "h2", "h3")
    spots = cut.select(
        "*",
        heads.alias("at_heads"),
        H.first(s, "span", test=_is_price).alias("at_price"),
        H.first(s, cls=["item-price", "listing-price", "property-price"]).alias("at_price_box"),
        H.where(s, "address").alias("at_places"),
        H.first(s, cls=["listing-location", "property-location"]).alias("at_place_box"),
        H.where(s, "a", cls=["hz-label"]).alias("at_label_links"),
        H.where(s, cls=["label-color-"]).alias("at_label_boxes"),
        H.first(s, "li", cls=["h-size"]).alias("at_size"),
        H.first(s, "li", cls=["h-vc"]).alias("at_zone"),
        H.first(s, cls=["listing-thumb"]).alias("at_thumb"),
        H.first(s, "img").alias("at_img"),
        H.first(
            s, test=lambda x: F.contains(F.lower(F.coalesce(H.attr(x, "style"), F.lit(""))), F.lit("background-image"))
        ).alias("at_painted"),
    )
    heads, places = F.col("at_heads"), F.col("at_places")
    spots = spots.filter(F.size(heads) > 0).select(
        "*",
        F.coalesce(
            H.first(heads, cls=["item-title", "entry-title", "listing-title"]), F.get(heads, F.lit(0))
        ).alias("pick_head"),
        F.coalesce(H.first(places, cls=["item-address"]), F.get(places, F.lit(0))).alias("pick_place"),
        F.when(F.size("at_label_links") > 0, F.col("at_label_links")).otherwise(F.col("at_label_boxes")).alias("pick_labels"),
        F.when(F.col("at_thumb").isNotNull(), H.first(under("at_thumb"), "img")).otherwise(F.col("at_img")).alias("pick_img"),
        H.first(under("at_size"), cls=["hz-figure"]).alias("pick_size"),
        H.first(under("at_zone"), cls=["hz-figure"]).alias("pick_zone"),
        H.text_of(s, " ").alias("pick_words"),
    )
    spots = spots.select(
        "*",
        H.first(under("pick_head"), "a").alias("link_a"),
        H.first(under("pick_place"), "span").alias("link_span"),
    )

    def text(*choices: str, separator: str = "") -> Column:
        """Text under the first of the elements that exists."""
        return H.text_of(under(F.coalesce(*[F.col(c) for c in choices])), separator)

    img = F.col("pick_img")
    shown = F.coalesce(_filled(H.attr(img, "data-src")), _filled(H.attr(img, "src")))
    values = spots.select(
        "*",
        text("link_a", "pick_head").alias("v_title"),
        _filled(T.strip(H.attr(F.col("link_a"), "href"))).alias("v_detail_url"),
        F.coalesce(text("at_price"), text("at_price_box", separator=" ")).alias("v_price"),
        _filled(text("link_span", "pick_place", "at_place_box")).alias("v_city"),
        F.array_distinct(
            F.filter(F.transform("pick_labels", lambda x: H.text_of(under(x))), lambda t: t != "")
        ).alias("v_labels"),
        text("pick_size", "at_size").alias("v_size"),
        text("pick_zone", "at_zone").alias("v_zone"),
        shown.alias("v_shown"),
        F.regexp_extract(H.attr(F.col("at_painted"), "style"), r"url\(['\"]?([^'\")\s]+)['\"]?\)", 1).alias("v_paint"),
    ).filter("v_title <> ''")
    words, low = F.col("pick_words"), F.lower("v_shown")
    plain = ~F.contains(low, F.lit("svg")) & ~F.contains(low, F.lit("data:image"))
    listing = values.select(
        "page_id",
        "page_url",
        "with",
        "total_found",
        "card",
        F.col("v_title").alias("title"),
        F.col("v_detail_url").alias("detail_url"),
        F.coalesce("v_price", T.price_in_text(words)).alias("price"),
        F.col("v_city").alias("city"),
        F.col("v_labels").alias("labels"),
        _filled(F.coalesce("v_size", T.size_in_text(words))).alias("dimensions"),
        _filled(F.col("v_zone")).alias("zone"),
        T.codes_in_text(words, F.col("v_zone")).alias("codes"),
        F.when(img.isNotNull(), F.when(plain, F.col("v_shown"))).otherwise(_filled(F.col("v_paint"))).alias("image_url"),
        F.lit(source).alias("source"),
        F.coalesce("v_detail_url", "v_title").alias("_key"),
    )
    # the first card wins; repeats are combined before the shuffle
    key = ["page_id", "_key"] if dedupe == "page" else ["_key"]
    whole = F.struct(*[c for c in listing.columns if c != "_key"])
    kept = listing.groupBy(*key).agg(F.min_by(whole, F.struct("page_id", "card")).alias("_row"))
    order = Window.partitionBy("page_id").orderBy("card")
    rows = kept.select("_row.*").withColumn("pos", F.row_number().over(order)).drop("card")
    return rows.select("*", *[F.col(f"with.{c}").alias(c) for c in carry]).drop("with")


def _pairs(box: Column, use_link: bool) -> Column:
    """Ordered label-to-value map of the list items among the nodes ``box``; a repeated label keeps its last value."""

    def parts(li: Column) -> Column:
        sub = _inside(box, li)
        return F.struct(li.alias("li"), H.first(sub, "strong").alias("strong"), H.first(sub, "span").alias("span"))

    def texts(p: Column) -> Column:
        link = H.first(_inside(box, p["span"]), "a") if use_link else F.lit(None)
        return F.struct(
            F.regexp_replace(H.text_of(_inside(box, p["strong"])), ":+$", "").alias("key"),
            H.text_of(_inside(box, p["span"])).alias("value"),
            (H.text_of(_inside(box, link)) if use_link else F.lit(None).cast("string")).alias("linked"),
        )

    items = F.filter(
        F.transform(H.where(box, "li"), parts), lambda p: p["strong"].isNotNull() & p["span"].isNotNull()
    )
    entries = F.transform(items, texts)
    if use_link:
        good = F.filter(
            entries,
            lambda e: e["linked"].isNotNull() | ((e["value"] != "") & ~F.contains(e["value"], F.lit("PLACEHOLDER"))),
        )
    else:
        good = F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != ""))
    return F.transform(good, lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["linked"], e["value"]).alias("value")))


def _inside(box: Column, node: Column) -> Column:
    return H.below(box, node, F.get(box, F.lit(0))["at"])


def _last_by_key(entries: Column) -> Column:
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    return F.coalesce(F.map_from_arrays(keys, values), F.create_map().cast("map<string,string>"))


def extract_details(pages: DataFrame) -> DataFrame:
    """One detail row per page: title, images, description, details and address maps, position and price."""
    n = F.col("nodes")
    parsed = pages.select("page_id", F.col("url").alias("detail_url"), H.html_nodes(F.col("html")).alias("raw"))
    nodes = settled(parsed, "nodes", H.placed(F.col("raw"))).drop("raw")
    spots = nodes.select(
        "*",
        H.first(n, "div", cls=["page-title"]).alias("at_title_box"),
        H.first(n, "h1").alias("at_h1"),
        H.where(n, "img", cls=["houzez-gallery-img"]).alias("at_gallery"),
        H.first(n, "div", cls=["property-description-wrap"]).alias("at_about"),
        H.first(n, "div", cls=["property-detail-wrap"]).alias("at_details"),
        H.first(n, "div", cls=["property-address-wrap"]).alias("at_address"),
        H.first(n, "li", cls=["item-price"]).alias("at_price_item"),
        H.first(n, "span", test=_is_price).alias("at_price"),
    )
    boxes = spots.select(
        "*",
        F.coalesce(H.first(H.below(n, F.col("at_title_box")), "h1"), F.col("at_title_box"), F.col("at_h1")).alias("box_title"),
        F.coalesce(
            H.first(H.below(n, F.col("at_about")), "div", cls=["description-content"]), F.col("at_about")
        ).alias("box_about"),
        H.below(n, F.col("at_details")).alias("box_details"),
        H.below(n, F.col("at_address")).alias("box_address"),
        F.when(
            F.col("at_price_item").isNotNull(), H.first(H.below(n, F.col("at_price_item")), "span", test=_is_price)
        ).otherwise(F.col("at_price")).alias("box_price"),
    )
    address = F.col("box_address")
    images = F.transform(
        F.col("at_gallery"), lambda g: F.coalesce(_filled(H.attr(g, "data-lazy")), _filled(H.attr(g, "src")), F.lit(""))
    )
    map_node = H.first(address, test=lambda x: F.map_contains_key(x["attrs"], F.lit("data-map")))
    values = boxes.select(
        "*",
        F.coalesce(H.text_of(H.below(n, F.col("box_title"))), F.lit("")).alias("v_title"),
        images.alias("v_images"),
        F.coalesce(T.collapse_blank_lines(H.text_of(H.below(n, F.col("box_about")), "\n")), F.lit("")).alias("v_description"),
        _pairs(F.col("box_details"), True).alias("v_details"),
        _pairs(address, False).alias("v_address"),
        _filled(H.attr(H.first(address, "a", cls=["hz-btn-map"]), "href")).alias("v_map_url"),
        F.from_json(H.attr(map_node, "data-map"), "map<string,string>", {"allowSingleQuotes": "false"}).alias("v_spot"),
        H.text_of(H.below(n, F.col("box_price"))).alias("v_price"),
    )
    real = F.filter(
        "v_images", lambda u: (u != "") & ~F.contains(u, F.lit("svg")) & ~F.contains(u, F.lit("data:image"))
    )
    return values.select(
        "page_id",
        "detail_url",
        F.col("v_title").alias("title"),
        F.array_distinct(real).alias("images"),
        F.col("v_description").alias("description"),
        _last_by_key(F.col("v_details")).alias("details"),
        _last_by_key(F.col("v_address")).alias("address"),
        F.col("v_map_url").alias("map_url"),
        F.try_element_at("v_spot", F.lit("latitude")).try_cast("double").alias("lat"),
        F.try_element_at("v_spot", F.lit("longitude")).try_cast("double").alias("lon"),
        F.coalesce(_filled(F.try_element_at("v_spot", F.lit("pricePin"))), "v_price", F.lit("")).alias("price"),
    )


def extract_links(
    pages: DataFrame, tag: str = "a", attribute: str = "href", includes: list[str] = (), excludes: list[str] = ()
) -> DataFrame:
    """Distinct attribute values per page, in page order (page_id, pos, url). No shuffle.

    Values come from the parsed page: entities are resolved, any quoting counts, comments and scripts do not.
    """
    links = pages.select("page_id", F.posexplode(_values(H.html_nodes(F.col("html")), tag, attribute)).alias("pos", "url"))
    return links.filter(T.keep_url(F.col("url"), includes, excludes))


def _values(nodes: Column, tag: str, attribute: str) -> Column:
    """Distinct values of an attribute in page order."""
    values = F.transform(F.filter(nodes, lambda n: n["tag"] == tag), lambda n: F.try_element_at(n["attrs"], F.lit(attribute)))
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull()))


def extract_image_urls(
    pages: DataFrame, attr_priority: list[str], card_class: str | None = None,
    includes: list[str] = (), excludes: list[str] = (),
) -> DataFrame:
    """Distinct absolute image addresses per page (page_id, url), inside cards of a class when one is given."""
    nodes = pages.select("page_id", F.col("url").alias("base"), H.placed(H.html_nodes(F.col("html"))).alias("nodes"))
    n = F.col("nodes")
    scope = n
    if card_class:
        scope = F.flatten(F.transform(H.where(n, cls=[card_class.lower()]), lambda c: H.below(n, c)))
    urls = F.transform(
        H.where(scope, "img", "image-element"), lambda x: T.image_url(x["attrs"], list(attr_priority), F.col("base"))
    )
    found = nodes.select("page_id", F.explode(F.array_distinct(urls)).alias("url")).filter("url IS NOT NULL")
    return found.filter(T.keep_url(F.col("url"), includes, excludes))


def with_next_marker(pages: DataFrame, out: str = "has_next", links: str | None = None) -> DataFrame:
    """Whether a page (html) leads on: a link or button that says next or load more, by its text, class or label, and
    is not disabled. Feeds ``has_next`` of :func:`page_flow`. ``links`` names a column for the page's distinct link
    addresses, read off the same parse."""
    nodes = F.col("_nodes")

    def leads_on(c: Column) -> Column:
        css = F.coalesce(c["low"], F.lit(""))
        label = F.lower(F.coalesce(H.attr(c, "aria-label"), F.lit("")))
        said = F.rlike(H.text_of(H.below(nodes, c), " "), F.lit("(?i)load more|next|→"))
        return (said | F.contains(css, F.lit("next")) | F.contains(label, F.lit("next page"))) & ~F.contains(css, F.lit("disabled"))

    parsed = pages.withColumn("_nodes", H.placed(H.html_nodes(F.col("html"))))
    found = F.exists(H.where(nodes, "a", "button"), leads_on)
    made = {out: F.coalesce(found, F.lit(False))} | ({links: _values(nodes, "a", "href")} if links else {})
    return parsed.withColumns(made).drop("_nodes")


def page_flow(
    links: DataFrame, idle: int = 3, max_pages: int | None = None, hot_rows: int = HOT_ROWS, split: bool | None = None
) -> DataFrame:
    """How a crawl of each site goes on: links per page, new ones, running total, and where it stops.

    ``links`` is (site, page_no, url, has_next); pages without links come with url = null. Pages after the stop are
    left out. ``max_pages`` stops a site there; by default it is followed to its end, and running values of sites
    with over ``hot_rows`` pages are split over the cluster.
    """
    within = links if max_pages is None else links.filter(F.col("page_no") <= max_pages)
    first_seen = (
        within.filter("url IS NOT NULL").groupBy("site", "url").agg(F.min("page_no").alias("page_no"))
        .groupBy("site", "page_no").agg(F.count(F.lit(1)).alias("n_new"))
    )
    per_page = (
        within.groupBy("site", "page_no")
        .agg(F.countDistinct("url").alias("n"), F.max("has_next").alias("has_next"))
        .join(first_seen, ["site", "page_no"], "left")
        .withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    )
    run = Ordered(per_page, ["site"], ["page_no"], hot_rows, split).rank("_no").running(
        total=("sum", F.col("n_new")), _last_new=("max", F.when(F.col("n_new") > 0, F.col("_no")))
    )
    rows = run.done()
    quiet = F.col("_no") - F.coalesce("_last_new", F.lit(0)) >= idle
    stop = F.when(quiet, "no growth").when(~F.col("has_next"), "last page")
    if max_pages is not None:
        stop = stop.when(F.col("page_no") >= max_pages, "page limit")
    rows = rows.withColumn("stop", stop)
    ends = rows.filter("stop IS NOT NULL").groupBy("site").agg(F.min("page_no").alias("_end"))
    return (
        rows.join(ends, "site", "left")
        .filter(F.col("_end").isNull() | (F.col("page_no") <= F.col("_end")))
        .select("site", "page_no", "n", "n_new", "total", "stop")
    )
