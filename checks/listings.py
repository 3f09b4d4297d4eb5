"""Pages and parts as listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import choose, query, spread_table, table
from hemline.functions import text as T
from hemline.operators import listings, pages
from hemline.operators.joins import dedupe_ordered

HREF = "'<a [^>]*href=\"([^\"]*)\"'"
_LINKS = f"l AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, {HREF}, 1)) AS url, generate_subscripts(regexp_extract_all(html, {HREF}, 1), 1) AS i FROM pages)"


def _pages(spark, sf):
    return spread_table(spark, sf, "pages", "page_id")


@query("src_08_read_pages", "SELECT page_id, url, length(html) AS n FROM pages")
def _(spark, sf):
    from hemline.sources.chats import read_pages

    return read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("n"))


@query(
    "ext_01_extract_listings",
    "WITH h AS (SELECT page_id, url, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS t FROM pages) "
    "SELECT page_id, 1 AS pos, trim(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')) AS title, '/item/' || page_id AS detail_url FROM h WHERE trim(t) <> ''",
)
def _(spark, sf):
    # the page's own article is a card once its heading is a linked h2
    linked = F.replace(
        F.replace(F.col("html"), F.lit("<h1>"), F.concat(F.lit('<h2><a href="/item/'), F.col("page_id").cast("string"), F.lit('">'))),
        F.lit("</h1>"), F.lit("</a></h2>"),
    )
    found = pages.extract_listings(_pages(spark, sf).select("page_id", "url", linked.alias("html")), "listings")
    return found.select("page_id", "pos", "title", "detail_url")


def planted_cards(spark, sf):
    """Result pages rendered from parts: one page per brand and twenty parts, every second card shown twice."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    card = F.format_string(
        '<div class="item-wrap x"><h2 class="item-title"><a href="/d/%d">%s &amp; co %d</a></h2>'
        '<ul><li class="item-price"><span class="price">Rs %d</span></li></ul>'
        '<address class="item-address"><i></i><span>%s</span></address>'
        '<a class="hz-label label">New</a><a class="hz-label">Hot %d</a><a class="hz-label">New</a>'
        '<li class="h-size">Size: <span class="hz-figure">%dx%d</span></li>'
        '<li class="h-vc">Zone: <span class="hz-figure">AB%d , ZZ9AA</span></li>'
        '<div class="listing-thumb"><img src="data:image/gif" data-src="/i/%d.jpg"></div></div>',
        k, "p_name", k, k % 900, "p_brand", k % 3, k % 60, k % 30, k % 90 + 100, k,
    )
    twice = F.when(k % 2 == 0, F.concat(card, card)).otherwise(card)
    return (
        p.groupBy(F.floor(k / 20).alias("page_id"))
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct(k.alias("k"), twice.alias("c"))))["c"], "\n").alias("cards"))
        .select(
            "page_id", F.concat(F.lit("http://x.example.com/p"), F.col("page_id").cast("string")).alias("url"),
            F.concat(F.lit("<html><body><h4>"), (F.col("page_id") + 40).cast("string"), F.lit(" OOH Media Found</h4>"), "cards", F.lit("</body></html>")).alias("html"),
        )
    )


@query(
    "ext_01_cards_of_planted_pages",
    "SELECT p_partkey // 20 AS page_id, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS pos, p_name || ' & co ' || p_partkey AS title, '/d/' || p_partkey AS detail_url, 'Rs ' || (p_partkey % 900) AS price, p_brand AS city, "
    "'New|Hot ' || (p_partkey % 3) AS labels, (p_partkey % 60) || 'x' || (p_partkey % 30) AS dimensions, 'AB' || (p_partkey % 90 + 100) || ' , ZZ9AA' AS zone, 'AB' || (p_partkey % 90 + 100) || '|ZZ9AA' AS codes, '/i/' || p_partkey || '.jpg' AS image_url, p_partkey // 20 + 40 AS total_found FROM part",
)
def _(spark, sf):
    found = pages.extract_listings(planted_cards(spark, sf).repartition(spark.sparkContext.defaultParallelism))
    return found.select(
        "page_id", "pos", "title", "detail_url", "price", "city", F.array_join("labels", "|").alias("labels"), "dimensions", "zone",
        F.array_join("codes", "|").alias("codes"), "image_url", "total_found",
    )


@query(
    "ext_02_extract_details",
    "SELECT page_id, url AS detail_url, trim(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')) AS title, 0::bigint AS n_images, 'F1=page ' || page_id || '|Contact=c' AS details, (page_id % 40)::double AS lat, 'Rs 5' AS price, 'line one' || chr(10) || 'line two' AS description FROM pages",
)
def _(spark, sf):
    extra = F.format_string(
        '<div class="property-description-wrap"><div class="description-content"><p>line one<br>line two</p></div></div>'
        '<div class="property-detail-wrap"><ul><li><strong>F1:</strong><span>page %d</span></li><li><strong>Contact</strong><span>c</span></li>'
        '<li><strong>Date</strong><span>PLACEHOLDER</span></li></ul></div><div class="property-address-wrap"><ul><li><strong>City:</strong><span>x</span></li></ul>'
        "<div data-map='{\"latitude\": \"%d\", \"longitude\": 70.5, \"pricePin\": \"Rs 5\"}'></div></div>",
        F.col("page_id"), F.col("page_id") % 40,
    )
    html = F.replace(F.col("html"), F.lit("<article>"), F.concat(extra, F.lit("<article>")))
    d = pages.extract_details(_pages(spark, sf).select("page_id", "url", html.alias("html")))
    pairs = F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return d.select(
        "page_id", "detail_url", "title", F.size("images").cast("bigint").alias("n_images"), F.array_join(pairs, "|").alias("details"),
        "lat", "price", "description",
    )


@query(
    "ext_03_extract_links",
    f"WITH {_LINKS} SELECT DISTINCT page_id, url FROM l WHERE (contains(url, 'a') OR contains(url, 'e')) AND NOT contains(url, 'th')",
)
def _(spark, sf):
    return pages.extract_links(_pages(spark, sf), includes=["a", "e"], excludes=["th"]).select("page_id", "url")


@query(
    "ext_03_links_of_planted_pages",
    f"WITH {_LINKS} SELECT page_id, unnest(['/y?a=1&b=' || page_id, '/q' || page_id, '/u' || page_id]) AS url FROM pages UNION SELECT page_id, url FROM l",
)
def _(spark, sf):
    k = F.col("page_id").cast("string")
    planted = F.concat(
        F.lit('<p><a href="/y?a=1&amp;b='), k, F.lit('">x</a><!-- <a href="/hidden">n</a> --><a class=c href=\'/q'), k,
        F.lit("'>y</a><A HREF=/u"), k, F.lit('>z</A><a name="no address">w</a></p>'), "html",
    )
    return pages.extract_links(_pages(spark, sf).select("page_id", planted.alias("html"))).select("page_id", "url")


@query(
    "ext_03_image_urls",
    "SELECT page_id, unnest(['http://h.example.com/i/' || page_id || '.jpg', 'http://h.example.com/big' || page_id || '.png', 'https://cdn.example.com/e' || page_id || '.webp']) AS url FROM pages",
)
def _(spark, sf):
    k = F.col("page_id").cast("string")
    cards = F.concat(
        F.lit('<div class="Card"><img src="/i/'), k, F.lit('.jpg"><img data-src="/small.png" srcset="/a.png 1x, /big'), k,
        F.lit('.png 2x"></div><div class="card"><image-element src="//cdn.example.com/e'), k,
        F.lit('.webp"></image-element><img src="/logo.png"></div><img src="/outside.png">'),
    )
    df = _pages(spark, sf).select("page_id", F.lit("http://h.example.com/x/").alias("url"), F.concat(cards, "html").alias("html"))
    found = pages.extract_image_urls(df, ["srcset", "data-src"], "card", excludes=["logo"])
    return found.select("page_id", F.regexp_replace("url", "^https?://cdn", "https://cdn").alias("url"))


@query(
    "txt_32_filter_urls", f"WITH {_LINKS} SELECT page_id, url FROM l WHERE NOT contains(url, ',') AND NOT contains(url, '.')"
)
def _(spark, sf):
    links = _pages(spark, sf).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)).alias("url"))
    return links.filter(T.keep_url(F.col("url"), [], [",", "."]))


@query("set_04_distinct_urls", f"WITH {_LINKS} SELECT DISTINCT url FROM l")
def _(spark, sf):
    return pages.extract_links(_pages(spark, sf)).select("url").distinct()


@query(
    "set_03_dedupe_ordered", f"WITH {_LINKS} SELECT url, min(page_id) AS page_id FROM l GROUP BY url",
)
def _(spark, sf):
    links = pages.extract_links(_pages(spark, sf))
    return dedupe_ordered(links, ["url"], ["page_id", "pos"]).select("url", "page_id")


@query(
    "txt_31_pick_image_urls",
    "WITH p AS (SELECT page_id, url AS b, page_id % 6 AS k, regexp_extract(url, '^[a-z]+://[^/?#]*') AS h, string_split(string_split(url, '#')[1], '?')[1] AS q FROM pages) SELECT page_id, CASE k WHEN 0 THEN h || '/bg/' || page_id || '.jpg' "
    "WHEN 1 THEN 'https://cdn.example.com/l.jpg' WHEN 2 THEN regexp_replace(q, '[^/]*$', '') || 'rel.png?x=1' WHEN 3 THEN string_split(b, ':')[1] || '://other.example.com/s.jpg' "
    "WHEN 4 THEN regexp_replace(regexp_replace(q, '[^/]*$', ''), '[^/]*/$', '') || 'up.png' END AS image FROM p",
)
def _(spark, sf):
    k = F.col("page_id") % 6
    none = F.lit(None).cast("string")
    attrs = F.create_map(
        F.lit("style"), F.when(k == 0, F.concat(F.lit("color:red;background-image: url('/bg/"), F.col("page_id").cast("string"), F.lit(".jpg')"))).otherwise(none),
        F.lit("srcset"), F.when(k == 1, "a.jpg 1x, https://cdn.example.com/l.jpg 2x,").otherwise(none),
        F.lit("data-src"), F.when(k == 2, "rel.png?x=1").when(k == 3, "").otherwise(none),
        F.lit("src"), F.when(k == 3, "//other.example.com/s.jpg").when(k == 4, "../up.png").otherwise(none),
    )
    picked = T.image_url(attrs, ["data-src", "data-srcset", "srcset", "src"], F.col("url"))
    return _pages(spark, sf).select("page_id", picked.alias("image"))


# the third and the fifth do not lead on
_MARKERS = [
    '<a href="?p=2">Load <b>more</b> results</a><a href="#">Load More</a>', '<a class="pg-Next" href="?p=3">2</a>', '<button class="next disabled">Next</button>',
    '<button aria-label="Next page">2</button>', "<p>next</p>", '<a href="?p=9">→</a>',
]


@query("ext_04_next_marker", "SELECT page_id, page_id % 6 NOT IN (2, 4) AS has_next FROM pages")
def _(spark, sf):
    planted = F.concat(choose(F.col("page_id"), _MARKERS), "html")
    return pages.with_next_marker(_pages(spark, sf).select("page_id", planted.alias("html"))).select("page_id", "has_next")


FLOW = (
    f"WITH {_LINKS}, st AS (SELECT page_id, page_id % 11 <> 0 AS has_next, CASE WHEN page_id % 3 = 0 THEN 'one large site' ELSE regexp_extract(url, '//([^/]+)/', 1) || page_id % 5 END AS site FROM pages), pg AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id % 11 = 0, page_id) AS page_no FROM st), "
    "u AS (SELECT DISTINCT site, page_no, CASE WHEN page_id % 2 = 0 THEN l.url ELSE left(md5(l.url), 2) END AS url FROM pg JOIN l USING (page_id)), f AS (SELECT site, url, min(page_no) AS page_no FROM u GROUP BY ALL), n AS (SELECT site, page_no, count(*) AS n_new FROM f GROUP BY ALL), "
    "m AS (SELECT site, page_no, any_value(has_next) AS has_next, count(DISTINCT u.url) AS n FROM pg LEFT JOIN u USING (site, page_no) GROUP BY ALL), j AS (SELECT site, page_no, n, has_next, coalesce(n_new, 0) AS n_new, sum(coalesce(n_new, 0)) OVER w AS total, "
    "max(CASE WHEN n_new > 0 THEN page_no END) OVER w AS lastnew FROM m LEFT JOIN n USING (site, page_no) WINDOW w AS (PARTITION BY site ORDER BY page_no)), "
    "s AS (SELECT *, CASE WHEN page_no - coalesce(lastnew, 0) >= 3 THEN 'no growth' WHEN NOT has_next THEN 'last page' END AS stop FROM j) "
    "SELECT site, page_no, n, n_new, total::bigint AS total, stop FROM s QUALIFY count(stop) OVER (PARTITION BY site ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0"
)


def numbered_pages(spark, sf):
    """Pages (site, page_no, page_id, html) numbered inside their site, with a planted marker that leads on or does not."""
    from hemline.operators.scale import ranked

    k = F.col("page_id")
    site = F.when(k % 3 == 0, "one large site").otherwise(F.concat(F.regexp_extract("url", "//([^/]+)/", 1), (k % 5).cast("string")))
    leads, ends = ["<button aria-label='Next page'>2</button>", "<button class=nav-next>&gt;</button>"], [_MARKERS[2], _MARKERS[4]]
    marker = F.when(k % 11 == 0, choose(k, ends)).otherwise(choose(k, leads))
    p = _pages(spark, sf).select("page_id", site.alias("site"), F.concat(marker, "html").alias("html"), (k % 11 == 0).alias("_last"))
    return ranked(p, ["site"], ["_last", "page_id"], "page_no").select("site", "page_no", "page_id", "html")


def links_of(numbered):
    """(site, page_no, url, has_next) as the pages say; every other page repeats few addresses."""
    marked = pages.with_next_marker(numbered, links="links")
    short = F.transform("links", lambda u: F.left(F.md5(u.cast("binary")), F.lit(2)))
    urls = F.when(F.col("page_id") % 2 == 0, F.col("links")).otherwise(short)
    return marked.select("site", "page_no", F.explode_outer(urls).alias("url"), "has_next")


@query("ext_04_page_flow", FLOW)
def _(spark, sf):
    return pages.page_flow(links_of(numbered_pages(spark, sf)))


# --- parts as listings ------------------------------------------------------------------------------------

def _parts(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("query"), "p_partkey", F.col("p_name").alias("title"), "p_retailprice",
        F.concat(F.lit("/d/"), k.cast("string")).alias("detail_url"), F.concat(F.lit("Rs "), F.col("p_size").cast("string")).alias("price"),
        F.lit("town").alias("city"), F.when(k % 2 == 0, F.array(F.lit("New"), F.lit("Hot"))).otherwise(F.array().cast("array<string>")).alias("labels"),
        F.when(k % 3 == 0, "6x3").alias("dimensions"), F.lit(None).cast("string").alias("contact"),
        F.when(k % 5 == 0, "http://i/1.png").alias("image_url"), (k % 50).alias("s_suppkey"),
    )


def _order():
    return [F.desc("p_retailprice"), F.asc("p_partkey")]


_TOP = "SELECT p_brand AS query, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 5"


@query("win_01_top_n", _TOP)
def _(spark, sf):
    return listings.top_n(_parts(spark, sf), ["query"], _order(), 5).select("query", "p_partkey", "rank")


@query(
    "join_07_enrich_top",
    f"WITH top AS ({_TOP}) SELECT p.p_partkey, CASE WHEN rank <= 3 THEN s_name END AS contact FROM part p LEFT JOIN top USING (p_partkey) LEFT JOIN supplier ON s_suppkey = p_partkey % 50",
)
def _(spark, sf):
    details = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("contact"))
    parts = _parts(spark, sf).drop("contact")
    return listings.enrich_top(parts, details, ["query"], _order(), 3, "p_partkey", "s_suppkey", "contact").select("p_partkey", "contact")


@query(
    "agg_19_listing_summary",
    "WITH s AS (SELECT p_brand AS query, count(*) AS n, max(CASE WHEN p_partkey % 2 = 0 THEN p_partkey END) AS total_found, least(count(*), 5) AS shown FROM part GROUP BY 1) SELECT *, CASE WHEN total_found > shown THEN total_found - shown ELSE n - shown END AS remaining FROM s",
)
def _(spark, sf):
    parts = _parts(spark, sf).withColumn("total", F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")))
    return listings.listing_summary(parts, ["query"], 5, "total")


@query(
    "txt_28_render_listing_report",
    f"WITH top AS ({_TOP}), c AS (SELECT p_brand AS query, count(*) AS n FROM part GROUP BY 1), b AS (SELECT t.query, string_agg(chr(10) || '### ' || rank || '. [' || p_name || '](/d/' || p.p_partkey || ')' || CASE WHEN p.p_partkey % 2 = 0 THEN chr(10) || 'New | Hot' ELSE '' END "
    "|| chr(10) || '- **Location:** town' || chr(10) || '- **Price:** Rs ' || p_size || CASE WHEN p.p_partkey % 3 = 0 THEN chr(10) || '- **Size:** 6x3 ft' ELSE '' END || CASE WHEN p.p_partkey % 5 = 0 THEN chr(10) || chr(10) || '![' || p_name || '](http://i/1.png)' ELSE '' END "
    "|| chr(10) || '- [View Details](/d/' || p.p_partkey || ')', chr(10) ORDER BY rank) AS body FROM top t JOIN part p USING (p_partkey) GROUP BY t.query) "
    "SELECT query, '## Billboard Listings in Dera Town (Wall Panels)' || chr(10) || '**12345 total listings found** on the site' || chr(10) || '*First ' || least(n, 5) || ' shown | [All results](u)*' || chr(10) || chr(10) || body || chr(10) || chr(10) || '---' || chr(10) "
    "|| '### ' || format('{:,}', 12345 - least(n, 5)) || ' further listings' || chr(10) || '**[See every listing in Dera Town](u)**' AS report FROM c JOIN b USING (query)",
)
def _(spark, sf):
    parts = _parts(spark, sf)
    asked = parts.select("query").distinct().select(
        "query", F.lit("dera-town").alias("city"), F.lit("wall-panels").alias("ad_type"), F.lit(12345).cast("bigint").alias("total_found"), F.lit("u").alias("search_url")
    )
    return listings.render_listing_report(parts, asked, _order(), 5)


@query(
    "txt_28_render_details",
    "SELECT p_partkey AS page_id, '## ' || p_name || chr(10) || '*Source: /d/' || p_partkey || '*' || chr(10) || chr(10) || '**Price:** Rs ' || p_size || chr(10) || chr(10) || '### Details' || chr(10) || '- **Size:** ' || p_size || chr(10) || '- **Contact:** c' || chr(10) || '- **Brand:** ' || p_brand || chr(10) "
    "|| '- **Coordinates:** 1.5, 2.5' || chr(10) || chr(10) || '### Images (1)' || chr(10) || '1. x.png' AS report FROM part",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    none = F.lit(None).cast("string")
    d = p.select(
        F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), F.concat(F.lit("/d/"), F.col("p_partkey").cast("string")).alias("detail_url"),
        F.concat(F.lit("Rs "), F.col("p_size").cast("string")).alias("price"),
        F.create_map(F.lit("Brand"), "p_brand", F.lit("Contact"), F.lit("c"), F.lit("Size"), F.col("p_size").cast("string")).alias("details"),
        F.create_map().cast("map<string,string>").alias("address"), none.alias("map_url"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"),
        F.lit("").alias("description"), F.array(F.lit("x.png")).alias("images"),
    )
    return listings.render_details(d)


_REPORT = "p_partkey // 20 AS query, p_partkey, p_name, p_brand, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_partkey // 20) AS n"


@query(
    "listing_search_reports",
    f"WITH p AS (SELECT {_REPORT} FROM part), b AS (SELECT query, any_value(n) AS n, string_agg(chr(10) || '### ' || r || '. [' || p_name || ' & co ' || p_partkey || '](/d/' || p_partkey || ')' || chr(10) || 'New | Hot ' || (p_partkey % 3) || chr(10) || '- **Location:** ' || p_brand || chr(10) "
    "|| '- **Price:** Rs ' || (p_partkey % 900) || chr(10) || '- **Size:** ' || (p_partkey % 60) || 'x' || (p_partkey % 30) || ' ft' || CASE WHEN r <= 3 AND p_partkey % 2 = 0 THEN chr(10) || '- **Contact:** c' || p_partkey ELSE '' END || chr(10) || chr(10) || '![' || p_name || ' & co ' || p_partkey || '](/i/' || p_partkey || '.jpg)' "
    "|| chr(10) || '- [View Details](/d/' || p_partkey || ')', chr(10) ORDER BY r) AS body FROM p WHERE r <= 5 GROUP BY query), u AS (SELECT *, 'http://s.example.com/?type%5B%5D=smd&type%5B%5D=digital&location%5B%5D=wah-cantt' AS url, query + 40 AS total FROM b) "
    "SELECT query, '## Billboard Listings in Wah Cantt (Smd, Digital)' || chr(10) || '**' || total || ' total listings found** on the site' || chr(10) || '*First ' || least(n, 5) || ' shown | [All results](' || url || ')*' || chr(10) || chr(10) || body || chr(10) || chr(10) || '---' || chr(10) || '### ' || "
    "format('{:,}', total - least(n, 5)) || ' further listings' || chr(10) || '**[See every listing in Wah Cantt](' || url || ')**' AS report FROM u",
)
def _(spark, sf):
    from hemline.plans.listing_search import listing_reports

    found = planted_cards(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    result_pages = found.select("page_id", F.col("page_id").alias("query"), F.lit(1).alias("page_no"), "url", "html")
    k = F.col("p_partkey")
    contact = F.format_string(
        '<div class="property-detail-wrap"><ul><li><strong>Contact:</strong><span>c%d</span></li></ul></div>', k
    )
    details = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(
        k.alias("page_id"), F.concat(F.lit("/d/"), k.cast("string")).alias("url"), contact.alias("html")
    )
    requests = result_pages.select("query", F.lit(" WAH Cantt").alias("city"), F.lit("smd,led").alias("ad_type"))
    return listing_reports(requests, result_pages, details, "http://s.example.com/")
