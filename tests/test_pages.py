"""Planted pages, one per fallback."""

import pytest
from pyspark.sql import functions as F

from hemline.functions import html as H
from hemline.operators import pages

FULL = """<h1>12 OOH Media Found</h1><div class="item-wrap a"><div class="labels"><a class="hz-label">New</a><a class="hz-label">New</a></div>
<div class="listing-thumb"><a><img src="s.jpg" data-src="d.jpg"></a></div><h2 class="item-title"><a href=" /d/1 ">One &amp; <b>Only</b></a></h2>
<span class="price">Rs 500</span><address class="item-address"><i>x</i><span> Lahore </span></address>
<li class="h-size">Size: <span class="hz-figure">60x30</span></li><li class="h-vc">Zone: <span class="hz-figure">KEQWX , 6O0FH</span></li></div>
<div class="item-wrap b"><h3><a href="/d/1">Again</a></h3></div>"""
BARE = """<article><h2>Plain title</h2><p>Costs Rs 1,200/month, 20 x 10 feet, code AB12C and AB12C</p><div style="Background-Image: url('bg.png')"></div></article>
<article><p>no title here</p></article><article><h3> </h3></article>"""
LISTED = """<article class="x Property-Item"><h2>Listed</h2><li class="item-price">Rs <b>9</b></li><div class="listing-location">Multan</div>
<span class="label-color-1">Hot</span><img src="data:image/png;x"></article><article><h2>Other</h2></article>"""


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(1, "u", FULL), (2, "u", BARE), (3, "u", LISTED), (4, "u", "<p>none</p>"), (5, "u", None)], "page_id int, url string, html string")
    return {(r.page_id, r.pos): r for r in pages.extract_listings(df, "site").collect()}


def test_full_card_and_repeat(found):
    r = found[1, 1]
    assert (r.title, r.detail_url, r.price, r.city) == ("One &Only", "/d/1", "Rs 500", "Lahore")
    assert (r.labels, r.dimensions, r.zone, r.codes) == (["New"], "60x30", "KEQWX , 6O0FH", ["6O0FH", "KEQWX"])
    assert (r.image_url, r.total_found, r.source) == ("d.jpg", 12, "site")
    assert (1, 2) not in found


def test_bare_article(found):
    r = found[2, 1]
    assert (r.title, r.detail_url, r.price, r.dimensions) == ("Plain title", None, "Rs 1,200/month", "20 x 10")
    assert (r.codes, r.image_url, r.city, r.labels) == (["AB12C"], "bg.png", None, [])
    assert (2, 2) not in found


def test_listing_class_article(found):
    r = found[3, 1]
    assert (r.title, r.price, r.city, r.labels, r.image_url) == ("Listed", "Rs 9", "Multan", ["Hot"], None)
    assert set(found) == {(1, 1), (2, 1), (3, 1)}


def test_dedupe_over_all_pages(spark):
    df = spark.createDataFrame([(1, "u", FULL), (2, "u", FULL)], "page_id int, url string, html string")
    assert pages.extract_listings(df).count() == 2
    assert [r.page_id for r in pages.extract_listings(df, dedupe="all").collect()] == [1]


DETAIL = """<div class="page-title me"><h1>Board</h1></div><img class="houzez-gallery-img" data-lazy="a.jpg" src="l.svg"><img class="houzez-gallery-img" src="a.jpg">
<img class="houzez-gallery-img" src="x.svg"><div class="property-description-wrap"><div class="description-content"><p>One<br>two</p><script>no()</script></div></div>
<div class="property-detail-wrap"><li><strong>Size:</strong><span>6x3</span></li><li><strong>Date</strong><span>PLACEHOLDER<a>log in</a></span></li>
<li><strong>Empty</strong><span></span></li><li><strong>Token</strong><span>PLACEHOLDER</span></li><li><strong>Size</strong><span>7x3</span></li></div>
<div class="property-address-wrap"><li><strong>City:</strong><span>Lahore</span></li><a class="hz-btn-map" href="http://m"></a>
<div data-map='{"latitude": "31.5", "longitude": 74.3, "pricePin": ""}'></div></div><li class="item-price"><span class="price">Rs 7</span></li>"""


def test_details(spark):
    bad = '<h1>Only</h1><div class="property-address-wrap"><div data-map="{bad"></div></div><span class="price">Rs 1</span>'
    df = spark.createDataFrame([(1, "u", DETAIL), (2, "v", bad)], "page_id int, url string, html string")
    a, b = pages.extract_details(df).orderBy("page_id").collect()
    assert (a.title, a.images, a.description) == ("Board", ["a.jpg"], "One\ntwo")
    assert a.details == {"Size": "7x3", "Date": "log in"} and a.address == {"City": "Lahore"}
    assert (a.lat, a.lon, a.price, a.map_url) == (31.5, 74.3, "Rs 7", "http://m")
    assert (b.title, b.images, b.description, b.details, b.lat, b.price) == ("Only", [], "", {}, None, "Rs 1")


def test_links_and_image_urls(spark, rows):
    html = '<a href="/a">1</a><A class="x" href="/b"></a><a href="/a"></a><div class="card"><img srcset="s.jpg 1x, /l.jpg 2x"><img src="logo.png"></div><img src="/out.jpg">'
    df = spark.createDataFrame([(1, "http://h.com/x/", html)], "page_id int, url string, html string")
    assert rows(pages.extract_links(df), "pos", "url") == [(0, "/a"), (1, "/b")]
    inside = pages.extract_image_urls(df, ["srcset", "src"], "card", excludes=["logo"])
    assert rows(inside, "url") == [("http://h.com/l.jpg",)]
    assert rows(pages.extract_image_urls(df, ["src"], includes=["out"]), "url") == [("http://h.com/out.jpg",)]


def test_page_flow_stops(spark, rows):
    seen = {1: "ab", 2: "bc", 3: "a", 4: "b", 5: "c", 6: "d"}
    data = [("s", p, u, True) for p, us in seen.items() for u in us] + [("t", 1, "a", True), ("t", 2, None, False), ("t", 3, "z", True)]
    flow = pages.page_flow(spark.createDataFrame(data, "site string, page_no int, url string, has_next boolean"))
    assert rows(flow) == [
        ("s", 1, 2, 2, 2, None), ("s", 2, 2, 1, 3, None), ("s", 3, 1, 0, 3, None), ("s", 4, 1, 0, 3, None),
        ("s", 5, 1, 0, 3, "no growth"), ("t", 1, 1, 1, 1, None), ("t", 2, 0, 0, 1, "last page"),
    ]


def test_nodes_close_like_browsers_do_not(spark):
    df = spark.createDataFrame([("<div><p>a<br>b</div>c</x><script>d</script>",)], "html string")
    nodes = df.select(H.html_nodes(F.col("html")).alias("n")).first().n
    assert [(n.tag, n.text, n.last) for n in nodes] == [
        ("div", None, 4), ("p", None, 4), ("#text", "a", 2), ("br", None, 3), ("#text", "b", 4), ("#text", "c", 5), ("script", None, 6),
    ]


def test_a_search_without_a_city_asks_for_one(spark):
    from hemline.operators.listings import NO_CITY
    from hemline.plans.listing_search import listing_reports

    html = '<p>7 OOH Media Found</p><div class="item-wrap"><h2 class="item-title"><a href="/d/1">One</a></h2></div>'
    pages_ = spark.createDataFrame([(1, q, 1, "http://h/x", html) for q in ("a",)] + [(2, "b", 1, "http://h/y", html)], "page_id int, query string, page_no int, url string, html string")
    asked = spark.createDataFrame([("a", "Lahore", "billboard"), ("b", "your city", "billboard"), ("c", None, "billboard")], "query string, city string, ad_type string")
    none = spark.createDataFrame([], "page_id int, url string, html string")
    got = {r["query"]: r["report"] for r in listing_reports(asked, pages_, none, "https://l.example.com/").collect()}
    assert "Lahore" in got["a"] and "[One](/d/1)" in got["a"] and got["b"] == got["c"] == NO_CITY


def test_pages_are_parsed_in_slices(spark):
    import pyarrow as pa

    from hemline.functions import html as H

    texts = [f"<p class=c{i}>{'x' * (i % 7)}<b>y</b></p>" if i % 5 else [None, ""][i % 2] for i in range(200)]
    whole = list(H.node_slices(pa.array(texts, pa.string()), 1 << 30))
    parts = list(H.node_slices(pa.array(texts, pa.string()), 100))
    assert len(whole) == 1 and len(parts) > 20 and max(len(p) for p in parts) < 20
    assert pa.concat_arrays(parts).to_pylist() == whole[0].to_pylist() and len(whole[0]) == 200
    assert [len(p) for p in H.node_slices(pa.array([], pa.string()))] == [0]
    # Spark puts slices of any length beside the rows they come from
    rows = spark.range(400).selectExpr("id", "concat('<i>', id, repeat('z', 20000), '</i>') AS html").coalesce(1)
    got = rows.select("id", H.html_nodes(F.col("html"))[1]["text"].alias("t")).collect()
    assert len(got) == 400 and all(r["t"] == f"{r['id']}" + "z" * 20000 for r in got)
