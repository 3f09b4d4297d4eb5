"""Text rules over documents, conversations, parts, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import (
    WORD, WS, choose, documents, md5_text, query, quote, sql_choose, sql_squeeze, sql_strip, sql_values, spread_table,
    table,
)
from hemline.functions import fixed, geo
from hemline.functions import text as T
from hemline.operators import places
from hemline.operators.listings import resolve_city
from hemline.operators.replies import parse_tool_calls, tool_defaults
from hemline.operators.title_index import TitleIndex, search_all
from hemline.session import shared_path

B, A = rf"(^|[^{WORD}])", rf"($|[^{WORD}])"


def _docs(spark, sf):
    return spread_table(spark, sf, "documents", "doc_id").select("doc_id", "text")


# --- captions ---------------------------------------------------------------------------------------------

_CLEAN = sql_squeeze(rf"regexp_replace(text, '[^{WORD}{WS}.,!?''()-]', '', 'g')")


@query(
    "txt_01_clean_captions",
    f"WITH k AS (SELECT doc_id, {_CLEAN} AS c FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN ' (é)# ' ELSE text END AS text "
    "FROM documents)), f AS (SELECT doc_id, CASE WHEN length(c) < 5 THEN c || ' fashion clothing' ELSE c END AS c FROM k) "
    "SELECT doc_id, md5(c) AS clean, length(c) AS n FROM f",
)
def _(spark, sf):
    source = F.when(F.col("doc_id") % 50 == 0, F.lit(" (é)# ")).otherwise(F.col("text"))
    clean = _docs(spark, sf).select("doc_id", T.clean_caption(source).alias("c"))
    return clean.select("doc_id", md5_text("c").alias("clean"), F.length("c").cast("bigint").alias("n"))


_HEADS = [
    *[p + " " for p in fixed.CAPTION_PREAMBLES], "The model is wearing", "The person is wearing", "The man is wearing",
    "The woman is wearing", "CAPTION: the model is wearing ", "",
]


def _sanitized_sql() -> str:
    cases = " ".join(
        f"WHEN starts_with(lower(f), {quote(p.lower())}) THEN "
        + ("'A ' || " if p in fixed.PREAMBLES_WITH_ARTICLE else "")
        + sql_strip(f"substr(f, {len(p) + 1})")
        for p in fixed.CAPTION_PREAMBLES
    )
    return (
        f"WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'Winter_Men' ELSE 'Winter_Women' END AS cat, "
        f"{sql_strip('replace(' + sql_choose('conv_id + turn', _HEADS) + ' || text, chr(10), chr(32))')} AS f FROM conversations), "
        f"b AS (SELECT *, CASE {cases} ELSE f END AS t FROM c), r AS (SELECT *, CASE "
        "WHEN regexp_matches(t, '^The (model|person) is wearing') THEN (CASE WHEN cat LIKE '%Men' AND cat NOT LIKE '%Women' THEN 'A man' ELSE 'A woman' END) "
        "|| ' wearing' || regexp_replace(t, '^The (model|person) is wearing', '') "
        "WHEN starts_with(t, 'The man is wearing') THEN 'A man wearing' || substr(t, 19) "
        "WHEN starts_with(t, 'The woman is wearing') THEN 'A woman wearing' || substr(t, 21) ELSE t END AS u FROM b) "
        f"SELECT conv_id, turn, left({sql_squeeze('u')}, 40) AS start, md5({sql_squeeze('u')}) AS caption FROM r"
    )


@query("txt_02_sanitize_captions", _sanitized_sql())
def _(spark, sf):
    c = table(spark, sf, "conversations")
    cat = F.when(F.col("conv_id") % 2 == 0, "Winter_Men").otherwise("Winter_Women")
    caption = T.sanitize_caption(F.concat(choose(F.col("conv_id") + F.col("turn"), _HEADS), "text"), cat)
    return c.select("conv_id", "turn", caption.alias("c")).select(
        "conv_id", "turn", F.left("c", F.lit(40)).alias("start"), md5_text("c").alias("caption")
    )


@query(
    "txt_03_caption_format_audit",
    "WITH d AS (SELECT lang AS category, doc_id, (['A man wearing ', 'A woman wearing ', 'Someone in '])[doc_id % 3 + 1] || text AS c "
    "FROM documents) SELECT category, count(*) AS n, count(*) FILTER (c LIKE 'A man wearing%' OR c LIKE 'A woman wearing%') AS n_good, "
    "md5(min_by(c, doc_id)) AS sample FROM d GROUP BY category",
)
def _(spark, sf):
    from hemline.operators.balance import caption_format_audit

    d = documents(spark, sf)
    heads = ["A man wearing ", "A woman wearing ", "Someone in "]
    audit = caption_format_audit(d.withColumn("caption", F.concat(choose(F.col("pos"), heads), "caption")))
    return audit.withColumn("sample", md5_text("sample"))


# --- media types and cities -------------------------------------------------------------------------------

_MEDIA_WORDS = [
    " Airport ", "LED", "pole", "Pole Signs", "giant billboard", "bus stop ads", "scheduled", "mall", "xyz", "", "a",
    "Vehicle Branding", "outdoor media", "wall panel painted",
]
_ALIAS = "al(alias, slug, pos) AS (VALUES " + sql_values([(a, s, i) for i, (a, s) in enumerate(fixed.MEDIA_ALIASES)]) + ")"
_MEDIA = (
    "CASE WHEN coalesce(key, '') = '' THEN 'billboards' ELSE coalesce((SELECT min(slug) FROM al WHERE alias = key), "
    "(SELECT min_by(slug, pos) FROM al WHERE contains(key, alias) OR contains(alias, key)), 'billboards') END"
)


@query(
    "txt_04_normalize_media_type",
    f"WITH {_ALIAS}, k AS (SELECT p_partkey, {sql_strip('lower(' + sql_choose('p_partkey', _MEDIA_WORDS) + ' || CASE WHEN p_partkey % 3 = 0 THEN chr(32) || p_name ELSE repeat(chr(32), 2) END)')} AS key FROM part), "
    f"u AS (SELECT DISTINCT key FROM k), m AS (SELECT key, {_MEDIA} AS media FROM u) SELECT p_partkey, media FROM k JOIN m USING (key)",
)
def _(spark, sf):
    p = spread_table(spark, sf, "part", "p_partkey")
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.lit("  "))
    return p.select("p_partkey", T.media_type(F.concat(choose(F.col("p_partkey"), _MEDIA_WORDS), tail)).alias("media"))


@query(
    "txt_04_media_type_lists",
    f"WITH {_ALIAS}, s AS (SELECT p_partkey, " + sql_choose("p_partkey", _MEDIA_WORDS) + " || ',' || " + sql_choose("p_partkey // 5", _MEDIA_WORDS)
    + " || ', ,' || p_type AS list FROM part), w AS (SELECT p_partkey, unnest(string_split(list, ',')) AS w, generate_subscripts(string_split(list, ','), 1) AS i "
    f"FROM s), k AS (SELECT p_partkey, i, {sql_strip('lower(w)')} AS key FROM w WHERE {sql_strip('w')} <> ''), u AS (SELECT DISTINCT key FROM k), "
    f"m AS (SELECT key, {_MEDIA} AS media FROM u), f AS (SELECT p_partkey, media, min(i) AS i FROM k JOIN m USING (key) GROUP BY ALL) "
    "SELECT p_partkey, string_agg(media, ',' ORDER BY i) AS media FROM f GROUP BY p_partkey",
)
def _(spark, sf):
    p = spread_table(spark, sf, "part", "p_partkey")
    k = F.col("p_partkey")
    listing = F.concat(
        choose(k, _MEDIA_WORDS), F.lit(","), choose(F.floor(k / 5), _MEDIA_WORDS), F.lit(", ,"), "p_type"
    )
    return p.select("p_partkey", F.array_join(T.media_types(listing), ",").alias("media"))


_PLACES = [
    "Lahore ", "KARACHI", "dera ghazi khan", "Greater Islamabad Capital", "Låhöre", "Wah Cantt!", "São Paulo", "Rawalpindi Tehsil, Punjab",
    "  New   York ", "Zürich-West", "Ñandú & Co.",
]
_SLUGS = "sl(city, slug) AS (VALUES " + sql_values(list(fixed.CITY_SLUGS.items())) + ")"


def _slug_sql(source: str) -> str:
    named = " ".join(f"WHEN contains(key, '{n}') OR contains(plain, '{n}') THEN '{n}'" for n in fixed.CITIES_BY_MENTION)
    return (
        f"{_SLUGS}, k AS (SELECT *, {sql_strip('lower(name)')} AS key FROM ({source})), p AS (SELECT *, "
        f"{sql_strip('''regexp_replace(strip_accents(key), '[^\\x00-\\x7f]', '', 'g')''')} AS plain FROM k), "
        "o AS (SELECT p.*, coalesce(a.slug, b.slug, CASE " + named + " END, regexp_replace(regexp_replace(CASE WHEN plain = '' THEN key ELSE plain END, "
        "'[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM p LEFT JOIN sl a ON a.city = key LEFT JOIN sl b ON b.city = plain)"
    )


@query(
    "txt_05_normalize_city",
    "WITH " + _slug_sql(
        "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE " + sql_choose("doc_id // 2", _PLACES) + " END AS name FROM documents"
    ) + " SELECT doc_id, slug FROM o",
)
def _(spark, sf):
    d = _docs(spark, sf)
    name = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(
        choose(F.floor(F.col("doc_id") / 2), _PLACES)
    )
    return d.select("doc_id", T.city_slug(name).alias("slug"))


@query("txt_05_whole_text_slugs", "WITH " + _slug_sql("SELECT doc_id, text AS name FROM documents") + " SELECT doc_id, md5(slug) AS slug FROM o")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", md5_text(T.city_slug(F.col("text"))).alias("slug"))


@query(
    "txt_05_nation_slugs", "WITH " + _slug_sql("SELECT n_nationkey, n_name AS name FROM nation") + " SELECT n_nationkey, slug FROM o"
)
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.city_slug(F.col("n_name")).alias("slug"))


_MENTIONS = ["in Wah Cantt today", "lahore, then Karachi", "wahé is no city", "Gujratwala", "dera ismail khan", "none here", "QUETTA?"]


def _planted(words: str = "doc_id") -> str:
    return f"left(text, 300) || ' ' || {sql_choose(words, _MENTIONS)} || ' ' || substr(text, 301)"


@query(
    "txt_06_extract_city",
    "WITH t AS (SELECT doc_id, lower(" + _planted() + ") AS low FROM documents) SELECT doc_id, CASE "
    + " ".join(
        f"WHEN regexp_matches(low, '{B}{c}{A}') THEN '{c}'" for c in sorted(fixed.CITIES, key=len, reverse=True)
    )
    + " END AS city FROM t",
)
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.city_in_text(_plant(_MENTIONS)).alias("city"))


@query(
    "txt_06_places_of_table",
    "WITH t AS (SELECT doc_id, lower(" + _planted() + ") AS low, CASE WHEN doc_id % 2 = 0 AND doc_id IN (SELECT o_orderkey FROM orders) THEN 'place ' || doc_id END AS p FROM documents), c AS (SELECT doc_id, p, CASE "
    + " ".join(f"WHEN regexp_matches(low, '{B}{c}{A}') THEN '{c}'" for c in sorted(fixed.CITIES, key=len, reverse=True))
    + " END AS city FROM t), n AS (SELECT doc_id, CASE WHEN p IS NOT NULL AND length(p) > coalesce(length(city), 0) THEN p ELSE city END AS name FROM c) SELECT * FROM n WHERE name IS NOT NULL",
)
def _(spark, sf):
    """The fixed cities and a place for every order, as one table of names."""
    k = F.col("doc_id")
    said = F.concat(_plant(_MENTIONS), F.lit(" Place "), k.cast("string"), F.when(k % 2 == 0, "!").otherwise("x"))
    o = F.concat(F.lit("Place "), F.col("o_orderkey").cast("string"))
    orders = table(spark, sf, "orders").select(o.alias("name"), o.alias("place"), (F.col("o_orderkey") + 1000).alias("pos"))
    fixed_ = spark.createDataFrame([(c, c, i) for i, c in enumerate(fixed.CITIES)], "name string, place string, pos bigint")
    docs = _docs(spark, sf).select("doc_id", said.alias("said"))
    return places.find_places(docs, places.name_table(fixed_.unionByName(orders)), "doc_id", "said").select("doc_id", "name")


def _plant(options):
    return F.concat(
        F.left("text", F.lit(300)), F.lit(" "), choose(F.col("doc_id"), options), F.lit(" "), F.substr("text", F.lit(301))
    )


_ASKS = [
    "billboards near   me", "what is Nearby", "not nearness", "where I am", "my city", "hereby", "CLOSE TO ME", "current location", "",
    "a hoarding", "SMD screens", "nothing", "outdoor ads",
]


def _near_sql(variant: str, low: str) -> str:
    body = "|".join(p.replace(" ", f"[{WS}]+") for p in fixed.NEAR_ME_PHRASES[variant])
    edge = r"(^|[^A-Za-z0-9_])", r"($|[^A-Za-z0-9_])"
    before, after = edge if variant == "client" else (B, A)
    return f"regexp_matches({low}, '{before}({body}){after}')"


_ASKED = f"WITH t AS (SELECT doc_id, lower(left(text, 300) || ' ' || {sql_choose('doc_id', _ASKS)} || ' ' || substr(text, 301)) AS low FROM documents)"


@query(
    "txt_07_near_me",
    f"{_ASKED} SELECT doc_id, {_near_sql('server', 'low')} AS server, {_near_sql('client', 'low')} AS client FROM t",
)
def _(spark, sf):
    said = _plant(_ASKS)
    return _docs(spark, sf).select(
        "doc_id", T.is_near_me(said).alias("server"), T.is_near_me(said, "client").alias("client")
    )


@query(
    "txt_08_listing_intent",
    f"{_ASKED} SELECT doc_id, (" + " OR ".join(f"contains(low, '{t}')" for t in fixed.LISTING_INTENT_TERMS)
    + f" OR {_near_sql('server', 'low')}) AS wants FROM t",
)
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.has_listing_intent(_plant(_ASKS)).alias("wants"))


_NAMES = [" Your City ", "N/A", "Lahore", "none", "", "near me", "  ", "unknown city"]


@query(
    "txt_09_null_if_placeholder",
    "WITH c AS (SELECT c_custkey, " + sql_choose("c_custkey", _NAMES) + f" AS city FROM customer) SELECT c_custkey, CASE WHEN {sql_strip('lower(city)')} IN ('', "
    + ", ".join(quote(p) for p in fixed.PLACEHOLDERS) + ") THEN NULL ELSE city END AS city FROM c",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", T.null_if_placeholder(choose(F.col("c_custkey"), _NAMES)).alias("city"))


# --- points -----------------------------------------------------------------------------------------------

LAT, LON = "(24 + c_custkey % 11 + (c_custkey % 7) / 10.0)", "(66 + c_custkey % 9 + (c_custkey % 5) / 10.0)"


def points(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", (24 + k % 11 + (k % 7) / 10.0).alias("lat"), (66 + k % 9 + (k % 5) / 10.0).alias("lon")
    )


def _km_sql(lat1, lon1, lat2, lon2) -> str:
    a = (
        f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    )
    return f"(2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - {a})))"


_PTS = f"pts AS (SELECT c_custkey, {LAT}::double AS lat, {LON}::double AS lon FROM customer)"
_CITY = "ct(city, clat, clon, pos) AS (VALUES " + sql_values([(n, y, x, i) for i, (n, y, x) in enumerate(fixed.CITY_POINTS)]) + ")"
_NEAR = (
    f"{_PTS}, {_CITY}, km AS (SELECT c_custkey, city, pos, {_km_sql('lat', 'lon', 'clat::double', 'clon::double')} AS km FROM pts, ct), "
    "best AS (SELECT c_custkey, city, km FROM km QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, pos) = 1)"
)


@query(
    "geo_01_haversine_km",
    f"WITH {_PTS} SELECT c_custkey, round({_km_sql('lat', 'lon', '31.5204', '74.3587')}, 3) AS km FROM pts",
)
def _(spark, sf):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(31.5204), F.lit(74.3587))
    return points(spark, sf).select("c_custkey", F.round(km, 3).alias("km"))


@query(
    "geo_02_nearest_city",
    f"WITH {_NEAR} SELECT c_custkey, CASE WHEN km <= 120 THEN city END AS city, round(km, 3) AS km FROM best",
)
def _(spark, sf):
    best = geo.nearest_city(F.col("lat"), F.col("lon"))
    return points(spark, sf).select("c_custkey", best["city"].alias("city"), F.round(best["km"], 3).alias("km"))


# parts as cities all over the globe, some of them at one point, at the poles and on both sides of the date line
_PART_CITIES = (
    "pc AS (SELECT p_partkey AS pos, 'city ' || p_partkey AS name, CASE p_partkey % 50 WHEN 0 THEN 90.0 WHEN 1 THEN -90.0 ELSE (p_partkey * 7919 % 17000) / 100.0 - 85 END::double AS clat, "
    "CASE WHEN p_partkey % 7 = 0 THEN 179.9 WHEN p_partkey % 7 = 1 THEN -179.9 ELSE (p_partkey * 104729 % 36000) / 100.0 - 180 END::double AS clon FROM part), "
    "cp AS (SELECT c_custkey, (c_custkey * 6101 % 18001) / 100.0 - 90 AS lat, (c_custkey * 3571 % 36001) / 100.0 - 180 AS lon FROM customer)"
)


@query(
    "geo_02_nearest_of_table",
    f"WITH {_PART_CITIES}, d AS (SELECT c_custkey, name, pos, {_km_sql('lat', 'lon', 'clat', 'clon')} AS km FROM cp, pc) "
    "SELECT c_custkey, name, round(km, 3) AS km FROM d WHERE km <= 400 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY round(km, 6), pos) = 1",
)
def _(spark, sf):
    k = F.col("p_partkey")
    lat = F.when(k % 50 == 0, 90.0).when(k % 50 == 1, -90.0).otherwise((k * 7919) % 17000 / 100.0 - 85)
    lon = F.when(k % 7 == 0, 179.9).when(k % 7 == 1, -179.9).otherwise((k * 104729) % 36000 / 100.0 - 180)
    name = F.concat(F.lit("city "), k.cast("string"))
    cities = table(spark, sf, "part").select(name.alias("name"), lat.alias("lat"), lon.alias("lon"), k.alias("pos"))
    c = F.col("c_custkey")
    at = table(spark, sf, "customer").select("c_custkey", ((c * 6101) % 18001 / 100.0 - 90).alias("lat"), ((c * 3571) % 36001 / 100.0 - 180).alias("lon"))
    return places.nearest_of(at, cities, "c_custkey", 400).select("c_custkey", "name", F.round("km", 3).alias("km"))


_SAYS = ["billboards near me", "screens in town", "what is nearby?", "show smd"]
_STATED = ["Multan ", "your city", "", "Sialkot", "n/a"]


@query(
    "txt_10_resolve_city",
    f"WITH {_NEAR}, r AS (SELECT c_custkey, " + sql_choose("c_custkey", _SAYS) + " AS message, " + sql_choose("c_custkey // 2", _NAMES) + " AS city, "
    + sql_choose("c_custkey // 3", _STATED) + " AS stated, CASE WHEN c_custkey % 5 < 3 AND b.km <= 120 THEN b.city END AS point, "
    "CASE WHEN c_custkey % 6 = 0 THEN 'Lahore' END AS ip FROM customer JOIN best b USING (c_custkey)), n AS (SELECT *, message LIKE '%near%' AS near, "
    f"CASE WHEN {sql_strip('lower(stated)')} IN ('', " + ", ".join(quote(p) for p in fixed.PLACEHOLDERS) + f") THEN NULL ELSE {sql_strip('stated')} END AS st, "
    f"CASE WHEN {sql_strip('lower(r.city)')} IN ('', " + ", ".join(quote(p) for p in fixed.PLACEHOLDERS) + ") THEN NULL ELSE r.city END AS guess FROM r) "
    "SELECT c_custkey, CASE WHEN near THEN coalesce(point, st, ip, 'Rawalpindi') ELSE guess END AS resolved_city, CASE WHEN near THEN CASE WHEN point IS NOT NULL "
    "THEN 'coordinates' WHEN st IS NOT NULL THEN 'stated' WHEN ip IS NOT NULL THEN 'address' ELSE 'default' END WHEN guess IS NOT NULL THEN 'named' ELSE 'unknown' END AS how FROM n",
)
def _(spark, sf):
    k = F.col("c_custkey")
    located = k % 5 < 3
    requests = points(spark, sf).select(
        "c_custkey", choose(k, _SAYS).alias("message"), choose(F.floor(k / 2), _NAMES).alias("city"),
        choose(F.floor(k / 3), _STATED).alias("current_city"), F.when(located, F.col("lat")).alias("lat"),
        F.when(located, F.col("lon")).alias("lon"), F.when(k % 6 == 0, "Lahore").alias("ip_city"),
    )
    return resolve_city(requests).select("c_custkey", "resolved_city", "how")


# --- listing text -----------------------------------------------------------------------------------------

_BASE = "https://listings.example.com/search-results/"


@query(
    "txt_11_search_urls",
    f"SELECT s_suppkey, page, '{_BASE}' || CASE WHEN page = 1 THEN '?' ELSE 'page/' || page || '/?' END || 'type%5B%5D=billboards&' || CASE WHEN s_suppkey % 2 = 0 "
    "THEN 'type%5B%5D=digital&' ELSE '' END || 'location%5B%5D=city-' || s_nationkey AS url FROM supplier, range(1, 4) p(page)",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").withColumn("page", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))))
    types = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("billboards"), F.lit("digital"))).otherwise(
        F.array(F.lit("billboards"))
    )
    city = F.concat(F.lit("city-"), F.col("s_nationkey").cast("string"))
    return s.select("s_suppkey", "page", T.search_url(city, types, F.col("page"), _BASE).alias("url"))


def _listing_text(p):
    k = F.col("p_partkey")
    return F.concat(
        F.col("p_name"), F.when(k % 3 == 0, F.concat(F.lit(" Rs 1,"), (k % 900 + 100).cast("string"), F.lit("/month "))).otherwise(" no price "),
        F.when(k % 4 > 0, F.concat((k % 60 + 5).cast("string"), F.lit(" X "), (k % 30 + 3).cast("string"))).otherwise("size open"),
        F.lit(" AB"), (k % 900 + 100).cast("string"), F.lit(" "), F.lit("ZZ9AA QWERTY AB"), (k % 7 + 100).cast("string"), F.lit("\n"),
        F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit(" ooh media FOUND"))).otherwise(""),
    )


_LISTING = (
    "l AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'C' || (p_partkey % 77 + 100) || ', X9X9X9X , ab' END AS zone, p_name || CASE WHEN p_partkey % 3 = 0 THEN "
    "' Rs 1,' || (p_partkey % 900 + 100) || '/month ' ELSE ' no price ' END || CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 60 + 5) || ' X ' || (p_partkey % 30 + 3) "
    "ELSE 'size open' END || ' AB' || (p_partkey % 900 + 100) || ' ZZ9AA QWERTY AB' || (p_partkey % 7 + 100) || chr(10) || CASE WHEN p_partkey % 5 = 0 THEN p_partkey || "
    "' ooh media FOUND' ELSE '' END AS t FROM part)"
)


@query(
    "txt_12_extract_listing_fields",
    f"WITH {_LISTING} SELECT p_partkey, CASE WHEN regexp_matches(t, 'Rs[{WS},0-9]+') THEN {sql_strip('regexp_extract(t, ' + quote('Rs[' + WS + ',0-9]+(?:/[a-z]+)?') + ')')} ELSE 'Contact for price' END AS price, "
    r"regexp_extract(t, '\b([0-9]+\s*[xX]\s*[0-9]+)\b', 1) AS size, array_to_string(list_sort(list_distinct(CASE WHEN zone IS NULL THEN regexp_extract_all(t, '\b[A-Z0-9]{5}\b') "
    "ELSE regexp_extract_all(zone, '[A-Z0-9]{4,6}') END)), ',') AS codes, CASE WHEN regexp_matches(t, '(?i)[0-9]+ OOH Media Found') THEN regexp_extract(t, '[0-9]+')::bigint END AS total FROM l",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    zone = F.when(k % 2 == 0, F.concat(F.lit("C"), (k % 77 + 100).cast("string"), F.lit(", X9X9X9X , ab")))
    rows = p.select("p_partkey", zone.alias("zone"), _listing_text(p).alias("t"))
    return rows.select(
        "p_partkey", T.price_in_text(F.col("t")).alias("price"), T.size_in_text(F.col("t")).alias("size"),
        F.array_join(T.codes_in_text(F.col("t"), F.col("zone")), ",").alias("codes"), T.total_in_text(F.col("t")).alias("total"),
    )


_FENCES = ["```html\n", "```\n", "  ```HTML5-x \n\n", "", "\n\n"]


@query(
    "txt_13_finalize_html",
    "WITH p AS (SELECT page_id, " + sql_choose("page_id", _FENCES) + " || CASE WHEN page_id % 3 = 0 THEN replace(html, '</html>', '') WHEN page_id % 3 = 1 THEN substr(html, 16) ELSE html END || "
    "CASE WHEN page_id % 2 = 0 THEN chr(10) || '``` ' ELSE '' END AS h FROM pages), "
    f"s AS (SELECT page_id, {sql_strip('h')} AS h FROM p), t AS (SELECT page_id, regexp_replace(h, '^[{WS}]*```[a-zA-Z0-9_-]*[{WS}]*\n?', '') AS h FROM s), "
    f"u AS (SELECT page_id, {sql_strip('regexp_replace(h, ' + quote(chr(10) + '?[' + WS + ']*```[' + WS + ']*$') + ', ' + quote('') + ')')} AS h FROM t), v AS (SELECT page_id, CASE WHEN contains(lower(h), '</html>') THEN h ELSE h || chr(10) || '</html>' END AS h FROM u) "
    "SELECT page_id, md5(CASE WHEN regexp_matches(h, '(?i)^<!doctype\\s+html') THEN h ELSE '<!DOCTYPE html>' || chr(10) || h END) AS page, length(h) AS n FROM v",
)
def _(spark, sf):
    p = spread_table(spark, sf, "pages", "page_id")
    k = F.col("page_id")
    body = F.when(k % 3 == 0, F.replace("html", F.lit("</html>"), F.lit(""))).when(k % 3 == 1, F.substr("html", F.lit(16))).otherwise(F.col("html"))
    raw = F.concat(choose(k, _FENCES), body, F.when(k % 2 == 0, "\n``` ").otherwise(""))
    out = p.select("page_id", T.finalize_html(raw).alias("h"))
    added = F.when(F.startswith("h", F.lit("<!DOCTYPE html>\n")), 16).otherwise(0)
    return out.select("page_id", md5_text("h").alias("page"), (F.length("h") - added).cast("bigint").alias("n"))


@query(
    "txt_14_extract_reply",
    "WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN ' ' || text || '<|im_end|>' ELSE '<|im_start|>assistant old<|im_end|><|im_start|>assistant' || chr(10) || text || "
    "CASE WHEN turn % 2 = 0 THEN '<|im_end|> rest' ELSE '' END END AS t FROM conversations), r AS (SELECT conv_id, turn, CASE WHEN contains(t, '<|im_start|>assistant') THEN "
    "string_split(list_extract(string_split(t, '<|im_start|>assistant'), -1), '<|im_end|>')[1] ELSE t END AS r FROM c) "
    f"SELECT conv_id, turn, md5({sql_strip('r')}) AS reply FROM r",
)
def _(spark, sf):
    c = table(spark, sf, "conversations")
    marked = F.concat(
        F.lit("<|im_start|>assistant old<|im_end|><|im_start|>assistant\n"), "text",
        F.when(F.col("turn") % 2 == 0, "<|im_end|> rest").otherwise(""),
    )
    raw = F.when(F.col("turn") % 4 == 3, F.concat(F.lit(" "), "text", F.lit("<|im_end|>"))).otherwise(marked)
    return c.select("conv_id", "turn", md5_text(T.reply_text(raw)).alias("reply"))


# --- tool calls -------------------------------------------------------------------------------------------

def _calls(spark, sf):
    """Model replies built from events: every form of tool call by turns."""
    e = spread_table(spark, sf, "events", "event_id")
    k = F.col("event_id")
    v = F.col("value").cast("string")
    params = F.concat(F.lit('{"prompt": "make '), "event_type", F.lit('", "city": "near me", "n": {"deep": {"v": '), v, F.lit("}}}"))
    outer = F.concat(F.lit('{"parameters": '), params, F.lit("}"))
    text = (
        F.when(k % 8 == 0, F.concat(F.lit('Sure.\n<tool_call>\n{"name": "text_generation", "parameters": '), params, F.lit("}</tool_call> done")))
        .when(k % 8 == 1, F.concat(F.lit("<billboard_search>"), outer, F.lit(" trailing } text")))
        .when(k % 8 == 2, F.concat(F.lit("<website_generation> then <image_generation> "), outer))
        .when(k % 8 == 3, F.concat(F.lit('<video_generation>{"parameters": {"description": "'), "event_type"))
        .when(k % 8 == 4, F.lit('<tool_call>{"name": "unknown_tool", "parameters": {}}</tool_call>'))
        .when(k % 8 == 5, F.concat(F.lit("just talk about "), "event_type"))
        .when(k % 8 == 6, F.concat(F.lit('<text_generation>{"prompt": "'), "event_type", F.lit('"}')))
        .otherwise(F.lit("<tool_call>{bad json}</tool_call> <billboard_search> {\"parameters\": {\"city\": \"Lahore\"}}"))
    )
    said = F.concat(F.lit("show "), "event_type", F.when(k % 3 == 0, " on digital screens").otherwise(" ads"))
    # explode keeps the built text a column of its own, as replies read from a table are
    return e.select("event_id", F.explode(F.array(text)).alias("text"), said.alias("message"))


_EXPECT = (
    "e AS (SELECT event_id, event_id % 8 AS k, event_type, 'show ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' on digital screens' ELSE ' ads' END AS message FROM events), "
    "c AS (SELECT *, CASE k WHEN 0 THEN 'text_generation' WHEN 1 THEN 'billboard_search' WHEN 2 THEN 'image_generation' WHEN 6 THEN 'text_generation' WHEN 7 THEN 'billboard_search' END AS tool, "
    "CASE WHEN k IN (3, 4) THEN 'malformed' WHEN k = 5 THEN 'none' ELSE 'ok' END AS status, CASE WHEN k IN (0, 1, 2) THEN 'make ' || event_type WHEN k = 6 THEN event_type END AS prompt, "
    "CASE WHEN k IN (0, 1, 2) THEN 'near me' WHEN k = 7 THEN 'Lahore' END AS city FROM e)"
)


@query("txt_15_parse_tool_calls", f"WITH {_EXPECT} SELECT event_id, tool, status, prompt, city FROM c")
def _(spark, sf):
    get = lambda n: F.try_element_at(F.col("params"), F.lit(n)).alias(n)
    return parse_tool_calls(_calls(spark, sf)).select("event_id", "tool", "status", get("prompt"), get("city"))


@query(
    "txt_16_tool_defaults",
    f"WITH {_EXPECT} SELECT event_id, tool, CASE WHEN tool IN ('text_generation', 'image_generation') THEN coalesce(prompt, message) END AS prompt, "
    "CASE WHEN tool = 'image_generation' THEN 'eastern_clothing' END AS style, CASE WHEN tool = 'billboard_search' AND city <> 'near me' THEN city END AS city, "
    "CASE WHEN tool = 'billboard_search' THEN CASE WHEN contains(message, 'digital') THEN 'digital' ELSE 'billboards' END END AS ad_type, "
    "'' AS missing FROM c WHERE status = 'ok'",
)
def _(spark, sf):
    ok = parse_tool_calls(_calls(spark, sf)).filter("status = 'ok'")
    get = lambda n: F.try_element_at(F.col("filled"), F.lit(n)).alias(n)
    return tool_defaults(ok).select(
        "event_id", "tool", get("prompt"), get("style"), get("city"), get("ad_type"),
        F.array_join("missing", ",").alias("missing"),
    )


_TAGGED = ["<text_generation>{a} b\nkept", "hello\n \n\n\nthere <billboard_search> gone", "<image_generation>", " plain "]


@query(
    "txt_17_strip_tool_tags",
    "WITH c AS (SELECT conv_id, turn, " + sql_choose("turn", _TAGGED) + " || CASE WHEN conv_id % 2 = 0 THEN chr(10) || text ELSE '' END AS t FROM conversations), "
    "s AS (SELECT conv_id, turn, "
    + sql_strip("regexp_replace(regexp_replace(t, '<(image_generation|text_generation|video_generation|website_generation|billboard_search)>[^\n]*', '', 'g'), '\n[" + WS + "]*\n', chr(10) || chr(10), 'g')")
    + " AS t FROM c) SELECT conv_id, turn, md5(CASE WHEN t = '' THEN 'I''ll help you with that request.' ELSE t END) AS reply FROM s",
)
def _(spark, sf):
    c = table(spark, sf, "conversations")
    raw = F.concat(choose(F.col("turn"), _TAGGED), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("\n"), "text")).otherwise(""))
    return c.select("conv_id", "turn", md5_text(T.strip_tool_tags(raw)).alias("reply"))


# --- errors and secrets -----------------------------------------------------------------------------------

def _errors(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'")
    k = F.col("event_id")
    n = (k % 90 + 10).cast("string")
    msg = (
        F.when(k % 5 == 0, F.concat(F.lit('429 Quota hit quota_metric: "GenerateRequestsPerDay" quota_value: '), n, F.lit("\nretry_delay {\n  seconds: "), (k % 9000).cast("string"), F.lit("\n}")))
        .when(k % 5 == 1, F.concat(F.lit('limit: quota_metric: "RequestsPerMinute" retry_delay { seconds: '), (k % 50).cast("string"), F.lit("}")))
        .when(k % 5 == 2, F.lit("400 API key not valid."))
        .when(k % 5 == 3, F.concat(F.lit("timeout while calling the model for event "), k.cast("string"), F.lit(" of the day")))
        .otherwise(F.lit("Invalid argument; rate unknown"))
    )
    return e.select("event_id", msg.alias("m"))


@query(
    "txt_19_classify_api_errors",
    "WITH e AS (SELECT event_id, event_id % 5 AS k FROM events WHERE event_type = 'error'), x AS (SELECT event_id, k, CASE WHEN k IN (0, 1) THEN 'quota' WHEN k = 3 THEN 'error' ELSE 'invalid' END AS kind, "
    'CASE WHEN k = 0 THEN event_id % 90 + 10 END AS "limit", CASE k WHEN 0 THEN event_id % 9000 WHEN 1 THEN event_id % 50 END AS retry_seconds, CASE k WHEN 0 THEN \'GenerateRequestsPerDay\' WHEN 1 THEN \'RequestsPerMinute\' END AS metric FROM e) '
    'SELECT event_id, kind, "limit", retry_seconds, metric, k = 0 AS is_daily, k = 1 AS is_per_minute, CASE k WHEN 0 THEN \'0 of \' || (event_id % 90 + 10) || \' daily images\' WHEN 1 THEN \'Per-minute limit hit (None/min)\' '
    "WHEN 3 THEN 'Unknown' ELSE 'N/A' END AS capacity, CASE WHEN retry_seconds > 0 THEN 'Resets in ' || CASE WHEN retry_seconds >= 3600 THEN (retry_seconds // 3600) || 'h ' ELSE '' END || (retry_seconds % 3600 // 60) || 'm' END AS resets, "
    "CASE WHEN k IN (0, 1, 4) THEN 'next_key_after_wait' ELSE 'give_up' END AS retry, CASE WHEN k IN (0, 1) THEN 'Quota exceeded' WHEN k = 3 THEN left('timeout while calling the model for event ' || event_id || ' of the day', 50) "
    "ELSE 'Invalid API key' END AS message FROM x",
)
def _(spark, sf):
    return _errors(spark, sf).select("event_id", T.api_error(F.col("m")).alias("e")).select("event_id", "e.*")


@query("txt_20_mask_secret", "SELECT c_custkey, left(c_name, 8) || '...' || right(c_name, 4) AS masked FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.mask_secret(F.col("c_name")).alias("masked"))


# --- prompts, titles, times -------------------------------------------------------------------------------

@query(
    "txt_21_render_training_prompt",
    "SELECT doc_id, md5('<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Describe ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || lang ELSE '' END || "
    "'<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || text || '<|im_end|>') AS prompt FROM documents",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    extra = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    prompt = T.training_prompt(F.concat(F.lit("Describe "), "source"), extra, F.col("text"), "Be brief.")
    return d.select("doc_id", md5_text(prompt).alias("prompt"))


@query(
    "txt_23_fill_templates",
    "SELECT p_partkey, 'Our ' || p_type || ' ' || p_name || ' ({season}) for ' || p_brand || ', ' || p_type AS instruction FROM part",
)
def _(spark, sf):
    filled = T.fill_template(
        F.lit("Our {style} {clothing} ({season}) for {context}, {style}"),
        style=F.col("p_type"), clothing=F.col("p_name"), context=F.col("p_brand"),
    )
    return table(spark, sf, "part").select("p_partkey", filled.alias("instruction"))


@query(
    "txt_24_chat_titles",
    "SELECT conv_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS title FROM conversations WHERE role = 'user' "
    "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1",
)
def _(spark, sf):
    users = table(spark, sf, "conversations").filter("role = 'user'")
    first = users.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", T.chat_title(F.col("text")).alias("title"))


_TAILS = ["", "Z", "+00:00", ".5", ".081280912Z", ".08128+05:00", "oops"]


@query(
    "txt_25_parse_db_timestamps",
    "WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400) AS t FROM orders) SELECT o_orderkey, strftime(CASE k WHEN 3 THEN t + INTERVAL 500 MILLISECOND "
    "WHEN 4 THEN t + INTERVAL 81280 MICROSECOND WHEN 5 THEN t + INTERVAL 81280 MICROSECOND - INTERVAL 5 HOUR WHEN 6 THEN NULL ELSE t END, '%Y-%m-%d %H:%M:%S.%f') AS at FROM o",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)
    raw = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), choose(F.col("o_orderkey"), _TAILS))
    return o.select("o_orderkey", F.date_format(T.db_timestamp(raw), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


_URIS = [
    "data:image/PNG;base64,aGVsbG8=", "data:video/mp4;base64,AAAAIGZ0eXBpc29t", "aGVsbG8=", "data:image/tiff;base64,aGk=",
    "data:image/webp;base64,UklGRgAAAABXRUJQ",
]


@query(
    "txt_26_media_kind",
    "WITH e AS (SELECT event_id, (event_id % 5)::int AS k, event_type FROM events) SELECT event_id, (['image/png', 'video/mp4', NULL, 'image/tiff', 'image/webp'])[k + 1] AS mime, "
    "(['png', 'mp4', 'png', 'bin', 'webp'])[k + 1] AS extension, CASE WHEN k = 1 THEN 'generated_videos' ELSE 'generated_images' END AS folder, ([5, 12, 5, 2, 12])[k + 1]::bigint AS n_bytes, "
    "(['image/png', 'video/mp4', 'image/png', 'application/octet-stream', 'image/webp'])[k + 1] AS content_type, CASE WHEN k = 4 THEN 'image/webp' ELSE 'video/mp4' END AS sniffed, "
    "CASE event_type WHEN 'click' THEN 'image' WHEN 'view' THEN 'video' WHEN 'signup' THEN 'website' ELSE 'text' END AS message_type, k = 1 OR event_id % 3 = 0 AS is_video FROM e",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    ref = T.media_reference(choose(F.col("event_id"), _URIS))
    tool = F.concat(
        F.when(F.col("event_type") == "click", "image").when(F.col("event_type") == "view", "video")
        .when(F.col("event_type") == "signup", "website").otherwise("other"), F.lit("_generation"),
    )
    url = F.when(F.col("event_id") % 5 == 1, choose(F.col("event_id"), _URIS)).when(
        F.col("event_id") % 3 == 0, "https://x.example.com/a.WEBM?s=1"
    ).otherwise("https://x.example.com/a.webmx")
    return e.select("event_id", "event_type", ref.alias("r"), tool.alias("tool"), url.alias("u")).select(
        "event_id", "r.mime", "r.extension", "r.folder", F.length("r.content").cast("bigint").alias("n_bytes"),
        T.content_type_for_extension(F.col("r.extension")).alias("content_type"),
        T.sniff_mime(F.col("r.content")).alias("sniffed"), T.message_type_for_tool(F.col("tool")).alias("message_type"),
        T.is_video_file(F.col("u")).alias("is_video"),
    )


@query(
    "txt_27_split_markdown",
    "WITH p AS (SELECT p_partkey, p_name, p_brand FROM part), r AS (SELECT p_partkey, 0 AS pos, 'text' AS kind, 'See ' || p_name || ': ' AS value, NULL AS alt FROM p UNION ALL SELECT p_partkey, 1, 'image', "
    "'http://i.example.com/' || p_partkey || '.png', p_brand FROM p UNION ALL SELECT p_partkey, 2, 'image', 'b.png', '' FROM p UNION ALL SELECT p_partkey, 3, 'text', ' end [x](y)', NULL FROM p WHERE p_partkey % 2 = 0) SELECT * FROM r",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat(
        F.lit("See "), "p_name", F.lit(": !["), "p_brand", F.lit("](http://i.example.com/"), F.col("p_partkey").cast("string"),
        F.lit(".png)![](b.png)"), F.when(F.col("p_partkey") % 2 == 0, " end [x](y)").otherwise(""),
    )
    parts = p.select("p_partkey", F.posexplode(T.markdown_parts(raw)).alias("pos", "part"))
    return parts.select("p_partkey", "pos", "part.kind", "part.value", "part.alt")


@query("txt_29_title_search", "SELECT doc_id FROM documents WHERE contains(lower(CASE WHEN doc_id % 9 > 0 THEN text ELSE '' END), 'the an')")
def _(spark, sf):
    title = F.when(F.col("doc_id") % 9 > 0, F.col("text"))
    return _docs(spark, sf).filter(T.title_matches(title, "The An")).select("doc_id")


@query(
    "txt_29_title_index",
    "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'Now ' || text ELSE text END AS title FROM documents WHERE doc_id % 40 <> 2) "
    "SELECT q AS query, doc_id FROM t, (VALUES ('the an'), ('now th'), ('ing. '), ('zzqx'), ('é')) v(q) WHERE contains(lower(title), q)",
)
def _(spark, sf):
    """Whole texts as titles; a second batch renames a quarter of them and takes some out."""
    k = F.col("doc_id")
    d = _docs(spark, sf).select(k.alias("id"), F.when(k % 9 > 0, F.col("text")).alias("title"), F.lit(False).alias("gone"))
    index = TitleIndex(spark, shared_path(spark, "titles"))
    index.add(d, 0)
    changed = d.filter("id % 4 = 1 OR id % 40 = 2").withColumn("gone", F.col("id") % 40 == 2)
    index.add(changed.withColumn("title", F.when(F.col("id") % 9 > 0, F.concat(F.lit("Now "), "title"))), 1)
    return search_all(index, ["the an", "now th", "ing. ", "zzqx", "é"]).select("query", F.col("id").alias("doc_id"))


@query(
    "txt_30_client_ips",
    "WITH e AS (SELECT event_id, event_id % 6 AS k, (event_id * 7919) % 256 AS a, (event_id * 31) % 256 AS b, event_id % 256 AS c FROM events), i AS (SELECT *, CASE WHEN k = 5 THEN 'not-an-ip' WHEN k = 4 THEN (['fe80::1', "
    "'2a00:1450::5', 'fd12::9', '::1', '999.1.1.1', '01.2.3.4'])[event_id // 6 % 6 + 1] ELSE a || '.' || b || '.' || c || '.7' END AS ip FROM e) SELECT event_id, ip, CASE WHEN k = 5 THEN true WHEN k = 4 THEN event_id // 6 % 6 <> 1 ELSE "
    "a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) "
    "OR (a = 203 AND b = 0 AND c = 113) OR a >= 240 END AS is_private FROM i",
)
def _(spark, sf):
    e = spread_table(spark, sf, "events", "event_id")
    k = F.col("event_id")
    quad = F.concat_ws(".", ((k * 7919) % 256).cast("string"), ((k * 31) % 256).cast("string"), (k % 256).cast("string"), F.lit("7"))
    odd = choose(F.floor(k / 6), ["fe80::1", "2a00:1450::5", "fd12::9", "::1", "999.1.1.1", "01.2.3.4"])
    ip = F.when(k % 6 == 5, "not-an-ip").when(k % 6 == 4, odd).otherwise(quad)
    seen = T.client_ip(
        F.when(k % 3 == 0, F.concat(F.lit(" "), ip, F.lit(" , 10.0.0.1"))).otherwise(""),
        F.when(k % 3 == 1, F.concat(ip, F.lit(" "))).otherwise(""), ip,
    )
    return e.select("event_id", seen.alias("ip")).select("event_id", "ip", T.is_private_ip(F.col("ip")).alias("is_private"))


@query(
    "txt_33_collapse_blank_lines",
    f"SELECT doc_id, md5({sql_strip('''regexp_replace(replace(text, '. ', '.' || repeat(chr(10), (doc_id % 5 + 1)::int)), chr(10) || '{3,}', chr(10) || chr(10), 'g')''')}) AS body FROM documents",
)
def _(spark, sf):
    lines = F.replace(F.col("text"), F.lit(". "), F.concat(F.lit("."), F.repeat(F.lit("\n"), (F.col("doc_id") % 5 + 1).cast("int"))))
    return _docs(spark, sf).select("doc_id", md5_text(T.collapse_blank_lines(lines)).alias("body"))
