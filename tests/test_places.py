"""Names and nearest points from large tables against plain Python."""


import numpy as np
from pyspark.sql import functions as F

from hemline.operators import places
from hemline.operators.listings import resolve_city

NAMES = "name string, place string, pos bigint"


def test_longest_name_of_a_large_table(spark):
    many = spark.range(100_000).select(F.concat(F.lit("Town "), F.col("id").cast("string")).alias("name"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("place"), (F.col("id") + 10).alias("pos"))
    own = [("Wah", "wah", 0), ("Wah  Cantt", "two blanks", 1), ("wah cantt", "cantt", 2), ("WAH CANTT", "later", 9), ("x-y", "dash", 3), ("été", "summer", 4), (" blank", "none", 5), ("a.", "none", 6), ("", "none", 7)]
    names = places.name_table(spark.createDataFrame(own, NAMES).unionByName(many))
    texts = {
        1: "in Wah Cantt today", 2: "wah,cantt", 3: "WAH  CANTT", 4: "town 99999!", 5: "town 99999x town 7", 6: "x-y x", 7: "ÉTÉ", 8: "wahé", 9: "", 10: None,
        11: "town 100000", 12: "a. blank", 13: "town 5 " * 20_000 + "town 12345", 14: "town 11 town 22",
    }
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    found = places.find_places(df, names, "id", "t")
    got = {r["id"]: r["place"] for r in found.collect()}
    assert got == {1: "cantt", 2: "wah", 3: "two blanks", 4: "t99999", 5: "t7", 6: "dash", 7: "summer", 13: "t12345", 14: "t11"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "99999" not in plan  # no expression for each name
    assert places.find_places(df, names.limit(0), "id", "t").count() == 0


def km(lat1, lon1, lat2, lon2):
    a, b, c, d = map(np.radians, (lat1, lon1, lat2, lon2))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def test_nearest_of_many_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    lat[: n // 2], lon[: n // 2] = 31 + rng.normal(0, 0.3, n // 2), 74 + rng.normal(0, 0.3, n // 2)  # a crowded region
    lat[:60], lon[:60] = 90.0 * np.sign(rng.uniform(-1, 1, 60)), 0.0  # the poles
    lon[60:160] = np.where(np.arange(100) % 2, 179.99, -179.99)
    lat[160:200], lon[160:200] = 12.5, 12.5  # one point
    at = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 120), rng.uniform(-180, 180, 120))]
    at += [(90.0, 10.0), (-90.0, -170.0), (0.0, 180.0), (0.0, -180.0), (12.5, 12.5), (31.0, 74.0), (33.5, 74.0), (None, 1.0), (float("nan"), 1.0), (91.0, 0.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id int, lat double, lon double")
    cities = spark.createDataFrame([(f"c{i}", float(lat[i]), float(lon[i]), i) for i in range(n)] + [("odd", None, 1.0, -1)], "name string, lat double, lon double, pos int")
    got = {r["id"]: (r["name"], r["km"]) for r in places.nearest_of(points, cities, "id", 150).collect()}
    for i, (a, b) in enumerate(at):
        if a is None or not abs(a) <= 90:
            assert i not in got
            continue
        d = np.round(km(a, b, lat, lon), 6)
        j = int(d.argmin())  # the first of equals
        if d[j] <= 150:
            assert got[i][0] == f"c{j}" and abs(got[i][1] - d[j]) < 1e-5
        else:
            assert i not in got


def test_resolve_city_from_tables(spark):
    requests = spark.createDataFrame(
        [(1, "screens near me", "x", 10.0, 10.0, ["nowhere", "North Ville"]), (2, "screens near me", "x", 10.0, 10.0, ["nowhere"]), (3, "screens near me", "x", 50.0, 50.0, None), (4, "screens in", "Lahore", None, None, None)],
        "id int, message string, city string, lat double, lon double, places array<string>",
    )
    names = places.name_table(spark.createDataFrame([("ville", "V", 0), ("north ville", "NV", 1)], NAMES))
    cities = spark.createDataFrame([("Near", 10.1, 10.1, 0)], "name string, lat double, lon double, pos int")
    got = {r["id"]: (r["resolved_city"], r["how"]) for r in resolve_city(requests, names=names, cities=cities).collect()}
    assert got == {1: ("NV", "coordinates"), 2: ("Near", "coordinates"), 3: ("Rawalpindi", "default"), 4: ("Lahore", "named")}
    assert resolve_city(requests, names=names, cities=cities).columns == [*requests.columns, "resolved_city", "how"]


def test_only_words_that_begin_a_name_make_runs(spark, monkeypatch):
    tables = {}

    def keep(df, name="table", stored=places.stored):
        tables.setdefault(name, []).append(stored(df, name))
        return tables[name][-1]

    monkeypatch.setattr(places, "stored", keep)
    names = places.name_table(spark.createDataFrame([("Old Town", "o", 0), ("old", "p", 1), ("Hill", "h", 2)], NAMES))
    texts = spark.createDataFrame([(1, "some words " * 500 + "in old  town"), (2, "an old town, up a hill"), (3, "nothing")], "id int, t string")
    assert {r["id"]: r["place"] for r in places.find_places(texts, names, "id", "t").collect()} == {1: "p", 2: "o"}
    assert tables["runs"][0].count() == 5  # two lengths for each "old", one "hill"


def test_cities_at_a_pole_and_crowds_take_few_rounds(spark, monkeypatch):
    """The fullest cube does not set the first width: it took sixteen rounds over all cities."""
    rounds = []

    def keep(df, name="table", stored=places.stored):
        rounds.append(name)
        return stored(df, name)

    monkeypatch.setattr(places, "stored", keep)
    cities = spark.range(1000).selectExpr("concat('c', id) AS name", "if(id % 2 = 0, 90.0D, id / 20 - 25) AS lat", "id / 3.0D AS lon", "id AS pos")
    points = spark.createDataFrame([(1, 89.0, 5.0), (2, -25.0, 0.0), (None, 90.0, 3.0)], "id int, lat double, lon double")
    got = {r["id"]: r["name"] for r in places.nearest_of(points, cities, "id", 150).collect()}
    assert got[1] == "c0" and got[None] == "c0" and rounds.count("nearest") <= 3
