"""Places from tables of any size: names found in texts by word runs, nearest points by a grid over the globe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.functions.geo import EARTH_KM, haversine_km
from hemline.functions.text import WORD
from hemline.operators.scale import settled, small_side
from hemline.session import stored

_PIECE, _TAIL = f"[{WORD}]+[^{WORD}]*", f"[^{WORD}]+$"


def _pieces(text: Column) -> Column:
    """Words of a lowered text, each with what stands between it and the next."""
    return F.regexp_extract_all(F.lower(text), F.lit(_PIECE), 0)


def word_runs(window: Column, n: Column, most: int) -> Column:
    """The first ``n`` pieces of a ``window`` of ``most`` as they are written, without what follows the last word."""
    runs = None
    for k in range(1, most + 1):
        run = F.concat(*[F.get(window, F.lit(i)) for i in range(k - 1)], F.regexp_replace(F.get(window, F.lit(k - 1)), _TAIL, ""))
        runs = F.when(n == k, run) if runs is None else runs.when(n == k, run)
    return runs


def name_table(names: DataFrame) -> DataFrame:
    """``names`` (name, place, pos) as looked up: names in lower case, once each (the smallest pos), stored.

    A name starts and ends with a letter, digit or underscore; others cannot stand between word borders and are left out.
    """
    low = names.select(F.lower("name").alias("name"), "place", "pos").filter(F.rlike("name", F.lit(f"(?s)^[{WORD}](.*[{WORD}])?$")))
    once = low.groupBy("name").agg(F.min(F.struct("pos", "place")).alias("p"))
    words = F.size(_pieces(F.col("name")))
    return stored(once.select("name", "p.place", "p.pos", words.alias("words")), "names")


def find_places(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """Longest name of each text that stands there between word borders: ``key``, ``name``, ``place``; of equally long
    ones that with the smallest pos. Texts without one, and null texts, have no row; ``key`` tells the texts apart.

    ``names`` is a :func:`name_table`. Words of the texts are first held against the first words of names; only from those that
    begin a name are word runs made, of the lengths such names have. Runs, combined before they are shuffled, are matched with
    the names next, and only names that occur somewhere are joined to the texts.
    """
    most = names.agg(F.max("words").alias("n")).first()["n"]
    if not most:
        return texts.select(key).limit(0).withColumns({"name": F.lit("").cast("string"), "place": F.lit("").cast("string")})
    firsts = names.groupBy(F.regexp_extract("name", f"^[{WORD}]+", 0).alias("_first"), "words").count().select("_first", "words")
    firsts = small_side(stored(firsts, "first-words"))
    cut = settled(texts.filter(F.col(text).isNotNull()).select(key, text), "_pieces", _pieces(F.col(text)))
    # places are read one by one: a slice would copy the whole array for every word of a long text
    at = F.sequence(F.lit(0), F.size("_pieces") - 1)
    windows = F.transform(at, lambda i: F.array(*[F.get(F.col("_pieces"), i + k) for k in range(most)]))
    starts = cut.filter(F.size("_pieces") > 0).select(key, F.explode(windows).alias("_window"))
    starts = starts.withColumn("_first", F.regexp_extract(F.get("_window", F.lit(0)), f"^[{WORD}]+", 0))
    runs = starts.join(firsts, "_first").select(key, word_runs(F.col("_window"), F.col("words"), most).alias("name"))
    runs = stored(runs.filter("name IS NOT NULL"), "runs")
    occurring = runs.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    occurring = small_side(stored(names.join(occurring, "name").select("name", "place", "pos"), "names-found"))
    best = F.max_by(F.struct("name", "place"), F.struct(F.length("name").alias("l"), (-F.col("pos")).alias("p")))
    return runs.join(occurring, "name").groupBy(key).agg(best.alias("b")).select(key, "b.*")


def resolve_places(requests: DataFrame, names: DataFrame, key: str, places: str) -> DataFrame:
    """First of the locality names of a request (array ``places``, in order) that is known: ``key``, ``place``.

    A locality is known when it contains a name of the table between word borders; the longest counts.
    """
    said = requests.select(key, F.posexplode(places).alias("_at", "_said"))
    said = said.withColumn("_row", F.struct(F.col(key).alias("k"), F.col("_at").alias("at")))
    found = find_places(said.select("_row", "_said"), names, "_row", "_said")
    return found.groupBy(F.col("_row.k").alias(key)).agg(F.min_by("place", F.col("_row.at")).alias("place"))


# Cities a point meets on average with the cubes chosen for it, the smallest cubes (of a globe of radius 1), and one in how many
# cubes is counted to choose; all bear on speed only.
MEET, SMALLEST, COUNTED = 32, 2.0**-20, 16


def _xyz(lat: Column, lon: Column) -> list[Column]:
    """Point on the globe of radius 1: no seam at the date line, no poles."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _cell(axes: list[Column], width: float) -> Column:
    """Number of the cube a point falls in."""
    return F.xxhash64(*[F.floor(c / F.lit(width)) for c in axes])


def _beside(points: DataFrame, axes: list[str], width: float) -> DataFrame:
    """``points`` once for each cube, of the eight nearest, that the globe runs through, with its number ``_cube`` and without
    the ``axes``. The eight hold all within half a width of the point."""
    own = points.withColumn("_side", F.explode(F.sequence(F.lit(0), F.lit(7))))
    low, high = F.lit(0.0), F.lit(0.0)
    for i, axis in enumerate(axes):
        at = F.col(axis) / F.lit(width)
        # the cube beside its own: one less where the point is in the lower half of it, one more in the upper
        step = F.when(at - F.floor(at) < 0.5, -1).otherwise(1)
        own = own.withColumn(f"_n{i}", F.floor(at) + step * F.getbit("_side", F.lit(i)))
        a, b = F.col(f"_n{i}") * F.lit(width), (F.col(f"_n{i}") + 1) * F.lit(width)
        high = high + F.greatest(a * a, b * b)
        low = low + F.when((a <= 0) & (b >= 0), 0.0).otherwise(F.least(a * a, b * b))
    own = own.filter((low <= 1 + 1e-9) & (high >= 1 - 1e-9)).withColumn("_cube", F.xxhash64("_n0", "_n1", "_n2"))
    return own.drop("_side", "_n0", "_n1", "_n2", *axes)


def _valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & F.abs(lon).between(0, 1e6)


def _width(open_: DataFrame, spots: DataFrame, least: float, widest: float) -> float:
    """Width of the widest cubes, from ``widest`` down by halves but to ``least``, at which points meet ``MEET`` cities on average.

    Points and cities are counted in the same cubes, one in ``COUNTED`` of them, for all widths in one job.
    """
    tried = [widest]
    while tried[-1] / 2 >= least:
        tried.append(tried[-1] / 2)

    def counts(axes: list[Column], df: DataFrame, n: str) -> DataFrame:
        cubes = F.array(*[F.struct(F.lit(i).alias("w"), _cell([F.col(f"_{a}") for a in range(3)], w).alias("c")) for i, w in enumerate(tried)])
        cubes = df.select(*[a.alias(f"_{i}") for i, a in enumerate(axes)]).select(F.explode(cubes).alias("u")).select("u.*")
        return cubes.filter(F.pmod(F.xxhash64("c", F.lit(1)), F.lit(COUNTED)) == 0).groupBy("w", "c").agg(F.count(F.lit(1)).alias(n))

    both = counts([F.col(c) for c in "xyz"], spots, "n").join(counts([F.col(c) for c in ("_x", "_y", "_z")], open_, "m"), ["w", "c"], "full")
    load = both.groupBy("w").agg(F.sum(F.coalesce(F.col("n") * F.col("m"), F.lit(0))).alias("pairs"), F.sum("m").alias("points"), F.sum("n").alias("n"))
    load = {r["w"]: r for r in load.collect()}
    # a point meets some eight cubes like its own; what cities there are is as much as a table is worth reading
    good = [w for i, w in enumerate(tried) if i not in load or 8 * load[i]["pairs"] <= MEET * ((load[i]["points"] or 0) + (load[i]["n"] or 0))]
    return max(good, default=tried[-1])


def nearest_of(points: DataFrame, cities: DataFrame, key: str, max_km: float = 120.0) -> DataFrame:
    """Nearest city of each point within ``max_km``: ``key``, ``name``, ``km``; ties, to the millimetre, go to the
    smaller pos.

    ``points`` (key, lat, lon), ``cities`` (name, lat, lon, pos). Points without a city so near, and points and cities with null
    or impossible coordinates, have no row. The globe is cut into cubes. A city stands in its own, once; a point
    looks into the nearest eight, which hold every city within half their width: if it finds one no farther off, no other can be
    nearer. Points that don't go on, with wider cubes, until these are twice as wide as ``max_km``. Each time the cubes are the
    widest in which the points left meet few cities on average, so only those left in a crowded region take small ones.
    """
    reach = 2 * math.sin(min(max_km / EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-12
    axes = dict(zip("xyz", _xyz(F.col("lat"), F.col("lon"))))
    # at a pole all longitudes are one point
    spots = cities.filter(_valid(F.col("lat"), F.col("lon"))).withColumn("lon", F.when(F.abs("lat") == 90, 0.0).otherwise(F.col("lon")))
    # of cities at one point the smallest pos
    spots = spots.groupBy("lat", "lon").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))
    spots = stored(spots.withColumns(axes), "spots")
    open_ = points.filter(_valid(F.col("lat"), F.col("lon"))).select(key, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    # stored with its place in space: the optimizer would work it out again for each cube
    open_ = stored(open_.withColumns(dict(zip(["_x", "_y", "_z"], _xyz(F.col("_lat"), F.col("_lon"))))), "points")
    widest, least, out = 2 * reach, SMALLEST, None
    xyz = [F.col(c) for c in "xyz"]
    while True:
        width = _width(open_, spots, min(least, widest), widest)
        last = width >= widest
        held = small_side(spots.select("lat", "lon", "name", "pos", _cell(xyz, width).alias("_cube")))
        met = _beside(open_, ["_x", "_y", "_z"], width).join(held, "_cube")
        km = haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
        best = F.min(F.struct(F.round(km, 6).alias("km"), "pos", "name"))
        found = met.groupBy(key).agg(best.alias("b")).select(key, F.col("b.name").alias("name"), F.col("b.km").alias("km"))
        # the length of a chord of half a width, a little less for rounding
        sure = max_km if last else 2 * EARTH_KM * math.asin(min(width / 4, 1.0)) * (1 - 1e-9)
        found = stored(found.filter(F.col("km") <= min(sure, max_km)), "nearest")
        out = found if out is None else out.unionByName(found)
        if last:
            return out
        open_ = stored(open_.join(found.select(F.col(key).alias("_done")), F.col(key).eqNullSafe(F.col("_done")), "left_anti"), "points-left")
        least = 2 * width
