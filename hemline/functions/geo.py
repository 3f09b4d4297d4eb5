"""Distances and nearest cities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemline.functions import fixed

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    north = F.sin(F.radians(lat2 - lat1) / 2)
    east = F.sin(F.radians(lon2 - lon1) / 2)
    a = north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def nearest_city(lat: Column, lon: Column, cities=fixed.CITY_POINTS, max_km: float = 120.0) -> Column:
    """Struct (city, km) of the closest city; city is null beyond ``max_km``. Ties go to the earlier city.

    The cities are a short list of constants, so each row finds its minimum in place: no join at all.
    """
    options = F.array(
        *[
            F.struct(
                haversine_km(lat, lon, F.lit(y), F.lit(x)).alias("km"),
                F.lit(pos).alias("pos"),
                F.lit(name).alias("city"),
            )
            for pos, (name, y, x) in enumerate(cities)
        ]
    )
    best = F.array_min(options)
    return F.struct(F.when(best["km"] <= max_km, best["city"]).alias("city"), best["km"].alias("km"))
