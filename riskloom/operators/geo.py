"""Geography (G1-G3): city lookup, great-circle distance, cross-border test.

The city dimension is a small table joined behind a row-count check
(broadcast), twice: once for the home city and once for the transaction city.
Unknown cities give NULL country/coordinates, hence NULL distance and NULL
cross-border flag.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.schema import CITIES, EARTH_RADIUS_KM


def city_dimension(spark: SparkSession) -> DataFrame:
    """(city, country, lat, lon): the 59 supported cities."""
    return spark.createDataFrame(CITIES, "city string, country string, lat double, lon double")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km, rounded half-up to an integer (bigint)."""
    to_r = F.lit(math.pi / 180)
    dlat = (lat2 - lat1) * to_r
    dlon = (lon2 - lon1) * to_r
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(lat1 * to_r) * F.cos(lat2 * to_r) * F.pow(F.sin(dlon / 2), 2))
    d = F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
    return F.floor(d + 0.5).cast("long")


def with_geo(df: DataFrame, cities: DataFrame, home_col: str, loc_col: str) -> DataFrame:
    """Append home/transaction country and coordinates, distance_km, cross_border."""
    dim = cities.select("city", "country", "lat", "lon")
    home = dim.select(F.col("city").alias("_hc"), F.col("country").alias("home_country"),
                      F.col("lat").alias("_hlat"), F.col("lon").alias("_hlon"))
    loc = dim.select(F.col("city").alias("_lc"), F.col("country").alias("tx_country"),
                     F.col("lat").alias("_llat"), F.col("lon").alias("_llon"))
    j = (df.join(home, F.col(home_col) == F.col("_hc"), "left")
           .join(loc, F.col(loc_col) == F.col("_lc"), "left"))
    return j.select(
        *df.columns, "home_country", "tx_country",
        haversine_km(F.col("_hlat"), F.col("_hlon"), F.col("_llat"), F.col("_llon"))
        .alias("distance_km"),
        (F.col("home_country") != F.col("tx_country")).alias("cross_border"))


def expected_international(home_country: Column, tx_country: Column) -> Column:
    """'Yes'/'No' from the two countries; NULL when either is unknown."""
    return (F.when(home_country.isNull() | tx_country.isNull(), F.lit(None).cast("string"))
            .when(home_country != tx_country, "Yes").otherwise("No"))
