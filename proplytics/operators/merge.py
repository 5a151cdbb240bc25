"""One property on several portals: listings of a place whose prices follow closely are one cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proplytics.session import materialise

#: two prices link when the dearer is at most six fifths of the cheaper
DEARER, CHEAPER = 6, 5
#: prices of a band lie closer than that, so each band of a place is linked throughout
BAND_RATIO = 1.19
SPREAD_DEGREES = 0.0005


def _follows(low: Column, high: Column) -> Column:
    whole = "decimal(38,0)"
    return high.cast(whole) * F.lit(CHEAPER) <= low.cast(whole) * F.lit(DEARER)


def price_band(price: Column) -> Column:
    """Number of the geometric band of a positive price; there are about 250 for all longs."""
    return F.floor(F.log(price.cast("double")) / F.lit(math.log(BAND_RATIO))).cast("int")


def merge_listings(listings: DataFrame, places: list[str], key: str = "id", price: str = "price_jpy") -> DataFrame:
    """(key, cluster_id): clusters of the links between listings of equal ``places`` with prices at most 20 % apart.

    A cluster is everything that links reach; its id is its lowest key. A place is a line of prices, so a cluster is a stretch
    of it, and prices are first gathered in bands that cannot be torn: a task sees the bands of a place (some 250 at most) and never its
    listings, however many there are. Rows without a key are left out; a listing with a null place column or without a positive price is a
    cluster of its own. A key with several places or prices has a row for each of its clusters.
    """
    known = F.col(price) > 0
    for place in places:
        known = known & F.col(place).isNotNull()
    rows = listings.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *places, price, F.coalesce(known, F.lit(False)).alias("_known"))
    rows = materialise(rows.withColumn("_band", F.when(F.col("_known"), price_band(F.col(price)))))
    bands = rows.where("_known").groupBy(*places, "_band").agg(F.min(price).alias("_low"), F.max(price).alias("_high"), F.min("_key").alias("_first"))
    line = Window.partitionBy(*places).orderBy("_band")
    gap = F.when(_follows(F.lag("_high").over(line), F.col("_low")), 0).otherwise(1)
    stretches = bands.withColumn("_gap", gap).withColumn("_stretch", F.sum("_gap").over(line))
    ids = stretches.withColumn("cluster_id", F.min("_first").over(Window.partitionBy(*places, "_stretch"))).select(*places, "_band", "cluster_id")
    # the bands of a crowded place are spread over tasks by their number
    found = rows.where("_known").join(ids, [*places, "_band"]).select(F.col("_key").alias(key), "cluster_id")
    return found.unionByName(rows.where("NOT _known").select(F.col("_key").alias(key), F.col("_key").alias("cluster_id"))).distinct()


def cluster_summary(listings: DataFrame, clusters: DataFrame, key: str = "id", price: str = "price_jpy", source: str = "source") -> DataFrame:
    """cluster_id, n, portals, cheapest, dearest, review: a cluster is flagged when a chain of links spans over 20 % or its points over some 50 m."""
    joined = clusters.join(listings.select(key, price, source, "lat", "lng"), key)
    apart = [F.max(c) - F.min(c) > F.lit(SPREAD_DEGREES) for c in ("lat", "lng")]
    return joined.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.size(F.collect_set(source)).cast("bigint").alias("portals"), F.min(price).alias("cheapest"), F.max(price).alias("dearest"),
        (~F.coalesce(_follows(F.min(price), F.max(price)), F.lit(True)) | F.coalesce(apart[0] | apart[1], F.lit(False))).alias("review"))
