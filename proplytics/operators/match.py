"""Entity resolution: which property does an incoming listing describe?

Three tiers, the first that hits wins: equal normalised address, similar address in the same
municipality, and coordinates within 50 m. Every join below works on distinct values, so a third of
all rows sharing one address or one point costs one row in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplytics.functions.geo import haversine_m
from proplytics.functions.text import bigrams, normalize_address
from proplytics.session import materialise

SIMILARITY = 0.85
MATCH_METERS = 50.0
BOX_DEGREES = 0.0005


def with_normalized(df: DataFrame, address: str = "address_ja") -> DataFrame:
    return df.withColumn("address_normalized", normalize_address(F.col(address)))


def one_per_address(properties: DataFrame, address: str = "address_ja") -> DataFrame:
    """Lowest property id per address; blank and unknown addresses match nothing."""
    a = F.col(address)
    usable = a.isNotNull() & (a != "") & (a != "Unknown")
    return properties.where(usable).groupBy(a.alias("_address")).agg(F.min("id").alias("match_id"))


def match_address(listings: DataFrame, properties: DataFrame, address: str = "address") -> DataFrame:
    """Listings with match_id, the property of exactly their address (null without one)."""
    found = one_per_address(properties)
    return listings.join(found, listings[address] == found["_address"], "left").drop("_address")


def match_normalized(listings: DataFrame, properties: DataFrame) -> DataFrame:
    """Tier 1: (key, match_id) by equal normalised address."""
    found = one_per_address(properties, "address_normalized")
    return listings.select("key", "address_normalized").join(
        found, F.col("address_normalized") == F.col("_address")
    ).select("key", "match_id")


# --- tier 2: similar addresses ----------------------------------------------
#
# J(x, y) >= t bounds the tokens not shared: |x ^ y| <= (1-t)/(1+t) * (|x|+|y|) = K. Hash the tokens
# into K+2 parts: at most K parts differ, so some two parts agree. Texts are joined on the hash of
# two agreeing parts; each such key covers 2/(K+2) of all tokens, so texts that merely share a
# town name do not meet. K follows from the size sum; each text emits keys for every K its
# possible partners allow. Nothing is lost; candidates are verified exactly.

SLACK = (1 - SIMILARITY) / (1 + SIMILARITY)
PAIRED_UP_TO = 6


def _bound(total: Column) -> Column:
    return F.floor(total * F.lit(SLACK) + F.lit(1e-9)).cast("int")


def _part_keys(hashes: Column, k: Column) -> Column:
    """Join keys of one text for difference bound ``k``."""
    paired = k <= PAIRED_UP_TO
    parts = F.when(paired, k + 2).otherwise(k + 1)
    indexes = F.sequence(F.lit(0), parts - 1)
    # each part is hashed once with its number; a pair is the hash of two such hashes
    hashed = F.transform(indexes, lambda i: F.xxhash64(k, i, F.filter(hashes, lambda h: F.pmod(h, parts) == i)))

    def partners(one: Column, i: Column) -> Column:
        later = F.slice(hashed, i + 2, parts)
        return F.when(paired, F.transform(later, lambda other: F.xxhash64(one, other))).otherwise(F.array(one))

    return F.flatten(F.transform(hashed, partners))


def similarity_keys(texts: DataFrame, text: str) -> DataFrame:
    """(text, tokens, n, k, key) rows of distinct texts.

    Only the empty text has no bigram. The filter names the text and not its tokens: below the
    distinct it would cut every row into bigrams, and spell the text out anew for each of them.
    """
    tokens = texts.select(text).where(F.col(text) != "").distinct().withColumn("tokens", bigrams(F.col(text)))
    sized = tokens.withColumns(
        {
            "n": F.size("tokens"),
            "hashes": F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t))),
        }
    )
    low = F.ceil(F.col("n") * F.lit(SIMILARITY) - F.lit(1e-9)).cast("int")
    high = F.floor(F.col("n") / F.lit(SIMILARITY) + F.lit(1e-9)).cast("int")
    bounds = F.sequence(_bound(F.col("n") + low), _bound(F.col("n") + high))
    keyed = F.flatten(
        F.transform(
            bounds,
            lambda k: F.transform(_part_keys(F.col("hashes"), k), lambda x: F.struct(k.alias("k"), x.alias("key"))),
        )
    )
    return sized.select(text, "tokens", "n", F.explode(F.array_distinct(keyed)).alias("_k")).select(
        text, "tokens", "n", "_k.k", "_k.key"
    )


def similar_texts(left: DataFrame, right: DataFrame, text: str = "address_normalized") -> DataFrame:
    """(l, r, score) of distinct texts with bigram Jaccard of at least 0.85, equal texts included.

    Equal texts never enter the candidate join: they are an equality join of their own. Both
    joins read the distinct texts, so these are written once.
    """
    left, right = (materialise(side.select(text).where(F.col(text) != "").distinct()) for side in (left, right))
    a = similarity_keys(left, text).select(F.col(text).alias("l"), F.col("tokens").alias("lt"), F.col("n").alias("ln"), "k", "key")
    b = similarity_keys(right, text).select(F.col(text).alias("r"), F.col("tokens").alias("rt"), F.col("n").alias("rn"), "k", "key")
    shared = F.size(F.array_intersect("lt", "rt"))
    union = F.col("ln") + F.col("rn") - shared
    candidates = a.join(b, ["k", "key"]).where(
        (F.col("l") != F.col("r")) & (_bound(F.col("ln") + F.col("rn")) == F.col("k"))
    )
    verified = candidates.withColumn("score", shared.cast("double") / union).where(F.col("score") >= SIMILARITY)
    # a pair can meet under several keys; one row per pair, combined map-side
    near = verified.groupBy("l", "r").agg(F.first("score").alias("score"))
    equal = (
        left.select(F.col(text).alias("l"))
        .join(right.select(F.col(text).alias("r")), F.col("l") == F.col("r"))
        .select("l", "r", F.lit(1.0).alias("score"))
    )
    return near.unionByName(equal)


def match_similar(listings: DataFrame, properties: DataFrame) -> DataFrame:
    """Tier 2: (key, match_id, score); best score, then lowest id.

    A candidate's written address must hold the listing's municipality. Listings and properties
    meet as distinct (address, municipality) and (normalised, written) texts. The listings are
    read three times and the written addresses twice, so both are written out: a normalised
    address is spelled out once a row.
    """
    named = listings.where(F.col("municipality").isNotNull() & (F.col("municipality") != ""))
    # empty texts are left out where the tables are read: ahead of that the filter would spell every text out twice
    asked = materialise(named.select("key", "address_normalized", "municipality")).where(F.col("address_normalized") != "")
    wanted = asked.select(F.col("address_normalized").alias("l"), "municipality").distinct()
    store = properties.groupBy("address_normalized", "address_ja").agg(F.min("id").alias("id"))
    written = materialise(store.withColumnRenamed("address_normalized", "r")).where(F.col("r") != "")
    pairs = similar_texts(asked, written.select(F.col("r").alias("address_normalized")))
    hits = pairs.join(wanted, "l").join(written, "r").where(F.contains("address_ja", "municipality"))
    best = hits.groupBy("l", "municipality").agg(
        F.min_by(F.struct("id", "score"), F.struct((-F.col("score")).alias("s"), "id")).alias("_b")
    )
    best = best.select(
        F.col("l").alias("address_normalized"), "municipality", F.col("_b.id").alias("match_id"), F.col("_b.score").alias("score")
    )
    return asked.join(best, ["address_normalized", "municipality"]).select("key", "match_id", "score")


# --- tier 3: nearby points ----------------------------------------------------

HOT_CELL = 256
FINE = 8


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("bigint")


def _neighbours(lat: str, lng: str, lat_size: float, lng_size: float) -> Column:
    """The 3 × 3 cells around a point, as array of struct(cy, cx)."""
    offsets = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return F.array(
        *[
            F.struct((_cell(F.col(lat), lat_size) + dy).alias("cy"), (_cell(F.col(lng), lng_size) + dx).alias("cx"))
            for dy, dx in offsets
        ]
    )


def _near(prefix_a: str, prefix_b: str, box: float, meters: float) -> Column:
    la, ga, lb, gb = (F.col(f"{p}{c}") for p in (prefix_a, prefix_b) for c in ("lat", "lng"))
    # the box is a filter of its own: it clips the circle east and west
    return (
        lb.between(la - F.lit(box), la + F.lit(box))
        & gb.between(ga - F.lit(box), ga + F.lit(box))
        & (haversine_m(la, ga, lb, gb) <= F.lit(meters))
    )


def first_within(
    left: DataFrame, right: DataFrame, box: float = BOX_DEGREES, meters: float = MATCH_METERS, hot_cell: int = HOT_CELL
) -> DataFrame:
    """For each point of left(key, lat, lng) the lowest id of right(id, lat, lng) within reach.

    Points meet by grid cell. A cell of the right side with up to ``hot_cell`` distinct points is
    compared point by point, which bounds the work per left point. A fuller cell is cut into fine
    cells: a fine cell wholly in reach answers with its lowest id, and only fine cells on the rim
    whose lowest id beats that answer are opened.
    """
    points = left.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng")
    ).distinct()
    store = (
        right.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .groupBy(F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
        .agg(F.min("id").alias("id"))
        .withColumns({"cy": _cell(F.col("b_lat"), box), "cx": _cell(F.col("b_lng"), box)})
    )
    # both are read several times below: computed once, on shared storage
    store = materialise(store)
    crowded = materialise(store.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_cell).drop("_n"))
    asked = points.withColumn("_c", F.explode(_neighbours("a_lat", "a_lng", box, box))).select("a_lat", "a_lng", "_c.*")

    def one_by_one(cells: DataFrame) -> DataFrame:
        return asked.join(cells, ["cy", "cx"]).where(_near("a_", "b_", box, meters)).select("a_lat", "a_lng", "id")

    if crowded.isEmpty():
        candidates = one_by_one(store)
    else:
        dense = _first_in_crowd(asked.join(crowded, ["cy", "cx"]), store.join(crowded, ["cy", "cx"]), box, meters)
        candidates = one_by_one(store.join(crowded, ["cy", "cx"], "left_anti")).unionByName(dense)
    found = candidates.groupBy("a_lat", "a_lng").agg(F.min("id").alias("match_id"))
    return left.select("key", "lat", "lng").join(
        found, (F.col("lat") == F.col("a_lat")) & (F.col("lng") == F.col("a_lng"))
    ).select("key", "match_id")


def _first_in_crowd(asked: DataFrame, store: DataFrame, box: float, meters: float) -> DataFrame:
    """Candidates (a_lat, a_lng, id) from crowded cells, given as (cy, cx, point) on both sides."""
    fine = box / FINE

    def fine_cells(points: DataFrame, prefix: str) -> DataFrame:
        lat, lng = F.col(f"{prefix}lat"), F.col(f"{prefix}lng")
        return points.withColumns({f"{prefix}fy": _cell(lat, fine), f"{prefix}fx": _cell(lng, fine)})

    def extents(points: DataFrame, prefix: str, *more: Column) -> DataFrame:
        lat, lng = f"{prefix}lat", f"{prefix}lng"
        return points.groupBy("cy", "cx", f"{prefix}fy", f"{prefix}fx").agg(
            F.min(lat).alias(f"{prefix}s"), F.max(lat).alias(f"{prefix}n"),
            F.min(lng).alias(f"{prefix}w"), F.max(lng).alias(f"{prefix}e"), *more,
        )

    a, b = fine_cells(asked, "a_"), fine_cells(store, "b_")
    boxes_a, boxes_b = extents(a, "a_"), extents(b, "b_", F.min("id").alias("low"))
    c = F.col
    # at most (3*FINE)^2 by FINE^2 box pairs per crowded cell
    pairs = boxes_a.join(boxes_b, ["cy", "cx"])
    far_y = F.greatest(c("a_n") - c("b_s"), c("b_n") - c("a_s"))
    far_x = F.greatest(c("a_e") - c("b_w"), c("b_e") - c("a_w"))
    gap_y = F.greatest(c("a_s") - c("b_n"), c("b_s") - c("a_n"), F.lit(0.0))
    gap_x = F.greatest(c("a_w") - c("b_e"), c("b_w") - c("a_e"), F.lit(0.0))
    # the parallel closest to the equator gives the longest east-west distance
    low_lat = F.least(F.abs("a_s"), F.abs("a_n"), F.abs("b_s"), F.abs("b_n"))
    longest = F.sqrt(F.pow(far_y, 2) + F.pow(far_x * F.cos(F.radians(low_lat)), 2)) * F.lit(111_194.9266446)
    slack = F.lit(1e-12)
    inside = (far_y <= F.lit(box) - slack) & (far_x <= F.lit(box) - slack) & (longest <= F.lit(meters - 0.01))
    reach = (gap_y <= F.lit(box) + slack) & (gap_x <= F.lit(box) + slack)
    pairs = pairs.where(reach).withColumn("inside", inside)
    area = ["cy", "cx", "a_fy", "a_fx"]
    answer = pairs.where("inside").groupBy(*area).agg(F.min("low").alias("best"))
    rim = pairs.where(~c("inside")).select(*area, "b_fy", "b_fx", "low").join(answer, area, "left")
    rim = rim.where(c("best").isNull() | (c("low") < c("best")))
    opened = (
        a.join(rim, area)
        .join(b, ["cy", "cx", "b_fy", "b_fx"])
        .where((c("best").isNull() | (c("id") < c("best"))) & _near("a_", "b_", box, meters))
        .select("a_lat", "a_lng", "id")
    )
    settled = a.join(answer, area).select("a_lat", "a_lng", F.col("best").alias("id"))
    return settled.unionByName(opened)


def features_within(points: DataFrame, features: DataFrame, radius_m: float, folds: list[Column]) -> DataFrame:
    """Fold the features within ``radius_m`` of each distinct point.

    The folds must not mind repeats (max, or): features are first made distinct. Grid cells are as
    wide as the radius at 46° north, the widest they need to be in Japan.
    """
    import math

    lat_size = radius_m / 111_194.9266446 * 1.0001
    lng_size = lat_size / math.cos(math.radians(46.0))
    wanted = points.select(F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng")).distinct().withColumns(
        {"cy": _cell(F.col("a_lat"), lat_size), "cx": _cell(F.col("a_lng"), lng_size)}
    )
    spread = (
        features.distinct()
        .withColumnsRenamed({"lat": "b_lat", "lng": "b_lng"})
        .withColumn("_c", F.explode(_neighbours("b_lat", "b_lng", lat_size, lng_size)))
        .select("*", "_c.*")
        .drop("_c")
    )
    close = haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")) <= F.lit(radius_m)
    # the planner does not see that features are nine times as many: both sides are shuffled, never sent whole to everyone
    return wanted.join(spread.hint("merge"), ["cy", "cx"]).where(close).groupBy(
        F.col("a_lat").alias("lat"), F.col("a_lng").alias("lng")
    ).agg(*folds)


# --- cascade ------------------------------------------------------------------


def match_cascade(listings: DataFrame, properties: DataFrame) -> DataFrame:
    """(key, match_id, tier, score): the first tier that finds a property for each listing.

    listings(key, address_normalized, municipality, lat, lng); later tiers see only what the
    earlier ones left over. Each tier is written out: two later steps read it. So are the inputs,
    which every tier reads: an address is normalised once.
    """
    none = F.lit(None).cast("double")
    listings = materialise(listings.select("key", "address_normalized", "municipality", "lat", "lng"))
    properties = materialise(properties.select("id", "address_ja", "address_normalized", "lat", "lng"))
    t1 = materialise(
        match_normalized(listings.where(F.col("address_normalized") != ""), properties).select(
            "key", "match_id", F.lit(1).alias("tier"), none.alias("score")
        )
    )
    rest = materialise(listings.join(t1.select("key"), "key", "left_anti"))
    t2 = materialise(match_similar(rest, properties).select("key", "match_id", F.lit(2).alias("tier"), "score"))
    rest = rest.join(t2.select("key"), "key", "left_anti")
    t3 = first_within(rest, properties).select("key", "match_id", F.lit(3).alias("tier"), none.alias("score"))
    return t1.unionByName(t2).unionByName(t3)
