"""Six-dimension investment score of a property."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplytics.functions import text as T
from proplytics.functions.numbers import REFERENCE_YEAR, clamp, round_exact

SCORING_VERSION = "1.0"

# Weights of the dimensions
WEIGHTS = {
    "rebuild": 0.25,
    "hazard": 0.20,
    "infrastructure": 0.15,
    "demographic": 0.15,
    "value": 0.15,
    "condition": 0.10,
}

# Use zones
RESIDENTIAL_ZONES = [
    "第一種低層住居専用地域",
    "第二種低層住居専用地域",
    "第一種中高層住居専用地域",
    "第二種中高層住居専用地域",
    "第一種住居地域",
    "第二種住居地域",
    "準住居地域",
    "田園住居地域",
]
COMMERCIAL_ZONES = ["近隣商業地域", "商業地域"]

# Useful life by words of the structure text; the first group that matches wins
STRUCTURE_LIFE = [
    (47, ["鉄筋コンクリート", "rc", "src", "鉄骨鉄筋"]),
    (27, ["軽量鉄骨", "light steel", "light-steel"]),
    (34, ["重量鉄骨", "鉄骨造", "steel"]),
]
WOOD_LIFE = 22


def steps(value: Column, bounds: list[tuple[float, float]], above: float) -> Column:
    """Points of the first bound that ``value`` lies below, else ``above``."""
    result = None
    for bound, points in bounds:
        hit, out = value < bound, F.lit(float(points))
        result = F.when(hit, out) if result is None else result.when(hit, out)
    return result.otherwise(F.lit(float(above)))


def useful_life(structure: Column) -> Column:
    text, result = F.lower(F.coalesce(structure, F.lit(""))), None
    for years, words in STRUCTURE_LIFE:
        hit = text.rlike("|".join(words))
        result = F.when(hit, years) if result is None else result.when(hit, years)
    return result.otherwise(WOOD_LIFE)


def score_rebuild(rebuild: Column, road_width: Column, frontage: Column, zone: Column) -> Column:
    """Zero when known impossible; else road, frontage and zone around a base of 80 or 50."""
    base = F.when(rebuild, 80.0).otherwise(50.0)
    road = (
        F.when(road_width.isNull(), -10.0).when(road_width >= 4.0, 20.0).when(road_width >= 3.0, 10.0).otherwise(0.0)
    )
    front = F.when(frontage.isNull(), -10.0).when(frontage >= 2.0, 20.0).otherwise(0.0)
    zoning = F.when(zone.isin(RESIDENTIAL_ZONES), 5.0).when(zone.isin(COMMERCIAL_ZONES), 3.0).otherwise(0.0)
    return F.when(rebuild == F.lit(False), F.lit(0.0)).otherwise(clamp(base + road + front + zoning))


def depth_points(depth: Column) -> Column:
    """Water depth, flood and tsunami alike."""
    points = steps(depth, [(0.5, 20), (1.0, 15), (3.0, 5)], 0)
    return F.when(depth.isNull(), 12.5).when(depth <= 0.0, 25.0).otherwise(points)


def pga_points(pga: Column) -> Column:
    return F.when(pga.isNull(), 12.5).otherwise(steps(pga, [(1.5, 25), (2.0, 20), (2.5, 15)], 5))


def landslide_points(risk: Column) -> Column:
    label = F.lower(risk)
    return (
        F.when(label.isin("low", "none"), 25.0)
        .when(label == "medium", 15.0)
        .when(label == "high", 5.0)
        .when(label == "very_high", 0.0)
        .otherwise(12.5)
    )


def score_hazard(assessed: Column, flood: Column, pga: Column, landslide: Column, tsunami: Column) -> Column:
    """Inverted risk, 25 points per peril; neutral 50 when there is no assessment."""
    total = depth_points(flood) + pga_points(pga) + landslide_points(landslide) + depth_points(tsunami)
    return F.when(assessed, clamp(total)).otherwise(F.lit(50.0))


def rooms(floor_plan: Column) -> Column:
    """Rooms of a plan such as 3LDK. No match is made null before the cast: a failing cast is slow."""
    return T.first_group(floor_plan, r"(?i)(\d+)\s*[SLDK]+").try_cast("int")


def score_infrastructure(lat: Column, lng: Column, zone: Column, floor_plan: Column, room_count: Column) -> Column:
    zoning = F.when(zone.isin(COMMERCIAL_ZONES), 20.0).when(zone.isin(RESIDENTIAL_ZONES), 10.0).otherwise(0.0)
    room_points = F.when(room_count >= 4, 15.0).when(room_count >= 3, 10.0).when(room_count >= 2, 5.0).otherwise(0.0)
    ldk = F.when(F.lower(floor_plan).contains("ldk"), 5.0).otherwise(0.0)
    located = lat.isNotNull() & lng.isNotNull()
    return F.when(located, clamp(F.lit(50.0) + zoning + room_points + ldk)).otherwise(F.lit(50.0))


def score_demographic() -> Column:
    return F.lit(50.0)


def score_value(price: Column, land_area: Column) -> Column:
    per_sqm = F.try_divide(price.cast("double"), land_area)
    known = price.isNotNull() & land_area.isNotNull() & (land_area > 0)
    points = steps(per_sqm, [(10_000, 90), (20_000, 80), (50_000, 70), (100_000, 50)], 30)
    return F.when(known, points).otherwise(F.lit(50.0))


def score_condition(year_built: Column, life: Column, as_of_year: int = REFERENCE_YEAR) -> Column:
    age = F.greatest(F.lit(0), F.lit(as_of_year) - year_built)
    remaining = F.greatest(F.lit(0.0), (life - age).cast("double") / life)
    return F.when(year_built.isNull(), F.lit(40.0)).otherwise(clamp(remaining * F.lit(70.0) + F.lit(30.0)))


def composite(weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the six unrounded dimension columns."""
    weights = weights or WEIGHTS
    total = None
    for name, weight in weights.items():
        term = F.col(f"{name}_score") * F.lit(weight)
        total = term if total is None else total + term
    return round_exact(clamp(total), 2)


def latest_scores(versions: DataFrame) -> DataFrame:
    """(property_id, version, composite) of the last version; of equal versions the higher composite.

    Two numbers of fixed width are folded, so rows combine by hash before they are shuffled.
    """
    last = versions.groupBy("property_id").agg(F.max("version").alias("version"))
    return versions.join(last, ["property_id", "version"]).groupBy("property_id", "version").agg(F.max("composite").alias("composite"))


def with_scores(
    properties: DataFrame, hazards: DataFrame, weights: dict[str, float] | None = None, as_of_year: int = REFERENCE_YEAR
) -> DataFrame:
    """``properties`` with the six scores and the composite: a single left join on the property id, then arithmetic.

    What a side can tell alone is reckoned before the join, so that numbers are shuffled and sorted instead of texts.
    """
    c = F.col
    peril = score_hazard(F.lit(True), c("flood_depth_max_m"), c("pga_475yr"), c("landslide_risk"), c("tsunami_depth_max_m"))
    h = hazards.select(c("property_id").alias("id"), peril.alias("_hazard"))
    dims = {
        "rebuild": score_rebuild(c("rebuild_possible"), c("road_width_m"), c("road_frontage_m"), c("use_zone")),
        "infrastructure": score_infrastructure(c("lat"), c("lng"), c("use_zone"), c("floor_plan"), c("_rooms")),
        "value": score_value(c("price_jpy"), c("land_area_sqm")),
        "condition": score_condition(c("year_built"), c("_life"), as_of_year),
    }
    # what several branches below read is computed once per row
    alone = properties.withColumns({"_rooms": rooms(c("floor_plan")), "_life": useful_life(c("structure"))})
    alone = alone.select(*properties.columns, *[e.alias(f"{n}_score") for n, e in dims.items()])
    # a property that was not assessed has the neutral score
    unknown = score_hazard(F.lit(False), *[F.lit(None).cast("double")] * 2, F.lit(None).cast("string"), F.lit(None).cast("double"))
    scored = (
        alone.join(h, "id", "left")
        .withColumns({"hazard_score": F.coalesce("_hazard", unknown), "demographic_score": score_demographic()})
        .withColumn("composite_score", composite(weights))
    )
    return scored.select(
        *properties.columns,
        *[round_exact(F.col(f"{n}_score"), 2).alias(f"{n}_score") for n in WEIGHTS],
        "composite_score",
        F.lit(SCORING_VERSION).alias("scoring_version"),
    )


def score_properties(
    properties: DataFrame, hazards: DataFrame, weights: dict[str, float] | None = None, as_of_year: int = REFERENCE_YEAR
) -> DataFrame:
    """One score row per property."""
    scored = with_scores(properties, hazards, weights, as_of_year)
    names = [c for c in scored.columns if c not in properties.columns]
    return scored.select(F.col("id").alias("property_id"), *names)


def unscored(properties: DataFrame, scores: DataFrame, version: str = SCORING_VERSION) -> DataFrame:
    """Active properties without a score of this version."""
    done = scores.where(F.col("scoring_version") == version).select(F.col("property_id").alias("id"))
    return properties.where(F.col("status") == "active").join(done, "id", "left_anti")


def score_unscored(
    properties: DataFrame, hazards: DataFrame, scores: DataFrame, as_of_year: int = REFERENCE_YEAR
) -> DataFrame:
    return score_properties(unscored(properties, scores), hazards, as_of_year=as_of_year)


def weighted_mean_nonzero(terms: dict[str, Column]) -> Column:
    """Σ w·s / Σ w over the terms above zero; 0 when there are none."""
    weight_sum = value_sum = F.lit(0.0)
    for name, score in terms.items():
        on = F.coalesce(score, F.lit(0.0)) > 0
        weight_sum = weight_sum + F.when(on, F.lit(WEIGHTS[name])).otherwise(0.0)
        value_sum = value_sum + F.when(on, score * F.lit(WEIGHTS[name])).otherwise(0.0)
    return F.coalesce(F.try_divide(value_sum, F.nullif(weight_sum, F.lit(0.0))), F.lit(0.0))


def stub_scores(listings: DataFrame, as_of_year: int = REFERENCE_YEAR) -> DataFrame:
    """Score at ingest, from the listing alone; its thresholds are not those of the engine."""
    c = F.col
    per_sqm = F.try_divide(c("price").cast("double"), c("land_area_sqm"))
    priced = (c("price") != 0) & (c("land_area_sqm") > 0)
    age = F.lit(as_of_year) - c("year_built")
    age_points = F.when(age <= 5, 90.0).when(age <= 15, 70.0).when(age <= 30, 50.0).when(age <= 50, 30.0).otherwise(15.0)
    base = F.when(c("rebuild_possible"), 80.0).otherwise(20.0)
    road = F.when(c("road_width_m") >= 4.0, F.least(F.lit(100.0), base + 15.0)).otherwise(base)
    value_points = steps(per_sqm, [(10_000, 95), (30_000, 80), (60_000, 60), (100_000, 40)], 20)
    out = listings.withColumns(
        {
            "rebuild_score": F.when(c("rebuild_possible").isNotNull(), road).otherwise(0.0),
            "hazard_score": F.lit(0.0),
            "infrastructure_score": F.lit(0.0),
            "demographic_score": F.lit(0.0),
            "value_score": F.when(priced, value_points).otherwise(0.0),
            "condition_score": F.when(c("year_built") != 0, age_points).otherwise(0.0),
        }
    )
    mean = weighted_mean_nonzero({n: F.col(f"{n}_score") for n in WEIGHTS})
    return out.withColumns({"composite_score": mean, "scoring_version": F.lit("stub")})
