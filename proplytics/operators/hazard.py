"""Hazard assessment: landed API responses and map tiles joined onto properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplytics.functions.geo import TILE_ZOOM, mesh_code, tile_x, tile_y
from proplytics.functions.numbers import round_exact
from proplytics.sources.feeds import FEATURE_COLLECTION

# JMA intensity levels and the property names that carry them
INTENSITIES = ["I45", "I50", "I55", "I60", "I65"]
PGA_KEYS = ["PGA_475", "PGA", "AVS", "ARV"]
VS30_KEYS = ["AVS", "VS30", "J_AVS"]
RISK_KEYS = ["risk", "rank", "R"]

# Provenance notes per source
PROVENANCE = {
    "seismic": "J-SHIS pshm",
    "avg_hazard": "J-SHIS avghazard",
    "landslide_jshis": "J-SHIS landslide",
    "landslide_prevention_reinfolib": "reinfolib XKT021",
    "steep_slope_reinfolib": "reinfolib XKT022",
    "flood": "GSI disaportal flood",
    "disaster_zone_reinfolib": "reinfolib XKT016",
    "tsunami": "GSI disaportal tsunami",
}


def first_properties(body: Column) -> Column:
    """Properties map of the first feature of a response body; null without one."""
    features = F.from_json(body, FEATURE_COLLECTION)["features"]
    return F.get(features, F.lit(0))["properties"]


def probe(properties: Column, key: str) -> Column:
    return F.try_element_at(properties, F.lit(key))


NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def to_number(text: Column) -> Column:
    """Number of a text, null for anything else; the check first, since a failing cast is slow."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def first_number(properties: Column, keys: list[str]) -> Column:
    """First of the keys whose value is a number."""
    return F.coalesce(*[to_number(probe(properties, k)) for k in keys])


def intensity_probabilities(properties: Column) -> Column:
    """Level → 30-year exceedance probability; an unreadable value is null, an absent one has no entry."""
    entries = F.array(
        *[
            F.struct(F.lit(level).alias("key"), F.coalesce(probe(properties, f"T30_{level}_P"), probe(properties, f"P_{level}_T30")).alias("value"))
            for level in INTENSITIES
        ]
    )
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    numbers = F.transform(present, lambda e: F.struct(e["key"].alias("key"), to_number(e["value"]).alias("value")))
    return F.map_from_entries(numbers)


def pga(properties: Column) -> Column:
    return round_exact(first_number(properties, PGA_KEYS), 2)


def liquefaction(properties: Column) -> Column:
    """Susceptibility from the shear wave velocity: the first non-empty key decides."""

    def filled(key: str) -> Column:
        text = probe(properties, key)
        return F.when((text != "") & ~text.rlike(r"^0(\.0*)?$"), text)

    vs30 = to_number(F.coalesce(*[filled(k) for k in VS30_KEYS]))
    return F.when(vs30 < 150, "high").when(vs30 < 250, "medium").when(vs30 < 400, "low").when(vs30.isNotNull(), "very_low")


def risk_class(top: Column) -> Column:
    return F.when(top >= 4, "very_high").when(top >= 3, "high").when(top >= 2, "medium").otherwise("low")


def whole_number(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[-+]?\d+\s*$"), text.try_cast("int"))


def _risk_value(properties: Column) -> Column:
    raw = F.coalesce(*[F.nullif(probe(properties, k), F.lit("")) for k in RISK_KEYS])
    return whole_number(raw)


def is_steep(kind: Column, name: Column) -> Column:
    return F.coalesce(F.lower(kind).contains("steep"), F.lit(False)) | F.coalesce(name.contains("急傾斜"), F.lit(False))


def is_landslide(kind: Column, name: Column) -> Column:
    return F.coalesce(F.lower(kind).contains("landslide"), F.lit(False)) | F.coalesce(name.contains("地すべり"), F.lit(False))


def landslide_folds() -> list[Column]:
    """Aggregates over exploded features(type, name, risk): class and the two zone flags."""
    kind, name = F.col("type"), F.col("name")
    top = F.greatest(F.max(whole_number(F.col("risk"))), F.lit(1))
    return [
        risk_class(top).alias("landslide_risk"),
        F.bool_or(is_steep(kind, name)).alias("steep_slope_zone"),
        F.bool_or(is_landslide(kind, name)).alias("landslide_prevention_zone"),
    ]


def landslide_by_property(features: DataFrame) -> DataFrame:
    """Folded features per property; partial aggregates make a crowded property cheap."""
    return features.groupBy("property_id").agg(*landslide_folds())


def feature_properties(body: Column) -> Column:
    """Properties map of every feature of a response body; empty without features, null without a body."""
    features = F.from_json(body, FEATURE_COLLECTION)["features"]
    none = F.array().cast("array<map<string,string>>")
    return F.when(body.isNotNull(), F.coalesce(F.transform(features, lambda f: f["properties"]), none))


def landslide_of(props: Column) -> Column:
    """The same fold inside one response: struct(risk, steep, prevention); null without a response.

    ``props`` is a column of feature_properties, computed once before the three folds read it. No
    shuffle: the features of a response are one array of the row.
    """
    top = F.array_max(F.transform(props, _risk_value))
    steep = F.exists(props, lambda p: is_steep(probe(p, "type"), probe(p, "name")))
    slide = F.exists(props, lambda p: is_landslide(probe(p, "type"), probe(p, "name")))
    risk = risk_class(F.greatest(top, F.lit(1)))
    return F.when(props.isNotNull(), F.struct(risk.alias("risk"), steep.alias("steep"), slide.alias("prevention")))


def tile_layers(tiles: DataFrame, zoom: int = TILE_ZOOM) -> DataFrame:
    """One row per tile with a flag per layer the assessment uses."""

    def has(layer: str) -> Column:
        return F.bool_or((F.col("layer") == layer) & F.col("present")).alias(f"has_{layer}")

    layers = ["flood", "tsunami", "disaster_zone", "landslide_prevention", "steep_slope_zone"]
    return (
        tiles.where((F.col("z") == zoom) & F.col("layer").isin(layers))
        .groupBy(F.col("x").alias("tile_x"), F.col("y").alias("tile_y"))
        .agg(*[has(layer) for layer in layers])
    )


def with_tiles(properties: DataFrame, tiles: DataFrame) -> DataFrame:
    """Properties with their tile's flags. Tiles are unique per key, so a hot tile splits freely."""
    keyed = properties.withColumns({"tile_x": tile_x(F.col("lng")), "tile_y": tile_y(F.col("lat"))})
    joined = keyed.join(tile_layers(tiles), ["tile_x", "tile_y"], "left")
    flags = [c for c in joined.columns if c.startswith("has_")]
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags})


def read_responses(responses: DataFrame) -> DataFrame:
    """What the assessment needs of each response(property_id, kind, body), a failed feed null.

    ``fetched_at`` says which of several responses is the latest; where the feed has none, and for ties, the body decides.

    Bodies are read where they lie, before anything is shuffled: a few values travel, not the JSON.
    """
    c = F.col
    body, kind = c("body"), c("kind")
    fetched = F.unix_micros(c("fetched_at").cast("timestamp")) if "fetched_at" in responses.columns else F.lit(0).cast("bigint")
    parsed = responses.select(
        "property_id",
        "kind",
        F.struct(fetched.alias("at"), F.xxhash64(body).alias("tie")).alias("_order"),
        body.isNotNull().alias("_ok"),
        F.when(kind != "landslide", first_properties(body)).alias("_first"),
        F.when(kind == "landslide", feature_properties(body)).alias("_props"),
    )
    no_levels = F.create_map().cast("map<string,double>")
    seismic, average = kind == "pshm", kind == "avghazard"
    return parsed.select(
        "property_id",
        "_order",
        F.when(seismic & c("_ok"), F.coalesce(intensity_probabilities(c("_first")), no_levels)).alias("seismic_intensity_prob"),
        F.when(average, pga(c("_first"))).alias("pga_475yr"),
        F.when(average, liquefaction(c("_first"))).alias("liquefaction_risk"),
        F.when(average & c("_ok"), F.lit(True)).alias("has_average"),
        landslide_of(c("_props")).alias("_slide"),
    )


def responses_by_property(responses: DataFrame) -> DataFrame:
    """The values of all feeds of a property side by side, each from the latest response that has it."""
    rows = read_responses(responses)
    values = [c for c in rows.columns if c not in ("property_id", "_order")]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in values]
    return rows.groupBy("property_id").agg(*latest)


def unassessed(properties: DataFrame, assessments: DataFrame) -> DataFrame:
    """Located properties without an assessment."""
    located = properties.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return located.join(assessments.select(F.col("property_id").alias("id")), "id", "left_anti")


def assess(properties: DataFrame, responses: DataFrame, tiles: DataFrame) -> DataFrame:
    """One assessment row per located property: two left joins, then column logic."""
    located = properties.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("id", "lat", "lng")
    feeds = responses_by_property(responses).withColumnRenamed("property_id", "id")
    rows = with_tiles(located, tiles).join(feeds, "id", "left")
    c = F.col
    have = {
        "seismic": c("seismic_intensity_prob").isNotNull(),
        "avg_hazard": c("has_average"),
        "landslide_jshis": c("_slide").isNotNull(),
        "landslide_prevention_reinfolib": c("has_landslide_prevention"),
        "steep_slope_reinfolib": c("has_steep_slope_zone"),
        "flood": c("has_flood"),
        "disaster_zone_reinfolib": c("has_disaster_zone"),
        "tsunami": c("has_tsunami"),
    }
    sources = F.map_filter(
        F.create_map(*[x for n, on in have.items() for x in (F.lit(n), F.when(on, F.lit(PROVENANCE[n])))]),
        lambda _, note: note.isNotNull(),
    )
    no_slide = F.lit(False)
    return rows.select(
        F.col("id").alias("property_id"),
        mesh_code(c("lat"), c("lng"), 3).alias("mesh_code"),
        "seismic_intensity_prob",
        "pga_475yr",
        "liquefaction_risk",
        F.when(c("has_flood"), F.lit(0.5)).alias("flood_depth_max_m"),
        F.when(c("has_flood"), "flood_risk_area").when(c("has_disaster_zone"), "disaster_risk_zone").alias("flood_zone"),
        F.when(c("has_tsunami"), "medium").alias("tsunami_risk"),
        F.when(c("has_tsunami"), F.lit(1.0)).alias("tsunami_depth_max_m"),
        c("_slide")["risk"].alias("landslide_risk"),
        (c("has_steep_slope_zone") | F.coalesce(c("_slide")["steep"], no_slide)).alias("steep_slope_zone"),
        (c("has_landslide_prevention") | F.coalesce(c("_slide")["prevention"], no_slide)).alias("landslide_prevention_zone"),
        sources.alias("data_sources"),
    )


def put_assessments(current: DataFrame, delta: DataFrame) -> DataFrame:
    """One row per property; a new assessment replaces the old one whole."""
    kept = current.join(delta.select("property_id"), "property_id", "left_anti")
    return kept.unionByName(delta)


def by_mesh(properties: DataFrame, table: DataFrame, level: int = 3) -> DataFrame:
    """Join a table keyed by grid code onto located properties."""
    located = properties.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    keyed = located.withColumn("mesh_code", mesh_code(F.col("lat"), F.col("lng"), level))
    return keyed.join(table, "mesh_code", "left")
