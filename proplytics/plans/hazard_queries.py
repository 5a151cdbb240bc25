"""Queries: grid codes, tiles, feeds and hazard assessments."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplytics.functions import geo
from proplytics.operators import hazard, match
from proplytics.plans.registry import query
from proplytics.plans.twins import over
from proplytics.sources import feeds
from proplytics.sources.views import bind, with_views

LOCATED = "lat IS NOT NULL AND lng IS NOT NULL"


def _t(e: str) -> str:
    return f"CAST(trunc({e}) AS INT)"


# the grid code written as nested selects, one reduction per level
MESH = f"""mesh AS (SELECT *, concat(lpad(p::VARCHAR, 2, '0'), lpad(u::VARCHAR, 2, '0')) AS m1,
 concat(lpad(p::VARCHAR, 2, '0'), lpad(u::VARCHAR, 2, '0'), q, v) AS m2,
 concat(lpad(p::VARCHAR, 2, '0'), lpad(u::VARCHAR, 2, '0'), q, v, r, w) AS m3,
 concat(lpad(p::VARCHAR, 2, '0'), lpad(u::VARCHAR, 2, '0'), q, v, r, w,
  CASE WHEN a2 * 60::DOUBLE - r * 30::DOUBLE < 15 THEN 0 ELSE 2 END + CASE WHEN b2 * 3600::DOUBLE - w * 45::DOUBLE < 22.5 THEN 0 ELSE 1 END + 1) AS m4 FROM (
 SELECT *, {_t('a2 * 60::DOUBLE / 30::DOUBLE')} AS r, {_t('b2 * 3600::DOUBLE / 45::DOUBLE')} AS w FROM (
  SELECT *, a - q * 5::DOUBLE AS a2, b - v * 7.5::DOUBLE / 60::DOUBLE AS b2 FROM (
   SELECT *, {_t('a / 5::DOUBLE')} AS q, {_t('b * 60::DOUBLE / 7.5::DOUBLE')} AS v FROM (
    SELECT *, lat * 60::DOUBLE - p * 40::DOUBLE AS a, lng - 100::DOUBLE - u AS b FROM (
     SELECT id, lat, lng, {_t('lat * 60::DOUBLE / 40::DOUBLE')} AS p, {_t('lng - 100::DOUBLE')} AS u FROM properties WHERE {LOCATED}))))))"""


def _located(s):
    return s.properties.where(LOCATED).select("id", "lat", "lng")


@query("geo01_mesh_code", with_views("properties", extra=MESH) + "SELECT id, m1, m2, m3, m4 FROM mesh")
def _mesh(s):
    codes = [geo.mesh_code(F.col("lat"), F.col("lng"), level).alias(f"m{level}") for level in (1, 2, 3, 4)]
    return _located(s).select("id", *codes)


_DIGIT = "CAST(substring(m4, {i}, {n}) AS INT)"
_S3 = f"{_DIGIT.format(i=1, n=2)} * 40::DOUBLE / 60::DOUBLE + {_DIGIT.format(i=5, n=1)} * 5::DOUBLE / 60::DOUBLE + {_DIGIT.format(i=7, n=1)} * 30::DOUBLE / 3600::DOUBLE"
_W3 = f"({_DIGIT.format(i=3, n=2)} + 100)::DOUBLE + {_DIGIT.format(i=6, n=1)} * 7.5::DOUBLE / 60::DOUBLE + {_DIGIT.format(i=8, n=1)} * 45::DOUBLE / 3600::DOUBLE"
_HALF = _DIGIT.format(i=9, n=1)
_BOUNDS = f"""SELECT id, round(s, 9) AS south, round(s + 30::DOUBLE / 7200, 9) AS north, round(w, 9) AS west, round(w + 45::DOUBLE / 7200, 9) AS east,
 round(s + 30::DOUBLE / 14400, 9) AS center_lat, round(w + 45::DOUBLE / 14400, 9) AS center_lng, lat >= s - 1e-9 AND lat <= s + 30::DOUBLE / 7200 + 1e-9
 AND lng >= w - 1e-9 AND lng <= w + 45::DOUBLE / 7200 + 1e-9 AS holds
FROM (SELECT id, lat, lng, {_S3} + (({_HALF} - 1) // 2) * 30::DOUBLE / 7200 AS s, {_W3} + (({_HALF} - 1) % 2) * 45::DOUBLE / 7200 AS w FROM mesh)"""


@query("geo02_mesh_bounds", with_views("properties", extra=MESH) + _BOUNDS)
def _bounds(s):
    code = geo.mesh_code(F.col("lat"), F.col("lng"), 4)
    rows = _located(s).withColumn("code", code).withColumns(
        {"b": geo.mesh_bounds(F.col("code")), "c": geo.mesh_center(F.col("code"))}
    )
    eps = F.lit(1e-9)
    holds = F.col("lat").between(F.col("b.south") - eps, F.col("b.north") + eps) & F.col("lng").between(
        F.col("b.west") - eps, F.col("b.east") + eps
    )
    return rows.select(
        "id", *[F.round(F.col(f"b.{n}"), 9).alias(n) for n in ("south", "north", "west", "east")],
        F.round("c.lat", 9).alias("center_lat"), F.round("c.lng", 9).alias("center_lng"), holds.alias("holds"),
    )


@query(
    "geo03_mesh_center",
    with_views("properties", extra=MESH)
    + f"SELECT m3, count(*) AS n, round(any_value({_S3.replace('m4', 'm3')} + 30::DOUBLE / 7200), 9) AS lat, round(any_value({_W3.replace('m4', 'm3')} + 45::DOUBLE / 7200), 9) AS lng FROM mesh GROUP BY m3",
)
def _center(s):
    cells = _located(s).groupBy(geo.mesh_code(F.col("lat"), F.col("lng"), 3).alias("m3")).agg(F.count(F.lit(1)).alias("n"))
    center = geo.mesh_center(F.col("m3"))
    return cells.withColumn("c", center).select(
        "m3", "n", F.round("c.lat", 9).alias("lat"), F.round("c.lng", 9).alias("lng")
    )


_TX = _t("(lng + 180::DOUBLE) / 360::DOUBLE * 32768::DOUBLE")
_TY = _t("(1::DOUBLE - ln(tan(radians(lat)) + 1::DOUBLE / cos(radians(lat))) / pi()) / 2::DOUBLE * 32768::DOUBLE")


@query("geo04_tile", over("properties", sql=f"SELECT id, {_TX} AS x, {_TY} AS y FROM properties WHERE {LOCATED}"))
def _tile(s):
    return _located(s).select("id", geo.tile_x(F.col("lng")).alias("x"), geo.tile_y(F.col("lat")).alias("y"))


@query(
    "flt15_japan_box",
    over("properties", sql=f"""SELECT id, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lng END AS lng FROM (
 SELECT id, lat, lng, lat BETWEEN 24 AND 46 AND lng BETWEEN 122 AND 154 AS ok FROM (SELECT id, lat, lng * 1.1::DOUBLE AS lng FROM properties))"""),
)
def _japan(s):
    rows = s.properties.select("id", "lat", (F.col("lng") * F.lit(1.1)).alias("lng"))
    ok = geo.in_japan(F.col("lat"), F.col("lng"))
    return rows.select("id", F.when(ok, F.col("lat")).alias("lat"), F.when(ok, F.col("lng")).alias("lng"))


@query(
    "flt16_digit_code",
    over("incoming", sql="SELECT key, CASE WHEN regexp_matches(m, '^[0-9]+$') THEN m END AS code FROM (SELECT key, CASE WHEN key % 2 = 0 THEN CAST(key AS VARCHAR) ELSE municipality END AS m FROM incoming)"),
)
def _digits(s):
    from proplytics.operators.ingest import digit_code

    text = F.when(F.col("key") % 2 == 0, F.col("key").cast("string")).otherwise(F.col("municipality"))
    return s.incoming.select("key", digit_code(text).alias("code"))


# --- feeds ------------------------------------------------------------------

_RESPONSE = """SELECT l_suppkey % 5 + 2020 AS year, lpad(CAST(l_suppkey % 47 + 1 AS STRING), 2, '0') AS city, concat('{"status":"OK","data":[{"Type":"land","TradePrice":"',
 CAST(l_partkey * 1000 AS STRING), '","Area":"', CAST(l_linenumber * 10 AS STRING), '","BuildingYear":"', CAST(1950 + l_partkey % 70 AS STRING), '年","Period":"2023年第1四半期"},{"Type":"house","TradePrice":"n/a"}]}') AS body FROM lineitem"""


@query(
    "src04_transaction_feed",
    """SELECT year, city, property_type, count(*) AS n, count(trade_price) AS priced, CAST(sum(trade_price) AS BIGINT) AS total, CAST(sum(per) AS BIGINT) AS per_sqm, min(building_year) AS oldest FROM (
 SELECT l_suppkey % 5 + 2020 AS year, lpad(CAST(l_suppkey % 47 + 1 AS VARCHAR), 2, '0') AS city, 'land' AS property_type, l_partkey * 1000 AS trade_price,
  CAST(floor(l_partkey * 1000 / (l_linenumber * 10)::DOUBLE) AS BIGINT) AS per, CAST(1950 + l_partkey % 70 AS INT) AS building_year FROM lineitem
 UNION ALL SELECT l_suppkey % 5 + 2020, lpad(CAST(l_suppkey % 47 + 1 AS VARCHAR), 2, '0'), 'house', NULL, NULL, NULL FROM lineitem) GROUP BY ALL""",
)
def _transaction_feed(s):
    landed = bind(s.spark, _RESPONSE, lineitem=s.lineitem)
    return feeds.transactions(landed).groupBy("year", "city", "property_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("trade_price").alias("priced"), F.sum("trade_price").alias("total"),
        F.sum("price_per_sqm").alias("per_sqm"), F.min("building_year").alias("oldest"),
    )


@query(
    "src04_municipality_feed",
    """SELECT lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') AS prefecture_code, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code, n_name AS name_ja FROM nation""",
)
def _municipality_feed(s):
    body = F.to_json(
        F.struct(F.lit("OK").alias("status"), F.array(F.struct(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("id"), F.col("n_name").alias("name"))).alias("data"))
    )
    area = F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0")
    return feeds.municipalities(s.nation.select(area.alias("area"), body.alias("body")))


_F0 = "body::JSON->'$.features[0].properties'"


@query(
    "src05_geojson_features",
    over("hazard_responses", sql="""SELECT kind, count(*) AS responses, count(*) FILTER (body IS NULL) AS failed,
 CAST(sum(coalesce(json_array_length(body::JSON->'$.features'), 0)) AS BIGINT) AS features FROM hazard_responses GROUP BY kind"""),
)
def _features(s):
    parsed = feeds.features(s.hazard_responses)
    size = F.coalesce(F.size(F.col("features")), F.lit(0))
    return parsed.groupBy("kind").agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(F.col("features").isNull()).alias("failed"),
        F.sum(F.greatest(size, F.lit(0))).alias("features"),
    )


_TILE_PART = "regexp_extract(path, '([A-Za-z_]+)/(\\d+)/(\\d+)/(\\d+)\\.[a-z]+$', {n})"


@query(
    "src06_tile_presence",
    over("tile_files", sql=f"""SELECT {_TILE_PART.format(n=1)} AS layer, {_TILE_PART.format(n=2)}::INT AS z, {_TILE_PART.format(n=3)}::INT AS x,
 {_TILE_PART.format(n=4)}::INT AS y, length > 0 AS present FROM tile_files"""),
)
def _tiles(s):
    return feeds.tile_presence(s.tile_files)


@query(
    "src06_unknown_tiles",
    over("tile_files", sql="SELECT replace(path, 'storm_surge', 'lava') AS path FROM tile_files WHERE contains(path, '/storm_surge/')"),
)
def _unknown_tiles(s):
    """What goes to the quarantine when a layer arrives under a name that nobody knows."""
    return feeds.unknown_tiles(s.tile_files.withColumn("path", F.replace("path", F.lit("storm_surge"), F.lit("lava"))))


# --- parsing ----------------------------------------------------------------


def _level(level: str) -> str:
    return f"TRY_CAST(coalesce({_F0}->>'T30_{level}_P', {_F0}->>'P_{level}_T30') AS DOUBLE) AS {level.lower()}"


def _has(level: str) -> str:
    return f"CASE WHEN coalesce({_F0}->>'T30_{level}_P', {_F0}->>'P_{level}_T30') IS NULL THEN 0 ELSE 1 END"


@query(
    "haz01_intensity",
    over("hazard_responses", sql=f"""SELECT property_id, {', '.join(_level(i) for i in hazard.INTENSITIES)},
 CASE WHEN ({_F0}) IS NULL THEN NULL ELSE {' + '.join(_has(i) for i in hazard.INTENSITIES)} END::INT AS n_levels FROM hazard_responses WHERE kind = 'pshm'"""),
)
def _intensity(s):
    rows = s.hazard_responses.where("kind = 'pshm'")
    probs = rows.select("property_id", hazard.first_properties(F.col("body")).alias("p")).withColumn(
        "m", hazard.intensity_probabilities(F.col("p"))
    )
    return probs.select(
        "property_id", *[F.try_element_at("m", F.lit(i)).alias(i.lower()) for i in hazard.INTENSITIES],
        F.when(F.col("p").isNotNull(), F.size("m")).alias("n_levels"),
    )


def _pga_sql() -> str:
    tries = ", ".join(f"TRY_CAST({_F0}->>'{k}' AS DOUBLE)" for k in hazard.PGA_KEYS)
    return f"format('{{:.2f}}', coalesce({tries}))::DOUBLE"


def _vs_sql() -> str:
    first = ", ".join(f"nullif({_F0}->>'{k}', '')" for k in hazard.VS30_KEYS)
    vs = f"TRY_CAST(coalesce({first}) AS DOUBLE)"
    return f"CASE WHEN {vs} < 150 THEN 'high' WHEN {vs} < 250 THEN 'medium' WHEN {vs} < 400 THEN 'low' WHEN {vs} IS NOT NULL THEN 'very_low' END"


@query(
    "haz02_pga",
    over("hazard_responses", sql=f"SELECT property_id, {_pga_sql()} AS pga_475yr FROM hazard_responses WHERE kind = 'avghazard'"),
)
def _pga(s):
    rows = s.hazard_responses.where("kind = 'avghazard'")
    return rows.select("property_id", hazard.pga(hazard.first_properties(F.col("body"))).alias("pga_475yr"))


@query(
    "haz04_liquefaction",
    over("hazard_responses", sql=f"SELECT property_id, {_vs_sql()} AS liquefaction_risk FROM hazard_responses WHERE kind = 'avghazard'"),
)
def _liquefaction(s):
    rows = s.hazard_responses.where("kind = 'avghazard'")
    return rows.select("property_id", hazard.liquefaction(hazard.first_properties(F.col("body"))).alias("liquefaction_risk"))


_CLASS = "CASE WHEN {t} >= 4 THEN 'very_high' WHEN {t} >= 3 THEN 'high' WHEN {t} >= 2 THEN 'medium' ELSE 'low' END"
_STEEP = "coalesce(contains(lower({k}), 'steep'), FALSE) OR coalesce(contains({n}, '急傾斜'), FALSE)"
_SLIDE = "coalesce(contains(lower({k}), 'landslide'), FALSE) OR coalesce(contains({n}, '地すべり'), FALSE)"


def _fold(kind: str, name: str, risk: str) -> str:
    return f"""{_CLASS.format(t=f'max(TRY_CAST({risk} AS INT))')} AS landslide_risk, bool_or({_STEEP.format(k=kind, n=name)}) AS steep_slope_zone,
 bool_or({_SLIDE.format(k=kind, n=name)}) AS landslide_prevention_zone"""


@query(
    "agg17_landslide_fold",
    over("landslide_features", sql=f"SELECT property_id, {_fold('type', 'name', 'risk')} FROM landslide_features GROUP BY property_id"),
)
def _landslide_fold(s):
    return hazard.landslide_by_property(s.landslide_features)


_ARRAY_RISK = "TRY_CAST(coalesce(nullif(f->>'$.properties.risk', ''), nullif(f->>'$.properties.rank', ''), nullif(f->>'$.properties.R', '')) AS INT)"
SLIDES = f"""slides AS (SELECT property_id, body, len(fs) AS n, list_max(list_transform(fs, lambda f: {_ARRAY_RISK})) AS top,
  coalesce(list_bool_or(list_transform(fs, lambda f: {_STEEP.format(k="f->>'$.properties.type'", n="f->>'$.properties.name'")})), FALSE) AS steep,
  coalesce(list_bool_or(list_transform(fs, lambda f: {_SLIDE.format(k="f->>'$.properties.type'", n="f->>'$.properties.name'")})), FALSE) AS prevention
 FROM (SELECT property_id, body, CAST(body::JSON->'$.features' AS JSON[]) AS fs FROM hazard_responses WHERE kind = 'landslide'))"""


@query(
    "haz03_landslide",
    with_views("hazard_responses", extra=SLIDES)
    + f"""SELECT property_id, CASE WHEN body IS NOT NULL THEN {_CLASS.format(t='top')} END AS risk, CASE WHEN body IS NOT NULL THEN steep END AS steep,
 CASE WHEN body IS NOT NULL THEN prevention END AS prevention FROM slides""",
)
def _landslide(s):
    rows = s.hazard_responses.where("kind = 'landslide'")
    props = rows.select("property_id", hazard.feature_properties(F.col("body")).alias("props"))
    return props.select("property_id", hazard.landslide_of(F.col("props")).alias("l")).select("property_id", "l.*")


# --- joins and assessment ----------------------------------------------------

_LAYERS = ["flood", "tsunami", "disaster_zone", "landslide_prevention", "steep_slope_zone"]
TILES = f"""tile_flags AS (SELECT x, y, {', '.join(f"bool_or(layer = '{n}' AND length > 0) AS {n}" for n in _LAYERS)} FROM (
 SELECT {_TILE_PART.format(n=1)} AS layer, {_TILE_PART.format(n=3)}::INT AS x, {_TILE_PART.format(n=4)}::INT AS y, length FROM tile_files)
 WHERE layer <> 'storm_surge' GROUP BY x, y),
placed AS (SELECT id, lat, lng, {_TX} AS x, {_TY} AS y FROM properties WHERE {LOCATED})"""


@query(
    "jn14_property_tiles",
    with_views("properties", "tile_files", extra=TILES)
    + f"SELECT p.id, p.x AS tile_x, p.y AS tile_y, {', '.join(f'coalesce(t.{n}, FALSE) AS has_{n}' for n in _LAYERS)} FROM placed p LEFT JOIN tile_flags t ON t.x = p.x AND t.y = p.y",
)
def _property_tiles(s):
    return hazard.with_tiles(_located(s), feeds.tile_presence(s.tile_files)).drop("lat", "lng")


@query(
    "jn15_mesh_population",
    with_views("properties", "mesh_population", extra=MESH)
    + "SELECT m.id, m.m3 AS mesh_code, p.population_current, p.elderly FROM mesh m LEFT JOIN mesh_population p ON p.mesh_code = m.m3",
)
def _mesh_population(s):
    return hazard.by_mesh(_located(s), s.mesh_population).drop("lat", "lng")


_KM = """2 * 6371000 * asin(sqrt(power(sin(radians(f.lat - a.lat) / 2), 2)
 + cos(radians(a.lat)) * cos(radians(f.lat)) * power(sin(radians(f.lng - a.lng) / 2), 2)))"""


@query(
    "jn16_risk_within_1km",
    over("properties", "risk_points", sql=f"""SELECT a.id, {_fold('f.type', 'f.name', 'f.risk')}, count(*) > 0 AS near FROM properties a JOIN risk_points f
 ON f.lat BETWEEN a.lat - 0.0095 AND a.lat + 0.0095 AND f.lng BETWEEN a.lng - 0.015 AND a.lng + 0.015 AND {_KM} <= 1000 GROUP BY a.id"""),
)
def _within_km(s):
    near = match.features_within(_located(s), s.risk_points, 1000.0, hazard.landslide_folds())
    return _located(s).join(near, ["lat", "lng"]).drop("lat", "lng").withColumn("near", F.lit(True))


@query(
    "jn11_unassessed",
    over("properties", "hazard_assessments", sql=f"SELECT id FROM properties WHERE {LOCATED} AND id NOT IN (SELECT property_id FROM hazard_assessments)"),
)
def _unassessed(s):
    return hazard.unassessed(s.properties, s.hazard_assessments).select("id")


def _note(name: str, on: str) -> str:
    return f"CASE WHEN {on} THEN '{name}' END"


_SOURCES = {
    "seismic": "s.body IS NOT NULL", "avg_hazard": "g.body IS NOT NULL", "landslide_jshis": "l.body IS NOT NULL",
    "landslide_prevention_reinfolib": "t.landslide_prevention", "steep_slope_reinfolib": "t.steep_slope_zone", "flood": "t.flood",
    "disaster_zone_reinfolib": "t.disaster_zone", "tsunami": "t.tsunami",
}
ASSESS = with_views("properties", "tile_files", "hazard_responses", extra=",\n".join([MESH, TILES, SLIDES])) + f"""
SELECT p.id AS property_id, m.m3 AS mesh_code, {_pga_sql().replace('body', 'g.body')} AS pga_475yr, {_vs_sql().replace('body', 'g.body')} AS liquefaction_risk,
 CASE WHEN t.flood THEN 0.5::DOUBLE END AS flood_depth_max_m, CASE WHEN t.flood THEN 'flood_risk_area' WHEN t.disaster_zone THEN 'disaster_risk_zone' END AS flood_zone,
 CASE WHEN t.tsunami THEN 'medium' END AS tsunami_risk, CASE WHEN t.tsunami THEN 1.0::DOUBLE END AS tsunami_depth_max_m,
 CASE WHEN l.body IS NOT NULL THEN {_CLASS.format(t='l.top')} END AS landslide_risk,
 coalesce(t.steep_slope_zone, FALSE) OR (l.body IS NOT NULL AND l.steep) AS steep_slope_zone,
 coalesce(t.landslide_prevention, FALSE) OR (l.body IS NOT NULL AND l.prevention) AS landslide_prevention_zone,
 array_to_string(list_sort(list_filter([{', '.join(_note(n, on) for n, on in _SOURCES.items())}], lambda x: x IS NOT NULL)), ',') AS sources
FROM placed p JOIN mesh m ON m.id = p.id LEFT JOIN tile_flags t ON t.x = p.x AND t.y = p.y
LEFT JOIN (SELECT * FROM hazard_responses WHERE kind = 'pshm') s ON s.property_id = p.id
LEFT JOIN (SELECT * FROM hazard_responses WHERE kind = 'avghazard') g ON g.property_id = p.id
LEFT JOIN slides l ON l.property_id = p.id"""


def _flat(rows):
    keys = F.array_join(F.array_sort(F.map_keys("data_sources")), ",")
    return rows.withColumn("sources", keys).drop("data_sources", "seismic_intensity_prob")


@query("haz05_assessment", ASSESS)
def _assess(s):
    return _flat(hazard.assess(s.properties, s.hazard_responses, feeds.tile_presence(s.tile_files)))


@query("haz06_batch", ASSESS.replace("FROM placed p JOIN mesh", "FROM (SELECT * FROM placed WHERE id NOT IN (SELECT property_id FROM assessed)) p JOIN mesh").replace(
    "WITH ", "WITH assessed AS (SELECT o_orderkey AS property_id FROM orders WHERE o_orderkey % 10 <> 3),\n", 1))
def _assess_batch(s):
    todo = hazard.unassessed(s.properties, s.hazard_assessments)
    return _flat(hazard.assess(todo, s.hazard_responses, feeds.tile_presence(s.tile_files)))


@query(
    "ups05_hazard_upsert",
    over("properties", "hazard_assessments", "landslide_features", sql=f"""SELECT property_id, landslide_risk FROM hazard_assessments WHERE property_id NOT IN (SELECT property_id FROM landslide_features)
UNION ALL SELECT property_id, landslide_risk FROM (SELECT property_id, {_fold('type', 'name', 'risk')} FROM landslide_features GROUP BY property_id)"""),
)
def _hazard_upsert(s):
    delta = hazard.landslide_by_property(s.landslide_features).select("property_id", "landslide_risk")
    return hazard.put_assessments(s.hazard_assessments.select("property_id", "landslide_risk"), delta)
