"""Queries: properties on several portals, outlook of areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplytics.functions.geo import mesh_code
from proplytics.functions.text import normalize_address
from proplytics.operators import area, merge
from proplytics.plans import twins as D
from proplytics.plans.hazard_queries import LOCATED, MESH
from proplytics.plans.registry import query
from proplytics.plans.twins import over
from proplytics.sources.views import with_views

_PORTAL = "CASE id % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END"
_CLUSTERS = f"""ads AS (SELECT id, {_PORTAL} AS source, {D.normalized('address_ja')} AS address, floor(land_area_sqm / 10::DOUBLE)::BIGINT AS area, price_jpy, lat, lng FROM properties),
links AS (SELECT a.id AS a, b.id AS b FROM ads a JOIN ads b ON a.address = b.address AND a.area = b.area
 AND 5 * greatest(a.price_jpy, b.price_jpy) <= 6 * least(a.price_jpy, b.price_jpy) WHERE a.price_jpy > 0 AND b.price_jpy > 0),
clusters AS (SELECT id, min(b) AS cluster_id FROM (WITH RECURSIVE reach AS (SELECT id, id AS b FROM ads UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.b) SELECT * FROM reach) GROUP BY id)"""


def _ads(s):
    """Adverts with the place they tell: normalised address and area to ten square metres."""
    return s.properties.select(
        "id", F.expr(_PORTAL).alias("source"), normalize_address(F.col("address_ja")).alias("address"), F.floor(F.col("land_area_sqm") / 10.0).alias("area"), "price_jpy", "lat", "lng")


@query("ent01_merged_listings", over("properties", extra=_CLUSTERS, sql="SELECT id, cluster_id FROM clusters"))
def _merged(s):
    return merge.merge_listings(_ads(s), ["address", "area"])


@query(
    "ent02_merge_review",
    over("properties", extra=_CLUSTERS, sql="""SELECT cluster_id, count(*) AS n, count(DISTINCT source) AS portals, min(price_jpy) AS cheapest, max(price_jpy) AS dearest,
 5 * max(price_jpy) > 6 * min(price_jpy) OR coalesce(max(lat) - min(lat) > 0.0005::DOUBLE OR max(lng) - min(lng) > 0.0005::DOUBLE, FALSE) AS review
 FROM clusters JOIN ads USING (id) GROUP BY cluster_id"""),
)
def _review(s):
    ads = _ads(s)
    return merge.cluster_summary(ads, merge.merge_listings(ads, ["address", "area"]))


_TREND = """sales AS (SELECT m.m3, datediff('day', DATE '1990-01-01', p.created_at::DATE) AS t, floor(p.price_jpy / p.land_area_sqm)::BIGINT AS y
 FROM mesh m JOIN properties p ON p.id = m.id WHERE p.land_area_sqm > 0),
cells AS (SELECT 3 AS level, m3 AS code, t, y FROM sales UNION ALL SELECT 2, m3[1:6], t, y FROM sales UNION ALL SELECT 1, m3[1:4], t, y FROM sales),
sums AS (SELECT level, code, count(*) AS n, sum(t)::DOUBLE AS t, sum(t * t)::DOUBLE AS tt, sum(y)::DOUBLE AS y, sum(t * y)::DOUBLE AS ty FROM cells GROUP BY level, code),
trend AS (SELECT level, code, n, round(y / n, 2) AS mean_value,
 CASE WHEN n * tt - t * t > 0 AND y / n > 0 THEN round((n * ty - t * y) / (n * tt - t * t) * 365.25::DOUBLE / (y / n) * 100, 3) END AS yearly_change FROM sums)"""


def _trend(s):
    priced = s.properties.where(LOCATED).where("land_area_sqm > 0")
    return area.price_trend(priced.select(
        mesh_code(F.col("lat"), F.col("lng")).alias("mesh_code"), F.col("created_at").cast("date").alias("day"), F.floor(F.col("price_jpy") / F.col("land_area_sqm")).alias("unit_price")))


@query("area01_price_trend", with_views("properties", extra=f"{MESH},\n{_TREND}") + "SELECT level, code, n, mean_value, yearly_change FROM trend")
def _price_trend(s):
    """Prices asked by square metre, by grid cell of levels 1 to 3."""
    return _trend(s)


@query(
    "area02_outlook",
    with_views("properties", "mesh_population", extra=f"{MESH},\n{_TREND}") + """SELECT mesh_code, population_current, elderly, source_level, n, yearly_change,
 CASE WHEN yearly_change IS NULL THEN 'unknown' WHEN yearly_change >= 1 THEN 'growing' WHEN yearly_change <= -1 THEN 'declining' ELSE 'stable' END AS outlook FROM (
 SELECT p.*, t.level AS source_level, t.n, t.yearly_change, row_number() OVER (PARTITION BY p.mesh_code ORDER BY t.level DESC NULLS LAST) AS r FROM mesh_population p
 LEFT JOIN trend t ON t.n >= 30 AND t.yearly_change IS NOT NULL AND t.code IN (p.mesh_code, p.mesh_code[1:6], p.mesh_code[1:4])) WHERE r = 1""",
)
def _outlook(s):
    """Every populated cell with the trend of the smallest cell around it that has 30 sales."""
    return area.outlook(s.mesh_population, _trend(s))
