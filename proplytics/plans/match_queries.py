"""Queries: entity resolution joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplytics.operators import match
from proplytics.plans import twins as D
from proplytics.plans.registry import query
from proplytics.plans.twins import over
from proplytics.sources.views import with_views

_BI = "list_distinct(list_transform(range(1, length({c})), lambda i: substring({c}, i, 2)))"

_HAVERSINE = """2 * 6371000 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2)
 + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lng - a.lng) / 2), 2)))"""
_NEAR = f"""b.lat BETWEEN a.lat - 0.0005::DOUBLE AND a.lat + 0.0005::DOUBLE AND b.lng BETWEEN a.lng - 0.0005::DOUBLE AND a.lng + 0.0005::DOUBLE
 AND {_HAVERSINE} <= 50"""

TIERS = f"""l AS (SELECT key, municipality, lat, lng, {D.normalized('address')} AS norm FROM incoming),
p AS (SELECT id, address_ja, lat, lng, {D.normalized('address_ja')} AS norm FROM properties),
t1 AS (SELECT l.key, min(p.id) AS match_id FROM l JOIN p ON p.norm = l.norm WHERE l.norm <> '' GROUP BY l.key),
ln AS (SELECT DISTINCT norm, municipality, {_BI.format(c='norm')} AS bi FROM l WHERE norm <> '' AND municipality <> ''),
pn AS (SELECT norm, address_ja, min(id) AS id, {_BI.format(c='norm')} AS bi FROM p WHERE norm <> '' GROUP BY norm, address_ja),
sim AS (SELECT ln.norm, ln.municipality, pn.id, CASE WHEN ln.norm = pn.norm THEN 1::DOUBLE ELSE
  len(list_intersect(ln.bi, pn.bi))::DOUBLE / len(list_distinct(list_concat(ln.bi, pn.bi))) END AS score
 FROM ln JOIN pn ON contains(pn.address_ja, ln.municipality) AND abs(len(ln.bi) - len(pn.bi)) <= 0.15 * greatest(len(ln.bi), len(pn.bi)) + 1),
best AS (SELECT norm, municipality, arg_min(id, (-score, id)) AS match_id, max(score) AS score FROM sim WHERE score >= 0.85::DOUBLE GROUP BY norm, municipality),
t2 AS (SELECT l.key, best.match_id, best.score FROM l JOIN best ON best.norm = l.norm AND best.municipality = l.municipality),
t3 AS (SELECT a.key, min(b.id) AS match_id FROM l a JOIN p b ON {_NEAR} GROUP BY a.key)"""


def _tiers(sql: str) -> str:
    return with_views("incoming", "properties", extra=TIERS) + sql


def listings(s):
    """Listings with the normalised address stored, as the property table stores it."""
    return match.with_normalized(s.incoming, "address")


def properties(s):
    return match.with_normalized(s.properties.select("id", "address_ja", "lat", "lng"))


@query(
    "jn02_exact_address",
    over("incoming", "properties", sql="""SELECT i.key, i.address, p.match_id FROM incoming i LEFT JOIN
 (SELECT address_ja, min(id) AS match_id FROM properties WHERE address_ja <> 'Unknown' GROUP BY address_ja) p
 ON p.address_ja = replace(i.address, '　', ' ')"""),
)
def _exact(s):
    asked = s.incoming.select("key", "address", F.replace("address", F.lit("　"), F.lit(" ")).alias("_a"))
    return match.match_address(asked, s.properties.select("id", "address_ja"), "_a").drop("_a")


@query("jn03_normalized_address", _tiers("SELECT key, match_id FROM t1"))
def _normalized(s):
    return match.match_normalized(listings(s), properties(s))


@query("jn04_similar_address", _tiers("SELECT key, match_id, score FROM t2"))
def _similar(s):
    return match.match_similar(listings(s), properties(s))


@query("jn05_spatial_match", _tiers("SELECT key, match_id FROM t3"))
def _spatial(s):
    return match.first_within(listings(s), properties(s))


@query(
    "jn06_match_cascade",
    _tiers("""SELECT key, match_id, tier, score FROM (
 SELECT key, match_id, 1 AS tier, NULL::DOUBLE AS score FROM t1
 UNION ALL SELECT key, match_id, 2, score FROM t2 WHERE key NOT IN (SELECT key FROM t1)
 UNION ALL SELECT key, match_id, 3, NULL FROM t3 WHERE key NOT IN (SELECT key FROM t1) AND key NOT IN (SELECT key FROM t2))"""),
)
def _cascade(s):
    return match.match_cascade(listings(s), properties(s))


@query(
    "jn06_tier_counts",
    _tiers("""SELECT tier, count(*) AS n FROM (
 SELECT key, 1 AS tier FROM t1 UNION ALL SELECT key, 2 FROM t2 WHERE key NOT IN (SELECT key FROM t1)
 UNION ALL SELECT key, 3 FROM t3 WHERE key NOT IN (SELECT key FROM t1) AND key NOT IN (SELECT key FROM t2)) GROUP BY tier"""),
)
def _tier_counts(s):
    return match.match_cascade(listings(s), properties(s)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "geo05_haversine",
    over("properties", sql="""SELECT id, round(2 * 6371000 * asin(sqrt(power(sin(radians(35.6812 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(35.6812))
 * power(sin(radians(139.7671 - lng) / 2), 2))), 3) AS meters FROM properties WHERE lat IS NOT NULL"""),
)
def _haversine(s):
    from proplytics.functions.geo import haversine_m

    meters = haversine_m(F.col("lat"), F.col("lng"), F.lit(35.6812), F.lit(139.7671))
    return s.properties.where("lat IS NOT NULL").select("id", F.round(meters, 3).alias("meters"))


@query("win04_best_match", _tiers("SELECT key, match_id FROM t2 WHERE score < 1"))
def _best(s):
    """Best similar address of each listing that has no equal one."""
    return match.match_similar(listings(s), properties(s)).where("score < 1").select("key", "match_id")


@query(
    "set03_bigram_sets",
    f"""SELECT id, len(list_intersect(x, y)) AS shared, len(list_distinct(list_concat(x, y))) AS total FROM (
 SELECT p_partkey AS id, {_BI.format(c='p_name')} AS x, {_BI.format(c='p_type')} AS y FROM part)""",
)
def _sets(s):
    from proplytics.functions.text import bigrams

    x, y = bigrams(F.col("p_name")), bigrams(F.col("p_type"))
    return s.part.select(
        F.col("p_partkey").alias("id"), F.size(F.array_intersect(x, y)).cast("bigint").alias("shared"),
        F.size(F.array_union(x, y)).cast("bigint").alias("total"),
    )
