"""Queries: taxes, returns and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplytics.functions import tax
from proplytics.operators import finance, score
from proplytics.plans import twins as D
from proplytics.plans.registry import query
from proplytics.plans.twins import dim, over
from proplytics.sources.dimensions import STAMP_BRACKETS, dimension, values_sql
from proplytics.sources.views import with_views

# --- DuckDB fragments: every rate is cast, since 0.7 alone is a decimal there -----


def fl(expression: str) -> str:
    return f"CAST(floor({expression}) AS BIGINT)"


def excl(p: str) -> str:
    return (
        f"CASE WHEN {p} <= 2000000 THEN {p} * 0.05::DOUBLE WHEN {p} <= 4000000 THEN {p} * 0.04::DOUBLE + 22000 "
        f"ELSE {p} * 0.03::DOUBLE + 66000 END"
    )


def incl(p: str) -> str:
    return fl(f"({excl(p)}) * 1.1::DOUBLE")


def commission(p: str) -> str:
    return f"CASE WHEN {p} <= 8000000 THEN 330000 ELSE {incl(p)} END"


def stamp(p: str) -> str:
    whens = " ".join(f"WHEN {p} <= {u} THEN {t}" for u, t in STAMP_BRACKETS if u is not None)
    return f"CAST(CASE {whens} ELSE 320000 END AS BIGINT)"


def land(a: str) -> str:
    return fl(f"{a} * 0.4::DOUBLE")


def registration(a: str) -> str:
    return f"{fl(f'{land(a)} * 0.015::DOUBLE')} + {fl(f'({a} - {land(a)}) * 0.02::DOUBLE')}"


def acquisition(a: str) -> str:
    return f"{fl(f'{land(a)} * 0.5::DOUBLE * 0.03::DOUBLE')} + {fl(f'({a} - {land(a)}) * 0.03::DOUBLE')}"


def monthly(a: str) -> str:
    return fl(f"({fl(f'{a} * 0.014::DOUBLE')} + {fl(f'{a} * 0.003::DOUBLE')}) / 12.0::DOUBLE")


def one_dp(e: str) -> str:
    return f"format('{{:.1f}}', {e})::DOUBLE"


# assessed values: one in four given, a few of them zero
ASSESSED = "CASE WHEN id % 4 = 0 THEN price_jpy * (id % 3) // 2 END"


def assessed(s):
    p = s.properties
    return p.withColumn(
        "assessed_value", F.expr("CASE WHEN id % 4 = 0 THEN price_jpy * (id % 3) div 2 END").cast("bigint")
    )


@query(
    "fin01_commission",
    over("properties", sql=f"""SELECT id, {fl(excl('price_jpy'))} AS standard_excl_tax, {incl('price_jpy')} AS standard_incl_tax,
 price_jpy <= 8000000 AS low_price_rule_applies, {commission('price_jpy')} AS actual_commission_incl_tax FROM properties"""),
)
def _commission(s):
    return finance.with_commission(s.properties.select("id", "price_jpy"), "price_jpy").drop("price_jpy")


@query("fin02_stamp_tax", over("properties", sql=f"SELECT id, price_jpy, {stamp('price_jpy')} AS stamp_tax FROM properties"))
def _stamp(s):
    return s.properties.select("id", "price_jpy", tax.stamp_tax(F.col("price_jpy")).alias("stamp_tax"))


_LAND_ONLY = "id % 6 = 1"


def _split_tax(kind: str, land_rate: str, building_rate: str, alone: str) -> str:
    return f"""SELECT id, l AS {kind}_land, b AS {kind}_building, l + b AS {kind}_total FROM (
 SELECT id, CASE WHEN {_LAND_ONLY} THEN {fl(f'price_jpy * {alone}')} ELSE {fl(f'{land("price_jpy")} * {land_rate}')} END AS l,
  CASE WHEN {_LAND_ONLY} THEN 0 ELSE {fl(f'(price_jpy - {land("price_jpy")}) * {building_rate}')} END AS b FROM properties)"""


@query(
    "fin03_registration_tax",
    over("properties", sql=_split_tax("registration", "0.015::DOUBLE", "0.02::DOUBLE", "0.015::DOUBLE")),
)
def _registration(s):
    rows = s.properties.select("id", "price_jpy")
    return finance.with_registration_tax(rows, "price_jpy", F.col("id") % 6 == 1).drop("price_jpy")


@query(
    "fin04_acquisition_tax",
    over("properties", sql=_split_tax("acquisition", "0.5::DOUBLE * 0.03::DOUBLE", "0.03::DOUBLE", "0.5::DOUBLE * 0.03::DOUBLE")),
)
def _acquisition(s):
    rows = s.properties.select("id", "price_jpy")
    return finance.with_acquisition_tax(rows, "price_jpy", F.col("id") % 6 == 1).drop("price_jpy")


@query(
    "fin05_holding_cost",
    over("properties", sql=f"""SELECT id, {fl('price_jpy * 0.014::DOUBLE')} AS fixed_asset_tax, {fl('price_jpy * 0.003::DOUBLE')} AS city_planning_tax,
 {fl('price_jpy * 0.014::DOUBLE')} + {fl('price_jpy * 0.003::DOUBLE')} AS total_annual, {monthly('price_jpy')} AS monthly FROM properties"""),
)
def _holding(s):
    return finance.with_holding_cost(s.properties.select("id", "price_jpy"), "price_jpy").drop("price_jpy")


@query(
    "fin06_capital_gains",
    over("deals", sql=f"""SELECT id, CASE WHEN g IS NOT NULL THEN greatest(0, g) END AS taxable_gain, r AS tax_rate, t AS tax_amount, m <= 60 AS is_short_term, sale - costs - t AS net_after_tax
FROM (SELECT *, CASE WHEN g <= 0 THEN 0 WHEN g > 0 THEN {fl('g * r')} END AS t FROM (
 SELECT *, CASE WHEN g IS NULL THEN NULL WHEN g <= 0 THEN 0::DOUBLE WHEN m <= 60 THEN 0.3963::DOUBLE ELSE 0.20315::DOUBLE END AS r FROM (
  SELECT id, target_sale_price AS sale, 330000 AS costs, holding_months AS m, target_sale_price - purchase_price - 330000 AS g
  FROM deals)))"""),
)
def _gains(s):
    rows = s.deals.select(
        "id", F.col("target_sale_price").alias("sale_price"), F.col("purchase_price").alias("acquisition_cost"),
        F.lit(330_000).cast("bigint").alias("sale_costs"), "holding_months",
    )
    return finance.with_capital_gains(rows).drop("sale_price", "acquisition_cost", "sale_costs", "holding_months")


PURCHASE = f"""purchase AS (
 SELECT *, price + total_purchase_costs AS total_with_price,
  CASE WHEN price > 0 THEN {one_dp('total_purchase_costs::DOUBLE / price * 100::DOUBLE')} ELSE 0::DOUBLE END AS cost_ratio FROM (
  SELECT *, {commission('price')} + {stamp('price')} + {registration('av')} + {acquisition('av')} + 50000 AS total_purchase_costs FROM (
   SELECT *, coalesce(assessed, {fl('price * 0.7::DOUBLE')}) AS av FROM deal_input)))"""


@query(
    "fin07_purchase_costs",
    over("properties", extra=f"deal_input AS (SELECT id, price_jpy AS price, {ASSESSED} AS assessed FROM properties),\n{PURCHASE}",
         sql=f"""SELECT id, av AS assessed_value_used, {commission('price')} AS commission, {stamp('price')} AS stamp_tax,
 {registration('av')} AS registration_total, {acquisition('av')} AS acquisition_total, total_purchase_costs, total_with_price, cost_ratio FROM purchase"""),
)
def _purchase(s):
    rows = finance.with_purchase_costs(assessed(s), "price_jpy", "assessed_value")
    return rows.select(
        "id", "assessed_value_used", "commission", "stamp_tax", "registration_total", "acquisition_total",
        "total_purchase_costs", "total_with_price", "cost_ratio",
    )


ROI = f"""roi AS (
 SELECT *, CASE WHEN invested > 0 THEN {one_dp('net_profit::DOUBLE / invested * 100::DOUBLE')} ELSE 0::DOUBLE END AS roi_percent FROM (
  SELECT *, net_proceeds - invested AS net_profit FROM (
   SELECT *, target - sale_commission - gains AS net_proceeds FROM (
    SELECT *, CASE WHEN gain <= 0 THEN 0 ELSE {fl('gain * rate')} END AS gains FROM (
     SELECT *, CASE WHEN gain <= 0 THEN 0::DOUBLE WHEN months <= 60 THEN 0.3963::DOUBLE ELSE 0.20315::DOUBLE END AS rate FROM (
      SELECT *, target - total_with_price - reno - sale_commission AS gain, total_with_price + reno + holding AS invested FROM (
       SELECT *, {monthly('hv')} * months AS holding, {commission('target')} AS sale_commission FROM (
        SELECT *, coalesce(nullif(assessed, 0), {fl('price * 0.7::DOUBLE')}) AS hv FROM purchase))))))))"""

ROI_OUT = f"""total_purchase_costs, holding AS holding_costs, invested AS total_invested, sale_commission, gains AS capital_gains_tax,
 net_proceeds, net_profit, roi_percent, {one_dp('roi_percent / greatest(months, 1) * 12::DOUBLE')} AS annualized_roi_percent,
 CAST(ceil((invested + sale_commission)::DOUBLE / (1.0::DOUBLE - rate)) AS BIGINT) AS breakeven_sale_price"""
ROI_COLUMNS = [
    "total_purchase_costs", "holding_costs", "total_invested", "sale_commission", "capital_gains_tax", "net_proceeds",
    "net_profit", "roi_percent", "annualized_roi_percent", "breakeven_sale_price",
]


@query(
    "fin08_roi",
    over("deals", extra=f"""deal_input AS (SELECT id, purchase_price AS price, CAST(NULL AS BIGINT) AS assessed, coalesce(renovation_budget, 0) AS reno,
 coalesce(target_sale_price, 0) AS target, holding_months AS months FROM deals),\n{PURCHASE},\n{ROI}""",
         sql=f"SELECT id, {ROI_OUT} FROM roi"),
)
def _roi(s):
    return finance.with_roi(s.deals).select("id", *ROI_COLUMNS)


# Three flip scenarios (assessed share of price, renovation, margin on price, months)
SCENARIO_ROWS = [("quick flip", None, 500_000, 2.4, 12), ("long hold", 0, 1_500_000, 1.9, 72), ("as is", None, 0, 1.2, 6)]
SCENARIO_COLUMNS = {"scenario": "string", "assessed": "bigint", "renovation": "bigint", "multiple": "double", "months": "int"}
SCENARIOS = values_sql(SCENARIO_ROWS, " ".join(SCENARIO_COLUMNS), " ".join(SCENARIO_COLUMNS.values()).upper())


@query(
    "fin09_scenario_grid",
    over("properties", extra=f"""scenarios AS ({SCENARIOS}), deal_input AS (SELECT id, scenario, price_jpy AS price, assessed, renovation AS reno,
 {fl('price_jpy * multiple')} AS target, months FROM properties CROSS JOIN scenarios),\n{PURCHASE},\n{ROI}""",
         sql=f"SELECT id, scenario, {ROI_OUT} FROM roi"),
)
def _grid(s):
    rows = finance.scenario_grid(s.properties.select("id", "price_jpy"), SCENARIO_ROWS, SCENARIO_COLUMNS)
    rows = rows.withColumn("target", tax.yen(F.col("price_jpy") * F.col("multiple")))
    return finance.with_roi(rows, "price_jpy", "assessed", "renovation", "target", "months").select(
        "id", "scenario", *ROI_COLUMNS
    )


@query(
    "fin10_rates",
    over("properties", sql=f"""SELECT bracket, count(*) AS n, CAST(sum(stamp) AS BIGINT) AS stamp_total FROM (SELECT {stamp('price_jpy')} AS stamp,
 CASE {' '.join(f'WHEN price_jpy <= {u} THEN {u}' for u, _ in STAMP_BRACKETS if u)} END::BIGINT AS bracket FROM properties) GROUP BY bracket"""),
)
def _rates(s):
    rows = finance.with_rate(s.properties.select("price_jpy"), "stamp", "price_jpy", {"high": "bracket", "amount": "stamp"})
    return rows.groupBy("bracket").agg(F.count(F.lit(1)).alias("n"), F.sum("stamp").alias("stamp_total"))


@query("fin10_rate_rows", f"WITH {dim('rates')} SELECT tax, item, low, high, rate, amount, note, n FROM rates CROSS JOIN (SELECT count(*) AS n FROM orders)")
def _rate_rows(s):
    """The published table, beside the number of properties that it prices."""
    n = s.properties.agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    return dimension(s.spark, "rates").withColumn("_k", F.lit(1)).join(n, "_k").drop("_k")


# --- scores -----------------------------------------------------------------


def _dimension(name: str, column: str):
    @query(name, D.scored(f"SELECT property_id, {column} FROM scores"))
    def run(s):
        return score.score_properties(s.properties, s.hazard_assessments).select("property_id", column)


_dimension("sco01_rebuild", "rebuild_score")
_dimension("sco02_hazard", "hazard_score")
_dimension("sco03_infrastructure", "infrastructure_score")
_dimension("sco04_demographic", "demographic_score")
_dimension("sco05_value", "value_score")
_dimension("sco06_condition", "condition_score")


@query(
    "sco07_useful_life",
    over("properties", sql="""SELECT structure, CASE WHEN structure IS NULL OR structure = '木造' THEN 22 WHEN structure IN ('鉄筋コンクリート造', 'SRC') THEN 47
 WHEN structure = '軽量鉄骨造' THEN 27 ELSE 34 END AS life, count(*) AS n FROM properties GROUP BY ALL"""),
)
def _life(s):
    life = score.useful_life(F.col("structure")).alias("life")
    return s.properties.groupBy("structure", life).agg(F.count(F.lit(1)).alias("n"))


@query("sco08_composite", D.scored("SELECT * FROM scores"))
def _composite(s):
    return score.score_properties(s.properties, s.hazard_assessments)


OLD_SCORES = "old_scores AS (SELECT o_orderkey AS property_id, CASE WHEN o_orderkey % 4 = 0 THEN '0.9' ELSE '1.0' END AS scoring_version FROM orders WHERE o_custkey % 3 = 0)"


def old_scores(s):
    version = F.when(F.col("o_orderkey") % 4 == 0, "0.9").otherwise("1.0")
    return s.orders.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("property_id"), version.alias("scoring_version"))


@query(
    "jn10_unscored",
    over("properties", extra=OLD_SCORES, sql="""SELECT id FROM properties WHERE status = 'active'
 AND id NOT IN (SELECT property_id FROM old_scores WHERE scoring_version = '1.0')"""),
)
def _unscored(s):
    return score.unscored(s.properties, old_scores(s)).select("id")


@query(
    "sco09_batch",
    with_views("properties", "hazard_assessments", extra=D.SCORES + ",\n" + OLD_SCORES)
    + """SELECT property_id, composite_score FROM scores WHERE property_id IN (SELECT id FROM properties WHERE status = 'active')
 AND property_id NOT IN (SELECT property_id FROM old_scores WHERE scoring_version = '1.0')""",
)
def _score_batch(s):
    rows = score.score_unscored(s.properties, s.hazard_assessments, old_scores(s))
    return rows.select("property_id", "composite_score")


_W = {"rebuild": "0.25", "value": "0.15", "condition": "0.1"}
_STUB = """SELECT id,
 CASE WHEN rebuild_possible IS NULL THEN 0::DOUBLE ELSE CASE WHEN rebuild_possible THEN 80 ELSE 20 END + CASE WHEN road_width_m >= 4 THEN 15 ELSE 0 END END AS r,
 CASE WHEN price_jpy <> 0 AND land_area_sqm > 0 THEN CASE WHEN price_jpy / land_area_sqm < 10000 THEN 95 WHEN price_jpy / land_area_sqm < 30000 THEN 80
  WHEN price_jpy / land_area_sqm < 60000 THEN 60 WHEN price_jpy / land_area_sqm < 100000 THEN 40 ELSE 20 END ELSE 0 END::DOUBLE AS v,
 CASE WHEN year_built <> 0 THEN CASE WHEN 2026 - year_built <= 5 THEN 90 WHEN 2026 - year_built <= 15 THEN 70 WHEN 2026 - year_built <= 30 THEN 50
  WHEN 2026 - year_built <= 50 THEN 30 ELSE 15 END ELSE 0 END::DOUBLE AS c FROM properties"""


@query(
    "sco10_stub_score",
    over("properties", sql=f"""SELECT id, r AS rebuild_score, v AS value_score, c AS condition_score, round(coalesce(
 ((CASE WHEN r > 0 THEN r * 0.25::DOUBLE ELSE 0 END) + (CASE WHEN v > 0 THEN v * 0.15::DOUBLE ELSE 0 END) + (CASE WHEN c > 0 THEN c * 0.1::DOUBLE ELSE 0 END))
 / nullif((CASE WHEN r > 0 THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN v > 0 THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN c > 0 THEN 0.1::DOUBLE ELSE 0 END), 0), 0), 6)
 AS composite_score FROM ({_STUB})"""),
)
def _stub(s):
    rows = score.stub_scores(s.properties.withColumnRenamed("price_jpy", "price"))
    return rows.select(
        "id", "rebuild_score", "value_score", "condition_score", F.round("composite_score", 6).alias("composite_score")
    )


@query(
    "agg18_weighted_mean",
    with_views("properties", "hazard_assessments", extra=D.SCORES)
    + """SELECT property_id, round(coalesce((rebuild_score * 0.25::DOUBLE + hazard_score * 0.2::DOUBLE + value_score * 0.15::DOUBLE)
 / nullif(CASE WHEN rebuild_score > 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN hazard_score > 0 THEN 0.2::DOUBLE ELSE 0 END
 + CASE WHEN value_score > 0 THEN 0.15::DOUBLE ELSE 0 END, 0), 0), 6) AS mean FROM scores""",
)
def _mean(s):
    scores = score.score_properties(s.properties, s.hazard_assessments)
    mean = score.weighted_mean_nonzero({n: F.col(f"{n}_score") for n in ("rebuild", "hazard", "value")})
    return scores.select("property_id", F.round(mean, 6).alias("mean"))


@query(
    "win03_latest_score",
    """SELECT property_id, max(version) AS version, arg_max(composite, (version, composite)) AS composite
FROM (SELECT l_orderkey AS property_id, l_partkey * 10 + l_linenumber AS version, CAST(l_quantity AS DOUBLE) AS composite FROM lineitem) GROUP BY property_id""",
)
def _latest_score(s):
    """Latest of several score versions per property."""
    rows = s.lineitem.select(
        F.col("l_orderkey").alias("property_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("version"),
        F.col("l_quantity").cast("double").alias("composite"),
    )
    return score.latest_scores(rows)


@query(
    "jn09_hazard_left_join",
    over("properties", "hazard_assessments", sql="""SELECT p.id, h.flood_depth_max_m, h.landslide_risk, h.property_id IS NOT NULL AS assessed
FROM properties p LEFT JOIN hazard_assessments h ON h.property_id = p.id"""),
)
def _hazard_join(s):
    h = s.hazard_assessments.select(F.col("property_id").alias("id"), "flood_depth_max_m", "landslide_risk", F.lit(True).alias("_a"))
    return s.properties.select("id").join(h, "id", "left").select(
        "id", "flood_depth_max_m", "landslide_risk", F.coalesce("_a", F.lit(False)).alias("assessed")
    )


@query("fin10_rate_table", over("properties", sql="""SELECT p.id, r.rate AS commission_rate FROM properties p JOIN (
 VALUES (0, 2000000, 0.05::DOUBLE), (2000001, 4000000, 0.04::DOUBLE), (4000001, 9223372036854775807, 0.03::DOUBLE)) r(lo, hi, rate) ON p.price_jpy BETWEEN r.lo AND r.hi"""))
def _rate_table(s):
    return finance.with_rate(s.properties.select("id", "price_jpy"), "brokerage", "price_jpy", {"rate": "commission_rate"}).drop("price_jpy")


_HOUSES = """houses AS (SELECT id, land_area_sqm * 0.6::DOUBLE AS area, year_built, CASE WHEN structure LIKE '%軽量鉄骨%' THEN 110 WHEN structure LIKE '%鉄筋%' OR structure LIKE '%RC%' THEN 140
 WHEN structure LIKE '%鉄骨%' THEN 120 ELSE 100 END AS percent, CASE WHEN 2026 - year_built <= 15 THEN 'basic' WHEN 2026 - year_built > 45 AND rebuild_possible THEN 'rebuild' ELSE 'full' END AS advised FROM properties)"""


@query(
    "fin11_renovation",
    with_views("properties", extra=f"{dim('renovation_costs')}, {_HOUSES}") + """SELECT h.id, c.work, c.least * percent // 100 AS least, c.most * percent // 100 AS most, c.work = advised AS is_advised
 FROM houses h LEFT JOIN renovation_costs c ON h.area >= c.area_from AND (c.area_below IS NULL OR h.area < c.area_below)""",
)
def _renovation(s):
    """Every property with all kinds of work; its house is taken to have 60 % of the plot's area."""
    houses = s.properties.select("id", (F.col("land_area_sqm") * 0.6).alias("building_area_sqm"), "year_built", "structure", "rebuild_possible")
    return finance.renovation_estimate(houses, 2026).select("id", "work", "least", "most", "is_advised")
