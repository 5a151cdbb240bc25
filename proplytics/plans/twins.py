"""DuckDB text fragments that several twin queries share."""

from __future__ import annotations

from proplytics.operators.score import COMMERCIAL_ZONES, RESIDENTIAL_ZONES
from proplytics.sources.dimensions import DIMENSIONS, PREFECTURES
from proplytics.sources.views import with_views


def quoted(items: list[str]) -> str:
    return ", ".join(f"'{i}'" for i in items)


RESIDENTIAL, COMMERCIAL = quoted(RESIDENTIAL_ZONES), quoted(COMMERCIAL_ZONES)

_DEPTH = """CASE WHEN {c} IS NULL THEN 12.5::DOUBLE WHEN {c} <= 0 THEN 25 WHEN {c} < 0.5 THEN 20
  WHEN {c} < 1 THEN 15 WHEN {c} < 3 THEN 5 ELSE 0 END"""

# six unrounded dimension scores per property
SCORE_PARTS = f"""score_parts AS (
 SELECT p.id AS property_id,
  CASE WHEN p.rebuild_possible = FALSE THEN 0::DOUBLE ELSE greatest(0::DOUBLE, least(100::DOUBLE,
    CASE WHEN p.rebuild_possible THEN 80::DOUBLE ELSE 50::DOUBLE END
    + CASE WHEN p.road_width_m IS NULL THEN -10 WHEN p.road_width_m >= 4 THEN 20 WHEN p.road_width_m >= 3 THEN 10 ELSE 0 END
    + CASE WHEN p.road_frontage_m IS NULL THEN -10 WHEN p.road_frontage_m >= 2 THEN 20 ELSE 0 END
    + CASE WHEN p.use_zone IN ({RESIDENTIAL}) THEN 5 WHEN p.use_zone IN ({COMMERCIAL}) THEN 3 ELSE 0 END)) END AS rebuild_score,
  CASE WHEN h.property_id IS NULL THEN 50::DOUBLE ELSE
    {_DEPTH.format(c='h.flood_depth_max_m')}
    + CASE WHEN h.pga_475yr IS NULL THEN 12.5::DOUBLE WHEN h.pga_475yr < 1.5 THEN 25 WHEN h.pga_475yr < 2 THEN 20
       WHEN h.pga_475yr < 2.5 THEN 15 ELSE 5 END
    + CASE WHEN lower(h.landslide_risk) IN ('low','none') THEN 25::DOUBLE WHEN lower(h.landslide_risk) = 'medium' THEN 15
       WHEN lower(h.landslide_risk) = 'high' THEN 5 WHEN lower(h.landslide_risk) = 'very_high' THEN 0 ELSE 12.5 END
    + {_DEPTH.format(c='h.tsunami_depth_max_m')} END AS hazard_score,
  CASE WHEN p.lat IS NULL OR p.lng IS NULL THEN 50::DOUBLE ELSE least(100::DOUBLE, 50::DOUBLE
    + CASE WHEN p.use_zone IN ({COMMERCIAL}) THEN 20 WHEN p.use_zone IN ({RESIDENTIAL}) THEN 10 ELSE 0 END
    + CASE WHEN p.rooms >= 4 THEN 15 WHEN p.rooms >= 3 THEN 10 WHEN p.rooms >= 2 THEN 5 ELSE 0 END
    + CASE WHEN contains(lower(p.floor_plan), 'ldk') THEN 5 ELSE 0 END) END AS infrastructure_score,
  50::DOUBLE AS demographic_score,
  CASE WHEN p.price_jpy IS NULL OR p.land_area_sqm IS NULL OR p.land_area_sqm <= 0 THEN 50::DOUBLE
    WHEN p.price_jpy / p.land_area_sqm < 10000 THEN 90 WHEN p.price_jpy / p.land_area_sqm < 20000 THEN 80
    WHEN p.price_jpy / p.land_area_sqm < 50000 THEN 70 WHEN p.price_jpy / p.land_area_sqm < 100000 THEN 50
    ELSE 30 END AS value_score,
  CASE WHEN p.year_built IS NULL THEN 40::DOUBLE ELSE greatest(0::DOUBLE, (p.life - greatest(0, 2026 - p.year_built))::DOUBLE / p.life)
    * 70::DOUBLE + 30::DOUBLE END AS condition_score
 FROM (SELECT *, TRY_CAST(regexp_extract(floor_plan, '(?i)(\\d+)\\s*[SLDK]+', 1) AS INT) AS rooms,
       CASE WHEN regexp_matches(lower(coalesce(structure, '')), '鉄筋コンクリート|rc|src|鉄骨鉄筋') THEN 47
        WHEN regexp_matches(lower(coalesce(structure, '')), '軽量鉄骨|light steel|light-steel') THEN 27
        WHEN regexp_matches(lower(coalesce(structure, '')), '重量鉄骨|鉄骨造|steel') THEN 34 ELSE 22 END AS life
       FROM properties) p
 LEFT JOIN hazard_assessments h ON h.property_id = p.id)"""

SCORES = (
    SCORE_PARTS
    + """,
scores AS (
 SELECT property_id, format('{:.2f}', rebuild_score)::DOUBLE AS rebuild_score, format('{:.2f}', hazard_score)::DOUBLE AS hazard_score,
  format('{:.2f}', infrastructure_score)::DOUBLE AS infrastructure_score, demographic_score, value_score,
  format('{:.2f}', condition_score)::DOUBLE AS condition_score,
  format('{:.2f}', greatest(0::DOUBLE, least(100::DOUBLE, rebuild_score * 0.25::DOUBLE + hazard_score * 0.2::DOUBLE + infrastructure_score * 0.15::DOUBLE
   + demographic_score * 0.15::DOUBLE + value_score * 0.15::DOUBLE + condition_score * 0.1::DOUBLE)))::DOUBLE AS composite_score,
  '1.0' AS scoring_version
 FROM score_parts)"""
)

# properties with the composite score on them
SCORED = (
    SCORES
    + """,
scored AS (SELECT p.*, s.composite_score FROM properties p JOIN scores s ON s.property_id = p.id)"""
)


def scored(sql: str) -> str:
    """A twin over ``scored`` (properties with their composite score)."""
    return with_views("properties", "hazard_assessments", extra=SCORED) + sql


def over(*views: str, sql: str, extra: str = "") -> str:
    return with_views(*views, extra=extra) + sql


def dim(name: str) -> str:
    return f"{name} AS ({DIMENSIONS[name]})"


def digits(c: str) -> str:
    return f"translate({c}, '０１２３４５６７８９', '0123456789')"


def group(c: str, pattern: str, n: int = 1) -> str:
    return f"nullif(regexp_extract({c}, '{pattern}', {n}), '')"


def price_portal(c: str) -> str:
    t = f"replace(replace(replace({digits(c)}, ',', ''), ' ', ''), '　', '')"
    return _price(t, ["(\\d{4,})円"])


def price_auction(c: str) -> str:
    t = f"replace(replace(replace(replace({digits(c)}, ',', ''), '，', ''), ' ', ''), '　', '')"
    return _price(t, ["(\\d{4,})円", "(\\d{4,})"])


def price_akiya(c: str) -> str:
    t = f"replace(replace(replace({digits(c)}, ',', ''), ' ', ''), '　', '')"
    return (
        f"CASE WHEN regexp_matches({t}, '無料|無償|0円|譲渡') THEN 0::BIGINT "
        f"WHEN regexp_matches({t}, '未定|要相談|応相談|お問[い合]合わせ') THEN NULL "
        f"ELSE {_price(t, ['(\\d{3,})円', '(\\d{4,})'])} END"
    )


def _price(t: str, plain: list[str]) -> str:
    tries = [
        f"TRY_CAST({group(t, '(\\d+)億(?:(\\d+)万)?円?', 1)} AS BIGINT) * 100000000 "
        f"+ coalesce(TRY_CAST({group(t, '(\\d+)億(?:(\\d+)万)?円?', 2)} AS BIGINT), 0) * 10000",
        f"TRY_CAST({group(t, '(\\d+)万円?')} AS BIGINT) * 10000",
    ]
    tries += [f"TRY_CAST({group(t, p)} AS BIGINT)" for p in plain]
    return "coalesce(" + ", ".join(tries) + ")"


def price_any(source: str, c: str) -> str:
    return (
        f"CASE {source} WHEN 'akiya' THEN {price_akiya(c)} WHEN 'bit' THEN {price_auction(c)} "
        f"ELSE {price_portal(c)} END"
    )


_KANJI = "〇一二三四五六七八九"


def kanji(c: str) -> str:
    """Kanji numerals folded; total and held digit share one integer (total * 10 + held)."""
    fold = (
        "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(seg, ''), "
        f"lambda ch: CASE ch WHEN '十' THEN 10 WHEN '百' THEN 100 WHEN '千' THEN 1000 ELSE instr('{_KANJI}', ch) - 1 END::BIGINT)), "
        "lambda acc, v: CASE WHEN v >= 10 THEN (acc // 10 + greatest(acc % 10, 1) * v) * 10 ELSE (acc // 10) * 10 + v END)"
    )
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '[{_KANJI}十百千]+|[^{_KANJI}十百千]+'), "
        f"lambda seg: CASE WHEN regexp_matches(seg, '^[{_KANJI}十百千]+$') AND ({fold}) // 10 + ({fold}) % 10 > 0 "
        f"THEN (({fold}) // 10 + ({fold}) % 10)::VARCHAR ELSE seg END), '')"
    )


def _width(c: str) -> str:
    wide = "".join(chr(i) for i in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(i) for i in range(0x21, 0x7F)) + " "
    return f"translate({c}, '{wide}', '{narrow.replace(chr(39), chr(39) * 2)}')"


def normalized(c: str) -> str:
    """Twin of normalize_address."""
    t = f"regexp_replace({_width(f'coalesce({c}, {chr(39) * 2})')}, '\\s+', '', 'g')"
    t = kanji(t)
    t = f"regexp_replace({t}, '(\\d+)丁目(\\d+)番地?(\\d+)号?', '\\1-\\2-\\3', 'g')"
    t = f"regexp_replace({t}, '(\\d+)丁目(\\d+)番地?', '\\1-\\2', 'g')"
    t = f"translate({t}, 'ー‐−―', '----')"
    return f"CASE WHEN regexp_matches({t}, '\\d[^\\d\\-]') THEN regexp_extract({t}, '^(.*\\d)', 1) ELSE {t} END"


def width(c: str) -> str:
    return _width(c)


PREFECTURE_ALTERNATION = "|".join(p[1] for p in PREFECTURES)
