"""Golden values and documented quirks of the column functions."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proplytics.functions import geo, tax
from proplytics.functions import numbers as N
from proplytics.functions import text as T


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


@pytest.mark.parametrize(
    "parse, cases",
    [
        (T.parse_price_portal, {"1億5000万円": 150_000_000, "1億円": 100_000_000, "１,２００万円": 12_000_000, "1500000円": 1_500_000,
                                "999円": None, "1.5万円": 50_000, "価格未定": None, "": None}),
        (T.parse_price_akiya, {"無料": 0, "0円": 0, "1500000円": 0, "1500001円": 1_500_001, "応相談": None, "430 万円": 4_300_000,
                               "500円": 0, "12345": 12_345, "未定": None}),
        (T.parse_price_auction, {"1，500，000円": 1_500_000, "1500000": 1_500_000, "150万円": 1_500_000, "999": None}),
        (lambda c: T.parse_price_akiya(c, strict=True), {"1500000円": 1_500_000, "0円": 0}),
        (T.parse_area_portal, {"100.5㎡": 100.5, "1,234.5㎡": 234.5, "100 m2": 100.0, "100坪": None}),
        (T.parse_area_akiya, {"1,234.5㎡": 1234.5}),
        (T.parse_area_auction, {"1,234.5平米": 1234.5, "10平方メートル": 10.0}),
        (T.parse_year_portal, {"2005年3月": 2005, "平成17年": 2005, "昭和60年": 1985, "明治30年": None, "1700年": 1700, "令和元年": None}),
        (T.parse_year_akiya, {"1700年": None, "平成 17 年": 2005, "明治30年": 1897, "築45年": None}),
        (T.parse_year_auction, {"1700年": None, "明治30年": 1897}),
        (T.era_to_year, {"令和6年": 2024, "平成30": 2018, "昭和50年": 1975, "x": None}),
        (T.kanji_to_arabic, {"一": "1", "九": "9", "二十三": "23", "十": "10", "千代田区": "1000代田区", "三重県": "3重県", "一二三": "3", "〇": "〇"}),
        (T.normalize_address, {"東京都新宿区西新宿1丁目2番3号": "東京都新宿区西新宿1-2-3", "東京都新宿区西新宿１丁目２番３号": "東京都新宿区西新宿1-2-3",
                               "": "", "西新宿 1 丁目 2 番地 3 号 ビル": "西新宿1-2-3", None: ""}),
        (T.extract_prefecture, {"東京都新宿区": "東京都", "大阪府大阪市": "大阪府", "北海道札幌市": "北海道", "西新宿1丁目": None}),
        (T.municipality_akiya, {"京都府京都市中京区": "府京都市", "長野県松本市中央": "松本市"}),
        (T.municipality_portal, {"京都府京都市中京区": "京都市"}),
        (T.simplify_address, {"中央1-2-3 メゾン": "中央1-2-3", "中央1-2-3（旧字名）": "中央1-2-3", "中央1-2 101号室": "中央1-2", "中央 3F 東": "中央"}),
        (T.clean_whitespace, {"a\n b": "a b", "a  b": "a  b"}),
        (T.risk_label, {"very_high": "Very High"}),
    ],
)
def test_text(spark, parse, cases):
    assert column(spark, list(cases), parse) == list(cases.values())


def test_width_matches_nfkc_on_addresses(spark):
    texts = ["ＡＢＣ１２３", "　西新宿（１）", "－１"]
    assert column(spark, texts, T.normalize_width) == [unicodedata.normalize("NFKC", t) for t in texts]
    assert column(spark, texts + ["㎡ｱ"], T.normalize_nfkc) == [unicodedata.normalize("NFKC", t) for t in texts + ["㎡ｱ"]]


def test_bigrams_and_jaccard(spark):
    assert column(spark, ["abab", "a", ""], T.bigrams) == [["ab", "ba"], ["a"], []]
    rows = spark.createDataFrame([("abc", "abc"), ("abc", "abd"), ("", "a")], "a string, b string")
    assert [r[0] for r in rows.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 1 / 3, 0.0]


def test_numbers(spark):
    assert column(spark, [1_500_000], N.format_yen, "bigint") == ["¥1,500,000"]
    assert column(spark, [1_500_000, 12_500, 13_500, 14_500], N.format_man_yen, "bigint") == ["150万円", "1.2万円", "1.4万円", "1.4万円"]
    values = [0.15, 2.675, 0.5, 1.005, 17.65]
    assert column(spark, values, lambda c: N.round_exact(c, 1), "double") == [round(v, 1) for v in values]
    assert column(spark, values, lambda c: N.round_exact(c, 2), "double") == [round(v, 2) for v in values]
    assert column(spark, [2024, 1989, 1926, 1868, 1800], N.year_to_era, "int") == ["令和6年", "平成1年", "昭和1年", "明治1年", "1800年"]
    assert column(spark, [2030, 2000, None], N.building_age, "int") == [0, 26, None]
    assert column(spark, [42.0, 125.4], N.duration_label, "double") == ["42s", "2m 5s"]


def test_tax(spark):
    assert column(spark, [1_500_000, 8_000_000, 0], tax.commission, "bigint") == [330_000] * 3
    assert column(spark, [10_000_000, 1_000_000], lambda c: tax.yen(tax.commission_standard(c)), "bigint") == [366_000, 50_000]
    assert column(spark, [1_500_000, 5_000_000, 10_000_000, 600_000_000], tax.stamp_tax, "bigint") == [1_000, 1_000, 5_000, 320_000]


def test_flip_scenario(spark):
    from proplytics.operators.finance import with_capital_gains, with_roi

    deal = spark.createDataFrame(
        [(1_500_000, 500_000, 3_500_000, 12)], "purchase_price bigint, renovation_budget bigint, target_sale_price bigint, holding_months int"
    )
    r = with_roi(deal).first()
    assert (r.total_purchase_costs, r.holding_monthly, r.total_invested, r.capital_gains_tax) == (425_100, 1_487, 2_442_944, 295_203)
    assert (r.net_proceeds, r.net_profit, r.roi_percent, r.breakeven_sale_price) == (2_874_797, 431_853, 17.7, 4_593_249)
    sales = spark.createDataFrame(
        [(1, 3_000_000, 2_000_000, 330_000, 12), (2, 3_000_000, 2_000_000, 330_000, 72), (3, 1_000_000, 2_000_000, 100_000, 12)],
        "id int, sale_price bigint, acquisition_cost bigint, sale_costs bigint, holding_months int",
    )
    got = {r.id: (r.taxable_gain, r.tax_rate, r.tax_amount) for r in with_capital_gains(sales).collect()}
    assert got[1][:2] == (670_000, 0.3963) and got[2][1] == 0.20315 and got[3] == (0, 0.0, 0)


def test_zero_assessment_counts_once(spark):
    from proplytics.operators.finance import with_roi

    rows = spark.createDataFrame(
        [(1_000_000, 0, 0, 0, 12)], "purchase_price bigint, assessed bigint, renovation_budget bigint, target_sale_price bigint, holding_months int"
    )
    r = with_roi(rows, assessed="assessed").first()
    assert r.registration_total == 0 and r.holding_monthly > 0 and r.sale_commission == 330_000


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(24.0, 45.9), st.floats(122.0, 153.9)), min_size=1, max_size=20))
def test_mesh_holds_its_point(spark, points):
    rows = spark.createDataFrame(points, "lat double, lng double")
    for level in (1, 2, 3, 4):
        out = rows.withColumn("code", geo.mesh_code(F.col("lat"), F.col("lng"), level)).withColumn("b", geo.mesh_bounds(F.col("code")))
        for r in out.collect():
            assert len(r.code) == {1: 4, 2: 6, 3: 8, 4: 9}[level]
            assert r.b.south - 1e-9 <= r.lat <= r.b.north + 1e-9 and r.b.west - 1e-9 <= r.lng <= r.b.east + 1e-9


def test_tokyo_station(spark):
    row = spark.createDataFrame([(35.6812, 139.7671)], "lat double, lng double").select(
        geo.mesh_code(F.col("lat"), F.col("lng"), 3).alias("m"), geo.tile_x(F.col("lng")).alias("x"), geo.tile_y(F.col("lat")).alias("y")
    ).first()
    assert row.m.startswith("5339") and len(row.m) == 8
    assert (row.x, row.y) == (29105, 12903)
    assert column(spark, ["53", "5339"], geo.mesh_bounds)[0] is None
