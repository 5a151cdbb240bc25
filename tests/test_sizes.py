"""Plans that hold at any size: what explodes is shuffled, never sent whole to the driver and every executor."""

from pyspark.sql import functions as F

from proplytics.operators import alerts, hazard, ingest, match, nearby, score


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_features_around_a_point_are_not_broadcast(spark):
    points = spark.createDataFrame([(35.0, 139.0), (36.0, 139.0), (35.0, 139.0)], "lat double, lng double")
    features = spark.createDataFrame([(35.001, 139.001, "landslide", "", "3"), (35.001, 139.001, "landslide", "", "3"), (37.0, 139.0, "", "", "4")], "lat double, lng double, type string, name string, risk string")
    near = match.features_within(points, features, 1000.0, hazard.landslide_folds())
    assert "Broadcast" not in plan(near)
    assert [tuple(r) for r in near.collect()] == [(35.0, 139.0, "high", False, True)]


def test_squares_of_boxes_are_not_broadcast(spark):
    points = spark.createDataFrame([(1, 35.0, 139.0), (2, 35.3, 139.0), (3, None, 139.0), (1, 35.0, 139.0)], "id long, lat double, lng double")
    boxes = spark.createDataFrame([(7, 34.999, 138.999, 35.001, 139.001), (8, 34.0, 138.0, 36.0, 140.0), (None, 34.0, 138.0, 36.0, 140.0)], "box_id long, south double, west double, north double, east double")
    found = nearby.in_boxes(points, boxes)
    assert "BroadcastHashJoin" not in plan(found) and "SortMergeJoin" in plan(found)
    assert sorted(map(str, ((r.box_id, r.id) for r in found.collect()))) == sorted(map(str, [(7, 1), (7, 1), (8, 1), (8, 1), (8, 2), (None, 1), (None, 1), (None, 2)]))
    # a point travels once for each level that a box has: two here
    assert nearby._sized(boxes).select("level").distinct().count() == 2


def test_searches_by_block_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, "active", "2001-01-02 00:00:00", "01", "01101", 5_000_000, True, 80.0)],
                                 "id long, status string, created_at string, prefecture_code string, municipality_code string, price_jpy long, rebuild_possible boolean, land_area_sqm double")
    asked = spark.createDataFrame([(7, "2001-01-01", None, None, None, None, None, None), (8, "2001-01-01", "01", None, 1, None, None, None), (9, "2001-01-01", None, None, None, 4_999_999, None, None)],
                                  "search_id long, since string, prefecture_code string, municipality_code string, price_min long, price_max long, rebuild_possible boolean, land_min double")
    found = alerts.matches(rows.withColumn("created_at", F.to_timestamp("created_at")), asked.withColumn("since", F.to_date("since")))
    assert "Broadcast" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(7, 1), (8, 1)]


def test_scores_join_numbers_and_an_upsert_joins_them_once(spark):
    columns = "id long, rebuild_possible boolean, road_width_m double, road_frontage_m double, use_zone string, lat double, lng double, floor_plan string, price_jpy long, land_area_sqm double, year_built int, structure string"
    properties = spark.createDataFrame([(1, True, 4.0, 2.0, "商業地域", 35.0, 139.0, "3LDK", 3_000_000, 100.0, 2000, "木造"), (2,) + (None,) * 11, (2,) + (None,) * 11], columns)
    hazards = spark.createDataFrame([(1, 0.0, 1.0, "low", 0.0), (3, None, None, None, None), (None, 0.0, 1.0, "low", 0.0)], "property_id long, flood_depth_max_m double, pga_475yr double, landslide_risk string, tsunami_depth_max_m double")
    fresh = score.score_properties(properties, hazards)
    assert sorted((r.property_id, r.hazard_score) for r in fresh.collect()) == [(1, 100.0), (2, 50.0), (2, 50.0)]
    old = spark.createDataFrame([(1, "1.0", 1.5), (1, "0.9", 1.5), (1, "0.9", 1.5), (2, "1.0", 1.5), (None, "1.0", 1.5), (4, None, 1.5)], "property_id long, scoring_version string, composite_score double")
    after = ingest.upsert_scores(old, fresh)
    assert sorted((r.property_id or 0, r.scoring_version or "") for r in after.collect()) == [(0, "1.0"), (1, "0.9"), (1, "0.9"), (1, "1.0"), (2, "1.0"), (2, "1.0"), (4, "")]
    optimised = after._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("Join LeftOuter") == 1
