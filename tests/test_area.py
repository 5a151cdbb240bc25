"""Merged listings and area outlook against loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from proplytics.operators import area, merge

ADS = "id long, place string, area long, price_jpy long, source string, lat double, lng double"


def reached(rows):
    """Clusters by walking all links."""
    whole = {r[0]: r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and r[3] is not None and r[3] > 0}
    out, left = {r[0]: r[0] for r in rows if r[0] is not None and r[0] not in whole}, set(whole)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = whole[todo.pop()]
            group.add(a[0])
            near = [k for k in left if whole[k][1:3] == a[1:3] and 5 * max(whole[k][3], a[3]) <= 6 * min(whole[k][3], a[3])]
            left -= set(near)
            todo += near
        out.update({k: min(group) for k in group})
    return out


def ads(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        # a third of all rows stand at one place; prices sit on and around the edges of 20 %
        place = "hot" if i % 3 == 0 else f"p{rnd.randrange(25)}"
        price = rnd.choice([5 * 6**k // 5**k * 1000 + rnd.randint(-1, 1) for k in range(12)]) * rnd.choice([1, 1, 7])
        rows.append((i, place, rnd.randrange(2), price, rnd.choice("ab"), 35.0 + rnd.choice([0, 0.0001, 0.01]), 139.0))
    rows += [(500, None, 1, 100, "a", None, None), (501, "hot", None, 100, "a", None, None), (502, "hot", 1, None, "a", None, None), (503, "hot", 1, 0, "a", None, None),
             (504, "hot", 1, -5, "b", None, None), (None, "hot", 1, 100, "a", None, None), (505, "big", 1, 2**63 - 1, "a", None, None), (506, "big", 1, 2**62 + 2**61 + 2**60 + 2**59, "a", None, None), (507, "tiny", 1, 1, "a", None, None), (508, "tiny", 1, 2, "a", None, None)]
    return rows


def test_clusters_are_what_links_reach(spark):
    for seed in (1, 2):
        rows = ads(seed)
        got = merge.merge_listings(spark.createDataFrame(rows, ADS), ["place", "area"]).collect()
        assert len(got) == len({r.id for r in got})
        assert {r.id: r.cluster_id for r in got} == reached(rows)


def test_chain_of_a_thousand_is_one_cluster_and_flagged(spark):
    price, rows = 1_000_000, []
    for i in range(1000):
        rows.append((1000 - i, "chain", 1, price, "ab"[i % 2], 35.0, 139.0))
        price += price // 100
    rows += [(2000 + i, "other", 1, 5_000_000 + 300_000 * i, "abc"[i], 35.0, 139.0) for i in range(3)] + [(3000, "far", 1, 10, "a", 35.0, 139.0), (3001, "far", 1, 11, "a", 35.1, 139.0)]
    frame = spark.createDataFrame(rows, ADS)
    clusters = merge.merge_listings(frame, ["place", "area"])
    got = {r.cluster_id: r for r in merge.cluster_summary(frame, clusters).collect()}
    assert {k: (r.n, r.portals, r.review) for k, r in got.items()} == {1: (1000, 2, True), 2000: (3, 3, False), 3000: (2, 1, True)}


def test_bands_hold_only_linked_prices(spark):
    prices = spark.range(1, 200_000).select(F.col("id").alias("p")).unionByName(spark.range(1, 63).select(F.expr("shiftleft(1L, cast(id as int)) AS p")))
    bands = prices.groupBy(merge.price_band(F.col("p")).alias("b")).agg(F.min("p").alias("low"), F.max("p").alias("high"))
    assert bands.where("cast(high as decimal(38,0)) * 5 > cast(low as decimal(38,0)) * 6").count() == 0
    assert bands.agg(F.max("b") - F.min("b")).first()[0] < 260


def test_no_listings(spark):
    empty = spark.createDataFrame([], ADS)
    clusters = merge.merge_listings(empty, ["place", "area"])
    assert clusters.count() == 0 and merge.cluster_summary(empty, clusters).count() == 0


SALES = "mesh_code string, day date, unit_price long"


def sales(seed):
    rnd = random.Random(seed)
    first = dt.date(1995, 1, 1)
    rows = [("53394611" if i % 3 == 0 else f"5339{rnd.randrange(40, 43)}{rnd.randrange(10, 13)}", first + dt.timedelta(rnd.randrange(2000)), rnd.randrange(1, 10**7)) for i in range(600)]
    rows += [("60400000", first, 5), ("60400000", first, 9), (None, first, 1), ("60400000", None, 1), ("60400000", first, None), ("61400000", first, -10), ("61400000", first + dt.timedelta(9), -20)]
    return rows


def plain_trend(rows):
    cells = {}
    for code, day, value in rows:
        if None not in (code, day, value):
            for level, digits in area.DIGITS.items():
                cells.setdefault((level, code[:digits]), []).append(((day - dt.date(1990, 1, 1)).days, value))
    out = {}
    for key, points in cells.items():
        n, mt, my = len(points), sum(t for t, _ in points) / len(points), sum(y for _, y in points) / len(points)
        spread = sum((t - mt) ** 2 for t, _ in points)
        out[key] = (n, my, sum((t - mt) * (y - my) for t, y in points) / spread * 36525 / my if spread > 0 and my > 0 else None)
    return out


def test_trends_of_all_levels(spark):
    rows = sales(3)
    got = {(r.level, r.code): r for r in area.price_trend(spark.createDataFrame(rows, SALES).repartition(7)).collect()}
    want = plain_trend(rows)
    assert got.keys() == want.keys()
    for key, (n, mean, change) in want.items():
        assert got[key].n == n and abs(got[key].mean_value - mean) < 0.01
        assert (got[key].yearly_change is None) == (change is None) and (change is None or abs(got[key].yearly_change - change) < 0.01)


def test_thin_cells_take_the_cell_around_them(spark):
    rows = sales(3)
    trend = area.price_trend(spark.createDataFrame(rows, SALES))
    codes = ["53394611", "53394110", "53394199", "53399999", "60400000", "99999999", None]
    got = {r.mesh_code: r for r in area.outlook(spark.createDataFrame([(c,) for c in codes], "mesh_code string"), trend).collect()}
    want = plain_trend(rows)
    assert len(got) == len(codes)
    for code in codes:
        levels = [k for k, d in area.DIGITS.items() if code and want.get((k, code[:d]), (0, 0, None))[0] >= 30 and want[(k, code[:d])][2] is not None]
        assert got[code].source_level == (levels[0] if levels else None)
        if not levels:
            assert got[code].outlook == "unknown"
            continue
        change = want[(levels[0], code[: area.DIGITS[levels[0]]])][2]
        assert abs(got[code].yearly_change - change) < 0.01
        assert got[code].outlook == ("growing" if change >= 1 else "declining" if change <= -1 else "stable")
    assert {r.source_level for r in got.values()} >= {3, 2, 1, None}
    assert area.price_trend(spark.createDataFrame([], SALES)).count() == 0
