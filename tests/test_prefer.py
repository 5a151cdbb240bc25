"""Cards are read once where details replace them."""

import datetime as dt

from proplytics.plans import load_all
from proplytics.plans.registry import QUERIES
from proplytics.sources.schemas import BASE


def test_pages_of_cards_are_read_once(spark, tmp_path):
    load_all()
    at = dt.datetime(2000, 1, 1)
    orders = [(i, i, "O", 100.0 * i + 50, at, "1-URGENT") for i in range(1000, 1040)]
    lines = [(i, 1, 1, n, 1.0, 1.0, 0.0, 0.0, "A" if i % 2 else "N", "O", at) for i in range(1000, 1040) for n in (1, 2)]
    spark.createDataFrame(orders, BASE["orders"]).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, BASE["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["jn18_prefer_details"](spark, str(tmp_path))
    # what reads markup in this plan are the details of five portals; cards lie in a table
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 5
    # a card costs one man more than its detail
    want = {}
    for i in range(1000, 1040):
        n, reached, man = want.setdefault(["suumo", "homes", "athome", "akiya", "bit"][i % 5], [0, 0, 0])
        want[["suumo", "homes", "athome", "akiya", "bit"][i % 5]] = [n + 1, reached + i % 2, man + i + 1 - i % 2]
    assert {r.source: [r.n, r.from_detail, r.man] for r in found.collect()} == want
