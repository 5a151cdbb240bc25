"""Hard negatives against plain loops over exact integers."""

import math
import random

import duckdb
import numpy as np
import pytest

from proplytics.llm import hardnegatives, queries

from .support import SF

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, block int, cells string, score long"
LONGEST = hardnegatives.LONGEST


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    good = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        # doubles times 256 are exact, however large
        good.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in v)))
    out = []
    for i, label, v in good:
        if i % every:
            continue
        score = lambda w: max(-LONGEST - 1, min(LONGEST, sum(a * b for a, b in zip(v, w))))
        others = sorted((-score(w), j, m) for j, m, w in good if j != i and len(w) == len(v))
        for s, p, _ in [x for x in others if x[2] == label][:positives]:
            hits = [(-n, j) for n, j, m in others if m != label and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(i, p, r, j, -s, n) for r, (n, j) in enumerate(hits, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, v, label in rows], SCHEMA).repartition(4)


def vectors(seed, n, dim=8, scale=1.0):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(0.3, 1) * scale for _ in range(dim)], rnd.randint(0, 3)) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(1, 400)
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(60)]  # equal vectors: ties
    rows += [rows[3], rows[100], rows[100]]  # equal rows
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2100, [float("nan")] * 8, 1), (2200, [float("inf")] * 8, 1), (2300, [1.0] * 8, None), (None, [1.0] * 8, 1)]
    rows += [(2400, [], 1), (2401, [], 2), (2402, [], 1), (2500, [0.0] * 8, 1), (2600, [1.0, 2.0], 1), (2601, [2.0, 2.0], 1), (2602, [1.0, 1.0], 2), (2700, [-1.0] * 8, 9)]
    got = sorted(tuple(r) for r in hardnegatives.mine(table(spark, rows), every=20).collect())
    assert got == brute(rows, every=20) and len(got) > 500


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardnegatives, "CANDIDATES", 37)
    monkeypatch.setattr(hardnegatives, "ANCHORS", 5)
    rows = [(i, v, 0 if i % 3 else label) for i, v, label in vectors(2, 300)]  # one label holds most rows
    assert sorted(tuple(r) for r in hardnegatives.mine(table(spark, rows), every=10, low=20, high=100).collect()) == brute(rows, every=10, low=20, high=100)


@pytest.mark.parametrize("scale", [1e4, 1e7, 1e12, 1e60, 1e307])
def test_large_components(spark, scale):
    rows = vectors(3, 60, scale=scale) + vectors(4, 20)[1:2]
    got = sorted(tuple(r) for r in hardnegatives.mine(table(spark, rows), every=10).collect())
    assert got == brute(rows, every=10)


def test_packed_products_are_exact():
    rng = np.random.default_rng(5)
    for size in (2, 100, 2**15, 2**20, 2**26, 2**40):
        for n in (0, 1, 2, 7, 50):
            anchors, candidates = rng.integers(-size, size, (6, 9)), rng.integers(-size // 2, size, (n, 9))
            packed = hardnegatives.Packed(candidates, *hardnegatives._bounds(anchors))
            want = np.clip(anchors.astype(object) @ candidates.astype(object).T, -LONGEST - 1, LONGEST) if n else np.zeros((6, 0))
            assert packed.scores(anchors).tolist() == want.tolist()
    assert hardnegatives.Packed(np.ones((30, 64), int) * 100, -128, 64 * 128).fields >= 2


def test_cells_round_trip():
    for values in ([], [1, -2], [127, -128], [128], [2**31], [-(2**62)]):
        row = np.array(values, np.int64)
        assert hardnegatives.decoded([hardnegatives.encoded(row)] * 2, len(row)).tolist() == [values] * 2
    assert hardnegatives.quantised(np.array([0.5, -0.001, 2.0**70])).tolist() == [128, -1, 2**78]


def test_empty_table(spark):
    assert hardnegatives.mine(table(spark, [(1, [1.0], 1)]).where("vec_id > 5")).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(hardnegatives.MINE_SQL).fetchall()
    got = [tuple(r) for r in queries.op12_hard_negatives(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 20
