import numpy as np
import pytest

from proplytics.llm import neighbours


def brute(rows, every, k):
    usable = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable[(i, tuple(v))] = np.array(v, np.float32).astype(float)
    out = {}
    for (q, own), x in usable.items():
        if q % every:
            continue
        near = sorted((-(x @ y) / np.sqrt((x @ x) * (y @ y)), i) for (i, _), y in usable.items() if i != q and len(y) == len(x))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, cell string, radius double")


def test_chi_square_limit():
    # quantiles of the distribution with 8 degrees of freedom
    assert neighbours.chi_square_limit(0.95) == pytest.approx(15.507, abs=1e-3)
    assert neighbours.chi_square_limit(0.99) == pytest.approx(20.090, abs=1e-3)


def test_recall_over_many_cells(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(10, 24)) * 2
    rows = [(i, [float(x) for x in centres[i % 10] + rnd.normal(size=24)]) for i in range(1500)]
    want = brute(rows, 50, 5)
    got = {}
    for r in neighbours.nearest(table(spark, rows), block=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5]
        exact = {i: np.dot(*(np.array(rows[j][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[j][1], np.float32).astype(float)) for j in (q, i))) for _, i, _ in found}
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in found)
        hits += len({i for i, _ in want[q]} & {f[1] for f in found})
    assert hits >= 0.95 * 5 * len(want)


def test_odd_vectors_and_ties(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(size=6)]) for i in range(40)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(30)]  # equal vectors, a query among them
    rows += [(200, None), (250, []), (300, [0.0] * 6), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] + [1.0] * 5), (450, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    rows += [(500, [1.0, 0.0]), (501, [2.0, 0.1]), (100, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0])]  # another length, a repeated row
    want = brute(rows, 50, 5)
    got = {}
    for r in neighbours.nearest(table(spark, rows), block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(f)] for q, f in got.items()}.keys() == {q for q in want if want[q]}
    assert [i for _, i in sorted(got[100])] == [101, 102, 103, 104, 105]
    assert [i for _, i in sorted(got[500])] == [501]


def test_no_rows(spark):
    assert neighbours.nearest(table(spark, [])).collect() == []
    assert neighbours.nearest(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert neighbours.nearest(table(spark, [(0, [1.0, 2.0])])).collect() == []


def test_components_whose_squares_leave_the_range(spark):
    rnd = np.random.default_rng(3)
    plain = [(i, [float(x) for x in rnd.normal(size=5)]) for i in range(60)]
    # the same directions at every size that a double can hold
    scales = [1.0, 1e200, 1e-200, 1e306, 1e-300, 1e160]
    rows = [(i, [x * scales[i % 6] for x in v]) for i, v in plain]
    rows.append((60, [1e200, -1e-200, 0.0, 0.0, 0.0]))
    plain.append((60, [1.0, 0.0, 0.0, 0.0, 0.0]))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, every=10, block=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 61, 10))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in plain}
    hits = 0
    for q, found in got.items():
        assert all(s == pytest.approx(unit[q] @ unit[i], abs=1e-9) for i, s in found.values())
        best = sorted((i for i in unit if i != q), key=lambda i: -(unit[q] @ unit[i]))[:5]
        hits += len({i for i, _ in found.values()} & set(best))
    assert hits >= 0.95 * 5 * len(got)
