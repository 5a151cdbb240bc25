from collections import defaultdict

import pytest

from proplytics.llm import mixing
from tests.llm.support import documents, edge_rows, words


def expected_targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = total * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(rows, got, tolerance):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = expected_targets(sizes)
    taken, seen = defaultdict(int), set()
    for r in got:
        taken[r.source] += r.copies * r["size"]
        assert 0 <= r.copies <= 2 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        seen.add(r.source)
    assert seen == set(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance, s


def test_targets_and_copies(spark):
    rows = [r for r in edge_rows(3, 400) if len(r[1] or "") < 10000]  # one text that is most of its source cannot come near
    docs = documents(spark, rows)
    got = mixing.mix(docs, block=16).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((i is None, i or 0, len(words(t))) for i, t, _ in rows)
    check(rows, got, 70)
    again = mixing.mix(docs.repartition(5), block=16).collect()
    assert sorted((r.row_key, r.copies) for r in got) == sorted((r.row_key, r.copies) for r in again)


def test_expected_copies_hold_over_seeds(spark):
    rows = [(i, "w " * (1 + i % 7), "a" if i % 2 else "b") for i in range(40)]
    docs = documents(spark, rows)
    total = defaultdict(int)
    for seed in range(12):
        for r in mixing.mix(docs, seed=seed, block=8).collect():
            total[r.source] += r.copies
    want = expected_targets({"a": sum(len(words(t)) for _, t, s in rows if s == "a"), "b": sum(len(words(t)) for _, t, s in rows if s == "b")})
    for s in want:
        size = sum(len(words(t)) for _, t, x in rows if x == s)
        assert total[s] / 12 / 20 == pytest.approx(want[s] / size, abs=0.12)


def test_the_mix_repeats_rows(spark):
    docs = documents(spark, edge_rows(4))
    copies = defaultdict(int)
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    found = defaultdict(int)
    for r in mixed.collect():
        found[r.doc_id] += 1
    assert dict(found) == {k: v for k, v in copies.items() if v}


def test_no_rows_and_no_words(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    got = mixing.mix(documents(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r.target, r.copies) for r in got] == [(0.0, 0), (0.0, 0)]
