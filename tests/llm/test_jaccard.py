import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from proplytics.llm import jaccard
from tests.llm.support import documents, edge_rows


def sets(rows, n):
    out = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset([tuple(w)]) if 0 < len(w) < n else frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)))
    return out


def brute(rows, n, percent):
    s = sets(rows, n)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                up[find(i)] = find(j)
    group = defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(i)
    return s, list(group.values())


def check(spark, rows, n, percent, **options):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(documents(spark, rows), n, percent, **options).collect())
    s, groups = brute(rows, n, percent)
    want = Counter()
    for g in groups:
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            want[(rows[i][0], len(s[i]), min(ids) if ids else None)] += 1
    assert got == want


def near_copies(seed, families, size, length, edits):
    rnd = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(length)] = f"e{rnd.randint(0, 99)}"
            rows.append((len(rows), " ".join(own), "s"))
    return rows


def test_near_copies(spark):
    check(spark, near_copies(1, 12, 9, 80, 4), 3, 90)


def test_odd_rows(spark):
    check(spark, edge_rows(), 3, 90)


def order_over(spark, sets, width=40):
    """The order of tokens by their counts over some sets."""
    runs = jaccard.HashRuns(jaccard.REST, 1 << 12)
    rows = [r for s in sets for b in runs.add(s >> np.uint64(64 - width)) for r in b.to_pylist()] + [r for b in runs.runs() for r in b.to_pylist()]
    return jaccard.order_of(spark.createDataFrame([tuple(r.values()) for r in rows], jaccard.HashRuns.SCHEMA), width)


def test_levels_are_those_of_the_counts(spark):
    rnd = np.random.default_rng(7)
    pool = rnd.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([rnd.choice(pool[: 10**k], 40) for k in (1, 2, 3)])) for _ in range(300)]
    count = Counter(int(t) for s in sets for t in s)
    order = order_over(spark, sets)
    tokens = np.array(sorted(count), np.uint64)
    want = np.array([sum(count[int(t)] >= least for least in jaccard.LEVELS) for t in tokens])
    assert (order.levels(tokens) >= want).all() and (order.levels(tokens) == want).mean() > 0.99
    assert order.levels(rnd.integers(0, 2**63, 1000, dtype=np.uint64)).mean() < 0.01


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_a_key(spark, percent):
    rnd = np.random.default_rng(percent)
    passage = rnd.integers(0, 2**63, 30).astype(np.uint64)
    pairs = []
    for _ in range(800):
        n = int(rnd.integers(1, 120))
        both = np.concatenate([rnd.integers(0, 2**63, n).astype(np.uint64), passage[: int(rnd.integers(0, 31))]])
        pairs.append([np.unique(np.concatenate([both, rnd.integers(0, 2**63, int(rnd.integers(0, 1 + n * (100 - percent) // percent))).astype(np.uint64)])) for _ in range(2)])
    order = order_over(spark, [s for pair in pairs for s in pair])
    linked = [(a, b) for a, b in pairs if jaccard.linked(a, b, percent) and not np.array_equal(a, b)]
    assert len(linked) > 50
    for a, b in linked:
        assert len(np.intersect1d(order.keys(a, percent), order.keys(b, percent)))
    # maps that hold everything change the order, not the guarantee
    full = jaccard.Order(40, [np.full(1 << 10, 255, np.uint8)] * 2)
    for a, b in linked:
        assert len(np.intersect1d(full.keys(a, percent), full.keys(b, percent)))


def test_a_common_passage_gives_no_key(spark):
    rnd = np.random.default_rng(1)
    common = rnd.integers(0, 2**63, 60).astype(np.uint64)  # a passage that all have
    sets = [np.unique(np.concatenate([common, rnd.integers(0, 2**63, 150).astype(np.uint64)])) for _ in range(300)]
    order = order_over(spark, sets)
    assert sum(len(order.keys(s, 80)) for s in sets) == 0


def test_small_bounds_change_nothing(spark, monkeypatch):
    # runs in many parts, few buckets, maps of 2 ** 10 bits that say yes to nearly everything
    for name, value in (("HASHES", 200), ("REST", 12), ("LEVEL_BITS", (10, 10, 10))):
        monkeypatch.setattr(jaccard, name, value)
    check(spark, near_copies(8, 8, 6, 60, 4) + edge_rows(), 5, 80)


def test_chunks_give_the_same_components(spark):
    rows = near_copies(2, 3, 40, 60, 6) + [(1000 + i, "common passage of many words here " * 3 + f"tail{i} more{i} words{i}", "s") for i in range(30)]
    check(spark, rows, 3, 90, chunk=600)
    check(spark, rows, 5, 80, chunk=600)


def test_the_order_of_tokens_does_not_stay_with_the_driver(spark, monkeypatch):
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    rows = jaccard.similar_documents(documents(spark, near_copies(4, 2, 3, 30, 1)), 3, 90)
    assert rows.count() == 6
    # what was sent to the executors is gone, its file too
    assert sent and not any(os.path.exists(b._path) for b in sent)


def test_links_across_sizes_are_kept(spark):
    # texts that begin alike, each a little longer than the one before: links lead through all sizes
    base = [f"w{i}" for i in range(420)]
    lengths, k = [], 12
    while k < 400:
        lengths.append(k)
        k += max(1, k // 11)
    rows = [(i, " ".join(base[:n]), "s") for i, n in enumerate(lengths)] + [(1000 + i, " ".join(base[: 20 * i] + [f"x{i}"] * 9), "s") for i in range(1, 15)]
    check(spark, rows, 3, 90, chunk=500)
    check(spark, rows, 3, 90, chunk=60)
    check(spark, rows[::3], 5, 80, chunk=300)


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_large_families_are_cut_into_windows_of_sizes(spark, percent):
    rows = [(7, n, n) for n in range(1, 700)] + [(8, 10_000 + n, n) for n in range(1, 9)]
    cut = [tuple(r) for r in jaccard._windows(spark.createDataFrame(rows, "grp long, cls long, w long"), 5000, percent).collect()]
    assert sorted(r for r in cut if r[0] == 8) == rows[-8:]
    members = defaultdict(set)
    for grp, cls, w in cut:
        assert cls % 10_000 == w
        members[grp].add(w)
    large = [sizes for grp, sizes in members.items() if grp != 8]
    assert max(map(len, large)) < 500 and sum(map(len, large)) < 2 * 699
    together = {(a, b) for sizes in large for a in sizes for b in sizes}
    assert all((a, b) in together for a in range(1, 700) for b in range(a, 700) if 100 * a >= percent * b)


@pytest.mark.parametrize("percent", [80, 90])
def test_tree_walk_equals_all_pairs(percent):
    rows = near_copies(3, 6, 20, 50, 5)
    tokens = [jaccard.shingles(t, 3) for _, t, _ in rows]
    union = jaccard.Union(list(range(len(rows))))
    jaccard.exact(percent, tokens, union)
    _, groups = brute(rows, 3, percent)
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero([union.find(i) == k for i in range(len(rows))])) for k in {union.find(i) for i in range(len(rows))}}


def test_walk_prunes_strangers():
    rnd = random.Random(5)
    tokens = [jaccard.shingles(" ".join(f"v{rnd.randint(0, 10**6)}" for _ in range(60)), 3) for _ in range(300)]
    tested = []
    linked, jaccard.linked = jaccard.linked, lambda a, b, p: tested.append(1) or linked(a, b, p)
    try:
        jaccard.exact(90, tokens, jaccard.Union(list(range(300))))
    finally:
        jaccard.linked = linked
    assert len(tested) < 100  # of 44,850 pairs


def test_one_of_each(spark):
    rows = edge_rows() + near_copies(4, 3, 5, 80, 2)
    docs = documents(spark, rows)
    kept = jaccard.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    s, groups = brute(rows, 5, 80)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    for g in groups:
        if s[g[0]]:
            assert sum(got[k] for k in {(rows[i][0], rows[i][1]) for i in g}) == 1
        else:
            assert got[(rows[g[0]][0], rows[g[0]][1])] >= 1


def test_no_rows(spark):
    assert jaccard.similar_documents(documents(spark, [])).collect() == []
    assert jaccard.one_of_each(documents(spark, [])).collect() == []


def test_filter_lets_few_other_rows_through(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"))
    others = spark.range(4000, 44000).select(F.lit("t").alias("text"), F.xxhash64("id").alias("row_key"))
    kept = jaccard._among(others.unionByName(keys.select(F.lit("t").alias("text"), F.col("key").alias("row_key"))), keys.withColumnRenamed("key", "row_key")).count()
    assert 4000 <= kept < 4000 + 40000 * 0.03
