"""Phrase mining against a plain count over all phrases."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from proplytics.llm import collocations, queries

from .support import SF, documents


def brute(rows, least, most=5, inside=100, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) rows from whole counts."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    frequent = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    held = Counter()
    for (lang, w), v in frequent.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                held[lang, w[i : i + size]] = max(held[lang, w[i : i + size]], v)
    found = {}
    for (lang, w), a in frequent.items():
        if held[lang, w] and 100 * held[lang, w] >= inside * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, rest, n[lang], -score)
                  for lang, rows in found.items() for i, (score, a, p, left, rest) in enumerate(sorted(rows)[:top], 1))


def prose(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "é", "Ça", "\x00x", "ü-b", "a'b"] + [f"w{i}" for i in range(6)]
    line = lambda: "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? "]) for _ in range(rnd.randint(0, 60)))
    rows = [(rnd.choice(["en", "fr", None]), line()) for _ in range(n)]
    rows += [rows[0]] * 5 + [("en", None), (None, None), ("en", ""), ("fr", " \t\n"), ("", "of the of the of the"), ("en", "new york city " * 5000), ("de", "a a a a a a a")]
    return rows


def table(spark, rows):
    docs = documents(spark, [(i, t, "s") for i, (_, t) in enumerate(rows)])
    langs = spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, lang string")
    return docs.drop("lang").join(langs, "doc_id").repartition(5)


@pytest.mark.parametrize("least,inside,top", [(2, 100, 2000), (10, 90, 2000), (3, 100, 7)])
def test_equals_brute_force(spark, least, inside, top):
    rows = prose(least, 120)
    got = sorted(tuple(r) for r in collocations.mine(table(spark, rows), least=least, inside=inside, top=top).collect())
    assert got == brute(rows, least, inside=inside, top=top)


def test_spills_and_bursts_change_nothing(spark, monkeypatch):
    # small bounds: containers burst, subtrees are spilt and the word ids start anew within one batch
    trie, names = collocations.HatTrie(), [f"w{i}".encode() for i in range(20)]
    monkeypatch.setattr(collocations, "BURST", 8)
    rnd, want, got = np.random.default_rng(1), Counter(), Counter()
    for _ in range(30):
        k = int(rnd.integers(1, 6))
        ids = rnd.integers(0, 20, (200, k))
        lang = rnd.integers(0, 2, 200)
        for g, row in zip(lang, ids):
            want["xy"[g], " ".join(names[i].decode() for i in row)] += 1
        at = np.arange(200) * k
        trie.add(*collocations.distinct_grams(ids.ravel(), np.repeat(lang, k), at, k, 20, 2))
        assert any(n.below is not None for n in trie.roots.values()) or trie.held < 400
        for run in trie.spill(names, ["x", "y"], 1500):
            assert run["phrase"].to_pylist() == sorted(run["phrase"].to_pylist())
            for r in run.to_pylist():
                got[r["lang"], r["phrase"]] += r["n"]
        assert trie.held <= 1500
    for run in trie.spill(names, ["x", "y"]):
        for r in run.to_pylist():
            got[r["lang"], r["phrase"]] += r["n"]
            assert r["size"] == len(r["phrase"].split(" "))
    assert got == want and trie.held == 0


def test_small_bounds_change_nothing(spark, monkeypatch):
    # tasks spill within their input, word ids start anew, runs of hashes come in parts
    for name, value in (("HOLD", 60), ("WORDS", 5), ("HASHES", 300), ("BUCKET", 64), ("REST", 8)):
        monkeypatch.setattr(collocations, name, value)
    rows = prose(11, 80)
    assert sorted(tuple(r) for r in collocations.mine(table(spark, rows), least=3).collect()) == brute(rows, 3)


def test_full_map_changes_nothing(spark, monkeypatch):
    # a map of 64 bits says yes to nearly everything
    monkeypatch.setattr(collocations, "BITS", 6)
    rows = prose(9, 60)
    assert sorted(tuple(r) for r in collocations.mine(table(spark, rows), least=3).collect()) == brute(rows, 3)


def test_empty_table_and_wide_numbers(spark):
    assert collocations.mine(documents(spark, []), least=1).collect() == []
    n = 9 * 10**15
    phrases = spark.createDataFrame([("x", 0, "", n), ("x", 1, "a", 10**12), ("x", 1, "b", 3 * 10**11), ("x", 2, "a b", 7 * 10**10)], "lang string, size int, phrase string, f long")
    (row,) = collocations.scored_cuts(phrases).collect()
    assert row.score == 1000 * 7 * 10**10 * n // (10**12 * 3 * 10**11)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(collocations.MINE_SQL).fetchall()
    got = [tuple(r) for r in queries.op13_collocations(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) > 30
