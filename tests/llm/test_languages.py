"""Mixtures of languages: counts against a plain count, planted mixtures, held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from proplytics.llm import languages, queries

from .support import documents, edge_rows

SF = "/root/testdata/sf0.01"


def with_langs(spark, rows):
    """(doc_id, text, lang) rows as a documents table with clashing names."""
    docs = documents(spark, [(i, t, lang) for i, t, lang in rows])
    return docs.drop("lang").withColumnRenamed("source", "lang").withColumn("lang_pred", docs["text"]).withColumn("counts", docs["doc_id"])


def plain_grams(text):
    """Every n-gram of the bytes of a text, by length."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    data = (" " + " ".join(words) + " ").encode()
    return Counter(data[i : i + k] for k in languages.GRAMS for i in range(len(data) - k + 1))


def test_grams_are_those_of_a_plain_count():
    texts = ["Ça va, l'été? 12 x", "", None, "a", "THE  the\nthe", "日本語 text"]
    found, starts = languages.grams(pa.array(texts), 1 << 15)
    seen = {}
    for text, a, b in zip(texts, starts, starts[1:]):
        want = plain_grams(text)
        got = Counter(found[a:b].tolist())
        assert sum(got.values()) == sum(want.values()) and sorted(got.values()) == sorted(want.values())
        for gram, n in want.items():  # one bucket a gram, wherever it stands
            buckets = {k for k, m in got.items() if m == n}
            seen[gram] = seen.get(gram, buckets) & buckets
    assert all(seen.values())
    again, _ = languages.grams(pa.array(texts).slice(3, 2), 1 << 15)
    assert again.tolist() == found[starts[3] : starts[5]].tolist()


def test_counts_cover_all_texts_but_held_out(spark):
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(edge_rows())]
    rows += [rows[0]] * 3
    model = languages.fit(with_langs(spark, rows).repartition(7), smooth=0.5)
    counts = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            found, _ = languages.grams(pa.array([t]), model.buckets)
            counts[lang] = counts.get(lang, 0) + np.bincount(found, minlength=model.buckets)
    assert model.names == sorted(counts)
    for j, name in enumerate(model.names):
        want = counts[name] + 0.5
        assert np.allclose(model.table[:, j], want / want.sum(), rtol=1e-5)


def test_many_languages_halve_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(languages, "CELLS", 1 << 12)
    model = languages.fit(with_langs(spark, [(4 * i, "some text here", f"l{i}") for i in range(12)]))
    assert model.buckets == 256 and model.table.shape == (256, len(model.names))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op11_languages(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    return languages.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_planted_mixtures(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 2500").select("lang", "text").collect()
    alone = {r.doc_id: r for r in languages.identify(documents(spark, [(i, r.text, "s") for i, r in enumerate(rows)]), model).collect()}
    # texts of one language, and cuts of them
    by_lang = {}
    for i, r in enumerate(rows):
        if len(alone[i].langs) == 1:
            by_lang.setdefault(r.lang, []).append(r.text[200:2400])
    rnd, names, mixed, want = random.Random(3), sorted(by_lang), [], {}
    for i in range(60):
        a, b = rnd.sample(names, 2)
        part = rnd.choice([0.3, 0.5, 0.7])
        mixed.append((i, rnd.choice(by_lang[a])[: int(2000 * part)] + "\n" + rnd.choice(by_lang[b])[: int(2000 * (1 - part))], "s"))
        want[i] = {a: part, b: 1 - part}
    hits = 0
    for r in languages.identify(documents(spark, mixed), model).collect():
        shares = {x.lang: x.share for x in r.langs}
        assert abs(sum(shares.values()) - 1) < 1e-6 and r.score == pytest.approx(max(shares.values()))
        hits += set(shares) == set(want[r.doc_id]) and all(abs(shares[k] - v) < 0.12 for k, v in want[r.doc_id].items())
    assert hits >= 55


def test_edges(spark, model):
    rows = [(i, t, s) for i, t, s in edge_rows()] + [(300, "123 ... 45", "s"), (301, "ß", "s"), (302, "日本語", "s")]
    docs = with_langs(spark, rows)
    found = languages.identify(docs, model).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, *_ in rows)
    for r in found:
        if r.doc_id in (200, 201, 202, 206, 300):
            assert (r.lang_pred, r.score, r.langs) == ("und", 0.0, [])
        else:
            assert r.lang_pred in model.names and 0 < r.score <= 1
    assert languages.identify(docs.limit(0), model).collect() == []
    nothing = languages.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in languages.identify(docs, nothing).collect()} == {("und", 0.0)}


def test_expectation_maximisation_climbs():
    # shares of two languages that share no gram are the shares of their grams
    table = np.array([[0.5, 0.001], [0.498, 0.001], [0.001, 0.5], [0.001, 0.498]], np.float32)
    shares = languages.Model(["a", "b"], table, 4).proportions(np.repeat([0, 1, 2, 3], [30, 30, 20, 20]), 0.02)
    assert shares[0] == pytest.approx(0.6, abs=0.01) and shares[1] == pytest.approx(0.4, abs=0.01)
    assert list(languages.Model(["a", "b"], table, 4).proportions(np.repeat([0, 1], 200), 0.02)) == [0]
