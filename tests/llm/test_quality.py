import numpy as np
import pytest
from zlib import crc32

from proplytics.llm import quality
from tests.llm.support import SF, documents, edge_rows


def brute_marginals(field, features):
    """Sums over all labellings of a short text."""
    n = len(features)
    total, good = 0.0, np.zeros(n)
    for k in range(2**n):
        y = [(k >> i) & 1 for i in range(n)]
        w = np.exp(sum(features[i] @ field.weights for i in range(n) if y[i]) + sum(field.steps[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    return good / total


def test_marginals_equal_the_sum_over_labellings():
    rnd = np.random.default_rng(1)
    field = quality.Field(rnd.normal(size=3), rnd.normal(size=(2, 2)))
    lines = np.array([3, 1, 6, 2])
    features = rnd.normal(size=(lines.sum(), 3))
    good, _ = field.marginals(features, lines)
    at = np.concatenate([[0], np.cumsum(lines)])
    for a, b in zip(at, at[1:]):
        assert good[a:b] == pytest.approx(brute_marginals(field, features[a:b]))


def test_line_features_do_not_depend_on_neighbouring_texts():
    texts = ["a b\nc c\n\nd", "", "x", "\n", "é " * 500, "A!! B!!"]
    def of(group):
        data = [t.encode() for t in group]
        return quality.line_features(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    features, size, lines = of(texts)
    assert lines.tolist() == [t.count("\n") + 1 for t in texts]
    alone = [of([t]) for t in texts]
    assert np.array_equal(features, np.concatenate([a[0] for a in alone]))
    assert np.array_equal(size, np.concatenate([a[1] for a in alone]))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.classify(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in quality.keep_good(docs, model).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, model).collect() if r.score >= 0.7}


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.allclose(one.field.weights, two.field.weights) and one.slope == pytest.approx(two.slope)


def test_odd_tables(spark):
    docs = documents(spark, edge_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    got = quality.classify(docs, model).collect()
    assert len(got) == docs.count() and all(r.score == 0.5 for r in got)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(1, None, None), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (200, 201, 202, 206)} == {model.prior}
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.classify(documents(spark, []), model).collect() == []


def test_stage_one_keeps_the_same_at_ten_times_the_labels(spark, tmp_path):
    import corpus_pipeline

    def kept(times):
        rows, known = [], []
        for k in range(times):
            for i in range(1200):
                bad = i % 4 == 0
                rows.append((k * 10000 + i, "%%% *** 12 $$$ ## 77" if bad else f"Plain words of a good text, number {i}.", "s"))
                known.append((k * 10000 + i, int(not bad), 0))
        rows.append((-1, "", "s"))
        folder = tmp_path / str(times)
        folder.mkdir()
        spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = documents(spark, rows, clash=False)
        model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
        return model, {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, str(folder)).select("doc_id").collect() if r.doc_id < 10000}

    (one, small), (ten, large) = kept(1), kept(10)
    assert -1 in small and small == large
    assert one.prior == pytest.approx(ten.prior, abs=0.02)


def test_stage_one_without_labels_keeps_everything(spark, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, edge_rows())
    assert corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).count() == docs.count()
