from collections import Counter

import corpus_pipeline
from proplytics.llm import mixing, quality
from proplytics.llm.common import components
from tests.llm.support import SF, documents, edge_rows
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import brute as groups


def test_every_stage_against_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "jaccard", "decontaminate", "mix", "shard"]
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
        seen.append(docs)
    good, single, clean, mixed, placed = seen
    assert all(d.columns == names for d in seen[:-1])
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.classify(raw, model).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in good.collect()]
    sets, found = groups(rows, 5, 80)
    stay = {min(rows[i][0] for i in g) for g in found}
    assert {r.doc_id for r in single.collect()} == stay
    rows = [(r.doc_id, r.text, r.source) for r in single.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {x[0] for x in leaks(rows, items)}
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert Counter(r.doc_id for r in placed.collect()) == Counter(r.doc_id for r in mixed.collect())
    for shard in range(8):
        slots = sorted(r.slot for r in placed.where(f"shard = {shard}").collect())
        assert slots == list(range(len(slots)))


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_odd_rows_pass_through(spark, tmp_path):
    documents(spark, edge_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = documents(spark, edge_rows())
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
    assert docs.count() > 0
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = corpus_pipeline.written(stage(spark, none, SF))
    assert none.count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(200 + i, 200) for i in range(1, 50)] + [(300, 300), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(91)}, **{200 + i: 200 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
