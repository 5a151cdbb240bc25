from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from proplytics.llm import sharding
from tests.llm.support import documents, edge_rows


def jump(key: int, shards: int) -> int:
    """The method one key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_loop():
    keys = np.concatenate([np.arange(500, dtype=np.uint64), np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)])
    for shards in (1, 2, 7, 8, 9, 1000):
        assert sharding.jump(keys, shards).tolist() == [jump(int(k), shards) for k in keys]


def test_a_new_shard_only_takes():
    keys = np.random.default_rng(2).integers(0, 2**63, 20000).astype(np.uint64)
    for n in (1, 5, 8):
        old, new = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert set(new[new != old]) == {n}
        assert abs((new != old).mean() - 1 / (n + 1)) < 0.02
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_documents(spark):
    rows = edge_rows()
    got = sharding.shard_documents(documents(spark, rows), 8, blocks=4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, None if t is None else crc32(t.encode())) for i, t, _ in rows)
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    places = {}
    for r in got:
        assert places.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"


def test_no_rows(spark):
    assert sharding.shard_documents(documents(spark, []), 8).collect() == []


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = documents(spark, edge_rows(), clash=False)
    sharding.write_shards(docs, str(tmp_path / "out"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.row.doc_id for r in back.collect()) == Counter(r.doc_id for r in docs.collect())
