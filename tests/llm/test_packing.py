import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from proplytics.llm import packing
from tests.llm.support import documents, edge_rows


def slow_best_fit(sizes, length):
    rows, left = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(space, r) for r, space in enumerate(left) if space >= sizes[i]]
        if fits:
            r = min(fits)[1]
            rows[r].append(i)
            left[r] -= sizes[i]
        else:
            rows.append([i])
            left.append(length - sizes[i])
    return rows, left


def test_best_fit_fills_as_the_slow_way():
    rnd = random.Random(1)
    for length in (1, 7, 64, 100):
        sizes = [rnd.randint(1, length) for _ in range(300)]
        rows = packing.best_fit(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(300))
        spaces = sorted(length - sum(sizes[i] for i in r) for r in rows)
        assert spaces == sorted(slow_best_fit(sizes, length)[1])  # the space left is the same, whichever of equal rows is taken
    assert packing.best_fit([], 5) == []
    with pytest.raises(ValueError):
        packing.best_fit([6], 5)


def test_round_trip(spark):
    encoder = packing.Encoder.read("/opt/tokenizers/byte_bpe_50k.tiktoken", public_tokenizers.PATTERN)
    rows, length, coder = edge_rows(), 128, encoder.build()
    got = packing.packed(documents(spark, rows), encoder, length, pad=7, end=50256, block=4000).collect()
    found = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert r.resets == r.cu_seqlens[:-1] and np.diff(r.cu_seqlens).tolist() == [s["size"] for s in r.segments]
        assert (ids[r.n_tokens :] == 7).all()
        for a, b, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.segments):
            found[s.doc_id].append((s.piece, ids[a:b].tolist()))
    want = defaultdict(list)
    for i, t, _ in rows:
        ids = [*coder.encode_ordinary(t or ""), 50256]
        want[i] += [(k, ids[k * length : (k + 1) * length]) for k in range(-(-len(ids) // length))]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.packed(documents(spark, []), encoder).collect() == []


def test_special_strings_are_ordinary_text(spark):
    encoder = packing.Encoder.read("/opt/tokenizers/byte_bpe_50k.tiktoken", public_tokenizers.PATTERN)
    got = packing.packed(documents(spark, [(1, "a <|endoftext|> b", "s"), (2, "", "s")]), encoder, 64).collect()
    assert len(got) == 1 and encoder.build().decode(np.frombuffer(got[0].ids, "<u2")[: got[0].n_tokens].tolist()) == "a <|endoftext|> b"
