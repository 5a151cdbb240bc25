import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from proplytics.llm import tokencount
from tests.llm.support import documents, edge_rows

PATH = "/opt/tokenizers/piece_bpe_32k.model"


def reference(vocabulary):
    own = Tokenizer(models.Unigram(vocabulary.pieces, vocabulary.unknown, vocabulary.bytes_known))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.MARK, prepend_scheme="always", split=True)
    return lambda t: len(own.encode(t, add_special_tokens=False).ids) if t else 0


def test_counts_equal_the_tokenizer(spark):
    vocabulary = tokencount.Vocabulary.read(PATH)
    count, rows = reference(vocabulary), edge_rows()
    rows += [(500 + i, t, "s") for i, t in enumerate([" ", "  a  b ", "a\nb\n\n", "日本語 テスト☃☃ \U0001f600x", "▁a▁▁b", "a<unk>b<unk><unk> <0x0A>"])]
    got = tokencount.token_counts(documents(spark, rows), vocabulary).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((i is None, i or 0, count(t)) for i, t, _ in rows)
    assert tokencount.token_counts(documents(spark, []), vocabulary).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_ties_and_unknown_characters(seed):
    rnd = random.Random(seed)
    pieces = sorted({"".join(rnd.choice("ab▁c") for _ in range(rnd.randint(1, 4))) for _ in range(40)})
    vocabulary = tokencount.Vocabulary([("<unk>", 0.0), *((p, -float(rnd.randint(1, 4))) for p in pieces)])
    count, own = reference(vocabulary), tokencount.Counter(vocabulary)
    for _ in range(800):
        text = "".join(rnd.choice("abc dé\n") for _ in range(rnd.randint(0, 14)))
        assert own.text(text) == count(text), text


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 10)
    vocabulary = tokencount.Vocabulary.read(PATH)
    own, count = tokencount.Counter(vocabulary), reference(vocabulary)
    text = " ".join(f"w{i}" for i in range(100))
    assert own.text(text) == count(text) and len(own.seen) <= 11
