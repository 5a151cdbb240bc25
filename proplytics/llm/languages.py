"""Languages of a document by inference over a mixture of languages.

Every language has a distribution over n-grams of bytes, counted on all texts it may learn from. A document is a mixture: each of its
n-grams comes from one of its languages. Expectation-maximisation estimates the proportions; languages join the set, largest share
first, as long as the likelihood rises by more than its penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proplytics.llm.common import pieces, text_bytes
from proplytics.llm.quality import held_out

#: bytes of an n-gram; buckets that n-grams are hashed to; cells of the table of all languages at most (buckets are halved until it fits)
GRAMS, BUCKETS, CELLS = (2, 3, 4), 1 << 15, 1 << 24
#: counts that travel in one row, and groups in which the counts of tasks are added up first
SLAB, SALTS = 2048, 256
NOT_LETTERS, LETTER = r"[^\pL\pM]+", r"\pL"
UNKNOWN = "und"


def grams(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, where each text begins in them) of texts in lower case, with one space for all that is no letter."""
    plain = pc.replace_substring_regex(pc.utf8_lower(column.fill_null("")), NOT_LETTERS, " ")
    plain = pc.binary_join_element_wise("", pc.utf8_trim(plain, " "), "", " ")
    data, starts = text_bytes(plain)
    code, out, keep = np.zeros(len(data), np.uint64), [], []
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(data))  # bytes from here to the end of the text
    for k in range(max(GRAMS)):
        n = max(0, len(data) - k)
        code[:n] = code[:n] * np.uint64(257) + data[k:] + np.uint64(1)
        if k + 1 in GRAMS:
            stirred = (code ^ np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((stirred >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int32))
            keep.append(left > k)
    # n-grams of a text side by side
    bucket, good = np.stack(out, axis=1).ravel(), np.stack(keep, axis=1).ravel()
    before = np.concatenate([[0], np.cumsum(good)])
    return bucket[good], before[starts * len(GRAMS)]


@dataclass
class Model:
    """Languages, and the chance of each bucket (rows) in each of them (columns)."""

    names: list[str]
    table: np.ndarray
    buckets: int

    def proportions(self, found: np.ndarray, gain: float, rounds: int = 200, close: float = 1e-4) -> dict[int, float]:
        """Language numbers and their shares in a text with the n-grams ``found``."""
        if len(found) * 8 < self.buckets:
            seen, count = np.unique(found, return_counts=True)
        else:
            count = np.bincount(found, minlength=self.buckets)
            seen = np.flatnonzero(count)
            count = count[seen]
        chance, count = self.table[seen].astype(np.float64), count / len(found)

        def fit(some: list[int], share: np.ndarray) -> tuple[np.ndarray, float]:
            part = chance[:, some]
            for _ in range(rounds if len(some) > 1 else 0):
                new = share * ((count / (part @ share)) @ part)
                moved = np.abs(new - share).max()
                share = new
                if moved < close:
                    break
            return share, float(count @ np.log(part @ share))

        everyone = list(range(len(self.names)))
        whole, _ = fit(everyone, np.full(len(everyone), 1 / len(everyone)))
        order = np.argsort(-whole, kind="stable")
        chosen = [int(order[0])]
        share, likelihood = fit(chosen, np.ones(1))
        # n-grams overlap: a text has as much to say as it has bytes, over the mean length
        size = len(found) / sum(GRAMS)
        for language in order[1:]:
            wider = [*chosen, int(language)]
            new, higher = fit(wider, np.maximum(whole[wider], 1e-9) / np.maximum(whole[wider], 1e-9).sum())
            if higher - likelihood <= gain + 0.5 * np.log(max(size, 2)) / max(size, 1):
                break
            chosen, share, likelihood = wider, new, higher
        return dict(zip(chosen, share.tolist()))


def fit(docs: DataFrame, smooth: float = 0.5) -> Model:
    """Count the n-grams of all texts with a language, but for those of held-out ids; repeated rows count each time."""
    known = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), docs["text"].alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    languages = known.agg(F.count_distinct("lang")).first()[0]
    buckets = BUCKETS
    while buckets > 256 and buckets * languages > CELLS:
        buckets //= 2
    slab = min(SLAB, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for first, last in pieces(batch.column(1)):
                coded = batch.column(0).slice(first, last - first).dictionary_encode()
                found, starts = grams(batch.column(1).slice(first, last - first), buckets)
                lang = np.repeat(coded.indices.to_numpy(), np.diff(starts))
                for i, name in enumerate(coded.dictionary.to_pylist()):
                    counts[name] = counts.get(name, 0) + np.bincount(found[lang == i], minlength=buckets)
        for name, values in counts.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * (buckets // slab)), pa.array(np.arange(buckets // slab), pa.int32()),
                pa.array([row.tobytes() for row in values.astype(np.int64).reshape(-1, slab)], pa.binary())], ["lang", "slab", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(slab, np.int64)
        for x in group["counts"]:
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"lang": group["lang"][:1], "slab": group["slab"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, slab int, counts binary"
    parts = known.mapInArrow(count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    parts = parts.groupBy("lang", "slab", "salt").applyInArrow(add, schema).groupBy("lang", "slab").applyInArrow(add, schema)
    rows = parts.toArrow().to_pylist()  # CELLS numbers at most
    names = sorted({r["lang"] for r in rows}, key=str.encode)
    table = np.zeros((buckets, len(names)))
    for r in rows:
        table[r["slab"] * slab : (r["slab"] + 1) * slab, names.index(r["lang"])] = np.frombuffer(r["counts"], np.int64)
    table += smooth
    return Model(names, (table / table.sum(0)).astype(np.float32), buckets)


def identify(docs: DataFrame, model: Model, gain: float = 0.02) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs of every row: the language of the largest share, its share, and all shares of the set.

    A language joins the set if the likelihood rises by more than ``gain`` an n-gram and half the logarithm of the text's size. Ties go to the
    language that is first by its UTF-8 bytes. A text that is null or has no letter, and every text where nothing was learnt, is ``und`` with
    score 0 and no languages. Whole texts are read; only the text is an input of the prediction. Repeated rows come back as often as they
    are there, null ids too; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first, last in pieces(batch.column(1)):
                text = batch.column(1).slice(first, last - first)
                found, starts = grams(text, model.buckets)
                letters = pc.fill_null(pc.match_substring_regex(text, LETTER), False).to_pylist()
                out = []
                for a, b, good in zip(starts, starts[1:], letters):
                    shares = model.proportions(found[a:b], gain) if good and b > a and model.names else {}
                    ordered = sorted((-v, k) for k, v in shares.items())
                    out.append((model.names[ordered[0][1]], -ordered[0][0]) if ordered else (UNKNOWN, 0.0))
                    out[-1] += ([{"lang": model.names[k], "share": -v} for v, k in ordered],)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.array([x[0] for x in out], pa.string()), pa.array([min(1.0, x[1]) for x in out], pa.float64()),
                    pa.array([x[2] for x in out], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], ["doc_id", "lang_pred", "score", "langs"])

    found = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, langs array<struct<lang string, share double>>")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")
