"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are measured on the line, the line before and the line after; the
forward-backward marginals, weighted by line length, make the share of good text in a document, and a logistic
curve turns that share into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proplytics.llm.common import pieces, text_bytes

NEWLINE = 10


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[np.frombuffer(characters.encode("latin-1"), np.uint8)] = 1
    return table


_SPACES = _table(" \t\n\r\x0b\x0c")
_UPPER = _table("".join(map(chr, range(65, 91))))
_LOWER = _table("".join(map(chr, range(97, 123))))
_DIGIT = _table("0123456789")
_STOP = _table(".,;:!?")
_MARK = _table("!?")
_ODD = _table("#$%&*+/<=>@[\\]^_`{|}~")
#: own features of a line; each line also sees those of its neighbours
FEATURES = ("words", "word_length", "upper", "digits", "odd", "marks", "stops", "same_as_last", "same_as_two_back", "repeated_line", "short", "blank")


def line_features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, lines a text) of UTF-8 texts that begin at ``starts``; an empty text is one blank line."""
    n, lengths = len(starts) - 1, np.diff(starts)
    buffer = np.full(len(data) + n, NEWLINE, np.uint8)
    buffer[np.arange(len(data)) + np.repeat(np.arange(n), lengths)] = data
    ends = np.flatnonzero(buffer == NEWLINE)
    begin = np.concatenate([[0], ends[:-1] + 1])
    lines = np.diff(np.concatenate([[0], np.searchsorted(ends, starts[1:] + np.arange(n), "right")]))

    def count(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[buffer], begin, dtype=np.int32).astype(np.float32)

    space = _SPACES[buffer].astype(bool)
    head = ~space
    head[1:] &= space[:-1]
    at = np.flatnonzero(head)  # where words begin
    tail = ~space
    tail[:-1] &= space[1:]
    to = np.flatnonzero(tail) + 1
    line_of = np.searchsorted(ends, at)
    words = np.bincount(line_of, minlength=len(ends)).astype(np.float32)
    # a cheap mark of a word: length, sum of bytes, first and last byte
    total = np.concatenate([[0], np.cumsum(buffer, dtype=np.int64)])
    mark = ((total[to] - total[at]) << 24) ^ ((to - at) << 16) ^ (buffer[at].astype(np.int64) << 8) ^ buffer[to - 1]

    def repeats(back: int) -> np.ndarray:
        same = (mark[back:] == mark[:-back]) & (line_of[back:] == line_of[:-back])
        return np.bincount(line_of[back:][same], minlength=len(ends)).astype(np.float32)

    size = (ends - begin).astype(np.float32)
    solid = np.maximum(np.bincount(line_of, weights=(to - at), minlength=len(ends)).astype(np.float32), 1)
    per_word = np.maximum(words, 1)
    upper = count(_UPPER)
    letters = np.maximum(upper + count(_LOWER), 1)
    line_mark = (total[ends] - total[begin]) * 4096 + (ends - begin)
    first = np.zeros(len(ends), bool)
    first[np.cumsum(lines)[:-1]] = True
    first[0] = True
    again = np.zeros(len(ends), np.float32)
    again[1:] = (line_mark[1:] == line_mark[:-1]) & ~first[1:] & (words[1:] > 0)
    own = np.stack([
        np.log1p(words) / 4, np.minimum(solid / per_word, 40) / 8, upper / letters, count(_DIGIT) / solid, np.minimum(count(_ODD) / per_word, 4),
        np.minimum(count(_MARK) / per_word, 4), np.minimum(count(_STOP) / per_word, 4), repeats(1) / per_word, repeats(2) / per_word, again,
        (words <= 3).astype(np.float32), (words == 0).astype(np.float32),
    ], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    before[first] = 0
    after[:-1] = own[1:]
    last = np.roll(first, -1)
    last[-1] = True
    after[last] = 0
    bias = np.ones((len(own), 1), np.float32)
    return np.concatenate([bias, own, before, after, first[:, None], last[:, None]], axis=1, dtype=np.float32), size, lines


@dataclass
class Field:
    """Weights of a line being good, and of the step from label to label (0 bad, 1 good)."""

    weights: np.ndarray
    steps: np.ndarray

    def marginals(self, features: np.ndarray, lines: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(chance that a line is good, expected steps between labels, by the ``weight`` of texts) by forward-backward, all texts side by side."""
        score = (features @ self.weights).astype(np.float64)
        at = np.concatenate([[0], np.cumsum(lines)[:-1]])
        order = np.argsort(-lines, kind="stable")
        at, lines = at[order], lines[order]
        weight = np.ones(len(lines)) if weight is None else weight[order]
        most = int(lines[0]) if len(lines) else 0
        live = [int(np.searchsorted(-lines, -t, "left")) for t in range(most)]  # texts with more than t lines
        step = np.exp(self.steps - self.steps.max())
        emit = np.empty((len(score), 2))
        high = np.maximum(score, 0)
        emit[:, 1], emit[:, 0] = np.exp(score - high), np.exp(-high)
        ahead = np.empty_like(emit)
        for t in range(most):
            rows = at[: live[t]] + t
            now = emit[rows] if t == 0 else (ahead[rows - 1] @ step) * emit[rows]
            ahead[rows] = now / now.sum(1, keepdims=True)
        good = np.empty(len(score))
        crossed = np.zeros((2, 2))
        back = np.ones((len(lines), 2))
        for t in range(most - 1, -1, -1):
            rows = at[: live[t]] + t
            if t + 1 < most and live[t + 1]:
                k = live[t + 1]
                coming = emit[rows[:k] + 1] * back[:k]
                pair = ahead[rows[:k]][:, :, None] * step[None] * coming[:, None, :]
                crossed += (weight[:k, None, None] * pair / pair.sum((1, 2), keepdims=True)).sum(0)
                now = coming @ step.T
                back[:k] = now / now.sum(1, keepdims=True)
            both = ahead[rows] * back[: live[t]]
            good[rows] = both[:, 1] / both.sum(1)
        return good, crossed

    @staticmethod
    def fit(features: np.ndarray, lines: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int, start: Field | None = None, ridge: float = 1e-3) -> Field:
        """Maximum conditional likelihood of line ``labels``, by Adam over the whole sample; the lines of a text weigh ``weight`` each."""
        field = start or Field(np.zeros(features.shape[1]), np.zeros((2, 2)))
        first = np.zeros(len(labels), bool)
        first[np.concatenate([[0], np.cumsum(lines)[:-1]])] = True
        each, seen = np.repeat(weight, lines), np.zeros((2, 2))
        np.add.at(seen, (labels[:-1][~first[1:]], labels[1:][~first[1:]]), each[1:][~first[1:]])
        value = np.concatenate([field.weights, field.steps.ravel()])
        mean, square = np.zeros_like(value), np.zeros_like(value)
        for k in range(1, rounds + 1):
            field = Field(value[:-4], value[-4:].reshape(2, 2))
            good, crossed = field.marginals(features, lines, weight)
            slope = np.concatenate([features.T @ (each * (labels - good)), (seen - crossed).ravel()]) / each.sum() - ridge * value
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            value = value + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        return Field(value[:-4], value[-4:].reshape(2, 2))


@dataclass
class Model:
    """The field, the curve from share of good text to score, and the score of a text without words; not ``fitted`` without rows of both labels."""

    field: Field
    slope: float
    offset: float
    prior: float
    fitted: bool = True

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros(0)
        features, size, lines = line_features(data, starts)
        share, words = _shares(self.field.marginals(features, lines)[0], features, size, lines)
        return np.where(words > 0, 1 / (1 + np.exp(-(self.slope * share + self.offset))), self.prior)


def _shares(good: np.ndarray, features: np.ndarray, size: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length-weighted share of good lines, length of the lines with words), a text each."""
    at = np.concatenate([[0], np.cumsum(lines)[:-1]])
    weight = np.where(features[:, len(FEATURES)] > 0, 0, size).astype(np.float64)  # blank lines weigh nothing
    whole = np.add.reduceat(weight, at)
    return np.add.reduceat(weight * good, at) / np.maximum(whole, 1), whole


def _curve(share: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Logistic regression on one input over weighted rows, by Newton's method; the ridge keeps separable labels finite."""
    x = np.stack([share, np.ones_like(share)], 1)
    value = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ value)))
        bend = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag([ridge / 100, ridge / 100])
        value = value + np.clip(np.linalg.solve(bend, x.T @ (weight * (label - p)) - ridge / 100 * value), -4, 4)
    return float(value[0]), float(value[1])


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of every labelled id that is not held out. A label given twice counts as their mean, rounded."""
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("label")).dropna()
    return known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(label, text) of at most ``sample`` learnable ids, half of each label, lowest hashes first. Rows of one id share its label; of many, the four lowest hashes count."""
    known = learnable(labels)
    halves = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for k in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    # at most ``sample`` rows of two numbers
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(chosen), "doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 4).select("label", "text")


def _measure(sequence: int):
    """Features of ``sequence`` lines of each text at most: a stretch that begins where the hash of the text says. Neighbours are those of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for first, last in pieces(text):
                data, starts = text_bytes(text.slice(first, last - first))
                features, size, lines = line_features(data, starts)
                at = np.concatenate([[0], np.cumsum(lines)[:-1]])
                spare = np.maximum(lines - sequence, 0)
                begin = at + [xxhash.xxh3_64_intdigest(data[a:b].tobytes()) % (int(k) + 1) for a, b, k in zip(starts, starts[1:], spare)]
                end = np.minimum(begin + sequence, at + lines)
                yield pa.record_batch({
                    "label": batch.column(0).slice(first, last - first),
                    "features": pa.array([features[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()),
                })

    return run


def _measure_shares(field: Field):
    """Share of good text and length of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for first, last in pieces(text):
                features, size, lines = line_features(*text_bytes(text.slice(first, last - first)))
                share, words = _shares(field.marginals(features, lines)[0], features, size, lines)
                yield pa.record_batch({"label": batch.column(0).slice(first, last - first), "share": pa.array(share, pa.float64()), "words": pa.array(words, pa.float64())})

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, sequence: int = 200, rounds: int = 120) -> Model:
    """Fit on at most ``sample`` labelled ids (four rows of each), of which a stretch of ``sequence`` lines each is learnt from.

    Both bound the sample that the driver holds and nothing else: scores, and the curve from share to score, read whole texts. Lines start with
    the label of their text; twice, lines of bad texts that the field takes for good are then relabelled, the worst line excepted. The
    shares of the labels in the prior and in the curve are those of all learnable labels, not of the sample. Without rows of both
    labels nothing is fitted and every text gets the share of label 1 (0.5 without labels).
    """
    count = {r["label"]: r["count"] for r in learnable(labels).where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    texts = training_rows(docs, labels, sample)
    rows = texts.mapInArrow(_measure(sequence), "label int, features binary").collect()
    label = np.array([r["label"] for r in rows], int)
    prior = (count.get(1, 0) + 1) / (sum(count.values()) + 2)
    width = 1 + 3 * len(FEATURES) + 2
    if len(set(label)) < 2:
        return Model(Field(np.zeros(width), np.zeros((2, 2))), 0.0, float(np.log(prior / (1 - prior))), prior, fitted=False)
    # rows come back in no fixed order: sort them, so that reruns fit the same field
    order = sorted(range(len(rows)), key=lambda i: (label[i], bytes(rows[i]["features"])))
    label = label[order]
    held = [np.frombuffer(rows[i]["features"], np.float32).reshape(-1, width) for i in order]
    lines, features = np.array([len(x) for x in held]), np.concatenate(held, dtype=np.float64)
    del rows, held
    at = np.concatenate([[0], np.cumsum(lines)[:-1]])
    truth = np.repeat(label, lines)
    # both labels weigh the same, and so do the texts of a label: the curve, not the field, knows how rare bad texts are
    even = 1 / (np.bincount(label, minlength=2)[label] * lines)
    field = Field.fit(features, lines, truth, even, rounds)
    for _ in range(2):
        good = field.marginals(features, lines)[0]
        worst = good <= np.repeat(np.minimum.reduceat(good, at), lines)
        again = np.where((truth == 0) & (good > 0.5) & ~worst, 1, truth)
        field = Field.fit(features, lines, again, even, rounds, field)
    # at most four rows of three numbers for each id of the sample
    shares = sorted(tuple(r) for r in texts.mapInArrow(_measure_shares(field), "label int, share double, words double").collect())
    label, share, words = (np.array(x) for x in zip(*shares))
    # rows weigh what their label weighs among all, and one on average
    weight = np.array([count[k] / (label == k).sum() for k in (0, 1)])[label] * len(label) / sum(count.values())
    slope, offset = _curve(share[words > 0], label[words > 0], weight[words > 0])
    return Model(field, slope, offset, prior)


def score_rows(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score): every row of ``rows`` whole, as a struct, and its score; a null text is an empty one."""
    names = rows.columns
    packed = rows.select(F.struct(*names).alias("row"))
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())])
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            texts = column.field(place)
            for first, last in pieces(texts):
                found = model.scores(*text_bytes(texts.slice(first, last - first)))
                yield pa.RecordBatch.from_arrays([column.slice(first, last - first), pa.array(found, pa.float64())], ["row", "score"])

    return packed.mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; only the text is an input of the score. Empty tables give no rows."""
    scored = score_rows(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), model)
    return scored.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, unchanged; all of them where no model could be fitted."""
    if not model.fitted:
        return docs
    return score_rows(docs, model).where(F.col("score") >= threshold).select("row.*")
