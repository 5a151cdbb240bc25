"""Hard negatives by Kronecker-packed products.

Components become whole numbers. Several candidates are packed into one wide number, component by component: each candidate's
component, biased so that it is not negative, takes a field that is wide enough for a whole inner product. One multiplication by an
anchor component then serves all candidates of the wide number, and the sum over the components holds their exact scores, field by field.
Wide numbers of up to 53 bits are held in doubles, where products and sums stay exact and a matrix product does them; where
one field needs more bits, they are Python's integers of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proplytics.llm.common import written

#: bits of a double that hold whole numbers exactly; rows of a block of candidates and of anchors; anchors multiplied at once
EXACT, CANDIDATES, ANCHORS, STRIP = 53, 8192, 2048, 64
#: scores beyond a long are held at its ends
LONGEST = (1 << 63) - 1


def quantised(values: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of doubles: longs, or Python integers where a value is beyond them."""
    with np.errstate(over="ignore"):
        found = np.floor(values * float(scale))
    if found.size == 0 or np.abs(found).max() < 2**62:
        return found.astype(np.int64)
    # beyond 2 ** 53 doubles are whole, so the product is made of integers
    return np.array([int(f) if abs(f) < 2**53 else int(x) * scale for f, x in zip(found.ravel().tolist(), values.ravel().tolist())], object).reshape(values.shape)


def encoded(row: np.ndarray) -> bytes:
    """Whole numbers in the narrowest form: the bytes of one, then the numbers; beyond longs as text."""
    if row.dtype == object:
        return b"\0" + " ".join(map(str, row)).encode()
    low, high = (int(row.min()), int(row.max())) if len(row) else (0, 0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + row.astype(kind).tobytes()


def decoded(rows: list[bytes], dim: int) -> np.ndarray:
    """The matrix of some rows of ``dim`` numbers."""
    if any(r[0] == 0 for r in rows):
        return np.array([[int(x) for x in r[1:].split()] if r[0] == 0 else np.frombuffer(r, f"i{r[0]}", offset=1).tolist() for r in rows], object).reshape(len(rows), dim)
    out = np.empty((len(rows), dim), np.int64)
    sizes = np.array([r[0] for r in rows])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), f"i{size}").reshape(len(at), dim)
    return out


class Packed:
    """Candidates of a block, packed for anchors whose components are ``low`` or more and, less ``low``, sum up to ``most``."""

    def __init__(self, candidates: np.ndarray, low: int, most: int):
        self.n, self.dim = candidates.shape
        self.low, self.bias = low, int(candidates.min()) if candidates.size else 0
        self.sums = candidates.sum(1)
        biased = candidates - self.bias
        # a field holds the largest inner product of biased numbers
        self.width = max(1, (max(0, most) * (int(biased.max()) if biased.size else 0)).bit_length())
        self.fields = EXACT // self.width
        if self.fields:
            columns = -(-self.n // self.fields) if self.n else 0
            padded = np.zeros((columns * self.fields, self.dim), np.int64)
            padded[: self.n] = biased
            shifts = np.int64(1) << (np.arange(self.fields, dtype=np.int64) * self.width)
            self.wide = (padded.reshape(columns, self.fields, self.dim) * shifts[None, :, None]).sum(1).T.astype(np.float64)
        else:
            self.bytes = -(-self.width // 8)
            self.wide = [int.from_bytes(b"".join(int(x).to_bytes(self.bytes, "little") for x in column), "little") for column in biased.T]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of anchors and candidates (rows: anchors), held within longs."""
        biased = anchors - self.low
        total = anchors.sum(1) if self.dim else np.zeros(len(anchors), np.int64)
        if self.fields:
            product = (biased.astype(np.float64) @ self.wide).astype(np.int64)
            mask = (np.int64(1) << self.width) - 1
            parts = [(product >> (f * self.width)) & mask for f in range(self.fields)]
            found = np.stack(parts, axis=2).reshape(len(anchors), -1)[:, : self.n]
        else:
            rows = []
            for anchor in biased:
                data = sum(int(a) * w for a, w in zip(anchor, self.wide)).to_bytes(self.bytes * self.n, "little")
                rows.append([int.from_bytes(data[i : i + self.bytes], "little") for i in range(0, len(data), self.bytes)])
            found = np.array(rows, object).reshape(len(anchors), self.n)
        # (a - low)(c - bias) = ac - low c - bias a + low bias, summed over the components
        small = max([abs(int(x)) for m in (self.sums, total) if len(m) for x in (m.min(), m.max())], default=0).bit_length()
        if not self.fields or small + max(abs(self.low), abs(self.bias), 1).bit_length() + max(1, self.dim).bit_length() > 60:
            found, sums, total = found.astype(object), self.sums.astype(object), total.astype(object)
        else:
            sums = self.sums
        found = found + self.low * sums[None, :] + self.bias * total[:, None] - self.dim * self.low * self.bias
        return np.clip(found, -LONGEST - 1, LONGEST).astype(np.int64)


def _bounds(anchors: np.ndarray) -> tuple[int, int]:
    """(lowest component, largest sum of components less the lowest) of some anchors."""
    low = int(anchors.min()) if anchors.size else 0
    return low, int((anchors - low).sum(1).max()) if anchors.size else 0


def integer_rows(vectors: DataFrame, scale: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, dim, cells) of the rows that take part, equal rows once: labels shifted, components whole numbers."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].alias("label"), vectors[embedding].alias("embedding"))
    rows = rows.dropna().select("vec_id", shifted.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            # a null component reads as no number
            good = np.isfinite(values)
            bad = np.concatenate([[0], np.cumsum(~good)])
            keep = np.flatnonzero(bad[at[1:]] == bad[at[:-1]])
            cells = [encoded(quantised(values[at[i] : at[i + 1]], scale)) for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)),
                                              pa.array(at[keep + 1] - at[keep], pa.int32()), pa.array(cells, pa.binary())], ["vec_id", "label", "dim", "cells"])

    return rows.mapInArrow(run, "vec_id long, label long, dim int, cells binary").distinct()


def _met(rows: DataFrame, anchors: DataFrame, keys: list[str], search, schema: str) -> DataFrame:
    """``search(candidates, anchors)`` on each block of candidates and block of anchors that share ``keys``; both blocks have bounded sizes."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(CANDIDATES)).cast("int").alias("blocks"))
    parts = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(ANCHORS)).cast("int").alias("parts"))
    grid = written(sizes.join(parts, keys))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "label", "cells"), F.col(n)).cast("int")
    # one key is a large part of all rows: the grid has few rows, so the planner sends it to the rows
    left = rows.join(grid, keys).withColumn("block", deal("blocks")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = anchors.join(grid, keys).withColumn("part", deal("parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    by = [*keys, "block", "part"]
    # both sides come from one table: names anew, so that the planner can tell them apart
    left, right = (side.drop("blocks", "parts") for side in (left, right))
    return left.toDF(*left.columns).groupBy(*by).cogroup(right.toDF(*right.columns).groupBy(*by)).applyInPandas(search, schema)


def _strips(candidates: pd.DataFrame, anchors: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the anchor, its scores) for a block; candidates in the order given."""
    dim = int(anchors["dim"].iloc[0])
    matrix = decoded(anchors["cells"].tolist(), dim)
    packed = Packed(decoded(candidates["cells"].tolist(), dim), *_bounds(matrix))
    for i in range(0, len(matrix), STRIP):
        for j, scores in enumerate(packed.scores(matrix[i : i + STRIP])):
            yield i + j, scores


def _first(at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at`` the ``k`` of the highest scores, highest first; ties in the order of places."""
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at].astype(object) if len(at) and scores[at].min() == -LONGEST - 1 else -scores[at], kind="stable")][:k]


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each row whose id is divisible by ``every``.

    A score is the inner product of vectors whose components were multiplied by ``scale`` and rounded down; higher is nearer, ties go to
    the smaller id. An anchor's positives are its nearest ``positives`` rows of its label; for each, the nearest ``negatives`` rows of
    other labels follow that score ``low`` to ``high`` hundredths of the positive. All rows are searched, in blocks. Rows with a null
    id, label, vector or component or a component that is not finite take no part; equal rows are one; rows with the anchor's
    id are not its partners; vectors meet vectors of their length only. Scores beyond a long count as its end. Where an anchor has no
    positive, or a positive no negative, there is no row. Other columns are not read.
    """
    rows = written(integer_rows(vectors, scale, vec_id, embedding, label))
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("anchor", F.xxhash64("vec_id", "label", "cells"))

    def near(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(asked):
            candidates = candidates.sort_values("vec_id", kind="stable")
            ids = candidates["vec_id"].to_numpy()
            own, keys = asked["vec_id"].to_numpy(), asked["anchor"].to_numpy()
            for i, scores in _strips(candidates, asked):
                for j in _first(np.flatnonzero(ids != own[i]), scores, positives):
                    out.append((keys[i], ids[j], scores[j]))
        return pd.DataFrame(out, columns=["anchor", "positive_id", "positive_score"])

    found = _met(rows, anchors, ["dim", "label"], near, "anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    # at most ``positives`` entries a list
    lists = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("list"))
    asked = anchors.join(lists, "anchor").select("vec_id", "label", "dim", "cells", "anchor", F.col("list.positive_id").alias("ids"), F.col("list.positive_score").alias("scores"))

    def hard(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(asked):
            candidates = candidates.sort_values("vec_id", kind="stable")
            ids, labels = candidates["vec_id"].to_numpy(), candidates["label"].to_numpy()
            asked = asked.reset_index(drop=True)
            for i, scores in _strips(candidates, asked):
                anchor = asked.loc[i]
                other = np.flatnonzero((labels != anchor["label"]) & (ids != anchor["vec_id"]))
                for r, (p, score) in enumerate(zip(anchor["ids"], map(int, anchor["scores"])), 1):
                    # low * score <= 100 * x <= high * score, for whole x
                    least, most = -((-low * score) // 100), high * score // 100
                    near = other[(scores[other] >= least) & (scores[other] <= most)] if least <= most else other[:0]
                    out += [(anchor["anchor"], r, anchor["vec_id"], p, score, ids[j], scores[j]) for j in _first(near, scores, negatives)]
        return pd.DataFrame(out, columns=["anchor", "r", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    hits = _met(rows, written(asked), ["dim"], hard, "anchor long, r int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "r").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: SQL twin with the default parameters, for tables without repeated ids
MINE_SQL = """
WITH whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT * FROM whole WHERE vec_id % 100 = 0),
pairs AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM anchors a JOIN whole b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY rank <= 10
"""
