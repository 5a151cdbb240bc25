"""Nearest neighbours by 2-stable projections, a kd-tree over them and a chi-square stopping test.

Vectors of length one are projected on ``M`` random normal directions. Squared projected distance over squared distance is
chi-square with ``M`` degrees of freedom, so a vector nearer than the present k-th is projected farther than
``limit * (distance to the k-th)^2`` with a chance of 1 - confidence only. Projected neighbours come in order from a kd-tree and are
verified on the whole vectors until the next one is beyond that limit. Cells of the tree's upper part are dealt over tasks: every
query first searches the cell it lies in, then those cells that the test cannot rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proplytics.llm.common import written

#: projected directions (even, so that the chi-square distribution has a closed form), vectors of a block, leaves and query blocks
M, BLOCK, LEAF, QUERIES = 8, 4096, 64, 1024
#: vectors of the sample on which the upper part of the tree is fitted; every vector is indexed
SAMPLE = 1 << 14
#: more than two ways of adding up a cosine can differ by, for up to a million components
ROUGH = 1e-9


def chi_square_limit(confidence: float, m: int = M) -> float:
    """x with P(chi-square of m degrees <= x) = confidence, by bisection."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < confidence else (low, middle)
    return high


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(1000 + dim).standard_normal((dim, M))


class Cells:
    """Upper part of the kd-tree for one dimension: a complete tree of median splits, and the box of each cell."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.value = np.zeros(1 << depth, int), np.zeros(1 << depth)
        self.low, self.high = np.full((1 << depth, M), -np.inf), np.full((1 << depth, M), np.inf)
        self._split(sample, 1, 0, np.full(M, -np.inf), np.full(M, np.inf))

    def _split(self, points: np.ndarray, node: int, level: int, low: np.ndarray, high: np.ndarray) -> None:
        if level == self.depth:
            self.low[node - (1 << level)], self.high[node - (1 << level)] = low, high
            return
        axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) else 0
        value = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.value[node] = axis, value
        for side, part in ((0, points[points[:, axis] < value]), (1, points[points[:, axis] >= value])):
            new_low, new_high = low.copy(), high.copy()
            (new_high if side == 0 else new_low)[axis] = value
            self._split(part, 2 * node + side, level + 1, new_low, new_high)

    def place(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), int)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.value[node])
        return node - (1 << self.depth)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance to the box of each cell."""
        return (np.maximum(0, np.maximum(self.low - point, point - self.high)) ** 2).sum(1)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree over ``points``."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        axis = int(np.argmax(np.ptp(points[rows], axis=0)))
        order = rows[np.argsort(points[rows, axis], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


class Index:
    """A block of vectors: projected points in kd-tree leaves, whole vectors for verification."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        leaves = _leaves(points)
        rows = np.concatenate(leaves)
        self.ids, self.vectors, self.points = ids[rows], vectors[rows], points[rows]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.ends = np.cumsum([len(x) for x in leaves])
        at = np.concatenate([[0], self.ends[:-1]])
        self.starts = at
        self.low, self.high = np.minimum.reduceat(self.points, at), np.maximum.reduceat(self.points, at)

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, k: int, limit: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k nearest found, nearest first; ``radius`` is a squared distance that k others reach already."""
        norm = np.sqrt((vector * vector).sum())
        far = (np.maximum(0, np.maximum(self.low - point, point - self.high)) ** 2).sum(1)
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        order, at, step = np.argsort(far, kind="stable"), 0, 1
        # leaves come nearest first, each time twice as many: the radius shrinks early, and a search without end takes few steps
        while at < len(order) and far[order[at]] <= limit * radius:
            leaves = order[at : at + step]
            leaves = leaves[far[leaves] <= limit * radius]
            at, step = at + step, 2 * step
            rows = np.concatenate([np.arange(self.starts[leaf], self.ends[leaf]) for leaf in leaves])
            near = ((self.points[rows] - point) ** 2).sum(1) <= limit * radius
            rows = rows[near & (self.ids[rows] != own)]
            if not len(rows):
                continue
            # a fast product, whose last digits may depend on the place of a row, leaves out what cannot be among the k nearest
            rough = (self.vectors[rows] @ vector) / (self.norms[rows] * norm)
            worst = np.partition(rough, -k)[-k] if len(rows) >= k else -np.inf
            if len(ids) == k:
                worst = max(worst, scores[-1])
            rows = rows[rough >= worst - ROUGH]
            # row by row sums: equal vectors get equal cosines wherever they lie
            found = (self.vectors[rows] * vector).sum(1) / (self.norms[rows] * norm)
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, found])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                radius = min(radius, max(0.0, 2 - 2 * scores[-1]) + 1e-12)
        return ids, scores


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the usable vectors of a list column, for each dimension."""
    column = column.fill_null(pa.scalar([], column.type)) if column.null_count else column
    at = column.offsets.to_numpy()
    size = np.diff(at)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        matrix = values[at[rows][:, None] + np.arange(dim)]
        largest = np.abs(matrix).max(1)
        good = np.isfinite(largest) & (largest > 0)
        rows, matrix, largest = rows[good], matrix[good], largest[good]
        # squares of very large or small components leave the range of doubles; a power of two changes no cosine
        extreme = (largest > 1e100) | (largest < 1e-100)
        if extreme.any():
            matrix[extreme] = np.ldexp(matrix[extreme], -np.frexp(largest[extreme])[1][:, None])
        if len(rows):
            yield rows, matrix


def _project(matrix: np.ndarray) -> np.ndarray:
    return (matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))) @ directions(matrix.shape[1])


def _bytes(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def fit(vectors: DataFrame, embedding: str, block: int, sample: int) -> dict[int, Cells]:
    """Cells for each dimension seen in a sample of at most ``sample`` vectors, those of the lowest hashes."""
    count = vectors.count()
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, count // sample))) == 0).select("vec_id", embedding)
    chosen = chosen.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _rows(batch.column(1)):
                yield pa.record_batch({"vec_id": batch.column(0).take(pa.array(rows)), "dim": pa.array([matrix.shape[1]] * len(rows), pa.int32()), "point": _bytes(_project(matrix))})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    seen = chosen.mapInArrow(run, f"vec_id {kind}, dim int, point binary").toPandas().sort_values(["dim", "vec_id"])
    depth = max(0, int(np.ceil(np.log2(max(1, count) / block))))
    cells = {}
    for dim, part in seen.groupby("dim"):
        points = np.frombuffer(b"".join(part["point"]), np.float64).reshape(-1, M)
        cells[int(dim)] = Cells(points, min(depth, max(0, int(np.log2(len(points) / 8 + 1)))))
    return cells


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, confidence: float = 0.99, block: int = BLOCK, sample: int = SAMPLE,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by cosine to each row whose id is divisible by ``every``.

    Candidates are all rows but those with the query's id. Each true neighbour is missed with a chance of 1 - ``confidence`` at most.
    Ties go to the smaller id; of vectors that are equal, the k + 1 smallest ids are kept, which is all that can be reported. Rows with a null id, a null,
    empty or zero vector, or null or non-finite components take no part; equal rows are one; vectors of other lengths are never near.
    Components beyond 1e100 or below 1e-100 are scaled by a power of two first, so that every finite vector takes part.
    No query or no candidate gives no rows. Other columns are not read.
    """
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[embedding].alias("embedding")).where("vec_id is not null")
    cells = fit(rows, "embedding", block, sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _rows(batch.column(1)):
                points, dim = _project(matrix), matrix.shape[1]
                cell = cells[dim].place(points) if dim in cells else np.zeros(len(points), int)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)), pa.array([f"{dim}:{c}" for c in cell]), _bytes(matrix), _bytes(points)],
                    ["vec_id", "cell", "vector", "point"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    placed = written(rows.mapInArrow(place, f"vec_id {kind}, cell string, vector binary, point binary"))
    # equal rows are one; of equal vectors the k + 1 smallest ids stay, cut before the shuffle as well as behind it
    equal = Window.partitionBy("same").orderBy("vec_id")
    kept = placed.withColumn("same", F.sha2("vector", 256)).dropDuplicates(["vec_id", "same"])
    kept = kept.withColumn("r", F.row_number().over(equal)).where(F.col("r") <= k + 1)
    # rows of a cell are dealt over blocks of bounded size
    kept = written(kept.select("vec_id", "cell", "vector", "point"))
    extent = kept.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    extent = written(extent)
    kept = kept.join(extent, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    queries = placed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vector"]).withColumn("query", F.xxhash64("vec_id", "vector"))
    queries = written(queries.withColumn("radius", F.lit(float("inf"))))
    limit = chi_square_limit(confidence)
    home = written(_search(kept, extent, queries, k, limit, kind))
    reached = home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    radius = F.when(F.col("n") >= k, F.greatest(2 - 2 * F.col("worst"), F.lit(0.0)) + 1e-12).otherwise(F.lit(float("inf")))
    wider = queries.drop("radius").join(reached, "query", "left").withColumn("radius", F.coalesce(radius, F.lit(float("inf"))))
    wider = wider.select("vec_id", "cell", "vector", "point", "query", "radius")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, name = [], []
            for i, (own, point, reach) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 3, 5)))):
                dim, cell = map(int, own.split(":"))
                if dim not in cells:
                    continue
                far = cells[dim].distances(np.frombuffer(point, np.float64))
                for c in np.flatnonzero(far <= limit * reach):
                    if c != cell:
                        at.append(i)
                        name.append(f"{dim}:{c}")
            out = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array(name, pa.string()), *[out.column(c) for c in range(2, 6)]], batch.schema.names)

    visits = written(wider.mapInArrow(others, wider.schema))
    found = home.unionByName(_search(kept, extent, visits, k, limit, kind)).distinct()
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(kept: DataFrame, extent: DataFrame, queries: DataFrame, k: int, limit: float, kind: str) -> DataFrame:
    """(query, query_id, vec_id, score): the k nearest to each query within each block of its cell; queries of a cell come in blocks too."""
    part = queries.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("parts"))
    part = written(part)
    asked = queries.join(part, "cell").withColumn("part", F.pmod(F.col("query"), F.col("parts")).cast("int")).join(extent, "cell")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    searched = kept.join(part, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["cell", "block", "part", "vec_id", "vector", "point"]
    both = searched.select(*columns, F.lit(False).alias("asks"), F.lit(0).cast("long").alias("query"), F.lit(0.0).alias("radius")).unionByName(
        asked.select(*columns, F.lit(True).alias("asks"), "query", "radius"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if asks.any() and not asks.all():
            rows, asked = group[~asks].sort_values("vec_id"), group[asks]

            def matrix(frame: pd.DataFrame, column: str) -> np.ndarray:
                return np.frombuffer(b"".join(frame[column]), np.float64).reshape(len(frame), -1)

            index = Index(rows["vec_id"].to_numpy(), matrix(rows, "vector"), matrix(rows, "point"))
            vectors, points = matrix(asked, "vector"), matrix(asked, "point")
            for i, (query, own, radius) in enumerate(zip(asked["query"], asked["vec_id"], asked["radius"])):
                ids, scores = index.search(own, vectors[i], points[i], k, limit, radius)
                out["query"] += [query] * len(ids)
                out["query_id"] += [own] * len(ids)
                out["vec_id"] += list(ids)
                out["score"] += list(scores)
        return pd.DataFrame(out)

    return both.groupBy("cell", "block", "part").applyInPandas(run, f"query long, query_id {kind}, vec_id {kind}, score double")
