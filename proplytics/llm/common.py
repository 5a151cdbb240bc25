"""What the operators share: the shared work folder, dense numbering, graph components, text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, under the warehouse, which is shared too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/proplytics-llm/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe when executors go, its size known to the planner."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` as a table of few files, ``rows`` rows a file: the planner goes by file sizes, and many empty files make a small table look large."""
    table = written(df)
    return written(table.coalesce(1 + table.count() // rows))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def dense_slots(counted: DataFrame, group: str, order: list[str], blocks: int) -> DataFrame:
    """Add ``slot``, numbers from 0 without gaps in each ``group``, to rows that stand for ``n`` equal rows each.

    Rows are ranked within hashed blocks of a group; a block then starts where the counts of the blocks
    before it end. No task sees more than a block, whatever the size of a group, and equal rows were counted before.
    """
    block = F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int")
    rows = counted.withColumn("_block", block)
    starts = rows.groupBy(group, "_block").agg(F.sum("n").alias("_in_block"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(group, "_block", F.coalesce(F.sum("_in_block").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    rows = rows.join(starts, [group, "_block"]).withColumn("_first", F.col("_start") + F.col("_inside"))
    return rows.withColumn("slot", F.explode(F.sequence("_first", F.col("_first") + F.col("n") - 1))).drop(
        "_block", "_start", "_inside", "_first", "n")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for edges (a, b) of longs: the smallest node that can be reached, by alternating star joins.

    Each half round hangs neighbours below the smallest of them, so paths shrink by a constant factor. Edges are a
    table in the shared folder after each round. Nodes without an edge to another do not come back.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(below.select("a", F.col("m").alias("b")))
        now = written(small.distinct())
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each text begins in them (one more entry at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[starts[0] : starts[-1]], starts - starts[0]


def pieces(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, so that arrays over a batch stay small; a longer text is a range alone."""
    _, starts = text_bytes(column)
    first, n = 0, len(starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, "right")) - 1)
        yield first, last
        first = last


# --- counting hashes -----------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """4-byte numbers by byte: all lowest bytes first. Small numbers leave runs of zeros, which the shuffle packs."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _folded(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class HashRuns:
    """Counts of hashes within a task, handed on as sorted runs: one row (bucket, steps, counts) for each bucket of a run.

    The bucket of a hash is what stands above its lowest ``rest`` bits. At most ``most`` hashes are held, twice as many while they are sorted.
    """

    SCHEMA = "bucket long, steps binary, counts binary"

    def __init__(self, rest: int, most: int):
        self.rest, self.most = rest, most
        self.keys, self.counts, self.fresh, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count ``keys``; runs come out when too many are held."""
        self.fresh.append(keys)
        self.waiting += len(keys)
        if self.waiting > self.most:
            self._fold()
            if len(self.keys) > self.most:
                yield from self.runs()

    def _fold(self) -> None:
        self.keys, self.counts = _folded(np.concatenate([self.keys, *self.fresh]), np.concatenate([self.counts, np.ones(self.waiting, np.int64)]))
        self.fresh, self.waiting = [], 0

    def runs(self) -> Iterator[pa.RecordBatch]:
        """All that is held."""
        self._fold()
        keys, counts = self.keys, np.minimum(self.counts, (1 << 32) - 1)
        self.keys, self.counts = keys[:0], counts[:0]
        if not len(keys):
            return
        bucket, low = (keys >> np.uint64(self.rest)).astype(np.int64), (keys & np.uint64((1 << self.rest) - 1)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        step = np.diff(low, prepend=0)
        step[at] = low[at]
        ends = np.concatenate([at[1:], [len(keys)]])
        for i in range(0, len(at), 4096):
            some = list(zip(at[i : i + 4096], ends[i : i + 4096]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at[i : i + 4096]]), pa.array([_planes(step[a:b]) for a, b in some], pa.binary()),
                                              pa.array([_planes(counts[a:b]) for a, b in some], pa.binary())], ["bucket", "steps", "counts"])

    @staticmethod
    def added(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        """(bucket, distinct hashes without their bucket, counts) of all runs of one bucket."""
        low = np.concatenate([np.cumsum(_from_planes(x.as_py()).astype(np.int64)) for x in group["steps"]])
        return group["bucket"][0].as_py(), *_folded(low, np.concatenate([_from_planes(x.as_py()).astype(np.int64) for x in group["counts"]]))
