"""Token ids packed into rows of equal length: best fit decreasing, with a segment tree over the space that is left.

Texts longer than a row are cut into pieces without loss. Each task packs the texts of its split in blocks of bounded size, so
nothing is shuffled and a lost task is done again from the same rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Encoder:
    """A byte-level vocabulary by ranks, and the pattern that cuts texts before pieces are merged."""

    ranks: dict[bytes, int]
    pattern: str

    @staticmethod
    def read(path: str, pattern: str) -> Encoder:
        with open(path, "rb") as lines:
            return Encoder({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def build(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})


class Spaces:
    """Open rows by the space left in them: a segment tree finds the smallest space that is large enough."""

    def __init__(self, length: int):
        self.leaves = 1 << max(1, length).bit_length()
        self.open = [0] * (2 * self.leaves)  # open rows at each leaf and below each node
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, space: int, by: int) -> None:
        node = space + self.leaves
        while node:
            self.open[node] += by
            node >>= 1

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        self._change(space, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(space, row) of the tightest open row with ``size`` left, taken out; None if there is none."""
        node = size + self.leaves
        if not self.open[node]:
            # up to the first node with something to the right, then down to its first leaf
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        space = node - self.leaves
        self._change(space, -1)
        return space, self.rows[space].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers: pieces from large to small (ties in order), each to the row that it fills best."""
    rows: list[list[int]] = []
    spaces = Spaces(length)
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if not 0 < sizes[piece] <= length:
            raise ValueError("a piece must have 1 to length tokens")
        place = spaces.take(sizes[piece])
        if place is None:
            rows.append([piece])
            space, row = length, len(rows) - 1
        else:
            space, row = place
            rows[row].append(piece)
        if space > sizes[piece]:
            spaces.add(space - sizes[piece], row)
    return rows


def _pack(docs: list[tuple[object, np.ndarray]], length: int, pad: int, kind: np.dtype) -> dict[str, list]:
    pieces = [(doc, k, ids[k * length : (k + 1) * length]) for doc, ids in docs for k in range(-(-len(ids) // length))]
    out: dict[str, list] = {name: [] for name in ("ids", "n_tokens", "cu_seqlens", "resets", "segments")}
    for row in best_fit([len(p[2]) for p in pieces], length):
        ends = np.cumsum([len(pieces[i][2]) for i in row])
        line = np.full(length, pad, kind)
        line[: ends[-1]] = np.concatenate([pieces[i][2] for i in row])
        out["ids"].append(line.tobytes())
        out["n_tokens"].append(int(ends[-1]))
        out["cu_seqlens"].append([0, *map(int, ends)])
        out["resets"].append([0, *map(int, ends[:-1])])
        out["segments"].append([{"doc_id": pieces[i][0], "piece": pieces[i][1], "size": len(pieces[i][2])} for i in row])
    return out


def packed(docs: DataFrame, encoder: Encoder, length: int = 2048, pad: int = 0, end: int | None = None, block: int = 1 << 21,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """ids, n_tokens, cu_seqlens, resets, segments: one row for each packed row of ``length`` token ids.

    ``ids`` are ``length`` little-endian unsigned integers of two bytes (four if the vocabulary needs them), ``pad`` behind the last
    segment. ``cu_seqlens`` has 0 and where each segment ends, ``resets`` where positions begin at 0 again, ``segments`` the doc_id,
    piece number and size of each segment; the pieces of a document in order are its ids, then ``end`` if given.
    Rows are packed in blocks of at least ``block`` ids of one task, so its memory does not follow the input. Null and empty texts without ``end`` have
    no ids and no segment; rows that repeat are packed each; empty tables give no rows.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    name = rows.schema["doc_id"].dataType.simpleString()
    wide = max([*encoder.ranks.values(), pad, end or 0]) >= 1 << 16
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, count = encoder.build(), [], 0
        schema = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(_pack(held, length, pad, kind), schema=schema)

        for batch in batches:
            schema = pa.schema([("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), (
                "segments", pa.list_(pa.struct([("doc_id", batch.schema.field(0).type), ("piece", pa.int32()), ("size", pa.int32())])))])
            for doc, body in zip(batch.column(0), batch.column(1)):
                ids = coder.encode_to_numpy(body.as_py() or "", disallowed_special=()).astype(kind)
                if end is not None:
                    ids = np.append(ids, kind.type(end))
                if len(ids):
                    held.append((doc.as_py(), ids))
                    count += len(ids)
                if count >= block:
                    yield out()
                    held, count = [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, f"ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, segments array<struct<doc_id:{name},piece:int,size:int>>")


def write_packed(rows: DataFrame, path: str) -> None:
    """The packed rows as Parquet: a matrix of ids in files that a reader can map, with what is needed to cut it again."""
    rows.withColumn("length", F.octet_length("ids")).write.parquet(path)
