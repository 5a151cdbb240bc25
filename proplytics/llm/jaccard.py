"""Exact Jaccard join on word n-grams with signature trees.

Documents with equal sets are one class. Tokens are put in one order, rarest first: how often each occurs is counted by its hash, and three
bit maps of bounded size say which tokens occur at least 2, 8 and 64 times. Two linked sets share a token among the first
``n - ceil(percent * n) + 1`` of each. Tokens that occur once are shared with nobody, so a set of which enough tokens are its own has
no key at all, whatever passages it has in common with others. Classes that share a key hang together, and what hangs
together is a family.

A family stands in signature trees, whose nodes hold the OR of their members' token bitmaps and their range of sizes. A walk over
pairs of nodes drops a pair as soon as sizes, or the largest overlap that the bitmaps allow, are too small; what is left is compared
set against set. Pairs that are known to hang together are not looked at again, so a family of near copies costs about one comparison a
document. Large families are cut into overlapping windows of sizes that may link, and large windows into chunks of bounded size; what chunks
leave apart is compared across chunks afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proplytics.llm.common import HashRuns, compact, components, pieces, written

#: tokens that one task compares, and bits of a filter of rows at most
CHUNK, FILTER_BITS = 1 << 21, 1 << 27
#: occurrences from which tokens stand later in the order, and bits of the map of each at most
LEVELS, LEVEL_BITS = (2, 8, 64), (27, 25, 25)
#: hashes that a task holds, hashes of a bucket, bits of a hash within its bucket, and of the number of buckets at most
HASHES, BUCKET, REST, HIGH = 1 << 20, 1 << 20, 26, 22
LEAF, FAN = 16, 8


def shingles(text: str | bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word ``words``-grams of a lower-cased text; fewer words are one gram; none, none."""
    if not text:
        return np.zeros(0, np.uint64)
    body = text.encode() if isinstance(text, str) else text
    split = body.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not split:
        return np.zeros(0, np.uint64)
    if len(split) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(split), len(split))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter(map(digest, split), np.uint64, len(split))
    n = len(each) - words + 1
    mixed = each[:n].copy()
    for k in range(1, words):
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += each[k : k + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Order:
    """The order of tokens: by level (how many of ``maps`` hold their hash), then by value."""

    def __init__(self, width: int, maps: list[np.ndarray]):
        self.width, self.maps = width, maps

    def levels(self, tokens: np.ndarray) -> np.ndarray:
        key, out = tokens >> np.uint64(64 - self.width), np.zeros(len(tokens), np.int64)
        for bits in self.maps:
            place = key >> np.uint64(self.width - (8 * len(bits)).bit_length() + 1)
            out += (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        return out

    def keys(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The first tokens of a sorted set, without those of level 0: two linked sets that are not the only ones with a token share one."""
        first = len(tokens) - -(-percent * len(tokens) // 100) + 1 if len(tokens) else 0
        level = self.levels(tokens)
        first -= int((level == 0).sum())
        if first <= 0:
            return tokens[:0]
        shared = np.flatnonzero(level)
        return tokens[shared[np.argsort(level[shared], kind="stable")[:first]]]


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits, a power of two from 64, in words of 64; token t sets bit t mod bits."""
    row = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(row, ((tokens & np.uint64(bits - 1)) >> np.uint64(6)).astype(np.int64), np.uint64(1) << (tokens & np.uint64(63)))
    return row


def wide(tokens: int, factor: int = 4) -> int:
    """Bits for so many tokens."""
    return 1 << max(6, (factor * tokens - 1).bit_length())


class Tree:
    """Signature tree: leaves of ``LEAF`` members, nodes of ``FAN`` children, in order of size."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, names: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        self.sizes, self.maps, self.names = sizes[order], maps[order], names[order]
        # tokens of a member that share a bit with another of it: a map hides so many
        self.hidden = self.sizes - np.bitwise_count(self.maps).sum(1).astype(np.int64)
        at = np.arange(0, len(order), LEAF)
        level = {"map": np.bitwise_or.reduceat(self.maps, at), "low": np.minimum.reduceat(self.sizes, at), "high": np.maximum.reduceat(self.sizes, at),
                 "hidden": np.maximum.reduceat(self.hidden, at), "from": at, "to": np.minimum(at + LEAF, len(order))}
        self.levels = [level]
        while len(level["from"]) > 1:
            at = np.arange(0, len(level["from"]), FAN)
            level = {"map": np.bitwise_or.reduceat(level["map"], at), "low": np.minimum.reduceat(level["low"], at),
                     "high": np.maximum.reduceat(level["high"], at), "hidden": np.maximum.reduceat(level["hidden"], at),
                     "from": level["from"][at], "to": np.maximum.reduceat(level["to"], at)}
            self.levels.append(level)

    @property
    def top(self) -> tuple[int, int]:
        return len(self.levels) - 1, 0

    def below(self, node: tuple[int, int]) -> list[tuple[int, int]]:
        depth, k = node
        return [(depth - 1, c) for c in range(k * FAN, min(k * FAN + FAN, len(self.levels[depth - 1]["from"])))]

    def members(self, node: tuple[int, int]) -> np.ndarray:
        level = self.levels[node[0]]
        return self.names[level["from"][node[1]] : level["to"][node[1]]]


class Union:
    """Components that are known so far."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = np.array([first.setdefault(x, i) for i, x in enumerate(labels)], np.int64)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)


def walk(a: Tree, b: Tree, percent: int, union: Union, test) -> list[tuple[int, int]]:
    """Pairs of members that ``test`` finds linked and that join components of ``union``, from a walk over pairs of nodes of two trees, or of one."""
    found: list[tuple[int, int]] = []
    same = a is b

    def one(tree: Tree, node: tuple[int, int]) -> int:
        """The component of all members of a node, or -1."""
        roots = {union.find(int(i)) for i in tree.members(node)}
        return roots.pop() if len(roots) == 1 else -1

    def hopeless(p: tuple[int, int], q: tuple[int, int]) -> bool:
        x, i, y, j = a.levels[p[0]], p[1], b.levels[q[0]], q[1]
        # the smaller set must reach ``percent`` of the larger one, and so must the overlap
        if 100 * x["high"][i] < percent * y["low"][j] or 100 * y["high"][j] < percent * x["low"][i]:
            return True
        # bits that a member has and the other node has not are tokens that no member there has
        shared = int(np.bitwise_count(x["map"][i] & y["map"][j]).sum())
        most = min(x["high"][i], y["high"][j], x["hidden"][i] + shared, y["hidden"][j] + shared)
        return 100 * most < percent * max(x["low"][i], y["low"][j])

    def leaves(i: int, j: int) -> None:
        x, y = a.levels[0], b.levels[0]
        rows, columns = np.arange(x["from"][i], x["to"][i]), np.arange(y["from"][j], y["to"][j])
        shared = np.bitwise_count(a.maps[rows][:, None, :] & b.maps[columns][None, :, :]).sum(2).astype(np.int64)
        most = np.minimum(a.hidden[rows][:, None] + shared, b.hidden[columns][None, :] + shared)
        hope = 100 * most >= percent * (a.sizes[rows][:, None] + b.sizes[columns][None, :] - most)
        for r, c in zip(*np.nonzero(hope)):
            if same and rows[r] >= columns[c]:
                continue
            u, v = int(a.names[rows[r]]), int(b.names[columns[c]])
            if union.find(u) != union.find(v) and test(u, v):
                union.join(u, v)
                found.append((u, v))

    # nodes against themselves come first: most near copies are joined before wider pairs are looked at
    later = [(a.top, b.top)]
    while later:
        p, q = later.pop()
        known = one(a, p)
        if known >= 0 and known == one(b, q):
            continue
        if not (same and p == q) and hopeless(p, q):
            continue
        if p[0] == 0 and q[0] == 0:
            leaves(p[1], q[1])
        elif same and p == q:
            below = a.below(p)
            later += [(x, y) for i, x in enumerate(below) for y in below[i + 1 :]] + [(x, x) for x in below]
        elif p[0] >= q[0]:
            later += [(x, q) for x in a.below(p)]
        else:
            later += [(p, y) for y in b.below(q)]
    return found


def exact(percent: int, sets: list[np.ndarray], union: Union, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among sets that join components; with ``side``, between sets of the two sides only."""
    size = np.array([len(s) for s in sets], np.int64)
    bits = min(1 << 15, wide(int(np.percentile(size, 90)), 2))
    maps = np.stack([bitmap(s, bits) for s in sets])
    rows = [np.flatnonzero(side == k) for k in (0, 1)] if side is not None else [np.arange(len(sets))]
    trees = [Tree(size[at], maps[at], at) for at in rows]
    return walk(trees[0], trees[-1], percent, union, lambda u, v: linked(sets[u], sets[v], percent))


def _count(words: int, width: int):
    """Set size and class of each text, and runs of the hashes of all tokens: rows of both kinds, the former without a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = HashRuns(REST, HASHES)

        def padded(runs: Iterator[pa.RecordBatch], like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for r in runs:
                yield pa.RecordBatch.from_arrays([pa.nulls(r.num_rows, like.column(0).type), pa.nulls(r.num_rows, pa.int64()), pa.nulls(r.num_rows, pa.int64()), pa.nulls(r.num_rows, pa.int64()), *r.columns],
                                                 ["doc_id", "row_key", "n", "cls", *r.schema.names])

        batch = None
        for batch in batches:
            texts = batch.column(1)
            for first, last in pieces(texts):
                sets = [shingles(t, words) for t in texts.slice(first, last - first).to_pylist()]
                if sets:
                    yield from padded(held.add(np.concatenate(sets) >> np.uint64(64 - width)), batch)
                k = len(sets)
                cls = [xxhash.xxh3_64_intdigest(t.tobytes()) - (1 << 63) if len(t) else None for t in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, k), batch.column(2).slice(first, k), pa.array([len(t) for t in sets], pa.int64()), pa.array(cls, pa.int64()),
                    pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], ["doc_id", "row_key", "n", "cls", "bucket", "steps", "counts"])
        if batch is not None:
            yield from padded(held.runs(), batch)

    return run


def order_of(runs: DataFrame, width: int) -> Order:
    """The order by the counts of all runs. A bucket is a stretch of each map, so maps are put together from one row a bucket."""
    high = width - REST
    powers = [max(high + 3, min(p, width)) for p in LEVEL_BITS]

    def add(group: pa.Table) -> pa.Table:
        bucket, low, counts = HashRuns.added(group)
        maps = []
        for least, power in zip(LEVELS, powers):
            bits = np.zeros(1 << (power - high), np.uint8)
            bits[low[counts >= least] >> (width - power)] = 1
            maps.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "maps": pa.array([maps], pa.list_(pa.binary()))})

    rows = runs.groupBy("bucket").applyInArrow(add, "bucket long, maps array<binary>").toArrow()
    maps = [np.zeros(1 << (power - 3), np.uint8) for power in powers]
    for bucket, found in zip(rows["bucket"].to_pylist(), rows["maps"]):
        # read in place: the driver holds the maps twice, not three times
        for whole, part in zip(maps, found.values):
            bits = np.frombuffer(part.as_buffer(), np.uint8)
            whole[bucket * len(bits) : (bucket + 1) * len(bits)] = bits
    return Order(width, maps)


def _heads(words: int, percent: int, order):
    """(cls, key) of each text that has keys; equal sets of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in pieces(batch.column(0)):
                found = {}
                for t in set(batch.column(0).slice(first, last - first).to_pylist()):
                    tokens = shingles(t, words)
                    keys = order.value.keys(tokens, percent)
                    if len(keys):
                        found[xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)] = keys
                if found:
                    cls = np.repeat(np.array(list(found), np.int64), [len(k) for k in found.values()])
                    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.concatenate(list(found.values())).view(np.int64))], ["cls", "key"])

    return run


def filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for each key, in 64 bits a key up to ``FILTER_BITS``: what the filter lets through too much is shuffled and joined out later."""
    bits = max(1 << 15, min(FILTER_BITS, 1 << (64 * keys.count()).bit_length()))
    place = F.pmod("key", F.lit(bits)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in maps:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.map, np.uint8)
    return out


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``row_key`` is not in ``keys``, so that few texts are shuffled to the join that decides."""
    filtered = filter_of(keys.select(F.col("row_key").alias("key")))
    bits, place = np.uint64(8 * len(filtered) - 1), rows.columns.index("row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(place).to_numpy().view(np.uint64) & bits
            keep = (filtered[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def _edges(cls: list | np.ndarray, found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": [cls[u] for u, _ in found], "b": [cls[v] for _, v in found]}, dtype="int64")


def _compare(percent: int, words: int):
    """Links within one chunk, or between the probes and the others of one, that join components."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        probing = "probe" in group
        group = group.drop_duplicates(["cls", "probe"] if probing else ["cls"]).sort_values("cls")
        side = group["probe"].to_numpy().astype(int) if probing else None
        if probing and len(set(side)) < 2:
            return _edges([], [])
        union = Union([int(x) for x in group["component"]] if probing else list(range(len(group))))
        return _edges(group["cls"].to_numpy(), exact(percent, [shingles(t, words) for t in group["text"]], union, side))

    return run


def _windows(weighed: DataFrame, limit: int, percent: int, steps: int = 4) -> DataFrame:
    """``weighed`` (grp, cls, w) with families of more than ``limit`` tokens cut by size into windows, each a family of its own.

    Sizes of linked sets are at most one step of 100 / percent apart. A window is ``steps`` steps and the first one of the next, so any two sets that
    may link stand in one window together, and a set in two of them at most.
    """
    if percent <= 0:
        return weighed
    large = weighed.groupBy("grp").agg(F.sum("w").alias("whole")).where(F.col("whole") > limit).select("grp", F.lit(True).alias("large"))
    # equal sizes are in one window whatever the step; the margin is for rounding
    step = F.log("w") / F.lit(max(float(np.log(100 / percent)), 0.01))
    window = F.floor(step / F.lit(steps))
    shared = (step - window * F.lit(steps) < 1 + 1e-6) & (window > 0)
    windows = F.when(F.col("large") & shared, F.array(window, window - 1)).when(F.col("large"), F.array(window)).otherwise(F.array(F.lit(None).cast("bigint")))
    cut = weighed.join(large, "grp", "left").select("grp", "cls", "w", F.explode(windows).alias("window"))
    return cut.select(F.when(F.col("window").isNull(), F.col("grp")).otherwise(F.xxhash64("grp", "window")).alias("grp"), "cls", "w")


def _joined(families: DataFrame, reps: DataFrame, rows: DataFrame, limit: int, percent: int, words: int) -> DataFrame:
    """Links that join what hangs together in each family (grp, cls); ``reps`` is (cls, row_key, n), ``rows`` (row_key, text).

    The places of a class, its chunks, are known before its text is looked up, so a text is shuffled once to be found and once to be compared.

    A family of more than ``limit`` tokens is cut into windows of sizes, and a window that is still larger is dealt over chunks of about ``limit`` tokens.
    After the chunks, the classes outside the largest component of a window are probes: blocks of them meet every chunk of it, and pairs within a
    component are passed over.
    """
    weighed = written(_windows(families.join(reps.select("cls", F.col("n").alias("w")), "cls"), limit, percent))
    families = weighed.drop("w")
    extent = written(weighed.groupBy("grp").agg(F.ceil(F.sum("w") / F.lit(limit)).cast("int").alias("chunks")))
    members = written(families.join(extent, "grp").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")))
    places = written(reps.join(members.groupBy("cls").agg(F.collect_list(F.struct("grp", "chunk")).alias("places")), "cls").select("cls", "row_key", "places"))
    # the text of one row a class; equal rows are folded where the join has put them
    found = _among(rows, places).join(places, "row_key").groupBy("row_key", "cls").agg(F.first("text").alias("text"), F.first("places").alias("places"))
    found = written(found.select("cls", "text", "places"))
    texts = found.select("cls", "text")
    placed = found.select("cls", "text", F.inline("places"))
    links = written(placed.groupBy("grp", "chunk").applyInPandas(_compare(percent, words), "a long, b long"))
    if not extent.where("chunks > 1").limit(1).count():
        return links
    label = components(links).withColumnRenamed("node", "cls")
    known = weighed.join(members.where("chunks > 1"), ["grp", "cls"]).join(label, "cls", "left")
    known = written(known.select("grp", "chunk", "cls", "w", F.coalesce("component", "cls").alias("component")))
    parts = known.groupBy("grp", "component").agg(F.count("*").alias("k")).groupBy("grp").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    known = known.join(parts, "grp")
    probes = known.where("component <> main")
    blocks = written(probes.groupBy("grp").agg(F.ceil(F.sum("w") / F.lit(limit)).cast("int").alias("blocks")))
    probes = probes.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int"))
    columns = ["grp", "block", "chunk", "cls", "component"]
    left = probes.drop("chunk").join(known.select("grp", "chunk").distinct(), "grp").select(*columns, F.lit(True).alias("probe"))
    right = known.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = written(left.unionByName(right.select(*columns, F.lit(False).alias("probe"))))
    more = meet.join(texts, "cls").groupBy("grp", "block", "chunk").applyInPandas(_compare(percent, words), "a long, b long")
    return written(links.unionByName(more))


def similar_documents(docs: DataFrame, words: int = 3, percent: int = 90, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: its set size, and the smallest doc_id that links lead to.

    Two rows link when 100 * |common grams| >= percent * |all grams|. Rows without words are linked with nothing and are
    their own component, as are rows that share no gram. Rows with one doc_id are documents of their own, but report the
    same id; a null doc_id takes part and counts as larger than any other. Classes and grams are told apart by 64-bit hashes.
    A family is cut into chunks of about ``chunk`` grams; what chunks leave apart is compared across chunks afterwards.
    """
    return _classed(docs, words, percent, chunk, doc_id, text).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _classed(docs: DataFrame, words: int, percent: int, chunk: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row_key, n, cls, component, component_id) of every row; a component goes by the smallest of its classes."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = REST + int(min(HIGH, max(6, np.ceil(np.log2((size + 2) / 2 / BUCKET)))))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = written(rows.mapInArrow(_count(words, width), f"doc_id {kind}, row_key long, n long, cls long, {HashRuns.SCHEMA}"))
    ready = counted.where("bucket is null").select("doc_id", "row_key", "n", "cls")
    order = docs.sparkSession.sparkContext.broadcast(order_of(counted.where("bucket is not null").select("bucket", "steps", "counts"), width))
    classes = written(ready.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"), F.min("row_key").alias("row_key"), F.max("n").alias("n")))

    # classes that share a key hang together, by the smallest class of the key
    heads = written(rows.select("text").mapInArrow(_heads(words, percent, order), "cls long, key long"))
    order.destroy()  # else the maps of each call stay with the driver until its garbage is collected
    del order
    least = written(heads.groupBy("key").agg(F.min("cls").alias("b"), F.max("cls").alias("c")).where("b < c").select("key", "b"))
    family = components(heads.join(least, "key").select(F.col("cls").alias("a"), "b").distinct())
    family = written(family.select(F.col("component").alias("grp"), F.col("node").alias("cls")))
    reps = written(classes.join(family, "cls", "left_semi").select("cls", "row_key", "n"))
    links = _joined(family, reps, rows.select("row_key", "text"), chunk, percent, words)
    label = components(links).withColumnsRenamed({"node": "cls"})
    named = classes.join(label, "cls", "left").select("cls", "first", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = written(named.join(least, "component").select("cls", "component", "component_id"))
    return ready.join(named, "cls", "left")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, of which one of each component stays: that of the smallest doc_id, then of the smallest row hash.

    Rows without words are linked with nothing and all stay. Of equal rows (doc_id and text) one stays.
    """
    found = written(_classed(docs, words, percent, chunk, doc_id, text).where("n > 0").select("doc_id", "row_key", "component"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    first = first.select(F.col("first.row_key").alias("row_key"), F.lit(True).alias("first"))
    rows = found.groupBy("row_key").agg(F.count("*").alias("n")).join(first, "row_key", "left")
    # what goes, and what stays once of several
    marked = compact(rows.where("first is null or n > 1").select("row_key", F.coalesce("first", F.lit(False)).alias("once")))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(docs[doc_id], docs[text]).alias("row_key"))
    stay = packed.join(marked, "row_key", "left_anti").select("row")
    once = packed.join(compact(marked.where("once").select("row_key")), "row_key", "left_semi").groupBy("row_key").agg(F.any_value("row").alias("row")).select("row")
    return stay.unionByName(once).select("row.*")
