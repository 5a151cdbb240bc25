"""Phrases whose words stand together more often than their parts would by chance.

Texts are read three times. The first reading counts hashes of words and word pairs, a bound from above that leaves out most of what is
rare. The second counts phrases of up to three words whose words and pairs pass, the third those of four and five whose triples are
frequent. These two count in a HAT-trie: a shallow trie of word ids whose leaves are hash containers that burst into a trie node when
they grow too large. A task that holds too much spills its largest subtrees whole, as runs sorted by phrase; runs are shuffled by the
first words of their phrases and added up there. What passes stands in a bit map of bounded size; a wrong yes costs work, not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proplytics.llm.common import HashRuns, pieces, text_bytes, written

#: orders counted in the second and third reading, and the orders whose map each of them asks
LEVELS = (((1, 2, 3), (1, 2)), ((4, 5), (3,)))
#: entries of a container before it bursts; entries, words and hashes that a task holds before it spills; bits of the map of what may be frequent
BURST, HOLD, WORDS, HASHES, BITS = 1 << 12, 1 << 19, 1 << 19, 1 << 21, 26
#: words of a phrase that say in which partition its runs are added up; hashes of a bucket at most, and bits of a hash within its bucket
PREFIX, BUCKET, REST = 3, 1 << 20, 26
#: languages whose numbers of words are sent to all tasks; where there are more, they are joined
LANGUAGES = 10_000
SPACE, STOP = 32, 10
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _characters() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9] = SPACE
    table[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = STOP
    return table


_CHARACTERS = _characters()


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words in lower case, piece of each, row of each) of a column of texts; pieces end at stops and with their text."""
    data, starts = text_bytes(column)
    n, lengths = len(starts) - 1, np.diff(starts)
    buffer = np.full(len(data) + n, STOP, np.uint8)
    buffer[np.arange(len(data)) + np.repeat(np.arange(n), lengths)] = _CHARACTERS[data]
    solid = (buffer != SPACE) & (buffer != STOP)
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(to - at)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer[solid])])
    return words, np.cumsum(buffer == STOP)[at] if len(at) else at, np.searchsorted(starts[1:] + np.arange(n), at, "right")


def _hash(words: pa.Array) -> np.ndarray:
    """A hash of each of some texts: its bytes as digits, stirred."""
    data, starts = text_bytes(words)
    size = np.diff(starts)
    if not len(data):
        return np.zeros(len(size), np.uint64)
    power = np.full(int(size.max()), _MIX, np.uint64)
    power = np.multiply.accumulate(power)
    terms = (data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(starts[:-1], size)]
    out = np.zeros(len(size), np.uint64)
    out[size > 0] = np.add.reduceat(terms, starts[:-1][size > 0])
    return (out ^ (out >> np.uint64(32))) * _MIX


def _keys(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A hash for each row of hashes of a language and its words; the number of words counts."""
    out = lang + np.uint64(len(words))
    for h in words:
        out = (out ^ h) * _MIX
        out = out ^ (out >> np.uint64(31))
    return out * _MIX


def _hashed(column: pa.Array, langs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, their hashes, piece, row, hash of the language) of a column of texts."""
    words, piece, row = split_words(column)
    coded = langs.dictionary_encode()
    return words, _hash(words), piece, row, _hash(coded.dictionary)[coded.indices.to_numpy()][row]


class FrequentMap:
    """A bit for each key (hash of ``width`` bits) of what may be frequent among phrases of ``orders`` words."""

    def __init__(self, orders: tuple[int, ...], width: int, words: np.ndarray):
        self.orders, self.width, self.words = orders, width, words

    @classmethod
    def of(cls, keys: DataFrame, orders: tuple[int, ...], width: int) -> FrequentMap:
        """The map of the longs ``key``: 16 bits for each, 2 ** BITS bits at most; so much comes to the driver."""
        power = int(min(BITS, max(10, np.ceil(np.log2(16 * (keys.count() + 1))))))
        place = F.col("key").bitwiseAND(F.lit((1 << power) - 1))
        bits = keys.select(F.shiftright(place, 6).alias("place"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bits"))
        rows = bits.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << (power - 6), np.uint64)
        words[rows["place"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return cls(orders, width, words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        bit = (keys >> np.uint64(64 - self.width)) & np.uint64(64 * len(self.words) - 1)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0

    def passing(self, hashes: np.ndarray, lang: np.ndarray, piece: np.ndarray, k: int) -> np.ndarray:
        """For each word whether the ``k`` words from it on stand in one piece and all their parts of the known orders may be frequent."""
        good = np.zeros(len(hashes), bool)
        n = len(hashes) - k + 1
        if n < 1:
            return good
        good[:n] = piece[:n] == piece[k - 1 :]
        for m in self.orders:
            for j in range(k - m + 1):
                at = np.flatnonzero(good)
                good[at] = self.has(_keys(lang[at], [hashes[at + j + i] for i in range(m)]))
        return good


def _phrase_keys(phrases: DataFrame, order: int, width: int) -> DataFrame:
    """key of each of the (lang, phrase) rows of ``order`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column(1), " ").flatten()
            found = _keys(_hash(batch.column(0)), list(_hash(words).reshape(-1, order).T)) >> np.uint64(64 - width)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["key"])

    return phrases.select("lang", "phrase").mapInArrow(run, "key long")


def pair_keys(texts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(key) of the words and word pairs whose hashes are counted ``least`` times or more, and the width of the keys.

    Tasks count hashes and cut the sorted counts into one run a bucket; a bucket holds BUCKET hashes at most, copies included,
    because there are as many buckets as the bytes of the texts ask for. The lower bits of a hash are left out, as they only tell apart
    what shares all others.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    high = int(max(6, np.ceil(np.log2((size + 2) / BUCKET))))  # two hashes a word, two bytes a word at least
    width = high + REST

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = HashRuns(REST, HASHES)
        for batch in batches:
            for first, last in pieces(batch.column(1)):
                _, hashes, piece, _, lang = _hashed(batch.column(1).slice(first, last - first), batch.column(0).slice(first, last - first))
                pair = np.flatnonzero(piece[1:] == piece[:-1])
                for keys in (_keys(lang, [hashes]), _keys(lang[pair], [hashes[pair], hashes[pair + 1]])):
                    yield from held.add(keys >> np.uint64(64 - width))
        yield from held.runs()

    def add(group: pa.Table) -> pa.Table:
        bucket, keys, counts = HashRuns.added(group)
        return pa.table({"key": keys[counts >= least] | (bucket << REST)})

    runs = texts.mapInArrow(count, HashRuns.SCHEMA)
    return written(runs.groupBy("bucket").applyInArrow(add, "key long")), width


class Node:
    """A hash container of the word ids that follow (4 bytes each) and their counts; once burst, a trie node that only keeps its own count."""

    __slots__ = ("held", "below")

    def __init__(self):
        self.held: dict[bytes, int] = {}
        self.below: dict[bytes, Node] | None = None

    def add(self, keys: list[bytes], counts: list[int]) -> int:
        """Add to the counts of ``keys``; how many keys are new."""
        new = 0
        for key, n in zip(keys, counts):
            node = self
            while node.below is not None and key:
                child = node.below.get(key[:4])
                if child is None:
                    child = node.below[key[:4]] = Node()
                node, key = child, key[4:]
            held = node.held
            if key in held:
                held[key] += n
            else:
                held[key] = n
                new += 1
                if len(held) > BURST and node.below is None:
                    node._burst()
        return new

    def _burst(self) -> None:
        held, self.held, self.below = self.held, {}, {}
        for key, n in held.items():
            self.add([key], [n])

    def entries(self, prefix: bytes = b"") -> Iterator[tuple[bytes, int]]:
        for key, n in self.held.items():
            yield prefix + key, n
        for word, child in (self.below or {}).items():
            yield from child.entries(prefix + word)


class HatTrie:
    """Counts of phrases (language, word ids); ``names`` are the words of the ids."""

    def __init__(self):
        self.roots: dict[int, Node] = {}
        self.sizes: dict[int, int] = {}
        self.held = 0

    def add(self, lang: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add rows of word ids, sorted, with their languages."""
        first = (lang.astype(np.int64) << 32) | ids[:, 0]
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else []
        k = ids.shape[1]
        rest = np.ascontiguousarray(ids[:, 1:], np.int32)
        keys = [b""] * len(ids) if k == 1 else [bytes(x) for x in rest.view(np.dtype((np.void, 4 * (k - 1)))).ravel().tolist()]
        number = counts.tolist()
        for a, b in zip(at, [*at[1:], len(first)]):
            root = int(first[a])
            node = self.roots.get(root)
            if node is None:
                node, self.sizes[root] = self.roots.setdefault(root, Node()), 0
            new = node.add(keys[a:b], number[a:b])
            self.sizes[root] += new
            self.held += new

    def spill(self, names: list[bytes], langs: list[str], most: int = 0) -> Iterator[pa.RecordBatch]:
        """Sorted runs (lang, size, phrase, n) of the largest subtrees, until ``most`` entries stay."""
        ordered = sorted(self.sizes, key=self.sizes.get, reverse=True)
        words = pa.array(names, pa.binary())
        while ordered and self.held > most:
            chosen, size = [], 0
            for root in ordered:
                if size >= 1 << 16 or self.held - size <= most:
                    break
                chosen.append(root)
                size += self.sizes[root]
            ordered = ordered[len(chosen) :]
            rows: dict[int, list] = {}
            for root in chosen:
                for key, n in self.roots.pop(root).entries():
                    rows.setdefault(len(key) // 4, []).append((root, key, n))
                self.held -= self.sizes.pop(root)
            for k, found in rows.items():
                root = np.array([r[0] for r in found], np.int64)
                ids = np.concatenate([(root & 0xFFFFFFFF)[:, None], np.frombuffer(b"".join(r[1] for r in found), np.int32).reshape(len(found), k)], axis=1)
                columns = [words.take(pa.array(ids[:, j])) for j in range(k + 1)]
                phrase = (pc.binary_join_element_wise(*columns, b" ") if k else columns[0]).cast(pa.string())
                batch = pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()).take(pa.array(root >> 32)), pa.array(np.full(len(found), k + 1), pa.int32()), phrase, pa.array([r[2] for r in found], pa.int64())],
                    ["lang", "size", "phrase", "n"])
                yield batch.take(pc.sort_indices(phrase))


def distinct_grams(ids: np.ndarray, lang: np.ndarray, at: np.ndarray, order: int, words: int, langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, word ids, count) of the distinct phrases of ``order`` words that begin at ``at``, sorted by language and ids."""
    code, size = lang[at].astype(np.int64), langs
    for j in range(order):
        if size * words >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            size = int(code.max(initial=0)) + 1
        code, size = code * words + ids[at + j], size * words
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    place = at[first]
    return lang[place], ids[place[:, None] + np.arange(order)], counts


def _counter(orders: tuple[int, ...], frequent):
    """mapInArrow function over (lang, text): runs of phrases of ``orders`` words; with single words also the number of all words (the empty phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, names, known, langs, totals = HatTrie(), [], {}, {}, {}
        for batch in batches:
            for first, last in pieces(batch.column(1)):
                lang_column = batch.column(0).slice(first, last - first)
                words, hashes, piece, row, lang_hash = _hashed(batch.column(1).slice(first, last - first), lang_column)
                coded = lang_column.dictionary_encode()
                lang = np.array([langs.setdefault(x, len(langs)) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()][row]
                if 1 in orders:
                    for k, n in enumerate(np.bincount(lang).tolist()):
                        totals[k] = totals.get(k, 0) + n
                starts = {k: np.flatnonzero(frequent.value.passing(hashes, lang_hash, piece, k)) for k in orders}
                asked = np.zeros(len(words), bool)
                for k, at in starts.items():
                    for j in range(k):
                        asked[at + j] = True
                coded = words.filter(pa.array(asked)).dictionary_encode()
                if len(known) + len(coded.dictionary) > WORDS and known:
                    yield from trie.spill(names, list(langs))
                    names, known = [], {}
                local = []
                for word in coded.dictionary.to_pylist():
                    i = known.get(word)
                    if i is None:
                        i = known[word] = len(names)
                        names.append(word)
                    local.append(i)
                ids = np.zeros(len(words), np.int64)
                ids[asked] = np.array(local, np.int64)[coded.indices.to_numpy()]
                for k, at in starts.items():
                    trie.add(*distinct_grams(ids, lang, at, k, len(names), len(langs)))
                    if trie.held > HOLD:
                        yield from trie.spill(names, list(langs), HOLD // 2)
        yield from trie.spill(names, list(langs))
        if totals:
            values = list(langs)
            yield pa.RecordBatch.from_arrays([pa.array([values[k] for k in totals], pa.string()), pa.array([0] * len(totals), pa.int32()), pa.array([""] * len(totals), pa.string()),
                                              pa.array(list(totals.values()), pa.int64())], ["lang", "size", "phrase", "n"])

    return run


def frequent_phrases(docs: DataFrame, least: int = 100, most: int = 5) -> DataFrame:
    """(lang, size, phrase, f): every phrase of up to ``most`` words that occurs ``least`` times or more in its language, and the empty phrase with the number of words."""
    texts = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), docs["text"].alias("text"))
    keys, width = pair_keys(texts, least)
    out = None
    for level, known in LEVELS:
        orders = tuple(k for k in level if k <= most)
        if not orders:
            break
        frequent = docs.sparkSession.sparkContext.broadcast(FrequentMap.of(keys, known, width))
        runs = texts.mapInArrow(_counter(orders, frequent), "lang string, size int, phrase string, n long")
        runs = runs.withColumn("prefix", F.substring_index("phrase", " ", PREFIX)).repartition("lang", "prefix")
        counts = runs.groupBy("lang", "prefix", "phrase").agg(F.max("size").alias("size"), F.sum("n").alias("f"))
        counts = written(counts.where((F.col("size") == 0) | (F.col("f") >= least)).select("lang", "size", "phrase", "f"))
        out = counts if out is None else out.unionByName(counts)
        keys, width = _phrase_keys(counts.where(F.col("size") == orders[-1]), orders[-1], 62), 62
    return out


def scored_cuts(phrases: DataFrame, scale: int = 1000) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score of each phrase of two words or more at its lowest-scoring cut; ties go to the shortest first part."""
    number = phrases.where("size = 0").select("lang", F.col("f").alias("n"))
    # one row a language; a join by language would put most phrases into one task
    number = F.broadcast(number) if number.count() <= LANGUAGES else number
    cuts = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(number, "lang")
    # 38 digits hold scale * a * n for corpora of up to 10^16 words
    wide = "cast({} as decimal(16, 0))".format
    cuts = cuts.withColumn("score", F.expr(f"({wide('a')} * {wide('n')} * cast({scale} as decimal(4, 0))) div ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "size")).alias("cut"))
    return best.select("lang", "phrase", *(f"cut.{c}" for c in ("size", "a", "l", "r", "n", "score")))


def mine(docs: DataFrame, least: int = 100, most: int = 5, inside: int = 100, top: int = 2000, scale: int = 1000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language that stand together most.

    Phrases have 2 to ``most`` words, do not cross stops, and occur ``least`` times or more in the whole corpus. A phrase inside a longer
    one that occurs at least ``inside`` hundredths as often is left out. A null language is ``und``, a null or empty text has no words,
    repeated rows and overlapping occurrences all count; texts may be of any length. Order: score, then a, both falling, then the
    phrase by UTF-8 bytes. No frequent phrase gives no rows. Other columns are not read.
    """
    phrases = frequent_phrases(docs, least, most)
    found = scored_cuts(phrases, scale)
    split = F.split("phrase", " ", -1)
    longer = phrases.where("size > 2").select("lang", "f", "size", split.alias("w"))
    longer = longer.withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.expr("size - length + 1"))))
    holders = longer.groupBy("lang", F.expr("array_join(slice(w, at, length), ' ')").alias("phrase")).agg(F.max("f").alias("held"))
    kept = found.join(holders, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: SQL twin with the default parameters
MINE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
numbered AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
phrases AS (SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[pos:pos + size - 1], ' ') AS phrase FROM (
        SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM numbered, (SELECT unnest([1, 2, 3, 4, 5])::INT AS size) WHERE len(w) >= size))
    GROUP BY lang, size, phrase),
totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM phrases WHERE size = 1 GROUP BY lang),
kept AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM phrases WHERE f >= 100),
cuts AS (SELECT lang, size, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:size], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM kept WHERE size > 1)),
scored AS (SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN kept x ON x.lang = c.lang AND x.phrase = c.first JOIN kept y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
holders AS (SELECT lang, array_to_string(w[pos:pos + length - 1], ' ') AS phrase, max(f) AS held FROM (
    SELECT *, unnest(range(1, size - length + 2)) AS pos FROM (SELECT *, unnest(range(2, size)) AS length FROM kept WHERE size > 2)) GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
    n::BIGINT AS n, score::BIGINT AS score
FROM best b LEFT JOIN holders h ON h.lang = b.lang AND h.phrase = b.phrase WHERE held IS NULL OR 100 * held < 100 * a
QUALIFY rank <= 2000
"""
