"""Token counts of a unigram vocabulary without tokens: Viterbi that carries the best score and the piece count only.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; the best score to a place is the largest of
score to the piece's start plus piece score. Ties go to the longer piece, as the tokenizer's own search (starts in order, later
candidates only if strictly better) does. Characters without a piece of their own cost the smallest score less 10; where the
vocabulary has all bytes they count as their bytes, else a run of them counts as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: stands for a space; units begin with it
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: units whose counts a task remembers before it starts anew
REMEMBERED = 1 << 20


@dataclass
class Vocabulary:
    """Pieces with scores, and the place of the unknown piece."""

    pieces: list[tuple[str, float]]
    unknown: int = 0

    @staticmethod
    def read(path: str) -> Vocabulary:
        """The pieces and scores of a sentencepiece model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Vocabulary([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id())

    @property
    def bytes_known(self) -> bool:
        known = {p for p, _ in self.pieces}
        return all(f"<0x{b:02X}>" in known for b in range(256))


class Counter:
    """Counts pieces of texts, unit by unit; units that come again are looked up."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary.pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == vocabulary.unknown))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_known = vocabulary.bytes_known
        # no piece reaches over a line end: lines then count apart, and come again more often
        self.lines = not any("\n" in p for p, _ in vocabulary.pieces) and self.bytes_known
        self.seen: dict[str, int] = {}

    def unit(self, unit: str) -> int:
        """Pieces on the best path of one unit."""
        n = len(unit)
        best, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        ending: list[list] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, found in self.automaton.iter(unit):
                ending[end].append(found)
        for end in range(n):
            score, pieces, run, single = None, 0, None, False
            matches = ending[end]
            matches.sort(key=lambda f: -f[0])  # starts in order
            for length, own, is_unknown in matches:
                single = single or length == 1
                start = end + 1 - length
                reached = own + best[start]
                if score is None or reached > score:
                    score = reached
                    pieces, run = self._step(count[start], open_run[start], unit[start : end + 1] if is_unknown else None)
            if not single:
                reached = self.unknown + best[end]
                if score is None or reached > score:
                    score = reached
                    pieces, run = self._step(count[end], open_run[end], unit[end])
            best[end + 1], count[end + 1], open_run[end + 1] = score, pieces, run
        return count[n]

    def _step(self, before: int, run: tuple[int, str] | None, unknown: str | None) -> tuple[int, tuple[int, str] | None]:
        """Count behind a piece, and the open run of unknown characters: they are one string, looked up and else cut into bytes."""
        if unknown is None:
            return before + 1, None
        first, string = run or (before, "")
        string += unknown
        cost = 1 if string in self.automaton or not self.bytes_known else len(string.encode())
        return first + cost, (first, string)

    def text(self, text: str | None) -> int:
        """Pieces of a whole text; null and empty have none."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        units = marked.split(MARK)
        if marked[0] == MARK:
            units = units[1:]
        total, seen = 0, self.seen
        for word in units:
            word = MARK + word
            got = seen.get(word)
            if got is None:
                if len(seen) > REMEMBERED:
                    seen.clear()
                got = sum(map(self.unit, word.split("\n"))) + word.count("\n") if self.lines else self.unit(word)
                seen[word] = got
            total += got
        return total


def token_counts(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens of every row, over its whole text. Null and empty texts have none; empty tables give no rows; other columns are not read."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            # one text at a time: a batch of long texts is never held twice
            counts = [counter.text(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))


def counts_by(counts: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, n_docs, n_tokens): counts summed for each value of a column of ``docs``, joined by doc_id."""
    return counts.join(docs.select("doc_id", key), "doc_id").groupBy(key).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
