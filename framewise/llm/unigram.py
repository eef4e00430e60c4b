"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character of a word, the longest
first; dynamic programming keeps, for each character, only the best score and the piece count of the path that
has it. As in the tokenizer, a later candidate wins by a strictly better score alone, so of equal paths that with
the longest last piece stays. Scores are added in double precision. A character that is no piece is an unknown
one: its score is ten below the lowest of the vocabulary, and it counts for its bytes if the vocabulary has byte
pieces, otherwise a run of unknown characters counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidied

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 300_000


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with their scores, and the id of the unknown one, from a SentencePiece model file."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(lib.id_to_piece(i), lib.get_score(i)) for i in range(lib.get_piece_size())], lib.unk_id()


class Counter:
    """Piece counts of words, with a bounded memory."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of one word: best path, ties as in the tokenizer."""
        if not self.single.issuperset(word):
            return self.count_with_unknown(word)
        score, pieces = [0.0], [0]
        for end, (length, gain) in self.automaton.iter(word):  # a match at least for each end, there from the first start on
            start = end + 1 - length
            total = score[start] + gain
            if len(score) == end + 1:
                score.append(total)
                pieces.append(pieces[start] + 1)
            elif total > score[-1]:
                score[-1], pieces[-1] = total, pieces[start] + 1
        return pieces[-1]

    def count_with_unknown(self, word: str) -> int:
        """The same for a word with characters that are no pieces."""
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        pieces = [0] * (n + 1)
        unknown_before = [False] * (n + 1)  # the path's last piece is an unknown character
        score[0] = 0.0
        ends: list[list[tuple[int, float]] | None] = [None] * (n + 1)
        for end, match in self.automaton.iter(word):
            if ends[end + 1] is None:
                ends[end + 1] = []
            ends[end + 1].append(match)
        for e in range(1, n + 1):
            best, count, odd = None, 0, False
            for length, gain in ends[e] or ():  # from the longest, that is from the first start
                before = score[e - length]
                if best is None or before + gain > best:
                    best, count, odd = before + gain, pieces[e - length] + 1, False
            char = word[e - 1]
            if char not in self.single:
                total = score[e - 1] + self.unknown
                if best is None or total > best:
                    more = len(char.encode("utf-8", "surrogatepass")) if self.bytes else 0 if unknown_before[e - 1] else 1
                    best, count, odd = total, pieces[e - 1] + more, True
            score[e], pieces[e], unknown_before[e] = best, count, odd
        return pieces[n]

    def count_text(self, text: str) -> int:
        """A text that already starts with a space gets no further mark."""
        if not text:
            return 0
        first, *rest = text.replace(SPACE, " ").split(" ")
        if not first and rest:
            first, *rest = rest
        total, get = 0, self.known.get
        for word in (first, *rest):
            n = get(word)
            if n is None:
                if len(self.known) >= CACHE_WORDS:
                    self.known.clear()
                n = self.known[word] = self.count(SPACE + word)
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_vocabulary(path)[0])


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and n_tokens per row of ``docs``, over whole texts.

    Null and empty texts have 0 tokens. Null and repeated ids are counted row by row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path).count_text
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.as_py() or "") for t in batch.column(1)], pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint")
