"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Every distinct word of a batch becomes a run of symbols in one flat numpy array. In each round the
smallest pair rank of each word is found by a segmented minimum, the pairs of that rank are merged
from the left in all words at once, and the array is compacted; words without a pair leave it.

The library merges one pair at a time: best score first, then leftmost. Merging several pairs of one
rank in a round gives the same result unless a merge makes a pair of better or equal rank (runs of
spaces share one score); a word's merges of a round therefore end with the first that does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidied

SPACE = "▁"
NONE = np.iinfo(np.int64).max
#: Words whose ids a task remembers; the memory is emptied when it is full.
CACHE_WORDS = 120_000
#: Characters of new words that are merged in one flat array at most, unless one word is longer.
FLAT_CHARS = 300_000


class PieceModel:
    """Tables of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        normal = {}
        for i, piece in enumerate(pieces):
            if byte[i]:
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not special[i]:
                normal[piece] = i
        # symbols are pieces or single characters of pieces that are none themselves
        symbols = dict(normal)
        for piece in normal:
            for c in piece:
                symbols.setdefault(c, n + len(symbols))
        self.base = max(symbols.values(), default=0) + 1
        self.char_symbol = np.full(0x110000, -1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = i
        order = {score: rank for rank, score in enumerate(sorted({lib.get_score(i) for i in normal.values()}, reverse=True))}
        pairs = {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (order[lib.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        #: no piece holds a space mark behind another character, or a line end: words can be merged apart
        self.splits_spaces = all(SPACE not in p.lstrip(SPACE) for p in normal)
        self.splits_lines = all("\n" not in p for p in normal)
        # decoding: the bytes of each id
        data = [b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        data[self.unk] = " ⁇ ".encode()
        self.length = np.array([len(x) for x in data], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(data), np.uint8)
        self.led = np.array([p.startswith(SPACE) and not byte[i] for i, p in enumerate(pieces)])
        self.control = np.array([lib.is_control(i) for i in range(n)])

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE where there is none."""
        key = np.where((a < 0) | (b < 0), -1, a * self.base + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.merged[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and where each word's ids end."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        symbol, char = self.char_symbol[codes], codes
        word = np.repeat(np.arange(len(words)), lengths)
        same = word[:-1] == word[1:]
        rank, into = np.full(len(symbol), NONE), np.zeros(len(symbol), np.int64)  # of the pair that starts at a symbol
        rank[:-1][same], into[:-1][same] = self.pair(symbol[:-1][same], symbol[1:][same])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(first, append=len(symbol)))
            over = best == NONE
            if over.any():
                done.append((word[over], symbol[over], char[over]))
                more = ~over
                symbol, char, word, rank, into, best = (x[more] for x in (symbol, char, word, rank, into, best))
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            run = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))  # of overlapping pairs every other one, from the left
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            made, owner, limit = into[at], word[at], best[at]
            after = np.minimum(at + 2, len(symbol) - 1)
            has = (at + 2 < len(symbol)) & (word[after] == owner)
            right, right_into = np.full(len(at), NONE), np.zeros(len(at), np.int64)
            right[has], right_into[has] = self.pair(made[has], symbol[after[has]])
            lead = np.maximum(at - 1, 0)
            has = (at > 0) & (word[lead] == owner)
            before = symbol[lead]
            joined = np.flatnonzero(at[1:] == at[:-1] + 2) + 1  # the symbol before was merged just now
            before[joined], lead[joined] = made[joined - 1], at[joined - 1]
            left, left_into = np.full(len(at), NONE), np.zeros(len(at), np.int64)
            left[has], left_into[has] = self.pair(before[has], made[has])
            worse = (right <= limit) | (left <= limit)
            if worse.any():
                seen = np.cumsum(worse) - worse
                start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                keep = seen == np.repeat(seen[start], np.diff(start, append=len(at)))
                at, made, right, right_into, lead, left, left_into, has = (x[keep] for x in (at, made, right, right_into, lead, left, left_into, has))
            symbol[at], rank[at], into[at] = made, right, right_into
            rank[lead[has]], into[lead[has]] = left[has], left_into[has]
            more = np.ones(len(symbol), bool)
            more[at + 1] = False
            symbol, char, word, rank, into = (x[more] for x in (symbol, char, word, rank, into))
        if not done:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        word, symbol, char = (np.concatenate(x) for x in zip(*done, strict=True))
        back = np.argsort(word, kind="stable")
        word, symbol, char = word[back], symbol[back], char[back]
        odd = np.flatnonzero((symbol < 0) | (symbol >= len(self.length)))
        if len(odd):  # characters that are no piece become bytes
            parts = [chr(c).encode("utf-8", "surrogatepass") for c in char[odd].tolist()]
            times = np.ones(len(symbol), np.int64)
            times[odd] = [len(p) for p in parts]
            start = np.cumsum(times) - times
            symbol, word = np.repeat(symbol, times), np.repeat(word, times)
            to = np.repeat(start[odd], times[odd]) + np.concatenate([np.arange(len(p)) for p in parts])
            symbol[to] = self.byte_ids[np.frombuffer(b"".join(parts), np.uint8)]
        return symbol, np.searchsorted(word, np.arange(1, len(words) + 1))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; a leading space mark is dropped, as the encoder added it."""
        ids = ids[~self.control[ids]] if len(ids) else ids
        if not len(ids):
            return b""
        size = self.length[ids]
        end = np.cumsum(size)
        out = self.blob[np.repeat(self.start[ids] - (end - size), size) + np.arange(int(end[-1]))].tobytes()
        out = out[1:] if self.led[ids[0]] else out
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "replace").encode()
        return out


class Encoder:
    """Encodes texts with one model, remembering the ids of words."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.known: dict[str, bytes] = {}
        apart = rf"{SPACE}*[^{SPACE}\n]*" if self.model.splits_lines else rf"{SPACE}*[^{SPACE}]*"
        self.segments = re.compile(rf"\n|{apart}" if self.model.splits_lines else apart).findall

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if not self.model.splits_spaces:
            return [marked]
        return self.segments(marked)

    def learn(self, words: set[str]) -> None:
        new, chars = [], 0
        for w in [w for w in words if w not in self.known]:
            new.append(w)
            chars += len(w)
            if chars >= FLAT_CHARS:
                self._add(new)
                new, chars = [], 0
        self._add(new)

    def _add(self, new: list[str]) -> None:
        if new:
            ids, ends = self.model.merge(new)
            raw, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            self.known.update((w, raw[a:b]) for w, a, b in zip(new, [0, *ends], ends, strict=False))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, with begin and end ids; the new words of all texts are merged together."""
        begin, end = (np.array([x], "<u4").tobytes() for x in (self.model.bos, self.model.eos))
        words = [self.words(text) for text in texts]
        used = set().union(*words)
        if len(self.known) > CACHE_WORDS:
            self.known = {w: x for w, x in self.known.items() if w in used}
        self.learn(used)
        for own in words:
            yield begin + b"".join(map(self.known.__getitem__, own)) + end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(texts: list[str | None], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Consecutive groups of texts of about ``chars`` characters; null counts as empty."""
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(t or "")
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def sentencepiece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes each text with begin and end ids, then decodes the ids.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256 (and ids, an array, if ``keep_ids``) per row of
    ``docs``. A null text counts as empty: its ids are begin and end alone. Ids may be null or repeat; other
    columns are not read. ``model_path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            counts, digests, decoded, lists = [], [], [], []
            for texts in slices(batch.column(1).to_pylist()):
                for raw in enc.encode(texts):
                    ids = np.frombuffer(raw, "<u4")
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(enc.model.decode_bytes(ids.astype(np.int64))).hexdigest())
                    if keep_ids:
                        lists.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)
