"""Packing of documents into windows of tokens, each filled with lexical neighbours of its seed document.

Whole windows of long documents stand alone; what is left of each document, its tail, is packed with others. Tails are
dealt into shards of bounded size by a signature of their tokens, so that those of like vocabulary share a shard. Each
shard has a BM25 inverted index over its tails. A seed asks it for its best unused neighbours, which fill the seed's window in
the order of their scores; the last one is cut where the window ends, and what is left of it seeds the next window.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, tidied

#: Tokens of a shard, about; its tails and its index are one task's at a time.
SHARD_TOKENS = 1 << 20
#: Bits of a signature; its values are the bins that shards are made of.
BITS = 16
#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
#: A shard's windows are numbered below this; whole windows of a task of the first pass below 2^33.
SHARD_WINDOWS = 1 << 24


#: Texts from this length on are encoded by a call that can be refused, which takes longer.
LONG_CHARS = 50_000


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None):
    """Ids of a text as a tokenizers file gives them, without special tokens added; by the file itself, or by the same vocabulary as ranks, which is faster."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    if ranks is None:
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return np.array(fast.encode_ordinary(text) if len(text) < LONG_CHARS else fast.encode(text, disallowed_special=()), np.uint32)
            except ValueError:  # a run of a million spaces is more than its patterns' stack holds; encode_ordinary could not tell
                pass
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


@lru_cache(maxsize=2)
def signs(bits: int) -> np.ndarray:
    """Random signs of 2^16 token residues, the same in every process."""
    return np.random.default_rng(29).choice(np.array([-1, 1], np.int8), (1 << 16, bits))


def signature(ids: np.ndarray) -> int:
    """Bits of the summed signs of a tail's tokens: tails of like tokens share leading bits."""
    total = signs(BITS)[ids & 0xFFFF].sum(0, dtype=np.int32)
    return int(np.packbits(total > 0).view(">u2")[0])


class Index:
    """BM25 over a shard's tails: for each term its tails and their weights."""

    def __init__(self, tails: list[np.ndarray]):
        n = len(tails)
        terms, times = zip(*(np.unique(t, return_counts=True) for t in tails), strict=True)
        self.terms = terms
        tail = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
        term, times = np.concatenate(terms), np.concatenate(times)
        order = np.argsort(term, kind="stable")
        term, tail, times = term[order], tail[order], times[order]
        self.known, start, df = np.unique(term, return_index=True, return_counts=True)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        self.useful = idf > 0  # terms of half of the tails or more tell nothing
        length = np.array([len(t) for t in tails], np.float64)
        norm = K1 * (1 - B + B * length / max(length.mean(), 1.0))
        weight = np.repeat(idf, df) * times * (K1 + 1) / (times + norm[tail])
        bounds = list(zip(start.tolist(), (start + df).tolist(), strict=True))
        self.postings = [(tail[a:b], weight[a:b]) if u else None for (a, b), u in zip(bounds, self.useful, strict=True)]
        self.n = n

    def neighbours(self, i: int, used: np.ndarray) -> np.ndarray:
        """Tails not ``used`` that share a useful term with tail ``i``, the highest score first, ties by place."""
        at = np.searchsorted(self.known, self.terms[i])
        held = [self.postings[k] for k in at[self.useful[at]].tolist()]
        if not held:
            return np.empty(0, np.int64)
        score = np.bincount(np.concatenate([t for t, _ in held]), np.concatenate([w for _, w in held]), self.n)
        found = np.flatnonzero((score > 0) & ~used)
        return found[np.lexsort((found, -score[found]))]


def fill_windows(tails: list[np.ndarray], size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (tail, start, length): each but the last holds ``size`` tokens.

    A seed is what is left of the tail that was cut last, or else the first unused tail. Its unused neighbours follow by
    score, and unused tails in order where there are no more.
    """
    index = Index(tails) if len(tails) > 1 else None
    length = [len(t) for t in tails]
    used = np.zeros(len(tails), bool)
    following, rest = 0, None  # the first tail that may be unused; the tail that was cut and where
    while True:
        if rest is None:
            while following < len(tails) and used[following]:
                following += 1
            if following == len(tails):
                return
            rest = following, 0
            used[following] = True
        (seed, begin), rest = rest, None
        window, room = [(seed, begin, length[seed] - begin)], size - (length[seed] - begin)
        if room > 0:
            for other in index.neighbours(seed, used).tolist() if index else ():
                used[other] = True
                window.append((other, 0, min(room, length[other])))
                room -= length[other]
                if room <= 0:
                    break
        while room > 0:
            while following < len(tails) and used[following]:
                following += 1
            if following == len(tails):
                break
            used[following] = True
            window.append((following, 0, min(room, length[following])))
            room -= length[following]
        if room < 0:
            last, at, n = window[-1]
            rest = last, at + n
        yield window


def in_powers(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """A window that is not full as sequences of powers of two, the largest first: they need no padding."""
    left = sum(n for _, _, n in window)
    pieces = list(reversed(window))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            tail, at, n = pieces.pop()
            out.append((tail, at, min(n, room)))
            if n > room:
                pieces.append((tail, at + room, n - room))
            room -= min(n, room)
        yield out


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def dealt_to_shards(tails: DataFrame, shard_tokens: int) -> DataFrame:
    """Adds shard. Bins of the signature are dealt into shards of about ``shard_tokens``: small neighbouring bins share one, a large one has several, by hash."""
    bins = tails.groupBy("bin").agg(F.sum("n_tail").alias("held"))
    before = F.sum("held").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")  # 2^BITS bins at most
    own = F.greatest(F.floor(F.col("held") / shard_tokens), F.lit(1))
    bins = bins.select("bin", F.floor(before / shard_tokens).alias("first"), own.alias("own"))
    return tails.join(F.broadcast(bins), "bin").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("uid"), "own")).cast("long"))


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, end_id: int = 1, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Pieces of all documents: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids' places in gapless sequences of ``size`` tokens at most.

    A document's tokens are the ids of its text by the tokenizers file ``tokenizer``, then ``end_id``; a null text is empty. With
    ``ranks``, the same vocabulary as a tiktoken file, ids are the same and faster found. start counts the document's
    tokens before the piece, offset those of the sequence. All sequences hold ``size`` tokens, but for each shard's
    last, which is cut into sequences of powers of two: no sequence needs padding. Even sequence ids are whole windows of one
    document, odd ones packed windows; they are not consecutive. Ids may be null or repeat, each row is a document of its
    own; other columns are not read. Neighbours come from a document's shard, whose statistics are the shard's own.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, ranks)
        windows = TaskContext.get().partitionId() << 33
        for batch in batches:
            counts, heads, firsts, tails, bins = [], [], [], [], []
            for x in batch.column(1):
                ids = np.append(encode(x.as_py() or ""), np.uint32(end_id))
                whole = len(ids) // size
                counts.append(len(ids))
                heads.append([crc_of(ids[i * size : (i + 1) * size]) for i in range(whole)])
                firsts.append(windows)
                windows += whole
                tail = ids[whole * size :]
                tails.append(tail.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())
                bins.append(signature(tail))
            columns = [pa.array(counts, pa.int64()), pa.array(heads, pa.list_(pa.int64())), pa.array(firsts, pa.int64()), pa.array(tails, pa.binary()), pa.array(bins, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "doc_tokens", "heads", "first", "tail", "bin"])

    schema = f"id {kind}, doc_tokens long, heads array<long>, first long, tail binary, bin int"
    seen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(tokenize), schema)
    seen = save(seen.withColumn("uid", F.monotonically_increasing_id()), "packing-tokens")
    heads = seen.where(F.size("heads") > 0).select("id", "doc_tokens", "first", F.posexplode("heads").alias("k", "ids_crc32"))
    heads = heads.select("id", (F.col("k") * size).cast("long").alias("start"), F.lit(size).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (2 * (F.col("first") + F.col("k"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    tails = seen.withColumn("n_tail", F.col("doc_tokens") % size).where("n_tail > 0").select("id", "uid", "doc_tokens", "n_tail", "tail", "bin")
    dealt = dealt_to_shards(tails, shard_tokens).select("shard", "uid", "id", "doc_tokens", "n_tail", "tail")
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "uid")

    def pack_shard(shard: int, rows: pa.Table) -> pa.RecordBatch:
        counts = rows["n_tail"].to_numpy()
        raw = rows["tail"].to_pylist()
        tails = [np.frombuffer(r, "<u2" if len(r) == 2 * n else "<u4") for r, n in zip(raw, counts.tolist(), strict=True)]
        owner, start, length, crc, sequence, offset = [], [], [], [], [], []
        number = 2 * shard * SHARD_WINDOWS + 1
        for window in fill_windows(tails, size):
            for part in [window] if sum(n for _, _, n in window) == size else in_powers(window):
                before = 0
                for tail, at, n in part:
                    owner.append(tail)
                    start.append(at)
                    length.append(n)
                    crc.append(crc_of(tails[tail][at : at + n]))
                    sequence.append(number)
                    offset.append(before)
                    before += n
                number += 2
        owner = np.array(owner, np.int64)
        tokens = rows["doc_tokens"].to_numpy()[owner]
        start = tokens - counts[owner] + np.array(start, np.int64)
        columns = [rows["id"].combine_chunks().take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens, sequence, offset))]
        return pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy()
            cut = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if int(shard[a]) != last:
                    if held:
                        yield pack_shard(last, pa.Table.from_batches(held))
                    held, last = [], int(shard[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield pack_shard(last, pa.Table.from_batches(held))

    packed = dealt.mapInArrow(tidied(pack_shards), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return heads.unionByName(packed).withColumnRenamed("id", id_col)
