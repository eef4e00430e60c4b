"""N-gram Jaccard join with Bayesian candidate pruning.

Each distinct text has the set of its 5-word shingles and a MinHash signature. Texts that share a band of the signature
are candidates. They are dealt into blocks, those of one neighbourhood together, and a text meets the blocks in which it
has a candidate. In such a tile the hashes of a pair are compared step by step: a pair is dropped as soon as the
posterior probability that its Jaccard similarity reaches the threshold, given the matches so far, falls below the
tolerance. The pairs that are left are verified on their whole shingle sets. Only links that hold join texts into
classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, save, save_at, scratch, staged, tidied
from .components import components
from .tiles import LINKED, linked, over_tiles

WORDS = 5
BANDS, BAND_HASHES = 36, 6
HASHES = BANDS * BAND_HASHES
#: A pair is dropped when its chance to reach the threshold is below this.
TOLERANCE = 1e-6
STEP = 36
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    top = np.iinfo(np.uint32).max
    return rng.integers(0, top, HASHES, np.uint32) | np.uint32(1), rng.integers(0, top, HASHES, np.uint32)


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(4).integers(1, np.iinfo(np.uint64).max, 256, np.uint64)


@lru_cache(maxsize=24)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers of an odd number and of its inverse, modulo 2**64."""
    r = int(ODD)
    return tuple(np.concatenate(([np.uint64(1)], np.full((1 << bits) - 1, x, np.uint64))).cumprod(dtype=np.uint64) for x in (r, pow(r, -1, 1 << 64)))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, words parted by ASCII white space: differences of one running polynomial over the bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    up, down = powers(max(len(data).bit_length(), 10))
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate(([np.uint64(0)], (byte_values()[data] * up[: len(data)]).cumsum(dtype=np.uint64)))
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of all windows of WORDS words; a shorter text is one shingle, one without words none."""
    h = word_hashes(text or "")
    n = min(WORDS, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * ODD + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values, shortened to 16 bits: two that differ agree by chance in one of 65,536 cases."""
    a, b = multipliers()
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for part in np.split(short, range(16_384, len(short), 16_384)):  # bounded memory for long texts
        for k in range(0, HASHES, 24):
            out[k : k + 24] = np.minimum(out[k : k + 24], (part[None, :] * a[k : k + 24, None] + b[k : k + 24, None]).min(1))
    return (mixed(out.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each STEP hashes compared: the fewest matches at which P(similarity >= threshold), under a uniform prior, is at least ``tolerance``."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        density = np.exp(log - log.max(1, keepdims=True))
        out.append(int(np.argmax(density[:, s >= threshold].sum(1) / density.sum(1) >= tolerance)))
    return np.array(out)


def surviving(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of a, rows of b) that no step drops."""
    matches = np.zeros(len(left), np.int32)
    for k, least in enumerate(least_matches(threshold)):
        for p in range(0, len(left), 131_072):
            part = slice(p, p + 131_072)
            matches[part] += (a[left[part], k * STEP : (k + 1) * STEP] == b[right[part], k * STEP : (k + 1) * STEP]).sum(1, dtype=np.int32)
        keep = matches >= least
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the pairs' intersections: one pair at a time, or for many pairs by products of 0/1 matrices over the shingles of two rows or more."""
    if len(left) <= 400:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    rows = np.unique(np.concatenate([left, right]))
    place = np.full(len(sets), -1)
    place[rows] = np.arange(len(rows))
    lengths = np.array([len(sets[r]) for r in rows])
    _, ids, times = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), lengths)
    common = times[ids] > 1
    ids, row = ids[common], row[common]
    names, ids = np.unique(ids, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    total = np.zeros((len(rows), len(rows)), np.float32)
    for k in range(0, len(names), 4_096):
        a, b = np.searchsorted(ids, (k, k + 4_096))
        x = np.zeros((len(rows), min(4_096, len(names) - k)), np.float32)
        x[row[a:b], ids[a:b] - k] = 1
        total += x @ x.T
    return total[place[left], place[right]].astype(np.int64)


def link_tile(tile: pa.Table, itself: bool, threshold: float) -> pa.RecordBatch | None:
    ids, first = np.unique(tile["uid"].to_numpy(), return_index=True)  # a repeated row is met once
    copies, side = tile["copies"].to_numpy()[first], tile["side"].to_numpy()[first]
    if len(ids) < 2:
        return None
    signatures, blobs = tile["sig"], tile["shingles"]
    sig = np.frombuffer(b"".join(signatures[int(i)].as_py() for i in first), np.uint16).reshape(len(ids), HASHES)
    a = np.flatnonzero(side == 0)
    b = a if itself else np.flatnonzero(side == 1)
    found = []
    for k in range(0, len(a), 256):  # bounded arrays of pairs
        left, right = (x.ravel() for x in np.meshgrid(a[k : k + 256], b, indexing="ij"))
        if itself:
            left, right = left[left < right], right[left < right]
        found.append(surviving(sig, sig, left, right, threshold))
    left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(left):
        return None
    sets = [np.frombuffer(blobs[int(i)].as_py(), np.uint64) for i in first]
    size = np.array([len(s) for s in sets])
    both = shared_counts(sets, left, right)
    hit = both >= threshold * (size[left] + size[right] - both) - 1e-9
    return linked(left[hit], right[hit], ids, copies) if hit.any() else None


#: Stands for a null doc_id.
LAST = 2**63 - 1


def signed_rows(rows: DataFrame) -> DataFrame:
    """doc_id, part, key, text_key, n (shingles) and sig per row of ``rows`` (doc_id, text without nulls, part, key)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, signatures = [], [], []
            for t in batch.column(3):
                text = t.as_py()
                s = shingle_set(text)
                keys.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest())
                counts.append(len(s))
                signatures.append(signature(s).tobytes() if len(s) else b"")
            columns = [*batch.columns[:3], pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "key", "text_key", "n", "sig"])

    return rows.select("doc_id", "part", "key", "text").mapInArrow(tidied(sign), "doc_id long, part int, key long, text_key string, n long, sig binary")


def shared_bands(reps: DataFrame) -> DataFrame:
    """uid, band, leader (smallest uid) and n (texts) of every band that two texts or more share, saved. reps: uid, sig."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * 2 * BAND_HASHES + 1, F.lit(2 * BAND_HASHES))))
    bands = reps.select("uid", F.explode(keys).alias("band"))
    buckets = save(bands.groupBy("band").agg(F.min("uid").alias("leader"), F.count("*").alias("n")).where("n > 1"), "bands")
    return save(join_keyed(bands, buckets.select("band", "leader", "n", F.col("n").alias("texts")), ["band"], BANDS * reps.count()), "shared-bands")


def dealt_to_blocks(reps: DataFrame) -> DataFrame:
    """uid, block and partners of every text that shares a band. reps: uid, n, sig.

    A text's neighbourhood is the smallest uid two steps away over shared bands. Neighbourhoods of half a block or more
    have blocks of their own, others share them by hash. Partners are the blocks of the texts that share a band.
    """
    shared = shared_bands(reps)
    rows = shared.count()
    label = save(shared.groupBy("uid").agg(F.min("leader").alias("label")), "labels")
    nearest = shared.select("uid", "band", "texts").join(label, "uid").groupBy("band").agg(F.min("label").alias("label"), F.first("texts").alias("n"))
    label = join_keyed(shared.select("uid", "band"), save(nearest, "band-labels"), ["band"], rows).groupBy("uid").agg(F.min("label").alias("label"))
    label = save(label.join(reps.select("uid", "n"), "uid").select("uid", "label", F.col("n").alias("shingles")), "labels")
    size = lambda rows, shingles: F.greatest(F.col(rows) / BLOCK_ROWS, F.col(shingles) / BLOCK_SHINGLES)
    sizes = label.groupBy("label").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles")).withColumn("blocks", size("n", "shingles"))
    sizes = save(sizes.select("label", "n", "blocks"), "neighbourhoods")
    few = sizes.agg(F.sum(F.when(F.col("blocks") < 0.5, F.col("blocks")))).first()[0] or 0.0
    small = F.pmod(F.xxhash64("label"), F.lit(int(2 * few) + 1))
    own = F.xxhash64("label", F.pmod(F.xxhash64("uid"), F.ceil("blocks")))
    block = F.when(F.col("blocks") < 0.5, small).otherwise(own).alias("block")
    blocks = save(join_keyed(label, sizes, ["label"], label.count()).select("uid", block), "blocks")
    in_band = shared.select("uid", "band", "texts").join(blocks, "uid")
    reach = in_band.groupBy("band").agg(F.sort_array(F.collect_set("block")).alias("blocks"), F.first("texts").alias("n")).where(F.size("blocks") > 1)
    others = join_keyed(shared.select("uid", "band"), save(reach, "band-blocks"), ["band"], rows).groupBy("uid").agg(F.collect_set("blocks").alias("others"))
    partners = F.array_distinct(F.flatten(F.coalesce(F.col("others"), F.array().cast("array<array<bigint>>"))))
    return blocks.join(others, "uid", "left").select("uid", "block", F.array_union(F.array("block"), partners).alias("partners"))


def text_links(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, reps, tiles), saved: rows with their text_key, different texts, and the links that tiles found.

    rows: doc_id, text without nulls, part and key of staged rows. Texts stay in their buckets: one that has candidates
    is cut into shingles there, and these are dealt to tiles.
    """
    names = ["block", "partners", "uid", "copies", "sig"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [shingle_set(t.as_py()).tobytes() for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(blobs, pa.binary())], names=[*names, "shingles"])

    with scratch(rows.sparkSession) as keep:
        signed, path = save_at(signed_rows(rows), "signatures")
        keep(path)
        first = [F.min(F.coalesce("doc_id", F.lit(LAST))).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")]
        reps = signed.where("n > 0").groupBy("text_key").agg(*first, F.min(F.struct("part", "key")).alias("at"))  # one of a text's rows stands for it
        reps, path = save_at(reps.select("*", "at.part", "at.key", F.monotonically_increasing_id().alias("uid")).drop("at"), "texts")
        keep(path)
        members = save(dealt_to_blocks(reps).join(reps, "uid").select(*names, "part", "key"), "members")
        texts = rows.select("part", "key", "text").join(members.hint("shuffle_hash"), ["part", "key"]).select(*names, "text")
        cuts = texts.mapInArrow(tidied(cut), "block long, partners array<long>, uid long, copies long, sig binary, shingles binary").withColumn("group", F.lit(0).cast("long"))
        tiles, path = save_at(over_tiles(cuts, lambda t, itself: link_tile(t, itself, threshold), LINKED), "text-links")
        keep(path)
    return signed, reps, tiles


def classified(signed: DataFrame, reps: DataFrame, tiles: DataFrame) -> DataFrame:
    """doc_id, part, key, text_key, n_links and kept per signed row: kept is the least (doc_id, text_key) of the row's class, null for texts without words; LAST stands for a null id."""
    links = tiles.groupBy("uid").agg(F.sum("links").alias("links"))
    named = components(tiles.select("uid", "root")).join(reps.select(F.col("uid").alias("node"), F.struct("rep", "text_key").alias("own")), "node")
    named = save(named, "text-components")
    least = save(named.groupBy("root").agg(F.min("own").alias("kept"), F.count("*").alias("n")), "text-roots")
    named = join_keyed(named, least, ["root"], named.count()).select(F.col("node").alias("uid"), "kept")
    found = reps.select("uid", "text_key", "rep", "copies").join(links, "uid", "left").join(named, "uid", "left")
    n_links, kept = F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.coalesce("kept", F.struct("rep", "text_key"))
    found = save(found.select("text_key", n_links.alias("n_links"), kept.alias("kept"), F.col("copies").alias("n")), "text-classes")
    own = ["doc_id", "part", "key", "text_key"]
    nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("n_links", "kept")]
    wordless, worded = signed.where("n = 0").select(*own, *nothing), signed.where("n > 0").select(*own)
    return join_keyed(worded, found, ["text_key"], worded.count()).select(*own, "n_links", "kept").unionByName(wordless)


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_key, class_id and n_links per row of ``docs`` (doc_id, text).

    Texts link when the Jaccard similarity of their shingle sets is at least ``threshold``; n_links counts the other
    rows linked directly, copies too, and class_id is the smallest doc_id reachable. Texts without words (null, empty,
    white space) link with nothing. Repeated rows are copies; null doc_ids count as the largest, and a class of null
    ids alone has a null class_id. Extra columns are not read. text_key is the text's MD5.
    """
    with staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))) as rows:
        found = text_links(rows, threshold)
    name = F.col("kept.rep")
    named = F.when(F.col("kept").isNull(), F.col("doc_id")).when(name != LAST, name).alias("class_id")
    return classified(*found).select("doc_id", "text_key", named, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each_class(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of ``docs`` of each class, all columns kept: that of the smallest doc_id (null ones last), then of the smallest text_key.

    Texts without words are a class each, so they stay (repeated rows of one id once).
    """
    names = docs.columns
    held = {c: f"__keep{i}" for i, c in enumerate(names)}  # extra columns may have any name
    with scratch(docs.sparkSession) as keep, staged(docs.select(*[F.col(f"`{c}`").alias(h) for c, h in held.items()])) as rows:
        texts = rows.select(F.col(held["doc_id"]).cast("long").alias("doc_id"), F.coalesce(held["text"], F.lit("")).alias("text"), "part", "key")
        own = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("rep"), "text_key")
        classes = classified(*text_links(texts, threshold)).where(F.col("kept").isNull() | (F.col("kept") == own))
        chosen = classes.groupBy(own.alias("own")).agg(F.min(F.struct("part", "key")).alias("at")).select("at.part", "at.key")
        kept = rows.join(chosen.hint("shuffle_hash"), ["part", "key"], "left_semi").select(*[F.col(h).alias(c) for c, h in held.items()])
        kept, path = save_at(kept, "kept")
        keep(path)
    return kept
