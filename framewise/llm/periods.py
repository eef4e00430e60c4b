"""Periodic runs of words by tiles of period octaves.

A run of period q is a stretch in which words q apart are identical: its *matches*, the positions whose word equals that
q words later, are an unbroken interval of at least q. Periods from 2^k to 2^(k+1) - 1 are an octave. For each octave a
document is cut into overlapping tiles, and each is solved by itself: at boundaries a half octave apart, Z-values, the
lengths of common prefixes behind a boundary and behind the place q later, and of common suffixes before them, give the
matches around the boundary for every q of the octave. Every interval long enough holds a boundary and the words right
after it, so only boundaries with an equal stretch q later are followed. Intervals that reach a tile's end are fragments:
they are shuffled by document and period, and those that overlap are stitched.

Stretches are compared by names: equal stretches of 2^j words have one number, so that Z-values come from few look-ups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, tidied

#: Words of a tile without its margins, at least; a tile of octave k has 8 * 2^k at least.
TILE_WORDS = 1 << 16


def names(ids: np.ndarray, distinct: int) -> list[np.ndarray]:
    """For each j the name of the 2^j words from each place: equal ones share a number, those that occur once have -1.

    The last level is the first without repeats.
    """
    out = [ids.astype(np.int64)]
    bound = distinct
    while True:
        step, before = 1 << (len(out) - 1), out[-1]
        n = len(before) - step
        level = np.full(max(n, 0), -1, np.int64)
        if n > 0:
            alive = np.flatnonzero((before[:n] >= 0) & (before[step:] >= 0))
            if len(alive):
                _, name, times = np.unique(before[alive] * bound + before[alive + step], return_inverse=True, return_counts=True)
                twice = times[name] > 1
                level[alive[twice]] = name[twice]
                bound = len(times)
        out.append(level)
        if not (level >= 0).any():
            return out


def same(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` words from a and from b, different places, are equal."""
    out = np.zeros(len(a), bool)
    top = np.maximum(np.frexp(length.astype(np.float64))[1] - 1, 0)
    for j in np.unique(top):
        at = np.flatnonzero(top == j)
        if j < len(levels):
            x, y, end = levels[j][a[at]], levels[j][b[at]], length[at] - (1 << int(j))
            x2, y2 = levels[j][a[at] + end], levels[j][b[at] + end]
            out[at] = (x >= 0) & (x == y) & (x2 >= 0) & (x2 == y2)
    return out | (length <= 0)


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Z-values: how many words from a and from b on are equal, b after a."""
    out = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(b + out < len(levels[j]))
        x, y = levels[j][a[fits] + out[fits]], levels[j][b[fits] + out[fits]]
        out[fits[(x >= 0) & (x == y)]] += 1 << j
    return out


def common_suffix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before a and before b are equal, b after a."""
    out = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        step = 1 << j
        fits = np.flatnonzero(a - out >= step)
        x, y = levels[j][a[fits] - out[fits] - step], levels[j][b[fits] - out[fits] - step]
        out[fits[(x >= 0) & (x == y)]] += step
    return out


@lru_cache(maxsize=4)
def least_factors(top: int) -> np.ndarray:
    """The least prime factor of each number below ``top``."""
    out = np.arange(top)
    for p in range(2, int(top**0.5) + 1):
        if out[p] == p:
            multiples = out[p * p :: p]
            multiples[multiples == np.arange(p * p, top, p)] = p
    return out


def is_power(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the ``period`` words from ``at`` repeat a shorter stretch: a run there has a smaller period."""
    factors, rest = least_factors(1 << int(period.max()).bit_length()), period.copy()
    out = np.zeros(len(at), bool)
    while (rest > 1).any():
        more = np.flatnonzero(rest > 1)
        prime = factors[rest[more]]
        shorter = period[more] // prime
        out[more] |= same(levels, at[more], at[more] + shorter, period[more] - shorter)
        rest[more] //= prime
    return out


def solve_tile(levels: list[np.ndarray], octave: int, low: int, high: int, whole_left: bool, whole_right: bool, least: int) -> np.ndarray:
    """(period, start, end) rows of a tile: intervals of matches around the boundaries from ``low`` to ``high``, both places in the tile.

    Intervals that end inside the tile are left out if too short for a run of ``least`` words, those that reach an end that
    is not the document's (``whole_left``, ``whole_right``) are fragments and stay.
    """
    first = 1 << octave
    level = max(2, octave - 1)  # the words after a boundary that are compared by one name
    gap = 2 if octave < 3 else first >> 1
    none = np.empty((0, 3), np.int64)
    if level >= len(levels):
        return none
    names_here = levels[level]
    bounds = np.arange(low + -low % gap, min(high, len(names_here) - first), gap)
    bounds = bounds[names_here[bounds] >= 0] if len(bounds) else bounds
    found = []
    step = max(1, (1 << 20) >> octave)
    for i in range(0, len(bounds), step):
        b = bounds[i : i + step]
        later = b[:, None] + first + np.arange(first)[None, :]
        named = np.where(later < len(names_here), names_here[np.minimum(later, len(names_here) - 1)], -2)
        row, column = np.nonzero(named == names_here[b][:, None])
        found.append(np.stack([b[row], column + first], 1))
    if not found or not sum(map(len, found)):
        return none
    at, period = np.concatenate(found).T
    keep = ~is_power(levels, at, period)
    at, period = at[keep], period[keep]
    start, end = at - common_suffix(levels, at, at + period), at + common_prefix(levels, at, at + period)
    n = len(levels[0])
    torn = ((start == 0) & (not whole_left)) | ((end + period == n) & (not whole_right))
    enough = end - start >= np.maximum(period, least - period)
    rows = np.stack([period, start, end], 1)[torn | enough]
    return np.unique(rows, axis=0) if len(rows) else none


def fragments(ids: np.ndarray, distinct: int, least: int, tile_words: int = TILE_WORDS) -> Iterator[np.ndarray]:
    """(period, start, end) rows of a document's tiles, octave after octave."""
    n = len(ids)
    shared: list[np.ndarray] | None = None  # a document of one tile has the same names in all octaves
    octave = 0
    while (2 << octave) <= n:
        core, margin = max(tile_words, 8 << octave), 2 << octave
        if n <= core:
            if shared is None:
                shared = names(ids, distinct)
            if max(2, octave - 1) >= len(shared):
                return
            yield solve_tile(shared, octave, 0, n, True, True, least)
        else:
            for t in range(0, n, core):
                a, b = max(0, t - margin), min(n, t + core + 2 * margin)
                rows = solve_tile(names(ids[a:b], distinct), octave, t - a, min(t + core, n) - a, a == 0, b == n, least)
                yield rows + np.array([0, a, a])
        octave += 1


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def numbered(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Each word's number, and how many different words there are."""
    known = {w: i for i, w in enumerate(set(words))}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), len(known)


def find_runs(found: DataFrame, key: str, least: int) -> DataFrame:
    """key, start, length, period of the runs from fragments (key, period, start, stop): overlapping fragments of a document and period are one interval.

    An interval that a smaller period has too is that period's run.
    """
    w = Window.partitionBy(key, "period").orderBy("start", "stop")
    upto = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("__new", F.coalesce(F.col("start") > upto, F.lit(True)).cast("int")).withColumn("__part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy(key, "period", "__part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    whole = whole.withColumn("length", length).where((F.col("length") >= least) & (F.col("length") >= 2 * F.col("period")))
    return whole.groupBy(key, "start", "length").agg(F.min("period").alias("period"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, tile_words: int = TILE_WORDS) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_words, runs (an array of start, length, period, by start, then period) and collapsed_sha256.

    A run is a stretch of at least ``least`` words and twice its smallest period q in which words q apart are identical
    and that no neighbouring word extends. collapsed_sha256 is the digest of the words joined by one space without those
    that a run holds after its first q words. A null or blank text has no word and no
    run; ids may be null or repeat, rows are taken one by one, an empty table gives no row; other columns are not read.

    Texts with fragments alone are kept for the second look that drops words. A text is one task's, as it is one value;
    names and Z-values are held for one tile at a time. ``least`` is 10 or more.
    """
    if least < 10:  # four words after one of every other boundary lie in each interval then
        raise ValueError("runs of fewer than 10 words cannot be asked for")
    kind = docs.schema[id_col].dataType.simpleString()

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts, lists = [], [], [], []
            for x in batch.column(1):
                text = x.as_py()
                words = split_words(text)
                rows = np.empty((0, 3), np.int64)
                if len(words) >= least:
                    rows = np.concatenate([rows, *fragments(*numbered(words), least, tile_words)])
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                texts.append(text if len(rows) else None)
                lists.append(rows)
            flat = np.concatenate(lists) if lists else np.empty((0, 3), np.int64)
            parts = pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(flat.T)], names=["period", "start", "stop"])
            held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()), held], names=["id", "n_words", "plain", "text", "found"]
            )

    schema = f"id {kind}, n_words long, plain string, text string, found array<struct<period: long, start: long, stop: long>>"
    seen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(tiles), schema)
    seen = save(seen.withColumn("uid", F.monotonically_increasing_id()), "run-fragments")
    runs = find_runs(seen.select("uid", F.explode("found").alias("f")).select("uid", "f.*"), "uid", least)
    runs = runs.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("__runs"))  # of one document, fewer than its words
    runs = runs.select("uid", F.transform("__runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for x, r in zip(batch.column("text"), batch.column("runs"), strict=True):
                words = split_words(x.as_py())
                change = np.zeros(len(words) + 1, np.int64)
                for run in r.as_py():
                    change[run["start"] + run["period"]] += 1
                    change[run["start"] + run["length"]] -= 1
                kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                digests.append(hashlib.sha256(b" ".join([words[i] for i in kept.tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), batch.column("runs"), pa.array(digests, pa.string())], names=["id", "n_words", "runs", "collapsed_sha256"])

    listed = "array<struct<start: long, length: long, period: long>>"
    empty = F.array().cast(listed)
    torn = seen.where("text is not null").select("uid", "id", "n_words", "text").join(runs, "uid", "left").select("id", "n_words", "text", F.coalesce("runs", empty).alias("runs"))
    changed = torn.mapInArrow(tidied(collapse), f"id {kind}, n_words long, runs {listed}, collapsed_sha256 string")
    plain = seen.where("text is null").select("id", "n_words", empty.alias("runs"), F.col("plain").alias("collapsed_sha256"))
    return plain.unionByName(changed).withColumnRenamed("id", id_col)
