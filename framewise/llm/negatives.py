"""Hard negatives by exact integer products, several candidates to a multiplication.

Components of several candidates are biased to be non-negative and packed into separated fields of one wide integer; an
anchor's component multiplies that integer once, and the fields of the summed products are the candidates' exact scores.
The wide integers are held in doubles, whose 53 bits are exact, so a packed product of matrices is one BLAS call.

Anchors are a stated query set: they are dealt into blocks, all rows into blocks too, and each pair of blocks is a tile.
The first pass over tiles of one label finds each anchor's positives, the second over all tiles the rows of other labels
in the window under each positive. Tiles give the best few of each anchor alone, which windows merge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_keyed, save, tidied

#: Anchors of a tile, at most about: their block is held while a tile's other rows pass by. Rows of a tile, at most about.
ANCHOR_ROWS, TILE_ROWS = 4_096, 1 << 20
#: Rows that make a tile of their own worth while.
LEAST_ROWS = 4_096
#: Bits of a wide integer: those a double holds exactly.
WIDE = 53
#: Scores of one step, at most: bounds a step's memory.
STEP = 1 << 21
#: A row's integer components have a squared length below this, so that hundredfold scores fit 64 bits.
MOST_SQUARE = 2.0**55


@dataclass(frozen=True)
class Packing:
    """How products of some anchors with candidates of components from ``low`` to ``high`` are packed."""

    low: int
    limbs: int  # parts of a component that one field cannot hold
    bits: int  # of a limb
    width: int  # of a field
    fields: int  # of a wide integer
    offset: int  # makes fields non-negative


def plan_packing(longest: int, low: int, high: int) -> Packing:
    """``longest``: the largest sum of an anchor's absolute components."""
    bits = max(int(high - low).bit_length(), 1)
    held = bits
    while held > 1 and 2 * longest * ((1 << held) - 1) + 1 >= 1 << WIDE:
        held -= 1
    offset = longest * ((1 << held) - 1)
    width = max((2 * offset).bit_length(), 1)
    if width > WIDE:
        raise ValueError("components are too large for exact products")
    return Packing(low, -(-bits // held), held, width, WIDE // width, offset)


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows) of whole numbers, in 64 bits."""
    if not len(anchors) or not len(rows) or not rows.shape[1]:
        return np.zeros((len(anchors), len(rows)), np.int64)
    p = plan_packing(int(np.abs(anchors).sum(1).max()), int(rows.min()), int(rows.max()))
    biased = rows - p.low
    parts = np.concatenate([(biased >> (p.bits * i)) & ((1 << p.bits) - 1) for i in range(p.limbs)]) if p.limbs > 1 else biased
    n = len(parts)
    parts = np.concatenate([parts, np.zeros((-n % p.fields, parts.shape[1]), np.int64)]).reshape(p.fields, -1, parts.shape[1])
    shifts = np.arange(p.fields, dtype=np.int64) * p.width
    wide = (parts << shifts[:, None, None]).sum(0)
    product = anchors.astype(np.float64) @ wide.T.astype(np.float64)  # one multiplication an anchor component for all fields
    product = product.astype(np.int64) + int(sum(p.offset << int(s) for s in shifts))
    mask = (1 << p.width) - 1
    fields = np.concatenate([(product >> s) & mask for s in shifts], axis=1)[:, :n] - p.offset
    out = fields[:, : len(rows)]
    for i in range(1, p.limbs):
        out = out + (fields[:, i * len(rows) : (i + 1) * len(rows)] << (p.bits * i))
    return out + p.low * anchors.sum(1)[:, None]


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` rows of each group, by score, the highest first, then by id; repeats of both count once."""
    order = np.lexsort((ids, -score, group))
    g, s, i = group[order], score[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    order, g = order[new], g[new]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < k]


class Leaders:
    """The best ``k`` rows seen so far of each of ``n`` groups."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.group = self.score = self.ids = np.empty(0, np.int64)
        self.least = np.full(n, np.iinfo(np.int64).min)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        at = best_of(group, score, ids, self.k)
        self.group, self.score, self.ids = group[at], score[at], ids[at]
        full = np.flatnonzero(np.bincount(self.group, minlength=len(self.least)) == self.k)
        last = np.searchsorted(self.group, full, "right") - 1
        self.least[full] = self.score[last]  # no later row below it is of use


def vectors_of(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    raw = batch.column(name)
    parts = [x.as_py() for x in raw] if isinstance(raw, pa.Array) else raw.to_pylist()
    return np.frombuffer(b"".join(parts), np.int64).reshape(len(parts), -1)


def positives_of(anchors: pa.Table, k: int) -> tuple[Callable[[pa.RecordBatch], None], Callable[[], pa.RecordBatch]]:
    """Rows of the anchors' label, passing by, into the best ``k`` of each anchor."""
    a, own = vectors_of(anchors, "v"), anchors["id"].to_numpy()
    best = Leaders(len(a), k)

    def see(batch: pa.RecordBatch) -> None:
        rows, ids = vectors_of(batch, "v"), batch.column("id").to_numpy()
        step = max(1, STEP // len(a))
        for i in range(0, len(rows), step):
            score, part = packed_scores(a, rows[i : i + step]), ids[i : i + step]
            other = own[:, None] != part[None, :]
            bound = best.least
            if len(part) > k:  # the kth best of a step bounds what can be among the best, but for repeats of one id
                seen = np.where(other, score, np.iinfo(np.int64).min)
                if len(np.unique(part)) == len(part):
                    bound = np.maximum(bound, np.partition(seen, len(part) - k, axis=1)[:, len(part) - k])
            left, right = np.nonzero(other & (score >= bound[:, None]))
            best.add(left, score[left, right], part[right])

    uid = anchors["uid"].to_numpy()
    return see, lambda: pa.RecordBatch.from_arrays([pa.array(uid[best.group]), pa.array(best.ids), pa.array(best.score)], names=["anchor", "id", "score"])


def negatives_of(anchors: pa.Table, k: int, low: int, high: int) -> tuple[Callable[[pa.RecordBatch], None], Callable[[], pa.RecordBatch]]:
    """Rows of other labels, passing by, into the best ``k`` of each anchor and positive that lie in the window under it."""
    a, label = vectors_of(anchors, "v"), anchors["label"].to_numpy()
    held = anchors["positives"].combine_chunks()
    of = np.repeat(np.arange(len(a)), np.diff(held.offsets.to_numpy()))
    score_of = held.flatten().to_numpy()
    least, most = -((-low * score_of) // 100), (high * score_of) // 100  # whole scores s with low * p <= 100 * s <= high * p
    best = Leaders(len(of), k)
    top = np.full(len(a), np.iinfo(np.int64).min)
    np.maximum.at(top, of, most)
    start = np.searchsorted(of, np.arange(len(a)))
    count = np.bincount(of, minlength=len(a))

    def see(batch: pa.RecordBatch) -> None:
        rows, ids, labels = vectors_of(batch, "v"), batch.column("id").to_numpy(), batch.column("label").to_numpy()
        step = max(1, STEP // len(a))
        for i in range(0, len(rows), step):
            score, part, named = packed_scores(a, rows[i : i + step]), ids[i : i + step], labels[i : i + step]
            bound = np.full(len(a), np.iinfo(np.int64).max)
            np.minimum.at(bound, of, np.maximum(least, best.least))
            left, right = np.nonzero((score >= bound[:, None]) & (score <= top[:, None]))
            apart = label[left] != named[right]
            left, right = left[apart], right[apart]
            times = count[left]
            found = np.repeat(start[left] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))  # the anchor's positives, one after another
            right = np.repeat(right, times)
            s = score[np.repeat(left, times), right]
            fits = (s >= np.maximum(least, best.least)[found]) & (s <= most[found])
            best.add(found[fits], s[fits], part[right[fits]])

    uid = anchors["uid"].to_numpy()[of] if len(of) else np.empty(0, np.int64)
    place = np.arange(len(of)) - start[of] if len(of) else np.empty(0, np.int64)
    return see, lambda: pa.RecordBatch.from_arrays(
        [pa.array(uid[best.group]), pa.array(place[best.group]), pa.array(best.ids), pa.array(best.score)], names=["anchor", "place", "id", "score"]
    )


def over_anchor_tiles(anchors: DataFrame, rows: DataFrame, start: Callable[[pa.Table], tuple], schema: str) -> DataFrame:
    """Runs ``start`` over every tile: a block of a group's anchors with a block of the group's rows.

    Both sides have group and the columns that ``start`` reads. A group's anchors are dealt into blocks of about
    ANCHOR_ROWS, its rows into as many blocks as give the cluster two tiles a shuffle partition, of LEAST_ROWS to
    TILE_ROWS each. A task holds one block of anchors; rows pass by in Arrow batches.
    """
    spark = anchors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = anchors.groupBy("group").agg(F.count("*").alias("anchors"))
    total = rows.groupBy("group").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("anchors") / ANCHOR_ROWS)
    wanted = F.least(F.ceil(2 * parts / blocks), F.ceil(F.col("n") / LEAST_ROWS))
    sizes = sizes.join(total, "group").select("group", "anchors", "n", blocks.cast("int").alias("ab"), F.greatest(wanted, F.ceil(F.col("n") / TILE_ROWS)).cast("int").alias("rb"))
    sizes = save(sizes, "anchor-blocks")
    n = sizes.agg(F.sum("n"), F.sum("anchors")).first()
    part = lambda c: F.pmod(F.xxhash64("uid"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    few = lambda c: sizes.select("group", "ab", "rb", F.col(c).alias("n"))
    columns = [c for c in anchors.columns if c != "group"]
    left = join_keyed(anchors, few("anchors"), ["group"], n[1] or 0).withColumn("i", part("ab")).withColumn("j", every("rb")).withColumn("side", F.lit(0))
    right = join_keyed(rows, few("n"), ["group"], n[0] or 0).withColumn("j", part("rb")).withColumn("i", every("ab")).withColumn("side", F.lit(1))
    both = left.select("group", "i", "j", "side", *columns).unionByName(right.select("group", "i", "j", "side", *[c for c in rows.columns if c != "group"]), allowMissingColumns=True)
    keys = ["group", "i", "j"]
    dealt = both.repartition(parts, *keys).sortWithinPartitions(*keys, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = see = done = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = [batch.column(c).to_numpy() for c in (*keys, "side")]
            cut = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                key, side = tuple(int(x[a]) for x in k[:3]), int(k[3][a])
                if key != last:
                    if done:
                        yield done()
                    held, last, see, done = [], key, None, None
                if side == 0:
                    held.append(batch.slice(a, b - a))
                elif held:
                    if see is None:
                        see, done = start(pa.Table.from_batches(held))
                        held = [held[0].slice(0, 1)]
                    see(batch.slice(a, b - a))
        if done:
            yield done()

    return dealt.mapInArrow(tidied(run), schema)


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each key by score and id, with rank from 1; repeats of both count once."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    same = F.lag(F.struct("score", "id")).over(w).eqNullSafe(F.struct("score", "id"))  # a repeated row, from another tile
    return found.withColumn("rank", F.dense_rank().over(w)).withColumn("__same", same).where(F.col("rank") <= k).where(~F.col("__same")).drop("__same")


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score, for rows of ``vectors`` (vec_id, embedding, label).

    A component x becomes floor(scale * x); a score is the integer inner product with the anchor, higher first, ties by
    smaller id. An anchor's positives are its first ``positives`` other rows of its label; for each of them the first
    ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive (percent) come back, none
    for positives below 0.

    Rows with a null id, a null label, a null vector or a null or non-finite component take no part. Labels are whole
    numbers. Rows meet rows of their vector's length only. A positive has another id than its anchor; rows of one id and one score
    count once, so repeated rows change nothing; of an anchor id with several vectors or labels, each gives rows. Whole
    components of a squared length of 2^55 or more raise, as their scores would not fit. Extra columns are not read.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    chosen = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), e.alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    chosen = chosen.where(F.col("id").isNotNull() & F.col("label").isNotNull() & e.isNotNull()).where(finite)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("embedding")
            held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
            size = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(scale * held.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ends = np.cumsum(size)
            square = np.r_[0.0, np.cumsum(flat * flat)]
            if len(flat) and (not np.isfinite(square[-1]) or np.abs(flat).max() >= MOST_SQUARE**0.5 or (square[ends] - square[ends - size]).max() >= MOST_SQUARE):
                raise ValueError("integer components are too large for 64-bit scores")
            raw = flat.astype(np.int64).tobytes()
            v = [raw[8 * (b - n) : 8 * b] for b, n in zip(ends.tolist(), size.tolist(), strict=True)]
            columns = [batch.column("id"), batch.column("label"), batch.column("is_anchor"), pa.array(size), pa.array(v, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "is_anchor", "dims", "v"])

    rows = chosen.mapInArrow(tidied(whole), "id long, label long, is_anchor boolean, dims long, v binary")
    rows = save(rows.withColumn("uid", F.monotonically_increasing_id()), "anchor-rows")
    kind = F.xxhash64("dims", "label")
    anchors = rows.where("is_anchor").groupBy("id", "label", "dims", "v").agg(F.min("uid").alias("uid"))
    anchors = save(anchors, "anchors")
    same = over_anchor_tiles(
        anchors.select(kind.alias("group"), "uid", "id", "v"), rows.select(kind.alias("group"), "uid", "id", "v"), lambda t: positives_of(t, positives), "anchor long, id long, score long"
    )
    best = save(first_of(same, ["anchor"], positives), "positives")
    held = best.where("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))  # at most ``positives``
    held = anchors.join(held.withColumnRenamed("anchor", "uid"), "uid").select(F.col("dims").alias("group"), "uid", "label", F.transform("found", lambda x: x["score"]).alias("positives"), "v")
    apart = over_anchor_tiles(
        held, rows.select(F.col("dims").alias("group"), "uid", "id", "label", "v"), lambda t: negatives_of(t, negatives, low, high), "anchor long, place long, id long, score long"
    )
    apart = first_of(apart, ["anchor", "place"], negatives).select("anchor", (F.col("place") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    named = named.select("anchor", "anchor_id", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return apart.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
