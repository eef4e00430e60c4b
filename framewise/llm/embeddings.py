"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors of one label are projected on many directions. A row collides with those inside the window around its own
projection; pairs that collide in a calibrated number of projections are verified by their exact cosine. Windows are
read from sorted projections: by the first ones, the leads, rows are dealt into cells, and each row also visits the
cells that its windows reach into; inside a cell every projection is sorted and each row's window is a slice of it.
Window widths and the count are set from simulated pairs at the threshold.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, save, save_at, scratch, tidied
from .components import components
from .tiles import LINKED, linked, over_tiles

#: Rows of a block, at most: a tile holds two. Rows a cell is meant to hold.
BLOCK_ROWS, CELL_ROWS = 8_192, 2_048
PROJECTIONS, LEADS = 24, 16
#: Half a window's width, in standard deviations of a threshold pair's projected difference.
WINDOW = 1.5
#: Part of the threshold pairs that a lead's window may lose.
LEAD_LOSS = 1e-4
#: A lead is of use when fewer of a label's rows than this have a window across its cut.
MOST_VISITING = 0.75
SIMULATED = 200_000
#: Stands for a null vec_id.
LAST = 2**63 - 1


@lru_cache(maxsize=8)
def directions(dims: int, count: int = PROJECTIONS) -> np.ndarray:
    """Orthonormal columns, the same in every process."""
    q = np.linalg.qr(np.random.default_rng(11).normal(size=(dims, dims)))[0]
    return q[:, : min(count, dims)]


@lru_cache(maxsize=8)
def calibrated(dims: int, cosine: float, count: int = PROJECTIONS) -> tuple[float, int, float]:
    """Half width of the window, the count that all simulated pairs at the threshold reach, less one, and a lead's half width."""
    distance = math.sqrt(max(2 - 2 * cosine, 0))
    half = max(WINDOW * distance / math.sqrt(dims), 1e-6)
    rng, least, m = np.random.default_rng(5), count, min(count, dims)
    wide = []
    for _ in range(10):
        d = rng.normal(size=(SIMULATED // 10, dims))
        d *= distance / np.linalg.norm(d, axis=1, keepdims=True)
        least = min(least, int((np.abs(d[:, :m]) <= half).sum(1).min()))
        wide.append(np.abs(d[:, :m]).ravel())
    return half, max(least - 1, 0), float(np.quantile(np.concatenate(wide), 1 - LEAD_LOSS)) + 1e-6


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """For each row of a and of b: in how many projections b's lies in the window around a's. Each projection of b is sorted, windows are slices."""
    out = np.zeros(len(a) * len(b), np.uint8)
    for x, y in zip(a.T, b.T, strict=True):
        order = np.argsort(y, kind="stable")
        low, high = np.searchsorted(y[order], x - half, "left"), np.searchsorted(y[order], x + half, "right")
        length = high - low
        hits = length.cumsum()
        if len(hits) and hits[-1]:
            at = np.arange(hits[-1]) - np.repeat(hits - length - low, length)  # places in sorted order, window after window
            out[np.repeat(np.arange(len(a)) * len(b), length) + order[at]] += 1
    return out.reshape(len(a), len(b))


def link_tile(tile: pa.Table, itself: bool, cosine: float) -> pa.RecordBatch | None:
    ids = tile["uid"].to_numpy()
    copies, side = tile["copies"].to_numpy(), tile["side"].to_numpy()
    v = np.frombuffer(b"".join(tile["unit"].to_pylist()), np.float64).reshape(len(ids), -1)
    a = np.flatnonzero(side == 0)
    b = a if itself else np.flatnonzero(side == 1)
    if not len(a) or not len(b):
        return None
    half, least, _ = calibrated(v.shape[1], cosine)
    p = v @ directions(v.shape[1])
    lefts, rights = [], []
    step = max(1, (4 << 20) // len(b))  # bounded counts
    for k in range(0, len(a), step):
        rows = a[k : k + step]
        left, right = np.nonzero(collisions(p[rows], p[b], half + 1e-9) >= least)
        left, right = rows[left], b[right]
        if itself:
            left, right = left[left < right], right[left < right]
        near = np.concatenate([np.einsum("ij,ij->i", v[left[i : i + 65_536]], v[right[i : i + 65_536]]) for i in range(0, len(left), 65_536)]) if len(left) else np.empty(0)
        lefts.append(left[near >= cosine])
        rights.append(right[near >= cosine])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    return linked(left, right, ids, copies) if len(left) else None


def dealt_to_cells(reps: DataFrame, cosine: float) -> DataFrame:
    """Rows by cell: group (a cell of a label), block, partners (the blocks it meets), uid, copies and unit.

    A lead cuts a label's rows at their median; the leads used are those that most rows lie clear of, one for each
    halving down to CELL_ROWS. A row is at home in one cell and visits those of smaller number that its windows reach
    into. Homes meet homes and visitors; cells of more rows than a block are dealt into blocks by hash.
    """
    leads, total = range(LEADS), reps.count()
    middle = [F.percentile_approx(F.get("leads", F.lit(i)), 0.5, 1_000).alias(f"c{i}") for i in leads]
    cuts = reps.groupBy("group").agg(F.count("*").alias("n"), *middle)
    cuts = save(cuts.select("group", "n", F.array(*[f"c{i}" for i in leads]).alias("cuts")), "vector-cuts")
    gap = [F.abs(F.get("leads", F.lit(i)) - F.get("cuts", F.lit(i))) for i in leads]
    near = [F.avg((gap[i] <= F.col("reach")).cast("double")).alias(f"s{i}") for i in leads]
    shares = join_keyed(reps.select("group", "leads", "reach"), cuts, ["group"], total).groupBy("group").agg(*near)
    found = F.filter(F.array(*[F.struct(F.col(f"s{i}").alias("share"), F.lit(i).alias("lead"), F.get("cuts", F.lit(i)).alias("cut")) for i in leads]), lambda x: x["share"] < MOST_VISITING)
    wanted = F.greatest(F.ceil(F.log2(F.col("n") / CELL_ROWS)), F.lit(0)).cast("int")
    chosen = save(shares.join(cuts, "group").select("group", "n", F.slice(F.array_sort(found), 1, wanted).alias("chosen")), "vector-leads")
    rows = join_keyed(reps.select("group", "uid", "copies", "unit", "leads", "reach"), chosen, ["group"], total)
    off = F.transform("chosen", lambda c: F.get(F.col("leads"), c["lead"]) - c["cut"])
    home = F.aggregate(off, F.lit(0).cast("long"), lambda s, x: s * 2 + (x > 0).cast("long"))
    both = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    sides = lambda x: F.when(F.abs(x) <= F.col("reach"), both).otherwise(F.array((x > 0).cast("long")))
    reached = F.aggregate(off, F.array(F.lit(0).cast("long")), lambda s, x: F.flatten(F.transform(s, lambda c: F.transform(sides(x), lambda d: c * 2 + d))))
    rows = rows.withColumn("home", home).withColumn("cell", F.explode(F.filter(reached, lambda c: c <= F.col("home"))))
    rows = rows.select(F.xxhash64("group", "cell").alias("group"), (F.col("cell") < F.col("home")).alias("visits"), "uid", "copies", "unit")
    sizes = rows.groupBy("group").agg(F.count_if(~F.col("visits")).alias("h"), F.count_if("visits").alias("v")).where("h > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    sizes = save(sizes.select("group", blocks("h").alias("homes"), blocks("v").alias("visitors"), (F.col("h") + F.col("v")).alias("n")), "vector-cells")
    rows = join_keyed(rows, sizes, ["group"], total)
    part = lambda n: F.pmod(F.xxhash64("uid"), F.greatest(n, F.lit(1))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("visits"), F.col("homes") + part(F.col("visitors"))).otherwise(part(F.col("homes"))))
    high = F.when(F.col("visits"), F.col("homes") - 1).otherwise(F.col("homes") + F.col("visitors") - 1)
    return rows.select("group", "block", F.sequence(F.lit(0), high).alias("partners"), "uid", "copies", "unit")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept per row of ``vectors`` (vec_id, embedding, label).

    Rows are compared when their labels are equal and not null and their vectors have one length; null and zero vectors
    and those with null or non-finite components link with nothing. Equal vectors of a label are one class that is
    compared once and counts with its copies; repeated rows are copies. component_id is the smallest vec_id reachable;
    null vec_ids count as the largest. Extra columns are not read.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", e.alias("embedding"), valid.alias("valid"))
    rows = rows.withColumn("k1", F.when(F.col("valid"), F.xxhash64("label", "embedding"))).withColumn("k2", F.when(F.col("valid"), F.hash("embedding", "label")))
    reps = rows.where("valid").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))

    def unit(batches):
        for batch in batches:
            units, leads, reach = [], [], []
            for x in batch.column(0):
                u = np.array(x.as_py(), np.float64)
                u = u / np.abs(u).max()
                u /= np.linalg.norm(u)
                units.append(u.tobytes())
                leads.append((u @ directions(len(u))[:, :LEADS]).tolist())
                reach.append(calibrated(len(u), cosine)[2])
            new = [pa.array(units, pa.binary()), pa.array(leads, pa.list_(pa.float64())), pa.array(reach, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*names, "unit", "leads", "reach"])

    names = ["uid", "group", "rep", "copies", "k1", "k2"]
    group = F.xxhash64("label", F.size("embedding")).alias("group")
    reps = reps.select("embedding", F.monotonically_increasing_id().alias("uid"), group, F.col("rep").cast("long").alias("rep"), "copies", "k1", "k2")
    reps = save(reps.mapInArrow(tidied(unit), "uid long, group long, rep long, copies long, k1 long, k2 int, unit binary, leads array<double>, reach double"), "vectors")
    with scratch(vectors.sparkSession) as keep:
        tiles, path = save_at(over_tiles(dealt_to_cells(reps, cosine), lambda t, itself: link_tile(t, itself, cosine), LINKED), "vector-links")
        keep(path)
    links = tiles.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(tiles.select("uid", "root"))
    named = roots.join(reps.select(F.col("uid").alias("node"), F.coalesce("rep", F.lit(LAST)).alias("rep")), "node")
    named = save(named, "vector-components")
    least = save(named.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("n")), "vector-roots")
    named = join_keyed(named, least, ["root"], named.count()).select(F.col("node").alias("uid"), "component")
    found = reps.select("uid", "k1", "k2", "rep", "copies").join(links, "uid", "left").join(named, "uid", "left")
    found = found.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.col("copies").alias("n"))
    plain = rows.where("not valid").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))  # link with nothing
    own = join_keyed(rows.where("valid").select("vec_id", "k1", "k2"), save(found, "vector-classes"), ["k1", "k2"], rows.where("valid").count())
    out = own.select("vec_id", "n_links", "component_id").unionByName(plain)
    component = F.when(F.col("component_id") == LAST, None).otherwise(F.coalesce("component_id", F.col("vec_id").cast("long")))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull() & F.col("component_id").isNull()))
