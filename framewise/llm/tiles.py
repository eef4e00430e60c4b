"""All pairs of a group in bounded pieces: a group is dealt into blocks, and each pair of blocks is a tile of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied


def over_tiles(members: DataFrame, work: Callable[[pa.Table, bool], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Runs ``work`` on every tile of every group.

    members: group and block (whole numbers), partners (the blocks of the group that a row meets, its own among them if
    it meets that) and what ``work`` reads. ``work`` gets the rows of a tile, whose column side is 0 or 1, and whether it
    is a block with itself (all rows have side 0). A task holds one tile at a time; tiles of small groups share tasks.
    """
    spark = members.sparkSession
    dealt = members.withColumn("__other", F.explode("partners")).drop("partners")
    dealt = dealt.withColumn("__i", F.least("block", "__other")).withColumn("__j", F.greatest("block", "__other"))
    dealt = dealt.withColumn("side", (F.col("block") > F.col("__i")).cast("int")).drop("__other", "block")
    keys = ["group", "__i", "__j"]
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                out = work(pa.Table.from_batches(held), last[1] == last[2])
                if out is not None and out.num_rows:
                    yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            k = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            cut = np.flatnonzero((k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])) + 1
            for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                key = tuple(int(x[a]) for x in k)
                if key != last:
                    yield from finish()
                    held, last = [], key
                held.append(batch.slice(a, b - a))
        yield from finish()

    return dealt.mapInArrow(tidied(run), schema)


def linked(left: np.ndarray, right: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
    """uid, links and root of the rows that have pairs: links counts partners' copies, root is the smallest uid reachable in the tile.

    ``left`` and ``right`` index ``ids``.
    """
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, left, copies[right])
    np.add.at(links, right, copies[left])
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root, a, b = np.arange(len(ids)), rank[left], rank[right]
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        root = root[root]
        if (root == before).all():
            break
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(links[at], pa.int64()), pa.array(ids[order][root[rank[at]]], pa.int64())], names=["uid", "links", "root"])


LINKED = "uid long, links long, root long"
