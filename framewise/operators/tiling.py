"""Shots and windows: segmentation by score, tiling, cut straddles, frame-rate resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parts


def shots(scores: DataFrame, threshold: float, least: int = 1) -> DataFrame:
    """clip, shot, start, end (inclusive), n: a new shot starts where the score passes the threshold; shorter ones than ``least`` go."""
    marked = parts.running_count(scores, "clip", "idx", F.col("score") > threshold, "shot")
    out = marked.groupBy("clip", "shot").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def tile(shots: DataFrame, size: int, stride: int | None = None) -> DataFrame:
    """Windows of ``size`` frames inside each shot, ``stride`` apart (``size`` by default); what is left at the end is dropped."""
    fits = shots.where(F.col("n") >= size)
    return fits.withColumn("w_start", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - size, F.lit(stride or size).cast("long")))).withColumn("w_end", F.col("w_start") + size - 1)


def cap_windows(windows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("clip", "shot").orderBy("w_start"))
    return windows.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def without_straddles(windows: DataFrame, cuts: DataFrame, span: int = 4096) -> DataFrame:
    """Windows (clip, w_start, w_end) with no cut (clip, at) strictly inside.

    The clip and a bin of ``span`` frames are equality keys, so that a long source is split among tasks; a window is met in
    each bin it reaches.
    """
    binned = windows.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("w_start") / span), F.floor(F.col("w_end") / span))))
    at = cuts.select(F.col("clip").alias("__clip"), F.col("at").alias("__at"), F.floor(F.col("at") / span).alias("__b"))
    inside = (F.col("__clip") == F.col("clip")) & (F.col("__b") == F.col("__bin")) & (F.col("__at") > F.col("w_start")) & (F.col("__at") < F.col("w_end"))
    hit = binned.join(at, inside, "left_semi").select("clip", "w_start", "w_end").distinct()
    return windows.join(hit, ["clip", "w_start", "w_end"], "left_anti")


def inherit(windows: DataFrame, captions: DataFrame) -> DataFrame:
    return windows.join(captions, ["clip", "shot"], "left")


def usable_by_length(shots: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Shots of at least each length."""
    return shots.select(F.explode(F.array(*map(F.lit, lengths))).alias("frames"), "n").groupBy("frames").agg(F.count_if(F.col("n") >= F.col("frames")).alias("shots"))


def resample(clips: DataFrame, source_fps: int, fps: int, frames: Column, pad: int) -> DataFrame:
    """A row per output frame: out_idx, src_idx (the last source frame repeats for at most ``pad`` frames); clips too short are dropped.

    clips: clip, n (source frames).
    """
    have = F.floor((F.col("n") - 1) * fps / source_fps) + 1
    rows = clips.withColumn("__want", frames).where(have + pad >= F.col("__want"))
    rows = rows.withColumn("out_idx", F.explode(F.sequence(F.lit(0), F.col("__want") - 1)))
    return rows.withColumn("src_idx", F.least(F.floor(F.col("out_idx") * source_fps / fps), F.col("n") - 1).cast("long")).drop("__want")


def densify(pairs: DataFrame, exponent: int, duplicate: float = 0.996, cut: float = 0.2) -> DataFrame:
    """2**exponent rows per frame with its similarity to the next: class duplicate, hold (cut or last frame) or interpolate."""
    kind = F.when(F.col("similarity").isNull(), "hold").when(F.col("similarity") > duplicate, "duplicate").when(F.col("similarity") < cut, "hold").otherwise("interpolate")
    return pairs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(2**exponent - 1)))).withColumn("kind", F.when(F.col("step") == 0, "source").otherwise(kind))
