"""Frame-sequence metrics: native ones over pixel arrays, structural ones in Arrow batches of frame pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import parts


def fold(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Mean of f over two equally long arrays."""
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mean_abs_diff(a: Column, b: Column) -> Column:
    return fold(a, b, lambda x, y: F.abs(x - y))


def psnr(a: Column, b: Column) -> Column:
    mse = fold(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(mse < 1e-9, 99.0).otherwise(10 * F.log10(F.lit(65025.0) / mse))


def psnr_exact(a: Column, b: Column) -> Column:
    """The variant of stricter equality: 99 below a mean squared error of 1e-8, by 20 log10 of the range over its root."""
    mse = fold(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(mse < 1e-8, 99.0).otherwise(20 * F.log10(F.lit(255.0) / F.sqrt(mse)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255


def with_previous(frames: DataFrame) -> DataFrame:
    """Each frame with the one before it in its clip, as column previous; null for the first."""
    return parts.previous(frames, "clip_id", "frame_idx", "pixels", "previous")


def with_first(frames: DataFrame, column: str = "pixels") -> DataFrame:
    """Each frame with its clip's first one, as column first; frame 0 is compared with itself.

    Frames are joined to frame 0 by clip, so no clip is sorted; a clip without frame 0 has none.
    """
    start = frames.where("frame_idx = 0").select("clip_id", F.col(column).alias("first"))
    return frames.join(start, "clip_id", "left")


def correlation(a: Column, b: Column) -> Column:
    """Correlation of two equally long arrays, such as histograms; 1 where one of them is even, as histogram comparisons count it."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ma, mb = total(a) / n, total(b) / n
    cov = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va, vb = total(F.transform(a, lambda x: (x - ma) * (x - ma))), total(F.transform(b, lambda y: (y - mb) * (y - mb)))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(va * vb > 0, cov / F.sqrt(va * vb)).otherwise(1.0))


def histogram(values: Column, bins: int, low: float, high: float) -> Column:
    """Counts of an array's values in ``bins`` even bins from ``low`` to ``high``; values outside count in the outer ones."""
    cell = F.transform(values, lambda x: F.least(F.greatest(F.floor((x - low) * bins / (high - low)), F.lit(0)), F.lit(bins - 1)).cast("int"))
    ones = F.array_sort(F.concat(cell, F.sequence(F.lit(0), F.lit(bins - 1))))  # each bin once more, so that none is missing
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (F.size(F.filter(ones, lambda x: x == i)) - 1).cast("double"))


def first_frame_drift(metrics: DataFrame) -> DataFrame:
    """By clip: frames, mean of adjacent histogram correlations, correlation of the first and last frame with frame 0, and their difference, the palette drift.

    metrics: clip_id, frame_idx, adjacent (with the frame before; null for the first) and versus_first, both cut to 4
    places before, as summaries are made from printed values.
    """
    adjacent, versus = F.round("adjacent", 4), F.round("versus_first", 4)
    out = metrics.groupBy("clip_id").agg(
        F.count("*").alias("frames"), F.avg(adjacent).alias("adjacent_mean"), F.min_by(versus, "frame_idx").alias("first"), F.max_by(versus, "frame_idx").alias("last")
    )
    return out.withColumn("palette_drift", F.round(F.col("first") - F.col("last"), 4))


def reconstruction(source: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Frames of both tables by clip and frame, up to the shorter: columns a and b; frames of one alone go."""
    return source.select("clip_id", "frame_idx", F.col("pixels").alias("a")).join(rebuilt.select("clip_id", "frame_idx", F.col("pixels").alias("b")), ["clip_id", "frame_idx"])


def quality_by_clip(scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and least of each column by clip, and frames."""
    parts = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("least", F.min))]
    return scored.groupBy("clip_id").agg(*parts, F.count("*").alias("frames"))


def summary(metrics: DataFrame) -> DataFrame:
    """Mean, least and population deviation of adjacent similarity (to 4 places before), of clips of two frames or more."""
    s = F.round("similarity", 4)
    metrics = metrics.where("similarity is not null")
    means = parts.means_in_order(metrics, "clip_id", "frame_idx", {"mean": s}).withColumnRenamed("clip_id", "__clip")
    stats = metrics.groupBy("clip_id").agg(F.min(s).alias("least"), F.stddev_pop(s).alias("deviation"), F.count("*").alias("pairs"))
    return stats.join(means, F.col("clip_id").eqNullSafe(F.col("__clip"))).select("clip_id", "mean", "least", "deviation", "pairs")


def flicker(metrics: DataFrame, k: float = 2.0) -> DataFrame:
    """Pairs whose similarity is below the clip's mean by more than k deviations."""
    s = F.round("similarity", 4)
    stats = metrics.groupBy(F.col("clip_id").alias("__clip")).agg(F.avg(s).alias("__mean"), F.stddev_pop(s).alias("__dev"))
    bound = F.col("__mean") - k * F.when(F.col("__dev") == 0, 1e-9).otherwise(F.col("__dev"))
    joined = metrics.join(stats, F.col("clip_id").eqNullSafe(F.col("__clip")))
    return joined.withColumn("bound", bound).where(s < F.col("bound")).drop("__clip", "__mean", "__dev")


def worst_pair(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("clip_id").agg(F.min_by("frame_idx", F.struct("similarity", "frame_idx")).alias("frame_idx"), F.min("similarity").alias("similarity"))


def drift(metrics: DataFrame, part: float = 0.15) -> DataFrame:
    """Absolute difference of the means over the first and last ``part`` of a clip's frames."""
    r = parts.ranked(metrics, "clip_id", "frame_idx").withColumn("__edge", F.greatest(F.floor(F.col("__n") * part), F.lit(1)))
    ends = {"__head": F.when(F.col("__rn") <= F.col("__edge"), F.col("similarity")), "__tail": F.when(F.col("__rn") > F.col("__n") - F.col("__edge"), F.col("similarity"))}
    return parts.means_in_order(r, "clip_id", "frame_idx", ends).select("clip_id", F.abs(F.col("__head") - F.col("__tail")).alias("drift"))


def smoothness(motion: DataFrame, still: float) -> DataFrame:
    """Jerk (mean absolute second difference of the motion) and the share of held frames (motion below ``still``)."""
    rows = parts.previous_two(motion, "clip_id", "frame_idx", "motion", ("__one", "__two"))
    second = F.col("motion") - 2 * F.col("__one") + F.col("__two")
    return parts.means_in_order(rows, "clip_id", "frame_idx", {"jerk": F.abs(second), "held": (F.col("motion") < still).cast("double")})


def gaussian(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - size // 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    return g / g.sum()


def blur(images: np.ndarray) -> np.ndarray:
    """Gaussian blur of a stack of images, borders mirrored without repeating the edge."""
    g = gaussian()
    r = len(g) // 2
    for axis in (1, 2):
        n = images.shape[axis]
        at = np.abs((np.arange(-r, n + r) + (n - 1)) % max(2 * (n - 1), 1) - (n - 1)) if n > 1 else np.zeros(2 * r + n, int)
        padded = np.take(images, at, axis=axis)
        images = sum(w * np.take(padded, np.arange(k, k + n), axis=axis) for k, w in enumerate(g))
    return images


def ssim_stack(a: np.ndarray, b: np.ndarray, data_range: float | np.ndarray = 255.0) -> np.ndarray:
    """Structural similarity of each pair of images of two stacks; ``data_range`` is one for all or one for each pair."""
    span = np.asarray(data_range, float).reshape(-1, 1, 1)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    return (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean(axis=(1, 2))


def sobel(images: np.ndarray) -> np.ndarray:
    p = np.pad(images, ((0, 0), (1, 1), (1, 1)), mode="reflect" if min(images.shape[1:]) > 1 else "edge")
    gx = (p[:, :-2, 2:] + 2 * p[:, 1:-1, 2:] + p[:, 2:, 2:]) - (p[:, :-2, :-2] + 2 * p[:, 1:-1, :-2] + p[:, 2:, :-2])
    gy = (p[:, 2:, :-2] + 2 * p[:, 2:, 1:-1] + p[:, 2:, 2:]) - (p[:, :-2, :-2] + 2 * p[:, :-2, 1:-1] + p[:, :-2, 2:])
    return np.hypot(gx, gy)


#: Pairs scored at a time, and bytes of an Arrow batch, at most: a worker's memory does not grow with its input.
PAIRS, BATCH_BYTES = 128, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as pairs of images make rows large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of PAIRS rows at most; empty ones go."""
    for pdf in batches:
        for at in range(0, len(pdf), PAIRS):
            yield pdf.iloc[at : at + PAIRS]


def structural(pairs: DataFrame, height: int, width: int) -> DataFrame:
    """Adds ssim, edge_ssim and flat_mae (null without flat pixels) to pairs with columns a and b, pixel arrays of one size.

    Pairs are scored on their own, so no clip has to fit a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in in_slices(batches):
            a, b = (np.stack(pdf[c].to_numpy()).astype(float).reshape(-1, height, width) for c in "ab")
            ea, eb = sobel(a), sobel(b)
            top = ea.max(axis=(1, 2))
            flat = ea < (0.06 * top + 1e-6)[:, None, None]
            count = flat.sum(axis=(1, 2))
            mae = np.where(count > 0, (np.abs(a - b) * flat).sum(axis=(1, 2)) / np.maximum(count, 1), np.nan)
            edge = ssim_stack(ea, eb, np.maximum(top, 1e-6))
            flat_mae = pd.Series(mae, index=pdf.index).astype(object).where(count > 0, None)
            yield pdf.drop(columns=["a", "b"]).assign(ssim=ssim_stack(a, b), edge_ssim=edge, flat_mae=flat_mae)

    bound_batches(pairs.sparkSession)
    schema = pairs.drop("a", "b").schema.add("ssim", "double").add("edge_ssim", "double").add("flat_mae", "double")
    return pairs.mapInPandas(run, schema)


def end_frames(frames: DataFrame) -> DataFrame:
    """The first and last frame of each clip as columns a and b; a clip of one frame has it twice."""
    pick = lambda f: f(F.col("pixels"), F.col("frame_idx"))
    return frames.groupBy("clip_id").agg(pick(F.min_by).alias("a"), pick(F.max_by).alias("b"))


def loop_closure(frames: DataFrame, height: int, width: int, least: float = 0.92) -> DataFrame:
    """clip_id, ssim of its first and last frame, and whether that closes the loop."""
    return loop_closed(structural(end_frames(frames), height, width).select("clip_id", "ssim"), least)


def loop_closed(ends: DataFrame, least: float = 0.92) -> DataFrame:
    """Whether the similarity of first and last frame (column ssim) closes the loop."""
    return ends.withColumn("closed", F.col("ssim") >= least)


def macro_mean(metrics: DataFrame, column: str) -> DataFrame:
    """Mean of clip means, NaN left out, each clip once."""
    value = F.when(~F.isnan(column), F.col(column))
    return metrics.groupBy("clip_id").agg(F.avg(value).alias("m")).agg(F.avg("m").alias("macro"), F.count("m").alias("clips"))


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``group`` and median: the exact middle of ``value`` by group, the mean of the two in the middle; nulls and NaN are left out.

    Bounds just below and above the middle come from a sketch with a rank error a tenth of their distance. Values below
    them are counted, and of those between them equal ones are counted together; the middle is selected among these, a
    five-hundredth of a group, so no task holds a group's values.
    """
    rows = rows.select(group, F.col(value).cast("double").alias("__v")).where(F.col(group).isNotNull() & F.col("__v").isNotNull() & ~F.isnan("__v"))
    bounds = rows.groupBy(group).agg(F.percentile_approx("__v", F.array(F.lit(0.499), F.lit(0.501)), 10_000).alias("__b"), F.count("*").alias("n"), F.count("*").alias("__n"))
    found = parts.join_counted(rows, bounds, [group])
    low, high = F.get("__b", F.lit(0)), F.get("__b", F.lit(1))
    counted = found.where(F.col("__v") <= high).withColumn("__v", F.when(F.col("__v") >= low, F.col("__v")))  # all values below as one, null
    counted = counted.groupBy(group, "__n", "__v").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(group).orderBy(F.asc_nulls_first("__v"))
    upto = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("__upto", upto).where(F.col("__v").isNotNull())
    at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__v")))
    return placed.groupBy(group).agg(at(F.floor((F.col("__n") - 1) / 2)).alias("__x"), at(F.floor(F.col("__n") / 2)).alias("__y")).select(group, ((F.col("__x") + F.col("__y")) / 2).alias("median"))


def seam_ratio(motion: DataFrame, seams: DataFrame) -> DataFrame:
    """Absolute motion at each seam (clip_id, frame_idx) over the clip's median absolute motion; null where that is 0."""
    middle = medians(motion.select("clip_id", F.abs("motion").alias("motion")), "clip_id", "motion")
    at = seams.select("clip_id", "frame_idx").join(motion, ["clip_id", "frame_idx"]).join(middle, "clip_id")
    return at.select("clip_id", "frame_idx", F.when(F.col("median") > 0, F.abs("motion") / F.col("median")).alias("ratio"))


def hue_saturation(rgb: np.ndarray) -> np.ndarray:
    """Histograms of 50 hues by 60 saturations of images (n, pixels, 3) of bytes, hue in half degrees, in 12-bit fixed point as 8-bit image libraries count it."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    v = np.maximum(np.maximum(r, g), b)
    d = v - np.minimum(np.minimum(r, g), b)
    per_v, per_d = np.rint(255 * 4096 / np.maximum(v, 1)).astype(np.int64), np.rint(30 * 4096 / np.maximum(d, 1)).astype(np.int64)
    s = (d * per_v + 2048) >> 12
    turn = np.where(v == r, g - b, np.where(v == g, b - r + 2 * d, r - g + 4 * d))
    h = (turn * per_d + 2048) >> 12
    h = np.minimum(h + 180 * (h < 0), 179)
    cell = (h * 50 // 180) * 60 + s * 60 // 256 + 3000 * np.arange(len(rgb))[:, None]
    return np.bincount(cell.ravel(), minlength=3000 * len(rgb)).reshape(len(rgb), 3000).astype(float)


def histogram_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of the hue and saturation histograms of two stacks of images (n, pixels, 3); 1 where one of them is even."""
    x, y = (h - h.mean(axis=1, keepdims=True) for h in (hue_saturation(a), hue_saturation(b)))
    below = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return np.where(below > 0, (x * y).sum(1) / np.where(below > 0, below, 1), 1.0)


@lru_cache(maxsize=32)
def smoothing(n: int, size: int) -> np.ndarray:
    """The Gaussian window over n values, edges repeated 5 times, as a matrix."""
    out = np.zeros((n + 11 - size, n))
    for row in range(len(out)):
        np.add.at(out[row], np.clip(row - 5 + np.arange(size), 0, n - 1), gaussian(size))
    return out


def similarity_terms(a: np.ndarray, b: np.ndarray, axes: tuple[int, ...]) -> tuple[float, float]:
    """Mean structural similarity and contrast term of two arrays under a Gaussian window of at most 11 along ``axes``, edges repeated 5 times.

    The range is 255 if a value of ``a`` is above 128, else 1, and one more if one is below -0.5.
    """
    size = min(11, *a.shape[-2:])
    smooth = np.stack([a, b, a * b, a * a, b * b])
    for axis in axes:
        smooth = np.moveaxis(np.tensordot(smoothing(a.shape[axis], size), smooth, (1, axis + 1)), 0, axis + 1)
    span = (255 if a.max() > 128 else 1) + (1 if a.min() < -0.5 else 0)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb, ab, aa, bb = smooth
    v1 = 2 * (ab - ma * mb) + c2
    v2 = aa - ma * ma + bb - mb * mb + c2
    return float(((2 * ma * mb + c1) * v1 / ((ma * ma + mb * mb + c1) * v2)).mean()), float((v1 / v2).mean())


def thumbnail(image: np.ndarray, size: int = 32) -> np.ndarray:
    """Bilinear samples (channels, size, size) at the centres of a ``size`` by ``size`` grid over (channels, height, width)."""
    for axis in (1, 2):
        n = image.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, None)
        low = np.minimum(at.astype(int), n - 1)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        image = np.take(image, low, axis) * (1 - part) + np.take(image, np.minimum(low + 1, n - 1), axis) * part
    return image


#: Weights of the scales of multi-scale similarity.
SCALE_WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def multi_scale(a: np.ndarray, b: np.ndarray, published: bool = False) -> float | None:
    """Multi-scale similarity of two images (channels, height, width); null below 16 pixels a side or for a negative term.

    The similarity of the last scale counts once for each scale above it, or once in all as ``published``.
    """
    if min(a.shape[1:]) < 16:
        return None
    out, terms = 1.0, []
    for i in range(len(SCALE_WEIGHTS)):
        if i:
            a, b = (x[:, : x.shape[1] // 2 * 2, : x.shape[2] // 2 * 2].reshape(x.shape[0], x.shape[1] // 2, 2, x.shape[2] // 2, 2).mean(axis=(2, 4)) for x in (a, b))
        terms.append(similarity_terms(a, b, (1, 2)))
    if min(t[1] for t in terms[:-1]) < 0 or terms[-1][0] < 0:
        return None
    for (_, contrast), w in zip(terms[:-1], SCALE_WEIGHTS, strict=False):
        out *= contrast**w
    return out * terms[-1][0] ** (SCALE_WEIGHTS[-1] * (1 if published else len(SCALE_WEIGHTS) - 1))


def colour_pairs(pairs: DataFrame, height: int, width: int) -> DataFrame:
    """Adds hist_corr, similarity (of volumes of 32 x 32 thumbnails) and ms_ssim to pairs with columns a and b, RGB pixel arrays (height, width, 3) of one size.

    Values are cut to whole bytes for the histograms and scaled to 0..1 for the similarities, whose classes ``tiling.densify`` gives.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in in_slices(batches):
            a, b = (np.stack(pdf[c].to_numpy()).astype(float).reshape(-1, height, width, 3) for c in "ab")
            whole = [np.clip(x, 0, 255).astype(np.uint8).reshape(len(x), -1, 3) for x in (a, b)]
            planes = [(x.transpose(2, 0, 1) / 255, y.transpose(2, 0, 1) / 255) for x, y in zip(a, b, strict=True)]
            small = [similarity_terms(thumbnail(x), thumbnail(y), (0, 1, 2))[0] for x, y in planes]
            yield pdf.drop(columns=["a", "b"]).assign(hist_corr=histogram_correlation(*whole), similarity=small, ms_ssim=pd.Series([multi_scale(x, y) for x, y in planes],
                index=pdf.index, dtype=object))

    bound_batches(pairs.sparkSession)
    schema = pairs.drop("a", "b").schema.add("hist_corr", "double").add("similarity", "double").add("ms_ssim", "double")
    return pairs.mapInPandas(run, schema)
