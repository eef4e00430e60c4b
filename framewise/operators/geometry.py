"""Sizes, crops, buckets and frame-count arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aspect ratio (height by width), height, width of the buckets at 512.
RATIOS_512 = (
    (0.25, 256, 1024), (0.26, 256, 992), (0.27, 256, 960), (0.28, 256, 928), (0.32, 288, 896), (0.33, 288, 864), (0.35, 288, 832),
    (0.4, 320, 800), (0.42, 320, 768), (0.48, 352, 736), (0.5, 352, 704), (0.52, 352, 672), (0.53, 368, 688), (0.57, 384, 672),
    (0.6, 384, 640), (0.68, 416, 608), (0.72, 416, 576), (0.78, 448, 576), (0.82, 448, 544), (0.88, 480, 544), (0.94, 480, 512),
    (1.0, 512, 512), (1.07, 512, 480), (1.13, 544, 480), (1.21, 544, 448), (1.29, 576, 448), (1.38, 576, 416), (1.46, 608, 416),
    (1.67, 640, 384), (1.75, 672, 384), (1.87, 688, 368), (2.0, 704, 352), (2.09, 736, 352), (2.4, 768, 320), (2.5, 800, 320),
    (2.89, 832, 288), (3.0, 864, 288), (3.11, 896, 288), (3.62, 928, 256), (3.75, 960, 256), (3.88, 992, 256), (4.0, 1024, 256),
)
#: Ratios a random crop may take, and their weights.
CROP_RATIOS = (0.42, 0.5, 0.57, 0.68, 0.78, 0.88, 0.94, 1.0, 1.07, 1.13, 1.29, 1.46, 1.75, 2.0, 2.4)
CROP_WEIGHTS = (1, 2, 4, 4, 4, 4, 8, 8, 8, 4, 4, 4, 4, 2, 1)


def floor_to(x: Column, m: int) -> Column:
    return (F.floor(x / m) * m).cast("int")


def fit_resolution(w: Column, h: Column, max_h: int, max_w: int, m: int = 16) -> tuple[Column, Column]:
    """(height, width): the largest of the given shape within the caps, on a grid of m, at least m."""
    scale = F.least(F.lit(max_h) / h, F.lit(max_w) / w)
    one = lambda x, cap: F.least(F.greatest(floor_to(F.bround(x * scale), m), F.lit(m)), F.lit(cap // m * m))
    return one(h, max_h), one(w, max_w)


def resolution_caps(sample_h: Column, sample_w: Column, patch: Column) -> tuple[Column, Column]:
    """Caps of a model's configuration; 768 x 1360 where it names none."""
    cap = lambda s, default: F.coalesce((F.floor(s / patch) * 8 * patch).cast("int"), F.lit(default))
    return cap(sample_h, 768), cap(sample_w, 1360)


def area_size(ratio: Column, side: int, m: int = 16) -> tuple[Column, Column]:
    """(height, width) of about side*side pixels where ratio is height by width, cut to whole pixels, then to the grid."""
    h = F.floor(F.sqrt(F.lit(float(side) ** 2) / ratio))
    return floor_to(h, m), floor_to(F.floor(h * ratio), m)


def short_side(w: Column, h: Column, target: int) -> tuple[Column, Column]:
    """(width, height) with the short side at target; never enlarged."""
    less = F.least(w, h) > target
    one = lambda x: F.when(less, F.floor(x * target / F.least(w, h))).otherwise(x).cast("int")
    return one(w), one(h)


def cover_crop(w: Column, h: Column, to_w: Column, to_h: Column, rounded: bool = False) -> dict[str, Column]:
    """Size that covers the target and offsets of the centre crop: cut to whole pixels, or ``rounded``, halves to even."""
    wide = h / w > to_h / to_w
    resize_w = F.when(wide, to_w).otherwise(F.floor(w * to_h / h)).cast("int")
    resize_h = F.when(wide, F.floor(h * to_w / w)).otherwise(to_h).cast("int")
    whole = F.bround if rounded else F.floor
    half = lambda a, b: whole(F.greatest(a - b, F.lit(0)) / 2).cast("int")
    return {"resize_w": resize_w, "resize_h": resize_h, "crop_x": half(resize_w, to_w), "crop_y": half(resize_h, to_h)}


def bucket_crop(rows: DataFrame, height: str, width: str) -> DataFrame:
    """Adds resize_w, resize_h, crop_x and crop_y that fit a row into its bucket (bucket_h, bucket_w, as closest_bucket or random_bucket give them)."""
    crop = cover_crop(F.col(width), F.col(height), F.col("bucket_w"), F.col("bucket_h"), rounded=True)
    return rows.withColumns(crop)


def random_bucket(rows: DataFrame, ratio: Column, side: int = 512) -> DataFrame:
    """Adds bucket_h and bucket_w of a drawn crop ratio (one of CROP_RATIOS): the bucket of that ratio, scaled to ``side``."""
    table = {r: (h, w) for r, h, w in RATIOS_512}
    pick = lambda k: F.coalesce(*[F.when(ratio == r, F.lit(table[r][k])) for r in CROP_RATIOS])
    scaled = lambda k: floor_to(pick(k) * side / 512, 16)
    return rows.withColumn("bucket_h", scaled(0)).withColumn("bucket_w", scaled(1))


def read_caps(configs: DataFrame) -> DataFrame:
    """Adds cap_h and cap_w from a model's configuration in JSON (column config): see resolution_caps; text that is no JSON has the fallback."""
    c = F.from_json("config", "patch_size int, sample_height int, sample_width int")
    patch = F.coalesce(c["patch_size"], F.lit(2))
    both = c["sample_height"].isNotNull() & c["sample_width"].isNotNull() & (patch > 0)  # one without the other is no size
    h, w = resolution_caps(F.when(both, c["sample_height"]), F.when(both, c["sample_width"]), patch)
    return configs.withColumn("cap_h", h).withColumn("cap_w", w)


def snap_4k1(n: Column) -> Column:
    """The largest 4k + 1 up to n (0 below 1)."""
    return F.when(n >= 1, F.floor((n - 1) / 4) * 4 + 1).otherwise(0).cast("int")


def latent_length(n: Column, q: int) -> Column:
    return (F.floor((n - 1) / q) + 1).cast("int")


def align_patch(n: Column, q: int, p_t: int) -> Column:
    """Frames left when the latent length is cut to a multiple of the temporal patch, at least 1."""
    return F.greatest(n - latent_length(n, q) % p_t * q, F.lit(1)).cast("int")


def frames_for_budget(tokens: Column, size: Column, most: int, q: int) -> Column:
    """Frames of a square size that a token budget holds."""
    return (F.floor(F.least(tokens / (size * size), F.lit(float(most))) / q) * q + 1).cast("int")


def closest_bucket(rows: DataFrame, height: str, width: str, side: int = 512) -> DataFrame:
    """Adds ratio, bucket_h and bucket_w of the nearest ratio, the first listed of equally near ones, scaled to ``side``.

    The table is a literal of fixed size that each row scans; no join is needed.
    """
    aspect = F.col(height) / F.col(width)
    table = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(h).alias("h"), F.lit(w).alias("w")) for r, h, w in RATIOS_512])
    best = F.aggregate(table, table[0], lambda acc, x: F.when(F.abs(x["r"] - aspect) < F.abs(acc["r"] - aspect), x).otherwise(acc))
    rows = rows.withColumn("__best", best)
    scaled = lambda c: floor_to(F.col(f"__best.{c}") * side / 512, 16)
    return rows.withColumn("ratio", F.col("__best.r")).withColumn("bucket_h", scaled("h")).withColumn("bucket_w", scaled("w")).drop("__best")
