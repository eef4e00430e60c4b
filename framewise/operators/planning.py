"""Segment sheets to planned clips: times, frame counts, ids, strategies and verdicts as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


#: Decimals of a second that times and durations are told apart by: equal times are equal numbers, whatever parts they were written in.
SECOND_PLACES = 9


def to_seconds(ts: Column) -> Column:
    """Seconds of '[[HH:]MM:]SS[.s]', to SECOND_PLACES: the last three parts of a longer value count; null if a part is no number."""
    parts = F.split(F.substring_index(F.trim(ts), ":", -3), ":")
    total = F.aggregate(parts, F.lit(0.0), lambda upto, part: upto * 60 + part.try_cast("double"))
    return F.round(total, SECOND_PLACES)


def choose_frames(seconds: Column, fps: int = 16, long: int = 81, short: int = 49) -> Column:
    return F.when(seconds * fps >= long, long).otherwise(short)


def frame_rate(rate: Column) -> Column:
    """'num[/den]' to a rounded rate, halves to even; a zero denominator counts as one."""
    parts = F.split(rate, "/")
    den = F.when(F.size(parts) > 1, F.element_at(parts, F.when(F.size(parts) > 1, 2).otherwise(1)).try_cast("double")).otherwise(1.0)
    return F.bround(F.element_at(parts, 1).try_cast("double") / F.greatest(den, F.lit(1.0))).cast("int")


def exact_rate(rate: Column, places: int = 3) -> Column:
    """'num[/den]' to a rate of ``places`` decimals; a missing denominator is 1, null for a denominator of 0 or a part that is no number."""
    parts = F.split(rate, "/")
    den = F.when(F.size(parts) > 1, F.element_at(parts, F.when(F.size(parts) > 1, 2).otherwise(1)).try_cast("double")).otherwise(1.0)
    return F.bround(F.try_divide(F.element_at(parts, 1).try_cast("double"), den), places)


def clip_id(source_file: Column, ordinal: Column, label: Column) -> Column:
    """Name without folder and last suffix, three-digit ordinal, label with dashes for spaces."""
    stem = F.regexp_replace(F.regexp_replace(source_file, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws("_", stem, F.when(ordinal < 1000, F.lpad(ordinal.cast("string"), 3, "0")).otherwise(ordinal.cast("string")), F.replace(label, F.lit(" "), F.lit("-")))


def strategy(alpha: Column, background: Column, plate: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(alpha) & (background == "gray"), "alpha-on-flat").when(has(alpha) & (background == "show") & has(plate), "alpha-on-plate").otherwise("baked")


def anchor(character: Column, anchors: Mapping[str, str], default: str) -> Column:
    """Text by character; every other value gets ``default``, also one that is_unknown."""
    out = F.lit(default)
    for k, v in anchors.items():
        out = F.when(character == k, v).otherwise(out)
    return out


def is_unknown(character: Column, anchors: Mapping[str, str], others: Sequence[str] = ()) -> Column:
    """The character is none of those with a text nor of ``others``, those that the default text is meant for; a null or blank one is unknown too. Never null."""
    known = [*anchors, *others]
    return ~F.coalesce(character.isin(*known), F.lit(False)) if known else F.lit(True)


def resolve_path(path: Column, root: str) -> Column:
    """Absolute paths as they are, others below ``root``; null stays null."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def plan_clips(segments: DataFrame, fps: int = 16) -> DataFrame:
    """Plan columns for every segment, also rejected ones, which keep their ordinal.

    verdict: 'ok', 'bad_time' or 'empty' (out not after in). short_after_pad marks windows that a second of padding
    does not bring to their frame count.
    """
    start, end = to_seconds(F.col("in")), to_seconds(F.col("out"))
    background = F.coalesce(blank_to_null(F.col("bg_type")), F.lit("gray"))
    out = segments.withColumn("start_s", start).withColumn("end_s", end).withColumn("duration_s", F.round(end - start, SECOND_PLACES))
    out = out.withColumn("verdict", F.when(F.col("duration_s") > 0, "ok").when(F.col("duration_s").isNull(), "bad_time").otherwise("empty"))
    out = out.withColumn("frames", choose_frames(F.col("duration_s"), fps))
    return (
        out.withColumn("clip_id", clip_id(F.col("source_file"), F.col("row_ord"), F.col("action_label")))
        .withColumn("strategy", strategy(F.trim("alpha_file"), background, F.trim("bg_plate")))
        .withColumn("bg_type", background)
        .withColumn("in_window", F.col("duration_s").between(2.0, 5.2))
        .withColumn("short_after_pad", fps * F.col("duration_s") + fps < F.col("frames"))
        .withColumn("props", F.filter(F.transform(F.split(F.coalesce("props", F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p != ""))
    )


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, after those of ``existing``; an existing row is never changed."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)
