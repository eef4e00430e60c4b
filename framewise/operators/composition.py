"""Composition statistics and gates over a clip manifest and over files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parts


def gates(clips: DataFrame, most_background: float = 0.3) -> DataFrame:
    """Total, shares of multi-character and show-background clips, and whether the latter stays within tolerance."""
    multi, show = F.col("character").contains("+"), F.col("bg_type") == "show"
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return clips.agg(F.count("*").alias("total"), share(multi).alias("multi_share"), share(show).alias("show_share")).withColumn("show_ok", F.col("show_share") <= most_background)


def action_parity(clips: DataFrame, least: int = 4) -> DataFrame:
    return clips.groupBy("action_label").agg(F.count("*").alias("n")).withColumn("starved", F.col("n") < least)


def prop_frequency(clips: DataFrame, least: int = 2) -> DataFrame:
    """Mentions and clips per prop; lonely by mentions, as a prop named twice in a clip counts twice, and by clips."""
    props = clips.select("clip_id", F.explode("props").alias("prop"))
    out = props.groupBy("prop").agg(F.count("*").alias("mentions"), F.count_distinct("clip_id").alias("clips"))
    return out.withColumn("lonely", F.col("mentions") < least).withColumn("lonely_clips", F.col("clips") < least)


def total_seconds(seconds: Column) -> Column:
    """Aggregate: the sum to three decimals, the same in every order of rows; added as decimals, or as doubles where a value is no decimal below 10^10."""
    exact = seconds.try_cast("decimal(28,18)")
    return F.when(F.count(exact) == F.count(seconds), F.round(F.sum(exact), 3).cast("double")).otherwise(F.round(F.sum(seconds), 3))


def sources_by_clips(clips: DataFrame, k: int) -> DataFrame:
    """The k sources of most clips with their footage, ties by name."""
    out = clips.groupBy("source_file").agg(F.count("*").alias("clips"), total_seconds(F.col("duration_s")).alias("footage_s"))
    return out.orderBy(F.desc("clips"), "source_file").limit(k)


def presence(clips: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Clips that show each of two characters alone and both, in one row."""
    a, b = (F.array_contains(F.split("character", r"\+"), n) for n in names)
    return clips.agg(F.count_if(a & ~b).alias("only_first"), F.count_if(b & ~a).alias("only_second"), F.count_if(a & b).alias("both"), F.count_distinct("source_file").alias("sources"))


def footage(clips: DataFrame) -> DataFrame:
    """By source: shots, clips, clips a shot, and seconds of footage. clips: source_file, shot, duration_s."""
    out = clips.groupBy("source_file").agg(F.count_distinct("shot").alias("shots"), F.count("*").alias("clips"), total_seconds(F.col("duration_s")).alias("footage_s"))
    return out.withColumn("clips_per_shot", F.round(F.col("clips") / F.col("shots"), 6))


def content_type(path: Column) -> Column:
    return (
        F.when(path.endswith(".mp4"), "video/mp4").when(path.endswith(".png"), "image/png").when(path.endswith(".md"), "text/markdown")
        .when(path.endswith(".log") | path.endswith(".txt"), "text/plain").otherwise("application/octet-stream")
    )


def settled(files: DataFrame, at: Column, seconds: int, older: bool = True) -> DataFrame:
    """Files not modified within ``seconds`` before ``at`` (or, not ``older``, only those that were)."""
    old = F.col("modificationTime") <= at - F.make_dt_interval(secs=F.lit(seconds))
    return files.where(old if older else ~old)


def transfer_totals(files: DataFrame) -> DataFrame:
    """Objects and bytes by category; empty files count as nothing."""
    return files.where("length > 0").groupBy("category").agg(F.count("*").alias("objects"), F.sum("length").alias("bytes"))


def identical_groups(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Groups of equal content of two rows or more: the first key, the size of the group."""
    return rows.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.min(key).alias(f"first_{key}"), F.count("*").alias("copies")).where("copies > 1")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer match of two name lists on the lower-case name without version suffix: counts on both sides and a status."""
    name = F.regexp_replace(F.lower(F.trim(F.col(key))), r"_v\d+$", "")
    sides = [df.groupBy(name.alias("name")).agg(F.count("*").alias(n)) for df, n in ((left, "n_left"), (right, "n_right"))]
    out = sides[0].join(sides[1], "name", "full_outer").na.fill(0, ["n_left", "n_right"])
    return out.withColumn("status", F.when(F.col("n_left") == 0, "right_only").when(F.col("n_right") == 0,
        "left_only").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicated").otherwise("matched"))


def parsed_name(name: Column, affixes: Sequence[str] = ()) -> dict[str, Column]:
    """stem, version and case_differs of a file's or storyboard's name.

    Folder and ending go, then ``affixes`` at either end, which are patterns, as often as they are there. A version is '_v2', '-v2', ' v2' or
    'v2' at the end, or else digits right after a letter ('Kettle2'); without one it is 1. The stem is what is left in lower case.
    case_differs: a word begins with two capitals and goes on in lower case ('HOrse'), which looks like a typing error.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[A-Za-z0-9]+$", ""))
    if affixes:
        either = "|".join(affixes)
        bare = F.regexp_replace(F.regexp_replace(bare, rf"(?i)^(?:(?:{either})[_\- ])+(?=.)", ""), rf"(?i)(?<=.)(?:[_\- ](?:{either}))+$", "")
    version = r"(?i)(?:(?<=.)[_\- ]?v(\d+)|(?<=[A-Za-z])(\d+))$"
    number = F.coalesce(F.nullif(F.regexp_extract(bare, version, 1), F.lit("")), F.nullif(F.regexp_extract(bare, version, 2), F.lit("")), F.lit("1"))
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(bare, version, "")), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return {"stem": stem, "version": number.try_cast("long"), "case_differs": F.coalesce(bare.rlike(r"(?<!\p{L})\p{Lu}\p{Lu}\p{Ll}"), F.lit(False))}


def reconcile_versions(left: DataFrame, right: DataFrame, key: str, affixes: Sequence[str] = ()) -> DataFrame:
    """Two lists of names matched by their stems: stem, n_left, n_right, latest_left, latest_right, odd_case and status.

    status: left_only, right_only; duplicated, where a side has one version twice; version_mismatch, where the latest
    versions differ; superseded, where they agree but a side has earlier ones; matched. odd_case: a name's capitals look like
    a typing error. Null names are left out.
    """
    sides = []
    for df, n in ((left, "left"), (right, "right")):
        named = df.select(*[c.alias(k) for k, c in parsed_name(F.col(key), affixes).items()]).where("stem is not null")
        each = named.groupBy("stem", "version").agg(F.count("*").alias("__n"), F.bool_or("case_differs").alias("__odd"))  # a stem's versions are few
        sides.append(each.groupBy("stem").agg(F.sum("__n").alias(f"n_{n}"), F.max("__n").alias(f"__most_{n}"), F.count("*").alias(f"__versions_{n}"),
            F.max("version").alias(f"latest_{n}"), F.bool_or("__odd").alias(f"__odd_{n}")))
    out = sides[0].join(sides[1], "stem", "full_outer").na.fill(0, ["n_left", "n_right"])
    status = (
        F.when(F.col("n_left") == 0, "right_only").when(F.col("n_right") == 0, "left_only").when(F.greatest("__most_left", "__most_right") > 1, "duplicated")
        .when(~F.col("latest_left").eqNullSafe(F.col("latest_right")), "version_mismatch").when(F.greatest("__versions_left", "__versions_right") > 1, "superseded").otherwise("matched")
    )
    odd = F.coalesce("__odd_left", F.lit(False)) | F.coalesce("__odd_right", F.lit(False))
    return out.select("stem", "n_left", "n_right", "latest_left", "latest_right", odd.alias("odd_case"), status.alias("status"))


def beat_number(label: Column) -> Column:
    """The number of a storyboard's beat: '2. text', '2) text', '#2' or 'Beat 2: text'; null without one."""
    return F.nullif(F.regexp_extract(label, r"(?i)^\s*(?:beat\s*|#\s*)?(\d+)", 1), F.lit("")).try_cast("long")


def beat_problems(beats: DataFrame) -> DataFrame:
    """storyboard, problem, number and times of numbering errors in beats (storyboard, label): 'duplicated' numbers, and 'missing' ones up to the highest, as runs.

    A row for each duplicated number, with how often it is there, and one for each run of missing numbers, with its first
    number and its length. Numbers count from 1 or from the least, if that is lower; beats without a number are left out.
    """
    numbered = beats.select("storyboard", beat_number(F.col("label")).alias("number")).where("storyboard is not null and number is not null")
    counted = numbered.groupBy("storyboard", "number").agg(F.count("*").alias("times"))
    twice = counted.where("times > 1").select("storyboard", F.lit("duplicated").alias("problem"), "number", "times")
    before = parts.previous(counted.select("storyboard", "number"), "storyboard", "number", "number", "__before")
    first = F.coalesce(F.col("__before") + 1, F.least(F.lit(1), F.col("number")))
    gaps = before.withColumn("__first", first).where(F.col("number") > F.col("__first"))
    return twice.unionByName(gaps.select("storyboard", F.lit("missing").alias("problem"), F.col("__first").alias("number"), (F.col("number") - F.col("__first")).alias("times")))


def share_gates(clips: DataFrame, column: str, wanted: dict[str, float], tolerance: float) -> DataFrame:
    """Share of each value of ``column`` against the wanted one; ok within the tolerance. Values that do not occur have share 0."""
    targets = clips.sparkSession.createDataFrame(sorted(wanted.items()), f"{column} string, wanted double")
    total = clips.agg(F.count("*").alias("total"))
    counted = targets.join(clips.groupBy(column).agg(F.count("*").alias("n")), column, "left").na.fill(0, ["n"]).crossJoin(total)  # one row
    share = F.when(F.col("total") > 0, F.round(F.col("n") / F.col("total"), 6)).otherwise(0.0)
    return counted.withColumn("share", share).withColumn("ok", F.abs(F.col("share") - F.col("wanted")) <= tolerance).drop("total")


def all_categories(lists: dict[str, DataFrame]) -> DataFrame:
    """File lists of several categories as one."""
    out = None
    for name, df in lists.items():
        part = df.withColumn("category", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def first_by_path(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy("path").limit(n)
