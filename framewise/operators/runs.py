"""Training logs, checkpoints and evaluation runs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parts

POINT = r"(\d+)/\d+ \[[^\]]*?loss=([0-9.eE+-]+),\s*lr=([0-9.eE+-]+)"


def named_fields(lines: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """One row per run: for each field the number of its pattern's first match."""
    out = lines
    for name, pattern in fields.items():
        out = out.withColumn(name, F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).try_cast("long"))
    return out.groupBy("run").agg(*[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in fields])


def log_points(lines: DataFrame) -> DataFrame:
    """run, line_no, nth, step, loss, lr of every progress point; points that are no numbers are left out."""
    part = lambda i: F.regexp_extract_all("value", F.lit(POINT), F.lit(i))
    rows = lines.select("run", "line_no", F.posexplode(F.arrays_zip(part(1).alias("step"), part(2).alias("loss"), part(3).alias("lr"))).alias("nth", "p"))
    rows = rows.select("run", "line_no", "nth", F.col("p.step").try_cast("long").alias("step"), F.col("p.loss").try_cast("double").alias("loss"), F.col("p.lr").try_cast("double").alias("lr"))
    return rows.where("step is not null and loss is not null and lr is not null")


def loss_curve(points: DataFrame, tail: int = 50) -> DataFrame:
    """Steps reached, first, last and least loss, mean of the last ``tail`` points, last rate."""
    order = F.struct("line_no", "nth")
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("line_no"), F.desc("nth")))
    last = points.withColumn("__rank", rank).where(F.col("__rank") <= tail)  # tasks leave out what can be no part of a tail before they shuffle
    ends = points.groupBy("run").agg(
        F.max("step").alias("steps_reached"), F.min_by("loss", order).alias("loss_first"), F.max_by("loss", order).alias("loss_last"),
        F.min("loss").alias("loss_min"), F.max_by("lr", order).alias("lr_last"),
    )
    tails = last.groupBy("run").agg(F.avg("loss").alias("loss_tail"))
    return ends.join(tails, "run").select("run", "steps_reached", "loss_first", "loss_last", "loss_min", "loss_tail", "lr_last")


def elapsed(lines: DataFrame) -> DataFrame:
    """Last elapsed time and first seconds an iteration by run."""
    time = F.nullif(F.regexp_extract("value", r"\[(\d+:\d+(?::\d+)?)<", 1), F.lit(""))
    pace = F.nullif(F.regexp_extract("value", r"([0-9.]+)s/it", 1), F.lit(""))
    rows = lines.withColumn("__t", time).withColumn("__p", pace.try_cast("double"))
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    return rows.groupBy("run").agg(F.max_by("__t", at("__t")).alias("elapsed_last"), F.min_by("__p", at("__p")).alias("s_per_it"))


#: What a log says when its run is over.
END_MARKS = ("end_training", "Steps: 100%")


def completion(lines: DataFrame, points: DataFrame, total_steps: DataFrame, marks: Sequence[str] = END_MARKS) -> DataFrame:
    """run, steps_reached, total_steps and completed of every run of ``lines``.

    A run is complete when a line holds one of ``marks``, or when it reached its planned number of steps: both known and
    the plan above 0. total_steps: run, total_steps, one row for each run.
    """
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.coalesce(F.contains(F.col("value"), F.lit(m)), F.lit(False))
    out = lines.groupBy("run").agg(F.bool_or(marked).alias("__marked"))
    out = out.join(points.groupBy("run").agg(F.max("step").alias("steps_reached")), "run", "left").join(total_steps.select("run", "total_steps"), "run", "left")
    reached = F.coalesce((F.col("steps_reached") > 0) & (F.col("total_steps") > 0) & (F.col("steps_reached") >= F.col("total_steps")), F.lit(False))
    return out.withColumn("completed", F.col("__marked") | reached).drop("__marked")


def sparkline(points: DataFrame, width: int = 60, levels: int = 8) -> DataFrame:
    """Every max(1, n // width)-th point of a run, by line and place in the line, with its level from 0 to levels - 1 between the run's least and largest loss.

    A point's number is the count of those in earlier parts of the run and its rank in its own part, so no run is sorted.
    A point at the largest loss has the level below the last unless losses are so far apart that the difference is
    lost in rounding, as levels divide a range that is longer by 1e-12.
    """
    ends = points.groupBy(F.col("run").alias("__run")).agg(F.min("loss").alias("__low"), F.max("loss").alias("__high"))
    rows = parts.ranked(points, "run", "line_no", then=("nth",)).withColumn("__i", F.col("__rn") - 1)
    rows = rows.where(F.col("__i") % F.greatest(F.lit(1), F.floor(F.col("__n") / width)) == 0).join(ends, F.col("run").eqNullSafe(F.col("__run")))  # fewer than 2 * width of a run are left
    level = F.least(F.lit(levels - 1), F.floor((F.col("loss") - F.col("__low")) / (F.col("__high") - F.col("__low") + 1e-12) * (levels - 1)))
    return rows.select("run", F.col("__i").alias("i"), level.cast("int").alias("level"))


def sparkline_text(points: DataFrame, width: int = 60, blocks: str = "▁▂▃▄▅▆▇█") -> DataFrame:
    """run and sparkline: the levels of a run as characters, in order."""
    drawn = sparkline(points, width, len(blocks)).withColumn("block", F.substring(F.lit(blocks), F.col("level") + 1, F.lit(1)))
    line = F.transform(F.array_sort(F.collect_list(F.struct("i", "block"))), lambda x: x["block"])  # fewer than 2 * width
    return drawn.groupBy("run").agg(F.array_join(line, "").alias("sparkline"))


def find_checkpoints(files: DataFrame) -> DataFrame:
    """Folders with weights: root, step, path, is_final. Of a root's own folder, which holds the final weights, the step is null.

    files: root, path (of a folder, by its name below the root; the root itself is '' or null) and has_weights. Other folders are left out.
    """
    name = F.regexp_replace(F.coalesce("path", F.lit("")), r"/+$", "")
    step = F.nullif(F.regexp_extract(name, r"(?:^|/)checkpoint-(\d+)$", 1), F.lit("")).cast("long")
    own = (name == "") | (name == F.col("root").cast("string"))
    return files.where("has_weights").withColumn("step", step).withColumn("is_final", step.isNull() & own).where(F.col("step").isNotNull() | F.col("is_final"))


def resolve_checkpoint(checkpoints: DataFrame, wanted: str | int = "latest", folders: DataFrame | None = None) -> DataFrame:
    """By root the checkpoint wanted: step, path, label, found, available (how many steps there are) and alternatives.

    'latest' is the highest step, or the root's weights where there is no step; 'final' the root's weights, or else the
    highest step; a number that step alone. A root without it has found false and lists all its steps in
    alternatives, in order. Any other text is a folder's path, which is the checkpoint for every root if ``folders`` (path,
    has_weights: any folders, of no root) holds it with weights; its label is its name and its step that of a name
    'checkpoint-<step>'. A folder with weights comes first, also one that is named like a step.
    """
    asked = str(wanted)
    order = F.struct(F.coalesce(F.col("is_final"), F.lit(False)).cast("int").alias("final"), F.coalesce("step", F.lit(-1)).alias("step"))
    if asked == "latest":
        order = F.struct(F.coalesce("step", F.lit(-1)).alias("step"))
    number = int(asked) if re.fullmatch(r"[0-9]+", asked) else None
    fits = F.lit(True) if asked in ("latest", "final") else F.col("step") == F.lit(number).cast("long")
    fits = F.coalesce(fits, F.lit(False))
    steps = F.count_if(F.col("step").isNotNull()).alias("available")
    listed = F.array_sort(F.collect_set("step")) if asked not in ("latest", "final") else F.lit(None).cast("array<long>")
    out = checkpoints.groupBy("root").agg(F.max_by(F.struct("step", "path"), F.when(fits, order)).alias("best"), F.bool_or(fits).alias("found"), steps, listed.alias("__steps"))
    step, path, found = F.col("best.step"), F.col("best.path"), F.col("found")
    label = F.when(step.isNull(), "final").otherwise(F.concat(F.lit("checkpoint-"), step))
    if folders is not None:
        bare = lambda c: F.regexp_replace(c, r"(?<=.)/+$", "")
        there = folders.where("has_weights").where(bare(F.col("path")) == asked.rstrip("/")).agg(F.min("path").alias("__folder"))
        out = out.crossJoin(F.broadcast(there))  # one row
        name = F.regexp_extract(bare(F.col("__folder")), r"([^/]*)$", 1)
        own = F.col("__folder").isNotNull()
        step = F.when(own, F.nullif(F.regexp_extract(name, r"^checkpoint-(\d+)$", 1), F.lit("")).cast("long")).otherwise(step)
        path, label, found = F.when(own, F.col("__folder")).otherwise(path), F.when(own, name).otherwise(label), own | found
    told = F.when(~found, F.array_join(F.col("__steps").cast("array<string>"), ", "))
    return out.select("root", F.when(found, step).alias("step"), F.when(found, path).alias("path"), F.when(found, label).alias("label"), found.alias("found"), "available", told.alias("alternatives"))


def retention(checkpoints: DataFrame, limit: int) -> DataFrame:
    """Plan before one more is written: the newest limit - 1 stay. A root's own weights have no step and are no part of it."""
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("step")))
    return checkpoints.where("step is not null").withColumn("remove", rank > limit - 1)


def newest(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("root").agg(F.max_by("path", F.struct("mtime", "step")).alias("path"))


#: Ranges that a ranking is worked out in, and rows that their bounds are drawn from.
RANGES, SAMPLED = 256, 8_192


def rank_by(runs: DataFrame, metrics: Sequence[tuple[str, bool]], ranges: int = RANGES) -> DataFrame:
    """Adds rank: 1 and how many rows are better, by metrics in order, each (column, larger is better); rows alike in all share a rank, nulls come last.

    Rows alike are counted first. What is left is dealt into ranges between bounds drawn over all metrics, as many as
    ``ranges`` at most; each range is ranked by itself and goes on where the counts of those before it end. The rows take
    their rank from their metrics, so no task sorts all rows nor those of a frequent value.
    """
    names = [c for c, _ in metrics]
    order = [F.desc_nulls_last(c) if up else F.asc_nulls_last(c) for c, up in metrics]
    kinds = runs.select(*[F.col(c).alias(c) for c in names]).groupBy(*names).agg(F.count("*").alias("__rows"))
    drawn = kinds.select(*names).orderBy(F.xxhash64(*names), *names).limit(SAMPLED)
    at = F.row_number().over(Window.orderBy(*order))
    step = -(-SAMPLED // ranges)
    bounds = drawn.withColumn("__at", at).where(F.col("__at") % step == 0).agg(F.collect_list(F.struct(*names)).alias("__bounds"))  # of SAMPLED rows at most

    def from_bound_on(b: Column) -> Column:
        """The row is the bound or comes after it."""
        later, alike = F.lit(False), F.lit(True)
        for c, up in metrics:
            x, y = F.col(c), b[c]
            behind = F.when(y.isNull(), False).when(x.isNull(), True).otherwise(x < y if up else x > y)
            later, alike = later | (alike & behind), alike & x.eqNullSafe(y)
        return later | alike

    placed = kinds.crossJoin(F.broadcast(bounds)).withColumn("__range", F.size(F.filter("__bounds", from_bound_on))).drop("__bounds")  # one row
    totals = placed.groupBy("__range").agg(F.sum("__rows").alias("__in"))
    before = F.coalesce(F.sum("__in").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # ``ranges`` rows
    local = F.coalesce(F.sum("__rows").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("__local", local).join(F.broadcast(totals.select("__range", before.alias("__before"))), "__range")
    key = F.struct(*names)  # structs compare nulls as equal
    ranks = ranked.select(key.alias("__key"), (1 + F.col("__before") + F.col("__local")).alias("rank"), F.col("__rows").alias("n"))
    return parts.join_counted(runs.drop("rank").withColumn("__key", key), ranks, ["__key"]).drop("__key")


def compare_runs(runs: DataFrame, summaries: DataFrame, last_frames: DataFrame) -> DataFrame:
    """Comparison of checkpoints: each run with its clip's adjacent similarity (mean, least), palette drift, last correlation with the first frame, and retention flag.

    runs: run, clip_id. summaries: clip_id, mean, least. last_frames: clip_id, first and last correlation with frame 0.
    Runs whose metrics are missing stay, with nulls and without a flag.
    """
    out = runs.join(summaries.select("clip_id", "mean", "least"), "clip_id", "left").join(last_frames.select("clip_id", "first", "last"), "clip_id", "left")
    out = out.withColumn("palette_drift", F.round(F.col("first") - F.col("last"), 4))
    return out.withColumn("flag", F.when(F.col("last").isNotNull(), retention_flag(F.col("last")))).drop("first")


def run_label(checkpoint: Column, scale: Column, guidance: Column, frames: Column) -> Column:
    """ckpt<n>_s<scale in hundredths, 3 digits>_g<guidance in tenths, 2 digits>_f<frames>; larger numbers keep all digits."""

    def digits(x: Column, n: int) -> Column:
        text = F.bround(x).cast("int").cast("string")
        return F.lpad(text, F.greatest(F.length(text), F.lit(n)), F.lit("0"))

    return F.concat(F.lit("ckpt"), checkpoint, F.lit("_s"), digits(scale * 100, 3), F.lit("_g"), digits(guidance * 10, 2), F.lit("_f"), frames)


def parse_label(label: Column) -> dict[str, Column]:
    part = lambda p: F.regexp_extract(label, p, 1).try_cast("int")
    return {"checkpoint": part(r"ckpt(\d+)"), "scale": part(r"_s(\d+)") / 100, "guidance": part(r"_g(\d+)") / 10, "frames": part(r"_f(\d+)")}


def retention_flag(score: Column) -> Column:
    return F.when(score > 0.7, "good").when(score > 0.5, "fading").otherwise("LOST")


def effective_scale(alpha: Column, rank: Column) -> Column:
    return alpha / rank


def rubric_verdict(scores: DataFrame, mean: float = 3.0) -> DataFrame:
    """Passes with a mean of at least ``mean`` and no dimension at 1."""
    out = scores.groupBy("item").agg(F.avg("score").alias("mean"), F.min("score").alias("least"))
    return out.withColumn("passes", (F.col("mean") >= mean) & (F.col("least") > 1))


def failure_rate(trials: DataFrame) -> DataFrame:
    """Failure rate over seeds by class."""
    return trials.groupBy("kind").agg(F.avg(F.col("failed").cast("double")).alias("rate"), F.count_distinct("seed").alias("seeds"))


def evaluation_grid(checkpoints: DataFrame, items: DataFrame, first: int = 10, prefix: str = "") -> DataFrame:
    """Every checkpoint with the first items by order: prompt and output name. The items' side holds ``first`` rows at most."""
    few = items.orderBy("ord").limit(first).withColumn("prompt", F.concat(F.lit(prefix), F.col("text"))).select("ord", "prompt")
    return checkpoints.crossJoin(F.broadcast(few)).withColumn("output", F.concat_ws("_", "root", "step", "ord"))


def throughput(items: DataFrame) -> DataFrame:
    """By kind: success rate, and seconds and cost per approved item (null without one). items: kind, approved, seconds, cost."""
    approved = F.count_if("approved")
    per = lambda c: F.when(approved > 0, F.sum(c) / approved)
    return items.groupBy("kind").agg(F.avg(F.col("approved").cast("double")).alias("success"), per("seconds").alias("seconds_each"), per("cost").alias("cost_each"))


def first_eligible(metadata: DataFrame, k: int) -> DataFrame:
    """The first k videos by ordinal; a row without a type counts as one."""
    return metadata.where(F.coalesce("type", F.lit("video")) == "video").orderBy("ord").limit(k)


def first_captions(metadata: DataFrame, k: int = 3) -> DataFrame:
    """ord and text of the first k entries of any type; a missing text is empty."""
    return metadata.orderBy("ord").limit(k).select("ord", F.coalesce("text", F.lit("")).alias("text"))
