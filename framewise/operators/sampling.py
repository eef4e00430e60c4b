"""Sample plans: balancing, epoch order, batches, frame indices and seeded draws.

Draws come from MD5 of key, seed, epoch and purpose, so they do not depend on partitions and can be repeated elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int, purpose: str, epoch: Column | int = 0) -> Column:
    """A number in [0, 1) of 32 bits."""
    text = F.concat_ws(":", F.lit(purpose), F.lit(seed), epoch if isinstance(epoch, Column) else F.lit(epoch), key)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def balance_types(metadata: DataFrame, video_repeat: int) -> DataFrame:
    """Rows that are no videos once, videos ``video_repeat`` times (0 drops them); a null type is an image."""
    kind = F.coalesce("type", F.lit("image"))
    times = F.when(kind == "video", video_repeat).otherwise(1)
    return metadata.withColumn("type", kind).where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def oversample(rows: DataFrame, column: str, weights: Mapping[str, int]) -> DataFrame:
    times = F.lit(1)
    for k, n in weights.items():
        times = F.when(F.col(column) == k, n).otherwise(times)
    return rows.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


#: Parts a group is ranked in: a power of two, so that a draw of 32 bits falls into one exactly.
RANK_BINS = 4096


def with_positions(rows: DataFrame, u: Column, key: str, group: Sequence[str]) -> DataFrame:
    """Adds __u (the draw), position (from 0, in the order of draw and key within ``group``) and __n (rows of the group).

    A group is cut at fixed draws into RANK_BINS parts that are ranked on their own; counts of the parts before give the
    rest, so no task sorts a whole group. Null group values form a group.
    """
    rows = rows.withColumn("__u", u).withColumn("__bin", F.floor(F.col("__u") * RANK_BINS).cast("int"))
    rows = rows.withColumn("__group", F.struct(F.lit(0).alias("all"), *group))  # structs compare nulls as equal
    counts = rows.groupBy("__group", "__bin").agg(F.count("*").alias("__in"))
    w = Window.partitionBy("__group")
    before = F.sum("__in").over(w.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__group", "__bin", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__in").over(w).alias("__n"))
    local = F.row_number().over(Window.partitionBy("__group", "__bin").orderBy("__u", key)) - 1
    ranked = rows.withColumn("__local", local).join(counts, ["__group", "__bin"])
    return ranked.withColumn("position", F.col("__before") + F.col("__local")).drop("__group", "__bin", "__before", "__local")


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int, group: Sequence[str] = (), resume: int = 0) -> DataFrame:
    """Adds position (from 0) in the epoch's shuffled order within ``group``; positions before ``resume`` are done."""
    ranked = with_positions(rows, draw(F.col(key).cast("string"), seed, "order", epoch), key, group)
    return ranked.where(F.col("position") >= resume).drop("__u", "__n")


def full_batches(rows: DataFrame, key: str, group: Sequence[str], size: int, seed: int, epoch: int) -> DataFrame:
    """Batches of ``size`` rows of one group in shuffled order; the incomplete last ones are not given out. batch_rank orders a batch by its last row."""
    ranked = with_positions(rows, draw(F.col(key).cast("string"), seed, "order", epoch), key, group).withColumn("batch", F.floor(F.col("position") / size))
    last = F.max("__u").over(Window.partitionBy(*group, "batch"))
    return ranked.where((F.col("batch") + 1) * size <= F.col("__n")).withColumn("batch_rank", last).drop("__u", "__n")


def carried_batches(rows: DataFrame, key: str, group: Sequence[str], size: int, seed: int, epochs: int) -> DataFrame:
    """Batches over ``epochs`` epochs in which a group's incomplete last batch goes on in the next epoch; only the very last is not given out.

    A row for each epoch, with epoch, position (in the group over all epochs), batch, and what orders batches: batch_epoch
    and batch_rank, epoch and draw of a batch's last row.
    """
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    ranked = with_positions(each, draw(F.col(key).cast("string"), seed, "order", F.col("epoch")), key, [*group, "epoch"])
    ranked = ranked.withColumn("position", F.col("epoch") * F.col("__n") + F.col("position")).withColumn("batch", F.floor(F.col("position") / size))
    full = ranked.where((F.col("batch") + 1) * size <= F.col("__n") * epochs)
    full = full.withColumn("__last", F.max(F.struct("epoch", "__u")).over(Window.partitionBy(*group, "batch")))
    return full.withColumn("batch_epoch", F.col("__last.epoch")).withColumn("batch_rank", F.col("__last.__u")).drop("__u", "__n", "__last")


def drop_captions(rows: DataFrame, key: str, p: float, seed: int) -> DataFrame:
    return rows.withColumn("text", F.when(draw(F.col(key).cast("string"), seed, "caption") < p, "").otherwise(F.col("text")))


def pick_weighted(u: Column, values: Sequence[float], weights: Sequence[float]) -> Column:
    """The value whose share of the cumulated weights holds the draw."""
    total, upto, out = float(sum(weights)), 0.0, None
    for v, w in zip(values, weights, strict=True):
        upto += w
        out = F.when(u < upto / total, v) if out is None else out.when(u < upto / total, v)
    return out.otherwise(values[-1])


def downsample_choices(size: int) -> list[float]:
    """Downsampling ratios by sample size."""
    return [1, 1.25, 1.5, 2, 2.5, 3] if size >= 1536 else [1, 1.25, 1.5, 2] if size >= 1024 else [1, 1.25, 1.5] if size >= 768 else [1]


def downsample_ratio(u: Column, size: int) -> Column:
    """The first choice in three of four draws, the others alike."""
    choices = downsample_choices(size)
    weights = [1.0] if len(choices) == 1 else [0.75] + [0.25 / (len(choices) - 1)] * (len(choices) - 1)
    return pick_weighted(u, choices, weights)


def once(values: Mapping[str, Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of a row's values, a struct: each is worked out once for a row, where a function over an array's elements would do it for every element."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), then), F.lit(0))


def strided_indices(length: Column, frames: int, stride: int, u: Column) -> Column:
    """``frames`` indices over a clip of at most (frames - 1) * stride + 1 source frames with a drawn start; they repeat where it is short."""
    span = F.least(length, F.lit((frames - 1) * stride + 1))
    place = lambda v, i: (v["start"] + F.floor(i * (v["span"] - 1) / max(frames - 1, 1))).cast("int")
    return once({"span": span, "start": F.floor(u * (length - span + 1))}, lambda v: F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: place(v, i)))


def dropped_ends_indices(length: Column, frames: int, stride: int, head: float, tail: float, u: Column) -> Column:
    """Indices as strided_indices gives them, between a dropped head and tail given as parts of the length.

    At most ``frames``, fewer where the part that is left holds fewer at the stride; null, an error row, where it holds
    none. ``head`` and ``tail`` are where the part begins and ends, of 1. The start is 0 where the clip spans all that is
    left before ``tail``.
    """
    n = F.least(F.lit(frames), F.floor(F.floor(length * (tail - head)) / stride).cast("int"))
    end = F.floor(length * tail).cast("int")

    def placed(v: Column) -> Column:
        room = v["end"] - v["span"] - v["low"]
        start = F.when(v["end"] == v["span"], 0).otherwise(v["low"] + F.least(F.floor(v["u"] * (room + 1)), room).cast("int"))
        return once({"n": v["n"], "span": v["span"], "start": start}, indices)

    def indices(v: Column) -> Column:
        step = lambda i: F.when(v["n"] > 1, F.floor(i * (v["span"] - 1) / F.greatest(v["n"] - 1, F.lit(1)))).otherwise(0)
        return F.when(v["n"] > 0, F.transform(F.sequence(F.lit(0), F.greatest(v["n"], F.lit(1)) - 1), lambda i: (v["start"] + step(i)).cast("int")))

    span = lambda v: F.least(v["end"], (v["n"] - 1) * stride + 1)
    low = lambda v: F.floor(F.lit(head) * v["end"]).cast("int")
    return once({"n": n, "end": end, "u": u}, lambda v: once({"n": v["n"], "end": v["end"], "u": v["u"], "span": span(v), "low": low(v)}, placed))


def single_frame(length: Column, u: Column) -> Column:
    """One frame drawn from the whole clip."""
    return F.least(F.floor(u * length), length - 1).cast("int")


def head_tail_indices(length: Column, head: int, tail: int, most: int) -> Column:
    """Frames between skipped ends, at most ``most`` at an even stride, cut to 4k + 1; the start alone if nothing is left."""
    end = length - tail
    left = F.greatest(end - head, F.lit(0))
    stride = F.when(left <= most, 1).otherwise(F.floor(left / most)).cast("int")
    n = F.least(F.floor((left + stride - 1) / stride), F.lit(most))
    n = F.floor((n - 1) / 4) * 4 + 1
    every = lambda v: F.transform(F.sequence(F.lit(0), (v["n"] - 1).cast("int")), lambda i: (head + i * v["stride"]).cast("int"))
    return F.when(left <= 0, F.array(F.lit(head))).otherwise(once({"n": n, "stride": stride}, every))


def key_frames(length: Column) -> Column:
    """First frame, quarters and last."""
    return F.array_distinct(F.array(F.lit(0), F.floor(length / 4).cast("int"), F.floor(length / 2).cast("int"), F.floor(length * 3 / 4).cast("int"), (length - 1).cast("int")))


def middle_frame(length: Column) -> Column:
    """The frame in the middle, the later one of two."""
    return F.floor(length / 2).cast("int")


def end_frames(length: Column) -> Column:
    """First and last frame."""
    return F.array_distinct(F.array(F.lit(0), (length - 1).cast("int")))


def picked_frames(frames: DataFrame, clip: str = "clip_id", index: str = "frame_idx") -> DataFrame:
    """Frames that the three picks take, with pick ('quarters', 'middle', 'ends') and nth, the place in the pick from 0.

    A clip's length is the number of its highest frame and one. A pick whose frame the clip does not hold is left out, a
    frame of several picks has a row for each.
    """
    lengths = frames.groupBy(clip).agg((F.max(index) + 1).alias("__n"), F.count("*").alias("n"))
    n = F.col("__n")
    one = lambda name, at: F.transform(at, lambda f, i: F.struct(F.lit(name).alias("pick"), i.alias("nth"), f.cast("long").alias("at")))
    picks = F.concat(one("quarters", key_frames(n)), one("middle", F.array(middle_frame(n))), one("ends", end_frames(n)))
    wanted = lengths.where("__n > 0").select(clip, F.explode(picks).alias("p")).select(clip, F.col("p.at").alias(index), "p.pick", "p.nth")  # eight rows for each clip
    return frames.join(wanted, [clip, index])


def frame_skip(fps: Column, total: Column, target: int = 8, least: int = 49) -> Column:
    """Frames skipped between kept ones: towards the target rate, at most 5, less where fewer than ``least`` would stay."""
    first = F.least(F.lit(5), F.greatest(F.lit(0), F.ceil(fps / target) - 1))
    ok = F.filter(F.array(*map(F.lit, range(5, -1, -1))), lambda s: (s <= first) & ((total / (s + 1) >= least) | (s == 0)))
    return F.element_at(ok, 1)


def kept_frames(fps: Column, total: Column, target: int = 8, least: int = 49) -> Column:
    """Indices of the first ``least`` frames that frame_skip keeps."""
    every = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(v["count"], F.lit(1)) - 1), lambda i: (i * v["step"]).cast("int"))
    count = lambda v: F.least(F.lit(least), F.ceil(v["total"] / v["step"])).cast("int")
    kept = once({"step": frame_skip(fps, total, target, least) + 1, "total": total}, lambda v: once({"step": v["step"], "count": count(v)}, every))
    return F.when(total > 0, kept).otherwise(F.array().cast("array<int>"))


def nearest_per_second(frames: DataFrame, most: int = 24) -> DataFrame:
    """Per clip and whole second up to the rounded last time, at most ``most`` seconds: the nearest frame, the earliest of equally near ones.

    Frames are grouped by whole second, all before 0 in one bin and all from ``most`` on in another, and a bin's first and
    last frame are all that a second can be nearest to: the last one before it and the first one from it on, over empty
    bins. So tasks reduce frames before the shuffle, and no clip is sorted. Frames without a time, or whose time is no
    number, count for nothing; a clip that ends before 0 has no second. frames: clip, t (seconds), idx.
    """
    timed = frames.where(F.col("t").isNotNull() & ~F.isnan(F.col("t").cast("double")))
    bins = F.greatest(F.lit(-1), F.least(F.lit(most), F.floor("t"))).cast("int")
    ends = timed.groupBy("clip", bins.alias("bin")).agg(F.min(F.struct("t", "idx")).alias("first"), F.max(F.struct(F.col("t"), (-F.col("idx")).alias("back"))).alias("last"))
    clips = ends.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("bin", "first", "last"))).alias("bins"), F.max("last.t").alias("top"))  # at most ``most`` + 2 bins
    upto = F.least(F.bround("top"), F.lit(most - 1)).cast("int")
    seconds = clips.where(upto >= 0).select("clip", "bins", F.explode(F.sequence(F.lit(0), upto)).alias("second"))
    before = F.try_element_at(F.filter("bins", lambda x: x["bin"] < F.col("second")), F.lit(-1))
    after = F.get(F.filter("bins", lambda x: x["bin"] >= F.col("second")), F.lit(0))
    near = seconds.select("clip", "second", before["last"].alias("b"), after["first"].alias("a"))
    take_after = F.col("b").isNull() | (F.col("a").isNotNull() & (F.col("a.t") - F.col("second") < F.col("second") - F.col("b.t")))
    return near.select("clip", "second", F.when(take_after, F.col("a.idx")).otherwise(-F.col("b.back")).alias("idx"))


def substitute_bad(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds use: a row's own key, or for a bad row a drawn good row's of its type; null where the type has none.

    Null types form a type; a null ``good`` is bad. Good rows are numbered in a shuffled order by parts of it.
    """
    rows = rows.withColumn("good", F.coalesce("good", F.lit(False)))
    ranked = with_positions(rows.where("good").select("type", key), draw(F.col(key).cast("string"), seed, "good"), key, ["type"])
    good = ranked.select(F.struct("type", F.col("position").alias("at")).alias("__pick"), F.col(key).alias("__key"))
    counts = rows.groupBy(F.col("type").alias("__type")).agg(F.count_if("good").alias("__n"))
    bad = rows.where("not good").join(counts, F.col("type").eqNullSafe(F.col("__type")))
    at = F.when(F.col("__n") > 0, F.floor(draw(F.col(key).cast("string"), seed, "bad") * F.col("__n")))
    bad = bad.withColumn("__pick", F.struct("type", at.alias("at"))).join(good, "__pick", "left").withColumn("use", F.col("__key"))
    return rows.where("good").withColumn("use", F.col(key)).unionByName(bad.select(*[f"`{c}`" for c in rows.columns], "use"))


def schedule(n_batches: int, accumulation: int, max_steps: int, resume_step: int = 0, batch_size: int = 1, processes: int = 1) -> dict[str, int]:
    """Steps an epoch, epochs, the epoch a resumed run is in, and the effective batch."""
    steps = -(-n_batches // accumulation)
    effective = batch_size * processes * accumulation
    return {"steps_per_epoch": steps, "epochs": -(-max_steps // steps), "resume_epoch": resume_step // steps, "effective_batch": effective}


def schedules(plans: DataFrame, accumulation: int, max_steps: int, batch_size: int, resume_step: int = 0, processes: int = 1) -> DataFrame:
    """The same as columns, for plans with n_batches; a plan without batches has null steps, epochs and resume_epoch."""
    steps = F.when(F.col("n_batches") > 0, F.ceil(F.col("n_batches") / accumulation)).cast("long")
    out = plans.withColumn("steps_per_epoch", steps).withColumn("epochs", F.ceil(F.lit(max_steps) / F.col("steps_per_epoch")).cast("long"))
    return out.withColumn("resume_epoch", F.floor(F.lit(resume_step) / F.col("steps_per_epoch")).cast("long")).withColumn("effective_batch", F.lit(batch_size * processes * accumulation).cast("long"))


def epoch_draws(rows: DataFrame, key: str, seed: int, epoch: int, count: Column | int, resume: int = 0) -> DataFrame:
    """``count`` draws of an epoch without replacement: whole shuffles of all rows, then the first of one more; draws before ``resume`` are done.

    A row for each draw, with draw_no; each shuffle has an order of its own. ``count`` may be a column of ``n``, the number
    of rows. Rows are counted when it runs.
    """
    total = rows.agg(F.count("*").alias("n"))
    wanted = count if isinstance(count, Column) else F.lit(count)
    total = total.select(F.col("n").alias("__total"), wanted.cast("long").alias("__count"))
    each = rows.crossJoin(F.broadcast(total)).withColumn("__round", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("__count") / F.col("__total")) - 1, F.lit(0)))))  # one row
    u = draw(F.concat_ws("/", F.col(key).cast("string"), F.col("__round")), seed, "order", epoch)
    ranked = with_positions(each, u, key, ["__round"]).withColumn("draw_no", F.col("__round") * F.col("__total") + F.col("position"))
    kept = ranked.where((F.col("draw_no") >= resume) & (F.col("draw_no") < F.col("__count")))
    return kept.drop("__round", "__u", "__n", "position", "__total", "__count")


def uniform_indices(length: Column, fps: Column, count: int = 24, seconds: int = 60) -> Column:
    """``count`` indices spread evenly over the first ``seconds`` of a clip, cut to whole ones."""
    last = F.least(length, F.floor(fps * seconds)) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * last / (count - 1)).cast("int"))


def resolution_choice(key: Column, smallest_side: Column, sizes: Sequence[int], seed: int) -> Column:
    """A drawn size below 1.25 times the batch's smallest mean side; the smallest size where none is."""
    fits = F.filter(F.array(*map(F.lit, sorted(sizes))), lambda s: s < 1.25 * smallest_side)
    fits = F.when(F.size(fits) > 0, fits).otherwise(F.array(F.lit(min(sizes))))
    return F.element_at(fits, F.floor(draw(key, seed, "size") * F.size(fits)).cast("int") + 1)


def draw_with_replacement(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``count`` draws (draw_no, key) from the rows, numbered in a shuffled order; a row may come more than once, no rows give no draws."""
    ranked = with_positions(rows.select(key), draw(F.col(key).cast("string"), seed, "number"), key, ()).select(key, F.col("position").alias("__rank"))
    total = rows.agg(F.count("*").alias("__n"))
    drawn = rows.sparkSession.range(count).withColumnRenamed("id", "draw_no").crossJoin(total)  # one row
    drawn = drawn.where("__n > 0").withColumn("__rank", F.floor(draw(F.col("draw_no").cast("string"), seed, "replace") * F.col("__n")).cast("long"))
    return drawn.join(ranked, "__rank").select("draw_no", key)


#: Weights of the ten mask modes of clips, and of the first two for single frames.
MASK_WEIGHTS = (0.05, 0.2, 0.2, 0.2, 0.05, 0.05, 0.05, 0.1, 0.05, 0.05)
STILL_WEIGHTS = (0.2, 0.8)


def between(u: Column, low: Column, high: Column) -> Column:
    """A whole number from ``low`` to below ``high`` (``low`` where that is none)."""
    return (low + F.floor(u * F.greatest(high - low, F.lit(1)))).cast("int")


def mask_plan(clips: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds the plan of an inpainting mask to clips with frames, height and width; no pixels are painted.

    mask_mode: 0 a box in all frames, 1 everything, 2 all but the first 1 to 4 frames, 3 all but as many at both ends, 4 a box in
    a run of frames, 5 single pixels of even chance, 6 a small box of its own in each of some frames, 7 an ellipse, 8 a circle, 9
    whole frames of even chance. frame_from and frame_to, x_from and x_to, y_from and y_to bound the masked part, ends excluded
    (modes 0 to 4, 7 and 8; an ellipse's box is cut at the frame's edges); boxes holds (frame, x_from, x_to, y_from, y_to) of modes
    6 and 9; coverage is the masked share, expected for mode 5 and null for 7 and 8. Columns that do not apply are null.
    """
    u = lambda purpose: draw(F.col(key).cast("string"), seed, f"mask-{purpose}")
    at = lambda i, purpose: draw(F.concat_ws("/", F.col(key).cast("string"), i.cast("string")), seed, f"mask-{purpose}")
    f, h, w = (F.col(c).cast("int") for c in ("frames", "height", "width"))
    zero, quarter = F.lit(0), lambda x: F.floor(x / 4).cast("int")
    mode = F.when(f == 1, pick_weighted(u("mode"), (0, 1), STILL_WEIGHTS)).otherwise(pick_weighted(u("mode"), tuple(range(10)), MASK_WEIGHTS))
    m = F.col("mask_mode")
    side = F.floor(F.least(h, w) / 8).cast("int"), quarter(F.least(h, w))
    rows = clips.withColumn("mask_mode", mode.cast("int")).withColumn("__cx", between(u("x"), zero, w)).withColumn("__cy", between(u("y"), zero, h))
    for c, size, purpose in (("__rx", w, "a"), ("__ry", h, "b")):  # half sides of boxes, half axes
        other = between(u("a" if purpose == "b" else purpose), *side)
        rows = rows.withColumn(c, F.when(m == 8, other).when(m == 7, between(u(purpose), *side)).otherwise(F.floor(between(u(purpose), quarter(size), quarter(size) * 3) / 2).cast("int")))
    near, cut = m.isin(0, 4, 7, 8), between(u("cut"), F.lit(1), F.lit(5))
    half = F.floor(f / 2).cast("int")
    first = F.when(m.isin(2, 3), F.least(cut, f)).when(m == 4, between(u("first"), zero, half)).otherwise(zero)
    last = F.when(m == 3, F.greatest(f - cut, F.least(cut, f))).when(m == 4, between(u("last"), half, f)).otherwise(f)
    whole = ~m.isin(5, 6, 9)
    rows = rows.withColumn("frame_from", F.when(whole, first)).withColumn("frame_to", F.when(whole, last))
    for axis, size in (("x", w), ("y", h)):
        rows = rows.withColumn(f"{axis}_from", F.when(whole, F.when(near, F.greatest(F.col(f"__c{axis}") - F.col(f"__r{axis}"), zero)).otherwise(zero)))
        rows = rows.withColumn(f"{axis}_to", F.when(whole, F.when(near, F.least(F.col(f"__c{axis}") + F.col(f"__r{axis}"), size)).otherwise(size)))

    def small(i: Column) -> Column:
        bh, bw = between(at(i, "h"), F.lit(1), quarter(h) + 1), between(at(i, "w"), F.lit(1), quarter(w) + 1)
        x, y = between(at(i, "left"), zero, w - bw + 1), between(at(i, "top"), zero, h - bh + 1)
        return F.struct(i.alias("frame"), x.alias("x_from"), (x + bw).alias("x_to"), y.alias("y_from"), (y + bh).alias("y_to"))

    all_frames = F.sequence(zero, F.greatest(f, F.lit(1)) - 1)
    count = between(u("count"), F.lit(1), F.greatest(half, F.lit(1)) + 1)
    some = F.transform(F.slice(F.array_sort(F.transform(all_frames, lambda i: F.struct(at(i, "frame").alias("u"), i.alias("i")))), 1, count), lambda x: x["i"])
    boxes = F.when(m == 6, F.transform(F.array_sort(some), small)).when(
        m == 9, F.transform(F.filter(all_frames, lambda i: at(i, "frame") > 0.5), lambda i: F.struct(i.alias("frame"), zero.alias("x_from"), w.alias("x_to"), zero.alias("y_from"), h.alias("y_to")))
    )
    area = lambda b: (b["x_to"] - b["x_from"]).cast("double") * (b["y_to"] - b["y_from"])
    covered = (F.col("frame_to") - F.col("frame_from")).cast("double") * (F.col("x_to") - F.col("x_from")) * (F.col("y_to") - F.col("y_from"))
    covered = F.when(m.isin(6, 9), F.aggregate("boxes", F.lit(0.0), lambda s, b: s + area(b))).when(m <= 4, covered)
    rows = rows.withColumn("boxes", boxes)
    return rows.withColumn("coverage", F.when(m == 5, 0.5).otherwise(covered / (f.cast("double") * h * w))).drop("__cx", "__cy", "__rx", "__ry")


def mask_plan_of_four(clips: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds the plan of an inpainting mask of four modes of equal chance to clips with frames, height and width; no pixels are painted.

    mask_mode: 0 all but the first frame, 1 all but the first and last, 2 a box in all frames, 3 a box in a run of frames. frame_from
    and frame_to, x_from and x_to, y_from and y_to bound the masked part, ends excluded; coverage is its share. A box has
    a drawn middle and sides of a quarter to below three quarters of the frame's, and is cut at its edges.
    """
    u = lambda purpose: draw(F.col(key).cast("string"), seed, f"mask4-{purpose}")
    f, h, w = (F.col(c).cast("int") for c in ("frames", "height", "width"))
    zero, half = F.lit(0), F.floor(f / 2).cast("int")
    m = F.col("mask_mode")
    rows = clips.withColumn("mask_mode", F.least(F.floor(u("mode") * 4), F.lit(3)).cast("int"))
    first = F.when(m.isin(0, 1), F.least(F.lit(1), f)).when(m == 3, between(u("first"), zero, half)).otherwise(zero)
    last = F.when(m == 1, F.greatest(f - 1, F.least(F.lit(1), f))).when(m == 3, between(u("last"), half, f)).otherwise(f)
    rows = rows.withColumn("frame_from", first).withColumn("frame_to", last)
    for axis, size in (("x", w), ("y", h)):
        quarter = F.floor(size / 4).cast("int")
        middle, reach = between(u(axis), zero, size), F.floor(between(u(f"{axis}-size"), quarter, quarter * 3) / 2).cast("int")
        rows = rows.withColumn(f"{axis}_from", F.when(m >= 2, F.greatest(middle - reach, zero)).otherwise(zero)).withColumn(f"{axis}_to", F.when(m >= 2, F.least(middle + reach, size)).otherwise(size))
    covered = (F.col("frame_to") - F.col("frame_from")).cast("double") * (F.col("x_to") - F.col("x_from")) * (F.col("y_to") - F.col("y_from"))
    return rows.withColumn("coverage", covered / (f.cast("double") * h * w))
