"""Queries of operators that the larger queries do not reach: one for each, or for a few that belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import captions as cap
from ..operators import composition as comp
from ..operators import frames as fr
from ..operators import geometry as geo
from ..operators import planning as plan
from ..operators import parts, runs, sampling
from ..operators import validate as val
from ..sources import tables
from . import analytics, views
from .analytics import draw_sql
from .views import with_views

# Frames against the first one


def _histogram_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir).select("clip_id", "frame_idx", fr.histogram(F.col("pixels"), 16, 0.0, 256.0).alias("hist"))
    f = parts.previous(fr.with_first(f, "hist"), "clip_id", "frame_idx", "hist", "previous")
    return f.select("clip_id", "frame_idx", fr.correlation(F.col("previous"), F.col("hist")).alias("adjacent"), fr.correlation(F.col("first"), F.col("hist")).alias("versus_first"))


def _corr_sql(a: str, b: str) -> str:
    """64 pixels in 16 bins: every histogram's mean is 4."""
    cov = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - 4) * (z[2] - 4)))"
    return f"CASE WHEN {a} IS NULL THEN NULL WHEN {cov(a, a)} * {cov(b, b)} > 0 THEN {cov(a, b)} / sqrt({cov(a, a)} * {cov(b, b)}) ELSE 1.0 END::DOUBLE"


HISTOGRAMS = f"""h AS (SELECT clip_id, frame_idx, list_transform(range(0, 16), lambda i: len(list_filter(pixels,
  lambda x: least(floor(x * 16 / 256), 15)::INT = i))::DOUBLE) AS hist FROM frames),
g AS (SELECT h.*, lag(h.hist) OVER (PARTITION BY h.clip_id ORDER BY h.frame_idx) AS previous, z.hist AS first FROM h LEFT JOIN h z ON z.clip_id = h.clip_id AND z.frame_idx = 0),
m AS (SELECT clip_id, frame_idx, {_corr_sql("previous", "hist")} AS adjacent, {_corr_sql("first", "hist")} AS versus_first FROM g),
drift AS (SELECT clip_id, count(*) AS frames, avg(round(adjacent, 4)) AS adjacent_mean, arg_min(round(versus_first, 4), frame_idx) AS first,
  arg_max(round(versus_first, 4), frame_idx) AS last FROM m GROUP BY clip_id)"""


def first_frame_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram correlation of adjacent frames, and of the last frame with the first."""
    out = fr.first_frame_drift(_histogram_metrics(spark, sf_dir))
    return out.select("clip_id", "frames", F.round("adjacent_mean", 5).alias("adjacent_mean"), "first", "last", "palette_drift")


FIRST_FRAME_DRIFT = with_views(f"+{HISTOGRAMS} SELECT clip_id, frames, round(adjacent_mean, 5) AS adjacent_mean, first, last, round(first - last, 4) AS palette_drift FROM drift", "frames")


def versus_first_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference and PSNR of every frame against its clip's first."""
    f = fr.with_first(views.frames(spark, sf_dir))
    a, b = F.col("first"), F.col("pixels")
    return f.select("clip_id", "frame_idx", F.round(fr.mean_abs_diff(a, b), 3).alias("mad"), F.round(fr.psnr_exact(a, b), 4).alias("psnr"))


VERSUS_FIRST = with_views(
    """+d AS (SELECT f.clip_id, f.frame_idx, list_transform(list_zip(z.pixels, f.pixels), lambda p: p[1] - p[2]) AS d FROM frames f JOIN frames z ON z.clip_id = f.clip_id
  AND z.frame_idx = 0),
e AS (SELECT *, list_avg(list_transform(d, lambda x: x * x)) AS mse FROM d)
SELECT clip_id, frame_idx, round(list_avg(list_transform(d, lambda x: abs(x))), 3) AS mad,
  round(CASE WHEN mse < 1e-8 THEN 99.0 ELSE 20 * log10(255.0::DOUBLE / sqrt(mse)) END, 4) AS psnr FROM e""",
    "frames",
)


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each clip, and some without metrics, compared by similarity, palette drift and what is left of the first frame."""
    m = _histogram_metrics(spark, sf_dir)
    labels = views.table(spark, sf_dir, "embeddings").select(F.explode(F.array("label", F.col("label") + 1000)).alias("clip_id")).distinct()
    chosen = labels.select(F.concat(F.lit("run"), F.col("clip_id")).alias("run"), "clip_id")
    out = runs.compare_runs(chosen, fr.summary(m.withColumnRenamed("adjacent", "similarity")), fr.first_frame_drift(m))
    return out.select("run", F.round("mean", 5).alias("mean"), F.round("least", 4).alias("least"), "palette_drift", "last", "flag")


RUN_COMPARISON = with_views(
    f"""+{HISTOGRAMS}, s AS (SELECT clip_id, avg(round(adjacent, 4)) AS mean, min(round(adjacent, 4)) AS least FROM m WHERE adjacent IS NOT NULL GROUP BY clip_id),
r AS (SELECT DISTINCT unnest([label, label + 1000]) AS clip_id FROM embeddings)
SELECT 'run' || r.clip_id AS run, round(mean, 5) AS mean, least, round(first - last, 4) AS palette_drift, last, CASE WHEN last > 0.7 THEN 'good' WHEN last > 0.5 THEN 'fading'
  WHEN last IS NOT NULL THEN 'LOST' END AS flag
FROM r LEFT JOIN s ON s.clip_id = r.clip_id LEFT JOIN drift d ON d.clip_id = r.clip_id""",
    "frames",
)


def clip_macro_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over clips of their mean PSNR against quantised frames, frames of no number left out."""
    f = views.frames(spark, sf_dir)
    rebuilt = f.select("clip_id", "frame_idx", F.transform("pixels", lambda p: 16 * F.floor(p / 16 + 0.5)).alias("pixels"))
    scored = fr.reconstruction(f, rebuilt).select("clip_id", F.when(F.col("frame_idx") % 7 == 0, float("nan")).otherwise(fr.psnr(F.col("a"), F.col("b"))).alias("psnr"))
    return fr.macro_mean(scored, "psnr").select(F.round("macro", 6).alias("macro"), "clips")


MACRO_MEANS = with_views(
    """+e AS (SELECT clip_id, 10 * log10(65025.0::DOUBLE / list_avg(list_transform(pixels, lambda p: (p - 16 * floor(p / 16 + 0.5)) * (p - 16 * floor(p / 16 + 0.5))))) AS psnr
  FROM frames WHERE frame_idx % 7 <> 0),
c AS (SELECT clip_id, avg(psnr) AS m FROM e GROUP BY clip_id) SELECT round(avg(m), 6) AS macro, count(*) AS clips FROM c""",
    "frames",
)


def loop_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every clip's first and last frame."""
    return fr.loop_closure(views.frames(spark, sf_dir), 8, 8, 0.5).withColumn("ssim", F.round("ssim", 6))


LOOP_CLOSURE = with_views(
    f"""+pairs AS (SELECT clip_id, 0 AS frame_idx, arg_min(pixels, frame_idx) AS a, arg_max(pixels, frame_idx) AS b FROM frames GROUP BY clip_id), {analytics.STRUCTURE}
SELECT clip_id, round(ssim, 6) AS ssim, ssim >= 0.5 AS closed FROM scores""",
    "frames",
)


def reconstruction_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and least SSIM by clip of frames against their quantised form."""
    f = views.frames(spark, sf_dir)
    rebuilt = f.select("clip_id", "frame_idx", F.transform("pixels", lambda p: 16 * F.floor(p / 16 + 0.5).cast("double")).alias("pixels"))
    out = fr.quality_by_clip(fr.structural(fr.reconstruction(f, rebuilt), 8, 8), ["ssim"])
    return out.select("clip_id", F.round("ssim_mean", 6).alias("ssim_mean"), F.round("ssim_least", 6).alias("ssim_least"), "frames")


RECONSTRUCTION_SIMILARITY = with_views(
    f"""+pairs AS (SELECT clip_id, frame_idx, pixels AS a, list_transform(pixels, lambda p: 16 * floor(p / 16 + 0.5)) AS b FROM frames), {analytics.STRUCTURE}
SELECT clip_id, round(avg(ssim), 6) AS ssim_mean, round(min(ssim), 6) AS ssim_least, count(*) AS frames FROM scores GROUP BY clip_id""",
    "frames",
)

# Checkpoints and runs


def checkpoint_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By root: what 'latest', 'final' and a step resolve to, where some roots hold final weights of their own and some hold these alone."""
    c = views.checkpoints(spark, sf_dir).select("root", "path", "has_weights")
    own = c.where("root % 3 = 0").select("root", F.lit("").alias("path"), F.lit(True).alias("has_weights")).distinct()
    alone = views.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("root"), F.lit("").alias("path"), (F.col("r_regionkey") % 2 == 0).alias("has_weights"))
    found = runs.find_checkpoints(c.unionByName(own).unionByName(alone))
    latest = runs.resolve_checkpoint(found, "latest").select("root", F.col("label").alias("latest"), "available")
    final = runs.resolve_checkpoint(found, "final").select("root", F.col("label").alias("final"))
    exact = runs.resolve_checkpoint(found, 33).select("root", F.col("found").alias("has_33"), F.col("path").alias("path_33"), "alternatives")
    return latest.join(final, "root").join(exact, "root")


CHECKPOINT_RESOLUTION = with_views(
    """+f AS (SELECT root, step, has_weights FROM checkpoints UNION ALL SELECT DISTINCT root, NULL::BIGINT, true FROM checkpoints WHERE root % 3 = 0
  UNION ALL SELECT r_regionkey + 100, NULL, r_regionkey % 2 = 0 FROM region), g AS (SELECT * FROM f WHERE has_weights)
SELECT root, coalesce('checkpoint-' || max(step), 'final') AS latest, count(step) AS available, CASE WHEN bool_or(step IS NULL) THEN 'final' ELSE 'checkpoint-' || max(step) END AS final,
  coalesce(bool_or(step = 33), false) AS has_33, CASE WHEN coalesce(bool_or(step = 33), false) THEN 'checkpoint-33' END AS path_33,
  CASE WHEN NOT coalesce(bool_or(step = 33), false) THEN coalesce(array_to_string(list_sort(list(DISTINCT step) FILTER (step IS NOT NULL)), ', '), '') END AS alternatives
  FROM g GROUP BY root""",
    "checkpoints",
)


def checkpoint_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By root: what a folder that holds weights resolves to, and what one that does not."""
    found = runs.find_checkpoints(views.checkpoints(spark, sf_dir).select("root", "path", "has_weights"))
    folders = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("/kept/checkpoint-"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "/").otherwise("")).alias("path"),
        (F.col("o_orderkey") % 32 < 4).alias("has_weights"))
    there = runs.resolve_checkpoint(found, "/kept/checkpoint-34//", folders).select("root", "step", "path", "label", "found", "alternatives")
    gone = runs.resolve_checkpoint(found, "/kept/checkpoint-7", folders).select("root", F.col("found").alias("found_7"), F.length("alternatives").cast("long").alias("listed_7"))
    return there.join(gone, "root")


CHECKPOINT_FOLDERS = with_views(
    """+g AS (SELECT root, list_sort(list(DISTINCT step)) AS steps FROM checkpoints WHERE has_weights GROUP BY root),
f AS (SELECT max(o_orderkey = 34) AS yes FROM orders), x AS (SELECT root, array_to_string(steps, ', ') AS listed, yes FROM g, f)
SELECT root, CASE WHEN yes THEN 34 END::BIGINT AS step, CASE WHEN yes THEN '/kept/checkpoint-34/' END AS path, CASE WHEN yes THEN 'checkpoint-34' END AS label, yes AS found,
  CASE WHEN NOT yes THEN listed END AS alternatives, false AS found_7, length(listed)::BIGINT AS listed_7 FROM x""",
    "checkpoints",
)


def run_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that are over: by what their log says, or by their planned number of steps."""
    lines = analytics.log_lines(spark, sf_dir)
    said = lines.where("line_no = 1 and run % 5 = 0").select("run", F.lit(0).alias("line_no"), F.lit("INFO end_training called").alias("value"))
    points = runs.log_points(lines)
    total = points.groupBy("run").agg((F.max("step") + F.col("run") % 2).alias("total_steps")).where("run % 3 > 0")
    return runs.completion(lines.unionByName(said), points, total).select("run", "steps_reached", "total_steps", "completed")


RUN_COMPLETION = """WITH n AS (SELECT user_id AS run, count(*) AS n FROM events GROUP BY ALL)
SELECT run, n AS steps_reached, CASE WHEN run % 3 > 0 THEN n + run % 2 END AS total_steps, run % 5 = 0 OR (run % 3 > 0 AND run % 2 = 0) AS completed FROM n"""


def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first match of named fields by run."""
    lines = analytics.log_lines(spark, sf_dir)
    return runs.named_fields(lines, {"first_step": r"^(\d+)/", "total": r"/(\d+) \[", "minutes": r"\[0*(\d+):", "absent": r"epoch (\d+)"})


LOG_FIELDS = "SELECT user_id AS run, 1::BIGINT AS first_step, count(*) AS total, 0::BIGINT AS minutes, NULL::BIGINT AS absent FROM events GROUP BY user_id"


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OK where a run left with 0 and its output is there; adapter scale."""
    o = views.table(spark, sf_dir, "orders")
    given = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("exit_code"), F.concat(F.lit("out/"), F.col("o_orderkey")).alias("output"),
        (F.col("o_orderkey") % 5).alias("rank"))
    there = views.table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.concat(F.lit("out/"), F.col("l_orderkey")).alias("path"))
    scale = F.when(F.col("rank") > 0, runs.effective_scale(F.lit(32.0), F.col("rank")))
    return val.run_status(given, there).select("o_orderkey", "status", F.round(scale, 6).alias("scale"))


RUN_STATES = """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) THEN 'OK' ELSE 'FAILED' END AS status,
  round(CASE WHEN o_orderkey % 5 > 0 THEN 32.0::DOUBLE / (o_orderkey % 5) END, 6) AS scale FROM orders"""


# Samples


def frame_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices between dropped ends, a single frame, and the frames that a target rate keeps."""
    p = views.probes(spark, sf_dir).withColumn("n", F.when(F.col("p_partkey") % 9 == 0, 3).otherwise(F.col("nb_read_frames")))
    key, text = F.col("p_partkey").cast("string"), lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    dropped = sampling.dropped_ends_indices(F.col("n"), 16, 3, 0.1, 0.9, sampling.draw(key, 7, "ends"))
    return p.select("p_partkey", text(dropped).alias("dropped_ends"), sampling.single_frame(F.col("n"), sampling.draw(key, 7, "one")).alias("single"),
        text(sampling.kept_frames(F.lit(30), F.col("n"))).alias("kept"))


FRAME_DRAWS = with_views(
    f"""+x AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 3 ELSE nb_read_frames END AS n, {draw_sql("ends", "p_partkey")} AS u, {draw_sql("one", "p_partkey")} AS v FROM probes),
y AS (SELECT *, least(16, floor(floor(n * 0.8::DOUBLE) / 3))::INT AS m, floor(n * 0.9::DOUBLE)::INT AS e FROM x),
  z AS (SELECT *, least(e, (m - 1) * 3 + 1) AS span, floor(0.1::DOUBLE * e)::INT AS low FROM y),
s AS (SELECT *, CASE WHEN e = span THEN 0 ELSE low + least(floor(u * (e - span - low + 1)), e - span - low)::INT END AS st,
  CASE WHEN n / 4.0 >= 49 THEN 4 WHEN n / 3.0 >= 49 THEN 3 WHEN n / 2.0 >= 49 THEN 2 ELSE 1 END AS step FROM z)
SELECT p_partkey, CASE WHEN m > 0 THEN array_to_string(list_transform(range(0, m),
  lambda i: (st + CASE WHEN m > 1 THEN floor(i * (span - 1) / greatest(m - 1, 1)::DOUBLE) ELSE 0 END)::INT), ',') END AS dropped_ends,
  least(floor(v * n), n - 1)::INT AS single, array_to_string(list_transform(range(0, least(49, ceil(n / step::DOUBLE))::INT), lambda i: i * step), ',') AS kept FROM s""",
    "probes",
)


def epoch_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffled epoch of one and a half times all rows, resumed at draw 10."""
    d = views.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.epoch_draws(d, "doc_id", 7, 1, F.floor(F.col("n") * 3 / 2), 10).select("doc_id", "draw_no")


EPOCH_DRAWS = """WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, unnest([0, 1]) AS round FROM documents),
u AS (SELECT *, ('0x' || substr(md5('order:7:1:' || doc_id || '/' || round), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM r),
d AS (SELECT doc_id, round * n + row_number() OVER (PARTITION BY round ORDER BY u, doc_id) - 1 AS draw_no, n FROM u, n) SELECT doc_id, draw_no FROM d WHERE draw_no >= 10
  AND draw_no < n * 3 // 2"""


def replaced_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws with replacement as there are rows."""
    d = views.table(spark, sf_dir, "documents").select("doc_id")
    return sampling.draw_with_replacement(d, "doc_id", d.count(), 7)


REPLACED_DRAWS = f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {draw_sql("number", "doc_id")}, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents),
d AS (SELECT draw_no, {draw_sql("replace", "draw_no")} AS u FROM (SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS draw_no))
SELECT draw_no, doc_id FROM d JOIN r ON k = floor(u * n)::BIGINT"""


def picked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters, middle, first and last frames of clips, with their mean brightness; every 40th frame is not held."""
    f = views.frames(spark, sf_dir).where("frame_idx % 40 <> 30")
    mean = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x) / F.size("pixels")
    return sampling.picked_frames(f).select("clip_id", "frame_idx", "pick", "nth", F.round(mean, 4).alias("mean"))


PICKED_FRAMES = with_views(
    """+f AS (SELECT * FROM frames WHERE frame_idx % 40 <> 30), l AS (SELECT clip_id, max(frame_idx) + 1 AS n FROM f GROUP BY clip_id),
p AS (SELECT clip_id, 'quarters' AS pick, unnest([0, 1, 2, 3, 4]) AS nth, unnest([0, n // 4, n // 2, n * 3 // 4, n - 1]) AS frame_idx FROM l
  UNION ALL SELECT clip_id, 'middle', 0, n // 2 FROM l UNION ALL SELECT clip_id, 'ends', unnest([0, 1]), unnest([0, n - 1]) FROM l)
SELECT p.clip_id, p.frame_idx, pick, nth, round(list_avg(pixels), 4) AS mean FROM p JOIN f ON f.clip_id = p.clip_id AND f.frame_idx = p.frame_idx""",
    "frames",
)


def four_mode_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inpainting masks of four modes planned for every probe; some clips have one or two frames."""
    p, key = views.probes(spark, sf_dir), F.col("p_partkey")
    p = p.withColumn("frames", F.when(key % 13 < 2, key % 13 + 1).otherwise(F.col("nb_read_frames")))
    out = sampling.mask_plan_of_four(p, "p_partkey", 7)
    return out.select("p_partkey", "mask_mode", "frame_from", "frame_to", "x_from", "x_to", "y_from", "y_to", "coverage")


def _four_sql() -> str:
    u = lambda purpose: draw_sql(f"mask4-{purpose}", "p_partkey")
    among = lambda x, low, high: f"({low} + floor({x} * greatest({high} - ({low}), 1))::INT)"
    axes = ", ".join(f"{among(u(a), '0', size)} AS c{a}, {among(u(f'{a}-size'), f'{size} // 4', f'{size} // 4 * 3')} // 2 AS r{a}" for a, size in (("x", "width"), ("y", "height")))
    sides = ", ".join(f"CASE WHEN m < 2 THEN 0 ELSE greatest(c{a} - r{a}, 0) END AS {a}_from, CASE WHEN m < 2 THEN {s} ELSE least(c{a} + r{a}, {s}) END AS {a}_to" for a,
        s in (("x", "width"), ("y", "height")))
    return f"""+p AS (SELECT *, (CASE WHEN p_partkey % 13 < 2 THEN p_partkey % 13 + 1 ELSE nb_read_frames END)::INT AS f, least(floor({u("mode")} * 4), 3)::INT AS m FROM probes),
q AS (SELECT *, {axes}, {among(u("first"), "0", "f // 2")} AS a, {among(u("last"), "f // 2", "f")} AS b FROM p),
r AS (SELECT p_partkey, m AS mask_mode, f, width, height, CASE WHEN m < 2 THEN least(1, f) WHEN m = 3 THEN a ELSE 0 END AS frame_from,
  CASE WHEN m = 1 THEN greatest(f - 1, least(1, f)) WHEN m = 3 THEN b ELSE f END AS frame_to, {sides} FROM q)
SELECT p_partkey, mask_mode, frame_from, frame_to, x_from, x_to, y_from, y_to,
  (frame_to - frame_from)::DOUBLE * (x_to - x_from) * (y_to - y_from) / (f::DOUBLE * height * width) AS coverage FROM r"""


FOUR_MODE_MASKS = with_views(_four_sql(), "probes")


def order_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines ranked by quantity, the largest first, then by discount, of which some are missing: most share their rank with many."""
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_orderkey") % 5 > 0, F.col("l_discount")).alias("discount"))
    return runs.rank_by(li, (("l_quantity", True), ("discount", False))).select("l_orderkey", "l_linenumber", "rank")


ORDER_RANKING = """SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity DESC, CASE WHEN l_orderkey % 5 > 0 THEN l_discount END ASC NULLS LAST) AS rank FROM lineitem"""


def spark_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss curves as lines of block characters."""
    return runs.sparkline_text(runs.log_points(analytics.log_lines(spark, sf_dir)))


SPARK_TEXTS = """WITH x AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value AS v,
  min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)
SELECT run, string_agg(substr('▁▂▃▄▅▆▇█', least(7, floor((v - lo) / (hi - lo + 1e-12::DOUBLE) * 7))::INT + 1, 1), '' ORDER BY i) AS sparkline FROM x
WHERE i % greatest(1, n // 60) = 0 GROUP BY run"""


def schedule_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, epochs and the effective batch of each type and source."""
    m = views.metadata(spark, sf_dir).groupBy("type", "source").agg(F.floor(F.count("*") / 4).cast("long").alias("n_batches"))
    return sampling.schedules(m, 2, 2500, 4, 100, 2)


SCHEDULE_PLANS = with_views(
    """+g AS (SELECT type, source, count(*) // 4 AS n_batches FROM metadata GROUP BY ALL), s AS (SELECT *, CASE WHEN n_batches > 0 THEN (n_batches + 1) // 2 END AS steps_per_epoch FROM g)
SELECT type, source, n_batches, steps_per_epoch, ceil(2500.0 / steps_per_epoch)::BIGINT AS epochs, 100 // steps_per_epoch AS resume_epoch, 16::BIGINT AS effective_batch FROM s""",
    "metadata",
)


# Geometry


def bucket_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resize and crop into the nearest bucket, and into a drawn one."""
    m = views.metadata(spark, sf_dir).select("doc_id", "height", "width")
    names = ("bucket_h", "bucket_w", "resize_h", "resize_w", "crop_x", "crop_y")
    near = geo.bucket_crop(geo.closest_bucket(m, "height", "width", 592), "height", "width").select("doc_id", *names)
    ratio = sampling.pick_weighted(sampling.draw(F.col("doc_id").cast("string"), 7, "crop"), geo.CROP_RATIOS, geo.CROP_WEIGHTS)
    drawn = geo.bucket_crop(geo.random_bucket(m, ratio, 592), "height", "width").select("doc_id", *[F.col(c).alias(f"drawn_{c}") for c in names])
    return near.join(drawn, "doc_id")


def _crop_columns(prefix: str, h: str, w: str) -> str:
    high = f"height::DOUBLE / width > {h}::DOUBLE / {w}"
    rh, rw = f"(CASE WHEN {high} THEN floor(height * {w} / width::DOUBLE) ELSE {h} END)::INT", f"(CASE WHEN {high} THEN {w} ELSE floor(width * {h} / height::DOUBLE) END)::INT"
    crop = lambda a, b, c: f"round_even(greatest({a} - {b}, 0) / 2.0, 0)::INT AS {prefix}crop_{c}"
    return f"{h} AS {prefix}bucket_h, {w} AS {prefix}bucket_w, {rh} AS {prefix}resize_h, {rw} AS {prefix}resize_w, {crop(rw, w, 'x')}, {crop(rh, h, 'y')}"


BUCKET_CROPS = with_views(
    f"""+ratios AS (SELECT * FROM (VALUES {", ".join(f"({i}, {r}::DOUBLE, {h}, {w})" for i, (r, h, w) in enumerate(geo.RATIOS_512))}) v(o, r, h, w)),
grid AS (SELECT r, (floor(h * 592 / 512.0 / 16) * 16)::INT AS h, (floor(w * 592 / 512.0 / 16) * 16)::INT AS w, o FROM ratios),
best AS (SELECT doc_id, height, width, arg_min((h, w), (abs(r - height::DOUBLE / width), o)) AS b FROM metadata, grid GROUP BY ALL),
d AS (SELECT doc_id, {analytics.crop_sql()} AS r FROM (SELECT doc_id, {draw_sql("crop", "doc_id")} AS u FROM metadata)),
x AS (SELECT doc_id, height, width, b[1] AS h1, b[2] AS w1, grid.h AS h2, grid.w AS w2 FROM best JOIN d USING (doc_id) JOIN grid ON grid.r = d.r)
SELECT doc_id, {_crop_columns("", "h1", "w1")}, {_crop_columns("drawn_", "h2", "w2")} FROM x""",
    "metadata",
)


def model_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size caps of models by their configuration; some lack a key or are no JSON."""
    p = views.table(spark, sf_dir, "part")
    whole = F.format_string('{"patch_size": %d, "sample_height": %d, "sample_width": 170, "other": 1}', F.col("p_partkey") % 3 + 1, F.col("p_size"))
    config = F.when(F.col("p_partkey") % 4 == 0, whole).when(F.col("p_partkey") % 4 == 1, '{"sample_height": 96, "sample_width": 170}').when(F.col("p_partkey") % 4 == 2,
        '{"sample_height": 90}').otherwise("none")
    return geo.read_caps(p.select("p_partkey", config.alias("config"))).select("p_partkey", "cap_h", "cap_w")


MODEL_CAPS = """SELECT p_partkey, (CASE WHEN p_partkey % 4 = 0 THEN p_size // (p_partkey % 3 + 1) * 8 * (p_partkey % 3 + 1) ELSE 768 END)::INT AS cap_h,
  (CASE WHEN p_partkey % 4 = 0 THEN 170 // (p_partkey % 3 + 1) * 8 * (p_partkey % 3 + 1) ELSE 1360 END)::INT AS cap_w FROM part"""


# Captions and metadata


def caption_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions whose identity text, where they begin with it, is a rare token."""
    c = views.captions(spark, sf_dir).withColumn("text", F.concat(F.trim("anchor"), F.lit(", "), F.trim("suffix")))
    identity = F.when(F.col("clip_id") % 3 == 0, F.lit("no such text")).otherwise(F.substring(F.trim("anchor"), 1, 12))
    return c.select("clip_id", cap.trigger_variant(F.col("text"), identity, "TRGTOK").alias("variant"))


CAPTION_VARIANTS = with_views("""SELECT clip_id, CASE WHEN clip_id % 3 = 0 THEN anchor || ', ' || suffix
  ELSE 'TRGTOK' || substr(anchor || ', ' || suffix, length(substr(anchor, 1, 12)) + 1) END AS variant FROM captions""", "captions")


def captions_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos with the first caption of their stem."""
    d = views.table(spark, sf_dir, "documents")
    videos = d.select(F.concat(F.lit("vids/a.b/"), F.col("doc_id"), F.lit(".mp4")).alias("path"))
    one = d.where("doc_id % 4 > 0").select(F.concat(F.lit("cap/"), F.col("doc_id"), F.lit(".txt")).alias("file_path"), F.col("doc_id").alias("ord"), F.col("lang").alias("text"))
    two = d.where("doc_id % 3 > 0").select(F.concat(F.lit("more/"), F.col("doc_id"), F.lit(".srt")).alias("file_path"), (1000 - F.col("doc_id")).alias("ord"), F.col("source").alias("text"))
    return cap.by_stem(videos, one.unionByName(two)).select("path", "stem", "text")


CAPTIONS_BY_STEM = """SELECT 'vids/a.b/' || doc_id || '.mp4' AS path, doc_id::VARCHAR AS stem,
  CASE WHEN doc_id % 4 > 0 AND (doc_id % 3 = 0 OR doc_id <= 1000 - doc_id) THEN lang WHEN doc_id % 3 > 0 THEN source END AS text FROM documents"""


def clip_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips joined to their captions, and captions added where none was: those that are there stay."""
    m, d = views.metadata(spark, sf_dir), views.table(spark, sf_dir, "documents")
    clips = m.select(F.col("doc_id").alias("clip_id"), "type")
    given = d.where("doc_id % 4 > 0").select(F.col("doc_id").alias("clip_id"), F.col("lang").alias("text"))
    joined = cap.clip_captions(clips, given.unionByName(given))
    stubs = plan.insert_absent(given, d.select(F.col("doc_id").alias("clip_id"), F.lit("stub").alias("text")), "clip_id")
    return joined.join(stubs.select("clip_id", F.col("text").alias("filled")), "clip_id")


CLIP_CAPTIONS = with_views(
    """SELECT m.doc_id AS clip_id, m.type, CASE WHEN m.doc_id % 4 > 0 THEN d.lang END AS text, CASE WHEN m.doc_id % 4 > 0 THEN d.lang ELSE 'stub' END AS filled
FROM metadata m JOIN documents d ON d.doc_id = m.doc_id""",
    "metadata",
)


def first_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first video and the first three captions of the metadata."""
    m = views.metadata(spark, sf_dir).withColumn("ord", F.col("doc_id")).withColumn("type", F.when(F.col("doc_id") % 5 == 0, "image").when(F.col("doc_id") % 5 > 1, F.col("type")))
    few = runs.first_captions(m).select(F.lit("caption").alias("kind"), "ord", "text")
    return few.unionByName(runs.first_eligible(m, 1).select(F.lit("video").alias("kind"), "ord", "text"))


FIRST_ENTRIES = with_views(
    """SELECT * FROM (SELECT 'caption' AS kind, doc_id AS ord, text FROM metadata ORDER BY doc_id LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'video' AS kind, doc_id AS ord, text FROM metadata WHERE doc_id % 5 > 0 ORDER BY doc_id LIMIT 1)""",
    "metadata",
)


def column_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of any columns as captions and paths, converted to a training list, a Markdown row each."""
    d = views.table(spark, sf_dir, "documents").select("lang", F.concat(F.lit("clips/"), F.col("doc_id"), F.lit(".mp4")).alias("where"))
    chosen = tables.choose_columns(d)
    listed = tables.conversion(chosen.select(F.col("path").alias("file_path"), "text"), "/data/")
    return tables.markdown_rows(listed.withColumn("empty", F.lit(None).cast("string")), ("video_path", "caption", "empty"))


COLUMN_CHOICES = "SELECT '| /data/clips/' || doc_id || '.mp4 | ' || lang || ' | – |' AS row FROM documents"


# Selection and composition


def eligible_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that are long, free of text and of enough of both characters, with and without internal cuts, less those culled."""
    d = views.table(spark, sf_dir, "documents")
    c = d.select("doc_id", (F.col("doc_id") % 3 == 0).alias("has_text"), (F.col("n_chars") % 100 / 100).alias("char_frac"), (F.col("doc_id") % 4 > 0).alias("both"),
                 (F.col("n_chars") < 300).alias("too_short"), F.when(F.col("doc_id") % 11 > 0, F.col("doc_id") % 7 == 0).alias("has_internal_cuts"))
    listed = views.table(spark, sf_dir, "labels").where("toxic = 1")
    strict = val.eligible(c, allow_cuts=False).select("doc_id", F.lit(True).alias("uncut"))
    return val.cull(val.eligible(c), "doc_id", listed).select("doc_id").join(strict, "doc_id", "left").na.fill(False, ["uncut"])


ELIGIBLE_CLIPS = """SELECT doc_id, doc_id % 11 > 0 AND doc_id % 7 > 0 AS uncut FROM documents
WHERE doc_id % 3 > 0 AND n_chars % 100 >= 14 AND doc_id % 4 > 0 AND n_chars >= 300 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""


def share_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of languages against wanted ones, one of which does not occur."""
    return comp.share_gates(views.table(spark, sf_dir, "documents"), "lang", {"en": 0.6, "de": 0.25, "xx": 0.0, "fr": 0.9}, 0.15)


SHARE_GATES = """WITH t AS (SELECT count(*) AS total FROM documents), w AS (SELECT *
  FROM (VALUES ('en', 0.6::DOUBLE), ('de', 0.25::DOUBLE), ('xx', 0.0::DOUBLE), ('fr', 0.9::DOUBLE)) v(lang, wanted)),
c AS (SELECT w.lang, wanted, count(d.lang) AS n FROM w LEFT JOIN documents d ON d.lang = w.lang GROUP BY ALL), s AS (SELECT *, round(n / total::DOUBLE, 6) AS share FROM c, t)
SELECT lang, wanted, n, share, abs(share - wanted) <= 0.15::DOUBLE AS ok FROM s"""


def source_footage(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = plan.plan_clips(views.segments(spark, sf_dir)).where("verdict = 'ok'")
    return comp.footage(clips.withColumn("shot", F.col("action_label")))


SOURCE_FOOTAGE = with_views(
    """SELECT source_file, count(DISTINCT action_label) AS shots, count(*) AS clips, round(sum(out_ms / 1000.0 - in_ms / 1000.0), 3) AS footage_s,
  round(count(*)::DOUBLE / count(DISTINCT action_label), 6) AS clips_per_shot
FROM planned WHERE out_ms > in_ms GROUP BY source_file""",
    "segments",
)


def category_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File lists of categories as one, with their content types, counted."""
    f = views.files(spark, sf_dir)
    end = F.element_at(F.array(*map(F.lit, (".mp4", ".png", ".md", ".log", ".txt", ".bin"))), (F.col("page_id") % 6 + 1).cast("int"))
    part = lambda n: f.where(F.col("category") == n).select(F.concat("path", end).alias("path"))
    every = comp.all_categories({"clips": part(0), "reports": part(1), "rest": part(2).unionByName(part(3))})
    return every.groupBy("category", comp.content_type(F.col("path")).alias("type")).agg(F.count("*").alias("n"))


CATEGORY_LISTS = """SELECT CASE page_id % 4 WHEN 0 THEN 'clips' WHEN 1 THEN 'reports' ELSE 'rest' END AS category,
  CASE page_id % 6 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/markdown' WHEN 5 THEN 'application/octet-stream' ELSE 'text/plain' END AS type, count(*) AS n
  FROM pages GROUP BY ALL"""


def first_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five files by path."""
    return comp.first_by_path(views.files(spark, sf_dir).select("path", "length"), 5)


FIRST_PATHS = with_views("SELECT path, length FROM files ORDER BY path LIMIT 5", "files")


def key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that lack a required key: as meant, and where an extra key hides it."""
    d = views.table(spark, sf_dir, "documents")
    keys = F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, "file_path"), F.when(F.col("doc_id") % 3 > 0, "text"), F.lit("type"), F.when(F.col("doc_id") % 5 == 0, "extra")))
    return d.select("doc_id", val.key_set_fails(keys).alias("fails"), val.key_set_fails(keys, parity=True).alias("fails_strictly"))


KEY_CHECKS = "SELECT doc_id, doc_id % 2 <> 0 OR doc_id % 3 = 0 AS fails, (doc_id % 2 <> 0 OR doc_id % 3 = 0) AND doc_id % 5 <> 0 AS fails_strictly FROM documents"


QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (first_frame_drift, FIRST_FRAME_DRIFT), (versus_first_frame, VERSUS_FIRST), (run_comparison, RUN_COMPARISON), (clip_macro_means, MACRO_MEANS), (loop_closure,
            LOOP_CLOSURE), (reconstruction_similarity, RECONSTRUCTION_SIMILARITY),
        (checkpoint_resolution, CHECKPOINT_RESOLUTION), (run_completion, RUN_COMPLETION), (log_fields, LOG_FIELDS), (run_states, RUN_STATES),
        (frame_draws, FRAME_DRAWS), (epoch_draws, EPOCH_DRAWS), (replaced_draws, REPLACED_DRAWS), (schedule_plans, SCHEDULE_PLANS), (bucket_crops, BUCKET_CROPS), (model_caps, MODEL_CAPS),
        (caption_variants, CAPTION_VARIANTS), (captions_by_stem, CAPTIONS_BY_STEM), (clip_captions, CLIP_CAPTIONS), (first_entries, FIRST_ENTRIES), (column_choices, COLUMN_CHOICES),
        (eligible_clips, ELIGIBLE_CLIPS), (share_gates, SHARE_GATES), (source_footage, SOURCE_FOOTAGE), (category_lists, CATEGORY_LISTS), (first_paths, FIRST_PATHS),
        (key_checks, KEY_CHECKS), (checkpoint_folders, CHECKPOINT_FOLDERS), (picked_frames, PICKED_FRAMES), (four_mode_masks, FOUR_MODE_MASKS), (order_ranking,
            ORDER_RANKING), (spark_texts, SPARK_TEXTS),
    )
}
