"""Queries of tiling, sampling, frame metrics, logs, checkpoints and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import runs, sampling, tiling
from . import views
from .views import with_views

SHOTS = """s AS (SELECT *, sum((score > 100)::INT) OVER (PARTITION BY clip ORDER BY idx) AS shot FROM series),
shots AS (SELECT clip, shot, min(idx) AS st, max(idx) AS en, count(*) AS n FROM s GROUP BY ALL)"""


def shot_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 9 frames in shots, at most 4 a shot, with the shot's length as inherited caption."""
    shots = tiling.shots(views.series(spark, sf_dir), 100)
    windows = tiling.cap_windows(tiling.tile(shots.where("n >= 9"), 9), 4).select("clip", "shot", "w_start", "w_end")
    return tiling.inherit(windows, shots.select("clip", "shot", F.concat(F.lit("shot of "), F.col("n")).alias("caption")))


SHOT_WINDOWS = with_views(f"""+{SHOTS}, w AS (SELECT clip, shot, n, st + unnest(range(0, n - 8, 9)) AS w_start FROM shots WHERE n >= 9)
SELECT clip, shot, w_start, w_start + 8 AS w_end, 'shot of ' || n AS caption FROM w QUALIFY row_number() OVER (PARTITION BY clip, shot ORDER BY w_start) <= 4""", "series")


def straddle_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-overlapping windows of 10 frames over whole clips, without those a cut lies inside of."""
    s = views.series(spark, sf_dir)
    whole = s.groupBy("clip").agg(F.min("idx").alias("start"), F.count("*").alias("n"))
    windows = tiling.tile(whole, 10, 5).select("clip", "w_start", "w_end")
    return tiling.without_straddles(windows, s.where("score > 100").select("clip", F.col("idx").alias("at")))


STRADDLE = with_views("""+n AS (SELECT clip, count(*) AS n FROM series GROUP BY clip), w AS (SELECT clip, unnest(range(0, n - 9, 5)) AS w_start FROM n WHERE n >= 10)
SELECT clip, w_start, w_start + 9 AS w_end FROM w WHERE NOT EXISTS (SELECT 1 FROM series s WHERE s.clip = w.clip AND score > 100 AND idx > w_start AND idx < w_start + 9)""", "series")


def usable_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.usable_by_length(tiling.shots(views.series(spark, sf_dir), 100), (1, 5, 9, 17, 25, 33))


USABLE_LENGTHS = with_views(f"+{SHOTS} SELECT f AS frames, count(*) FILTER (n >= f) AS shots FROM shots, (VALUES (1), (5), (9), (17), (25), (33)) v(f) GROUP BY f", "series")


def resampled_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = views.series(spark, sf_dir).groupBy("clip").agg(F.count("*").alias("n"))
    rows = tiling.resample(clips, 24, 16, F.lit(49), 16)
    return rows.groupBy("clip").agg(F.count("*").alias("frames"), F.sum("src_idx").alias("src_sum"), F.max("src_idx").alias("src_last"))


RESAMPLED = with_views("""+n AS (SELECT clip, count(*) AS n FROM series GROUP BY clip),
  r AS (SELECT clip, n, unnest(range(0, 49)) AS k FROM n WHERE floor((n - 1) * 16 / 24.0) + 1 + 16 >= 49),
x AS (SELECT clip, least(floor(k * 24 / 16.0), n - 1)::BIGINT AS src FROM r) SELECT clip, count(*) AS frames, sum(src)::BIGINT AS src_sum, max(src) AS src_last FROM x
  GROUP BY clip""", "series")


def densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.series(spark, sf_dir)
    pairs = s.withColumn("similarity", F.when(F.col("idx") % 50 != 49, F.col("similarity")))
    return tiling.densify(pairs, 2).groupBy("clip", "kind").agg(F.count("*").alias("n"))


DENSIFIED = with_views("""+p AS (SELECT clip, CASE WHEN idx % 50 <> 49 THEN similarity END AS s, unnest(range(0, 4)) AS step FROM series)
SELECT clip, CASE WHEN step = 0 THEN 'source' WHEN s IS NULL THEN 'hold' WHEN s > 0.996 THEN 'duplicate' WHEN s < 0.2 THEN 'hold' ELSE 'interpolate' END AS kind, count(*) AS n
  FROM p GROUP BY ALL""", "series")


def draw_sql(purpose: str, key: str, seed: int = 7) -> str:
    return f"(('0x' || substr(md5('{purpose}:{seed}:0:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def balanced_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos twice, images once, one source three times over, by type and source."""
    rows = sampling.balance_types(views.metadata(spark, sf_dir), 2).drop("copy")
    return sampling.oversample(rows, "source", {"src1": 3}).groupBy("type", "source").agg(F.count("*").alias("n"))


BALANCED = with_views("SELECT type, source, (sum(CASE type WHEN 'video' THEN 2 ELSE 1 END) * CASE source WHEN 'src1' THEN 3 ELSE 1 END)::BIGINT AS n FROM metadata GROUP BY type, source", "metadata")


def full_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.full_batches(views.metadata(spark, sf_dir), "doc_id", ("type", "source"), 4, 7, 0)
    return out.select("doc_id", "type", "source", F.col("position").cast("long").alias("position"), F.col("batch").cast("long").alias("batch"), F.round("batch_rank", 6).alias("batch_rank"))


FULL_BATCHES = with_views(f"""+d AS (SELECT doc_id, type, source, {draw_sql("order", "doc_id")} AS u FROM metadata),
r AS (SELECT *, row_number() OVER (PARTITION BY type, source ORDER BY u, doc_id) - 1 AS position, count(*) OVER (PARTITION BY type, source) AS n FROM d),
b AS (SELECT *, position // 4 AS batch FROM r) SELECT doc_id, type, source, position, batch, round(max(u) OVER (PARTITION BY type, source, batch), 6) AS batch_rank FROM b
  WHERE (batch + 1) * 4 <= n""", "metadata")


def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption dropout, downsampling and crop ratios of every sample."""
    from ..operators.geometry import CROP_RATIOS, CROP_WEIGHTS

    m = sampling.drop_captions(views.metadata(spark, sf_dir), "doc_id", 0.1, 7)
    key = F.col("doc_id").cast("string")
    return m.select("doc_id", (F.col("text") == "").alias("emptied"), sampling.downsample_ratio(sampling.draw(key, 7, "down"), 1024).alias("down"),
                    sampling.pick_weighted(sampling.draw(key, 7, "crop"), CROP_RATIOS, CROP_WEIGHTS).alias("crop"))


def crop_sql() -> str:
    from ..operators.geometry import CROP_RATIOS, CROP_WEIGHTS

    upto, whens = 0.0, ""
    for r, w in zip(CROP_RATIOS, CROP_WEIGHTS, strict=True):
        upto += w
        whens += f" WHEN u < {upto}::DOUBLE / {float(sum(CROP_WEIGHTS))}::DOUBLE THEN {r}"
    return f"CASE{whens} ELSE {CROP_RATIOS[-1]} END::DOUBLE"


SEEDED_DRAWS = f"""WITH x AS (SELECT doc_id, {draw_sql("caption", "doc_id")} AS c, {draw_sql("down", "doc_id")} AS d, {draw_sql("crop", "doc_id")} AS u FROM documents)
SELECT doc_id, c < 0.1 AS emptied, CASE WHEN d < 0.75 THEN 1 WHEN d < 0.75 + 0.25::DOUBLE / 3 THEN 1.25 WHEN d < 0.75 + 0.25::DOUBLE / 3 * 2 THEN 1.5 ELSE 2 END::DOUBLE AS down,
  {crop_sql()} AS crop FROM x"""


def frame_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.probes(spark, sf_dir)
    n, text = F.col("nb_read_frames"), lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return p.select("p_partkey", text(sampling.strided_indices(n, 16, 3, sampling.draw(F.col("p_partkey").cast("string"), 7, "clip"))).alias("strided"),
        text(sampling.head_tail_indices(n, 4, 4, 20)).alias("head_tail"),
                    text(sampling.key_frames(n)).alias("keys"), sampling.frame_skip(F.lit(30), n).alias("skip"))


FRAME_INDICES = with_views(f"""+x AS (SELECT p_partkey, nb_read_frames AS n, least(nb_read_frames, 46) AS span, {draw_sql("clip", "p_partkey")} AS u, nb_read_frames - 8 AS left_
  FROM probes),
y AS (SELECT *, floor(u * (n - span + 1)) AS st, CASE WHEN left_ <= 20 THEN 1 ELSE left_ // 20 END AS stride FROM x),
  z AS (SELECT *, (least((left_ + stride - 1) // stride, 20) - 1) // 4 * 4 + 1 AS m FROM y)
SELECT p_partkey, array_to_string(list_transform(range(0, 16), lambda i: (st + floor(i * (span - 1) / 15.0))::INT), ',') AS strided,
  array_to_string(list_transform(range(0, m), lambda i: 4 + i * stride), ',') AS head_tail,
  concat_ws(',', 0, n // 4, n // 2, n * 3 // 4, n - 1) AS keys, CASE WHEN n / 4.0 >= 49 THEN 3 WHEN n / 3.0 >= 49 THEN 2 WHEN n / 2.0 >= 49 THEN 1 ELSE 0 END AS skip FROM z""", "probes")


def nearest_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.nearest_per_second(views.series(spark, sf_dir).select("clip", "t", "idx"))


NEAREST_SECONDS = with_views("""+l AS (SELECT clip, least(round_even(max(t), 0), 23)::INT AS last FROM series GROUP BY clip),
  s AS (SELECT clip, unnest(range(0, last + 1))::INT AS second FROM l)
SELECT s.clip, second, arg_min(idx, (abs(t - second), idx)) AS idx FROM s JOIN series x ON x.clip = s.clip GROUP BY s.clip, second""", "series")


def bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.metadata(spark, sf_dir).withColumn("good", F.trim("text") != "")
    return sampling.substitute_bad(m, "doc_id", 7).select("doc_id", "type", "use")


BAD_ROWS = with_views(f"""+m AS (SELECT doc_id, type, trim(text) <> '' AS good FROM metadata),
  g AS (SELECT type, doc_id, row_number() OVER (PARTITION BY type ORDER BY {draw_sql("good", "doc_id")}, doc_id) - 1 AS k FROM m WHERE good),
n AS (SELECT type, count(*) AS n FROM g GROUP BY type) SELECT m.doc_id, m.type, CASE WHEN good THEN m.doc_id ELSE g.doc_id END AS use
FROM m JOIN n USING (type) LEFT JOIN g ON NOT m.good AND g.type = m.type AND g.k = floor({draw_sql("bad", "m.doc_id")} * n)::BIGINT""", "metadata")


def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fr.with_previous(views.frames(spark, sf_dir)).where("previous is not null")
    a, b = F.col("previous"), F.col("pixels")
    return f.select("clip_id", "frame_idx", F.round(fr.mean_abs_diff(a, b), 3).alias("mad"), F.round(fr.psnr(a, b), 4).alias("psnr"),
        F.round(fr.luminance(a[0], a[1], a[2]), 6).alias("luminance"))


FRAME_METRICS = with_views("""+p AS (SELECT *, lag(pixels) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS q FROM frames),
d AS (SELECT clip_id, frame_idx, q, list_transform(list_zip(q, pixels), lambda z: z[1] - z[2]) AS d FROM p WHERE q IS NOT NULL)
SELECT clip_id, frame_idx, round(list_avg(list_transform(d, lambda x: abs(x))), 3) AS mad, round(10 * log10(65025.0::DOUBLE / list_avg(list_transform(d, lambda x: x * x))), 4) AS psnr,
  round((0.299::DOUBLE * q[1] + 0.587::DOUBLE * q[2] + 0.114::DOUBLE * q[3]) / 255, 6) AS luminance FROM d""", "frames")


def reconstruction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and least PSNR by clip of frames against their quantised form, joined on clip and frame."""
    f = views.frames(spark, sf_dir)
    r = f.select("clip_id", "frame_idx", F.transform("pixels", lambda p: 16 * F.floor(p / 16 + 0.5)).alias("pixels"))
    both = fr.quality_by_clip(fr.reconstruction(f, r).withColumn("psnr", fr.psnr(F.col("a"), F.col("b"))), ["psnr"])
    return both.select("clip_id", F.round("psnr_mean", 4).alias("mean"), F.round("psnr_least", 4).alias("least"), "frames")


RECONSTRUCTION = with_views("""+e AS (SELECT clip_id, 10 * log10(65025.0::DOUBLE / list_avg(list_transform(pixels,
  lambda p: (p - 16 * floor(p / 16 + 0.5)) * (p - 16 * floor(p / 16 + 0.5))))) AS psnr FROM frames)
SELECT clip_id, round(avg(psnr), 4) AS mean, round(min(psnr), 4) AS least, count(*) AS frames FROM e GROUP BY clip_id""", "frames")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.series(spark, sf_dir).select(F.col("clip").alias("clip_id"), F.col("idx").alias("frame_idx"), "similarity", F.col("score").alias("motion"))


def consistency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    out = fr.summary(m).join(fr.worst_pair(m).select("clip_id", F.col("frame_idx").alias("worst")), "clip_id").join(fr.drift(m), "clip_id").join(fr.smoothness(m, 10), "clip_id")
    near = lambda c: F.signum(c) * F.floor(F.abs(c) * 1e5 + 0.5) / 1e5  # noqa: E731  # the double itself, not its shortest decimal
    return out.select("clip_id", "pairs", "worst", *[near(c).alias(c) for c in ("mean", "least", "deviation", "drift", "jerk", "held")])


CONSISTENCY = with_views("""+x AS (SELECT *, round(similarity, 4) AS s, row_number() OVER (PARTITION BY clip ORDER BY idx) AS rn, count(*) OVER (PARTITION BY clip) AS n,
  abs(score - 2 * lag(score) OVER (PARTITION BY clip ORDER BY idx) + lag(score, 2) OVER (PARTITION BY clip ORDER BY idx)) AS j FROM series)
SELECT clip AS clip_id, count(*) AS pairs, arg_min(idx, (similarity, idx)) AS worst, round(avg(s), 5) AS mean, round(min(s), 5) AS least, round(stddev_pop(s), 5) AS deviation,
  round(abs(avg(similarity) FILTER (rn <= greatest(floor(n * 0.15), 1)) - avg(similarity) FILTER (rn > n - greatest(floor(n * 0.15), 1))), 5) AS drift, round(avg(j), 5) AS jerk,
  round(avg((score < 10)::INT), 5) AS held FROM x GROUP BY clip""", "series")


def flicker_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.flicker(_metrics(spark, sf_dir)).select("clip_id", "frame_idx", F.round("bound", 5).alias("bound"))


FLICKER = with_views("""+x AS (SELECT clip AS clip_id, idx AS frame_idx, round(similarity, 4) AS s, avg(round(similarity, 4)) OVER w AS m,
  stddev_pop(round(similarity, 4)) OVER w AS d FROM series WINDOW w AS (PARTITION BY clip))
SELECT clip_id, frame_idx, round(m - 2 * CASE WHEN d = 0 THEN 1e-9 ELSE d END, 5) AS bound FROM x WHERE s < m - 2 * CASE WHEN d = 0 THEN 1e-9 ELSE d END""", "series")


def structural_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SSIM, edge SSIM and flat-area error of adjacent frames."""
    f = fr.with_previous(views.frames(spark, sf_dir)).where("previous is not null")
    out = fr.structural(f.select("clip_id", "frame_idx", F.col("previous").alias("a"), F.col("pixels").alias("b")), 8, 8)
    return out.select("clip_id", "frame_idx", *[F.round(c, 6).alias(c) for c in ("ssim", "edge_ssim", "flat_mae")])


#: Blur and edges of 8 x 8 images as weights of a source pixel (src) for a pixel (pos), borders mirrored; then both similarities of the pairs (clip_id, frame_idx, a, b).
STRUCTURE = """px AS (SELECT clip_id, frame_idx, j::INT AS pos, a[j + 1] AS a, b[j + 1] AS b FROM pairs, range(64) t(j)),
taps AS (SELECT d, exp(-d * d / 4.5::DOUBLE) / sum(exp(-d * d / 4.5::DOUBLE)) OVER () AS w FROM range(-5, 6) t(d)),
line AS (SELECT y, abs((y + d + 7) % 14 - 7) AS s, sum(w) AS w FROM range(8) t(y), taps GROUP BY ALL),
blur AS (SELECT (r.y * 8 + c.y)::INT AS pos, (r.s * 8 + c.s)::INT AS src, r.w * c.w AS w FROM line r, line c),
edge AS (SELECT (y * 8 + x)::INT AS pos, (abs((y + dy + 7) % 14 - 7) * 8 + abs((x + dx + 7) % 14 - 7))::INT AS src, dx * (2 - abs(dy)) AS wx, dy * (2 - abs(dx)) AS wy
  FROM range(8) t(y), range(8) u(x), range(-1, 2) v(dy), range(-1, 2) z(dx)),
e AS (SELECT clip_id, frame_idx, edge.pos, sqrt(pow(sum(wx * a), 2) + pow(sum(wy * a), 2)) AS ea, sqrt(pow(sum(wx * b), 2) + pow(sum(wy * b), 2)) AS eb
  FROM px JOIN edge ON edge.src = px.pos GROUP BY ALL),
top AS (SELECT *, max(ea) OVER (PARTITION BY clip_id, frame_idx) AS top FROM e),
kinds AS (SELECT clip_id, frame_idx, 'ssim' AS kind, pos, a, b, 255.0::DOUBLE AS r FROM px UNION ALL SELECT clip_id, frame_idx, 'edge', pos, ea, eb, greatest(top, 1e-6) FROM top),
means AS (SELECT clip_id, frame_idx, kind, blur.pos, any_value(r) AS r, sum(w * a) AS ma, sum(w * b) AS mb, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab
  FROM kinds JOIN blur ON blur.src = kinds.pos GROUP BY ALL),
terms AS (SELECT clip_id, frame_idx, kind, (2 * ma * mb + pow(0.01 * r, 2)) * (2 * (ab - ma * mb) + pow(0.03 * r, 2))
  / ((ma * ma + mb * mb + pow(0.01 * r, 2)) * ((aa - ma * ma) + (bb - mb * mb) + pow(0.03 * r, 2))) AS s FROM means),
scores AS (SELECT clip_id, frame_idx, avg(s) FILTER (kind = 'ssim') AS ssim, avg(s) FILTER (kind = 'edge') AS edge_ssim FROM terms GROUP BY ALL),
calm AS (SELECT clip_id, frame_idx, avg(abs(a - b)) FILTER (ea < 0.06 * top + 1e-6) AS flat_mae FROM top JOIN px USING (clip_id, frame_idx, pos) GROUP BY ALL)"""

STRUCTURAL = with_views(f"""+p AS (SELECT clip_id, frame_idx, lag(pixels) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS a, pixels AS b FROM frames),
pairs AS (SELECT * FROM p WHERE a IS NOT NULL), {STRUCTURE}
SELECT clip_id, frame_idx, round(ssim, 6) AS ssim, round(edge_ssim, 6) AS edge_ssim, round(flat_mae, 6) AS flat_mae FROM scores JOIN calm USING (clip_id, frame_idx)""", "frames")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id")
    n, total = F.row_number().over(w.orderBy("ts", "event_id")), F.count("*").over(w)
    text = F.concat(n, F.lit("/"), total, F.lit(" ["), F.lpad(F.floor(n / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"),
        F.lit("<0:00, 1.00s/it, loss="), F.col("value"), F.lit(", lr="), F.col("value") / 1e6, F.lit("]"))
    return e.select(F.col("user_id").alias("run"), n.alias("line_no"), text.alias("value"))


def loss_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir)
    curve = runs.loss_curve(runs.log_points(lines)).join(runs.elapsed(lines), "run")
    return curve.select("run", "steps_reached", "loss_first", "loss_last", "loss_min", F.round("loss_tail", 5).alias("loss_tail"), F.round("lr_last", 9).alias("lr_last"),
        "elapsed_last", "s_per_it")


LOSS_CURVES = """WITH x AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n, value AS v FROM events)
SELECT run, max(i) AS steps_reached, arg_min(v, i) AS loss_first, arg_max(v, i) AS loss_last, min(v) AS loss_min, round(avg(v) FILTER (i > n - 50), 5) AS loss_tail,
  round(arg_max(v, i) / 1e6, 9) AS lr_last,
  lpad((max(i) // 60)::VARCHAR, 2, '0') || ':' || lpad((max(i) % 60)::VARCHAR, 2, '0') AS elapsed_last, 1.0::DOUBLE AS s_per_it FROM x GROUP BY run"""


def sparklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sparkline(runs.log_points(log_lines(spark, sf_dir))).groupBy("run").agg(F.count("*").alias("points"), F.sum("level").alias("levels"))


SPARKLINES = """WITH x AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value AS v FROM events),
y AS (SELECT *, min(v) OVER (PARTITION BY run) AS lo, max(v) OVER (PARTITION BY run) AS hi FROM x)
SELECT run, count(*) AS points, sum(least(7, floor((v - lo) / (hi - lo + 1e-12::DOUBLE) * 7)))::BIGINT AS levels FROM y WHERE i % greatest(1, n // 60) = 0 GROUP BY run"""


def checkpoint_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By root: latest step with weights, checkpoints kept by a limit of 5, newest by time."""
    c = runs.find_checkpoints(views.checkpoints(spark, sf_dir))
    kept = runs.retention(c, 5).groupBy("root").agg(F.count_if(~F.col("remove")).alias("kept"), F.count_if("remove").alias("removed"))
    return runs.resolve_checkpoint(c, "latest").drop("path").join(kept, "root").join(runs.newest(c), "root").select("root", "step", "available", "found", "kept", "removed", "path")


CHECKPOINT_PLAN = with_views("""SELECT root, max(step) AS step, count(*) AS available, true AS found, least(count(*), 4) AS kept, count(*) - least(count(*), 4) AS removed,
  arg_max(path, (mtime, step)) AS path FROM checkpoints WHERE has_weights GROUP BY root""", "checkpoints")


def rubric_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rubric_verdict(views.rubric(spark, sf_dir)).select("item", F.round("mean", 5).alias("mean"), "least", "passes")


RUBRIC = with_views("SELECT item, round(avg(score), 5) AS mean, min(score) AS least, avg(score) >= 3.0 AND min(score) > 1 AS passes FROM rubric GROUP BY item", "rubric")


def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    return runs.failure_rate(e.select(F.col("event_type").alias("kind"), (F.col("user_id") % 7).alias("seed"), (F.col("value") > 100).alias("failed"))).select("kind",
        F.round("rate", 6).alias("rate"), "seeds")


FAILURE_RATES = "SELECT event_type AS kind, round(avg((value > 100)::INT), 6) AS rate, count(DISTINCT user_id % 7) AS seeds FROM events GROUP BY event_type"


def run_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds ranked by least mean value, with their retention flag: a report of a few rows."""
    e = views.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    return runs.rank_by(e, (("mean", False), ("n", True))).withColumn("flag", runs.retention_flag(F.col("mean") / 100))


RUN_RANKING = """WITH e AS (SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY event_type)
SELECT *, rank() OVER (ORDER BY mean, n DESC) AS rank, CASE WHEN mean / 100 > 0.7 THEN 'good' WHEN mean / 100 > 0.5 THEN 'fading' ELSE 'LOST' END AS flag FROM e"""


def evaluation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), "text")
    return runs.evaluation_grid(runs.find_checkpoints(views.checkpoints(spark, sf_dir)), items, 10, "IDTOKEN ").select("root", "step", "ord",
        F.length("prompt").alias("prompt_chars"), "output")


EVALUATION_GRID = with_views("""SELECT root, step, item_id AS ord, length('IDTOKEN ' || text) AS prompt_chars, root || '_' || step || '_' || item_id AS output
FROM checkpoints, (SELECT * FROM benchmark ORDER BY item_id LIMIT 10) WHERE has_weights""", "checkpoints")


def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of runs, and what is read back from them."""
    p = views.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 100).alias("scale"), (F.col("p_size") % 10 + 1).cast("double").alias("guidance"))
    p = p.withColumn("label", runs.run_label(F.col("p_partkey"), F.col("scale"), F.col("guidance"), F.lit(33)))
    return p.select("p_partkey", "label", *[c.alias(k) for k, c in runs.parse_label(F.col("label")).items()])


RUN_LABELS = """SELECT p_partkey, 'ckpt' || p_partkey || '_s' || lpad(p_size::VARCHAR, 3, '0') || '_g' || ((p_size % 10 + 1) * 10) || '_f33' AS label,
  p_partkey::INT AS checkpoint, p_size / 100.0::DOUBLE AS scale, (p_size % 10 + 1)::DOUBLE AS guidance, 33 AS frames FROM part"""


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    out = runs.throughput(o.select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "F").alias("approved"),
        (F.col("o_orderkey") % 100).alias("seconds"), F.col("o_totalprice").alias("cost")))
    return out.select("kind", *[F.round(c, 4).alias(c) for c in ("success", "seconds_each", "cost_each")])


THROUGHPUT = """SELECT o_orderpriority AS kind, round(avg((o_orderstatus = 'F')::INT), 4) AS success,
  round(sum(o_orderkey % 100)::DOUBLE / count(*) FILTER (o_orderstatus = 'F'), 4) AS seconds_each,
  round(sum(o_totalprice) / count(*) FILTER (o_orderstatus = 'F'), 4) AS cost_each FROM orders GROUP BY ALL"""


def seam_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion at every ninth frame against the clip's median."""
    m = _metrics(spark, sf_dir)
    return fr.seam_ratio(m, m.where("frame_idx % 9 = 0 and frame_idx > 0")).withColumn("ratio", F.round("ratio", 5))


SEAM_RATIOS = with_views("""+m AS (SELECT clip, median(abs(score)) AS m FROM series GROUP BY clip)
SELECT clip AS clip_id, idx AS frame_idx, round(CASE WHEN m > 0 THEN abs(score) / m END, 5) AS ratio FROM series JOIN m USING (clip) WHERE idx % 9 = 0 AND idx > 0""", "series")


def uniform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 even indices, and a drawn resolution, by probe."""
    p = views.probes(spark, sf_dir)
    at = sampling.uniform_indices(F.col("nb_read_frames"), F.lit(1))
    size = sampling.resolution_choice(F.col("p_partkey").cast("string"), F.least("width", "height"), (256, 512, 768), 7)
    return p.select("p_partkey", F.array_join(F.transform(at, lambda x: x.cast("string")), ",").alias("indices"), size.alias("size"))


UNIFORM_FRAMES = with_views(f"""+x AS (SELECT p_partkey, least(nb_read_frames, 60) - 1 AS last, {draw_sql("size", "p_partkey")} AS u,
  CASE WHEN len(list_filter([256, 512, 768], lambda s: s < 1.25 * least(width, height))) > 0 THEN list_filter([256, 512, 768], lambda s: s < 1.25 * least(width, height))
  ELSE [256] END AS fits FROM probes)
SELECT p_partkey, array_to_string(list_transform(range(0, 24), lambda i: floor(i * last / 23.0)::INT), ',') AS indices, fits[floor(u * len(fits))::INT + 1] AS size FROM x""", "probes")


def carried_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 4 over three epochs, incomplete ones going on in the next epoch."""
    out = sampling.carried_batches(views.metadata(spark, sf_dir), "doc_id", ("type", "source"), 4, 7, 3)
    return out.select("doc_id", "type", "source", "epoch", "position", F.col("batch").cast("long").alias("batch"), "batch_epoch", F.round("batch_rank", 6).alias("batch_rank"))


CARRIED_BATCHES = with_views("""+e AS (SELECT doc_id, type, source, unnest([0, 1, 2]) AS epoch FROM metadata),
d AS (SELECT *, ('0x' || substr(md5('order:7:' || epoch || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY type, source ORDER BY epoch, u, doc_id) - 1 AS position, count(*) OVER (PARTITION BY type, source) AS n FROM d),
b AS (SELECT *, position // 4 AS batch FROM r), l AS (SELECT type, source, batch, max(epoch) AS batch_epoch, round(arg_max(u, (epoch, u)), 6) AS batch_rank FROM b GROUP BY ALL)
SELECT doc_id, type, source, epoch, position, batch, batch_epoch, batch_rank FROM b JOIN l USING (type, source, batch) WHERE (batch + 1) * 4 <= n""", "metadata")


def mask_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inpainting masks planned for every probe."""
    p = views.probes(spark, sf_dir).withColumn("frames", F.when(F.col("p_partkey") % 13 == 0, 1).otherwise(F.col("nb_read_frames")))
    out = sampling.mask_plan(p, "p_partkey", 7)
    listed = F.array_join(F.transform("boxes", lambda b: F.concat_ws(" ", *[b[c].cast("string") for c in ("frame", "x_from", "x_to", "y_from", "y_to")])), ",")
    return out.select("p_partkey", "mask_mode", "frame_from", "frame_to", "x_from", "x_to", "y_from", "y_to", listed.alias("boxes"), F.round("coverage", 6).alias("coverage"))


def _mask_sql() -> str:
    def u(purpose: str, key: str = "p_partkey") -> str:
        return draw_sql(f"mask-{purpose}", key)

    def at(purpose: str) -> str:
        return u(purpose, "p_partkey || '/' || i")

    def among(x: str, low: str, high: str) -> str:
        return f"({low} + floor({x} * greatest({high} - ({low}), 1))::INT)"

    upto, modes = 0.0, ""
    for k, w in enumerate(sampling.MASK_WEIGHTS):
        upto += w
        modes += f" WHEN u < {upto}::DOUBLE / {float(sum(sampling.MASK_WEIGHTS))}::DOUBLE THEN {k}"
    axis = "".join(
        f"CASE WHEN m = 8 THEN {among(u('a'), 's // 8', 's // 4')} WHEN m = 7 THEN {among(u(p), 's // 8', 's // 4')} "
        f"ELSE {among(u(p), f'{size} // 4', f'{size} // 4 * 3')} // 2 END AS r{c}, {among(u(c), '0', size)} AS c{c}, "
        for c, size, p in (("x", "w", "a"), ("y", "h", "b"))
    )
    frame_at = f"SELECT p_partkey, m, f, h, w, many, unnest(range(0, f)) AS i FROM x WHERE m IN (6, 9)"  # noqa: F541
    edge = "".join(
        f"CASE WHEN m IN (0, 4, 7, 8) THEN greatest(c{c} - r{c}, 0) WHEN m NOT IN (5, 6, 9) THEN 0 END AS {c}_from, "
        f"CASE WHEN m IN (0, 4, 7, 8) THEN least(c{c} + r{c}, {s}) WHEN m NOT IN (5, 6, 9) THEN {s} END AS {c}_to, "
        for c, s in (("x", "w"), ("y", "h"))
    )
    return f"""+v AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE nb_read_frames END AS f, height AS h, width AS w, least(height, width) AS s, {u("mode")} AS u FROM probes),
y AS (SELECT *, CASE WHEN f = 1 THEN CASE WHEN u < 0.2 THEN 0 ELSE 1 END ELSE CASE{modes} ELSE 9 END END AS m FROM v),
x AS (SELECT *, {axis}{among(u("cut"), "1", "5")} AS cut, {among(u("count"), "1", "greatest(f // 2, 1) + 1")} AS many, {among(u("first"), "0", "f // 2")} AS fst,
  {among(u("last"), "f // 2", "f")} AS lst FROM y),
i AS ({frame_at}), j AS (SELECT *, {at("frame")} AS fu, {among(at("h"), "1", "h // 4 + 1")} AS bh, {among(at("w"), "1", "w // 4 + 1")} AS bw FROM i),
k AS (SELECT *, {among(at("left"), "0", "w - bw + 1")} AS bx, {among(at("top"), "0", "h - bh + 1")} AS ly FROM j QUALIFY m = 9 AND fu > 0.5 OR m = 6
  AND row_number() OVER (PARTITION BY p_partkey ORDER BY fu, i) <= many),
b AS (SELECT p_partkey, string_agg(CASE WHEN m = 6 THEN concat_ws(' ', i, bx, bx + bw, ly, ly + bh) ELSE concat_ws(' ', i, 0, w, 0, h) END, ',' ORDER BY i) AS boxes,
  sum(CASE WHEN m = 6 THEN bw * bh ELSE w * h END)::DOUBLE AS area FROM k GROUP BY ALL),
z AS (SELECT p_partkey, m, f, h, w, {edge}CASE WHEN m IN (2, 3) THEN least(cut, f) WHEN m = 4 THEN fst WHEN m NOT IN (5, 6, 9) THEN 0 END AS frame_from,
  CASE WHEN m = 3 THEN greatest(f - cut, least(cut, f)) WHEN m = 4 THEN lst WHEN m NOT IN (5, 6, 9) THEN f END AS frame_to FROM x)
SELECT p_partkey, m AS mask_mode, frame_from, frame_to, x_from, x_to, y_from, y_to, CASE WHEN m IN (6, 9) THEN coalesce(boxes, '') END AS boxes,
  round(CASE WHEN m = 5 THEN 0.5 WHEN m IN (6, 9) THEN coalesce(area, 0) / (f::DOUBLE * h * w)
  WHEN m <= 4 THEN (frame_to - frame_from)::DOUBLE * (x_to - x_from) * (y_to - y_from) / (f::DOUBLE * h * w) END, 6) AS coverage
FROM z LEFT JOIN b USING (p_partkey)"""


MASK_PLANS = with_views(_mask_sql(), "probes")


def colour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram correlation, thumbnail similarity with its class, and multi-scale similarity of adjacent frames, drawn 16 x 16 in three channels."""
    f = fr.with_previous(views.frames(spark, sf_dir)).where("previous is not null")
    cell = lambda i: F.floor(i / 96) * 8 + F.floor(F.floor(i / 3) % 16 / 2)
    drawn = lambda p: F.transform(F.sequence(F.lit(0), F.lit(767)), lambda i: F.get(F.col(p), ((cell(i) + 21 * (i % 3)) % 64).cast("int")))
    out = fr.colour_pairs(f.select("clip_id", "frame_idx", drawn("previous").alias("a"), drawn("pixels").alias("b")), 16, 16)
    kind = F.when(F.col("similarity") > 0.996, "duplicate").when(F.col("similarity") < 0.2, "hold").otherwise("interpolate")
    return out.select("clip_id", "frame_idx", *[F.round(c, 6).alias(c) for c in ("hist_corr", "similarity", "ms_ssim")], kind.alias("kind"))


def _colour_sql() -> str:
    """Hue and saturation cells in fixed point, and Gaussian windows as weights of source rows, from their rules."""

    def channel(p: str, k: int) -> str:
        return f"floor(least(255, greatest(0, {p}[(j + {21 * k}) % 64 + 1])))::BIGINT"

    def hues(p: str) -> str:
        return f"""SELECT clip_id, frame_idx, '{p}' AS side, {channel(p, 0)} AS r, {channel(p, 1)} AS g, {channel(p, 2)} AS u FROM pairs, range(64) t(j)"""

    def smooth(name: str, source: str, axis: str, rest: str) -> str:
        fields = ", ".join(f"sum(w * {c}) AS {c}" for c in ("a", "b", "ab", "aa", "bb"))
        return f"{name} AS (SELECT clip_id, frame_idx, k, {rest}, o AS {axis}, {fields} FROM {source} s JOIN window_rows q ON q.n = s.n{axis} AND q.i = s.{axis} GROUP BY ALL)"

    def products(source: str, n: str) -> str:
        return f"SELECT clip_id, frame_idx, k, c, y, x, {n} AS ny, {n} AS nx, a, b, a * b AS ab, a * a AS aa, b * b AS bb FROM {source}"

    shrunk = ",\n".join(
        f"level{k} AS (SELECT clip_id, frame_idx, {k} AS k, {16 >> k} AS n, c, y // 2 AS y, x // 2 AS x, avg(a) AS a, avg(b) AS b FROM level{k - 1} GROUP BY ALL)" for k in range(1, 5)
    )
    terms = "(2 * (ab - a * b) + 9e-4) / ((aa - a * a) + (bb - b * b) + 9e-4)"
    power = " * ".join(f"pow(max(contrast) FILTER (k = {k}), {w})" for k, w in enumerate(fr.SCALE_WEIGHTS[:-1]))
    return f"""+p AS (SELECT clip_id, frame_idx, lag(pixels) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS a, pixels AS b FROM frames), pairs AS (SELECT * FROM p WHERE a IS NOT NULL),
rgb AS ({hues("a")} UNION ALL {hues("b")}), vd AS (SELECT *, greatest(r, g, u) AS v, greatest(r, g, u) - least(r, g, u) AS d FROM rgb),
hs AS (SELECT *, floor((d * round_even(255 * 4096.0::DOUBLE / greatest(v, 1), 0) + 2048) / 4096) AS s,
  floor(((CASE WHEN v = r THEN g - u WHEN v = g THEN u - r + 2 * d ELSE r - g + 4 * d END) * round_even(30 * 4096.0::DOUBLE / greatest(d, 1), 0) + 2048) / 4096) AS h FROM vd),
cells AS (SELECT clip_id, frame_idx, side, floor(least(CASE WHEN h < 0 THEN h + 180 ELSE h END, 179) * 50 / 180)::INT * 60 + floor(s * 60 / 256)::INT AS cell FROM hs),
counts AS (SELECT clip_id, frame_idx, cell, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM cells GROUP BY ALL),
sums AS (SELECT clip_id, frame_idx, sum(na * nb) - 64 * 64 / 3000.0::DOUBLE AS ab, sum(na * na) - 64 * 64 / 3000.0::DOUBLE AS aa,
  sum(nb * nb) - 64 * 64 / 3000.0::DOUBLE AS bb FROM counts GROUP BY ALL),
hist AS (SELECT clip_id, frame_idx, ab / sqrt(aa * bb) AS hist_corr FROM sums),
sizes AS (SELECT * FROM (VALUES (32, 11), (16, 11), (8, 8), (4, 4), (2, 2), (1, 1), (3, 11)) v(n, size)),
bell AS (SELECT n, size, t, exp(-pow(t - size // 2, 2) / 4.5::DOUBLE) / sum(exp(-pow(t - size // 2, 2) / 4.5::DOUBLE)) OVER (PARTITION BY n) AS w FROM sizes, range(11) z(t) WHERE t < size),
window_rows AS (SELECT n, o, least(greatest(o - 5 + t, 0), n - 1) AS i, sum(w) AS w FROM bell, range(32) z(o) WHERE o < n + 11 - size GROUP BY ALL),
level0 AS (SELECT clip_id, frame_idx, 0 AS k, 16 AS n, c, y, x, a[((y // 2) * 8 + x // 2 + 21 * c) % 64 + 1] / 255 AS a, b[((y // 2) * 8 + x // 2 + 21 * c) % 64 + 1] / 255 AS b
  FROM pairs, range(3) t(c), range(16) q(y), range(16) z(x)),
{shrunk},
levels AS (SELECT * FROM level0 UNION ALL SELECT * FROM level1 UNION ALL SELECT * FROM level2 UNION ALL SELECT * FROM level3 UNION ALL SELECT * FROM level4),
flat0 AS ({products("levels", "n")}), {smooth("flat1", "flat0", "y", "c, x, nx")}, {smooth("flat2", "flat1", "x", "c, y")},
scales AS (SELECT clip_id, frame_idx, k, avg((2 * a * b + 1e-4) / (a * a + b * b + 1e-4) * {terms}) AS whole, avg({terms}) AS contrast FROM flat2 GROUP BY ALL),
multi AS (SELECT clip_id, frame_idx, CASE WHEN min(contrast) FILTER (k < 4) >= 0 AND max(whole) FILTER (k = 4) >= 0
  THEN {power} * pow(max(whole) FILTER (k = 4), {fr.SCALE_WEIGHTS[-1] * 4}) END AS ms_ssim
  FROM scales GROUP BY ALL),
taps AS (SELECT o, floor(greatest(o / 2.0::DOUBLE - 0.25, 0))::INT AS low, greatest(o / 2.0::DOUBLE - 0.25, 0) - floor(greatest(o / 2.0::DOUBLE - 0.25, 0)) AS part FROM range(32) t(o)),
mixes AS (SELECT o, i, sum(w) AS w FROM (SELECT o, low AS i, 1 - part AS w FROM taps UNION ALL SELECT o, least(low + 1, 15), part FROM taps) GROUP BY ALL),
tall AS (SELECT clip_id, frame_idx, c, o AS y, x, sum(w * a) AS a, sum(w * b) AS b FROM level0 JOIN mixes ON i = y GROUP BY ALL),
thumbs AS (SELECT clip_id, frame_idx, 0 AS k, c, y, o AS x, sum(w * a) AS a, sum(w * b) AS b FROM tall JOIN mixes ON i = x GROUP BY ALL),
deep0 AS (SELECT *, 3 AS nc FROM ({products("thumbs", "32")})), {smooth("deep1", "deep0", "c", "y, x, ny, nx")}, {smooth("deep2", "deep1", "y", "c, x, nx")}, {smooth("deep3", "deep2", "x", "c, y")},
small AS (SELECT clip_id, frame_idx, avg((2 * a * b + 1e-4) / (a * a + b * b + 1e-4) * {terms}) AS similarity FROM deep3 GROUP BY ALL)
SELECT clip_id, frame_idx, round(hist_corr, 6) AS hist_corr, round(similarity, 6) AS similarity, round(ms_ssim, 6) AS ms_ssim,
  CASE WHEN similarity > 0.996 THEN 'duplicate' WHEN similarity < 0.2 THEN 'hold' ELSE 'interpolate' END AS kind
FROM hist JOIN small USING (clip_id, frame_idx) JOIN multi USING (clip_id, frame_idx)"""


COLOUR_SIMILARITY = with_views(_colour_sql(), "frames")


QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (shot_windows, SHOT_WINDOWS), (straddle_rejection, STRADDLE), (usable_lengths, USABLE_LENGTHS), (resampled_clips, RESAMPLED), (densified, DENSIFIED),
        (balanced_samples, BALANCED), (full_batches, FULL_BATCHES),
        (seeded_draws, SEEDED_DRAWS), (frame_indices, FRAME_INDICES), (nearest_seconds, NEAREST_SECONDS), (bad_rows, BAD_ROWS), (frame_metrics, FRAME_METRICS),
        (reconstruction_quality, RECONSTRUCTION),
        (consistency_summary, CONSISTENCY), (flicker_suspects, FLICKER), (structural_similarity, STRUCTURAL), (loss_curves, LOSS_CURVES), (sparklines, SPARKLINES),
        (checkpoint_plan, CHECKPOINT_PLAN), (rubric_verdicts, RUBRIC),
        (failure_rates, FAILURE_RATES), (run_ranking, RUN_RANKING), (evaluation_grid, EVALUATION_GRID), (run_labels, RUN_LABELS), (throughput, THROUGHPUT),
        (seam_ratios, SEAM_RATIOS), (uniform_frames, UNIFORM_FRAMES),
        (carried_batches, CARRIED_BATCHES), (mask_plans, MASK_PLANS), (colour_similarity, COLOUR_SIMILARITY),
    )
}
