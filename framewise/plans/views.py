"""Tables the queries read, derived from the given ones; VIEWS_SQL holds the same in DuckDB SQL, as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment sheet from events."""
    e = table(spark, sf_dir, "events")
    start_ms = (F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000 + F.second("ts") * 1000 + F.date_format("ts", "SSS").cast("int")).cast("long")
    out_ms = F.floor(start_ms + F.col("value") * 20).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    k = F.get_json_object("props", "$.k").cast("long")
    rest = F.col("event_id") % 10
    return e.select(
        (F.col("event_id") + 1).alias("row_ord"), F.concat(F.lit("sheets/skit_"), F.col("user_id"), F.lit(".mp4")).alias("source_file"),
        F.concat(two(F.hour("ts")), F.lit(":"), two(F.minute("ts")), F.lit(":"), F.date_format("ts", "ss.SSS")).alias("in"),  # hours of the session's time zone may not exist
        F.concat(F.when(out_ms < 0, "-").otherwise(""), F.floor(F.abs(out_ms) / 1000).cast("string"), F.lit("."), F.lpad((F.abs(out_ms) % 1000).cast("string"), 3, "0")).alias("out"),
        F.when(F.col("user_id") % 3 == 0, "a").when(F.col("user_id") % 3 == 1, "b").otherwise("a+b").alias("character"), F.col("event_type").alias("action_label"),
        F.when(rest < 7, "gray").when(rest < 9, "show").otherwise(" ").alias("bg_type"), F.when(F.col("event_id") % 4 == 0, "alpha.mov").otherwise("").alias("alpha_file"),
        F.when(F.col("event_id") % 3 == 0, "plate.png").otherwise("").alias("bg_plate"), F.concat(F.lit("Prp_"), k % 12, F.lit("| Prp_"), k % 7).alias("props"),
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return d.join(b.select("item_id", F.col("text").alias("anchor")), F.col("item_id") == F.col("doc_id") % 40).select(F.col("doc_id").alias("clip_id"), "source", "lang",
        "anchor", F.col("text").alias("suffix"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat(F.lit("train/"), F.col("doc_id"), F.lit(".mp4")).alias("file_path"), F.when(F.col("doc_id") % 17 == 0, " ").otherwise(F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 5 == 0, "image").otherwise("video").alias("type"), (16 * (1 + F.col("n_chars") % 80)).cast("int").alias("width"),
        (16 * (1 + F.col("doc_id") % 80)).cast("int").alias("height"), "source",
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda *x: F.when(key % 4 == 0, x[0]).when(key % 4 == 1, x[1]).when(key % 4 == 2, x[2]).otherwise(x[3]).cast("int")
    frames = F.when(size % 3 == 0, 33).when(size % 3 == 1, 49).otherwise(81) + F.when(key % 11 == 0, size).otherwise(0)
    rate = F.when(key % 7 == 0, "24/1").otherwise("16/1")
    path = F.when(key % 3 == 0, F.concat(F.lit("train/"), F.floor(key / 3).cast("string"), F.lit(".mp4"))).otherwise(F.concat(F.lit("other/"), key.cast("string")))
    return p.select("p_partkey", path.alias("file_path"), pick(768, 1360, 1080, 16 * size).alias("width"), pick(1360, 768, 1920, 512).alias("height"),
        frames.cast("int").alias("nb_read_frames"), rate.alias("avg_frame_rate"), rate.alias("r_frame_rate"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    at = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=F.col("page_id").cast("decimal(18,6)"))
    return p.select("page_id", F.col("url").alias("path"), F.length("html").cast("long").alias("length"), at.alias("modificationTime"), (F.col("page_id") % 4).alias("category"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame scores: per user the n-th event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    first = F.min("ts").over(Window.partitionBy("user_id"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return e.select(F.col("user_id").alias("clip"), (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("value").alias("score"),
        (1 - F.col("value") / 500).alias("similarity"), (micros / 1e6 / 50_000).alias("t"), "event_id")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 frames from embeddings."""
    w = Window.partitionBy("label").orderBy("vec_id")
    pixels = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 127.5 * (x.cast("double") + 1))))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), pixels.alias("pixels"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 20).alias("root"), F.col("o_orderkey").alias("step"), (F.col("o_orderstatus") != "P").alias("has_weights"),
        F.concat(F.lit("checkpoint-"), F.col("o_orderkey")).alias("path"), F.col("o_orderdate").alias("mtime"))


def rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("dimension"), (1 + F.floor((F.col("l_quantity") - 1) / 12.5)).cast("int").alias("score"))


VIEWS_SQL = {
    "segments": """segments AS (
  SELECT event_id + 1 AS row_ord, 'sheets/skit_' || user_id || '.mp4' AS source_file, (hour(ts) * 3600000 + minute(ts) * 60000 + (floor(epoch_ms(ts)) % 60000))::BIGINT AS in_ms,
    floor((hour(ts) * 3600000 + minute(ts) * 60000 + (floor(epoch_ms(ts)) % 60000))::BIGINT + value * 20)::BIGINT AS out_ms,
    CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'a+b' END AS character, event_type AS action_label,
    CASE WHEN event_id % 10 < 7 THEN 'gray' WHEN event_id % 10 < 9 THEN 'show' ELSE 'gray' END AS bg_type, event_id % 4 = 0 AS alpha, event_id % 3 = 0 AS plate,
    ['Prp_' || (json_extract_string(props, '$.k')::BIGINT % 12), 'Prp_' || (json_extract_string(props, '$.k')::BIGINT % 7)] AS props FROM events),
planned AS (
  SELECT *, round(out_ms / 1000.0 - in_ms / 1000.0, 3) AS duration_s, CASE WHEN (out_ms - in_ms) * 16 >= 81000 THEN 81 ELSE 49 END AS frames,
    'skit_' || regexp_extract(source_file, '_(\\d+)', 1) || '_' || CASE WHEN row_ord < 1000 THEN lpad(row_ord::VARCHAR, 3, '0')
  ELSE row_ord::VARCHAR END || '_' || replace(action_label, ' ', '-') AS clip_id,
    CASE WHEN alpha AND bg_type = 'gray' THEN 'alpha-on-flat' WHEN alpha AND bg_type = 'show' AND plate THEN 'alpha-on-plate' ELSE 'baked' END AS strategy FROM segments)""",
    "captions": "captions AS (SELECT doc_id AS clip_id, source, lang, trim(b.text) AS anchor, trim(d.text) AS suffix FROM documents d JOIN benchmark b ON item_id = doc_id % 40)",
    "metadata": """metadata AS (SELECT doc_id, 'train/' || doc_id || '.mp4' AS file_path, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE text END AS text, CASE
  WHEN doc_id % 5 = 0 THEN 'image' ELSE 'video' END AS type,
  (16 * (1 + n_chars % 80))::INT AS width, (16 * (1 + doc_id % 80))::INT AS height, source FROM documents)""",
    "probes": """probes AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'train/' || (p_partkey // 3) || '.mp4' ELSE 'other/' || p_partkey END AS file_path,
  (CASE p_partkey % 4 WHEN 0 THEN 768 WHEN 1 THEN 1360 WHEN 2 THEN 1080 ELSE 16 * p_size END)::INT AS width,
  (CASE p_partkey % 4 WHEN 0 THEN 1360 WHEN 1 THEN 768 WHEN 2 THEN 1920 ELSE 512 END)::INT AS height,
  (CASE p_size % 3 WHEN 0 THEN 33 WHEN 1 THEN 49 ELSE 81 END + CASE WHEN p_partkey % 11 = 0 THEN p_size ELSE 0 END)::INT AS nb_read_frames, CASE WHEN p_partkey % 7 = 0 THEN 24
  ELSE 16 END AS fps FROM part)""",
    "files": "files AS (SELECT page_id, url AS path, length(html) AS length, page_id AS age, page_id % 4 AS category FROM pages)",
    "series": """series AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS score, 1 - value / 500 AS similarity,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 / 50000 AS t, event_id FROM events)""",
    "frames": """frames AS (SELECT label AS clip_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
  list_transform(embedding, lambda x: greatest(0.0, least(255.0, 127.5 * (x::DOUBLE + 1)))) AS pixels FROM embeddings)""",
    "checkpoints": "checkpoints AS (SELECT o_custkey % 20 AS root, o_orderkey AS step, o_orderstatus <> 'P' AS has_weights, 'checkpoint-' || o_orderkey AS path, o_orderdate AS mtime FROM orders)",
    "rubric": "rubric AS (SELECT l_orderkey AS item, l_linenumber AS dimension, (1 + floor((l_quantity - 1) / 12.5))::INT AS score FROM lineitem)",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the named views."""
    return "WITH " + ",\n".join(VIEWS_SQL[n] for n in names) + ("," if sql.lstrip().startswith("+") else "") + "\n" + sql.lstrip().removeprefix("+")
