"""Readers and writers of segment sheets, metadata, captions, logs and file lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEGMENT_COLUMNS = ("source_file", "in", "out", "character", "action_label", "bg_type", "alpha_file", "bg_plate", "props")
METADATA_SCHEMA = "file_path string, text string, type string, width int, height int, source_skit string, source_shot string, window string"
#: Lines that are numbered by one task.
LINES = 1 << 20
CAPTION_SCHEMA = "clip_id string, anchor string, suffix string"


def numbered(df: DataFrame, name: str, start: int, of_file: bool = True) -> DataFrame:
    """Rows of files, with file, numbered in the order they stand in: within their file, or over all files by path if not ``of_file``.

    A file's blocks are numbered on their own, and each goes on where the blocks before it end: counts of blocks alone
    are summed, and no task holds more than a block. Numbers depend on neither file sizes nor how Spark packs files.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    keys = ["file", "__block"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    blocks = Window.partitionBy("file").orderBy("__block") if of_file else Window.partitionBy().orderBy(*keys)
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("__at")) - 1 + start
    ranked = rows.withColumn("__local", local).join(before.drop("__n"), keys)
    return ranked.withColumn(name, (F.col("__local") + F.col("__before")).cast("long")).drop("__block", "__at", "__local", "__before")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of one sheet or more, with row_ord, from 1 in each sheet."""
    schema = ", ".join(f"`{c}` string" for c in SEGMENT_COLUMNS)
    return numbered(spark.read.schema(schema).option("header", True).csv(path), "row_ord", 1).drop("file")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header or, by the file's suffix, JSON: an array of entries, or an object that holds it as 'data'.

    Rows have ord, their place from 0; extra keys of entries are not read.
    """
    if path.endswith(".csv"):
        return numbered(spark.read.schema(METADATA_SCHEMA).option("header", True).csv(path), "ord", 0, of_file=False).drop("file")
    fields = METADATA_SCHEMA.split(", ")
    names = [f.split()[0] for f in fields]
    found = spark.read.schema(f"{METADATA_SCHEMA}, data array<struct<{', '.join(f.replace(' ', ': ', 1) for f in fields)}>>").option("multiLine", True).json(path)
    # an array's entries are rows, an object with data is one row that holds them
    at, here = F.monotonically_increasing_id(), F.col("_metadata.file_path")
    entries = F.coalesce(F.col("data"), F.array(F.struct(*names)))
    rows = found.select(here.alias("__file"), at.alias("__at"), F.posexplode(entries).alias("__pos", "__e"))
    rank = F.row_number().over(Window.partitionBy("__file").orderBy("__at", "__pos")) - 1  # a file of this kind is read by one task
    counts = rows.groupBy("__file").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__rank", rank).join(counts.select("__file", before.alias("__before")), "__file")
    return rows.select(*[F.col(f"__e.{n}").alias(n) for n in names], (F.col("__rank") + F.col("__before")).cast("long").alias("ord"))


def entries_of(texts: DataFrame, text: str = "value") -> DataFrame:
    """Entries of JSON texts: the columns of ``texts`` without the text, pos (from 0), entry (JSON text) and keys.

    A text is an array of entries, an object that holds one as 'data', or one entry. keys are those an entry was written
    with, also where the value is null; they are null for an entry that is no object. Texts that are no JSON have one
    entry, null.
    """
    held = F.try_parse_json(F.col(text))
    kind = F.schema_of_variant(held)
    listed = F.when(kind.startswith("ARRAY<"), held).when(F.schema_of_variant(F.try_variant_get(held, "$.data", "variant")).startswith("ARRAY<"), F.try_variant_get(held, "$.data", "variant"))
    items = F.coalesce(F.try_variant_get(listed, "$", "array<variant>"), F.array(held))
    rows = texts.select(*[F.col(f"`{c}`") for c in texts.columns if c != text], F.posexplode(items).alias("pos", "__e"))
    return rows.withColumn("entry", F.to_json("__e")).withColumn("keys", F.json_object_keys("entry")).drop("__e")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON metadata files, whatever keys they have: the columns of read_metadata, keys and ord, their place from 0 over all files by path.

    A field that an entry lacks is null and not among its keys. A file of this kind is one text, read by one task.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("__file"))
    rows = entries_of(files)
    counts = rows.groupBy("__file").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(counts.select("__file", before.alias("__before")), "__file")
    held = F.from_json("entry", METADATA_SCHEMA)
    return rows.select("keys", held.alias("__h"), (F.col("__before") + F.col("pos")).cast("long").alias("ord")).select("__h.*", "keys", "ord")


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """Caption lines; blank lines are skipped, lines that are no JSON stay in _corrupt_record."""
    return spark.read.schema(CAPTION_SCHEMA + ", _corrupt_record string").json(path)


def read_line_pairs(spark: SparkSession, captions: str, paths: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, unmatched): non-blank lines of two sources by position, with their line numbers and whether these agree."""

    def lines(path: str, name: str) -> DataFrame:
        rows = numbered(spark.read.text(path), "line", 1, of_file=False)
        blank = F.trim("value") == ""
        keep = rows.where(~blank).select(F.trim("value").alias(name), F.col("line").alias(f"{name}_line"))
        # lines in parts of fixed length: each is numbered on its own, after the counts of those before it
        part = F.floor(F.col(f"{name}_line") / LINES)
        counts = keep.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        local = F.row_number().over(Window.partitionBy("__part").orderBy(f"{name}_line")) - 1
        ranked = keep.withColumn("__part", part).withColumn("__local", local).join(counts.select("__part", before.alias("__before")), "__part")
        return ranked.select((F.col("__local") + F.col("__before")).alias("ord"), name, f"{name}_line")

    both = lines(captions, "text").join(lines(paths, "path"), "ord", "full_outer").withColumn("aligned", F.col("text_line") == F.col("path_line"))
    bad = F.col("text").isNull() | F.col("path").isNull()
    return both.where(~bad), both.where(bad)


def choose_columns(df: DataFrame, caption: str | None = None, video: str | None = None) -> DataFrame:
    """Caption and video columns, by default the first and second; a name that is not there raises with those that are."""
    names = df.columns
    caption, video = caption or names[0], video or names[min(1, len(names) - 1)]
    for c in (caption, video):
        if c not in names:
            raise ValueError(f"no column {c!r}; there are {', '.join(names)}")
    return df.select(F.col(caption).alias("text"), F.col(video).alias("path"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """run (file), line_no (from 1 in each file), value; carriage returns end lines too."""
    return numbered(spark.read.text(path), "line_no", 1).select(F.col("file").alias("run"), "line_no", "value")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime of files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


def write_table(df: DataFrame, path: str, kind: str = "parquet", columns: Sequence[str] | None = None) -> None:
    """Parquet, CSV with a header, or JSON lines, in the given column order."""
    df = df.select(*columns) if columns else df
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path) if kind == "json" else writer.parquet(path)


def _committed(spark: SparkSession, path: str) -> dict[str, str]:
    """Batches of a table of appended batches that were written whole, with their folders."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    inside = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("batch-")]
    return {p.getName().removeprefix("batch-"): p.toString() for p in inside if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def read_appended(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of all batches that append_absent wrote whole; what a broken write left is not read."""
    found = sorted(_committed(spark, path).values())
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def append_absent(new: DataFrame, path: str, key: str, batch: str) -> bool:
    """Appends the rows of ``new`` whose key is not in the table yet, as one batch; rows that are there are neither read whole nor changed.

    A batch is a folder that counts once its writer's commit marker is there, so the same call may be made again: a batch
    that was written whole is left alone (False), one that broke off is written anew. Of several new rows of a key the
    least is added, as a struct of its columns; null keys are never there yet and are one key. One writer at a time.
    """
    spark = new.sparkSession
    done = _committed(spark, path)
    if batch in done:
        return False
    there = read_appended(spark, path, new.schema) if done else None
    rows = new.groupBy(F.struct(key).alias("__key")).agg(F.min(F.struct(*[f"`{c}`" for c in new.columns])).alias("__row"))
    if there is not None:
        rows = rows.join(there.where(F.col(key).isNotNull()).select(F.struct(key).alias("__key")), "__key", "left_anti")
    rows.select("__row.*").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch-{batch}")
    return True


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A Markdown table row per row of ``df``."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in columns])
    return df.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("row"))


def conversion(metadata: DataFrame, root: str) -> DataFrame:
    """video_path below the root, and caption."""
    return metadata.select(F.concat_ws("/", F.lit(root.rstrip("/")), "file_path").alias("video_path"), F.col("text").alias("caption"))
