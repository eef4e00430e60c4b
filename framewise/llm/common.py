"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary one; others raise."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='framewise-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Open scratch scopes of this thread, the innermost last: paths to remove when each ends.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """Tables saved inside are removed at its end, but for paths given to what it yields, which pass to the scope around it.

    All that reads the others must have run by then, so a scope ends after a table that needs them was written.
    """
    own: list[str] = []
    kept: list[str] = []
    around = _scopes.get()
    token = _scopes.set((*around, own))
    try:
        yield kept.append
    finally:
        _scopes.reset(token)
        for path in own:
            if path not in kept:
                remove(spark, path)
            elif around:
                around[-1].append(path)


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder; it is removed with its scratch scope, or else when the session's JVM ends."""
    path = f"{shared_dir(spark)}/framewise/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if scopes := _scopes.get():
        scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def save_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back; also gives the path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def save(df: DataFrame, name: str) -> DataFrame:
    return save_at(df, name)[0]


#: Names of staged tables begin with this. The database that they are entered in while they are open: a session setting.
STAGED, DATABASE = "framewise_staged_", "spark.framewise.database"


def database(spark: SparkSession) -> str:
    return spark.conf.get(DATABASE, "default")


def drop_stale(spark: SparkSession, name: str) -> None:
    """Drops entries of staged tables whose files are gone: those of sessions that broke off, as files go with a session's JVM."""
    for t in spark.sql(f"SHOW TABLES IN spark_catalog.`{name}` LIKE '{STAGED}*'").collect():
        entry = f"spark_catalog.`{name}`.`{t['tableName']}`"
        at = [r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {entry}").collect() if r["col_name"] == "Location"]
        path = spark._jvm.org.apache.hadoop.fs.Path(at[0]) if at else None
        if path is not None and not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            spark.sql(f"DROP TABLE IF EXISTS {entry}")


@lru_cache(maxsize=8)
def _numbers(found: tuple[tuple[int, int], ...], buckets: int) -> str:
    known = dict(found)
    return ",".join(str(known.get(b, b)) for b in range(buckets))


def bucket_numbers(spark: SparkSession, buckets: int) -> Column:
    """An array of ``buckets`` whole numbers, of which the i-th is hashed into the i-th of as many buckets."""
    few = spark.range(32 * buckets).select(F.col("id").cast("int").alias("p")).select("p", F.pmod(F.hash("p"), F.lit(buckets)).alias("b"))
    found = tuple(sorted((r["b"], r["p"]) for r in few.groupBy("b").agg(F.min("p").alias("p")).collect()))  # a number for each bucket
    return F.split(F.lit(_numbers(found, buckets)), ",").cast("array<int>")


@contextmanager
def staged(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` with part and key, saved once as a table of buckets by part: what is found out about rows goes back to them by part and key.

    Each task writes the rows it holds into one bucket, tasks in turn into all of them, so keys stay what they are when an
    executor is lost, and a join by part and key (``found.hint("shuffle_hash")``) deals the few columns that were found to
    the buckets and leaves the rows, with their texts, where they are: a task holds what was found about one bucket, and
    its rows pass by. The table is entered in the database that DATABASE names while it is open, and a session setting
    about the keys of such joins is changed for as long; entries that broken sessions left are dropped first.
    """
    spark = rows.sparkSession
    drop_stale(spark, database(spark))
    name, key = f"spark_catalog.`{database(spark)}`.{STAGED}{uuid.uuid4().hex}", "spark.sql.requireAllClusterKeysForCoPartition"
    before, path = spark.conf.get(key), new_path(spark, "staged")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.get(bucket_numbers(spark, buckets), F.spark_partition_id() % buckets)
    numbered = rows.withColumn("part", part).withColumn("key", F.monotonically_increasing_id())
    try:
        numbered.write.format("parquet").bucketBy(buckets, "part").option("path", path).saveAsTable(name)
        spark.conf.set(key, "false")  # buckets by part do for a join by part and key
        yield spark.table(name)
    finally:
        spark.conf.set(key, before)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def bounded_rows(df: DataFrame, key: str, text: str, rows: int, *values: str) -> DataFrame:
    """At most ``rows`` different rows (key, text, values) of ``df``, those of the smallest hashed keys; rows of a null key go.

    Keys and hashes alone are sorted; rows of one key are told apart by their text's hash, and repeated ones are one row.
    """
    mark = F.xxhash64(text)
    chosen = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), mark.alias("__mark")).distinct()
    chosen = chosen.orderBy(F.xxhash64("__key"), "__key", "__mark").limit(rows)
    found = df.join(F.broadcast(chosen), (F.col(key) == F.col("__key")) & (mark == F.col("__mark")))  # at most ``rows`` of two numbers
    first = [F.first(c).alias(c) for c in (text, *values)]
    return found.groupBy(key, "__mark").agg(*first).drop("__mark")


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; at the task's end memory that is free goes back to the machine, as a worker process stays for later tasks."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def column_or_null(df: DataFrame, name: str, kind: str):
    """``df[name]`` cast to ``kind``, or null where there is no such column."""
    return df[name].cast(kind) if name in df.columns else F.lit(None).cast(kind)


#: A key is hot when it holds this share of all rows or more, or this many rows; hot keys beyond a number are left to Spark's skew splitting, the rarest first.
HOT_SHARE, HOT_ROWS, HOT_KEYS = 1e-3, 1_000_000, 65_536


def join_keyed(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, one row for each key and how many of the ``total`` rows have it in column n.

    Hot keys are at most a thousand of up to a billion rows and HOT_KEYS of more, so their rows are joined by broadcast and
    stay where they are; no task gets more rows of one key than a thousandth of all, nor than HOT_ROWS while hot keys are
    fewer than HOT_KEYS. Null keys meet nothing. n is dropped.
    """
    bound = max(min(HOT_SHARE * total, HOT_ROWS), 2)
    hot, cold = keyed.where(F.col("n") >= bound), keyed.where(F.col("n") < bound)
    if total / bound > HOT_KEYS:
        hot = hot.orderBy(F.desc("n"), *keys).limit(HOT_KEYS)
        cold = keyed.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    few = F.broadcast(hot.drop("n"))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.drop("n"), keys))


#: Rows and bytes of an Arrow batch, at most: whole texts make rows large.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, and lets Python workers on this machine import the package from its folder; a cluster gets it by --py-files."""
    import os
    from pathlib import Path

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep) + os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
