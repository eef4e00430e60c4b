"""Helpers that the operators share: scratch scopes of threads, staged tables and joins by counted keys."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewise.llm import common
from framewise.llm.common import STAGED, bucket_numbers, join_keyed, new_path, prepare, save_at, scratch, staged


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def exists(spark, path):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_scopes_of_threads_are_apart(spark):
    """What one thread saved outlives the end of another's scope; scopes inside hand on what they keep."""
    open_, done, told = threading.Event(), threading.Event(), {}

    def other():
        with scratch(spark) as keep:
            _, told["kept"] = save_at(spark.range(3).toDF("x"), "kept")
            _, told["gone"] = save_at(spark.range(3).toDF("x"), "gone")
            keep(told["kept"])
            open_.set()
            assert done.wait(60)
            told["there"] = exists(spark, told["gone"])
        told["after"] = exists(spark, told["gone"])

    with scratch(spark):
        thread = threading.Thread(target=other)
        thread.start()
        assert open_.wait(60)
        _, mine = save_at(spark.range(3).toDF("x"), "mine")
    done.set()
    thread.join(60)
    assert told["there"] and not told["after"] and exists(spark, told["kept"]) and not exists(spark, mine)


def test_two_operators_in_two_threads(spark):
    from framewise.llm import ngrams, warc

    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2) * 100 + k}" for k in range(30))) for i in range(20)], "doc_id long, text string")
    pages = spark.createDataFrame([(i, "u", "<p>x" if i % 2 else None) for i in range(20)], "page_id long, url string, html string")
    found, wrong = {}, []

    def run(name, work):
        try:
            found[name] = work()
        except Exception as e:
            wrong.append(e)

    jobs = [("near", lambda: ngrams.near_duplicate_classes(docs).collect()), ("warc", lambda: warc.archive_and_read(pages).collect())]
    threads = [threading.Thread(target=run, args=job) for job in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not wrong
    assert {r["doc_id"]: r["class_id"] for r in found["near"]} == {i: i - i % 2 for i in range(20)}
    assert Counter(r["record_type"] for r in found["warc"]) == {"response": 2, "revisit": 18}


def test_staged_tables(spark):
    """In a database of one's own, dealt evenly, gone at the end; entries without files are dropped, those with files stay."""
    spark.sql("CREATE DATABASE IF NOT EXISTS staging")
    spark.conf.set(common.DATABASE, "staging")
    tables = lambda name: {r["tableName"] for r in spark.sql(f"SHOW TABLES IN spark_catalog.{name}").collect()}
    try:
        for name in ("stale", "live"):
            spark.range(3).write.option("path", new_path(spark, name)).saveAsTable(f"spark_catalog.staging.{STAGED}{name}")
        at = [r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED spark_catalog.staging.{STAGED}stale").collect() if r["col_name"] == "Location"][0]
        common.remove(spark, at)
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        before = tables("default")
        with staged(spark.range(0, 8_000, 1, 2 * buckets)) as rows:
            assert tables("default") == before and len(tables("staging")) == 2
            found = rows.select("part", "key", (F.col("id") * 2).alias("twice"))
            joined = rows.join(found.hint("shuffle_hash"), ["part", "key"])
            assert joined.where("twice = 2 * id").count() == 8_000
            used = rows.groupBy("part", F.pmod(F.hash("part"), F.lit(buckets)).alias("bucket")).count().collect()
            assert sorted(r["bucket"] for r in used) == list(range(buckets)) and {r["count"] for r in used} == {8_000 // buckets}
        assert tables("staging") == {f"{STAGED}live"}
    finally:
        spark.conf.unset(common.DATABASE)
        spark.sql("DROP DATABASE IF EXISTS staging CASCADE")


@pytest.mark.parametrize("buckets", [1, 8, 200, 333])
def test_a_number_for_each_bucket(spark, buckets):
    rows = spark.range(1).select(F.posexplode(bucket_numbers(spark, buckets)).alias("b", "p")).select("b", F.pmod(F.hash("p"), F.lit(buckets)).alias("at"))
    assert [r["at"] for r in rows.orderBy("b").collect()] == list(range(buckets))


def test_hot_keys_have_bounds(spark, monkeypatch):
    rows = spark.createDataFrame([("hot", i) for i in range(60)] + [(f"k{i % 9}", i) for i in range(40)] + [(None, 1)], "g string, v int")
    keyed = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    want = sorted((r["g"], r["v"], r["s"]) for r in rows.where("g is not null").join(keyed, "g").collect())
    for most, keys in ((1_000_000, 65_536), (10, 65_536), (4, 2), (2, 1)):
        monkeypatch.setattr(common, "HOT_ROWS", most)
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        assert sorted((r["g"], r["v"], r["s"]) for r in join_keyed(rows, keyed, ["g"], 101).collect()) == want


def test_named_words_of_listings_stay():
    """Names inside a listing mark up a programme; the same names outside of one take out what they name."""
    from framewise.llm import main_text

    prose = " ".join(f"word{i}" for i in range(60))
    page = f'<html><body><article><p>{prose}</p><pre><span class="comment"># say it</span> <code class="ad">x = 1</code></pre><div class="comment"><p>Nice one.</p></div><p>{prose}</p></article></body></html>'
    assert main_text.extract(page, {}) == f"{prose} # say it x = 1 {prose}"
