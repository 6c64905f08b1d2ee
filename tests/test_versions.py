"""The store on disk: both tables or none, two writers, old versions, lookups that open one bucket, documents."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from zeitband.operators import store
from zeitband.sources import versions


def made(spark, n, start=0, note="a"):
    t = spark.range(start, start + n).select(F.col("id").cast("string").alias("transcript_id"), F.lit(note).alias("title"), F.lit("de").alias("language"), F.lit(1).cast("long").alias("duration_ms"), F.lit(1).alias("speaker_count"), F.lit("x").alias("status"), F.col("id").alias("created_at"), F.col("id").alias("updated_at"))
    s = spark.range(3 * start, 3 * (start + n)).select(F.floor(F.col("id") / 3).cast("string").alias("transcript_id"), F.concat(F.lit(note), F.col("id").cast("string")).alias("segment_id"), (F.col("id") % 3).cast("int").alias("seq"), F.col("id").alias("start_ms"), F.col("id").alias("end_ms"), F.lit(note).alias("text"), F.lit(None).cast("string").alias("speaker_id"), F.lit(None).cast("string").alias("speaker_label"))
    return t, s


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture
def at(spark, tmp_path):
    return store.TranscriptStore(spark, f"file://{tmp_path}/store", buckets=8)


def test_both_tables_change_together(spark, at):
    assert at.version() == 0 and at.read("segments").count() == 0 and at.find("segments", "5").count() == 0
    at.save(*made(spark, 40))
    assert at.version() == 1 and (at.read("transcripts").count(), at.read("segments").count()) == (40, 120)
    t, s = made(spark, 2, note="b")
    at.save(t, s.filter("seq = 1"))
    assert rows(at.find("segments", "1").select("segment_id")) == ["('b4',)"] and at.read("segments").count() == 116
    at.delete(spark.createDataFrame([("7",), ("none",), (None,)], "transcript_id string"))
    assert at.read("transcripts").count() == 39 and at.find("segments", "7").count() == 0
    at.rename(spark.createDataFrame([("8", "acht")], "transcript_id string, new_title string"))
    assert at.find("transcripts", "8").first()["title"] == "acht" and at.version() == 4
    assert at.read("transcripts", 1).count() == 40 and at.read("segments", 1).count() == 120  # older versions stay readable
    assert at.edit(t.limit(0), lambda now: 1 / 0) == 4  # nothing to change, no version


def test_only_touched_buckets_are_written(spark, at):
    at.save(*made(spark, 200))
    before = at.manifest(1)
    at.save(*made(spark, 1, note="b"))
    after = at.manifest(2)
    for table in store.STORED:
        same = [b for b in before[table] if before[table][b] == after[table][b]]
        assert len(same) == len(before[table]) - 1 == 7
    at.rename(spark.createDataFrame([("0", "c")], "transcript_id string, new_title string"))
    assert at.manifest(3)["segments"] == after["segments"]


def test_a_job_that_dies_between_both_writes_changes_nothing(spark, at):
    at.save(*made(spark, 20))
    real, calls = at._write, []

    def dies(table, *more):
        calls.append(table)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(table, *more)

    at._write = dies
    with pytest.raises(RuntimeError):
        at.save(*made(spark, 20, note="b"))
    again = store.TranscriptStore(spark, at.path, buckets=8)
    assert calls == ["transcripts", "segments"] and again.version() == 1
    assert {r["title"] for r in again.read("transcripts").collect()} == {"a"} and again.read("segments").filter("text = 'b'").count() == 0
    again.clean()
    named = {f for t in again.manifest(1).values() for fs in t.values() for f in fs}
    folder = at.path.removeprefix("file://")
    there = {os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(f"{folder}/data") for f in fs if f.startswith("part-")}
    assert there == named and again.read("segments").count() == 60


def test_two_writers_cannot_both_win(spark, at):
    at.save(*made(spark, 10))
    base = at.version()
    t, s = made(spark, 10, note="b")
    other = store.TranscriptStore(spark, at.path, buckets=8)
    other.delete(t.filter("transcript_id = '3'"))
    with pytest.raises(versions.Conflict):
        at.edit(t, lambda now: {"transcripts": t, "segments": s}, base)
    assert at.version() == 2 and at.read("transcripts").filter("title = 'b'").count() == 0 and at.read("transcripts").count() == 9


def test_a_lookup_reads_one_bucket(spark, at):
    at.save(*made(spark, 4000))
    found = at.find("segments", "1234")
    assert rows(found.select("seq")) == ["(0,)", "(1,)", "(2,)"]
    size = lambda files: sum(os.path.getsize(f.removeprefix("file://")) for f in files)
    assert len(found.inputFiles()) == 1 and size(found.inputFiles()) * 4 < size(at.read("segments").inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(transcript_id), EqualTo(transcript_id,1234)]" in plan and "Location: InMemoryFileIndex(1 paths)" in plan
    file = found.inputFiles()[0].removeprefix("file://")
    blooms = duckdb.sql(f"select bloom_filter_offset from parquet_metadata('{file}') where path_in_schema = 'transcript_id'").fetchall()
    assert all(b[0] for b in blooms)
    ids = [r[0] for r in spark.read.parquet(f"file://{file}").select("transcript_id").collect()]
    assert ids == sorted(ids)


def test_null_keys_and_documents(spark, tmp_path):
    docs = store.nested(*made(spark, 30))
    at = store.DocumentStore(spark, f"file://{tmp_path}/documents", buckets=4)
    at.put(docs.unionByName(docs.limit(1).withColumn("transcript_id", F.lit(None).cast("string"))))
    assert at.read("documents").count() == 31 and len(at.find("documents", "5").inputFiles()) == 1
    at.put(docs.filter("transcript_id = '5'").withColumn("title", F.lit("neu")))
    at.delete(docs.filter("transcript_id = '6'"))
    assert at.find("documents", "5").first()["title"] == "neu" and at.find("documents", "6").count() == 0 and at.read("documents").count() == 30
    assert store.document_segments(at.find("documents", "5")).count() == 3


def test_documents_are_deleted_where_they_are_dealt(spark, tmp_path):
    """Null ids delete nothing, ids that aren't there neither; documents move to their buckets and nowhere else."""
    docs = store.nested(*made(spark, 30))
    at = store.DocumentStore(spark, f"file://{tmp_path}/documents", buckets=4)
    at.put(docs.unionByName(docs.limit(1).withColumn("transcript_id", F.lit(None).cast("string"))))
    ids = spark.createDataFrame([("6",), ("7",), ("7",), (None,), ("none",)], "transcript_id string")
    left = at.without(at.read("documents"), ids)
    left.collect()
    plan = left._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1
    want = sorted(map(repr, store.delete(at.read("documents"), ids).collect()))
    at.delete(ids)
    assert sorted(map(repr, at.read("documents").collect())) == want and len(want) == 29
