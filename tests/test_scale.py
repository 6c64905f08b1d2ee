"""What must not grow faster than the input: partitions, state, files and shuffled rows."""

import random
import time

from pyspark.sql import functions as F

from zeitband.operators import metrics, scans, store
from zeitband.shared import new_folder, small_tasks
from zeitband.sources import timelines, versions
from zeitband.streaming.assign import stream_assign


def test_state_is_one_row_for_a_timeline_and_slot(spark):
    """a join of the streams kept three rows for each segment and turn."""
    place = new_folder(spark, "stream")
    rows = spark.range(400).select((F.col("id") % 2).alias("tid"), F.col("id").cast("int").alias("seq"), (3_600_000 + F.col("id") * 100).alias("start_ms"), (3_600_050 + F.col("id") * 100).alias("end_ms"))
    rows.select("*", F.lit(None).cast("string").alias("speaker_id"), F.lit("x").alias("text")).write.parquet(f"{place}/segments")
    rows.select("tid", F.col("seq").cast("long").alias("turn_seq"), "start_ms", "end_ms", F.lit(1).cast("long").alias("speaker")).write.parquet(f"{place}/turns")
    streams = [spark.readStream.schema(spark.read.parquet(f"{place}/{t}").schema).parquet(f"{place}/{t}") for t in ("segments", "turns")]
    query = stream_assign(*streams).writeStream.outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(lambda df, i: df.collect()).start()
    query.awaitTermination()
    assert [len(p["stateOperators"]) for p in query.recentProgress] == [1] * len(query.recentProgress)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 2


def test_partitions_grow_with_the_rows(spark):
    """However many rows there are, a task holds a partition of bounded size, and timelines whole."""
    rows = spark.range(1000).select((F.col("id") % 50).alias("tid"))
    for count, n in ((10, spark.sparkContext.defaultParallelism), (40 * timelines.PARTITION_ROWS, 40), (40 * timelines.PARTITION_ROWS + 1, 41)):
        dealt = timelines.by_timeline(rows, "tid", count)
        assert dealt.rdd.getNumPartitions() == n
        assert dealt.select("tid", F.spark_partition_id().alias("p")).distinct().count() == 50


def test_values_are_carried_both_ways_with_one_sort(spark):
    """Rows were sorted once for each direction."""
    rows = spark.range(20).select(F.lit(1).alias("tid"), "id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    got = scans.carried(rows, "tid", ["id"], before={"left": F.col("v")}, after={"right": F.col("v")}, sums={"sum": F.col("v")}, span=3)
    want = [(i, (i - 1) // 5 * 5 if i else None, None if i >= 15 else i // 5 * 5 + 5, sum(range(0, i + 1, 5))) for i in range(20)]
    assert sorted(tuple(r) for r in got.select("id", "left", "right", "sum").collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    ends = [line for line in plan.splitlines() if "Window" in line and "__front" in line]
    assert len(ends) == 1


def test_buckets_grow_with_the_rows_and_documents_are_compressed(spark):
    """Sixteen buckets held any table, so one task read and sorted a sixteenth of it."""
    assert [versions.buckets_for(n) for n in (0, 16 * versions.BUCKET_ROWS, 500 * versions.BUCKET_ROWS + 1)] == [16, 16, 501]
    t = spark.createDataFrame([(str(i), "t", "de", 1, 1, "open", 0, 0) for i in range(60)], store.STORED["transcripts"])
    s = spark.createDataFrame([(str(i), f"{i}-0", 0, 0, 1, "x", None, None) for i in range(60)], store.STORED["segments"])
    at = store.DocumentStore(spark, new_folder(spark, "documents"), 40)
    at.put(store.nested(t, s))
    files = [f for fs in at.manifest(1)["documents"].values() for f in fs]
    assert len(files) > 16 and all(f.endswith(".json.gz") for f in files)
    assert [r["title"] for r in at.find("documents", "17").collect()] == ["t"] and at.read("documents").count() == 60
    path = new_folder(spark, "documents")
    store.write_documents(store.nested(t, s), path)
    assert {r[0].endswith(".json.gz") for r in spark.read.text(path).select(F.input_file_name()).distinct().collect()} == {True}
    assert store.scan_documents(spark, path).count() == 60


def test_settings_of_written_tables_are_put_back(spark):
    """tables in between were written by tasks of any size, which spill."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    with small_tasks(spark):
        assert spark.conf.get(key) == "16m"
    assert spark.conf.get(key) == before


def test_word_errors_are_spread_and_cheap(spark):
    """a few tasks held all pairs, and a cell of the table copied its whole row."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(80)]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False))] + [(-1, None, "a b"), (-2, "a", None), (-3, "a b", "a b")]

    def least(a, b):
        rows = [[(j, j, 0) for j in range(len(a) + 1)]]
        for i, w in enumerate(b, 1):
            made = [(i, 0, i)]
            for j, v in enumerate(a, 1):
                (n, d, k), (p, q, r), (x, y, z) = rows[-1][j - 1], rows[-1][j], made[-1]
                made.append(min((n + (v != w), d, k), (p + 1, q, r + 1), (x + 1, y + 1, z)))
            rows.append(made)
        n, d, k = rows[-1][-1]
        return n - d - k, d, k

    made = metrics.word_errors(spark.createDataFrame(pairs, "id long, reference string, hypothesis string"))
    assert {r["id"]: (r["replaced"], r["deleted"], r["inserted"]) for r in made.collect()} == {i: least((a or "").split(), (b or "").split()) for i, a, b in pairs}
    assert made.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    long = spark.range(8).select("id", F.repeat(F.lit("a b c "), 200).alias("reference"), F.repeat(F.lit("a c d "), 200).alias("hypothesis"))
    start = time.perf_counter()
    assert metrics.word_errors(long).agg(F.min("n_reference")).first()[0] == 600
    assert time.perf_counter() - start < 10
