"""Carries across buckets: small buckets give what one bucket gives, and one long timeline spreads over tasks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from zeitband.operators import chunks, intervals, labels, reports, scans

PARTS = "tid long, seq int, start_ms long, end_ms long, text string, speaker_id string, speaker_label string, is_final boolean, is_new boolean"
WIDE = 10**12


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(4)
    rows = []
    for tid in [1, 2, 3, 4, None]:
        at, seq = 0, 0
        for _ in range(rng.choice([1, 7, 150])):
            seq += rng.choice([1, 1, 1, 9])
            at += rng.choice([0, 300, 1100, 5000])
            end = at + rng.choice([100, 700, 1500, 9000])
            who = rng.choice([None, " ", "speaker_0", "speaker_1", "speaker_2", "speaker_1"])
            rows.append((tid, seq, at, end, rng.choice(["a", "one two", " ", None, "one two three four five"]), who, None if who in (None, " ") else f"S {who[-1]} {rng.randrange(2)}", rng.random() < 0.9, rng.random() < 0.2))
            at = end
    return spark.createDataFrame(rows, PARTS).repartition(3)


OPERATORS = {
    "smooth_islands": lambda r, n, ms: labels.smooth_islands(r, span=n),
    "fill_between": lambda r, n, ms: labels.fill_between(r, span=n),
    "inherit_tiny": lambda r, n, ms: labels.inherit_tiny(r, span=n),
    "fill_nearest": lambda r, n, ms: labels.fill_nearest(r, span=n),
    "fill_leading": lambda r, n, ms: labels.fill_leading(r, span=n),
    "renumber": lambda r, n, ms: labels.renumber(r, span=n),
    "compact_tiny": lambda r, n, ms: labels.compact_tiny(r, span=n),
    "merge_history": lambda r, n, ms: labels.merge_history(r, span_ms=ms),
    "enrich": lambda r, n, ms: labels.enrich(r, span=n, span_ms=ms),
    "saved_segments": lambda r, n, ms: reports.saved_segments(r, span=n),
    "speaker_blocks": lambda r, n, ms: reports.speaker_blocks(r, span=n),
    "coalesce_turns": lambda r, n, ms: intervals.coalesce_turns(turns(r), span_ms=ms),
    "change_points": lambda r, n, ms: intervals.change_points(turns(r), span=n),
    "on_sample_clock": lambda r, n, ms: chunks.on_sample_clock(r.select(F.col("tid").alias("session"), "seq", F.sequence(F.lit(1), F.col("seq") % 5 + 1).alias("samples")), 16, span=n),
}


def turns(rows):
    return rows.select("tid", F.col("seq").alias("turn_seq"), "start_ms", "end_ms", F.length("text").alias("speaker"))


def shown(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", OPERATORS)
def test_small_buckets_change_nothing(parts, name):
    whole = shown(OPERATORS[name](parts, WIDE, WIDE))
    assert shown(OPERATORS[name](parts, 2, 2500)) == whole
    assert OPERATORS[name](parts.limit(0), 2, 2500).count() == 0


def test_carried_values(spark):
    """Values, neighbours and sums against loops over plain lists, with empty buckets, nulls and places that are null."""
    rng = random.Random(1)
    rows = [(t, s * rng.choice([1, 1, 40]) if s else None, rng.choice([None, None, s])) for t in (None, 5, 6) for s in range(0, 60)]
    rows = list({(t, s): (t, s, v) for t, s, v in rows}.values())
    got = scans.carried(
        spark.createDataFrame(rows, "tid long, seq long, v long"), "tid", ["seq"], before={"l": F.col("v"), "p": F.struct("seq")}, after={"r": F.col("v"), "n": F.struct("seq")}, sums={"s": F.lit(1)}, span=7
    )
    want = []
    for t in (None, 5, 6):
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (r[1] is not None, r[1]))
        for i, (_, s, v) in enumerate(own):
            left = [x[2] for x in own[:i] if x[2] is not None]
            right = [x[2] for x in own[i + 1 :] if x[2] is not None]
            want.append((t, s, v, left[-1] if left else None, own[i - 1][1] if i else "none", right[0] if right else None, own[i + 1][1] if i + 1 < len(own) else "none", i + 1))
    rows = [(r["tid"], r["seq"], r["v"], r["l"], r["p"]["seq"] if r["p"] else "none", r["r"], r["n"]["seq"] if r["n"] else "none", r["s"]) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["fill_nearest", "renumber", "merge_history", "on_sample_clock"])
def test_one_long_timeline_spreads(spark, name):
    """No task makes over twice the median number of rows, though all rows are of one timeline."""
    n = 60_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("tid"), F.col("id").cast("int").alias("seq"), (F.col("id") * 2000).alias("start_ms"), (F.col("id") * 2000 + 500).alias("end_ms"), F.lit("x").alias("text"),
        F.when(F.col("id") % 5 < 2, F.concat(F.lit("speaker_"), (F.col("id") % 3).cast("string"))).alias("speaker_id"), F.lit("S").alias("speaker_label"), F.lit(True).alias("is_final"), F.lit(False).alias("is_new"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = OPERATORS[name](rows, 200, 400_000)
        counts = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(counts) == n and len(counts) == 4 and max(counts) <= 2 * statistics.median(counts)


def test_counters_since_a_recording_began(spark):
    rows = [(1, i, c, b) for i, (c, b) in enumerate([("borderline", None), ("engineOrThreshold", False), (None, False), ("engineOrThreshold", True), ("tooFewSamples", False), ("engineOrThreshold", False), (None, True)])]
    got = chunks.silence_counters(spark.createDataFrame([*rows, (2, 0, None, None)], "session int, chunk long, cause string, begins boolean"), span=2)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 1, 0), (1, 1, 2, 1), (1, 2, 2, 1), (1, 3, 1, 1), (1, 4, 1, 1), (1, 5, 2, 2), (1, 6, 0, 0), (2, 0, 0, 0)]


def test_recogniser_documents(spark, tmp_path):
    from zeitband.sources.timelines import recognised

    (tmp_path / "clip.json").write_text('{\n "segments": [{"start": 0.0004, "end": 1.2346, "text": "a", "words": []},\n {"end": 3}, {"start": 5.5, "text": null}]}')
    (tmp_path / "empty.json").write_text('{"segments": []}')
    (tmp_path / "broken.json").write_text('{"segments": [')
    got = recognised(spark, str(tmp_path), multi_line=True)
    assert sorted(tuple(r) for r in got.collect()) == [("clip", 1, 0, 1235, "a"), ("clip", 2, 0, 3000, None), ("clip", 3, 5500, 5500, None)]
