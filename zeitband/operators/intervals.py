"""Joins and edits of time intervals. All joins are keyed by timeline and time bucket, so long timelines spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import SPAN, SPAN_MS, carried

BUCKET_MS = 60_000


def overlaps(left: DataFrame, right: DataFrame, key: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of rows of one key whose intervals overlap, and overlap_ms. Both sides have start_ms and end_ms, other
    columns must differ by name; ``right``'s interval is named r_start_ms and r_end_ms. A pair meets in every bucket
    that both touch and counts in the one where its overlap begins."""
    buckets = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket_ms), F.floor(F.col(e) / bucket_ms)))
    a = left.filter("end_ms > start_ms").withColumn("bucket", buckets("start_ms", "end_ms"))
    b = right.filter("end_ms > start_ms").withColumnsRenamed({"start_ms": "r_start_ms", "end_ms": "r_end_ms"}).withColumn("bucket", buckets("r_start_ms", "r_end_ms"))
    begin = F.greatest("start_ms", "r_start_ms")
    pairs = a.join(b, [key, "bucket"]).filter((F.col("r_start_ms") < F.col("end_ms")) & (F.col("r_end_ms") > F.col("start_ms")) & (F.floor(begin / bucket_ms) == F.col("bucket")))
    return pairs.withColumn("overlap_ms", F.least("end_ms", "r_end_ms") - begin).drop("bucket")


def assignment(rows: DataFrame, heard: Column, least_ms: int = 80, sure_ms: int = 300, sure_percent: int = 35) -> DataFrame:
    """``rows`` with the gates put to their winner (overlap_ms, speaker): reason, and speaker_id by it."""
    duration = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(300))
    reason = (
        F.when(~heard, "noTurns")
        .when(F.col("overlap_ms").isNull(), "noOverlap")
        .when(F.col("overlap_ms") < least_ms, "belowMinOverlap")
        .when((F.col("overlap_ms") < sure_ms) & (100 * F.col("overlap_ms") < sure_percent * duration), "lowConfidence")
        .otherwise("label")
    )
    named = F.when(F.col("reason") == "label", F.concat(F.lit("speaker_"), F.col("speaker").cast("string"))).when(F.col("reason") == "noTurns", F.col("speaker_id"))
    return rows.withColumn("reason", reason).withColumn("speaker_id", named).drop("speaker")


def assign_speakers(segments: DataFrame, turns: DataFrame, least_ms: int = 80, sure_ms: int = 300, sure_percent: int = 35) -> DataFrame:
    """Label each segment with the speaker whose turns overlap it most; ties go to the speaker whose turn comes first.

    Segments count as 300 ms long at least. A winner needs ``least_ms`` of overlap, and ``sure_ms`` or
    ``sure_percent`` of the segment; else the segment is unlabeled, and ``reason`` says why. No row is lost. Timelines
    without any turn keep the labels that they have (``noTurns``).
    """
    wide = segments.select("tid", "seq", "start_ms", F.greatest("end_ms", F.col("start_ms") + 300).alias("end_ms"))
    votes = overlaps(wide, turns, "tid").groupBy("tid", "seq", "speaker").agg(F.sum("overlap_ms").alias("overlap_ms"), F.min("turn_seq").alias("first_turn"))
    best = votes.groupBy("tid", "seq").agg(F.max(F.struct("overlap_ms", -F.col("first_turn"), "speaker")).alias("best")).select("tid", "seq", "best.overlap_ms", "best.speaker")
    heard = turns.select("tid").distinct().withColumn("__heard", F.lit(True))
    rows = segments.join(best, ["tid", "seq"], "left").join(heard, "tid", "left")
    return assignment(rows, F.col("__heard").isNotNull(), least_ms, sure_ms, sure_percent).drop("__heard")


def replace_interval(kept: DataFrame, added: DataFrame, zones: DataFrame, margin_ms: int = 10) -> DataFrame:
    """Turns of ``kept`` give way to ``added`` from the zone of their timeline on (``zones``: tid, zone_start, zone_end).

    Turns that end ``margin_ms`` before the zone stay; those that begin before it end where it begins; those that begin
    in it or behind it go. Timelines without a zone stay as they are; ``added`` is taken as it is.
    """
    rows = kept.join(zones.select("tid", "zone_start", "zone_end"), "tid", "left")
    ends = F.col("end_ms") <= F.col("zone_start") - margin_ms
    into = (F.col("start_ms") < F.col("zone_end") + margin_ms) & (F.col("start_ms") < F.col("zone_start"))
    left = rows.filter(F.col("zone_start").isNull() | ends | into)
    clipped = F.when(F.col("zone_start").isNull() | ends, F.col("end_ms")).otherwise(F.col("zone_start"))
    return left.withColumn("end_ms", clipped).select(*kept.columns).unionByName(added)


def coalesce_turns(turns: DataFrame, margin_ms: int = 10, span_ms: int = SPAN_MS) -> DataFrame:
    """Neighbouring turns of one speaker, in order of start, that overlap or lie up to ``margin_ms`` apart, as one:
    tid, turn_seq (of the first), speaker, start_ms, end_ms, n_merged."""
    order = ["start_ms", "turn_seq"]
    rows = carried(turns.select("tid", "turn_seq", "speaker", "start_ms", "end_ms"), "tid", order, before={"__left": F.col("speaker")}, span=span_ms)
    rows = carried(rows, "tid", order, sums={"run": F.when(F.col("__left") == F.col("speaker"), 0).otherwise(1)}, span=span_ms)
    within = Window.partitionBy("tid", "run").orderBy(*order)
    reach = F.max("end_ms").over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("apart", F.when(F.col("start_ms") <= reach + margin_ms, 0).otherwise(1))
    rows = rows.withColumn("block", F.sum("apart").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("tid", "run", "block").agg(F.min_by("turn_seq", F.struct("start_ms", "turn_seq")).alias("turn_seq"), F.first("speaker").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_merged")).drop("run", "block")


def longest_turns(turns: DataFrame, keys: list[str]) -> DataFrame:
    """The longest turn of each group; of equals the one with the least turn_seq."""
    best = turns.groupBy(*keys).agg(F.max(F.struct((F.col("end_ms") - F.col("start_ms")).alias("ms"), (-F.col("turn_seq")).alias("place"), F.struct("turn_seq", "start_ms", "end_ms").alias("turn"))).alias("b"))
    return best.select(*keys, "b.turn.turn_seq", "b.turn.start_ms", "b.turn.end_ms")


def change_points(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """Turns whose speaker differs from that of the turn before."""
    met = carried(turns, "tid", ["turn_seq"], before={"__left": F.struct("speaker")}, span=span)
    return met.withColumn("before", F.col("__left.speaker")).filter("before <> speaker").select("tid", "turn_seq", "start_ms", "before", "speaker")
