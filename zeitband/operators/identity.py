"""Identities of speakers: similarity to known voices, and matching of local to global numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted
from .intervals import overlaps
from .neighbours import scored, unit

def mean_voices(rows: DataFrame) -> DataFrame:
    """session, speaker and the mean of its embeddings: sums by dimension are combined before the shuffle."""
    parts = rows.select("session", "speaker", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("session", "speaker", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("session", "speaker").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("voice"))


def identify(queries: DataFrame, bank: DataFrame, threshold: float = 0.62, pending_threshold: float = 0.35) -> DataFrame:
    """vec_id, similarity and speaker of the voice of the same session that is most similar; the speaker is null up to
    the threshold, and ties go to the least one. Voices may be pending (``pending``, if the bank has that column): they
    have a threshold of their own, and give way to a confirmed voice that is as similar. ``queries`` has session, vec_id
    (unique) and embedding; without a voice in its session a query has similarity 0, as it has to unlike and zero
    vectors."""
    voices = bank if "pending" in bank.columns else bank.withColumn("pending", F.lit(False))
    voices = voices.withColumn("pending", F.coalesce("pending", F.lit(False)))
    found = scored(queries, voices)
    best = found.groupBy("vec_id").agg(F.max(F.struct("similarity", (~F.col("pending")).alias("sure"), (-F.col("speaker")).alias("place"))).alias("b"))
    needed = F.when(F.col("b.sure"), threshold).otherwise(pending_threshold)
    named = best.select("vec_id", F.col("b.similarity").alias("similarity"), F.when(F.col("b.similarity") > needed, -F.col("b.place")).alias("speaker"))
    # A voice that can't be compared counts as similar by 0, which is more than what is below.
    sizes = unit(voices.select("session", "voice"), "voice", "v").groupBy("session").agg(F.min("dim").alias("small"), F.max("dim").alias("large"))
    asked = unit(queries.select("session", "vec_id", "embedding"), "embedding", "u").select("session", "vec_id", "dim")
    rows = asked.join(sizes, "session", "left").join(named, "vec_id", "left")
    unlike = F.coalesce((F.col("small") != F.col("dim")) | (F.col("large") != F.col("dim")), F.lit(False))
    value = F.coalesce("similarity", F.lit(0.0))
    return rows.select("vec_id", F.when(unlike, F.greatest(value, F.lit(0.0))).otherwise(value).alias("similarity"), "speaker")


def best_confirmed(queries: DataFrame, bank: DataFrame) -> DataFrame:
    """vec_id and the largest similarity to any voice of its session, 0 without one."""
    return identify(queries, bank, threshold=2.0).select("vec_id", "similarity")


# Matching of one chunk's speakers to those of the session.


def significant_turns(turns: DataFrame, fragment_ms: int = 400, aggregate_ms: int = 2000) -> DataFrame:
    """tid, turn_seq, speaker, start_ms, end_ms of turns of ``fragment_ms`` at least. Where a timeline has none of these,
    each speaker whose fragments last ``aggregate_ms`` in all becomes one turn from the first to the last of them."""
    ms = F.col("end_ms") - F.col("start_ms")
    rows = turns.select("tid", "turn_seq", "speaker", "start_ms", "end_ms")
    whole = rows.filter(ms >= fragment_ms)
    broken = rows.join(whole.select("tid").distinct(), "tid", "left_anti")
    sums = broken.groupBy("tid", "speaker").agg(F.min("turn_seq").alias("turn_seq"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum(ms).alias("ms"))
    return whole.unionByName(sums.filter(F.col("ms") >= aggregate_ms).drop("ms"))


def overlap_votes(local: DataFrame, world: DataFrame, zones: DataFrame) -> DataFrame:
    """Overlap of each pair of local and global speaker inside the zone of their timeline (tid, zone_start, zone_end),
    both sides clipped to it, and the first turns that each has in it."""

    def clip(turns: DataFrame, name: str) -> DataFrame:
        inside = turns.join(zones, "tid")
        return inside.select("tid", F.col("speaker").alias(name), F.col("turn_seq").alias(f"{name}_first"), F.greatest("start_ms", "zone_start").alias("start_ms"), F.least("end_ms", "zone_end").alias("end_ms"))

    met = overlaps(clip(local, "local"), clip(world, "global"), "tid")
    return met.groupBy("tid", "local", "global").agg(F.sum("overlap_ms").alias("overlap_ms"), F.min("local_first").alias("local_first"), F.min("global_first").alias("global_first"))


def greedy_pairs(votes: list[tuple[int, int, int]], least_ms: int) -> Iterator[tuple[int, int, int]]:
    """One-to-one pairs of (local, global, overlap_ms) votes in their order."""
    left, right = set(), set()
    for a, b, ms in votes:
        if ms >= least_ms and a not in left and b not in right:
            left.add(a)
            right.add(b)
            yield a, b, ms


def match_greedily(votes: DataFrame, least_ms: int = 300) -> DataFrame:
    """One-to-one pairs of local and global speaker per timeline, the largest overlap first; ties go to the local, then
    the global speaker whose turn comes first. A timeline has few speakers, so its votes are one small group."""

    def fold(own: Iterable[dict]) -> Iterator[tuple]:
        rows = list(own)
        for pair in greedy_pairs([(r["local"], r["global"], r["overlap_ms"]) for r in rows], least_ms):
            yield (rows[0]["tid"], *pair)

    ordered = votes.filter(F.col("overlap_ms") >= least_ms).withColumn("less", -F.col("overlap_ms"))
    return fold_sorted(ordered, "tid", ["less", "local_first", "global_first", "local", "global"], fold, votes.select("tid", "local", "global", "overlap_ms").schema)


def speaker_mapping(local: DataFrame, world: DataFrame, zones: DataFrame, least_ms: int = 300, fragment_ms: int = 400, aggregate_ms: int = 2000) -> DataFrame:
    """tid, local, speaker and is_new: the session's number of each local speaker that has a significant turn. Speakers
    without a match get new numbers in ascending order, from the largest that the session has in significant turns."""
    own = significant_turns(local, fragment_ms, aggregate_ms)
    old = world.filter((F.col("end_ms") - F.col("start_ms") >= fragment_ms) & (F.col("end_ms") > F.col("start_ms")))
    pairs = match_greedily(overlap_votes(own, old, zones), least_ms)
    speakers = own.groupBy("tid", F.col("speaker").alias("local")).agg(F.lit(1).alias("n")).drop("n")
    top = old.groupBy("tid").agg(F.max("speaker").alias("top"))
    found = speakers.join(pairs.select("tid", "local", "global"), ["tid", "local"], "left").join(top, "tid", "left")
    is_new = F.col("global").isNull()
    fresh = F.count_if(is_new).over(Window.partitionBy("tid").orderBy("local").rowsBetween(Window.unboundedPreceding, 0))
    return found.select("tid", "local", F.coalesce("global", F.coalesce("top", F.lit(-1)) + fresh).cast("bigint").alias("speaker"), is_new.alias("is_new"))


def reconcile(local: DataFrame, world: DataFrame, zones: DataFrame, least_ms: int = 300, fragment_ms: int = 400, aggregate_ms: int = 2000) -> DataFrame:
    """tid, turn_seq, local, speaker, start_ms, end_ms of the significant turns of a chunk in the session's numbers."""
    own = significant_turns(local, fragment_ms, aggregate_ms).withColumnRenamed("speaker", "local")
    return own.join(speaker_mapping(local, world, zones, least_ms, fragment_ms, aggregate_ms).drop("is_new"), ["tid", "local"])
