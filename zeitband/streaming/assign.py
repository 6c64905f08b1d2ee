"""Speakers of segments while both segments and turns still come in: a join of two streams by time.

Rows of a timeline meet in slots of event time: a segment is in the slot of its start, a turn in all slots whose segments
it can reach. State is one row for each timeline and slot, which goes once the watermark is past the slot; segments leave
with it, once, with the winner, as in ``operators.intervals.assign_speakers``. (A join of the two streams would keep and
number each row by itself, and each segment once more for its votes.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zeitband.operators.intervals import assignment
from zeitband.operators.scans import told

#: The length of a slot, in longest segments.
SLOT = 5


def pieces(turns: DataFrame, longest_ms: int) -> DataFrame:
    """``turns`` cut into pieces of ``longest_ms`` at most: sums of overlaps stay what they are."""
    starts = F.explode(F.sequence(F.col("start_ms"), F.col("end_ms") - 1, F.lit(longest_ms)))
    cut = turns.filter("end_ms > start_ms").select("tid", "turn_seq", "speaker", "end_ms", starts.alias("t_start"))
    return cut.select(F.col("tid").alias("t_tid"), "turn_seq", "speaker", "t_start", F.least("end_ms", F.col("t_start") + longest_ms).alias("t_end"))


def _winner() -> Column:
    """The struct (overlap_ms, -first turn, speaker) that is largest."""
    heard = F.filter("__votes", lambda v: v["speaker"].isNotNull())
    own = lambda s: F.filter(heard, lambda v: v["speaker"] == s)
    total = lambda s: F.aggregate(own(s), F.lit(0).cast("bigint"), lambda a, v: a + v["ms"])
    sums = F.transform(F.array_distinct(F.transform(heard, lambda v: v["speaker"])), lambda s: F.struct(total(s).alias("overlap_ms"), (-F.array_min(F.transform(own(s), lambda v: v["turn_seq"]))).alias("place"), s.alias("speaker")))
    return F.array_max(sums)


def stream_assign(segments: DataFrame, turns: DataFrame, longest_ms: int = 60_000, late: str = "60 seconds") -> DataFrame:
    """Two streams, ``segments`` (tid, seq, start_ms, end_ms, speaker_id, text) and ``turns`` (tid, turn_seq, start_ms,
    end_ms, speaker), in milliseconds since 1970: the segments with overlap_ms, speaker_id and reason.

    Rows may come in any order within ``late`` (a turn is as old as its start, so that must cover the longest turn);
    rows whose slot the watermark is past are dropped. Segments last ``longest_ms`` at most; the overlap of longer ones
    with turns that begin later than that behind their start is not counted. A segment without overlap is unlabeled:
    whether its timeline will ever have a turn isn't known on a stream (``without_turns`` settles that afterwards).
    A segment leaves when the watermark of both streams is past its slot and all that could overlap it.
    """
    width = SLOT * longest_ms
    # Slots begin at odd halves, as recordings often begin at a full one.
    slot = lambda at: F.floor((at + width // 2) / width)
    until = lambda s: F.timestamp_millis(((s + 1) * width - width // 2).cast("bigint"))
    delay = f"{late} {width + 2 * longest_ms} milliseconds"
    own = F.struct("seq", "start_ms", "end_ms", "speaker_id", "text")
    rows = segments.select("tid", until(slot(F.col("start_ms"))).alias("__slot"), own.alias("__segment")).withWatermark("__slot", delay)
    reach = F.explode(F.sequence(slot(F.col("t_start") - longest_ms), slot(F.col("t_end") - 1)))
    heard = pieces(turns, longest_ms).filter("t_tid is not null").select(F.col("t_tid").alias("tid"), F.struct("speaker", "turn_seq", "t_start", "t_end").alias("__turn"), reach.alias("__n"))
    heard = heard.select("tid", until(F.col("__n")).alias("__slot"), "__turn").withWatermark("__slot", delay)
    met = rows.unionByName(heard, allowMissingColumns=True).groupBy("tid", "__slot").agg(F.collect_list("__segment").alias("__segments"), F.collect_list("__turn").alias("__turns"))
    each = met.select("tid", "__turns", F.explode("__segments").alias("s")).select("tid", "__turns", "s.*")
    end = F.greatest("end_ms", F.col("start_ms") + 300)
    near = F.filter("__turns", lambda t: (t["t_start"] < end) & (t["t_end"] > F.col("start_ms")) & t["t_start"].between(F.col("start_ms") - longest_ms, F.col("start_ms") + longest_ms))
    votes = F.transform(near, lambda t: F.struct(t["speaker"].alias("speaker"), (F.least(end, t["t_end"]) - F.greatest("start_ms", t["t_start"])).alias("ms"), t["turn_seq"].alias("turn_seq")))
    best = each.withColumn("__votes", votes).withColumn("__best", _winner()).withColumns({"overlap_ms": F.col("__best.overlap_ms"), "speaker": F.col("__best.speaker"), "own_id": F.col("speaker_id")})
    return assignment(best, F.lit(True)).select("tid", "seq", "start_ms", "end_ms", "text", "overlap_ms", "speaker_id", "reason", "own_id")


def without_turns(assigned: DataFrame, turns: DataFrame) -> DataFrame:
    """What ``stream_assign`` gave, once all turns are there: segments of timelines without any turn keep their labels."""
    rows = told(assigned, ["tid"], turns.select("tid").distinct().withColumn("__heard", F.lit(True)))
    none = F.col("__heard").isNull()
    kept = {"reason": F.when(none, "noTurns").otherwise(F.col("reason")), "speaker_id": F.when(none, F.col("own_id")).otherwise(F.col("speaker_id"))}
    return rows.withColumns(kept).drop("__heard", "own_id")
