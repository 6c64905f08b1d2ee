"""Long segments cut where the speaker changes. Rows: tid, seq, start_ms, end_ms, speaker_id, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlaps


def split_long(segments: DataFrame, turns: DataFrame, longest_ms: int = 8000, least_ms: int = 80) -> DataFrame:
    """Segments of ``longest_ms`` or more that overlap turns of two speakers at least are cut at every change of
    speaker among those turns (in order of start); the words are dealt to the parts by time, and each part takes the
    speaker who overlaps it most, if by ``least_ms``, else the label of the segment. A part without words is "...".
    Parts are numbered by ``part``; all other segments stay as they are, as part 0.
    """
    long_ = segments.filter(F.col("end_ms") - F.col("start_ms") >= longest_ms)
    met = overlaps(long_.select("tid", "seq", "start_ms", "end_ms"), turns.select("tid", "turn_seq", "speaker", "start_ms", "end_ms"), "tid")
    met = met.select("tid", "seq", "start_ms", "end_ms", "turn_seq", "speaker", "r_start_ms", "overlap_ms")
    before = F.lag("speaker").over(Window.partitionBy("tid", "seq").orderBy("r_start_ms", "turn_seq"))
    # A cut lies strictly inside the segment; a change at or before its start cuts nothing.
    cut = F.when((before != F.col("speaker")) & (F.col("r_start_ms") > F.col("start_ms")) & (F.col("r_start_ms") < F.col("end_ms")), F.col("r_start_ms"))
    cuts = met.withColumn("cut", cut).groupBy("tid", "seq").agg(F.array_sort(F.collect_set("cut")).alias("cuts")).filter(F.size("cuts") > 0)
    edges = F.concat(F.array("start_ms"), F.col("cuts"), F.array("end_ms"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda i: F.struct(F.get("edges", i).alias("a"), F.get("edges", i + 1).alias("z")))
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), r"\s+")
    rows = segments.join(cuts, ["tid", "seq"], "left")
    whole = F.array(F.struct(F.col("start_ms").alias("a"), F.col("end_ms").alias("z")))
    rows = rows.withColumn("edges", edges).withColumn("pieces", F.when(F.col("cuts").isNull(), whole).otherwise(pieces)).withColumn("words", words)
    parts = rows.select("tid", "seq", "start_ms", "end_ms", "speaker_id", "text", "words", F.col("cuts").isNotNull().alias("is_cut"), F.posexplode("pieces").alias("part", "p"))
    length = F.col("end_ms") - F.col("start_ms")
    place = lambda x: F.floor(F.size("words") * (x - F.col("start_ms")) / length).cast("int")
    some = F.array_join(F.slice("words", place(F.col("p.a")) + 1, place(F.col("p.z")) - place(F.col("p.a"))), " ")
    text = F.when(F.col("is_cut"), F.coalesce(F.nullif(some, F.lit("")), F.lit("..."))).otherwise(F.col("text"))
    parts = parts.select("tid", "seq", "part", "is_cut", "speaker_id", text.alias("text"), F.col("p.a").alias("start_ms"), F.col("p.z").alias("end_ms"))
    votes = overlaps(parts.filter("is_cut").select("tid", "seq", "part", "start_ms", "end_ms"), turns.select("tid", "turn_seq", "speaker", "start_ms", "end_ms"), "tid")
    votes = votes.groupBy("tid", "seq", "part", "speaker").agg(F.sum("overlap_ms").alias("overlap_ms"), F.min("turn_seq").alias("first_turn")).filter(F.col("overlap_ms") >= least_ms)
    best = votes.groupBy("tid", "seq", "part").agg(F.max(F.struct("overlap_ms", -F.col("first_turn"), "speaker")).alias("best"))
    named = F.concat(F.lit("speaker_"), F.col("best.speaker").cast("string"))
    return parts.join(best, ["tid", "seq", "part"], "left").select("tid", "seq", F.col("part").cast("long").alias("part"), "start_ms", "end_ms", F.coalesce(named, "speaker_id").alias("speaker_id"), "text")
