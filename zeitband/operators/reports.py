"""Transcripts as they are saved, and their reports: plain text and Markdown, one text per timeline.

Rows: tid, seq, start_ms, end_ms, speaker_id, speaker_label, text. Blocks go by label; null labels form blocks too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zeitband.functions.text import clean_text, count_text, date_text, duration, hms, trimmed

from .labels import collapse
from .scans import SPAN, carried


def summaries(segments: DataFrame, created_ms: int = 0, title_chars: int = 60) -> DataFrame:
    """tid, title (the first characters of the first text, trimmed; the date if that leaves three or fewer),
    duration_ms (the last end) and speaker_count (distinct ids, blank ones too) of each timeline."""
    start = _title(F.min_by("text", "seq"), title_chars)
    rows = segments.groupBy("tid").agg(start.alias("start"), F.max("end_ms").alias("duration_ms"), F.count_distinct("speaker_id").alias("speaker_count"))
    return rows.select("tid", _dated("start", created_ms).alias("title"), "duration_ms", "speaker_count")


def _title(first: Column, chars: int = 60) -> Column:
    return trimmed(F.substring(F.coalesce(first, F.lit("Transkript")), 1, chars))


def _dated(start: str, created_ms: int = 0) -> Column:
    dated = F.concat(F.lit("Transkript vom "), date_text(F.lit(created_ms).cast("bigint"), "dd.MM.yy HH:mm"))
    return F.when(F.length(start) > 3, F.col(start)).otherwise(dated)


def saved_segments(segments: DataFrame, span: int = SPAN) -> DataFrame:
    """Segments as they are saved: numbered from 0, with a label exactly if they have an id."""
    rows = carried(segments, "tid", ["seq"], sums={"sequence_index": F.lit(1).cast("long")}, span=span)
    named = F.when(F.col("speaker_id").isNotNull(), F.coalesce("speaker_label", F.lit("Sprecher 1")))
    return rows.withColumn("sequence_index", F.col("sequence_index") - 1).withColumn("speaker_label", named)


def speaker_blocks(segments: DataFrame, between: str = " ", span: int = SPAN) -> DataFrame:
    """Runs of segments of one label (or of none) as one row each; blank texts are left out first."""
    rows = segments.withColumn("text", clean_text(F.col("text"))).filter("text <> ''").withColumn("speaker_id", F.col("speaker_label"))
    met = carried(rows, "tid", ["seq"], before={"__left": F.struct("speaker_label")}, span=span)
    same = F.col("__left").isNotNull() & F.col("speaker_label").eqNullSafe(F.col("__left.speaker_label"))
    return collapse(met, same, between, span).withColumnRenamed("speaker_id", "speaker_label")


def report(segments: DataFrame, markdown: bool) -> DataFrame:
    """tid and report of each timeline. A report is one text, so all of a timeline meets in one row: blocks are made where
    timelines are dealt, blank texts in them count for the head alone."""
    said = F.when(clean_text(F.col("text")) != "", F.struct("seq", clean_text(F.col("text")).alias("text")))
    rows = segments.withColumn("__said", said)
    met = carried(rows, "tid", ["seq"], before={"__left": F.when(F.col("__said").isNotNull(), F.struct("speaker_label"))}, span=None)
    same = F.col("__left").isNotNull() & F.col("speaker_label").eqNullSafe(F.col("__left.speaker_label"))
    whole = carried(met, "tid", ["seq"], sums={"__block": F.when(same | F.col("__said").isNull(), 0).otherwise(1)}, span=None)
    here = lambda c: F.when(F.col("__said").isNotNull(), F.col(c))
    blocks = whole.groupBy("tid", "__block").agg(
        F.min_by("text", "seq").alias("first"),
        F.min("seq").alias("first_seq"),
        F.max("end_ms").alias("end_ms"),
        F.collect_set("speaker_id").alias("ids"),
        F.min(here("seq")).alias("seq"),
        F.min(here("start_ms")).alias("start_ms"),
        F.min_by("speaker_label", here("seq")).alias("speaker_label"),
        F.array_join(F.array_sort(F.collect_list("__said"))["text"], " " if markdown else "\n").alias("text"),
    )
    name = F.coalesce("speaker_label", F.lit("Unbekannt" if markdown else "—"))
    part = F.concat(F.lit("\n## "), name, F.lit(" · "), hms(F.col("start_ms"))) if markdown else F.concat(F.lit("\n"), name, F.lit(" "), hms(F.col("start_ms")))
    one = F.when(F.col("seq").isNotNull(), F.struct("seq", F.concat(part, F.lit("\n"), "text", F.lit("\n")).alias("part")))
    made = blocks.groupBy("tid").agg(
        _title(F.min_by("first", "first_seq")).alias("start"),
        F.max("end_ms").alias("duration_ms"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("speaker_count"),
        F.array_sort(F.collect_list(one)).alias("parts"),
    )
    length, speakers = duration(F.col("duration_ms")), F.col("speaker_count").cast("string")
    if markdown:
        head = F.concat(F.lit("# "), "title", F.lit("\n\n**Dauer:** "), length, F.lit(" · **Sprecher:** "), speakers, F.lit("\n"))
    else:
        head = F.concat("title", F.lit("\nDauer: "), length, F.lit(" · Sprecher: "), speakers, F.lit("\n"))
    # A null key is no timeline whose texts could be told from others.
    body = F.when(F.col("tid").isNotNull(), F.array_join(F.col("parts")["part"], "")).otherwise("")
    return made.withColumn("title", _dated("start")).select("tid", F.concat(head, body).alias("report"))


def history_line(segments: DataFrame) -> DataFrame:
    """tid and what a list of transcripts shows of it: title, length, and the number of speakers if there are any."""
    rows = summaries(segments)
    return rows.select("tid", F.concat_ws(" · ", "title", duration(F.col("duration_ms")), F.nullif(count_text(F.col("speaker_count")), F.lit(""))).alias("line"))
