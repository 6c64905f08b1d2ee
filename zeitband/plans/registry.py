"""Queries over the driver tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zeitband.functions import text
from zeitband.operators import dedupe, intervals, labels, reports, splitting, store
from zeitband.sources.timelines import VIEWS, dealt_parts, parts, segments, turns
from zeitband.shared import scratch_folder
from zeitband.streaming.assign import stream_assign, without_turns
from zeitband.streaming.levels import file_stream, levels, run_levels
from zeitband.streaming.state import run_appended

from . import labelings, sessions, stores

SQL_VIEWS = VIEWS.format(lineitem="lineitem", part="part")
SHORT = "trim(speaker_id)"
WINDOW = "window w as (partition by tid order by seq)"
KEPT = "tid, seq, start_ms, end_ms, text"


def assign_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.assign_speakers(segments(spark, sf_dir), turns(spark, sf_dir))


def assignment_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_speakers(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


ASSIGN = f"""{SQL_VIEWS},
votes as (select s.tid, s.seq, t.speaker, min(t.turn_seq) as first_turn,
  cast(sum(least(greatest(s.end_ms, s.start_ms + 300), t.end_ms) - greatest(s.start_ms, t.start_ms)) as bigint) as overlap_ms
  from v_seg s join v_turn t on s.tid = t.tid and t.start_ms < greatest(s.end_ms, s.start_ms + 300) and t.end_ms > s.start_ms group by all),
best as (select * from votes qualify row_number() over (partition by tid, seq order by overlap_ms desc, first_turn) = 1),
r as (select s.tid, s.seq, s.start_ms, s.end_ms, s.text, s.speaker_id as old, b.overlap_ms, b.speaker,
  case when s.tid not in (select tid from v_turn) then 'noTurns' when b.overlap_ms is null then 'noOverlap' when b.overlap_ms < 80 then 'belowMinOverlap'
  when b.overlap_ms < 300 and 100 * b.overlap_ms < 35 * greatest(s.end_ms - s.start_ms, 300) then 'lowConfidence' else 'label' end as reason from v_seg s left join best b on s.tid = b.tid and s.seq = b.seq)
"""

ASSIGNED = f"{ASSIGN} select tid, seq, start_ms, end_ms, text, overlap_ms, reason, case when reason = 'label' then 'speaker_' || speaker when reason = 'noTurns' then old end as speaker_id from r"


def stream_assign_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and turns as two streams, an hour later than they are; a last row of each moves the watermark past all."""
    hour, end = 3_600_000, 10**12
    shift = lambda df: df.withColumns({"start_ms": F.col("start_ms") + hour, "end_ms": F.col("end_ms") + hour})
    own, heard = shift(segments(spark, sf_dir)), shift(turns(spark, sf_dir))
    last = spark.range(1).select(F.lit(-1).cast("long").alias("tid"), F.lit(end).alias("start_ms"), F.lit(end + 1).alias("end_ms"))
    place = scratch_folder(spark, "live")
    own.unionByName(last, allowMissingColumns=True).write.parquet(f"{place}/segments")
    heard.unionByName(last, allowMissingColumns=True).write.parquet(f"{place}/turns")
    made = run_appended(spark, stream_assign(file_stream(spark, f"{place}/segments"), file_stream(spark, f"{place}/turns")), "assigned")
    rows = without_turns(made.filter("tid >= 0"), spark.read.parquet(f"{place}/turns"))
    return rows.withColumns({"start_ms": F.col("start_ms") - hour, "end_ms": F.col("end_ms") - hour})


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.change_points(turns(spark, sf_dir))


def upsert_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).select("tid", "seq", "speaker_id", "start_ms")
    new = rows.filter("seq >= 3").withColumn("speaker_id", F.lit("speaker_9")).withColumn("start_ms", F.col("start_ms") + 1)
    return store.upsert(rows.filter("seq <= 4"), new.unionByName(new.withColumn("start_ms", F.col("start_ms") + 1)), ["tid", "seq"], "start_ms")


def delete_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments(spark, sf_dir).select("tid", "seq")
    return store.delete(rows, rows.filter("tid % 5 = 0").select("tid").distinct())


def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.from_documents(store.to_documents(segments(spark, sf_dir)))


def _on_segments(f):
    return lambda spark, sf_dir: f(segments(spark, sf_dir))


def _on_parts(f):
    """Segments with the texts of their labels, which go where the ids go."""
    return lambda spark, sf_dir: f(parts(spark, sf_dir)).select("tid", "seq", "speaker_id", "speaker_label")


def compare_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.compare(segments(spark, sf_dir), assign_speakers(spark, sf_dir))


def export_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("["), text.hms(F.col("start_ms")), F.lit("] "), F.coalesce("speaker_label", F.lit("Unbekannt")), F.lit(": "))
    return reports.speaker_blocks(parts(spark, sf_dir)).select("tid", "seq", F.concat(head, F.col("text")).alias("line"))


def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_long(segments(spark, sf_dir), turns(spark, sf_dir), longest_ms=4000)


def stream_hourly_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_levels(spark, f"{sf_dir}/events.parquet")


def ascii_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return docs.filter(text.ascii_like(F.col("text"), "THE")).select("conv_id", "turn")


def literal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return docs.filter(text.contains_text(F.col("text"), "An")).select("conv_id", "turn")


def hopping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = F.window("ts", "80 minutes", "60 minutes", "40 minutes")
    return events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")).select(F.unix_timestamp("w.start").alias("start_s"), "n", "first_event")


def hourly_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _block_sql(joins: str, source: str = "v_seg") -> str:
    return f"""{SQL_VIEWS}, j as (select *, case when {joins} then 0 else 1 end as new from {source} {WINDOW}),
k as (select *, sum(new) over (partition by tid order by seq rows between unbounded preceding and current row) as block from j)"""


MERGED = "select tid, min(seq) as seq, min(start_ms) as start_ms, max(end_ms) as end_ms, arg_min(coalesce(speaker_id, chr(1)), seq) as s, string_agg(text, ' ' order by seq) as text, count(*) as n_merged from k group by tid, block"
MERGED = f"select * exclude (s), nullif(s, chr(1)) as speaker_id from ({MERGED})"
WORDS = "len(string_split_regex(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '\\s+'))"

BLOCKS = f"""{SQL_VIEWS}, c as (select *, regexp_replace(regexp_replace(text, '^[\\s.,;:!?]+', ''), '\\s+$', '') as t from v_part),
j as (select *, case when lag(seq) over w is not null and speaker_label is not distinct from lag(speaker_label) over w then 0 else 1 end as new from c where t <> '' {WINDOW}),
k as (select *, sum(new) over (partition by tid order by seq) as block from j),
m as (select tid, min(seq) as seq, min(start_ms) as start_ms, any_value(speaker_label) as speaker_label, string_agg(t, {{between}} order by seq) as text from k group by tid, block)"""
SUMMARIES = """h as (select tid, trim(left(coalesce(arg_min(text, seq), 'Transkript'), 60)) as start, max(end_ms) as duration_ms, count(distinct speaker_id) as speaker_count from v_part group by tid),
t as (select tid, case when length(start) > 3 then start else 'Transkript vom 01.01.70 00:00' end as title, duration_ms, speaker_count, printf('%d:%02d Min', duration_ms // 60000, duration_ms // 1000 % 60) as length from h)"""


def _report_sql(head: str, part: str, between: str) -> str:
    return f"""{BLOCKS.format(between=between)}, {SUMMARIES},
p as (select tid, string_agg({part} || chr(10) || text || chr(10), '' order by seq) as body from m group by tid)
select tid, {head} || chr(10) || coalesce(body, '') as report from t left join p using (tid)"""


HMS = "printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60)"
HOURLY = "select cast(epoch(date_trunc('hour', ts)) as bigint) as start_s, round(sqrt(avg(value * value)), 6) as rms, max(abs(value)) as peak from events group by date_trunc('hour', ts)"

#: Each part with id and label of its neighbours, null where they have none.
NEIGHBOURS = f"""{SQL_VIEWS}, n as (select *, nullif(trim(speaker_id), '') as s, count(*) over (partition by tid, speaker_id) as k from v_part),
x as (select *, lag(s) over w as l, lag(speaker_label) over w as ll, lead(s) over w as r, lead(speaker_label) over w as rl, start_ms - lag(end_ms) over w as gl, lead(start_ms) over w - end_ms as gr,
 lag(end_ms - start_ms) over w as dl, lead(end_ms - start_ms) over w as dr from n {WINDOW}),
y as (select *, coalesce(s is null and l = r and (end_ms - start_ms <= 2000 or {WORDS} <= 3), false) as between_,
 coalesce(l = r and l <> s and end_ms - start_ms <= 2000 and {WORDS} <= 3 and 3 * (end_ms - start_ms) <= greatest(dl, dr) and k > 1, false) as island,
 s is null and (end_ms - start_ms <= 800 or length(trim(text)) <= 3) as tiny, gl between 0 and 500 and l is not null as by_left, gr between 0 and 500 and r is not null as by_right from x)"""


def _neighbour_sql(cases: str) -> str:
    return f"{NEIGHBOURS} select tid, seq, case {cases.format(l='l', r='r')} else speaker_id end as speaker_id, case {cases.format(l='ll', r='rl')} else speaker_label end as speaker_label from y"


QUERIES = {
    "assign_speakers": assign_speakers,
    "assignment_reasons": assignment_reasons,
    "stream_assign_speakers": stream_assign_speakers,
    "change_points": change_points,
    "smooth_islands": _on_segments(labels.smooth_islands),
    "fill_between": _on_segments(labels.fill_between),
    "inherit_tiny": _on_segments(labels.inherit_tiny),
    "fill_nearest": _on_segments(labels.fill_nearest),
    "fill_leading": _on_segments(labels.fill_leading),
    "smooth_labels": _on_parts(labels.smooth_islands),
    "fill_between_labels": _on_parts(labels.fill_between),
    "inherit_tiny_labels": _on_parts(labels.inherit_tiny),
    "fill_nearest_labels": _on_parts(labels.fill_nearest),
    "fill_leading_labels": _on_parts(labels.fill_leading),
    "renumber": _on_segments(labels.renumber),
    "compact_tiny": _on_segments(labels.compact_tiny),
    "assignment_quality": _on_segments(labels.quality),
    "compare_assignments": compare_assignments,
    "export_blocks": export_blocks,
    "upsert_segments": upsert_segments,
    "delete_transcripts": delete_transcripts,
    "document_round_trip": document_round_trip,
    "ascii_search": ascii_search,
    "literal_search": literal_search,
    "hopping_chunks": hopping_chunks,
    "hourly_peak": hourly_peak,
    "stream_hourly_peak": stream_hourly_peak,
    "split_long": split_long,
    "dedupe_texts": _on_segments(dedupe.dedupe_texts),
    "report_text": lambda spark, sf_dir: reports.report(dealt_parts(spark, sf_dir), markdown=False),
    "report_markdown": lambda spark, sf_dir: reports.report(dealt_parts(spark, sf_dir), markdown=True),
    "transcript_summaries": lambda spark, sf_dir: reports.summaries(parts(spark, sf_dir)),
    "saved_segments": lambda spark, sf_dir: reports.saved_segments(parts(spark, sf_dir)).select("tid", "seq", "sequence_index", "speaker_id", "speaker_label"),
    "history_lines": lambda spark, sf_dir: reports.history_line(parts(spark, sf_dir)),
}
ORACLES = {
    "assign_speakers": ASSIGNED,
    "stream_assign_speakers": ASSIGNED,
    "assignment_reasons": f"{ASSIGN} select reason, count(*) as n from r group by reason",
    "change_points": f"{SQL_VIEWS} select * from (select tid, turn_seq, start_ms, lag(speaker) over (partition by tid order by turn_seq) as before, speaker from v_turn) where before <> speaker",
    "smooth_islands": f"""{SQL_VIEWS}, x as (select *, lag(speaker_id) over w as l, lead(speaker_id) over w as r, lag(end_ms - start_ms) over w as dl, lead(end_ms - start_ms) over w as dr,
 count(*) over (partition by tid, speaker_id) as n from v_seg {WINDOW})
select {KEPT}, case when l = r and l <> speaker_id and end_ms - start_ms <= 2000 and {WORDS} <= 3 and 3 * (end_ms - start_ms) <= greatest(dl, dr) and n > 1 then l else speaker_id end as speaker_id from x""",
    "fill_between": f"""{SQL_VIEWS}, x as (select *, lag(speaker_id) over w as l, lead(speaker_id) over w as r from v_seg {WINDOW})
select {KEPT}, case when speaker_id is null and l = r and (end_ms - start_ms <= 2000 or {WORDS} <= 3) then l else speaker_id end as speaker_id from x""",
    "inherit_tiny": f"""{SQL_VIEWS}, x as (select *, case when start_ms - lag(end_ms) over w between 0 and 500 then lag(speaker_id) over w end as l, case when lead(start_ms) over w - end_ms between 0 and 500 then lead(speaker_id) over w end as r from v_seg {WINDOW})
select {KEPT}, case when speaker_id is null and (end_ms - start_ms <= 800 or length(trim(text)) <= 3) then coalesce(l, r) else speaker_id end as speaker_id from x""",
    "fill_nearest": f"""{SQL_VIEWS}, x as (select *, last_value(speaker_id ignore nulls) over (partition by tid order by seq rows between unbounded preceding and 1 preceding) as l,
 first_value(speaker_id ignore nulls) over (partition by tid order by seq rows between 1 following and unbounded following) as r from v_seg)
select {KEPT}, coalesce(speaker_id, case when l is null or r is null or l = r then coalesce(l, r) end) as speaker_id from x""",
    "fill_leading": f"""{SQL_VIEWS}, f as (select tid, start_ms as fs, speaker_id as fl from v_seg where speaker_id is not null qualify row_number() over (partition by tid order by start_ms, seq) = 1)
select {KEPT}, case when speaker_id is null and end_ms <= fs then fl else speaker_id end as speaker_id from v_seg left join f using (tid)""",
    "smooth_labels": _neighbour_sql("when island then {l}"),
    "fill_between_labels": _neighbour_sql("when between_ then {l}"),
    "inherit_tiny_labels": _neighbour_sql("when tiny and by_left then {l} when tiny and by_right then {r}"),
    "fill_nearest_labels": f"""{SQL_VIEWS}, n as (select *, nullif(trim(speaker_id), '') as s from v_part), o as (select *, case when s is not null then {{'s': s, 't': speaker_label}} end as own from n),
x as (select *, last_value(own ignore nulls) over (partition by tid order by seq rows between unbounded preceding and 1 preceding) as l,
 first_value(own ignore nulls) over (partition by tid order by seq rows between 1 following and unbounded following) as r from o),
y as (select *, case when s is null and (l is null or r is null or l.s = r.s) then coalesce(l, r) end as f from x)
select tid, seq, case when f is not null then f.s else speaker_id end as speaker_id, case when f is not null then f.t else speaker_label end as speaker_label from y""",
    "fill_leading_labels": f"""{SQL_VIEWS}, n as (select *, nullif(trim(speaker_id), '') as s from v_part),
f as (select tid, start_ms as fs, speaker_id as fi, speaker_label as fl from n where s is not null qualify row_number() over (partition by tid order by start_ms, seq) = 1)
select tid, seq, case when s is null and end_ms <= fs then fi else speaker_id end as speaker_id, case when s is null and end_ms <= fs then fl else speaker_label end as speaker_label from n left join f using (tid)""",
    "renumber": f"""{SQL_VIEWS}, x as (select *, case when speaker_id is not null then min(seq) over (partition by tid, speaker_id) end as f from v_seg)
select {KEPT}, speaker_id, case when f is not null then dense_rank() over (partition by tid order by f nulls last) end as speaker_no from x""",
    "compact_tiny": f"{_block_sql('(end_ms - start_ms < 600 or length(trim(text)) < 3) and start_ms - lag(end_ms) over w between 0 and 1200')} {MERGED}",
    "assignment_quality": f"""{SQL_VIEWS} select tid, count(speaker_id) as labeled, count(*) - count(speaker_id) as unlabeled, count(distinct speaker_id) as speakers,
 cast(coalesce(sum(end_ms - start_ms) filter (speaker_id is not null), 0) as bigint) as labeled_ms from v_seg group by tid""",
    "compare_assignments": f"""{ASSIGN}, z as (select r.tid, v.speaker_id as a, case when reason = 'label' then 'speaker_' || speaker when reason = 'noTurns' then old end as b from r join v_seg v on r.tid = v.tid and r.seq = v.seq)
select tid, count(*) filter (a is null and b is not null) as "new", count(*) filter (a <> b) as changed, count(*) filter (a is not null and b is null) as lost from z group by tid""",
    "export_blocks": f"""{BLOCKS.format(between="' '")} select tid, seq, '[' || {HMS} || '] ' || coalesce(speaker_label, 'Unbekannt') || ': ' || text as line from m""",
    "transcript_summaries": f"{SQL_VIEWS}, {SUMMARIES} select tid, title, duration_ms, speaker_count from t",
    "saved_segments": f"""{SQL_VIEWS} select tid, seq, row_number() over (partition by tid order by seq) - 1 as sequence_index, speaker_id,
  case when speaker_id is not null then coalesce(speaker_label, 'Sprecher 1') end as speaker_label from v_part""",
    "history_lines": f"{SQL_VIEWS}, {SUMMARIES} select tid, title || ' · ' || length || case when speaker_count > 0 then ' · ' || speaker_count || ' Sprecher' else '' end as line from t",
    "upsert_segments": f"""{SQL_VIEWS} select tid, seq, case when seq >= 3 then 'speaker_9' else speaker_id end as speaker_id, case when seq >= 3 then start_ms + 2 else start_ms end as start_ms from v_seg""",
    "delete_transcripts": f"{SQL_VIEWS} select tid, seq from v_seg where tid % 5 <> 0",
    "document_round_trip": f"{SQL_VIEWS} select tid, cast(seq as int) as seq, start_ms, end_ms, speaker_id, text from v_seg",
    "ascii_search": "select conv_id, turn from conversations where translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%the%'",
    "literal_search": "select conv_id, turn from conversations where contains(lower(text), 'an')",
    "hopping_chunks": """select cast(epoch(s) as bigint) as start_s, count(*) as n, min(event_id) as first_event from
 (select event_id, ts, unnest([time_bucket(interval '60 minutes', ts, timestamp '1970-01-01 00:40:00'), time_bucket(interval '60 minutes', ts, timestamp '1970-01-01 00:40:00') - interval '60 minutes']) as s from events) where ts < s + interval '80 minutes' group by s""",
    "hourly_peak": HOURLY,
    "stream_hourly_peak": HOURLY,
    "report_text": _report_sql("title || chr(10) || 'Dauer: ' || length || ' · Sprecher: ' || speaker_count", f"chr(10) || coalesce(speaker_label, '—') || ' ' || {HMS}", "chr(10)"),
    "report_markdown": _report_sql("'# ' || title || chr(10) || chr(10) || '**Dauer:** ' || length || ' · **Sprecher:** ' || speaker_count", f"chr(10) || '## ' || coalesce(speaker_label, 'Unbekannt') || ' · ' || {HMS}", "' '"),
    "split_long": f"""{SQL_VIEWS}, m as (select s.tid, s.seq, s.start_ms, s.end_ms, t.speaker, t.start_ms as cut, lag(t.speaker) over (partition by s.tid, s.seq order by t.start_ms, t.turn_seq) as before
 from v_seg s join v_turn t on s.tid = t.tid and t.start_ms < s.end_ms and t.end_ms > s.start_ms where s.end_ms - s.start_ms >= 4000),
k as (select distinct tid, seq, cut as a from m where before <> speaker and cut > start_ms and cut < end_ms),
e as (select * from k union all select tid, seq, start_ms from v_seg semi join k using (tid, seq) union all select tid, seq, end_ms from v_seg semi join k using (tid, seq)),
p as (select tid, seq, a, lead(a) over x as z, row_number() over x - 1 as part from e window x as (partition by tid, seq order by a) qualify z is not null),
w as (select p.*, s.speaker_id, s.start_ms, s.end_ms, string_split_regex(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '\\s+') as words from p join v_seg s using (tid, seq)),
o as (select w.tid, w.seq, part, t.speaker, sum(least(z, t.end_ms) - greatest(a, t.start_ms)) as ms, min(turn_seq) as first_turn from w join v_turn t on w.tid = t.tid and t.start_ms < z and t.end_ms > a group by all having ms >= 80),
best as (select * from o qualify row_number() over (partition by tid, seq, part order by ms desc, first_turn) = 1)
select tid, seq, part, a as start_ms, z as end_ms, coalesce('speaker_' || speaker, speaker_id) as speaker_id, coalesce(nullif(array_to_string(words[cast(floor(len(words) * (a - start_ms) / (end_ms - start_ms)) as int) + 1 : cast(floor(len(words) * (z - start_ms) / (end_ms - start_ms)) as int)], ' '), ''), '...') as text
from w left join best using (tid, seq, part) union all select tid, seq, 0, start_ms, end_ms, speaker_id, text from v_seg anti join k using (tid, seq)""",
}
for module in (labelings, stores, sessions):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
