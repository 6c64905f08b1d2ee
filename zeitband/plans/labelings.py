"""Queries over labelings of transcripts, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zeitband.operators import candidates as c
from zeitband.operators import chunks, identity, intervals, labels, metrics
from zeitband.shared import scratch_folder, stored
from zeitband.sources.timelines import VIEWS, candidates, confirmed, parts, turns
from zeitband.sources.versions import buckets_for
from zeitband.streaming.layers import CHANGE, LiveLayers

SQL_VIEWS = VIEWS.format(lineitem="lineitem", part="part")
#: Ids and labels of the labeled segments on either side, and what is known of each timeline.
SIDES = f"""{SQL_VIEWS},
p as (select *, nullif(trim(speaker_id), '') as id, try_cast(replace(speaker_id, 'speaker_', '') as int) as num from v_part),
d as (select *, nullif(trim(speaker_id), '') as id, try_cast(replace(speaker_id, 'speaker_', '') as int) as num from v_cand)"""
ROW = "tid, seq, start_ms, end_ms"


def raw_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unlabeled_new(parts(spark, sf_dir))


def unlabeled_new(rows: DataFrame) -> DataFrame:
    """``parts`` as they were before they got labels: none on those that are new."""
    return rows.withColumns({x: F.when(~F.col("is_new"), F.col(x)) for x in ("speaker_id", "speaker_label")})


def _short(rows: DataFrame) -> DataFrame:
    return rows.select("tid", "seq", "start_ms", "end_ms", "speaker_id", "speaker_label")


def _two(f):
    """A query of ``parts`` and ``candidates``."""
    return lambda spark, sf_dir: f(parts(spark, sf_dir), candidates(spark, sf_dir))


def _sure(f):
    """A query of ``parts`` and the confirmed speakers."""
    return lambda spark, sf_dir: _short(f(parts(spark, sf_dir), confirmed(spark, sf_dir)))


def overlay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(c.overlay(raw_parts(spark, sf_dir), candidates(spark, sf_dir)))


def merge_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(c.merge_candidate(raw_parts(spark, sf_dir), parts(spark, sf_dir), candidates(spark, sf_dir), confirmed(spark, sf_dir)))


def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.session_ids(candidates(spark, sf_dir), parts(spark, sf_dir))


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, vec_id, speaker and embedding; embeddings lean towards their labels."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    mixed = F.transform("embedding", lambda x, i: x.cast("double") * 0.7 + F.when(i == F.col("label"), 1.0).otherwise(0.0))
    return rows.select((F.col("vec_id") % 4).alias("session"), "vec_id", F.col("label").alias("speaker"), mixed.alias("embedding"))


def identify_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voices(spark, sf_dir)
    return identity.identify(rows.drop("speaker"), identity.mean_voices(rows))


def voice_matches(spark: SparkSession, sf_dir: str, rows: DataFrame, place: str) -> DataFrame:
    """The voices that rows are taken to be spoken in, one after the other, and the speaker that each is identified as."""
    known = identify_voices(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    heard = rows.select("tid", place, ((F.col("tid") * 7 + F.col(place)) % n).alias("vec_id"))
    return heard.join(known, "vec_id").select("tid", place, F.col("speaker").cast("int").alias("matched"))


def correct_by_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir)
    return _short(c.correct_by_voice(rows, voice_matches(spark, sf_dir, rows, "seq")))


def commit_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(parts(spark, sf_dir))
    return c.commit(_short(raw_parts(spark, sf_dir)), rows, candidates(spark, sf_dir), confirmed(spark, sf_dir))


def commit_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run: every fourth timeline has no candidate, and of these every other one a labeling that was dropped."""
    rows = _short(parts(spark, sf_dir))
    dropped = rows.filter("tid % 8 = 0").withColumns({"speaker_id": F.concat(F.lit("speaker_"), (F.col("seq") % 3).cast("string")), "speaker_label": F.lit("spät")})
    return c.commit(_short(raw_parts(spark, sf_dir)), rows, candidates(spark, sf_dir).filter("tid % 4 > 0"), confirmed(spark, sf_dir), final=True, preserved=c.preserve(rows, dropped))


def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final segments under the candidate's labels, those that are not final as texts being spoken."""
    rows = parts(spark, sf_dir)
    return c.display(rows.filter("is_final"), candidates(spark, sf_dir), rows.filter("not is_final")).select("tid", "place", "seq", "start_ms", "end_ms", "speaker_id", "n_merged")


def live_changes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three batches of changes: every other part; the others, with some labels; all labels (some of them again), and some
    parts as they are."""
    rows = parts(spark, sf_dir).select(F.lit("segment").alias("kind"), F.lit(0).cast("long").alias("at"), "tid", F.col("seq").cast("int").alias("seq"), "start_ms", "end_ms", "text", "speaker_id", "speaker_label", "is_final", "is_new")
    rows = stored(rows, "parts")
    given = candidates(spark, sf_dir).select(F.lit("label").alias("kind"), F.lit(1).cast("long").alias("at"), "tid", F.col("seq").cast("int").alias("seq"), "speaker_id", "speaker_label")
    given = stored(given, "labels")
    odd = F.col("seq") % 2 == 1
    more = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return [rows.filter(odd), more(rows.filter(~odd), given.filter("tid % 3 = 0")), more(rows.filter("tid % 5 = 0"), given)]


def live_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches as a stream; what is shown after the last one."""
    place = scratch_folder(spark, "live")
    live = LiveLayers(spark, f"{place}/live", buckets_for(spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()))
    for i, batch in enumerate(live_changes(spark, sf_dir)):
        batch.write.option("compression", "zstd").parquet(f"{place}/changes/{i}")
        stream = spark.readStream.schema(CHANGE).option("recursiveFileLookup", "true").parquet(f"{place}/changes")
        live.follow(stream, f"{place}/state")
    return live.shown().select("tid", "place", "seq", "start_ms", "end_ms", "speaker_id", "speaker_label", "text", "is_new", "n_merged")


def resolve_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    return c.resolve_turns(rows, confirmed(spark, sf_dir), voice_matches(spark, sf_dir, rows, "turn_seq"), margin_ms=1000)


def remapped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three showings: the labels of one list, of the other, and of the first again."""
    p, d = parts(spark, sf_dir).select("tid", "seq", "speaker_id"), candidates(spark, sf_dir).select("tid", "seq", "speaker_id")
    shown = [x.withColumn("batch", F.lit(i)) for i, x in enumerate((p, d, p), 1)]
    return metrics.remapped(shown[0].unionByName(shown[1]).unionByName(shown[2]))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coverage(parts(spark, sf_dir), turns(spark, sf_dir), long_ms=4000)


# Matching of chunks. Odd turns stand for a new chunk, even ones for the session.

ZONE = "2000 + (tid % 3) * 500"


def local_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every eighth timeline all turns are fragments."""
    rows = turns(spark, sf_dir).filter("turn_seq % 2 = 1")
    return rows.withColumn("end_ms", F.when(F.col("tid") % 8 == 0, F.col("start_ms") + F.least(F.col("end_ms") - F.col("start_ms"), F.lit(390))).otherwise(F.col("end_ms")))


LOCAL = """l as (select tid, turn_seq, start_ms, case when tid % 8 = 0 then start_ms + least(end_ms - start_ms, 390) else end_ms end as end_ms, speaker from v_turn where turn_seq % 2 = 1)"""


def world_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).filter("turn_seq % 2 = 0")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("tid").distinct().selectExpr("tid", f"{ZONE} as zone_start", f"{ZONE} + 7000 as zone_end")


def overlap_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.overlap_votes(local_turns(spark, sf_dir), world_turns(spark, sf_dir), zones(spark, sf_dir))


def speaker_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.speaker_mapping(local_turns(spark, sf_dir), world_turns(spark, sf_dir), zones(spark, sf_dir), aggregate_ms=700)


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.reconcile(local_turns(spark, sf_dir), world_turns(spark, sf_dir), zones(spark, sf_dir), aggregate_ms=700)


def replace_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = zones(spark, sf_dir).filter("tid % 5 <> 0")
    return intervals.replace_interval(world_turns(spark, sf_dir), turns(spark, sf_dir).filter("turn_seq % 2 = 1"), some)


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the one before it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return rows.join(before, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "reference", F.col("text").alias("hypothesis"))


QUERIES = {
    "overlay_labels": overlay_labels,
    "merge_candidate": merge_candidate,
    "accept_candidate": _two(c.accept),
    "new_speaker_evidence": _two(c.new_speaker_evidence),
    "speaker_changes": _two(c.speaker_changes),
    "segment_changes": _two(c.segment_changes),
    "meaningful_change": _two(c.is_meaningful),
    "nearest_confirmed": _sure(c.nearest_confirmed),
    "leading_confirmed": _sure(c.leading_confirmed),
    "live_renumber": lambda spark, sf_dir: _short(c.live_renumber(parts(spark, sf_dir))),
    "commit_candidate": commit_candidate,
    "commit_final": commit_final,
    "display": display,
    "live_layers": live_layers,
    "resolve_turns": resolve_turns,
    "session_ids": session_ids,
    "merge_rare_speakers": lambda spark, sf_dir: _short(c.merge_rare_speakers(parts(spark, sf_dir))),
    "correct_by_voice": correct_by_voice,
    "identify_voices": identify_voices,
    "merge_gaps": lambda spark, sf_dir: labels.merge_history(parts(spark, sf_dir)),
    "merge_display": lambda spark, sf_dir: labels.merge_display(parts(spark, sf_dir)),
    "name_by_appearance": lambda spark, sf_dir: _short(labels.name_by_appearance(parts(spark, sf_dir))),
    "enrich": lambda spark, sf_dir: labels.enrich(parts(spark, sf_dir)),
    "speaker_totals": lambda spark, sf_dir: metrics.speaker_totals(parts(spark, sf_dir)),
    "stage_metrics": lambda spark, sf_dir: metrics.stage_metrics(parts(spark, sf_dir)),
    "coverage": coverage,
    "first_two_speakers": _two(lambda p, d: metrics.first_two_speakers(d, p)),
    "remapped_segments": remapped_segments,
    "first_turns": lambda spark, sf_dir: metrics.first_turns(turns(spark, sf_dir), 3),
    "votes_text": lambda spark, sf_dir: metrics.votes_text(overlap_votes(spark, sf_dir)),
    "speaker_numbers": lambda spark, sf_dir: metrics.turn_numbers(parts(spark, sf_dir)),
    "contiguous_segments": lambda spark, sf_dir: metrics.contiguous(parts(spark, sf_dir)),
    "coalesce_turns": lambda spark, sf_dir: intervals.coalesce_turns(turns(spark, sf_dir), margin_ms=1000),
    "longest_turns": lambda spark, sf_dir: intervals.longest_turns(turns(spark, sf_dir), ["tid", "speaker"]),
    "turn_diagnostics": lambda spark, sf_dir: chunks.turn_diagnostics(turns(spark, sf_dir)),
    "fragment_aggregate": lambda spark, sf_dir: identity.significant_turns(local_turns(spark, sf_dir), aggregate_ms=700),
    "overlap_votes": overlap_votes,
    "speaker_mapping": speaker_mapping,
    "reconcile": reconcile,
    "replace_interval": replace_interval,
    "word_differences": lambda spark, sf_dir: metrics.word_differences(word_pairs(spark, sf_dir)),
    "word_errors": lambda spark, sf_dir: metrics.word_errors(word_pairs(spark, sf_dir)),
}

RAW = "r as (select tid, seq, start_ms, end_ms, case when not is_new then speaker_id end as rid, case when not is_new then speaker_label end as rlabel from v_part)"
SETS = """sets as (select tid, list(distinct p.id) filter (p.id is not null) as b, (select list(distinct d.id) filter (d.id is not null) from d where d.tid = p.tid) as k,
  (select list('speaker_' || speaker) from v_conf where v_conf.tid = p.tid) as sure from p group by tid),
g as (select tid, coalesce(b, []) as b, len(coalesce(b, [])) >= 2 and (len(coalesce(k, [])) < len(coalesce(b, [])) or
  len(list_filter(coalesce(k, []), lambda x: not list_contains(coalesce(b, []), x) and not list_contains(coalesce(sure, []), x))) > 0) as strip from sets)"""
QUALITY = """select tid, count(id) as n, count(distinct id) as s, coalesce(sum(end_ms - start_ms) filter (id is not null), 0) as ms from {side} group by tid"""
EVIDENCE = """e as (select d.tid, count(*) as new_segments, cast(sum(d.end_ms - d.start_ms) as bigint) as new_ms from d where d.id is not null
  and d.tid in (select tid from p where id is not null) and not exists (select 1 from p where p.tid = d.tid and p.id = d.id) group by d.tid)"""
SURE = "s as (select p.*, v.speaker is not null as sure from p left join v_conf v on v.tid = p.tid and v.speaker = p.num)"


def _nearest(edge: str, condition: str, order: str) -> str:
    return f"(select {edge} from s x where x.tid = s.tid and x.sure and {condition} order by x.seq {order} limit 1)"


#: Turns of one speaker that lie up to a second apart, folded one after the other.
COALESCED = """with recursive {views}, o as (select *, row_number() over (partition by tid order by start_ms, turn_seq) as n from {source}),
f as (select tid, n, turn_seq as hq, start_ms as hs, end_ms as he, speaker, 1 as k from o where n = 1
 union all select o.tid, o.n, case when j then hq else o.turn_seq end, case when j then hs else o.start_ms end, case when j then greatest(he, o.end_ms) else o.end_ms end, o.speaker, case when j then k + 1 else 1 end
  from (select f.*, x.n as nn, f.speaker = x.speaker and x.start_ms <= he + 1000 as j from f join o x on x.tid = f.tid and x.n = f.n + 1) f join o on o.tid = f.tid and o.n = nn)
select tid, hq as turn_seq, speaker, hs as start_ms, he as end_ms, cast(k as bigint) as n_merged from f qualify row_number() over (partition by tid, hq order by n desc) = 1"""
#: The voice that each embedding is most similar to, by all pairs.
VOICES = """ve as (select vec_id % 4 as session, vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
vf as (select session, vec_id, label, i, cast(x as double) * 0.7 + case when i = label then 1.0 else 0.0 end as x from ve),
vv as (select session, label, i, avg(x) as x from vf group by all),
vs as (select vf.vec_id, vv.label, round(sum(vf.x * vv.x) / (sqrt(sum(vf.x * vf.x)) * sqrt(sum(vv.x * vv.x))), 6) as similarity from vf join vv on vf.session = vv.session and vf.i = vv.i group by all),
iv as (select vec_id, similarity, case when similarity > 0.62 then label end as speaker from vs qualify row_number() over (partition by vec_id order by similarity desc, label) = 1)"""
RESOLVED = f"""{SQL_VIEWS}, {VOICES}, lt as (select tid, speaker, turn_seq from v_turn t where not exists (select 1 from v_conf c where c.tid = t.tid and c.speaker = t.speaker)
  qualify row_number() over (partition by tid, speaker order by end_ms - start_ms desc, turn_seq) = 1),
lm as (select lt.tid, lt.speaker, iv.speaker as matched from lt join iv on iv.vec_id = (lt.tid * 7 + lt.turn_seq) % (select count(*) from embeddings) where iv.speaker is not null),
rt as (select t.tid, t.turn_seq, t.start_ms, t.end_ms, coalesce(lm.matched, t.speaker) as speaker from v_turn t left join lm on lm.tid = t.tid and lm.speaker = t.speaker where t.tid in (select tid from lm))"""


def _shown_sql(source: str, then: str) -> str:
    """``then`` over ``m``, the rows of the table ``w`` (which ``source`` defines) merged for display, one step a row."""
    return f"""with recursive {SIDES.strip().removeprefix("with")}, {source}, o as (select *, row_number() over (partition by tid order by start_ms, seq) as n from w),
f as (select tid, n, seq as hq, start_ms as hs, end_ms as he, id as hi, speaker_id as hraw, speaker_label as hl, is_final as hf, is_new as hn, text as ht, 1 as k from o where n = 1
 union all select o.tid, o.n, case when j then hq else o.seq end, case when j then hs else o.start_ms end, case when j then greatest(he, o.end_ms) else o.end_ms end, case when j then hi else o.id end, case when j then hraw else o.speaker_id end,
  case when j then hl else o.speaker_label end, case when j then hf else o.is_final end, case when j then hn or o.is_new else o.is_new end, case when j then trim(concat_ws(' ', nullif(trim(ht), ''), nullif(trim(o.text), ''))) else o.text end, case when j then k + 1 else 1 end
  from (select f.*, x.n as nn, coalesce(hf and x.is_final and hi is not null and x.id is not null and (hi = x.id or hl is not distinct from x.speaker_label) and x.start_ms - he between 0 and 1200, false) as j from f join o x on x.tid = f.tid and x.n = f.n + 1) f join o on o.tid = f.tid and o.n = nn),
m as (select tid, hq as seq, hs as start_ms, he as end_ms, hraw as speaker_id, hl as speaker_label, ht as text, hf as is_final, hn as is_new, cast(k as bigint) as n_merged from f qualify row_number() over (partition by tid, hq order by n desc) = 1)
{then}"""


#: The candidate's ids over the final parts, merged, with the parts that are not final among them.
DISPLAY = _shown_sql(
    """w as (select p.* replace (coalesce(v_cand.speaker_id, p.speaker_id) as speaker_id, case when v_cand.speaker_id is not null then v_cand.speaker_label else p.speaker_label end as speaker_label,
  nullif(trim(coalesce(v_cand.speaker_id, p.speaker_id)), '') as id) from p left join v_cand using (tid, seq) where is_final)""",
    """, u as (select tid, seq, start_ms, end_ms, speaker_id, speaker_label, text, is_new, n_merged from m union all select tid, seq, start_ms, end_ms, speaker_id, speaker_label, text, is_new, 0 from p where not is_final),
z as (select *, row_number() over (partition by tid order by start_ms, n_merged, seq) as place from u) select {columns} from z""",
)
#: Distances row by row: what a cell takes from the row above, then the best way along the row to each cell.
WORD_ERRORS = r"""with recursive w as (select conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-zäöüß0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '') as w from conversations),
p as (select x.conv_id * 1000 + x.turn as id, y.w as a, x.w as b from w x join w y on x.conv_id = y.conv_id and x.turn = y.turn + 1),
d(id, i, row) as (select id, cast(0 as bigint), list_transform(range(0, len(a) + 1), lambda j: j * 4398048608256) from p
 union all
 select id, i, list_transform(range(1, len(t) + 1), lambda j: list_min(list_transform(range(1, j + 1), lambda k: t[k] + (j - k) * 4398048608256))) from (
  select d.id, d.i + 1 as i, list_transform(range(0, len(a) + 1), lambda j: case when j = 0 then row[1] + 4398046511105 else least(row[j] + case when a[j] = b[d.i + 1] then 0 else 4398046511104 end, row[j + 1] + 4398046511105) end) as t
  from d join p on p.id = d.id where d.i < len(b)))
select id, cast(len(a) as bigint) as n_reference, cast(len(b) as bigint) as n_hypothesis, c // 4398046511104 - c % 4398046511104 // 2097152 - c % 2097152 as replaced, c % 4398046511104 // 2097152 as deleted, c % 2097152 as inserted,
 case when len(a) > 0 then round((c // 4398046511104) / len(a), 6) end as error_rate from (select p.id, a, b, row[-1] as c from d join p on p.id = d.id and d.i = len(b))"""
#: Significant turns, votes, and pairs taken one by one, the largest vote first.
MAPPED = f"""with recursive {SQL_VIEWS.strip().removeprefix("with")}, {LOCAL},
w as (select * from l where end_ms - start_ms >= 400),
own as (select tid, turn_seq, speaker, start_ms, end_ms from w union all
 select tid, min(turn_seq), speaker, min(start_ms), max(end_ms) from l where tid not in (select tid from w) group by tid, speaker having sum(end_ms - start_ms) >= 700),
old as (select * from v_turn where turn_seq % 2 = 0 and end_ms - start_ms >= 400),
la as (select tid, turn_seq, speaker, greatest(start_ms, {ZONE}) as s, least(end_ms, {ZONE} + 7000) as e from own where tid in (select tid from v_turn)),
wb as (select tid, turn_seq, speaker, greatest(start_ms, {ZONE}) as s, least(end_ms, {ZONE} + 7000) as e from old),
vo as (select a.tid, a.speaker as a, b.speaker as b, sum(least(a.e, b.e) - greatest(a.s, b.s)) as ms, min(a.turn_seq) as af, min(b.turn_seq) as bf
 from la a join wb b on a.tid = b.tid and a.s < b.e and b.s < a.e where a.e > a.s and b.e > b.s group by all having ms >= 300),
vn as (select *, row_number() over (partition by tid order by ms desc, af, bf, a, b) as n from vo),
gr(tid, n, "as", bs) as (select distinct tid, cast(0 as bigint), cast([] as bigint[]), cast([] as bigint[]) from vn
 union all select gr.tid, vn.n, case when list_contains("as", a) or list_contains(bs, b) then "as" else list_append("as", a) end, case when list_contains("as", a) or list_contains(bs, b) then bs else list_append(bs, b) end
 from gr join vn on vn.tid = gr.tid and vn.n = gr.n + 1),
pr as (select tid, unnest("as") as a, unnest(bs) as b from gr qualify row_number() over (partition by tid order by n desc) = 1),
sp as (select o.tid, o.a as local, pr.b, coalesce((select max(speaker) from old where old.tid = o.tid), -1) as top from (select distinct tid, speaker as a from own) o left join pr on pr.tid = o.tid and pr.a = o.a),
mapped as (select tid, local, coalesce(b, top + count(*) filter (b is null) over (partition by tid order by local)) as speaker, b is null as is_new from sp)"""
#: Texts folded into the one before, one step a row.
FOLDED = f"""with recursive {SQL_VIEWS.strip().removeprefix("with")},
o as (select tid, seq, start_ms, end_ms, text, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '') as w, row_number() over (partition by tid order by seq) as n from v_seg),
f(tid, n, hq, hs, he, t, w, k) as (select tid, n, seq, start_ms, end_ms, text, w, 1 from o where n = 1
 union all select tid, n, case when made is null then q else hq end, case when made is null then s else hs end, case when made is null then e else greatest(he, e) end, case when made is null then x else array_to_string(made, ' ') end,
  case when made is null then b else made end, case when made is null then 1 else k + 1 end from (
  select *, case when not (s - hs >= 1 and s - hs < 60000) then null when e - s < 500 and len(b) < 2 and s - he < 1500 then list_concat(w, b)
    when shared is not null then case when shared = len(w) and len(w) < len(b) then b else list_concat(w, b[shared + 1:]) end
    when len(lw) >= 3 and lw[1:3] = lb[1:3] or contains(array_to_string(lb, ' '), array_to_string(lw, ' ')) or contains(array_to_string(lw, ' '), array_to_string(lb, ' ')) then case when len(w) >= len(b) then w else b end end as made
  from (select *, list_max(list_filter(range(2, least(len(w), len(b)) + 1), lambda j: lw[len(lw) - j + 1:len(lw)] = lb[1:j])) as shared
   from (select f.*, o.n as n2, o.seq as q, o.start_ms as s, o.end_ms as e, o.text as x, o.w as b, list_transform(f.w, lambda y: lower(y)) as lw, list_transform(o.w, lambda y: lower(y)) as lb
    from f join o on o.tid = f.tid and o.n = f.n + 1))) z(tid, n_, hq, hs, he, t, w, k, n, q, s, e, x, b, lw, lb, shared, made))
select tid, hq as seq, hs as start_ms, he as end_ms, t as text, cast(k as bigint) as n_merged from f qualify row_number() over (partition by tid, hq order by n desc) = 1"""


def _step_sql(i: int, source: str, cases: str) -> str:
    """Table ``y<i>``: the rows of ``source`` with id and label taken from neighbours in some cases."""
    return f"""n{i} as (select *, nullif(trim(speaker_id), '') as s, count(*) over (partition by tid, speaker_id) as kk from {source}),
x{i} as (select *, lag(s) over w as l, lag(speaker_label) over w as ll, lead(s) over w as r, lead(speaker_label) over w as rl, start_ms - lag(end_ms) over w as gl, lead(start_ms) over w - end_ms as gr,
 lag(end_ms - start_ms) over w as dl, lead(end_ms - start_ms) over w as dr, end_ms - start_ms as ms, len(string_split_regex(trim(coalesce(text, '')), '\\s+')) as nw from n{i} window w as (partition by tid order by seq)),
y{i} as (select tid, seq, start_ms, end_ms, text, is_final, case {cases.format(l="l", r="r")} else speaker_id end as speaker_id, case {cases.format(l="ll", r="rl")} else speaker_label end as speaker_label from x{i})"""


ENRICHED = f"""{SQL_VIEWS}, many as (select *, count(*) over (partition by tid) as cn from v_part), y0 as (select tid, seq, start_ms, end_ms, text, is_final, speaker_id, speaker_label from many where cn >= 3),
{_step_sql(1, "y0", "when l = r and l <> s and ms <= 2000 and nw <= 3 and 3 * ms <= greatest(dl, dr) and kk > 1 then {l}")},
{_step_sql(2, "y1", "when s is null and l = r and (ms <= 2000 or nw <= 3) then {l}")},
{_step_sql(3, "y2", "when s is null and (ms <= 800 or length(trim(text)) <= 3) and gl between 0 and 500 and l is not null then {l} when s is null and (ms <= 800 or length(trim(text)) <= 3) and gr between 0 and 500 and r is not null then {r}")},
mi as (select *, nullif(trim(speaker_id), '') as id from y3),
mj as (select *, case when lag(id) over w = id and is_final and lag(is_final) over w and start_ms - lag(end_ms) over w between 0 and 1200 then 0 else 1 end as new from mi window w as (partition by tid order by start_ms, seq)),
mb as (select *, sum(new) over (partition by tid order by start_ms, seq) as block from mj),
mm as (select tid, block, list({{'q': seq, 'e': end_ms, 's': start_ms, 'i': speaker_id, 'l': speaker_label, 't': text}} order by start_ms, seq) as r from mb group by tid, block),
mr as (select tid, r[1].q as seq, r[1].s as start_ms, list_max(list_transform(r, lambda x: x.e)) as end_ms, r[1].i as speaker_id, r[1].l as speaker_label,
  case when len(r) = 1 then r[1].t else array_to_string(list_filter(list_transform(r, lambda x: trim(x.t)), lambda t: t <> ''), ' ') end as text, nullif(trim(r[1].i), '') as id from mm),
mf as (select *, case when id is not null then min(seq) over (partition by tid, id) end as f from mr), mk as (select *, dense_rank() over (partition by tid order by f nulls last) as k from mf)
select tid, seq, start_ms, end_ms, speaker_id, case when f is not null then 'Sprecher ' || k else speaker_label end as speaker_label, text from mk
union all select tid, seq, start_ms, end_ms, speaker_id, speaker_label, text from many where cn < 3"""
ORACLES = {
    "word_errors": WORD_ERRORS,
    "speaker_mapping": f"{MAPPED} select tid, local, speaker, is_new from mapped",
    "reconcile": f"{MAPPED} select own.tid, turn_seq, local, mapped.speaker, start_ms, end_ms from own join mapped on mapped.tid = own.tid and local = own.speaker",
    "dedupe_texts": FOLDED,
    "enrich": ENRICHED,
    "overlay_labels": f"""{SIDES}, {RAW} select r.tid, r.seq, r.start_ms, r.end_ms, case when d.id is not null then d.speaker_id else rid end as speaker_id,
  case when d.id is not null then d.speaker_label else rlabel end as speaker_label from r left join d using (tid, seq)""",
    "merge_candidate": f"""{SIDES}, {RAW}, {SETS},
j as (select r.*, d.id as did, d.speaker_label as dlabel, p.id as pid, p.speaker_id as praw, p.speaker_label as plabel, strip, strip and not list_contains(b, d.id) as barred
  from r left join d using (tid, seq) left join p using (tid, seq) left join g using (tid)),
w as (select *, case when did is not null and not barred and (pid is null or not strip) then 'd' when pid is not null then 'p' else 'r' end as who from j)
select {ROW}, case who when 'd' then did when 'p' then praw else rid end as speaker_id, case who when 'd' then dlabel when 'p' then plabel else rlabel end as speaker_label from w""",
    "accept_candidate": f"""{SIDES}, a as ({QUALITY.format(side="p")}), k as ({QUALITY.format(side="d")}), {EVIDENCE},
q as (select tid, coalesce(a.n, 0) as bn, coalesce(a.s, 0) as bs, coalesce(a.ms, 0) as bm, coalesce(k.n, 0) as cn, coalesce(k.s, 0) as cs, coalesce(k.ms, 0) as cm,
  coalesce(new_segments >= 2 or new_ms >= 3000, false) as ev from a full join k using (tid) left join e using (tid)),
r as (select tid, case when bn = 0 and bs = 0 then 'first' when bn > 0 and cn = 0 then 'labelsGone' when bs >= 2 and cs < bs then 'fewerSpeakers' when cn < bn * 0.5 then 'fewerLabels'
  when bm > 0 and cm < bm * 0.5 then 'lessTime' when cs > bs and cn >= bn * (case when bs = 1 and cs = 2 then 0.5 else 0.7 end) and (not (bs = 1 and cs = 2) or ev) then 'moreSpeakers'
  when cs = bs and cn >= bn and cm >= bm then 'noWorse' when cs = bs and cn > bn * 1.2 and cm >= bm * 0.8 then 'moreLabels' when cs = bs then 'worse' else 'other' end as rule from q)
select tid, rule not in ('labelsGone', 'fewerSpeakers', 'fewerLabels', 'lessTime', 'worse') as accepted, rule from r""",
    "new_speaker_evidence": f"{SIDES}, {EVIDENCE} select *, new_segments >= 2 or new_ms >= 3000 as has_evidence from e",
    "speaker_changes": f"""{SIDES}, x as (select distinct tid, id from p where id is not null), y as (select distinct tid, id from d where id is not null)
select coalesce(x.tid, y.tid) as tid, coalesce(x.id, y.id) as speaker_id, case when x.id is null then 'new' when y.id is null then 'lost' else 'kept' end as state from x full join y on x.tid = y.tid and x.id = y.id""",
    "segment_changes": f"{SIDES} select tid, seq, 'gone' as state from p anti join d using (tid, seq) union all select tid, seq, 'added' from d anti join p using (tid, seq)",
    "meaningful_change": f"""{SIDES} select tid, count(*) filter (p.id is null and d.id is not null) > 0 or count(*) filter (p.id <> d.id) > 0 or count(distinct d.id) > count(distinct p.id) as meaningful
  from p full join d using (tid, seq) group by tid""",
    "nearest_confirmed": f"""{SIDES}, {SURE}, n as (select *, {_nearest("{'i': x.id, 'l': coalesce(x.speaker_label, x.id)}", "x.end_ms <= s.start_ms", "desc")} as l, {_nearest("{'i': x.id, 'l': coalesce(x.speaker_label, x.id)}", "x.start_ms >= s.end_ms", "")} as r from s),
f as (select *, case when sure then null when l is null then r when r is null then l when l.i = r.i then l end as x from n)
select {ROW}, case when x is not null then x.i else speaker_id end as speaker_id, case when x is not null then x.l else speaker_label end as speaker_label from f""",
    "leading_confirmed": f"""{SIDES}, {SURE}, f as (select tid, start_ms as fs, speaker_id as fi, coalesce(speaker_label, speaker_id) as fl from s where sure qualify row_number() over (partition by tid order by start_ms, seq) = 1)
select {ROW}, case when not sure and end_ms <= fs then fi else speaker_id end as speaker_id, case when not sure and end_ms <= fs then fl else speaker_label end as speaker_label from s left join f using (tid)""",
    "live_renumber": f"""{SIDES}, o as (select tid, id, any_value(num) as num, row_number() over (partition by tid order by min(seq)) - 1 as place from p where id is not null group by tid, id),
t as (select tid, count(*) as n, min(num) as least, list(id) as ids from o group by tid),
x as (select o.*, n > 1 and least is not null and not (least = 0 and list_sort(ids) = list_sort(list_transform(range(n), lambda i: 'speaker_' || i))) as change from o join t using (tid))
select {ROW}, case when change then 'speaker_' || place else speaker_id end as speaker_id, case when change then 'Sprecher ' || (place + 1) else speaker_label end as speaker_label from p left join x using (tid, id)""",
    "session_ids": f"""{SIDES}, k as (select tid, count(distinct id) as n, coalesce(max(num), -1) + 1 as free from p where id is not null group by tid),
e as (select tid, num as engine, min(seq) as first_seq from d where num is not null group by tid, num),
v as (select d.tid, d.num as engine, p.id, sum(least(d.end_ms, p.end_ms) - greatest(d.start_ms, p.start_ms)) as ms, min(d.seq * 1000000 + p.seq) as met from d join p on p.tid = d.tid and p.id is not null and d.num is not null
  and d.end_ms > p.start_ms and p.end_ms > d.start_ms group by all),
bb as (select * from v qualify row_number() over (partition by tid, engine order by ms desc, met) = 1),
m as (select d.tid, d.num as engine, arg_min(p.id, d.seq) as same from d join p using (tid, seq) where d.num is not null and p.id is not null group by all),
f as (select e.*, coalesce(bb.id, m.same) as found, coalesce(n, 0) as n, coalesce(free, 0) as free, count(*) over (partition by e.tid) as c, row_number() over (partition by e.tid order by e.engine) as place
  from e left join bb using (tid, engine) left join m using (tid, engine) left join k using (tid)),
h as (select *, coalesce(found, 'speaker_' || (greatest(free, n) + sum(case when found is null then 1 else 0 end) over (partition by tid order by first_seq, engine) - 1)) as made, count(*) filter (found is null) over (partition by tid) as missing from f),
i as (select tid, id as nth, row_number() over (partition by tid order by min(seq)) as place from p where id is not null group by tid, id),
s as (select h.tid, engine, case when c = n and c >= 2 and missing > 0 then nth else made end as id from h left join i using (tid, place))
select d.tid, d.seq, d.start_ms, d.end_ms, coalesce(s.id, d.speaker_id) as speaker_id, case when s.id is not null then 'Sprecher ' || (coalesce(try_cast(replace(s.id, 'speaker_', '') as int), 0) + 1) else d.speaker_label end as speaker_label
  from d left join s on s.tid = d.tid and s.engine = d.num""",
    "merge_rare_speakers": f"""{SIDES}, t as (select tid, id, count(*) as n, sum(end_ms - start_ms) as ms, min(seq) as f from p where id is not null group by all),
z as (select *, coalesce((select {{'i': p.id, 'l': p.speaker_label}} from p where p.tid = t.tid and p.id <> t.id and p.seq < f order by p.seq desc limit 1), (select {{'i': p.id, 'l': p.speaker_label}} from p where p.tid = t.tid and p.id <> t.id and p.seq > f order by p.seq limit 1)) as z
  from t where n = 1 or ms < 2000)
select {ROW}, case when z is not null then z.i else speaker_id end as speaker_id, case when z is not null then coalesce(z.l, 'Sprecher ' || right(z.i, 1)) else speaker_label end as speaker_label from p left join z using (tid, id)""",
    "identify_voices": f"with {VOICES} select * from iv",
    "correct_by_voice": f"""{SIDES}, {VOICES}, m as (select p.*, iv.speaker as m, num is not null and iv.speaker <> num and end_ms - start_ms >= 2000 as other
  from p left join iv on iv.vec_id = (tid * 7 + seq) % (select count(*) from embeddings))
select {ROW}, case when other then 'speaker_' || m else speaker_id end as speaker_id, case when other then 'Sprecher ' || (m + 1) else speaker_label end as speaker_label from m""",
    "merge_gaps": f"""{SIDES}, j as (select *, case when lag(id) over w = id and is_final and lag(is_final) over w and start_ms - lag(end_ms) over w between 0 and 1200 then 0 else 1 end as new from p window w as (partition by tid order by start_ms, seq)),
bl as (select *, sum(new) over (partition by tid order by start_ms, seq) as block from j),
m as (select tid, block, list({{'q': seq, 'e': end_ms, 's': start_ms, 'i': speaker_id, 'l': speaker_label, 't': text}} order by start_ms, seq) as r from bl group by tid, block)
select tid, r[1].q as seq, r[1].s as start_ms, list_max(list_transform(r, lambda x: x.e)) as end_ms, r[1].i as speaker_id, r[1].l as speaker_label, cast(len(r) as bigint) as n_merged,
  case when len(r) = 1 then r[1].t else array_to_string(list_filter(list_transform(r, lambda x: trim(x.t)), lambda t: t <> ''), ' ') end as text from m""",
    "merge_display": _shown_sql("w as (select * from p)", "select * from m"),
    "display": DISPLAY.format(columns="tid, place, seq, start_ms, end_ms, speaker_id, n_merged"),
    "live_layers": DISPLAY.format(columns="tid, place, seq, start_ms, end_ms, speaker_id, speaker_label, text, is_new, n_merged"),
    "name_by_appearance": f"""{SIDES}, x as (select *, case when id is not null then min(seq) over (partition by tid, id) end as f from p), y as (select *, dense_rank() over (partition by tid order by f nulls last) as k from x)
select {ROW}, speaker_id, case when f is not null then 'Sprecher ' || k else speaker_label end as speaker_label from y""",
    "speaker_totals": f"{SIDES} select tid, id as speaker_id, count(*) as n, cast(sum(end_ms - start_ms) as bigint) as ms from p where id is not null group by all",
    "stage_metrics": f"""{SIDES} select tid, count(*) as n, count(id) as labeled, cast(coalesce(sum(end_ms - start_ms) filter (id is not null), 0) as bigint) as labeled_ms, count(distinct id) as speakers,
  coalesce(string_agg(distinct replace(id, 'speaker_', ''), ',' order by replace(id, 'speaker_', '')), '') as ids from p group by tid""",
    "coverage": f"""{SIDES} select tid, cast(sum(end_ms - start_ms) as bigint) as segment_ms, count(*) filter (end_ms - start_ms > 4000) as long_segments,
  cast(coalesce((select sum(end_ms - start_ms) from v_turn t where t.tid = p.tid), 0) as bigint) as turn_ms, (select count(distinct speaker) from v_turn t where t.tid = p.tid) as speakers,
  count(*) filter (id is null and exists (select 1 from v_turn t where t.tid = p.tid and t.start_ms < p.end_ms and t.end_ms > p.start_ms)) as overlapped_unlabeled from p group by tid""",
    "first_two_speakers": f"""{SIDES}, t as (select tid, id, count(*) as n, cast(sum(end_ms - start_ms) as bigint) as ms from p where id is not null group by all)
select p.tid, p.id as speaker_id, start_ms, end_ms, n, ms from p join t using (tid, id) where (select count(*) from t where t.tid = p.tid) >= 2 and not exists (select 1 from d where d.tid = p.tid and d.id = p.id)
  qualify row_number() over (partition by p.tid order by seq) = 1""",
    "remapped_segments": f"""{SIDES}, s as (select tid, seq, 1 as batch, id from p union all select tid, seq, 2, id from d union all select tid, seq, 3, id from p)
select tid, seq, batch, before, id as speaker_id from (select *, lag(id) over (partition by tid, seq order by batch) as before from s where id is not null) where before <> id""",
    "first_turns": f"""{SQL_VIEWS} select tid, place, printf('[%.2f-%.2f]spk%d(%.1fs)', start_ms / 1000, end_ms / 1000, speaker, (end_ms - start_ms) / 1000) as shown
  from (select *, row_number() over (partition by tid order by start_ms, turn_seq) as place from v_turn) where place <= 3""",
    "speaker_numbers": f"{SIDES} select tid, seq, num as number from p",
    "contiguous_segments": f"{SQL_VIEWS} select tid, seq, coalesce(lag(end_ms) over (partition by tid order by seq), 0) as start_ms, end_ms from v_part",
    "coalesce_turns": COALESCED.format(views=SQL_VIEWS.strip().removeprefix("with"), source="v_turn"),
    "resolve_turns": f"{COALESCED.format(views=RESOLVED.strip().removeprefix('with'), source='rt')} union all select tid, turn_seq, speaker, start_ms, end_ms, 1 from v_turn where tid not in (select tid from lm)",
    "longest_turns": f"{SQL_VIEWS} select tid, speaker, turn_seq, start_ms, end_ms from v_turn qualify row_number() over (partition by tid, speaker order by end_ms - start_ms desc, turn_seq) = 1",
    "turn_diagnostics": f"""{SQL_VIEWS} select tid, count(*) as n, count(distinct speaker) as speakers, min(end_ms - start_ms) as least_ms, round(avg(end_ms - start_ms), 3) as mean_ms, max(end_ms - start_ms) as most_ms from v_turn group by tid""",
    "fragment_aggregate": f"""{SQL_VIEWS}, {LOCAL}, w as (select * from l where end_ms - start_ms >= 400)
select tid, turn_seq, speaker, start_ms, end_ms from w union all select tid, min(turn_seq), speaker, min(start_ms), max(end_ms) from l where tid not in (select tid from w) group by tid, speaker having sum(end_ms - start_ms) >= 700""",
    "overlap_votes": f"""{SQL_VIEWS}, {LOCAL}, la as (select tid, turn_seq, speaker, greatest(start_ms, {ZONE}) as s, least(end_ms, {ZONE} + 7000) as e from l),
wb as (select tid, turn_seq, speaker, greatest(start_ms, {ZONE}) as s, least(end_ms, {ZONE} + 7000) as e from v_turn where turn_seq % 2 = 0)
select a.tid, a.speaker as local, b.speaker as "global", cast(sum(least(a.e, b.e) - greatest(a.s, b.s)) as bigint) as overlap_ms, min(a.turn_seq) as local_first, min(b.turn_seq) as global_first
  from la a join wb b on a.tid = b.tid and a.s < b.e and b.s < a.e where a.e > a.s and b.e > b.s group by all""",
    "replace_interval": f"""{SQL_VIEWS}, z as (select *, tid % 5 <> 0 as zoned, {ZONE} as zs from v_turn)
select tid, turn_seq, start_ms, case when turn_seq % 2 = 1 or not zoned or end_ms <= zs - 10 then end_ms else zs end as end_ms, speaker from z where turn_seq % 2 = 1 or not zoned or end_ms <= zs - 10 or start_ms < zs""",
}
ORACLES["votes_text"] = f"select tid, local, string_agg(printf('%d:%.2fs', \"global\", overlap_ms / 1000), ',' order by overlap_ms desc, \"global\") as votes from ({ORACLES['overlap_votes']}) group by tid, local"
_MERGED, _GATE = ORACLES["merge_candidate"], ORACLES["accept_candidate"]
_COMMIT = """{sides}, {raw}, merged as ({merged}), gate as ({gate}),
m as (select *, nullif(trim(speaker_id), '') as id from merged),
mc as (select tid, count(*) filter (p.id is null and m.id is not null) > 0 or count(*) filter (p.id <> m.id) > 0 or count(distinct m.id) > count(distinct p.id) as new, count(distinct m.id) >= count(distinct p.id) as no_fewer
  from p full join m using (tid, seq) group by tid),
taken as (select tid from gate join mc using (tid) where accepted and new {final}),
fb as (select tid, seq, 'speaker_' || (seq % 3) as fid from p where {fallback})
select {row}, speaker_id, speaker_label from merged where tid in (select tid from taken) union all
select r.tid, r.seq, r.start_ms, r.end_ms, case when fid is not null then fid when p.id is not null then p.speaker_id else rid end, case when fid is not null then 'spät' when p.id is not null then p.speaker_label else rlabel end
 from r left join p using (tid, seq) left join fb using (tid, seq) where r.tid not in (select tid from taken)"""
ORACLES["commit_candidate"] = _COMMIT.format(sides=SIDES, raw=RAW, merged=_MERGED, gate=_GATE, row=ROW, final="", fallback="false")
_LAST = lambda sql: sql.replace("from v_cand)", "from v_cand where tid % 4 > 0)")
ORACLES["commit_final"] = _COMMIT.format(
    sides=_LAST(SIDES), raw=RAW, merged=_LAST(_MERGED), gate=_LAST(_GATE), row=ROW, final="and no_fewer",
    fallback="tid % 8 = 0 and tid in (select tid from p group by tid having count(*) > count(id) or count(distinct seq % 3) > count(distinct id))",
)
