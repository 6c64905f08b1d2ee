"""Queries over a store of transcripts, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zeitband.functions import text
from zeitband.operators import store
from zeitband.shared import scratch_folder
from zeitband.sources.timelines import VIEWS, dealt_parts, parts, recognised
from zeitband.sources.versions import buckets_for

DOC = """select cast(o_orderkey as string) as transcript_id, concat('Gespräch_', o_orderpriority, ' ', cast(o_custkey as string)) as title, 'de' as language, cast(floor(o_totalprice) as bigint) * 10 as duration_ms,
 cast(o_custkey % 4 as int) as speaker_count, case when o_orderstatus = 'F' then 'finalized' else 'open' end as status, o_orderkey * 7919 % 100003 * 1000000 as created_at, o_orderkey * 7919 % 100003 * 1000000 + 5000 as updated_at from {orders}"""
SEG = "select cast(tid as string) as transcript_id, segment_id, cast(seq as int) as seq, start_ms, end_ms, text, speaker_id, speaker_label from v_part"
SQL = f"{VIEWS.format(lineitem='lineitem', part='part')}, t as ({DOC.format(orders='orders')}), s as ({SEG})"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOC, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_stored(parts(spark, sf_dir))


def _as_stored(rows: DataFrame, *also: str) -> DataFrame:
    return rows.select(*also, F.col("tid").cast("string").alias("transcript_id"), "segment_id", F.col("seq").cast("int").alias("seq"), "start_ms", "end_ms", "text", "speaker_id", "speaker_label")


def _both(f):
    return lambda spark, sf_dir: f(transcripts(spark, sf_dir), segments(spark, sf_dir))


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Of a store of all transcripts: as many as its segments need, which are as many as order lines."""
    return buckets_for(spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())


def stored(t: DataFrame, s: DataFrame, n: int = 16) -> store.TranscriptStore:
    """A store of ``n`` buckets that holds both tables."""
    at = store.TranscriptStore(t.sparkSession, scratch_folder(t.sparkSession, "store"), n)
    at.edit(t.select("transcript_id").union(s.select("transcript_id")), lambda now: {"transcripts": t, "segments": s})
    return at


def _digest(t: DataFrame, s: DataFrame) -> DataFrame:
    """Both tables of a store after an edit, in one."""
    one = t.select("transcript_id", F.lit("").alias("segment_id"), F.col("title").alias("value"), "updated_at")
    return one.unionByName(s.select("transcript_id", "segment_id", F.col("text").alias("value"), F.col("start_ms").alias("updated_at")))


def upsert_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir)
    n = F.col("transcript_id").cast("bigint")
    new = t.filter(n % 3 == 0).withColumns({"title": F.concat(F.lit("neu "), "title"), "updated_at": F.col("updated_at") + 1})
    again = new.filter(n % 2 == 0).withColumns({"title": F.concat(F.lit("noch "), "title"), "updated_at": F.col("updated_at") + 1})
    return store.upsert(t.filter(n % 6 < 5), new.unionByName(again), ["transcript_id"], "updated_at")


def save_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth transcript saved anew with every other segment; every eighth without any."""
    t, s = transcripts(spark, sf_dir), segments(spark, sf_dir)
    n = F.col("transcript_id").cast("bigint")
    new_t = t.filter(n % 4 == 0).withColumn("title", F.concat("title", F.lit(" (2)")))
    new_s = s.filter((n % 8 == 0) & (F.col("seq") % 2 == 0)).withColumn("text", F.upper("text"))
    at = stored(t, s, buckets(spark, sf_dir))
    at.save(new_t, new_s)
    return _digest(at.read("transcripts"), at.read("segments"))


def rename_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir)
    titles = t.filter(F.col("transcript_id").cast("bigint") % 10 == 0).select("transcript_id", F.concat(F.lit("Titel "), "transcript_id").alias("new_title"))
    return store.rename(t, titles)


def rename_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir)
    return store.rename(t, t.filter("speaker_count = 2").select("transcript_id", F.lit("zwei").alias("new_title")), now_ms=1_700_000_000_000)


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = transcripts(spark, sf_dir), segments(spark, sf_dir)
    at = stored(t, s, buckets(spark, sf_dir))
    at.delete(t.filter("status = 'open'").select("transcript_id"))
    return _digest(at.read("transcripts"), at.read("segments"))


def written(spark: SparkSession, sf_dir: str) -> str:
    """The transcripts as JSON files in the shared folder."""
    path = scratch_folder(spark, "documents")
    store.write_documents(store.nested(transcripts(spark, sf_dir), segments(spark, sf_dir)), path)
    return path


def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest_first(store.scan_documents(spark, written(spark, sf_dir))).drop("segments")


def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents in buckets; one bucket is read."""
    at = store.DocumentStore(spark, scratch_folder(spark, "documents"), buckets(spark, sf_dir))
    at.put(store.nested(transcripts(spark, sf_dir), segments(spark, sf_dir)))
    return store.document_segments(at.find("documents", "17")).orderBy("seq")


def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are put together where their segments were made, by timeline."""
    t = transcripts(spark, sf_dir)
    at = store.DocumentStore(spark, scratch_folder(spark, "documents"), buckets(spark, sf_dir))
    at.put(store.nested(t.withColumn("tid", F.col("transcript_id").cast("bigint")), _as_stored(dealt_parts(spark, sf_dir), "tid"), "tid"))
    at.delete(t.filter("transcript_id like '%7'").select("transcript_id"))
    return at.read("documents").select("transcript_id", "title", F.size("segments").cast("long").alias("n"))


def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of one transcript, from its bucket of the store."""
    return store.segments_of(stored(transcripts(spark, sf_dir), segments(spark, sf_dir), buckets(spark, sf_dir)).find("segments", "42"), "42")


def stored_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after some transcripts were migrated from documents, some renamed and some deleted: three commits."""
    t, s = transcripts(spark, sf_dir), segments(spark, sf_dir)
    n = F.col("transcript_id").cast("bigint")
    at = stored(t.filter(n % 4 > 0).withColumn("title", F.upper("title")), s.filter(n % 4 > 0), buckets(spark, sf_dir))
    at.migrate(store.scan_documents(spark, written(spark, sf_dir)))
    at.rename(t.filter(n % 10 == 0).select("transcript_id", F.lit("neu").alias("new_title")), now_ms=1)
    at.delete(t.filter(n % 7 == 0).select("transcript_id"))
    return _digest(at.read("transcripts"), at.read("segments"))


def recognised_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a recogniser writes them, with times in seconds, and read back."""
    path = scratch_folder(spark, "recognised")
    one = F.struct("seq", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")
    docs = parts(spark, sf_dir).groupBy(F.col("tid").cast("string").alias("name")).agg(F.array_sort(F.collect_list(one)).alias("segments"))
    docs.write.json(path)
    return recognised(spark, path)


def migrate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into a store that has three of four transcripts already, under other titles."""
    t, s = transcripts(spark, sf_dir), segments(spark, sf_dir)
    there = F.col("transcript_id").cast("bigint") % 4 > 0
    old = t.filter(there).withColumn("title", F.upper("title"))
    return _digest(*store.migrate(old, s.filter(there), store.scan_documents(spark, written(spark, sf_dir))))


def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that lists and reports show for times, counts and names."""
    t = transcripts(spark, sf_dir)
    return t.select(
        "transcript_id",
        text.minutes(F.col("duration_ms")).alias("minutes"),
        text.duration(F.col("duration_ms")).alias("duration"),
        text.rounded_hms(F.col("duration_ms") / 1000).alias("rounded"),
        text.hms(F.col("duration_ms")).alias("hms"),
        text.date_text(F.col("created_at")).alias("date"),
        text.date_text(F.col("created_at"), "yyyyMMdd_HHmmss").alias("file_date"),
        text.date_text(F.col("updated_at"), "HH:mm:ss.SSS").alias("clock"),
        text.count_text(F.col("speaker_count")).alias("speakers"),
        text.speaker_name(F.col("speaker_count")).alias("name"),
        text.join_texts(F.concat(F.lit("\t"), "title"), F.when(F.col("speaker_count") > 1, F.lit(" x ")).otherwise(F.lit(" \n"))).alias("joined"),
        text.json_text(F.concat(F.lit('"\\\u0001\b\f\r\n\t'), "status")).alias("json"),
    )


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", F.array_join(text.normal_words(F.col("text")), "|").alias("words"))


QUERIES = {
    "transcript_list": lambda spark, sf_dir: store.newest_first(transcripts(spark, sf_dir)),
    "transcript_lookup": lambda spark, sf_dir: store.find_transcript(transcripts(spark, sf_dir), "42"),
    "transcript_segments": lambda spark, sf_dir: store.segments_of(segments(spark, sf_dir), "42"),
    "transcript_detail": _both(store.with_segments),
    "count_transcripts": lambda spark, sf_dir: transcripts(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")),
    "title_search": lambda spark, sf_dir: store.search_titles(transcripts(spark, sf_dir), "H_1-urgent%2"),
    "segment_search": lambda spark, sf_dir: store.search_segments(segments(spark, sf_dir), "42", "E"),
    "search_anywhere": _both(lambda t, s: store.search_anywhere(t, s, "RING P")),
    "upsert_transcripts": upsert_transcripts,
    "save_transcripts": save_transcripts,
    "rename_transcripts": rename_transcripts,
    "rename_documents": rename_documents,
    "delete_cascade": delete_cascade,
    "document_scan": document_scan,
    "document_lookup": document_lookup,
    "migrate_documents": migrate_documents,
    "delete_documents": delete_documents,
    "recognised_segments": recognised_segments,
    "stored_lookup": stored_lookup,
    "stored_edits": stored_edits,
    "export_json": _both(store.json_report),
    "shown_values": shown_values,
    "word_lists": word_lists,
}
DIGEST = "select transcript_id, '' as segment_id, title as value, updated_at from {t} union all select transcript_id, segment_id, text, start_ms from {s}"


def _fields(*names: str, indent: int) -> str:
    """Of (JSON name, column, is text) lines."""
    made = []
    for name in names:
        key, column = name.split("=")
        value = f"coalesce('\"' || replace(replace({column}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"', 'null')" if not column.startswith("+") else f"cast({column[1:]} as varchar)"
        made.append(f"'{' ' * indent}\"{key}\": ' || {value}")
    return " || ',' || chr(10) || ".join(made)


ORACLES = {
    "recognised_segments": f"{SQL} select cast(tid as string) as name, row_number() over (partition by tid order by seq) as seq, start_ms, end_ms, text from v_part",
    "transcript_list": f"{SQL} select * from t",
    "transcript_lookup": f"{SQL} select * from t where transcript_id = '42'",
    "transcript_segments": f"{SQL} select * from s where transcript_id = '42'",
    "transcript_detail": f"{SQL} select t.transcript_id, title, created_at, s.* exclude (transcript_id) from t join s using (transcript_id)",
    "count_transcripts": f"{SQL} select count(*) as n from t",
    "title_search": f"{SQL} select * from t where translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%h_1-urgent%2%'",
    "segment_search": f"{SQL} select * from s where transcript_id = '42' and translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%e%'",
    "search_anywhere": f"{SQL} select * from t where contains(lower(title), 'ring p') or transcript_id in (select transcript_id from s where contains(lower(text), 'ring p'))",
    "upsert_transcripts": f"""{SQL}, x as (select *, cast(transcript_id as bigint) as n from t)
select transcript_id, case when n % 6 = 0 then 'noch neu ' when n % 3 = 0 then 'neu ' else '' end || title as title, language, duration_ms, speaker_count, status, created_at,
  updated_at + case when n % 6 = 0 then 2 when n % 3 = 0 then 1 else 0 end as updated_at from x where n % 6 < 5""",
    "save_transcripts": f"""{SQL}, x as (select * replace (title || case when cast(transcript_id as bigint) % 4 = 0 then ' (2)' else '' end as title) from t),
y as (select * replace (case when cast(transcript_id as bigint) % 8 = 0 and seq % 2 = 0 then upper(text) else text end as text) from s
  where cast(transcript_id as bigint) % 8 <> 0 or seq % 2 = 0 or not exists (select 1 from s z where z.transcript_id = s.transcript_id and z.seq % 2 = 0)) {DIGEST.format(t="x", s="y")}""",
    "rename_transcripts": f"{SQL} select * replace (case when cast(transcript_id as bigint) % 10 = 0 then 'Titel ' || transcript_id else title end as title) from t",
    "rename_documents": f"{SQL} select * replace (case when speaker_count = 2 then 'zwei' else title end as title, case when speaker_count = 2 then 1700000000000 else updated_at end as updated_at) from t",
    "delete_cascade": f"{SQL}, x as (select * from t where status <> 'open'), y as (select * from s where transcript_id not in (select transcript_id from t where status = 'open')) {DIGEST.format(t='x', s='y')}",
    "document_scan": f"{SQL} select * from t",
    "document_lookup": f"{SQL} select * from s where transcript_id = '17'",
    "migrate_documents": f"{SQL}, x as (select * replace (case when cast(transcript_id as bigint) % 4 > 0 then upper(title) else title end as title) from t), y as (select * from s where transcript_id in (select transcript_id from t)) {DIGEST.format(t='x', s='y')}",
    "delete_documents": f"{SQL} select t.transcript_id, title, count(s.seq) as n from t left join s using (transcript_id) where not t.transcript_id like '%7' group by all",
    "stored_lookup": f"{SQL} select * from s where transcript_id = '42'",
    "stored_edits": f"""{SQL}, i as (select *, cast(transcript_id as bigint) as n from t),
x as (select transcript_id, case when n % 10 = 0 then 'neu' when n % 4 > 0 then upper(title) else title end as title, case when n % 10 = 0 then 1 else updated_at end as updated_at from i where n % 7 <> 0),
y as (select * from s where cast(transcript_id as bigint) % 7 <> 0 and transcript_id in (select transcript_id from t)) {DIGEST.format(t='x', s='y')}""",
    "export_json": f"""{SQL}, p as (select transcript_id, string_agg('    {{' || chr(10) || {_fields("segmentId=segment_id", "startTimeMs=+start_ms", "endTimeMs=+end_ms", "text=text", "speakerId=speaker_id", "speakerLabel=speaker_label", indent=6)} || chr(10) || '    }}', ',' || chr(10) order by seq) as parts from s group by all)
select transcript_id, '{{' || chr(10) || {_fields("transcriptId=transcript_id", "title=title", "language=language", "durationMs=+duration_ms", "speakerCount=+speaker_count", "createdAt=+created_at", "updatedAt=+updated_at", indent=2)} || ',' || chr(10) || '  "segments": [' || chr(10) || coalesce(parts || chr(10), '') || '  ]' || chr(10) || '}}' || chr(10) as report
  from t left join p using (transcript_id)""",
    "shown_values": f"""{SQL}, x as (select *, cast(round_even(duration_ms / 1000, 0) as bigint) as r, duration_ms // 1000 as q from t)
select transcript_id, printf('%d:%02d', q // 60, q % 60) as minutes, printf('%d:%02d Min', q // 60, q % 60) as duration, printf('%02d:%02d:%02d', r // 3600, r // 60 % 60, r % 60) as rounded, printf('%02d:%02d:%02d', q // 3600, q // 60 % 60, q % 60) as hms,
  strftime(make_timestamp(created_at * 1000), '%d.%m.%Y · %H:%M') as date, strftime(make_timestamp(created_at * 1000), '%Y%m%d_%H%M%S') as file_date, strftime(make_timestamp(updated_at * 1000), '%H:%M:%S.%g') as clock,
  case when speaker_count > 0 then speaker_count || ' Sprecher' else '' end as speakers, 'Sprecher ' || (speaker_count + 1) as name, title || case when speaker_count > 1 then ' x' else '' end as joined,
  '"' || '\\"\\\\\\u0001\\b\\f\\r\\n\\t' || status || '"' as json from x""",
    "word_lists": r"select conv_id, turn, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-zäöüß0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> ''), '|') as words from conversations",
}
