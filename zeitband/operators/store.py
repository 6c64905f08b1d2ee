"""A store of transcripts and their segments: reads, searches, edits, and nested JSON documents.

transcripts: transcript_id, title, language, duration_ms, speaker_count, status, created_at, updated_at (epoch ms).
segments: transcript_id, segment_id, seq, start_ms, end_ms, text, speaker_id, speaker_label. Edits return the tables as
they are after the edit. Null keys match nothing when edits look for rows, except that ``upsert`` takes them as equal;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zeitband.functions.text import ascii_like, contains_text, json_text
from zeitband.shared import small_tasks
from zeitband.sources.versions import VersionedTables

SEGMENT = "array<struct<seq:int,start_ms:bigint,end_ms:bigint,speaker_id:string,text:string>>"
DOCUMENT = (
    "transcript_id string, title string, language string, duration_ms bigint, speaker_count int, status string, created_at bigint, updated_at bigint, "
    "segments array<struct<segment_id:string,seq:int,start_ms:bigint,end_ms:bigint,text:string,speaker_id:string,speaker_label:string>>"
)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; of several new rows with one key the last by ``order`` counts, of
    those with equal ``order`` the one with the largest values. Null keys are equal to each other."""
    rest = [c for c in new.columns if c not in (*keys, order)]
    last = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(c) for c in rest])
    fresh = new.withColumn("__place", F.row_number().over(last)).filter("__place = 1").drop("__place")
    a, b = old.alias("a"), fresh.select(*keys).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, same, "left_anti").unionByName(fresh)


def delete(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without those whose key is in ``keys``."""
    return rows.join(keys, keys.columns, "left_anti")


# Reads.


def newest_first(transcripts: DataFrame) -> DataFrame:
    return transcripts.orderBy(F.desc("created_at"), "transcript_id")


def find_transcript(transcripts: DataFrame, transcript_id: str) -> DataFrame:
    return transcripts.filter(F.col("transcript_id") == transcript_id)


def segments_of(segments: DataFrame, transcript_id: str) -> DataFrame:
    """The segments of one transcript by start; equal starts by seq."""
    return segments.filter(F.col("transcript_id") == transcript_id).orderBy("start_ms", "seq", "segment_id")


def with_segments(transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """Each transcript with each of its segments; transcripts without any are left out."""
    return transcripts.select("transcript_id", "title", "created_at").join(segments, "transcript_id")


# Searches.


def search_titles(transcripts: DataFrame, query: str) -> DataFrame:
    """Titles that contain the pattern, A-Z in either case, % and _ as wildcards; newest first."""
    return newest_first(transcripts.filter(ascii_like(F.col("title"), query)))


def search_segments(segments: DataFrame, transcript_id: str, query: str) -> DataFrame:
    return segments_of(segments.filter(ascii_like(F.col("text"), query)), transcript_id)


def search_anywhere(transcripts: DataFrame, segments: DataFrame, query: str) -> DataFrame:
    """Transcripts whose title or any segment contains the query literally, in either case; each once, newest first."""
    in_text = segments.filter(contains_text(F.col("text"), query)).select("transcript_id").distinct()
    by_text = transcripts.join(in_text, "transcript_id", "left_semi")
    return newest_first(transcripts.filter(contains_text(F.col("title"), query)).unionByName(by_text).dropDuplicates(["transcript_id"]))


# Edits.


def save(transcripts: DataFrame, segments: DataFrame, new_transcripts: DataFrame, new_segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after transcripts were saved with their segments. Segments of a saved transcript that are not among
    the new ones go, unless nothing at all was saved for it."""
    replaced = new_segments.select("transcript_id").distinct().join(new_transcripts.select("transcript_id").distinct(), "transcript_id", "left_semi")
    saved = new_segments.join(replaced, "transcript_id", "left_semi")
    return upsert(transcripts, new_transcripts, ["transcript_id"], "updated_at"), upsert(delete(segments, replaced), saved, ["segment_id"], "seq")


def rename(transcripts: DataFrame, titles: DataFrame, now_ms: int | None = None) -> DataFrame:
    """``titles`` (transcript_id, new_title) put in; updated_at becomes ``now_ms`` where one is given. Ids that are not
    there change nothing; of several titles for one id the largest is taken."""
    one = titles.groupBy("transcript_id").agg(F.max("new_title").alias("__title"))
    rows = transcripts.join(one, "transcript_id", "left")
    if now_ms is not None:
        rows = rows.withColumn("updated_at", F.when(F.col("__title").isNotNull(), F.lit(now_ms).cast("bigint")).otherwise(F.col("updated_at")))
    return rows.withColumn("title", F.coalesce("__title", "title")).select(*transcripts.columns)


def delete_transcripts(transcripts: DataFrame, segments: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the transcripts of ``ids``."""
    ids = ids.select("transcript_id")
    return delete(transcripts, ids), delete(segments, ids)


def migrate(transcripts: DataFrame, segments: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the documents (as ``scan_documents`` gives them) that are not there yet, so that running it again
    brings back nothing that was renamed since."""
    fresh = documents.join(transcripts.select("transcript_id"), "transcript_id", "left_anti").dropDuplicates(["transcript_id"])
    return transcripts.unionByName(fresh.select(*transcripts.columns)), segments.unionByName(document_segments(fresh).select(*segments.columns))


# Documents.


def nested(transcripts: DataFrame, segments: DataFrame, by: str = "transcript_id") -> DataFrame:
    """Transcripts with their segments as an array in order of seq. A document is one row, so its segments meet: ``by``
    names a column of both by which they may lie together already, in place of the id."""
    one = F.struct("seq", "start_ms", "end_ms", "segment_id", "text", "speaker_id", "speaker_label")
    lists = segments.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("s"))
    typed = F.transform("s", lambda x: F.struct(x["segment_id"].alias("segment_id"), x["seq"].cast("int").alias("seq"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["text"].alias("text"), x["speaker_id"].alias("speaker_id"), x["speaker_label"].alias("speaker_label")))
    return transcripts.join(lists, by, "left").withColumn("segments", F.coalesce(typed, F.array())).drop("s")


def write_documents(documents: DataFrame, path: str) -> None:
    """Nested transcripts as compressed JSON files, one document a line, nulls written out."""
    with small_tasks(documents.sparkSession):
        documents.write.option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def scan_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The documents of a folder, in no order. What is broken or has no id is left out; missing fields get their
    defaults: empty title, language "de", status "finalized", no time, no speakers, and the file's time."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(path)
    changed = F.unix_millis("_metadata.file_modification_time")
    defaults = {"title": F.lit(""), "language": F.lit("de"), "duration_ms": F.lit(0), "speaker_count": F.lit(0), "status": F.lit("finalized"), "created_at": changed, "updated_at": changed}
    return rows.withColumns({c: F.coalesce(F.col(c), d.cast(rows.schema[c].dataType)) for c, d in defaults.items()}).filter(F.col("transcript_id").isNotNull())


def document_segments(documents: DataFrame) -> DataFrame:
    """The segments of nested documents, in document order by seq."""
    return documents.select("transcript_id", F.explode("segments").alias("s")).select("transcript_id", "s.*")


def json_report(transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """transcript_id and its report as JSON text of a fixed layout."""

    def field(name: str, value: Column, indent: int) -> Column:
        return F.concat(F.lit(" " * indent + f'"{name}": '), value)

    def lines(*fields: Column) -> Column:
        return F.concat_ws(",\n", *fields)

    def number(name: str) -> Column:
        return F.col(name).cast("bigint").cast("string")

    own = lines(field("segmentId", json_text(F.col("segment_id")), 6), field("startTimeMs", number("start_ms"), 6), field("endTimeMs", number("end_ms"), 6), field("text", json_text(F.col("text")), 6), field("speakerId", json_text(F.col("speaker_id")), 6), field("speakerLabel", json_text(F.col("speaker_label")), 6))
    one = F.struct("seq", F.concat(F.lit("    {\n"), own, F.lit("\n    }")).alias("part"))
    parts = segments.groupBy("transcript_id").agg(F.array_sort(F.collect_list(one))["part"].alias("parts"))
    head = lines(field("transcriptId", json_text(F.col("transcript_id")), 2), field("title", json_text(F.col("title")), 2), field("language", json_text(F.col("language")), 2), field("durationMs", number("duration_ms"), 2), field("speakerCount", number("speaker_count"), 2), field("createdAt", number("created_at"), 2), field("updatedAt", number("updated_at"), 2))
    body = F.when(F.size("parts") > 0, F.concat(F.array_join("parts", ",\n"), F.lit("\n"))).otherwise("")
    return transcripts.join(parts, "transcript_id", "left").select("transcript_id", F.concat(F.lit("{\n"), head, F.lit(',\n  "segments": [\n'), body, F.lit("  ]\n}\n")).alias("report"))


def to_documents(segments: DataFrame) -> DataFrame:
    """tid and its segments in order as one JSON text. A transcript is the unit of a document, so its segments meet."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), "start_ms", "end_ms", "speaker_id", "text")))
    return segments.groupBy("tid").agg(F.to_json(parts, {"ignoreNullFields": "false"}).alias("document"))


def from_documents(documents: DataFrame) -> DataFrame:
    """The segments of documents; a broken document has none."""
    parts = F.explode(F.from_json("document", SEGMENT)).alias("s")
    return documents.select("tid", parts).select("tid", "s.*")


# A store on disk, whose two tables change together.

STORED = {
    "transcripts": "transcript_id string, title string, language string, duration_ms bigint, speaker_count int, status string, created_at bigint, updated_at bigint",
    "segments": "transcript_id string, segment_id string, seq int, start_ms bigint, end_ms bigint, text string, speaker_id string, speaker_label string",
}


class TranscriptStore(VersionedTables):
    """Transcripts and segments by transcript_id; every edit is one commit of both tables."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        super().__init__(spark, path, STORED, "transcript_id", buckets)

    def save(self, transcripts: DataFrame, segments: DataFrame) -> int:
        """As ``save``."""
        ids = transcripts.select("transcript_id").union(segments.select("transcript_id"))
        return self.edit(ids, lambda now: dict(zip(STORED, save(now["transcripts"], now["segments"], transcripts, segments), strict=True)))

    def delete(self, ids: DataFrame) -> int:
        """As ``delete_transcripts``."""
        return self.edit(ids, lambda now: dict(zip(STORED, delete_transcripts(now["transcripts"], now["segments"], ids), strict=True)))

    def rename(self, titles: DataFrame, now_ms: int | None = None) -> int:
        """As ``rename``; the segments' files stay as they are."""
        return self.edit(titles, lambda now: {"transcripts": rename(now["transcripts"], titles, now_ms)})

    def migrate(self, documents: DataFrame) -> int:
        """As ``migrate``."""
        return self.edit(documents, lambda now: dict(zip(STORED, migrate(now["transcripts"], now["segments"], documents), strict=True)))


class DocumentStore(VersionedTables):
    """Nested transcripts as JSON, one document a line, in buckets by transcript_id."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        super().__init__(spark, path, {"documents": DOCUMENT}, "transcript_id", buckets, "json")

    def put(self, documents: DataFrame) -> int:
        """Documents in place of those with their ids."""
        return self.edit(documents, lambda now: {"documents": delete(now["documents"], documents.select("transcript_id")).unionByName(documents.select(*now["documents"].columns))})

    def delete(self, ids: DataFrame) -> int:
        """As ``delete``; documents move once, to their buckets."""
        return self.edit(ids, lambda now: {"documents": (self.without(now["documents"], ids), ids, True)})
