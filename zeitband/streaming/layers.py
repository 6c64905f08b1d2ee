"""What is shown of live timelines, kept up to date from changes alone.

Three layers are stored by timeline: raw segments, labels that were assigned to them, and what is shown. A batch of
changes touches some timelines. Their buckets' rows and the changes are dealt by bucket once, and what is known of each
segment is written beside it; files of that hold whole buckets, so layers are written from them where they lie. Of the timelines only the ones whose raw segments or labels are others than before are shown
anew, and only where what is shown differs is anything written or handed on. All layers change in one commit, which
names the batch, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zeitband.operators.candidates import KEY
from zeitband.operators.labels import label, merge_display
from zeitband.shared import delete_folder, new_folder, small_tasks
from zeitband.sources.versions import VersionedTables

SEGMENT = "tid long, seq int, start_ms long, end_ms long, text string, speaker_id string, speaker_label string, is_final boolean, is_new boolean"
#: A change is a segment (new, or in place of the one of its key), or a label for one (kind: segment or label).
CHANGE = f"kind string, at long, {SEGMENT}"
LAYERS = {
    "raw": SEGMENT,
    "assigned": "tid long, seq int, speaker_id string, speaker_label string",
    "shown": f"{SEGMENT}, n_merged long, place long",
    "last_ids": "tid long, seq int, speaker_id string",
    "digests": "tid long, input string, output string",
}
LOG = "touched long, recomputed long, suppressed long, remapped long"


LABEL = ["speaker_id", "speaker_label"]
NAMES = ["tid", "seq", "start_ms", "end_ms", "text", *LABEL, "is_final", "is_new"]


def _hash(names: list[str]) -> Column:
    """Of a row; sums of these differ if a timeline's rows do (but for chances of 2**-64), in whatever order."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in names]).cast("decimal(38,0)")


class LiveLayers:
    """The layers under ``path``, with a feed of what changed (``updates``), of segments that changed speaker
    (``remaps``) and of counts (``log``), a folder a batch each."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = VersionedTables(spark, f"{self.path}/layers", LAYERS, "tid", buckets)

    def shown(self) -> DataFrame:
        return self.tables.read("shown")

    def feed(self, name: str) -> DataFrame:
        schema = {"updates": LAYERS["shown"], "remaps": "tid long, seq int, before string, speaker_id string", "log": LOG}[name]
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")

    def _hand_on(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        """``rows`` as they are read back from the feed."""
        path = f"{self.path}/{name}/batch={batch}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def refresh(self, changes: DataFrame, batch: int) -> None:
        """Take in a batch of changes (as in ``CHANGE``; of changes of one key the last by ``at`` counts)."""
        base, done = self.tables.version(), self.tables.note().get("batch", -1)
        if done >= batch:
            return
        scratch = new_folder(self.spark, "refresh")

        def kept(rows: DataFrame, name: str) -> DataFrame:
            with small_tasks(rows.sparkSession):
                rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{scratch}/{name}")
            return self.spark.read.schema(rows.schema).parquet(f"{scratch}/{name}")

        touched = self.tables.buckets_of(changes.filter("tid is not null").select("tid"))
        state = kept(self._state(changes, {t: self.tables.read_buckets(t, touched, base) for t in LAYERS}, len(touched)), "state")
        segments, heads = state.filter("kind = 'segment'"), state.filter("head")
        dirty = segments.filter("dirty")
        shown = kept(self._shown(dirty, heads.filter("dirty"), len(touched)), "shown")
        digests = shown.filter("head")
        changed = digests.filter("changed").select("tid")
        updates = shown.filter("head is null and changed").select(*self.shown().columns)
        self._hand_on(updates, "updates", batch)
        shown_id = label("best.speaker_id")
        remaps = self._hand_on(dirty.filter(F.col("before") != shown_id).select(*KEY, "before", shown_id.alias("speaker_id")), "remaps", batch)
        n = heads.agg(F.count_if("touched"), F.count_if("dirty")).first()
        self._hand_on(self.spark.createDataFrame([(n[0], n[1], n[1] - changed.count(), remaps.count())], LOG), "log", batch)
        anew = heads.filter("dirty").select("tid")

        def edit(now):
            last = F.when(F.col("dirty"), F.coalesce(shown_id, "before")).otherwise(F.col("before"))
            kept_digests = state.filter("kind = 'digest' and not dirty").select("tid", "input", "output")
            return {
                "raw": (segments, anew, True),
                "assigned": (state.filter("kind = 'label'"), anew, True),
                "shown": (self._others(now["shown"], changed).unionByName(updates), changed, True),
                "last_ids": (segments.select(*KEY, last.alias("speaker_id")).filter("speaker_id is not null"), anew, True),
                "digests": (kept_digests.unionByName(digests.select("tid", "input", "output")), anew, True),
            }

        self.tables.edit(anew, edit, base, {"batch": batch})
        delete_folder(self.spark, scratch)

    def _state(self, changes: DataFrame, old: dict[str, DataFrame], buckets: int) -> DataFrame:
        """Segments and labels of the touched buckets after a batch, and old digests (kind: segment, label or digest). On
        segments: ``best``, under which they are shown, and the id ``before``, the last that was. On all rows of a timeline:
        its ``input`` and ``old_output``, whether it was ``touched`` and is ``dirty``; one of them is its ``head``."""
        is_label = F.col("kind") == "label"
        new = changes.withColumns({c: F.when(~is_label, F.col(c)) for c in NAMES if c not in (*KEY, *LABEL)} | {"fresh": F.lit(True)})
        kinds = {"raw": "segment", "assigned": "label", "last_ids": "last", "digests": "digest"}
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [new, *(old[t].withColumn("kind", F.lit(k)) for t, k in kinds.items())])
        group, row = ["__bucket", "tid"], [c for c in NAMES if c not in KEY]
        place, timeline = Window.partitionBy(*group, "seq"), Window.partitionBy(*group)
        last = Window.partitionBy(*group, "seq", "kind").orderBy(F.desc("fresh"), F.desc("at"), *map(F.desc, row))
        one = self.tables.dealt(rows.filter("tid is not null"), buckets).withColumn("__n", F.row_number().over(last)).filter("__n = 1")
        of = lambda kind, value: F.when(F.col("kind") == kind, value)
        given = F.when(F.col("seq").isNotNull() & F.col("speaker_id").isNotNull(), F.struct(*LABEL))
        digest = lambda kind, names: F.when(F.count(of(kind, 1)).over(timeline) > 0, F.concat_ws("/", F.count(of(kind, 1)).over(timeline), F.sum(of(kind, _hash(names))).over(timeline)))
        known = one.withColumns(
            {
                "given": F.max(of("label", given)).over(place),
                "before": F.max(of("last", F.col("speaker_id"))).over(place),
                "input_now": F.concat_ws("|", F.coalesce(digest("segment", NAMES), F.lit("")), F.coalesce(digest("label", [*KEY, *LABEL]), F.lit(""))),
                "old_input": F.max(of("digest", F.col("input"))).over(timeline),
                "old_output": F.max(of("digest", F.col("output"))).over(timeline),
                "touched": F.coalesce(F.max("fresh").over(timeline), F.lit(False)),
                "head": F.row_number().over(timeline.orderBy("seq", "kind")) == 1,
            }
        )
        dirty = F.col("touched") & ~F.col("input_now").eqNullSafe(F.col("old_input"))
        best = F.when(F.col("kind") == "segment", F.coalesce("given", F.struct(*LABEL)))
        now = F.when(dirty, F.col("input_now")).otherwise(F.col("old_input"))
        of_timeline = lambda c: F.when(F.col("head") | (F.col("kind") == "digest"), c)
        made = known.select("kind", *NAMES, best.alias("best"), of("segment", F.col("before")).alias("before"), of_timeline(now).alias("input"), "output", of_timeline(F.col("old_output")).alias("old_output"), "touched", dirty.alias("dirty"), "head")
        return made.filter("head or kind in ('segment', 'label', 'digest')")

    def _shown(self, dirty: DataFrame, heads: DataFrame, buckets: int) -> DataFrame:
        """What is shown of timelines, and their heads with the digest of that (``output``); both with whether it is
        ``changed``."""
        merged = merge_display(dirty.filter("is_final").withColumns({c: F.col(f"best.{c}") for c in LABEL}))
        waiting = dirty.filter("not is_final").select(*NAMES).withColumn("n_merged", F.lit(0).cast("long"))
        rows = merged.unionByName(waiting).unionByName(heads.select("tid", "input", "old_output", "head"), allowMissingColumns=True)
        timeline, is_row = Window.partitionBy("__bucket", "tid"), F.col("head").isNull()
        place = F.row_number().over(timeline.orderBy("head", "start_ms", "n_merged", "seq")).cast("long")
        n = F.count(F.when(is_row, 1)).over(timeline)
        output = F.when(n > 0, F.concat_ws("/", n, F.sum(F.when(is_row, _hash([*NAMES, "n_merged", "place"]))).over(timeline)))
        made = self.tables.dealt(rows, buckets).withColumn("place", place).withColumns({"output": output, "before": F.max("old_output").over(timeline)})
        return made.withColumn("changed", ~F.col("output").eqNullSafe(F.col("before"))).withColumn("output", F.when(~is_row, F.col("output"))).drop("__bucket", "old_output", "before")

    def _others(self, old: DataFrame, keys: DataFrame) -> DataFrame:
        """The rows of ``old`` of other timelines than ``keys``, dealt by bucket."""
        rows = old.withColumn("__key", F.lit(False)).unionByName(keys.withColumn("__key", F.lit(True)), allowMissingColumns=True)
        dealt = self.tables.dealt(rows, len(self.tables.buckets_of(keys)))
        return dealt.withColumn("__any", F.max("__key").over(Window.partitionBy("__bucket", "tid"))).filter("not __any").select(*old.columns)

    def follow(self, changes: DataFrame, checkpoint: str) -> None:
        """Take in a stream of changes until its sources end."""
        changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(self.refresh).start().awaitTermination()
