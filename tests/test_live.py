"""Live timelines: layers that follow changes, and the join of two streams, against whole recomputes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from zeitband.operators import candidates, intervals
from zeitband.plans.labelings import live_changes
from zeitband.shared import new_folder
from zeitband.streaming.assign import pieces, stream_assign, without_turns
from zeitband.streaming.layers import CHANGE, SEGMENT, LiveLayers

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def segment(tid, seq, start, end, text="x", who=None, name=None, final=True, kind="segment", at=0):
    return (kind, at, tid, seq, start, end, text, who, name, final, False)


def given(tid, seq, who, name, at=0):
    return segment(tid, seq, None, None, None, who, name, None, "label", at)


def test_only_what_changes_is_written(spark, tmp_path):
    live = LiveLayers(spark, f"file://{tmp_path}", buckets=4)
    take = lambda n, *changes: live.refresh(spark.createDataFrame(changes, CHANGE), n)
    log = lambda n: tuple(live.feed("log").filter(F.col("batch") == n).select("touched", "recomputed", "suppressed", "remapped").first())
    updated = lambda n: {r["tid"] for r in live.feed("updates").filter(F.col("batch") == n).collect()}
    take(0, segment(1, 1, 0, 500), segment(1, 2, 600, 900), segment(2, 1, 0, 500, who="speaker_0", name="A"), segment(3, 1, 0, 900, final=False))
    assert log(0) == (3, 3, 0, 0) and updated(0) == {1, 2, 3}
    # The same again, and a label: timeline 2 is touched, but nothing of it is another than before.
    take(1, segment(2, 1, 0, 500, who="speaker_0", name="A"), given(1, 1, "speaker_1", "B"), given(1, 2, "speaker_1", "B"))
    assert log(1) == (2, 1, 0, 0) and updated(1) == {1}
    shown = {(r["tid"], r["seq"], r["speaker_id"], r["n_merged"]) for r in live.shown().collect()}
    assert shown == {(1, 1, "speaker_1", 2), (2, 1, "speaker_0", 1), (3, 1, None, 0)}
    before = live.tables.manifest(live.tables.version())
    # A label of a segment that isn't there changes a layer, but nothing that is shown.
    take(2, given(2, 9, "speaker_5", "C"))
    after = live.tables.manifest(live.tables.version())
    assert log(2) == (1, 1, 1, 0) and updated(2) == set() and after["shown"] == before["shown"] and after["assigned"] != before["assigned"]
    # Another speaker, then none: the last one that was shown is what counts.
    take(3, given(1, 2, "speaker_2", "D"))
    take(4, given(1, 2, " ", None, at=1), given(1, 2, "speaker_7", "x", at=0))
    take(5, given(1, 2, "speaker_2", "D"), given(2, 1, "speaker_3", "E"))
    assert log(3)[3] == 1 and log(4)[3] == 0 and log(5)[3] == 1
    assert {(r["batch"], r["tid"], r["before"], r["speaker_id"]) for r in live.feed("remaps").collect()} == {(3, 1, "speaker_1", "speaker_2"), (5, 2, "speaker_0", "speaker_3")}
    # Nothing but what is there, and a batch that runs again: versions move, files don't.
    files = live.tables.manifest(live.tables.version())
    take(6, given(2, 1, "speaker_3", "E"))
    live.refresh(spark.createDataFrame([segment(9, 1, 0, 1)], CHANGE), 6)
    assert log(6) == (1, 0, 0, 0) and live.tables.manifest(live.tables.version()) == files and live.tables.note() == {"batch": 6}


def test_batches_like_a_whole_recompute(spark, tmp_path):
    live = LiveLayers(spark, f"file://{tmp_path}")
    batches = live_changes(spark, FOLDER)
    for i, b in enumerate(batches):
        live.refresh(b, i)
    raw = batches[0].unionByName(batches[1].filter("kind = 'segment'").select(*batches[0].columns)).drop("kind", "at")
    assigned = batches[2].filter("kind = 'label'").select("tid", "seq", "speaker_id", "speaker_label")
    want = candidates.display(raw.filter("is_final"), assigned, raw.filter("not is_final"))
    assert rows(live.shown()) == rows(want.select(*live.shown().columns))
    touched, recomputed, suppressed = (sum(r[c] for r in live.feed("log").collect()) for c in ("touched", "recomputed", "suppressed"))
    assert recomputed < touched and suppressed > 0


def test_layers_move_little(spark, tmp_path):
    """A batch of labels for all timelines: what is shuffled, in deals of all segments and labels. Where each layer was
    dealt for itself, that was 6.5."""
    sc = spark.sparkContext._jsc.sc()

    def moved(run):
        def total():
            sc.listenerBus().waitUntilEmpty()
            found = sc.statusStore().executorList(False)
            return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

        before = total()
        run()
        return total() - before

    rows = spark.range(24_000).select((F.col("id") / 6).cast("long").alias("tid"), (F.col("id") % 6).cast("int").alias("seq"))
    segments = rows.selectExpr("'segment' kind", "0L at", "tid", "seq", "seq * 1000L start_ms", "seq * 1000L + 900 end_ms", "sha2(cast(tid * 6 + seq as string), 224) text", "'speaker_0' speaker_id", "'A' speaker_label", "true is_final", "false is_new")
    labels = rows.selectExpr("'label' kind", "1L at", "tid", "seq", "null start_ms", "null end_ms", "null text", "concat('speaker_', seq) speaker_id", "'B' speaker_label", "null is_final", "null is_new")
    live = LiveLayers(spark, f"file://{tmp_path}", buckets=4)
    live.refresh(segments, 0)
    once = moved(lambda: segments.unionByName(labels).repartition(4, "tid").write.format("noop").mode("overwrite").save())
    assert moved(lambda: live.refresh(labels, 1)) < 5.8 * once
    assert live.shown().filter("speaker_label = 'B' and n_merged = 6").count() == 4000


def test_empty_batch(spark, tmp_path):
    live = LiveLayers(spark, f"file://{tmp_path}")
    live.refresh(spark.createDataFrame([], CHANGE), 0)
    assert live.shown().count() == 0 and live.feed("log").first()["touched"] == 0 and SEGMENT in CHANGE


# Two streams.


def timelines(n, seed=2):
    """Segments and turns of three timelines in an order of time, and where each second ends."""
    rng = random.Random(seed)
    segs, turns = [], []
    for i in range(n):
        at = 3_600_000 + 2000 * i + rng.randrange(1000)
        segs.append((i % 3, i, at, at + rng.choice([100, 1500, 4000]), rng.choice([None, "speaker_9"]), "x"))
        for _ in range(rng.randrange(3)):
            s = at + rng.randrange(-1500, 1500)
            turns.append((i % 3 if i % 3 < 2 else 0, len(turns), s, s + rng.choice([90, 500, 3000, 15_000]), rng.randrange(3)))
    return segs, turns


SEGS, TURNS = "tid long, seq int, start_ms long, end_ms long, speaker_id string, text string", "tid long, turn_seq long, start_ms long, end_ms long, speaker long"


def stream_of(spark, batches, schema):
    path = new_folder(spark, "batches")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{path}/{i}")
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


@pytest.mark.parametrize("n", [120, 360])
def test_two_streams_like_two_tables(spark, n):
    """Batches of 40 segments and their turns; state stays as it is, however long the streams are."""
    segs, turns = timelines(n)
    k, end = n // 40, 10**10
    cut = lambda rows, i: [r for r in rows if 3_600_000 + 80_000 * i <= r[2] + 2000 < 3_600_000 + 80_000 * (i + 1)]
    parts = [[cut(rows, i) for i in range(k + 1)] for rows in (segs, turns)]
    parts = [[p for p in x if p] for x in parts]
    last = [[(-1, 0, end, end + 1, None, "")], [(-1, 0, end, end + 1, 0)]]
    late = [(0, 10_000, 3_600_000, 3_600_500, None, "late")]
    streams = [stream_of(spark, [*p, x], schema) for p, x, schema in zip([[*parts[0], late], [*parts[1], [(0, 10_000, 3_600_000, 3_600_900, 1)]]], last, (SEGS, TURNS), strict=True)]
    got = []
    query = stream_assign(*streams, longest_ms=5000, late="20 seconds").writeStream.outputMode("append").option("checkpointLocation", new_folder(spark, "state")).trigger(availableNow=True)
    query = query.foreachBatch(lambda df, i: got.extend(df.collect())).start()
    query.awaitTermination()
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    got = [tuple(r) for r in got if r["tid"] >= 0]
    names = "tid long, seq int, start_ms long, end_ms long, text string, overlap_ms long, speaker_id string, reason string, own_id string"
    table = spark.createDataFrame(turns, TURNS)
    want = intervals.assign_speakers(spark.createDataFrame(segs, SEGS), table)
    made = without_turns(spark.createDataFrame(got, names), table)
    assert rows(made.select(*sorted(made.columns))) == rows(want.select(*sorted(made.columns)))
    assert max(held) < 260 < 3 * len(segs) and not any(r[4] == "late" for r in got)


def test_pieces_of_turns(spark):
    cut = pieces(spark.createDataFrame([(1, 1, 0, 2500, 7), (1, 2, 5, 5, 7), (1, 3, 10, 1010, 8)], TURNS), 1000)
    assert sorted((r["turn_seq"], r["t_start"], r["t_end"]) for r in cut.collect()) == [(1, 0, 1000), (1, 1000, 2000), (1, 2000, 2500), (3, 10, 1010)]
