"""Numbers about labelings and texts. Empty tables give no rows; null and blank speaker ids are unlabeled."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zeitband.functions.text import normal_words, speaker_number

from .intervals import overlaps
from .labels import label


def speaker_totals(rows: DataFrame) -> DataFrame:
    """tid, speaker_id, segments and duration of each speaker."""
    return rows.filter(label().isNotNull()).groupBy("tid", "speaker_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))


def stage_metrics(rows: DataFrame) -> DataFrame:
    """Segments, labeled ones, their duration, speakers, and the speakers' numbers as a text, of each timeline."""
    known = label().isNotNull()
    ids = F.array_join(F.array_sort(F.collect_set(F.when(known, F.regexp_replace("speaker_id", "^speaker_", "")))), ",")
    return rows.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("labeled"), F.coalesce(F.sum(F.when(known, F.col("end_ms") - F.col("start_ms"))), F.lit(0)).alias("labeled_ms"), F.count_distinct(label()).alias("speakers"), ids.alias("ids"))


def coverage(assigned: DataFrame, turns: DataFrame, long_ms: int = 8000) -> DataFrame:
    """Of each timeline with segments: their whole duration, that of the turns, speakers of turns, segments over
    ``long_ms``, and unlabeled segments that some turn overlaps."""
    ms = F.col("end_ms") - F.col("start_ms")
    own = assigned.groupBy("tid").agg(F.sum(ms).alias("segment_ms"), F.count_if(ms > long_ms).alias("long_segments"))
    heard = turns.groupBy("tid").agg(F.sum(ms).alias("turn_ms"), F.count_distinct("speaker").alias("speakers"))
    open_ = assigned.filter(label().isNull()).select("tid", "seq", "start_ms", "end_ms")
    missed = overlaps(open_, turns.select("tid", "start_ms", "end_ms"), "tid").select("tid", "seq").distinct().groupBy("tid").agg(F.count(F.lit(1)).alias("overlapped_unlabeled"))
    return own.join(heard, "tid", "left").join(missed, "tid", "left").fillna(0, ["turn_ms", "speakers", "overlapped_unlabeled"])


def first_two_speakers(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of each timeline that has two speakers at least: the first segment of a speaker that was not there before, and how
    many segments and how much time that speaker has."""
    old = before.filter(label().isNotNull()).select("tid", "speaker_id").distinct()
    totals = speaker_totals(after)
    several = totals.groupBy("tid").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2").select("tid")
    fresh = after.filter(label().isNotNull()).join(old, ["tid", "speaker_id"], "left_anti").join(several, "tid", "left_semi")
    first = fresh.groupBy("tid").agg(F.min_by(F.struct("speaker_id", "start_ms", "end_ms"), "seq").alias("f")).select("tid", "f.*")
    return first.join(totals, ["tid", "speaker_id"])


def remapped(shown: DataFrame) -> DataFrame:
    """Segments whose speaker differs from the one that they were shown with last: ``shown`` has tid, seq, batch and
    speaker_id; unlabeled ones are passed over."""
    known = shown.filter(label().isNotNull())
    before = F.lag("speaker_id").over(Window.partitionBy("tid", "seq").orderBy("batch"))
    return known.withColumn("before", before).filter("before <> speaker_id").select("tid", "seq", "batch", "before", "speaker_id")


def first_turns(turns: DataFrame, n: int = 12) -> DataFrame:
    """The first ``n`` turns of each timeline by start, with their length in seconds as text."""
    place = F.row_number().over(Window.partitionBy("tid").orderBy("start_ms", "turn_seq"))
    shown = F.format_string("[%.2f-%.2f]spk%d(%.1fs)", F.col("start_ms") / 1000, F.col("end_ms") / 1000, "speaker", (F.col("end_ms") - F.col("start_ms")) / 1000)
    return turns.withColumn("place", place).filter(F.col("place") <= n).select("tid", F.col("place").cast("long").alias("place"), shown.alias("shown"))


def votes_text(votes: DataFrame) -> DataFrame:
    """tid, local and the votes of a local speaker as text, the largest first."""
    one = F.struct((-F.col("overlap_ms")).alias("o"), "global", F.format_string("%d:%.2fs", "global", F.col("overlap_ms") / 1000).alias("t"))
    return votes.groupBy("tid", "local").agg(F.array_join(F.array_sort(F.collect_list(one))["t"], ",").alias("votes"))


def turn_numbers(rows: DataFrame) -> DataFrame:
    """tid, seq and the number in each speaker id, null for ids of another form."""
    return rows.select("tid", "seq", speaker_number(F.col("speaker_id")).alias("number"))


def contiguous(ends: DataFrame) -> DataFrame:
    """Segments of a recording from the ends of its utterances (tid, seq, end_ms): each begins where the last ended."""
    before = F.lag("end_ms").over(Window.partitionBy("tid").orderBy("seq"))
    return ends.select("tid", "seq", F.coalesce(before, F.lit(0)).alias("start_ms"), "end_ms")


def word_differences(pairs: DataFrame) -> DataFrame:
    """Words that differ between a reference and a hypothesis (``pairs``: id, reference, hypothesis): id, n_reference,
    n_hypothesis, replaced and deleted (words of the reference), inserted (words of the hypothesis), ratio (twice the
    matching words by all), error_rate (against the reference; null without words), and replaced_rate, which counts
    replaced words alone. A null text has no words."""
    words = lambda c: F.coalesce(normal_words(F.col(c)), F.array().cast("array<string>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for i, a, b in zip(batch["id"], batch["a"], batch["b"], strict=True):
                match = SequenceMatcher(None, list(a), list(b))
                counts = dict.fromkeys(("replace", "delete", "insert"), 0)
                for tag, s, e, t, u in match.get_opcodes():
                    if tag in counts:
                        counts[tag] += u - t if tag == "insert" else e - s
                n = len(a)
                made.append((i, n, len(b), *counts.values(), round(match.ratio(), 6), round(sum(counts.values()) / n, 6) if n else None, round(counts["replace"] / n, 6) if n else None))
            yield pd.DataFrame(made, columns=["id", "n_reference", "n_hypothesis", "replaced", "deleted", "inserted", "ratio", "error_rate", "replaced_rate"])

    kind = pairs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_reference long, n_hypothesis long, replaced long, deleted long, inserted long, ratio double, error_rate double, replaced_rate double"
    return pairs.select("id", words("reference").alias("a"), words("hypothesis").alias("b")).mapInPandas(run, schema)


#: The steps of an alignment, as one number each: every step costs one, and of alignments that cost the same the one with
#: fewer deletions is less, then the one with fewer insertions.
STEP, DELETION, INSERTION = 1 << 42, 1 << 21, 1


def _distance(a: list[str], b: list[str]) -> int:
    """The least sum of steps from ``a`` to ``b``."""
    codes: dict[str, int] = {}
    own = np.array([codes.setdefault(w, len(codes)) for w in a], dtype=np.int64)
    deletions = np.arange(len(a) + 1, dtype=np.int64) * (STEP + DELETION)
    row, best = deletions, np.empty_like(deletions)
    for w in b:
        best[0] = row[0] + STEP + INSERTION
        np.minimum(row[:-1] + np.where(own == codes.get(w, -1), 0, STEP), row[1:] + (STEP + INSERTION), out=best[1:])
        row = np.minimum.accumulate(best - deletions) + deletions
    return int(row[-1])


def word_errors(pairs: DataFrame) -> DataFrame:
    """The least word error of a hypothesis against a reference (``pairs``: id, reference, hypothesis): id, n_reference,
    n_hypothesis, replaced, deleted, inserted (of the alignment with the fewest of all three together; of these, with the
    fewest deletions, then insertions) and error_rate (against the reference; null without words). A null text has no
    words.

    A row of the table of distances is carried over the words of the hypothesis, as one array: work and memory of a pair
    grow with the product of its lengths and with the reference's length. Pairs are few bytes and much work, so they are
    dealt to four partitions a core whatever their size.
    """
    words = lambda c: F.coalesce(normal_words(F.col(c)), F.array().cast("array<string>"))
    rows = pairs.select("id", words("reference").alias("a"), words("hypothesis").alias("b")).repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            made = [_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
            sizes = [x.value_lengths().cast(pa.int64()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *sizes, pa.array(made, pa.int64())], ["id", "n_reference", "n_hypothesis", "d"])

    last = rows.mapInArrow(run, f"id {pairs.schema['id'].dataType.simpleString()}, n_reference long, n_hypothesis long, d long")
    steps, rest = F.expr(f"d div {STEP}L"), F.col("d") % STEP
    deleted, inserted = F.expr(f"(d % {STEP}L) div {DELETION}L"), rest % DELETION
    counts = last.select("id", "n_reference", "n_hypothesis", (steps - deleted - inserted).cast("long").alias("replaced"), deleted.cast("long").alias("deleted"), inserted.cast("long").alias("inserted"), steps.alias("steps"))
    return counts.withColumn("error_rate", F.when(F.col("n_reference") > 0, F.round(F.col("steps") / F.col("n_reference"), 6))).drop("steps")
