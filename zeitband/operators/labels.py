"""Speaker labels of neighbouring segments: smoothing, filling and numbering. Rows: tid, seq, start_ms, end_ms,
speaker_id, text; a null or blank speaker_id is unlabeled."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from zeitband.functions.text import is_blank, speaker_name, trimmed
from zeitband.shared import stored

from .folds import fold_sorted
from .scans import SPAN, SPAN_MS, bucket, by_group, carried, told


def label(name: str = "speaker_id") -> Column:
    return F.when(~is_blank(F.col(name)), F.col(name))


def words(name: str = "text") -> Column:
    return F.size(F.split(trimmed(F.coalesce(F.col(name), F.lit(""))), r"\s+"))


def _near(*more: str) -> Column:
    """What a segment shows its neighbours: its label if it has one, its times, and ``more``."""
    return F.struct(label().alias("id"), *more, "start_ms", "end_ms")


def _both(rows: DataFrame) -> list[str]:
    """The label's text goes with the id wherever rows have it."""
    return [c for c in ("speaker_label",) if c in rows.columns]


def _taken(rows: DataFrame, found: Column) -> DataFrame:
    """``rows`` with id (and label) of the neighbour ``found`` where it is not null; without the working columns."""
    made = rows.withColumn("__found", found)
    put = {"speaker_id": F.when(F.col("__found").isNotNull(), F.col("__found.id")).otherwise(F.col("speaker_id"))}
    put |= {c: F.when(F.col("__found").isNotNull(), F.col(f"__found.{c}")).otherwise(F.col(c)) for c in _both(rows)}
    return made.withColumns(put).drop(*[c for c in made.columns if c.startswith("__")])


def smooth_islands(rows: DataFrame, longest_ms: int = 2000, most_words: int = 3, span: int | None = SPAN, where: str = "true") -> DataFrame:
    """A short segment between two of one other speaker takes their id and label (the one's before it), if a neighbour
    lasts three times as long and its own speaker has more segments."""
    near = _near(*_both(rows))
    counted = by_group(rows, ["tid", "speaker_id"], "seq", {"__n": ("sum", F.lit(1))}, span)
    met = carried(counted, "tid", ["seq"], before={"__left": near}, after={"__right": near}, span=span)
    length = lambda of="": F.col(f"{of}end_ms") - F.col(f"{of}start_ms")
    island = (F.col("__left.id") == F.col("__right.id")) & (F.col("__left.id") != label()) & (length() <= longest_ms) & (words() <= most_words)
    island &= (length() * 3 <= F.greatest(length("__left."), length("__right."))) & (F.col("__n") > 1)
    return _taken(met, F.when(island & F.expr(where), F.col("__left")))


def fill_between(rows: DataFrame, longest_ms: int = 2000, most_words: int = 3, span: int | None = SPAN, where: str = "true") -> DataFrame:
    """An unlabeled segment, short in time or words, between two of one speaker takes id and label of the one before."""
    near = _near(*_both(rows))
    met = carried(rows, "tid", ["seq"], before={"__left": near}, after={"__right": near}, span=span)
    short = (F.col("end_ms") - F.col("start_ms") <= longest_ms) | (words() <= most_words)
    return _taken(met, F.when(label().isNull() & (F.col("__left.id") == F.col("__right.id")) & short & F.expr(where), F.col("__left")))


def inherit_tiny(rows: DataFrame, longest_ms: int = 800, most_chars: int = 3, gap_ms: int = 500, span: int | None = SPAN, where: str = "true") -> DataFrame:
    """A tiny unlabeled segment takes id and label of the segment close before it, else of the one close after."""
    near = _near(*_both(rows))
    met = carried(rows, "tid", ["seq"], before={"__left": near}, after={"__right": near}, span=span)
    tiny = (F.col("end_ms") - F.col("start_ms") <= longest_ms) | (F.length(trimmed(F.col("text"))) <= most_chars)
    before = F.when((F.col("start_ms") - F.col("__left.end_ms")).between(0, gap_ms) & F.col("__left.id").isNotNull(), F.col("__left"))
    after = F.when((F.col("__right.start_ms") - F.col("end_ms")).between(0, gap_ms) & F.col("__right.id").isNotNull(), F.col("__right"))
    return _taken(met, F.when(label().isNull() & tiny & F.expr(where), F.coalesce(before, after)))


def fill_nearest(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """An unlabeled segment takes id and label of its nearest labeled neighbours, if their ids agree or only one exists."""
    near = F.when(label().isNotNull(), F.struct(label().alias("id"), *_both(rows)))
    met = carried(rows, "tid", ["seq"], before={"__left": near}, after={"__right": near}, span=span)
    left, right = F.col("__left"), F.col("__right")
    found = F.when(left.isNull() | right.isNull() | (F.col("__left.id") == F.col("__right.id")), F.coalesce(left, right))
    return _taken(met, F.when(label().isNull(), found))


def fill_leading(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """Unlabeled segments that end before the first labeled one take its id and label."""
    first = F.when(label().isNotNull(), F.struct("start_ms", "seq", F.col("speaker_id").alias("id"), *_both(rows)))
    met = by_group(rows, ["tid"], "seq", {"__first": ("min", first)}, span)
    return _taken(met, F.when(label().isNull() & (F.col("end_ms") <= F.col("__first.start_ms")), F.col("__first")))


def renumber(rows: DataFrame, span: int | None = SPAN) -> DataFrame:
    """speaker_no numbers the speakers of a timeline from 1 in the order of their first segments."""
    if span is None:
        first = F.when(label().isNotNull(), F.struct(F.min("seq").over(Window.partitionBy("tid", "speaker_id")).alias("at")))
        ranked = rows.withColumn("__first", first)
        number = F.dense_rank().over(Window.partitionBy("tid").orderBy(F.asc_nulls_last("__first")))
        return ranked.withColumn("speaker_no", F.when(F.col("__first").isNotNull(), number).cast("long")).drop("__first")
    marked = rows.withColumn("__bucket", bucket("seq", span))
    parts = marked.filter(label().isNotNull()).groupBy("tid", "speaker_id", "__bucket").agg(F.min("seq").alias("__first"))
    firsts = parts.groupBy("tid", "speaker_id").agg(F.min("__first").alias("__first"))
    ranked = firsts.select("tid", "speaker_id", F.dense_rank().over(Window.partitionBy("tid").orderBy("__first")).cast("long").alias("speaker_no"))
    numbers = told(parts.drop("__first"), ["tid", "speaker_id"], ranked)
    return told(marked, ["tid", "speaker_id", "__bucket"], numbers).drop("__bucket")


def collapse(rows: DataFrame, joins: Column, between: str = " ", span: int = SPAN) -> DataFrame:
    """Runs of rows that join the row before them, as one row each; texts joined in order, ``between`` them."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    blocks = carried(rows, "tid", ["seq"], sums={"__block": F.when(joins, 0).otherwise(1)}, span=span)
    merged = blocks.groupBy("tid", "__block").agg(F.min("seq").alias("seq"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("speaker_id", "seq").alias("speaker_id"), F.array_join(parts["text"], between).alias("text"), F.count(F.lit(1)).alias("n_merged"))
    return merged.drop("__block")


def merge_history(rows: DataFrame, gap_ms: int = 1200, span_ms: int | None = SPAN_MS, where: str = "true", keep: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours in order of start (then seq), both final and of one speaker, with gaps of 0 to ``gap_ms``, become one.
    Texts that are joined are trimmed, blank ones left out; a segment that joins none keeps its text as it is. Columns
    that ``keep`` names are the same in all of a timeline."""
    order, near = ["start_ms", "seq"], F.struct(label().alias("id"), "end_ms", "is_final")
    met = carried(rows, "tid", order, before={"__left": near}, span=span_ms)
    gap = F.col("start_ms") - F.col("__left.end_ms")
    joins = (F.col("__left.id") == label()) & F.col("is_final") & F.col("__left.is_final") & gap.between(0, gap_ms) & F.expr(where)
    blocks = carried(met.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).drop("__left"), "tid", order, sums={"__block": F.col("__new")}, span=span_ms)
    texts = F.array_sort(F.collect_list(F.struct("start_ms", "seq", "text")))["text"]
    merged = blocks.groupBy("tid", *keep, "__block").agg(
        F.min_by("seq", F.struct("start_ms", "seq")).alias("seq"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.min_by("speaker_id", F.struct("start_ms", "seq")).alias("speaker_id"),
        F.min_by("speaker_label", F.struct("start_ms", "seq")).alias("speaker_label"),
        texts.alias("__texts"),
        F.count(F.lit(1)).alias("n_merged"),
    )
    joined = F.array_join(F.filter(F.transform("__texts", trimmed), lambda t: t != ""), " ")
    return merged.withColumn("text", F.when(F.col("n_merged") == 1, F.get("__texts", F.lit(0))).otherwise(joined)).drop("__block", "__texts")


def merge_display(rows: DataFrame, gap_ms: int = 1200) -> DataFrame:
    """As ``merge_history``, but a segment also joins by an equal label (null equals null), is compared with the first
    segment of what it joins, and is_new is kept if any part is new."""
    names = ["tid", "seq", "start_ms", "end_ms", "speaker_id", "speaker_label", "text", "is_final", "is_new"]

    def fold(timeline: Iterable[dict]) -> Iterator[tuple]:
        head: dict | None = None
        for r in timeline:
            close = head is not None and None not in (r["start_ms"], head["end_ms"]) and 0 <= r["start_ms"] - head["end_ms"] <= gap_ms and head["is_final"] and r["is_final"]
            ids = [(x["speaker_id"] or "").strip() for x in (head, r)] if close else []
            if close and all(ids) and (ids[0] == ids[1] or head["speaker_label"] == r["speaker_label"]):
                both = [(x["text"] or "").strip() for x in (head, r)]
                head |= {"text": " ".join(t for t in both if t), "end_ms": max(head["end_ms"], r["end_ms"]), "is_new": head["is_new"] or r["is_new"], "n_merged": head["n_merged"] + 1}
                continue
            if head:
                yield tuple(head.values())
            head = r | {"n_merged": 1}
        if head:
            yield tuple(head.values())

    schema = StructType([*rows.select(*names).schema, StructField("n_merged", LongType())])
    return fold_sorted(rows.select(*names), "tid", ["start_ms", "seq"], fold, schema)


def name_by_appearance(rows: DataFrame, prefix: str = "Sprecher ", span: int | None = SPAN, where: str = "true") -> DataFrame:
    """speaker_label numbers the speakers of a timeline in the order of their first segments; ids stay."""
    numbered = renumber(rows, span)
    return numbered.withColumn("speaker_label", F.when(F.col("speaker_no").isNotNull() & F.expr(where), speaker_name(F.col("speaker_no") - 1, prefix)).otherwise(F.col("speaker_label"))).drop("speaker_no")


def enrich(rows: DataFrame, fewest: int = 3, span: int = SPAN, span_ms: int = SPAN_MS) -> DataFrame:
    """What is done to a transcript before it is saved, where it has ``fewest`` segments at least: islands smoothed,
    gaps between one speaker filled, tiny segments labeled, neighbours merged, speakers named by appearance.

    Timelines of up to ``span`` segments stay whole, and all steps are windows in the one place that each is dealt to.
    Longer ones spread over buckets: there each step refers to the rows of the one before more than once, so each is
    written to the shared folder."""
    names = ["tid", "seq", "start_ms", "end_ms", "speaker_id", "speaker_label", "text"]
    rows = rows.select(*names, "is_final")
    long = stored(rows.groupBy("tid").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > span), "enrich")
    if long.isEmpty():
        return _enriched(rows, fewest, None, None, lambda df: df).select(*names)
    marked = told(rows, ["tid"], long)
    spread = marked.filter(F.col("__n").isNotNull()).drop("__n")
    whole = marked.filter(F.col("__n").isNull()).drop("__n")
    done = _enriched(spread, fewest, span, span_ms, lambda df: stored(df, "enrich"))
    return _enriched(whole, fewest, None, None, lambda df: df).select(*names).unionByName(done.select(*names))


def _enriched(rows: DataFrame, fewest: int, span: int | None, span_ms: int | None, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The steps over all timelines; those of too few segments pass through them as they are."""
    done = kept(by_group(rows, ["tid"], "seq", {"enough": ("sum", F.lit(1))}, span).withColumn("enough", F.col("enough") >= fewest))
    for step in (smooth_islands, fill_between, inherit_tiny):
        done = kept(step(done, span=span, where="enough"))
    return name_by_appearance(kept(merge_history(done, span_ms=span_ms, where="enough", keep=("enough",))), span=span, where="enough")


def compact_tiny(rows: DataFrame, shortest_ms: int = 600, fewest_chars: int = 3, gap_ms: int = 1200, span: int = SPAN) -> DataFrame:
    """Segments of under ``shortest_ms`` or ``fewest_chars`` characters join the one before, if it is close."""
    met = carried(rows, "tid", ["seq"], before={"__end": F.col("end_ms")}, span=span)
    tiny = (F.col("end_ms") - F.col("start_ms") < shortest_ms) | (F.length(trimmed(F.col("text"))) < fewest_chars)
    return collapse(met, F.coalesce(tiny & (F.col("start_ms") - F.col("__end")).between(0, gap_ms), F.lit(False)), span=span)


def quality(rows: DataFrame) -> DataFrame:
    """Labeled and unlabeled segments, distinct speakers and labeled duration of each timeline."""
    known = label().isNotNull()
    return rows.groupBy("tid").agg(F.count_if(known).alias("labeled"), F.count_if(~known).alias("unlabeled"), F.count_distinct(label()).alias("speakers"), F.coalesce(F.sum(F.when(known, F.col("end_ms") - F.col("start_ms"))), F.lit(0)).alias("labeled_ms"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """New, changed and lost labels of each timeline between two labelings."""
    a, b = before.select("tid", "seq", label().alias("a")), after.select("tid", "seq", label().alias("b"))
    both = a.join(b, ["tid", "seq"], "full_outer")
    return both.groupBy("tid").agg(F.count_if(F.expr("a is null and b is not null")).alias("new"), F.count_if(F.expr("a <> b")).alias("changed"), F.count_if(F.expr("a is not null and b is null")).alias("lost"))
