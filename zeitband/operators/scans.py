"""Values carried along timelines that no task holds whole: a segmented prefix scan.

A timeline is cut into buckets of its order column. Each bucket is summarised by one row (its last and first values
that are not null, its sums); the summaries of a timeline, a small table, are scanned; and what comes in from other
buckets is handed to each bucket as one more row, in front of its own. So rows move once, by (timeline, bucket), and
every window ends at a bucket's edge. A timeline of one bucket gets no row more.

Timelines that are known to be short need no buckets: without a ``span`` each is a window of its own, rows are referred
to once, and a chain of such operators moves them once.

Rows with a null key are a timeline of their own, as in any window; a null place comes first.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places (numbers in a timeline) in a bucket, and milliseconds where the order is by time.
SPAN = 2_000
SPAN_MS = 3_600_000
#: The bucket of null places: before all others.
NOWHERE = -(2**62)


def bucket(place: str, span: int) -> Column:
    return F.coalesce(F.floor(F.col(place) / span).cast("bigint"), F.lit(NOWHERE))


def carried(rows: DataFrame, key: str, order: list[str], before: Mapping[str, Column] | None = None, after: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None, span: int | None = SPAN) -> DataFrame:
    """``rows`` with a column for each name: the last value of ``before`` that is not null in the rows before, the first
    of ``after`` in the rows behind, the sum of ``sums`` up to and with the row. A value that is a struct is never
    null, so ``before`` of a struct is the row just before. The order within a timeline is by ``order``, numbers whose
    first is cut into buckets of ``span`` (None: timelines stay whole)."""
    before, after, sums = before or {}, after or {}, sums or {}
    marked = rows.withColumns({f"__{n}": c for n, c in (before | after | sums).items()})
    if span is None:
        return marked.withColumns(_found(before, after, sums, [key], order)).select(*rows.columns, *before, *after, *sums)
    marked = marked.withColumn("__bucket", bucket(order[0], span))
    place = lambda n: F.when(F.col(f"__{n}").isNotNull(), F.struct(*order))
    last = [F.max_by(f"__{n}", place(n)).alias(f"__{n}") for n in before]
    first = [F.min_by(f"__{n}", place(n)).alias(f"__{n}") for n in after]
    totals = marked.groupBy(key, "__bucket").agg(*last, *first, *(F.sum(f"__{n}").alias(f"__{n}") for n in sums))
    over = lambda *by: Window.partitionBy(key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    up, down = over(F.asc("__bucket")), over(F.desc("__bucket"))
    known = lambda n, w: F.last(f"__{n}", ignorenulls=True).over(w).alias(f"__{n}")
    incoming = totals.select(key, "__bucket", *(known(n, up) for n in before), *(known(n, down) for n in after), *(F.sum(f"__{n}").over(up).alias(f"__{n}") for n in sums))
    # What comes in stands in front of the rows, and behind them what comes from behind.
    fronts = [f for f, names in ((-1, [*before, *sums]), (1, after)) if names]
    told_at = lambda n: F.when(F.col("__front") == (1 if n in after else -1), F.col(f"__{n}")).alias(f"__{n}")
    named = [*before, *after, *sums]
    incoming = incoming.withColumn("__front", F.explode(F.array(*map(F.lit, fronts)))).select(key, "__bucket", "__front", *map(told_at, named))
    incoming = incoming.filter(reduce(or_, (F.col(f"__{n}").isNotNull() for n in named)))
    both = marked.withColumn("__front", F.lit(0)).unionByName(incoming, allowMissingColumns=True)
    found = _found(before, after, sums, [key, "__bucket"], ["__front", *order])
    return both.withColumns(found).filter("__front = 0").select(*rows.columns, *found)


def _found(before: Mapping[str, Column], after: Mapping[str, Column], sums: Mapping[str, Column], group: list[str], order: list[str]) -> dict[str, Column]:
    """What each name finds within its group. One order serves both directions: the nearest value that is not null is an
    offset that passes over nulls."""
    named = lambda columns: ", ".join(f"`{c}`" for c in columns)
    inside = f"over (partition by {named(group)} order by {named(order)})"
    found = {n: F.expr(f"lag(`__{n}`) ignore nulls {inside}") for n in before}
    found |= {n: F.expr(f"lead(`__{n}`) ignore nulls {inside}") for n in after}
    running = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return found | {n: F.sum(f"__{n}").over(running) for n in sums}


def told(rows: DataFrame, by: list[str], table: DataFrame) -> DataFrame:
    """``rows`` with the other columns of ``table`` (one row a key) where the columns ``by`` agree, nulls with nulls."""
    named = table.withColumnsRenamed({c: f"__by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.join(named, same, "left").drop(*(f"__by_{c}" for c in by))


def by_group(rows: DataFrame, group: list[str], place: str, values: Mapping[str, tuple[str, Column]], span: int | None = SPAN) -> DataFrame:
    """``rows`` with aggregates over their group: for each name ``min``, ``max`` or ``sum`` and a column. What a whole
    group must know is made from one row a bucket of it, and told to each bucket by itself (``span`` None: groups stay
    whole)."""
    again = {"min": F.min, "max": F.max, "sum": F.sum}
    if span is None:
        return rows.withColumns({n: again[how](c).over(Window.partitionBy(*group)) for n, (how, c) in values.items()})
    marked = rows.withColumn("__bucket", bucket(place, span))
    parts = marked.groupBy(*group, "__bucket").agg(*(again[how](c).alias(n) for n, (how, c) in values.items()))
    whole = parts.groupBy(*group).agg(*(again[how](n).alias(n) for n, (how, _) in values.items()))
    return told(marked, [*group, "__bucket"], told(parts.select(*group, "__bucket"), group, whole)).drop("__bucket")
