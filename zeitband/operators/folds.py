"""Folds over the rows of each group in order, where every step depends on the ones before."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows made until a batch is handed on, about.
BATCH = 10_000


def fold_sorted(rows: DataFrame, key: str, order: list[str], fold: Callable[[Iterable[dict]], Iterable[tuple]], schema: StructType) -> DataFrame:
    """What ``fold`` makes of each group's rows, which it gets one by one in their order (nulls first).

    Groups are dealt to partitions by key and sorted there by Spark, so a group is read as a stream: no task holds more
    than a batch of rows and what the fold keeps. Many small groups share a task."""
    names, kinds = schema.fieldNames(), [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []

        def hand_on() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            made.clear()
            return batch

        flat = (r for b in batches for r in b.to_pylist())
        for _, own in groupby(flat, key=lambda r: r[key]):
            for row in fold(own):
                made.append(row)
                if len(made) >= BATCH:
                    yield hand_on()
        yield hand_on()

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
