"""Recognised texts that repeat or continue the text before them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .folds import fold_sorted


def continued(a: list[str], b: list[str]) -> list[str] | None:
    """The words that ``a`` becomes when ``b`` follows and repeats some of it; None if ``b`` is a text of its own.

    ``b`` goes on from two last words of ``a`` at least, or restates its first three at least (the longer text stays),
    or one text holds the other. Case is ignored.
    """
    x, y = [w.lower() for w in a], [w.lower() for w in b]
    shared = next((k for k in range(min(len(x), len(y)), 1, -1) if x[-k:] == y[:k]), 0)
    if shared:
        return b if shared == len(a) < len(b) else a + b[shared:]
    longer = a if len(a) >= len(b) else b
    if len(x) >= 3 and x[:3] == y[:3]:
        return longer
    s, t = " ".join(x), " ".join(y)
    return longer if s in t or t in s else None


def fold(rows: Iterable[dict], reach_ms: int, micro_ms: int, pause_ms: int) -> Iterator[tuple]:
    """The segments that are left of a timeline's rows in order, each as soon as nothing more can join it."""
    last: dict | None = None
    for r in rows:
        words, made = (r["text"] or "").split(), None
        if last and 1 <= r["start_ms"] - last["start_ms"] < reach_ms:
            own = (last["text"] or "").split()
            micro = r["end_ms"] - r["start_ms"] < micro_ms and len(words) < 2 and r["start_ms"] - last["end_ms"] < pause_ms
            made = own + words if micro else continued(own, words)
        if made is not None:
            last |= {"text": " ".join(made), "end_ms": max(last["end_ms"], r["end_ms"]), "n_merged": last["n_merged"] + 1}
            continue
        if last:
            yield tuple(last.values())
        last = r | {"n_merged": 1}
    if last:
        yield tuple(last.values())


def dedupe_texts(rows: DataFrame, reach_ms: int = 60_000, micro_ms: int = 500, pause_ms: int = 1500) -> DataFrame:
    """Segments (tid, seq, start_ms, end_ms, text) with each one that repeats, continues or hangs on the one before it,
    within ``reach_ms`` of its start, folded into it.

    Texts that nothing is folded into stay as they are, null ones too. Rows of equal seq come in the order of their
    start, end and text; rows without a seq, start or end are left out, as they have no place in time.
    """
    names = ["tid", "seq", "start_ms", "end_ms", "text"]
    placed = rows.select(*names).na.drop(subset=["seq", "start_ms", "end_ms"])
    schema = StructType([*placed.schema, StructField("n_merged", LongType())])
    return fold_sorted(placed, "tid", names[1:], lambda own: fold(own, reach_ms, micro_ms, pause_ms), schema)
