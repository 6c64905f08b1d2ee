"""Banks of voices that learn from contacts, one a session.

A voice (speaker, mean, n, pending) is what a bank holds: pending after one contact, known after a second one that is
similar enough, or at once after a long one. A contact that is similar to a voice matches it; any other teaches the
bank the voice of the speaker that it was taken for. Similarity is the cosine; of equal ones a known voice goes before
a pending one, then the smaller number. Contacts with a null embedding or of too little time change nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .folds import fold_sorted

CONTACTS = "session long, seq long, matched int, confirmed boolean, n_confirmed long, n_pending long"


class Voice(NamedTuple):
    mean: np.ndarray
    n: int
    pending: bool


@dataclass(frozen=True)
class Limits:
    """A match with a known voice is above ``match``, one with a pending voice above ``confirm``; contacts count from
    ``least_ms`` on, and make a voice known at once from ``quick_ms`` on."""

    match: float = 0.62
    confirm: float = 0.35
    least_ms: int = 2000
    quick_ms: int = 4000


def cosines(x: np.ndarray, means: list[np.ndarray]) -> list[float]:
    """0 for vectors of another length and for null vectors."""
    norm = float(np.linalg.norm(x))
    fit = [len(m) == len(x) and len(x) > 0 for m in means]
    bottom = [norm * float(np.linalg.norm(m)) if f else 0.0 for m, f in zip(means, fit, strict=True)]
    return [float(x @ m) / b if b else 0.0 for m, b in zip(means, bottom, strict=True)]


def meet(bank: dict[int, Voice], speaker: int, embedding: list[float] | None, ms: int, limits: Limits) -> tuple[int | None, bool, int | None]:
    """Take a contact in: the voice that it matches, whether it made the speaker's voice known or found it so, and whose
    voice in ``bank`` changed, if any did."""
    if embedding is None or ms < limits.least_ms:
        return None, False, None
    x = np.asarray(embedding, np.float64)
    scored = zip(cosines(x, [v.mean for v in bank.values()]), bank, strict=True)
    alike, best = max(((s, not bank[k].pending, -k) for s, k in scored), default=(0.0, True, 0))[::2]
    if alike > 0 and alike > (limits.confirm if bank[-best].pending else limits.match):
        if not bank[-best].pending:
            return -best, False, None
        bank[-best] = Voice((bank[-best].mean + x) / 2, 2, False)
        return -best, False, -best
    own = bank.get(speaker)
    if own and not own.pending:
        bank[speaker] = Voice((own.mean * own.n + x) / (own.n + 1), own.n + 1, False)
    elif own and cosines(x, [own.mean])[0] >= limits.confirm:
        bank[speaker] = Voice((own.mean + x) / 2, 2, False)
    elif own or ms < limits.quick_ms:
        bank[speaker] = Voice(x, 1, True)
    else:
        bank[speaker] = Voice(x, 2, False)
    return None, not bank[speaker].pending, speaker


def seen(bank: dict[int, Voice]) -> tuple[int, int]:
    """How many voices are known, and how many pending."""
    waiting = sum(v.pending for v in bank.values())
    return len(bank) - waiting, waiting


def identify_and_enroll(contacts: DataFrame, limits: Limits | None = None) -> DataFrame:
    """session, seq, the voice that was matched, whether the contact confirmed one, and the sizes of the bank after it.
    ``contacts``: session, seq (their order), speaker, ms, embedding. Sessions are dealt to tasks and read as streams in
    order: a task holds one bank and a batch of contacts."""
    held = limits or Limits()

    def fold(own: Iterable[dict]) -> Iterator[tuple]:
        bank: dict[int, Voice] = {}
        for r in own:
            matched, sure, _ = meet(bank, r["speaker"], r["embedding"], r["ms"], held)
            yield (r["session"], r["seq"], matched, sure, *seen(bank))

    return fold_sorted(contacts.select("session", "seq", "speaker", "ms", "embedding"), "session", ["seq", "speaker"], fold, StructType.fromDDL(CONTACTS))
