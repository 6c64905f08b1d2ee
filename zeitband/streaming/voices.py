"""Voice banks in the state store: one entry a voice, so a contact reads its session's bank and writes one voice."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from zeitband.operators.voices import CONTACTS, Limits, Voice, meet, seen

from .state import needs_rocksdb

VOICE = "mean array<double>, n long, pending boolean"


class BankProcessor(StatefulProcessor):
    """The bank of a session as a map from speaker to voice. Voices that no contact changes for ``keep_ms`` go."""

    def __init__(self, limits: Limits, keep_ms: int | None):
        self.limits, self.keep_ms = limits, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.voices = handle.getMapState("voices", "speaker int", VOICE, self.keep_ms)

    def _bank(self) -> dict[int, Voice]:
        return {k[0]: Voice(np.array(v[0], np.float64), v[1], v[2]) for k, v in self.voices.iterator()}

    def _put(self, speaker: int, v: Voice) -> None:
        self.voices.updateValue((speaker,), (v.mean.tolist(), v.n, v.pending))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self._put(initialState["speaker"], Voice(np.array(initialState["mean"], np.float64), initialState["n"], initialState["pending"]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        bank, changed = self._bank(), set()
        for r in sorted(rows, key=lambda r: (r["seq"], r["speaker"])):
            matched, sure, whose = meet(bank, r["speaker"], r["embedding"], r["ms"], self.limits)
            changed |= {whose} - {None}
            n_known, n_pending = seen(bank)
            yield Row(session=key[0], seq=r["seq"], matched=matched, confirmed=sure, n_confirmed=n_known, n_pending=n_pending)
        for speaker in sorted(changed):
            self._put(speaker, bank[speaker])

    def close(self) -> None:
        pass


def stream_contacts(contacts: DataFrame, limits: Limits | None = None, bank: DataFrame | None = None, keep_ms: int | None = None) -> DataFrame:
    """What ``operators.voices.identify_and_enroll`` gives, of a stream whose batches come in order of seq.

    ``bank`` (session, speaker, mean, n, pending) is a stored bank that sessions begin with. A batch's contacts of one
    session are sorted in memory, so the batch's size bounds them (``maxFilesPerTrigger`` and the like). With ``keep_ms``
    the query goes by processing time, and a trigger to the end of the sources never ends it: stop it by hand.
    """
    needs_rocksdb(contacts.sparkSession)
    grouped = contacts.select("session", "seq", "speaker", "ms", "embedding").groupBy("session")
    first = bank.select("session", "speaker", "mean", "n", "pending").groupBy("session") if bank is not None else None
    return grouped.transformWithState(BankProcessor(limits or Limits(), keep_ms), CONTACTS, "Append", "None" if keep_ms is None else "ProcessingTime", first)
