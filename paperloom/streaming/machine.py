"""The state machine of documents over a log stream: arbitrary state with timers in event time.

Rows come in any order. A document keeps what it has not yet folded, at most the rows of one watermark delay, and its
machine's state, five small values. A timer fires when the watermark passes the first row that waits; rows up to the watermark are
then final and are folded in order. So a stream gives the rows of the batch form, whatever the order of arrival,
as long as no row is later than the watermark allows; rows later than that are dropped by Spark before they get here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import machine
from ..schemas import STAGES

_ROW = "stage string, status string, micros long"


def _in_order(row: tuple) -> tuple:
    stage, status, at = row
    return (at, STAGES.index(stage) + 1 if stage in STAGES else 0, stage, status in machine.ENDS, status)


class Machine(StatefulProcessor):
    """Waiting rows as a list, the machine as one value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.state = handle.getValueState("state", f"reached int, open int, failed boolean, attempts int, {_ROW}")

    def _fold(self, document_id: str, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        rows.sort(key=_in_order)
        final = [r for r in rows if r[2] <= watermark * 1000]
        rest = rows[len(final) :]
        if final:
            s = machine.State()
            if self.state.exists():
                reached, open_, failed, attempts, *last = self.state.get()
                s = machine.State(reached, open_, failed, attempts, tuple(last))
            out = []
            for stage, status, micros in final:
                s, verdict = machine.step(s, stage, status, micros)
                out.append(machine.told(document_id, s, verdict))
            self.state.update((s.reached, s.open, s.failed, s.attempts, *s.last))
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in machine.STEPS.split(", ")])
            frame["created_at"] = pd.to_datetime(frame["created_at"], unit="us")
            yield frame
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][2] // 1000 + 1)
        else:
            self.waiting.clear()

    def _waiting(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(s, t, int(m)) for b in rows for s, t, m in zip(b["stage"], b["status"], b["micros"], strict=True)]
        yield from self._fold(key[0], self._waiting() + new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold(key[0], self._waiting(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def steps(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    """machine.steps over a stream of log rows. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    rows = logs.select("document_id", "stage", "status", "created_at").dropna().withWatermark("created_at", late)
    rows = rows.selectExpr("document_id", "stage", "status", "created_at", "unix_micros(created_at) AS micros")
    return rows.groupBy("document_id").transformWithStateInPandas(Machine(), machine.STEPS, "Append", "EventTime")
