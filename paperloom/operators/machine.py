"""The state of a document out of its log: which rows are legal steps, and where each leaves the document.

A document has reached a stage (its results are in force) and may have one open. Steps:

- started: legal for a stage up to the one after what is reached. An earlier stage is a restart, which takes back
  what came after it. A stage that is started while one is open abandons that one.
- completed, failed: legal for the open stage only; upload, which has no start, is legal before anything else.
  After a failure the same stage, or an earlier one, may be started again.
- skipped: legal for the stage after what is reached, with none open.

What isn't legal, an unknown stage or status included, changes nothing and is told. A row equal to another (stage, status
and time) is a repetition, which is told too. Rows count in the order of their time; at equal times by stage, and
a start before an end. After the last stage a document is at its end, which a restart leaves.

In a batch, rows are dealt by document, sorted within partitions and folded as they come: a task holds one state and
one Arrow batch, however many rows a document has. The streaming form (streaming.machine) folds with the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import STAGES

OPTIONAL = ("vision_fallback",)
ENDS = ("completed", "failed")
VERDICTS = ["step", "restart", "repeated", "illegal"]
STEPS = "document_id string, stage string, status string, created_at timestamp, verdict string, reached string, open_stage string, state string, attempts int"
_PLACE = {s: i for i, s in enumerate(STAGES)}
_NONE = -1


class State(NamedTuple):
    """The last stage whose results are in force, the open one, whether the last end was a failure, how many starts there were, and the last row."""

    reached: int = _NONE
    open: int = _NONE
    failed: bool = False
    attempts: int = 0
    last: tuple = ()


def next_of(reached: int) -> int:
    """The furthest stage that may follow: optional ones may be left out."""
    at = reached + 1
    while at < len(STAGES) and STAGES[at] in OPTIONAL:
        at += 1
    return at


def name_of(s: State) -> str:
    if s.open != _NONE:
        return "running"
    if s.failed:
        return "failed"
    return "new" if s.reached == _NONE else "ended" if s.reached == len(STAGES) - 1 else "waiting"


def step(s: State, stage: str, status: str, at) -> tuple[State, str]:
    """The state after a row, and what the row was."""
    row, k = (stage, status, at), _PLACE.get(stage, len(STAGES))
    if row == s.last:
        return s, "repeated"
    s = s._replace(last=row)
    if status == "started" and k <= next_of(s.reached) and k < len(STAGES):
        back = k <= s.reached
        return s._replace(reached=min(s.reached, k - 1), open=k, failed=False, attempts=s.attempts + 1), "restart" if back else "step"
    if status in ENDS and k < len(STAGES) and (k == s.open or k == 0 and s.reached == s.open == _NONE):
        done = status == "completed"
        return s._replace(reached=k if done else s.reached, open=_NONE, failed=not done), "step"
    if status == "skipped" and s.open == _NONE and s.reached < k <= next_of(s.reached) and k < len(STAGES):
        return s._replace(reached=k, failed=False), "step"
    return s, "illegal"


def told(document_id: str, s: State, verdict: str) -> tuple:
    stage, status, at = s.last
    of = lambda k: STAGES[k] if k != _NONE else None
    return (document_id, stage, status, at, verdict, of(s.reached), of(s.open), name_of(s), s.attempts)


def order(stage: Column, status: Column, at: Column) -> list[Column]:
    """The order of a document's rows."""
    return [at, F.array_position(F.array(*map(F.lit, STAGES)), stage), stage, status.isin(*ENDS), status]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own, s = object(), State()
    for b in batches:
        out = []
        for document_id, stage, status, at in zip(b["document_id"], b["stage"], b["status"], b["created_at"], strict=True):
            if document_id != own:
                own, s = document_id, State()
            s, verdict = step(s, stage, status, at)
            out.append(told(document_id, s, verdict))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in STEPS.split(", ")])


def steps(logs: DataFrame) -> DataFrame:
    """Every log row with what it was and the state of its document after it. Rows without a document, stage, status or time are left out."""
    rows = logs.select("document_id", "stage", "status", "created_at").dropna()
    rows = rows.repartition("document_id").sortWithinPartitions("document_id", *order(F.col("stage"), F.col("status"), F.col("created_at")))
    return rows.mapInPandas(_fold, STEPS)


def states(logs: DataFrame) -> DataFrame:
    """One row a document: where it is, how often a stage was started, and how many rows were steps, restarts, repetitions and illegal."""
    found = steps(logs).withColumn("_i", F.monotonically_increasing_id())  # rows of a document are in order, in one partition
    last = F.max_by(F.struct("reached", "open_stage", "state", "attempts", "created_at"), "_i").alias("l")
    counts = (F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS)
    return found.groupBy("document_id").agg(last, *counts).select("document_id", "l.*", *(f"n_{v}" for v in VERDICTS))
