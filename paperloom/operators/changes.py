"""Actions as a fold over the log of their changes: generations by the chain, and edits by users.

A generation (kind 'generated') is one time of a document at which its actions were made: a row for each action,
or one row without an action if none was. An edit (kind 'edit') sets the status of the action with its key. Rows fold in the
order of their time; at equal times generations come first, then by key and status. So the result
doesn't depend on the order in which rows arrive or are stored, and equal rows count once.

- An action that is generated is there from then on; one that is there already takes the new text, priority, date and
  reason, and keeps its id, its creation and, of KEPT, its status.
- An action that a later generation lacks goes, unless a user made it or it is begun or done.
- An edit of an action that isn't there, or to a status outside of the domain, changes nothing: it is an error row.

Rows are dealt by document, sorted within partitions and folded as they come: a task holds one document's present
actions and one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import action_key
from ..schemas import ACTION_STATUSES

CHANGES = "document_id string, at timestamp, kind string, action_ord int, action string, priority string, due_date date, status string, source string, reason string"
FOLDED = "document_id string, action_ord int, action_id string, action string, priority string, due_date date, status string, source string, reason string, created_at timestamp, updated_at timestamp, error string"
#: Statuses that a user sets and a generation leaves; those with which an action outlives a generation without it.
KEPT, STAYING = [x for x in ACTION_STATUSES if x != "pending"], ["completed", "in_progress"]
_COLUMNS = [c.split(" ")[0] for c in FOLDED.split(", ")]


def edits(rows: DataFrame) -> DataFrame:
    """Rows of CHANGES out of document_id, action, status and at."""
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select("document_id", "at", F.lit("edit").alias("kind"), none("int").alias("action_ord"), "action", none("string").alias("priority"), none("date").alias("due_date"), F.lower(F.trim("status")).alias("status"), none("string").alias("source"), none("string").alias("reason"))


def generated(actions: DataFrame, at) -> DataFrame:
    """Rows of CHANGES out of the actions that a run of the chain has made at a time (a column)."""
    return actions.select("document_id", at.cast("timestamp").alias("at"), F.lit("generated").alias("kind"), "action_ord", "action", "priority", "due_date", F.lit(None).cast("string").alias("status"), "source", "reason")


def _settled(document_id: str, there: dict) -> Iterator[tuple]:
    for a in there.values():
        yield (document_id, a["action_ord"], a["action_id"], a["action"], a["priority"], a["due_date"], a["status"], a["source"], a["reason"], a["created_at"], a["updated_at"], None)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own, there, made, time, last = None, {}, set(), None, None
    out: list[tuple] = []

    def closed() -> None:
        """The end of a generation: what it lacks goes."""
        for key in [k for k, a in there.items() if k not in made and a["source"] != "user" and a["status"] not in STAYING]:
            del there[key]

    generating = False
    for b in batches:
        for r in b.itertuples(index=False):
            this = (r.document_id, r.at, r.kind, r.key, r.status, r.action)
            if generating and (r.document_id != own or r.kind != "generated" or r.at != time):
                closed()
                generating = False
            if r.document_id != own:
                out += _settled(own, there)
                own, there, last = r.document_id, {}, None
            if this == last:
                continue
            last = this
            if r.kind == "generated":
                if not generating:
                    generating, made, time = True, set(), r.at
                if not r.key:
                    continue
                made.add(r.key)
                old = there.get(r.key)
                status = old["status"] if old and old["status"] in KEPT else "pending"
                there[r.key] = {"action_ord": r.action_ord, "action_id": r.action_id, "action": r.action, "priority": r.priority, "due_date": r.due_date, "status": status, "source": r.source, "reason": r.reason, "created_at": old["created_at"] if old else r.at, "updated_at": r.at}
            else:
                error = "no such action" if r.key not in there else None if r.status in ACTION_STATUSES else "no such status"
                if error:
                    out.append((own, None, None, r.action, None, None, r.status, None, None, r.at, None, error))
                else:
                    there[r.key] |= {"status": r.status, "updated_at": r.at}
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)
            out = []
    if generating:
        closed()
    out += _settled(own, there)
    if out:
        yield pd.DataFrame(out, columns=_COLUMNS)


def fold(log: DataFrame) -> DataFrame:
    """FOLDED: the actions that are there after all rows of the log (error is null), and a row for each edit without effect."""
    key = F.coalesce(action_key(F.col("action")), F.lit(""))
    rows = log.where("document_id IS NOT NULL AND at IS NOT NULL AND kind IN ('generated', 'edit')").withColumn("key", key)
    ord_ = F.coalesce("action_ord", F.lit(0)).alias("action_ord")
    rows = rows.select("document_id", "at", "kind", "key", "status", "action", ord_, F.sha2(F.concat_ws("|", "document_id", "key"), 256).alias("action_id"), "priority", "due_date", "source", "reason")
    # of a generation's actions with one key the first is the last to fold, and so stays
    order = ["document_id", F.col("at"), F.col("kind").desc(), "key", F.desc("action_ord"), "status", "action", "priority", "due_date", "source", "reason"]
    return rows.repartition("document_id").sortWithinPartitions(*order).mapInPandas(_fold, FOLDED)


def actions(folded: DataFrame) -> DataFrame:
    return folded.where("error IS NULL").drop("error")


def errors(folded: DataFrame) -> DataFrame:
    """document_id, action, status, at, error of the edits without effect."""
    return folded.where("error IS NOT NULL").select("document_id", "action", "status", F.col("created_at").alias("at"), "error")
