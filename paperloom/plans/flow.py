"""Queries over what happens to documents in time: answers that fail their schema, the ledger of answers, the status machine, attempts, and stages that stall; each with the same in SQL.

An order stands for a section that was asked about, a conversation turn for a prompt, a user's events for a document's log.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import action_key
from ..operators import audit, changes, extract, machine, precedence
from ..schemas import STAGES
from ..session import own_folder
from ..sources.ledger import Ledgered
from ..sources.providers import Batched
from ..streaming import logs as stream
from .catalog import query, read
from .chain import answers, key, null, orders, pick

# Answers about sections

#: Section, answer, path and text of its first error; an order takes one by its number.
_ANSWERS = [
    ("vendor_information", '{"vendor_name": {"value": "x", "confidence": 1}, "odd": 1}', None, None), ("vendor_information", "no json", "$", "no JSON"),
    ("vendor_information", '{"vendor_name": {"value": 7}}', "$.vendor_name.value", "text expected"), ("vendor_information", '{"vendor_name": {"value": ["x"]}}', "$.vendor_name.value", "text expected"),
    ("vendor_information", '{"vendor_email": {"value": "x", "confidence": 1.7}}', "$.vendor_email.confidence", "not from 0 to 1"), ("vendor_information", '["x"]', "$", "object expected"),
    ("tax_information", '{"total": {"value": "12.50", "confidence": 0.5}}', None, None), ("tax_information", '{"total": {"value": "12 or so"}}', "$.total.value", "number expected"), ("vendor_information", "", "$", "empty answer"),
    ("line_items", '{"items": [{"quantity": 2}, {"quantity": "two"}]}', "$.items[1].quantity", "number expected"), ("line_items", '{"items": [{"quantity": 2, "line_total": "3.5"}]}', None, None), ("line_items", '{"items": "none"}', "$.items", "list expected"),
]
_N = len(_ANSWERS)


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(
    f"""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CAST(o_orderkey % {_N} AS INTEGER) + 1 AS k FROM orders),
a AS (SELECT document_id, {_sql_list([a[2] for a in _ANSWERS])}[k] AS error_path, {_sql_list([a[3] for a in _ANSWERS])}[k] AS message, {_sql_list([a[0] for a in _ANSWERS])}[k] AS section FROM o)
SELECT document_id, error_path, error_path || ': ' || message AS error, CASE WHEN message IS NULL THEN 2 ELSE 1 END::BIGINT AS sections_processed, CASE WHEN message IS NULL THEN '' ELSE section END AS failed_sections,
CASE WHEN message IS NULL THEN 5 ELSE 0 END + 1::BIGINT AS total_fields FROM a"""
)
def answer_checks(spark, d):
    """Answers of every kind of fault: each fails its section, and the notes beside it never."""
    rows, k = orders(spark, d), key() % _N
    part = lambda id_, i, name: F.struct(F.lit(id_).alias("section_id"), F.lit(i).alias("section_ord"), name.alias("section_name"), F.lit(1).alias("page_number"), F.lit("long enough").alias("text"))
    found = rows.withColumn("s", F.explode(F.array(part("a", 1, pick(k, *(a[0] for a in _ANSWERS))), part("b", 2, F.lit("notes"))))).select("document_id", F.lit("invoice").alias("document_type"), "s.*")
    told = answers(rows, "extraction", F.lit("a"), pick(k, *(a[1] for a in _ANSWERS))).unionByName(answers(rows, "extraction", F.lit("b"), F.lit('{"notes": {"value": "paid"}}')))
    checked = extract.checked(found, told)
    counted = extract.counters(found, checked, extract.fields(found, checked)).withColumn("failed_sections", F.array_join("failed_sections", ","))
    return checked.where("item_key = 'a'").select("document_id", "error_path", "error").join(counted, "document_id")


def _lengths(prompts: list[str]) -> list[str]:
    """Stands for a model: says how long a prompt is, and can't take one with a question, or a batch that holds one."""
    if any("?" in p for p in prompts):
        raise ValueError("a question")
    return [json.dumps({"length": len(p)}) for p in prompts]


@query(
    """SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS document_id, stage, CASE WHEN contains(coalesce(text, ''), '?') THEN NULL ELSE '{"length": ' || length(coalesce(text, '')) || '}' END AS response_json,
CASE WHEN contains(coalesce(text, ''), '?') THEN 'a question' END AS error FROM conversations, (SELECT unnest(['first', 'second']) AS stage)"""
)
def answer_ledger(spark, d):
    """Prompts asked through a ledger, twice: equal ones once, those at fault alone with an error, and the second time none at all."""
    rows = read(spark, d, "conversations", "conv_id", "turn", "text").select(F.concat_ws("-", "conv_id", "turn").alias("document_id"), F.coalesce("text", F.lit("")).alias("prompt"))
    path = f"{own_folder(spark)}/answers-{uuid.uuid4().hex}"
    first = Ledgered(Batched(_lengths), path).answer("summary", rows)
    again = Ledgered(Batched(_no_call), path, "batched").answer("summary", rows)
    return first.withColumn("stage", F.lit("first")).unionByName(again.withColumn("stage", F.lit("second"))).select("document_id", "stage", "response_json", "error")


def _no_call(prompts: list[str]) -> list[str]:
    raise AssertionError("asked again")


# The log


def logs(spark: SparkSession, d: str) -> DataFrame:
    """A document goes through the stages two rows each, failing and skipping at times; times are whole days, so they tie, and every tenth row comes twice."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = read(spark, d, "events", "event_id", "ts", "user_id", "event_type").withColumn("n", n)
    even = F.col("n") % 2 == 0
    status = F.when((F.col("event_type") == "error") & even, "failed").when((F.col("event_type") == "signup") & (F.col("n") % 7 == 0), "skipped").when(even, "completed").otherwise("started")
    stage = F.get(F.array(*map(F.lit, STAGES)), (F.floor((F.col("n") - 1) / 2) % len(STAGES)).cast("int"))
    twice = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(F.col("user_id").cast("string").alias("document_id"), stage.alias("stage"), status.alias("status"), F.date_trunc("day", "ts").alias("created_at"), F.explode(twice).alias("_c")).drop("_c")


_L = f"""SELECT document_id, stage, status, created_at FROM (SELECT CAST(user_id AS VARCHAR) AS document_id, {STAGES}[CAST((n - 1) // 2 % {len(STAGES)} AS INTEGER) + 1] AS stage,
CASE WHEN event_type = 'error' AND n % 2 = 0 THEN 'failed' WHEN event_type = 'signup' AND n % 7 = 0 THEN 'skipped' WHEN n % 2 = 0 THEN 'completed' ELSE 'started' END AS status, date_trunc('day', ts)::TIMESTAMP AS created_at,
unnest(CASE WHEN event_id % 10 = 0 THEN [1, 2] ELSE [1] END) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))"""

_V = STAGES.index("vision_fallback")
_MACHINE = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT *, lag((stage, status, created_at)) OVER w IS NOT DISTINCT FROM (stage, status, created_at) AS again, row_number() OVER w AS n FROM (SELECT *, list_position({STAGES}, stage) - 1 AS k FROM ({_L}))
WINDOW w AS (PARTITION BY document_id ORDER BY created_at, k, status IN ('completed', 'failed'), status)),
m AS (SELECT document_id, 0::BIGINT AS n, '' AS stage, '' AS status, NULL::TIMESTAMP AS created_at, '' AS verdict, -1 AS reached, -1 AS open, false AS failed, 0 AS attempts FROM (SELECT DISTINCT document_id FROM l)
UNION ALL SELECT document_id, n, stage, status, created_at, v,
CASE v WHEN 'repeated' THEN reached WHEN 'illegal' THEN reached ELSE CASE status WHEN 'started' THEN least(reached, k - 1) WHEN 'failed' THEN reached ELSE k END END,
CASE v WHEN 'repeated' THEN open WHEN 'illegal' THEN open ELSE CASE status WHEN 'started' THEN k ELSE -1 END END,
CASE v WHEN 'repeated' THEN failed WHEN 'illegal' THEN failed ELSE status = 'failed' END,
CASE WHEN v IN ('step', 'restart') AND status = 'started' THEN attempts + 1 ELSE attempts END
FROM (SELECT l.document_id, l.n, l.stage, l.status, l.created_at, l.k, m.reached, m.open, m.failed, m.attempts,
  CASE WHEN l.again THEN 'repeated'
  WHEN l.status = 'started' AND l.k <= m.reached + CASE WHEN m.reached + 1 = {_V} THEN 2 ELSE 1 END THEN CASE WHEN l.k <= m.reached THEN 'restart' ELSE 'step' END
  WHEN l.status IN ('completed', 'failed') AND (l.k = m.open OR (l.k = 0 AND m.reached = -1 AND m.open = -1)) THEN 'step'
  WHEN l.status = 'skipped' AND m.open = -1 AND l.k > m.reached AND l.k <= m.reached + CASE WHEN m.reached + 1 = {_V} THEN 2 ELSE 1 END THEN 'step' ELSE 'illegal' END AS v
  FROM m JOIN l ON l.document_id = m.document_id AND l.n = m.n + 1)),
s AS (SELECT document_id, n, stage, status, created_at, verdict, CASE WHEN reached >= 0 THEN {STAGES}[reached + 1] END AS reached, CASE WHEN open >= 0 THEN {STAGES}[open + 1] END AS open_stage,
CASE WHEN open >= 0 THEN 'running' WHEN failed THEN 'failed' WHEN reached = -1 THEN 'new' WHEN reached = {len(STAGES) - 1} THEN 'ended' ELSE 'waiting' END AS state, attempts FROM m WHERE n > 0)"""


@query(_MACHINE + " SELECT * EXCLUDE n FROM s")
def status_steps(spark, d):
    return machine.steps(logs(spark, d))


@query(
    _MACHINE
    + """ SELECT document_id, arg_max(reached, n) FILTER (n = of) AS reached, arg_max(open_stage, n) FILTER (n = of) AS open_stage, arg_max(state, n) AS state, arg_max(attempts, n) AS attempts, arg_max(created_at, n) AS created_at,
count_if(verdict = 'step')::BIGINT AS n_step, count_if(verdict = 'restart')::BIGINT AS n_restart, count_if(verdict = 'repeated')::BIGINT AS n_repeated, count_if(verdict = 'illegal')::BIGINT AS n_illegal
FROM (SELECT *, max(n) OVER (PARTITION BY document_id) AS of FROM s) GROUP BY document_id"""
)
def document_states(spark, d):
    return machine.states(logs(spark, d))


_ATTEMPTS = f"""WITH l AS (SELECT DISTINCT * FROM ({_L}) WHERE status <> 'skipped'),
a AS (SELECT *, count_if(status = 'started') OVER (PARTITION BY document_id, stage ORDER BY created_at, status <> 'started', status ROWS UNBOUNDED PRECEDING) AS attempt FROM l),
g AS (SELECT document_id, stage, CAST(attempt AS INTEGER) AS attempt, min(created_at) FILTER (status = 'started') AS started_at, min(created_at) FILTER (status <> 'started') AS ended_at,
  arg_min(status, (created_at, status)) FILTER (status <> 'started') AS e, CAST(greatest(count_if(status <> 'started') - 1, 0) AS BIGINT) AS repeats FROM a GROUP BY ALL),
t AS (SELECT document_id, stage, attempt, started_at, ended_at, CASE WHEN attempt = 0 THEN 'orphan' WHEN e IS NOT NULL THEN e WHEN attempt = max(attempt) OVER (PARTITION BY document_id, stage) THEN 'open' ELSE 'abandoned' END AS outcome, repeats,
  CAST(epoch(ended_at) - epoch(started_at) AS DOUBLE) AS seconds FROM g)"""


@query(_ATTEMPTS + " SELECT * FROM t")
def stage_attempts(spark, d):
    return audit.attempts(logs(spark, d))


@query(
    _ATTEMPTS
    + f""", f AS (SELECT document_id, stage, min(started_at) AS started_at, count_if(attempt > 0)::BIGINT AS attempts, count_if(outcome = 'failed')::BIGINT AS failures, sum(seconds) AS seconds FROM t GROUP BY ALL)
SELECT e.document_id, e.stage, f.started_at, e.ended_at, coalesce(f.attempts, 0) AS attempts, coalesce(f.failures, 0) AS failures, f.seconds FROM (SELECT document_id, stage, max(created_at) FILTER (status IN ('completed', 'failed')) AS ended_at FROM ({_L}) GROUP BY ALL) e LEFT JOIN f USING (document_id, stage)"""
)
def stage_duration(spark, d):
    return audit.stage_durations(logs(spark, d))


@query(_ATTEMPTS + " SELECT stage, " + ", ".join(f"count_if(outcome = '{o}')::BIGINT AS n_{o}" for o in ("completed", "failed", "open", "abandoned", "orphan")) + ", sum(seconds) AS seconds, max(seconds) AS longest FROM t GROUP BY stage")
def stage_totals(spark, d):
    return audit.stage_totals(logs(spark, d))


@query(
    f"""SELECT document_id, stage, created_at FROM ({_L}) s WHERE status = 'started'
AND NOT EXISTS (SELECT 1 FROM ({_L}) e WHERE e.document_id = s.document_id AND e.stage = s.stage AND e.status IN ('completed', 'failed') AND e.created_at >= s.created_at AND e.created_at <= s.created_at + INTERVAL 1 DAY)"""
)
def stalled_stages(spark, d):
    return stream.stalled(logs(spark, d), "1 DAY")


@query(
    f"""SELECT document_id, stage, created_at, status FROM ({_L}) e WHERE status IN ('completed', 'failed')
AND NOT EXISTS (SELECT 1 FROM ({_L}) s WHERE e.document_id = s.document_id AND e.stage = s.stage AND s.status = 'started' AND s.created_at <= e.created_at AND s.created_at >= e.created_at - INTERVAL 1 DAY)"""
)
def orphan_ends(spark, d):
    return stream.orphans(logs(spark, d), "1 DAY")


# What stages have left, and changes of actions

_BODY = ["""{"fields": [{"name": "a", "value": "1"}, {"name": "b"}]}""", "{\"fields\": [{\"name\"", """{"fields": []}""", None, """{"fields": {"name": "a"}}"""]
_STATES = ["ok", "corrupt", "empty", "missing", "corrupt"]


@query(
    f"""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id, {_STATES}[CAST(o_orderkey % 5 AS INTEGER) + 1] AS v, {_STATES}[CAST(o_orderkey // 5 % 5 AS INTEGER) + 1] AS e, o_orderkey % 3 = 0 AS t FROM orders),
s AS (SELECT *, CASE WHEN v IN ('ok', 'empty') THEN 'validation' WHEN e IN ('ok', 'empty') THEN 'extraction' WHEN t THEN 'table' ELSE 'none' END AS source FROM o)
SELECT document_id, source, v AS validation, e AS extraction, CASE WHEN t THEN 'ok' ELSE 'missing' END AS in_table,
CASE source WHEN 'validation' THEN CASE v WHEN 'ok' THEN 'a,b' ELSE '' END WHEN 'extraction' THEN CASE e WHEN 'ok' THEN 'a,b' ELSE '' END WHEN 'table' THEN 'x,y' ELSE '' END AS names FROM s"""
)
def artifact_precedence(spark, d):
    """Fields of each document from its validation, else its extraction, else the table; corrupt texts are passed over, empty ones aren't."""
    kind = "struct<name: string, value: string>"
    rows = orders(spark, d)
    texts = lambda n: rows.select("document_id", pick(n % 5, *_BODY[:3], null(), _BODY[4]).alias("body")).where("body IS NOT NULL")
    stored = rows.where(key() % 3 == 0).select("document_id", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), null().alias("value")) for i, n in enumerate("xy")))).alias("f"))
    stored = precedence.table(stored.select("document_id", "f.i", F.struct("f.name", "f.value").alias("r")), "i", "struct<i: int, r: struct<name: string, value: string>>")
    stored = stored.withColumn("items", F.transform("items", lambda x: x["r"]))
    levels = [("validation", precedence.level(texts(key()), "fields", kind)), ("extraction", precedence.level(texts(F.floor(key() / 5)), "fields", kind)), ("table", stored)]
    made = precedence.merge(rows, levels)
    return made.select("document_id", "source", *(F.col("states")[n].alias(c) for n, c in (("validation", "validation"), ("extraction", "extraction"), ("table", "in_table"))), F.array_join(F.transform("items", lambda x: x["name"]), ",").alias("names"))


_CHANGES = """c AS (SELECT CAST(user_id AS VARCHAR) AS document_id, date_trunc('hour', ts)::TIMESTAMP AS tm, CASE WHEN event_id % 3 = 0 THEN 'generated' ELSE 'edit' END AS kind, 'Check  item ' || event_id % 5 AS action, 'checkitem' || event_id % 5 AS key,
CASE WHEN event_id % 3 = 0 THEN NULL ELSE CASE event_type WHEN 'view' THEN 'completed' WHEN 'click' THEN 'in_progress' WHEN 'signup' THEN 'dismissed' WHEN 'error' THEN 'odd' ELSE 'pending' END END AS status, CASE WHEN event_id % 5 = 4 THEN 'user' ELSE 'ai' END AS source FROM events)"""


@query(
    f"""WITH RECURSIVE {_CHANGES}, g AS (SELECT DISTINCT document_id, tm FROM c WHERE kind = 'generated'), k AS (SELECT DISTINCT document_id, key, source FROM c),
e AS (SELECT DISTINCT document_id, tm, key, 1 AS o, status, source FROM c WHERE kind = 'edit'
  UNION ALL SELECT g.document_id, g.tm, k.key, 0, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.document_id = g.document_id AND c.tm = g.tm AND c.kind = 'generated' AND c.key = k.key) THEN 'made' ELSE 'lacking' END, k.source FROM g JOIN k USING (document_id)),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY document_id, key ORDER BY tm, o, status) AS n FROM e),
m AS (SELECT document_id, key, 0::BIGINT AS n, 'none' AS now, NULL::TIMESTAMP AS tm, NULL::VARCHAR AS told, NULL::VARCHAR AS error FROM k
UNION ALL SELECT l.document_id, l.key, l.n, CASE WHEN o = 1 THEN CASE WHEN now <> 'none' AND l.status <> 'odd' THEN l.status ELSE now END WHEN l.status = 'made' THEN CASE WHEN now IN ('completed', 'in_progress', 'dismissed') THEN now ELSE 'pending' END
  WHEN now = 'none' OR source = 'user' OR now IN ('completed', 'in_progress') THEN now ELSE 'none' END, l.tm, CASE WHEN o = 1 THEN l.status END, CASE WHEN o = 0 THEN NULL WHEN now = 'none' THEN 'no such action' WHEN l.status = 'odd' THEN 'no such status' END
  FROM m JOIN l ON l.document_id = m.document_id AND l.key = m.key AND l.n = m.n + 1)
SELECT document_id, key, told AS status, error, tm AS "at" FROM m WHERE error IS NOT NULL UNION ALL SELECT document_id, key, arg_max(now, n), NULL, NULL FROM m GROUP BY document_id, key HAVING arg_max(now, n) <> 'none'"""
)
def action_changes(spark, d):
    """Actions after a log of generations and edits, and the edits that had no effect."""
    e, n = F.col("event_id"), F.col("event_id") % 5
    made = e % 3 == 0
    status = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "click", "in_progress").when(F.col("event_type") == "signup", "dismissed").when(F.col("event_type") == "error", "odd").otherwise("pending")
    rows = read(spark, d, "events", "event_id", "ts", "user_id", "event_type").select(
        F.col("user_id").cast("string").alias("document_id"), F.date_trunc("hour", "ts").alias("at"), F.when(made, "generated").otherwise("edit").alias("kind"), F.when(made, n.cast("int")).alias("action_ord"), F.concat(F.lit("Check  item "), n.cast("string")).alias("action"),
        F.lit("low").alias("priority"), F.lit(None).cast("date").alias("due_date"), F.when(~made, status).alias("status"), F.when(made, F.when(n == 4, "user").otherwise("ai")).alias("source"), null().alias("reason"),
    )
    folded = changes.fold(rows)
    return folded.select("document_id", action_key(F.col("action")).alias("key"), "status", "error", F.when(F.col("error").isNotNull(), F.col("created_at")).alias("at"))
