"""Summaries and actions: masked context, rules to actions, de-duplication, cap, and what users had before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import action_key
from ..functions.text import blank, strip
from ..schemas import ACTION_PRIORITIES, ACTION_STATUSES
from ..settings import DEFAULT, Settings
from .classify import texts

# Parts of names whose values must not be shown.
SENSITIVE = ["account_number", "bank_account", "ifsc", "routing_number", "tax_id", "ssn", "pan_number", "aadhaar", "passport", "identity_doc"]
MASK = "[PRESENT - SENSITIVE VALUE PROTECTED]"
TYPES = ["invoice", "onboarding_form"]


def sensitive(name: Column, s: Settings = DEFAULT) -> Column:
    parts = SENSITIVE if s.legacy else [*SENSITIVE, "id_doc_\\d+_document_number"]
    return F.lower(name).rlike("|".join(parts))


def display(s: Settings = DEFAULT, masked: bool = True) -> Column:
    """The normal form, or else the value; a mark where it is sensitive; null where there is none."""
    shown = F.coalesce("normalized_value", "field_value")
    shown = F.when(~blank(shown), shown)
    return F.when(shown.isNotNull() & sensitive(F.col("field_name"), s), MASK).otherwise(shown) if masked else shown


def context(fields: DataFrame, issues: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """document_id, context (JSON): fields as shown, issues, names in conflict."""
    item = lambda *c: F.struct("field_ord", F.struct(*c).alias("v"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    shown = fields.groupBy("document_id").agg(
        ordered(item("field_name", display(s).alias("value"), F.col("validation_status").alias("status"))).alias("fields"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("validation_status") == "conflict", F.struct("field_ord", "field_name")))), lambda x: x["field_name"]).alias("conflicts_detected"),
    )
    said = issues.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("issue_ord", F.struct("field_name", "status", "message").alias("v")))), lambda x: x["v"]).alias("issues"))
    return shown.join(said, "document_id", "left").select("document_id", F.to_json(F.struct("fields", "issues", "conflicts_detected")).alias("context"))


def summaries(documents: DataFrame, fields: DataFrame, responses: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row a document (document_id, document_type): the model's summary with capped lists, or why there is none."""
    counts = fields.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("validation_status") == "needs_review").alias("needs_review_fields"), F.count_if(F.col("validation_status") == "conflict").alias("conflict_fields"))
    a = F.from_json("response_json", "struct<summary:string,key_points:string,review_items:string>")
    told = responses.where("stage = 'summary' AND error IS NULL").select("document_id", strip(a["summary"]).alias("_s"), texts(a["key_points"]).alias("_k"), texts(a["review_items"]).alias("_i"))
    rows = documents.select("document_id", "document_type").join(counts, "document_id", "left").join(told, "document_id", "left")
    none = F.array().cast("array<string>")
    unknown, empty = ~F.col("document_type").isin(TYPES), F.coalesce("_n", F.lit(0)) == 0
    status = F.when(unknown | empty, "skipped").when(F.col("_s").isNull(), "failed").otherwise("completed")
    text = F.when(unknown, "No summary: the document's type is unknown.").when(empty, "No summary: the document has no fields.").otherwise(F.col("_s"))
    review = F.when(empty & ~unknown, F.array(F.lit("Extract fields before summarizing."))).when(unknown, none).otherwise(F.slice(F.coalesce("_i", none), 1, s.max_review_items))
    return rows.select("document_id", status.alias("status"), text.alias("summary"), F.when(unknown | empty, none).otherwise(F.slice(F.coalesce("_k", none), 1, s.max_key_points)).alias("key_points"), review.alias("review_items"), F.coalesce("_n", F.lit(0)).alias("total_fields"), F.coalesce("needs_review_fields", F.lit(0)).alias("needs_review_fields"), F.coalesce("conflict_fields", F.lit(0)).alias("conflict_fields"))


def payment(total: Column, due: Column, currency: Column, vendor: Column, s: Settings = DEFAULT) -> Column:
    """The action of paying an invoice, a struct, or null without a positive total; total is a decimal, due a date."""
    as_of = F.lit(s.as_of)
    days = F.datediff(due, as_of)
    iso = F.date_format(due, "yyyy-MM-dd")
    high = F.coalesce(days <= s.due_soon_days, F.lit(False))
    reason = (
        F.when(days < 0, F.concat(F.lit("Payment is overdue since "), iso, F.lit("."))).when(high, F.concat(F.lit("Payment due date ("), iso, F.lit(f") is approaching within {s.due_soon_days} days.")))
        .when(due.isNotNull(), F.concat(F.lit("Invoice payable by due date "), iso, F.lit("."))).otherwise("Payment required for billed invoice.")
    )
    action = F.concat(F.lit("Pay invoice totaling "), F.coalesce(currency, F.lit("USD")), F.lit(" "), F.format_number(total, 2), F.when(blank(vendor), "").otherwise(F.concat(F.lit(" to "), vendor)))
    return F.when(total > 0, F.struct(action.alias("action"), F.when(high, "high").otherwise("medium").alias("priority"), due.alias("due_date"), F.lit("rule_based").alias("source"), reason.alias("reason")))


def issue_action(field: Column, status: Column, message: Column, code: Column) -> Column:
    """The action that an issue asks for, a struct, or null; the first rule that fits."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *p: F.greatest(*(low.contains(x) for x in p), F.lit(False))
    is_ = lambda x: F.coalesce(code == x, F.lit(False))
    on = lambda before: F.concat(F.lit(before + " '"), field, F.lit("'"))
    made = lambda a, p, src, why: F.struct(a.alias("action"), F.lit(p).alias("priority"), F.lit(None).cast("date").alias("due_date"), F.lit(src).alias("source"), why.alias("reason"))
    return (
        F.when(status == "conflict", made(on("Review conflicting values for"), "high", "rule_based", F.concat(F.lit("Validation conflict: "), message)))
        .when(has("discrepancy", "does not match", "!=", "mismatch") | is_("ARITHMETIC_MISMATCH"), made(on("Resolve calculation discrepancy on"), "high", "rule_based", message))
        .when(has("earlier than invoice date"), made(F.lit("Clarify invalid invoice due date with vendor"), "high", "rule_based", message))
        .when(has("missing") | is_("REQUIRED_FIELD_MISSING"), made(on("Obtain missing required information for"), "high", "rule_based", message))
        .when(has("invalid", "must contain"), made(on("Verify and correct invalid format for"), "medium", "deterministic", message))
    )


def deterministic(fields: DataFrame, issues: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Actions by rule with their order: payment, issues, provisioning."""
    name = F.lower("field_name")
    value = F.struct("normalized_value", "field_value")
    last = lambda n: F.max_by(F.when(name == n, value), F.when(name == n, F.col("field_ord")))
    first = lambda *names: F.coalesce(*(last(n) for n in names))
    facts = fields.groupBy("document_id").agg(
        F.first("document_type").alias("type"), first("total_amount", "total", "invoice_total").alias("total"), first("due_date", "payment_due_date").alias("due"), first("currency", "currency_symbol").alias("cur"),
        first("vendor_name", "vendor", "supplier_name").alias("ven"), last("joining_date").alias("join"), last("full_name").alias("who"),
    )
    shown = lambda c: F.coalesce(F.col(f"{c}.normalized_value"), F.col(f"{c}.field_value"))
    pay = facts.where("type = 'invoice'").select("document_id", F.lit(0).alias("ord"), payment(F.col("total.normalized_value").try_cast("decimal(18,2)"), F.col("due.normalized_value").try_cast("date"), shown("cur"), shown("ven"), s).alias("a"))
    told = issues.select("document_id", F.col("issue_ord").alias("ord"), issue_action(F.col("field_name"), F.col("status"), F.col("message"), F.col("code")).alias("a"))
    day = F.col("join.normalized_value")
    start = F.struct(
        F.concat(F.lit("Prepare onboarding provisioning for "), F.coalesce(shown("who"), F.lit("new employee"))).alias("action"), F.lit("medium").alias("priority"), day.try_cast("date").alias("due_date"),
        F.lit("deterministic").alias("source"), F.concat(F.lit("Candidate joining date is scheduled for "), day, F.lit(".")).alias("reason"),
    )
    begin = facts.where("type = 'onboarding_form'").select("document_id", F.lit(1_000_000).alias("ord"), F.when(day.isNotNull(), start).alias("a"))
    return pay.unionByName(told).unionByName(begin).where("a IS NOT NULL").select("document_id", "ord", "a.*")


def suggested(responses: DataFrame) -> DataFrame:
    """Actions of stage action_extraction that a model suggests, cleaned; errors suggest nothing."""
    a = F.from_json("response_json", "struct<actions:array<struct<action:string,priority:string,due_date:string,reason:string>>>")["actions"]
    rows = responses.where("stage = 'action_extraction' AND error IS NULL").select("document_id", F.posexplode(a).alias("i", "x")).where(~blank(F.col("x.action")))
    due, priority = strip(F.col("x.due_date")), F.lower(strip(F.col("x.priority")))
    reason = strip(F.col("x.reason"))
    return rows.select("document_id", (F.lit(2_000_000) + F.col("i")).alias("ord"), strip(F.col("x.action")).alias("action"), F.when(priority.isin(ACTION_PRIORITIES), priority).otherwise("medium").alias("priority"), F.when(~F.lower(due).isin("null", "none", "n/a"), due.try_cast("date")).alias("due_date"), F.lit("ai").alias("source"), F.when(reason != "", reason).alias("reason"))


def first_of_key(actions: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Of actions with one key the first, and of those the first few of each document."""
    key = action_key(F.col("action"))
    w = Window.partitionBy("document_id", "_key").orderBy("ord")
    one = actions.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    top = one.withColumn("action_ord", F.row_number().over(Window.partitionBy("document_id").orderBy("ord"))).where(F.col("action_ord") <= s.max_actions)
    return top.withColumn("action_id", F.sha2(F.concat_ws("|", "document_id", "_key"), 256)).drop("_r", "_key", "ord")


def reconcile(new: DataFrame, old: DataFrame) -> DataFrame:
    """New actions with the id, creation and status that users gave the old ones of their key; then old ones that must stay: the users' own, and those begun or done."""
    n = new.withColumn("_key", action_key(F.col("action")))
    o = old.withColumn("_key", action_key(F.col("action")))
    latest = o.groupBy("document_id", "_key").agg(F.max_by(F.struct("action_id", "created_at", "status"), "action_ord").alias("_o"))
    kept = F.when(F.col("_o.status").isin([x for x in ACTION_STATUSES if x != "pending"]), F.col("_o.status")).otherwise("pending")
    out = n.join(latest, ["document_id", "_key"], "left").select(
        "document_id", "action_ord", F.coalesce("_o.action_id", "action_id").alias("action_id"), "action", "priority", "due_date", kept.alias("status"), "source", "reason", F.col("_o.created_at").alias("created_at")
    )
    rest = o.join(n.select("document_id", "_key").distinct(), ["document_id", "_key"], "left_anti").where("source = 'user' OR status IN ('completed', 'in_progress')")
    return out.unionByName(rest.select("document_id", (F.lit(1_000) + F.col("action_ord")).alias("action_ord"), "action_id", "action", "priority", "due_date", "status", "source", "reason", "created_at"))


def actions(fields: DataFrame, issues: DataFrame, responses: DataFrame, old: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
    """All actions of documents of a known type."""
    known = F.col("document_type").isin(TYPES)
    types = fields.groupBy("document_id").agg(F.first("document_type").alias("document_type")).where(known).select("document_id")
    every = deterministic(fields, issues, s).unionByName(suggested(responses)).join(types, "document_id", "left_semi")
    new = first_of_key(every, s)
    return reconcile(new, old) if old is not None else new.withColumn("status", F.lit("pending")).withColumn("created_at", F.lit(None).cast("timestamp"))


def counters(actions_: DataFrame) -> DataFrame:
    return actions_.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_actions"), F.count_if(F.col("priority") == "high").alias("high_priority"), F.count_if(F.col("source").isin("rule_based", "deterministic")).alias("deterministic_count"), F.count_if(F.col("source") == "ai").alias("ai_count"),
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "pending").alias("pending"),
    )


def action_prompts(fields: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """document_id, prompt: the first fields with a value, masked."""
    w = Window.partitionBy("document_id").orderBy("field_ord")
    rows = fields.where(~blank(F.col("field_value"))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= s.context_fields)
    line = F.concat_ws(": ", "field_name", display(s, masked=not s.legacy))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy("document_id").agg(listed.alias("t")).select("document_id", F.concat(F.lit("Suggest further actions for these fields:\n"), "t").alias("prompt"))


def set_status(actions_: DataFrame, action_id: str, status: str) -> DataFrame:
    """The actions with one status changed; the status must be of the domain."""
    if status not in ACTION_STATUSES:
        raise ValueError(f"no such status: {status}")
    return actions_.withColumn("status", F.when(F.col("action_id") == action_id, status).otherwise(F.col("status")))
