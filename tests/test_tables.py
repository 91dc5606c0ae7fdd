"""The store by dynamic overwrite, precedence of artifacts, the log of changes of actions, and the chain by micro-batch."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.operators import changes, precedence
from paperloom.sources.store import Store
from paperloom.streaming.chain import Upserts

T0 = datetime.datetime(2024, 1, 1)
FIELD = "document_id string, field_ord int, field_name string, field_value string, source string, confidence double"


def fields(spark, rows):
    return spark.createDataFrame([(d, i, n, v, "model", 0.5) for d, i, n, v in rows], FIELD)


def held(store, table="fields"):
    return sorted((r.document_id, r.field_name, r.field_value) for r in store.read(table).collect())


def test_replace_reads_and_writes_touched_buckets_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 8)
    ids = [f"d{i}" for i in range(40)]
    store.save_fields(fields(spark, [(d, 1, "a", "old") for d in ids]))
    files = lambda: {f: f.stat().st_mtime_ns for f in tmp_path.glob("s/fields/bucket=*/*.parquet")}
    before, bucket = files(), spark.createDataFrame([("d3",)], "document_id string").select(store.bucket()).first()[0]
    store.save_fields(fields(spark, [("d3", 1, "a", "new"), ("d3", 2, "b", "new")]))
    after = files()
    assert {f for f in before if f not in after} == {f for f in before if f"bucket={bucket}/" in str(f)}
    assert held(store) == sorted([(d, "a", "old") for d in ids if d != "d3"] + [("d3", "a", "new"), ("d3", "b", "new")])
    plan = store.touched("fields", [bucket])._jdf.queryExecution().executedPlan().toString()
    assert f"bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.get("fields", "d3").count() == 2 and store.get("fields", "none").count() == 0


def test_store_keeps_its_buckets_and_empties_them(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    store.save_fields(fields(spark, [("a", 1, "x", "1"), ("b", 1, "x", "2")]))
    again = Store(spark, str(tmp_path / "s"), 99)
    assert again.buckets == 4
    again.replace("fields", fields(spark, []).limit(0), spark.createDataFrame([("a",)], "document_id string"))
    assert held(again) == [("b", "x", "2")]
    again.delete_documents(spark.createDataFrame([("b",), ("c",)], "document_id string"))
    assert held(again) == [] and again.read("logs").count() == 0
    again.replace("fields", fields(spark, [(None, 1, "x", "1")]))
    assert held(again) == []


def test_updates_of_documents(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    row = lambda d, **k: tuple({"document_id": d, "filename": "f", "document_type": "invoice", "status": "uploaded", "summary": "s"} .get(c) if c not in k else k[c] for c in [x.split(" ")[0] for x in schemas.DOCUMENTS.split(", ")])
    store.append("documents", spark.createDataFrame([row("a"), row("b")], schemas.DOCUMENTS))
    change = spark.createDataFrame([("a", "failed", None)], "document_id string, status string, summary string")
    store.update_documents(change)
    assert {r.document_id: (r.status, r.summary) for r in store.read("documents").collect()} == {"a": ("failed", "s"), "b": ("uploaded", "s")}
    store.update_documents(change, nulls=True)
    assert {r.document_id: r.summary for r in store.read("documents").collect()} == {"a": None, "b": "s"}
    with pytest.raises(ValueError, match="domain"):
        store.update_documents(spark.createDataFrame([("a", "odd")], "document_id string, status string"))


def test_saved_actions_keep_what_users_set(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    rows = lambda *x: spark.createDataFrame([("a", i, f"id{i}{s}", t, "odd", None, s, "ai", None, None, None) for i, t, s in x], schemas.ACTIONS)
    store.save_actions(rows((1, "Call them", "completed"), (2, "Pay", "pending"), (3, " ", "pending")))
    store.save_actions(rows((1, "call  THEM", "pending"), (2, "pay", "pending"), (3, "New", None)))
    assert {r.action: (r.status, r.action_id, r.priority) for r in store.read("actions").collect()} == {"call  THEM": ("completed", "id1completed", "medium"), "pay": ("pending", "id2pending", "medium"), "New": ("pending", "id3None", "medium")}


# Changes


def made(document, t, *actions):
    return [(document, T0 + datetime.timedelta(hours=t), "generated", i, a, "low", None, None, s, None) for i, (a, s) in enumerate(actions)] or [(document, T0 + datetime.timedelta(hours=t), "generated", None, None, None, None, None, None, None)]


def edit(document, t, action, status):
    return (document, T0 + datetime.timedelta(hours=t), "edit", None, action, None, None, status, None, None)


LOG = [
    *made("a", 1, ("Pay now", "ai"), ("Call", "ai"), ("Mine", "user"), ("Begun", "ai")), edit("a", 2, "pay NOW", "completed"), edit("a", 2, "Call", "dismissed"), edit("a", 2, "Begun", "in_progress"), edit("a", 2, "Nothing", "completed"), edit("a", 2, "Call", "odd"),
    *made("a", 3, ("Pay now", "ai"), ("Other", "ai")), edit("a", 3, "Other", "completed"), edit("a", 4, "Call", "completed"), edit("b", 1, "Pay now", "completed"), *made("b", 2, ("Pay now", "ai")), *made("c", 1, ("Gone", "ai")), *made("c", 2),
]


def test_changes_in_any_order_of_arrival(spark):
    want_actions = {("a", "Pay now", "completed"), ("a", "Mine", "pending"), ("a", "Begun", "in_progress"), ("a", "Other", "completed"), ("b", "Pay now", "pending")}
    want_errors = {("a", "Nothing", "no such action"), ("a", "Call", "no such status"), ("a", "Call", "no such action"), ("b", "Pay now", "no such action")}
    for seed in range(3):
        rows = LOG + LOG[:4] * seed
        random.Random(seed).shuffle(rows)
        folded = changes.fold(spark.createDataFrame(rows, changes.CHANGES).repartition(3)).collect()
        assert {(r.document_id, r.action, r.status) for r in folded if not r.error} == want_actions and len([r for r in folded if not r.error]) == len(want_actions)
        assert {(r.document_id, r.action, r.error) for r in folded if r.error} == want_errors
    pay = next(r for r in folded if r.action == "Pay now" and r.document_id == "a" and not r.error)
    assert (pay.created_at, pay.updated_at) == (T0 + datetime.timedelta(hours=1), T0 + datetime.timedelta(hours=3))
    assert changes.fold(spark.createDataFrame([], changes.CHANGES)).count() == 0


def test_store_folds_edits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    store.record(spark.createDataFrame(made("a", 1, ("Pay", "ai")) + made("b", 1, ("Pay", "ai")), changes.CHANGES))
    asked = spark.createDataFrame([("a", "pay", " Completed ", T0 + datetime.timedelta(hours=2)), ("a", "Pray", "completed", T0 + datetime.timedelta(hours=2))], "document_id string, action string, status string, at timestamp")
    errors = store.update_action_status(asked).collect()
    assert [(r.action, r.error) for r in errors] == [("Pray", "no such action")]
    assert [(r.document_id, r.status) for r in store.read("actions").collect()] == [("a", "completed")]
    store.settle(spark.createDataFrame([("b",)], "document_id string"))
    assert sorted((r.document_id, r.status) for r in store.read("actions").collect()) == [("a", "completed"), ("b", "pending")]


# Precedence


def test_precedence(spark, tmp_path):
    bodies = {"ok": '{"fields": [{"name": "x"}]}', "empty": '{"fields": []}', "bare": "{}", "corrupt": '{"fields": [', "shape": '{"fields": "x"}', "list": "[1]", "missing": None}
    kind = {"ok": "ok", "empty": "empty", "bare": "empty", "corrupt": "corrupt", "shape": "corrupt", "list": "corrupt", "missing": "missing"}
    cases = list(itertools.product(bodies, bodies))
    docs = spark.createDataFrame([(f"{a} {b}",) for a, b in cases], "document_id string")
    text = lambda k: spark.createDataFrame([(f"{a} {b}", bodies[(a, b)[k]].replace("x", "ve"[k]) if bodies[(a, b)[k]] else None) for a, b in cases], "document_id string, body string").where("body IS NOT NULL")
    levels = [(n, precedence.level(text(k), "fields", "struct<name: string>")) for k, n in enumerate(("validation", "extraction"))]
    got = {r.document_id: r for r in precedence.merge(docs, levels).collect()}
    stopped = {r.document_id: r.source for r in precedence.merge(docs, levels, ("validation",)).collect()}
    for a, b in cases:
        r, states = got[f"{a} {b}"], [kind[a], kind[b]]
        source = next((n for n, s in zip(("validation", "extraction"), states, strict=True) if s in ("ok", "empty")), "none")
        assert (r.source, r.states) == (source, dict(zip(("validation", "extraction"), states, strict=True)))
        assert [x.name for x in r["items"]] == (["v"] if source == "validation" and a == "ok" else ["e"] if source == "extraction" and b == "ok" else [])
        assert stopped[f"{a} {b}"] == ("corrupt" if kind[a] == "corrupt" else source)


def test_precedence_from_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    rows = spark.createDataFrame([("a", [("x", "1")])], "document_id string, fields array<struct<name: string, value: string>>")
    store.write_artifact("validation", rows)
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    kind = "struct<field_ord: int, field_name: string>"
    store.save_fields(fields(spark, [("b", 2, "two", "v"), ("b", 1, "one", "v"), ("a", 1, "no", "v")]))
    made = precedence.merge(docs, [("validation", precedence.level(store.artifacts("validation"), "fields", kind)), ("extraction", precedence.level(store.artifacts("extraction"), "fields", kind)), ("table", precedence.table(store.read("fields").select("document_id", "field_ord", "field_name"), "field_ord", kind))])
    got = {r.document_id: (r.source, [x.field_name for x in r["items"]]) for r in made.collect()}
    assert got == {"a": ("validation", [None]), "b": ("table", ["one", "two"]), "c": ("none", [])}


# Micro-batches


class Stopped(Exception):
    pass


def test_a_batch_that_is_delivered_again_changes_nothing(spark, tmp_path):
    """The run ends between a batch's writes and its commit; what the restart gives equals one computation over everything."""
    kinds, where = "document_id string, value int", f"{tmp_path}/in"
    put = lambda *rows: spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(where)
    store, calls = Store(spark, str(tmp_path / "s"), 4), []

    def compute(documents):
        calls.append(sorted(r[0] for r in documents.collect()))
        rows = spark.read.schema(kinds).parquet(where).join(documents, "document_id", "left_semi")
        total = rows.groupBy("document_id").agg(F.sum("value").alias("n"))
        return {"fields": total.select("document_id", F.lit(1).alias("field_ord"), F.lit("total").alias("field_name"), F.col("n").cast("string").alias("field_value"))}

    class Ending(Upserts):
        def mark(self, batch):
            if batch == 1 and not ended:
                ended.append(batch)
                raise Stopped
            super().mark(batch)

    def run(of):
        stream = spark.readStream.schema(kinds).parquet(where)
        query = of(store, "chain", compute).start(stream, f"{tmp_path}/state")
        query.awaitTermination()

    ended = []
    put(("a", 1), ("b", 2))
    run(Ending)
    put(("b", 5), ("c", 7))
    with pytest.raises(Exception, match="Stopped"):
        run(Ending)
    assert held(store) == [("a", "total", "1"), ("b", "total", "7"), ("c", "total", "7")]
    run(Ending)
    assert held(store) == [("a", "total", "1"), ("b", "total", "7"), ("c", "total", "7")]
    assert calls == [["a", "b"], ["b", "c"], ["b", "c"]]
    # a marker without the stream's own commit: the batch is passed over
    Upserts(store, "chain", compute)(spark.createDataFrame([("a", 1)], kinds), 1)
    assert len(calls) == 3
    put(("d", 1), (None, 3))
    run(Upserts)
    assert calls[3:] == [["d"]] and len(held(store)) == 4
