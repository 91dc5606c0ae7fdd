"""The status machine, attempts and stalled stages in batch and stream; bisected batches and the ledger of answers."""

import datetime
import random

import pytest

from paperloom.operators import audit, machine
from paperloom.schemas import STAGES
from paperloom.sources import ledger, providers
from paperloom.streaming import logs as stream
from paperloom.streaming import machine as streaming

KINDS = "document_id string, stage string, status string, created_at timestamp"
T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def log(spark, rows):
    return spark.createDataFrame([(d, s, t, at(x) if x is not None else None) for d, s, t, x in rows], KINDS)


def walk(*rows):
    s, out = machine.State(), []
    for stage, status in rows:
        s, verdict = machine.step(s, stage, status, len(out))
        out.append(verdict)
    return machine.name_of(s), out


def test_steps_of_the_machine():
    up = ("upload", "completed")
    assert walk() == ("new", []) and walk(up) == ("waiting", ["step"])
    assert walk(("ocr", "started"), ("ocr", "completed"), ("upload", "odd"), ("odd", "started")) == ("new", ["illegal"] * 4)
    assert walk(up, ("preprocessing", "started"), ("ocr", "started"), ("preprocessing", "failed"), ("ocr", "started"), ("preprocessing", "started"), ("preprocessing", "completed"), ("ocr", "started")) == ("running", ["step", "step", "illegal", "step", "illegal", "step", "step", "step"])
    assert walk(up, ("preprocessing", "failed"), ("upload", "completed")) == ("waiting", ["step", "illegal", "illegal"])
    whole = [up] + [x for s in STAGES[1:] if s != "vision_fallback" for x in ((s, "started"), (s, "completed"))]
    assert walk(*whole) == ("ended", ["step"] * len(whole))
    assert walk(*whole, ("ocr", "started"), ("validation", "started"), ("ocr", "completed")) == ("waiting", ["step"] * len(whole) + ["restart", "illegal", "step"])
    assert walk(up, ("preprocessing", "skipped"), ("classification", "skipped"), ("preprocessing", "skipped")) == ("waiting", ["step", "step", "illegal", "illegal"])


def test_order_and_repetitions(spark):
    """At equal times stages count in their order and a start before an end; equal rows are told; rows without a key are left out."""
    rows = [("a", "ocr", "started", 5), ("a", "preprocessing", "completed", 5), ("a", "preprocessing", "started", 5), ("a", "upload", "completed", 5), ("a", "upload", "completed", 5), (None, "ocr", "started", 1), ("b", None, "started", 1), ("b", "ocr", "started", None)]
    got = [(r.stage, r.status, r.verdict, r.state) for r in machine.steps(log(spark, rows)).collect()]
    assert got == [("upload", "completed", "step", "waiting"), ("upload", "completed", "repeated", "waiting"), ("preprocessing", "started", "step", "running"), ("preprocessing", "completed", "step", "waiting"), ("ocr", "started", "step", "running")]
    assert audit.latest_status(log(spark, rows[:5])).first()[1:3] == ("ocr", "started")
    assert audit.latest_status(log(spark, rows[1:5])).first()[1:3] == ("preprocessing", "completed")
    assert machine.states(log(spark, []).limit(0)).count() == 0


def noisy(n=240, seed=2):
    rng = random.Random(seed)
    return [(f"d{rng.randrange(4)}", STAGES[rng.randrange(3)], rng.choice(["started", "completed", "failed", "skipped"]), rng.randrange(400) * 5) for _ in range(n)]


def streamed(spark, tmp_path, rows, make, watermark_rows=2):
    """What a stream gives for rows that come in any order, in three batches, with rows after them that move the watermark on."""
    rows = [*rows]
    random.Random(5).shuffle(rows)
    parts = [rows[i::3] for i in range(3)] + [[("end", "upload", "started", 10**6 + k)] for k in range(watermark_rows)]
    for part in parts:
        log(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = make(stream.read_logs(spark, f"{tmp_path}/in", KINDS, 1))
    query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(180)
    finally:
        query.stop()
    return sorted(str(tuple(r)) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.document_id != "end")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, old)


def test_stream_of_the_machine(spark, tmp_path, rocks):
    rows = noisy()
    got = streamed(spark, tmp_path, rows, lambda s: streaming.steps(s, "1 hour"))
    assert got == sorted(str(tuple(r)) for r in machine.steps(log(spark, rows)).collect())


@pytest.mark.parametrize("of", [stream.stalled, stream.orphans])
def test_stream_of_unmatched_rows(spark, tmp_path, of):
    rows = noisy(120, 9)
    want = sorted(str(tuple(r)) for r in of(log(spark, rows), "100 SECONDS").collect())
    assert want and streamed(spark, tmp_path, rows, lambda s: of(s, "100 SECONDS", "1 hour")) == want


def test_attempts(spark):
    """A failed run and a short rerun two days later: the time between them isn't counted."""
    day = 86_400
    rows = [("a", "ocr", "started", 0), ("a", "ocr", "failed", 60), ("a", "ocr", "started", 2 * day), ("a", "ocr", "completed", 2 * day + 60), ("a", "ocr", "completed", 2 * day + 70), ("a", "ocr", "completed", 2 * day + 60)]
    rows += [("b", "ocr", "completed", 5), ("b", "ocr", "started", 7), ("b", "ocr", "started", 7), ("b", "ocr", "started", 9), ("b", "ocr", "failed", 9), ("b", "ocr", "started", 20), ("b", "ocr", "skipped", 30)]
    got = [(r.document_id, r.attempt, r.outcome, r.repeats, r.seconds) for r in audit.attempts(log(spark, rows)).orderBy("document_id", "attempt").collect()]
    assert got == [("a", 1, "failed", 0, 60.0), ("a", 2, "completed", 1, 60.0), ("b", 0, "orphan", 0, None), ("b", 1, "abandoned", 0, None), ("b", 2, "failed", 0, 0.0), ("b", 3, "open", 0, None)]
    row = {r.document_id: r for r in audit.stage_durations(log(spark, rows)).collect()}["a"]
    assert (row.seconds, row.attempts, row.failures, row.ended_at - row.started_at) == (120.0, 2, 1, datetime.timedelta(days=2, seconds=70))


def test_bisected():
    calls = []

    def call(prompts):
        calls.append(len(prompts))
        if "bad" in prompts:
            raise ValueError("poisoned")
        return [p.upper() for p in prompts]

    got = providers.bisected(call, ["a"] * 700 + ["bad"] + ["b"] * 299)
    assert [x for x in got if x[1]] == [(None, "poisoned")] and got[700] == (None, "poisoned") and got[0] == ("A", None) and len(got) == 1000
    assert len(calls) < 30
    assert providers.bisected(call, []) == [] and providers.bisected(lambda p: [None] * len(p), ["a"]) == [(None, "no answer")]
    assert {e for _, e in providers.bisected(lambda p: ["one"], ["a", "b"])} == {None}  # each alone gets its one answer
    assert providers.bisected(lambda p: [], ["a"]) == [(None, "0 answers to 1 prompts")]
    calls.clear()
    assert providers.bisected(call, ["bad"], tries=3) == [(None, "poisoned")] and calls == [1, 1, 1]


def counting(path):
    """A call that notes the prompts it is asked, where executors and driver share the disk."""

    def call(prompts):
        with open(path, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        if "bad" in prompts:
            raise ValueError("poisoned")
        return [f"told {p}" for p in prompts]

    return call


def test_ledger(spark, tmp_path):
    prompts = spark.createDataFrame([(str(i), "bad" if i == 500 else f"p{i % 300}") for i in range(1000)], "document_id string, prompt string")
    asked = tmp_path / "asked"
    make = lambda **k: ledger.Ledgered(providers.Batched(counting(str(asked))), f"file://{tmp_path}/ledger", **k)
    first = {r.document_id: (r.response_json, r.error) for r in make().answer("summary", prompts).collect()}
    assert len(first) == 1000 and first["500"] == (None, "poisoned") and first["7"] == ("told p7", None) and sum(e is not None for _, e in first.values()) == 1
    # every prompt was answered in one call; those beside the poisoned one were asked again with ever fewer others, and no prompt by itself but that
    said = asked.read_text().split()
    assert set(said) == {f"p{i}" for i in range(300)} | {"bad"}
    asked.unlink()
    again = {r.document_id: (r.response_json, r.error) for r in make().answer("summary", prompts).collect()}
    assert again == first and not asked.exists()
    # another stage or model is another question; what had an error is asked again if wanted
    make(model="other").answer("summary", prompts.limit(1)).collect()
    make().answer("titles", prompts.limit(1)).collect()
    assert len(asked.read_text().split()) == 2
    asked.unlink()
    make(again=True).answer("summary", prompts).collect()
    assert asked.read_text().split() == ["bad"]
    # rows of concurrent runs repeat: an answer goes before an error
    spark.createDataFrame([("batched", r.prompt_hash, "told at last", None) for r in make().known(spark).where("error IS NOT NULL").collect()], ledger.LEDGER).write.mode("append").parquet(f"file://{tmp_path}/ledger")
    assert {r.document_id: r.response_json for r in make().answer("summary", prompts).collect()}["500"] == "told at last"


def test_ledger_tells_crops_apart(spark):
    rows = spark.createDataFrame([("a", "x", 1, (1, 2)), ("b", "x", 1, (1, 2)), ("a", "x", 1, (1, 3)), ("a", "x", 1, (1, 2))], "document_id string, prompt string, page_number int, crop struct<x:int,y:int>")
    hashes = [r[0] for r in rows.select(ledger.prompt_hash("vision_fallback", rows)).collect()]
    assert hashes[0] == hashes[3] and len(set(hashes)) == 3
    plain = rows.drop("crop", "page_number")
    assert plain.select(ledger.prompt_hash("summary", plain)).distinct().count() == 1
