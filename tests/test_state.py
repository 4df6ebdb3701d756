"""Keyed state of streams: bounded reads, repeated triggers, buckets that aren't touched."""

import random
import re

from pyspark.sql import functions as F

from acervo.functions.vectors import hash_embedder
from acervo.operators import lifecycle
from acervo.streaming import batches, keyed
from acervo.streaming.state import KeyedState
from tests.test_audit import uuid
from tests.test_lifecycle import SCHEMA, random_log
from tests.test_streams import put

ROWS = "key string, value long"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS).coalesce(1)


def held(state, before=None, buckets=None):
    return {r.key: r.value for r in state.rows(buckets, before).collect()}


def test_fifty_triggers_leave_few_files(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "s"), ROWS, "key", buckets=3, most_deltas=4)
    rng, want = random.Random(1), {}
    for batch in range(50):
        rows = {f"k{rng.randrange(9)}": batch for _ in range(3)}
        want |= rows
        changed = frame(spark, list(rows.items()))
        state.write(changed, batch, state.touched(changed))
        if batch % 10 == 9:
            assert held(state) == want
    for parts in state.parts(None).values():
        assert len(parts) <= 6
    # Cleared, too, and not only left unread: nothing is there but two generations.
    assert all(len(list(at.iterdir())) <= 12 for at in (tmp_path / "s").iterdir() if at.name.startswith("bucket="))


def test_a_repeated_trigger_replaces_its_rows(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "s"), ROWS, "key", buckets=2, most_deltas=2)
    for batch in range(8):
        for attempt in ("first", "second") if batch in (0, 3, 4, 7) else ("only",):
            before = held(state, batch)
            assert before == {"a": batch - 1, "b": (batch - 1) * 10} if batch else before == {}
            rows = [("a", batch), ("b", batch * 10)] if attempt != "first" else [("a", -5), ("c", 1), ("b", 0)]
            changed = frame(spark, rows)
            state.write(changed, batch, [0, 1])
        assert held(state) == {"a": batch, "b": batch * 10}
    assert held(state, buckets=[]) == {}


def test_a_failed_write_is_made_good_by_the_next(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "s"), ROWS, "key", buckets=2, most_deltas=1)
    for batch in range(3):
        state.write(frame(spark, [("a", batch), ("b", batch)]), batch, [0, 1])
    broken = frame(spark, [("a", 3), ("b", 3)]).withColumn("value", F.when(F.col("key") == "b", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("value")))
    try:
        state.write(broken, 3, [0, 1])
        raise AssertionError("should fail")
    except Exception as problem:
        assert "lost" in str(problem)
    assert held(state, 3) == {"a": 2, "b": 2}
    state.write(frame(spark, [("a", 3), ("b", 3)]), 3, [0, 1])
    assert held(state) == {"a": 3, "b": 3}


def test_rows_of_one_document_lie_together(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "s"), keyed.STATES, "version_id", "document_id", buckets=8)
    rows = spark.createDataFrame([(f"d{k % 5}", f"v{k}", "READY") for k in range(40)], keyed.STATES)
    state.write(rows, 0, range(8))
    one = rows.where("document_id = 'd3'")
    (bucket,) = state.touched(one)
    found = state.rows([bucket])
    assert {r.version_id for r in found.where("document_id = 'd3'").collect()} == {f"v{k}" for k in range(3, 40, 5)}
    # No other bucket is read.
    assert {re.search(r"bucket=(\d+)", path).group(1) for path in found.inputFiles()} == {str(bucket)}


def test_lifecycle_over_many_triggers_equals_batch_and_reads_little(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    log = [(p, d, f"{d}-{v}", c) for p, d, v, c in random_log(21, n=700, versions=9)]
    step = 100
    for start in range(0, len(log), step):
        put(spark, source, log[start : start + step], SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        keyed.lifecycle_stream(stream, out, checkpoint, buckets=2, most_deltas=2).awaitTermination()
    commands = spark.createDataFrame(log, SCHEMA)
    columns = ["pos", "before", "outcome"]
    moves, batch = spark.read.parquet(f"{out}/moves"), lifecycle.fold_lifecycle(commands)
    assert sorted(map(tuple, moves.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    states, owners = keyed.lifecycle_states(spark, out, buckets=2, most_deltas=2)
    want = {(r.document_id, r.version_id, r.state) for r in lifecycle.version_histories(commands).collect()}
    assert {(r.document_id, r.version_id, r.state) for r in states.rows().collect()} == want
    assert {(r.document_id, r.version_id) for r in owners.rows().collect()} == {w[:2] for w in want}
    assert all(len(parts) <= 4 for state in (states, owners) for parts in state.parts(None).values())


def test_one_fold_gives_moves_and_histories(spark):
    commands = spark.createDataFrame([(p, d, f"{d}-{v}", c) for p, d, v, c in random_log(3, n=300, versions=6)], SCHEMA)
    moves, histories = lifecycle.fold_with_histories(commands)
    assert sorted(map(tuple, moves.collect())) == sorted(map(tuple, lifecycle.fold_lifecycle(commands).collect()))
    plain = lifecycle.version_histories(commands)
    assert sorted(map(str, histories.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_an_ingest_trigger_reads_its_keys_buckets_only(spark, tmp_path, monkeypatch):
    root, source = str(tmp_path / "tables"), str(tmp_path / "in")
    schema = (
        "seq long, job_id string, idempotency_key string, document_id string, version_id string, title string, academic_year string, "
        "description string, file_name string, mime_type string, path string"
    )
    files = spark.createDataFrame([("/in/a.pdf", bytearray(b"%PDF-\nTexto suficiente para una hoja."))], "path string, content binary").withColumn("length", F.lit(40))
    sizes = {"buckets": 16}

    def run(rows):
        put(spark, source, [(n, f"j{n}", key, uuid(d), uuid(v), "T", "2026-2027", None, "a.pdf", "application/pdf", "/in/a.pdf") for n, key, d, v in rows], schema)
        stream = spark.readStream.schema(schema).parquet(source)
        batches.ingest_stream(stream, lambda paths: files, root, hash_embedder(8), dims=8, sizes=sizes).awaitTermination()

    run([(n, f"key-{n}", n, 100 + n) for n in range(1, 13)])
    read = []
    kept = KeyedState._read
    monkeypatch.setattr(KeyedState, "_read", lambda self, parts: read.append((self.key, set(parts))) or kept(self, parts))
    run([(20, " key-3 ", 3, 103), (21, "key-new", 3, 103)])
    states = batches.ingest_states(spark, root, **sizes)
    want = {"idempotency_key": ["key-3", "key-new"], "version_id": [uuid(103)], "document_id": [uuid(3)]}
    for state in states.values():
        buckets = set(state.touched(spark.createDataFrame([(v,) for v in want[state.key]], f"{state.key} string")))
        seen = set().union(*[parts for key, parts in read if key == state.key])
        assert seen <= buckets and len(seen) >= 1
    ledger = {r.job_id if r.job_id != "j3" else f"j3 {r.outcome}": (r.outcome, r.ownership) for r in spark.read.parquet(f"{root}/ledger").where("batch = 1").collect()}
    assert ledger == {"j3 replay": ("replay", None), "j21": ("new", "already_indexed")}
    assert states["documents"].rows().count() == 12 and states["versions"].rows().count() == 12 and states["owners"].rows().count() == 13
