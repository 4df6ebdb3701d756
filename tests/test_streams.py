from datetime import datetime

from pyspark.sql import functions as F

from acervo.functions.vectors import hash_embedder
from acervo.operators import lifecycle
from acervo.streaming import batches, keyed
from tests.test_audit import uuid
from tests.test_lifecycle import SCHEMA, random_log

REQUESTS = "idempotency_key string, seq long, request_hash string, job_id string"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_admission_remembers_over_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        keyed.admit_stream(spark.readStream.schema(REQUESTS).parquet(source), out, checkpoint).awaitTermination()
        return {r.seq: (r.outcome, r.job_id) for r in spark.read.parquet(out).collect()}

    put(spark, source, [("k", 2, "h", "j2"), ("k", 1, "h", "j1"), ("x", 3, "h", "j3")], REQUESTS)
    assert run() == {1: ("new", "j1"), 2: ("replay", "j1"), 3: ("new", "j3")}
    put(spark, source, [("k", 4, "h", "j4"), ("x", 5, "other", "j5")], REQUESTS)
    assert run() == {1: ("new", "j1"), 2: ("replay", "j1"), 3: ("new", "j3"), 4: ("replay", "j1"), 5: ("conflict", None)}


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    log = [(p, d, f"{d}-{v}", c) for p, d, v, c in random_log(11, n=600, versions=12)]
    for part in (log[:300], log[300:]):
        put(spark, source, part, SCHEMA)
        keyed.lifecycle_stream(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint).awaitTermination()
    streamed = spark.read.parquet(f"{out}/moves")
    commands = spark.createDataFrame(log, SCHEMA)
    batch = lifecycle.fold_lifecycle(commands)
    columns = ["pos", "before", "outcome"]
    assert sorted(map(tuple, streamed.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    purged = {r.version_id for r in spark.read.parquet(f"{out}/purges").collect()}
    assert purged == {r.version_id for r in lifecycle.purge_queue(lifecycle.version_histories(commands)).collect()}


def test_ingest_stream_over_two_triggers(spark, tmp_path):
    root, source = str(tmp_path / "tables"), str(tmp_path / "in")
    schema = (
        "seq long, job_id string, idempotency_key string, document_id string, version_id string, title string, academic_year string, "
        "description string, file_name string, mime_type string, path string"
    )

    def request(n, key, version, path="/in/a.pdf", title="Título"):
        return (n, f"j{n}", key, uuid(1), uuid(version), title, "2026-2027", None, "a.pdf", "application/pdf", path)

    files = spark.createDataFrame(
        [("/in/a.pdf", bytearray(b"%PDF-\nTexto suficiente para una hoja.")), ("/in/b.pdf", bytearray(b"%PDF-\nOtro texto suficiente, distinto."))], "path string, content binary"
    ).withColumn("length", F.octet_length("content").cast("bigint"))

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        batches.ingest_stream(stream, lambda paths: files, root, hash_embedder(8), dims=8).awaitTermination()
        return {r.job: (r.outcome, r.error_code) for r in spark.read.parquet(f"{root}/ledger").withColumn("job", F.concat_ws("/", "idempotency_key", "request_hash")).collect()}, spark.read.parquet(f"{root}/ledger")

    put(spark, source, [request(1, "k1", 11)], schema)
    run()
    put(spark, source, [request(2, "k1", 11), request(3, "k1", 12), request(4, "k2", 11, "/in/b.pdf"), request(5, "k3", 11)], schema)
    _, ledger = run()
    second = ledger.where("batch = 1").select("idempotency_key", "version_id", "outcome", "ownership", "job_id", "error_code").collect()
    rows = {(r.idempotency_key, r.version_id): (r.outcome, r.ownership, r.error_code) for r in second}
    assert rows == {
        ("k1", uuid(11)): ("replay", None, None), ("k1", uuid(12)): ("conflict", None, "IDEMPOTENCY_CONFLICT"),
        ("k2", uuid(11)): ("conflict", "other_content", "VERSION_CONFLICT"), ("k3", uuid(11)): ("new", "already_indexed", None),
    }
    assert spark.read.parquet(f"{root}/points").count() == 1
    assert {(r.version_id, r.state) for r in spark.read.parquet(f"{root}/versions").collect()} == {(uuid(11), "READY")}


def test_purges_over_several_triggers(spark, tmp_path):
    source, out = str(tmp_path / "purges"), str(tmp_path / "out")
    points = spark.createDataFrame([("p1", "v1"), ("p2", "v2"), ("p3", "v3")], "point_id string, version_id string")
    assert batches.live_points(points, out).count() == 3
    for gone in (["v1"], ["v1", "v3"]):
        put(spark, source, [(v,) for v in gone], "version_id string")
        stream = spark.readStream.schema("version_id string").parquet(source)
        batches.purge_stream(stream, out, str(tmp_path / "c1")).awaitTermination()
    assert [r.point_id for r in batches.live_points(points, out).collect()] == ["p2"]
    assert [r.point_id for r in batches.compact_points(points, out, str(tmp_path / "next")).collect()] == ["p2"]


def test_notes_made_during_a_compaction_are_kept(spark, tmp_path, monkeypatch):
    purged, path = str(tmp_path / "purged"), str(tmp_path / "next")
    points = spark.createDataFrame([("p1", "v1"), ("p2", "v2"), ("p3", "v3")], "point_id string, version_id string")

    def note(batch, version):
        spark.createDataFrame([(version,)], "version_id string").write.parquet(f"{purged}/batch={batch}")

    def ids(df):
        return sorted(r.point_id for r in df.collect())

    note(3, "v1")
    mark = batches.note_mark

    def marked(session, at):
        through = mark(session, at)
        # A trigger notes another version after the mark is taken and before the points are written.
        note(4, "v2")
        return through

    monkeypatch.setattr(batches, "note_mark", marked)
    compacted = batches.compact_points(points, purged, path)
    assert ids(compacted) == ["p2", "p3"]
    assert batches.drop_spent_notes(spark, purged, path) == 1 and batches.drop_spent_notes(spark, purged, path) == 0
    assert mark(spark, purged) == 4
    assert ids(batches.live_points(compacted, purged)) == ["p3"]
    monkeypatch.setattr(batches, "note_mark", mark)
    again = batches.compact_points(compacted, purged, f"{path}-2")
    assert ids(again) == ["p3"] and batches.drop_spent_notes(spark, purged, f"{path}-2") == 1
    assert mark(spark, purged) == -1 and ids(batches.live_points(again, purged)) == ["p3"]


def test_entries_kept_by_one_trigger_expire_at_a_later_one(spark, tmp_path):
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "id string, expires_at timestamp"
    clock = ["2026-01-01 00:30:00"]

    def run(rows):
        put(spark, source, [(i, datetime.fromisoformat(at)) for i, at in rows], schema)
        stream = spark.readStream.schema(schema).parquet(source)
        as_of = lambda: F.lit(clock[0]).cast("timestamp")
        batches.diagnostics_expiry_stream(stream, as_of, out, str(tmp_path / "c"), every=None).awaitTermination()
        return sorted(r.id for r in batches.live_diagnostics(spark, out, schema, as_of()).collect())

    assert run([("gone", "2026-01-01 00:10:00"), ("a", "2026-01-01 01:00:00"), ("b", "2026-01-01 02:45:00"), ("c", "2026-01-09 00:00:00")]) == ["a", "b", "c"]
    clock[0] = "2026-01-01 02:30:00"
    assert run([("d", "2026-01-02 00:00:00")]) == ["b", "c", "d"]
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["b", "c", "d"]
    clock[0] = "2026-01-01 02:50:00"
    assert run([("e", "2026-01-03 00:00:00")]) == ["c", "d", "e"]
