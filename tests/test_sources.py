import datetime
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from acervo.functions import fields, ids
from acervo.operators import admission, answering, diagnostics, evaluation
from acervo.operators.retrieval import search_scope
from acervo import session as session_module
from acervo.sources import corpus_json, ledger, snapshots, wanted
from acervo.sources import files as fs

NOW = datetime.datetime(2026, 8, 16, 10, 0, 0)


def test_files_are_checked_and_read(spark, tmp_path):
    contents = {
        "a.pdf": b"%PDF-1.7\nPrimera hoja con texto.\f\fTercera hoja con texto.", "B.PDF": "%PDF-\nUna hoja con bastante texto.".encode(),
        "c.pdf": b"no signature", "d.txt": b"%PDF-\nx", "e.pdf": b"%PDF-\n" + b"x" * 500, "f.pdf": b"%PDF-\n\xff\xfe", "g.pdf": b"%PDF-\ncorto", "h.pdf": b"%PD",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    files = fs.check_signature(fs.read_files(spark, str(tmp_path), max_bytes=300))
    rows = {os.path.basename(r.path): r for r in fs.extract_pages(files).collect()}
    errors = {name: r.error_code for name, r in rows.items()}
    assert errors == {
        "a.pdf": None, "B.PDF": None, "c.pdf": "PDF_SIGNATURE_INVALID", "d.txt": "PDF_EXTENSION_INVALID", "e.pdf": "PDF_TOO_LARGE",
        "f.pdf": "PDF_PARSE_FAILED", "g.pdf": "PDF_TEXT_NOT_FOUND", "h.pdf": "PDF_SIGNATURE_INVALID",
    }
    assert [(p.page, p.text) for p in rows["a.pdf"].pages] == [(1, "Primera hoja con texto."), (3, "Tercera hoja con texto.")]


def test_wanted_files_are_opened_in_the_tasks(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"f{k}.pdf").write_bytes(b"%PDF-\n" + b"x" * k)
    (tmp_path / "folder.pdf").mkdir()
    (tmp_path / "shut.pdf").symlink_to("shut.pdf")
    asked = [f"{tmp_path}/f{k}.pdf" for k in range(30)] + [f"file:{tmp_path}/f1.pdf", f"file://{tmp_path}/f2.pdf", f"{tmp_path}/none.pdf", f"{tmp_path}/folder.pdf", f"{tmp_path}/shut.pdf", f"{tmp_path}/f3.txt", "nowhere://host/x.pdf"]
    paths = spark.createDataFrame([(p,) for p in asked], "path string")
    rows = {os.path.basename(r.path): r for r in fs.wanted_files(spark, paths, max_bytes=30).collect()}
    assert len(rows) == 34 and fs.wanted_files(spark, paths, max_bytes=30).count() == 34
    for k in range(30):
        r = rows[f"f{k}.pdf"]
        assert r.length == 6 + k and r.modificationTime is not None
        assert (r.content, r.error_code) == ((bytearray(b"%PDF-\n" + b"x" * k), None) if k <= 24 else (None, "PDF_TOO_LARGE"))
    assert {n: rows[n].error_code for n in ("none.pdf", "folder.pdf", "x.pdf")} == {"none.pdf": "PDF_REQUIRED", "folder.pdf": "PDF_REQUIRED", "x.pdf": "UPLOAD_PROCESSING_FAILED"}
    assert rows["shut.pdf"].error_code in ("PDF_REQUIRED", "UPLOAD_PROCESSING_FAILED")
    assert fs.read_wanted(spark, paths).where("error_code is null").count() == 30
    assert fs.wanted_files(spark, paths.limit(0)).collect() == []


def test_wanted_paths_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    paths = spark.createDataFrame([(f"{tmp_path}/f{k}.pdf",) for k in range(40)], "path string").coalesce(1)
    # No call for a path on the driver: only the two of the shared folder and of the default store are resolved there.
    resolved = []
    monkeypatch.setattr(wanted, "qualified", lambda session, path: resolved.append(path) or session_module.qualified(session, path))
    files = wanted.load(spark, paths, paths_a_task=10)
    parts = files.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sorted(r["count"] for r in parts) == [10] * 4 and len(resolved) == 2


def test_loader_failures_become_codes(spark):
    def loader(content):
        name = content.decode()
        if name in ("PasswordException", "FormatError"):
            raise type(name, (Exception,), {})()
        if name == "double":
            return [(1, "x" * 30), (1, "y" * 30)]
        if name == "zero":
            return [(0, "x" * 30)]
        if name == "bytes":
            return [(1, b"x" * 30)]
        return [(2, "y" * 10), (1, "x" * 10)]

    names = ["PasswordException", "FormatError", "double", "zero", "bytes", "fine"]
    files = spark.createDataFrame([(n, bytearray(n.encode()), None) for n in names], "path string, content binary, error_code string")
    rows = {r.path: r for r in fs.extract_pages(files, loader).collect()}
    assert [rows[n].error_code for n in names] == ["PDF_ENCRYPTED", "PDF_CORRUPT", "PDF_METADATA_INVALID", "PDF_METADATA_INVALID", "PDF_PARSE_FAILED", None]
    assert [p.page for p in rows["fine"].pages] == [1, 2]


def test_json_inputs(spark, tmp_path):
    version = {"versionId": "v1", "title": "t", "academicYear": "2026-2027", "source": "s.json", "file": "f.pdf", "idempotencyKey": "k", "activate": True}
    manifest = {
        "schema": "m/v1", "institution": {"name": "IES", "email": "e", "phone": "p", "address": "a"},
        "documents": [{"documentId": "d1", "topic": "x", "title": "T", "description": "D", "versions": [version, {**version, "versionId": "v2", "activate": False}]}],
        "replacement": {"topic": "x", "documentId": "d1", "previous": {**version, "versionId": "v2"}, "current": version},
        "conflicts": [{"id": "c", "subject": "s", "claims": [{"documentId": "d1", "versionId": "v1", "page": 1, "claim": "uno"}, {"documentId": "d2", "versionId": "v3", "page": 2, "claim": "dos"}]}],
    }
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    tables = corpus_json.flatten_manifest(corpus_json.read_manifest(spark, str(tmp_path / "m.json")))
    assert {(r.version_id, r.activate, r.position) for r in tables["versions"].collect()} == {("v1", True, 0), ("v2", False, 1)}
    (replacement,) = tables["replacement"].collect()
    assert (replacement.previous_version_id, replacement.current_version_id, replacement.current_activates) == ("v2", "v1", True)
    assert {(r.conflict_id, r.document_id, r.page) for r in tables["conflicts"].collect()} == {("c", "d1", 1), ("c", "d2", 2)}
    assert [(r.source, r.expected_name) for r in tables["institutions"].collect()] == [("s.json", "IES")]
    (tmp_path / "s.json").write_text(json.dumps({"institution": manifest["institution"], "pages": [{"heading": "H", "paragraphs": ["a", "b"]}, {"heading": "G", "paragraphs": []}]}))
    assert [(r.source, r.page, r.text) for r in corpus_json.read_json_pages(spark, str(tmp_path / "s.json")).orderBy("page").collect()] == [("s.json", 1, "H\na\nb"), ("s.json", 2, "G")]
    questions = {"schema": "q", "questions": [{"id": "q1", "question": "¿?", "expectedStatus": "found", "expectedDocumentIds": ["d1"], "expectedPages": [1]}]}
    (tmp_path / "q.json").write_text(json.dumps(questions, indent=1))
    (row,) = corpus_json.read_eval_questions(spark, str(tmp_path / "q.json")).collect()
    assert (row.question_id, row.expected_status, row.expected_document_ids, row.expected_pages) == ("q1", "found", ["d1"], [1])


def test_point_snapshots(spark, tmp_path):
    existing = spark.createDataFrame([("p1", "v1", "old"), ("p2", "v2", "kept")], "point_id string, version_id string, text string")
    incoming = spark.createDataFrame([("p1", "v1", "new", 2), ("p1", "v1", "newer", 3), ("p3", "v3", "added", 1)], "point_id string, version_id string, text string, seq int")
    once = snapshots.upsert_points(existing, incoming, "seq")
    assert {tuple(r) for r in once.collect()} == {("p1", "v1", "newer"), ("p2", "v2", "kept"), ("p3", "v3", "added")}
    twice = snapshots.upsert_points(once, incoming, "seq")
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in once.collect()}
    gone = spark.createDataFrame([("v1",), ("v8",)], "version_id string")
    left = snapshots.delete_versions(once, gone)
    assert {r.point_id for r in left.collect()} == {r.point_id for r in snapshots.delete_versions(left, gone).collect()} == {"p2", "p3"}
    path = str(tmp_path / "points")
    snapshots.write_snapshot(snapshots.with_bucket(once, 4), path, ["bucket"])
    snapshots.write_snapshot(snapshots.with_bucket(once.where("version_id = 'v1'").withColumn("text", F.lit("again")), 4), path, ["bucket"])
    texts = {r.point_id: r.text for r in spark.read.parquet(path).collect()}
    assert texts["p1"] == "again" and set(texts) >= {"p1"}


def test_written_points_are_upserted_without_moving_them_whole(spark, tmp_path):
    existing = spark.createDataFrame([("p1", "v1", "old"), ("p2", "v2", "kept"), (None, "v9", "kept")], "point_id string, version_id string, text string")
    rows = [("p1", "v1", "new", 2), ("p1", "v1", "newer", 3), ("p3", "v3", "added", 1), (None, "v4", "a", 1), (None, "v4", "b", 2)]
    spark.createDataFrame(rows, "point_id string, version_id string, text string, seq int").write.parquet(str(tmp_path / "in"))
    incoming = spark.read.parquet(str(tmp_path / "in"))
    once = snapshots.upsert_points(existing, incoming, "seq", written=True)
    expected = [tuple(r) for r in snapshots.upsert_points(existing, incoming, "seq").collect()]
    assert sorted(map(str, map(tuple, once.collect()))) == sorted(map(str, expected)) and len(expected) == 5
    # Rows whose id comes once are neither shuffled nor aggregated: a count of them by version reads no text.
    incoming.where("point_id = 'p3'").write.parquet(str(tmp_path / "one"))
    single = spark.read.parquet(str(tmp_path / "one"))
    counted = snapshots.upsert_points(existing, single, "seq", written=True).groupBy("version_id").count()
    scans = [line for line in counted._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line and "/one" in line]
    assert any("version_id:string" in line and "text:string" not in line for line in scans)
    assert {tuple(r) for r in counted.collect()} == {("v1", 1), ("v2", 1), ("v3", 1), ("v9", 1)}


def test_bucketed_tables_join_without_moving_points(spark, tmp_path):
    points = spark.range(1000).select(F.col("id").alias("point_id"), F.concat(F.lit("v"), (F.col("id") % 50).cast("string")).alias("version_id"))
    versions = points.select("version_id").distinct().where("version_id < 'v3'")
    p = snapshots.save_bucketed(points, "bucketed_points", 4, str(tmp_path / "p"))
    v = snapshots.save_bucketed(versions, "bucketed_versions", 4, str(tmp_path / "v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scoped = search_scope(p, v)
        plan = scoped._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert scoped.count() == points.where("version_id < 'v3'").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_points")
        spark.sql("DROP TABLE bucketed_versions")


def test_vector_schema_is_enforced(spark):
    points = spark.createDataFrame([("p1", [1.0, 2.0]), ("p2", [1.0])], "point_id string, vector array<float>")
    assert [r.point_id for r in snapshots.vector_schema_violations(points, 2).collect()] == ["p2"]
    assert snapshots.ensure_vector_schema(points.where("point_id = 'p1'"), 2).count() == 1
    with pytest.raises(Exception, match="VECTOR_DIMENSION_MISMATCH"):
        snapshots.ensure_vector_schema(points, 2).collect()


def test_documents_keep_their_creation(spark):
    existing = spark.createDataFrame([("d1", "t", "x", 1, 1)], "document_id string, title string, description string, created_at int, updated_at int")
    incoming = spark.createDataFrame([("d1", "u", None, 5), ("d2", "n", None, 4), ("d1", "w", None, 6)], "document_id string, title string, description string, updated_at int")
    rows = {tuple(r) for r in snapshots.upsert_documents(existing, incoming).collect()}
    assert rows == {("d1", "w", None, 1, 6), ("d2", "n", None, 4, 4)}


def test_admission(spark):
    schema = "idempotency_key string, seq long, request_hash string, job_id string"
    known = spark.createDataFrame([("k3", "h1", "old")], "idempotency_key string, request_hash string, job_id string")
    requests = spark.createDataFrame(
        [("k1", 1, "h1", "j1"), ("k1", 2, "h1", "j2"), ("k1", 3, "h2", "j3"), ("k2", 4, "h1", "j4"), ("k3", 5, "h1", "j5"), ("k3", 6, "h9", "j6")]
        + [("hot", 10 + i, f"h{i % 2}", f"j{10 + i}") for i in range(200)],
        schema,
    )
    rows = {r.seq: (r.outcome, r.job_id) for r in admission.admit_requests(requests, known).collect()}
    assert [rows[i] for i in range(1, 7)] == [
        ("new", "j1"), ("replay", "j1"), ("conflict", None), ("new", "j4"), ("replay", "old"), ("conflict", None)
    ]
    hot = [rows[10 + i] for i in range(200)]
    assert hot[0] == ("new", "j10") and all(h == (("replay", "j10") if i % 2 == 0 else ("conflict", None)) for i, h in enumerate(hot) if i)


def test_ownership(spark):
    versions = spark.createDataFrame([("v1", "d1", "h", "ACTIVE"), ("v2", "d1", "h", "FAILED")], "version_id string, document_id string, content_hash string, state string")
    requests = spark.createDataFrame(
        [(1, "v1", "d1", "h"), (2, "v1", "d2", "h"), (3, "v1", "d1", "x"), (4, "v2", "d1", "h"), (5, "v3", "d1", "h"), (6, "v3", "d2", "h"), (7, "v3", "d1", "x")],
        "seq long, version_id string, document_id string, content_hash string",
    )
    rows = {r.seq: r.ownership for r in admission.check_version_ownership(requests, versions).collect()}
    assert rows == {1: "already_indexed", 2: "other_document", 3: "other_content", 4: "closed_version", 5: "index", 6: "other_document", 7: "other_content"}


def test_request_hash_keeps_null(spark):
    import hashlib

    row = spark.range(1).select(ids.request_hash(F.lit("abc"), F.lit("d"), F.lit("v"), F.lit('T "x"/ñ'), F.lit("y"), F.lit(None).cast("string")).alias("h")).first()
    body = 'abc{"documentId":"d","versionId":"v","title":"T \\"x\\"/ñ","academicYear":"y","description":null}'
    assert row.h == hashlib.sha256(body.encode()).hexdigest()


def test_ledger(spark):
    rows = ledger.ledger_rows(
        spark.createDataFrame([("j1", "completed", None, None, 2), ("j1", "embedding", None, None, 1), ("j2", "storing", "BAD code", "a\nb", 1)],
                              "job_id string, stage string, error_code string, error_message string, updated_at int")
    ).withColumn("document_id", F.lit("d")).withColumn("version_id", F.lit("v")).withColumn("completed_at", F.lit(None).cast("int"))
    asked = spark.createDataFrame([("j1",), ("j2",), ("j3",)], "job_id string")
    got = {r.job_id: (r.found, r.status, r.progress, r.error_code, r.error_message) for r in ledger.job_status(rows, asked).collect()}
    assert got == {"j1": (True, "completed", 100, None, None), "j2": (True, "failed", 85, "BAD_____", "a b"), "j3": (False, None, None, None, None)}


def test_diagnostics(spark, tmp_path):
    answers = spark.createDataFrame([(f"r{i}", "¿?", None if i % 2 else "sí", ["c1"]) for i in range(150)], "request_id string, question string, answer string, retrieved array<string>")
    path = str(tmp_path / "d")
    diagnostics.append_diagnostics(answers, path, F.lit(NOW))
    diagnostics.append_diagnostics(answers.limit(1), path, F.lit(NOW + datetime.timedelta(hours=1)))
    kept = spark.read.parquet(path)
    assert diagnostics.count_diagnostics(kept).first()["count"] == 151
    assert diagnostics.list_recent(kept, 500).count() == 100 and diagnostics.list_recent(kept, 3).count() == 3
    with pytest.raises(ValueError):
        diagnostics.list_recent(kept, 0)
    at = F.lit(NOW + datetime.timedelta(hours=24))
    assert diagnostics.purge_expired(kept, at).count() == 1
    assert diagnostics.purge_expired(kept, at - F.expr("interval 1 millisecond")).count() == 151
    assert tuple(diagnostics.delete_counts(kept, diagnostics.purge_expired(kept, at)).first()) == (150, 1)
    out = str(tmp_path / "lines")
    diagnostics.export_jsonl(kept, out, 20)
    lines = [json.loads(line) for name in sorted(os.listdir(out)) if name.endswith(".txt") for line in open(os.path.join(out, name))]
    assert len(lines) == 20 and lines[0]["createdAt"] == "2026-08-16T11:00:00.000Z" and lines[0]["retrievedChunkIds"] == ["c1"]
    assert [x["createdAt"] for x in lines] == sorted((x["createdAt"] for x in lines), reverse=True)


def test_instants_and_ids_from_json(spark):
    df = spark.createDataFrame([("2026-08-16T10:00:00.000Z",), ("nope",), ("2026-13-01T00:00:00Z",)], "s string")
    assert [r.t for r in df.select(fields.parse_iso_instant(F.col("s")).alias("t")).collect()] == [NOW, None, None]
    df = spark.createDataFrame([('["a","b"]',), ("[]",), ("[1]",), ('["a",null]',), ("{}",), ("x",)], "s string")
    assert [r.i for r in df.select(fields.chunk_ids_from_json(F.col("s")).alias("i")).collect()] == [["a", "b"], [], None, None, None, None]


def test_dedup_keeps_best_score_and_first_place(spark):
    hits = spark.createDataFrame([("q", "a", 0.5, 1, "x"), ("q", "b", 0.9, 2, "y"), ("q", "a", 0.8, 3, "z"), ("q", "a", 0.8, 4, "w")], "question_id string, point_id string, score double, pos int, text string")
    rows = answering.dedup_hits(hits).orderBy("pos").collect()
    assert [(r.point_id, r.score, r.pos, r.text) for r in rows] == [("a", 0.8, 1, "z"), ("b", 0.9, 2, "y")]


def test_evaluation(spark):
    citation = "array<struct<document_id:string,page:int>>"
    answers = spark.createDataFrame(
        [("a", "found", "x", [("d1", 1), ("d2", 3)]), ("b", "found", "x", [("d2", 1)]), ("c", "not_found", None, []), ("d", "ambiguous", None, []), ("e", "found", "x", [("d1", 1)])],
        f"question_id string, status string, answer string, citations {citation}",
    )
    questions = spark.createDataFrame(
        [("a", "found", ["d1"], [3]), ("b", "found", ["d1"], [1]), ("c", "not_found", [], []), ("d", "ambiguous", ["d1"], [1]), ("e", "not_found", [], []), ("f", "found", ["d1"], [1])],
        "question_id string, expected_status string, expected_document_ids array<string>, expected_pages array<int>",
    )
    evaluated = evaluation.evaluate(answers, questions)
    assert {r.question_id: (r.passed, r.pages_covered) for r in evaluated.collect()} == {
        "a": (True, True), "b": (False, True), "c": (True, True), "d": (True, False), "e": (False, True), "f": (False, False)
    }
    report = {r.expected_status: (r.questions, r.passed) for r in evaluation.eval_report(evaluated).collect()}
    assert report == {"found": (3, 1), "not_found": (2, 1), "ambiguous": (1, 1), None: (6, 3)}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path, schema = str(tmp_path / "points"), "point_id string, version_id string, text string"
    points = spark.createDataFrame([(f"p{v}-{k}", f"v{v}", "old") for v in range(12) for k in range(3)], schema)
    snapshots.write_snapshot(snapshots.with_bucket(points, 8), path, ["bucket"])

    def files():
        return {f for f in glob.glob(f"{path}/bucket=*/*.parquet")}

    before = files()
    incoming = spark.createDataFrame([("p3-0", "v3", "a", 1), ("p3-0", "v3", "new", 2), ("p3-9", "v3", "more", 1)], schema + ", seq int")
    touched = snapshots.upsert_into(path, incoming, "seq", 8)
    assert len(touched) == 1 and {f for f in before - files()} == {f for f in before if f"bucket={touched[0]}/" in f}
    rows = {r.point_id: r.text for r in spark.read.parquet(path).collect()}
    assert len(rows) == 37 and rows["p3-0"] == "new" and rows["p3-9"] == "more" and rows["p3-1"] == "old"
    for gone in ([f"v{v}" for v in range(5)], [f"v{v}" for v in range(11)], []):
        snapshots.delete_from(path, spark.createDataFrame([(v,) for v in gone], "version_id string"), 8)
    assert {r.version_id for r in spark.read.parquet(path).collect()} == {"v11"}


def test_source_names_are_those_of_the_files(spark, tmp_path):
    (tmp_path / "matrícula nueva.json").write_text(json.dumps({"institution": {"name": "x"}, "pages": [{"heading": "H", "paragraphs": ["p"]}]}))
    assert [r.source for r in corpus_json.read_sources(spark, str(tmp_path)).collect()] == ["matrícula nueva.json"]


def test_files_below_a_rule_are_not_opened(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-ok"), ("b.PDF", b"%PDF-" + b"x" * 50), ("c.txt", b"text")):
        (tmp_path / name).write_bytes(content)
    rows = {os.path.basename(r.path): (r.error_code, r.content is not None) for r in fs.read_files(spark, str(tmp_path), max_bytes=20).collect()}
    assert rows == {"a.pdf": (None, True), "b.PDF": ("PDF_TOO_LARGE", False), "c.txt": ("PDF_EXTENSION_INVALID", False)}


def test_paths_lose_their_scheme(spark):
    paths = ["file:/a/b.pdf", "file:///a/b.pdf", "store://host:80/a/b.pdf", "/a/b.pdf", "a:b/c.pdf"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select(fs.bare_path(F.col("path")).alias("p"))
    assert [r.p for r in df.collect()] == ["/a/b.pdf"] * 4 + ["a:b/c.pdf"]


def test_read_files_query_hashes_files_beyond_2_mib(spark, tmp_path):
    import hashlib

    from acervo.checks import CHECKS, Tables

    data = bytes(range(256)) * (3 << 12)
    (tmp_path / "large.parquet").write_bytes(data)
    (row,) = CHECKS["read_files"].build(Tables(spark, str(tmp_path))).collect()
    assert (row.length, row.error_code, row.content_hash) == (3 << 20, None, hashlib.sha256(data).hexdigest())


def test_a_failed_and_repeated_job_leaves_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "d")
    answers = spark.createDataFrame([(f"r{i}", "¿?", "sí", ["c1"]) for i in range(40)], "request_id string, question string, answer string, retrieved array<string>").repartition(4)
    broken = answers.withColumn("question", F.when(F.col("request_id") == "r7", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("question")))

    def held():
        return spark.read.parquet(path).groupBy("batch").count().collect()

    diagnostics.append_diagnostics(answers.limit(5), path, F.lit(NOW), batch=1)
    for rows, fails in ((broken, True), (answers, False), (answers, False), (broken, True)):
        if fails:
            with pytest.raises(Exception, match="lost"):
                diagnostics.append_diagnostics(rows, path, F.lit(NOW), batch=2)
        else:
            diagnostics.append_diagnostics(rows, path, F.lit(NOW), batch=2)
    assert sorted((r.batch, r["count"]) for r in held()) == [(1, 5), (2, 40)]
    rows = spark.createDataFrame([("j1", "completed", None, None), ("j2", "storing", "BAD", "x")], "job_id string, stage string, error_code string, error_message string")
    for _ in range(3):
        ledger.write_ledger(rows, str(tmp_path / "l"), "run-1")
    ledger.write_ledger(rows, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 4


def test_a_delete_is_counted_by_its_write(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("point_id"), (F.col("id") % 10).alias("version_id")).write.parquet(str(tmp_path / "p"))
    points = spark.read.parquet(str(tmp_path / "p"))
    gone = spark.createDataFrame([(3,), (4,), (4,), (77,)], "version_id long")
    assert diagnostics.delete_counted(points, gone, "version_id", str(tmp_path / "left")) == (200, 800)
    assert spark.read.parquet(str(tmp_path / "left")).where("version_id in (3, 4)").count() == 0
    assert diagnostics.delete_counted(points.where("false"), gone, "version_id", str(tmp_path / "none")) == (0, 0)


def test_a_large_ledger_is_filtered_by_the_batch(spark):
    known = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("idempotency_key"), F.lit("h").alias("request_hash"), F.concat(F.lit("j"), "id").alias("job_id"))
    for n, most in ((3, 40), (200, 260)):
        requests = spark.createDataFrame([(f"k{i * 7}", i, "h" if i % 2 else "other", f"new{i}") for i in range(n)] + [("fresh", n, "h", "f")], "idempotency_key string, seq long, request_hash string, job_id string")
        left = admission.known_keys(requests, known, large=True).count()
        assert n <= left <= most
        columns = ["idempotency_key", "seq", "outcome", "job_id"]
        large, plain = (admission.admit_requests(requests, known, large_ledger=flag).select(columns).collect() for flag in (True, False))
        assert sorted(large) == sorted(plain) and {r.outcome for r in large} == {"new", "replay", "conflict"}
    assert admission.known_keys(requests, known) is known


def test_text_files_of_a_key_hold_its_lines(spark, tmp_path):
    from acervo.checks.inputs import _text_files

    rows = spark.createDataFrame([(k, f"line {k}") for k in range(40)] + [(7, "line 0")], "k int, value string").repartition(3)
    out = str(tmp_path / "texts")
    paths = [r.path for r in _text_files(rows, out).collect()]
    # One file a key, and none that a commit of the driver has put there.
    assert len(paths) == 40 == len(glob.glob(f"{out}/**/*.txt", recursive=True))
    read = {r.path.split("k=")[1]: bytes(r.content) for r in fs.wanted_files(spark, spark.createDataFrame([(p,) for p in paths], "path string"), ext=".txt").collect()}
    assert read["7/part.txt"] == b"line 0\nline 7\n" and read["39/part.txt"] == b"line 39\n" and len(read) == 40


def test_large_tables_are_dealt_over_the_tasks_of_their_scan(spark, tmp_path):
    from acervo.checks.registry import Tables

    for folder, partitions in (("small", 1), ("large", 20)):
        spark.range(1000).withColumn("text", F.repeat(F.lit("x"), F.lit(100))).repartition(partitions).write.parquet(str(tmp_path / folder / "documents.parquet"))
    least, cost = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        dealt = {n: Tables(spark, str(tmp_path / n)).spread("documents") for n in ("small", "large")}
        assert {n: df.rdd.getNumPartitions() for n, df in dealt.items()} == {"small": least, "large": max(least, 20)}
        assert dealt["large"].count() == 1000
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
