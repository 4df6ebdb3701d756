import contextlib
import io

from pyspark.sql import functions as F

from acervo.functions.vectors import hash_embedder
from acervo.plans import ingest as plan
from acervo.sources import files as fs
from tests.test_audit import uuid

REQUESTS = (
    "seq long, job_id string, idempotency_key string, document_id string, version_id string, title string, academic_year string, "
    "description string, file_name string, mime_type string, path string"
)
LEDGER = "idempotency_key string, request_hash string, job_id string"
VERSIONS = "version_id string, document_id string, academic_year string, content_hash string, state string"


def request(n, version, path, document=1, title="Título"):
    return (n, f"j{n}", f"key-{n}", uuid(document), uuid(version), title, "2026-2027", None, "a.pdf", "application/pdf", path)


def corpus(tmp_path):
    for name, text in (("a", "Texto suficiente para una hoja."), ("b", "Otro texto suficiente, distinto."), ("other", "Nadie pide este texto.")):
        (tmp_path / f"{name}.pdf").write_bytes(b"%PDF-\n" + text.encode())
    return str(tmp_path)


def test_one_request_of_a_version_works_and_others_share_its_outcome(spark, tmp_path):
    folder = corpus(tmp_path)
    rows = [
        request(1, 11, f"{folder}/a.pdf", title="Viejo"), request(2, 11, f"{folder}/a.pdf"), request(3, 12, f"file:{folder}/b.pdf", 2),
        request(4, 13, f"{folder}/none.pdf", 3), request(5, 11, f"{folder}/b.pdf"),
    ]
    requests = spark.createDataFrame(rows, REQUESTS)
    empty = spark.createDataFrame([], LEDGER), spark.createDataFrame([], VERSIONS)
    opened = []

    def wanted(paths):
        files = fs.read_wanted(spark, paths)
        opened.extend(r.path.rsplit("/", 1)[1] for r in files.select("path").collect())
        return files

    at = F.lit("2026-01-01").cast("timestamp")
    known = spark.createDataFrame([(uuid(1), "Antes", "d", None, None)], plan.DOCUMENTS)
    done = plan.ingest(requests, wanted, *empty, hash_embedder(8), dims=8, documents=known, as_of=at)
    assert sorted(opened) == ["a.pdf", "b.pdf"]
    points = [r.point_id for r in done.points.collect()]
    assert len(points) == len(set(points)) == 2
    assert sorted((r.version_id, r.state) for r in done.versions.collect()) == [(uuid(11), "READY"), (uuid(12), "READY")]
    assert {r.idempotency_key: (r.outcome, r.ownership, r.status, r.error_code) for r in done.ledger.collect()} == {
        "key-1": ("new", "index", "completed", None), "key-2": ("new", "already_indexed", "completed", None), "key-3": ("new", "index", "completed", None),
        "key-4": ("rejected", None, "failed", "PDF_REQUIRED"), "key-5": ("conflict", "other_content", "failed", "VERSION_CONFLICT"),
    }
    assert sorted((r.document_id, r.title) for r in done.documents.collect()) == [(uuid(1), "Título"), (uuid(2), "Título")]


def test_a_failed_worker_fails_those_that_share_it(spark):
    files = spark.createDataFrame([("/a.pdf", bytearray(b"%PDF-\nx"))], "path string, content binary").withColumn("length", F.lit(7))
    requests = spark.createDataFrame([request(1, 11, "/a.pdf"), request(2, 11, "/a.pdf")], REQUESTS)
    done = plan.ingest(requests, files, spark.createDataFrame([], LEDGER), spark.createDataFrame([], VERSIONS), hash_embedder(8), dims=8)
    assert [(r.status, r.stage, r.error_code) for r in done.ledger.collect()] == [("failed", "extracting", "PDF_TEXT_NOT_FOUND")] * 2
    assert done.points.count() == 0


def test_content_is_never_shuffled(spark, tmp_path):
    files = fs.read_files(spark, corpus(tmp_path))
    requests = spark.createDataFrame([request(1, 11, "/a.pdf")], REQUESTS)
    scanned = plan.scanned(files, requests, fs.form_feed_pages, fs.MAX_FILE_BYTES)
    with contextlib.redirect_stdout(io.StringIO()) as told:
        scanned.explain()
    assert "Exchange" not in told.getvalue() and "binaryFile" in told.getvalue()
    assert "content" not in scanned.columns
