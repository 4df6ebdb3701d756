"""Ingesting files: from requests and bytes to points, versions and ledger rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.ids import request_hash
from acervo.functions.vectors import Embedder
from acervo.operators import admission, chunking, models, validation
from acervo.session import cut_lineage
from acervo.sources import files as fs
from acervo.sources.ledger import ledger_rows
from acervo.sources.snapshots import last_per_key, upsert_documents, upsert_points


@dataclass
class Ingested:
    """Results of one ingest batch. All are tables; no store has been changed."""

    points: DataFrame  # embedded chunks of the versions that succeeded, one row per point id
    versions: DataFrame  # one row per indexed version with its new state
    ledger: DataFrame  # one row per request
    documents: DataFrame  # documents as they are after the batch
    all_points: DataFrame  # points as they are after the batch


DOCUMENTS = "document_id string, title string, description string, created_at timestamp, updated_at timestamp"

Files = DataFrame | Callable[[DataFrame], DataFrame]


def checked_files(files: DataFrame, max_bytes: int = fs.MAX_FILE_BYTES) -> DataFrame:
    """Files (path, length, content) with the code of the rule they break, if any."""
    return fs.check_signature(fs.accept_files(files, max_bytes))


def scanned(files: Files, requests: DataFrame, loader: fs.Loader, max_bytes: int) -> DataFrame:
    """(path, content_hash, file_error, pages, error_code): each file is opened once, hashed and read in the task that opened it.

    Only the hash, the pages and the error leave that task. ``files`` may be a
    function of the requested paths, so that it opens no other files.
    """
    given = files if isinstance(files, DataFrame) else files(requests.select("path").distinct())
    marked = fs.hash_content(checked_files(given, max_bytes)).withColumn("file_error", F.col("error_code"))
    return fs.extract_pages(marked, loader, ("path", "content_hash", "file_error"))


def admit(requests: DataFrame, hashed: DataFrame, ledger: DataFrame, versions: DataFrame) -> DataFrame:
    """Requests joined to their file's hash and classified.

    ``hashed``: path, content_hash, file_error. Of several new requests for one
    version the earliest does the work (ownership ``index``); the others are
    ``already_indexed`` and share its outcome.
    """
    checked = validation.validate_requests(requests).withColumn("_file", fs.bare_path(F.col("path")))
    by_file = hashed.select(fs.bare_path(F.col("path")).alias("_file"), "content_hash", "file_error")
    # Accepted and rejected rows part below; written first, so that they are joined once.
    joined = cut_lineage(
        checked.join(by_file, "_file", "left")
        .withColumn(
            "error_code",
            F.coalesce("error_code", "file_error", F.when(F.col("content_hash").isNull(), F.lit("PDF_REQUIRED"))),
        )
        .drop("file_error", "_file")
    )
    valid = joined.where(F.col("error_code").isNull()).withColumn(
        "request_hash",
        request_hash(
            F.col("content_hash"), F.col("document_id"), F.col("version_id"), F.col("title"),
            F.col("academic_year"), F.col("description"),
        ),
    )
    admitted = admission.admit_requests(valid, ledger)
    owned = admission.check_version_ownership(admitted.where(F.col("outcome") == "new"), versions)
    workers = owned.where(F.col("ownership") == "index").groupBy("version_id").agg(F.min("seq").alias("_worker"))
    later = (F.col("ownership") == "index") & (F.col("seq") != F.col("_worker"))
    fresh = (
        owned.join(workers, "version_id", "left")
        .withColumn("ownership", F.when(later, F.lit("already_indexed")).otherwise(F.col("ownership")))
        .drop("_worker")
    )
    others = admitted.where(F.col("outcome") != "new").withColumn("ownership", F.lit(None).cast("string"))
    rejected = (
        joined.where(F.col("error_code").isNotNull())
        .withColumn("request_hash", F.lit(None).cast("string"))
        .withColumn("outcome", F.lit("rejected"))
        .withColumn("ownership", F.lit(None).cast("string"))
    )
    every = fresh.unionByName(others).unionByName(rejected)
    conflict = F.col("ownership").isin("other_document", "other_content", "closed_version")
    return every.withColumn(
        "error_code", F.coalesce("error_code", F.when(conflict, F.lit("VERSION_CONFLICT")))
    ).withColumn("outcome", F.when(conflict, F.lit("conflict")).otherwise(F.col("outcome")))


def ingest(
    requests: DataFrame,
    files: Files,
    ledger: DataFrame,
    versions: DataFrame,
    embedder: Callable[[], Embedder],
    loader: fs.Loader = fs.form_feed_pages,
    dims: int | None = None,
    max_bytes: int = fs.MAX_FILE_BYTES,
    documents: DataFrame | None = None,
    points: DataFrame | None = None,
    as_of: Column | None = None,
) -> Ingested:
    """One batch from requests to points, and to the documents and points after it.

    Each document fails alone: a file that cannot be read, holds too little
    text or cannot be embedded gives a FAILED version and no points, and the
    others go on. Scanned files, admissions and embedded chunks are written to
    the shared checkpoint folder once, since versions, points and ledger all
    read them and neither loader nor model should run twice.

    ``documents`` and ``points`` are the tables before the batch; admitted
    requests, the last of a document by ``seq``, set its title and description
    at the instant ``as_of``.
    """
    c = F.col
    read = cut_lineage(scanned(files, requests, loader, max_bytes))
    admitted = cut_lineage(admit(requests, read.select("path", "content_hash", "file_error"), ledger, versions))
    work = admitted.where((c("outcome") == "new") & (c("ownership") == "index")).withColumn("_file", fs.bare_path(c("path")))
    pages = read.select(fs.bare_path(c("path")).alias("_file"), "pages", "error_code")
    texts = work.select(
        "_file", "job_id", "document_id", "version_id", c("title").alias("document_title"), "academic_year",
        c("content_hash").alias("file_hash"),
    ).join(pages, "_file").drop("_file")
    readable = texts.where(c("error_code").isNull())
    chunks = chunking.chunk_versions(readable, normalized=True)
    embedded = cut_lineage(models.embed_documents(chunks.where(c("error_code").isNull()), embedder, dims=dims, document_column="version_id"))
    # Few versions, if any: written, so that a join with them knows it and moves no points.
    broken = cut_lineage(embedded.where(c("embed_error").isNotNull()).groupBy("version_id").agg(F.min("embed_error").alias("stage_error")))
    stored = embedded.groupBy("version_id").agg(F.count("*").alias("chunks"))
    results = (
        work.select("document_id", "version_id", "academic_year", "content_hash", "_file")
        .join(pages.select("_file", c("error_code").alias("page_error")), "_file", "left")
        .join(broken, "version_id", "left")
        .join(stored, "version_id", "left")
        .withColumn(
            "error_code",
            F.coalesce(
                F.when(c("page_error").isNull() & c("chunks").isNull(), F.lit("PDF_CHUNK_EMPTY")), "page_error", "stage_error"
            ),
        )
    )
    failed = c("error_code").isNotNull()
    outcomes = results.select(
        "version_id",
        c("error_code").alias("work_error"),
        F.when(~failed, F.lit("completed"))
        .when(c("page_error").isNotNull(), F.lit("extracting"))
        .when(c("stage_error").isNotNull(), F.lit("embedding"))
        .otherwise(F.lit("chunking"))
        .alias("stage"),
        F.lit("new").alias("outcome"),
    )
    # The worker of a version and those that share its outcome meet it by version.
    rows = admitted.select(
        "job_id", "idempotency_key", "request_hash", "content_hash", "outcome", "ownership",
        "document_id", "version_id", c("error_code").alias("admission_error"),
    ).join(outcomes, ["version_id", "outcome"], "left")
    done = c("ownership") == "already_indexed"
    ledger_out = ledger_rows(
        rows.withColumn("error_code", F.coalesce("admission_error", "work_error"))
        .withColumn("stage", F.coalesce("stage", F.when(done, F.lit("completed")).otherwise(F.lit("queued"))))
        .withColumn("error_message", c("error_code"))
        .drop("admission_error", "work_error")
    )
    new_points = embedded.join(broken, "version_id", "left_anti").drop("error_code", "embed_error")
    known = documents if documents is not None else requests.sparkSession.createDataFrame([], DOCUMENTS)
    named = admitted.where(c("outcome") == "new").select("document_id", "seq", "title", "description")
    incoming = last_per_key(named, ["document_id"], c("seq")).drop("seq").withColumn("updated_at", F.current_timestamp() if as_of is None else as_of)
    return Ingested(
        points=new_points,
        versions=results.select(
            "version_id", "document_id", "academic_year", "content_hash",
            F.when(failed, F.lit("FAILED")).otherwise(F.lit("READY")).alias("state"), "error_code",
        ),
        ledger=ledger_out,
        documents=upsert_documents(known, incoming),
        all_points=new_points if points is None else upsert_points(points, new_points.withColumn("_order", c("chunk_index")), "_order", written=True),
    )
