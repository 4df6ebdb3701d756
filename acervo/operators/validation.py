"""Rules over requests, questions, pages, points, decisions and failures.

Rules are columns: each row keeps its first failing code, so accepted and
rejected rows are two filters over one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions import ids
from acervo.functions import text as tx
from acervo.functions.fields import is_string_array, parse_model_json

# --- fixed values -----------------------------------------------------------
TITLE_LENGTH = (1, 200)
DESCRIPTION_LENGTH = (0, 1000)
QUESTION_LENGTH = (1, 1000)
PDF_MIME = "application/pdf"
EXTRACTION_CODES = (
    "PDF_SIGNATURE_INVALID", "PDF_CORRUPT", "PDF_ENCRYPTED", "PDF_PARSE_FAILED",
    "PDF_METADATA_INVALID", "PDF_TEXT_NOT_FOUND",
)
CHUNKING_CODES = ("PDF_PAGE_METADATA_INVALID", "PDF_CHUNK_EMPTY")
VECTOR_CODES = ("VECTOR_DIMENSION_MISMATCH", "VECTOR_PAYLOAD_INVALID")
TRANSIENT_NAMES = ("AbortError", "TimeoutError")
TRANSIENT_CODES = ("ECONNREFUSED", "ECONNRESET", "ETIMEDOUT", "EAI_AGAIN", "EPIPE", "ENOTFOUND")
STATES = ("INDEXING", "READY", "ACTIVE", "FAILED", "ARCHIVED")
ANSWER_STATUSES = ("found", "not_found", "ambiguous")
# ----------------------------------------------------------------------------


def _given(col: Column) -> Column:
    return F.coalesce(tx.trimmed(col) != "", F.lit(False))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests in canonical form with ``error_code`` of the first rule they break.

    Columns read: idempotency_key, document_id, version_id, title,
    academic_year, description, file_name, mime_type.
    """
    c = F.col
    canonical = requests.select(
        *[
            c(n)
            for n in requests.columns
            if n not in ("idempotency_key", "document_id", "version_id", "title", "academic_year", "description")
        ],
        tx.trimmed(c("idempotency_key")).alias("idempotency_key"),
        ids.canonical_uuid(c("document_id")).alias("document_id"),
        ids.canonical_uuid(c("version_id")).alias("version_id"),
        tx.canonical_text(c("title"), *TITLE_LENGTH).alias("title"),
        tx.trimmed(c("academic_year")).alias("academic_year"),
        c("description").alias("_given_description"),
        tx.canonical_text(c("description"), *DESCRIPTION_LENGTH).alias("description"),
    )
    metadata_ok = (
        c("document_id").isNotNull()
        & c("version_id").isNotNull()
        & c("title").isNotNull()
        & ids.academic_year_shape(c("academic_year"))
        & (c("_given_description").isNull() | c("description").isNotNull())
    )
    code = (
        F.when(~_given(c("idempotency_key")), F.lit("IDEMPOTENCY_KEY_REQUIRED"))
        .when(~ids.valid_idempotency_key(c("idempotency_key")), F.lit("IDEMPOTENCY_KEY_INVALID"))
        .when(~metadata_ok, F.lit("INDEXING_METADATA_INVALID"))
        .when(c("file_name").isNull(), F.lit("PDF_REQUIRED"))
        .when(~F.lower(c("file_name")).rlike(r"[^/]\.pdf\z"), F.lit("PDF_EXTENSION_INVALID"))
        .when(~F.coalesce(c("mime_type") == PDF_MIME, F.lit(False)), F.lit("PDF_MIME_INVALID"))
        .when(~ids.academic_year_follows(c("academic_year")), F.lit("INDEXING_METADATA_INVALID"))
    )
    return (
        canonical.withColumn("error_code", code)
        .withColumn("description", F.nullif(c("description"), F.lit("")))
        .drop("_given_description")
    )


def validate_questions(questions: DataFrame) -> DataFrame:
    """Canonical questions; invalid ones are kept with ``QUESTION_INVALID``."""
    text = tx.canonical_text(F.col("question"), *QUESTION_LENGTH)
    return questions.withColumn("question", text).withColumn(
        "error_code", F.when(F.col("question").isNull(), F.lit("QUESTION_INVALID"))
    )


def payload_ok() -> Column:
    """The rule for the payload columns of a point."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name) != "", F.lit(False))

    rule = F.coalesce(F.col("page") >= 1, F.lit(False)) & F.coalesce(F.col("chunk_index") >= 0, F.lit(False))
    for name in ("document_id", "version_id", "document_title", "academic_year", "content_hash", "text"):
        rule = rule & filled(name)
    return rule


def validate_payload(points: DataFrame) -> DataFrame:
    return points.withColumn("error_code", F.when(~payload_ok(), F.lit("VECTOR_PAYLOAD_INVALID")))


def validate_pages(pages: DataFrame) -> DataFrame:
    """Versions with a page number below 1, missing, or used twice."""
    used = pages.groupBy("version_id", "page").agg(F.count("*").alias("n"))
    bad = F.coalesce(F.col("page") < 1, F.lit(True)) | (F.col("n") > 1)
    return (
        used.where(bad)
        .groupBy("version_id")
        .agg(F.count("*").alias("bad_pages"))
        .withColumn("error_code", F.lit("PDF_PAGE_METADATA_INVALID"))
    )


def extractable_totals(pages: DataFrame) -> DataFrame:
    """Extractable characters per version, and the code when there are too few."""
    totals = pages.groupBy("version_id").agg(F.sum(tx.extractable_chars(F.col("text"))).alias("chars"))
    return totals.withColumn(
        "error_code", F.when(F.col("chars") < tx.MIN_EXTRACTED_CHARACTERS, F.lit("PDF_TEXT_NOT_FOUND"))
    )


def version_scope(versions: DataFrame, kind: str) -> DataFrame:
    """Versions a question may see (searchable), a preview may see, or that keep vectors (retained)."""
    states = {"searchable": ["ACTIVE"], "previewable": ["READY", "ACTIVE"], "retained": ["INDEXING", "READY", "ACTIVE"]}
    return versions.where(F.col("state").isin(*states[kind]))


def score_filter(hits: DataFrame, threshold: float = 0.35) -> DataFrame:
    return hits.where(F.col("score") >= threshold)


def decision_fields(value: Column) -> dict[str, Column]:
    """Typed fields of a parsed model reply; each is null unless it has the right JSON type."""
    cited = F.try_variant_get(value, "$.citedChunkIds", "variant")
    answer = F.try_variant_get(value, "$.answer", "variant")
    status = F.try_variant_get(value, "$.status", "variant")
    return {
        "status": F.when(F.schema_of_variant(status) == "STRING", F.try_variant_get(value, "$.status", "string")),
        "answer": F.when(F.schema_of_variant(answer) == "STRING", F.try_variant_get(value, "$.answer", "string")),
        "answer_is_null": F.coalesce(F.is_variant_null(answer), F.lit(False)),
        "cited": F.when(is_string_array(cited), F.try_variant_get(cited, "$", "array<string>")),
    }


def validate_decisions(decisions: DataFrame) -> DataFrame:
    """Checks raw replies (``raw``) against the retrieved ids (``retrieved``) of their question.

    found needs an answer and at least one citation, all of them retrieved;
    the other statuses need a null answer and no citation.
    """
    fields = decision_fields(F.col("_value"))
    parsed = decisions.withColumn("_value", parse_model_json(F.col("raw")))
    typed = parsed.select(*decisions.columns, *[col.alias(f"_{name}") for name, col in fields.items()])
    none_unknown = F.size(F.array_except("_cited", F.coalesce("retrieved", F.array().cast("array<string>")))) == 0
    found = (F.col("_status") == "found") & (F.col("_answer") != "") & (F.size("_cited") >= 1) & none_unknown
    other = F.col("_status").isin("not_found", "ambiguous") & F.col("_answer_is_null") & (F.size("_cited") == 0)
    ok = F.coalesce(found | other, F.lit(False))
    return typed.select(
        *decisions.columns,
        F.when(ok, F.col("_status")).alias("status"),
        F.when(ok, F.col("_answer")).alias("answer"),
        F.when(ok, F.col("_cited")).alias("cited_chunk_ids"),
        F.when(~ok, F.lit("MODEL_OUTPUT_INVALID")).alias("error_code"),
    )


def classify_failure(failures: DataFrame) -> DataFrame:
    """Public error code of a failure from its own code and the stage it happened in."""
    own = F.col("raw_code").isin(*EXTRACTION_CODES, *CHUNKING_CODES, *VECTOR_CODES)
    code = (
        F.when(own, F.col("raw_code"))
        .when(F.col("stage") == "embedding", F.lit("EMBEDDING_GENERATION_FAILED"))
        .when(F.col("stage") == "storing", F.lit("VECTOR_STORE_UNAVAILABLE"))
        .otherwise(F.lit("INDEXING_FAILED"))
    )
    return failures.withColumn("error_code", code)


def is_transient(name: Column, code: Column, status: Column) -> Column:
    """A dependency failure worth another attempt."""
    return F.coalesce(
        name.isin(*TRANSIENT_NAMES) | code.isin(*TRANSIENT_CODES) | (status == 429) | (status >= 500),
        name.isin(*TRANSIENT_NAMES),
        code.isin(*TRANSIENT_CODES),
        (status == 429) | (status >= 500),
        F.lit(False),
    )


def is_transient_error(error: Column) -> Column:
    """As ``is_transient``, over a struct that may hold one level of cause."""
    own = is_transient(error["name"], error["code"], error["status"])
    cause = error["cause"]
    return own | is_transient(cause["name"], cause["code"], cause["status"])


def duplicate_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def active_uniqueness_violations(versions: DataFrame) -> DataFrame:
    """Documents with more than one active version."""
    return duplicate_keys(versions.where(F.col("state") == "ACTIVE"), ["document_id"])
