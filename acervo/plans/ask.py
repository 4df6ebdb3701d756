"""Answering batches of questions, and previews of candidate versions."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions.vectors import Embedder
from acervo.operators import answering, diagnostics, lifecycle, models, retrieval, validation
from acervo.session import cut_lineage
from acervo.sources.appends import append_once

ANSWER_COLUMNS = ("question_id", "question", "status", "answer", "citations", "retrieved", "error_code")


def embed_questions(questions: DataFrame, embedder: Callable[[], Embedder], dims: int | None = None) -> DataFrame:
    """Questions with their vectors, written once: both the search and the answers read them."""
    return cut_lineage(models.embed_documents(questions, embedder, text_column="question", dims=dims))


def _answers(questions: DataFrame, hits: DataFrame, decider) -> DataFrame:
    """Answers for checked questions from their ranked hits with payload."""
    # A point id that the points hold more than once counts once, at its best score.
    once = answering.dedup_hits(hits.withColumn("pos", F.col("rank")).drop("rank")).withColumnRenamed("pos", "rank")
    contexts = answering.assemble_context(once)
    # Only questions with hits go to the decider; all others are not found.
    asked = contexts.join(questions.select("question_id", "question"), "question_id")
    if decider is None:
        decided = validation.validate_decisions(answering.lexical_decider(asked))
    else:
        message = answering.context_message(F.col("question"), F.col("context"))
        decided = models.decide(asked.withColumn("message", message), decider).drop("message")
    cited = answering.build_citations(decided).select(
        "question_id", "status", "answer", "citations", "retrieved", F.col("error_code").alias("decision_error")
    )
    no_citations = F.array().cast(cited.schema["citations"].dataType)
    c = F.col
    bad_question = c("error_code").isNotNull()
    error = F.coalesce("error_code", "embed_error", "decision_error")
    return (
        questions.join(cited, "question_id", "left")
        .withColumn("_error", error)
        .select(
            "question_id",
            "question",
            F.when(c("_error").isNotNull(), F.lit("error")).otherwise(F.coalesce("status", F.lit("not_found"))).alias("status"),
            F.when(c("_error").isNull() & ~bad_question, c("answer")).alias("answer"),
            F.coalesce(F.when(c("_error").isNull(), c("citations")), no_citations).alias("citations"),
            F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"),
            c("_error").alias("error_code"),
        )
    )


def ask_diagnostics(answers: DataFrame, as_of: Column, ttl_hours: int = diagnostics.TTL_HOURS) -> DataFrame:
    """Diagnostics entries of answered questions; those that ended in an error have none."""
    answered = answers.where(F.col("error_code").isNull())
    return diagnostics.diagnostics_rows(answered.withColumnRenamed("question_id", "request_id"), as_of, ttl_hours)


def record(answers: DataFrame, path: str, as_of: Column, ttl_hours: int = diagnostics.TTL_HOURS, batch: str | int | None = None) -> bool:
    """Add the diagnostics of written answers, once per job; a failure is told in the log and by the result, and fails no answer."""
    try:
        append_once(ask_diagnostics(answers, as_of, ttl_hours), path, batch)
        return True
    except Exception:
        logging.getLogger(__name__).exception("diagnostics were not recorded")
        return False


def ask(
    questions: DataFrame,
    points: DataFrame,
    versions: DataFrame,
    embedder: Callable[[], Embedder],
    decider=None,
    k: int = retrieval.TOP_K,
    threshold: float = retrieval.THRESHOLD,
    dims: int | None = None,
) -> DataFrame:
    """Grounded answers for a table of questions (question_id, question).

    Searches the points of active versions only. Without a decider the lexical
    one decides. Every question gives one row; invalid ones carry an error.
    """
    checked = validation.validate_questions(questions)
    valid = checked.where(F.col("error_code").isNull())
    embedded = embed_questions(valid, embedder, dims)
    scoped = retrieval.search_scope(points, validation.version_scope(versions, "searchable"))
    asked = embedded.where(F.col("vector").isNotNull())
    hits = retrieval.vector_topk(asked, scoped, k, threshold)
    full = retrieval.with_payload(hits, scoped)
    everything = embedded.drop("vector").unionByName(
        checked.where(F.col("error_code").isNotNull()).withColumn("embed_error", F.lit(None).cast("string"))
    )
    return _answers(everything, full, decider)


def preview(
    questions: DataFrame,
    candidates: DataFrame,
    points: DataFrame,
    versions: DataFrame,
    embedder: Callable[[], Embedder],
    decider=None,
    k: int = retrieval.TOP_K,
    threshold: float = retrieval.THRESHOLD,
    dims: int | None = None,
) -> DataFrame:
    """Answers as they would be with a candidate version live; nothing is changed.

    ``questions``: question_id, question, document_id, version_id, where the
    candidate is that version of that document; ``candidates`` lists those
    pairs once each. A question sees its candidate and the active versions of
    all other documents.
    """
    scopes = lifecycle.preview_scope(candidates, versions)
    scoped_questions = questions.join(scopes, ["document_id", "version_id"], "left").withColumnRenamed(
        "error_code", "scope_error"
    )
    checked = validation.validate_questions(scoped_questions).withColumn(
        "error_code", F.coalesce("error_code", "scope_error")
    )
    keep = ["question_id", "question", "version_id", "hidden_version_id", "error_code"]
    valid = checked.where(F.col("error_code").isNull()).select(*keep)
    embedded = embed_questions(valid, embedder, dims)
    live = versions.select("version_id", (F.col("state") == "ACTIVE").alias("shared"), "state")
    visible = live.join(candidates.select("version_id").distinct().withColumn("asked", F.lit(True)), "version_id", "left")
    visible = visible.where(F.col("shared") | (F.col("asked") & (F.col("state") == "READY"))).select("version_id", "shared")
    scoped = points.join(visible, "version_id")
    asked = embedded.where(F.col("vector").isNotNull()).select(
        "question_id",
        "vector",
        F.col("version_id").alias("own_version_id"),
        # A question without a hidden sibling hides nothing: its own version is always seen.
        F.coalesce("hidden_version_id", "version_id").alias("hidden_version_id"),
    )
    hits = retrieval.vector_topk(asked, scoped, k, threshold)
    full = retrieval.with_payload(hits, scoped)
    everything = embedded.drop("vector").unionByName(
        checked.where(F.col("error_code").isNotNull()).select(*keep).withColumn("embed_error", F.lit(None).cast("string"))
    )
    return _answers(everything.drop("version_id", "hidden_version_id"), full, decider)
