"""The ingest ledger: outcomes of ingest jobs and their public status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.fields import progress_for
from acervo.functions.text import sanitize_code, sanitize_message
from acervo.sources.appends import append_once
from acervo.sources.snapshots import last_per_key

STATUS_COLUMNS = (
    "job_id", "document_id", "version_id", "status", "progress", "stage",
    "error_code", "error_message", "completed_at",
)


def ledger_rows(outcomes: DataFrame) -> DataFrame:
    """Ledger entries: progress from the stage, failure details bounded and cleaned."""
    failed = F.col("error_code").isNotNull()
    return (
        outcomes.withColumn(
            "status",
            F.when(failed, F.lit("failed"))
            .when(F.col("stage") == "completed", F.lit("completed"))
            .when(F.col("stage") == "queued", F.lit("queued"))
            .otherwise(F.lit("processing")),
        )
        .withColumn("progress", progress_for(F.col("stage")))
        .withColumn("error_code", F.when(failed, sanitize_code(F.col("error_code"))))
        .withColumn("error_message", F.when(failed, sanitize_message(F.col("error_message"))))
    )


def write_ledger(outcomes: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Adds the entries of a job named ``batch``; repeating the job adds none twice."""
    append_once(ledger_rows(outcomes), path, batch)


def job_status(ledger: DataFrame, ids: DataFrame, order: str = "updated_at") -> DataFrame:
    """Latest public status of each asked-for job; ``found`` is false for unknown ids."""
    asked = ids.select("job_id").distinct()
    wanted = ledger.join(asked, "job_id", "left_semi")
    latest = last_per_key(wanted, ["job_id"], F.col(order)).select(*STATUS_COLUMNS)
    return lookup(latest, asked, "job_id")


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a table with a unique key, for a table of keys; absent keys are kept, not found."""
    marked = table.withColumn("found", F.lit(True))
    return keys.join(marked, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def pending_in_order(ledger: DataFrame, n: int, max_attempts: int = 3) -> DataFrame:
    """The next jobs to admit, oldest first, leaving out those tried too often."""
    waiting = ledger.where((F.col("status") == "queued") & (F.col("attempts") < max_attempts))
    return waiting.orderBy("created_at", "job_id").limit(n)


def purges_in_order(queue: DataFrame, as_of, n: int) -> DataFrame:
    """The next purge entries that are due, in the order they became available."""
    due = queue.where((F.col("status") == "queued") & (F.col("available_at") <= as_of))
    return due.orderBy("available_at", "created_at", "version_id").limit(n)


def ingest_summary(ledger: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    return ledger.agg(
        F.count("*").alias("total"), done.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed")
    )
