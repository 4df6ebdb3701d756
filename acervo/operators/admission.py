"""Idempotent admission of index requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.functions.bloom import might_contain
from acervo.sources.snapshots import first_per_key


# Bytes from which a ledger is filtered by the requests' keys before it is shuffled.
LARGE_LEDGER = 256 << 20


def known_keys(requests: DataFrame, ledger: DataFrame, large: bool | None = None) -> DataFrame:
    """The ledger without most of what no request names: a Bloom filter of the requests' keys on its scan.

    ``large`` says whether the ledger is worth that; without it, Spark's own
    estimate of its size does.
    """
    if large is None:
        estimate = int(str(ledger._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        # Spark gives rows of unknown size the largest number there is.
        large = LARGE_LEDGER < estimate < 1 << 60
    return ledger.where(might_contain(requests, "idempotency_key", F.col("idempotency_key"))) if large else ledger


def admit_requests(requests: DataFrame, ledger: DataFrame, order: str = "seq", large_ledger: bool | None = None) -> DataFrame:
    """Classifies requests as new, replay or conflict.

    The first request of a key decides: the ledger's entry if there is one,
    else the earliest of the batch. Requests repeating its hash are replays of
    its job, others conflict. The earliest per key is an aggregate, so a key
    repeated very often collapses before the shuffle; the join back has one row
    per key on its right side, which AQE can split on the left.
    """
    known = known_keys(requests, ledger, large_ledger).groupBy("idempotency_key").agg(
        F.min_by(F.struct("request_hash", "job_id"), F.col("job_id")).alias("known")
    )
    first = first_per_key(
        requests.select("idempotency_key", order, "request_hash", "job_id"), ["idempotency_key"], F.col(order)
    )
    owner = first.join(known, "idempotency_key", "left").select(
        "idempotency_key",
        F.coalesce(F.col("known.request_hash"), F.col("request_hash")).alias("owner_hash"),
        F.coalesce(F.col("known.job_id"), F.col("job_id")).alias("owner_job_id"),
        F.when(F.col("known").isNull(), F.col(order)).alias("owner_order"),
    )
    outcome = (
        F.when(F.col(order) == F.col("owner_order"), F.lit("new"))
        .when(F.col("request_hash") == F.col("owner_hash"), F.lit("replay"))
        .otherwise(F.lit("conflict"))
    )
    return (
        requests.join(owner, "idempotency_key")
        .withColumn("outcome", outcome)
        .withColumn("job_id", F.when(F.col("outcome") != "conflict", F.col("owner_job_id")))
        .withColumn("error_code", F.when(F.col("outcome") == "conflict", F.lit("IDEMPOTENCY_CONFLICT")))
        .drop("owner_hash", "owner_job_id", "owner_order")
    )


def check_version_ownership(requests: DataFrame, versions: DataFrame, order: str = "seq") -> DataFrame:
    """Marks requests whose version is another document's or has other content.

    A version seen for the first time in the batch belongs to its earliest
    request. A version that is READY or ACTIVE with the same content is not
    indexed again; FAILED and ARCHIVED ones need a new version id.
    """
    known = versions.select(
        "version_id",
        F.struct("document_id", "content_hash", "state").alias("known"),
    )
    first = first_per_key(
        requests.select("version_id", order, "document_id", "content_hash"), ["version_id"], F.col(order)
    )
    owner = first.join(known, "version_id", "left").select(
        "version_id",
        F.coalesce(F.col("known.document_id"), F.col("document_id")).alias("owner_document"),
        F.coalesce(F.col("known.content_hash"), F.col("content_hash")).alias("owner_hash"),
        F.col("known.state").alias("known_state"),
    )
    outcome = (
        F.when(F.col("document_id") != F.col("owner_document"), F.lit("other_document"))
        .when(F.col("content_hash") != F.col("owner_hash"), F.lit("other_content"))
        .when(F.col("known_state").isin("READY", "ACTIVE"), F.lit("already_indexed"))
        .when(F.col("known_state").isin("FAILED", "ARCHIVED"), F.lit("closed_version"))
        .otherwise(F.lit("index"))
    )
    return (
        requests.join(owner, "version_id")
        .withColumn("ownership", outcome)
        .drop("owner_document", "owner_hash", "known_state")
    )
