"""Keyed state over request and command streams, kept as tables that each trigger reads and adds to.

A trigger runs the batch operators against what earlier triggers left, so a key
with very many rows in one trigger is aggregated and spread as in a batch, and
no worker holds the rows of a key. Each trigger writes to folders named by its
batch id and replaces them when it is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegralType

from acervo.operators import admission, lifecycle
from acervo.session import cut_lineage
from acervo.streaming.batches import LEDGER_KEYS, read_or_empty, start
from acervo.streaming.state import KeyedState

OWNERS = "version_id string, document_id string"
STATES = "document_id string, version_id string, state string"


def admit_stream(requests: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Admission outcomes for a stream of idempotency_key, seq, request_hash, job_id, in the table at ``path``.

    The first request of a key over all triggers decides; within a trigger that is the one of least ``seq``.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        earlier = read_or_empty(batch.sparkSession, path, f"{LEDGER_KEYS}, batch bigint")
        owners = earlier.where((F.col("batch") < batch_id) & (F.col("outcome") == "new")).drop("batch", "outcome")
        asked = batch.select("idempotency_key", "seq", "request_hash", "job_id")
        known = admission.known_keys(asked, owners).join(asked.select("idempotency_key"), "idempotency_key", "left_semi")
        admission.admit_requests(asked, known, large_ledger=False).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return start(requests, each, checkpoint, every)


def lifecycle_states(spark: SparkSession, path: str, **sizes) -> tuple[KeyedState, KeyedState]:
    """The states of versions, which lie by their document, and the documents of versions."""
    states = KeyedState(spark, f"{path}/states", STATES, "version_id", "document_id", **sizes)
    return states, KeyedState(spark, f"{path}/owners", OWNERS, "version_id", **sizes)


def _struct_positions(new: DataFrame) -> bool:
    return not isinstance(new.schema["pos"].dataType, IntegralType)


def _least(new: DataFrame) -> int:
    found = new.agg(F.min("pos")).first()[0]
    return 0 if found is None else found


def _log_after(before: DataFrame, new: DataFrame) -> DataFrame:
    """New commands after those that bring versions to the states they are in (one activation per document at most, so these need no order among versions)."""
    c = F.col
    past = lifecycle.commands_to(before)
    if _struct_positions(new):
        none = F.lit(None).cast(new.schema["pos"].dataType)
        early = F.struct(F.lit(0).alias("turn"), c("version_id").alias("key"), none.alias("pos"), "step")
        late = F.struct(F.lit(1).alias("turn"), F.lit("").alias("key"), "pos", F.lit(0).alias("step"))
    else:
        # Numbers are compared faster: the three before the least position are free.
        early, late = F.lit(_least(new) - 3).cast("bigint") + c("step"), c("pos").cast("bigint")
    named = ("document_id", "version_id", "command")
    return past.select(early.alias("pos"), *named).unionByName(new.select(late.alias("pos"), *named))


def lifecycle_stream(commands: DataFrame, path: str, checkpoint: str, every: str | None = None, **sizes) -> StreamingQuery:
    """Transitions and purge requests for a stream of lifecycle commands (pos, document_id, version_id, command).

    Below ``path``: ``moves`` has every command with the state before it and its
    outcome, ``purges`` the versions that each trigger archived or failed,
    ``states`` and ``owners`` are keyed state (``lifecycle_states``), of which a
    trigger reads and writes only the buckets of its documents and versions.
    Positions must ascend from trigger to trigger.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        c = F.col
        spark = batch.sparkSession
        states, owners = lifecycle_states(spark, path, **sizes)
        new = cut_lineage(batch.select("pos", "document_id", "version_id", "command"))
        # A version may be named beside another document than its own, whose versions count then.
        known = owners.rows(owners.touched(new), batch_id) if batch_id else spark.createDataFrame([], OWNERS)
        mine = known.join(new.select("version_id").distinct(), "version_id", "left_semi").select("document_id")
        documents = mine.union(new.select("document_id")).distinct()
        held = states.rows(states.touched(documents), batch_id) if batch_id else spark.createDataFrame([], STATES)
        before = cut_lineage(held.join(documents, "document_id", "left_semi").select("document_id", "version_id", "state"))
        folded, histories = lifecycle.fold_with_histories(_log_after(before, new))
        moves = folded.where(c("pos.turn") == 1).withColumn("pos", c("pos.pos")) if _struct_positions(new) else folded.where(c("pos") >= _least(new))
        moves.write.mode("overwrite").parquet(f"{path}/moves/batch={batch_id}")
        old = before.select("version_id", c("state").alias("old"))
        after = histories.select("document_id", "version_id", "state").join(old, "version_id", "left")
        changed = cut_lineage(after.where(~c("state").eqNullSafe(c("old"))))
        changed.where(c("state").isin("ARCHIVED", "FAILED")).select("version_id").write.mode("overwrite").parquet(f"{path}/purges/batch={batch_id}")
        begun = changed.where(c("old").isNull())
        states.write(changed, batch_id, states.touched(changed))
        owners.write(begun, batch_id, owners.touched(begun))

    return start(commands, each, checkpoint, every)
