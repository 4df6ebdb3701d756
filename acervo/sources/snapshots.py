"""Keyed snapshots: every update is (old snapshot, changes) -> new snapshot.

The caller writes the result beside the old one (``write_snapshot``) and then
moves readers over; nothing is overwritten while it is being read.
Last-wins is a ``max_by`` aggregate, so copies of one key collapse inside each
task before the shuffle and a much repeated key costs one row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.session import cut_lineage


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``, which must be unique within a key."""
    values = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_last"))
    return last.select(*keys, "_last.*").select(*rows.columns)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The first row of each key by ``order``, which must be unique within a key."""
    values = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_first"))
    return first.select(*keys, "_first.*").select(*rows.columns)


def upsert_points(existing: DataFrame, incoming: DataFrame, order: str, written: bool = False) -> DataFrame:
    """Insert or replace by point id; of repeated incoming points the last one counts.

    ``written`` says that ``incoming`` comes from a written table: its ids are
    then counted first, and only points with a repeated id are shuffled whole.
    """
    c = F.col
    if written:
        counts = incoming.groupBy(c("point_id").alias("_id")).agg(F.count("*").alias("_n"))
        repeated = cut_lineage(counts.where(c("_n") > 1).select("_id"))
        same = c("point_id").eqNullSafe(c("_id"))
        several = last_per_key(incoming.join(repeated, same, "left_semi"), ["point_id"], c(order))
        latest = incoming.join(repeated, same, "left_anti").unionByName(several).drop(order)
    else:
        latest = last_per_key(incoming, ["point_id"], c(order)).drop(order)
    kept = existing.join(incoming.select("point_id"), "point_id", "left_anti")
    return kept.select(*latest.columns).unionByName(latest)


def delete_versions(points: DataFrame, version_ids: DataFrame) -> DataFrame:
    """Points without those of the given versions; deleting twice changes nothing."""
    return points.join(version_ids.select("version_id"), "version_id", "left_anti")


def upsert_documents(existing: DataFrame, incoming: DataFrame, order: str = "updated_at") -> DataFrame:
    """Insert, or overwrite title, description and updated_at; created_at stays."""
    latest = last_per_key(incoming, ["document_id"], F.col(order))
    old, new = existing.alias("old"), latest.alias("new")
    arrived = F.col("new.updated_at").isNotNull()

    def pick(name: str) -> Column:
        return F.when(arrived, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return old.join(new, "document_id", "full_outer").select(
        "document_id",
        pick("title"),
        pick("description"),
        F.coalesce(F.col("old.created_at"), F.col("new.updated_at")).alias("created_at"),
        pick("updated_at"),
    )


def vector_schema_violations(points: DataFrame, dims: int) -> DataFrame:
    """Points whose vector is missing or not of the agreed size."""
    size = F.when(F.col("vector").isNotNull(), F.size("vector"))
    return points.where(F.coalesce(size != dims, F.lit(True))).select(
        "point_id", F.coalesce(size, F.lit(0)).alias("size"), F.lit("VECTOR_DIMENSION_MISMATCH").alias("error_code")
    )


def ensure_vector_schema(points: DataFrame, dims: int) -> DataFrame:
    """The points, with an error raised at run time on the first misfit."""
    fits = F.coalesce(F.size("vector") == dims, F.lit(False))
    return points.where(
        F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("VECTOR_DIMENSION_MISMATCH")).cast("boolean"))
    )


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a snapshot to a path of its own; partitions present in ``df`` are replaced."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_bucketed(df: DataFrame, table: str, buckets: int, path: str, key: str = "version_id") -> DataFrame:
    """Save a table bucketed and sorted by its version.

    Points and versions saved with the same number of buckets meet in scope,
    purge and delete joins without moving the points.
    """
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def with_bucket(points: DataFrame, buckets: int) -> DataFrame:
    """A version bucket to partition the points table by (all points of a version share one)."""
    return points.withColumn("bucket", F.pmod(F.xxhash64("version_id"), F.lit(buckets)).cast("int"))


def rewrite_buckets(spark: SparkSession, path: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets named in ``touched`` (column bucket) of a table partitioned by bucket; returns them.

    Only these partitions are read and written. The new rows are written beside
    the table first, so a failure before the swap leaves it as it was, and
    repeating the call is harmless.
    """
    buckets = sorted(r.bucket for r in touched.select("bucket").distinct().collect())
    if not buckets:
        return buckets
    new = cut_lineage(change(spark.read.parquet(path).where(F.col("bucket").isin(buckets))))
    write_snapshot(new, path, ["bucket"])
    left = {r.bucket for r in new.select("bucket").distinct().collect()}
    for bucket in set(buckets) - left:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return buckets


def upsert_into(path: str, incoming: DataFrame, order: str, buckets: int) -> list[int]:
    """``upsert_points`` in place, for a table written with ``with_bucket`` and partitioned by it."""
    placed = cut_lineage(with_bucket(incoming, buckets))
    return rewrite_buckets(incoming.sparkSession, path, placed, lambda old: upsert_points(old, placed, order))


def delete_from(path: str, version_ids: DataFrame, buckets: int) -> list[int]:
    """``delete_versions`` in place, for a table written with ``with_bucket`` and partitioned by it."""
    gone = cut_lineage(with_bucket(version_ids.select("version_id").distinct(), buckets))
    return rewrite_buckets(version_ids.sparkSession, path, gone, lambda old: delete_versions(old, gone))
