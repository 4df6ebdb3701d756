"""Keyed state of streams as bucketed tables of snapshots and deltas.

A table lies in buckets of its key. Each trigger adds the rows that it changed
to the buckets of their keys, in a folder named by its batch number; once a
bucket holds more than ``MOST_DELTAS`` such additions, the trigger that touches
it next writes the bucket as a whole, and what came before is cleared the time
after. So a trigger reads a bounded number of files in the buckets of its own
keys, and none in the others, however many triggers there were.

A trigger sees what triggers before it wrote, never its own rows, and replaces
those when it is repeated. A bucket's files are kept until a later trigger than
the one that wrote it as a whole has begun, so a repeated trigger finds all it
read before.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from acervo.sources.snapshots import last_per_key

BUCKETS = 16  # of small state; large state takes more, as a touched bucket is read as a whole
MOST_DELTAS = 8


class KeyedState:
    """The latest row of each key. ``bucket_by``, a function of the key or the key itself, says which rows lie together."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str, key: str, bucket_by: str | None = None,
        buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS,
    ):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.bucket_by, self.buckets, self.most_deltas = bucket_by or key, buckets, most_deltas

    def bucket(self, value: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.bucket_by) if value is None else value), F.lit(self.buckets)).cast("int")

    def touched(self, *keys: DataFrame) -> list[int]:
        """The buckets of some rows of the table's ``bucket_by`` column, in one job; there are at most ``buckets`` of them."""
        found = None
        for rows in keys:
            part = rows.select(self.bucket().alias("bucket"))
            found = part if found is None else found.unionByName(part)
        return sorted(r.bucket for r in found.distinct().collect())

    def _store(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def parts(self, buckets: Sequence[int] | None, before: int | None = None) -> dict[int, list[tuple[int, str, str]]]:
        """The folders of each bucket since it was last written as a whole, by batch number, with their kind."""
        which = "*" if buckets is None else "{" + ",".join(map(str, buckets)) + "}" if buckets else None
        if which is None:
            return {}
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={which}/batch=*/kind=*")
        found: dict[int, list[tuple[int, str, str]]] = {}
        for status in self._store().globStatus(pattern) or []:
            at = status.getPath().toString()
            bucket, batch, kind = re.search(r"/bucket=(-?\d+)/batch=(-?\d+)/kind=(\w+)$", at).groups()
            if before is None or int(batch) < before:
                found.setdefault(int(bucket), []).append((int(batch), kind, at))
        for bucket, rows in found.items():
            rows.sort()
            whole = max((k for k, row in enumerate(rows) if row[1] == "whole"), default=0)
            found[bucket] = rows[whole:]
        return found

    def _read(self, parts: dict[int, list[tuple[int, str, str]]]) -> DataFrame:
        paths = [at for rows in parts.values() for _, _, at in rows]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, batch bigint")
        reader = self.spark.read.option("basePath", self.path).schema(f"{self.schema}, bucket int, batch bigint, kind string")
        return reader.parquet(*paths).drop("bucket", "kind")

    def rows(self, buckets: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
        """The latest row of each key of some buckets (all of them if None), as triggers before number ``before`` left it."""
        return self._latest(self._read(self.parts(buckets, before)))

    def _latest(self, rows: DataFrame) -> DataFrame:
        return last_per_key(rows, [self.key], F.col("batch")).drop("batch")

    def write(self, changed: DataFrame, batch: int, buckets: Sequence[int]) -> None:
        """Adds a trigger's rows, one per key and all in ``buckets``; buckets with many additions are written as a whole."""
        columns = StructType.fromDDL(self.schema).names
        parts = self.parts(buckets, batch)
        full = {b: rows for b, rows in parts.items() if len(rows) > self.most_deltas}
        new = changed.select(*columns).withColumn("bucket", self.bucket())
        out = new.where(~F.col("bucket").isin(list(full))) if full else new
        out = out.withColumn("kind", F.lit("delta"))
        if full:
            held = self._read(full).unionByName(new.where(F.col("bucket").isin(list(full))).select(*columns, F.lit(batch).cast("bigint").alias("batch")))
            whole = self._latest(held).select(*columns, self.bucket().alias("bucket"), F.lit("whole").alias("kind"))
            out = out.select(*columns, "bucket", "kind").unionByName(whole)
        tasks = max(1, min(len(buckets), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        placed = out.withColumn("batch", F.lit(batch).cast("bigint")).repartition(tasks, "bucket")
        self._forget(batch, buckets)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch", "kind").parquet(self.path)
        self._clear(parts)

    def _forget(self, batch: int, buckets: Sequence[int]) -> None:
        """Removes what an earlier attempt of this trigger left."""
        store, path = self._store(), self.spark._jvm.org.apache.hadoop.fs.Path
        for status in store.globStatus(path(f"{self.path}/bucket=*/batch={batch}")) or []:
            store.delete(status.getPath(), True)

    def _clear(self, parts: dict[int, list[tuple[int, str, str]]]) -> None:
        """Removes what lies before a bucket's last whole writing, which this trigger, begun after it, has read."""
        store, path = self._store(), self.spark._jvm.org.apache.hadoop.fs.Path
        whole = {bucket: rows[0][0] for bucket, rows in parts.items() if rows[0][1] == "whole"}
        if not whole:
            return
        for status in store.globStatus(path(f"{self.path}/bucket={{{','.join(map(str, whole))}}}/batch=*")) or []:
            bucket, batch = re.search(r"/bucket=(-?\d+)/batch=(-?\d+)$", status.getPath().toString()).groups()
            if int(batch) < whole[int(bucket)]:
                store.delete(status.getPath(), True)
