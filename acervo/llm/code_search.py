"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code holds the signs of its entries. A task indexes the codes of its rows by each 16-bit segment. For a query, radius r
is searched in every segment in turn: all segment values at distance r from the query's are looked up, and the codes found are
verified by their whole Hamming distance. When every segment is searched up to r, each code within ``segments * (r + 1) - 1``
has been met; the search ends once the k-th best distance lies within that. The task's best k per query are merged over tasks.
Rows of equal code take part once in a task, with their k least ids, as further ones can't be among the k best.

The queries are taken in blocks of bounded size, each broadcast to one pass over all codes; what a task holds is bounded by its
rows, what it returns by queries times k.

Ties go to the lesser id, and a query that is itself a row finds itself. Defined cases: rows without id, without vector, with
another number of entries than ``bits``, or with null entries are neither queries nor found; fewer than k rows give fewer results.
A repeated row is found as often as it occurs. Entries of 0 or less, and NaN, count as 0 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm.common import Batches, Shared, batch_of, ids, staged

BITS = 64
SEGMENT_BITS = 16
QUERY_BLOCK = 4096
TASK_ROWS = 200_000


def codes(vectors: DataFrame, id_column: str, vector_column: str, bits: int = BITS) -> DataFrame:
    """(id, code) with the signs of the vector as bytes."""
    schema = pa.schema([("id", pa.int64()), ("code", pa.binary())])
    values = F.col(vector_column).cast("array<double>")
    usable = vectors.select(F.col(id_column).cast("long").alias("id"), values.alias("vector")).filter(F.col("id").isNotNull() & (F.size("vector") == bits) & ~F.exists("vector", lambda x: x.isNull()))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            signs = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, bits) > 0
            yield batch_of(schema, ids(batch, "id"), [row.tobytes() for row in np.packbits(signs, axis=1)])

    return usable.mapInArrow(run, "id bigint, code binary")


class CodeIndex:
    """The codes of a task by segment."""

    def __init__(self, row_ids: np.ndarray, rows: np.ndarray, k: int):
        order = np.lexsort([row_ids, *rows.T[::-1]])
        row_ids, rows = row_ids[order], rows[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        starts = np.flatnonzero(fresh)
        self.k, self.rows = k, rows[starts]
        self.counts = np.minimum(np.diff([*starts, len(rows)]), k)
        self.starts, self.ids = starts, row_ids
        segments = self.rows.view(">u2").astype(np.int64)
        self.order = [np.argsort(s, kind="stable") for s in segments.T]
        self.bounds = [np.searchsorted(s[o], np.arange((1 << SEGMENT_BITS) + 1)) for s, o in zip(segments.T, self.order, strict=True)]

    def search(self, query: np.ndarray, flips: list[np.ndarray]) -> list[tuple[int, int]]:
        """The k best (distance, id)."""
        parts = query.view(">u2").astype(np.int64)
        met = np.zeros(len(self.rows), bool)
        found, distances, seen = [], [], 0
        by_distance = np.zeros(8 * len(query) + 1, np.int64)
        for radius in range(SEGMENT_BITS + 1):
            for segment, part in enumerate(parts):
                values = part ^ flips[radius]
                first, stop = self.bounds[segment][values], self.bounds[segment][values + 1]
                sizes = stop - first
                if not (total := int(sizes.sum())):
                    continue
                at = self.order[segment][np.arange(total) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)]
                at = at[~met[at]]
                met[at] = True
                distance = np.bitwise_count(self.rows[at] ^ query).sum(axis=1, dtype=np.int64)
                found.append(at)
                distances.append(distance)
                by_distance += np.bincount(distance, self.counts[at], minlength=len(by_distance)).astype(np.int64)
                seen += len(at)
            if by_distance[: len(parts) * (radius + 1)].sum() >= self.k or seen == len(self.rows):
                break
        at, distance = np.concatenate([*found, np.zeros(0, np.int64)]), np.concatenate([*distances, np.zeros(0, np.int64)])
        kth = int(np.searchsorted(by_distance.cumsum(), min(self.k, by_distance.sum())))
        near = distance <= kth
        best = [(int(d), int(i)) for a, d in zip(at[near], distance[near], strict=True) for i in self.ids[self.starts[a] : self.starts[a] + self.counts[a]]]
        return sorted(best)[: self.k]


def flips() -> list[np.ndarray]:
    """By radius, the changes of a segment at that distance."""
    return [np.array([sum(1 << b for b in chosen) for chosen in combinations(range(SEGMENT_BITS), radius)], np.int64) for radius in range(SEGMENT_BITS + 1)]


def search_block(coded: DataFrame, queries: list[tuple[int, bytes]], k: int) -> DataFrame:
    """Each task's k best rows for each query of a block."""
    shared = Shared(coded.sparkSession, queries)
    schema = pa.schema([("query_id", pa.int64()), ("distance", pa.int64()), ("id", pa.int64())])

    def answer(row_ids: list[int], rows: list[bytes]) -> pa.RecordBatch:
        index = CodeIndex(np.array(row_ids, np.int64), np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), k)
        found = [(query, d, i) for query, code in shared.value for d, i in index.search(np.frombuffer(code, np.uint8), changes)]
        return batch_of(schema, *zip(*found, strict=True))

    changes = flips()

    def run(batches: Batches) -> Batches:
        row_ids: list[int] = []
        rows: list[bytes] = []
        for batch in batches:
            row_ids += batch.column(0).to_pylist()
            rows += batch.column(1).to_pylist()
            if len(rows) >= TASK_ROWS:
                yield answer(row_ids, rows)
                row_ids, rows = [], []
        if rows:
            yield answer(row_ids, rows)

    return coded.mapInArrow(run, "query_id bigint, distance bigint, id bigint")


def top_k(vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", bits: int = BITS, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, the found id and its distance, for the distinct ids of rows that satisfy ``is_query``."""
    coded = staged(codes(vectors, id_column, vector_column, bits))
    queries = coded.filter(is_query).dropDuplicates(["id"])
    blocks = -(-queries.count() // block)
    numbered = staged(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, 2 * blocks))))) if blocks else queries
    found = coded.sparkSession.createDataFrame([], "query_id bigint, distance bigint, id bigint")
    for number in range(2 * blocks):
        rows = sorted((r.id, bytes(r.code)) for r in numbered.filter(F.col("block") == number).collect())
        if rows:
            found = found.union(search_block(coded, rows, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias(id_column), "distance")
