"""What the training-data operators share: input columns, staging, word shingles, offsets."""

from __future__ import annotations

import bisect
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.session import cut_lineage

SHINGLE_WORDS = 5
ARROW_ROWS = 128
CACHE_ENTRIES = 200_000

MIX1 = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
MIX3 = np.uint64(0x94D049BB133111EB)


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text: other columns, whatever their names, can't clash with an operator's own. A null text is empty."""
    bound_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def bound_batches(df: DataFrame) -> None:
    """Few rows in an Arrow batch, as one text may hold megabytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def staged(df: DataFrame) -> DataFrame:
    """A table in the shared folder: computed once, kept when executors are lost."""
    return cut_lineage(df)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))


class Shared:
    """A broadcast value that a worker process loads once, so that caches inside it live on from task to task.

    It travels pickled by value, classes included: workers need no copy of the package.
    """

    def __init__(self, spark: SparkSession, value):
        self.key, self.pickled = uuid.uuid4().hex, spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        held = pyspark.__dict__.setdefault("_shared_values", {})
        if self.key not in held:
            if len(held) >= 4:
                held.clear()
            held[self.key] = cloudpickle.loads(self.pickled.value)
        return held[self.key]


class Bounded(dict):
    """A worker's cache: computes what is missing, and starts anew when it holds too much."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def word_hashes() -> Bounded:
    import xxhash

    return Bounded(xxhash.xxh3_64_intdigest)


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


def hashed_words(words: list[bytes], cache: Bounded) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run of five words; for fewer words, one for the whole sequence."""
    if not len(hashes):
        return hashes
    width = min(SHINGLE_WORDS, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out * MIX1 + hashes[k : k + n])
    return out


def code_points(text: bytes, offsets: list[int]) -> list[int]:
    """Offsets in bytes, as offsets in code points."""
    if not offsets:
        return []
    if text.isascii():
        return list(offsets)
    starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts)])
    return before[offsets].tolist()


class Cover:
    """Stretches that spans cover, in order; adding and asking take logarithmic search."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start

    def gaps(self, start: int, end: int) -> list[tuple[int, int]]:
        """What the stretches leave of a span."""
        out, k = [], bisect.bisect_right(self.ends, start)
        while start < end:
            stop = min(end, self.starts[k]) if k < len(self.starts) else end
            if start < stop:
                out.append((start, stop))
            start, k = self.ends[k] if k < len(self.ends) else end, k + 1
        return out

    def add(self, start: int, end: int) -> None:
        """A span that overlaps none."""
        k = bisect.bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def span_text(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    order = {kind: k for k, kind in enumerate(kinds)}
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


Batches = Iterator[pa.RecordBatch]
