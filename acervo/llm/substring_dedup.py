"""Removal of repeated 200-byte strings by a distributed difference-cover suffix algorithm.

Only equality of the first 200 bytes of suffixes matters, so names stand for equal prefixes and are ordered by hash.

1. Equal texts are one text from the start; of a text that occurs twice all goes.
2. Positions whose offset modulo 73 lies in a perfect difference cover are sampled (9 of 73). Any two positions have a common
   shift of less than 73 that leads both to sampled ones, so two equal 200-byte strings share an equal sampled 128-byte tuple.
   Tuples are named by recursion: the name of 2n bytes comes from the names of its halves.
3. Names are sorted and compared with their neighbours. A position is settled when no repeated sampled tuple starts within 72
   bytes of it: it can't repeat, and drops out.
4. The remaining suffixes are merged: the names of their 200-byte prefixes (from two names of 128 bytes) are sorted and adjacent
   equal ones mark their positions.

Sorting is spread by ranges of names. Texts lie in blocks of a few megabytes; a block sends each range its distinct names in one
packed, delta-coded value with a bit for names that it has twice, and gets back a bit for each name: a name met in a third of all
texts costs a block no more than another. Names of step 3 are cut to the bits that keep chance repeats rare, since these only
leave more for step 4, whose names have 64 bits.

Defined cases: a null text is empty. Texts of fewer than 200 bytes lose nothing. A row without doc_id counts like any other;
repeated rows count as copies of each other and get a row each. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import MIX1, MIX2, bound_batches, id_text, mixed, sha256, staged

LENGTH = 200
TUPLE = 128
PERIOD = LENGTH - TUPLE + 1
# Fixed value: a perfect difference cover modulo 73 (each difference but 0 occurs once).
COVER = (0, 1, 3, 7, 15, 31, 36, 54, 63)
BLOCK_BYTES = 6 << 20
CHUNK_BYTES = 1 << 19
MOST_BUCKETS = 4096
BYTE_NAMES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX1)
IN_COVER = np.isin(np.arange(PERIOD), COVER)


def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of joined strings, from the names of two parts."""
    out = left * MIX1 + (right ^ (right >> np.uint64(32))) * MIX2
    return out ^ (out >> np.uint64(29))


def tuple_names(data: np.ndarray) -> np.ndarray:
    """The name of the 128 bytes at each position."""
    names, width = BYTE_NAMES[data], 1
    while width < TUPLE:
        names = named(names[:-width], names[width:])
        width *= 2
    return names


class Chunk:
    """Texts of a block, joined: positions know their own text's ends."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts])
        self.stops = np.cumsum(self.sizes)
        self.starts = self.stops - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.names = tuple_names(self.data)
        offset = np.arange(len(self.data)) - np.repeat(self.starts, self.sizes)
        left = np.repeat(self.sizes, self.sizes) - offset
        self.is_start = left >= LENGTH
        self.samples = np.flatnonzero(IN_COVER[offset % PERIOD] & (left >= TUPLE))

    def sample_names(self) -> np.ndarray:
        return mixed(self.names[self.samples])

    def unsettled(self, repeated: np.ndarray) -> np.ndarray:
        """Positions of whole 200-byte strings with a repeated sampled tuple within reach."""
        at = self.samples[repeated]
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, np.maximum(at - (PERIOD - 1), self.starts[np.searchsorted(self.stops, at, side="right")]), 1)
        np.add.at(edge, at + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & self.is_start)

    def prefix_names(self, at: np.ndarray) -> np.ndarray:
        return mixed(named(self.names[at], self.names[at + (LENGTH - TUPLE)]))

    def results(self, repeated: np.ndarray) -> list[tuple[int, int, str]]:
        """Removed bytes, spans and the digest of what stays, of each text; ``repeated`` are positions of repeated strings."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        edge[repeated] += 1
        np.add.at(edge, repeated + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        first[self.starts] = gone[self.starts]
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, first)]
        removed, spans = (s[self.stops] - s[self.starts] for s in sums)
        return [
            (int(r), int(n), sha256((self.data[a:b][~gone[a:b]] if r else self.data[a:b]).tobytes()))
            for a, b, r, n in zip(self.starts, self.stops, removed, spans, strict=True)
        ]


def chunks(table: pa.Table):
    """Keys and chunks of a block's texts, in a fixed order."""
    held, keys, size = [], [], 0
    for key, text in sorted(zip(table["key"].to_pylist(), table["text"].cast(pa.binary()).to_pylist(), strict=True)):
        held.append(text)
        keys.append(key)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield keys, Chunk(held)
            held, keys, size = [], [], 0
    if held:
        yield keys, Chunk(held)


def packed(names: np.ndarray) -> bytes:
    """Ascending names, as differences, byte by byte of all, compressed."""
    import zstandard

    return zstandard.compress(np.diff(names, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(value: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(value), np.uint8).reshape(8, -1).T).view("<u8").ravel().cumsum(dtype=np.uint64)


SENT = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("names", pa.binary()), ("twice", pa.binary())])
SENT_DDL = "block bigint, range bigint, names binary, twice binary"
ANSWER = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("step", pa.int32()), ("repeated", pa.binary())])
ANSWER_DDL = "block bigint, range bigint, step int, repeated binary"
RESULT = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def ranges_of(names: np.ndarray, ranges: int, bits: int) -> list[tuple[int, int, int]]:
    """(range, first, stop) of ascending names."""
    high = names >> np.uint64(bits - 32) if bits > 32 else names << np.uint64(32 - bits)
    part = ((high * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(int(part[a]), a, b) for a, b in pairwise(cuts) if a < b]


def sent(block: int, names: np.ndarray, ranges: int, bits: int) -> pa.Table:
    """A block's distinct names by range."""
    names, counts = np.unique(names, return_counts=True)
    cut = ranges_of(names, ranges, bits)
    return pa.table([[block] * len(cut), [r for r, _, _ in cut], [packed(names[a:b]) for _, a, b in cut], [np.packbits(counts[a:b] > 1).tobytes() for _, a, b in cut]], schema=SENT)


def compared(step: int):
    """For a range of names: which names of each block another block, or the block itself, has again."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpacked(v) for v in table["names"].to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(v, np.uint8), count=len(p)) for v, p in zip(table["twice"].to_pylist(), parts, strict=True)]).astype(bool)
        names = np.concatenate(parts)
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cuts = np.cumsum([0, *map(len, parts)])
        return pa.table([table["block"], table["range"], [step] * len(parts), [np.packbits(twice[a:b]).tobytes() for a, b in pairwise(cuts.tolist())]], schema=ANSWER)

    return run


def repeated_names(names: np.ndarray, answers: pa.Table, step: int, ranges: int, bits: int) -> np.ndarray:
    """Of a block's names, the distinct repeated ones, by the answers of all ranges."""
    names = np.unique(names)
    held = {r: v for r, s, v in zip(answers["range"].to_pylist(), answers["step"].to_pylist(), answers["repeated"].to_pylist(), strict=True) if s == step}
    flags = [np.unpackbits(np.frombuffer(held[r], np.uint8), count=b - a) for r, a, b in ranges_of(names, ranges, bits)]
    return names[np.concatenate(flags).astype(bool)] if flags else names


def among(names: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    if not len(chosen):
        return np.zeros(len(names), bool)
    return chosen[np.minimum(np.searchsorted(chosen, names), len(chosen) - 1)] == names


def distinct_results(texts: DataFrame, total: int) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256) of distinct texts of 200 bytes or more (key, text) that have ``total`` bytes."""
    spark = texts.sparkSession
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    sampled = max(1, total * len(COVER) // PERIOD)
    ranges = max(1, math.ceil(8 * sampled / BLOCK_BYTES))
    bits = min(64, max(34, sampled.bit_length() + 8))
    shift = np.uint64(64 - bits)
    buckets = min(blocks, MOST_BUCKETS)
    name = f"texts_{uuid.uuid4().hex}"
    placed = texts.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    placed.repartition(buckets, "block").write.option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    stored = spark.table(name)

    def sample(table: pa.Table) -> pa.Table:
        return sent(table["block"][0].as_py(), np.concatenate([c.sample_names() >> shift for _, c in chunks(table)]), ranges, bits)

    def merge(chunk_list: list, answers: pa.Table) -> list[np.ndarray]:
        """The unsettled positions of each chunk."""
        own = [c.sample_names() >> shift for _, c in chunk_list]
        chosen = repeated_names(np.concatenate(own), answers, 1, ranges, bits)
        return [c.unsettled(among(names, chosen)) for (_, c), names in zip(chunk_list, own, strict=True)]

    def remaining(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return SENT.empty_table()
        held = list(chunks(table))
        return sent(table["block"][0].as_py(), np.concatenate([c.prefix_names(at) for (_, c), at in zip(held, merge(held, answers), strict=True)]), ranges, 64)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return RESULT.empty_table()
        held = list(chunks(table))
        places = merge(held, answers)
        names = [c.prefix_names(at) for (_, c), at in zip(held, places, strict=True)]
        chosen = repeated_names(np.concatenate(names), answers, 2, ranges, 64)
        rows = [(key, *row) for (keys, c), at, n in zip(held, places, names, strict=True) for key, row in zip(keys, c.results(at[among(n, chosen)]), strict=True)]
        return pa.table(list(map(list, zip(*rows, strict=True))), schema=RESULT)

    first = staged(stored.groupBy("block").applyInArrow(sample, SENT_DDL).groupBy("range").applyInArrow(compared(1), ANSWER_DDL))
    second = staged(stored.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(remaining, SENT_DDL).groupBy("range").applyInArrow(compared(2), ANSWER_DDL))
    out = staged(stored.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInArrow(remove, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string"))
    spark.sql(f"DROP TABLE {name}")
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    bound_batches(docs)
    keyed = id_text(docs).select("doc_id", "text", F.unhex(F.md5("text")).alias("key"))
    size = F.octet_length("text").cast("long")
    rows = staged(keyed.select("doc_id", "key", size.alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256")))
    texts = rows.groupBy("key").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"))
    copied = texts.filter("copies > 1").select("key", F.lit(True).alias("copied"))
    total = texts.filter(f"n_bytes >= {LENGTH}").agg(F.sum("n_bytes")).first()[0] or 0
    if not total:
        return rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("whole_sha256").alias("kept_sha256"))
    found = distinct_results(keyed.filter(size >= LENGTH).dropDuplicates(["key"]).select("key", "text"), total)
    both = rows.join(found.join(copied, "key", "left"), "key", "left")
    copy = F.col("copied").isNotNull()
    return both.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(sha256(b""))).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
