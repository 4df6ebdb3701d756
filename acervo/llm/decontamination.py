"""Benchmark decontamination by SimHash of item-sized windows and a multi-index of Hamming blocks.

A window has as many words as the item it is held against (or is the whole text, if that is shorter). Its fingerprint is the
64-bit SimHash of its five-word shingles, each weighing as often as it occurs. Fingerprints are cut into eight bytes; two that
differ in at most ``RADIUS`` bits agree in some byte up to two bits, so that tables of item lists per byte value miss none.
Candidates within the radius are verified by the exact weighted similarity of shingles: sum of lesser over sum of greater counts.

Windows that share no shingle with any item of their size have similarity 0, so only windows that cover a shared shingle are
fingerprinted; this loses nothing. At similarity 0.75 fingerprints differ in 11 bits on average, in more than 23 about once in
ten thousand windows, and a passage is met by several windows.

The benchmark is the stated query set: it is taken in blocks of bounded size, each broadcast to one pass over all documents.

Defined cases: null or blank texts and items match nothing; an item of fewer than five words is one shingle; a row without
doc_id is reported with a null doc_id; rows without item_id likewise. Repeated rows are reported once each. An item of a given
text that occurs more than once is reported under each id.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import MIX1, SHINGLE_WORDS, Batches, Shared, batch_of, bound_batches, hashed_words, id_text, ids, mixed, raw_texts, word_hashes, words_of

RADIUS = 23
THRESHOLD = 0.75
BLOCK_BYTES = 8 << 20
FILTER_BITS = 20
NEAR = np.array([[bin(a ^ b).count("1") <= RADIUS // 8 for b in range(256)] for a in range(256)])


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    n = len(hashes) - width + 1
    out = np.full(max(n, 0), width, np.uint64)
    for k in range(width if n > 0 else 0):
        out = mixed(out * MIX1 + hashes[k : k + n])
    return out


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 values 1 or -1 for each shingle."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Eight bytes for each row of 64 sums."""
    return np.packbits(sums > 0, axis=1)


@dataclass
class Group:
    """The items of one number of words."""

    items: list[int | None] = field(default_factory=list)
    counts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    prints: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray | None = None  # byte, value, item: whether the item's byte is near the value


class Index:
    """A block of benchmark items, by number of words."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        cache, self.groups, found = word_hashes(), {}, defaultdict(set)
        for item, text in rows:
            hashes = hashed_words(words_of(text), cache)
            if not len(hashes):
                continue
            shingles = runs(hashes, min(SHINGLE_WORDS, len(hashes)))
            group = self.groups.setdefault(len(hashes), Group())
            group.items.append(item)
            group.counts.append(np.unique(shingles, return_counts=True))
            group.prints.append(fingerprints(signs(shingles).sum(axis=0)[None])[0])
            for shingle in set(shingles.tolist()):
                found[shingle].add(len(hashes))
        for group in self.groups.values():
            group.prints = np.array(group.prints)
            group.tables = NEAR[:, group.prints].transpose(2, 0, 1)
        self.shingles = np.array(sorted(found), np.uint64)
        self.sizes = [sorted(found[int(s)]) for s in self.shingles]
        self.widths = sorted({min(SHINGLE_WORDS, size) for size in self.groups})
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.shingles >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def matches(self, hashes: np.ndarray) -> list[tuple[int | None, float, int, int]]:
        """(item, best similarity, its window's first word, windows that match) of a text given as word hashes."""
        best: dict[tuple[int, int], list] = {}
        for width in self.widths:
            shingles = runs(hashes, width)
            if not len(shingles):
                continue
            maybe = np.flatnonzero(self.filter[(shingles >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(maybe):
                continue
            at = np.minimum(np.searchsorted(self.shingles, shingles[maybe]), len(self.shingles) - 1)
            positions: dict[int, list[int]] = defaultdict(list)
            for position, where, same in zip(maybe.tolist(), at.tolist(), (self.shingles[at] == shingles[maybe]).tolist(), strict=True):
                if same:
                    for size in self.sizes[where]:
                        if min(SHINGLE_WORDS, size) == width:
                            positions[size].append(position)
            for size, hits in positions.items():
                for first, stop in stretches(hits, width, size, len(hashes)):
                    self.compare(shingles, width, size, first, stop, best)
        return [(self.groups[size].items[k], similarity, first, n) for (size, k), (similarity, first, n) in sorted(best.items())]

    def compare(self, shingles: np.ndarray, width: int, size: int, first: int, stop: int, best: dict) -> None:
        """Windows of ``size`` words that start in [first, stop)."""
        group, n = self.groups[size], min(size - width + 1, len(shingles))
        sums = np.vstack([np.zeros((1, 64), np.int32), signs(shingles[first : stop + n - 1]).cumsum(axis=0, dtype=np.int32)])
        prints = fingerprints(sums[n:] - sums[:-n])
        near = np.zeros((len(prints), len(group.items)), bool)
        for byte in range(8):
            near |= group.tables[byte][prints[:, byte]]
        window, item = np.nonzero(near)
        distance = np.bitwise_count(prints[window] ^ group.prints[item]).sum(axis=1)
        for w, k in zip(window[distance <= RADIUS].tolist(), item[distance <= RADIUS].tolist(), strict=True):
            similarity = weighted_similarity(shingles[first + w : first + w + n], *group.counts[k])
            if similarity >= THRESHOLD:
                before = best.get((size, k), (0.0, 0, 0))
                best[size, k] = [*max((before[0], -before[1]), (similarity, -(first + w))), before[2] + 1]
                best[size, k][1] *= -1


def stretches(hits: list[int], width: int, size: int, words: int) -> list[tuple[int, int]]:
    """Ranges of the first words of all windows of ``size`` words that cover one of the runs at ``hits``."""
    last, out = max(words - size, 0), []
    for hit in hits:
        first, stop = min(max(hit + width - size, 0), last), min(hit, last) + 1
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [(a, b) for a, b in out]


def weighted_similarity(window: np.ndarray, shingles: np.ndarray, counts: np.ndarray) -> float:
    own, times = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
    lesser = int(np.minimum(times, counts[at])[shingles[at] == own].sum())
    return lesser / (len(window) + int(counts.sum()) - lesser)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Broadcast indexes of the benchmark's items, each block of about ``block_bytes`` of text at most."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + 2 * size // block_bytes
    for block in range(blocks if size else 0):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = Index([(r.item_id, r.text.encode()) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id, r.text))])
        if index.groups:
            yield Shared(benchmark.sparkSession, index)


def contaminated_in(docs: DataFrame, shared: Shared) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_windows", pa.int64())])

    def run(batches: Batches) -> Batches:
        cache, index = word_hashes(), shared.value
        for batch in batches:
            rows = [(doc, *match) for doc, text in zip(ids(batch).to_pylist(), raw_texts(batch), strict=True) for match in index.matches(hashed_words(words_of(text), cache))]
            yield batch_of(schema, *(list(zip(*rows, strict=True)) or [[]] * 5))

    return id_text(docs).mapInArrow(run, "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_windows bigint")


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item that a window of the document matches: doc_id, item_id, similarity, first_word, n_windows."""
    found = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_windows bigint")
    for shared in item_blocks(benchmark, block_bytes):
        found = found.union(contaminated_in(docs, shared))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that match no item, columns as they were. Texts are searched where they lie; nothing is shuffled."""
    schema = docs.schema
    bound_batches(docs)
    for shared in item_blocks(benchmark, block_bytes):

        def run(batches: Batches, shared=shared) -> Batches:
            cache, index = word_hashes(), shared.value
            for batch in batches:
                keep = [not index.matches(hashed_words(words_of(text or b""), cache)) for text in raw_texts(batch)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
