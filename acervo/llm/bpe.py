"""Byte-level BPE by rounds over length-bucketed padded matrices.

Texts are cut by the tokenizer's pattern. The pieces of a batch that a worker hasn't met are bucketed by length; each bucket is a
padded matrix of ids, a row a piece. In a round every row merges its leftmost pair of least rank: pairs are looked up in a hash
table in numpy, merged rows are compacted by one column, and rows without a mergeable pair leave the matrix. Pieces of more than
``LONG`` bytes, which would make very wide matrices, merge all places of their least rank in a round, over linked neighbours.
Decoding joins the tokens' bytes.

The vocabulary (a rank file of fixed size) is read where the query starts and broadcast; worker caches have a bound.

Defined cases: a null text is empty and has no tokens. Bytes that are no character can't occur in a text column. A row without
doc_id is encoded like any other. Repeated rows get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import Batches, Shared, batch_of, id_text, ids, mixed, raw_texts, sha256
from acervo.llm.pretokens import Cutter, tiktoken_table

NONE = np.int32(2**31 - 1)
LONG = 512
MATRIX_CELLS = 1 << 20
CACHED_PIECES = 300_000
LONGEST_CACHED = 64  # longer pieces are encoded where they occur, so that the cache has a bound in bytes


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Pairs of ids and the id they merge into, in an open-addressed hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slots = self.slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            chosen, first = np.unique(slots[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[chosen], self.values[chosen] = keys[placed], values[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair's merge; NONE where a pair has none, or a side is padding (-1)."""
        shape = left.shape
        keys = (left.astype(np.int64).ravel() << 32) | (right.astype(np.int64).ravel() & 0xFFFFFFFF)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self.slots(keys[todo])
        while len(todo):
            held = self.keys[slots]
            same = held == keys[todo]
            out[todo[same]] = self.values[slots[same]]
            more = ~same & (held != -1)
            todo, slots = todo[more], (slots[more] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.cutter, self.pairs = ranks, Cutter(pattern, lambda: tiktoken_table(pattern)), PairTable(ranks)
        self.bytes_to_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.cache: dict[str, bytes] = {}  # ids as little-endian 32-bit integers

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that the cache lacks."""
        buckets: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.cache[piece] = self.merge_long(self.bytes_to_ids[np.frombuffer(raw, np.uint8)]).astype("<u4").tobytes()
            else:
                buckets[(len(raw) - 1).bit_length()].append((piece, raw))
        for bucket, rows in buckets.items():
            step = max(1, MATRIX_CELLS >> bucket)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                for (piece, _), row in zip(part, self.merge_rows([raw for _, raw in part]), strict=True):
                    self.cache[piece] = row

    def merge_rows(self, raws: list[bytes]) -> list[bytes]:
        lengths = np.array([len(r) for r in raws])
        width = int(lengths.max())
        matrix = np.full((len(raws), width), -1, np.int32)
        matrix[np.arange(width) < lengths[:, None]] = self.bytes_to_ids[np.frombuffer(b"".join(raws), np.uint8)]
        out = [b""] * len(raws)
        rows = np.arange(len(raws))
        ranks = self.pairs.merged(matrix[:, :-1], matrix[:, 1:]) if width > 1 else np.full((len(raws), 0), NONE, np.int32)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE, np.int32)
            ended = least == NONE
            if ended.any():
                done = matrix[ended]
                sizes, flat = (done >= 0).sum(axis=1), done.astype("<u4")
                for k, row, size in zip(rows[ended].tolist(), flat, sizes.tolist(), strict=True):
                    out[k] = row[:size].tobytes()
                rows, matrix, ranks, at, least = rows[~ended], matrix[~ended], ranks[~ended], at[~ended], least[~ended]
                if not len(rows):
                    break
            # Compaction: columns after the merged pair move one to the left, and the pair's rank leaves.
            n, width = len(rows), matrix.shape[1]
            column = np.arange(width - 1)
            new = np.take_along_axis(matrix, column + (column > at[:, None]), axis=1)
            each = np.arange(n)
            new[each, at] = least
            column = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
            inner = at > 0
            ranks[each[inner], at[inner] - 1] = self.pairs.merged(new[each[inner], at[inner] - 1], least[inner])
            inner = at < width - 2
            ranks[each[inner], at[inner]] = self.pairs.merged(least[inner], new[each[inner], at[inner] + 1])
            matrix = new
        return out

    def merge_long(self, row: np.ndarray) -> np.ndarray:
        """One row, merged in rounds: all places of the least rank at once, the left one first where two overlap.

        Neighbours are linked, and each rank knows the places that had it when they were looked up. Should a merge make a pair of
        lesser rank, which would have to be merged before the next place, the row is merged pair by pair instead.
        """
        n, start = len(row), row
        row, after, before = row.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.full(n, NONE, np.int32)
        ranks[: n - 1] = self.pairs.merged(row[:-1], row[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[ranks[places] != NONE]
            if not len(places):
                return
            order = np.argsort(ranks[places], kind="stable")
            places = places[order]
            values, first = np.unique(ranks[places], return_index=True)
            for value, part in zip(values.tolist(), np.split(places, first[1:]), strict=True):
                if value not in waiting:
                    waiting[value] = []
                    heapq.heappush(heap, value)
                waiting[value].append(part)

        wait(np.arange(n - 1))
        while heap:
            least = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(least)))
            places = places[ranks[places] == least]
            if not len(places):
                continue
            # Of a chain of overlapping places, the first, third, fifth ...
            head = np.ones(len(places), bool)
            head[1:] = after[places[:-1]] != places[1:]
            at = np.arange(len(places))
            places = places[(at - np.maximum.accumulate(np.where(head, at, 0))) % 2 == 0]
            right = after[places]
            # What stands to the right when a place is merged, be it merged itself afterwards.
            beyond = after[right]
            beyond = row[beyond[beyond < n]]
            if (self.pairs.merged(np.full(len(beyond), least, np.int32), beyond) < least).any():
                return self.merge_one_by_one(start)
            row[places], row[right], ranks[right] = least, -1, NONE
            after[places] = after[right]
            inner = after[places] < n
            before[after[places[inner]]] = places[inner]
            touched = np.concatenate([places, before[places]])
            touched = np.unique(touched[touched >= 0])
            follows = after[touched]
            ranks[touched] = NONE
            paired = follows < n
            ranks[touched[paired]] = self.pairs.merged(row[touched[paired]], row[follows[paired]])
            if (ranks[touched] < least).any():
                return self.merge_one_by_one(start)
            wait(touched)
        return row[row >= 0]

    def merge_one_by_one(self, row: np.ndarray) -> np.ndarray:
        """One row, merged in place: neighbours are linked, and each block of positions knows its least rank."""
        n = len(row)
        row, side = row.copy(), 1 << max(4, int(n**0.5).bit_length())
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.full(-(-n // side) * side, NONE, np.int32)
        ranks[: n - 1] = self.pairs.merged(row[:-1], row[1:])
        blocks = ranks.reshape(-1, side)
        least = blocks.min(axis=1)

        def put(position: int, value: int) -> None:
            ranks[position] = value
            least[position // side] = blocks[position // side].min()

        def rank_at(position: int) -> int:
            right = after[position]
            return int(self.pairs.merged(row[position : position + 1], row[right : right + 1])[0]) if right < n else int(NONE)

        while (block := int(least.argmin()), least[block])[1] != NONE:
            at = block * side + int(blocks[block].argmin())
            right = int(after[at])
            row[at] = ranks[at]
            row[right] = -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            put(right, NONE)
            put(at, rank_at(at))
            if before[at] >= 0:
                put(int(before[at]), rank_at(int(before[at])))
        return row[row >= 0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut, cache = self.cutter.cut(texts), self.cache
        missing = {p for pieces in cut for p in pieces if p not in cache}
        if len(cache) + len(missing) > CACHED_PIECES:
            cache.clear()
            missing = {p for pieces in cut for p in pieces}
        self.learn(missing)
        found = [np.frombuffer(b"".join(map(cache.__getitem__, pieces)), "<u4") for pieces in cut]
        for piece in missing:
            if len(piece) > LONGEST_CACHED:
                del cache[piece]
        return found

    def decode(self, tokens: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, tokens.tolist()))


def encoded(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, ids_sha256, decoded_sha256, round_trip, and the ids if kept."""
    shared = Shared(docs.sparkSession, Encoder(read_ranks(ranks_path), pattern))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)
    ddl = "doc_id bigint, n_bytes bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids

    def run(batches: Batches) -> Batches:
        encoder = shared.value
        for batch in batches:
            raws = raw_texts(batch)
            tokens = encoder.encode([raw.decode() for raw in raws])
            decoded = [encoder.decode(t) for t in tokens]
            yield batch_of(
                schema, ids(batch), [len(r) for r in raws], [len(t) for t in tokens], [sha256(t.tobytes()) for t in tokens],
                [sha256(d) for d in decoded], [d == r for d, r in zip(decoded, raws, strict=True)], *([[t.astype(np.int32) for t in tokens]] * keep_ids),
            )

    return id_text(docs).mapInArrow(run, ddl)


def decoded(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text of rows with ids; bytes that are no character become U+FFFD, null ids an empty text."""
    shared = Shared(tokens.sparkSession, {rank: token for token, rank in read_ranks(ranks_path).items()})
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Batches) -> Batches:
        table = shared.value
        for batch in batches:
            yield batch_of(schema, ids(batch), [b"".join(table[t] for t in row or []).decode(errors="replace") for row in batch.column(1).to_pylist()])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")
