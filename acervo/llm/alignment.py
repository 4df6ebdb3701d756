"""Alignment of two tokenizers' tokens over the same bytes, and what their links say corpus-wide.

Both tokenizers encode a text; the byte offsets where a token of each ends are shared cuts. They are found by divide and conquer:
an interval between two shared cuts is probed from its middle outwards, each probe a bisect of one tokenizer's end among the
other's, until the nearest shared cut is found; both halves go on, and an interval without a cut inside is a leaf group. All
intervals of a batch of texts are probed together as arrays, in windows that double, so an interval is never looked at more than
a logarithm of times.

The last tokens of a group end together, so each group links one pair. Pairs are counted inside tasks before they are shuffled.
To read a pair's count back to the documents, the pairs that hold more than 1 / HEAVY of all links, fewer than HEAVY whatever the
corpus, go to every task as a sorted array; the others, none of which is frequent, are joined by pair.

Tokenizer A takes a space and the text, B the text, to which it adds that space itself. Special strings are plain text.

Defined cases: null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have no tokens: zeros and an
empty digest. A row without doc_id is aligned like any other. Repeated rows get a row each and count each; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import Batches, Shared, batch_of, id_text, ids, raw_texts, sha256, staged
from acervo.llm.pretokens import BYTE_LEVEL_PATTERN

HEAVY = 1 << 16
CHUNK = 1 << 20  # bytes of text aligned at once; a longer text is aligned by itself
HELD_PAIRS = 1 << 20  # pairs that a task counts before it hands their counts on
SPACE = "▁"
LONG_RUN = 1_000
UNSURE = re.compile(r"[^\x00-\u024f]|\s{%d}" % LONG_RUN)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode()


class Tokenizers:
    """Both tokenizers with the bytes of their tokens; the libraries' objects are made where they are used."""

    def __init__(self, definition: str, model: bytes):
        self.definition, self.model, self.ready = definition, model, False

    def __getstate__(self):
        return {"definition": self.definition, "model": self.model, "ready": False}

    def load(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(self.definition)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=self.model)
        special = {t["id"]: t["content"].encode() for t in json.loads(self.definition)["added_tokens"]}
        byte_of = byte_alphabet()
        entries = sorted((i, piece) for piece, i in self.a.get_vocab(with_added_tokens=True).items())
        self.a_bytes = [b""] * (entries[-1][0] + 1)
        for i, piece in entries:
            self.a_bytes[i] = special[i] if i in special else bytes(byte_of[c] for c in piece)
        self.quick = self._by_ranks(special)
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.width = len(self.b_bytes)
        self.digits = Digits(max(len(self.a_bytes), len(self.b_bytes)))
        self.ready = True

    def _by_ranks(self, special: dict[int, bytes]):
        """A quicker encoder of the same ids, or None: where A cuts by the usual pattern alone and its merges make ids in their order, ids are ranks."""
        import tiktoken

        definition = json.loads(self.definition)
        cut, model = definition["pre_tokenizer"] or {}, definition["model"]
        if definition["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space"):
            return None
        vocabulary = model["vocab"]
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        singles = len(vocabulary) - len(merged) - sum(i in vocabulary.values() for i in special)
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if not plain or singles != 256 or merged != list(range(256, 256 + len(merged))):
            return None
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _a_tokens(self, texts: list[str]) -> list[list[int]]:
        """Tokens of A. Letters up to U+024F, whose classes every version of Unicode has alike, in runs of a usual length go the quick way."""
        sure = [self.quick is not None and UNSURE.search(t) is None and max(map(len, t.split()), default=0) < LONG_RUN for t in texts]
        others = iter(self.a.encode_batch_fast([t for t, s in zip(texts, sure, strict=True) if not s], add_special_tokens=False))
        return [self.quick.encode_ordinary(t) if s else next(others).ids for t, s in zip(texts, sure, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of A and B of each text; none where the bytes of either aren't the text's."""
        if not self.ready:
            self.load()
        spaced = [" " + text for text in texts]
        a, b = self._a_tokens(spaced), self.b.encode(texts, num_threads=1)
        for k, text in enumerate(spaced):
            raw = text.encode()
            same = len(raw) > 1 and b"".join([self.a_bytes[i] for i in a[k]]) == raw and b"".join([self.b_bytes[i] for i in b[k]]) == raw
            if not same:
                a[k] = b[k] = []
        return a, b


class Digits:
    """Token ids as decimal text with a separator after each, put together without a loop over tokens."""

    SEPARATORS = b",|;"

    def __init__(self, ids: int):
        self.width = len(str(ids)) + 1
        self.sizes = np.array([len(str(i)) + 1 for i in range(ids)], np.int64)
        rows = b"".join(f"{i}{chr(s)}".encode().ljust(self.width, b"\0") for i in range(ids) for s in self.SEPARATORS)
        self.table = np.frombuffer(rows, np.uint8).reshape(-1, self.width)

    def joined(self, tokens: np.ndarray, separators: np.ndarray) -> bytes:
        found = self.table[tokens * len(self.SEPARATORS) + separators]
        return found[found != 0].tobytes()


def nearest_shared(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each interval's inner ends of A, ``lo`` to ``hi`` (inclusive), the one nearest its middle that B shares: places in A and B, -1 for none."""
    n = len(lo)
    middle = (lo + hi) // 2
    at, there = np.full(n, -1), np.full(n, -1)
    left = np.arange(n)
    reach = 0
    while len(left):
        first, last = np.maximum(lo[left], middle[left] - reach), np.minimum(hi[left], middle[left] + reach)
        sizes = last - first + 1
        owner = np.repeat(np.arange(len(left)), sizes)
        probe = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]
        place = np.searchsorted(b, a[probe])
        shared = b[place] == a[probe]
        owner, probe, place = owner[shared], probe[shared], place[shared]
        distance = np.abs(probe - middle[left][owner]) * 2 + (probe > middle[left][owner])
        order = np.lexsort((distance, owner))
        owner, probe, place = owner[order], probe[order], place[order]
        once = np.ones(len(owner), bool)
        once[1:] = owner[1:] != owner[:-1]
        met = left[owner[once]]
        at[met], there[met] = probe[once], place[once]
        whole = (first == lo[left]) & (last == hi[left])
        left = left[(at[left] < 0) & ~whole]
        reach = reach * 2 + 1
    return at, there


def shared_cuts(a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the groups, as numbers of tokens of A and of B before them.

    ``a`` and ``b`` are ascending ends of tokens; ``a_stops`` and ``b_stops`` the numbers of tokens at cuts known to be shared (the
    ends of texts), without 0 and in order.
    """
    a_lo, b_lo = np.concatenate([[0], a_stops[:-1]]), np.concatenate([[0], b_stops[:-1]])
    a_hi, b_hi = a_stops, b_stops
    leaves: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a_hi):
        open_ = (a_hi - a_lo > 1) & (b_hi - b_lo > 1)
        leaves.append((a_hi[~open_], b_hi[~open_]))
        a_lo, a_hi, b_lo, b_hi = (x[open_] for x in (a_lo, a_hi, b_lo, b_hi))
        at, there = nearest_shared(a, b, a_lo, a_hi - 2)
        cut = at >= 0
        leaves.append((a_hi[~cut], b_hi[~cut]))
        a_lo, a_hi, b_lo, b_hi, at, there = (x[cut] for x in (a_lo, a_hi, b_lo, b_hi, at, there))
        a_lo, a_hi = np.concatenate([a_lo, at + 1]), np.concatenate([at + 1, a_hi])
        b_lo, b_hi = np.concatenate([b_lo, there + 1]), np.concatenate([there + 1, b_hi])
    a_cuts, b_cuts = (np.sort(np.concatenate(side)) for side in zip(*leaves, strict=True)) if leaves else (a_stops, b_stops)
    return a_cuts, b_cuts


class Aligned:
    """The groups of a few texts: tokens in a row, and the numbers of tokens of A and of B at each group's end."""

    def __init__(self, tools: Tokenizers, texts: list[str]):
        a, b = tools.encode(texts)
        self.tools, self.n_a, self.n_b = tools, np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.a = np.fromiter(chain.from_iterable(a), np.int64, int(self.n_a.sum()))
        self.b = np.fromiter(chain.from_iterable(b), np.int64, int(self.n_b.sum()))
        held = self.n_a > 0
        self.a_ends, self.b_ends = np.cumsum(tools.a_sizes[self.a]), np.cumsum(tools.b_sizes[self.b])
        self.a_cuts, self.b_cuts = shared_cuts(self.a_ends, self.b_ends, np.cumsum(self.n_a)[held], np.cumsum(self.n_b)[held])
        # The groups before each text, and in each.
        stops = np.searchsorted(self.a_cuts, np.cumsum(self.n_a), side="right")
        self.starts = np.concatenate([[0], stops[:-1]])
        self.n_groups = stops - self.starts

    def links(self) -> np.ndarray:
        """The pair that each group links, as one number."""
        return self.a[self.a_cuts - 1] * self.tools.width + self.b[self.b_cuts - 1]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups: ``a1,a2|b1;a3|b2,b3``."""
        n = len(self.a_cuts)
        a_before, b_before = np.concatenate([[0], self.a_cuts[:-1]]), np.concatenate([[0], self.b_cuts[:-1]])
        group_a, group_b = np.repeat(np.arange(n), self.a_cuts - a_before), np.repeat(np.arange(n), self.b_cuts - b_before)
        tokens, separators = np.empty(len(self.a) + len(self.b), np.int64), np.zeros(len(self.a) + len(self.b), np.int64)
        tokens[np.arange(len(self.a)) + b_before[group_a]] = self.a
        tokens[np.arange(len(self.b)) + self.a_cuts[group_b]] = self.b
        separators[self.a_cuts - 1 + b_before] = 1
        separators[self.b_cuts - 1 + self.a_cuts] = 2
        written = self.tools.digits.joined(tokens, separators)
        ends = np.concatenate([[0], np.cumsum(self.tools.digits.sizes[tokens])])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [sha256(written[i : j - 1]) if j > i else "" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def chunks(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > CHUNK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def tokenizers(definition_path: str, model_path: str) -> Tokenizers:
    with open(definition_path, encoding="utf-8") as definition, open(model_path, "rb") as model:
        return Tokenizers(definition.read(), model.read())


def groups(docs: DataFrame, tools: Tokenizers) -> DataFrame:
    """Every group of every text: doc_id, place (from 0), a_ids, b_ids, and the byte of space+text at which it ends."""
    shared = Shared(docs.sparkSession, tools)
    tokens = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("a_ids", tokens), ("b_ids", tokens), ("end", pa.int64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            names = ids(batch).to_pylist()
            for part in chunks([raw.decode() for raw in raw_texts(batch)]):
                found = Aligned(shared.value, part)
                owner = np.repeat(np.arange(len(part)), found.n_groups)
                place = np.arange(len(owner)) - np.repeat(found.starts, found.n_groups)
                offsets = [pa.array(np.concatenate([[0], cuts]), pa.int32()) for cuts in (found.a_cuts, found.b_cuts)]
                before = np.concatenate([[0], found.a_ends])[np.cumsum(found.n_a) - found.n_a]
                ends = found.a_ends[found.a_cuts - 1] - before[owner]
                yield batch_of(
                    schema, [names[k] for k in owner], place,
                    pa.ListArray.from_arrays(offsets[0], pa.array(found.a)), pa.ListArray.from_arrays(offsets[1], pa.array(found.b)), ends,
                )
                names = names[len(part) :]

    return id_text(docs).mapInArrow(run, "doc_id bigint, place bigint, a_ids array<bigint>, b_ids array<bigint>, end bigint")


def linked(docs: DataFrame, tools: Tokenizers) -> DataFrame:
    """Per row: row (a number of its own), doc_id, n_a, n_b, n_groups, groups_sha256, and its different pairs with how often it links them."""
    shared = Shared(docs.sparkSession, tools)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
         ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            names, parts = ids(batch).to_pylist(), list(chunks([raw.decode() for raw in raw_texts(batch)]))
            for part in parts:
                found = Aligned(shared.value, part)
                links, owner = found.links(), np.repeat(np.arange(len(part)), found.n_groups)
                order = np.lexsort((links, owner))
                links, owner = links[order], owner[order]
                new = np.ones(len(links), bool)
                new[1:] = (links[1:] != links[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                times = np.diff(first, append=len(links))
                bounds = pa.array(np.searchsorted(owner[first], np.arange(len(part) + 1)), pa.int32())
                yield batch_of(
                    schema, names[: len(part)], found.n_a, found.n_b, found.n_groups, found.digests(),
                    pa.ListArray.from_arrays(bounds, pa.array(links[first])), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
                )
                names = names[len(part) :]

    rows = id_text(docs).mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
    )
    return staged(rows.withColumn("row", F.monotonically_increasing_id()))


def flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    once, place = np.unique(pairs, return_inverse=True)
    return once, np.bincount(place, times, minlength=len(once)).astype(np.int64)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): the links of each pair corpus-wide, and whether no pair of the same token of B has more."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def count(batches: Batches) -> Batches:
        held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held, n = summed(np.concatenate([held, flat(batch, "pairs")]), np.concatenate([n, flat(batch, "times")]))
            if len(held) > HELD_PAIRS:
                yield batch_of(schema, held, n)
                held, n = held[:0], n[:0]
        yield batch_of(schema, held, n)

    counts = staged(rows.select("pairs", "times").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    token = F.col("pair") % width
    # One row per token of B: bounded by the vocabulary.
    most = counts.groupBy(token.alias("b_id")).agg(F.max("n").alias("most"))
    return staged(counts.withColumn("b_id", token).join(F.broadcast(most), "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def align(docs: DataFrame, tools: Tokenizers, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    tools.load()
    rows = linked(docs, tools)
    counts = pair_counts(rows, tools.width)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.where(F.col("n") * heavy > total)  # fewer than ``heavy`` rows
    held = frequent.orderBy("pair").toPandas()
    known = Shared(spark, (held.pair.to_numpy(np.int64), held.n.to_numpy(np.int64), held.best.to_numpy(np.int64)))
    lists = pa.list_(pa.int64())
    schema = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("pairs", lists), ("times", lists)])

    def settle(batches: Batches) -> Batches:
        pairs, n, best = known.value
        for batch in batches:
            asked, times = flat(batch, "pairs"), flat(batch, "times").astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), batch.column(batch.schema.get_field_index("pairs")).value_lengths().to_numpy(zero_copy_only=False))
            place = np.minimum(np.searchsorted(pairs, asked), max(len(pairs) - 1, 0))
            hit = pairs[place] == asked if len(pairs) else np.zeros(len(asked), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], owner[hit], times[hit] * best[place[hit]])
            np.add.at(sums[1], owner[hit], times[hit] * n[place[hit]])
            bounds = pa.array(np.searchsorted(owner[~hit], np.arange(batch.num_rows + 1)), pa.int32())
            yield batch_of(
                schema, ids(batch, "row"), sums[0], sums[1],
                pa.ListArray.from_arrays(bounds, pa.array(asked[~hit])), pa.ListArray.from_arrays(bounds, pa.array(times[~hit])),
            )

    settled = staged(
        rows.select("row", "pairs", "times").mapInArrow(settle, "row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")
    )
    rare = settled.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    others = rare.join(counts.where(F.col("n") * heavy <= total), "pair").select(
        "row", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
    )
    sums = settled.select("row", "n_best", "count_sum").unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )
