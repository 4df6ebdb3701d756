"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

The first tier is a broadcast table of the token lengths of frequent pre-tokens, made from a bounded sample of documents: it only
saves work, no count depends on what is in it. The second tier is a cache in each worker: a pre-token that the table lacks is
encoded by the tokenizer's library once and remembered. Every text is cut and counted in full where it lies.

Special strings inside texts are one token each, as the library has it by default; the stretches between them are cut by the
tokenizer's own pattern, and a pre-token's length doesn't depend on its neighbours.

Defined cases: a null text is empty and has no tokens. A row without doc_id is counted like any other. Repeated rows get a row
each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import Batches, Shared, batch_of, id_text, ids, raw_texts
from acervo.llm.pretokens import Cutter, tokenizers_table

LIMIT = 1024
SAMPLE_ROWS = 2_000
TABLE_ENTRIES = 32_768
CACHED_PIECES = 300_000
LONGEST_CACHED = 64  # longer pre-tokens are encoded where they occur, so that the cache has a bound in bytes


class Lengths:
    """The token lengths of pre-tokens: a compact table of hashed frequent ones, then the worker's cache."""

    def __init__(self, definition: str, pattern: str):
        self.definition, self.cutter = definition, Cutter(pattern, lambda: tokenizers_table(definition))
        self.special = [t["content"] for t in json.loads(definition)["added_tokens"]]
        self.pieces: list[str] = []
        self.lengths = np.zeros(0, np.uint16)
        self.tools = None

    def __getstate__(self):
        return self.__dict__ | {"tools": None}

    def load(self) -> None:
        import regex
        from tokenizers import Tokenizer

        marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.tools = marks, Tokenizer.from_str(self.definition)
        self.table, self.cache = dict(zip(self.pieces, self.lengths.tolist(), strict=True)), {}

    def with_table(self, pieces: list[str]) -> Lengths:
        """With the given frequent pre-tokens; long ones stay out."""
        pieces = [p for p in pieces if len(p) <= LONGEST_CACHED]
        chosen = list(zip(pieces, self.encoded(pieces), strict=True))
        made = Lengths(self.definition, self.cutter.pattern)
        made.pieces, made.lengths = [p for p, _ in chosen], np.array([n for _, n in chosen], np.uint16)
        return made

    def encoded(self, pieces: list[str]) -> list[int]:
        if self.tools is None:
            self.load()
        return [len(e.ids) for e in self.tools[1].encode_batch_fast(pieces, add_special_tokens=False)]

    def cut(self, texts: list[str]) -> list[tuple[list[str], int]]:
        """Pre-tokens of each text, and the number of its special strings."""
        if self.tools is None:
            self.load()
        marks = self.tools[0]
        parts = [[text] if marks is None or marks.search(text) is None else marks.split(text) for text in texts]
        pieces = iter(self.cutter.cut([p for text in parts for p in text]))
        return [([piece for _ in text for piece in next(pieces)], len(text) - 1) for text in parts]

    def counts(self, texts: list[str]) -> list[int]:
        cut = self.cut(texts)
        table, cache = self.table, self.cache
        missing = {p for pieces, _ in cut for p in pieces if p not in table and p not in cache}
        if len(cache) + len(missing) > CACHED_PIECES:
            cache.clear()
            missing = {p for pieces, _ in cut for p in pieces if p not in table}
        new = list(missing)
        cache.update(zip(new, self.encoded(new), strict=True))
        counts = [special + sum(table[p] if p in table else cache[p] for p in pieces) for pieces, special in cut]
        for piece in new:
            if len(piece) > LONGEST_CACHED:
                del cache[piece]
        return counts


def frequent_pieces(docs: DataFrame, lengths: Lengths, sample_rows: int, entries: int) -> list[str]:
    """The most frequent pre-tokens of about ``sample_rows`` documents."""
    total = docs.count()
    if not total:
        return []
    share = min(1.0, sample_rows / total)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    shared = Shared(docs.sparkSession, lengths)
    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            counts: Counter = Counter()
            for pieces, _ in shared.value.cut([raw.decode() for raw in raw_texts(batch)]):
                counts.update(pieces)
            common = counts.most_common(entries)
            yield batch_of(schema, [p for p, _ in common], [n for _, n in common])

    counted = id_text(sample).mapInArrow(run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1")
    return [r.piece for r in counted.orderBy(F.desc("n"), "piece").limit(entries).collect()]


def token_counts(docs: DataFrame, definition_path: str, pattern: str, limit: int = LIMIT, sample_rows: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit."""
    with open(definition_path, encoding="utf-8") as file:
        lengths = Lengths(file.read(), pattern)
    lengths = lengths.with_table(frequent_pieces(docs, lengths, sample_rows, entries))
    shared = Shared(docs.sparkSession, lengths)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Batches) -> Batches:
        lengths = shared.value
        for batch in batches:
            raws = raw_texts(batch)
            if lengths.tools is None:
                lengths.load()
            yield batch_of(schema, ids(batch), [len(r) for r in raws], lengths.counts([r.decode() for r in raws]))

    counted = id_text(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
