"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are uni- and bigrams of words and uni-, bi- and trigrams of word shapes (letters, digits and marks folded, with a note
where a word repeats the one before), hashed to ``BUCKETS`` coordinates; a text's values are dampened counts of unit length, and
its score is a sparse dot product through the logistic curve.

Training rows, at most ``max_labelled`` of them by a hash of doc_id, lie in ``SHARDS`` shards by another hash. In each round
every shard starts from the common state of the updates, goes through its rows in a fixed order, and returns the changes of the
coordinates it touched; their mean is the next state. What comes back is bounded by the number of coordinates.

Defined cases: a null or empty text has no feature but the bias. A row without doc_id is scored like any other. Labels that are
null teach nothing; without training rows every document scores 0.5. Repeated rows get a row each; an empty table gives an empty
result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import MIX1, Batches, Bounded, Shared, batch_of, id_text, ids, mixed, raw_texts, staged
from acervo.llm.toxicity import held_out, training_rows

BUCKETS = 1 << 18
MAX_LABELLED = 12_000
SHARDS = 4
ROUNDS = 5
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
PASSING = 0.7
FOLDS = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"(?:[a-z]|[\x80-\xff])+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^Aa0])\1+"), rb"\1"))


def shape(word: bytes) -> bytes:
    for pattern, to in FOLDS:
        word = pattern.sub(to, word)
    return word


def hashes_of(word: bytes) -> tuple[int, int]:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(shape(word), seed=1)


def features(text: bytes, cache: Bounded) -> tuple[np.ndarray, np.ndarray]:
    """Ascending coordinates and their values; the bias is coordinate 0."""
    pairs = list(map(cache.__getitem__, text.split()))
    if not pairs:
        return np.zeros(1, np.int64), np.ones(1)
    word, form = np.array(pairs, np.uint64).T
    form = form.copy()
    form[1:][word[1:] == word[:-1]] += np.uint64(1)
    grams = [
        run * MIX1 + np.uint64(kind)
        for kind, run in enumerate((word, mixed(word[:-1]) + word[1:], form, mixed(form[:-1]) + form[1:], mixed(mixed(form[:-2]) + form[1:-1]) + form[2:]))
    ]
    at, counts = np.unique(mixed(np.concatenate(grams)) % np.uint64(BUCKETS - 1) + np.uint64(1), return_counts=True)
    values = np.log1p(counts)
    return np.concatenate([[0], at.astype(np.int64)]), np.concatenate([[1.0], values * (3 / np.sqrt((values * values).sum()))])


def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights of a state."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def dot(w: np.ndarray, values: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(w @ values, -30, 30))))


def follow(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """One update a row, in place."""
    for at, values, label in rows:
        w = leader(z[at], n[at])
        g = (dot(w, values) - label) * values
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g


def shard_changes(shared: Shared, turn: int):
    """Goes through a shard's rows from a common state, and gives the changed coordinates."""
    schema = pa.schema([("at", pa.int64()), ("z", pa.float64()), ("n", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        z, n = (part.copy() for part in shared.value)
        cache = Bounded(hashes_of)
        order = np.argsort(mixed(np.array(table["doc_id"].to_pylist(), np.int64).view(np.uint64) + np.uint64(turn + 1)), kind="stable")
        texts, labels = table["text"].cast(pa.binary()).to_pylist(), table["label"].to_pylist()
        follow(z, n, [(*features(texts[k], cache), labels[k]) for k in order.tolist()])
        dz, dn = z - shared.value[0], n - shared.value[1]
        at = np.flatnonzero((dz != 0) | (dn != 0))
        return pa.table([at, dz[at], dn[at]], schema=schema)

    return run


def train_weights(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by coordinate."""
    train = training_rows(docs, labels, "quality", held_out(4, 2), max_labelled)
    train = staged(train.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SHARDS)).cast("int")))
    state = np.zeros((2, BUCKETS))
    for turn in range(rounds):
        run = shard_changes(Shared(docs.sparkSession, state), turn)
        changes = train.groupBy("shard").applyInArrow(run, "at bigint, z double, n double").groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toPandas()
        state = state.copy()
        state[:, changes["at"].to_numpy(np.int64)] += changes[["z", "n"]].to_numpy(float).T / SHARDS
    return leader(*state)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = Shared(docs.sparkSession, weights.astype(np.float32))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Batches) -> Batches:
        weights, cache = shared.value, Bounded(hashes_of)
        for batch in batches:
            yield batch_of(schema, ids(batch), [dot(weights[at], values) for at, values in (features(text, cache) for text in raw_texts(batch))])

    scored = id_text(docs).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", F.when(F.col("score") >= PASSING, 1).otherwise(0).alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    return score(docs, train_weights(docs, labels, max_labelled))
