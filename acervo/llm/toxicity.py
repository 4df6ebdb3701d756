"""Toxic passages as maximum-scoring segments of token log-odds.

Learned from labelled documents: each token's log-odds of toxic against clean documents under a Dirichlet prior, with its
z-score; tokens of a small z-score score 0 besides the drift that every token pays, the others their log-odds less some standard
errors. How small is chosen from ``MIN_Z`` by the loss on the calibration rows. A word that isn't telling itself counts by its beginning, if that is. A linear scan finds all maximal segments of positive
score in a text. The best segment's score, less what its text's length alone would give, is calibrated by a Gumbel
(extreme-value) law fitted to clean documents; the log of its tail probability and the segment's score give the document's score
by a logistic curve.

Only training rows teach: at most ``max_labelled`` of them, chosen by a hash of doc_id, so that what is held in memory at once
has a fixed bound; equal texts of one label teach once. The model holds all telling tokens, which that bound limits, too.

Defined cases: a null or empty text has no segment and gets the score of such a text. A row without doc_id is scored like any
other. Labels that are null teach nothing; without a toxic or without a clean training row every document scores 0.
Repeated rows get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import Batches, Bounded, Shared, batch_of, bound_batches, id_text, ids, raw_texts, staged

MAX_LABELLED = 20_000
MIN_Z = (2.0, 2.5, 3.0, 3.5)  # least z-scores of telling tokens to choose from
PRIOR = 0.05  # weight of the Dirichlet prior against all counts; a token's part is its share of these
DRIFT = 0.5
SIGNIFICANT = 0.01
STEMS = (7, 5, 3)  # bytes of a word's beginning that stand for it when the word itself tells nothing
CAUTION = 1.5  # standard errors taken off a token's log-odds
EDGE = bytes(c for c in range(128) if not chr(c).isalnum())


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder kept from training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held: Column, max_labelled: int) -> DataFrame:
    """Texts with their label: at most ``max_labelled`` labelled rows, by a hash of doc_id; broadcast, as their number is bounded."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").dropDuplicates(["doc_id"]).filter(~held)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def tokens_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), without ASCII marks at their ends."""
    return [w for w in (word.strip(EDGE) for word in text.lower().split()) if w]


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    location: float = 0.0
    scale: float = 1.0
    growth: float = 0.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    trained: bool = False


def maximal_segments(positions: list[int], gains: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa), in time linear in the number of telling tokens.

    ``positions`` ascend; every other token scores ``-drift``. Returns (first, last, score).
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum at the end, nearest earlier with a lesser sum before
    total, before = 0.0, -1
    for position, gain in zip(positions, gains, strict=True):
        total -= drift * (position - before - 1)
        before = position
        if gain <= 0:
            total += gain
            continue
        first, left, right = position, total, total + gain
        total = right
        k = len(found) - 1
        while k >= 0 and found[k][2] >= left:
            k = found[k][4]
        while k >= 0 and found[k][3] < right:
            first, _, left, _, link = found[k]
            del found[k:]
            k = link
        found.append((first, position, left, right, k))
    return [(first, last, right - left) for first, last, left, right, _ in found]


def stems(token: bytes) -> list[bytes]:
    return [b"^" + token[:n] for n in STEMS if len(token) > n]


def scorer(scores: dict[bytes, float]) -> Bounded:
    """The score of a word by itself or its longest telling beginning; None for a word that tells nothing."""
    return Bounded(lambda token: next((scores[t] for t in (token, *stems(token)) if t in scores), None))


def segments_of(text: bytes, scores: Bounded) -> tuple[list[tuple[int, int, float]], int]:
    tokens = tokens_of(text)
    hits = [(k, s) for k, s in enumerate(map(scores.__getitem__, tokens)) if s is not None]
    return maximal_segments([k for k, _ in hits], [s - DRIFT for _, s in hits], DRIFT) if hits else [], len(tokens)


def best_segment(text: bytes, scores: Bounded) -> tuple[float, int]:
    found, n = segments_of(text, scores)
    return max((s for _, _, s in found), default=0.0), n


def tail(model: Model, score: float, n: int) -> float:
    """-log of the probability that a clean text of n tokens has a segment of this score or better."""
    x = (score - model.growth * math.log1p(n) - model.location) / model.scale
    return max(0.0, x if x > 30 else -math.log(-math.expm1(-math.exp(-x))) if x > -3 else 0.0)


def features(model: Model, scores: Bounded, text: bytes) -> tuple[float, float]:
    """Evidence and score of the best segment."""
    found, n = segments_of(text, scores)
    best = max((s for _, _, s in found), default=0.0)
    return (min(50.0, tail(model, best, n)), min(best, 50.0)) if found else (0.0, 0.0)


def probability(model: Model, scores: Bounded, text: bytes) -> float:
    if not model.trained:
        return 0.0
    evidence, best = features(model, scores, text)
    a, b, c = model.weights
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * evidence + c * best))))


def token_scores(train: DataFrame) -> dict[bytes, tuple[float, float]]:
    """Score and size of the z-score of tokens, counted once per document, whose z-score is large."""
    schema = pa.schema([("token", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches: Batches) -> Batches:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(raw_texts(batch), batch.column(2).to_pylist(), strict=True):
                words = set(tokens_of(text))
                counts[label].update(words | {stem for word in words for stem in stems(word)})
            both = list(counts[0].keys() | counts[1].keys())
            yield batch_of(schema, both, [counts[1][t] for t in both], [counts[0][t] for t in both])

    counted = staged(train.mapInArrow(count, "token binary, toxic bigint, clean bigint").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    all_toxic, all_clean = (float(x or 0) for x in counted.agg(F.sum("toxic"), F.sum("clean")).first())
    if not all_toxic or not all_clean:
        return {}
    total = all_toxic + all_clean
    prior = PRIOR * (F.col("toxic") + F.col("clean"))
    in_toxic, in_clean = F.col("toxic") + prior * all_toxic / total, F.col("clean") + prior * all_clean / total
    rest = PRIOR * total
    odds = F.log(in_toxic / (all_toxic + rest * all_toxic / total - in_toxic)) - F.log(in_clean / (all_clean + rest * all_clean / total - in_clean))
    error = F.sqrt(1 / in_toxic + 1 / in_clean)
    sure = F.signum(odds) * (F.abs(odds) - CAUTION * error)
    scored = counted.filter("toxic + clean > 1").select("token", sure.alias("score"), (odds / error).alias("z"))
    telling = scored.filter(F.abs("z") >= MIN_Z[0]).orderBy("token")
    return {bytes(r.token): (float(r.score), abs(float(r.z))) for r in telling.collect()}


def gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Location, scale and growth with the log of length, of clean texts' best scores (by moments)."""
    if len(best) < 2:
        return 0.0, 1.0, 0.0
    x = np.log1p(n)
    growth = max(0.0, float(np.cov(x, best)[0, 1] / x.var())) if x.var() > 0 else 0.0
    rest = best - growth * x
    scale = max(float(rest.std()) * math.sqrt(6) / math.pi, 0.05)
    return float(rest.mean()) - 0.5772156649 * scale, scale, growth


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights by Newton steps with a little shrinkage."""
    x = np.column_stack([np.ones(len(x)), x])
    w, shrink = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train_model(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Tokens from three quarters of the training rows, calibration from the fourth, which the tokens haven't seen."""
    train = staged(training_rows(docs, labels, "toxic", held_out(5, 0), max_labelled).dropDuplicates(["text", "label"]))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 3
    tokens = token_scores(train.filter(~fold))
    if not tokens:
        return Model()
    choices = [{t: s for t, (s, z) in tokens.items() if z >= least} for least in MIN_Z]
    schema = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("best", pa.list_(pa.float64()))])

    def measure(batches: Batches) -> Batches:
        scorers = [scorer(scores) for scores in choices]
        for batch in batches:
            texts = raw_texts(batch)
            best = [[best_segment(text, by_word)[0] for by_word in scorers] for text in texts]
            yield batch_of(schema, batch.column(2), [len(tokens_of(text)) for text in texts], best)

    rows = train.filter(fold).mapInArrow(measure, "label int, n bigint, best array<double>").toPandas()
    if rows.label.nunique() < 2:
        return Model()
    bests = np.stack(rows.best.to_numpy())
    fitted = [fit(scores, bests[:, k], rows.n.to_numpy(), rows.label.to_numpy()) for k, scores in enumerate(choices)]
    return min(fitted, key=lambda pair: pair[0])[1]


def fit(scores: dict[bytes, float], best: np.ndarray, n: np.ndarray, label: np.ndarray) -> tuple[float, Model]:
    """The calibrated model of some token scores, with its log loss."""
    model = Model(scores, trained=True)
    model.location, model.scale, model.growth = gumbel(best[label == 0], n[label == 0])
    x = np.minimum(np.column_stack([[tail(model, b, int(m)) if b else 0.0 for b, m in zip(best, n, strict=True)], best]), 50.0)
    weights = logistic(x, label.astype(float))
    model.weights = tuple(float(w) for w in weights)
    p = np.clip(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))), 1e-9, 1 - 1e-9)
    return float(-np.where(label == 1, np.log(p), np.log(1 - p)).mean()), model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments (significant ones), passages (first and last token, score)."""
    shared = Shared(docs.sparkSession, model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", kind)])

    def run(batches: Batches) -> Batches:
        model = shared.value
        by_word = scorer(model.scores)
        for batch in batches:
            texts = raw_texts(batch)
            passages = []
            for text in texts:
                found, n = segments_of(text, by_word)
                passages.append([{"first": f, "last": e, "score": s} for f, e, s in found if tail(model, s, n) > -math.log(SIGNIFICANT)])
            yield batch_of(schema, ids(batch), [probability(model, by_word, t) for t in texts], passages)

    scored = id_text(docs).mapInArrow(run, "doc_id bigint, score double, passages array<struct<first: bigint, last: bigint, score: double>>")
    return scored.select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("passages").cast("long").alias("n_segments"), "passages",
    )


def toxic_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    return score(docs, train_model(docs, labels, max_labelled))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that aren't predicted toxic, columns as they were. The text is scored where it lies; nothing is shuffled."""
    model = Shared(docs.sparkSession, train_model(docs, labels, max_labelled))
    bound_batches(docs)

    def run(batches: Batches) -> Batches:
        by_word = scorer(model.value.scores)
        for batch in batches:
            keep = [probability(model.value, by_word, text or b"") < 0.5 for text in raw_texts(batch)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
