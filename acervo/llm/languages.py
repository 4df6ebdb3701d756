"""The language of texts, and of the stretches of mixed ones.

Letters are told apart by their script. A word is a run of letters of one script, taken in units of at most ``UNIT`` letters
where a script has no blanks; languages that were hardly ever seen in that script are no candidates for it. A word's score for a
language is the log-likelihood ratio of its hashed letter n-grams and of itself, against all languages together. The Viterbi path
over a text's words, in which each change of language costs ``SWITCH``, labels the stretches; the language that labels most
letters is the text's.

Paths are found for many texts at once. Where no stretch of any other language gains more than half a change against the best
single language of a text, that language's constant path is the best one (a path of k changes has at most k + 1 stretches that
gain, or k and one that doesn't), so only the other texts go through the recursion, word by word for all of them together.

Only rows with a language, outside the held-out third, teach: at most ``max_labelled``, taken in turn from each language by a hash
of doc_id, whole texts each.

Defined cases: a text that is null or has no letter is ``und`` with score 0. Without any row to learn from every text is. Letters
that tell nothing leave the most frequent language. A row without doc_id is labelled like any other and may teach. Repeated rows
get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm.common import MIX1, MIX2, Batches, Shared, batch_of, bound_batches, id_text, ids, mixed, raw_texts, staged

MAX_LABELLED = 20_000
BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
UNIT = 24
PRIOR = 1_000  # n-grams' worth of what all languages share
MOST = 4.0  # size of an n-gram's score at most
SWITCH = 10.0
SELDOM = 0.001  # least share of a language's letters in a script, to be a candidate there
AGAINST = 30.0  # a word's score for languages that are no candidates
UNKNOWN = "und"
CHUNK = 4_000_000  # letters times languages over 8, labelled at once
CACHED_WORDS = 200_000
MARK = 255  # belongs to the letter before it

# Ranges of code points by script, after the Unicode blocks.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F), (0xFB13, 0xFB17)),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "oriya": ((0xB00, 0xB7F),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "myanmar": ((0x1000, 0x109F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "ethiopic": ((0x1200, 0x139F), (0x2D80, 0x2DDF)),
    "khmer": ((0x1780, 0x17FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "han": ((0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}
OTHER = len(SCRIPTS) + 1


def script_table() -> np.ndarray:
    """For each code point: 0 if it is no letter, MARK, or the number of its script from 1 on."""
    table = np.zeros(0x110000, np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), start=1):
        for first, last in ranges:
            table[first : last + 1] = number
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(len(table)))
    kind = np.frombuffer(kinds.encode(), np.uint8)
    letter = kind == ord("L")
    table[letter & (table == 0)] = OTHER
    table[~letter] = 0
    table[kind == ord("M")] = MARK
    return table


class Words:
    """The words of a few texts: the text each is of, its script, where it begins and ends there in code points, and the word."""

    def __init__(self, texts: list[str], table: np.ndarray):
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        script = table[points]
        # A mark belongs to what is before it; a text's first character has a line feed before it.
        settled = np.where(script == MARK, 0, np.arange(len(script)))
        script = script[np.maximum.accumulate(settled)]
        if len(script) and script[0] == MARK:
            script = np.where(np.logical_and.accumulate(script == MARK), 0, script)
        change = np.ones(len(script), bool)
        change[1:] = script[1:] != script[:-1]
        begin = np.maximum.accumulate(np.where(change, np.arange(len(script)), 0))
        starts = np.flatnonzero((script > 0) & ((np.arange(len(script)) - begin) % UNIT == 0))
        bounds = np.append(np.flatnonzero(change | ((script > 0) & ((np.arange(len(script)) - begin) % UNIT == 0))), len(script))
        ends = bounds[np.searchsorted(bounds, starts, side="right")]
        self.n, offsets = len(texts), np.concatenate([[0], np.cumsum(sizes)])
        self.owner = np.searchsorted(offsets, starts, side="right") - 1
        self.script, self.start, self.end = script[starts], starts - offsets[self.owner], ends - offsets[self.owner]
        self.words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        self.letters = ends - starts


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed features of words, order by order: buckets, and where each word's begin and end among them."""
    lowered = [w.lower() for w in words]
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in lowered).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in lowered], np.int64)
    ends = np.cumsum(sizes)
    first = ends - sizes
    end_of = np.repeat(ends, sizes)
    place = np.arange(len(points))
    for order in ORDERS:
        inside = np.flatnonzero(place + order <= end_of)
        h = np.full(len(inside), order, np.uint64)
        for k in range(order):
            h = mixed(h * MIX1 + points[inside + k])
        yield (h % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(inside, first), np.searchsorted(inside, ends)
    whole = mixed(points + (place - np.repeat(first, sizes)).astype(np.uint64) * MIX2)
    h = mixed(np.add.reduceat(whole, first)) if len(words) else whole[:0]
    yield (h % np.uint64(BUCKETS)).astype(np.int64), np.arange(len(words)), np.arange(1, len(words) + 1)


class Model:
    """Languages, the score of each bucket for each, each language's share of rows, and the scripts it is seen in (``used``)."""

    def __init__(self, languages: list[str], weights: np.ndarray, prior: np.ndarray, used: np.ndarray, table: np.ndarray):
        self.languages, self.weights, self.prior, self.table = languages, weights, prior, table
        # In a script that no language is seen in, words tell nothing and narrow nothing.
        self.told = used.any(axis=1, keepdims=True)
        self.against = np.where(used | ~self.told, 0.0, -AGAINST)
        self.clear()

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "scores": None}

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        if self.scores is None or len(self.known) > CACHED_WORDS:
            self.clear()
        new = list({w for w in words if w not in self.known})
        if new:
            rows = np.zeros((len(new), len(self.languages)))
            for buckets, first, last in grams(new):
                # Added up word by word, so that a score doesn't hang on what else is scored.
                some = last > first
                if some.any():
                    rows[some] += np.add.reduceat(self.weights[buckets].astype(np.float64), first[some], axis=0)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, rows / len(ORDERS)])
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str]) -> tuple[Words, np.ndarray, list[str], np.ndarray]:
        """Words, the language of each, and each text's language and score."""
        words = Words(texts, self.table)
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages or not words.words:
            return words, np.zeros(len(words.words), np.int64), names, score
        s = self.word_scores(words.words) * self.told[words.script] + self.against[words.script]
        first = np.flatnonzero(np.diff(words.owner, prepend=-1))
        s[first] += self.prior
        path = best_paths(s, first, SWITCH)
        held = np.zeros((len(first), len(self.languages)))
        row = np.repeat(np.arange(len(first)), np.diff(first, append=len(s)))
        np.add.at(held, (row, path), words.letters)
        total = np.add.reduceat(s, first, axis=0)
        # Most letters, then the better total.
        most = held == held.max(axis=1, keepdims=True)
        chosen = np.where(most, total, -np.inf).argmax(axis=1)
        every = np.arange(len(first))
        share = held[every, chosen] / held.sum(axis=1)
        rest = total.copy()
        rest[every, chosen] = -np.inf
        margin = total[every, chosen] - rest.max(axis=1) if len(self.languages) > 1 else np.full(len(first), 30.0)
        score[words.owner[first]] = share / (1 + np.exp(-np.clip(margin, -30, 30)))
        for text, language in zip(words.owner[first].tolist(), chosen.tolist(), strict=True):
            names[text] = self.languages[language]
        return words, path, names, score


def best_paths(s: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best path of each text through its words' scores; ``first`` has each text's first row."""
    sizes = np.diff(first, append=len(s))
    best = np.add.reduceat(s, first, axis=0).argmax(axis=1)
    owner = np.repeat(np.arange(len(first)), sizes)
    over = s - s[np.arange(len(s)), best[owner]][:, None]
    # Sums from each text's beginning, each text lower than all before it, so that running minima start anew with it.
    total = np.cumsum(over, axis=0)
    total -= np.concatenate([np.zeros((1, s.shape[1])), total])[first][owner]
    span = 2 * np.abs(total).max(initial=0.0) + 1
    before = total - over - (owner * span)[:, None]
    gain = (total - (owner * span)[:, None] - np.minimum.accumulate(before, axis=0)).max(axis=1)
    path = best[owner]
    mixed_texts = np.flatnonzero(np.maximum.reduceat(gain, first) > switch / 2)
    if len(mixed_texts):
        rows = np.flatnonzero(np.isin(owner, mixed_texts))
        starts = np.concatenate([[0], np.cumsum(sizes[mixed_texts])])[:-1]
        path[rows] = viterbi(s[rows], starts, sizes[mixed_texts], switch)
    return path


def viterbi(s: np.ndarray, first: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """The recursion, a word of every text at a time, the longest texts first."""
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    value = np.zeros((len(first), s.shape[1]))
    came, changed = np.zeros(len(s), np.int32), np.zeros(s.shape, bool)
    for t in range(longest):
        m = active[t]
        at = first[:m] + t
        held = value[:m]
        if t:
            leader = held.argmax(axis=1)
            other = held[np.arange(m), leader] - switch
            moved = held < other[:, None]
            came[at], changed[at] = leader, moved
            held = np.where(moved, other[:, None], held)
        value[:m] = held + s[at]
    path = np.zeros(len(s), np.int64)
    state = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at, now = first[:m] + t, state[:m]
        path[at] = now
        state[:m] = np.where(changed[at, now], came[at], now)
    return path


def held_out(modulus: int = 3, remainder: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_rows(docs: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, text, lang) of at most about ``max_labelled`` rows, in turn from each language; their keys are broadcast, being so many at most."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    turn = Window.partitionBy("lang").orderBy("h", "doc_id")
    keyed = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    ranked = keyed.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= max_labelled)
    chosen = ranked.orderBy("turn", "lang").limit(max_labelled).select("lang", F.col("doc_id").alias("chosen"))
    return known.join(F.broadcast(chosen), (known.lang == chosen.lang) & known.doc_id.eqNullSafe(F.col("chosen")), "left_semi")


def train(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Counts of hashed n-grams, of letters by script and of rows, by language."""
    bound_batches(docs)
    rows, table = staged(training_rows(docs, max_labelled)), script_table()
    spark = docs.sparkSession
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros(0), np.zeros((OTHER + 1, 0), bool), table)
    number = {language: k for k, language in enumerate(languages)}
    shared = Shared(spark, table)
    schema = pa.schema([("language", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Batches) -> Batches:
        for batch in batches:
            names = np.array([number[x] for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()], np.int64)
            words = Words([raw.decode() for raw in raw_texts(batch)], shared.value)
            once: dict[str, int] = {}
            place = np.fromiter((once.setdefault(w, len(once)) for w in words.words), np.int64, len(words.words))
            own = names[words.owner]
            # Buckets of n-grams, then a row per script and one of rows.
            found = [(own * WIDE + BUCKETS + words.script, words.letters), (names * WIDE + BUCKETS + OTHER + 1, np.ones(len(names), np.int64))]
            for buckets, first, last in grams(list(once)):
                sizes = (last - first)[place]
                at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[place], sizes)
                found.append((np.repeat(own, sizes) * WIDE + buckets[at], np.ones(len(at), np.int64)))
            keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(where, np.concatenate([w for _, w in found]), minlength=len(keys))
            yield batch_of(schema, (keys // WIDE).astype(np.int32), (keys % WIDE).astype(np.int32), n.astype(np.int64))

    counted = rows.select("lang", "text").mapInArrow(count, "language int, bucket int, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    # At most so many rows as there are languages times buckets.
    found = counted.toArrow()
    counts = np.zeros((len(languages), WIDE))
    counts[found.column("language").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return fitted(languages, counts, table)


WIDE = BUCKETS + OTHER + 2


def fitted(languages: list[str], counts: np.ndarray, table: np.ndarray) -> Model:
    seen, letters, rows = counts[:, :BUCKETS], counts[:, BUCKETS : BUCKETS + OTHER + 1], counts[:, -1]
    # Every language counts alike in what they share.
    shares = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)
    common = shares.mean(axis=0)
    smoothed = (seen + PRIOR * common) / (seen.sum(axis=1, keepdims=True) + PRIOR)
    ratio = np.divide(smoothed, common, out=np.ones_like(smoothed), where=common > 0)
    weights = np.clip(np.log(ratio), -MOST, MOST).T.astype(np.float32)
    used = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1) >= SELDOM
    return Model(languages, weights, np.log((rows + 1) / (rows.sum() + len(rows))), used.T, table)


def spans_of(words: Words, path: np.ndarray, languages: list[str]) -> list[list[dict]]:
    """Each text's stretches of one language, from the first letter to behind the last, in code points."""
    out: list[list[dict]] = [[] for _ in range(words.n)]
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (words.owner[1:] != words.owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first, len(path))[1:] - 1
    for text, start, end, language in zip(words.owner[first].tolist(), words.start[first].tolist(), words.end[last].tolist(), path[first].tolist(), strict=True):
        out[text].append({"start": start, "end": end, "lang": languages[language]})
    return out


SPANS = "array<struct<start:bigint,end:bigint,lang:string>>"


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans, spans (start, end, lang)."""
    shared = Shared(docs.sparkSession, model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", kind)])
    most = int(CHUNK / max(1.0, len(model.languages) / 8))

    def labelled(names: list[int | None], texts: list[str]) -> pa.RecordBatch:
        words, path, languages, score = shared.value.label(texts)
        found = spans_of(words, path, shared.value.languages) if shared.value.languages else [[] for _ in texts]
        return batch_of(schema, names, languages, score, found)

    def run(batches: Batches) -> Batches:
        names: list[int | None] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for name, raw in zip(ids(batch).to_pylist(), raw_texts(batch), strict=True):
                if texts and size + len(raw) > most:
                    yield labelled(names, texts)
                    names, texts, size = [], [], 0
                names.append(name)
                texts.append(raw.decode())
                size += len(raw)
        if texts:
            yield labelled(names, texts)

    found = id_text(docs).mapInArrow(run, f"doc_id bigint, lang_pred string, score double, spans {SPANS}")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), "spans")


def identify(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    return label(docs, train(docs, max_labelled))
