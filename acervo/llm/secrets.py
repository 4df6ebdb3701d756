"""Secrets: three fixed patterns, and values in credential context that are costly to guess.

The fixed patterns give the base spans. Beyond these, a value that follows a name with a credential word (``KEYWORD``) is a secret when its
guess cost is high: the least log10 of guesses over all ways to cut it into dictionary words, dates, repeats, keyboard walks and
brute-force spans, by dynamic programming over its characters. The dictionary holds a few fixed words and the letter runs of at
least ``MIN_VALUES`` different values in credential contexts of the whole corpus; the rarer among all different values, the
dearer. How often a value occurs does not matter, so a secret stays one in any number of copies.

Defined cases: a null text is empty and has no span. A row without doc_id is scanned like any other. Repeated rows get a row
each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import Batches, Cover, Shared, batch_of, bound_batches, code_points, id_text, ids, raw_texts, sha256, span_text

KINDS = ("assign", "access", "hex", "guess")
MIN_LENGTH = {"assign": 12, "access": 18, "hex": 16}
MIN_COST = 9.0
MIN_VALUES = 10  # different values that teach a letter run
REDACTED = b"[SECRET]"

# Fixed patterns of the base spans; the matches shorter than MIN_LENGTH are dropped after matching.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")

HINT = re.compile(rb"passw|passphrase|secret|token|api_?key|credential|pwd|private_?key|access_?key|auth")
# A name: the credential word at its start or after a part of it, then further parts; camel case parts words, too.
KEYWORD = re.compile(
    rb"""(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))"""
    rb"""(?:password|passwd|passphrase|secret|token|api[_-]?key|credentials?|pwd|private[_-]?key|access[_-]?key|auth(?:orization)?)""",
    re.I,
)
NAME_REST = re.compile(rb"(?:s(?![A-Za-z]))?(?:(?:[0-9_.-]|(?<=[a-z])[A-Z])[A-Za-z0-9_.-]*+|(?![A-Za-z]))")
# After the name: a value up to the closing quote, or to white space. Marks at the end that close a list or a quote are not of it.
VALUE = re.compile(
    rb"""["']?(?:\x20*[:=]\x20*(?:bearer\x20+|basic\x20+)?|\x20+is\x20+)(?:"([^\s"]+)|'([^\s']+)|([^\s"']\S*(?<![,"'])))""",
    re.I,
)
MIN_CHARACTERS = 8  # of a value in credential context
CONTINUED = bytes(range(0x80, 0xC0))
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
LETTERS = re.compile(rb"[a-z]{3,}")
DATE = re.compile(rb"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
ROWS = (b"1234567890", b"qwertyuiop", b"asdfghjkl", b"zxcvbnm", b"abcdefghijklmnopqrstuvwxyz")
WORDS = (
    "password admin secret test example changeme default user root guest login welcome token dummy sample placeholder none null "
    "true false public private value string master letmein monkey dragon the your here insert redacted hidden unknown"
).split()
LOG_CARDINALITY = {"digit": 1.0, "lower": math.log10(26), "upper": math.log10(26), "mark": math.log10(33)}
WALK_STARTS = math.log10(2 * sum(len(row) for row in ROWS))
NEIGHBOURS = {pair for row in ROWS for a, b in zip(row, row[1:], strict=False) for pair in ((a, b), (b, a))}


class Words(dict):
    """Words with their cost, and the length of the longest."""

    def __init__(self, costs: dict[bytes, float]):
        super().__init__(costs)
        self.longest = max(map(len, self), default=0)


def dictionary(ranked: list[bytes], priced: dict[bytes, float] | None = None) -> Words:
    """log10 of a word's rank: fixed words first, then those given, commonest first; or the cost given, where that is less."""
    words = dict.fromkeys([*(w.encode() for w in WORDS), *ranked])
    costs = {word: math.log10(rank + 2) for rank, word in enumerate(words)}
    return Words(costs | {word: min(cost, costs.get(word, cost)) for word, cost in (priced or {}).items()})


# All ASCII bytes but letters and digits.
NO_CHARACTERS = bytes(c for c in range(128) if not chr(c).isalnum())


def guess_cost(value: bytes, words: Words) -> float:
    """Least log10 of guesses over all segmentations of the value; each further segment costs a little, too.

    The programme ends early where no way is left at or below ``MIN_COST``; the result is then a lower bound above it.
    """
    n, lower = len(value), value.lower()
    least = [0.0] + [math.inf] * n
    far = hope = 0  # the last place reached, and an open place from which a cheap way may go on
    runs: dict[int, list] = {}  # by period of a repeat, 0 for walks: end of the run, and the start and cost that are best for it

    def spread(kind: int, start: int, stop: int, shortest: int, cost: float) -> None:
        """Segments from here to all ends of a run, as far as they can be better than those from the best start before."""
        nonlocal far
        best, last = runs[kind], stop
        if best[1] is not None and (more := cost - best[2]) > 0:
            # The logarithms of both lengths differ by less than ``more`` from here on.
            last = min(stop, start + 1 + int((start - best[1]) / (10 ** min(more, 300) - 1)))
        if last == stop:
            best[1:] = start, cost
        for end in range(start + shortest, last + 1):
            least[end] = min(least[end], cost + math.log10(end - start) + 0.3)
        far = max(far, last)

    for start in range(n):
        if least[start] > MIN_COST and (hope <= start or least[hope] > MIN_COST):
            hope = min(range(start, far + 1), key=least.__getitem__)
            if least[hope] > MIN_COST:
                return least[hope]
        here = least[start]
        far = max(far, start + 1)
        least[start + 1] = min(least[start + 1], here + brute(value[start]))
        if 97 <= lower[start] <= 122:
            for end in range(start + 3, min(n, start + words.longest) + 1):
                if (cost := words.get(lower[start:end])) is not None:
                    changed = value[start:end] != lower[start:end]
                    least[end] = min(least[end], here + cost + changed * math.log10(2 + end - start) + 0.3)
                    far = max(far, end)
        if (date := DATE.match(value, start)) is not None:
            end = date.end()
            least[end] = min(least[end], here + (math.log10(365 * 120) if end - start > 4 else math.log10(120)) + 0.3)
            far = max(far, end)
        for kind in range(5):
            step = kind or 1
            run = runs.setdefault(kind, [0, None, 0.0])
            if start + step > run[0]:
                end = start + step
                while end < n and ((lower[end - 1], lower[end]) in NEIGHBOURS if kind == 0 else value[end] == value[end - kind]):
                    end += 1
                run[:] = [end, None, 0.0]
            shortest = max(3, 2 * kind)
            if run[0] - start >= shortest:
                spread(kind, start, run[0], shortest, here + (sum(map(brute, value[start : start + kind])) if kind else WALK_STARTS))
    return least[n]


def brute(c: int) -> float:
    kind = "digit" if 48 <= c <= 57 else "lower" if 97 <= c <= 122 else "upper" if 65 <= c <= 90 else "mark"
    return LOG_CARDINALITY[kind]


def context_values(text: bytes) -> list[tuple[int, int]]:
    """Values after a name with a credential word in it."""
    if HINT.search(text.lower()) is None:
        return []
    out, at = [], 0
    while (word := KEYWORD.search(text, at)) is not None:
        at = word.end()
        if (rest := NAME_REST.match(text, at)) is None:
            continue
        # Further words in this name end where it ends, so that no name is read twice.
        at = rest.end()
        if (m := VALUE.match(text, at)) is None:
            continue
        start, end = m.span(m.lastindex)
        if (space := WIDE_SPACE.search(text, start, end)) is not None:
            end = space.start()
        if len(text[start:end].translate(None, CONTINUED)) >= MIN_CHARACTERS:
            out.append((start, end))
            at = end
    return out


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in bytes."""
    out = [(*m.span(), "hex") for m in HEX.finditer(text)]
    if b"AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_LENGTH["access"]]
    if HINT.search(text.lower()) is not None:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_LENGTH["assign"]]
    return out


def guessed_spans(text: bytes, words: Words, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Costly values in credential context, and values of which base spans leave letters or digits uncovered."""
    if not (values := context_values(text)):
        return []
    covered = Cover((s, e) for s, e, _ in base)
    out = []
    for a, b in values:
        if not covered.overlaps(a, b):
            secret = guess_cost(text[a:b], words) >= MIN_COST
        else:
            # What a base span takes out of a value is a secret, so the whole value is.
            secret = any(text[x:y].translate(None, NO_CHARACTERS) for x, y in covered.gaps(a, b))
        if secret:
            out.append((a, b, "guess"))
    return out


def learnt_words(docs: DataFrame) -> dict[bytes, float]:
    """Letter runs of at least ``MIN_VALUES`` different context values of the whole corpus: log10 of 1 + all values / those with it.

    Values that differ in case or in marks at their ends only are one. Runs that cost no less than their single letters are left
    out, as they could change no result.
    """
    schema = pa.schema([("value", pa.binary()), ("word", pa.binary())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            values = {text[a:b].lower().strip(MARKS) for text in raw_texts(batch) for a, b in context_values(text)}
            # The empty word stands for the value itself.
            pairs = [(hashlib.blake2b(v, digest_size=16).digest(), w) for v in values for w in {b"", *LETTERS.findall(v)}]
            yield batch_of(schema, [v for v, _ in pairs], [w for _, w in pairs])

    each = id_text(docs).mapInArrow(run, "value binary, word binary").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {bytes(r.word): r.n for r in each.filter((F.col("n") >= MIN_VALUES) | (F.octet_length("word") == 0)).collect()}
    total = counts.pop(b"", 0)
    costs = {word: math.log10(1 + total / n) for word, n in counts.items()}
    return {word: cost for word, cost in costs.items() if cost + 0.3 < len(word) * LOG_CARDINALITY["lower"]}


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per document: counts by kind, the digest of base spans, all spans, costs are of kind ``guess``."""
    shared = Shared(docs.sparkSession, dictionary([], learnt_words(docs)))
    schema = pa.schema(
        [("doc_id", pa.int64()), *((f"n_{kind}", pa.int64()) for kind in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]
    )

    def run(batches: Batches) -> Batches:
        words = shared.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(KINDS) + 2)]
            for text in raw_texts(batch):
                base = base_spans(text)
                found = base + guessed_spans(text, words, base)
                if found:
                    at = code_points(text, [x for s, e, _ in found for x in (s, e)])
                    found = [(at[2 * k], at[2 * k + 1], kind) for k, (_, _, kind) in enumerate(found)]
                counts = Counter(kind for _, _, kind in found)
                for k, kind in enumerate(KINDS):
                    columns[k].append(counts[kind])
                columns[-2].append(sha256(span_text([s for s in found if s[2] != "guess"], KINDS).encode()))
                columns[-1].append(span_text(found, KINDS))
            yield batch_of(schema, ids(batch), *columns)

    return id_text(docs).mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"
    )


def redact(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text with each stretch of overlapping spans replaced."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return b"".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced, columns as they were; ``n_chars``, where given, is that of the new text."""
    shared = Shared(docs.sparkSession, dictionary([], learnt_words(docs)))
    bound_batches(docs)
    at = docs.columns.index("text")

    def run(batches: Batches) -> Batches:
        words = shared.value
        for batch in batches:
            new = []
            for text in raw_texts(batch):
                base = base_spans(text or b"")
                found = base + guessed_spans(text or b"", words, base)
                new.append(redact(text, [s[:2] for s in found]) if found else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.binary()).cast(batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
