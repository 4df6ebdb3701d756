"""Cutting texts into pre-tokens: by any pattern, and for the usual byte-level pattern by vector operations on character classes."""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable

import numpy as np

# Fixed value: the pattern whose rules `cut_by_class` follows.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMBER, OTHER, END = range(5)
CHUNK = 1 << 20


RUN = 256

# Says for each character of a text whether the tokenizer's library starts a pre-token there.
Starts = Callable[[str], np.ndarray]


def class_table() -> np.ndarray:
    """The class of each code point, by the `regex` module's own properties; the last entry stands between texts."""
    import regex

    points = [chr(c) if not 0xD800 <= c < 0xE000 else "" for c in range(sys.maxunicode + 1)]
    table = np.full(len(points) + 1, OTHER, np.uint8)
    text = "".join(points)
    at = np.flatnonzero([p != "" for p in points])
    for kind, found in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for match in regex.finditer(found, text):
            table[at[match.start() : match.end()]] = kind
    table[-1] = END
    return table


def library_table(starts: Starts) -> np.ndarray:
    """The class of each code point as a tokenizer's library has it, which may know another version of Unicode.

    Runs of one class in `regex` are shown to the library behind a character of that class. Where it cuts inside, the character
    there is asked about by itself, behind one of each class; it and those up to the next cut share the answer.
    """
    table = class_table()
    points = np.array([c for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000])
    kind = table[points]
    new = np.ones(len(points), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (points[1:] != points[:-1] + 1)
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    new[(np.arange(len(points)) - first[run]) % RUN == 0] = True
    begin = np.flatnonzero(new)
    shown, at = [], []
    size = 0
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(points)).tolist(), strict=True):
        if kind[a] != SPACE:
            shown.append(SAMPLES[kind[a]] + "".join(map(chr, points[a:b].tolist())) + "\n")
            at.append((a, b, size + 1))
            size += len(shown[-1])
    cut = starts("".join(shown))
    unsure = np.flatnonzero(kind == SPACE).tolist()
    stretch = {k: k + 1 for k in unsure}
    for a, b, place in at:
        cuts = np.flatnonzero(cut[place : place + b - a])
        for k, stop in zip(cuts.tolist(), [*cuts.tolist(), b - a][1:], strict=True):
            stretch[a + k] = a + stop
    asked = list(stretch)
    alone = starts("".join(f"{sample}{chr(points[k])}\n" for k in asked for sample in SAMPLES.values()))
    joined = ~alone[1::3].reshape(-1, len(SAMPLES))
    for k, answer in zip(asked, joined, strict=True):
        table[points[k] : points[stretch[k] - 1] + 1] = list(SAMPLES)[int(answer.argmax())] if answer.any() else SPACE
    return table


SAMPLES = {LETTER: "a", NUMBER: "1", OTHER: "!"}


@functools.lru_cache(maxsize=4)
def tiktoken_table(pattern: str) -> np.ndarray:
    return library_table(tiktoken_starts(pattern))


@functools.lru_cache(maxsize=4)
def tokenizers_table(definition: str) -> np.ndarray:
    from tokenizers import Tokenizer

    return library_table(tokenizers_starts(Tokenizer.from_str(definition).pre_tokenizer))


def tokenizers_starts(pre_tokenizer) -> Starts:
    def starts(text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, bool)
        out[[begin for _, (begin, _) in pre_tokenizer.pre_tokenize_str(text)]] = True
        return out[:-1]

    return starts


def tiktoken_starts(pattern: str) -> Starts:
    """By an encoding whose only merges are those of a character's last byte with the next one's first: no token goes over a cut."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for left in [*range(0x20, 0xC0)]:
        for right in range(0xC2, 0xF5):
            ranks[bytes([left, right])] = len(ranks)
    encoding = tiktoken.Encoding("cuts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def starts(text: str) -> np.ndarray:
        lengths = np.where(np.fromiter(encoding.encode_ordinary(text), np.int64) < 256, 1, 2)
        bytes_ = np.frombuffer(text.encode(), np.uint8)
        begun = np.zeros(len(bytes_) + 1, bool)
        begun[np.concatenate([[0], np.cumsum(lengths)])] = True
        return begun[:-1][(bytes_ & 0xC0) != 0x80]

    return starts


class Cutter:
    """Cuts texts into the pattern's matches. Characters that no match covers are left out, as by `findall`.

    For the byte-level pattern a tokenizer's own table of classes may be given.
    """

    def __init__(self, pattern: str, table: Callable[[], np.ndarray] = class_table):
        self.pattern, self.find = pattern, None
        self.table = table() if pattern == BYTE_LEVEL_PATTERN else None

    def __getstate__(self):
        return self.__dict__ | {"find": None}

    def cut(self, texts: list[str]) -> list[list[str]]:
        if self.table is None:
            if self.find is None:
                import regex

                self.find = regex.compile(self.pattern).findall
            return [self.find(text) for text in texts]
        out: list[list[str]] = []
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > CHUNK:
                out += cut_by_class(held, self.table)
                held, size = [], 0
        return out + cut_by_class(held, self.table)


def cut_by_class(texts: list[str], table: np.ndarray) -> list[list[str]]:
    """Pieces start where the class changes; then white space gives its last character to what follows, and contractions are set apart."""
    if not texts:
        return []
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind = table[points]
    kind[ends] = END
    n = len(points)
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    # White space before something else: all but the last character is a piece, and a last plain space joins what follows.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    start[last] = True
    joins = last[points[last] == 32]
    start[joins + 1] = False
    # A contraction: an apostrophe at which a piece starts, and the letters named in the pattern.
    quotes = np.flatnonzero((points[:-1] == 39) & start[:-2] & start[1:-1] & (kind[1:] == LETTER)) if n > 1 else []
    for at in quotes.tolist() if len(quotes) else ():
        width = 2 if joined[at + 1] in "stmd" else 3 if joined[at + 1 : at + 3] in ("re", "ve", "ll") else 0
        if width:
            start[at + 1] = False
            start[at + width] = True
    bounds = np.flatnonzero(start)
    real = kind[bounds[:-1]] != END
    left, right = bounds[:-1][real].tolist(), bounds[1:][real].tolist()
    pieces = [joined[a:b] for a, b in zip(left, right, strict=True)]
    stops = np.searchsorted(left, ends).tolist()
    return [pieces[a:b] for a, b in zip([0, *stops], stops, strict=False)]
