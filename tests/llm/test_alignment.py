import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from acervo.llm import alignment
from tests.llm.samples import documents, empty, rows_of, texts

EXTRA = ["<|endoftext|> a", "<s> </s> <unk> <0x41>", "a▁b", "▁", " ", "\n\n  x\t", "ﬁ ½", "\x00\x01", "日本語" * 30, "it's  'the' end ", "aaaa" * 500]


@pytest.fixture(scope="module")
def tools():
    found = alignment.tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found.load()
    return found


def library_tokens(text):
    """Tokens of both libraries with their bytes, by loops; none where the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(library_tokens, "held"):
        a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        a.encode_special_tokens = True
        library_tokens.held = a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a, b = library_tokens.held
    if not text:
        return [], []
    table = {c: i for i, c in enumerate(map(chr, range(256))) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174}
    for i in range(256):
        if i not in table.values():
            table[chr(256 + len(table) - 188)] = i
    first = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
    second = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
    raw = (" " + text).encode()
    same = all(b"".join(t for _, t in side) == raw for side in (first, second))
    return (first, second) if same else ([], [])


def brute_groups(text):
    first, second = library_tokens(text)
    groups, a, b, x, y = [], [], [], 0, 0
    second = list(second)
    for i, t in first:
        a.append(i)
        x += len(t)
        while second and y + len(second[0][1]) <= x:
            token, raw = second.pop(0)
            b.append(token)
            y += len(raw)
        if x == y:
            groups.append((a, b))
            a, b = [], []
    return groups, len(first), sum(len(g[1]) for g in groups)


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else ""


def brute(rows):
    found = [(d, *brute_groups(t)) for d, t in rows]
    n = Counter((a[-1], b[-1]) for _, groups, _, _ in found for a, b in groups)
    most = {}
    for (_, b), k in n.items():
        most[b] = max(most.get(b, 0), k)
    out = []
    for d, groups, n_a, n_b in found:
        links = [(a[-1], b[-1]) for a, b in groups]
        out.append((d, n_a, n_b, len(groups), len(links), sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links), digest(groups)))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("heavy", [1 << 16, 40])
def test_equals_brute_force(spark, tools, heavy):
    docs = documents(spark, texts() + EXTRA)
    df = alignment.align(docs, tools, heavy)
    assert tuple(df.columns) == COLUMNS
    got = sorted((tuple(r[c] for c in COLUMNS) for r in rows_of(df)), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_and_small_parts(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 200)
    docs = documents(spark, texts()[:20] + EXTRA)
    rows = sorted(rows_of(alignment.groups(docs, tools)), key=lambda r: (str(r["doc_id"]), r["place"]))
    text = {r.doc_id: r.text for r in docs.collect()}
    repeated = Counter(r.doc_id for r in docs.select("doc_id").collect())
    for doc, raw in text.items():
        mine = [r for r in rows if r["doc_id"] == doc]
        want = brute_groups(raw)[0]
        assert [(r["a_ids"], r["b_ids"]) for r in mine] == [g for g in want for _ in range(repeated[doc])]
        if mine:
            assert mine[-1]["end"] == len((" " + raw).encode())


def test_the_quick_encoder_equals_the_library(tools):
    rng = random.Random(8)
    assert tools.quick is not None
    some = [f"a{c}b 1{c} {c}{c}'s {c}" for c in map(chr, range(0x250))]
    some += ["".join(rng.choice("ab'stremvldLS1²½ \n\t  \x00\x1c\x85!?ñßÞſĳ") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    some += ["x" * 999, "x" * 5000, " " * 999, " \n" * 5000, "日本", "\u0558's", "<|endoftext|>"]
    want = [e.ids for e in tools.a.encode_batch(some, add_special_tokens=False)]
    assert tools._a_tokens(some) == want
    quick = [alignment.UNSURE.search(t) is None for t in some]
    assert all(quick[:0x250]) and not any(quick[-4:-1])


def test_cuts_equal_the_intersection():
    rng = np.random.default_rng(2)
    for density in (0.02, 0.3, 0.9):
        for _ in range(60):
            size = int(rng.integers(1, 400))
            a, b = (np.unique(np.append(rng.choice(size, int(rng.integers(0, max(1, size * density))), replace=False) + 1, size)) for _ in range(2))
            cuts = alignment.shared_cuts(a, b, np.array([len(a)]), np.array([len(b)]))
            both = np.intersect1d(a, b)
            assert (cuts[0] == np.searchsorted(a, both) + 1).all() and (cuts[1] == np.searchsorted(b, both) + 1).all()


def test_a_very_long_text(tools):
    rng = random.Random(3)
    text = "".join(rng.choice("ab \né") for _ in range(300_000))
    found = alignment.Aligned(tools, ["", text, "x"])
    assert found.digests()[1] == digest(brute_groups(text[:0] + text)[0])


def test_empty(spark, tools):
    assert rows_of(alignment.align(empty(spark), tools)) == []
    assert rows_of(alignment.groups(empty(spark), tools)) == []
    blank = alignment.align(documents(spark, ["", None]), tools)
    assert {tuple(r[c] for c in COLUMNS[1:]) for r in rows_of(blank)} == {(0, 0, 0, 0, 0, 0, "")}
