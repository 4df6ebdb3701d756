import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from acervo.llm import bpe, pretokens, token_counts
from tests.llm.samples import documents, empty, rows_of, texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTS = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
ODD = "ab'stremvldLS1²½ \n\t  \x00\x1c\x85　!?ñ日\U0001F600́"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_encoding_equals_library_and_decodes(spark, library):
    docs = documents(spark)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = rows_of(bpe.encoded(docs, RANKS, PATTERN))
    assert len(rows) == docs.count()
    for row in rows:
        ids = library.encode_ordinary(text[row["doc_id"]])
        raw = text[row["doc_id"]].encode()
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and row["n_bytes"] == len(raw) and row["round_trip"]
        assert row["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(raw).hexdigest()


def test_long_pieces_and_random_runs(library):
    encoder, rng = bpe.Encoder(bpe.read_ranks(RANKS), PATTERN), random.Random(2)
    runs = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "abcdefghij", "éèaü", "=-") for n in (500, 513, 4000)] + ["x" * 6000, ""]
    assert [e.tolist() for e in encoder.encode(runs)] == [library.encode_ordinary(r) for r in runs]
    assert [encoder.decode(e) for e in encoder.encode(runs)] == [r.encode() for r in runs]


def test_rounds_over_places_equal_single_merges(library):
    encoder, rng = bpe.Encoder(bpe.read_ranks(RANKS), PATTERN), random.Random(12)
    for letters in ("a", "ab", "aé", "the anionres", "=-", "0123456789", "日本語"):
        for n in (1, 2, 3, 40, 700):
            raw = "".join(rng.choice(letters) for _ in range(n)).encode()
            ids = encoder.bytes_to_ids[np.frombuffer(raw, "u1")]
            assert encoder.merge_long(ids).tolist() == encoder.merge_one_by_one(ids).tolist()
    # A vocabulary whose later tokens have lesser ranks is merged one by one.
    odd = {bytes([b]): b + 10 for b in range(256)} | {b"aa": 9, b"aaa": 5, b"aab": 4}
    made = bpe.Encoder(odd, PATTERN)
    for text in ("aaaaab", "aaaa", "baaaaaab"):
        ids = made.bytes_to_ids[np.frombuffer(text.encode(), "u1")]
        want = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=odd, special_tokens={}).encode_ordinary(text)
        assert made.merge_long(ids).tolist() == made.merge_one_by_one(ids).tolist() == want


def test_a_piece_of_a_megabyte(library):
    import time

    rng = random.Random(13)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    encoder, started = bpe.Encoder(bpe.read_ranks(RANKS), PATTERN), time.time()
    ids = encoder.encode([text])[0]
    assert time.time() - started < 60 and encoder.decode(ids) == text.encode() and not encoder.cache
    part = text[:20_000]
    assert encoder.encode([part])[0].tolist() == library.encode_ordinary(part)


def test_every_doubtful_character_is_cut_as_by_the_libraries(library):
    """All characters on which `regex` and a library differ, the first 1,536, and some others."""
    tokenizer, rng = Tokenizer.from_file(COUNTS), random.Random(14)
    plain = pretokens.class_table()
    by_tiktoken, by_tokenizers = pretokens.tiktoken_table(PATTERN), pretokens.tokenizers_table(tokenizer.to_str())
    doubtful = [c for c in range(0x110000) if plain[c] != by_tiktoken[c] or plain[c] != by_tokenizers[c]]
    points = [*range(0x600), *rng.sample(doubtful, min(2000, len(doubtful))), *(c for c in rng.sample(range(0x20000), 3000))]
    some = [f"a{c}b 1{c} {c}{c}'s" for c in (chr(p) for p in points if not 0xD800 <= p < 0xE000)]
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), PATTERN)
    assert [e.tolist() for e in encoder.encode(some)] == library.encode_ordinary_batch(some)
    lengths = token_counts.Lengths(tokenizer.to_str(), PATTERN)
    lengths.load()
    assert lengths.counts(some) == [len(e.ids) for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]


def test_decoded_table(spark):
    docs = documents(spark)
    back = {r["doc_id"]: r["text"] for r in rows_of(bpe.decoded(bpe.encoded(docs, RANKS, PATTERN), RANKS))}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}


def test_cutting_equals_the_pattern():
    find, cutter, rng = regex.compile(PATTERN).findall, pretokens.Cutter(PATTERN), random.Random(3)
    for _ in range(400):
        some = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(9)]
        assert cutter.cut(some) == [find(t) for t in some]
    other = pretokens.Cutter(r"\w+|\W")
    assert other.cut(["a b", ""]) == [["a", " ", "b"], []]


def test_counts_equal_library(spark):
    docs = documents(spark, texts() + ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n", "".join(ODD) * 30])
    tokenizer = Tokenizer.from_file(COUNTS)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for entries in (0, 50):
        rows = rows_of(token_counts.token_counts(docs, COUNTS, PATTERN, limit=100, entries=entries))
        assert len(rows) == docs.count()
        for row in rows:
            n = len(tokenizer.encode(text[row["doc_id"]], add_special_tokens=False).ids)
            assert (row["n_tokens"], row["over_limit"], row["n_bytes"]) == (n, n > 100, len(text[row["doc_id"]].encode()))


def test_small_caches_give_the_same(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), PATTERN)
    some = [t or "" for t in texts()]
    assert [encoder.encode([t])[0].tolist() for t in some] == [library.encode_ordinary(t) for t in some]


def test_empty(spark):
    assert rows_of(bpe.encoded(empty(spark), RANKS, PATTERN)) == []
    assert rows_of(token_counts.token_counts(empty(spark), COUNTS, PATTERN)) == []
