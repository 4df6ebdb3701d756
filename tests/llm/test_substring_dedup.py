import hashlib
import random
from collections import Counter

from acervo.llm import substring_dedup
from tests.llm.samples import documents, empty, pairs, rows_of, words

LENGTH = 200


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept digest) by counting every 200-byte string."""
    raws = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(raw[k : k + LENGTH] for _, raw in raws for k in range(len(raw) - LENGTH + 1))
    out = []
    for doc, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - LENGTH + 1):
            if counts[raw[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(substring_dedup.remove_repeats(docs))), key=str)


def test_cover_is_perfect():
    shifts = Counter((a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER if a != b)
    assert shifts == Counter(range(1, substring_dedup.PERIOD))


def test_sample_texts(spark):
    docs = documents(spark)
    assert got(docs) == brute(pairs(docs))


def test_passages_of_about_the_length_and_periods(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 1500)
    rng = random.Random(9)
    pool = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = []
    for n in (199, 200, 201, 230, 272, 273, 400, 900):
        for _ in range(3):
            at = rng.randrange(len(pool) - n)
            rows.append(words(rng, rng.randint(0, 60)) + pool[at : at + n] + words(rng, rng.randint(0, 60)))
    rows += [pool[:350], words(rng, 20) + "é" * 240, "z" * 199, "z" * 200, "z" * 201, "ab" * 150, "q" * 5000]
    docs = documents(spark, rows)
    assert got(docs) == brute(pairs(docs))


def test_nothing_long_enough(spark):
    docs = documents(spark, ["a", None, "", "b" * 150])
    assert got(docs) == brute(pairs(docs))
    assert got(empty(spark)) == []
