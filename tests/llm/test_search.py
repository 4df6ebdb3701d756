"""Decontamination and code search against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from acervo.llm import code_search, decontamination
from tests.llm.samples import F, documents, empty, pairs, rows_of, texts, words


def bags(w):
    width = min(5, len(w))
    return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if w else Counter()


def brute_matches(docs, items):
    """doc and item -> best weighted similarity of a window, where 0.75 or more."""
    out = Counter()
    for n, (doc, text) in enumerate(docs):
        w = (text or "").lower().split()
        for m, (item, passage) in enumerate(items):
            p = (passage or "").lower().split()
            want = bags(p)
            for k in range(max(1, len(w) - len(p) + 1) if p and w else 0):
                have = bags(w[k : k + len(p)])
                s = sum((have & want).values()) / sum((have | want).values())
                if s >= 0.75:
                    out[n, m] = max(out[n, m], s)
    return sorted(((docs[n][0], items[m][0], round(s, 9)) for (n, m), s in out.items()), key=str)


@pytest.fixture(scope="module")
def benchmark_rows():
    rng = random.Random(8)
    items = [(k, words(rng, n)) for k, n in enumerate((3, 4, 5, 6, 15, 20, 20, 33, 40, 59))]
    return [*items, (90, None), (91, " "), (92, items[5][1]), (None, items[7][1].upper()), (93, "one two one two one two one two one two")]


def planted(benchmark_rows):
    rng = random.Random(11)
    rows = texts()[:10] + [None, ""]
    for _, passage in benchmark_rows:
        if passage and passage.strip():
            w = passage.split()
            rows.append(words(rng, 30) + " " + passage + "\n" + words(rng, 20))
            w[len(w) // 2] = "edited"
            rows.append(words(rng, rng.randint(0, 9)) + " " + " ".join(w))
            rows.append(" ".join(passage.split()[: max(1, len(w) * 4 // 5)]))
            rows.append(passage + " " + passage)
    return rows


def test_matches_equal_brute_force(spark, benchmark_rows):
    docs = documents(spark, planted(benchmark_rows))
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in benchmark_rows], "item_id bigint, text string, doc_id string, similarity int")
    want = brute_matches(pairs(docs), benchmark_rows)
    for block in (1 << 20, 300):
        rows = rows_of(decontamination.contaminated(docs, benchmark, block))
        assert sorted(((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in rows), key=str) == want
    clean = decontamination.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns
    dirty = {d for d, _, _ in want}
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == sorted(d for d, _ in pairs(docs) if d is not None and d not in dirty)


def test_hamming_blocks_meet_all_within_the_radius():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, 8, dtype=np.uint8)
    for n in range(decontamination.RADIUS + 1):
        for _ in range(50):
            b = np.unpackbits(a)
            b[rng.choice(64, n, replace=False)] ^= 1
            assert decontamination.NEAR[a, np.packbits(b)].any()


def test_empty_tables(spark, benchmark_rows):
    benchmark = spark.createDataFrame(benchmark_rows, "item_id bigint, text string")
    none = benchmark.limit(0)
    assert rows_of(decontamination.contaminated(empty(spark), benchmark)) == []
    assert rows_of(decontamination.contaminated(documents(spark), none)) == []
    assert decontamination.drop_contaminated(documents(spark), none).count() == documents(spark).count()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, id int, code string").repartition(3)


def brute_top(rows, k, bits):
    usable = [(i, v) for i, v, *_ in rows if i is not None and v is not None and len(v) == bits and None not in v]
    out = []
    for q, asked in dict(usable).items():
        if q % 100 == 0:
            best = sorted((sum((a > 0) != (b > 0) for a, b in zip(asked, v)), i) for i, v in usable)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(best)]
    return sorted(out)


def got_top(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in rows_of(df))


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(code_search, "TASK_ROWS", 100)
    rng = random.Random(3)
    hot = [rng.gauss(0, 1) for _ in range(64)]
    rows = []
    for k in range(900):
        v = list(hot) if k % 3 == 0 else [rng.gauss(0, 1) for _ in range(64)]
        if k % 6 == 1:
            v = [x if rng.random() < 0.9 else -x for x in hot]
        rows.append((k, v, 1, 2, "z"))
    rows += [(None, hot, 0, 0, None), (1001, None, 0, 0, None), (1002, [1.0], 0, 0, None), (1003, [None] * 64, 0, 0, None), (1004, [0.0] * 64, 0, 0, None), (7, rows[7][1], 0, 0, None)]
    for k, block in ((10, 4096), (3, 2)):
        found = code_search.top_k(vectors(spark, rows), F.col("id") % 100 == 0, k, block=block)
        assert got_top(found) == brute_top(rows, k, 64)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, -1.0] * 16, 0, 0, None), (1, [1.0, 1.0] * 16, 0, 0, None)]
    assert got_top(code_search.top_k(vectors(spark, rows), F.col("id") % 100 == 0, 10, bits=32)) == brute_top(rows, 10, 32)
    assert got_top(code_search.top_k(vectors(spark, []), F.col("id") % 100 == 0)) == []
