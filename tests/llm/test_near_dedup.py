import hashlib
import re
from itertools import combinations

from acervo.llm import near_dedup
from tests.llm.samples import documents, empty, pairs, rows_of, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, set size, component, kept) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(k)] = min(doc, least.get(root(k), doc))
    out = []
    for k, (doc, _) in enumerate(rows):
        c = least[root(k)] if doc is not None else None
        out.append((doc, len(sets[k]), c, True if doc is None else doc == c))
    return sorted(out, key=str)


def got(docs):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(near_dedup.near_duplicates(docs))), key=str)


def test_components_equal_all_pairs(spark):
    docs = documents(spark)
    assert got(docs) == brute(pairs(docs))


def test_many_near_copies_and_frequent_passages(spark):
    import random

    rng = random.Random(4)
    base, passage = words(rng, 60).split(), words(rng, 25)
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
        rows.append(" ".join(w))
    rows += [words(rng, rng.randint(5, 40)) + " " + passage for _ in range(60)]
    docs = documents(spark, rows)
    assert got(docs) == brute(pairs(docs))


def test_one_of_each_stays_with_columns(spark):
    docs = documents(spark)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {d for d, _, _, k in brute(pairs(docs)) if k}
    have = [r["doc_id"] for r in rows_of(kept)]
    assert set(have) == want and len(have) == len(want)


def test_empty(spark):
    assert got(empty(spark)) == []
    assert near_dedup.drop_near_duplicates(empty(spark)).count() == 0


def test_two_texts_of_one_document(spark):
    import random

    rng = random.Random(6)
    a, b, c = (words(rng, 40) for _ in range(3))
    near = " ".join([*c.split()[:-1], "other"])
    for rows, left in (
        ([(1, a), (1, b), (2, c)], {(1, a), (1, b), (2, c)}),
        ([(1, a), (1, a), (1, b), (2, near), (3, c), (1, "")], {(1, a), (1, b), (2, near), (1, "")}),
        ([(5, c), (5, near), (6, c), (4, a), (5, a)], {(5, min((c, near), key=lambda t: hashlib.sha256(t.encode()).hexdigest())), (4, a)}),
    ):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        assert got(docs) == brute(rows)
        assert {tuple(r) for r in near_dedup.drop_near_duplicates(docs).collect()} == left
        assert near_dedup.drop_near_duplicates(docs).count() == len(left)
