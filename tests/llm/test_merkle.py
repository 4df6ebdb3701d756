import hashlib
import random
import zlib

import pytest

from acervo.llm import merkle
from tests.llm.samples import documents, empty, rows_of, texts


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climbed(nodes, arity):
    """Root, and per leaf the (left, right) siblings of each step."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(places):
            run = at // arity * arity
            paths[leaf].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + arity])))
        nodes = [h(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
        places = [at // arity for at in places]
    return nodes[0], paths


def brute(rows, arity=2, modulus=7):
    def leaf(r, more=0):
        n = None if r["n_chars"] is None else r["n_chars"] + more
        return h(field(r["doc_id"]), field(r["source"]), field(r["lang"]), field(n), field(r["text"]))

    groups = {}
    for r in rows:
        groups.setdefault((r["lang"] is not None, (r["lang"] or "").encode()), []).append(r)
    keys = sorted(groups)
    ordered = {k: sorted(groups[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for k in keys}
    trees = {k: climbed([leaf(r) for r in ordered[k]], arity) for k in keys}
    root, upper = climbed([trees[k][0] for k in keys], arity) if keys else (None, [])
    out = []
    for at, k in enumerate(keys):
        for r, path in zip(ordered[k], trees[k][1], strict=True):
            steps = path + upper[at]
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == 0
            node = leaf(r, int(bad))
            for left, right in steps:
                node = h(left, node, right)
            out.append((r["doc_id"], leaf(r), trees[k][0], root, h(*(s for step in steps for s in step)), node, node == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def got(df):
    assert tuple(df.columns) == COLUMNS
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows_of(df)), key=str)


@pytest.mark.parametrize("arity,levels", [(2, 8), (2, 1), (2, 3), (3, 2)])
def test_equals_a_tree_of_single_nodes(spark, arity, levels):
    rng = random.Random(4)
    rows = texts() + [f"text {k}" for k in range(60)]
    # One language holds most rows; some have odd names, and one language a single row.
    langs = [rng.choice(["en", "en", "en", "é", "", None, "z:1", "Zz"]) for _ in rows]
    langs[3] = "alone"
    data = [(k * 2 - 9, t, lang, None if k % 4 == 0 else f"ß{k}", None if k % 6 == 0 else len(t or ""), 0.0, 1, "x") for k, (t, lang) in enumerate(zip(rows, langs, strict=True))]
    data += [data[5], data[5], (data[7][0], "other text", *data[7][2:]), (None, "a", "en", None, (1 << 63) - 1, None, None, None), (None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(data, documents(spark).schema).repartition(5)
    assert got(merkle.verified(docs, arity=arity, levels=levels)) == brute(rows_of(docs), arity)


def test_samples_and_tampering(spark):
    docs = documents(spark)
    found = got(merkle.verified(docs))
    assert found == brute(rows_of(docs))
    assert {row[-1] for row in found} == {True, False}
    assert len({row[3] for row in found}) == 1


def test_proofs_hold_a_long_text_and_one_row(spark):
    docs = documents(spark, ["é" * 2_000_000])
    assert got(merkle.verified(docs)) == brute(rows_of(docs))


def test_empty(spark):
    assert got(merkle.verified(empty(spark))) == []
