import random
import unicodedata
import zlib
from itertools import product

import numpy as np
import pytest

from acervo.llm import languages
from tests.llm.samples import documents, empty, rows_of, texts

LETTERS = {"aa": "abcdeno", "bb": "abstuvo", "ru": "абвгдеж", "el": "αβγδεζη"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus(spark, n=240):
    rng = random.Random(5)
    langs = [rng.choice(["aa", "aa", "bb", "ru", "el"]) for _ in range(n)]
    rows = [(k, prose(rng, lang, rng.randint(10, 120)), lang, "s", 0) for k, lang in enumerate(langs)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score int").repartition(3)


@pytest.fixture(scope="module")
def model(spark):
    return languages.train(corpus(spark))


def test_held_out_accuracy(spark, model):
    docs = corpus(spark)
    want = {r.doc_id: r.lang for r in docs.collect()}
    rows = rows_of(languages.label(docs, model))
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixed_texts_are_cut_into_spans(model):
    rng = random.Random(9)
    parts = [("aa", 60), ("ru", 30), ("aa", 40), ("bb", 50)]
    text = ". ".join(prose(rng, lang, n) for lang, n in parts)
    words, path, names, _ = model.label([text, "", "12 ..."])
    spans = languages.spans_of(words, path, model.languages)
    assert [s["lang"] for s in spans[0]] == [lang for lang, _ in parts] and spans[1:] == [[], []]
    starts = np.cumsum([0] + [len(p) for p in text.split(". ")][:-1]) + 2 * np.arange(4)
    assert all(abs(s["start"] - at) < 40 for s, at in zip(spans[0], starts, strict=True))
    assert names == ["aa", "und", "und"]


def test_scripts_narrow_candidates(model):
    _, _, names, score = model.label(["αβ", "абв", "АБВГД", "漢字", "á́́ a", "́", "2́", "é" * 5000, "א"])
    assert names[0] == "el" and names[1] == names[2] == "ru"
    # No language is known in these scripts: the most frequent language is left.
    assert names[3] == names[8] == "aa"
    assert names[5] == names[6] == "und" and score[5] == 0


def test_words_equal_a_loop():
    rng = random.Random(1)
    table = languages.script_table()
    some = ["".join(rng.choice("abé́ αЖ漢か1.\n😀ा́Z") for _ in range(rng.randint(0, 70))) for _ in range(200)] + ["x" * 100, "́a"]

    def by_loop(text):
        out, now, start = [], 0, 0
        for k, c in enumerate(text + "\n"):
            kind = table[ord(c)]
            kind = now if kind == languages.MARK else kind
            if kind != now or (kind and k - start == languages.UNIT):
                if now:
                    out.append((start, k))
                now, start = kind, k
        return out

    words = languages.Words(some, table)
    for k, text in enumerate(some):
        mine = words.owner == k
        assert list(zip(words.start[mine].tolist(), words.end[mine].tolist(), strict=True)) == by_loop(text)
    assert words.words == [t[a:b] for t in some for a, b in by_loop(t)]
    assert all((table[ord(c)] not in (0, languages.MARK)) == unicodedata.category(c).startswith("L") for t in some for c in t)


def best_by_trial(s, switch):
    return max(sum(s[t, l] for t, l in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False)) for p in product(range(s.shape[1]), repeat=len(s)))


def gain(s, path, switch):
    return s[np.arange(len(path)), path].sum() - switch * (np.diff(path) != 0).sum()


def test_paths_are_the_best():
    rng = np.random.default_rng(7)
    for switch in (0.5, 2.0, 6.0):
        sizes = rng.integers(1, 8, 60)
        s = rng.normal(0, 1.5, (sizes.sum(), 3))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        path, whole = languages.best_paths(s, first, switch), languages.viterbi(s, first, sizes, switch)
        for a, n in zip(first, sizes, strict=True):
            best = best_by_trial(s[a : a + n], switch)
            assert abs(gain(s[a : a + n], path[a : a + n], switch) - best) < 1e-9
            assert abs(gain(s[a : a + n], whole[a : a + n], switch) - best) < 1e-9


def test_constant_paths_equal_the_recursion_on_long_texts(model):
    rng = random.Random(2)
    long = [prose(rng, "aa", 20_000), prose(rng, "aa", 3000) + prose(rng, "bb", 3000), prose(rng, "el", 50)]
    words = languages.Words(long, model.table)
    s = model.word_scores(words.words) + model.against[words.script]
    first = np.flatnonzero(np.diff(words.owner, prepend=-1))
    sizes = np.diff(first, append=len(s))
    a, b = languages.best_paths(s, first, 10.0), languages.viterbi(s, first, sizes, 10.0)
    for at, n in zip(first, sizes, strict=True):
        assert abs(gain(s[at : at + n], a[at : at + n], 10.0) - gain(s[at : at + n], b[at : at + n], 10.0)) < 1e-6


def test_results_do_not_hang_on_caches_and_batches(spark, model, monkeypatch):
    docs = documents(spark, texts() + [prose(random.Random(4), "bb", 2000)])
    want = sorted(map(str, rows_of(languages.label(docs, model))))
    monkeypatch.setattr(languages, "CACHED_WORDS", 3)
    monkeypatch.setattr(languages, "CHUNK", 500)
    assert sorted(map(str, rows_of(languages.label(docs.repartition(7), model)))) == want


def test_defined_cases(spark):
    docs = documents(spark)
    rows = rows_of(languages.identify(docs))
    text = [r.text for r in docs.collect()]
    assert len(rows) == len(text)
    assert sum(r["lang_pred"] == "und" for r in rows) == sum(not any(c.isalpha() for c in t or "") for t in text)
    assert {r["lang_pred"] for r in rows} <= {"en", "und"}
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert rows_of(languages.identify(empty(spark))) == []
    untaught = docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r["lang_pred"] for r in rows_of(languages.identify(untaught))} == {"und"}


def test_the_sample_takes_languages_in_turn(spark):
    rows = [(k, f"text {k}", "aa" if k % 20 else "bb") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    few = languages.training_rows(docs, 10).collect()
    assert len(few) == 10 and sum(r.lang == "bb" for r in few) == 5
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in few)
