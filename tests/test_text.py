import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from acervo.functions import text as tx

ACUTE = "\N{COMBINING ACUTE ACCENT}"
NEL, LS, PS, BOM, ZWSP = (chr(n) for n in (0x85, 0x2028, 0x2029, 0xFEFF, 0x200B))
NOISE = [chr(n) for n in (0xFEFF, 0x0, 0x7, 0x1F, 0x7F, 0x9F, 0xAD, 0x200B, 0x206F, 0xE0001)]

PAIRS = [
    *[(f"El\t{n}\tplazo", "El plazo") for n in NOISE],
    *[((f"a{n}{ACUTE}") * 10, "á" * 10) for n in (BOM, chr(7), ZWSP)],
    (f"  TÍTULO{NEL}Informacio{ACUTE}n\tbreve.{LS}Sigue.{PS}Otro.  ", "TÍTULO\nInformación breve.\nSigue.\n\nOtro."),
    ("A\r\n\r\nB\rC\r\r\r\rD", "A\n\nB\nC\n\nD"),
    (f"x\r{BOM}\ny", "x\ny"),
    (f"{chr(0x3000)}a{chr(0xA0)}\x0b{chr(0x2003)}b\x0c", "a b"),
    ("ya está\n\nbien", "ya está\n\nbien"),
    (f"{NEL}{LS}{PS}{ZWSP}{BOM}\x07", ""),
]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", expression(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_normalize_pairs_and_idempotence(spark):
    first = column(spark, [a for a, _ in PAIRS], tx.normalize_text)
    assert first == [b for _, b in PAIRS]
    assert column(spark, first, tx.normalize_text) == first


def test_normalize_random_noise_is_idempotent_and_nfc(spark):
    alphabet = "aé .\n\t\r" + "".join(NOISE) + ACUTE + NEL + LS + PS + chr(0x3000) + "\N{ANGSTROM SIGN}\N{GRADUATION CAP}"
    texts = []

    @settings(max_examples=300, database=None, deadline=None)
    @given(st.text(alphabet, max_size=30))
    def gather(text):
        texts.append(text)

    gather()
    once = column(spark, texts, tx.normalize_text)
    assert column(spark, once, tx.normalize_text) == once
    assert all(unicodedata.is_normalized("NFC", t) for t in once)
    assert not any("\n\n\n" in t or "  " in t or t != t.strip(" \n") for t in once)


@pytest.mark.parametrize("noise", [NEL, BOM, ZWSP, chr(0xA0), "\x07", "\t"])
def test_extractable_characters_ignore_noise(spark, noise):
    assert column(spark, [noise.join("á" * 19), noise], tx.extractable_chars) == [19, 0]
    assert column(spark, [noise + "x", noise], tx.has_extractable_text) == [True, False]


def test_headings(spark):
    cases = {
        "MATRÍCULA": True, "Matrícula": False, "PLAZO.": False, "PLAZO:": False, "2026-2027": False, "CURSO 2026": True,
        " ".join("ABCDEFGHIJ"): True, " ".join("ABCDEFGHIJK"): False, "A" * 80: True, "A" * 81: False, "": False, "¿QUÉ?": False,
    }
    assert column(spark, list(cases), tx.is_heading) == list(cases.values())
    holding = column(spark, [f"texto\n{k}\ntexto" for k in cases], tx.may_hold_heading)
    assert all(h for h, heading in zip(holding, cases.values()) if heading)


def test_sanitising(spark):
    code, message = "VECTOR STORE\nUNAVAILABLE", "Mensaje seguro\n" + "x" * 600
    assert column(spark, [code, "", "é" * 200], tx.sanitize_code) == ["VECTOR_STORE_UNAVAILABLE", "UNKNOWN_ERROR", "_" * 100]
    cleaned = column(spark, [message], tx.sanitize_message)[0]
    assert len(cleaned) == 500 and "\n" not in cleaned


def test_words(spark):
    assert column(spark, ["¿Qué días, de la (actividad) actividad?"], tx.content_words) == [["días", "actividad", "actividad"]]
    assert column(spark, ["¡Hola! a.b;c"], tx.tokenize) == [["hola", "a", "b", "c"]]


def test_canonical_text_bounds(spark):
    values = [" a ", "", "x" * 200, "x" * 201, "a\x07b", f"e{ACUTE}", BOM + "a"]
    assert column(spark, values, lambda c: tx.canonical_text(c, 1, 200)) == ["a", None, "x" * 200, None, None, "é", "a"]


def test_few_extractable_characters_are_told_without_counting_all(spark):
    blank = "".join(NOISE) + f" \n{NEL}{LS}"
    texts = [blank.join("a" * n) + blank for n in (0, 1, 19, 20, 21)] + ["", "é" * 20, chr(0x1F600) * 19, chr(0x1F600) * 20, " " * 1_000_000, " " * 1_000_000 + "a" * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = rows.select("id", (tx.extractable_chars(F.col("text")) >= 20).alias("counted"), tx.has_extractable_chars(F.col("text"), 20).alias("told")).collect()
    assert all(r.counted == r.told for r in found) and [r.id for r in found if r.told] == [3, 4, 6, 8, 10]
