import hashlib
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from acervo.functions.ids import POINT_NAMESPACE
from acervo.operators import chunking, validation

VERSION = "11111111-1111-4111-8111-111111111111"
SCHEMA = (
    "document_id string, version_id string, document_title string, academic_year string, "
    "pages array<struct<page:int,text:string>>"
)


def chunks(spark, *versions):
    rows = [("d", version, "título", "2026-2027", pages) for version, pages in versions]
    out = chunking.chunk_versions(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(out, key=lambda r: (r.version_id, r.chunk_index or 0))


def test_golden_hash_and_id(spark):
    rows = chunks(spark, (VERSION, [(2, "  DETALLE\r\nMás   texto. "), (1, "INTRODUCCIÓN \nTexto   normalizado.")]))
    assert [r.page for r in rows] == [1, 2]
    assert [r.section for r in rows] == ["INTRODUCCIÓN", "DETALLE"]
    assert {r.content_hash for r in rows} == {"a6d45666cd0ba6676c43818b2f545db4ee53d7f5c0579ef67b3ccd4f9b004a6d"}
    assert rows[0].point_id == "9d6b37a8-637a-546e-ae90-1b4edf9f4646"
    for r in rows:
        assert r.point_id == str(uuid.uuid5(uuid.UUID(POINT_NAMESPACE), f"{VERSION}:{r.chunk_index}"))


def test_noise_gives_the_same_chunks(spark):
    noisy = "El\t\x07\tplazo continu\N{ZERO WIDTH SPACE}\N{COMBINING ACUTE ACCENT}a" + chr(0xFEFF) + "."
    (row,) = chunks(spark, ("v", [(1, noisy)]))
    assert row.text == "El plazo continúa."
    assert row.content_hash == "584d0fa23b4b4e9eceac6d5fb45d428011d1d2918ba212bf4e0f6c805d0fe871"


def test_long_text_overlaps(spark):
    rows = chunks(spark, ("v", [(1, "á" * 2200)]))
    assert [len(r.text) for r in rows] == [1000, 1000, 600]
    assert rows[0].text[-200:] == rows[1].text[:200] and rows[1].text[-200:] == rows[2].text[:200]


def test_pages_stay_apart_and_numbers_run_on(spark):
    rows = chunks(spark, ("v", [(1, "a" * 1200), (2, "b" * 1200)]))
    assert [(r.page, r.chunk_index) for r in rows] == [(1, 0), (1, 1), (2, 2), (2, 3)]
    assert all(set(r.text) == {"a" if r.page == 1 else "b"} for r in rows)


def test_sections_begin_anew_per_page(spark):
    first = "Un preámbulo.\n\nMATRÍCULA\nEl plazo termina.\n\nDOCUMENTACIÓN\nSe presenta."
    rows = chunks(spark, ("v", [(1, first), (2, "Sin título aquí.")]))
    assert [r.section for r in rows] == [None, "MATRÍCULA", "DOCUMENTACIÓN", None]
    assert [r.text for r in rows] == ["Un preámbulo.", "MATRÍCULA\nEl plazo termina.", "DOCUMENTACIÓN\nSe presenta.", "Sin título aquí."]


def test_empty_versions_are_error_rows(spark):
    (row,) = chunks(spark, ("v", [(1, " \r\n\t " + chr(0x200B))]))
    assert (row.error_code, row.point_id, row.text) == ("PDF_CHUNK_EMPTY", None, None)


def naive_merge(pieces, size, overlap):
    out, held, total = [], [], 0
    for piece in pieces:
        if total + len(piece) > size and held:
            out.append("".join(held).strip())
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    out.append("".join(held).strip())
    return [c for c in out if c]


def naive_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    separator = next(s for s in separators if s in text)
    finer = separators[separators.index(separator) + 1 :]
    if separator:
        cuts = [i for i in range(1, len(text)) if text.startswith(separator, i)]
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    else:
        pieces = list(text)
    out, short = [], []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        if short:
            out += naive_merge(short, size, overlap)
            short = []
        out += naive_split(piece, size, overlap, finer) if finer else [piece]
    return out + (naive_merge(short, size, overlap) if short else [])


@settings(max_examples=500, database=None, deadline=None)
@given(st.text("ab \n", min_size=1, max_size=200), st.integers(8, 40), st.integers(0, 7))
def test_splitter_agrees_with_the_naive_one(text, size, overlap):
    text = "\n\n".join(p for p in text.split("\n\n\n"))
    assert chunking.split_text(text, size, overlap) == naive_split(text, size, overlap)


@settings(max_examples=200, database=None, deadline=None)
@given(st.lists(st.text("abcdefg", min_size=1, max_size=15), min_size=1, max_size=60))
def test_chunks_cover_all_words_in_order(words):
    # Numbered, so that a chunk is found at its own place and not at an equal earlier one.
    text = " ".join(f"{i}{w}" for i, w in enumerate(words))
    found, at = chunking.split_text(text, 40, 10), 0
    assert all(len(c) <= 40 for c in found)
    for chunk in found:
        start = text.find(chunk, max(0, at - 11))
        assert start != -1 and start <= at + 1
        at = start + len(chunk)
    assert at == len(text)


def test_flat_pages_give_the_chunks_of_nested_ones(spark):
    text = "TÍTULO\n" + "una frase con palabras. " * 150
    pages = spark.createDataFrame(
        [("d", "v", "t", "y", 2, "dos\r\n" + text), ("d", "v", "t", "y", 1, text), ("d", "v", "t", "y", 3, " "), ("d", "w", "t", "y", 1, "x" * 3000), ("d", "e", "t", "y", 1, "")],
        "document_id string, version_id string, document_title string, academic_year string, page int, text string",
    )
    nested = chunking.nest_pages(pages)
    assert {r.version_id: [p.page for p in r.pages] for r in nested.collect()} == {"v": [1, 2, 3], "w": [1], "e": [1]}
    flat, whole = chunking.chunk_pages(pages), chunking.chunk_versions(nested)
    names = [c for c in whole.columns if c != "content_hash"]
    assert sorted(map(str, flat.select(names).collect())) == sorted(map(str, whole.select(names).collect()))
    hashes = [sorted({(r.version_id, r.content_hash) for r in df.where("text is not null").collect()}) for df in (flat, whole)]
    assert hashes[0] == hashes[1]


def test_version_hash_joins_pages(spark):
    df = spark.createDataFrame([("v", [(3, "c"), (1, "a")])], "version_id string, pages array<struct<page:int,text:string>>")
    (row,) = chunking.version_content_hash(df).collect()
    assert row.content_hash == hashlib.sha256("a\n\f\nc".encode()).hexdigest()


def test_page_rules(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 1), ("c", 0), ("d", None)], "version_id string, page int")
    assert {r.version_id for r in validation.validate_pages(pages).collect()} == {"b", "c", "d"}


def test_hot_version_is_numbered_like_any_other(spark):
    pieces = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("v"), F.col("id").cast("string"))).otherwise("hot").alias("version_id"),
        (F.col("id") % 50).cast("int").alias("page"), F.lit(0).alias("section_no"), F.col("id").alias("piece_no"),
    )
    rows = chunking.assign_chunk_index(pieces).where("version_id = 'hot'").orderBy("page", "piece_no").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))


def test_versions_of_many_pages_are_normalized_in_linear_time(spark):
    import time

    pages = F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.struct(i.alias("page"), F.concat(F.lit("hoja  "), i.cast("string")).alias("text")))
    started = time.time()
    (row,) = chunking.normalize_pages(spark.range(1).select(pages.alias("pages"))).select(F.size("pages").alias("n"), F.col("pages")[39_999].alias("last")).collect()
    assert time.time() - started < 30
    assert (row.n, row.last.page, row.last.text) == (40_000, 40_000, "hoja 40000")


def test_normalized_pages_give_the_same_chunks(spark):
    accent = "\N{COMBINING ACUTE ACCENT}"
    noise = [chr(n) for n in (0x7, 0x85, 0xA0, 0xAD, 0x200B, 0x2000, 0x2028, 0x2029, 0x3000, 0xFEFF)]
    pages = [(k + 1, f" {n}TI{accent}TULO{n}\r\n{n} te{accent}xto {n}{accent}\n{n}\n \n {accent}y {n}") for k, n in enumerate([*noise, "\n".join(noise), "".join(noise)])]
    rows = [("d", VERSION, "t", "2026-2027", pages[::-1]), ("d", VERSION.replace("1", "2"), "t", "2026-2027", [(1, " \n ")])]
    given_pages = spark.createDataFrame(rows, SCHEMA)
    settled = chunking.normalize_pages(given_pages)
    assert settled.collect() == chunking.normalize_pages(settled).collect()
    assert "regexp_replace" not in plan(chunking.chunk_versions(given_pages, normalized=True)) and "regexp_replace" in plan(chunking.chunk_versions(given_pages))
    once = chunking.chunk_versions(settled, normalized=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, chunking.chunk_versions(given_pages).collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_short_texts_are_one_piece():
    for text in ("", " ", "\n\n", "a", " a b\n", "a\n\nb", "x" * 1000, " " * 1000, "a b " * 250):
        whole = text.strip(" \n")
        assert chunking.split_text(text) == ([whole] if whole else [])
    assert chunking.split_text("x" * 1001) == ["x" * 1000, "x" * 201]
