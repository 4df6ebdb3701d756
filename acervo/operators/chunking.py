"""From the pages of a version to sections, overlapping chunks and stable ids.

A version is one row holding its pages in an array (one file gives one row),
so normalising, hashing, sectioning, splitting and numbering need no shuffle:
the plan is a scan, projections and one posexplode.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acervo.functions import text as tx
from acervo.functions.ids import point_id
from acervo.session import bound_batches, cut_lineage

# --- fixed values -----------------------------------------------------------
PAGE_SEPARATOR = "\n\f\n"
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", " ")
# ----------------------------------------------------------------------------

PAGES_TYPE = "array<struct<page:int,text:string>>"


def _edges(text: str, separator: str) -> list[int]:
    """Offsets at which pieces begin and end; a separator opens its piece."""
    edges, at = [0], text.find(separator, 1)
    while at != -1:
        edges.append(at)
        at = text.find(separator, at + 1)
    edges.append(len(text))
    return edges


def _pack(text: str, edges, size: int, overlap: int) -> list[str]:
    """Fill chunks with whole pieces, each chunk repeating the tail of the last one."""
    out, first, last = [], 0, len(edges) - 1
    while True:
        end = bisect_right(edges, edges[first] + size) - 1
        chunk = text[edges[first] : edges[end]].strip(" \n")
        if chunk:
            out.append(chunk)
        if end >= last:
            return out
        room = min(overlap, size - (edges[end + 1] - edges[end]))
        first = bisect_left(edges, edges[end] - room)


def split_text(
    text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS
) -> list[str]:
    """Cut text at the coarsest separator it holds; finer ones cut pieces that stay too long."""
    if len(text) <= size:
        whole = text.strip(" \n")
        return [whole] if whole else []
    for level, separator in enumerate(separators):
        if separator in text:
            break
    else:
        return _pack(text, range(len(text) + 1), size, overlap)
    edges, out, run = _edges(text, separator), [], []
    for start, end in zip(edges, edges[1:]):
        if end - start < size:
            run = run or [start]
            run.append(end)
            continue
        if run:
            out += _pack(text, run, size, overlap)
            run = []
        out += split_text(text[start:end], size, overlap, separators[level + 1 :])
    return out + _pack(text, run, size, overlap) if run else out


def split_recursive(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Column function: a text becomes the array of its chunk texts."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batch: pd.Series) -> pd.Series:
        return batch.map(lambda text: split_text(text, size, overlap), na_action="ignore")

    return split


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compose_all(batch: pd.Series) -> pd.Series:
    import unicodedata

    return batch.map(
        lambda texts: [unicodedata.normalize("NFC", t) for t in texts], na_action="ignore"
    )


def normalize_pages(versions: DataFrame) -> DataFrame:
    """Canonical text of every page, pages in ascending order, empty pages dropped."""
    bound_batches(versions)
    composable = F.exists("pages", lambda p: p.text.rlike(tx.COMPOSABLE))
    settled = versions.withColumn(
        "pages",
        F.transform(
            F.sort_array(F.col("pages").cast(PAGES_TYPE)),
            lambda p: F.struct(p.page.alias("page"), tx.settle_text(p.text).alias("text")),
        ),
    ).withColumn("_composable", composable)
    texts = F.transform("pages", lambda p: p.text)
    composed = F.coalesce(_compose_all(F.when(F.col("_composable"), texts)), texts)
    return (
        # Both arrays are made once; an array looked into by place, page for page, would be made for each page.
        settled.withColumn("pages", F.zip_with("pages", composed, lambda p, text: F.struct(p.page.alias("page"), text.alias("text"))))
        .withColumn("pages", F.filter("pages", lambda p: p.text != ""))
        .drop("_composable")
    )


def content_hash(pages: Column) -> Column:
    """SHA-256 of normalised pages in page order, with a fixed page separator."""
    texts = F.transform(pages, lambda p: p.text)
    return F.sha2(F.array_join(texts, PAGE_SEPARATOR), 256)


def version_content_hash(versions: DataFrame) -> DataFrame:
    return normalize_pages(versions).withColumn("content_hash", content_hash(F.col("pages")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _page_sections(page: Column) -> Column:
    """Sections of one page: a heading line opens a section and belongs to its text."""

    def opening(lines: Column) -> Column:
        marked = F.transform(
            lines,
            lambda line, i: F.struct(i.alias("at"), F.when(tx.is_heading(line), line).alias("section")),
        )
        return F.filter(marked, lambda s: (s.at == 0) | s.section.isNotNull())

    def cut(lines: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda s, i: F.struct(
                page.page.alias("page"),
                s.section.alias("section"),
                F.trim(
                    F.array_join(
                        F.slice(lines, s.at + 1, F.coalesce(F.get(starts, i + 1).at, F.size(lines)) - s.at),
                        "\n",
                    ),
                    F.lit(" \n"),
                ).alias("text"),
            ),
        )

    return _let(
        F.split(page.text, "\n"),
        lambda lines: _let(opening(lines), lambda starts: cut(lines, starts)),
    )


def assign_sections(versions: DataFrame) -> DataFrame:
    """Adds ``sections``: array of (page, section, text) over all pages, in order.

    The section is null before the first heading of a page and starts anew on
    each page. Pages without any heading, the common case, are one section.
    """

    def of_page(page: Column) -> Column:
        whole = F.struct(
            page.page.alias("page"), F.lit(None).cast("string").alias("section"), page.text.alias("text")
        )
        return F.when(tx.may_hold_heading(page.text), _page_sections(page)).otherwise(F.array(whole))

    sections = F.flatten(F.transform("pages", of_page))
    return versions.withColumn("sections", sections).withColumn(
        "sections", F.filter("sections", lambda s: s.text != "")
    )


_VERSION_KEYS = ("document_id", "version_id", "document_title", "academic_year", "content_hash")


def chunk_versions(
    versions: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, normalized: bool = False
) -> DataFrame:
    """One row per chunk, numbered over the whole version, with id and content hash.

    ``versions``: document_id, version_id, document_title, academic_year, pages.
    A version without text gives one row with ``error_code`` and no chunk.
    ``normalized`` says that the pages come from ``normalize_pages``, which
    would change nothing in them.
    """
    hashed = versions.withColumn("content_hash", content_hash(F.col("pages"))) if normalized else version_content_hash(versions)
    cut = assign_sections(hashed).select(
        *_VERSION_KEYS,
        F.transform("sections", lambda s: s.page).alias("pages"),
        F.transform("sections", lambda s: s.section).alias("sections"),
        F.transform("sections", lambda s: s.text).alias("texts"),
    )

    def number(batches):
        for batch in batches:
            rows = []
            for *keys, pages, sections, texts in batch.itertuples(index=False):
                index = 0
                for page, section, text in zip(pages, sections, texts):
                    for piece in split_text(text, size, overlap):
                        rows.append((*keys, page, section, index, piece))
                        index += 1
                if index == 0:
                    rows.append((*keys, None, None, None, None))
            yield pd.DataFrame(rows, columns=columns).astype({"page": "Int32", "chunk_index": "Int32"})

    columns = [*_VERSION_KEYS, "page", "section", "chunk_index", "text"]
    chunks = cut.mapInPandas(
        number,
        ", ".join(f"{k} string" for k in _VERSION_KEYS)
        + ", page int, section string, chunk_index int, text string",
    )
    return chunks.select(
        F.when(F.col("text").isNotNull(), point_id(F.col("version_id"), F.col("chunk_index"))).alias("point_id"),
        *_VERSION_KEYS[:4],
        "page",
        "section",
        "chunk_index",
        "content_hash",
        "text",
        F.when(
            F.col("text").isNull() | ~tx.has_extractable_text(F.col("text")), F.lit("PDF_CHUNK_EMPTY")
        ).alias("error_code"),
    )


def nest_pages(pages: DataFrame) -> DataFrame:
    """Pages table -> one row per version, pages in order. For versions that fit in a row, as those of one file do;
    ``chunk_pages`` needs no such row."""
    return pages.groupBy("document_id", "version_id", "document_title", "academic_year").agg(
        F.sort_array(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "text"))).alias("pages")
    )


def flat_content_hash(pages: DataFrame) -> DataFrame:
    """(version_id, content_hash) of normalised flat pages. A version's pages stream through its task in order; none is held
    longer than its batch, so a version may be of any size."""
    schema = pa.schema([("version_id", pa.string()), ("content_hash", pa.string())])
    separator = PAGE_SEPARATOR.encode()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, found = None, None
        for batch in batches:
            for version, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if found is None:
                    found = hashlib.sha256()
                else:
                    found.update(separator)
                found.update(text.encode())
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([version]), pa.array([found.hexdigest()])], schema=schema)

    ordered = pages.select("version_id", "page", "text").repartition("version_id").sortWithinPartitions("version_id", "page")
    return ordered.groupBy("version_id").applyInArrow(digest, "version_id string, content_hash string")


def chunk_pages(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The chunks of ``chunk_versions`` from a flat table of pages, with no version gathered into a row.

    ``pages``: document_id, version_id, document_title, academic_year, page,
    text. Sections and pieces are made page by page, so a version with a large
    share of all pages is spread; numbers come from counts per page.
    """
    keys = [F.col(k) for k in _VERSION_KEYS[:4]]
    one = pages.select(*keys, F.array(F.struct(F.col("page").cast("int").alias("page"), "text")).alias("pages"))
    settled = cut_lineage(normalize_pages(one).select(*keys, F.inline("pages")))
    sections = assign_sections(settled.select(*keys, "page", F.array(F.struct("page", "text")).alias("pages")))
    cut = sections.select(*keys, "page", F.posexplode("sections").alias("section_no", "s")).select(
        *keys, "page", "section_no", "s.section", F.posexplode(split_recursive(size, overlap)("s.text")).alias("piece_no", "text")
    )
    numbered = cut_lineage(assign_chunk_index(cut))
    chunks = numbered.join(flat_content_hash(settled), "version_id").select(
        point_id(F.col("version_id"), F.col("chunk_index")).alias("point_id"), *keys, "page", "section",
        F.col("chunk_index").cast("int").alias("chunk_index"), "content_hash", "text",
        F.when(~tx.has_extractable_text(F.col("text")), F.lit("PDF_CHUNK_EMPTY")).alias("error_code"),
    )
    bare = pages.select(*keys).dropDuplicates(["version_id"]).join(numbered.select("version_id").distinct(), "version_id", "left_anti")
    missing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema}
    no_text = bare.select(
        *[F.lit("PDF_CHUNK_EMPTY").alias(n) if n == "error_code" else F.col(n) if n in bare.columns else missing[n] for n in chunks.columns]
    )
    return chunks.unionByName(no_text)


def assign_chunk_index(pieces: DataFrame) -> DataFrame:
    """0-based chunk numbers over a version for a flat table of pieces.

    ``pieces``: version_id, page, section_no, piece_no, ... Pieces are counted
    per page first; only the counts are put in order per version, so a version
    holding a large share of all rows is spread by page.
    """
    counts = pieces.groupBy("version_id", "page").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("version_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "version_id", "page", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("version_id", "page").orderBy("section_no", "piece_no")
    return (
        pieces.withColumn("_rank", F.row_number().over(within) - 1)
        .join(offsets, ["version_id", "page"])
        .withColumn("chunk_index", F.col("_offset") + F.col("_rank"))
        .drop("_offset", "_rank")
    )
