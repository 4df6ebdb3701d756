"""Files as rows: size and extension rules, signature, content hash, page extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from acervo.functions import text as tx
from acervo.session import bound_batches
from acervo.sources import wanted

# --- fixed values -----------------------------------------------------------
MAX_FILE_BYTES = 25 * 1024 * 1024
PDF_SIGNATURE = "%PDF-"
LOADER_ERRORS = {
    "PasswordException": "PDF_ENCRYPTED",
    "EncryptedPDFError": "PDF_ENCRYPTED",
    "InvalidPDFException": "PDF_CORRUPT",
    "FormatError": "PDF_CORRUPT",
    "MissingPDFException": "PDF_CORRUPT",
}
# ----------------------------------------------------------------------------

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"

# A loader turns the bytes of one file into (page number, text) pairs.
Loader = Callable[[bytes], Iterable[tuple[int, str]]]


def form_feed_pages(content: bytes) -> Iterable[tuple[int, str]]:
    """Default loader: UTF-8 text after the signature line, pages parted by form feeds."""
    body = content.decode("utf-8")
    if body.startswith(PDF_SIGNATURE):
        body = body.partition("\n")[2]
    return enumerate(body.split("\f"), start=1)


def bare_path(path: Column) -> Column:
    """A path without scheme and authority, as requests name it: ``file:/a/b`` and ``store://host/a/b`` are ``/a/b``."""
    return F.regexp_replace(path, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)", "")


def wanted_files(spark: SparkSession, paths: DataFrame, max_bytes: int = MAX_FILE_BYTES, ext: str = ".pdf") -> DataFrame:
    """A row for each path of a table (``path``) that has the extension, opened in the tasks: path, modificationTime, length, content, error_code.

    A file that requests spell in several ways is opened once, one that is too
    large not at all. A path that names no file, or one that can't be read, is
    a row with its code.
    """
    named = paths.where(F.lower("path").endswith(ext.lower())).groupBy(bare_path(F.col("path"))).agg(F.max_by("path", F.length("path")).alias("path"))
    return wanted.load(spark, named, max_bytes)


def read_wanted(spark: SparkSession, paths: DataFrame, ext: str = ".pdf", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The files of a table of paths, no others being opened; a path that names no file gives no row."""
    return wanted_files(spark, paths, max_bytes, ext).where(~F.col("error_code").eqNullSafe(wanted.MISSING))


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES, ext: str = ".pdf") -> DataFrame:
    """Files below ``path`` with ``error_code`` set on those that break a rule.

    The extension and the size limit are filters on the listing, so files that
    break them are never opened; they come from a second listing that does not
    read content.
    """
    def listing() -> DataFrameReader:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true")

    fits = listing().option("pathGlobFilter", "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)).load(path)
    small = fits.where(F.col("length") <= max_bytes)
    listed = listing().load(path).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    others = listed.where((F.col("length") > max_bytes) | ~F.lower("path").endswith(ext.lower()))
    return accept_files(small.unionByName(others), max_bytes, ext)


def file_error(max_bytes: int = MAX_FILE_BYTES, ext: str = ".pdf") -> Column:
    return F.when(~F.lower(F.col("path")).endswith(ext.lower()), F.lit("PDF_EXTENSION_INVALID")).when(
        F.col("length") > max_bytes, F.lit("PDF_TOO_LARGE")
    )


def accept_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, ext: str = ".pdf") -> DataFrame:
    """Marks files that break a rule and takes their content away; codes that files have already stay."""
    error = file_error(max_bytes, ext)
    known = [F.col("error_code")] if "error_code" in files.columns else []
    return files.withColumn("error_code", F.coalesce(*known, error)).withColumn(
        "content", F.when(F.col("error_code").isNull(), F.col("content"))
    )


def check_signature(files: DataFrame) -> DataFrame:
    """Marks files whose first five bytes are not the signature."""
    signed = F.coalesce(F.substring("content", 1, 5) == F.encode(F.lit(PDF_SIGNATURE), "UTF-8"), F.lit(False))
    return files.withColumn(
        "error_code", F.coalesce(F.col("error_code"), F.when(~signed, F.lit("PDF_SIGNATURE_INVALID")))
    )


def hash_content(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2("content", 256))


def extract_pages(files: DataFrame, loader: Loader = form_feed_pages, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per file with its ``pages`` array, or an error code.

    The loader runs per file inside the tasks; a file that cannot be read
    becomes an error row and never fails the job. Pages are normalised, empty
    ones dropped, and the rest put in ascending order.
    """
    from acervo.operators.chunking import normalize_pages

    bound_batches(files)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema if f.name in keys)
    errors = LOADER_ERRORS

    def load(batches):
        for batch in batches:
            starts, page_numbers, page_texts, codes = [0], [], [], []
            for content, error in zip(batch.column("content").to_pylist(), batch.column("error_code").to_pylist()):
                if error is None:
                    try:
                        loaded = [(number, text) for number, text in loader(bytes(content))]
                        numbers = [number for number, _ in loaded]
                        if any(type(n) is not int or n < 1 for n in numbers) or len(set(numbers)) < len(numbers):
                            error = "PDF_METADATA_INVALID"
                        elif any(not isinstance(text, str) for _, text in loaded):
                            error = "PDF_PARSE_FAILED"
                        else:
                            page_numbers += numbers
                            page_texts += [text for _, text in loaded]
                    except Exception as problem:  # a bad file is a row, not a failure
                        error = errors.get(type(problem).__name__, "PDF_PARSE_FAILED")
                starts.append(len(page_texts))
                codes.append(error)
            found = pa.StructArray.from_arrays([pa.array(page_numbers, pa.int32()), pa.array(page_texts, pa.string())], ["page", "text"])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(key) for key in keys], pa.ListArray.from_arrays(pa.array(starts, pa.int32()), found), pa.array(codes, pa.string())],
                names=[*keys, "pages", "error_code"],
            )

    loaded = files.select(*keys, "content", "error_code").mapInArrow(
        load, f"{schema}, pages array<struct<page:int,text:string>>, error_code string"
    )
    enough = tx.has_extractable_chars(F.array_join(F.transform("pages", lambda p: p.text), ""), tx.MIN_EXTRACTED_CHARACTERS)
    return normalize_pages(loaded).withColumn(
        "error_code", F.coalesce(F.col("error_code"), F.when(~enough, F.lit("PDF_TEXT_NOT_FOUND")))
    )
