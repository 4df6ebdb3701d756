"""Registered queries: files and JSON inputs derived from the given tables, vector sizes, and failing models."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.checks.registry import CHECKS, Tables, check
from acervo.operators import models
from acervo.session import cut_lineage, qualified, shared_dir
from acervo.sources import corpus_json, files, wanted
from acervo.sources import snapshots as sn


@check("read_files")
def _(t: Tables) -> DataFrame:
    """The files of the given tables themselves, all of them; their bytes are beyond SQL that doesn't know the folder (see test_sources)."""
    read = files.hash_content(files.read_files(t.spark, t.folder, ext=".parquet"))
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "error_code", "content_hash")


def _text_files(rows: DataFrame, out: str) -> DataFrame:
    """(path) of a text file for each key ``k``, below a folder of its own; its lines are those of ``value``. The tasks write the files
    themselves, so that neither a commit nor a listing goes through them one by one."""
    spark = rows.sparkSession
    folder, default_store = qualified(spark, out), qualified(spark, "/")

    def write(batches):
        for batch in batches:
            paths = []
            for k, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = wanted.opened(f"{folder}/k={k}", default_store)
                store.create_dir(at)
                with store.open_output_stream(f"{at}/part.txt") as stream:
                    stream.write("".join(line + "\n" for line in lines).encode())
                paths.append(f"{folder}/k={k}/part.txt")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    of_key = rows.groupBy("k").agg(F.sort_array(F.collect_list("value")).alias("lines"))
    return cut_lineage(of_key.select("k", "lines").mapInArrow(write, "path string"))


# Each supplier is a file, asked for beside a path that names none. Its text ends with a line feed.
@check(
    "wanted_files",
    """WITH given AS (SELECT s_suppkey, concat_ws(' ', s_suppkey, s_name, s_nationkey)||chr(10) AS content FROM supplier)
    SELECT s_suppkey, CAST(strlen(content) AS BIGINT) AS length, sha256(content) AS content_hash, CAST(NULL AS VARCHAR) AS error_code FROM given
    UNION ALL SELECT -s_suppkey, NULL, NULL, 'PDF_REQUIRED' FROM given""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    out = shared_dir(t.spark, "supplier-files")
    text = F.concat_ws(" ", c("s_suppkey").cast("string"), "s_name", c("s_nationkey").cast("string"))
    paths = _text_files(t.supplier.select(text.alias("value"), c("s_suppkey").alias("k")), out)
    asked = paths.unionByName(paths.select(F.regexp_replace("path", r"/k=(\d+)/", "/k=-$1/").alias("path")))
    read = files.hash_content(files.wanted_files(t.spark, asked, ext=".txt"))
    return read.select(F.regexp_extract("path", r"/k=(-?\d+)/", 1).cast("bigint").alias("s_suppkey"), "length", "content_hash", "error_code")


def _written(t: Tables, rows: DataFrame, name: str) -> str:
    """One JSON file for each row, below a folder for its key ``k``."""
    out = shared_dir(t.spark, name)
    rows.write.partitionBy("k").json(out)
    return out


# A nation is a source; its suppliers are the pages.
@check(
    "read_json_pages",
    """SELECT row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS page,
      concat_ws(chr(10), s_name, CAST(s_suppkey AS VARCHAR), 'nation '||s_nationkey) AS text FROM supplier""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    page = F.struct(
        c("s_suppkey"), c("s_name").alias("heading"),
        F.array(c("s_suppkey").cast("string"), F.concat(F.lit("nation "), c("s_nationkey").cast("string"))).alias("paragraphs"),
    )
    pages = F.transform(F.sort_array(F.collect_list(page)), lambda p: F.struct(p.heading.alias("heading"), p.paragraphs.alias("paragraphs")))
    sources = t.supplier.groupBy(c("s_nationkey").alias("k")).agg(pages.alias("pages"))
    read = corpus_json.read_json_pages(t.spark, _written(t, sources, "sources"))
    return read.select(c("page").cast("bigint").alias("page"), "text")


# A nation has a manifest; its suppliers are documents of one version each.
@check(
    "flatten_manifest",
    """SELECT 'd'||s_suppkey AS document_id, CAST(0 AS BIGINT) AS position, 'v'||s_suppkey AS version_id, s_name AS title, '2026-2027' AS academic_year,
      n_name||'.json' AS source, s_name||'.pdf' AS file, 'seed-'||s_suppkey AS idempotency_key, s_suppkey % 3 = 0 AS activate
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    key = c("s_suppkey").cast("string")
    version = F.struct(
        F.concat(F.lit("v"), key).alias("versionId"), c("s_name").alias("title"), F.lit("2026-2027").alias("academicYear"),
        F.concat("n_name", F.lit(".json")).alias("source"), F.concat("s_name", F.lit(".pdf")).alias("file"),
        F.concat(F.lit("seed-"), key).alias("idempotencyKey"), F.when(c("s_suppkey") % 3 == 0, True).alias("activate"),
    )
    document = F.struct(F.concat(F.lit("d"), key).alias("documentId"), c("n_name").alias("topic"), c("s_name").alias("title"), F.array(version).alias("versions"))
    manifests = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).groupBy(c("n_nationkey").alias("k")).agg(F.collect_list(document).alias("documents"))
    read = corpus_json.read_manifest(t.spark, _written(t, manifests, "manifests"))
    return corpus_json.flatten_manifest(read)["versions"].withColumn("position", c("position").cast("bigint"))


# The manifests' other tables: the institution, one replacement (of a nation's first supplier by its last), one conflict of all.
@check(
    "flatten_manifest_tables",
    """WITH given AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    ends AS (SELECT n_nationkey, min(s_suppkey) AS a, max(s_suppkey) AS b FROM given GROUP BY ALL)
    SELECT 'documents' AS tab, 'd'||s_suppkey AS a, 'manifest/'||n_regionkey AS b, n_name AS c, s_name||'/'||coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'about '||s_name END, '-') AS d FROM given
    UNION ALL SELECT DISTINCT 'institutions', n_name||'.json', n_name, lower(n_name)||'@school', CAST(n_nationkey AS VARCHAR) FROM given
    UNION ALL SELECT 'replacement', 'd'||a, 'v'||a, 'v'||b, CAST(b % 2 = 0 AS VARCHAR) FROM ends
    UNION ALL SELECT 'conflicts', 'c'||n_nationkey, n_name, 'd'||s_suppkey||'/v'||s_suppkey, (s_suppkey % 7 + 1)||'/'||s_name FROM given""",
)
def _(t: Tables) -> DataFrame:
    c, lit = F.col, F.lit
    key = c("s_suppkey").cast("string")
    document = F.struct(
        F.concat(lit("d"), key).alias("documentId"), c("n_name").alias("topic"), c("s_name").alias("title"),
        F.when(c("s_suppkey") % 2 == 0, F.concat(lit("about "), "s_name")).alias("description"),
        F.array(F.struct(F.concat(lit("v"), key).alias("versionId"), F.concat("n_name", lit(".json")).alias("source"))).alias("versions"),
    )
    claim = F.struct(
        "s_suppkey", F.concat(lit("d"), key).alias("documentId"), F.concat(lit("v"), key).alias("versionId"),
        (c("s_suppkey") % 7 + 1).cast("int").alias("page"), c("s_name").alias("claim"),
    )
    nation = c("n_nationkey").cast("string")
    first, last = F.min("s_suppkey"), F.max("s_suppkey")
    manifests = (
        t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).groupBy("n_nationkey", "n_name", "n_regionkey")
        .agg(F.collect_list(document).alias("documents"), F.sort_array(F.collect_list(claim)).alias("claims"), first.alias("first"), last.alias("last"))
        .select(
            c("n_nationkey").alias("k"), F.concat(lit("manifest/"), c("n_regionkey").cast("string")).alias("schema"),
            F.struct(c("n_name").alias("name"), F.concat(F.lower("n_name"), lit("@school")).alias("email"), nation.alias("phone")).alias("institution"),
            "documents",
            F.struct(
                F.concat(lit("d"), c("first").cast("string")).alias("documentId"),
                F.struct(F.concat(lit("v"), c("first").cast("string")).alias("versionId")).alias("previous"),
                F.struct(F.concat(lit("v"), c("last").cast("string")).alias("versionId"), F.when(c("last") % 2 == 0, True).alias("activate")).alias("current"),
            ).alias("replacement"),
            F.array(F.struct(F.concat(lit("c"), nation).alias("id"), c("n_name").alias("subject"), F.transform("claims", lambda x: x.dropFields("s_suppkey")).alias("claims"))).alias("conflicts"),
        )
    )
    flat = corpus_json.flatten_manifest(corpus_json.read_manifest(t.spark, _written(t, manifests, "manifests")))

    def shown(name: str, *columns) -> DataFrame:
        return flat[name].select(lit(name).alias("tab"), *[column.cast("string").alias(to) for to, column in zip("abcd", columns)])

    slash = lit("/")
    return (
        shown("documents", c("document_id"), c("manifest_schema"), c("topic"), F.concat("title", slash, F.coalesce("description", lit("-"))))
        .unionByName(shown("institutions", c("source"), c("expected_name"), c("expected_email"), c("expected_phone")))
        .unionByName(shown("replacement", c("document_id"), c("previous_version_id"), c("current_version_id"), c("current_activates")))
        .unionByName(shown("conflicts", c("conflict_id"), c("subject"), F.concat("document_id", slash, "version_id"), F.concat(c("page").cast("string"), slash, "claim")))
    )


# Fifty conversations are one file of questions.
@check(
    "read_eval_questions",
    """SELECT conv_id||'-'||turn AS question_id, text AS question, role AS expected_status, 'c'||conv_id AS expected_document, turn + 1 AS expected_page
    FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    item = F.struct(
        F.concat_ws("-", c("conv_id").cast("string"), c("turn").cast("string")).alias("id"), c("text").alias("question"), c("role").alias("expectedStatus"),
        F.array(F.concat(F.lit("c"), c("conv_id").cast("string"))).alias("expectedDocumentIds"), F.array(c("turn") + 1).alias("expectedPages"),
    )
    sets = t.conversations.groupBy(F.floor(c("conv_id") / 50).alias("k")).agg(F.collect_list(item).alias("questions"))
    read = corpus_json.read_eval_questions(t.spark, _written(t, sets, "questions"))
    return read.select(
        "question_id", "question", "expected_status", c("expected_document_ids")[0].alias("expected_document"),
        c("expected_pages")[0].cast("bigint").alias("expected_page"),
    )


@check("ensured_vectors", "SELECT vec_id AS point_id, len(embedding)::INT AS size FROM embeddings")
def _(t: Tables) -> DataFrame:
    points = t.embeddings.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    return sn.ensure_vector_schema(points, 64).select("point_id", F.size("vector").alias("size"))


def unsteady_embedder():
    """Refuses texts that start with A, and loses its connection at the first call of each task."""
    calls = []

    def embed(texts: list[str]):
        calls.append(len(texts))
        if len(calls) == 1:
            raise ConnectionResetError("lost once")
        if any(text.startswith("A") for text in texts):
            raise ValueError("refused")
        return [[float(len(text)), 1.0] for text in texts]

    return embed


@check(
    "embed_refusals",
    """SELECT doc_id, CASE WHEN text LIKE 'A%' THEN 'EMBEDDING_GENERATION_FAILED' END AS embed_error,
      CASE WHEN text NOT LIKE 'A%' THEN CAST(length(text) AS DOUBLE) END AS first_value FROM documents""",
)
def _(t: Tables) -> DataFrame:
    rows = models.embed_documents(t.documents.select("doc_id", "text"), lambda: unsteady_embedder(), dims=2)
    return rows.select("doc_id", "embed_error", F.get("vector", F.lit(0)).cast("double").alias("first_value"))


def embedder_with_outages():
    """Times out on every call that holds a text starting with A."""

    def embed(texts: list[str]):
        if any(text.startswith("A") for text in texts):
            raise TimeoutError("no answer")
        return [[float(len(text)), 1.0] for text in texts]

    return embed


# Documents are embedded in batches; an outage fails the one document that meets it by itself.
@check("embed_outages", CHECKS["embed_refusals"].sql)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text")
    made = models.embed_documents(rows, lambda: embedder_with_outages(), dims=2, document_column="doc_id", delays=(0.0,))
    return made.select("doc_id", "embed_error", F.get("vector", F.lit(0)).cast("double").alias("first_value"))
