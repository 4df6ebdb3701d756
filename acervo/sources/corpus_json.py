"""Multi-line JSON inputs: source documents, the corpus manifest, evaluation questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSTITUTION = "struct<name:string,email:string,phone:string,address:string>"
VERSION = (
    "struct<versionId:string,title:string,academicYear:string,source:string,file:string,"
    "idempotencyKey:string,activate:boolean,replaced:boolean>"
)
SOURCE_SCHEMA = f"institution {INSTITUTION}, pages array<struct<heading:string,paragraphs:array<string>>>"
MANIFEST_SCHEMA = (
    f"schema string, producer string, generatedAt string, academicYear string, institution {INSTITUTION}, "
    "documents array<struct<documentId:string,topic:string,title:string,description:string,"
    f"versions:array<{VERSION}>>>, "
    f"replacement struct<topic:string,documentId:string,previous:{VERSION},current:{VERSION}>, "
    "conflicts array<struct<id:string,subject:string,"
    "claims:array<struct<documentId:string,versionId:string,page:int,claim:string>>>>"
)
QUESTIONS_SCHEMA = (
    "schema string, academicYear string, questions array<struct<id:string,question:string,"
    "expectedStatus:string,expectedDocumentIds:array<string>,expectedPages:array<int>>>"
)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source documents with the name of their file. Spark gives names percent-encoded; a plus is a plus."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return (
        spark.read.schema(SOURCE_SCHEMA)
        .json(path, multiLine=True)
        .withColumn("source", name)
    )


def pages_of_sources(sources: DataFrame) -> DataFrame:
    """Source documents -> (source, page, text): heading and paragraphs, one per line."""
    return sources.select("source", F.posexplode("pages").alias("at", "p")).select(
        "source",
        (F.col("at") + 1).alias("page"),
        F.concat_ws("\n", F.col("p.heading"), F.col("p.paragraphs")).alias("text"),
    )


def read_json_pages(spark: SparkSession, path: str) -> DataFrame:
    return pages_of_sources(read_sources(spark, path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)


def flatten_manifest(manifest: DataFrame) -> dict[str, DataFrame]:
    """The nested manifest as tables: documents, versions, replacement, conflicts, institutions."""
    documents = manifest.select(F.col("schema").alias("manifest_schema"), F.explode("documents").alias("d"))
    versions = documents.select("d.documentId", F.posexplode("d.versions").alias("position", "v"))
    replacement = manifest.where(F.col("replacement").isNotNull()).select(
        F.col("replacement.documentId").alias("document_id"),
        F.col("replacement.previous.versionId").alias("previous_version_id"),
        F.col("replacement.current.versionId").alias("current_version_id"),
        F.coalesce(F.col("replacement.current.activate"), F.lit(False)).alias("current_activates"),
    )
    conflicts = manifest.select(F.explode("conflicts").alias("c")).select(
        F.col("c.id").alias("conflict_id"), F.col("c.subject").alias("subject"), F.posexplode("c.claims").alias("position", "k")
    )
    institutions = manifest.select("institution", F.explode("documents").alias("d")).select(
        *[F.col(f"institution.{n}").alias(f"expected_{n}") for n in ("name", "email", "phone")],
        F.explode("d.versions.source").alias("source"),
    )
    return {
        "institutions": institutions.distinct(),
        "documents": documents.select(
            "manifest_schema",
            F.col("d.documentId").alias("document_id"),
            F.col("d.topic").alias("topic"),
            F.col("d.title").alias("title"),
            F.col("d.description").alias("description"),
        ),
        "versions": versions.select(
            F.col("documentId").alias("document_id"),
            "position",
            F.col("v.versionId").alias("version_id"),
            F.col("v.title").alias("title"),
            F.col("v.academicYear").alias("academic_year"),
            F.col("v.source").alias("source"),
            F.col("v.file").alias("file"),
            F.col("v.idempotencyKey").alias("idempotency_key"),
            F.coalesce(F.col("v.activate"), F.lit(False)).alias("activate"),
        ),
        "replacement": replacement,
        "conflicts": conflicts.select(
            "conflict_id",
            "subject",
            F.col("k.documentId").alias("document_id"),
            F.col("k.versionId").alias("version_id"),
            F.col("k.page").alias("page"),
            F.col("k.claim").alias("claim"),
        ),
    }


def questions_of(evaluation: DataFrame) -> DataFrame:
    return evaluation.select(F.explode("questions").alias("q")).select(
        F.col("q.id").alias("question_id"),
        F.col("q.question").alias("question"),
        F.col("q.expectedStatus").alias("expected_status"),
        F.col("q.expectedDocumentIds").alias("expected_document_ids"),
        F.col("q.expectedPages").alias("expected_pages"),
    )


def read_eval_questions(spark: SparkSession, path: str) -> DataFrame:
    return questions_of(spark.read.schema(QUESTIONS_SCHEMA).json(path, multiLine=True))
