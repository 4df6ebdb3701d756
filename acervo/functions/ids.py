"""Identifiers: stable point ids, request hashes, and their validity rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import trimmed

# --- fixed values -----------------------------------------------------------
POINT_NAMESPACE = "1f588a94-853c-5fd6-a703-bd57aaf65a5a"
IDEMPOTENCY_KEY = r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"
UUID_FORM = (
    r"\A(?:[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
    r"|0{8}-0{4}-0{4}-0{4}-0{12}|f{8}-f{4}-f{4}-f{4}-f{12})\z"
)
ACADEMIC_YEAR = r"\A[0-9]{4}-[0-9]{4}\z"
# ----------------------------------------------------------------------------


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Name-based UUID (version 5) as canonical text."""
    prefix = F.unhex(F.lit(uuid.UUID(namespace).hex))
    digest = F.sha1(F.concat(prefix, F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def point_id(version_id: Column, chunk_index: Column) -> Column:
    return uuid5(F.concat_ws(":", version_id, chunk_index.cast("string")))


def canonical_uuid(col: Column) -> Column:
    """Lower-cased UUID, null when the text is not one."""
    low = F.lower(col)
    return F.when(low.rlike(UUID_FORM), low)


def valid_idempotency_key(col: Column) -> Column:
    return F.coalesce(trimmed(col).rlike(IDEMPOTENCY_KEY), F.lit(False))


def academic_year_shape(col: Column) -> Column:
    return F.coalesce(trimmed(col).rlike(ACADEMIC_YEAR), F.lit(False))


def academic_year_follows(col: Column) -> Column:
    year = trimmed(col)
    first = F.substring(year, 1, 4).try_cast("int")
    second = F.substring(year, 6, 4).try_cast("int")
    return F.coalesce(second == first + 1, F.lit(False))


def valid_academic_year(col: Column) -> Column:
    """Two four-digit years joined by a dash, the second following the first."""
    return academic_year_shape(col) & academic_year_follows(col)


def request_hash(
    content_hash: Column,
    document_id: Column,
    version_id: Column,
    title: Column,
    academic_year: Column,
    description: Column,
) -> Column:
    """SHA-256 over the content hash and the metadata as JSON in fixed key order."""
    metadata = F.struct(
        document_id.alias("documentId"),
        version_id.alias("versionId"),
        title.alias("title"),
        academic_year.alias("academicYear"),
        description.alias("description"),
    )
    body = F.to_json(metadata, {"ignoreNullFields": "false"})
    return F.sha2(F.concat(content_hash, body), 256)
