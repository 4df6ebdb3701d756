"""Corpus audits. Every check gives rows of (check, subject, detail), so they unite into one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.functions import text as tx
from acervo.functions.ids import IDEMPOTENCY_KEY
from acervo.operators.validation import ANSWER_STATUSES
from acervo.session import cut_lineage

# --- fixed values -----------------------------------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+"
PHONE_PATTERN = r"\+34 \d{2} \d{3} \d{2} \d{2}"
URL_PATTERN = (
    r"https?://[a-zA-Z0-9.-]+(?:\.[a-zA-Z0-9.-]+)+(?:/[a-zA-Z0-9._~:/?#\[\]@!$&'()*+,;=-]*)?"
)
FICTIONAL_PHONE = r"\A\+34 91 000 00 \d{2}\z"
FICTIONAL_DOMAIN = ".example.invalid"
ALLOWED_HOSTS = ("localhost",)

# Least numbers of evaluation questions per expected status.
LEAST_QUESTIONS = {"found": 5, "not_found": 3, "ambiguous": 2}
# ----------------------------------------------------------------------------

# EMAIL_PATTERN with the same matches in linear time: a match can only start where a run of its characters starts or where the
# match before it ended, and no run is given back, as neither @ nor the dot belongs to the class before it.
LINEAR_EMAIL = (
    r"(?:(?<![a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-])|\G)[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]++"
    r"@[a-zA-Z0-9-]++(?:\.[a-zA-Z0-9-]++)++"
)


def violation(check: str, subject: Column, detail: Column | None = None) -> list[Column]:
    return [
        F.lit(check).alias("check"),
        subject.cast("string").alias("subject"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    ]


def failing(df: DataFrame, *rules: tuple[str, Column, Column, Column | None]) -> DataFrame:
    """Violations of several row rules (check, condition, subject, detail) in one pass."""
    found = [F.when(broken, F.struct(*violation(check, subject, detail))) for check, broken, subject, detail in rules]
    return df.select(F.explode(F.array(*found)).alias("v")).where(F.col("v").isNotNull()).select("v.*")


def unite(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def scan_contacts(
    pages: DataFrame,
    subject: str,
    allow_domains: tuple[str, ...] = (FICTIONAL_DOMAIN,),
    allow_hosts: tuple[str, ...] = ALLOWED_HOSTS,
    phone_pattern: str = PHONE_PATTERN,
    allowed_phone: str = FICTIONAL_PHONE,
) -> DataFrame:
    """E-mail addresses, phones and URLs that lie outside the allowed patterns.

    One scan finds all three kinds: the matches of a text are one array, so the
    texts are read once and only the matches leave the projection.
    """

    def kind(name: str, pattern: str, needs: str | None = None) -> Column:
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        found = F.when(F.contains("text", F.lit(needs)), matches).otherwise(F.array().cast("array<string>")) if needs else matches
        return F.transform(found, lambda m: F.struct(F.lit(name).alias("kind"), tx.strip_trailing_punct(m).alias("value")))

    # The outer form keeps the optimizer from repeating the search as a filter below it.
    found = pages.select(
        F.col(subject),
        F.explode_outer(F.concat(kind("email", LINEAR_EMAIL, "@"), kind("phone", phone_pattern), kind("url", URL_PATTERN, "http"))).alias("m"),
    ).select(subject, "m.*")
    host = F.lower(F.regexp_extract("value", r"\Ahttps?://([a-zA-Z0-9.-]+)", 1))

    def within(col: Column) -> Column:
        return reduce(lambda a, b: a | b, [col.endswith(d) for d in allow_domains], F.lit(False))

    allowed = (
        F.when(F.col("kind") == "email", within(F.col("value")))
        .when(F.col("kind") == "phone", tx.trimmed(F.col("value")).rlike(allowed_phone))
        .otherwise(within(host) | host.isin(*allow_hosts))
    )
    return found.where(F.col("value").isNotNull() & ~allowed).select(*violation("contact", F.col(subject), F.concat_ws(":", "kind", "value")))


UNIQUE = ("version_id", "file", "idempotency_key")


def version_uses(versions: DataFrame) -> DataFrame:
    """How often each document, source and value that must be unique occurs in the versions, and where first: one pass for all."""
    named = {"document": "document_id", "source": "source", **{c: c for c in UNIQUE}}
    uses = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in named.items()])
    rows = versions.select("document_id", "position", "source", F.explode(uses).alias("u"))
    return rows.groupBy("u.kind", "u.value").agg(
        F.count("*").alias("n"), F.min(F.struct("document_id", "position")).alias("first_use"), F.min_by("source", "position").alias("first_source")
    )


def repeated_sources(versions: DataFrame, uses: DataFrame) -> DataFrame:
    """Sources used again elsewhere than as the first source of the same document."""
    c = F.col
    seen = uses.where((c("kind") == "source") & (c("n") > 1)).select(c("value").alias("source"), "first_use")
    first = uses.where(c("kind") == "document").select(c("value").alias("document_id"), c("first_source").alias("own_source"))
    again = (
        versions.select("document_id", "position", "source", "version_id")
        .join(seen, "source")
        .where(F.struct("document_id", "position") > c("first_use"))
        .join(first, "document_id")
        .where(c("source") != c("own_source"))
    )
    return again.select(*violation("duplicate_source", c("source"), c("version_id")))


def validate_manifest(
    documents: DataFrame,
    versions: DataFrame,
    replacement: DataFrame,
    conflicts: DataFrame,
    expected_documents: int = 10,
    expected_multi_version: int = 1,
    schema_tag: str = "corpus-manifest/v1",
) -> DataFrame:
    """Violations of the manifest rules, over its flattened tables."""
    c = F.col
    uses = cut_lineage(version_uses(versions))
    schemas = cut_lineage(documents.groupBy("manifest_schema").agg(F.count("*").alias("n")))
    claims = cut_lineage(
        conflicts.groupBy("conflict_id").agg(
            F.count("*").alias("n"), F.min("document_id").alias("least"), F.max("document_id").alias("most")
        )
    )
    known = documents.select("document_id", F.lit(True).alias("known")).distinct()
    owned = versions.select("document_id", "version_id").distinct()
    checked = replacement.join(known, "document_id", "left")
    for side in ("previous", "current"):
        mark = owned.select("document_id", c("version_id").alias(f"{side}_version_id"), F.lit(True).alias(f"{side}_known"))
        checked = checked.join(mark, ["document_id", f"{side}_version_id"], "left")
    repeated = uses.where(c("kind").isin(*UNIQUE) & (c("n") > 1))
    multi = uses.where(c("kind") == "document").agg(F.count_if(c("n") > 1).alias("n"))
    return unite(
        [
            schemas.where(~c("manifest_schema").eqNullSafe(schema_tag)).select(*violation("schema", c("manifest_schema"))),
            schemas.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where(c("n") != expected_documents).select(
                *violation("document_count", c("n"))
            ),
            multi.where(c("n") != expected_multi_version).select(*violation("multi_version_documents", c("n"))),
            repeated.select(F.concat(F.lit("duplicate_"), "kind").alias("check"), c("value").alias("subject"), c("n").cast("string").alias("detail")),
            repeated_sources(versions, uses),
            versions.where(~F.coalesce(c("idempotency_key").rlike(IDEMPOTENCY_KEY), F.lit(False))).select(
                *violation("invalid_idempotency_key", c("version_id"), c("idempotency_key"))
            ),
            failing(
                checked,
                ("replacement_document", c("known").isNull(), c("document_id"), None),
                ("replacement_previous", c("previous_known").isNull(), c("previous_version_id"), None),
                ("replacement_current", c("current_known").isNull(), c("current_version_id"), None),
                ("replacement_same_version", c("previous_version_id") == c("current_version_id"), c("current_version_id"), None),
                ("replacement_not_active", ~c("current_activates"), c("current_version_id"), None),
            ),
            claims.agg(F.count("*").alias("n")).where(c("n") == 0).select(*violation("no_conflict", F.lit(None))),
            failing(
                claims,
                ("conflict_claims", c("n") != 2, c("conflict_id"), c("n")),
                ("conflict_same_document", (c("n") == 2) & (c("least") == c("most")), c("conflict_id"), None),
            ),
            conflicts.join(documents.select("document_id"), "document_id", "left_anti").select(
                *violation("conflict_unknown_document", c("conflict_id"), c("document_id"))
            ),
        ]
    )


def validate_source_consistency(sources: DataFrame, expected: DataFrame) -> DataFrame:
    """Sources that the manifest names and no file gives, or whose institution differs from the manifest's.

    ``sources``: source, institution (struct); ``expected``: the institutions
    table of the flattened manifest.
    """
    joined = expected.join(sources.withColumn("_given", F.lit(True)), "source", "left")
    given = F.col("_given").isNotNull()
    return failing(
        joined,
        ("source_missing", ~given, F.col("source"), None),
        *[
            (f"institution_{n}", given & ~F.col(f"institution.{n}").eqNullSafe(F.col(f"expected_{n}")), F.col("source"), F.col(f"institution.{n}"))
            for n in ("name", "email", "phone")
        ],
    )


def validate_eval_set(questions: DataFrame, documents: DataFrame, least: dict[str, int] = LEAST_QUESTIONS) -> DataFrame:
    """Violations of the evaluation set rules."""
    c = F.col
    counts = questions.agg(*[F.count_if(c("expected_status") == s).alias(s) for s in least])
    answerable = c("expected_status").isin("found", "ambiguous")
    named = questions.where(answerable).select("question_id", F.explode("expected_document_ids").alias("document_id"))
    empty = (F.size("expected_document_ids") == 0) & (F.size("expected_pages") == 0)
    return unite(
        [
            failing(
                questions,
                ("status", ~F.coalesce(c("expected_status").isin(*ANSWER_STATUSES), F.lit(False)), c("question_id"), c("expected_status")),
                ("page_number", answerable & F.exists("expected_pages", lambda p: p < 1), c("question_id"), None),
                ("not_found_with_documents", (c("expected_status") == "not_found") & ~empty, c("question_id"), None),
            ),
            failing(counts, *[("too_few_questions", c(s) < n, F.lit(s), c(s)) for s, n in least.items()]),
            named.join(documents.select("document_id"), "document_id", "left_anti").select(
                *violation("unknown_document", c("question_id"), c("document_id"))
            ),
            questions.where((tx.nfc(c("question")) != c("question")) | c("question").rlike(r"\p{C}")).select(
                *violation("question_text", c("question_id"))
            ),
        ]
    )


def find_conflicts(claims: DataFrame) -> DataFrame:
    """Subjects on which different documents make claims."""
    return (
        claims.groupBy("subject")
        .agg(
            F.count("*").alias("claims"),
            F.min("document_id").alias("first_document"),
            F.max("document_id").alias("last_document"),
        )
        .where(F.col("first_document") != F.col("last_document"))
    )


def corpus_summary(files: DataFrame) -> DataFrame:
    """Files, bytes and pages per file, with the totals (file null)."""
    return files.rollup("file").agg(
        F.count("*").alias("files"),
        F.sum("bytes").alias("bytes"),
        F.sum("pages").alias("pages"),
        F.when(F.grouping("file") == 0, F.max("sha256")).alias("sha256"),
    )
