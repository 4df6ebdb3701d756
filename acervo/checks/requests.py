"""Registered queries: request rules, admission, ledger and keyed snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.checks import fragments as fr
from acervo.checks.registry import Tables, check
from acervo.functions import fields, ids
from acervo.functions import text as tx
from acervo.operators import admission, validation
from acervo.sources import ledger as lg
from acervo.sources import snapshots as sn

# Fixed values below, spelt out for the SQL: the forms of UUIDs, idempotency keys and academic years.
_UUID_SQL = "'00000000-0000-4000-8000-'||lpad(CAST(c_custkey AS VARCHAR), 12, '0')"

# Requests made from customers; each nation breaks another rule, or none.
REQUESTS_SQL = f"""requests AS (
  SELECT c_custkey AS seq,
    CASE c_nationkey WHEN 0 THEN NULL WHEN 1 THEN '-'||c_name WHEN 2 THEN '  ' ELSE ' '||replace(c_name, '#', ':')||chr(160) END AS idempotency_key,
    CASE c_nationkey WHEN 3 THEN c_name ELSE upper({_UUID_SQL}) END AS document_id,
    CASE c_nationkey WHEN 4 THEN NULL ELSE {_UUID_SQL} END AS version_id,
    CASE c_nationkey WHEN 5 THEN '   ' WHEN 6 THEN repeat(c_name, 12) WHEN 7 THEN c_name||chr(8203)||'x'
      ELSE chr(9)||c_mktsegment||' e'||chr(769)||' ' END AS title,
    CASE c_nationkey WHEN 8 THEN '2026/2027' WHEN 9 THEN '2026-2028' ELSE ' 2026-2027 ' END AS academic_year,
    CASE c_nationkey WHEN 10 THEN c_name||chr(7)||'x' WHEN 11 THEN '  ' WHEN 12 THEN NULL ELSE c_mktsegment END AS description,
    CASE c_nationkey WHEN 13 THEN NULL WHEN 14 THEN c_name||'.txt' WHEN 15 THEN '.pdf' ELSE c_name||'.PDF' END AS file_name,
    CASE c_nationkey WHEN 16 THEN 'text/plain' WHEN 17 THEN NULL ELSE 'application/pdf' END AS mime_type
  FROM customer)"""


def _by_nation(default: Column, **cases) -> Column:
    out = None
    for nation, value in cases.items():
        value = F.lit(value) if value is None or isinstance(value, str) else value
        test = F.col("c_nationkey") == int(nation[1:])
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def requests(t: Tables) -> DataFrame:
    c = F.col
    name, segment = c("c_name"), c("c_mktsegment")
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(c("c_custkey").cast("string"), 12, "0"))
    return t.customer.select(
        c("c_custkey").alias("seq"),
        _by_nation(
            F.concat(F.lit(" "), F.replace(name, F.lit("#"), F.lit(":")), F.lit(chr(160))),
            n0=None, n1=F.concat(F.lit("-"), name), n2="  ",
        ).alias("idempotency_key"),
        _by_nation(F.upper(uuid), n3=name).alias("document_id"),
        _by_nation(uuid, n4=None).alias("version_id"),
        _by_nation(
            F.concat(F.lit("\t"), segment, F.lit(" e" + chr(769) + " ")),
            n5="   ", n6=F.repeat(name, 12), n7=F.concat(name, F.lit(chr(8203) + "x")),
        ).alias("title"),
        _by_nation(F.lit(" 2026-2027 "), n8="2026/2027", n9="2026-2028").alias("academic_year"),
        _by_nation(segment, n10=F.concat(name, F.lit("\x07x")), n11="  ", n12=None).alias("description"),
        _by_nation(F.concat(name, F.lit(".PDF")), n13=None, n14=F.concat(name, F.lit(".txt")), n15=".pdf").alias("file_name"),
        _by_nation(F.lit("application/pdf"), n16="text/plain", n17=None).alias("mime_type"),
    )


_UUID_RE = "^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


@check(
    "validate_requests",
    f"""WITH {REQUESTS_SQL}, canonical AS (
      SELECT seq, {fr.trimmed('idempotency_key')} AS idempotency_key,
        CASE WHEN regexp_matches(lower(document_id), '{_UUID_RE}') THEN lower(document_id) END AS document_id,
        CASE WHEN regexp_matches(lower(version_id), '{_UUID_RE}') THEN lower(version_id) END AS version_id,
        {fr.canonical('title', 1, 200)} AS title, {fr.trimmed('academic_year')} AS academic_year,
        description AS given, {fr.canonical('description', 0, 1000)} AS description, file_name, mime_type FROM requests)
    SELECT seq, idempotency_key, document_id, version_id, title, academic_year, nullif(description, '') AS description,
      CASE WHEN coalesce(idempotency_key, '') = '' THEN 'IDEMPOTENCY_KEY_REQUIRED'
        WHEN NOT regexp_matches(idempotency_key, '^[A-Za-z0-9][A-Za-z0-9._:-]{{0,127}}$') THEN 'IDEMPOTENCY_KEY_INVALID'
        WHEN document_id IS NULL OR version_id IS NULL OR title IS NULL OR NOT regexp_matches(academic_year, '^\\d{{4}}-\\d{{4}}$')
          OR (given IS NOT NULL AND description IS NULL) THEN 'INDEXING_METADATA_INVALID'
        WHEN file_name IS NULL THEN 'PDF_REQUIRED'
        WHEN NOT regexp_matches(lower(file_name), '[^/]\\.pdf$') THEN 'PDF_EXTENSION_INVALID'
        WHEN coalesce(mime_type, '') <> 'application/pdf' THEN 'PDF_MIME_INVALID'
        WHEN CAST(substr(academic_year, 6, 4) AS INT) <> CAST(substr(academic_year, 1, 4) AS INT) + 1 THEN 'INDEXING_METADATA_INVALID'
      END AS error_code FROM canonical""",
)
def _(t: Tables) -> DataFrame:
    return validation.validate_requests(requests(t)).select(
        "seq", "idempotency_key", "document_id", "version_id", "title", "academic_year", "description", "error_code"
    )


@check(
    "valid_academic_year",
    """SELECT o_orderkey, regexp_matches(y, '^\\d{4}-\\d{4}$') AND
      TRY_CAST(substr(y, 6, 4) AS INT) = TRY_CAST(substr(y, 1, 4) AS INT) + 1 AS valid
    FROM (SELECT o_orderkey, year(o_orderdate)||'-'||(1992 + ascii(o_orderpriority) - 48) AS y FROM orders)""",
)
def _(t: Tables) -> DataFrame:
    second = F.lit(1992) + F.ascii("o_orderpriority") - 48
    year = F.concat_ws("-", F.year("o_orderdate").cast("string"), second.cast("string"))
    return t.orders.select("o_orderkey", ids.valid_academic_year(year).alias("valid"))


@check(
    "valid_idempotency_key",
    """SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$') AS by_name,
      regexp_matches(replace(p_name, ' ', '-'), '^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$') AS dashed FROM part""",
)
def _(t: Tables) -> DataFrame:
    dashed = F.replace("p_name", F.lit(" "), F.lit("-"))
    return t.part.select(
        "p_partkey",
        ids.valid_idempotency_key(F.col("p_name")).alias("by_name"),
        ids.valid_idempotency_key(dashed).alias("dashed"),
    )


@check(
    "canonical_uuid",
    f"""WITH u AS (SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_name WHEN c_nationkey < 15 THEN upper({_UUID_SQL})
        ELSE replace({_UUID_SQL}, '-8000-', '-c000-') END AS id FROM customer)
    SELECT c_custkey, CASE WHEN regexp_matches(lower(id), '{_UUID_RE}') THEN lower(id) END AS id FROM u""",
)
def _(t: Tables) -> DataFrame:
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    given = (
        F.when(F.col("c_nationkey") < 5, F.col("c_name"))
        .when(F.col("c_nationkey") < 15, F.upper(uuid))
        .otherwise(F.replace(uuid, F.lit("-8000-"), F.lit("-c000-")))
    )
    return t.customer.select("c_custkey", ids.canonical_uuid(given).alias("id"))


# Titles from conversations: one role gets control characters, one decomposed accents.
@check(
    "canonical_text",
    f"""WITH x AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN text||chr(8203)||'.' ELSE ' '||replace(text, 'é', 'e'||chr(769))||chr(160) END AS text
                   FROM conversations)
    SELECT conv_id, turn, {fr.canonical('text', 1, 200)} AS title, {fr.canonical('text', 0, 1000)} AS description FROM x""",
)
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("role") == "system", F.concat("text", F.lit(chr(8203) + "."))).otherwise(
        F.concat(F.lit(" "), F.replace("text", F.lit("é"), F.lit("e" + chr(769))), F.lit(chr(160)))
    )
    return t.conversations.select(
        "conv_id",
        "turn",
        tx.canonical_text(text, 1, 200).alias("title"),
        tx.canonical_text(text, 0, 1000).alias("description"),
    )


QUESTIONS_SQL = f"""asked AS (SELECT conv_id||'-'||turn AS question_id, {fr.canonical("replace(text, chr(10), ' ')", 1, 1000)} AS question FROM conversations)"""


def questions(t: Tables) -> DataFrame:
    """All turns of all roles as questions, on one line each."""
    return t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("question"),
    )


@check(
    "validate_questions",
    f"WITH {QUESTIONS_SQL} SELECT question_id, question, CASE WHEN question IS NULL THEN 'QUESTION_INVALID' END AS error_code FROM asked",
)
def _(t: Tables) -> DataFrame:
    return validation.validate_questions(questions(t))


# Requests from orders: a customer's orders share a key; the priority is the hash.
ADMISSION_SQL = """requests AS (
  SELECT 'key-'||o_custkey AS idempotency_key, o_orderkey AS seq, o_orderpriority AS request_hash, 'job-'||o_orderkey AS job_id FROM orders),
known AS (SELECT 'key-'||c_custkey AS idempotency_key, '1-URGENT' AS request_hash, 'old-'||c_custkey AS job_id
          FROM customer WHERE c_mktsegment = 'BUILDING')"""


def admission_requests(t: Tables) -> DataFrame:
    return t.orders.select(
        F.concat(F.lit("key-"), F.col("o_custkey").cast("string")).alias("idempotency_key"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("request_hash"),
        F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"),
    )


@check(
    "admit_requests",
    f"""WITH {ADMISSION_SQL}, firsts AS (
      SELECT r.*, first_value(request_hash) OVER w AS first_hash, first_value(job_id) OVER w AS first_job,
             row_number() OVER w AS n FROM requests r WINDOW w AS (PARTITION BY idempotency_key ORDER BY seq)),
    judged AS (
      SELECT f.*, CASE WHEN k.job_id IS NULL AND n = 1 THEN 'new'
        WHEN f.request_hash = coalesce(k.request_hash, first_hash) THEN 'replay' ELSE 'conflict' END AS outcome,
        coalesce(k.job_id, first_job) AS owner_job
      FROM firsts f LEFT JOIN known k ON f.idempotency_key = k.idempotency_key)
    SELECT idempotency_key, seq, request_hash, outcome, CASE WHEN outcome <> 'conflict' THEN owner_job END AS job_id,
      CASE WHEN outcome = 'conflict' THEN 'IDEMPOTENCY_CONFLICT' END AS error_code FROM judged""",
)
def _(t: Tables) -> DataFrame:
    known = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(
        F.concat(F.lit("key-"), F.col("c_custkey").cast("string")).alias("idempotency_key"),
        F.lit("1-URGENT").alias("request_hash"),
        F.concat(F.lit("old-"), F.col("c_custkey").cast("string")).alias("job_id"),
    )
    return admission.admit_requests(admission_requests(t), known).select(
        "idempotency_key", "seq", "request_hash", "outcome", "job_id", "error_code"
    )


@check(
    "check_version_ownership",
    """WITH requests AS (SELECT o_orderkey AS seq, 'v'||o_custkey AS version_id, o_orderstatus AS document_id, o_orderpriority AS content_hash FROM orders),
    known AS (SELECT 'v'||(c_custkey * 2) AS version_id, 'O' AS document_id, '2-HIGH' AS content_hash,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'READY' WHEN 'MACHINERY' THEN 'ACTIVE' WHEN 'FURNITURE' THEN 'FAILED' ELSE 'INDEXING' END AS state
      FROM customer),
    firsts AS (SELECT r.*, first_value(document_id) OVER w AS d, first_value(content_hash) OVER w AS h
               FROM requests r WINDOW w AS (PARTITION BY version_id ORDER BY seq))
    SELECT seq, f.version_id, CASE WHEN f.document_id <> coalesce(k.document_id, d) THEN 'other_document'
      WHEN f.content_hash <> coalesce(k.content_hash, h) THEN 'other_content'
      WHEN k.state IN ('READY', 'ACTIVE') THEN 'already_indexed' WHEN k.state IN ('FAILED', 'ARCHIVED') THEN 'closed_version'
      ELSE 'index' END AS ownership
    FROM firsts f LEFT JOIN known k ON f.version_id = k.version_id""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    asked = t.orders.select(
        c("o_orderkey").alias("seq"),
        fr.version_id(c("o_custkey")).alias("version_id"),
        c("o_orderstatus").alias("document_id"),
        c("o_orderpriority").alias("content_hash"),
    )
    segment = c("c_mktsegment")
    state = (
        F.when(segment == "BUILDING", "READY").when(segment == "MACHINERY", "ACTIVE").when(segment == "FURNITURE", "FAILED")
    ).otherwise("INDEXING")
    # Customers' numbers are doubled, so that some versions are asked for and not known, and others known and not asked for.
    known = t.customer.select(
        fr.version_id(c("c_custkey") * 2).alias("version_id"),
        F.lit("O").alias("document_id"),
        F.lit("2-HIGH").alias("content_hash"),
        state.alias("state"),
    )
    return admission.check_version_ownership(asked, known).select("seq", "version_id", "ownership")


@check(
    "upsert_points",
    """WITH latest AS (SELECT o_custkey AS point_id, o_orderpriority AS text, 'v'||o_orderstatus AS version_id FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
    SELECT c_custkey AS point_id, c_name AS text, 'v'||c_mktsegment AS version_id FROM customer
    WHERE c_custkey NOT IN (SELECT point_id FROM latest) UNION ALL SELECT * FROM latest""",
)
def _(t: Tables) -> DataFrame:
    existing = t.customer.select(
        F.col("c_custkey").alias("point_id"), F.col("c_name").alias("text"), fr.version_id(F.col("c_mktsegment")).alias("version_id")
    )
    incoming = t.orders.select(
        F.col("o_custkey").alias("point_id"),
        F.col("o_orderpriority").alias("text"),
        fr.version_id(F.col("o_orderstatus")).alias("version_id"),
        F.col("o_orderkey").alias("seq"),
    )
    return sn.upsert_points(existing, incoming, "seq")


@check(
    "upsert_documents",
    """WITH latest AS (SELECT o_custkey AS document_id, o_orderpriority AS title, o_orderstatus AS description, o_orderkey AS updated_at FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
    old AS (SELECT c_custkey * 2 AS document_id, c_name AS title, c_mktsegment AS description, CAST(-1 AS BIGINT) AS at FROM customer)
    SELECT coalesce(o.document_id, n.document_id) AS document_id, CASE WHEN n.updated_at IS NULL THEN o.title ELSE n.title END AS title,
      CASE WHEN n.updated_at IS NULL THEN o.description ELSE n.description END AS description,
      coalesce(o.at, n.updated_at) AS created_at, coalesce(n.updated_at, o.at) AS updated_at
    FROM old o FULL JOIN latest n ON o.document_id = n.document_id""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    existing = t.customer.select(
        (c("c_custkey") * 2).alias("document_id"), c("c_name").alias("title"), c("c_mktsegment").alias("description"),
        F.lit(-1).cast("bigint").alias("created_at"), F.lit(-1).cast("bigint").alias("updated_at"),
    )
    incoming = t.orders.select(
        c("o_custkey").alias("document_id"), c("o_orderpriority").alias("title"), c("o_orderstatus").alias("description"),
        c("o_orderkey").alias("updated_at"),
    )
    return sn.upsert_documents(existing, incoming)


# A ledger from events: a user is a job, the event type its stage.
LEDGER_SQL = """outcomes AS (
  SELECT 'job-'||user_id AS job_id, 'd'||user_id AS document_id, 'v'||event_id AS version_id, event_id AS updated_at,
    CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'chunking' WHEN 'click' THEN 'storing' WHEN 'purchase' THEN 'completed' ELSE 'embedding' END AS stage,
    CASE WHEN event_type = 'error' THEN props END AS error
  FROM events),
ledger AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'failed' WHEN stage = 'completed' THEN 'completed' WHEN stage = 'queued' THEN 'queued' ELSE 'processing' END AS status,
    CAST(CASE stage WHEN 'extracting' THEN 15 WHEN 'chunking' THEN 35 WHEN 'embedding' THEN 55 WHEN 'storing' THEN 85 WHEN 'finalizing' THEN 95 WHEN 'completed' THEN 100 ELSE 0 END AS INT) AS progress,
    regexp_replace(upper(error), '[^A-Z0-9_]', '_', 'g') AS error_code, error AS error_message FROM outcomes)"""


def ledger(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    stage = (
        F.when(kind == "signup", "queued").when(kind == "view", "chunking").when(kind == "click", "storing").when(kind == "purchase", "completed")
    ).otherwise("embedding")
    error = F.when(kind == "error", F.col("props"))
    return lg.ledger_rows(
        t.events.select(
            F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
            F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("document_id"),
            fr.version_id(F.col("event_id")).alias("version_id"),
            F.col("event_id").alias("updated_at"),
            stage.alias("stage"),
            F.upper(error).alias("error_code"),
            error.alias("error_message"),
        )
    ).withColumn("completed_at", F.when(F.col("status") == "completed", F.col("updated_at")))


@check("ledger_rows", f"WITH {LEDGER_SQL} SELECT version_id, status, stage, progress, error_code, error_message FROM ledger")
def _(t: Tables) -> DataFrame:
    return ledger(t).select("version_id", "status", "stage", "progress", "error_code", "error_message")


@check(
    "job_status",
    f"""WITH {LEDGER_SQL}, latest AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC) = 1)
    SELECT 'job-'||c_custkey AS job_id, document_id, version_id, status, progress, stage, error_code, error_message,
      CASE WHEN status = 'completed' THEN updated_at END AS completed_at, job_id IS NOT NULL AS found
    FROM customer LEFT JOIN latest ON job_id = 'job-'||c_custkey""",
)
def _(t: Tables) -> DataFrame:
    asked = t.customer.select(F.concat(F.lit("job-"), F.col("c_custkey").cast("string")).alias("job_id"))
    return lg.job_status(ledger(t), asked)


@check("progress_for", f"WITH {LEDGER_SQL} SELECT stage, progress, count(*) AS n FROM ledger GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return ledger(t).select("stage", fields.progress_for(F.col("stage")).alias("progress")).groupBy("stage", "progress").agg(
        F.count("*").alias("n")
    )


@check(
    "ingest_summary",
    f"WITH {LEDGER_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM ledger",
)
def _(t: Tables) -> DataFrame:
    return lg.ingest_summary(ledger(t))


@check(
    "lookup",
    """SELECT o_orderkey, c.c_custkey AS c_custkey, c_name, c.c_custkey IS NOT NULL AS found
    FROM (SELECT o_orderkey, o_custkey + 50 AS k FROM orders) LEFT JOIN customer c ON c_custkey = k""",
)
def _(t: Tables) -> DataFrame:
    keys = t.orders.select("o_orderkey", (F.col("o_custkey") + 50).alias("key"))
    table = t.customer.select(F.col("c_custkey").alias("key"), "c_custkey", "c_name")
    return lg.lookup(table, keys, "key").drop("key")


_JOBS_SQL = """jobs AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS job_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'completed' ELSE 'processing' END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS attempts FROM orders)"""


def jobs(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "completed").otherwise("processing")
    return t.orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("job_id"),
        F.col("o_orderdate").alias("created_at"),
        status.alias("status"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("attempts"),
    )


@check(
    "pending_in_order",
    f"WITH {_JOBS_SQL} SELECT job_id, epoch_us(created_at) AS created_us FROM jobs WHERE status = 'queued' AND attempts < 3 ORDER BY created_at, job_id LIMIT 100",
)
def _(t: Tables) -> DataFrame:
    return lg.pending_in_order(jobs(t), 100).select("job_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))


@check(
    "purges_in_order",
    f"""WITH {_JOBS_SQL} SELECT job_id AS version_id FROM jobs WHERE status = 'queued' AND created_at <= TIMESTAMP '1995-06-30 00:00:00'
    ORDER BY created_at, job_id LIMIT 100""",
)
def _(t: Tables) -> DataFrame:
    queue = jobs(t).select(F.col("job_id").alias("version_id"), "status", "created_at", F.col("created_at").alias("available_at"))
    return lg.purges_in_order(queue, F.lit("1995-06-30 00:00:00").cast("timestamp_ntz"), 100).select("version_id")


@check(
    "orphan_files",
    """WITH files AS (SELECT '/up/upload-'||lpad(CAST(o_orderkey AS VARCHAR), 8, '0')||CASE WHEN o_orderstatus = 'P' THEN '.tmp' ELSE '.pdf' END AS path FROM orders)
    SELECT path FROM files WHERE regexp_matches(split_part(path, '/', 3), '^upload-\\d{8}\\.pdf$')
      AND path NOT IN (SELECT '/up/upload-'||lpad(CAST(l_orderkey AS VARCHAR), 8, '0')||'.pdf' FROM lineitem WHERE l_returnflag IN ('R'))""",
)
def _(t: Tables) -> DataFrame:
    from acervo.operators.lifecycle import orphan_files

    def path(key: str, ext: Column) -> Column:
        return F.concat(F.lit("/up/upload-"), F.lpad(F.col(key).cast("string"), 8, "0"), ext).alias("path")

    ext = F.when(F.col("o_orderstatus") == "P", ".tmp").otherwise(".pdf")
    live = t.lineitem.select(
        path("l_orderkey", F.lit(".pdf")), F.when(F.col("l_returnflag") == "R", "processing").otherwise("completed").alias("status")
    )
    return orphan_files(t.orders.select(path("o_orderkey", ext)), live, r"\Aupload-\d{8}\.pdf\z")


# Failures from events.
@check(
    "classify_failure",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'PDF_CORRUPT' WHEN event_type = 'view' THEN 'PDF_CHUNK_EMPTY'
        WHEN event_type = 'signup' AND value < 20 THEN 'VECTOR_DIMENSION_MISMATCH'
        WHEN stage = 'embedding' THEN 'EMBEDDING_GENERATION_FAILED' WHEN stage = 'storing' THEN 'VECTOR_STORE_UNAVAILABLE' ELSE 'INDEXING_FAILED' END AS error_code
    FROM (SELECT *, CASE WHEN value < 10 THEN 'embedding' WHEN value < 40 THEN 'storing' ELSE 'finalizing' END AS stage FROM events)""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    raw = (
        F.when(c("event_type") == "error", "PDF_CORRUPT")
        .when(c("event_type") == "view", "PDF_CHUNK_EMPTY")
        .when((c("event_type") == "signup") & (c("value") < 20), "VECTOR_DIMENSION_MISMATCH")
        .otherwise(c("event_type"))
    )
    stage = F.when(c("value") < 10, "embedding").when(c("value") < 40, "storing").otherwise("finalizing")
    failures = t.events.select("event_id", raw.alias("raw_code"), stage.alias("stage"))
    return validation.classify_failure(failures).select("event_id", "error_code")


@check(
    "is_transient",
    """SELECT event_id, coalesce(event_type = 'error', false) OR (event_type = 'view' AND k < 50) OR (event_type <> 'signup' AND (s = 429 OR s >= 500))
      OR (event_type = 'signup' AND k >= 80) AS transient
    FROM (SELECT *, k * 10 + 1 - CASE WHEN k = 43 THEN 2 ELSE 0 END AS s FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))""",
)
def _(t: Tables) -> DataFrame:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    status = k * 10 + 1 - F.when(k == 43, 2).otherwise(0)
    none = F.lit(None).cast("string")
    error = F.struct(
        F.when(kind == "error", "TimeoutError").otherwise(none).alias("name"),
        F.when((kind == "view") & (k < 50), "ECONNRESET").otherwise(none).alias("code"),
        F.when(kind != "signup", status).alias("status"),
        F.struct(
            none.alias("name"),
            F.when((kind == "signup") & (k >= 80), "EPIPE").otherwise(none).alias("code"),
            F.lit(None).cast("int").alias("status"),
        ).alias("cause"),
    )
    return t.events.select("event_id", validation.is_transient_error(error).alias("transient"))
