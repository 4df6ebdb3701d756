"""Registered queries: whole pipelines over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.checks import fragments as fr
from acervo.checks.registry import Tables, check
from acervo.checks.reports import (
    ADDRESSES_SQL, EVAL_SET_AUDIT_SQL, EVAL_SET_SQL, INSTITUTIONS_AUDIT_SQL, INSTITUTIONS_SQL, MANIFEST_AUDIT_SQL, MANIFEST_SQL, PHONE,
    contacts_sql, eval_set, institutions, manifest_tables,
)
from acervo.checks.requests import QUESTIONS_SQL, questions
from acervo.checks.retrievals import DECIDE_SQL, DIMS, hash_vector_sql, unit_sql
from acervo.checks.texts import CHUNKS_SQL, FILES_SQL, files, files_of
from acervo.functions.vectors import hash_embedder
from acervo.operators import chunking, evaluation, models
from acervo.plans import ask as asking
from acervo.plans import corpus as corpora
from acervo.plans.ingest import Ingested, ingest
from acervo.session import cut_lineage


def corpus_points(t: Tables) -> DataFrame:
    """Points of the given documents, written once since searching reads them twice."""
    chunks = chunking.chunk_versions(fr.corpus(t)).where(F.col("error_code").isNull()).drop("error_code")
    return cut_lineage(models.embed_documents(chunks, hash_embedder(DIMS), dims=DIMS).drop("embed_error"))


POINTS_SQL = f"""points AS (
  SELECT {fr.uuid5("'v'||doc_id||':'||chunk_index")} AS point_id, doc_id, CAST(page AS INT) AS page, text, {unit_sql(hash_vector_sql('text'))} AS u FROM chunks)"""
QUESTION_VECTORS_SQL = f"""vectors AS (SELECT *, {unit_sql(hash_vector_sql('question'))} AS u FROM {{}} WHERE question IS NOT NULL)"""


def answers_sql(visible: str, asked: str) -> str:
    """SQL of answers for ``asked`` (question_id, question, ...) over points that are ``visible``."""
    return f"""{POINTS_SQL}, {QUESTION_VECTORS_SQL.format(asked)},
    hits AS (SELECT question_id, question, point_id, p.doc_id, page, text, round(list_dot_product(q.u, p.u), 6) AS score
      FROM vectors q JOIN (SELECT p.*, v.state, v.document_id FROM points p JOIN versions v ON v.version_id = 'v'||p.doc_id) p ON {visible}),
    top AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, point_id) AS rank FROM hits WHERE score >= 0.35 QUALIFY rank <= 6),
    asked AS (SELECT question_id, question, list({{'id': point_id, 'text': text, 'doc_id': doc_id, 'page': page}} ORDER BY rank) AS ctx FROM top GROUP BY ALL),
    {DECIDE_SQL},
    answers AS (
      SELECT q.question_id, q.question, d.ctx, coalesce(d.status, 'not_found') AS status, d.status = 'found' AS hit, d.top AS best
      FROM {asked} q LEFT JOIN decided d ON q.question_id = d.question_id)"""


ANSWER_OUT_SQL = """SELECT question_id, question, CASE WHEN question IS NULL THEN 'error' ELSE status END AS status,
  CASE WHEN hit THEN CASE WHEN length(best.text) > 200 THEN substr(best.text, 1, 200)||'...' ELSE best.text END END AS answer,
  CASE WHEN hit THEN 'v'||best.doc_id||'/'||best.page||'/'||substr(best.text, 1, 300) ELSE '' END AS cited,
  coalesce(array_to_string(list_transform(ctx, lambda c: c.id), ','), '') AS retrieved,
  CASE WHEN question IS NULL THEN 'QUESTION_INVALID' END AS error_code FROM answers"""


def shown(answers: DataFrame) -> DataFrame:
    cited = F.transform("citations", lambda c: F.concat_ws("/", c.version_id, c.page.cast("string"), c.excerpt))
    return answers.select(
        "question_id", "question", "status", "answer", F.array_join(cited, "|").alias("cited"),
        F.array_join("retrieved", ",").alias("retrieved"), "error_code",
    )


@check(
    "ask",
    f"""WITH RECURSIVE {CHUNKS_SQL}, {fr.VERSIONS_SQL}, {QUESTIONS_SQL.replace('asked AS', 'given AS')},
    {answers_sql("p.state = 'ACTIVE'", "given")} {ANSWER_OUT_SQL}""",
)
def _(t: Tables) -> DataFrame:
    answers = asking.ask(questions(t), corpus_points(t), fr.labelled_versions(t), hash_embedder(DIMS), dims=DIMS)
    return shown(answers)


@check(
    "ask_diagnostics",
    f"""WITH RECURSIVE {CHUNKS_SQL}, {fr.VERSIONS_SQL}, {QUESTIONS_SQL.replace('asked AS', 'given AS')},
    {answers_sql("p.state = 'ACTIVE'", "given")}, said AS ({ANSWER_OUT_SQL})
    SELECT sha256(question_id||chr(31)||question||chr(31)||'2024-01-15 00:00:00') AS id, question_id AS request_id, question, answer, retrieved,
      epoch_us(TIMESTAMP '2024-01-16 00:00:00') AS expires_at FROM said WHERE error_code IS NULL""",
)
def _(t: Tables) -> DataFrame:
    # Every point is there twice; a repeated id must not repeat in a context.
    points = corpus_points(t)
    answers = asking.ask(questions(t), points.unionByName(points), fr.labelled_versions(t), hash_embedder(DIMS), dims=DIMS, k=12)
    kept = answers.withColumn("retrieved", F.slice("retrieved", 1, 6))
    rows = asking.ask_diagnostics(kept, F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return rows.select("id", "request_id", "question", "answer", F.array_join("retrieved_chunk_ids", ",").alias("retrieved"), F.unix_micros("expires_at").alias("expires_at"))


# Two neighbouring documents are two versions of one; the even one may be live.
PAIRED_SQL = """versions AS (SELECT 'v'||d.doc_id AS version_id, 'p'||(d.doc_id // 2) AS document_id,
  CASE WHEN toxic = 1 THEN 'ARCHIVED' WHEN d.doc_id % 2 = 0 THEN 'ACTIVE' WHEN quality = 0 THEN 'FAILED' ELSE 'READY' END AS state
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def paired_versions(t: Tables) -> DataFrame:
    state = (
        F.when(F.col("toxic") == 1, "ARCHIVED")
        .when(F.col("doc_id") % 2 == 0, "ACTIVE")
        .when(F.col("quality") == 0, "FAILED")
        .otherwise("READY")
    )
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select(
        fr.version_id(F.col("doc_id")).alias("version_id"),
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / 2).cast("string")).alias("document_id"),
        state.alias("state"),
    )


@check(
    "preview",
    f"""WITH RECURSIVE {CHUNKS_SQL}, {PAIRED_SQL}, {QUESTIONS_SQL.replace('asked AS', 'texts AS')},
    scoped AS (
      SELECT t.question_id, t.question AS qtext, v.version_id, v.document_id,
        CASE WHEN v.version_id IS NULL THEN 'VERSION_NOT_FOUND' WHEN v.state NOT IN ('READY', 'ACTIVE') THEN 'VERSION_NOT_PREVIEWABLE'
          END AS scope_error
      FROM texts t LEFT JOIN versions v ON v.version_id = 'v'||split_part(t.question_id, '-', 1)),
    given AS (SELECT *, CASE WHEN scope_error IS NULL THEN qtext END AS question FROM scoped),
    {answers_sql("(p.state = 'ACTIVE' AND p.document_id <> q.document_id) OR 'v'||p.doc_id = q.version_id", "given")}
    SELECT o.* REPLACE (CASE WHEN g.qtext IS NULL THEN 'QUESTION_INVALID' ELSE g.scope_error END AS error_code, g.qtext AS question)
    FROM ({ANSWER_OUT_SQL}) o JOIN given g ON o.question_id = g.question_id""",
)
def _(t: Tables) -> DataFrame:
    conv = F.split("question_id", "-")[0].cast("bigint")
    asked = questions(t).select(
        "question_id",
        "question",
        F.concat(F.lit("p"), F.floor(conv / 2).cast("string")).alias("document_id"),
        fr.version_id(conv).alias("version_id"),
    )
    candidates = asked.select("document_id", "version_id").distinct()
    points = corpus_points(t)
    return shown(asking.preview(asked, candidates, points, paired_versions(t), hash_embedder(DIMS), dims=DIMS))


@check(
    "run_evaluation",
    f"""WITH RECURSIVE {CHUNKS_SQL}, {fr.VERSIONS_SQL}, {QUESTIONS_SQL.replace('asked AS', 'given AS')},
    {answers_sql("p.state = 'ACTIVE'", "given")},
    judged AS (
      SELECT q.question_id, CASE role WHEN 'user' THEN 'found' WHEN 'assistant' THEN 'not_found' ELSE 'ambiguous' END AS expected_status,
        CASE WHEN a.question IS NULL THEN 'error' ELSE a.status END AS status, hit, best.doc_id AS doc, conv_id
      FROM (SELECT *, conv_id||'-'||turn AS question_id FROM conversations) q JOIN answers a ON a.question_id = q.question_id),
    passed AS (SELECT *, coalesce(status = expected_status AND CASE WHEN expected_status = 'found' THEN doc = conv_id ELSE NOT hit END, status = expected_status AND expected_status <> 'found', false) AS passed FROM judged)
    SELECT expected_status, count(*) AS questions, count(*) FILTER (passed) AS passed, round(avg(passed::INT::DOUBLE), 6) AS pass_rate
    FROM passed GROUP BY ROLLUP (expected_status)""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    expected = F.when(c("role") == "user", "found").when(c("role") == "assistant", "not_found").otherwise("ambiguous")
    labels = t.conversations.select(
        F.concat_ws("-", c("conv_id").cast("string"), c("turn").cast("string")).alias("question_id"),
        expected.alias("expected_status"),
        F.when(c("role") == "user", F.array(F.concat(F.lit("d"), c("conv_id").cast("string"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("expected_document_ids"),
        F.array().cast("array<int>").alias("expected_pages"),
    )
    asked = questions(t).join(labels, "question_id")
    evaluated = corpora.run_evaluation(
        asked, corpus_points(t), fr.labelled_versions(t), hash_embedder(DIMS), dims=DIMS
    )
    return evaluation.eval_report(evaluated)


# Index requests for the files made from documents; labels tell which versions exist already.
_ID = "'00000000-0000-4000-8000-'||lpad(CAST({} AS VARCHAR), 12, '0')"
INGEST_SQL = f"""{FILES_SQL.replace('text, source, lang FROM', 'text, source, lang, doc_id FROM')},
requests AS (
  SELECT f.doc_id, CASE WHEN source = 'src3' THEN 'PDF_EXTENSION_INVALID' WHEN lang = 'de' THEN 'PDF_SIGNATURE_INVALID' END AS file_error,
    quality, toxic, text FROM files f LEFT JOIN labels l ON f.doc_id = l.doc_id),
admitted AS (
  SELECT *, CASE WHEN file_error IS NOT NULL THEN 'rejected' WHEN toxic = 1 THEN 'conflict' ELSE 'new' END AS outcome,
    CASE WHEN file_error IS NOT NULL THEN NULL WHEN toxic = 1 THEN 'closed_version' WHEN quality = 1 THEN 'already_indexed' ELSE 'index' END AS ownership FROM requests),
numbered AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM admitted WHERE ownership = 'index'),
pages_of AS (SELECT doc_id, page, {fr.normal('line')} AS text FROM numbered),
worked AS (
  SELECT a.*, CASE WHEN ownership = 'index' AND (SELECT coalesce(sum(length({fr.bare('p.text')})), 0) FROM pages_of p WHERE p.doc_id = a.doc_id) < 20
    THEN 'PDF_TEXT_NOT_FOUND' END AS work_error FROM admitted a)"""
_FORM_FEED_CHUNKS = CHUNKS_SQL.replace(fr.PAGES_SQL + ",\n", "").replace(
    "FROM pages_of)", "FROM pages_of WHERE doc_id IN (SELECT doc_id FROM worked WHERE work_error IS NULL))", 1
)


def ingest_requests(t: Tables) -> DataFrame:
    c = F.col
    ext = F.when(c("source") == "src3", ".txt").when(c("source") == "src4", ".PDF").otherwise(".pdf")
    name = F.concat("source", F.lit("/"), c("doc_id").cast("string"), ext)
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(c("doc_id").cast("string"), 12, "0"))
    return t.documents.select(
        c("doc_id").alias("seq"),
        F.concat(F.lit("job-"), c("doc_id").cast("string")).alias("job_id"),
        F.concat(F.lit("seed-"), c("doc_id").cast("string")).alias("idempotency_key"),
        uuid.alias("document_id"),
        uuid.alias("version_id"),
        F.concat_ws(" ", "source", "lang").alias("title"),
        F.lit(fr.YEAR).alias("academic_year"),
        F.lit(None).cast("string").alias("description"),
        name.alias("file_name"),
        F.lit("application/pdf").alias("mime_type"),
        F.concat(F.lit("/corpus/"), name).alias("path"),
    )


def repeated_requests(t: Tables) -> DataFrame:
    """The same requests, and for every fourth document another one with a key of its own for the same version."""
    c = F.col
    once = ingest_requests(t)
    again = once.where(c("seq") % 4 == 0).select(
        *[
            {
                "seq": (c("seq") + 1_000_000_000).alias("seq"),
                "job_id": F.concat("job_id", F.lit("-again")).alias("job_id"),
                "idempotency_key": F.concat("idempotency_key", F.lit("-again")).alias("idempotency_key"),
            }.get(name, c(name))
            for name in once.columns
        ]
    )
    return once.unionByName(again)


def existing_versions(t: Tables) -> DataFrame:
    """Versions of labelled documents: toxic ones archived, good ones ready."""
    hashed = files_of(t.documents).select("path", F.sha2("content", 256).alias("content_hash"))
    known = ingest_requests(t).join(t.labels, F.col("seq") == F.col("doc_id")).where((F.col("toxic") == 1) | (F.col("quality") == 1))
    return known.join(hashed, "path").select(
        "version_id", "document_id", "academic_year", "content_hash",
        F.when(F.col("toxic") == 1, "ARCHIVED").otherwise("READY").alias("state"),
    )


def empty_ledger(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([], "idempotency_key string, request_hash string, job_id string")


def ingested(t: Tables) -> Ingested:
    return ingest(
        repeated_requests(t), files(t), empty_ledger(t), existing_versions(t), hash_embedder(DIMS), dims=DIMS,
        as_of=F.lit("2026-01-01").cast("timestamp"),
    )


@check(
    "ingest_ledger",
    f"""WITH {INGEST_SQL} SELECT {_ID.format('doc_id')} AS version_id, outcome, ownership,
      CASE WHEN coalesce(file_error, work_error) IS NOT NULL OR outcome = 'conflict' THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN outcome <> 'new' THEN 'queued' WHEN work_error IS NOT NULL THEN 'extracting' ELSE 'completed' END AS stage,
      coalesce(file_error, CASE WHEN outcome = 'conflict' THEN 'VERSION_CONFLICT' END, work_error) AS error_code
    FROM (SELECT * FROM worked UNION ALL SELECT * REPLACE (CASE ownership WHEN 'index' THEN 'already_indexed' ELSE ownership END AS ownership) FROM worked WHERE doc_id % 4 = 0)""",
)
def _(t: Tables) -> DataFrame:
    return ingested(t).ledger.select("version_id", "outcome", "ownership", "status", "stage", "error_code")


@check(
    "ingest_documents",
    f"""WITH {INGEST_SQL} SELECT {_ID.format('w.doc_id')} AS document_id, d.source||' '||d.lang AS title, CAST(NULL AS VARCHAR) AS description,
      epoch_us(TIMESTAMP '2026-01-01') AS created_at, epoch_us(TIMESTAMP '2026-01-01') AS updated_at
    FROM worked w JOIN documents d ON d.doc_id = w.doc_id WHERE outcome = 'new'""",
)
def _(t: Tables) -> DataFrame:
    at = [F.unix_micros(name).alias(name) for name in ("created_at", "updated_at")]
    return ingested(t).documents.select("document_id", "title", "description", *at)


@check(
    "ingest_points",
    f"""WITH RECURSIVE {INGEST_SQL}, {_FORM_FEED_CHUNKS}
    SELECT {fr.uuid5(_ID.format('c.doc_id') + "||':'||chunk_index")} AS point_id, {_ID.format('c.doc_id')} AS version_id, CAST(page AS INT) AS page, section, chunk_index, text FROM chunks c""",
)
def _(t: Tables) -> DataFrame:
    return ingested(t).points.select("point_id", "version_id", "page", "section", "chunk_index", "text")


# A manifest of the same files over a live corpus: two neighbouring documents are two versions of one, of which the even one may be
# live and the odd one ready; the manifest activates all it can, so the odd one replaces the even one.
_OLD = "CASE WHEN toxic = 1 THEN 'ARCHIVED' WHEN quality = 1 AND doc_id % 2 = 0 THEN 'ACTIVE' WHEN quality = 1 THEN 'READY' END"
_FRESH = f"file_error IS NULL AND ({_OLD}) IS NULL"


@check(
    "replace_annual",
    f"""WITH RECURSIVE {INGEST_SQL.replace("WHERE ownership = 'index'", f"WHERE {_FRESH}").replace("ownership = 'index' AND", f"{_FRESH} AND")},
    known AS (SELECT doc_id, doc_id // 2 AS pair, {_OLD} AS old, file_error, work_error FROM worked),
    lives AS (SELECT *, coalesce(old <> 'ARCHIVED', true) AND (coalesce(old = 'ACTIVE', false) OR (file_error IS NULL AND work_error IS NULL)) AS live FROM known),
    states AS (SELECT *, CASE WHEN old = 'ARCHIVED' THEN 'ARCHIVED'
      WHEN live THEN CASE WHEN doc_id % 2 = 0 AND bool_or(live AND doc_id % 2 = 1) OVER (PARTITION BY pair) THEN 'ARCHIVED' ELSE 'ACTIVE' END
      WHEN old IS NOT NULL THEN old WHEN file_error IS NULL THEN 'FAILED' END AS state FROM lives),
    {CHUNKS_SQL.replace(fr.PAGES_SQL + ",", "").replace("FROM pages_of)", "FROM pages_of WHERE doc_id IN (SELECT doc_id FROM states WHERE state = 'ACTIVE' AND old IS NULL))", 1)}
    SELECT {_ID.format('s.pair')} AS document_id, {_ID.format('s.doc_id')} AS version_id, state,
      CASE WHEN old IS NULL THEN (SELECT count(*) FROM chunks c WHERE c.doc_id = s.doc_id) WHEN state IN ('ACTIVE', 'READY') THEN 1 ELSE 0 END AS points
    FROM states s WHERE state IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    requests = ingest_requests(t)
    pair = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.floor(c("seq") / 2).cast("string"), 12, "0"))
    tables = {
        "documents": requests.select(pair.alias("document_id"), F.lit(None).cast("string").alias("description")).distinct(),
        "versions": requests.select(
            pair.alias("document_id"), c("seq").alias("position"), "version_id", "title", "academic_year",
            c("file_name").alias("file"), "idempotency_key", F.lit(True).alias("activate"),
        ),
    }
    hashed = files_of(t.documents).select("path", F.sha2("content", 256).alias("content_hash"))
    state = F.when(c("toxic") == 1, "ARCHIVED").when(c("quality") == 1, F.when(c("seq") % 2 == 0, "ACTIVE").otherwise("READY"))
    old = cut_lineage(
        requests.join(t.labels, c("seq") == c("doc_id")).join(hashed, "path").where(state.isNotNull())
        .select("version_id", pair.alias("document_id"), "academic_year", "content_hash", state.alias("state"))
    )
    old_points = old.select(
        F.concat(F.lit("old-"), "version_id").alias("point_id"), "version_id", "document_id",
        F.lit(None).cast("string").alias("document_title"), "academic_year", F.lit(None).cast("string").alias("file_hash"),
        F.lit(1).alias("page"), F.lit(None).cast("string").alias("section"), F.lit(0).cast("bigint").alias("chunk_index"),
        F.lit("old").alias("text"), "content_hash", F.lit(None).cast("array<float>").alias("vector"),
    )
    _done, histories, points = corpora.replace_annual(
        tables, files(t), "/corpus", empty_ledger(t), old, hash_embedder(DIMS), dims=DIMS, points=old_points
    )
    counts = points.groupBy("version_id").agg(F.count("*").alias("n"))
    return histories.join(counts, "version_id", "left").select(
        "document_id", "version_id", "state", F.coalesce("n", F.lit(0)).alias("points")
    )


@check(
    "audit_corpus",
    f"""WITH {MANIFEST_SQL}, {INSTITUTIONS_SQL}, {EVAL_SET_SQL}, {fr.VERSIONS_SQL}
    {contacts_sql("(SELECT CAST(doc_id AS VARCHAR) AS subject, text FROM documents)", ".example.invalid", PHONE, "^x$")}
    UNION ALL {contacts_sql(ADDRESSES_SQL, ".example.invalid", PHONE, "^x$")}
    UNION ALL {MANIFEST_AUDIT_SQL} UNION ALL {INSTITUTIONS_AUDIT_SQL}
    UNION ALL {EVAL_SET_AUDIT_SQL.replace("(SELECT doc_id FROM documents)", "(SELECT s_suppkey FROM supplier)")}
    UNION ALL SELECT 'active_versions', document_id, CAST(count(*) AS VARCHAR) FROM versions WHERE state = 'ACTIVE' GROUP BY document_id HAVING count(*) > 1""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    sources, expected = institutions(t)
    asked, _documents = eval_set(t)
    asked = asked.withColumn("expected_document_ids", F.transform("expected_document_ids", lambda i: F.concat(F.lit("s"), i)))
    audited = corpora.audit_corpus(
        t.spread("documents").select("doc_id", "text"),
        {**manifest_tables(t), "institutions": expected},
        sources,
        fr.labelled_versions(t),
        asked,
        page_subject="doc_id",
        contact_rules={"phone_pattern": PHONE, "allowed_phone": r"\Ax\z"},
        schema_tag="corpus/v1",
    )
    # The SQL names unknown documents by their bare number.
    unknown = c("check") == "unknown_document"
    return audited.withColumn("detail", F.when(unknown, F.substring("detail", 2, 40)).otherwise(c("detail")))
