"""Registered queries: diagnostics, evaluation and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.checks.registry import Tables, check
from acervo.functions import fields
from acervo.functions.nested import nested_texts
from acervo.functions.text import nfc
from acervo.operators import audit, diagnostics, evaluation

# Diagnostics from events; the instant asked about lies inside the log.
AS_OF = "2024-01-15 00:00:00"
DIAGNOSTICS_SQL = """diagnostics AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'r'||user_id AS request_id, event_type AS question,
  CASE WHEN event_type = 'view' THEN props END AS answer, [CAST(user_id AS VARCHAR), event_type] AS retrieved_chunk_ids,
  date_trunc('millisecond', ts) AS created_at, date_trunc('millisecond', ts) + INTERVAL 24 HOUR AS expires_at FROM events)"""


def entries(t: Tables) -> DataFrame:
    c = F.col
    created = F.date_trunc("millisecond", c("ts").cast("timestamp"))
    return t.events.select(
        F.lpad(c("event_id").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("r"), c("user_id").cast("string")).alias("request_id"),
        c("event_type").alias("question"),
        F.when(c("event_type") == "view", c("props")).alias("answer"),
        F.array(c("user_id").cast("string"), c("event_type")).alias("retrieved_chunk_ids"),
        created.alias("created_at"),
        fields.expires_at(created, diagnostics.TTL_HOURS).alias("expires_at"),
    )


def _micros(name: str):
    return F.unix_micros(name).alias(name)


@check(
    "append_diagnostics",
    """SELECT sha256('r'||conv_id||chr(31)||text||chr(31)||'2024-01-15 00:00:00') AS id, 'r'||conv_id AS request_id, text AS question, role AS answer, '' AS retrieved,
      epoch_us(TIMESTAMP '2024-01-15 00:00:00') AS created_at, epoch_us(TIMESTAMP '2024-01-16 12:00:00') AS expires_at FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    answers = t.conversations.select(
        F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("request_id"),
        F.col("text").alias("question"),
        F.col("role").alias("answer"),
        F.lit(None).cast("array<string>").alias("retrieved"),
    )
    rows = diagnostics.diagnostics_rows(answers, F.lit(AS_OF).cast("timestamp"), ttl_hours=36)
    return rows.select(
        "id", "request_id", "question", "answer", F.array_join("retrieved_chunk_ids", ",").alias("retrieved"),
        _micros("created_at"), _micros("expires_at"),
    )


@check(
    "list_recent",
    f"WITH {DIAGNOSTICS_SQL} SELECT id, request_id, question, answer, epoch_us(created_at) AS created_at FROM diagnostics ORDER BY diagnostics.created_at DESC, id DESC LIMIT 100",
)
def _(t: Tables) -> DataFrame:
    return diagnostics.list_recent(entries(t), 500).select("id", "request_id", "question", "answer", _micros("created_at"))


@check(
    "export_jsonl",
    f"""WITH {DIAGNOSTICS_SQL} SELECT to_json({{'id': id, 'requestId': request_id, 'question': question, 'answer': answer, 'retrievedChunkIds': retrieved_chunk_ids,
      'expiresAt': strftime(expires_at, '%Y-%m-%dT%H:%M:%S.%gZ'), 'createdAt': strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ')}})::VARCHAR AS line
    FROM diagnostics ORDER BY created_at DESC, id DESC LIMIT 20""",
)
def _(t: Tables) -> DataFrame:
    return diagnostics.to_json_lines(entries(t)).select("line")


@check(
    "purge_expired",
    f"WITH {DIAGNOSTICS_SQL} SELECT id, epoch_us(expires_at) AS expires_at FROM diagnostics WHERE NOT expires_at <= TIMESTAMP '{AS_OF}'",
)
def _(t: Tables) -> DataFrame:
    return diagnostics.purge_expired(entries(t), F.lit(AS_OF).cast("timestamp")).select("id", _micros("expires_at"))


@check("count_diagnostics", f"WITH {DIAGNOSTICS_SQL} SELECT count(*) AS count FROM diagnostics")
def _(t: Tables) -> DataFrame:
    return diagnostics.count_diagnostics(entries(t))


@check(
    "parse_iso_instant",
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN NULL ELSE epoch_us(date_trunc('millisecond', ts)) END AS instant FROM events""",
)
def _(t: Tables) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    kind = F.col("event_type")
    text = F.when(kind == "error", F.col("props")).when(kind == "click", F.replace(stamp, F.lit("2024-"), F.lit("2024-13-"))).otherwise(stamp)
    return t.events.select("event_id", F.unix_micros(fields.parse_iso_instant(text)).alias("instant"))


# Answers and expectations from documents and labels.
EVALUATION_SQL = """items AS (
  SELECT d.doc_id AS question_id, CASE lang WHEN 'en' THEN 'found' WHEN 'fr' THEN 'not_found' ELSE 'ambiguous' END AS expected_status,
    CASE WHEN lang = 'en' THEN [source] ELSE [] END AS expected_ids, CASE WHEN lang = 'en' THEN [1, 2] ELSE [] END AS expected_pages,
    CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'ambiguous' WHEN quality = 1 THEN 'found' ELSE 'not_found' END AS status,
    CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN source END AS answer,
    CASE WHEN quality = 1 AND toxic = 0 THEN [CASE WHEN n_chars > 1000 THEN source ELSE 'src0' END, 'x'] ELSE [] END AS cited,
    CASE WHEN quality = 1 AND toxic = 0 THEN [1, CAST(n_chars % 3 AS INT)] ELSE [] END AS pages
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
evaluated AS (
  SELECT question_id, expected_status, status, coalesce(status = expected_status AND CASE expected_status
      WHEN 'found' THEN answer <> '' AND len(cited) >= 1 AND len(list_filter(expected_ids, lambda e: NOT list_contains(cited, e))) = 0
      WHEN 'not_found' THEN answer IS NULL AND len(cited) = 0 ELSE answer IS NULL END, false) AS passed,
    len(list_filter(expected_pages, lambda p: NOT list_contains(pages, p))) = 0 AS pages_covered FROM items)"""


def evaluated(t: Tables) -> DataFrame:
    c = F.col
    lang = c("lang")
    documents = t.documents.select("doc_id", "lang", "source", "n_chars")
    questions = documents.select(
        c("doc_id").alias("question_id"),
        F.when(lang == "en", "found").when(lang == "fr", "not_found").otherwise("ambiguous").alias("expected_status"),
        F.when(lang == "en", F.array("source")).otherwise(F.array().cast("array<string>")).alias("expected_document_ids"),
        F.when(lang == "en", F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")).alias("expected_pages"),
    )
    good = (c("quality") == 1) & (c("toxic") == 0)
    first = F.struct(
        F.when(c("n_chars") > 1000, c("source")).otherwise("src0").alias("document_id"), F.lit(1).alias("page")
    )
    second = F.struct(F.lit("x").alias("document_id"), (c("n_chars") % 3).cast("int").alias("page"))
    answers = documents.join(t.labels, "doc_id").select(
        c("doc_id").alias("question_id"),
        F.when(c("toxic") == 1, "ambiguous").when(c("quality") == 1, "found").otherwise("not_found").alias("status"),
        F.when(good, c("source")).alias("answer"),
        F.when(good, F.array(first, second)).otherwise(F.array().cast("array<struct<document_id:string,page:int>>")).alias("citations"),
    )
    return evaluation.evaluate(answers, questions)


@check("evaluate", f"WITH {EVALUATION_SQL} SELECT * FROM evaluated")
def _(t: Tables) -> DataFrame:
    return evaluated(t).select("question_id", "expected_status", "status", "passed", "pages_covered")


@check(
    "eval_report",
    f"""WITH {EVALUATION_SQL} SELECT expected_status, count(*) AS questions, count(*) FILTER (passed) AS passed, round(avg(passed::INT::DOUBLE), 6) AS pass_rate
    FROM evaluated GROUP BY ROLLUP (expected_status)""",
)
def _(t: Tables) -> DataFrame:
    return evaluation.eval_report(evaluated(t))


# Contacts over texts and web pages; the tables hold phones of another country.
PHONE = r"\+1 \(\d{3}\) \d{3}-\d{4}"
# The patterns, spelt out for the SQL.
_EMAIL_SQL = r"[a-zA-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+"
_URL_SQL = r"https?://[a-zA-Z0-9.-]+(?:\.[a-zA-Z0-9.-]+)+(?:/[a-zA-Z0-9._~:/?#\[\]@!$&''()*+,;=-]*)?"


def contacts_sql(source: str, domain: str, phone: str, allowed_phone: str) -> str:
    strip = r"""regexp_replace(m, '[.,;:!?"'')\]}>]+$', '')"""
    return f"""SELECT 'contact' AS "check", subject, kind||':'||value AS detail FROM (
      SELECT subject, 'email' AS kind, {strip} AS value FROM (SELECT subject, unnest(regexp_extract_all(text, '{_EMAIL_SQL}')) AS m FROM {source})
      UNION ALL SELECT subject, 'phone', {strip} FROM (SELECT subject, unnest(regexp_extract_all(text, '{phone}')) AS m FROM {source})
      UNION ALL SELECT subject, 'url', {strip} FROM (SELECT subject, unnest(regexp_extract_all(text, '{_URL_SQL}')) AS m FROM {source}))
    WHERE NOT CASE kind WHEN 'email' THEN value LIKE '%{domain}' WHEN 'phone' THEN regexp_matches(value, '{allowed_phone}')
      ELSE coalesce(lower(regexp_extract(value, '^https?://([^/:?#]+)', 1)) LIKE '%{domain}', false) END"""


@check("scan_contacts", contacts_sql("(SELECT CAST(doc_id AS VARCHAR) AS subject, text FROM documents)", "@mail5.example.com", PHONE, "^.1 .7.*$"))
def _(t: Tables) -> DataFrame:
    return audit.scan_contacts(
        t.spread("documents"), "doc_id", allow_domains=("@mail5.example.com",), phone_pattern=PHONE, allowed_phone=r"\A.1 .7.*\z"
    )


@check(
    "nested_texts",
    """SELECT CAST(c_nationkey AS VARCHAR) AS nation, 'customers['||(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)||'].name' AS path, c_name AS text FROM customer
    UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'facts.'||k, v FROM (SELECT n_nationkey, unnest(['name', 'comment']) AS k, unnest([n_name, 'r'||n_regionkey]) AS v FROM nation)
      WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    people = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: F.struct(x.c_name.alias("name"), x.c_custkey.alias("key")))
    grouped = t.customer.groupBy("c_nationkey").agg(people.alias("customers")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    facts = F.create_map(F.lit("name"), c("n_name"), F.lit("comment"), F.concat(F.lit("r"), c("n_regionkey").cast("string")))
    return nested_texts(grouped.select(c("c_nationkey").cast("string").alias("nation"), "customers", facts.alias("facts")), "nation")


@check("scan_contacts_web", contacts_sql("(SELECT CAST(page_id AS VARCHAR) AS subject, url||' '||html AS text FROM pages)", ".example.org", PHONE, "^x$"))
def _(t: Tables) -> DataFrame:
    pages = t.spread("pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return audit.scan_contacts(pages, "page_id", allow_domains=(".example.org",), phone_pattern=PHONE, allowed_phone=r"\Ax\z")


@check(
    "find_conflicts",
    """SELECT o_custkey AS subject, count(*) AS claims, min(o_orderpriority) AS first_document, max(o_orderpriority) AS last_document
    FROM orders GROUP BY o_custkey HAVING min(o_orderpriority) <> max(o_orderpriority)""",
)
def _(t: Tables) -> DataFrame:
    return audit.find_conflicts(
        t.orders.select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("document_id"))
    )


# A manifest from parts (versions), suppliers (documents), nations (replacements) and order lines (claims).
MANIFEST_SQL = """documents_m AS (SELECT 's'||s_suppkey AS document_id, CASE WHEN s_nationkey = 3 THEN 'old' ELSE 'corpus/v1' END AS manifest_schema FROM supplier),
versions_m AS (SELECT 's'||(p_size * 2) AS document_id, p_partkey AS position, p_name AS version_id, p_brand||p_type AS source, 'f'||p_retailprice::INT AS file,
  CASE WHEN p_size < 25 THEN p_name ELSE replace(p_name, ' ', '-') END AS idempotency_key FROM part),
replacement_m AS (SELECT 's'||(n_nationkey * 4) AS document_id, a.p_name AS previous_version_id, b.p_name AS current_version_id, n_regionkey <> 2 AS current_activates
  FROM nation JOIN part a ON a.p_partkey = n_nationkey + 1 JOIN part b ON b.p_partkey = CASE WHEN n_regionkey = 1 THEN n_nationkey + 1 ELSE 3 END),
conflicts_m AS (SELECT 'o'||l_orderkey AS conflict_id, 's'||(l_suppkey + CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END) AS document_id FROM lineitem)"""
_V = 'CAST({} AS VARCHAR)'


def _part(check_name: str, subject: str, detail: str, rest: str) -> str:
    return f"""SELECT '{check_name}' AS "check", CAST({subject} AS VARCHAR) AS subject, CAST({detail} AS VARCHAR) AS detail {rest}"""


MANIFEST_AUDIT_SQL = " UNION ALL ".join(
    [
        _part("schema", "manifest_schema", "NULL", "FROM (SELECT DISTINCT manifest_schema FROM documents_m WHERE manifest_schema <> 'corpus/v1')"),
        _part("document_count", "count(*)", "NULL", "FROM documents_m HAVING count(*) <> 10"),
        _part("multi_version_documents", "count(*)", "NULL", "FROM (SELECT document_id FROM versions_m GROUP BY document_id HAVING count(*) > 1) HAVING count(*) <> 1"),
        *[
            _part(f"duplicate_{name}", name, "count(*)", f"FROM versions_m GROUP BY {name} HAVING count(*) > 1")
            for name in ("version_id", "file", "idempotency_key")
        ],
        _part(
            "duplicate_source", "source", "version_id",
            """FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY document_id, position) AS nth,
                 first_value(source) OVER (PARTITION BY document_id ORDER BY position) AS first_source FROM versions_m)
               WHERE nth > 1 AND source <> first_source""",
        ),
        _part("invalid_idempotency_key", "version_id", "idempotency_key", "FROM versions_m WHERE NOT regexp_matches(idempotency_key, '^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$')"),
        _part("replacement_document", "document_id", "NULL", "FROM replacement_m WHERE document_id NOT IN (SELECT document_id FROM documents_m)"),
        *[
            _part(
                f"replacement_{side}", f"r.{side}_version_id", "NULL",
                f"FROM replacement_m r WHERE NOT EXISTS (SELECT 1 FROM versions_m v WHERE v.document_id = r.document_id AND v.version_id = r.{side}_version_id)",
            )
            for side in ("previous", "current")
        ],
        _part("replacement_same_version", "current_version_id", "NULL", "FROM replacement_m WHERE previous_version_id = current_version_id"),
        _part("replacement_not_active", "current_version_id", "NULL", "FROM replacement_m WHERE NOT current_activates"),
        _part("conflict_claims", "conflict_id", "count(*)", "FROM conflicts_m GROUP BY conflict_id HAVING count(*) <> 2"),
        _part("conflict_same_document", "conflict_id", "NULL", "FROM conflicts_m GROUP BY conflict_id HAVING count(*) = 2 AND min(document_id) = max(document_id)"),
        _part("conflict_unknown_document", "conflict_id", "document_id", "FROM conflicts_m WHERE document_id NOT IN (SELECT document_id FROM documents_m)"),
    ]
)


def manifest_tables(t: Tables) -> dict[str, DataFrame]:
    c = F.col

    def s(col):
        return F.concat(F.lit("s"), col.cast("string"))

    documents = t.supplier.select(
        s(c("s_suppkey")).alias("document_id"), F.when(c("s_nationkey") == 3, "old").otherwise("corpus/v1").alias("manifest_schema")
    )
    versions = t.part.select(
        s(c("p_size") * 2).alias("document_id"),
        c("p_partkey").alias("position"),
        c("p_name").alias("version_id"),
        F.concat("p_brand", "p_type").alias("source"),
        F.concat(F.lit("f"), F.rint("p_retailprice").cast("int").cast("string")).alias("file"),
        F.when(c("p_size") < 25, c("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("idempotency_key"),
    )
    names = t.part.select("p_partkey", "p_name")
    replacement = (
        t.nation.withColumn("a", (c("n_nationkey") + 1).cast("bigint"))
        .withColumn("b", F.when(c("n_regionkey") == 1, c("a")).otherwise(3))
        .join(names.select(c("p_partkey").alias("a"), c("p_name").alias("previous_version_id")), "a")
        .join(names.select(c("p_partkey").alias("b"), c("p_name").alias("current_version_id")), "b")
        .select(
            s(c("n_nationkey") * 4).alias("document_id"), "previous_version_id", "current_version_id",
            (c("n_regionkey") != 2).alias("current_activates"),
        )
    )
    shift = F.when(c("l_returnflag") == "R", 3).otherwise(0)
    conflicts = t.lineitem.select(
        F.concat(F.lit("o"), c("l_orderkey").cast("string")).alias("conflict_id"), s(c("l_suppkey") + shift).alias("document_id")
    )
    return {"documents": documents, "versions": versions, "replacement": replacement, "conflicts": conflicts}


@check("validate_manifest", f"WITH {MANIFEST_SQL} {MANIFEST_AUDIT_SQL}")
def _(t: Tables) -> DataFrame:
    return audit.validate_manifest(**manifest_tables(t), schema_tag="corpus/v1")


# Sources are customers; the manifest's entries are orders, of which those whose key is no customer's name a missing source.
INSTITUTIONS_SQL = """institutions AS (SELECT o_orderkey AS source, c_custkey IS NOT NULL AS given, c_name AS name, c_mktsegment AS email, CAST(c_nationkey AS VARCHAR) AS phone,
  CASE WHEN o_orderstatus = 'P' THEN 'other' ELSE c_name END AS ename, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE c_mktsegment END AS eemail,
  CAST(c_nationkey + CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS VARCHAR) AS ephone
  FROM orders LEFT JOIN customer ON o_orderkey = c_custkey)"""
# Every fifth institution has an e-mail address in its postal address.
ADDRESSES_SQL = "(SELECT CAST(c_custkey AS VARCHAR) AS subject, 'Write to '||lower(c_mktsegment)||c_custkey||'@corp.example.com' AS text FROM customer WHERE c_custkey % 5 = 0)"
INSTITUTIONS_AUDIT_SQL = " UNION ALL ".join(
    [_part("source_missing", "source", "NULL", "FROM institutions WHERE NOT given")]
    + [_part(f"institution_{n}", "source", n, f"FROM institutions WHERE given AND {n} IS DISTINCT FROM e{n}") for n in ("name", "email", "phone")]
)


def institutions(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = F.col
    address = F.when(c("c_custkey") % 5 == 0, F.concat(F.lit("Write to "), F.lower("c_mktsegment"), c("c_custkey").cast("string"), F.lit("@corp.example.com")))
    own = F.struct(
        c("c_name").alias("name"), c("c_mktsegment").alias("email"), c("c_nationkey").cast("string").alias("phone"), address.alias("address")
    )
    sources = t.customer.select(c("c_custkey").cast("string").alias("source"), own.alias("institution"))
    expected = t.orders.join(t.customer, c("o_orderkey") == c("c_custkey"), "left").select(
        c("o_orderkey").cast("string").alias("source"),
        F.when(c("o_orderstatus") == "P", "other").otherwise(c("c_name")).alias("expected_name"),
        F.when(c("o_orderpriority") != "1-URGENT", c("c_mktsegment")).alias("expected_email"),
        (c("c_nationkey") + F.when(c("o_totalprice") > 400000, 1).otherwise(0)).cast("string").alias("expected_phone"),
    )
    return sources, expected


@check("validate_source_consistency", f"WITH {INSTITUTIONS_SQL} {INSTITUTIONS_AUDIT_SQL}")
def _(t: Tables) -> DataFrame:
    return audit.validate_source_consistency(*institutions(t))


EVAL_SET_SQL = """q AS (SELECT conv_id||'-'||turn AS question_id, text AS question, CASE role WHEN 'user' THEN 'found' WHEN 'assistant' THEN 'not_found' ELSE 'other' END AS expected_status,
      CASE WHEN turn < 2 THEN [conv_id * 3] ELSE [] END AS ids, CASE WHEN turn < 2 THEN [turn] ELSE [] END AS pages FROM conversations)"""
EVAL_SET_AUDIT_SQL = f"""{_part("status", "question_id", "expected_status", "FROM q WHERE expected_status = 'other'")} UNION ALL
    {_part("too_few_questions", "'ambiguous'", "0", "")} UNION ALL
    {_part("unknown_document", "question_id", "id", "FROM (SELECT question_id, unnest(ids) AS id FROM q WHERE expected_status = 'found') WHERE id NOT IN (SELECT doc_id FROM documents)")} UNION ALL
    {_part("page_number", "question_id", "NULL", "FROM q WHERE expected_status = 'found' AND len(list_filter(pages, lambda p: p < 1)) > 0")} UNION ALL
    {_part("not_found_with_documents", "question_id", "NULL", "FROM q WHERE expected_status = 'not_found' AND len(ids) + len(pages) > 0")} UNION ALL
    {_part("question_text", "question_id", "NULL", "FROM q WHERE nfc_normalize(question) <> question OR regexp_matches(question, '[\\p{Cc}\\p{Cf}]')")}"""


def eval_set(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = F.col
    role = c("role")
    early = c("turn") < 2
    questions = t.conversations.select(
        F.concat_ws("-", c("conv_id").cast("string"), c("turn").cast("string")).alias("question_id"),
        c("text").alias("question"),
        F.when(role == "user", "found").when(role == "assistant", "not_found").otherwise("other").alias("expected_status"),
        F.when(early, F.array((c("conv_id") * 3).cast("string"))).otherwise(F.array().cast("array<string>")).alias("expected_document_ids"),
        F.when(early, F.array(c("turn"))).otherwise(F.array().cast("array<bigint>")).alias("expected_pages"),
    )
    documents = t.documents.select(c("doc_id").cast("string").alias("document_id"))
    return questions, documents


@check("validate_eval_set", f"WITH {EVAL_SET_SQL} {EVAL_SET_AUDIT_SQL}")
def _(t: Tables) -> DataFrame:
    return audit.validate_eval_set(*eval_set(t))


@check("nfc", "SELECT conv_id, turn, nfc_normalize(replace(text, 'é', 'e'||chr(769))) AS text FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", nfc(F.replace("text", F.lit("é"), F.lit("e" + chr(769)))).alias("text"))
