"""Registered queries: vectors, search, contexts, decisions and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.checks import fragments as fr
from acervo.checks.registry import Tables, check
from acervo.functions import fields, vectors
from acervo.operators import answering, models, retrieval, validation
from acervo.sources import snapshots as sn

DIMS = 64


def hash_vector_sql(expr: str, dims: int = DIMS) -> str:
    """SQL of the hash embedding of a text, in single precision."""
    raw = f"list_transform(range(0, {dims}), lambda i: CAST('0x'||substr(sha256({expr}), CAST((i % 32) * 2 + 1 AS INT), 2) AS INT) / 255.0::DOUBLE)"
    return f"(SELECT list_transform(v, lambda x: CAST(x / sqrt(list_dot_product(v, v)) AS FLOAT)) FROM (SELECT {raw} AS v))"


def unit_sql(expr: str) -> str:
    d = f"list_transform({expr}, lambda x: CAST(x AS DOUBLE))"
    return f"(SELECT list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) FROM (SELECT {d} AS d))"


@check(
    "hash_embedding",
    f"""WITH e AS (SELECT doc_id, {hash_vector_sql('text')} AS v FROM documents)
    SELECT doc_id, CAST(len(v) AS INT) AS dims, array_to_string(list_transform(v, lambda x: CAST(round(x::DOUBLE * 1e6) AS BIGINT)), ',') AS vector,
      CAST(NULL AS VARCHAR) AS embed_error FROM e""",
)
def _(t: Tables) -> DataFrame:
    texts = t.spread("documents").select("doc_id", "text")
    out = models.embed_documents(texts, vectors.hash_embedder(DIMS), dims=DIMS)
    micro = F.transform("vector", lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string"))
    return out.select("doc_id", F.size("vector").alias("dims"), F.array_join(micro, ",").alias("vector"), "embed_error")


@check(
    "l2_normalize",
    f"""SELECT vec_id, array_to_string(list_transform({unit_sql('embedding')}, lambda x: CAST(round(x * 1e6) AS BIGINT)), ',') AS vector FROM embeddings""",
)
def _(t: Tables) -> DataFrame:
    unit = vectors.l2_normalize(F.col("embedding"))
    micro = F.transform(unit, lambda x: F.round(x * 1e6).cast("bigint").cast("string"))
    return t.embeddings.select("vec_id", F.array_join(micro, ",").alias("vector"))


@check(
    "cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(t: Tables) -> DataFrame:
    following = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    pairs = t.embeddings.join(following, "vec_id")
    return pairs.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


# Every vector asks for its nearest among the vectors of all labels but 3 and 7.
TOPK_SQL = f"""WITH u AS (SELECT vec_id, label, {unit_sql('embedding')} AS v FROM embeddings),
  hits AS (SELECT q.vec_id AS question_id, p.vec_id AS point_id, round(list_dot_product(q.v, p.v), 6) AS score
           FROM u q JOIN u p ON p.label NOT IN (3, 7))
  SELECT question_id, point_id, score, CAST(row_number() OVER w AS INT) AS rank FROM hits WHERE score >= 0.35
  WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, point_id) QUALIFY rank <= 6"""


def _vector_search(t: Tables, **options) -> DataFrame:
    points = t.embeddings.select(
        F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("version_id")
    )
    active = t.embeddings.where(~F.col("label").isin(3, 7)).select(F.col("label").cast("string").alias("version_id")).distinct()
    questions = t.embeddings.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_topk(questions, retrieval.search_scope(points, active), **options)


@check("vector_topk", TOPK_SQL)
def _(t: Tables) -> DataFrame:
    return _vector_search(t)


@check("vector_topk_blocks", TOPK_SQL)
def _(t: Tables) -> DataFrame:
    return _vector_search(t, question_block=128)


@check(
    "search_scope",
    f"""WITH {fr.VERSIONS_SQL} SELECT page AS point_id, version_id FROM (SELECT doc_id * 100000 + page AS page, 'v'||doc_id AS version_id
      FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents))
    WHERE version_id IN (SELECT version_id FROM versions WHERE state = 'ACTIVE')""",
)
def _(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("at", "line"))
    points = lines.select(
        (F.col("doc_id") * 100000 + F.col("at") + 1).alias("point_id"), fr.version_id(F.col("doc_id")).alias("version_id")
    )
    active = validation.version_scope(fr.labelled_versions(t), "searchable")
    return retrieval.search_scope(points, active).select("point_id", "version_id")


@check(
    "ensure_vector_schema",
    """SELECT vec_id AS point_id, CAST(coalesce(len(v), 0) AS INT) AS size, 'VECTOR_DIMENSION_MISMATCH' AS error_code
    FROM (SELECT vec_id, CASE label WHEN 1 THEN NULL WHEN 2 THEN embedding[1:10] ELSE embedding END AS v FROM embeddings)
    WHERE len(v) IS DISTINCT FROM 64""",
)
def _(t: Tables) -> DataFrame:
    vector = F.when(F.col("label") == 2, F.slice("embedding", 1, 10)).when(F.col("label") != 1, F.col("embedding"))
    points = t.embeddings.select(F.col("vec_id").alias("point_id"), vector.alias("vector"))
    return sn.vector_schema_violations(points, 64)


@check(
    "validate_payload",
    """SELECT event_id, CASE WHEN k < 1 OR user_id < 3 OR event_type = 'error' OR (event_type = 'view' AND k > 50) THEN 'VECTOR_PAYLOAD_INVALID' END AS error_code
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
)
def _(t: Tables) -> DataFrame:
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    points = t.events.select(
        "event_id",
        k.alias("page"),
        (F.col("user_id") - 3).cast("int").alias("chunk_index"),
        F.when(kind != "error", kind).otherwise("").alias("document_id"),
        F.when((kind != "view") | (k <= 50), kind).alias("version_id"),
        *[F.col("props").alias(n) for n in ("document_title", "academic_year", "content_hash", "text")],
    )
    return validation.validate_payload(points).select("event_id", "error_code")


# Hits from order lines: an order asks, a part group is the point, the price in cents the place.
HITS_SQL = """hits AS (SELECT l_orderkey AS question_id, l_partkey % 5 AS point_id, round(l_discount * 10, 6) AS score, CAST(round(l_extendedprice * 100) AS BIGINT) AS pos FROM lineitem)"""


def hits(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("question_id"),
        (F.col("l_partkey") % 5).alias("point_id"),
        F.round(F.col("l_discount") * 10, 6).alias("score"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("pos"),
    )


@check(
    "dedup_hits",
    f"""WITH {HITS_SQL}, best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY question_id, point_id ORDER BY score DESC, pos) = 1)
    SELECT b.question_id, b.point_id, b.score, f.pos FROM best b JOIN
      (SELECT question_id, point_id, min(pos) AS pos FROM hits GROUP BY ALL) f ON b.question_id = f.question_id AND b.point_id = f.point_id""",
)
def _(t: Tables) -> DataFrame:
    return answering.dedup_hits(hits(t)).select("question_id", "point_id", "score", "pos")


@check(
    "score_filter",
    f"WITH {HITS_SQL} SELECT question_id, pos, score FROM hits WHERE score >= 0.35",
)
def _(t: Tables) -> DataFrame:
    return validation.score_filter(hits(t)).select("question_id", "pos", "score")


@check(
    "rank_hits",
    """SELECT l_suppkey AS question_id, l_orderkey * 10 + l_linenumber AS point_id, l_extendedprice AS score,
      CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS INT) AS rank
    FROM lineitem QUALIFY rank <= 6""",
)
def _(t: Tables) -> DataFrame:
    found = t.lineitem.select(
        F.col("l_suppkey").alias("question_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"),
        F.col("l_extendedprice").alias("score"),
    )
    return retrieval.rank_hits(found)


# Contexts from conversations: a turn asks, the up to six turns before it are its hits.
CONTEXT_SQL = f"""turns AS (SELECT conv_id, turn, conv_id||'-'||turn AS question_id, text,
    list({{'id': conv_id||'-'||turn, 'text': text, 'role': role}}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS ctx FROM conversations),
asked AS (SELECT question_id, text AS question, list_reverse(ctx) AS ctx FROM turns WHERE len(ctx) > 0)"""
DECIDE_SQL = f"""counted AS (
  SELECT *, list_transform(ctx, lambda c: len(list_filter(words, lambda w: list_contains({fr.tokens('c.text')}, w)))) AS counts
  FROM (SELECT *, {fr.content_words('question')} AS words FROM asked)),
ranked AS (SELECT *, coalesce(list_reverse_sort(counts)[1], 0) AS best, coalesce(list_reverse_sort(counts)[2], 0) AS second, len(words) AS n FROM counted),
decided AS (
  SELECT *, CASE WHEN n = 0 THEN 'ambiguous' WHEN best = 0 OR best < n * 0.5 THEN 'not_found' WHEN second = best THEN 'ambiguous'
    WHEN best < n AND second >= 2.0 / 3 * best THEN 'ambiguous' ELSE 'found' END AS status, ctx[list_position(counts, best)] AS top FROM ranked)"""
CONTEXT_SQL = f"{CONTEXT_SQL},\n{DECIDE_SQL}"


def contexts(t: Tables) -> DataFrame:
    c = F.col
    turns = t.conversations.select(
        "conv_id",
        "turn",
        F.concat_ws("-", c("conv_id").cast("string"), c("turn").cast("string")).alias("question_id"),
        "text",
        "role",
    )
    hit = F.struct(
        (-c("turn")).alias("rank"),
        c("question_id").alias("point_id"),
        F.lit(1.0).alias("score"),
        "text",
        c("conv_id").cast("string").alias("document_id"),
        c("role").alias("version_id"),
        c("role").alias("document_title"),
        F.lit(fr.YEAR).alias("academic_year"),
        c("turn").cast("int").alias("page"),
        F.lit(None).cast("string").alias("section"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    with_hits = turns.withColumn("context", F.array_sort(F.collect_list(hit).over(before))).where(F.size("context") > 0)
    return with_hits.select(
        "question_id",
        c("text").alias("question"),
        "context",
        F.transform("context", lambda h: h.point_id).alias("retrieved"),
    )


@check(
    "lexical_decider",
    f"""WITH {CONTEXT_SQL} SELECT question_id, status, CASE WHEN status = 'found' THEN CASE WHEN length(top.text) > 200 THEN substr(top.text, 1, 200)||'...' ELSE top.text END END AS answer,
      CASE WHEN status = 'found' THEN top.id ELSE '' END AS cited FROM decided""",
)
def _(t: Tables) -> DataFrame:
    checked = validation.validate_decisions(answering.lexical_decider(contexts(t)))
    return checked.select("question_id", "status", "answer", F.array_join("cited_chunk_ids", ",").alias("cited"))


@check(
    "assemble_context",
    """WITH ranked AS (SELECT l_orderkey AS question_id, l_partkey, l_suppkey, l_shipdate, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem)
    SELECT question_id, to_json({'question': 'order '||question_id, 'context': list({'chunkId': 'p'||l_partkey||'-'||l_linenumber, 'text': 'part '||l_partkey,
      'documentTitle': 's'||l_suppkey, 'page': l_linenumber, 'section': CASE WHEN l_linenumber > 3 THEN 'late' END} ORDER BY rank)})::VARCHAR AS message
    FROM ranked WHERE rank <= 6 GROUP BY question_id""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    # One place per order and line number, so that ranks are settled.
    lines = t.lineitem.select(
        c("l_orderkey").alias("question_id"),
        c("l_extendedprice").alias("score"),
        F.format_string("%05d", "l_linenumber").alias("point_id"),
        "l_partkey",
        "l_linenumber",
        "l_suppkey",
    )
    ranked = retrieval.rank_hits(lines)
    rows = ranked.select(
        "question_id",
        "rank",
        F.concat(F.lit("p"), c("l_partkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string")).alias("point_id"),
        "score",
        F.concat(F.lit("part "), c("l_partkey").cast("string")).alias("text"),
        F.lit("d").alias("document_id"),
        F.lit("v").alias("version_id"),
        F.concat(F.lit("s"), c("l_suppkey").cast("string")).alias("document_title"),
        F.lit(fr.YEAR).alias("academic_year"),
        c("l_linenumber").alias("page"),
        F.when(c("l_linenumber") > 3, "late").alias("section"),
    )
    question = F.concat(F.lit("order "), c("question_id").cast("string"))
    return answering.assemble_context(rows).select(
        "question_id", answering.context_message(question, c("context")).alias("message")
    )


# Model replies of many shapes, right and wrong, over the contexts of conversations.
_CITED_FIRST = """'"'||ctx[1].id||'"'"""
RAW_SQL = f"""replies AS (SELECT *, CASE (length(question) % 12)
  WHEN 0 THEN '{{"status":"found","answer":"a","citedChunkIds":['||{_CITED_FIRST}||']}}'
  WHEN 1 THEN '```json'||chr(10)||'{{"status":"found","answer":"b","citedChunkIds":['||{_CITED_FIRST}||','||{_CITED_FIRST}||']}}'||chr(10)||'```'
  WHEN 2 THEN '  ```'||chr(10)||'{{"status":"ambiguous","answer":null,"citedChunkIds":[]}}```  '
  WHEN 3 THEN '{{"status":"not_found","answer":null,"citedChunkIds":[]}}'
  WHEN 4 THEN '{{"status":"not_found","answer":"x","citedChunkIds":[]}}'
  WHEN 5 THEN '{{"status":"found","answer":"","citedChunkIds":['||{_CITED_FIRST}||']}}'
  WHEN 6 THEN '{{"status":"found","answer":"c","citedChunkIds":["other"]}}'
  WHEN 7 THEN '{{"status":"found","answer":"d","citedChunkIds":[]}}'
  WHEN 8 THEN '{{"status":"found","answer":5,"citedChunkIds":['||{_CITED_FIRST}||']}}'
  WHEN 9 THEN '{{"status":"ambiguous","answer":null,"citedChunkIds":[1]}}'
  WHEN 10 THEN 'No lo sé: '||question
  ELSE '{{"status":"found","answer":"e","citedChunkIds":['||{_CITED_FIRST}||',"'||ctx[len(ctx)].id||'"]}}' END AS raw FROM asked)"""


def replies(t: Tables) -> DataFrame:
    c = F.col
    first = F.get("context", F.lit(0)).point_id
    last = F.element_at("context", -1).point_id
    shapes = [
        ('{"status":"found","answer":"a","citedChunkIds":["%s"]}', [first]),
        ('```json\n{"status":"found","answer":"b","citedChunkIds":["%s","%s"]}\n```', [first, first]),
        ('  ```\n{"status":"ambiguous","answer":null,"citedChunkIds":[]}```  ', []),
        ('{"status":"not_found","answer":null,"citedChunkIds":[]}', []),
        ('{"status":"not_found","answer":"x","citedChunkIds":[]}', []),
        ('{"status":"found","answer":"","citedChunkIds":["%s"]}', [first]),
        ('{"status":"found","answer":"c","citedChunkIds":["other"]}', []),
        ('{"status":"found","answer":"d","citedChunkIds":[]}', []),
        ('{"status":"found","answer":5,"citedChunkIds":["%s"]}', [first]),
        ('{"status":"ambiguous","answer":null,"citedChunkIds":[1]}', []),
        ("No lo sé: %s", [c("question")]),
        ('{"status":"found","answer":"e","citedChunkIds":["%s","%s"]}', [first, last]),
    ]
    raw, kind = F.lit(None).cast("string"), F.length("question") % 12
    for i, (form, args) in enumerate(shapes):
        raw = F.when(kind == i, F.format_string(form, *args) if args else F.lit(form)).otherwise(raw)
    return contexts(t).withColumn("raw", raw)


_FIELDS_SQL = f"""bodies AS (SELECT *, CASE WHEN regexp_matches({fr.trimmed('raw')}, '(?is)^```(?:json)?\\s*(.*?)\\s*```$')
    THEN regexp_extract({fr.trimmed('raw')}, '(?is)^```(?:json)?\\s*(.*?)\\s*```$', 1) ELSE {fr.trimmed('raw')} END AS body FROM replies),
parsed AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM bodies),
typed AS (SELECT *, j->>'$.status' AS s, json_type(j, '$.answer') AS atype, j->>'$.answer' AS a,
  list_transform(CAST(j->'$.citedChunkIds[*]' AS JSON[]), lambda x: json_type(x)) AS ct, j->>'$.citedChunkIds[*]' AS ids FROM parsed),
judged AS (SELECT *, coalesce(
  (s = 'found' AND atype = 'VARCHAR' AND a <> '' AND len(ids) >= 1 AND len(list_filter(ids, lambda x: NOT list_contains(list_transform(ctx, lambda c: c.id), x))) = 0)
  OR (s IN ('not_found', 'ambiguous') AND atype = 'NULL' AND len(ids) = 0), false) AS ok FROM typed)"""


@check(
    "validate_decisions",
    f"""WITH {CONTEXT_SQL}, {RAW_SQL}, {_FIELDS_SQL}
    SELECT question_id, CASE WHEN ok THEN s END AS status, CASE WHEN ok THEN a END AS answer,
      CASE WHEN ok THEN array_to_string(ids, ',') END AS cited, CASE WHEN NOT ok THEN 'MODEL_OUTPUT_INVALID' END AS error_code FROM judged""",
)
def _(t: Tables) -> DataFrame:
    return validation.validate_decisions(replies(t)).select(
        "question_id", "status", "answer", F.array_join("cited_chunk_ids", ",").alias("cited"), "error_code"
    )


@check(
    "parse_model_json",
    f"""WITH {CONTEXT_SQL}, {RAW_SQL}, {_FIELDS_SQL}
    SELECT question_id, j IS NOT NULL AS is_json, s AS status, body FROM typed""",
)
def _(t: Tables) -> DataFrame:
    value = fields.parse_model_json(F.col("raw"))
    return replies(t).select(
        "question_id",
        value.isNotNull().alias("is_json"),
        F.try_variant_get(value, "$.status", "string").alias("status"),
        fields.model_json_text(F.col("raw")).alias("body"),
    )


@check(
    "build_citations",
    f"""WITH {CONTEXT_SQL}, {RAW_SQL}, {_FIELDS_SQL},
    cited AS (SELECT question_id, ctx, unnest(ids) AS id, generate_subscripts(ids, 1) AS n FROM judged WHERE ok),
    firsts AS (SELECT question_id, ctx, id, min(n) AS n FROM cited GROUP BY ALL),
    found AS (SELECT question_id, n, list_filter(ctx, lambda c: c.id = id)[1] AS h FROM firsts)
    SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY n) - 1 AS INT) AS place, split_part(h.id, '-', 1) AS document_id, h.role AS version_id,
      CAST(split_part(h.id, '-', 2) AS INT) AS page, substr(h.text, 1, 300) AS excerpt FROM found""",
)
def _(t: Tables) -> DataFrame:
    cited = answering.build_citations(validation.validate_decisions(replies(t)))
    rows = cited.select("question_id", F.posexplode_outer("citations").alias("place", "c")).where(F.col("c").isNotNull())
    return rows.select("question_id", "place", "c.document_id", "c.version_id", "c.page", "c.excerpt")


# A decider that answers in prose when the question is of even length, also when asked again.
def _echo_decider():
    import json

    def decide(prompt: str, message: str) -> str:
        body = json.loads(message)
        if len(body["question"]) % 2 == 0:
            return "No puedo responder."
        first = body["context"][0]["chunkId"]
        return "```json\n" + json.dumps({"status": "found", "answer": body["question"], "citedChunkIds": [first]}) + "\n```"

    return decide


@check(
    "decide",
    f"""WITH {CONTEXT_SQL} SELECT question_id, CASE WHEN length(question) % 2 = 1 THEN 'found' END AS status,
      CASE WHEN length(question) % 2 = 1 THEN question END AS answer, CASE WHEN length(question) % 2 = 1 THEN ctx[1].id END AS cited,
      CASE WHEN length(question) % 2 = 0 THEN 'MODEL_OUTPUT_INVALID' END AS error_code FROM asked""",
)
def _(t: Tables) -> DataFrame:
    asked = contexts(t).withColumn("message", answering.context_message(F.col("question"), F.col("context")))
    return models.decide(asked.select("question_id", "message", "retrieved"), _echo_decider).select(
        "question_id", "status", "answer", F.array_join("cited_chunk_ids", ",").alias("cited"), "error_code"
    )


@check(
    "chunk_ids_from_json",
    """WITH j AS (SELECT event_id, CASE event_type WHEN 'signup' THEN '["'||user_id||'","'||event_id||'"]' WHEN 'view' THEN '[]' WHEN 'click' THEN '['||user_id||']'
        WHEN 'error' THEN props ELSE '["'||user_id||'", null]' END AS text FROM events)
    SELECT event_id, CASE WHEN json_type(text::JSON) = 'ARRAY' AND len(list_filter(CAST(text::JSON->'$[*]' AS JSON[]), lambda x: json_type(x) <> 'VARCHAR')) = 0
      THEN array_to_string(text::JSON->>'$[*]', ',') END AS ids FROM j""",
)
def _(t: Tables) -> DataFrame:
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    text = (
        F.when(kind == "signup", F.format_string('["%s","%s"]', user, F.col("event_id").cast("string")))
        .when(kind == "view", "[]")
        .when(kind == "click", F.format_string("[%s]", user))
        .when(kind == "error", F.col("props"))
        .otherwise(F.format_string('["%s", null]', user))
    )
    return t.events.select("event_id", F.array_join(fields.chunk_ids_from_json(text), ",").alias("ids"))
