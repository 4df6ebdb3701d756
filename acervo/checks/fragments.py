"""SQL fragments and derived tables shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acervo.checks.registry import Tables

LINES_PER_PAGE = 12
YEAR = "2026-2027"

# White space as RE2 classes: all but the line feed, and the set used for words.
_WS = r"\t\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WORD_WS = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_NOISE = r"[\x00-\x08\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}\p{Cf}]"
_TRIM = "||".join(
    f"chr({n})"
    for n in [*range(9, 14), 32, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
)


def sub(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', {by}, 'g')"


def normal(expr: str) -> str:
    """SQL of the canonical page text of ``expr``."""
    step = f"replace({expr}, chr(65279), '')"
    step = sub(step, r"\r\n?|\x{85}|\x{2028}", "chr(10)")
    step = f"replace({step}, chr(8233), chr(10)||chr(10))"
    step = sub(step, _NOISE, "''")
    step = sub(step, f"[{_WS}]+", "' '")
    step = sub(step, r" ?\n ?", "chr(10)")
    step = sub(step, r"\n{3,}", "chr(10)||chr(10)")
    return f"nfc_normalize(trim({step}, ' '||chr(10)))"


def trimmed(expr: str) -> str:
    return f"trim({expr}, {_TRIM})"


def canonical(expr: str, least: int, most: int) -> str:
    text = f"nfc_normalize({trimmed(expr)})"
    return (
        f"CASE WHEN length({text}) BETWEEN {least} AND {most} "
        f"AND NOT regexp_matches({text}, '[\\p{{Cc}}\\p{{Cf}}]') THEN {text} END"
    )


def bare(expr: str) -> str:
    """SQL of ``expr`` without white space, control and format characters."""
    return sub(expr, rf"[\n{_WS}\p{{Cc}}\p{{Cf}}]+", "''")


def heading(line: str) -> str:
    return (
        f"(length({line}) <= 80 AND {line} = upper(replace({line}, 'ß', 'SS')) AND {line} <> lower({line}) "
        f"AND regexp_matches({line}, '\\p{{L}}') "
        f"AND len(regexp_split_to_array({line}, '[{_WORD_WS}]+')) <= 10 "
        f"AND NOT regexp_matches({line}, '[.!?;,:]$'))"
    )


def tokens(expr: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({expr}), '[{_WORD_WS},¿?¡!.;:()]+'), lambda w: w <> '')"
    )


# The words that don't count, spelt out for the SQL.
STOP_SQL = (
    "'el', 'la', 'los', 'las', 'un', 'una', 'de', 'del', 'en', 'y', 'e', 'o', 'u', 'a', 'ante', 'bajo', "
    "'con', 'contra', 'para', 'por', 'que', 'cual', 'como', 'cuando', 'donde', 'es', 'se', 'su', 'lo', "
    "'qué', 'cuál', 'cómo', 'cuándo', 'dónde', 'al', 'no' "
)


def content_words(expr: str) -> str:
    return f"list_filter({tokens(expr)}, lambda w: length(w) > 2 AND w NOT IN ({STOP_SQL}))"


def uuid5(name: str) -> str:
    from acervo.functions.ids import POINT_NAMESPACE

    digest = f"sha1(from_hex('{POINT_NAMESPACE.replace('-', '')}') || encode({name}))"
    return (
        f"(SELECT substr(d,1,8)||'-'||substr(d,9,4)||'-5'||substr(d,14,3)||'-'||"
        f"substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(d,17,1)), 1)||substr(d,18,3)||'-'||substr(d,21,12) "
        f"FROM (SELECT {digest} AS d))"
    )


# Pages of a document: its lines, twelve to a page.
PAGES_SQL = f"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
pages_of AS (
  SELECT doc_id, i + 1 AS page, array_to_string(lines[i*{LINES_PER_PAGE}+1 : i*{LINES_PER_PAGE}+{LINES_PER_PAGE}], chr(10)) AS text
  FROM (SELECT doc_id, lines, unnest(range(0, (len(lines) + {LINES_PER_PAGE - 1}) // {LINES_PER_PAGE})) AS i FROM lines))"""


def with_pages(documents: DataFrame) -> DataFrame:
    """Documents with ``pages`` in the place of their text."""
    n = LINES_PER_PAGE
    last = F.floor((F.size("_lines") - 1) / n).cast("int")
    pages = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            (i + 1).alias("page"), F.array_join(F.slice("_lines", i * n + 1, F.lit(n)), "\n").alias("text")
        ),
    )
    return documents.withColumn("_lines", F.split("text", "\n")).withColumn("pages", pages).drop("_lines", "text")


def version_id(doc_id: Column) -> Column:
    return F.concat(F.lit("v"), doc_id.cast("string"))


def corpus(t: Tables) -> DataFrame:
    """One version per given document, with its pages."""
    return with_pages(t.spread("documents")).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"),
        version_id(F.col("doc_id")).alias("version_id"),
        F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("document_title"),
        F.lit(YEAR).alias("academic_year"),
        "pages",
    )


def flat_pages(t: Tables) -> DataFrame:
    return corpus(t).select("version_id", F.explode_outer("pages").alias("p")).select("version_id", "p.page", "p.text")


# State of each document's version from its labels.
VERSIONS_SQL = """versions AS (
  SELECT 'v'||d.doc_id AS version_id, d.source AS document_id,
         CASE WHEN l.doc_id IS NULL THEN 'INDEXING' WHEN l.toxic = 1 THEN 'ARCHIVED'
              WHEN l.quality = 1 THEN 'ACTIVE' ELSE 'READY' END AS state
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def labelled_versions(t: Tables) -> DataFrame:
    state = (
        F.when(F.col("quality").isNull(), "INDEXING")
        .when(F.col("toxic") == 1, "ARCHIVED")
        .when(F.col("quality") == 1, "ACTIVE")
        .otherwise("READY")
    )
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select(
        version_id(F.col("doc_id")).alias("version_id"), F.col("source").alias("document_id"), state.alias("state")
    )


# Lifecycle commands: a user is a document with four versions.
COMMANDS_SQL = """commands AS (
  SELECT event_id AS pos, 'd'||user_id AS document_id,
         'd'||user_id||'-'||(CAST(json_extract_string(props, '$.k') AS INT) % 4) AS version_id,
         CAST(json_extract_string(props, '$.k') AS INT) % 4 + 1 AS slot,
         CASE event_type WHEN 'signup' THEN 'index_started' WHEN 'view' THEN 'index_succeeded'
              WHEN 'error' THEN 'index_failed' WHEN 'purchase' THEN 'activate' ELSE 'archive' END AS command
  FROM events)"""


def commands(t: Tables) -> DataFrame:
    document = F.concat(F.lit("d"), F.col("user_id").cast("string"))
    slot = F.get_json_object("props", "$.k").cast("int") % 4
    command = (
        F.when(F.col("event_type") == "signup", "index_started")
        .when(F.col("event_type") == "view", "index_succeeded")
        .when(F.col("event_type") == "error", "index_failed")
        .when(F.col("event_type") == "purchase", "activate")
        .otherwise("archive")
    )
    return t.events.select(
        F.col("event_id").alias("pos"),
        document.alias("document_id"),
        F.concat_ws("-", document, slot.cast("string")).alias("version_id"),
        command.alias("command"),
    )


# The state machine step by step: one row per command, carrying the four states.
FOLD_SQL = COMMANDS_SQL + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS n FROM commands),
fold AS (
  SELECT document_id, CAST(0 AS BIGINT) AS n, ['NONE','NONE','NONE','NONE'] AS states,
         [CAST(NULL AS BIGINT), NULL, NULL, NULL] AS archived,
         CAST(NULL AS BIGINT) AS pos, '' AS version_id, '' AS command, '' AS before, '' AS outcome
  FROM (SELECT DISTINCT document_id FROM commands)
  UNION ALL
  SELECT document_id, n,
    list_transform(states, lambda s, i: CASE
      WHEN i = slot THEN after
      WHEN outcome = 'accepted' AND command = 'activate' AND s = 'ACTIVE' THEN 'ARCHIVED' ELSE s END),
    list_transform(archived, lambda a, i: CASE
      WHEN i = slot AND outcome = 'accepted' AND command = 'archive' THEN pos
      WHEN i <> slot AND outcome = 'accepted' AND command = 'activate' AND states[i] = 'ACTIVE' THEN pos ELSE a END),
    pos, version_id, command, before, outcome
  FROM (
    SELECT *, CASE WHEN outcome <> 'accepted' THEN before
      ELSE CASE command WHEN 'index_started' THEN 'INDEXING' WHEN 'index_succeeded' THEN 'READY'
           WHEN 'index_failed' THEN 'FAILED' WHEN 'activate' THEN 'ACTIVE' ELSE 'ARCHIVED' END END AS after
    FROM (
      SELECT o.document_id, o.n, f.states, f.archived, o.pos, o.version_id, o.slot, o.command, f.states[o.slot] AS before,
        CASE WHEN o.command = 'index_started' THEN CASE WHEN f.states[o.slot] = 'NONE' THEN 'accepted' ELSE 'no_op' END
             WHEN f.states[o.slot] = 'NONE' THEN 'VERSION_NOT_FOUND'
             WHEN o.command = 'archive' THEN CASE WHEN f.states[o.slot] = 'ARCHIVED' THEN 'no_op' ELSE 'accepted' END
             WHEN o.command = 'index_succeeded' THEN CASE f.states[o.slot] WHEN 'INDEXING' THEN 'accepted' WHEN 'READY' THEN 'no_op' ELSE 'INVALID_TRANSITION' END
             WHEN o.command = 'index_failed' THEN CASE f.states[o.slot] WHEN 'INDEXING' THEN 'accepted' WHEN 'FAILED' THEN 'no_op' ELSE 'INVALID_TRANSITION' END
             ELSE CASE f.states[o.slot] WHEN 'READY' THEN 'accepted' WHEN 'ACTIVE' THEN 'no_op' ELSE 'VERSION_NOT_READY' END
        END AS outcome
      FROM fold f JOIN ordered o ON o.document_id = f.document_id AND o.n = f.n + 1)))"""
HISTORIES_SQL = FOLD_SQL + """,
final AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC) = 1),
histories AS (
  SELECT document_id, document_id||'-'||(i-1) AS version_id, states[i] AS state, archived[i] AS archived_at
  FROM (SELECT *, unnest([1,2,3,4]) AS i FROM final) WHERE states[i] <> 'NONE')"""
