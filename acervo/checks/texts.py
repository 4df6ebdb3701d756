"""Registered queries: files, text, sections, chunks and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.checks import fragments as fr
from acervo.checks.registry import CHECKS, Tables, check
from acervo.functions import ids
from acervo.functions import text as tx
from acervo.operators import chunking, validation
from acervo.sources import files as fs

# Noise put into the given texts: control and format characters, line
# separators of every kind, decomposed accents, runs of white space.
NOISE = (
    (", ", "chr(9)||chr(8203)||chr(9)"),
    (". ", "'.'||chr(13)||chr(10)||chr(160)"),
    ("é", "'e'||chr(65279)||chr(769)"),
    ("ü", "'u'||chr(7)||chr(776)"),
    (" the ", "chr(133)||'the'||chr(8233)"),
    (" de ", "chr(8232)||chr(12)||'de'||chr(12288)"),
)


def noisy_sql(expr: str) -> str:
    for old, new in NOISE:
        expr = f"replace({expr}, '{old}', {new})"
    return f"chr(65279)||' '||{expr}||chr(133)"


def noisy(col):
    for old, new in NOISE:
        by = "".join(p[1:-1] if p.startswith("'") else chr(int(p[4:-1])) for p in new.split("||"))
        col = F.replace(col, F.lit(old), F.lit(by))
    return F.concat(F.lit(chr(65279) + " "), col, F.lit(chr(133)))


@check("normalize_text", f"SELECT doc_id, {fr.normal(noisy_sql('text'))} AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", tx.normalize_text(noisy(F.col("text"))).alias("text"))


@check(
    "extractable_chars",
    f"""SELECT doc_id, length({fr.bare(noisy_sql('text'))}) AS chars,
        length({fr.bare(noisy_sql('text'))}) > 0 AS has_text FROM documents""",
)
def _(t: Tables) -> DataFrame:
    text = noisy(F.col("text"))
    return t.spread("documents").select(
        "doc_id",
        tx.extractable_chars(text).cast("bigint").alias("chars"),
        tx.has_extractable_text(text).alias("has_text"),
    )


@check(
    "extractable_totals",
    f"""WITH {fr.PAGES_SQL}, totals AS (
      SELECT 'v'||doc_id AS version_id, CAST(sum(length({fr.bare('text')})) AS BIGINT) AS chars FROM pages_of GROUP BY doc_id)
    SELECT version_id, chars, CASE WHEN chars < 20 THEN 'PDF_TEXT_NOT_FOUND' END AS error_code FROM totals""",
)
def _(t: Tables) -> DataFrame:
    return validation.extractable_totals(fr.flat_pages(t))


@check(
    "is_heading",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER ({fr.heading('line')}) AS BIGINT) AS headings,
      CAST(count(*) FILTER ({fr.heading("upper(replace(rtrim(line, '.'), 'ß', 'SS'))")}) AS BIGINT) AS upper_headings
    FROM l GROUP BY doc_id""",
)
def _(t: Tables) -> DataFrame:
    lines = t.spread("documents").select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        F.count_if(tx.is_heading(F.col("line"))).alias("headings"),
        F.count_if(tx.is_heading(F.upper(F.rtrim("line", F.lit("."))))).alias("upper_headings"),
    )


# Texts with a heading after every sentence.
HEADED_SQL = "replace(text, '. ', '.'||chr(10)||'TÍTULO '||upper(source)||chr(10))"


def headed(t: Tables) -> DataFrame:
    title = F.concat(F.lit(".\nTÍTULO "), F.upper("source"), F.lit("\n"))
    docs = t.spread("documents").withColumn("text", F.replace("text", F.lit(". "), title))
    return fr.with_pages(docs).withColumn("version_id", fr.version_id(F.col("doc_id")))


HEADED_SECTIONS_SQL = f"""{fr.PAGES_SQL.replace('string_split(text, chr(10))', f'string_split({HEADED_SQL}, chr(10))')},
marked AS (
  SELECT doc_id, page, n, line, {fr.heading('line')} AS head
  FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS n FROM pages_of)),
numbered AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY n) AS s FROM marked),
sections AS (
  SELECT doc_id, page, s, max(CASE WHEN head THEN line END) AS section,
         trim(string_agg(line, chr(10) ORDER BY n), ' '||chr(10)) AS text
  FROM numbered GROUP BY doc_id, page, s)"""


@check(
    "assign_sections",
    f"""WITH {HEADED_SECTIONS_SQL}
    SELECT doc_id, page, section, text,
           CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, s) AS INT) AS section_no
    FROM sections WHERE text <> ''""",
)
def _(t: Tables) -> DataFrame:
    rows = chunking.assign_sections(headed(t)).select("doc_id", F.posexplode_outer("sections").alias("at", "s"))
    return rows.select(
        "doc_id", F.col("s.page").cast("bigint").alias("page"), "s.section", "s.text", (F.col("at") + 1).alias("section_no")
    )


@check(
    "version_content_hash",
    f"""WITH {fr.PAGES_SQL}, normal AS (SELECT doc_id, page, {fr.normal(noisy_sql('text'))} AS text FROM pages_of)
    SELECT 'v'||doc_id AS version_id, sha256(string_agg(text, chr(10)||chr(12)||chr(10) ORDER BY page)) AS content_hash
    FROM normal WHERE text <> '' GROUP BY doc_id""",
)
def _(t: Tables) -> DataFrame:
    noise = F.transform("pages", lambda p: F.struct(p.page.alias("page"), noisy(p.text).alias("text")))
    return chunking.version_content_hash(fr.corpus(t).withColumn("pages", noise)).select("version_id", "content_hash")


# Chunks in SQL. Texts hold no blank lines and no word of 1000 characters, so
# the cuts are lines, and words inside lines of 1000 characters and more. A unit
# is a run of short lines or one long line; a recursive query walks its chunks.
CHUNKS_SQL = f"""{fr.PAGES_SQL},
sections AS (SELECT doc_id, page, 0 AS s, CAST(NULL AS VARCHAR) AS section, trim(text, ' '||chr(10)) AS text FROM pages_of),
UNITS
"""
_UNITS = """pieces AS (
  SELECT doc_id, page, s, n, CASE WHEN n > 1 THEN chr(10)||line ELSE line END AS piece
  FROM (SELECT doc_id, page, s, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS n FROM sections WHERE text <> '')),
runs AS (
  SELECT *, length(piece) >= 1000 AS long,
    sum(CASE WHEN length(piece) >= 1000 THEN 1 ELSE 0 END) OVER w * 2
      - CASE WHEN length(piece) >= 1000 THEN 1 ELSE 0 END AS unit
  FROM pieces WINDOW w AS (PARTITION BY doc_id, page, s ORDER BY n)),
fine AS (
  SELECT doc_id, page, s, unit, n, 0 AS m, piece FROM runs WHERE NOT long AND piece <> ''
  UNION ALL
  SELECT doc_id, page, s, unit, n, m, CASE WHEN m > 1 THEN ' '||word ELSE word END
  FROM (SELECT doc_id, page, s, unit, n, unnest(string_split(piece, ' ')) AS word,
               generate_subscripts(string_split(piece, ' '), 1) AS m FROM runs WHERE long)
  WHERE m > 1 OR word <> ''),
units AS (
  SELECT doc_id, page, s, unit, string_agg(piece, '' ORDER BY n, m) AS text, list(e ORDER BY n, m) AS ends
  FROM (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id, page, s, unit ORDER BY n, m) AS BIGINT) AS e FROM fine)
  GROUP BY ALL),
edges AS (SELECT doc_id, page, s, unit, text, list_prepend(CAST(0 AS BIGINT), ends) AS e FROM units),
walk AS (
  SELECT doc_id, page, s, unit, text, e, 0 AS c, CAST(1 AS BIGINT) AS a,
         CAST(len(list_filter(e, lambda x: x <= 1000)) AS BIGINT) AS b FROM edges
  UNION ALL
  SELECT doc_id, page, s, unit, text, e, c + 1, a, CAST(len(list_filter(e, lambda x: x <= e[a] + 1000)) AS BIGINT)
  FROM (SELECT * REPLACE (
      CAST(1 + len(list_filter(e, lambda x: x < e[b] - least(200, 1000 - (e[b+1] - e[b])))) AS BIGINT) AS a)
    FROM walk WHERE b < len(e))),
chunks AS (
  SELECT doc_id, page, section, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, s, unit, c) - 1 AS INT) AS chunk_index
  FROM (SELECT w.doc_id, w.page, w.s, unit, c, sections.section,
               trim(substr(w.text, e[a] + 1, e[b] - e[a]), ' '||chr(10)) AS text
        FROM walk w JOIN sections ON w.doc_id = sections.doc_id AND w.page = sections.page AND w.s = sections.s)
  WHERE text <> '')"""
CHUNKS_SQL = CHUNKS_SQL.replace("UNITS\n", _UNITS)
HEADED_CHUNKS_SQL = f"{HEADED_SECTIONS_SQL},\n{_UNITS}"


@check(
    "chunk_versions",
    f"""WITH RECURSIVE {CHUNKS_SQL},
    hashes AS (SELECT doc_id, sha256(string_agg(text, chr(10)||chr(12)||chr(10) ORDER BY page)) AS content_hash
               FROM sections WHERE text <> '' GROUP BY doc_id)
    SELECT {fr.uuid5("'v'||c.doc_id||':'||chunk_index")} AS point_id, 'd'||c.doc_id AS document_id, 'v'||c.doc_id AS version_id,
      CAST(page AS INT) AS page, section, chunk_index, content_hash, text
    FROM chunks c JOIN hashes h ON c.doc_id = h.doc_id""",
)
def _(t: Tables) -> DataFrame:
    return chunking.chunk_versions(fr.corpus(t)).select(
        "point_id", "document_id", "version_id", "page", "section", "chunk_index", "content_hash", "text"
    )


@check(
    "chunk_sections",
    f"""WITH RECURSIVE {HEADED_CHUNKS_SQL}
    SELECT 'v'||doc_id AS version_id, CAST(page AS INT) AS page, section, chunk_index, text FROM chunks""",
)
def _(t: Tables) -> DataFrame:
    versions = headed(t).select(
        "version_id",
        F.col("version_id").alias("document_id"),
        F.col("source").alias("document_title"),
        F.lit(fr.YEAR).alias("academic_year"),
        "pages",
    )
    return chunking.chunk_versions(versions).select("version_id", "page", "section", "chunk_index", "text")


@check(
    "split_recursive",
    f"""WITH RECURSIVE sections AS (SELECT doc_id, 1 AS page, 0 AS s, CAST(NULL AS VARCHAR) AS section, text FROM documents),
    {_UNITS}
    SELECT doc_id, chunk_index AS piece_no, text FROM chunks""",
)
def _(t: Tables) -> DataFrame:
    split = chunking.split_recursive()
    return t.spread("documents").select("doc_id", F.posexplode_outer(split(F.col("text"))).alias("piece_no", "text"))


@check(
    "assign_chunk_index",
    f"""WITH {fr.PAGES_SQL}
    SELECT 'v'||doc_id AS version_id, page, piece_no, text,
      row_number() OVER (PARTITION BY doc_id ORDER BY page, piece_no) - 1 AS chunk_index
    FROM (SELECT doc_id, CAST(page AS INT) AS page, unnest(string_split(text, chr(10))) AS text,
                 CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS piece_no FROM pages_of)""",
)
def _(t: Tables) -> DataFrame:
    pieces = fr.flat_pages(t).select(
        "version_id", "page", F.lit(0).alias("section_no"), F.posexplode_outer(F.split("text", "\n")).alias("piece_no", "text")
    )
    return chunking.assign_chunk_index(pieces).drop("section_no")


@check(
    "nest_pages",
    f"""WITH {fr.PAGES_SQL} SELECT 'v'||doc_id AS version_id, count(*) AS pages,
      sha256(string_agg(text, chr(12) ORDER BY page)) AS text_hash FROM pages_of GROUP BY doc_id""",
)
def _(t: Tables) -> DataFrame:
    flat = fr.corpus(t).select("document_id", "version_id", "document_title", "academic_year", F.inline("pages"))
    nested = chunking.nest_pages(flat)
    texts = F.array_join(F.transform("pages", lambda p: p.text), "\f")
    return nested.select("version_id", F.size("pages").cast("bigint").alias("pages"), F.sha2(texts, 256).alias("text_hash"))


@check("chunk_pages", CHECKS["chunk_versions"].sql)
def _(t: Tables) -> DataFrame:
    flat = fr.corpus(t).select("document_id", "version_id", "document_title", "academic_year", F.inline("pages"))
    return chunking.chunk_pages(flat).where(F.col("error_code").isNull()).select(
        "point_id", "document_id", "version_id", "page", "section", "chunk_index", "content_hash", "text"
    )


@check(
    "validate_pages",
    """SELECT 'v'||l_orderkey AS version_id, count(*) AS bad_pages, 'PDF_PAGE_METADATA_INVALID' AS error_code
    FROM (SELECT l_orderkey, CAST(l_quantity AS INT) - 1 AS page, count(*) AS n FROM lineitem GROUP BY ALL)
    WHERE page < 1 OR n > 1 GROUP BY l_orderkey""",
)
def _(t: Tables) -> DataFrame:
    pages = t.lineitem.select(fr.version_id(F.col("l_orderkey")).alias("version_id"), (F.col("l_quantity").cast("int") - 1).alias("page"))
    return validation.validate_pages(pages)


@check("point_id", f"""SELECT l_orderkey, l_linenumber, {fr.uuid5("l_orderkey||':'||l_linenumber")} AS point_id FROM lineitem""")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", ids.point_id(F.col("l_orderkey").cast("string"), F.col("l_linenumber")).alias("point_id")
    )


@check(
    "request_hash",
    """SELECT doc_id, sha256(sha256(text) || to_json({'documentId': source, 'versionId': 'v'||doc_id, 'title': text,
      'academicYear': '2026-2027', 'description': CASE WHEN lang = 'en' THEN NULL ELSE lang END})) AS request_hash
    FROM documents""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    return t.spread("documents").select(
        "doc_id",
        ids.request_hash(
            F.sha2("text", 256), c("source"), fr.version_id(c("doc_id")), c("text"), F.lit(fr.YEAR),
            F.when(c("lang") != "en", c("lang")),
        ).alias("request_hash"),
    )


@check("excerpt", "SELECT doc_id, substr(text, 1, 300) AS excerpt FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


@check(
    "sanitize_code",
    """SELECT page_id, coalesce(nullif(substr(regexp_replace(url, '[^A-Z0-9_]', '_', 'g'), 1, 100), ''), 'UNKNOWN_ERROR') AS code
    FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.sanitize_code(F.col("url")).alias("code"))


@check(
    "sanitize_message",
    f"""SELECT doc_id, substr({fr.trimmed("regexp_replace(chr(27)||text, '[' || chr(1) || '-' || chr(31) || chr(127) || ']', ' ', 'g')")}, 1, 500) AS message
    FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.sanitize_message(F.concat(F.lit("\x1b"), F.col("text"))).alias("message"))


@check(
    "tokenize",
    f"""SELECT conv_id, turn, array_to_string({fr.tokens('text')}, '|') AS tokens,
      array_to_string({fr.content_words('text')}, '|') AS words FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id",
        "turn",
        F.array_join(tx.tokenize(F.col("text")), "|").alias("tokens"),
        F.array_join(tx.content_words(F.col("text")), "|").alias("words"),
    )


@check(
    "strip_trailing_punct",
    r"""SELECT doc_id, regexp_replace(text || '?!)"', '[.,;:!?"'')\]}>]+$', '') AS text FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.strip_trailing_punct(F.concat("text", F.lit('?!)"'))).alias("text"))


# Files made from the given documents: one language lacks the signature, one
# source has another extension.
FILES_SQL = """files AS (
  SELECT '/corpus/'||source||'/'||doc_id||CASE WHEN source = 'src3' THEN '.txt' WHEN source = 'src4' THEN '.PDF' ELSE '.pdf' END AS path,
    CASE WHEN lang = 'de' THEN '' ELSE '%PDF-1.7'||chr(10) END || replace(text, chr(10), chr(12)) AS content, text, source, lang FROM documents)"""
LIMIT = 8192


def files(t: Tables) -> DataFrame:
    return files_of(t.spread("documents"))


def files_of(documents: DataFrame) -> DataFrame:
    c = F.col
    ext = F.when(c("source") == "src3", ".txt").when(c("source") == "src4", ".PDF").otherwise(".pdf")
    head = F.when(c("lang") == "de", "").otherwise("%PDF-1.7\n")
    content = F.encode(F.concat(head, F.replace("text", F.lit("\n"), F.lit("\f"))), "UTF-8")
    return documents.select(
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), c("doc_id").cast("string"), ext).alias("path"),
        content.alias("content"),
    ).withColumn("length", F.octet_length("content").cast("bigint"))


_FILE_ERROR_SQL = f"""CASE WHEN NOT lower(path) LIKE '%.pdf' THEN 'PDF_EXTENSION_INVALID'
  WHEN octet_length(encode(content)) > {LIMIT} THEN 'PDF_TOO_LARGE' END"""


@check("accept_files", f"WITH {FILES_SQL} SELECT path, octet_length(encode(content)) AS length, {_FILE_ERROR_SQL} AS error_code FROM files")
def _(t: Tables) -> DataFrame:
    return fs.accept_files(files(t), max_bytes=LIMIT).select("path", "length", "error_code")


@check(
    "check_signature",
    f"""WITH {FILES_SQL} SELECT path, coalesce({_FILE_ERROR_SQL},
      CASE WHEN content NOT LIKE '\\%PDF-%' ESCAPE '\\' THEN 'PDF_SIGNATURE_INVALID' END) AS error_code FROM files""",
)
def _(t: Tables) -> DataFrame:
    return fs.check_signature(fs.accept_files(files(t), max_bytes=LIMIT)).select("path", "error_code")


@check(
    "check_signature_whole",
    f"""WITH {FILES_SQL} SELECT path, octet_length(encode(content)) AS length, CASE WHEN NOT lower(path) LIKE '%.pdf' THEN 'PDF_EXTENSION_INVALID'
      WHEN content NOT LIKE '\\%PDF-%' ESCAPE '\\' THEN 'PDF_SIGNATURE_INVALID' END AS error_code FROM files""",
)
def _(t: Tables) -> DataFrame:
    """Texts of every length, as the operators take them without a limit of one's own."""
    return fs.check_signature(fs.accept_files(files(t))).select("path", "length", "error_code")


@check("hash_content", f"WITH {FILES_SQL} SELECT path, sha256(content) AS content_hash FROM files")
def _(t: Tables) -> DataFrame:
    return fs.hash_content(files(t)).select("path", "content_hash")


@check(
    "extract_pages",
    f"""WITH {FILES_SQL}, good AS (
      SELECT path, text, coalesce(CASE WHEN NOT lower(path) LIKE '%.pdf' THEN 'PDF_EXTENSION_INVALID' END,
        CASE WHEN content NOT LIKE '\\%PDF-%' ESCAPE '\\' THEN 'PDF_SIGNATURE_INVALID' END) AS file_error FROM files),
    numbered AS (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page
                 FROM good WHERE file_error IS NULL),
    normal AS (SELECT path, page, {fr.normal('text')} AS text FROM numbered),
    pages AS (SELECT path, count(*) AS pages, string_agg(page||':'||text, '|' ORDER BY page) AS text,
                     sum(length({fr.bare('text')})) AS chars FROM normal WHERE text <> '' GROUP BY path)
    SELECT g.path, coalesce(p.pages, 0) AS pages, sha256(coalesce(p.text, '')) AS text_hash,
      coalesce(g.file_error, CASE WHEN coalesce(p.chars, 0) < 20 THEN 'PDF_TEXT_NOT_FOUND' END) AS error_code
    FROM good g LEFT JOIN pages p ON g.path = p.path""",
)
def _(t: Tables) -> DataFrame:
    pages = fs.extract_pages(fs.check_signature(fs.accept_files(files(t))))
    texts = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p.page.cast("string"), p.text)), "|")
    return pages.select(
        "path", F.size("pages").cast("bigint").alias("pages"), F.sha2(texts, 256).alias("text_hash"), "error_code"
    )


@check(
    "corpus_summary",
    """SELECT file, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(pages) AS BIGINT) AS pages,
      CASE WHEN grouping(file) = 0 THEN max(sha) END AS sha256
    FROM (SELECT source||'/'||doc_id AS file, octet_length(encode(text)) AS bytes, len(string_split(text, chr(10))) AS pages,
                 sha256(text) AS sha FROM documents)
    GROUP BY ROLLUP (file)""",
)
def _(t: Tables) -> DataFrame:
    from acervo.operators.audit import corpus_summary

    return corpus_summary(
        t.documents.select(
            F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"),
            F.octet_length("text").cast("bigint").alias("bytes"),
            F.size(F.split("text", "\n")).cast("bigint").alias("pages"),
            F.sha2("text", 256).alias("sha256"),
        )
    )


@check(
    "duplicate_keys",
    "SELECT sha256(text) AS text_hash, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1",
)
def _(t: Tables) -> DataFrame:
    return validation.duplicate_keys(t.documents.select(F.sha2("text", 256).alias("text_hash"), "lang"), ["text_hash", "lang"])
