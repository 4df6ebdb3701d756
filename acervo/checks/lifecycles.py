"""Registered queries: the version lifecycle, scopes and purges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.checks import fragments as fr
from acervo.checks.registry import Tables, check
from acervo.operators import lifecycle, validation
from acervo.operators.diagnostics import delete_counted
from acervo.session import cut_lineage, shared_dir
from acervo.sources import snapshots as sn


@check(
    "fold_lifecycle",
    f"WITH RECURSIVE {fr.FOLD_SQL} SELECT pos, document_id, version_id, command, before, outcome FROM fold WHERE n > 0",
)
def _(t: Tables) -> DataFrame:
    return lifecycle.fold_lifecycle(fr.commands(t))


@check(
    "version_histories",
    f"WITH RECURSIVE {fr.HISTORIES_SQL} SELECT document_id, version_id, state, archived_at FROM histories",
)
def _(t: Tables) -> DataFrame:
    return lifecycle.version_histories(fr.commands(t)).select("document_id", "version_id", "state", "archived_at")


@check(
    "purge_queue",
    f"""WITH RECURSIVE {fr.HISTORIES_SQL} SELECT version_id, archived_at AS requested_at FROM histories WHERE state = 'ARCHIVED'
    UNION ALL SELECT h.version_id, f.pos FROM histories h JOIN fold f ON f.version_id = h.version_id AND f.command = 'index_failed' AND f.outcome = 'accepted'
    WHERE h.state = 'FAILED'""",
)
def _(t: Tables) -> DataFrame:
    return lifecycle.purge_queue(lifecycle.version_histories(fr.commands(t)))


@check(
    "preview_scope",
    f"""WITH RECURSIVE {fr.HISTORIES_SQL}, candidates AS (
      SELECT document_id, version_id FROM histories UNION ALL
      SELECT DISTINCT 'd'||(user_id + 1), 'd'||user_id||'-0' FROM events),
    judged AS (
      SELECT c.*, CASE WHEN h.version_id IS NULL OR h.document_id <> c.document_id THEN 'VERSION_NOT_FOUND'
        WHEN h.state NOT IN ('READY', 'ACTIVE') THEN 'VERSION_NOT_PREVIEWABLE' END AS error_code
      FROM candidates c LEFT JOIN histories h ON c.version_id = h.version_id)
    SELECT document_id, version_id, error_code,
      CASE WHEN error_code IS NULL THEN (SELECT max(version_id) FROM histories h WHERE h.state = 'ACTIVE' AND h.document_id = j.document_id AND h.version_id <> j.version_id) END AS hidden_version_id,
      CASE WHEN error_code IS NULL THEN (SELECT count(*) FROM histories h WHERE h.state = 'ACTIVE' AND h.document_id <> j.document_id) + 1 END AS scope_size
    FROM judged j""",
)
def _(t: Tables) -> DataFrame:
    # The scope reads the versions table three times, so it is written once.
    versions = cut_lineage(lifecycle.version_histories(fr.commands(t)).select("document_id", "version_id", "state"))
    user = F.col("user_id")
    strangers = t.events.select(
        F.concat(F.lit("d"), (user + 1).cast("string")).alias("document_id"),
        F.concat(F.lit("d"), user.cast("string"), F.lit("-0")).alias("version_id"),
    ).distinct()
    candidates = versions.select("document_id", "version_id").unionByName(strangers)
    return lifecycle.preview_scope(candidates, versions)


@check(
    "version_view",
    f"""WITH {fr.VERSIONS_SQL}, titles AS (SELECT source AS document_id, max(lang) AS title, CAST(count(*) AS VARCHAR) AS description FROM documents GROUP BY source)
    SELECT version_id, state, v.document_id, title, description FROM versions v JOIN titles t ON v.document_id = t.document_id""",
)
def _(t: Tables) -> DataFrame:
    titles = t.documents.groupBy(F.col("source").alias("document_id")).agg(
        F.max("lang").alias("title"), F.count("*").cast("string").alias("description")
    )
    return lifecycle.version_view(fr.labelled_versions(t), titles)


@check(
    "version_scope",
    f"""WITH {fr.VERSIONS_SQL} SELECT version_id, state, state = 'ACTIVE' AS searchable, state IN ('READY', 'ACTIVE') AS previewable
    FROM versions WHERE state IN ('INDEXING', 'READY', 'ACTIVE')""",
)
def _(t: Tables) -> DataFrame:
    versions = fr.labelled_versions(t)
    kept = validation.version_scope(versions, "retained").select("version_id", "state")
    seen = validation.version_scope(versions, "searchable").select("version_id", F.lit(True).alias("searchable"))
    shown = validation.version_scope(versions, "previewable").select("version_id", F.lit(True).alias("previewable"))
    joined = kept.join(seen, "version_id", "left").join(shown, "version_id", "left")
    return joined.fillna(False, ["searchable", "previewable"])


@check("active_version_ids", f"WITH {fr.VERSIONS_SQL} SELECT version_id FROM versions WHERE state = 'ACTIVE' ORDER BY version_id")
def _(t: Tables) -> DataFrame:
    return lifecycle.active_version_ids(fr.labelled_versions(t))


@check(
    "scope_by_documents",
    f"""WITH {fr.VERSIONS_SQL} SELECT version_id FROM versions WHERE state = 'ACTIVE'
    AND document_id IN (SELECT 'src'||n_nationkey FROM nation WHERE n_regionkey < 3) ORDER BY version_id""",
)
def _(t: Tables) -> DataFrame:
    listed = t.nation.where(F.col("n_regionkey") < 3).select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("document_id")
    )
    return lifecycle.scope_by_documents(fr.labelled_versions(t), listed)


@check(
    "active_uniqueness_violations",
    f"WITH {fr.VERSIONS_SQL} SELECT document_id, count(*) AS n FROM versions WHERE state = 'ACTIVE' GROUP BY document_id HAVING count(*) > 1",
)
def _(t: Tables) -> DataFrame:
    return validation.active_uniqueness_violations(fr.labelled_versions(t))


_POINTS_SQL = "points AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, 'v'||l_partkey AS version_id FROM lineitem)"


def points(t: Tables) -> DataFrame:
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), fr.version_id(F.col("l_partkey")).alias("version_id")
    )


@check(
    "delete_versions",
    f"WITH {_POINTS_SQL} SELECT point_id, version_id FROM points WHERE version_id NOT IN (SELECT 'v'||p_partkey FROM part WHERE p_size < 10)",
)
def _(t: Tables) -> DataFrame:
    gone = t.part.where(F.col("p_size") < 10).select(fr.version_id(F.col("p_partkey")).alias("version_id"))
    return sn.delete_versions(points(t), gone)


@check(
    "purge_points",
    f"""WITH RECURSIVE {fr.HISTORIES_SQL}, points AS (SELECT event_id AS point_id, 'd'||user_id||'-'||(CAST(json_extract_string(props, '$.k') AS INT) % 4) AS version_id FROM events)
    SELECT point_id, version_id FROM points WHERE version_id NOT IN (SELECT version_id FROM histories WHERE state IN ('ARCHIVED', 'FAILED'))""",
)
def _(t: Tables) -> DataFrame:
    log = fr.commands(t)
    queue = lifecycle.purge_queue(lifecycle.version_histories(log))
    return lifecycle.purge_points(log.select(F.col("pos").alias("point_id"), "version_id"), queue)


@check(
    "delete_counts",
    f"WITH {_POINTS_SQL}, cut AS (SELECT version_id IN (SELECT 'v'||p_partkey FROM part WHERE p_size < 10) AS gone FROM points)"
    " SELECT count(*) FILTER (gone) AS removed, count(*) FILTER (NOT gone) AS left FROM cut",
)
def _(t: Tables) -> DataFrame:
    gone = t.part.where(F.col("p_size") < 10).select(fr.version_id(F.col("p_partkey")).alias("version_id"))
    removed, left = delete_counted(points(t), gone, "version_id", shared_dir(t.spark, "kept"))
    return t.spark.createDataFrame([(removed, left)], "removed bigint, left bigint")
