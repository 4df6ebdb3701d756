import random

from pyspark.sql import functions as F

from acervo.operators import lifecycle, validation

SCHEMA = "pos long, document_id string, version_id string, command string"

# Commands that take a version from a state (row) to another one; the rest are rejected.
_MOVES = {
    ("index_succeeded", "INDEXING"): "READY",
    ("index_failed", "INDEXING"): "FAILED",
    ("activate", "READY"): "ACTIVE",
}
_REPEATS = {("index_succeeded", "READY"), ("index_failed", "FAILED"), ("activate", "ACTIVE"), ("archive", "ARCHIVED")}


def next_state(command: str, before: str) -> tuple[str, str]:
    """(state after, outcome) of a command on a version in state ``before``."""
    if command == "index_started":
        return ("INDEXING", "accepted") if before == "NONE" else (before, "no_op")
    if before == "NONE":
        return before, "VERSION_NOT_FOUND"
    if (command, before) in _REPEATS:
        return before, "no_op"
    if command == "archive":
        return "ARCHIVED", "accepted"
    after = _MOVES.get((command, before))
    if after is None:
        return before, "VERSION_NOT_READY" if command == "activate" else "INVALID_TRANSITION"
    return after, "accepted"


def sequential(log):
    """The state machine one command at a time, over all documents."""
    versions, outcomes = {}, []
    for pos, document, version, command in sorted(log):
        owner, before = versions.get(version, (None, "NONE"))
        if command == "index_started" and owner not in (None, document):
            outcomes.append((pos, before, "VERSION_CONFLICT"))
            continue
        if before != "NONE" and command in ("activate", "archive") and owner != document:
            outcomes.append((pos, before, "VERSION_NOT_FOUND"))
            continue
        after, outcome = next_state(command, before)
        if outcome == "accepted":
            if after == "ACTIVE":
                for other, (d, s) in list(versions.items()):
                    if d == owner and s == "ACTIVE":
                        versions[other] = (d, "ARCHIVED")
            versions[version] = (owner or document, after)
        outcomes.append((pos, before, outcome))
    return versions, outcomes


def random_log(seed, n=1500, documents=6, versions=40, hot=0.0):
    rng = random.Random(seed)
    log = []
    for pos in range(n):
        v = 0 if rng.random() < hot else rng.randrange(versions)
        document = v % documents if rng.random() < 0.9 else rng.randrange(documents)
        log.append((pos, f"d{document}", f"v{v}", rng.choice(lifecycle.COMMANDS)))
    return log


def check_log(spark, log):
    commands = spark.createDataFrame(log, SCHEMA).repartition(5)
    versions, outcomes = sequential(log)
    folded = sorted((r.pos, r.before, r.outcome) for r in lifecycle.fold_lifecycle(commands).collect())
    assert folded == sorted(outcomes)
    histories = lifecycle.version_histories(commands).collect()
    assert {r.version_id: (r.document_id, r.state) for r in histories} == versions
    return spark.createDataFrame([(r.document_id, r.version_id, r.state) for r in histories], "document_id string, version_id string, state string")


def test_fold_equals_sequential(spark):
    for seed in range(3):
        versions = check_log(spark, random_log(seed))
        assert validation.active_uniqueness_violations(versions).count() == 0


def test_fold_with_a_hot_version_and_few_documents(spark):
    check_log(spark, random_log(7, hot=0.4, documents=2, versions=30))


def test_rules(spark):
    log = [
        (1, "d", "a", "activate"), (2, "d", "a", "index_started"), (3, "d", "a", "activate"), (4, "d", "a", "index_succeeded"),
        (5, "d", "a", "index_succeeded"), (6, "d", "a", "index_failed"), (7, "d", "a", "activate"), (8, "d", "a", "activate"),
        (9, "d", "b", "index_started"), (10, "d", "b", "index_succeeded"), (11, "x", "b", "activate"), (12, "d", "b", "activate"),
        (13, "d", "a", "archive"), (14, "d", "a", "index_succeeded"), (15, "d", "b", "archive"), (16, "d", "b", "archive"),
    ]
    rows = {r.pos: (r.before, r.outcome) for r in lifecycle.fold_lifecycle(spark.createDataFrame(log, SCHEMA)).collect()}
    assert rows == {
        1: ("NONE", "VERSION_NOT_FOUND"), 2: ("NONE", "accepted"), 3: ("INDEXING", "VERSION_NOT_READY"), 4: ("INDEXING", "accepted"),
        5: ("READY", "no_op"), 6: ("READY", "INVALID_TRANSITION"), 7: ("READY", "accepted"), 8: ("ACTIVE", "no_op"),
        9: ("NONE", "accepted"), 10: ("INDEXING", "accepted"), 11: ("READY", "VERSION_NOT_FOUND"), 12: ("READY", "accepted"),
        13: ("ARCHIVED", "no_op"), 14: ("ARCHIVED", "INVALID_TRANSITION"), 15: ("ACTIVE", "accepted"), 16: ("ARCHIVED", "no_op"),
    }
    queue = lifecycle.purge_queue(lifecycle.version_histories(spark.createDataFrame(log, SCHEMA))).collect()
    assert {(r.version_id, r.requested_at) for r in queue} == {("a", 12), ("b", 15)}


def test_preview_scope(spark):
    versions = spark.createDataFrame(
        [("d1", "a1", "ACTIVE"), ("d1", "a2", "READY"), ("d2", "b1", "ACTIVE"), ("d2", "b2", "FAILED"), ("d3", "c1", "READY")],
        "document_id string, version_id string, state string",
    )
    candidates = spark.createDataFrame(
        [("d1", "a2"), ("d1", "a1"), ("d2", "b2"), ("d1", "b1"), ("d3", "c1"), ("d3", "zz")], "document_id string, version_id string"
    )
    rows = {(r.document_id, r.version_id): (r.error_code, r.hidden_version_id, r.scope_size) for r in lifecycle.preview_scope(candidates, versions).collect()}
    assert rows == {
        ("d1", "a2"): (None, "a1", 2), ("d1", "a1"): (None, None, 2), ("d2", "b2"): ("VERSION_NOT_PREVIEWABLE", None, None),
        ("d1", "b1"): ("VERSION_NOT_FOUND", None, None), ("d3", "c1"): (None, None, 3), ("d3", "zz"): ("VERSION_NOT_FOUND", None, None),
    }


def test_scopes(spark):
    versions = spark.createDataFrame(
        [("d1", "b", "ACTIVE"), ("d2", "a", "ACTIVE"), ("d3", "c", "READY")], "document_id string, version_id string, state string"
    )
    assert [r.version_id for r in lifecycle.active_version_ids(versions).collect()] == ["a", "b"]
    listed = spark.createDataFrame([("d1",), ("d3",), ("d9",)], "document_id string")
    assert [r.version_id for r in lifecycle.scope_by_documents(versions, listed).collect()] == ["b"]
    titles = spark.createDataFrame([("d1", "uno", None)], "document_id string, title string, description string")
    assert [(r.version_id, r.title) for r in lifecycle.version_view(versions, titles).collect()] == [("b", "uno")]
    assert lifecycle.active_version_ids(versions.where(F.lit(False))).count() == 0
