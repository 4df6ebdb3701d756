import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.functions import bloom, vectors
from acervo.operators import retrieval
from acervo.plans import ask as asking
from acervo.sources import snapshots

FORMS = [{}, {"question_block": 7}, {"question_block": 7, "max_tasks": 1}]


def brute(questions, points, k, threshold):
    out = set()
    for q, qv in questions:
        scored = []
        for p, pv in points:
            norm = np.linalg.norm(qv) * np.linalg.norm(pv)
            scored.append((-round(float(np.dot(qv, pv) / norm), 6) if norm else 0.0, p))
        kept = [s for s in sorted(scored) if -s[0] >= threshold][:k]
        out |= {(q, p, -s, i + 1) for i, (s, p) in enumerate(kept)}
    return out


def frame(spark, name, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} string, vector array<float>").repartition(5)


@pytest.mark.parametrize("options", FORMS)
@pytest.mark.parametrize("threshold", [-1.0, 0.35])
def test_topk_equals_brute_force(spark, options, threshold):
    rng = np.random.default_rng(3)
    points = [(f"p{i:03}", rng.integers(-3, 4, 8)) for i in range(120)]
    # A third of the points are copies of one, so that ties decide.
    points += [(f"c{i:03}", points[5][1]) for i in range(60)]
    questions = [(f"q{i:02}", rng.integers(-3, 4, 8)) for i in range(20)] + [("same", points[5][1]), ("zero", np.zeros(8))]
    hits = retrieval.vector_topk(frame(spark, "question_id", questions), frame(spark, "point_id", points), 6, threshold, **options)
    assert {(r.question_id, r.point_id, round(r.score, 6) + 0.0, r["rank"]) for r in hits.collect()} == brute(questions, points, 6, threshold)


@pytest.mark.parametrize("options", FORMS)
def test_empty_sides_give_no_hits(spark, options):
    some = [("a", [1, 0]), ("b", [0, 1])]
    q, p = frame(spark, "question_id", some), frame(spark, "point_id", some)
    assert retrieval.vector_topk(q, p.where(F.lit(False)), **options).count() == 0
    assert retrieval.vector_topk(q.where(F.lit(False)), p, **options).count() == 0


def test_vectors_of_another_size_and_nulls_are_refused(spark):
    good = frame(spark, "question_id", [("q", [1, 0])])
    ragged = frame(spark, "point_id", [("a", [1]), ("b", [0, 1, 1])])
    null = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "point_id string, vector array<float>")
    hollow = spark.createDataFrame([("a", [1.0, None])], "point_id string, vector array<float>")
    for points in (ragged, null, hollow):
        with pytest.raises(Exception, match=retrieval.MISFIT):
            retrieval.vector_topk(good, points).collect()
    with pytest.raises(ValueError, match=retrieval.MISFIT):
        retrieval.vector_topk(frame(spark, "question_id", [("q", [1, 0]), ("r", [1])]), frame(spark, "point_id", [("a", [1, 0])]))


def shown_plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as told:
        df.explain()
    return told.getvalue()


@pytest.mark.parametrize("held_bytes", [0, 3000, 1 << 20])
def test_blocks_beyond_memory_are_read_again(spark, monkeypatch, held_bytes):
    monkeypatch.setattr(retrieval, "HELD_BYTES", held_bytes)
    monkeypatch.setattr(retrieval, "CHUNK_BYTES", 2000)
    rng = np.random.default_rng(5)
    points = [(f"p{i:03}", rng.integers(-3, 4, 8)) for i in range(300)]
    questions = [(f"q{i:03}", rng.integers(-3, 4, 8)) for i in range(100)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        hits = retrieval.vector_topk(frame(spark, "question_id", questions), frame(spark, "point_id", points), 4, 0.1, question_block=9)
        assert {(r.question_id, r.point_id, round(r.score, 6) + 0.0, r["rank"]) for r in hits.collect()} == brute(questions, points, 4, 0.1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_scan_of_points_for_any_number_of_questions(spark, tmp_path):
    rng = np.random.default_rng(6)
    frame(spark, "point_id", [(f"p{i}", rng.normal(size=4)) for i in range(50)]).write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    questions = frame(spark, "question_id", [(f"q{i}", rng.normal(size=4)) for i in range(60)])
    plan = shown_plan(retrieval.vector_topk(questions, points, question_block=2))
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1 and "Union" not in plan
    # The points are searched where they are scanned: the only exchange deals out hits.
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")


def test_payload_of_many_hits(spark, monkeypatch, tmp_path):
    points = spark.createDataFrame([(f"p{i}", f"text {i}", [1.0]) for i in range(500)], "point_id string, text string, vector array<float>")
    hits = spark.createDataFrame([(f"q{i}", f"p{i * 7}", 0.5, 1) for i in range(60)], "question_id string, point_id string, score double, rank int")
    want = sorted((r.question_id, r.point_id, f"text {r.point_id[1:]}") for r in hits.collect())
    for few in (1000, 10):
        monkeypatch.setattr(retrieval, "FEW_HITS", few)
        full = retrieval.with_payload(hits, points)
        assert "vector" not in full.columns
        assert sorted((r.question_id, r.point_id, r.text) for r in full.collect()) == want
    # Without a broadcast, only points that may be hit reach the exchange ...
    monkeypatch.setattr(retrieval, "FEW_HITS", 10)
    points.write.parquet(str(tmp_path / "points"))
    stored = spark.read.parquet(str(tmp_path / "points"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filtered = [line for line in shown_plan(retrieval.with_payload(hits, stored)).splitlines() if "Filter" in line and "subquery" in line.lower()]
        assert filtered
        # ... and points bucketed by their id are not shuffled at all.
        snapshots.save_bucketed(stored, "payload_by_point", 4, str(tmp_path / "bucketed"), key="point_id")
        monkeypatch.setattr(retrieval, "FEW_HITS", 1000)
        plan = shown_plan(retrieval.with_payload(hits, spark.table("payload_by_point")))
        # The one exchange is that of the hits, which come before the points in the plan.
        assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("text#", plan.index("FileScan"))
        assert "text" not in plan[plan.index("Exchange") :].split("FileScan")[1].split("ReadSchema")[1].splitlines()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS payload_by_point")


def test_bloom_filter_loses_no_key(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 3)] + [(None,)], "key string")
    asked = spark.createDataFrame([(f"k{i}", i) for i in range(3000)] + [(None, -1)], "asked string, i int")
    for bits, most in ((bloom.BITS, 1010), (1 << 14, 1200), (64, 3000)):
        passed = {r.i for r in asked.where(bloom.might_contain(keys, "key", F.col("asked"), bits)).collect()}
        assert set(range(0, 3000, 3)) <= passed and len(passed) <= most and -1 not in passed
    assert asked.where(bloom.might_contain(keys.where("key = 'none'"), "key", F.col("asked"))).count() == 0


def test_scope_keeps_only_listed_versions(spark):
    points = spark.createDataFrame([("p1", "v1"), ("p2", "v2"), ("p3", "v1")], "point_id string, version_id string")
    one = spark.createDataFrame([("v1",), ("v9",)], "version_id string")
    assert {r.point_id for r in retrieval.search_scope(points, one).collect()} == {"p1", "p3"}
    assert retrieval.search_scope(points, one.where(F.lit(False))).count() == 0


def test_hash_embedding_repeats_and_is_unit_length():
    embed = vectors.hash_embedder(100)()
    a, b = embed(["hola", "hola"])
    assert np.array_equal(a, b) and np.isclose(np.linalg.norm(a), 1) and np.allclose(a[:32], a[32:64])


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    row = df.select(
        vectors.cosine(F.col("a"), F.col("b")).alias("ab"), vectors.cosine(F.col("a"), F.col("z")).alias("az"),
        vectors.l2_normalize(F.col("a")).alias("ua"), vectors.l2_normalize(F.col("z")).alias("uz"),
    ).first()
    assert row.ab == pytest.approx(0.96) and row.az == 0.0 and row.ua == pytest.approx([0.6, 0.8]) and row.uz == [0.0, 0.0]


TEXTS = {
    ("d1", "a1"): "El plazo ordinario para entregar la solicitud termina en marzo.",
    ("d2", "b1"): "El comedor abre de lunes a viernes y cuesta cinco euros.",
    ("d3", "c1"): "La biblioteca presta libros durante quince días.",
    ("d1", "a2"): "El plazo ordinario para entregar la solicitud termina en abril.",
}
STATES = {"a1": "ACTIVE", "b1": "ACTIVE", "c1": "READY", "a2": "READY"}
EMBEDDER = vectors.hash_embedder(32)


def corpus(spark):
    embed = EMBEDDER()
    rows = [
        (f"p-{v}", d, v, f"Título {d}", "2026-2027", 1, None, 0, "h", t, [float(x) for x in embed([t])[0]]) for (d, v), t in TEXTS.items()
    ]
    points = spark.createDataFrame(
        rows,
        "point_id string, document_id string, version_id string, document_title string, academic_year string, page int, "
        "section string, chunk_index int, content_hash string, text string, vector array<float>",
    )
    versions = spark.createDataFrame([(d, v, STATES[v]) for d, v in TEXTS], "document_id string, version_id string, state string")
    return points, versions


def test_ask_end_to_end(spark):
    points, versions = corpus(spark)
    questions = spark.createDataFrame(
        [("plazo", " ¿Cuándo termina el plazo ordinario? "), ("viaje", "¿Cuánto cuesta el viaje de esquí?"), ("libros", "¿Cuántos días presta libros la biblioteca?"),
         ("vacía", "   "), ("control", "hola\x07 mundo"), ("larga", "x" * 1001), ("palabras", "¿qué es?")],
        "question_id string, question string",
    )
    rows = {r.question_id: r for r in asking.ask(questions, points, versions, EMBEDDER, threshold=0.0).collect()}
    assert len(rows) == 7
    assert rows["plazo"].status == "found" and rows["plazo"].answer == TEXTS["d1", "a1"]
    (citation,) = rows["plazo"].citations
    assert (citation.document_id, citation.version_id, citation.page, citation.excerpt) == ("d1", "a1", 1, TEXTS["d1", "a1"])
    # The only chunk about books belongs to a version that is not active.
    for name in ("viaje", "libros"):
        assert (rows[name].status, rows[name].answer, rows[name].citations) == ("not_found", None, [])
    assert rows["palabras"].status == "ambiguous" and rows["palabras"].citations == []
    for name in ("vacía", "control", "larga"):
        assert (rows[name].status, rows[name].error_code) == ("error", "QUESTION_INVALID")


def test_ask_with_nothing_active(spark):
    points, versions = corpus(spark)
    questions = spark.createDataFrame([("q", "¿Cuándo termina el plazo?")], "question_id string, question string")
    (row,) = asking.ask(questions, points, versions.withColumn("state", F.lit("READY")), EMBEDDER).collect()
    assert (row.status, row.answer, row.citations, row.retrieved) == ("not_found", None, [], [])


def test_preview_sees_the_candidate_in_place_of_its_sibling(spark):
    points, versions = corpus(spark)
    questions = spark.createDataFrame(
        [("own", "¿Cuándo termina el plazo ordinario?", "d1", "a2"), ("other", "¿Cuándo termina el plazo ordinario?", "d3", "c1"),
         ("books", "¿Cuántos días presta libros la biblioteca?", "d3", "c1"), ("bad", "¿Cuándo?", "d2", "a2")],
        "question_id string, question string, document_id string, version_id string",
    )
    candidates = questions.select("document_id", "version_id").distinct()
    rows = {r.question_id: r for r in asking.preview(questions, candidates, points, versions, EMBEDDER, threshold=0.0).collect()}
    assert rows["own"].answer == TEXTS["d1", "a2"] and set(rows["own"].retrieved) == {"p-a2", "p-b1"}
    assert rows["other"].answer == TEXTS["d1", "a1"] and set(rows["other"].retrieved) == {"p-a1", "p-b1", "p-c1"}
    assert rows["books"].answer == TEXTS["d3", "c1"]
    assert (rows["bad"].status, rows["bad"].error_code) == ("error", "VERSION_NOT_FOUND")


def test_few_pairs_are_scored_and_no_bound_is_too_low():
    embed = vectors.hash_embedder(64)()
    rng = np.random.default_rng(8)
    for unit in (embed([str(i) for i in range(5000)]), rng.normal(size=(5000, 16))):
        rows = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        bounds = retrieval._Bounds.chosen(rows[:300], rows, 6, 0.35)
        low = bounds(rows)
        slack = retrieval._SLACK * (2 + low.shape[1])
        assert (low[:300] @ low.T + slack >= rows[:300] @ rows.T).all()
        block = retrieval._Block.__new__(retrieval._Block)
        block.matrix, block.bound, block.masks, block.best = rows[:300], None, None, None
        exact = np.round(rows[:300] @ rows.T, retrieval.SCORE_DECIMALS)
        block.floor = np.sort(exact, axis=1)[:, -6]
        points = retrieval._Points.__new__(retrieval._Points)
        points.unit, points.low = rows, low
        found = list(block._next(points, slice(0, 5000), block.floor, block.bounded(bounds), slack))
        assert sum(len(q) for q, _, _ in found) == (exact >= block.floor[:, None]).sum() < 300 * 10


def test_points_of_many_partitions_are_searched_in_few_tasks(spark):
    rng = np.random.default_rng(9)
    points = [(f"p{i:03}", rng.integers(-3, 4, 8)) for i in range(200)]
    questions = [(f"q{i:02}", rng.integers(-3, 4, 8)) for i in range(30)]
    cores = spark.sparkContext.defaultParallelism
    p = frame(spark, "point_id", points).repartition(5 * cores + 3)
    hits = retrieval.vector_topk(frame(spark, "question_id", questions), p, 6, 0.1)
    assert f"Coalesce {cores}" in shown_plan(hits)
    assert {(r.question_id, r.point_id, round(r.score, 6) + 0.0, r["rank"]) for r in hits.collect()} == brute(questions, points, 6, 0.1)


@pytest.mark.parametrize("n", [3, 40, 700, 9000])
@pytest.mark.parametrize("masked", [False, True])
def test_first_floors_are_high_and_never_too_high(n, masked):
    rng = np.random.default_rng(10)
    rows = rng.normal(size=(n + 100, 12))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    block, points = retrieval._Block.__new__(retrieval._Block), retrieval._Points.__new__(retrieval._Points)
    block.matrix, block.floor = rows[:100], np.full(100, -1.0)
    points.unit, points.code, points.shared = rows[100:], rng.integers(0, 5, n), rng.random(n) < 0.5
    block.masks = (rng.integers(0, 5, 100), rng.integers(0, 5, 100)) if masked else None
    bounds = retrieval._Bounds.chosen(block.matrix, points.unit, 6, -1.0)
    points.low = bounds(points.unit)
    floor = block._first(points, bounds(block.matrix), 6)
    exact = np.round(block.matrix @ points.unit.T, retrieval.SCORE_DECIMALS)
    if masked:
        exact[~block._seen(points, np.arange(100)[:, None], np.arange(n)[None, :])] = -np.inf
    kth = np.sort(exact, axis=1)[:, -6] if n >= 6 else np.full(100, -1.0)
    assert (floor <= np.maximum(kth, -1.0) + 1e-9).all()
    if n >= 700:
        # Few points reach it.
        assert np.median((exact >= floor[:, None]).sum(axis=1)) < 60


def test_a_question_whose_points_give_no_floor_finds_them_all():
    # Only the last of many groups of points may be seen.
    rng = np.random.default_rng(11)
    unit = rng.normal(size=(5000, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    block, points = retrieval._Block.__new__(retrieval._Block), retrieval._Points.__new__(retrieval._Points)
    block.matrix, block.floor, block.best, block.bound, block.raised = unit[:20], np.full(20, -1.0), None, None, False
    block.masks = np.zeros(20, np.int64), np.zeros(20, np.int64)
    points.unit, points.ids = unit, np.arange(5000)
    points.code, points.shared = np.ones(5000, np.int64), np.arange(5000) >= 4990
    bounds = retrieval._Bounds.chosen(unit[:20], unit, 6, -1.0)
    points.low = bounds(unit)
    q, scores, ids = block.scan(points, 6, bounds)
    exact = np.round(unit[:20] @ unit.T, retrieval.SCORE_DECIMALS)
    want = {(i, p) for i in range(20) for p in sorted(range(4990, 5000), key=lambda p: (-exact[i, p], p))[:6]}
    assert set(zip(q.tolist(), ids.tolist())) == want


def test_decider_counts_each_word_without_splitting_by_a_pattern(spark):
    from acervo.functions import text as tx
    from acervo.operators import answering

    odd = ["", " ", "a b", ".a,,b;", "¿Plazo?¡Marzo!(x:y)", "un　dos tres﻿cua\u0085tro", "\n\t\v\f\r", "İstanbul ΣΑΣ straße", None, "plazo plazo PLAZO"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    for row in rows.select(tx.tokenize(F.col("t")).alias("a"), F.filter(tx.split_words(F.col("t")), lambda w: w != "").alias("b")).collect():
        assert row.a == row.b
    contexts = spark.createDataFrame(
        [("q1", "plazo plazo marzo euros", ["El plazo, en marzo.", "¡Plazo! ¿Euros?"]), ("q2", "comedor", [None, "EL COMEDOR;abre"])],
        "question_id string, question string, texts array<string>",
    ).select("question_id", "question", F.transform("texts", lambda t, i: F.struct(t.alias("text"), i.cast("string").alias("point_id"))).alias("context"))
    decided = answering.lexical_decider(contexts)
    assert "array_intersect" in shown_plan(decided)
    got = {r.question_id: r.raw for r in decided.collect()}
    # Three of four words each, with "plazo" twice: a tie.
    assert '"ambiguous"' in got["q1"] and '"found"' in got["q2"] and '"citedChunkIds":["1"]' in got["q2"]
