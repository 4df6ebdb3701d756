from pyspark.sql import functions as F

from acervo.functions.vectors import hash_embedder
from acervo.functions.nested import nested_texts
from acervo.operators import audit
from acervo.plans import corpus as corpora


def found(df):
    return sorted((r["check"], r.subject, r.detail) for r in df.collect())


def test_contacts(spark):
    texts = [
        (1, "Escriba a ana@centro.example.invalid, o a pepe@correo.es."), (2, "Tel. +34 91 000 00 12 y +34 91 123 45 67."),
        (3, "Vea https://sede.example.invalid/a?b=1), http://localhost/x y (https://www.otro.es/ruta)."), (4, "Nada que ver."),
    ]
    pages = spark.createDataFrame(texts, "page int, text string")
    assert found(audit.scan_contacts(pages, "page")) == [
        ("contact", "1", "email:pepe@correo.es"), ("contact", "2", "phone:+34 91 123 45 67"), ("contact", "3", "url:https://www.otro.es/ruta")
    ]


def manifest(spark, **changes):
    tables = {
        "documents": [("m/v1", f"d{i}") for i in range(10)],
        "versions": [(f"d{i}", 0, f"v{i}", f"s{i}", f"f{i}", f"key-{i}") for i in range(10)] + [("d9", 1, "v10", "s10", "f10", "key-10")],
        "replacement": [("d9", "v9", "v10", True)],
        "conflicts": [("c1", "d1"), ("c1", "d2")],
    }
    tables.update(changes)
    schemas = {
        "documents": "manifest_schema string, document_id string",
        "versions": "document_id string, position int, version_id string, source string, file string, idempotency_key string",
        "replacement": "document_id string, previous_version_id string, current_version_id string, current_activates boolean",
        "conflicts": "conflict_id string, document_id string",
    }
    return audit.validate_manifest(**{n: spark.createDataFrame(rows, schemas[n]) for n, rows in tables.items()}, schema_tag="m/v1")


def test_manifest_rules(spark):
    good = [(f"d{i}", 0, f"v{i}", f"s{i}", f"f{i}", f"key-{i}") for i in range(9)]
    assert found(manifest(spark)) == []
    assert found(
        manifest(
            spark,
            documents=[("m/v1", f"d{i}") for i in range(9)] + [("m/v0", "d9")] + [("m/v1", "d10")],
            versions=good + [("d9", 0, "v1", "s1", "f9", "key-9"), ("d9", 1, "v9", "s9", "f9", "-bad")],
            replacement=[("d9", "v8", "v8", False), ("dx", "v9", "v9b", True)],
            conflicts=[("c1", "d1"), ("c1", "d1"), ("c2", "d1"), ("c3", "d1"), ("c3", "zz")],
        )
    ) == sorted(
        [
            ("schema", "m/v0", None), ("document_count", "11", None), ("duplicate_version_id", "v1", "2"), ("duplicate_file", "f9", "2"),
            ("invalid_idempotency_key", "v9", "-bad"), ("replacement_previous", "v8", None),
            ("replacement_current", "v8", None), ("replacement_same_version", "v8", None), ("replacement_not_active", "v8", None),
            ("replacement_document", "dx", None), ("replacement_previous", "v9", None), ("replacement_current", "v9b", None),
            ("conflict_same_document", "c1", None), ("conflict_claims", "c2", "1"), ("conflict_unknown_document", "c3", "zz"),
        ]
    )
    assert ("no_conflict", None, None) in found(manifest(spark, conflicts=[]))
    # A source may be used again by its own document's later versions, not elsewhere.
    again = good + [("d9", 0, "v9", "s9", "f9", "key-9"), ("d9", 1, "v10", "s9", "f10", "key-10")]
    assert found(manifest(spark, versions=again)) == []
    elsewhere = good + [("d9", 0, "v9", "s9", "f9", "key-9"), ("d9", 1, "v10", "s3", "f10", "key-10")]
    assert found(manifest(spark, versions=elsewhere)) == [("duplicate_source", "s3", "v10")]


def test_eval_set_rules(spark):
    schema = "question_id string, question string, expected_status string, expected_document_ids array<string>, expected_pages array<int>"
    documents = spark.createDataFrame([("d1",)], "document_id string")
    good = [(f"f{i}", "¿Qué?", "found", ["d1"], [1]) for i in range(5)] + [(f"n{i}", "¿Qué?", "not_found", [], []) for i in range(3)]
    good += [(f"a{i}", "¿Qué?", "ambiguous", ["d1"], [1]) for i in range(2)]
    assert found(audit.validate_eval_set(spark.createDataFrame(good, schema), documents)) == []
    bad = good[1:] + [
        ("x1", "¿Qué?", "maybe", [], []), ("x2", "¿Qué?", "found", ["d7"], [0]), ("x3", "¿Qué?", "not_found", ["d1"], []), ("x4", "¿e\N{COMBINING ACUTE ACCENT}?", "ambiguous", [], []),
        ("x5", "a\x07", "ambiguous", [], []),
    ]
    assert found(audit.validate_eval_set(spark.createDataFrame(bad, schema), documents)) == [
        ("not_found_with_documents", "x3", None), ("page_number", "x2", None), ("question_text", "x4", None), ("question_text", "x5", None),
        ("status", "x1", "maybe"), ("unknown_document", "x2", "d7"),
    ]
    assert ("too_few_questions", "found", "4") in found(audit.validate_eval_set(spark.createDataFrame(good[1:], schema), documents))


def test_source_consistency_and_conflicts(spark):
    inst = "struct<name:string,email:string,phone:string>"
    sources = spark.createDataFrame([("a", ("N", "e", "p")), ("b", ("N", None, "q"))], f"source string, institution {inst}")
    expected = spark.createDataFrame([("N", "e", "p", "a"), ("N", "e", "p", "b")], "expected_name string, expected_email string, expected_phone string, source string")
    assert found(audit.validate_source_consistency(sources, expected)) == [("institution_email", "b", None), ("institution_phone", "b", "q")]
    claims = spark.createDataFrame([("s1", "d1"), ("s1", "d2"), ("s2", "d1"), ("s2", "d1")], "subject string, document_id string")
    assert [tuple(r) for r in audit.find_conflicts(claims).collect()] == [("s1", 2, "d1", "d2")]


def uuid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def test_yearly_replacement(spark):
    tables = {
        "documents": spark.createDataFrame([(uuid(1), "uno"), (uuid(2), None)], "document_id string, description string"),
        "versions": spark.createDataFrame(
            [(uuid(1), 0, uuid(11), "Jornada 2025", "2025-2026", "a.pdf", "k1", True), (uuid(1), 1, uuid(12), "Jornada 2026", "2026-2027", "b.pdf", "k2", True),
             (uuid(2), 0, uuid(21), "Becas", "2026-2027", "c.pdf", "k3", True), (uuid(2), 1, uuid(22), "Becas", "2026-2027", "bad.pdf", "k4", True),
             (uuid(2), 2, uuid(23), "Becas", "2026-2028", "c.pdf", "k5", True)],
            "document_id string, position int, version_id string, title string, academic_year string, file string, idempotency_key string, activate boolean",
        ),
    }
    body = "%PDF-1.7\nHORARIO\nLas clases comienzan el día {} de septiembre.\fSegunda hoja del documento {}."
    files = spark.createDataFrame(
        [(f"/in/{n}.pdf", bytearray(body.format(i, i).encode() if n != "bad" else b"%PDF-\nx")) for i, n in enumerate(["a", "b", "c", "bad"])], "path string, content binary"
    ).withColumn("length", F.octet_length("content").cast("bigint"))
    ledger = spark.createDataFrame([], "idempotency_key string, request_hash string, job_id string")
    versions = spark.createDataFrame([], "version_id string, document_id string, academic_year string, content_hash string, state string")
    done, histories, points = corpora.replace_annual(tables, files, "/in", ledger, versions, hash_embedder(32), dims=32)
    assert {(r.version_id, r.state) for r in histories.collect()} == {
        (uuid(11), "ARCHIVED"), (uuid(12), "ACTIVE"), (uuid(21), "ACTIVE"), (uuid(22), "FAILED")
    }
    assert {(r.version_id, r.chunk_index, r.section) for r in points.collect()} == {
        (uuid(12), 0, "HORARIO"), (uuid(12), 1, None), (uuid(21), 0, "HORARIO"), (uuid(21), 1, None)
    }
    rows = {r.idempotency_key: (r.outcome, r.status, r.error_code) for r in done.ledger.collect()}
    assert rows == {
        "k1": ("new", "completed", None), "k2": ("new", "completed", None), "k3": ("new", "completed", None),
        "k4": ("new", "failed", "PDF_TEXT_NOT_FOUND"), "k5": ("rejected", "failed", "INDEXING_METADATA_INVALID"),
    }


def test_long_runs_are_scanned_in_linear_time(spark):
    import time

    runs = ["a" * 1_000_000, "a" * 500_000 + "@" + "b" * 500_000, "a.b@c.dd+e@f.gg x@y.z@w.v " + "q" * 1000, "http://" + "a." * 200_000]
    pages = spark.createDataFrame(list(enumerate(runs)), "id int, text string")
    started = time.time()
    found = audit.scan_contacts(pages, "id").collect()
    assert time.time() - started < 20
    assert sorted(r.detail for r in found if r.subject == "2") == ["email:+e@f.gg", "email:a.b@c.dd", "email:x@y.z"]


def test_missing_sources_are_told(spark):
    sources = spark.createDataFrame([("a", ("n", "e", "p"))], "source string, institution struct<name:string,email:string,phone:string>")
    expected = spark.createDataFrame([("a", "n", "e", "p"), ("lost", "n", "e", "p")], "source string, expected_name string, expected_email string, expected_phone string")
    assert [(r.check, r.subject) for r in audit.validate_source_consistency(sources, expected).collect()] == [("source_missing", "lost")]


def test_contacts_inside_nested_sources_are_found(spark):
    schema = "source string, institution struct<name:string,contacts:array<struct<kind:string,value:string>>>, extra map<string,array<string>>, n int"
    rows = [
        ("a.json", ("IES", [("mail", "escribe a x@real.es"), ("web", None), ("tel", "+34 912 345 678")]), {"notes": ["fine", "http://real.es/x"]}, 1),
        ("b.json", ("IES", None), None, 2), ("c.json", None, {"k": None}, 3),
    ]
    sources = spark.createDataFrame(rows, schema)
    texts = {(r.source, r.path): r.text for r in nested_texts(sources, "source").collect()}
    assert texts == {
        ("a.json", "institution.name"): "IES", ("a.json", "institution.contacts[0].kind"): "mail", ("a.json", "institution.contacts[0].value"): "escribe a x@real.es",
        ("a.json", "institution.contacts[1].kind"): "web", ("a.json", "institution.contacts[2].kind"): "tel", ("a.json", "institution.contacts[2].value"): "+34 912 345 678",
        ("a.json", "extra.notes[0]"): "fine", ("a.json", "extra.notes[1]"): "http://real.es/x", ("b.json", "institution.name"): "IES",
    }
    found = audit.scan_contacts(nested_texts(sources, "source"), "source")
    assert {(r.subject, r.detail) for r in found.collect()} == {("a.json", "email:x@real.es"), ("a.json", "url:http://real.es/x")}
    assert nested_texts(sources.select("source", "n"), "source").count() == 0
