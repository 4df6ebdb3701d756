import numpy as np
import pytest
from pyspark.sql import functions as F

from acervo.operators import models, validation


class Refused(Exception):
    def __init__(self, code=None, status=None):
        self.code, self.status = code, status


def test_retry_only_transient_failures():
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise Refused(code="ECONNRESET")
        return "ok"

    assert models.with_retry(flaky, sleep=slept.append) == "ok" and slept == [0.25, 0.5, 1.0]
    for problem, tries in ((Refused(status=503), 4), (Refused(status=429), 4), (TimeoutError(), 4), (Refused(status=400), 1), (ValueError(), 1)):
        calls.clear()

        def fail():
            calls.append(1)
            raise problem

        with pytest.raises(type(problem)):
            models.with_retry(fail, sleep=lambda s: None)
        assert len(calls) == tries


def test_cause_is_looked_at_once():
    outer, inner, deep = ValueError(), RuntimeError(), Refused(code="EPIPE")
    inner.__cause__ = deep
    outer.__cause__ = inner
    assert models.transient(inner) and not models.transient(outer)


def test_batches_and_failures(spark):
    def embedder():
        def embed(texts):
            assert len(texts) <= 4
            if "bad" in texts:
                raise ValueError("no")
            return np.full((len(texts), 3), len(texts), dtype=float)

        return embed

    rows = spark.createDataFrame([(i, "bad" if i == 5 else "x") for i in range(10)], "i int, text string").coalesce(1)
    out = {r.i: r for r in models.embed_documents(rows, embedder, batch_size=4, dims=3).collect()}
    assert [out[i].embed_error for i in range(10)] == [None] * 5 + ["EMBEDDING_GENERATION_FAILED"] + [None] * 4
    assert out[0].vector == [4.0] * 3 and out[9].vector == [2.0] * 3 and out[5].vector is None
    other = models.embed_documents(rows.where("text = 'x'"), embedder, dims=7).select("embed_error").distinct().collect()
    # The batch is too large for this model, which takes the texts one by one.
    assert [r.embed_error for r in other] == ["VECTOR_DIMENSION_MISMATCH"]
    small = models.embed_documents(rows.where("i < 4"), embedder, batch_size=4, dims=7).select("embed_error").distinct().collect()
    assert [r.embed_error for r in small] == ["VECTOR_DIMENSION_MISMATCH"]


def test_one_repair_attempt(spark, tmp_path):
    folder = str(tmp_path)

    def decider():
        import os

        def decide(prompt, message):
            # Each message is answered badly the first time; "never" always.
            seen = os.path.join(folder, message)
            if message == "never" or not os.path.exists(seen):
                open(seen, "a").write("x")
                return "eso no es JSON"
            return '{"status":"found","answer":"sí","citedChunkIds":["c1"]}'

        return decide

    contexts = spark.createDataFrame([("q1", "once", ["c1"]), ("q2", "never", ["c1"])], "question_id string, message string, retrieved array<string>")
    rows = {r.question_id: r for r in models.decide(contexts, decider).collect()}
    assert (rows["q1"].status, rows["q1"].answer, rows["q1"].error_code) == ("found", "sí", None)
    assert (rows["q2"].status, rows["q2"].answer, rows["q2"].error_code) == (None, None, "MODEL_OUTPUT_INVALID")


def test_decision_rules(spark):
    cases = [
        ('{"status":"found","answer":"a","citedChunkIds":["c1","c1"]}', True), ('{"status":"found","answer":"a","citedChunkIds":["c9"]}', False),
        ('{"status":"found","answer":"","citedChunkIds":["c1"]}', False), ('{"status":"found","answer":null,"citedChunkIds":["c1"]}', False),
        ('{"status":"found","answer":"a","citedChunkIds":[]}', False), ('{"status":"found","answer":"a"}', False),
        ('{"status":"not_found","answer":null,"citedChunkIds":[]}', True), ('{"status":"ambiguous","answer":null,"citedChunkIds":[]}', True),
        ('{"status":"not_found","citedChunkIds":[]}', False), ('{"status":"not_found","answer":null,"citedChunkIds":["c1"]}', False),
        ('{"status":"other","answer":null,"citedChunkIds":[]}', False), ('{"status":1,"answer":null,"citedChunkIds":[]}', False),
        ("[]", False), ("texto", False), (None, False), ('```JSON\n{"status":"ambiguous","answer":null,"citedChunkIds":[]}\n```', True),
    ]
    df = spark.createDataFrame([(i, raw, ["c1", "c2"]) for i, (raw, _) in enumerate(cases)], "i int, raw string, retrieved array<string>")
    rows = sorted(validation.validate_decisions(df).collect())
    assert [r.error_code is None for r in rows] == [ok for _, ok in cases]
    assert rows[0].cited_chunk_ids == ["c1", "c1"]


def test_transient_column(spark):
    cause = "struct<name:string,code:string,status:int>"
    df = spark.createDataFrame(
        [(1, ("TimeoutError", None, None, None)), (2, (None, None, 404, (None, "EPIPE", None))), (3, (None, None, 404, None)), (4, (None, None, 500, None))],
        f"i int, e struct<name:string,code:string,status:int,cause:{cause}>",
    )
    assert [r.t for r in df.orderBy("i").select(validation.is_transient_error(F.col("e")).alias("t")).collect()] == [True, True, False, True]


def test_passing_failures_as_python_raises_them():
    import errno
    import socket

    class Response:
        status_code = 503

    class HttpError(Exception):
        response = Response()

    for problem in (ConnectionRefusedError(), ConnectionResetError(), BrokenPipeError(), socket.gaierror(), TimeoutError(), OSError(errno.ETIMEDOUT, "late"), HttpError()):
        assert models.transient(problem), problem
    for problem in (ValueError(), OSError(errno.ENOENT, "none"), FileNotFoundError(), None):
        assert not models.transient(problem)


def test_outage_is_told_apart_and_not_asked_again(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def decider():
        def reply(_prompt, message):
            with open(calls, "a") as log:
                log.write(message + "\n")
            if message == "down":
                raise ValueError("no model")
            return "not json"

        return reply

    contexts = spark.createDataFrame([("q1", "down", ["a"]), ("q2", "bad", ["a"])], "question_id string, message string, retrieved array<string>").coalesce(1)
    decided = models.decide(contexts, decider)
    for _ in range(2):  # a second reader repeats no call
        assert {r.question_id: r.error_code for r in decided.collect()} == {"q1": "MODEL_UNAVAILABLE", "q2": "MODEL_OUTPUT_INVALID"}
    assert sorted(open(calls).read().split()) == ["bad", "bad", "down"]


def test_an_outage_fails_one_document(spark):
    calls = []

    def model(texts):
        calls.append(list(texts))
        if "poison" in texts:
            raise TimeoutError("no answer")
        if "refused" in texts:
            raise ValueError("bad")
        return [[float(len(t))] for t in texts]

    texts = ["a", "bb", "poison", "ccc", "dd", "refused", "e"]
    owners = ["d1", "d1", "d2", "d2", "d3", "d3", "d4"]
    found = models._vectors(model, texts, owners, 1, (0.0,))
    assert [e for _, e in found] == [None, None, "EMBEDDING_GENERATION_FAILED", "EMBEDDING_GENERATION_FAILED", None, "EMBEDDING_GENERATION_FAILED", None]
    assert [v[0] for v, e in found if e is None] == [1.0, 2.0, 2.0, 1.0]


def test_documents_are_packed_whole():
    owners = ["a"] * 3 + ["b"] * 4 + ["c"] * 20 + ["d"] + ["a"]
    batches = models.packed(owners, 8)
    assert sorted(k for batch in batches for k in batch) == list(range(len(owners))) and all(len(b) <= 8 for b in batches)
    for name in "abd":
        assert sum(any(owners[k] == name for k in batch) for batch in batches) == 1
    assert models.packed([], 8) == [] and models.packed([None, None], 8) == [[0, 1]]


def test_python_tasks_get_batches_of_few_bytes(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from acervo.functions.vectors import hash_embedder
    from acervo.operators import models

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(4000, numPartitions=1).select("id", F.repeat(F.lit("x"), 4000).alias("text"))
    embedded = models.embed_documents(texts, hash_embedder(8), dims=8)
    found = [r.n for r in embedded.mapInArrow(sizes, "n bigint").collect()]
    # 16 MB in all, which used to be one batch.
    assert sum(found) > 16_000_000 and max(found) < 5_000_000
