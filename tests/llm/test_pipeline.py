import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from acervo.llm import bpe, decontamination, secrets, toxicity
from tests.llm.samples import documents, pairs, rows_of, words
from tests.llm.test_near_dedup import brute as brute_groups
from tests.llm.test_search import brute_matches
from tests.llm.test_spans import base_secrets


def test_run_equals_plain_python(spark, tmp_path):
    import random

    rng = random.Random(12)
    item = words(rng, 30)
    rows = [words(rng, rng.randint(30, 90)) for _ in range(120)]
    labels = []
    for k in range(0, 120, 4):
        rows[k] = rows[k] + " vilest rotten scum " + words(rng, 3)
    labels = [(k * 3 + 1, 1, int(k % 4 == 0)) for k in range(120)]
    rows += [rows[1], rows[2] + " end", words(rng, 20) + " " + item + " " + words(rng, 20), rows[3] + ' token = "deadbeefdeadbeef00"', "", None]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(5, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {r["doc_id"] for r in rows_of(toxicity.toxic_documents(stored, spark.read.parquet(f"{tmp_path}/labels.parquet"))) if r["predicted"]}
    assert len(toxic & {d for d, _, t in labels if t}) >= 25 and not toxic & {d for d, _, t in labels if not t}
    left = [(d, t) for d, t in pairs(stored) if d not in toxic]
    kept = {d for d, _, _, k in brute_groups(left) if k and d is not None}
    left = {d: t for d, t in left if d in kept} | {d: t for d, t in left if d is None}
    dirty = {d for d, _, _ in brute_matches(list(left.items()), [(5, item)])}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for doc, text in left.items():
        if doc not in dirty:
            spans, text = base_secrets(text or ""), text or ""
            if spans:
                text = secrets.redact(text.encode(), [(len(text[:s].encode()), len(text[:e].encode())) for s, e, _ in spans]).decode()
            want[doc] = library.encode_ordinary(text)
    got = {r["doc_id"]: r for r in rows_of(corpus_pipeline.run(spark, str(tmp_path)))}
    assert {d: r["ids"] for d, r in got.items()} == want
    assert all(r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r["ids"])).hexdigest() for r in got.values())
    assert len(dirty) == 1 and decontamination.RADIUS


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = documents(spark)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
