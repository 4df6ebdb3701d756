"""Small tables for the training-data operators, with the cases that tables hold in practice."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node bigint, block string"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts(seed=1):
    """Plain, near and exact copies, shared passages, odd characters, blanks, one long text, and nulls."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(30, 120)) for _ in range(12)]
    shared = words(rng, 60)
    out = list(base)
    out += [base[0], base[0], base[1].upper(), base[2] + "\n"]
    for text in base[:6]:
        w = text.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
        w[len(w) // 3] = "again"
        out.append(" ".join(w))
    out += [words(rng, 40) + " " + shared + " " + words(rng, 40) for _ in range(5)]
    out += ["", " \n\t", "one", "two words", "a b c d", "a b c d e", None, None, "é" * 300, "日本語 テキスト " * 40, "x" * 900, "😀 it's <|endoftext|> we're\x00\x85 done  "]
    out.append(" ".join(words(rng, 50) for _ in range(60)))
    return out


def documents(spark, rows=None):
    """Documents with further columns whose names clash with operators' own, a row without doc_id, and a repeated row."""
    rows = texts() if rows is None else rows
    data = [(k * 3 + 1, t, None if k % 5 else "en", f"src{k % 3}", len(t or ""), 0.5, k, "b") for k, t in enumerate(rows)]
    if rows:
        data += [data[min(4, len(data) - 1)], (None, rows[min(5, len(rows) - 1)], None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def nulls_last(value):
    return (value is None, value)


__all__ = ["F", "documents", "empty", "nulls_last", "pairs", "rows_of", "texts", "words"]
