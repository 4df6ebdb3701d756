"""Personal data: four fixed patterns, and candidates chosen by gradient-boosted trees.

The fixed patterns with their checks (ranges, Luhn, numbers of digits) give the base spans. Generators of high recall propose
further, overlapping spans: anything shaped like an address, a number in groups, an account number or a spelt-out e-mail
address. An IBAN of a registered country's length with the right check digits is selected as it is. Boosted trees rate the other
candidates by their format and context. They learn from candidates of the whole corpus: those that a check has confirmed are
positive, those whose own span has a checked shape and fails are negative; what merely holds or meets a failed span is rated. All
of them are used, half (by a hash of their text and place) to fit the trees, half to calibrate. The
threshold is the least score at and above which that half has a precision of ``PRECISION``; candidates above it that overlap no
base span are selected, best first where they overlap each other. An IBAN that overlaps a base span (digits in it that are a
card's, too) is left to that span.

Defined cases: a null text is empty and has no span. A row without doc_id is scanned like any other. Repeated rows get a row
each; an empty table gives an empty result. Without positive or without negative candidates no further span but IBANs is selected.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm.common import Batches, Cover, batch_of, code_points, id_text, ids, raw_texts, sha256, span_text, staged

KINDS = ("email", "ip", "card", "phone", "other")
TREES, DEPTH = 12, 4
PRECISION = 0.98
CONTEXT_BYTES = 32

# Fixed patterns of the base spans. Written so that no run of characters is searched more than once: a number can only start
# where no digit precedes, and an address is found from its @ outwards; the matches are those of the plain patterns.
LOCAL = re.compile(rb"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(rb"[^A-Za-z0-9._%+-]")

# Generators of high recall.
GENERATORS = (
    re.compile(
        rb"[A-Za-z0-9._%+-]{1,64}(?:\x20?(?:@|\[at\]|\(at\))\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}"
        rb"(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}"
    ),
    re.compile(rb"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9])"),
    re.compile(rb"(?<![0-9+])(?:\+|\()?[0-9][0-9()./\x20-]{7,24}[0-9](?![0-9])"),
    re.compile(rb"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"),
)
# A call abroad is written with + or 00 (011 in North America). Digits in groups after 00 or 011 are the number that + gives.
INTERNATIONAL = re.compile(rb"\(?(?:\+|(?:00|011)[\x20-]?[1-9])")
GROUPED = re.compile(rb"(\(?)(?:00|011)[\x20-]?(?=[1-9][0-9]*[()./\x20-])")
IBAN_START = re.compile(rb"(?<![A-Z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
# Registered lengths of account numbers by country.
IBAN_LENGTHS = {
    b"AD": 24, b"AE": 23, b"AL": 28, b"AT": 20, b"AZ": 28, b"BA": 20, b"BE": 16, b"BG": 22, b"BH": 22, b"BI": 27, b"BR": 29, b"BY": 28,
    b"CH": 21, b"CR": 22, b"CY": 28, b"CZ": 24, b"DE": 22, b"DJ": 27, b"DK": 18, b"DO": 28, b"EE": 20, b"EG": 29, b"ES": 24, b"FI": 18,
    b"FK": 18, b"FO": 18, b"FR": 27, b"GB": 22, b"GE": 22, b"GI": 23, b"GL": 18, b"GR": 27, b"GT": 28, b"HR": 21, b"HU": 28, b"IE": 22,
    b"IL": 23, b"IQ": 23, b"IS": 26, b"IT": 27, b"JO": 30, b"KW": 30, b"KZ": 20, b"LB": 28, b"LC": 32, b"LI": 21, b"LT": 20, b"LU": 20,
    b"LV": 21, b"LY": 25, b"MC": 27, b"MD": 24, b"ME": 22, b"MK": 19, b"MN": 20, b"MR": 27, b"MT": 31, b"MU": 30, b"NI": 28, b"NL": 18,
    b"NO": 15, b"OM": 23, b"PK": 24, b"PL": 28, b"PS": 29, b"PT": 25, b"QA": 29, b"RO": 24, b"RS": 22, b"RU": 33, b"SA": 24, b"SC": 31,
    b"SD": 18, b"SE": 24, b"SI": 19, b"SK": 24, b"SM": 27, b"SO": 23, b"ST": 25, b"SV": 28, b"TL": 23, b"TN": 24, b"TR": 26, b"UA": 29,
    b"VA": 22, b"VG": 24, b"XK": 20, b"YE": 30,
}
IBANS = {n: re.compile(rb"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % n) for n in set(IBAN_LENGTHS.values())}
# An address spelt out. After the word ``at`` the dot must be spelt out, too, as prose has the word and full stops.
SPELT_AT = re.compile(rb"\x20?(?:\[at\]|\(at\))\x20?|\x20at\x20|\x20?@\x20?")
SPELT_DOT = re.compile(rb"\x20?(?:\[dot\]|\(dot\))\x20?|\x20dot\x20")
# Endings of most addresses, besides those of two letters.
SUFFIXES = (b"com", b"org", b"net", b"edu", b"gov", b"mil", b"int", b"info", b"biz", b"name", b"mobi", b"app", b"dev", b"cloud", b"online", b"example", b"invalid", b"test")
NUMBER_CUES = (b"phone", b"tel", b"call", b"card", b"contact", b"account", b"iban", b"ssn", b"fax", b"mobile", b"number")
CUES = (b"mail", b"phone", b"tel", b"call", b"card", b"ip", b"host", b"contact", b"account", b"iban", b"ssn", b"address", b"at")


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = c - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: bytes) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)) is not None:
            done = domain.end()
            out.append((start, done))
        else:
            done = max(done, at + 1)
        at = text.find(b"@", max(done, at + 1))
    return out


def octet(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) <= 3 and int(part or b"0") <= 255


def n_digits(part: bytes) -> int:
    return sum(48 <= c <= 57 for c in part)


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in bytes."""
    out = [(*span, "email") for span in emails(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(octet, m[0].split(b".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= n_digits(m[0]) <= 19 and luhn(bytes(c for c in m[0] if 48 <= c <= 57)):
            out.append((*m.span(), "card"))
    if b"+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= n_digits(m[0]) <= 15]
    return out


def candidates(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, generator) of every generator's spans; they may overlap."""
    if re.search(rb"[0-9@]|[\x20\[(]at[\x20\])]", text) is None:
        return []
    return [(*m.span(), g) for g, pattern in enumerate(GENERATORS) for m in pattern.finditer(text) if likely(text, *m.span(), g)]


def likely(text: bytes, start: int, end: int, generator: int) -> bool:
    """Whether a generator's span is more than prose or a bare number: spelt-out addresses spell the dot, a few bare digits follow a cue."""
    value = text[start:end]
    if generator == 0 and b"@" not in value and b" at " in value:
        return SPELT_DOT.search(value) is not None
    if generator == 2 and value.isdigit() and len(value) < 14 and INTERNATIONAL.match(value) is None:
        before = text[max(0, start - CONTEXT_BYTES) : start].lower()
        return any(cue in before for cue in NUMBER_CUES)
    return True


def plain_address(value: bytes) -> bytes:
    """An address without what spells it out."""
    return SPELT_DOT.sub(b".", SPELT_AT.sub(b"@", value, count=1))


def known_ending(value: bytes) -> bool:
    last = plain_address(value).rsplit(b".", 1)[-1].lower()
    return last in SUFFIXES or (len(last) == 2 and last.isalpha())


def ibans(text: bytes) -> list[tuple[int, int]]:
    """Account numbers of their country's length whose check digits are right (ISO 7064, modulo 97)."""
    out: list[tuple[int, int]] = []
    for start in IBAN_START.finditer(text):
        length = IBAN_LENGTHS.get(start[1])
        if length and (not out or start.start() >= out[-1][1]) and (found := IBANS[length].match(text, start.start())) is not None:
            number = found[0].replace(b" ", b"")
            if int("".join(str(int(chr(c), 36)) for c in number[4:] + number[:4])) % 97 == 1:
                out.append(found.span())
    return out


def checked(text: bytes, start: int, end: int, generator: int) -> bool:
    """Whether a candidate's own span has a shape that a check decides: a spelt-out address's ending, four dotted numbers, a card's digits, an IBAN's country.

    Digits right after a letter are part of something longer, and those after an international prefix a phone number.
    """
    if generator == 0:
        # Only an ending that no address has speaks against one that is spelt out.
        return b"@" not in text[start:end] and not known_ending(text[start:end])
    if generator == 2:
        return 14 <= n_digits(text[start:end]) <= 19 and INTERNATIONAL.match(text, start) is None and not text[max(0, start - 1) : start].isalpha()
    return generator == 1 or (generator == 3 and text[start : start + 2] in IBAN_LENGTHS)


def features(text: bytes, start: int, end: int, generator: int) -> list[float]:
    value = GROUPED.sub(rb"\1+", text[start:end], count=1) if generator == 2 and GROUPED.match(text, start, end) else text[start:end]
    value = plain_address(value) if generator == 0 else value
    before, after = text[max(0, start - CONTEXT_BYTES) : start].lower(), text[end : end + CONTEXT_BYTES].lower()
    digits = bytes(c for c in value if 48 <= c <= 57)
    groups = [len(g) for g in re.findall(rb"[0-9]+", value)]
    counts = Counter(digits)
    return [
        float(x)
        for x in (
            len(value), len(digits), sum(value.count(c) for c in (b" ", b"-", b".", b"/", b"(", b")")), value.count(b"."), value.count(b"-"), b"@" in value, value[:1] == b"+",
            len(groups), max(groups, default=0), min(groups, default=0), len(counts), max(counts.values(), default=0) / max(1, len(digits)),
            bool(digits) and len(digits) >= 12 and luhn(digits), all(int(g) <= 255 for g in re.findall(rb"[0-9]{1,9}", value)), sum(c > 64 for c in value),
            before[-1:].isspace() or not before, after[:1].isspace() or not after, before[-1:].isalnum(), after[:1].isalnum(), before[-2:-1] in (b":", b"="),
            generator == 0 and known_ending(value), *(generator == g for g in range(len(GENERATORS))), *(cue in before for cue in CUES),
        )
    ]


def proposals(docs: DataFrame) -> DataFrame:
    """A row per document: base spans, and candidates with their features and whether a check confirms them."""
    span = [("start", pa.int64()), ("end", pa.int64())]
    base_kind = pa.list_(pa.struct([*span, ("kind", pa.string())]))
    found_kind = pa.list_(pa.struct([*span, ("state", pa.int32()), ("features", pa.list_(pa.float32()))]))
    schema = pa.schema([("row", pa.int64()), ("text_hash", pa.int64()), ("doc_id", pa.int64()), ("base", base_kind), ("found", found_kind)])
    ddl = "row bigint, text_hash bigint, doc_id bigint, base array<struct<start: bigint, end: bigint, kind: string>>, found array<struct<start: bigint, end: bigint, state: int, features: array<float>>>"

    def run(batches: Batches) -> Batches:
        for batch in batches:
            bases, founds = [], []
            for text in raw_texts(batch):
                base, rows = base_spans(text), []
                exact, covered = {(s, e) for s, e, _ in base}, Cover((s, e) for s, e, _ in base)
                accounts = [span for span in ibans(text) if not covered.overlaps(*span)]
                covered = Cover([*exact, *accounts])
                proposed = candidates(text)
                refuted = {(s, e) for s, e, g in proposed if (s, e) not in exact and checked(text, s, e, g)}
                rows += [(start, end, 3, features(text, start, end, 3)) for start, end in accounts]
                for start, end, generator in proposed:
                    # 1: confirmed by a check; 0: of a checked shape, and refuted; 2: unknown, to be rated; 3: a confirmed IBAN.
                    state = 1 if (start, end) in exact else None if covered.overlaps(start, end) else 0 if (start, end) in refuted else 2
                    if state is not None:
                        rows.append((start, end, state, features(text, start, end, generator)))
                at = code_points(text, [x for s, e, *_ in [*base, *rows] for x in (s, e)])
                bases.append([{"start": at[2 * k], "end": at[2 * k + 1], "kind": kind} for k, (_, _, kind) in enumerate(base)])
                founds.append([{"start": at[2 * k], "end": at[2 * k + 1], "state": state, "features": f} for k, (_, _, state, f) in enumerate(rows, len(base))])
            yield batch_of(schema, ids(batch, "row"), ids(batch, "text_hash"), ids(batch), bases, founds)

    numbered = id_text(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("text_hash", F.xxhash64("text"))
    return numbered.mapInArrow(run, ddl)


def fitted(known: DataFrame):
    """The trees and the threshold, from all examples; None without examples of both kinds."""
    half = F.pmod(F.col("order"), F.lit(2)) == 0
    # Examples of the same features and label are one, with their number for its weight.
    counted = staged(known.groupBy(half.alias("fits"), "features", "state").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    fit = counted.filter("fits").select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("state").cast("double").alias("label"), "weight")
    if fit.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False, weightCol="weight").fit(fit)
    least = least_precise(rate(model, counted.filter(~F.col("fits"))).select("score", "state", "weight"))
    return None if least is None else (model, least)


def least_precise(rated: DataFrame) -> float | None:
    """The least score at and above which the precision is ``PRECISION``; scores are summed in ranges, so no task sees all of them."""
    by_score = rated.groupBy("score").agg(F.sum(F.col("state") * F.col("weight")).alias("hits"), F.sum("weight").alias("n"))
    ranged = staged(by_score.repartitionByRange(F.col("score").desc()).withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(F.sum("hits").alias("range_hits"), F.sum("n").alias("range_n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("range", *[F.coalesce(F.sum(f"range_{c}").over(earlier), F.lit(0.0)).alias(f"before_{c}") for c in ("hits", "n")])
    down = Window.partitionBy("range").orderBy(F.col("score").desc())
    sums = ranged.join(F.broadcast(before), "range").select("score", *[(F.col(f"before_{c}") + F.sum(c).over(down)).alias(c) for c in ("hits", "n")])
    return sums.filter(F.col("hits") / F.col("n") >= PRECISION).agg(F.min("score")).first()[0]


def rate(model, rows: DataFrame) -> DataFrame:
    vectors = rows.withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1])


def selected(spans: list) -> list[tuple[int, int, str]]:
    """Of rated spans that may overlap, the best first."""
    taken = Cover()
    for s in sorted(spans, key=lambda s: (-s["score"], s["start"], s["end"])):
        if not taken.overlaps(s["start"], s["end"]):
            taken.add(s["start"], s["end"])
    return [(start, end, "other") for start, end in zip(taken.starts, taken.ends, strict=True)]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """A row per document: counts by kind, the digest of base spans, all spans."""
    proposed = staged(proposals(docs))
    each = proposed.select("row", "text_hash", F.explode("found").alias("f")).select("row", "text_hash", "f.*").withColumn("order", F.xxhash64("features", "text_hash", "start"))
    trained = fitted(each.filter("state != 2").withColumn("state", F.least("state", F.lit(1))))
    above = each.filter("state = 3").select("row", "start", "end", F.lit(1.0).alias("score"))
    if trained is not None:
        model, threshold = trained
        above = above.union(rate(model, each.filter("state = 2")).filter(F.col("score") >= threshold).select("row", "start", "end", "score"))
    by_row = above.groupBy("row").agg(F.collect_list(F.struct("start", "end", "score")).alias("others"))
    chosen = proposed.select("row", "doc_id", "base").join(by_row, "row", "left")
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{kind}", pa.int64()) for kind in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(KINDS) + 2)]
            for base, others in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(s["start"], s["end"], s["kind"]) for s in base]
                every = spans + selected(others or [])
                counts = Counter(kind for *_, kind in every)
                for k, kind in enumerate(KINDS):
                    columns[k].append(counts[kind])
                columns[-2].append(sha256(span_text(spans, KINDS).encode()))
                columns[-1].append(span_text(every, KINDS))
            yield batch_of(schema, ids(batch), *columns)

    ddl = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_other bigint, base_sha256 string, spans string"
    return chosen.select("doc_id", "base", "others").mapInArrow(run, ddl).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_other")
