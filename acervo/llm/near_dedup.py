"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set holds the hashes of its distinct five-word shingles. Equal sets form one class, so that exact copies, however
many, take part once. Each class is posted under every (coordinate, value) pair of its signature. Posts that no other class has
go; of a class's other posts, the rarest ``live - MATCHES + 1`` are its prefix, as two classes with ``MATCHES`` collisions must
share one of these. In a posting list each class is first held against the list's least one, a number of pairs linear in the
list. A candidate's collisions are counted on whole signatures, pairs with ``MATCHES`` or more are compared on full sets, and
links join components. Lists of three or more that still hold two components then go through a second search for pairs across
components only, by prefixes of the full sets with bounds from the places of shared shingles: within a large group of near
copies it looks at no pair of one component, nor at those too far apart.

A pair at the very threshold of 0.75 has 24 of 32 collisions on average; it has fewer than 12 once in about a million cases.

Defined cases: a null or blank text has an empty set, is linked with nothing and kept. A row without doc_id is linked with
nothing and kept, its component_id is null. Repeated rows get a result row each. Different texts of one doc_id are documents of
their own. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acervo.llm.common import Batches, batch_of, hashed_words, id_text, ids, mixed, raw_texts, shingle_hashes, staged, word_hashes, words_of

COORDINATES = 32
MATCHES = 12
THRESHOLD = 75
SKETCH = "doc_id bigint, text_key string, n_shingles bigint, set_key binary, signature array<bigint>"
TEXT_KEY = "near_dedup_text_key"
SETS = "node bigint, signature array<bigint>, shingles binary"


def distinct_shingles(text: bytes, cache) -> np.ndarray:
    return np.unique(shingle_hashes(hashed_words(words_of(text), cache)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each coordinate, with the coordinate's number in the low bits: one value is one posting list."""
    coordinate = np.arange(COORDINATES, dtype=np.uint64)
    factor, add = mixed(coordinate + np.uint64(101)) | np.uint64(1), mixed(coordinate + np.uint64(977))
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096, None] * factor + add
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    return ((mixed(least) & ~np.uint64(COORDINATES - 1)) | coordinate).view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(docs: DataFrame) -> DataFrame:
    """Text key, set size, set key and signature of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.list_(pa.int64()))])

    def run(batches: Batches) -> Batches:
        cache = word_hashes()
        for batch in batches:
            sets = [distinct_shingles(text, cache) for text in raw_texts(batch)]
            yield batch_of(
                schema, ids(batch), ids(batch, "text_key"), [len(s) for s in sets],
                [set_key(s) if len(s) else None for s in sets], [signature(s) if len(s) else None for s in sets],
            )

    return id_text(docs).withColumn("text_key", text_key("text")).mapInArrow(run, SKETCH)


def text_key(name: str):
    return F.sha2(F.coalesce(F.col(name), F.lit("")), 256)


def full_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Signature and full set of the given classes, from the documents that stand for them."""
    schema = pa.schema([("node", pa.int64()), ("signature", pa.list_(pa.int64())), ("shingles", pa.binary())])

    def run(batches: Batches) -> Batches:
        cache = word_hashes()
        for batch in batches:
            sets = [distinct_shingles(text, cache) for text in raw_texts(batch)]
            # One doc_id may have several texts; each class wants its own.
            keys = batch.column(batch.schema.get_field_index("set_key")).to_pylist()
            own = [k for k, s in enumerate(sets) if len(s) and set_key(s) == keys[k]]
            yield batch_of(schema, ids(batch, "node").take(pa.array(own, pa.int64())), [signature(sets[k]) for k in own], [sets[k].tobytes() for k in own])

    wanted = classes.join(nodes.select("node").distinct(), "node", "left_semi").select("doc_id", "node", "set_key")
    return id_text(docs).join(wanted, "doc_id").mapInArrow(run, SETS)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b), those with enough collisions whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            left, right = (column[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES) for c in ("signature_a", "signature_b"))
            enough = (left == right).sum(axis=1) >= MATCHES
            linked = []
            for k in np.flatnonzero(enough):
                x, y = (np.frombuffer(column[c][int(k)].as_py(), np.uint64) for c in ("shingles_a", "shingles_b"))
                linked.append(int(k)) if similar(x, y) else None
            at = pa.array(linked, pa.int64())
            yield batch_of(schema, column["a"].take(at), column["b"].take(at))

    side = {s: sets.select(F.col("node").alias(s), F.col("signature").alias(f"signature_{s}"), F.col("shingles").alias(f"shingles_{s}")) for s in "ab"}
    return pairs.join(side["b"], "b").join(side["a"], "a").select("a", "b", "signature_a", "signature_b", "shingles_a", "shingles_b").mapInArrow(run, "a bigint, b bigint")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= THRESHOLD * (len(both) - shared)


def prefix_posts(nodes: DataFrame) -> DataFrame:
    """The prefix of each class's posts in lists that hold two classes or more: (token, node)."""
    posts = nodes.select("node", F.explode("signature").alias("token"))
    lists = posts.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    live = posts.join(lists, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("live"))
    kept = live.filter(F.size("live") >= MATCHES).select("node", F.explode(F.slice("live", F.lit(1), F.size("live") - (MATCHES - 1))).alias("post"))
    return kept.select("node", F.col("post.token").alias("token"))


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b): least labels passed along edges, then from label to label, until none changes."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("to"))
        further = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        after = staged(moved.join(further, "to", "left").select("node", "before", F.least("to", "further").alias("component")))
        labels = after.select("node", "component")
        if not after.filter("component < before").limit(1).count():
            return labels


def unresolved(posts: DataFrame, components: DataFrame) -> DataFrame:
    """(node, component) of the classes in posting lists of three or more that still hold two components."""
    held = posts.join(components, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component"))
    lists = held.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    return held.join(lists.filter("n > 2 and least < most"), "token").groupBy("node").agg(F.min("component").alias("component"))


def set_prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The quarter of each set's shingles that the fewest of the given sets hold: (shingle, node, component, size, place).

    A pair of sets as similar as asked for shares a shingle of both prefixes. Shingles of one set alone come first and are left out.
    """
    schema = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("component", pa.int64()), ("size", pa.int64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for node, component, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(shingles, np.int64)
                yield batch_of(schema, own, np.full(len(own), node), np.full(len(own), component), np.full(len(own), len(own)))

    rows = staged(sets.join(members, "node").select("node", "component", "shingles").mapInArrow(run, "shingle bigint, node bigint, component bigint, size bigint"))
    held = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    live = rows.join(held, "shingle").groupBy("node").agg(
        F.min("component").alias("component"), F.min("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("live")
    )
    alone = F.col("size") - F.size("live")
    taken = F.col("size") - F.ceil(F.col("size") * THRESHOLD / 100) + 1 - alone
    cut = live.select("node", "component", "size", alone.alias("alone"), F.posexplode(F.slice("live", F.lit(1), F.greatest(taken, F.lit(0)).cast("int"))).alias("at", "post"))
    return cut.select(F.col("post.shingle").alias("shingle"), "node", "component", "size", (F.col("alone") + F.col("at")).alias("place"))


def across_components(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components among the given classes whose prefixes allow the similarity asked for.

    A shingle at places p and q of two sets whose earlier ones are not shared leaves them ``min(|x| - p, |y| - q)`` to share. A set
    that could not reach the similarity even with the least set listed under a shingle is skipped there, so that a frequent shingle
    of one large component costs no pairs.
    """
    posts = staged(set_prefixes(members, sets))
    whole = 100 + THRESHOLD
    enough = f"{whole} * (size - place) >= {THRESHOLD} * (size + least_size)"
    least = posts.groupBy("shingle").agg(F.min("size").alias("least_size"))
    able = posts.join(least, "shingle").filter(enough).drop("least_size")
    mixed_lists = able.groupBy("shingle").agg(F.min("component").alias("first"), F.max("component").alias("last")).filter("first < last").select("shingle")
    left = able.join(mixed_lists, "shingle", "left_semi")
    right = left.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("node", "component", "size", "place")))
    reach = f"{whole} * least(size - place, size_b - place_b) >= {THRESHOLD} * (size + size_b)"
    return left.join(right, "shingle").filter(f"node < node_b and component <> component_b and {reach}").select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def linked_components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that have a link to another class."""
    posts = staged(prefix_posts(classes.select("node", "signature")))
    sets = staged(full_sets(docs, posts, classes))
    pivot = posts.groupBy("token").agg(F.min("node").alias("a"))
    first = staged(posts.join(pivot, "token").filter("a < node").select("a", F.col("node").alias("b")).distinct())
    links = staged(confirmed(first, sets))
    components = smallest_reachable(links)
    members = staged(unresolved(posts, components))
    more = staged(confirmed(staged(across_components(members, sets).distinct()), sets))
    # Links of the second search join whole components: each stands by its least member.
    label = components.select(F.col("node").alias("a"), F.col("component").alias("to"))
    ends = more.join(label, "a", "left").select(F.coalesce("to", "a").alias("a"), "b").join(label.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("to", "b").alias("b"))
    merged = smallest_reachable(ends.filter("a <> b")).select(F.col("node").alias("component"), F.col("component").alias("least"))
    every = components.union(merged.select(F.col("component").alias("node"), "component")).dropDuplicates(["node"])
    return every.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def components_of(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, group (of linked classes; null for rows that none can be linked with), component_id."""
    sketch = staged(sketches(docs))
    named = sketch.filter("doc_id is not null and n_shingles > 0")
    # A class stands by its least doc_id, which two classes may have in common; numbers ascend as these do.
    found = staged(named.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min_by("signature", "doc_id").alias("signature")))
    order = ("doc_id", "set_key")
    classes = staged(found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    components = linked_components(docs, classes)
    grouped = classes.select("set_key", "node", "doc_id").join(components, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    of_class = grouped.join(least, "group").select("set_key", "group", "component_id")
    rows = sketch.drop("signature").join(of_class, "set_key", "left")
    named_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"), named_id.alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept."""
    return components_of(docs).select("doc_id", "n_shingles", "component_id").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with one of each component, columns as they were; a repeated row stays once. Rows without doc_id stay.

    Texts of one doc_id are documents of their own: they go only where they are linked.
    """
    rows = components_of(docs).filter("doc_id is not null")
    grouped = rows.filter("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("one")).select("one.*")
    kept = grouped.unionByName(rows.filter("group is null").select("doc_id", "text_key")).distinct()
    marked = docs.filter("doc_id is not null").withColumn(TEXT_KEY, text_key("text"))
    same = (F.col("doc_id").cast("long") == F.col("kept_id")) & (F.col(TEXT_KEY) == F.col("kept_key"))
    one = marked.join(kept.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")), same, "left_semi")
    return one.dropDuplicates(["doc_id", TEXT_KEY]).select(*docs.columns).unionByName(docs.filter("doc_id is null")).select(*docs.columns)
