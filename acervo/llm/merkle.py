"""A Merkle manifest of a dataset: a leaf per row, a tree per language, a tree over the languages, and every leaf's proof.

Built of concatenated levels. Leaves are numbered within their language and cut into aligned blocks of ``arity ** levels``; a
block keeps each of its levels as one string of fixed-width digests, so a parent is the digest of a fixed-width substring, and a
node's siblings are the substrings that flank it within its run. What remains of each block is a node of the next round, which
is built in the same way, until each tree is one node. Proofs go the other way: each round's blocks meet the proof of the node
that they became, and hand it on with their own segment before it.

No group is gathered: leaves are dealt by ranges of (language, doc_id) and numbered inside each range, the ranges' counts give
the offsets, and a block has a fixed size whatever a language's share is. The number of rounds is the logarithm of the largest
language's rows to the base of the block's size.

Defined cases: null fields are ``-`` in a leaf; null languages are a tree of their own, the first; null doc_ids come before
others, and rows of one doc_id are ordered by their leaf. Rows repeated exactly are leaves each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm.common import staged

ARITY = 2
LEVELS = 8  # of a block: 256 leaves, whose string has 16 KiB
WIDTH = 64  # hex digits of a digest
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with the number of its bytes before it, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(n_chars: Column) -> Column:
    return digest(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(tree, doc_id, node, altered): ``altered`` is the leaf with one character more in n_chars, where that changes it."""
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    return docs.select(
        # Null languages come first, the others in the order of their bytes.
        F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(F.col("n_chars")).alias("node"),
        F.when(tampered & F.col("n_chars").isNotNull(), leaf_of(more)).alias("altered"),
    )


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes with their place in their tree (``pos``, from 0) and the tree's size (``total``)."""
    by = [F.col(name).asc_nulls_first() for name in ("tree", *order)]
    dealt = nodes.repartitionByRange(*by).sortWithinPartitions(*by)
    # Written, so that parts and rows keep their numbers however often they are read.
    held = staged(dealt.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    ranges = held.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "tree", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total")
    )
    return held.join(offsets, ["tree", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


class Tree:
    """The rounds of blocks above numbered nodes (tree, pos, total, node, item)."""

    def __init__(self, nodes: DataFrame, arity: int, levels: int):
        self.arity, self.levels = arity, levels
        self.size = arity**levels
        self.rounds: list[DataFrame] = []
        most = None
        while most is None or most > 1:
            blocks = staged(self._blocks(nodes))
            self.rounds.append(blocks)
            most = blocks.agg(F.coalesce(F.max("above"), F.lit(0))).first()[0]
            nodes = blocks.select("tree", F.col("block").alias("pos"), F.col("above").alias("total"), F.element_at("strings", -1).alias("node"), F.lit(None).cast("string").alias("item"))

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        c = F.col
        gathered = nodes.groupBy("tree", "total", F.floor(c("pos") / self.size).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "node", "item"))).alias("members")
        )
        lowest = F.array_join(F.transform("members", lambda m: m["node"]), "")
        run = F.lit(self.arity * WIDTH)

        def parents(level: Column) -> Column:
            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(level), run), lambda at: F.sha2(F.substring(level, at, run), 256)), "")

        def grown(done: Column, l: Column) -> Column:
            last = F.element_at(done, -1)
            return F.concat(done, F.array(F.when(self._count(l) > 1, parents(last)).otherwise(last)))

        every = F.sequence(F.lit(0), F.lit(self.levels - 1))
        return gathered.withColumn("strings", F.aggregate(every, F.array(lowest), grown)).withColumn("above", self._count(F.lit(self.levels)))

    def _count(self, l: Column) -> Column:
        """How many nodes the whole tree has ``l`` levels up."""
        return F.ceil(F.col("total") / F.pow(F.lit(self.arity), l)).cast("long")

    def roots(self) -> DataFrame:
        return self.rounds[-1].select("tree", F.element_at("strings", -1).alias("node"))

    def proofs(self, tops: DataFrame) -> DataFrame:
        """(item, node, path and the columns of ``tops``) for every node, where ``tops`` (tree, path, ...) has what is above each tree's root."""
        carried = [c for c in tops.columns if c not in ("tree", "path")]
        above = tops.withColumn("block", F.lit(0).cast("long"))
        for level, blocks in reversed(list(enumerate(self.rounds))):
            met = blocks.join(above.withColumnRenamed("path", "rest"), ["tree", "block"])
            rows = met.select("tree", *carried, F.explode(self._handed()).alias("m")).select("tree", *carried, "m.*")
            above = rows if level == 0 else rows.select("tree", *carried, "path", F.col("pos").alias("block"))
        return above.select("tree", "item", "node", "path", *carried)

    def _handed(self) -> Column:
        """A block's members, each with its segment of siblings and what is above the block."""
        steps = F.filter(F.sequence(F.lit(0), F.lit(self.levels - 1)), lambda l: self._count(l) > 1)

        def step(k: Column, l: Column) -> Column:
            level = F.element_at("strings", l + 1)
            at = F.floor(k / F.pow(F.lit(self.arity), l)).cast("int")
            before = at % self.arity
            left = F.substring(level, (at - before) * WIDTH + 1, before * WIDTH)
            right = F.substring(level, (at + 1) * WIDTH + 1, (self.arity - 1 - before) * WIDTH)
            return F.struct(left.alias("left"), right.alias("right"))

        def member(m: Column, k: Column) -> Column:
            own = F.transform(steps, lambda l: step(k, l))
            return F.struct(m["pos"].alias("pos"), m["item"].alias("item"), m["node"].alias("node"), F.concat(own, F.col("rest")).alias("path"))

        return F.transform("members", member)


def proofs(docs: DataFrame, tampered: Column, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, altered, subroot (of its language), root, and ``path``, the siblings left and right of each step up."""
    held = staged(leaves(docs, tampered))
    placed = numbered(held, ["doc_id", "node"])
    below = Tree(placed.select("tree", "pos", "total", "node", F.struct("doc_id", "altered").alias("item")), arity, levels)
    subroots = below.roots().select(F.lit("").alias("tree"), F.col("tree").alias("item"), "node")
    top = Tree(numbered(subroots, ["item"]), arity, levels)
    nothing = F.array().cast(PATH)
    tops = top.proofs(top.roots().select("tree", F.col("node").alias("root"), nothing.alias("path")))
    tops = tops.select(F.col("item").alias("tree"), F.col("node").alias("subroot"), "root", "path")
    return below.proofs(tops).select("item.doc_id", F.col("node").alias("leaf"), "item.altered", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def verified(docs: DataFrame, modulus: int = 7, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; rows whose crc32 of doc_id the modulus divides are tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    rows = proofs(docs, tampered, arity, levels).select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


# The same by recursion over single nodes, for DuckDB.
SQL = """
    WITH RECURSIVE hashed AS (
        SELECT doc_id, lang,
            list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                lambda crc, byte: list_reduce(range(8), lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)),
                4294967295) AS crc,
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
            coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS chars,
            coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') AS more,
            coalesce(strlen(text) || ':' || text, '-') AS tail
        FROM documents),
    leaves AS (
        SELECT doc_id, lang, sha256(head || chars || tail) AS leaf,
            CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(head || more || tail) ELSE sha256(head || chars || tail) END AS start,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || chars || tail)) - 1 AS pos,
            count(*) OVER (PARTITION BY lang) AS n
        FROM hashed),
    nodes AS (
        SELECT lang, 0 AS level, pos, n, leaf AS node FROM leaves
        UNION ALL
        SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
    subroots AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
    upper_nodes AS (
        SELECT 0 AS level, pos, n, node FROM subroots
        UNION ALL
        SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 2, n),
    climb AS (
        SELECT doc_id, lang, leaf, pos AS start_pos, 0 AS level, pos, n, start AS node, '' AS proof FROM leaves
        UNION ALL
        SELECT c.doc_id, c.lang, c.leaf, c.start_pos, c.level + 1, c.pos // 2, (c.n + 1) // 2,
            sha256(CASE WHEN c.pos % 2 = 1 THEN s.node || c.node ELSE c.node || coalesce(s.node, '') END), c.proof || coalesce(s.node, '')
        FROM climb c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.pos = xor(c.pos, 1)
        WHERE c.n > 1),
    climb_roots AS (
        SELECT c.doc_id, c.leaf, r.node AS subroot, r.pos, r.n, 0 AS level, c.node, c.proof
        FROM climb c JOIN subroots r ON r.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
        UNION ALL
        SELECT c.doc_id, c.leaf, c.subroot, c.pos // 2, (c.n + 1) // 2, c.level + 1,
            sha256(CASE WHEN c.pos % 2 = 1 THEN s.node || c.node ELSE c.node || coalesce(s.node, '') END), c.proof || coalesce(s.node, '')
        FROM climb_roots c LEFT JOIN upper_nodes s ON s.level = c.level AND s.pos = xor(c.pos, 1)
        WHERE c.n > 1)
    SELECT c.doc_id, c.leaf, c.subroot, u.node AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = u.node AS verified
    FROM climb_roots c, upper_nodes u WHERE c.n = 1 AND u.n = 1
"""
