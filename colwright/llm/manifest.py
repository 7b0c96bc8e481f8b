"""Merkle manifest of a dataset: one root for all rows, and for every row a proof that it is part of it.

Every row is a leaf. Within a group (a source) neighbouring nodes are hashed together, ``ARITY`` at a time, level by level,
until one is left; the groups' roots are joined to one root in the same way.

Of all levels only every ``STRIDE``-th is written (*checkpoints*). Between two of them lie aligned subtrees of at most
``ARITY ** STRIDE`` stored nodes each. A proof needs the siblings on the way up, most of which were never written: each subtree
is taken up once more, its missing interior nodes are computed again from its stored descendants, the siblings of all its
nodes are emitted, and the interior nodes are dropped. Ways of different checkpoints are joined by subtree, from the top down, so
a row moves once to be hashed and once to get its proof, whatever the height.

A subtree never holds more than ``ARITY ** STRIDE`` rows and is addressed by (group, position), so a group with a third of all
rows is many subtrees in many tasks. Positions come from one sort by range. All hashing is done by built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colwright.operators.ordered import POS, lay_out
from colwright.storage import cut_lineage

#: Nodes that are hashed together.
ARITY = 3
#: Levels from one written level to the next.
STRIDE = 4


def leaf_digest(*fields: Column) -> Column:
    """Hash of a row: each field as ``-`` if NULL, else as its length in UTF-8 bytes, a colon and its value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _joined(nodes: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(nodes, start, length), "")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _parents(nodes: Column, arity: int) -> Column:
    """The next level: every ``arity`` neighbours become one node, the last ones even if they are fewer."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / F.lit(arity)).cast("int"))
    return F.transform(runs, lambda i: _digest(_joined(nodes, i * arity + 1, F.lit(arity))))


def _height(n: Column, arity: int, stride: int) -> Column:
    """Levels above a level of ``n`` nodes until one is left, at most ``stride``."""
    return sum(((n > arity**k).cast("int") for k in range(stride)), F.lit(0))


def _subtrees(nodes: DataFrame, arity: int, stride: int, *carried: str) -> DataFrame:
    """(key, sub, n, rows, height, l0, l1, ...): the aligned subtrees above some nodes (key, pos, n, digest), with all their levels.

    ``n`` is the number of nodes of the key on the level of the nodes. ``rows`` are the nodes in order, with carried columns.
    """
    size = arity**stride
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *carried)))
    grouped = nodes.groupBy("key", F.floor(F.col("pos") / F.lit(size)).cast("long").alias("sub")).agg(
        F.first("n").alias("n"), members.alias("rows")
    )
    grouped = grouped.withColumn("height", _height(F.col("n"), arity, stride)).withColumn("l0", F.col("rows.digest"))
    for k in range(stride):
        above = F.when(F.col("height") > k, _parents(F.col(f"l{k}"), arity)).otherwise(F.col(f"l{k}"))
        grouped = grouped.withColumn(f"l{k + 1}", above)
    return grouped


@dataclass
class Tree:
    """``levels``: the written levels from the leaves up, each (key, pos, n, digest); ``roots``: (key, root)."""

    levels: list[DataFrame]
    roots: DataFrame
    arity: int
    stride: int


def build_tree(nodes: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> Tree:
    """Trees over leaves (key, pos, n, digest): positions count from 0 within a key, ``n`` is the number of leaves of the key."""
    levels = [nodes.select("key", "pos", "n", "digest")]
    top = levels[0].agg(F.max("n")).first()[0] or 0
    while top > 1:
        size = arity**stride
        folded = _subtrees(levels[-1], arity, stride).select(
            "key", F.col("sub").alias("pos"), F.ceil(F.col("n") / F.lit(size)).cast("long").alias("n"), F.col(f"l{stride}")[0].alias("digest")
        )
        levels.append(cut_lineage(folded, "checkpoint"))
        top = -(-top // size)
    return Tree(levels, levels[-1].select("key", F.col("digest").alias("root")), arity, stride)


def _ways(subtrees: DataFrame, tree: Tree) -> Column:
    """The rows of a subtree, each with its way to the subtree's top: an array of (before, after), siblings as hex text."""
    arity = tree.arity

    def way(row, i):
        steps = []
        for k in range(tree.stride):
            at = F.floor(i / F.lit(arity**k)).cast("int")
            run = at - at % arity
            nodes = F.col(f"l{k}")
            steps.append(
                F.struct(
                    _joined(nodes, run + 1, at - run).alias("before"),
                    _joined(nodes, at + 2, run + arity - 1 - at).alias("after"),
                )
            )
        return F.struct(row.alias("row"), F.slice(F.array(*steps), F.lit(1), F.col("height")).alias("way"))

    return F.transform("rows", way)


def proofs(tree: Tree, leaves: DataFrame, *carried: str) -> DataFrame:
    """(key, digest, way, carried columns) of every leaf; ``leaves`` are those the tree was built of, with more columns.

    ``way`` leads from the leaf to the root of its key, as an array of (before, after).
    """
    above = None
    for level in reversed(tree.levels):
        at_leaves = level is tree.levels[0]
        extra = carried if at_leaves else ()
        subtrees = _subtrees(leaves if at_leaves else level, tree.arity, tree.stride, *extra)
        if above is not None:
            upper = above.select(F.col("key").alias("__key"), F.col("pos").alias("__pos"), F.col("way").alias("above"))
            subtrees = subtrees.join(upper, (F.col("key") == F.col("__key")) & (F.col("sub") == F.col("__pos"))).drop("__key", "__pos")
        else:
            subtrees = subtrees.withColumn("above", F.array().cast("array<struct<before:string,after:string>>"))
        found = subtrees.select("key", "above", F.explode(_ways(subtrees, tree)).alias("found"))
        way = F.concat("found.way", "above").alias("way")
        named = [F.col(f"found.row.{c}").alias(c) for c in ("pos", "digest", *extra)]
        above = found.select("key", *named, way)
        if not at_leaves:
            above = cut_lineage(above, "ways")
    return above.drop("pos")


def siblings(way: Column) -> Column:
    """All siblings of a way, level by level, left to right, as one text."""
    return F.array_join(F.transform(way, lambda s: F.concat(s["before"], s["after"])), "")


def fold(leaf: Column, way: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(way, leaf, lambda digest, s: _digest(F.concat(s["before"], digest, s["after"])))


def manifest(df: DataFrame, group: str, order: str, leaf: Column, arity: int = ARITY, stride: int = STRIDE, **carried: Column) -> DataFrame:
    """One row per row of ``df``: group, order, leaf, subroot, root, way and the carried columns.

    Leaves ascend by ``order`` (NULL first, equal ones by digest) within their group, groups by value (NULL first, bytewise).
    ``way`` leads from the leaf over the root of its group to the root of all. Rows that are equal have equal leaves and keep
    their own places. An empty table gives no rows. Other columns of ``df`` are not looked at.
    """
    slim = df.select(
        F.col(f"`{group}`").cast("string").alias("group"),
        F.col(f"`{order}`").cast("long").alias("order"),
        leaf.alias("digest"),
        *[c.alias(name) for name, c in carried.items()],
    )
    placed = cut_lineage(lay_out(slim, ["group"], ["order", "digest"]).table, "leaves")
    # sorted by group, so a group's first position also ranks the groups
    groups = placed.groupBy("group").agg(F.min(POS).alias("start"), F.count(F.lit(1)).alias("n"))
    ranked = lay_out(groups.withColumn("one", F.lit(0)), ["one"], ["start"]).table
    ranked = cut_lineage(ranked.select(F.col("group").alias("of"), "start", "n", F.col(POS).alias("key")), "groups")
    joined = placed.join(ranked, F.col("group").eqNullSafe(F.col("of"))).withColumn("pos", F.col(POS) - F.col("start"))
    leaves = cut_lineage(joined.select("key", "pos", "n", "digest", "group", "order", *carried), "placed")
    tree = build_tree(leaves, arity, stride)
    tops = cut_lineage(
        tree.roots.select(F.lit(0).alias("key"), F.col("key").alias("pos"), F.lit(ranked.count()).cast("long").alias("n"), F.col("root").alias("digest")), "subroots"
    )
    forest = build_tree(tops, arity, stride)
    upper = proofs(forest, tops.withColumn("member", F.col("pos")), "member")
    upper = upper.join(forest.roots, "key").select(F.col("member").alias("__key"), F.col("digest").alias("subroot"), "root", F.col("way").alias("__way"))
    upper = cut_lineage(upper, "upper")
    own = proofs(tree, leaves, "group", "order", *carried)
    whole = own.join(upper, F.col("key") == F.col("__key"))
    return whole.select("group", "order", F.col("digest").alias("leaf"), "subroot", "root", F.concat("way", "__way").alias("way"), *carried)


#: Columns of a document that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """The manifest of a table of documents by source and doc_id, with the leaf that a changed text would give.

    Columns: doc_id, leaf, subroot, root, proof_sha256 (digest of all siblings), folded_root (from the changed leaf and the
    siblings) and verified. Where ``tampered_text`` is NULL, or is not given, the row stays as it is. NULL in any column counts
    as a value of its own, also NULL ids and sources.
    """
    fields = [F.col(f"`{c}`") for c in FIELDS]
    leaf = leaf_digest(*fields)
    changed = F.lit(None).cast("string") if tampered_text is None else tampered_text
    other = F.when(changed.isNotNull(), leaf_digest(*fields[:-1], changed))
    rows = manifest(docs, "source", "doc_id", leaf, other=other)
    folded = fold(F.coalesce("other", "leaf"), F.col("way"))
    out = rows.select(
        F.col("order").alias("doc_id"), "leaf", "subroot", "root", _digest(siblings(F.col("way"))).alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The manifest of ``documents`` in DuckDB: leaves, both trees level by level, and the way of every leaf.
SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
d AS (SELECT *, doc_id IS NOT NULL AND (xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1]))) & 1) = 0 AS touched FROM documents, crc_table),
h AS (SELECT doc_id, source, concat(
      CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END,
      CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
      CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
      CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END) AS head,
    text, CASE WHEN touched THEN replace(text, chr(10), '') ELSE text END AS changed FROM d),
l AS (SELECT doc_id, source,
    sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
    sha256(concat(head, CASE WHEN changed IS NULL THEN '-' ELSE concat(strlen(changed), ':', changed) END)) AS other FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS key FROM l),
up(lvl, key, pos, n, digest) AS (
  SELECT 0, key, pos, n, leaf FROM p
  UNION ALL
  SELECT lvl + 1, key, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lvl, key, pos // 3, n),
roots AS (SELECT key, digest AS subroot FROM up WHERE n = 1),
top(lvl, pos, n, digest) AS (
  SELECT 0, key, (SELECT count(*) FROM roots), subroot FROM roots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
leaf_steps AS (SELECT p.key, p.pos, u.lvl,
    coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (WHERE u.pos < p.pos // (3 ** u.lvl)::BIGINT), '') AS before,
    coalesce(string_agg(u.digest, '' ORDER BY u.pos) FILTER (WHERE u.pos > p.pos // (3 ** u.lvl)::BIGINT), '') AS after
  FROM p JOIN up u ON u.key = p.key AND u.n > 1 AND u.pos // 3 = p.pos // (3 ** (u.lvl + 1))::BIGINT GROUP BY 1, 2, 3),
top_steps AS (SELECT r.key, t.lvl,
    coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos < r.key // (3 ** t.lvl)::BIGINT), '') AS before,
    coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos > r.key // (3 ** t.lvl)::BIGINT), '') AS after
  FROM roots r JOIN top t ON t.n > 1 AND t.pos // 3 = r.key // (3 ** (t.lvl + 1))::BIGINT GROUP BY 1, 2),
ways AS (SELECT key, pos, list({'before': before, 'after': after} ORDER BY lvl) AS way FROM leaf_steps GROUP BY 1, 2),
top_ways AS (SELECT key, list({'before': before, 'after': after} ORDER BY lvl) AS way FROM top_steps GROUP BY 1),
w AS (SELECT p.*, r.subroot, list_concat(coalesce(a.way, []), coalesce(b.way, [])) AS way
  FROM p JOIN roots r USING (key) LEFT JOIN ways a USING (key, pos) LEFT JOIN top_ways b USING (key)),
f AS (SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(way, lambda s: s.before || s.after), ''), '')) AS proof_sha256,
    list_reduce(list_prepend({'before': other, 'after': ''}, way),
      lambda x, s: {'before': sha256(s.before || x.before || s.after), 'after': ''}).before AS folded_root FROM w)
SELECT *, folded_root = root AS verified FROM f
"""
