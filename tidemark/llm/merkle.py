"""A Merkle manifest of a dataset, its nodes kept in Parquet by level.

Every row is a leaf; the leaves of a source (in doc_id order) form a tree of FAN-fold runs, and the trees' roots, in the order of their sources, once
more a tree under one root. The store has one table a level. A row of it is a run: its tree, its place, its nodes in order, its digest. A level
is made by reading the one below once, and has a FAN-th of its rows. Places come from a range sort: rows are numbered within
the sorted partitions, and a small table says what stands before each part of a tree, so no tree, however large, meets in one task.

A node's path is what stands to its left and right in its run, then its run's own path. Paths go down from the root, each level merged with the
next by place; a run hands its path to its FAN nodes at most, so no join has a frequent key. The leaves' proofs, and the roots
made from them, are read off the path within the row.

A null is ``-`` in a leaf. Rows without a source form a tree of their own, before the others; within a tree null ids come first, and rows of equal ids
stand in the order of their leaves. Equal rows are leaves each for itself. Texts are hashed whole. An empty table has no root and gives an empty
result; further columns, of any name, are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import work_folder, written

#: Nodes of a run.
FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def sha(*texts: Column) -> Column:
    """The digest of texts one after the other, as lower-case hex."""
    return F.sha2(F.concat(*texts), 256)


def leaf(text: Column | None = None) -> Column:
    """The digest of a row of COLUMNS, or of the row with another text."""

    def part(value: Column) -> Column:
        shown = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return sha(*(part(F.col(c) if c != "text" or text is None else text) for c in COLUMNS))


def ranked(rows: DataFrame, tree: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows``, a written table, sorted by ``tree`` and ``order`` (a total order), and the table of its parts.

    Of the rows, ``part`` and ``at`` say where they stand; of the parts (``part``, the tree's columns), ``before`` says how many rows of
    the tree stand before ``at`` 0, and ``n`` how many the tree has.
    """
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*tree, *order).sortWithinPartitions(*tree, *order)
    placed = written(placed.withColumn("part", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))), name)
    parts = placed.groupBy("part", *tree).agg(F.min("at").alias("first"), F.count("*").alias("m"))
    # One row for each tree and partition that it reaches into.
    whole = Window.partitionBy(*tree)
    until = F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed, parts.select("part", *tree, (until - F.col("m") - F.col("first")).alias("before"), F.sum("m").over(whole).alias("n"))


def _level(nodes: DataFrame, also: list[str], path: str) -> DataFrame:
    """``tree, n, run, kids, digest`` of ``tree, n, pos, digest`` (n: the tree's nodes on this level): FAN nodes a run at most, in order."""
    kids = F.sort_array(F.collect_list(F.struct("pos", "digest", *also))).alias("kids")
    grouped = nodes.groupBy("tree", "n", F.expr(f"pos div {FAN}").alias("run")).agg(kids)
    grouped.withColumn("digest", F.sha2(F.array_join("kids.digest", ""), 256)).write.parquet(path)
    return nodes.sparkSession.read.parquet(path)


def climb(nodes: DataFrame, store: str, also: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels of runs above ``nodes``, and of each level's nodes those that are roots of their trees."""
    levels: list[DataFrame] = []
    roots = [nodes.where("n = 1")]
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        levels.append(_level(nodes.where("n > 1"), [] if levels else also, f"{store}/level={len(levels)}"))
        nodes = levels[-1].select("tree", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("run").alias("pos"), "digest")
        roots.append(nodes.where("n = 1"))
    return levels, roots


def descend(levels: list[DataFrame], roots: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the lowest level (``kid``) with their ``path``, given ``above``: ``tree, path`` of every root, and more to carry down."""
    carried = [c for c in above.columns if c != "tree"]
    before, after = (f"array_join(slice(kids.digest, {part}), '')" for part in ("1, i", "i + 2, size(kids)"))
    step = F.expr(f"array(struct({before} as before, {after} as after))")
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        own = roots[k + 1].select("tree", F.col("pos").alias("run")).join(above, "tree")
        paths = own if paths is None else own.unionByName(paths)
        spread = levels[k].join(paths, ["tree", "run"]).select("*", F.posexplode("kids").alias("i", "kid"))
        paths = spread.withColumn("path", F.concat(step, "path")).select("tree", F.col("kid.pos").alias("run") if k else "kid", *carried)
    lone = roots[0].select("tree", F.struct(*(c for c in roots[0].columns if c not in ("tree", "n"))).alias("kid")).join(above, "tree")
    return lone if paths is None else paths.unionByName(lone.select(paths.columns))


@dataclass
class Manifest:
    """The root of a dataset (None without rows), and its stored levels."""

    root: str | None
    store: str
    levels: list[DataFrame]
    roots: list[DataFrame]
    top_levels: list[DataFrame]
    top_roots: list[DataFrame]

    def proofs(self) -> DataFrame:
        """``doc_id, leaf, subroot, path`` of every leaf, and what it was given to carry."""
        empty = F.expr(f"cast(array() as {PATH})").alias("path")
        tops = descend(self.top_levels, self.top_roots, self.top_roots[-1].select("tree", empty))
        above = tops.select(F.col("kid.pos").alias("tree"), "path", F.col("kid.digest").alias("subroot"))
        found = descend(self.levels, self.roots, written(above, "subroots"))
        others = [c for c in found.select("kid.*").columns if c not in ("pos", "digest", "doc_id")]
        return found.select("kid.doc_id", F.col("kid.digest").alias("leaf"), "subroot", "path", *(f"kid.{c}" for c in others))


def build(docs: DataFrame, carried: dict[str, Column] | None = None, store: str | None = None) -> Manifest:
    """The manifest of ``docs`` (with COLUMNS), stored in the folder ``store``; ``carried`` columns go along with the leaves."""
    carried = carried or {}
    store = store or f"{work_folder(docs.sparkSession)}/merkle-{uuid.uuid4().hex}"
    source = [F.col("source").isNotNull().alias("known"), F.coalesce("source", F.lit("")).alias("name")]
    leaves = docs.select(*source, F.col("doc_id").cast("long"), leaf().alias("digest"), *(c.alias(name) for name, c in carried.items()))
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    tree = ["known", "name"]
    placed, parts = ranked(leaves, tree, ["doc_id", "digest", "row"], "sorted")
    trees = written(parts.select(*tree).distinct().withColumn("one", F.lit(1)), "trees")
    sorted_trees, tree_parts = ranked(trees, ["one"], tree, "sorted-trees")
    numbered = sorted_trees.join(tree_parts, ["part", "one"]).select(*tree, (F.col("before") + F.col("at")).alias("tree"))
    places = parts.join(numbered, tree)
    nodes = placed.join(places, ["part", *tree]).select("tree", "n", (F.col("before") + F.col("at")).alias("pos"), "digest", "doc_id", *carried)
    levels, roots = climb(written(nodes, "nodes"), f"{store}/sources", ["doc_id", *carried])
    subroots = None
    for part in roots:
        part = part.select("tree", "digest")
        subroots = part if subroots is None else subroots.unionByName(part)
    subroots = written(subroots, "subroots")
    top = subroots.select(F.lit(0).alias("tree"), F.lit(subroots.count()).cast("long").alias("n"), F.col("tree").alias("pos"), "digest")
    top_levels, top_roots = climb(top, f"{store}/root", [])
    last = top_roots[-1].first()
    return Manifest(last.digest if last else None, store, levels, roots, top_levels, top_roots)


def folded(own: Column, path: Column) -> Column:
    """The root that a digest and its path lead to."""
    return F.aggregate(path, own, lambda digest, step: sha(step.before, digest, step.after))


def audited(manifest: Manifest, leaf_column: str | Column = "leaf") -> DataFrame:
    """The proofs with ``root``, ``folded_root`` (from the given leaf and the stored siblings) and ``verified``."""
    own = F.col(leaf_column) if isinstance(leaf_column, str) else leaf_column
    proofs = manifest.proofs().withColumn("root", F.lit(manifest.root).cast("string")).withColumn("folded_root", folded(own, F.col("path")))
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def siblings(path: Column) -> Column:
    """All siblings of a path in one string, from the lowest level up, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step.before, step.after)), "")
