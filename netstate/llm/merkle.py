"""Merkle manifest of a table of documents: a persistent binary hash tree per language under one root.

Leaves of a language stand in the order of their keys. Aligned blocks of ``2**BLOCK_LEVELS`` of them are hashed by one task
each and leave one node behind; blocks of those nodes follow, until a single node remains, and the same is done with the
languages' nodes. A changed leaf makes a new version of the tree that shares every untouched node: inside its block only
the leaf's ancestors are copied, and the version goes on upwards with the block's siblings, which all leaves of the block
have in common. So no task holds more than a block, however many versions there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netstate.scale import join_small, stage

BLOCK_LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of monotonically_increasing_id that count rows inside a partition.
_ROW_BITS = 33


def encoded(values: Sequence[Column]) -> Column:
    """Concatenation of the values, each as its UTF-8 byte count, a colon and the value; ``-`` for null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def is_tampered(key: str = "doc_id", modulus: int = 7) -> Column:
    """Whether `modulus` divides the crc32 of the decimal key; false for a null key."""
    remainder = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))
    return F.coalesce(remainder == 0, F.lit(False))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", counter: str = "n_chars") -> DataFrame:
    """key, g (the group as text that sorts as groups do, null first), leaf and changed of every row.

    changed is the leaf after one was added to `counter` where the key says so (null where nothing changes: other keys, or
    a null counter).
    """
    kept = [F.col(f) for f in fields]
    added = [F.col(f) + 1 if f == counter else F.col(f) for f in fields]
    changes = is_tampered(key) & F.col(counter).isNotNull()
    return docs.select(
        F.col(key),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.sha2(encoded(kept), 256).alias("leaf"),
        F.when(changes, F.sha2(encoded(added), 256)).alias("changed"),
    )


def numbered(rows: DataFrame, order: Sequence[str], group: str = "g") -> DataFrame:
    """The rows with pos, their place from 0 within the group by `order`, and n, the group's size.

    Rows are dealt by ranges of (group, first of order) and sorted; a partition's groups are counted, and these counts, one row
    per partition and group it holds, shift the places. Equal rows take places in any order.
    """
    ordered = rows.repartitionByRange(F.col(group), F.col(order[0])).sortWithinPartitions(group, *order)
    placed = stage(ordered).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    counts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("rows"), F.min("_at").alias("_first"))
    per_group = Window.partitionBy(group)
    shifts = counts.select(
        group, "_part", "_first",
        (F.sum("rows").over(per_group.orderBy("_part")) - F.col("rows")).alias("_before"),
        F.sum("rows").over(per_group).alias("n"),
    )
    joined = join_small(placed, shifts, [group, "_part"], "inner")
    return joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "n")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def levels_of(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length()


def block_nodes(values: Sequence[str], levels: int) -> list[list[str]]:
    """All nodes of a block by level, the leaves first. A node without a sibling is hashed alone."""
    rows = [list(values)]
    for _ in range(levels):
        below = rows[-1]
        rows.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return rows


def siblings(rows: list[list[str]], at: int) -> list[str]:
    """For each level of a block the sibling of the leaf's ancestor, after L or R for its side; N where there is none."""
    path = []
    for row in rows[:-1]:
        other = at ^ 1
        path.append("N" if other >= len(row) else ("L" if other < at else "R") + row[other])
        at >>= 1
    return path


def copied(leaf: str, path: Sequence[str]) -> list[str]:
    """The ancestors of a leaf along a path of siblings: the nodes a version of the tree does not share. The last is its root."""
    nodes, node = [], leaf
    for step in path:
        node = digest(step[1:], node) if step[0] == "L" else digest(node, step[1:])
        nodes.append(node)
    return nodes


def in_order(path: Sequence[str]) -> str:
    """Hash of the siblings' digests, level by level."""
    return digest(*[step[1:] for step in path])


def reduced(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """The node above each block of ``2**levels`` nodes: g, pos (the block), n (the blocks of g) and node."""

    def reduce(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        g, pos, n = (rows.column(c)[0].as_py() for c in ("g", "pos", "n"))
        top = block_nodes(rows.column("node").to_pylist(), min(levels, levels_of(n)))[-1]
        return pa.table({"g": [g], "pos": [pos >> levels], "n": [(n + (1 << levels) - 1) >> levels], "node": top})

    keyed = nodes.select("g", "pos", "n", "node", F.shiftright("pos", levels).alias("block"))
    return keyed.groupBy("g", "block").applyInArrow(reduce, "g string, pos long, n long, node string")


PATHS = "g string, pos long, path array<string>, subroot string, root string"


def extended(nodes: DataFrame, above: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """PATHS of the nodes: the siblings inside their block, then the path of the node above the block."""

    def extend(table: pa.Table, upper: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        tree = block_nodes(rows.column("node").to_pylist(), min(levels, levels_of(rows.column("n")[0].as_py())))
        rest = upper.column("path")[0].as_py()
        size = rows.num_rows
        return pa.table({
            "g": rows.column("g"), "pos": rows.column("pos"),
            "path": pa.array([siblings(tree, i) + rest for i in range(size)], pa.list_(pa.string())),
            "subroot": pa.array([upper.column("subroot")[0].as_py()] * size, pa.string()),
            "root": pa.array([upper.column("root")[0].as_py()] * size, pa.string()),
        })

    keyed = nodes.select("g", "pos", "n", "node", F.shiftright("pos", levels).alias("block"))
    upper = above.select("g", F.col("pos").alias("block"), "path", "subroot", "root")
    return keyed.groupBy("g", "block").cogroup(upper.groupBy("g", "block")).applyInArrow(extend, PATHS)


def layers(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """The nodes above blocks, above blocks of those, and so on, until every group has one node."""
    found = [stage(reduced(nodes, levels))]
    while (found[-1].agg(F.max("n")).first()[0] or 1) > 1:
        found.append(stage(reduced(found[-1], levels)))
    return found


@dataclass
class Tree:
    """A Merkle tree: its leaves with their places, and for every block of leaves the path from the block's node to the root."""

    leaves: DataFrame
    above: DataFrame
    levels: int


def build_tree(rows: DataFrame, key: str = "doc_id", levels: int = BLOCK_LEVELS) -> Tree:
    """The tree over `rows` as `leaves` gives them. Leaves stand by (key, leaf) in their group, a null key first.

    Repeated rows are leaves of their own next to each other. An empty table has an empty tree.
    """
    placed = stage(numbered(stage(rows), [key, "leaf"]))
    lower = layers(placed.select("g", "pos", "n", F.col("leaf").alias("node")), levels)
    tops = lower[-1].select("g", "node")
    # The groups' nodes are the leaves of the tree on top.
    ranked = numbered(tops.select(F.lit("").alias("all"), "g", "node"), ["g"], group="all")
    ranked = stage(ranked.select("g", F.struct(F.col("all").alias("g"), "pos", "n", "node").alias("top")))
    upper = layers(ranked.select("top.*"), levels)
    paths = upper[-1].select(
        "g", "pos", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root")
    )
    for nodes in [*upper[-2::-1], ranked.select("top.*")]:
        paths = extended(nodes, paths, levels)
    paths = ranked.join(paths, F.col("top.pos") == F.col("pos")).select(
        ranked["g"], F.lit(0).cast("long").alias("pos"), "path", F.col("top.node").alias("subroot"), "root"
    )
    for nodes in lower[-2::-1]:
        paths = extended(nodes, paths, levels)
    return Tree(placed, stage(paths), levels)


def proofs(tree: Tree, key: str = "doc_id", paths: bool = False) -> DataFrame:
    """Per leaf: key, leaf, subroot, root, proof_sha256, folded_root and verified; with `paths` also path and copies.

    folded_root is the root of the version that the leaf's change makes, or of the original where nothing changed. path holds
    the siblings, after L or R for their side (N: none). copies are the nodes of that version that it does not share, from
    the leaf's parent to its root; null for an unchanged leaf.
    """
    levels, kind = tree.levels, tree.leaves.schema[key].dataType.simpleString()

    def prove(table: pa.Table, upper: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        values, changes = rows.column("leaf").to_pylist(), rows.column("changed").to_pylist()
        inner = block_nodes(values, min(levels, levels_of(rows.column("n")[0].as_py())))
        rest, subroot, root = (upper.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        ways = [siblings(inner, i) + rest for i in range(len(values))]
        versions = [copied(change or leaf, way) for leaf, change, way in zip(values, changes, ways)]
        folded = [v[-1] if v else change or leaf for v, leaf, change in zip(versions, values, changes)]
        columns = {
            "key": rows.column("key"), "leaf": rows.column("leaf"), "subroot": [subroot] * len(values), "root": [root] * len(values),
            "proof_sha256": [in_order(way) for way in ways], "folded_root": folded, "verified": [f == root for f in folded],
        }
        if paths:
            columns["path"] = pa.array(ways, pa.list_(pa.string()))
            columns["copies"] = pa.array([v if change else None for v, change in zip(versions, changes)], pa.list_(pa.string()))
        return pa.table(columns)

    block = F.shiftright("pos", levels).alias("block")
    keyed = tree.leaves.select(F.col(key).alias("key"), "g", "leaf", "changed", "pos", "n", block)
    upper = tree.above.select("g", F.col("pos").alias("block"), "path", "subroot", "root")
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", path array<string>, copies array<string>" if paths else ""
    return keyed.groupBy("g", "block").cogroup(upper.groupBy("g", "block")).applyInArrow(prove, schema).withColumnRenamed("key", key)


def version_nodes(proven: DataFrame, key: str = "doc_id") -> DataFrame:
    """The nodes that each version owns: key (the changed leaf's), level from 1 up, and node. All others are shared."""
    return proven.where("copies is not null").select(key, F.posexplode("copies").alias("level", "node")).withColumn("level", F.col("level") + 1)


def manifest(docs: DataFrame, key: str = "doc_id", levels: int = BLOCK_LEVELS, paths: bool = False) -> DataFrame:
    """`proofs` of the tree over all rows of docs. Empty docs give no rows; other columns of docs are not read."""
    return proofs(build_tree(leaves(docs, key=key), key, levels), key, paths)
