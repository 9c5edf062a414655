"""Merkle dataset manifest by cogrouped subtree exchange.

A digest H is the lowercase hex SHA-256 of its inputs in a row, digests as hex text. Every row of the table
is a leaf: H of its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The leaves of
a group (``lang``) ascend by id; every ``FAN`` consecutive nodes (the last run: fewer, even one) become their
H until one is left, the subroot. The subroots, ordered by group (null first, bytewise), give the root the
same way.

A superblock holds ``FAN ** DEPTH`` consecutive nodes of a tree.

1. Leaves are hashed in the JVM and numbered inside their group by a range sort; only digests move.
2. Each superblock is reduced to its top node. The top nodes of a tree are the nodes of its next tier,
   and so on until every tree has one node; then the subroots are a tree themselves.
3. Downwards, the nodes of a superblock are *cogrouped* with what it needs from outside: for every level
   above it the digests left and right of its path. One ``applyInPandas`` task reduces the superblock once
   more, joins each node's own siblings to the outer ones, and (for leaves) hashes the proof and folds
   the leaf that is to be verified up to the root.

A task holds one superblock (4,096 digests); an outer path has at most seven digests a level. Groups may
hold any share of the rows. The number of rounds is the number of tiers: 2 up to 16 million rows of a group.

Null ids come first and are never tampered with; rows that repeat an id are ordered by their leaves, so only
equal rows may change places. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FAN, DEPTH = 8, 4
_PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as a leaf's digest takes it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``pos``, the place in the row's ``tree`` from 0 on, and ``size``, the tree's rows.

    A range sort over all trees, then counts per tree and task. Rows that are equal in ``order`` may change places;
    their place in the written table parts them, so that the sort can split any number of them.
    """
    spread = ["tree", *order, "_at"]
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    placed = rows.repartitionByRange(*spread).sortWithinPartitions(*spread).drop("_at")
    placed = written(placed.withColumns({"_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), f"{name}-sorted")
    runs = placed.groupBy("tree", "_task").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "_task", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size"))
    return placed.join(written(runs, f"{name}-runs"), ["tree", "_task"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_task", "_row", "_shift")


def _levels(nodes: list[str], whole: bool, fan: int, depth: int) -> list[list[str]]:
    """Nodes of every level, from the given ones up. ``whole``: they are all of their tree, so it ends at one node."""
    out = [nodes]
    while len(out) <= depth and not (whole and len(out[-1]) == 1):
        last = out[-1]
        out.append([digest("".join(last[i:i + fan])) for i in range(0, len(last), fan)])
    return out


def _siblings(levels: list[list[str]], at: int, fan: int) -> list[tuple[str, str]]:
    """Digests left and right of the path of node ``at``, level by level."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fan
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + fan])))
        at //= fan
    return out


def fold(node: str, path) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def _reducer(fan: int, depth: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        top = _levels(rows["hash"].tolist(), int(rows["size"].iloc[0]) <= fan ** depth, fan, depth)[-1]
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "pos": [rows["pos"].iloc[0] // fan ** depth], "hash": top,
                             "size": [-(-int(rows["size"].iloc[0]) // fan ** depth)]})
    return run


def _exchanger(fan: int, depth: int):
    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = _levels(rows["hash"].tolist(), int(rows["size"].iloc[0]) <= fan ** depth, fan, depth)
        beyond = [{"left": p["left"], "right": p["right"]} for p in outer["path"].iloc[0]]
        paths = [[{"left": a, "right": b} for a, b in _siblings(levels, i, fan)] + beyond for i in range(len(rows))]
        return pd.DataFrame({"tree": rows["tree"], "pos": rows["pos"], "path": paths, "top": outer["top"].iloc[0]})
    return run


def _prover(fan: int, depth: int):
    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = _levels(rows["hash"].tolist(), int(rows["size"].iloc[0]) <= fan ** depth, fan, depth)
        beyond = [(p["left"], p["right"]) for p in outer["path"].iloc[0]]
        proofs, folded = [], []
        for i, claimed in enumerate(rows["claimed"].tolist()):
            path = _siblings(levels, i, fan) + beyond
            proofs.append(digest("".join([a + b for a, b in path])))
            folded.append(fold(claimed, path))
        return pd.DataFrame({"_id": rows["_id"], "leaf": rows["hash"], "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0],
                             "proof_sha256": proofs, "folded_root": folded})
    return run


def _block(rows: DataFrame, fan: int, depth: int):
    return rows.withColumn("_block", F.floor(F.col("pos") / (fan ** depth)).cast("long")).groupBy("tree", "_block")


def _tops(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """Top node of every superblock: the nodes of the next tier."""
    return _block(nodes, fan, depth).applyInPandas(_reducer(fan, depth), "tree string, pos long, hash string, size long")


def outer_paths(nodes: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """``(tree, pos, path, top)``: for each node what its tree has left and right of its way up, and the tree's last node.

    ``nodes``: ``(tree, pos, hash, size)`` with the number of nodes of the tree.
    """
    if not nodes.where("size > 1").take(1):
        return nodes.select("tree", "pos", F.array().cast(_PATH).alias("path"), F.col("hash").alias("top"))
    up = written(outer_paths(written(_tops(nodes, fan, depth), "tops"), fan, depth), "outer")
    return (_block(nodes, fan, depth).cogroup(up.withColumn("_block", F.col("pos")).groupBy("tree", "_block"))
            .applyInPandas(_exchanger(fan, depth), f"tree string, pos long, path {_PATH}, top string"))


def merkle_manifest(docs: DataFrame, fields: list[str], tampered: list[Column], where_tampered: Column, group_col: str = "lang",
                    id_col: str = "doc_id", fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of the table as it is),
    ``folded_root`` (from the leaf of the ``tampered`` fields where ``where_tampered``) and ``verified``."""
    group = F.col(group_col).cast("string")
    leaves = docs.select(F.col(id_col).alias("_id"), F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("tree"),
                         leaf_digest([F.col(c) for c in fields]).alias("hash"),
                         F.when(where_tampered, leaf_digest(tampered)).alias("claimed"))
    leaves = _numbered(leaves, ["_id", "hash"], "leaves").withColumn("claimed", F.coalesce("claimed", "hash"))
    leaves = written(leaves.withColumn("_id", F.col("_id").cast("string")), "numbered")  # pandas has no null integers
    up = written(outer_paths(written(_tops(leaves, fan, depth), "tops"), fan, depth), "outer")
    # the subroots are the leaves of one more tree
    subroots = up.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("_group"), F.col("top").alias("hash"))
    subroots = written(_numbered(subroots, ["_group"], "subroots"), "ranked")
    above = outer_paths(subroots.drop("_group"), fan, depth).select("pos", F.col("path").alias("_above"), F.col("top").alias("root"))
    above = subroots.join(above, "pos").select(F.col("_group").alias("tree"), "_above", "root")
    outer = written(up.join(above, "tree").select("tree", F.col("pos").alias("_block"), F.concat("path", "_above").alias("path"),
                                                  F.col("top").alias("subroot"), "root"), "exchange")
    found = (_block(leaves, fan, depth).cogroup(outer.groupBy("tree", "_block"))
             .applyInPandas(_prover(fan, depth), "_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"))
    return found.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def tamper_check(docs: DataFrame, every: int = 3) -> DataFrame:
    """The manifest of a documents table, verified against texts that were lower-cased (A-Z) where
    ``every`` divides the CRC-32 of the decimal id."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    return merkle_manifest(docs, fields, [F.col(c) for c in fields[:-1]] + [lowered], hit)
