"""Embedding near-dedup: exact metric range join with pivots.

Vectors are compared only within a label, by cosine, that is by the distance of unit vectors:
``cosine >= c`` is ``distance <= r`` with ``r = sqrt(2 - 2 c)``. A bounded number of pivots splits the
space into Voronoi cells. A vector y of cell j can have a neighbour in cell i only if
``d(y, p_i) - d(y, p_j) <= 2 r`` (triangle inequality) and its distance from the plane between the two
pivots is at most ``r``; then, and if i < j, it is replicated to cell i. Each cell joins by itself, its
own vectors with all others, so every pair meets exactly once. Cells are cut into blocks of at most
about ``block`` vectors, and each pair of blocks is one task group, however many vectors a cell holds.

Identical vectors are one class from the start, with a count: copies are neither shuffled nor compared.

Null labels and vectors that are null, empty, zero or hold null or non-finite components link with
nothing (not even with copies of themselves), nor do rows without an id. Vectors of different
lengths are never compared. Empty tables give empty results. Only id, label and vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype="<f4").reshape(len(rows), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(batches):
    """Vectors as bytes, null for those that can't be compared; -0 as 0."""
    for b in batches:
        out = []
        for v in b.column(2).to_pylist():
            ok = v is not None and len(v) and None not in v
            x = np.asarray(v, dtype=np.float32) + np.float32(0) if ok else None
            out.append(x.tobytes() if ok and np.isfinite(x).all() and np.any(x) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["id", "label", "v"])


def _assign(pivots: dict[int, np.ndarray], radius: float):
    """Rows ``(rep, label, cell, home, v)``: each vector in its home cell and where it may have neighbours."""
    def run(batches):
        for b in batches:
            reps, labels, vs = (b.column(i).to_pylist() for i in range(3))
            sizes = np.array([len(v) for v in vs])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x, p = _unit([vs[i] for i in at]), pivots.get(int(size))
                if p is None:
                    near, home = np.ones((len(at), 1), dtype=bool), np.zeros(len(at), dtype=int)
                else:
                    d2 = np.maximum(2 - 2 * x @ p.T, 0)
                    home = d2.argmin(axis=1)
                    own = d2[np.arange(len(at)), home][:, None]
                    gap = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[home]
                    plane = (d2 - own) / np.maximum(2 * gap, 1e-12)
                    near = (np.sqrt(d2) - np.sqrt(own) <= 2 * radius + 1e-9) & (plane <= radius + 1e-9)
                    near &= np.arange(len(p)) < home[:, None]
                    near[np.arange(len(at)), home] = True
                row, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([reps[at[i]] for i in row], pa.int64()), pa.array([labels[at[i]] for i in row], pa.string()),
                     pa.array([int(size) << 32 | int(c) for c in cell], pa.int64()), pa.array(home[row] == cell),
                     pa.array([vs[at[i]] for i in row], pa.binary())], names=["rep", "label", "cell", "home", "v"])
    return run


def _join_blocks(cosine: float):
    """One pair of blocks: links of the left block's vectors, and of replicas on the right; a spanning forest of the links."""
    def run(pdf):
        import pandas as pd
        left, right = pdf[pdf["left"]], pdf[~pdf["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        hit = _unit(left["v"].tolist()) @ _unit(right["v"].tolist()).T >= cosine
        hit &= a[:, None] != b[None, :]
        home = right["home"].to_numpy()
        gained = np.concatenate([hit @ right["copies"].to_numpy(), np.where(home, 0, left["copies"].to_numpy() @ hit)])
        reps = np.concatenate([a, b])
        x, y = np.nonzero(hit)
        nodes, inv = np.unique(reps, return_inverse=True)
        x, y, root = inv[x], inv[len(a) + y], np.arange(len(nodes))
        while len(x):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
            x, y = root[x], root[y]
            x, y = x[x != y], y[x != y]
        out = pd.DataFrame({"rep": reps, "links": gained.astype("int64"), "root": nodes[root[inv]]})
        return out[(out["links"] > 0) | (out["rep"] != out["root"])]
    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                    block: int = 1024, max_pivots: int = 1024) -> DataFrame:
    """Per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``. At most ``max_pivots`` pivots are broadcast."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>").alias("v"))
    rows = written(rows.mapInArrow(_pack, "id long, label string, v binary"), "vectors")
    valid = rows.where("id is not null and label is not null and v is not null")
    classes = written(valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    n, labels = classes.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    k = max(1, min(max_pivots, n // max(1, labels * block)))
    some = classes.orderBy(F.xxhash64("rep", "label")).limit(k).select("v").collect()
    pivots: dict[int, np.ndarray] = {}
    for size in {len(r["v"]) for r in some}:
        pivots[size] = np.unique(_unit([bytes(r["v"]) for r in some if len(r["v"]) == size]), axis=0)
    radius = float(np.sqrt(2 - 2 * cosine))
    placed = written(classes.select("rep", "label", "v").mapInArrow(_assign(pivots, radius), "rep long, label string, cell long, home boolean, v binary"), "cells")
    placed = placed.join(classes.select("rep", "label", "copies"), ["rep", "label"])
    parts = (placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("_all"), F.sum(F.col("home").cast("long")).alias("_own"))
             .select("label", "cell", F.ceil(F.col("_own") / block).alias("_rows"), F.ceil(F.col("_all") / block).alias("_cols")).where("_rows > 0"))
    cut = written(placed.join(written(parts, "parts"), ["label", "cell"]), "blocks")
    nth = F.xxhash64("rep")
    as_left = cut.where("home").select("*", F.pmod(nth, F.col("_rows")).alias("r"), F.explode(F.expr("sequence(0L, _cols - 1)")).alias("c"), F.lit(True).alias("left"))
    as_right = cut.select("*", F.explode(F.expr("sequence(0L, _rows - 1)")).alias("r"), F.pmod(nth, F.col("_cols")).alias("c"), F.lit(False).alias("left"))
    keep = ["label", "cell", "r", "c", "left", "home", "rep", "copies", "v"]
    found = (as_left.select(*keep).unionByName(as_right.select(*keep)).groupBy("label", "cell", "r", "c")
             .applyInPandas(_join_blocks(cosine), "rep long, links long, root long"))
    found = written(found, "links")
    comp = written(components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))), "components")
    total = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # an id that several rows have stands for each of them; its vectors' components are one
    by_class = (classes.join(total, "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
                .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    by_class = written(by_class, "by_class")
    out = rows.withColumn("v", F.when(F.col("id").isNotNull(), F.col("v"))).join(by_class, ["label", "v"], "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), comp_id.alias("component_id"),
                      F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"))
