"""Optical duplicates: pairs of a set whose clusters lie next to each other on the flow cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .duplicate_sets import or_first

GROUP = ("rep_idx", "optical_group")


def located(sets: DataFrame, most: int) -> DataFrame:
    """Pairs that may be optical duplicates: of sets of two pairs or more and of no more than ``most``, with a known place."""
    return sets.where(F.col("set_size").between(2, most) & F.col("tile").isNotNull()).select(*GROUP, "library", "rg_ordinal", "tile", "x", "y", F.col("idx1").alias("node"))


def edges(sets: DataFrame, distance: int = 100, most: int = 300_000) -> DataFrame:
    """(rep_idx, optical_group, library, u, v): pairs of pairs of one set, read group and tile at most ``distance`` apart in x and in y.

    u < v are first reads' indexes. Sets of one pair and of more than ``most`` have none. The join is by cells of the
    grid, so that large sets are not compared all with all. These are all edges; links() has no more than connect them.
    """
    places = located(sets, most)
    cell = lambda c: F.floor(F.col(c) / distance)
    left = places.select(*GROUP, "library", "rg_ordinal", "tile", F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("node").alias("u"), cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = places.select(*GROUP, "rg_ordinal", "tile", F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("node").alias("v"))
    right = right.withColumn("cx", F.explode(F.transform(steps, lambda d: F.floor(F.col("vx") / distance) + d))).withColumn("cy", F.explode(F.transform(steps, lambda d: F.floor(F.col("vy") / distance) + d)))
    close = (F.abs(F.col("ux") - F.col("vx")) <= distance) & (F.abs(F.col("uy") - F.col("vy")) <= distance)
    return left.join(right, [*GROUP, "rg_ordinal", "tile", "cx", "cy"]).where((F.col("u") < F.col("v")) & close).select(*GROUP, "library", "u", "v")


def links(sets: DataFrame, distance: int = 100, most: int = 300_000) -> DataFrame:
    """(rep_idx, optical_group, u, v): edges that connect what all edges connect, no more than a few a pair.

    Pairs in one cell of a grid of side ``distance`` + 1 are all close to each other, so each is linked to the least of
    its cell. Of two neighbouring cells one edge is enough: in each one the pairs of every x (or y) that stand nearest
    the other cell can have it, which the least and largest y (or x) among them tell. Of the cells side by side these
    are pairs by column and row of the grid, so rows grow with the pairs and not with their square.
    """
    side = distance + 1
    placed = located(sets, most).withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    cell = [*GROUP, "rg_ordinal", "tile", "cx", "cy"]
    inner = placed.select(*GROUP, F.min("node").over(Window.partitionBy(*cell)).alias("u"), F.col("node").alias("v")).where("u <> v")
    # of a column x of a cell only the least and the largest y can be nearest to a pair of another cell
    ends = placed.groupBy(*cell, "x").agg(F.min(F.struct("y", "node")).alias("first"), F.max(F.struct("y", "node")).alias("last"))
    points = ends.select(*cell, "x", F.explode(F.array_distinct(F.array("first", "last"))).alias("p")).select(*cell, "x", F.col("p.y").alias("y"), F.col("p.node").alias("node"))
    forward = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1))))
    asked = points.select(*cell, F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("node").alias("u"), F.inline(forward)).withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy"))
    met = asked.join(points.select(*cell, F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("node").alias("v")), cell)
    close = (F.abs(F.col("ux") - F.col("vx")) <= distance) & (F.abs(F.col("uy") - F.col("vy")) <= distance)
    across = met.where(close).groupBy(*cell, "dx", "dy").agg(F.min(F.struct("u", "v")).alias("e")).select(*GROUP, F.col("e.u").alias("u"), F.col("e.v").alias("v"))
    return inner.unionByName(across)


def union_find(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The component of each end of the edges (u[i], v[i]), numbered 0 to n - 1 by first use: array of 2 rows."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        root = i
        while parent[root] != root:
            root = parent[root]
        while parent[i] != root:
            parent[i], i = root, parent[i]
        return root

    for a, b in zip(*at.reshape(2, -1).tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    roots = np.array([find(i) for i in range(len(nodes))])
    return nodes[roots[at]].reshape(2, -1)


def clusters(edges: DataFrame) -> DataFrame:
    """(rep_idx, optical_group, node, cluster): connected components; a cluster's name is its least node. Only sets with an edge get here.

    Sets are dealt out and stand in order, so that Python takes a batch of whole sets at once. A pair is of one set, so
    no component spans two.
    """

    def found(rows: pa.Table) -> pa.RecordBatch:
        u, v, rep, group = (rows.column(c).to_numpy() for c in ("u", "v", "rep_idx", "optical_group"))
        names = union_find(u, v).ravel()
        node, first = np.unique(np.concatenate([u, v]), return_index=True)
        columns = {"rep_idx": np.tile(rep, 2)[first], "optical_group": np.tile(group, 2)[first].astype(np.int32), "node": node, "cluster": names[first]}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last set, which the next batch may continue
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            rep = rows.column("rep_idx").to_numpy()
            cut = int(np.searchsorted(rep, rep[-1])) if len(rep) else 0
            if cut:
                yield found(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield found(held)

    dealt = edges.select(*GROUP, "u", "v").repartition("rep_idx").sortWithinPartitions("rep_idx")
    return dealt.mapInArrow(run, "rep_idx long, optical_group int, node long, cluster long")


def optical_pairs(sets: DataFrame, distance: int = 100, most: int = 300_000) -> DataFrame:
    """(idx1, idx2, library, rep_idx, rank): pairs that are optical duplicates.

    Of each cluster all but one are: the kept one is the set's best pair if it is in the cluster, else the one of least
    x, then y, then place in the order of the set. One rule covers lists of every size.
    """
    found = clusters(links(sets, distance, most)).select("rep_idx", F.col("node").alias("idx1"), "cluster")
    members = sets.join(found, ["rep_idx", "idx1"])
    order = Window.partitionBy("rep_idx", "cluster").orderBy(F.when(F.col("rank") == 1, 0).otherwise(1), "x", "y", or_first("tile"), "idx1", "idx2")
    return members.withColumn("_place", F.row_number().over(order)).where("_place > 1").select("idx1", "idx2", "library", "rep_idx", "rank")


def optical_duplicates(optical: DataFrame) -> DataFrame:
    """(idx): reads of optical pairs that are not their set's best."""
    return optical.where("rank > 1").select(F.explode(F.array_distinct(F.array("idx1", "idx2"))).alias("idx"))


def optical_by_library(optical: DataFrame) -> DataFrame:
    """(library, optical): how many pairs are optical duplicates."""
    return optical.groupBy("library").agg(F.count(F.lit(1)).alias("optical"))
