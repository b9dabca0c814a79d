"""Near-duplicate embeddings: exact threshold pairs by cover-tree dual traversal.

Vectors are points on the unit sphere, where cosine >= c is a distance of at
most sqrt(2 - 2c). Equal vectors of one label travel as one point with a count.
A label with more points than a block gets a net of pivots of its own, as many
as it has blocks, and its points are dealt to the nearest pivot's cell. Two
cells are neighbours if the distance of their pivots less their covering radii
is within the threshold; only blocks of neighbour cells meet, by a join on the
table of neighbours. A pair of blocks is a task: each builds a cover tree
(nested levels with halving radii) and a dual traversal drops node pairs that
are too far apart, takes whole node pairs that are close enough, and compares
the rest in double precision.

A task returns link counts and a spanning forest, never pairs: a group of
copies of any size costs rows in proportion to its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.llm.components import Forest, sorted_groups
from loomkb.operators.components import connected_components
from loomkb.operators.retrieval import dot
from loomkb.session import table
from loomkb.storage import materialize

#: Points of a block, points of a leaf, and the widest slack that rounding can need.
BLOCK, LEAF, SLACK = 2048, 128, 1e-7
#: Nets are fitted on at most so many points, bytes and pivots over all labels; a cell beyond them has several blocks.
NET_SAMPLE, NET_BYTES, PIVOTS = 16_384, 64 << 20, 2048


@dataclass
class Node:
    center: np.ndarray
    radius: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)
    centers: np.ndarray | None = None
    radii: np.ndarray | None = None


def cover_tree(points: np.ndarray, members: np.ndarray | None = None, level: float = 1.0) -> Node:
    """Nested nets over unit vectors: children of a level are more than ``level`` apart and cover the node."""
    members = np.arange(len(points)) if members is None else members
    center = points[members[0]]
    gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points[members] @ center)))
    node = Node(center, float(gaps.max()) + SLACK, members)
    if len(members) <= LEAF or node.radius <= 1e-4:
        return node
    while node.radius <= level:  # an empty level
        level /= 2
    left, gap = members, gaps
    while len(left):
        near = gap <= level
        part, left = left[near], left[~near]
        # the first point of the part is the child's center
        node.children.append(cover_tree(points, part, level / 2))
        if len(left):
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points[left] @ points[left[0]])))
    node.centers = np.stack([c.center for c in node.children])
    node.radii = np.array([c.radius for c in node.children])
    return node


class Links:
    """What a pair of blocks finds: links per point, and which points hang together."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.links, self.forest = counts, np.zeros(len(counts), np.int64), Forest(len(counts))

    def all_of(self, a: np.ndarray, b: np.ndarray | None) -> None:
        """Every point of ``a`` with every point of ``b``; None: with each other."""
        if b is None:
            self.links[a] += self.counts[a].sum() - self.counts[a]
        else:
            self.links[a] += self.counts[b].sum()
            self.links[b] += self.counts[a].sum()
        for x in (*a[1:], *(() if b is None else b)):
            self.forest.union(int(a[0]), int(x))

    def some_of(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray, same: bool) -> None:
        if same:
            linked = np.triu(linked, 1)
        if not linked.any():
            return
        self.links[a] += linked @ self.counts[b]
        self.links[b] += self.counts[a] @ linked
        for i, j in zip(*np.nonzero(linked)):
            self.forest.union(int(a[i]), int(b[j]))


def dual_traversal(points: np.ndarray, norms: np.ndarray, raw: np.ndarray, first: Node, second: Node, cosine: float, out: Links) -> None:
    """Add every link between the points of two trees; one tree twice: within it."""
    limit = float(np.sqrt(2.0 - 2.0 * cosine))

    def compare(a: Node, b: Node) -> None:
        if a is b and 2 * a.radius <= limit - SLACK:
            out.all_of(a.members, None)
            return
        linked = (raw[a.members] @ raw[b.members].T) / np.outer(norms[a.members], norms[b.members]) >= cosine
        out.some_of(a.members, b.members, linked, a is b)

    todo = [(first, second)]
    while todo:
        a, b = todo.pop()
        if not a.children and not b.children:
            compare(a, b)
            continue
        if a is b:
            if 2 * a.radius <= limit - SLACK:
                out.all_of(a.members, None)
                continue
            xs = ys = a.children
            cx = cy = a.centers
            rx = ry = a.radii
        else:
            # a leaf stands for itself; of two inner nodes both open
            xs, cx, rx = (a.children, a.centers, a.radii) if a.children else ([a], a.center[None], np.array([a.radius]))
            ys, cy, ry = (b.children, b.centers, b.radii) if b.children else ([b], b.center[None], np.array([b.radius]))
        gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (cx @ cy.T)))
        reach = rx[:, None] + ry[None, :]
        near = gaps - reach <= limit + SLACK
        if a is b:
            near = np.triu(near)
        inside = near & (gaps + reach <= limit - SLACK)
        for i, j in zip(*np.nonzero(near)):
            x, y = xs[i], ys[j]
            if inside[i, j] and x is not y:
                out.all_of(x.members, y.members)
            else:
                todo.append((x, y))


def nested_net(sample: np.ndarray, most: int) -> np.ndarray:
    """Points of ``sample``, each farthest from those before it: every prefix is a net."""
    if not len(sample):
        return sample
    chosen, gap = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(most, len(sample)):
        gap = np.minimum(gap, 2.0 - 2.0 * (sample @ sample[chosen[-1]]))
        if gap.max() <= 1e-12:
            break
        chosen.append(int(gap.argmax()))
    return sample[chosen]


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Only vectors of one (not null) label and one length are compared. Null and
    zero vectors and those with null or non-finite components link with
    nothing. Rows with one id count as vectors of their own in n_links, each
    with its own vector's links, and share their component; null ids are
    returned without links. An empty table
    gives an empty result.
    """
    v = F.col("__v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("__v"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    norm = F.sqrt(dot(v, v))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite
    good = good & F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False))
    rows = materialize(rows.withColumn("good", good).withColumn("key", F.when(good, F.xxhash64("label", "__v"))), "vectors")
    points = rows.where("good").groupBy("key", "label", "__v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # numbers of their own, fixed by the written table: an id may name several vectors
    points = materialize(points.withColumn("point", F.monotonically_increasing_id()), "points")
    links = _links(points.drop("first"), cosine)
    edges = links.select(F.col("point").alias("a"), F.col("peer").alias("b")).unionByName(_of_one_id(rows.where("good"), points))
    components = connected_components(edges)
    totals = links.groupBy("point").agg(F.sum("links").alias("links"))
    found = points.join(totals, "point", "left").join(components.withColumnRenamed("node", "point"), "point", "left")
    found = found.select("key", "label", "__v", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "point").alias("component"))
    found = materialize(found, "found")
    names = found.groupBy("component").agg(F.min("first").alias("component_id"))
    found = found.drop("first").join(names, "component")
    linked = rows.where("good").join(found, ["key", "label", "__v"]).select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _of_one_id(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b): points of ids that name several vectors, and the least of them for each."""
    several = rows.groupBy("vec_id").agg(F.min("key").alias("k"), F.max("key").alias("most")).where("k <> most").select("vec_id")
    named = materialize(rows.join(several, "vec_id").join(points, ["key", "label", "__v"]).select("vec_id", "point").distinct(), "named")
    hubs = named.groupBy("vec_id").agg(F.min("point").alias("b"))
    return named.join(hubs, "vec_id").select(F.col("point").alias("a"), "b")


def _nets(points: DataFrame, sizes: DataFrame) -> dict[tuple, np.ndarray]:
    """Pivots of each (label, length) that has more points than a block.

    Fitted on a sample by hash: at most NET_SAMPLE points, NET_BYTES and PIVOTS
    over all labels, shared by their sizes. All points are dealt to the pivots.
    """
    large = sizes.where(F.col("n") > BLOCK)
    total = large.agg(F.sum("n").alias("n"), F.max("dim").alias("dim")).first()
    if not total["n"]:
        return {}
    rows = max(1, min(NET_SAMPLE, NET_BYTES // (8 * total["dim"])))
    mine = points.join(large.select("label", "dim", "n"), ["label", "dim"])
    sample = mine.select("label", "dim", "n", "__v").orderBy(F.xxhash64("__v"), "label").limit(rows).toPandas()
    share = min(1.0, PIVOTS * BLOCK / total["n"])
    nets = {}
    for key, group in sample.groupby(["label", "dim"]):
        unit = np.stack(group["__v"].to_list())
        nets[key] = nested_net(unit / np.linalg.norm(unit, axis=1, keepdims=True), max(1, math.ceil(share * group["n"].iloc[0] / BLOCK)))
    return nets


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _neighbours(cells: DataFrame, nets: dict[tuple, np.ndarray], limit: float) -> DataFrame:
    """(label, dim, cell, cell2) with cell <= cell2: cells whose points may be within ``limit``.

    Radii of the nets' cells come to the driver, at most one number for each
    pivot. Labels without a net have one cell, its own neighbour.
    """
    spark = cells.sparkSession
    kind = cells.schema["label"].dataType.simpleString()
    radii: dict[tuple, dict[int, float]] = {}
    for r in cells.where("cell >= 0").collect():
        radii.setdefault((r["label"], r["dim"]), {})[r["cell"]] = r["radius"]
    parts = []
    for key, of_cell in radii.items():
        ids = np.array(sorted(of_cell))
        radius = np.array([of_cell[i] for i in ids])
        near = np.triu(distances(nets[key][ids], nets[key][ids]) - radius[:, None] - radius[None, :] <= limit + SLACK)
        i, j = np.nonzero(near | np.eye(len(ids), dtype=bool))
        parts.append(pd.DataFrame({"label": key[0], "dim": key[1], "cell": ids[i], "cell2": ids[j]}))
    alone = cells.where("cell < 0").select("label", "dim", "cell", F.col("cell").alias("cell2"))
    if not parts:
        return alone
    schema = f"label {kind}, dim int, cell int, cell2 int"
    return alone.unionByName(spark.createDataFrame(pd.concat(parts), schema))


def _links(points: DataFrame, cosine: float) -> DataFrame:
    """(point, links, peer): links to other points, counted with their copies, and a smaller point of the same component."""
    limit = float(np.sqrt(2.0 - 2.0 * cosine))
    points = points.withColumn("dim", F.size("__v"))
    sizes = materialize(points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")), "labels")
    nets = _nets(points, sizes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.assign(cell=-1, gap=2.0)
            for key, at in batch.groupby(["label", "dim"]).indices.items():
                # a length that the sample missed has no pivot: one cell with an open radius
                net = nets.get(key)
                if net is None:
                    continue
                for start in range(0, len(at), 1024):
                    part = at[start : start + 1024]
                    x = np.stack(batch["__v"].iloc[part].to_list()).astype(np.float64)
                    d = distances(x / np.linalg.norm(x, axis=1, keepdims=True), net)
                    out.iloc[part, out.columns.get_loc("cell")] = d.argmin(axis=1)
                    out.iloc[part, out.columns.get_loc("gap")] = d.min(axis=1)
            yield out

    kind = points.schema["label"].dataType.simpleString()
    columns = points.select("point", "label", "copies", "__v", "dim")
    placed = materialize(columns.mapInPandas(assign, f"point long, label {kind}, copies long, __v array<double>, dim int, cell int, gap double"), "placed")
    cell = ["label", "dim", "cell"]
    cells = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"), F.max("gap").alias("radius"))
    cells = materialize(cells, "cells")
    block = lambda c, part: F.xxhash64("label", "dim", c, part)
    dealt = placed.join(cells.select(*cell, "parts"), cell).withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")))
    blocked = materialize(dealt.select(block("cell", "part").alias("block"), "point", "copies", "__v"), "blocked")
    # blocks of neighbour cells: numbers of parts, multiplied out
    counts = cells.select(*cell, "parts")
    met = _neighbours(cells, nets, limit).join(counts, cell).join(counts.select("label", "dim", F.col("cell").alias("cell2"), F.col("parts").alias("parts2")), ["label", "dim", "cell2"])
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    first = F.when(F.col("cell") == F.col("cell2"), F.col("part")).otherwise(F.lit(0).cast("long"))
    met = met.withColumn("part2", F.explode(F.sequence(first, F.col("parts2") - 1)))
    met = met.select(block("cell", "part").alias("block"), block("cell2", "part2").alias("block2"))
    pairs = materialize(met.select(F.xxhash64("block", "block2").alias("pair"), "block", "block2"), "pairs")
    sides = pairs.select("pair", "block", F.lit(0).alias("side"), (F.col("block") == F.col("block2")).alias("same")).union(
        pairs.where("block <> block2").select("pair", F.col("block2"), F.lit(1), F.lit(False))
    )
    shipped = blocked.select("block", "point", "copies", "__v").join(sides, "block")
    shipped = shipped.repartition("pair").sortWithinPartitions("pair", "side", "point")

    def traverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, "pair"):
            raw = np.stack(g["__v"]).astype(np.float64)
            norms = np.linalg.norm(raw, axis=1)
            unit, side = raw / norms[:, None], g["side"]
            out = Links(g["copies"].astype(np.int64))
            first = cover_tree(unit, np.flatnonzero(side == 0)) if (side == 0).any() else None
            second = first if bool(g["same"][0]) else cover_tree(unit, np.flatnonzero(side == 1)) if (side == 1).any() else None
            if first is None or second is None:
                continue
            dual_traversal(unit, norms, raw, first, second, cosine, out)
            hit = np.flatnonzero(out.links)
            if len(hit):
                peers = g["point"].astype(np.int64)[out.forest.roots()]
                yield pd.DataFrame({"point": g["point"][hit].astype(np.int64), "links": out.links[hit], "peer": peers[hit]})

    links = shipped.select("pair", "side", "same", "point", "copies", "__v").mapInPandas(traverse, "point long, links long, peer long")
    return materialize(links, "links")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
    AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, CAST(count(l.b) AS BIGINT) AS n_links, min(c.component_id) AS component_id, e.vec_id = min(c.component_id) AS kept
FROM embeddings e LEFT JOIN links l ON l.a = e.vec_id LEFT JOIN comp c ON c.vec_id = e.vec_id GROUP BY e.vec_id
"""
