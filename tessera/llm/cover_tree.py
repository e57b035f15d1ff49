"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors of one label are compared by cosine. On the unit sphere cosine >= c is distance <= t with
t^2 = 2 - 2c, which is a metric, so trees with covering radii can prune.

Tree: levels with halving radii. A node's centre is one of its points; the next level's centres are
taken greedily among its points so that each point lies within half the radius of one, the node's own centre first
(levels are nested). Nodes carry the true radius of their points. Small nodes are leaves.

Traversal: a pair of nodes further apart than the sum of their radii and t has no link; one whose farthest points
must be within t is linked as a whole, at the nodes, without looking at its points, which learn of it by one sum at the end; others go down, children against
children in one matrix product; leaves are compared point by point.

Distribution: rows that are equal (label and vector) are one point with a weight, so copies cost
nothing. The points of a label with more than ``cell_rows`` are dealt to the nearest of some pivots
(about one per cell_rows points, ``MOST_PIVOTS`` at most, chosen by a hash); a cell that still has more than cell_rows
is split into parts by a hash, so no task holds more than about twice that, whatever the label's size. With a cell's radius r, a point
x can have links into cell j only if its distance to pivot j is <= r + t; x is sent to the tasks of its own part and the parts of these j
only. Each pair of points meets in one task. A task returns sums of weights and a star for each group, not its pairs.

Where vectors do not cluster, all of a label's parts are within reach of each other: work is quadratic in the label's distinct
vectors then (in many dimensions no bound by radii prunes), as blocks of matrix products, spread over all pairs of parts.

Results for odd input: vectors that are null, empty, zero, or hold null or non-finite components, and rows
with a null label or id link with nothing: 0 links, a component of their own (the id, if there is one), kept. Vectors
of different lengths never link. An empty table gives no rows. Repeated rows (same id) count as further vectors.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from .common import settled
from .components import connected_components
from .simhash import Forest

COSINE = 0.98
CELL_ROWS = 4096
MOST_PIVOTS = 64
#: Parts of a cell, at most; they are numbered apart.
PARTS = 1 << 40
#: Points of a leaf, at most.
LEAF = 24
#: Entries of a matrix of distances, about.
CELLS = 1 << 21
#: Slack of bounds against rounding; the threshold itself has none.
EPS = 1e-9


class CoverTree:
    """Over unit vectors: per node its centre, radius, points (a slice of ``order``) and children."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.order = np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(points):
            apart = self.distances(0, self.order)
            self.grow(self.add(0, 0, len(points), float(apart.max())), 2.0)

    def distances(self, centre: int, to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.points[to] @ self.points[centre])))

    def add(self, centre: int, lo: int, hi: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.span.append((lo, hi))
        self.children.append([])
        return len(self.centre) - 1

    def grow(self, root: int, width: float) -> None:
        waiting = [(root, width)]
        while waiting:
            node, width = waiting.pop()
            lo, hi = self.span[node]
            if hi - lo <= LEAF or self.radius[node] < EPS:
                continue
            while width / 2 >= self.radius[node] and width > EPS:  # levels on which the node is its own only child
                width /= 2
            width /= 2
            own = self.centre[node]
            members = self.order[lo:hi]
            left = np.concatenate([[own], members[members != own]])  # the node's own centre comes first
            at, parts = lo, []
            while len(left):
                # The distances of the next points to all that are left, in one product; then greedily among them.
                some = left[: max(1, CELLS // len(left))]
                apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.points[some] @ self.points[left].T)))
                free = np.ones(len(left), bool)
                for k in range(len(some)):
                    if free[k]:
                        near = free & (apart[k] <= width)
                        near[k] = True
                        inside = left[near]
                        self.order[at : at + len(inside)] = inside
                        parts.append(self.add(int(some[k]), at, at + len(inside), float(apart[k][near].max())))
                        at += len(inside)
                        free &= ~near
                left = left[free]
            self.children[node] = parts
            waiting += [(p, width) for p in parts]

    def members(self, node: int) -> np.ndarray:
        lo, hi = self.span[node]
        return self.order[lo:hi]

    def parts(self, node: int) -> list[int]:
        return self.children[node] or [node]

    @property
    def first(self) -> np.ndarray:
        """A point of each node: its first one."""
        return self.order[[lo for lo, _ in self.span]] if self.span else self.order

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Each node's sum over its points."""
        run = np.concatenate([[0], np.cumsum(weights[self.order])])
        lo, hi = np.array(self.span, np.int64).reshape(-1, 2).T
        return run[hi] - run[lo]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Each point's sum over the nodes that it is in."""
        lo, hi = np.array(self.span, np.int64).reshape(-1, 2).T
        edges = np.zeros(len(self.order) + 1, np.int64)
        np.add.at(edges, lo, values)
        np.add.at(edges, hi, -values)
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(edges[:-1])
        return out


class Links:
    """What a traversal finds, told by nodes where all their points take part, and by points otherwise.

    ``whole`` of a node: how much weight each of its points is linked with through links that hold for all of them. A node
    linked with itself counts its own weight in and each point's own out again (``selves``).
    """

    def __init__(self, a: CoverTree, b: CoverTree, weights_a: np.ndarray, weights_b: np.ndarray) -> None:
        self.trees, self.weights = (a, b), (weights_a, weights_b)
        self.mass = [t.sums(w) for t, w in zip(self.trees, self.weights, strict=True)]
        self.whole = [np.zeros(len(t.centre), np.int64) for t in self.trees]
        self.selves = np.zeros(len(a.centre), np.int64)
        self.nodes: list[tuple[np.ndarray, np.ndarray]] = []
        self.points: list[tuple[np.ndarray, np.ndarray]] = []

    def all_of(self, u: np.ndarray, v: np.ndarray, same: bool) -> None:
        """Each point of node u with each of v; of one tree, a node may come with itself."""
        itself = u == v if same else np.zeros(len(u), bool)
        self.selves[u[itself]] += 1
        u, v = u[~itself], v[~itself]
        np.add.at(self.whole[0], u, self.mass[1][v])
        np.add.at(self.whole[1], v, self.mass[0][u])
        self.nodes.append((u, v))

    def sums(self, side: int) -> np.ndarray:
        """Weight each point of a side is linked with."""
        tree, weights = self.trees[side], self.weights[side]
        whole = self.whole[side].copy()
        if side == 0:
            whole += self.selves * self.mass[0]
        total = tree.spread(whole)
        if side == 0:
            total -= tree.spread(self.selves) * weights
        for pair in self.points:
            np.add.at(total, pair[side], self.weights[1 - side][pair[1 - side]])
        return total

    def edges(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points, of the first tree and the second, that join all that is linked; see ``unions`` for the rest."""
        centres = [np.array(t.centre, np.int64) for t in self.trees]
        for u, v in self.nodes:
            yield centres[0][u], centres[1][v]
        yield from self.points

    def unions(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Points of a side and the centre of a node all of whose points are linked with something in common."""
        tree = self.trees[side]
        met = np.zeros(len(tree.centre), bool)
        for pair in self.nodes:
            met[pair[side]] = True
        if side == 0:
            met |= self.selves > 0
        top = np.flatnonzero(met)
        parts = [tree.members(int(k)) for k in top]
        return (np.concatenate(parts), np.repeat(np.array(tree.centre, np.int64)[top], [len(p) for p in parts])) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def linked_points(a: CoverTree, b: CoverTree, cosine: float, weights_a: np.ndarray, weights_b: np.ndarray) -> Links:
    """All links between points of two trees, or of one, given twice."""
    found, same = Links(a, b, weights_a, weights_b), a is b
    if not len(a.points) or not len(b.points):
        return found
    reach = math.sqrt(2 - 2 * cosine)
    (ra, ca, na), (rb, cb, nb) = ((np.array(t.radius), t.points[t.centre], np.array([hi - lo for lo, hi in t.span])) for t in (a, b))
    waiting = [(0, 0)]
    while waiting:
        u, v = waiting.pop()
        if na[u] <= LEAF and nb[v] <= LEAF or not a.children[u] and not b.children[v]:
            p, q = a.members(u), b.members(v)
            i, j = np.nonzero(a.points[p] @ b.points[q].T >= cosine)
            p, q = p[i], q[j]
            if same and u == v:
                p, q = p[p < q], q[p < q]
            if len(p):
                found.points.append((p, q))
            continue
        us, vs = np.array(a.parts(u)), np.array(b.parts(v))
        block = max(1, CELLS // len(vs))
        for k in range(0, len(us), block):
            x = us[k : k + block]
            apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (ca[x] @ cb[vs].T)))
            i, j = np.nonzero(apart <= ra[x][:, None] + rb[vs][None, :] + reach + EPS)
            m, n, far = x[i], vs[j], apart[i, j] + ra[x][i] + rb[vs][j]
            if same and u == v:
                once = m <= n
                m, n, far = m[once], n[once], far[once]
            whole = far <= reach - EPS
            if same:
                whole &= (m != n) | (na[m] > 1)
            found.all_of(m[whole], n[whole], same)
            left = ~whole
            if same:
                left &= (m != n) | (na[m] > 1)  # a point has no link with itself
            # Pairs of single points are compared at once, the others go down.
            single = left & (na[m] == 1) & (nb[n] == 1)
            if single.any():
                p, q = np.array(a.first)[m[single]], np.array(b.first)[n[single]]
                close = (a.points[p] * b.points[q]).sum(axis=1) >= cosine
                found.points.append((p[close], q[close]))
            rest = left & ~single
            waiting += zip(m[rest].tolist(), n[rest].tolist(), strict=True)
    return found


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column, all lists of one length, as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def compare_cells(group: pa.Table, cosine: float) -> pa.Table:
    """(point, links, root) of a pair task: how much weight each point is linked with here, and its group's first point."""
    ids, weights = group.column("point").to_numpy(), group.column("weight").to_numpy()
    points, second = unit(matrix(group.column("vector"))), group.column("second").to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(ids, kind="stable")
    ids, weights, points, second = ids[order], weights[order], points[order], second[order]
    links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
    one, two = np.flatnonzero(~second), np.flatnonzero(second)
    a = CoverTree(points[one])
    # A task of two cells may hold points of one only, as reach is one-sided; then there is nothing to compare.
    itself = group.column("first")[0] == group.column("last")[0]
    b, other = (a, one) if itself else (CoverTree(points[two]), two)
    told = linked_points(a, b, cosine, weights[one], weights[other])
    links[one] += told.sums(0)
    links[other] += told.sums(1)
    for side, at in ((0, one), (1, other)):
        points, centres = told.unions(side)
        forest.join(at[points], at[centres])
    edges = list(told.edges())
    if edges:
        forest.join(one[np.concatenate([p for p, _ in edges])], other[np.concatenate([q for _, q in edges])])
    found = np.flatnonzero(links)
    return pa.table({"point": pa.array(ids[found], pa.int64()), "links": pa.array(links[found], pa.int64()), "root": pa.array(ids[forest.roots(found)], pa.int64())})


def pair_tasks(points: DataFrame, cosine: float, cell_rows: int, most_pivots: int) -> DataFrame:
    """points (label, size, vector, point, weight) dealt to pair tasks: _label, _size, first, second_cell, second, and the point."""
    reach = math.sqrt(2 - 2 * cosine)
    kind = ["label", "size"]
    counts = points.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"))
    chance = F.when(F.col("n") > cell_rows, F.least(F.ceil(F.col("n") / cell_rows), F.lit(most_pivots)) / F.col("n")).otherwise(0.0)
    # About most_pivots vectors a label at most.
    pivots = points.join(counts, kind).where(F.pmod(F.xxhash64("point"), F.lit(1 << 40)) / float(1 << 40) < chance).groupBy(*kind).agg(F.sort_array(F.collect_list(F.struct("point", "vector")))["vector"].alias("pivots"))
    met = points.join(pivots, kind, "left").select(*kind, "vector", "point", "weight", F.coalesce("pivots", F.array()).alias("pivots"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = [[0.0]] * batch.num_rows
            rows: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True)):
                rows.setdefault(key, []).append(k)
            for at in rows.values():
                pivots = batch.column(5)[at[0]].as_py()  # those of the label and length
                if pivots:
                    own = unit(matrix(batch.column(2).take(pa.array(at))))
                    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (own @ unit(np.array(pivots, float)).T)))
                    for k, row in zip(at, apart.tolist(), strict=True):
                        found[k] = row
            home = [int(np.argmin(d)) for d in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.list_(pa.float64())), pa.array(home, pa.int32())], names=[*batch.schema.names[:5], "apart", "home"])

    placed = settled(met.mapInArrow(near, met.drop("pivots").schema.add("apart", ArrayType(DoubleType())).add("home", IntegerType())))
    cells = placed.groupBy(*kind, "home").agg(F.max(F.get("apart", F.col("home"))).alias("radius"), F.ceil(F.count(F.lit(1)) / cell_rows).alias("parts"))
    cells = cells.groupBy(*kind).agg(F.map_from_entries(F.collect_list(F.struct("home", F.struct("radius", "parts")))).alias("cells"))
    cell = lambda j: F.try_element_at("cells", j)
    part = lambda j, k: j.cast("long") * PARTS + k
    reached = F.filter(F.sequence(F.lit(0), F.size("apart") - 1), lambda j: cell(j).isNotNull() & ((j == F.col("home")) | (F.get("apart", j) <= cell(j)["radius"] + reach + EPS)))
    others = F.flatten(F.transform(reached, lambda j: F.transform(F.sequence(F.lit(0).cast("long"), cell(j)["parts"] - 1), lambda k: part(j, k))))
    own = part(F.col("home"), F.pmod(F.xxhash64("point", F.lit(1)), cell(F.col("home"))["parts"]))
    sent = placed.join(cells, kind).select(*kind, "point", "weight", "vector", own.alias("own"), F.explode(others).alias("other"))
    return sent.select(*kind, F.least("own", "other").alias("first"), F.greatest("own", "other").alias("last"), (F.col("own") > F.col("other")).alias("second"), "point", "weight", "vector")


def dedup_embeddings(rows: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    judged = rows.withColumn("fine", fine)
    points = settled(judged.where("fine").groupBy("label", "vector").agg(F.min("vec_id").alias("point"), F.count(F.lit(1)).alias("weight")).select("label", F.size("vector").alias("size"), "vector", "point", "weight"))
    tasks = pair_tasks(points, cosine, cell_rows, most_pivots)
    found = settled(tasks.groupBy("label", "size", "first", "last").applyInArrow(lambda t: compare_cells(t, cosine), "point long, links long, root long"))
    links = found.groupBy("point").agg(F.sum("links").alias("links"))
    roots = connected_components(found, "point", "root")
    classes = (
        points.join(links, "point", "left").join(roots, F.col("point") == F.col("node"), "left")
        .select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("_links"), F.coalesce("root", "point").alias("_root"))
    )
    met = judged.where("fine").join(classes, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")))
    result = met.select("vec_id", F.col("_links").cast("long").alias("n_links"), F.col("_root").alias("component_id"), (F.col("vec_id") == F.col("_root")).alias("kept"))
    alone = judged.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return result.unionByName(alone)


#: The same in SQL, pair by pair.
EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings e JOIN c ON e.vec_id = c.node LEFT JOIN n ON n.a = e.vec_id
"""
