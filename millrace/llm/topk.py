"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors are dealt to cells (nearest of a bounded set of pivots) and cells are cut into blocks of about BLOCK vectors;
each block holds a cover tree, and the queries of a cell hold trees of about GROUP queries. A pair of nodes is passed
over if no inner product in it can reach the worst k-th score of the query node's queries: for centres q, r with
covering radii Rq, Rr it is at most q.r + Rr|q| + Rq|r| + Rq Rr. The data's trees hang in one: cells over blocks over nodes.
A group first searches one block of its own cell, which gives it k-th scores to begin with; from then on it goes down: to
the cells whose ball can still reach them (a table of at most MOST_PIVOTS balls goes to each task), to their blocks whose
root can (joined by cell), and in those to the nodes. A block's tree is sent once for TOGETHER groups that search it.
All arithmetic on scores is exact (integers under 2**53).

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without vec_id, take no
part. Shorter vectors count as padded with zeros. A query's own rows are all with its vec_id. Rows that repeat both a
vec_id and its vector are one row, as query and as candidate; vectors of one vec_id that differ are rows of their own. Ties go to the smaller vec_id. Fewer
candidates than k give fewer rows; the empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

#: Vectors of a data tree, of a query tree, of a leaf; vectors searched between looks at the bounds; most cells.
BLOCK, GROUP, LEAF, BATCH, MOST_PIVOTS = 2048, 256, 64, 512, 1024
#: Query groups, about, that search a block in one row.
TOGETHER = 16


@dataclass
class Node:
    """Points lo..hi of the tree's order lie within radius of the centre; a leaf has no children. A loose leaf holds
    those points of its parent, and has the parent's centre, that have too little company for nodes of their own."""

    centre: object
    norm: float
    radius: float
    lo: int
    hi: int
    children: list
    loose: bool = False


@dataclass
class Tree:
    ids: object
    points: object
    root: Node


def build(ids, points) -> Tree:
    """A cover tree: a node's centre is a point of it, its children's centres lie more than half the node's level
    distance apart and cover all of its points within that; levels halve. Radii are the distances really reached."""
    import numpy as np

    order = np.lexsort((ids,))
    ids, points = np.asarray(ids)[order], np.asarray(points, float)[order]
    place: list = []

    def node(own, centre, radius) -> Node:
        lo, far, norm = len(place), float(radius.max(initial=0.0)), float(np.linalg.norm(points[centre]))
        children: list[Node] = []
        loose = [np.arange(len(own))]
        if len(own) > LEAF and far > 0:
            level, rest, dist, at, dull, loose = far / 2, np.arange(len(own)), radius, centre, 0, []
            while len(rest):
                near = dist <= level
                if near.sum() >= LEAF // 4:
                    children.append(node(own[rest[near]], at, dist[near]))
                    dull = 0
                else:
                    loose.append(rest[near])
                    dull += 1
                rest = rest[~near]
                if dull >= LEAF // 2:
                    loose.append(rest)
                    break
                if len(rest):
                    at = own[rest[0]]
                    dist = np.sqrt(((points[own[rest]] - points[at]) ** 2).sum(axis=1))
        if some := [x for x in loose if len(x)]:
            some = np.concatenate(some)
            begin = len(place)
            place.extend(own[some])
            if children:
                children.append(Node(points[centre], norm, float(radius[some].max()), begin, len(place), [], True))
        return Node(points[centre], norm, far, lo, len(place), children)

    every = np.arange(len(ids))
    root = node(every, 0, np.sqrt(((points - points[0]) ** 2).sum(axis=1)))
    return Tree(ids[place], points[place], root)


class Search:
    """The k best of each query of a tree, over one data tree after another. kth: scores to beat to begin with."""

    def __init__(self, queries: Tree, k: int, kth=None) -> None:
        import numpy as np

        self.q, self.k, self.best, self.products = queries, k, [[] for _ in queries.ids], 0
        self.kth = np.full(len(queries.ids), -np.inf) if kth is None else np.array(kth, float)

    def run(self, data: Tree) -> Search:
        self.data = data
        self._visit(self.q.root, data.root)
        return self

    def _visit(self, q: Node, r: Node) -> None:
        """All pairs of children at once: those of leaves are searched together, the others in order of their bounds."""
        import numpy as np

        if not q.children and not r.children:
            return self._leaves([q], [r])
        qs, rs = q.children or [q], r.children or [r]
        bound, worst = self._bounds(qs, rs), lambda n: self.kth[n.lo : n.hi].min()
        q_leaf, r_leaf = [i for i, n in enumerate(qs) if not n.children], [j for j, n in enumerate(rs) if not n.children]
        if q_leaf and r_leaf:
            least = np.array([worst(qs[i]) for i in q_leaf])
            reach = (bound[np.ix_(q_leaf, r_leaf)] - least[:, None]).max(axis=0)
            order = [r_leaf[j] for j in np.argsort(-reach) if reach[j] >= 0]
            some, held = [], 0
            for j in order:
                some.append(rs[j])
                held += rs[j].hi - rs[j].lo
                if held >= BATCH:
                    self._leaves([qs[i] for i in q_leaf], some)
                    some, held = [], 0
                    q_leaf = [i for i in q_leaf if bound[i, order].max() >= worst(qs[i])]
            if some and q_leaf:
                self._leaves([qs[i] for i in q_leaf], some)
        deep = [(-bound[i, j], i, j) for i, a in enumerate(qs) for j in (range(len(rs)) if a.children else [j for j, b in enumerate(rs) if b.children])]
        for b, i, j in sorted(deep):
            if -b >= worst(qs[i]):
                self._visit(qs[i], rs[j])

    @staticmethod
    def _bounds(qs: list[Node], rs: list[Node]):
        """No inner product of a pair of nodes is larger."""
        import numpy as np

        dim = min(len(qs[0].centre), len(rs[0].centre))
        qc, rc = np.array([n.centre[:dim] for n in qs]), np.array([n.centre[:dim] for n in rs])
        qn, rn = np.array([n.norm for n in qs])[:, None], np.array([n.norm for n in rs])[None, :]
        qr, rr = np.array([n.radius for n in qs])[:, None], np.array([n.radius for n in rs])[None, :]
        bound = qc @ rc.T + rr * qn + qr * rn + qr * rr
        return bound + 1e-9 * (1 + np.abs(bound))  # distances are rounded; scores aren't

    def _leaves(self, qs: list[Node], rs: list[Node]) -> None:
        import numpy as np

        mine, rows = (np.concatenate([np.arange(n.lo, n.hi) for n in ns]) for ns in (qs, rs))
        dim = min(self.q.points.shape[1], self.data.points.shape[1])
        scores, ids, k = self.q.points[mine, :dim] @ self.data.points[rows, :dim].T, self.data.ids[rows], self.k
        self.products += scores.size
        scores[self.q.ids[mine][:, None] == ids[None, :]] = -np.inf
        least = np.maximum(self.kth[mine], np.finfo(float).min)
        able = scores >= least[:, None]
        if len(rows) > k and able.sum() > 4 * k * len(mine):
            able = scores >= np.maximum(np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k], least)[:, None]
        for i in np.flatnonzero(able.any(axis=1)):
            found = np.flatnonzero(able[i])
            if len(found) > k:
                found = found[np.lexsort((ids[found], -scores[i, found]))[:k]]
            best = sorted({*self.best[mine[i]], *zip((-scores[i, found]).tolist(), ids[found].tolist(), strict=True)})[:k]
            self.best[mine[i]] = best
            if len(best) == k:
                self.kth[mine[i]] = max(self.kth[mine[i]], -best[-1][0])


def _valid(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: the integer components of the rows that take part, each once."""
    e = F.col("embedding")
    good = (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v")).distinct()


def _cells(vectors: DataFrame, pivots: list[list[int]]) -> DataFrame:
    """vectors with the number of the nearest pivot."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        width = max(map(len, pivots))
        centres = np.array([p + [0] * (width - len(p)) for p in pivots], float)
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            near = ((centres**2).sum(axis=1)[None, :] - 2 * (x[:, :width] @ centres.T)).argmin(axis=1) if len(x) else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(near.astype("i4"))], names=[*batch.schema.names, "cell"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, cell int")


def _matrix(lists, width: int = 0):
    """The rows of lists (of integers), padded with zeros to the longest or to width."""
    import numpy as np

    sizes = np.diff(lists.offsets.to_numpy())
    width = max(width, int(sizes.max(initial=0)))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _trees(celled: DataFrame, size: int, name: str) -> DataFrame:
    """id, cell, slice, centre, norm, radius, tree: a row for each tree of about size vectors."""
    cuts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("slices"))
    dealt = celled.join(F.broadcast(cuts), "cell")  # at most MOST_PIVOTS rows
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("vec_id", "v", F.lit(7)), "slices").cast("int"))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        width = max(map(len, group["v"]))
        tree = build(group["vec_id"].to_numpy(), np.array([[*v, *[0] * (width - len(v))] for v in group["v"]], float))
        most = np.abs(tree.points).max(initial=0)
        tree.points = tree.points.astype(np.int16 if most < 2**15 else np.int64)
        r = tree.root
        return pd.DataFrame([{"cell": group["cell"].iloc[0], "slice": group["slice"].iloc[0], "centre": r.centre.tolist(), "norm": r.norm, "radius": r.radius, "tree": pickle.dumps(tree, 5)}])

    made = dealt.groupBy("cell", "slice").applyInPandas(make, "cell int, slice int, centre array<double>, norm double, radius double, tree binary")
    return stored(made.withColumn("id", F.concat_ws("-", "cell", "slice")), name)


def _load(blob: bytes) -> Tree:
    tree = pickle.loads(blob)  # made by _trees in the same run
    tree.points = tree.points.astype(float)
    return tree


FOUND = "g string, b string, query_id long, vec_id long, score long, kth binary, worst double"


def _searched(pairs: DataFrame, q: DataFrame, r: DataFrame, k: int) -> DataFrame:
    """pairs (g, b, kth) of the trees q (g, q_tree) and r (b, r_tree): rows of scores, and for each pair a row with the k-th
    scores reached. A row that is searched holds a block's tree and those of about TOGETHER groups."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64()]
        names = ["g", "b", "query_id", "vec_id", "score", "kth", "worst"]
        for batch in batches:
            for row in range(batch.num_rows):
                b, data = batch.column("b")[row].as_py(), _load(batch.column("r_tree")[row].as_py())
                for one in batch.column("asked")[row]:
                    g, kth = one["g"].as_py(), one["kth"].as_py()
                    search = Search(_load(one["q_tree"].as_py()), k, None if kth is None else np.frombuffer(kth)).run(data)
                    rows = [(g, b, int(q), i, int(-s), None, None) for q, best in zip(search.q.ids, search.best, strict=True) for s, i in best]
                    rows.append((g, b, None, None, None, search.kth.tobytes(), float(search.kth.min())))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("g"), "parts"))
    asked = dealt.join(q, "g").groupBy("b", "part").agg(F.collect_list(F.struct("g", "kth", "q_tree")).alias("asked"))
    return asked.join(r, "b").repartition("b", "part").select("b", "r_tree", "asked").mapInArrow(run, FOUND)


def _reaching(groups: DataFrame, balls: list) -> DataFrame:
    """g, cell: the cells whose ball (cell, centre, radius) can reach the worst of a group (g, q, worst)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        width = max(len(c) for _, c, _ in balls)
        centres = np.array([[*c, *[0.0] * (width - len(c))] for _, c, _ in balls])
        radii, norms = np.array([r for *_, r in balls]), np.linalg.norm(centres, axis=1)
        for batch in batches:
            gs, cells = [], []
            for g, q, worst in zip(*(batch.column(c).to_pylist() for c in ("g", "q", "worst")), strict=True):
                at = min(width, len(q["centre"]))
                bound = centres[:, :at] @ np.array(q["centre"][:at]) + radii * q["norm"] + q["radius"] * (norms + radii)
                keep = np.flatnonzero(bound + 1e-9 * np.abs(bound) + 1e-6 >= worst)
                gs += [g] * len(keep)
                cells += [balls[i][0] for i in keep]
            yield pa.record_batch([pa.array(gs, pa.string()), pa.array(cells, pa.int32())], names=["g", "cell"])

    return groups.select("g", "q", "worst").mapInArrow(run, "g string, cell int")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the highest inner products for each row of queries, from
    vectors (vec_id, embedding); components become floor(scale * x)."""
    ship(vectors.sparkSession)
    data, asked = stored(_valid(vectors, scale), "top-data"), _valid(queries, scale)
    n = data.count()
    drawn = data.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").limit(max(1, min(MOST_PIVOTS, n // BLOCK)))
    pivots = [list(r.v) for r in drawn.collect()] or [[0]]
    blocks = _trees(_cells(data, pivots), BLOCK, "top-blocks")
    groups = _trees(_cells(asked, pivots), GROUP, "top-groups")
    q = groups.select(F.col("id").alias("g"), F.col("cell").alias("g_cell"), F.col("tree").alias("q_tree"), F.struct("centre", "norm", "radius").alias("q"))
    r = blocks.select(F.col("id").alias("b"), "cell", "slice", F.col("tree").alias("r_tree"), F.struct("centre", "norm", "radius").alias("r"))
    trees = (q.select("g", "q_tree"), r.select("b", "r_tree"))
    # A cell's ball: about its first block's centre, wide enough for every block of it. At most MOST_PIVOTS rows.
    heads = r.groupBy("cell").agg(F.min_by(F.struct("b", "r"), "slice").alias("head"))
    apart = F.sqrt(F.greatest(F.lit(0.0), F.col("r.norm") ** 2 + F.col("head.r.norm") ** 2 - 2 * _dot("r.centre", "head.r.centre")))
    wide = r.join(F.broadcast(heads), "cell").groupBy("cell").agg(F.any_value("head.b").alias("b"), F.any_value("head.r.centre").alias("centre"), F.max(apart + F.col("r.radius")).alias("radius"))
    balls = [(x.cell, x.centre, x.radius * (1 + 1e-9) + 1e-3, x.b) for x in wide.collect()]
    if not balls:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    heads = vectors.sparkSession.createDataFrame([(c, b) for c, _, _, b in balls], "cell int, b string")
    own = q.join(F.broadcast(heads), F.col("g_cell") == F.col("cell")).select("g", "b", F.lit(None).cast("binary").alias("kth"))
    first = stored(_searched(own, *trees, k), "top-first")
    reached = first.filter("kth IS NOT NULL").select("g", "kth", "worst", F.col("b").alias("done"))
    roots = stored(q.select("g", "q").join(reached, "g", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf")))), "top-roots")
    pairs = _reaching(roots, [x[:3] for x in balls]).join(r.select("b", "cell", "r"), "cell").join(roots, "g").filter(~F.col("b").eqNullSafe(F.col("done")))
    bound = _dot("q.centre", "r.centre") + F.col("r.radius") * F.col("q.norm") + F.col("q.radius") * F.col("r.norm") + F.col("q.radius") * F.col("r.radius")
    pairs = stored(pairs.filter(bound * (1 + 1e-9) + 1e-6 >= F.col("worst")).select("g", "b", "kth"), "top-pairs")
    rest = stored(_searched(pairs, *trees, k), "top-rest")
    found = first.unionByName(rest).filter("query_id IS NOT NULL").select("query_id", "vec_id", "score").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.filter("vec_id % 50 = 0"))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
