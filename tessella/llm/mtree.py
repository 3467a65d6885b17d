"""Exact top-k by inner product: a best-first search of M-trees.

Inner products become distances by one more component: with ``big`` at least every norm, x goes to
(x, sqrt(big² - |x|²)) and a query to (q, 0), so that d² = big² + |q|² - 2 x·q. A tree has paged nodes with a routing
vector, a covering radius and the distance to the parent's routing vector; leaf pages keep each entry's distance
to their own. A search takes the page with the least possible distance first, and skips pages and entries that the stored
distances alone rule out. Many queries walk a tree side by side: each goes down to its own best page, and then the page of the
least bound is taken next, for all queries that can't rule it out, which share one product. Rows are dealt over shards of bounded size, each with a tree of its own.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import FOUND, SHARD_ROWS, STEP, gathered, matrix, numbers, searched, shown

PAGE, FANOUT, SCALE = 512, 8, 64
#: Queries that walk a tree side by side.
TOGETHER = 4096
#: Bounds are widened by this share, so that rounding never rules out a row.
SLACK = 1e-9


@dataclass
class Node:
    parent: int
    radius: float
    to_parent: float
    center: int  # row of the routing vector
    rows: tuple[int, int] | None = None  # leaf: its rows, which are consecutive
    children: list[int] = field(default_factory=list)


class MTree:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, none: np.ndarray, vectors: np.ndarray):
        top = float(np.abs(vectors).max(initial=0))
        most = top * top * vectors.shape[1]
        #: The narrowest kind whose products of this size are exact: floats, and beyond these integers do the work.
        self.kind = np.float32 if most < 2.0**23 else np.float64 if most < 2.0**52 else np.int64
        x = vectors.astype(np.float64)
        norms = (x * x).sum(1)
        self.big2 = float(norms.max(initial=0))
        self.extra = np.sqrt(np.maximum(0, self.big2 - norms))
        self.nodes: list[Node] = []
        order: list[np.ndarray] = []
        self._build(x, np.arange(len(ids)), -1, order, 0)
        dealt = np.concatenate(order)
        place = np.empty(len(dealt), np.int64)
        place[dealt] = np.arange(len(dealt))
        for node in self.nodes:
            node.center = int(place[node.center])
        self.rows, self.ids, self.none, self.extra, x = rows[dealt], ids[dealt], none[dealt], self.extra[dealt], x[dealt]
        #: Order of ids, null last, and entries by it.
        self.by_id = np.lexsort((self.rows, self.ids, self.none))
        self.rank = np.empty(len(dealt), np.int64)
        self.rank[self.by_id] = np.arange(len(dealt))
        self.by_row = np.argsort(self.rows)
        self.to_center = np.zeros(len(dealt))
        for node in self.nodes:
            if node.rows:
                a, b = node.rows
                self.to_center[a:b] = self._distance(x, node.center, np.arange(a, b))
        self.vectors = vectors[dealt].astype(self.kind)

    def _distance(self, x: np.ndarray, center: int, rows: np.ndarray) -> np.ndarray:
        gap = x[rows] - x[center]
        return np.sqrt((gap * gap).sum(1) + (self.extra[rows] - self.extra[center]) ** 2)

    def _build(self, x: np.ndarray, rows: np.ndarray, parent: int, order: list[np.ndarray], done: int, center: int | None = None) -> int:
        center = int(rows[0]) if center is None else center
        d = self._distance(x, center, rows)
        to_parent = float(self._distance(x, self.nodes[parent].center, np.array([center]))[0]) if parent >= 0 else 0.0
        me = len(self.nodes)
        self.nodes.append(Node(parent, float(d.max()), to_parent, center))
        if parent >= 0:
            self.nodes[parent].children.append(me)
        if len(rows) <= PAGE:
            order.append(rows[np.argsort(d, kind="stable")])
            self.nodes[me].rows = (done, done + len(rows))
            return done + len(rows)
        # routing vectors: each the farthest from those taken; rows go to the nearest
        heads, near, owner = [center], d.copy(), np.zeros(len(rows), np.int64)
        while len(heads) < FANOUT and near.max() > 0:
            heads.append(int(rows[near.argmax()]))
            own = self._distance(x, heads[-1], rows)
            owner[own < near] = len(heads) - 1
            near = np.minimum(near, own)
        parts = [(h, rows[owner == k]) for k, h in enumerate(heads)]
        if len(heads) == 1 or max(len(p) for _, p in parts) > 0.9 * len(rows):  # copies, or one far row: cut by distance
            sorted_rows = rows[np.argsort(d, kind="stable")]
            parts = [(int(p[0]), p) for p in np.array_split(sorted_rows, FANOUT) if len(p)]
        for h, p in parts:
            if len(p):
                done = self._build(x, p, me, order, done, h)
        return done

    def search(self, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, score) of the k best entries of each query, its row ``own`` left out, ties to the smaller id, in no order."""
        kind, size, n = self.kind, len(self.rows), len(q)
        most = float(np.abs(q).max(initial=0)) * float(np.sqrt(self.big2)) * q.shape[1]
        if most >= (2.0**23 if kind is np.float32 else 2.0**52):
            kind = np.int64  # a query far larger than the rows
        wide = 1 + SLACK
        base = self.big2 + (q.astype(np.float64) ** 2).sum(1)
        q = q.astype(kind)
        vectors = self.vectors.astype(kind, copy=False)
        # one number that orders entries: the score, and within a score the rank; objects where 64 bits don't hold it
        number = np.int64 if most * size < 2.0**61 else object
        none = -(1 << 62) if number is np.int64 else -(1 << 200)
        spot = self.by_row[np.minimum(np.searchsorted(self.rows, own, sorter=self.by_row), size - 1)]
        mine = np.where(self.rows[spot] == own, spot, -1)
        top, reach = np.full((n, k), none, number), np.full(n, np.inf)
        low, away = np.full((n, len(self.nodes)), np.inf), np.zeros((n, len(self.nodes)))

        def distance(some: np.ndarray, entry: int) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, base[some] - 2 * (q[some] @ vectors[entry]).astype(np.float64)))

        lowest = kind(-np.inf) if kind is not np.int64 else np.iinfo(np.int64).min
        worst = np.full(n, lowest, kind)
        everyone = np.arange(n)
        away[:, 0] = distance(everyone, self.nodes[0].center)
        low[:, 0] = np.maximum(0.0, away[:, 0] - self.nodes[0].radius * wide)

        def visit(at: int, some: np.ndarray) -> None:
            """Take a page for some queries: open its children, or hold its entries against the best so far."""
            node, d = self.nodes[at], away[some, at]
            if node.rows is None:
                for c in node.children:
                    child = self.nodes[c]
                    near = np.abs(d - child.to_parent) - child.radius * wide <= reach[some] * wide + SLACK * d
                    if near.any():  # else without a distance of its own
                        asking = some[near]
                        away[asking, c] = d[near] if child.center == node.center else distance(asking, child.center)
                        low[asking, c] = np.maximum(0.0, away[asking, c] - child.radius * wide)
                return
            # entries are in the order of their distance to the routing vector: those that no query here rules out are one stretch
            far = reach[some] * wide + SLACK * d
            a, b = node.rows
            if np.isfinite(far).all():
                a, b = a + np.searchsorted(self.to_center[a:b], [(d - far).min(), np.nextafter((d + far).max(), np.inf)])
            scores = q[some] @ vectors[a:b].T
            inside = np.flatnonzero((mine[some] >= a) & (mine[some] < b))
            scores[inside, mine[some[inside]] - a] = lowest
            hit, spot = np.nonzero((scores >= worst[some][:, None]) & (scores > lowest))
            if not len(hit):
                return
            found = scores[hit, spot].astype(np.int64).astype(number) * size + (size - 1 - self.rank[a + spot])
            rows, first, many = np.unique(hit, return_index=True, return_counts=True)
            both = np.full((len(rows), k + many.max()), none, number)
            both[:, :k] = top[some[rows]]
            both[np.repeat(np.arange(len(rows)), many), k + np.arange(len(hit)) - np.repeat(first, many)] = found
            both = np.partition(both, both.shape[1] - k, axis=1)[:, -k:] if number is np.int64 else np.sort(both, axis=1)[:, -k:]
            asking, least = some[rows], both.min(1)
            top[asking] = both
            full = least > none
            asking, score = asking[full], least[full] // size
            worst[asking] = score.astype(kind)
            reach[asking] = np.sqrt(np.maximum(0.0, base[asking] - 2.0 * score.astype(np.float64)))

        # first each query down to its own best page, then page by page, the least bound of all first, for every query it isn't ruled out for
        live = everyone
        while len(live):
            pick = low[live].argmin(1)
            low_there = low[live, pick]
            live, pick = live[np.isfinite(low_there)], pick[np.isfinite(low_there)]
            low[live, pick] = np.inf
            for at in np.unique(pick).tolist():
                visit(at, live[pick == at])
            live = live[[self.nodes[at].rows is None for at in pick.tolist()]]
        while True:
            open_ = np.where(low <= (reach * wide)[:, None], low, np.inf)
            at = int(open_.min(0).argmin())
            some = np.flatnonzero(np.isfinite(open_[:, at]))
            if not len(some):
                break
            low[:, at] = np.inf
            visit(at, some)
        who, slot = np.nonzero(top > none)
        found = top[who, slot]
        return who, self.by_id[(size - 1 - found % size).astype(np.int64)], (found // size).astype(np.int64)


def index(rows: DataFrame, shards: int) -> DataFrame:
    """(tree) from (row, id, dim, v), of one dim: one pickled tree a shard, written as a table."""

    def build(data):
        order = np.argsort(data.column("row").to_numpy())
        ids, none = numbers(data.column("id"))
        tree = MTree(data.column("row").to_numpy()[order], ids[order], none[order], matrix(data.column("v"), data.column("dim")[0].as_py(), np.int64)[order])
        return pa.table({"tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInArrow(build, "tree binary"), "mtree", "uncompressed")


def search(rows: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", step: int = STEP) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query, the rows whose key is divisible by ``step``, against all rows but itself.

    Vectors are scaled and floored to integers; scores are exact. If a score could leave 64 bits, by the lengths of the longest vector asked for and the longest
    there is, that is an error before anything is searched: no row is dropped and none is ranked by a wrapped number. Which rows take part, null and repeated keys and
    other lengths: vectors.gathered(). Fewer than k other rows give fewer results, an empty table none. Other columns are left behind.
    Queries are broadcast in blocks of bounded size; a task holds one tree at a time and yields k rows a query and tree.
    """
    held = F.lit(2.0**62)  # what is larger stands for itself in the check below, which it can't pass
    ints = F.transform(F.col(vector), lambda x: F.floor(F.greatest(-held, F.least(held, x.cast("double") * SCALE))).cast("long"))
    whole = F.when(F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(None)).otherwise(ints)
    some = gathered(rows, key, whole, True)
    square = F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = some.groupBy("dim").agg(F.count("*").alias("n"), F.sum((F.col("id") % step == 0).cast("long")).alias("asked"), F.max(square).alias("most"), F.max(F.when(F.col("id") % step == 0, square)).alias("most_asked")).orderBy("dim").collect()
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for r in sizes:
        if r["asked"]:
            if r["most"] * r["most_asked"] >= 2.0**125:  # of their square roots the product bounds a score; a bit is left for rounding
                raise ValueError(f"inner products of vectors of {r['dim']} components may leave 64 bits")
            own = some.where(F.col("dim") == r["dim"])
            trees = index(own, max(1, -(-r["n"] // SHARD_ROWS)))
            part = searched(trees, own.where(F.col("id") % step == 0).select("row", "id", "v"), r["dim"], r["asked"], FOUND.format("long"), _walk(r["dim"], k), k)
            found = part if len(sizes) == 1 else found.unionByName(part)
    return found


def _walk(dim: int, k: int):
    def run(batches, block):
        asked, names, q = block.column("row").to_numpy(), block.column("id").to_numpy(), matrix(block.column("v"), dim, np.int64)
        for batch in batches:
            for pickled in batch.column(0):
                tree: MTree = pickle.loads(pickled.as_py())
                for at in range(0, len(q), TOGETHER):
                    who, entry, score = tree.search(asked[at : at + TOGETHER], q[at : at + TOGETHER], k)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[at + who]), pa.array(names[at + who]), shown(tree.ids[entry], tree.none[entry]), pa.array(score, pa.int64())], names=["row", "query_id", "vec_id", "score"])

    return run


def op10_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of every vec_id divisible by 20; nulls, ties, repeated rows and empty tables as search() says."""
    return search(table(spark, sf_dir, "embeddings"))


SQL = {
    "op10_mtree": """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS i FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.i::DOUBLE[], c.i::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.row <> q.row),
r AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}
