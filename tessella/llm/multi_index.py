"""Approximate nearest neighbours by inner product with an inverted multi-index.

Vectors get one more component, as in mtree, so that the largest product is the least distance; the two halves of
the longer vector are quantised separately, and the pair of centroids names a row's cell. A query takes cells in the order
of their summed distance from a heap until they hold the wanted share of all rows, and reranks their entries by the
exact product of the original vectors. Only the entries of cells that a query takes are multiplied with it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import FOUND, SHARD_ROWS, STEP, gathered, matrix, numbers, searched, shown

#: Centroids of each half, rows they are fitted on at most (those whose ids hash lowest), rounds of fitting.
CENTROIDS, SAMPLE, ROUNDS = 32, 20_000, 12
#: Cells are probed until they hold this share of the rows.
SHARE = 0.65
#: Queries that are multiplied with a shard's cells at a time, and pairs that are reranked at a time.
TOGETHER, PAIRS = 256, 1 << 17


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from distinct starting rows; an empty centroid moves to the row that is farthest off."""
    starts = np.unique(x, axis=0)
    centers = starts[np.linspace(0, len(starts) - 1, min(k, len(starts))).astype(int)].copy()
    for _ in range(ROUNDS):
        d = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
        owner = d.argmin(1)
        for c in range(len(centers)):
            own = x[owner == c]
            if len(own):
                centers[c] = own.mean(0)
            else:
                centers[c] = x[d.min(1).argmax()]
    return centers


class MultiIndex:
    """The two codebooks and, for each cell, how many rows it has and which shards hold them."""

    def __init__(self, sample: np.ndarray, big2: float, k: int = CENTROIDS):
        self.big2 = big2
        x = self.longer(sample)
        self.cut = x.shape[1] // 2
        self.books = [_kmeans(x[:, : self.cut], k), _kmeans(x[:, self.cut :], k)]
        self.counts: dict[int, int] = {}
        self.shards: dict[int, list[int]] = {}

    def longer(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.big2 - (x * x).sum(1)))[:, None]])

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        halves = x[:, : self.cut], x[:, self.cut :]
        return [(h * h).sum(1)[:, None] - 2 * h @ b.T + (b * b).sum(1) for h, b in zip(halves, self.books, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.distances(self.longer(x))
        return one.argmin(1) * len(self.books[1]) + two.argmin(1)

    def deal(self, counts: dict[int, int], rows: int = SHARD_ROWS) -> int:
        """Pack cells into shards of some ``rows`` rows; a larger cell is cut into slices. Returns the number of shards."""
        self.counts, shard, held = counts, 0, 0
        for cell in sorted(counts):
            n = counts[cell]
            if n > rows:
                slices = -(-n // rows)
                shard += bool(held)
                self.shards[cell] = list(range(shard, shard + slices))
                shard, held = shard + slices, 0
                continue
            if held + n > rows:
                shard, held = shard + 1, 0
            self.shards[cell] = [shard]
            held += n
        return shard + bool(held)

    def probe(self, one: np.ndarray, two: np.ndarray, wanted: int) -> list[int]:
        """Cells by summed distance until they hold ``wanted`` rows: the multi-sequence walk over both sorted lists."""
        a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        da, db, a, b = one[a].tolist(), two[b].tolist(), a.tolist(), b.tolist()
        width, out, total = len(db), [], 0
        queue = [(da[0] + db[0], 0, 0)]
        while queue and total < wanted:
            _, i, j = heapq.heappop(queue)
            cell = a[i] * width + b[j]
            if n := self.counts.get(cell, 0):
                out.append(cell)
                total += n
            if j + 1 < width:
                heapq.heappush(queue, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(da):
                heapq.heappush(queue, (da[i + 1] + db[0], i + 1, 0))
        return out


class Shard:
    """The entries of some cells: rows sorted by cell, and where each cell's begin."""

    def __init__(self, cells: np.ndarray, rows: np.ndarray, ids: np.ndarray, none: np.ndarray, x: np.ndarray):
        order = np.lexsort((rows, cells))
        self.rows, self.ids, self.none, self.x = rows[order], ids[order], none[order], x[order]
        self.cells, begins = np.unique(cells[order], return_index=True)
        self.spans = list(zip(self.cells.tolist(), begins.tolist(), np.append(begins[1:], len(rows)).tolist(), strict=True))
        #: Order of ids, null last.
        self.rank = np.empty(len(rows), np.int64)
        self.rank[np.lexsort((self.rows, self.ids, self.none))] = np.arange(len(rows))

    def nearest(self, own: np.ndarray, q: np.ndarray, taken: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, exact product) of the k best entries of each query in the cells it takes, its own row left out. ``taken``: query by cell."""
        products = np.full((len(q), len(self.rows)), -np.inf)
        for cell, a, b in self.spans:
            some = np.flatnonzero(taken[:, cell])
            if len(some):
                products[some, a:b] = q[some] @ self.x[a:b].T
        place = np.minimum(np.searchsorted(self.rows, own, sorter=self.by_row), len(self.rows) - 1)
        place = self.by_row[place]
        mine = np.flatnonzero(self.rows[place] == own)
        products[mine, place[mine]] = -np.inf
        cut = np.partition(products, -k, axis=1)[:, -k] if products.shape[1] > k else np.full(len(q), -np.inf)
        # rounding of the block product may differ from entry to entry: all that could be among the best are multiplied anew
        low = np.where(np.isfinite(cut), cut - 1e-9 * (1 + np.abs(cut)), np.finfo(float).min)
        who, entry = np.nonzero(products >= low[:, None])
        exact = np.concatenate([(q[who[a : a + PAIRS]] * self.x[entry[a : a + PAIRS]]).sum(1) for a in range(0, len(who), PAIRS)] or [np.zeros(0)])
        order = np.lexsort((self.rank[entry], -exact, who))
        who, entry, exact = who[order], entry[order], exact[order]
        first = np.searchsorted(who, who, "left")
        keep = np.arange(len(who)) - first < k
        return who[keep], entry[keep], exact[keep]

    @property
    def by_row(self) -> np.ndarray:
        if not hasattr(self, "_by_row"):
            self._by_row = np.argsort(self.rows, kind="stable")
        return self._by_row


def search(rows: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", step: int = STEP, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query, the rows whose key is divisible by ``step``, against all rows but itself.

    Which rows take part, null and repeated keys and other lengths: vectors.gathered(); of several lengths the index is built for each. Fewer
    than k other rows give fewer results, an empty table none. Other columns are left behind. Every row is indexed; codebooks come from a
    bounded sample. The driver sees the sample, the largest norm, one count a cell and one block of queries at a time. An entry is in one
    shard; hot cells are cut into slices of bounded size.
    """
    spark = rows.sparkSession
    some = gathered(rows, key, F.col(vector).cast("array<double>"), False)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = some.groupBy("dim").agg(F.count("*").alias("n"), F.sum((F.col("id") % step == 0).cast("long")).alias("asked"), F.max(norm2).alias("big2")).orderBy("dim").collect()
    parts = [_search_dim(some.where(F.col("dim") == r["dim"]), r["dim"], r["n"], r["asked"], r["big2"], k, step, share) for r in sizes if r["asked"]]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _search_dim(some: DataFrame, dim: int, n: int, asked: int, big2: float, k: int, step: int, share: float) -> DataFrame:
    context = some.sparkSession.sparkContext
    sample = some.orderBy(F.xxhash64(F.lit("codebook"), "id"), "id", "row").limit(SAMPLE).select("v").toArrow()
    own = MultiIndex(matrix(sample.column("v"), dim), big2)
    books = context.broadcast(own)

    def assign(batches):
        for batch in batches:
            cells = books.value.cells(matrix(batch.column("v"), dim)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=["row", "id", "v", "cell"])

    entries = written(some.select("row", "id", "v").mapInArrow(assign, "row long, id long, v array<double>, cell int"), "cells")
    own.deal({r["cell"]: r["count"] for r in entries.groupBy("cell").count().collect()})
    cell_map = some.sparkSession.createDataFrame([(c, s) for c, s in own.shards.items()], "cell int, slices array<int>")
    slot = F.element_at("slices", (F.pmod(F.xxhash64("row"), F.size("slices")) + 1).cast("int"))
    placed = entries.join(F.broadcast(cell_map), "cell").select("row", "id", "v", "cell", slot.alias("shard"))  # at most CENTROIDS² rows in cell_map

    def pack(data):
        names = ["cells", "rows", "ids", "v"]
        return pa.table([pa.array([data.column(c).combine_chunks().to_pylist()], pa.list_(t)) for c, t in (("cell", pa.int32()), ("row", pa.int64()), ("id", pa.int64()))] + [pa.array([matrix(data.column("v"), dim).tobytes()], pa.binary())], names=names)

    index = written(placed.groupBy("shard").applyInArrow(pack, "cells array<int>, rows array<long>, ids array<long>, v binary"), "shards", "uncompressed")
    ready, width, wanted = context.broadcast(own), len(own.books[0]) * len(own.books[1]), max(int(np.ceil(share * n)), k + 1)

    def route(batches):
        for batch in batches:
            taken = np.zeros((batch.num_rows, width), bool)
            if batch.num_rows:
                q = matrix(batch.column("v"), dim)
                one, two = ready.value.distances(np.hstack([q, np.zeros((len(q), 1))]))
                for i in range(len(q)):
                    taken[i, ready.value.probe(one[i], two[i], wanted)] = True
            bits = [x.tobytes() for x in np.packbits(taken, axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary())], names=["row", "id", "v", "taken"])

    queries = some.where(F.col("id") % step == 0).select("row", "id", "v").mapInArrow(route, "row long, id long, v array<double>, taken binary")

    def run(batches, block):
        asked, names = block.column("row").to_numpy(), block.column("id").to_numpy()
        q = matrix(block.column("v"), dim)
        taken = np.unpackbits(np.frombuffer(b"".join(block.column("taken").to_pylist()), np.uint8).reshape(len(q), -1), axis=1, count=width).astype(bool)
        for batch in batches:
            for cells, own_rows, ids, v in zip(*[batch.column(i) for i in range(4)], strict=True):
                ids, none = numbers(ids.values)
                shard = Shard(cells.values.to_numpy(), own_rows.values.to_numpy(), ids, none, np.frombuffer(v.as_py()).reshape(-1, dim))
                for at in range(0, len(q), TOGETHER):
                    who, entry, score = shard.nearest(asked[at : at + TOGETHER], q[at : at + TOGETHER], taken[at : at + TOGETHER], k)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[at + who]), pa.array(names[at + who]), shown(shard.ids[entry], shard.none[entry]), pa.array(score, pa.float64())], names=["row", "query_id", "vec_id", "score"])

    return searched(index, queries, dim, asked, FOUND.format("double"), run, k)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of every vec_id divisible by 20; nulls, ties, repeated rows and empty tables as search() says."""
    return search(table(spark, sf_dir, "embeddings"))
