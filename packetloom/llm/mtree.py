"""Exact top-k inner products by best-first search in M-trees.

Rows are dealt in blocks, near ones together; each block becomes a paged M-tree (routing objects
with covering radii and distances to their parents) in a space where a larger inner product is a
smaller distance: a candidate x gets one more coordinate sqrt(M^2 - |x|^2), a query gets 0
there. A query searches its own block first; its k-th score there rules out every block whose
centre and radius can't beat it, and prunes in those that are left. A task reads one block at a
time and streams the block's queries past its tree."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import discard, materialize, ship

#: Rows and bytes of coordinates of a block at most, entries of a page.
BLOCK, BLOCK_BYTES, PAGE = 16384, 32 << 20, 256
#: Bytes that may be broadcast: the pivots that deal rows to blocks, and the blocks' balls. With
#: more blocks than the balls of which fit, queries go to all of them.
PIVOT_BYTES, BALL_BYTES, PIVOTS = 8 << 20, 64 << 20, 1024
#: Distances are doubles; bounds are loosened by this share of the largest before they prune.
SLACK = 1e-7


class Tree:
    """A bulk-loaded M-tree over the rows of x (int64); leaves hold row numbers. Scores below
    2^53 (small) are computed in doubles, others in integers."""

    def __init__(self, x: np.ndarray, small: bool = True):
        norm = (x.astype(float) ** 2).sum(axis=1)
        self.whole = None if small else x
        self.top = float(norm.max()) if len(x) else 0.0
        self.points = np.column_stack((x.astype(float), np.sqrt(np.maximum(self.top - norm, 0))))
        self.slack = SLACK * (1 + np.sqrt(self.top)) + 1e-6
        #: A page: its entries (rows, or routing rows), their distance to the parent's routing
        #: row, their covering radii and the pages below (None in a leaf).
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, list[int] | None]] = []
        #: Coordinates of each page's rows, side by side.
        self.coords: list[np.ndarray] = []
        self.root = self._page(np.arange(len(x)), None) if len(x) else -1

    def _far(self, rows: np.ndarray, centre: int | None) -> np.ndarray:
        if centre is None:
            return np.zeros(len(rows))
        d = self.points[rows] - self.points[centre]
        return np.sqrt((d * d).sum(axis=1))

    def _page(self, rows: np.ndarray, parent: int | None) -> int:
        if len(rows) <= PAGE:
            self.pages.append((rows, self._far(rows, parent), None, None))
            self.coords.append(np.ascontiguousarray(self.points[rows, :-1]))
            return len(self.pages) - 1
        fan = min(PAGE, -(-len(rows) // PAGE) * 2)
        seeds = rows[np.linspace(0, len(rows) - 1, fan).astype(int)]
        p, s = self.points[rows], self.points[seeds]
        near = ((s * s).sum(axis=1) - 2 * (p @ s.T)).argmin(axis=1)
        if (near == near[0]).all():  # equal rows: deal them evenly
            near = np.arange(len(rows)) * fan // len(rows)
        centres, radii, below = [], [], []
        for k in range(fan):
            mine = rows[near == k]
            if len(mine):
                c = int(seeds[k])
                centres.append(c)
                radii.append(self._far(mine, c).max())
                below.append(self._page(mine, c))
        centres = np.array(centres)
        self.pages.append((centres, self._far(centres, parent), np.array(radii), below))
        self.coords.append(self.points[centres])
        return len(self.pages) - 1

    def search(self, q: np.ndarray, k: int, ids: np.ndarray, own: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) but for id `own`, ties to smaller ids; only scores from
        `least` on, if it is given."""
        point = np.append(q.astype(float), 0.0)
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst first
        queue = [(0.0, self.root, 0.0)] if self.root >= 0 else []
        size = float((point * point).sum()) + self.top
        reach = np.inf if least is None else np.sqrt(max(size - 2.0 * least, 0.0))  # no row farther than this can enter
        while queue:
            low, page, up = heapq.heappop(queue)  # up: distance from q to the page's routing row
            if low > reach + self.slack:
                break
            rows, to_parent, radii, below = self.pages[page]
            coords = self.coords[page]
            if page != self.root and reach < np.inf:
                # stored distances rule entries out before any distance is computed
                bound = np.abs(up - to_parent)
                at = np.flatnonzero((bound if radii is None else bound - radii) <= reach + self.slack)
                if len(at) < len(rows):
                    rows, coords = rows[at], coords[at]
                    radii = None if radii is None else radii[at]
                    below = None if below is None else [below[i] for i in at]
            if below is None:
                scores = coords @ point[:-1] if self.whole is None else self.whole[rows] @ q  # exact
                if len(best) == k or least is not None:  # ties may still win by their id
                    good = scores >= (best[0][0] if len(best) == k else least)
                    rows, scores = rows[good], scores[good]
                for score, i in zip(scores.tolist(), ids[rows].tolist(), strict=True):
                    if i == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                if len(best) == k:
                    reach = min(reach, np.sqrt(max(size - 2.0 * best[0][0], 0.0)))
                continue
            d = coords - point
            d = np.sqrt(np.einsum("ij,ij->i", d, d))
            low = np.maximum(d - radii, 0)
            for j in np.flatnonzero(low <= reach + self.slack).tolist():
                heapq.heappush(queue, (float(low[j]), below[j], float(d[j])))
        return [(int(s), -i) for s, i in best]


def quantised(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.col(vec_col).isNull() | F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Shorter vectors are padded with zeros."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    if (size == width).all():
        return values[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    for i, (a, n) in enumerate(zip(ends.tolist(), size.tolist(), strict=False)):
        out[i, :n] = values[a : a + n]
    return out


def _dealt(rows: DataFrame, total: int, width: int) -> DataFrame:
    """rows with their block: those nearest to one pivot together, in as many blocks as their
    number asks for (so a very common vector fills several)."""
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, width))))
    n = min(-(-total // most), PIVOTS, max(1, PIVOT_BYTES // (8 * max(1, width))))
    if total <= most:
        return materialize(rows.withColumn("cell", F.lit(0).cast("long")), "blocks")
    at = np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(n).collect()], float)  # n pivots
    pivots = rows.sparkSession.sparkContext.broadcast(at)

    def nearest(batches):
        p = pivots.value
        half = (p * p).sum(axis=1) / 2
        for b in batches:
            x = _matrix(b.column("v"), width).astype(float)
            spot = [(half - x[i : i + 4096] @ p.T).argmin(axis=1) for i in range(0, len(x), 4096)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(np.concatenate(spot) if spot else [], pa.int64())], names=["vec_id", "v", "pivot"])

    near = materialize(rows.mapInArrow(nearest, "vec_id long, v array<long>, pivot long"), "near")
    sizes = {r["pivot"]: -(-r["n"] // most) for r in near.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    first = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[k] for k in sorted(sizes))]).tolist(), strict=False))
    table = near.sparkSession.createDataFrame([(k, first[k], sizes[k]) for k in sizes], "pivot long, first long, parts long")
    cell = F.col("first") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))
    out = materialize(near.join(F.broadcast(table), "pivot").select("vec_id", "v", cell.alias("cell")), "blocks")
    discard(near)
    return out


_FOUND = "cell long, query_id long, vec_id long, score long, centre array<double>, radius double"


def _searched(blocks: DataFrame, queries: DataFrame, k: int, width: int, small: bool, balls: bool) -> DataFrame:
    """The k best of each query (cell, query_id, v, least) in its block and, if `balls`, a row
    with the centre and radius of each block. Rows come sorted by block, candidates first: a
    task holds one block and its tree."""
    both = blocks.select("cell", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("long").alias("least")).unionByName(queries.select("cell", F.lit(1).alias("kind"), F.col("query_id").alias("vec_id"), "v", "least"))

    def run(batches):
        cell, held, ids, tree = None, [], [], None

        def built():
            x = np.concatenate(held)
            return Tree(x, small), np.concatenate(ids), x

        def ball():
            x = np.concatenate(held).astype(float)
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])], names=names)

        names = ["cell", "query_id", "vec_id", "score", "centre", "radius"]
        for b in batches:
            if not b.num_rows:
                continue
            mark = np.column_stack((b.column("cell").to_numpy(), b.column("kind").to_numpy()))
            edge = np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(mark)], strict=True):
                part, (here, kind) = b.slice(s, e - s), mark[s].tolist()
                if here != cell:
                    if balls and held:
                        yield ball()
                    cell, held, ids, tree = here, [], [], None
                x, who = _matrix(part.column("v"), width), part.column("vec_id").to_numpy()
                if kind == 0:
                    held.append(x)
                    ids.append(who)
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = built()
                out = []
                for i, (q, least) in enumerate(zip(who.tolist(), part.column("least").to_pylist(), strict=True)):
                    out += [(q, v, score) for score, v in tree[0].search(x[i], k, tree[1], q, least)]
                if out:
                    cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([here] * len(out), pa.int64()), *cols, pa.nulls(len(out), pa.list_(pa.float64())), pa.nulls(len(out), pa.float64())], names=names)
        if balls and held:
            yield ball()

    return both.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(run, _FOUND)


def _elsewhere(queries: DataFrame, balls: DataFrame, cells: int, width: int) -> DataFrame:
    """queries (query_id, v, cell, least) to each other block that may hold a score from their
    least on: the largest product in a ball is q.c + |q|r."""
    if cells * (width + 2) * 8 > BALL_BYTES:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))
        return queries.withColumnRenamed("cell", "home").withColumn("cell", every).filter("cell <> home").drop("home")
    got = balls.collect()  # a row a block, BALL_BYTES at most
    where = queries.sparkSession.sparkContext.broadcast((np.array([r["cell"] for r in got]), np.array([r["centre"] for r in got]), np.array([r["radius"] for r in got])))

    def run(batches):
        cell, centre, radius = where.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                x = _matrix(part.column("v"), width).astype(float)
                norm = np.sqrt((x * x).sum(axis=1))
                top = x @ centre.T + norm[:, None] * radius
                least = np.array([-np.inf if v is None else v for v in part.column("least").to_pylist()], float)
                room = SLACK * (1 + np.abs(least) + norm * (radius.max() + np.sqrt((centre * centre).sum(axis=1).max())))
                room[~np.isfinite(room)] = 0
                at, to = np.nonzero((top >= (least - room)[:, None]) & (cell[None, :] != part.column("cell").to_numpy()[:, None]))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(take), part.column("v").take(take), part.column("least").take(take), pa.array(cell[to])], names=["query_id", "v", "least", "cell"])

    return queries.select("query_id", "v", "least", "cell").mapInArrow(run, "query_id long, v array<long>, least long, cell long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k
    largest integer inner products with other rows, ties to the smaller id; exact.

    Null ids and vectors that are null or hold a null or non-finite component take no part;
    shorter vectors count as padded with zeros; rows with the query's own id are left out.
    A repeated query id is one query for each of its different vectors, ranked together.
    Components so large that a score may not fit into a long are an error (ValueError). An empty
    table, and one without queries, give an empty result.
    Candidates are dealt once and queries go only to blocks that can matter; a task holds one
    block, whatever the input."""
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(quantised(vectors, scale, id_col, vec_col), "vectors")
    largest = F.greatest(F.abs(F.coalesce(F.array_max("v").cast("double"), F.lit(0.0))), F.abs(F.coalesce(F.array_min("v").cast("double"), F.lit(0.0))))
    total, width, high = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(largest), F.lit(0.0))).first()
    bound = width * int(high) ** 2
    if bound >= 1 << 63:
        raise ValueError(f"components of up to {high:g} in {width} dimensions: scores may not fit into 64 bits")
    blocks = _dealt(rows, total, width)
    discard(rows)
    queries = blocks.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.min("cell").alias("cell"))
    queries = materialize(queries.withColumn("least", F.lit(None).cast("long")), "queries")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    home = materialize(_searched(blocks, queries, k, width, bound < 1 << 53, True), "home")
    found = home.filter("query_id is not null").select("query_id", "vec_id", "score")
    cells = home.filter("query_id is null").count()
    if cells > 1:
        last = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        known = queries.drop("least").join(last, "query_id", "left")
        more = _elsewhere(known, home.filter("query_id is null").select("cell", "centre", "radius"), cells, width)
        found = found.unionByName(_searched(blocks, more, k, width, bound < 1 << 53, False).select("query_id", "vec_id", "score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
