"""Nearest neighbours by vantage-point trees, one for each shard of vectors.

1. Every vector goes to the cell of its nearest pivot (pivots are drawn from a bounded sample), a cell to as many shards as
   its rows need.  A cell's range of distances to its pivot and its longest vector are kept, so whole shards are skipped.
2. A shard's tree is written once to the shared folder.  A node has a vantage point, the candidate whose distances to the
   node's rows spread most, and two halves; every node keeps the ranges of its rows' distances to all vantage points above it.
3. Queries go to shards in rounds, their nearest shard first, then GROWTH times as many in each round; what a round
   found prunes the next one, so a query's found rows grow with the number of rounds and not with that of shards.

By the triangle inequality |q - x| is at least the gap between |q - p| and the range of |x - p|.  As
2 q.x = |q|^2 + |x|^2 - |q - x|^2, rows are left out if that gap is more than the distance that the worst neighbour so far
allows to the longest vector among them.  RELAX below 1 takes that distance as so much smaller and prunes more; 1 restores
exact search.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, small_batches, written

NEAREST = 20
RELAX = 1.0
SHARD_ROWS = 16_384
LEAF_ROWS = 128
SAMPLE_ROWS = 4_096  # vectors that pivots are drawn from; all vectors are indexed
MAX_CELLS = 1_024  # of one dimension; larger tables have more shards in a cell
GROWTH = 8  # a round's shards for those of all rounds before
SALTS = 4  # tasks that may search one shard in a round
FOUND = "query_id long, vec_id long, score double"
ASKED = "shard long, salt int, ids array<long>, q array<double>, least array<double>"


def distances(norms: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """|q - p| of each row of q, whose squared lengths are norms."""
    return np.sqrt(np.maximum(norms - 2 * (q @ p) + p @ p, 0))


def may_hold(gap: np.ndarray, norms: np.ndarray, least: np.ndarray, longest: np.ndarray | float, relax: float) -> np.ndarray:
    """Whether rows no longer than ``longest`` (squared) and no nearer than gap can have an inner product of least or more."""
    known = np.isfinite(least)
    worst = np.where(known, least, 0)
    slack = 1e-6 * (1 + np.sqrt(longest) + np.sqrt(norms))
    reach = np.sqrt(np.maximum(longest + norms - 2 * worst, 0))
    return ~known | ((gap <= relax * reach + slack) & (np.sqrt(norms * longest) >= worst - slack * slack))


class Tree:
    """A vantage-point tree over the rows of x, as arrays; a node's rows are a slice of the tree's order.

    low and high have a node's ranges of distances to the vantage points above it, the root's first.
    """

    ARRAYS = ("ids", "x", "vantage", "child", "begin", "stop", "low", "high", "longest")

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.norms = np.einsum("ij,ij->i", x, x)
        draws = np.random.default_rng(len(ids))
        order, nodes = np.arange(len(x)), []

        def node(begin: int, stop: int, above: list[np.ndarray]) -> int:
            """Adds the node of order[begin:stop]; above: its rows' distances to the vantage points above."""
            me, rows = len(nodes), order[begin:stop]
            ranges = [(d.min(), d.max()) for d in above]
            nodes.append([None, (-1, -1), begin, stop, ranges, self.norms[rows].max(initial=0)])
            if stop - begin <= leaf:
                return me
            p = x[rows[self._spread(x[rows], draws)]]
            d = distances(self.norms[rows], x[rows], p)
            own = np.argsort(d, kind="stable")
            order[begin:stop] = rows[own]
            above = [a[own] for a in [*above, d]]
            half = self._cut(above[-1])
            nodes[me][0] = p
            nodes[me][1] = (node(begin, begin + half, [a[:half] for a in above]), node(begin + half, stop, [a[half:] for a in above]))
            return me

        node(0, len(x), [])
        depth = max(len(n[4]) for n in nodes)
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        self.norms = self.norms[order]
        self.vantage = np.array([np.zeros(x.shape[1]) if n[0] is None else n[0] for n in nodes])
        self.child, self.begin, self.stop = np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])
        self.low, self.high = np.zeros((len(nodes), depth)), np.full((len(nodes), depth), np.inf)
        for i, n in enumerate(nodes):
            for k, (low, high) in enumerate(n[4]):
                self.low[i, k], self.high[i, k] = low, high
        self.longest = np.array([n[5] for n in nodes])

    @staticmethod
    def _spread(x: np.ndarray, draws: np.random.Generator, candidates: int = 8, others: int = 128) -> int:
        """The candidate row whose distances to some other rows vary most."""
        tried, seen = draws.integers(0, len(x), candidates), x[draws.integers(0, len(x), others)]
        norms = np.einsum("ij,ij->i", seen, seen)
        return int(tried[np.argmax([distances(norms, seen, x[t]).var() for t in tried])])

    @staticmethod
    def _cut(d: np.ndarray) -> int:
        """Rows of the near half: up to a wide gap between the distances (in order), else half of them."""
        low, high = max(len(d) // 8, 1), len(d) - max(len(d) // 8, 1)
        steps = np.diff(d[low - 1 : high + 1])
        at = int(np.argmax(steps))
        return low + at if steps[at] > (d[-1] - d[0]) / 4 else len(d) // 2

    def save(self, to) -> None:
        np.savez(to, **{name: getattr(self, name) for name in self.ARRAYS})

    @classmethod
    def load(cls, source) -> Tree:
        out = cls.__new__(cls)
        with np.load(source) as arrays:
            for name in cls.ARRAYS:
                setattr(out, name, arrays[name])
        out.norms = np.einsum("ij,ij->i", out.x, out.x)
        return out


class Best:
    """The k best (score, smaller id first) of each query so far; rows under a query's ``least`` are not looked for."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.norms = np.einsum("ij,ij->i", q, q)
        self.score, self.of = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.least = np.full(len(q), -np.inf) if least is None else least
        self.scored = np.zeros(len(q), np.int64)

    def worst(self, who: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[who, -1], self.least[who])

    def search(self, tree: Tree, relax: float = RELAX) -> None:
        if len(self.q) and len(tree.ids):
            self._visit(tree, 0, np.arange(len(self.q)), np.zeros((len(self.q), 0)), relax)

    def _visit(self, tree: Tree, at: int, who: np.ndarray, above: np.ndarray, relax: float) -> None:
        """Search a node; above has the queries' distances to the vantage points over it."""
        children = tree.child[at]
        if children[0] < 0:
            return self._leaf(tree, slice(tree.begin[at], tree.stop[at]), who)
        above = np.hstack([above, distances(self.norms[who], self.q[who], tree.vantage[at])[:, None]])
        n = above.shape[1]
        gaps = [np.maximum(np.maximum(tree.low[c, :n] - above, above - tree.high[c, :n]).max(axis=1), 0) for c in children]
        # each query first in the half that is nearer, then in the other one where that may hold something
        first = (gaps[1] < gaps[0]).astype(int)
        for side, turn in ((0, 0), (1, 0), (0, 1), (1, 1)):
            go = np.flatnonzero((first == side) == (turn == 0))
            go = go[may_hold(gaps[side][go], self.norms[who[go]], self.worst(who[go]), tree.longest[children[side]], relax)]
            if len(go):
                self._visit(tree, children[side], who[go], above[go], relax)

    def _leaf(self, tree: Tree, rows: slice, who: np.ndarray) -> None:
        x, ids = tree.x[rows], tree.ids[rows]
        self.scored[who] += len(ids)
        rough = self.q[who] @ x.T
        rough[self.ids[who][:, None] == ids[None, :]] = -np.inf
        slack = 1e-9 * (1 + np.sqrt(self.norms[who] * tree.norms[rows].max()))
        i, j = np.nonzero((rough >= (self.worst(who) - slack)[:, None]) & np.isfinite(rough))
        if not len(i):
            return
        # equal vectors must get equal scores: each sum is made alone, in the order of the components
        score = np.concatenate([(self.q[who[i[a : a + 65536]]] * x[j[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536)])
        got, i = np.unique(i, return_inverse=True)
        to = who[got]
        n = np.repeat(np.arange(len(to)), self.k)
        all_who, all_score, all_ids = np.concatenate([n, i]), np.concatenate([self.score[to].ravel(), score]), np.concatenate([self.of[to].ravel(), ids[j]])
        order = np.lexsort((all_ids, -all_score, all_who))
        starts = np.searchsorted(all_who[order], np.arange(len(to)))
        take = order[(starts[:, None] + np.arange(self.k)[None, :]).ravel()]
        self.score[to], self.of[to] = all_score[take].reshape(len(to), self.k), all_ids[take].reshape(len(to), self.k)

    def found(self) -> pa.RecordBatch:
        """The rows found, and one without vec_id for each query that says how many vectors were scored."""
        i, j = np.nonzero(np.isfinite(self.score) & (self.score >= self.least[:, None]))
        ids = pa.concat_arrays([pa.array(self.of[i, j]), pa.nulls(len(self.ids), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([self.ids[i], self.ids])), ids, pa.array(np.concatenate([self.score[i, j], self.scored.astype(float)]))], ["query_id", "vec_id", "score"])


def by_size(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows, matrix) of the lists of each size."""
    starts, sizes = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield n, rows, flat[starts[rows][:, None] + np.arange(n)]


class Place:
    """(vec_id, v) to the same with cell, distance to its pivot and squared length; pivots by dimension, cells numbered over all."""

    SCHEMA = "vec_id long, v array<double>, cell int, d double, norm double"

    def __init__(self, pivots: dict[int, np.ndarray], offset: dict[int, int]):
        self.pivots, self.offset = pivots, offset

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, near, norm = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for n, rows, x in by_size(batch["v"]):
                norms, p = np.einsum("ij,ij->i", x, x), self.pivots[n]
                d = np.sqrt(np.maximum(norms[:, None] - 2 * (x @ p.T) + np.einsum("ij,ij->i", p, p), 0))
                own = d.argmin(axis=1)
                cell[rows], near[rows], norm[rows] = own + self.offset[n], d[np.arange(len(x)), own], norms
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(cell), pa.array(near), pa.array(norm)], ["vec_id", "v", "cell", "d", "norm"])


def write_tree(folder: str, table: pa.Table) -> pa.Table:
    """The rows of one shard to its tree's file."""
    _, _, x = next(by_size(table["v"].combine_chunks()))
    to, path = pa.fs.FileSystem.from_uri(folder)
    to.create_dir(path, recursive=True)
    body, name = io.BytesIO(), uuid.uuid4().hex
    Tree(table["vec_id"].to_numpy(), x).save(body)
    with to.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write(body.getbuffer())
    return pa.table({"shard": table["shard"].slice(0, 1), "path": [f"{folder}/{name}"]})


class Route:
    """Queries (query_id, q, least) to the shards they go to in one round: those at places first to last - 1 in their order.

    cells: by dimension, (pivots, low, high, longest, shards, first shard) of its cells.
    """

    def __init__(self, cells: dict[int, tuple], relax: float, first: int, last: int):
        self.cells, self.relax, self.first, self.last = cells, relax, first, last

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_least = batch["query_id"].to_numpy(), batch["least"].to_numpy()
            for n, rows, q in by_size(batch["q"]):
                pivots, low, high, longest, shards, start = self.cells[n]
                ids, least, norms = all_ids[rows], all_least[rows], np.einsum("ij,ij->i", q, q)
                d = np.sqrt(np.maximum(norms[:, None] - 2 * (q @ pivots.T) + np.einsum("ij,ij->i", pivots, pivots), 0))
                gap = np.maximum(np.maximum(low - d, d - high), 0)
                go = may_hold(gap, norms[:, None], least[:, None], longest, self.relax)
                order = np.lexsort((d, gap), axis=1)
                upto = np.cumsum(shards[order], axis=1)  # places in a query's order after each cell's shards
                to: dict[int, list[int]] = {}
                for i, k in zip(*np.nonzero(np.take_along_axis(go, order, 1) & (upto > self.first) & (upto - shards[order] < self.last))):
                    c = order[i, k]
                    before = upto[i, k] - shards[c]
                    for place in range(max(self.first - before, 0), min(self.last - before, shards[c])):
                        # queries of one cell begin with different ones of its shards
                        to.setdefault(int(start[c] + (place + ids[i]) % shards[c]), []).append(i)
                some = list(to.items())
                for at in range(0, len(some), 64):
                    part = some[at : at + 64]
                    columns = [pa.array([s for s, _ in part], pa.int64()), pa.array([int(ids[who[0]]) % SALTS for _, who in part], pa.int32())]
                    columns += [pa.array([v[who].ravel() for _, who in part]) for v in (ids, q, least)]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "salt", "ids", "q", "least"])


class Search:
    """Rows of ASKED with a tree's path, in the order of paths, to FOUND."""

    def __init__(self, k: int, relax: float):
        self.k, self.relax = k, relax

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            for at, path in enumerate(batch["path"].to_pylist()):
                if path != now:
                    source, name = pa.fs.FileSystem.from_uri(path)
                    with source.open_input_file(name) as f:
                        now, tree = path, Tree.load(io.BytesIO(f.read()))
                ids, q, least = (batch[c][at].values.to_numpy() for c in ("ids", "q", "least"))
                best = Best(ids, q.reshape(len(ids), -1), self.k, least)
                best.search(tree, self.relax)
                yield best.found()


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part: no nulls, finite, not all zero; components as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.where(finite).where(F.exists("v", lambda x: x != 0))


def index(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple]]:
    """Trees over the distinct (vec_id, v): a table (shard, path), and the cells as Route takes them."""
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy(F.size("v")).count().collect()}  # a row for each dimension
    drawn: dict[int, list] = {n: [] for n in counts}
    for r in rows.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE_ROWS).collect():
        drawn[len(r["v"])].append(r["v"])
    pivots, offset = {}, {}
    for n in sorted(counts):
        sample = np.unique(np.array(drawn[n] or np.zeros((1, n))), axis=0)
        some = np.random.default_rng(n).permutation(len(sample))[: min(MAX_CELLS, -(-counts[n] // SHARD_ROWS))]
        offset[n], pivots[n] = sum(map(len, pivots.values())), sample[some]
    placed = written(small_batches(rows).mapInArrow(Place(pivots, offset), Place.SCHEMA), "placed")
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.max("norm").alias("longest"), F.count(F.lit(1)).alias("n")).collect()}  # MAX_CELLS a dimension
    shards = {c: -(-r["n"] // SHARD_ROWS) for c, r in cells.items()}
    start = dict(zip(sorted(cells), np.cumsum([0, *(shards[c] for c in sorted(cells))]).tolist()))
    out = {}
    for n in pivots:
        own = [c for c in range(offset[n], offset[n] + len(pivots[n])) if c in cells]
        get = lambda name: np.array([cells[c][name] for c in own])
        out[n] = (pivots[n][[c - offset[n] for c in own]], get("low"), get("high"), get("longest"), np.array([shards[c] for c in own]), np.array([start[c] for c in own]))
    of = spark.createDataFrame([(c, start[c], shards[c]) for c in cells], "of int, start long, ways long")
    dealt = placed.join(F.broadcast(of), F.col("cell") == F.col("of"))  # MAX_CELLS rows a dimension
    dealt = dealt.select((F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("ways"))).alias("shard"), "vec_id", "v")
    folder = new_path(spark, "trees")
    trees = dealt.groupBy("shard").applyInArrow(lambda table: write_tree(folder, table), "shard long, path string")
    return written(trees, "tree-list"), out


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST, relax: float = RELAX) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score) of the k best of each query, and (query_id, scored): how many vectors were scored for it."""
    spark = vectors.sparkSession
    rows = usable(vectors).distinct()
    queries = written(rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")
    # of equal vectors, only the k + 1 smallest ids can be among the k best of any query
    turn = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    candidates = written(rows.withColumn("turn", turn).where(F.col("turn") <= k + 1).drop("turn"), "candidates")
    best = spark.createDataFrame([], FOUND)
    scored, first, last = None, 0, 1
    trees, cells = index(candidates)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    tasks = spark.sparkContext.defaultParallelism
    while first < max((int(c[4].sum()) for c in cells.values()), default=0):
        worst = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
        least = F.when(F.col("n") >= k, F.col("worst")).otherwise(float("-inf")).alias("least")
        ask = queries.join(worst, "query_id", "left").select("query_id", "q", least)
        ask = small_batches(ask.repartition(tasks, "query_id")).mapInArrow(Route(cells, relax, first, last), ASKED)
        ways = min(trees.count() * SALTS, 64 * tasks)
        ask = ask.join(trees, "shard").repartition(ways, "shard", "salt").sortWithinPartitions("path")
        found = written(ask.mapInArrow(Search(k, relax), FOUND), "found")
        count = found.where("vec_id IS NULL").select("query_id", F.col("score").cast("long").alias("scored"))
        scored = count if scored is None else scored.union(count)
        best = best.union(found.where("vec_id IS NOT NULL"))
        best = written(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
        first, last = last, last * GROWTH
    if scored is None:
        scored = spark.createDataFrame([], "query_id long, scored long")
    return best, scored.groupBy("query_id").agg(F.sum("scored").alias("scored"))


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, relax: float = RELAX) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the largest inner product to each query row but itself.

    vectors has vec_id and embedding (an array of numbers); is_query is a condition on vec_id.  Nulls, null or
    non-finite components and zero vectors take no part; a query meets only vectors of its own dimension; equal scores go to
    the smaller vec_id; fewer than k candidates give fewer rows; an empty table gives none.  Rows that repeat vec_id and
    vector count once.  Where a vec_id has several vectors, each is a candidate and a query, the best of all of them are
    listed, and none of them is its own neighbour.  Other columns are ignored.
    """
    best, _ = search(vectors, is_query, k, relax)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score")
