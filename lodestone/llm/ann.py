"""Nearest neighbours of a set of queries by vantage-point trees.

A top tree over a bounded sample cuts space into leaves; the vectors of a leaf, in chunks of about ``shard_rows``, are
the shards, and every shard holds a vantage-point tree of its own vectors. A node has a vantage point and the median
distance to it, so by the triangle inequality the far side of the median can hold something closer than ``tau`` only
if the query's distance to the vantage point is within tau of the median. Pruning is relaxed by ``factor``: the far
side is skipped where factor * |distance - median| > tau. Factor one is exact search; larger factors skip more and
may miss some.

Each query is first searched in the leaf that it falls into, which gives it a bound; with the bound the top tree says,
by the same rule, which other leaves it has to visit. Equal vectors are one point: of those of one point only the k + 1
of the least ids can be among anybody's k nearest, and equal queries are searched once, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._common import col, ship, stored

#: The top tree has so many leaves at most and learns from SAMPLE vectors a leaf, whatever the size of the table.
MOST_LEAVES, SAMPLE = 4096, 16
#: Points of more than k + 1 copies are broadcast up to this many (about 24 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Queries, and vectors of a leaf, whose distances are held at a time.
QUERIES, BLOCK = 2048, 1024


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def _to(point: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(1))


@dataclass
class Node:
    """A leaf (``rows``) or a split."""

    rows: np.ndarray | None = None
    point: np.ndarray | None = None
    median: float = 0.0
    inside: Node | None = None
    outside: Node | None = None
    leaf: int = 0


@dataclass
class Tree:
    """With ``most_leaves`` the tree is cut at that many leaves (a power of two), else where ``leaf_size`` is reached. A
    split that would leave one side with less than a sixteenth of the rows, as where distances tie, isn't made: its rows
    stay a leaf. So the depth grows with the logarithm of the rows, and trees are built and walked without recursion."""

    x: np.ndarray
    leaf_size: int = 256
    most_leaves: int | None = None
    leaves: list[Node] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.squares = (self.x * self.x).sum(1)
        depth = None if self.most_leaves is None else int(np.ceil(np.log2(max(1, self.most_leaves))))
        self.root = Node()
        left: list[tuple[Node, np.ndarray, int]] = [(self.root, np.arange(len(self.x)), 0)]
        while left:
            node, rows, level = left.pop()
            small = len(rows) <= self.leaf_size if depth is None else level == depth or len(rows) < 2
            if small or not self._split(node, rows):
                node.rows, node.leaf = rows, len(self.leaves)
                self.leaves.append(node)
                continue
            inside = _to(node.point, self.x[rows]) < node.median
            node.inside, node.outside = Node(), Node()
            left += [(node.outside, rows[~inside], level + 1), (node.inside, rows[inside], level + 1)]

    def _split(self, node: Node, rows: np.ndarray) -> bool:
        """Choose the vantage point: of a few candidates the one whose distances spread most."""
        x = self.x[rows]
        some = x[:: max(1, len(x) // 256)][:256]
        spread, points = -1.0, x[range(0, len(x), max(1, len(x) // 8))]
        for point in points:
            d = _to(point, some)
            if (s := float(d.std())) > spread:
                spread, node.point = s, point
        d = _to(node.point, x)
        node.median = float(np.median(d))
        n = int((d < node.median).sum())
        return min(n, len(x) - n) * 16 >= len(x)

    def routes(self) -> Tree:
        """The same tree without its rows: vantage points and medians, to be handed to tasks."""
        other = Tree(self.x[:0], most_leaves=1)
        other.root, other.leaves = self.root, self.leaves
        for leaf in self.leaves:
            leaf.rows = np.zeros(0, np.int64)
        return other

    def home(self, q: np.ndarray) -> np.ndarray:
        """The leaf that each query falls into."""
        out = np.zeros(len(q), np.int64)
        left = [(self.root, np.arange(len(q)))]
        while left:
            node, at = left.pop()
            if node.rows is not None:
                out[at] = node.leaf
            elif len(at):
                inside = _to(node.point, q[at]) < node.median
                left += [(node.inside, at[inside]), (node.outside, at[~inside])]
        return out

    def visits(self, q: np.ndarray, tau: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all the leaves that pruning leaves over."""
        query, leaf = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left = [(self.root, np.arange(len(q)))]
        while left:
            node, at = left.pop()
            if node.rows is not None:
                query.append(at)
                leaf.append(np.full(len(at), node.leaf))
            elif len(at):
                gap = _to(node.point, q[at]) - node.median
                near = factor * np.abs(gap) <= tau[at] * (1 + 1e-9)
                left += [(node.inside, at[(gap < 0) | near]), (node.outside, at[(gap >= 0) | near])]
        return np.concatenate(query), np.concatenate(leaf)

    def search(self, q: np.ndarray, own: np.ndarray | None, ids: np.ndarray, k: int, factor: float, tau: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest, ordered by both; ``own`` ids are left out, missing ones are infinite, -1."""
        best = np.full((len(q), k), np.inf)
        name = np.full((len(q), k), np.iinfo(np.int64).max)
        bound = np.full(len(q), np.inf) if tau is None else tau.copy()
        squares = (q * q).sum(1)
        # a far side waits below its near side, and by then the bounds are tighter: it keeps its gaps to be asked again
        left: list[tuple[Node, np.ndarray, np.ndarray | None]] = [(self.root, np.arange(len(q)), None)]
        while left:
            node, at, gap = left.pop()
            if gap is not None:
                at = at[factor * gap <= bound[at] * (1 + 1e-9)]
            if not len(at):
                continue
            if node.rows is not None:
                for low in range(0, len(node.rows), BLOCK):
                    self._leaf(node.rows[low : low + BLOCK], q, squares, own, ids, at, best, name, bound)
                continue
            gap = _to(node.point, q[at]) - node.median
            low = gap < 0
            left += [(node.outside, at[low], -gap[low]), (node.inside, at[~low], gap[~low]), (node.inside, at[low], None), (node.outside, at[~low], None)]
        name[np.isinf(best)] = -1
        return best, name

    def _leaf(self, rows: np.ndarray, q: np.ndarray, squares: np.ndarray, own: np.ndarray | None, ids: np.ndarray, at: np.ndarray, best: np.ndarray, name: np.ndarray, bound: np.ndarray) -> None:
        """Products of matrices say who may be near, within their error; distances proper are those of differences."""
        k = best.shape[1]
        rough = squares[at][:, None] + self.squares[rows][None]
        error = 1e-12 * rough.max(1) + 1e-300
        rough -= 2 * (q[at] @ self.x[rows].T)
        if own is not None and len(here := np.flatnonzero(np.isin(own[at], ids[rows]))):
            rough[here] = np.where(own[at][here][:, None] == ids[rows][None], np.inf, rough[here])
        most = bound[at] ** 2 * (1 + 1e-9)
        if len(rows) > k:
            most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero((rough <= (most + error)[:, None]) & np.isfinite(rough))
        if not len(r):
            return
        d = np.empty(len(r))
        for low in range(0, len(r), 65_536):
            s = slice(low, low + 65_536)
            d[s] = np.sqrt(((q[at[r[s]]] - self.x[rows[c[s]]]) ** 2).sum(1))
        hit, first, size = np.unique(r, return_index=True, return_counts=True)
        place = np.arange(len(r)) - np.repeat(first, size)
        wide, labels = np.full((len(hit), int(size.max())), np.inf), np.full((len(hit), int(size.max())), np.iinfo(np.int64).max)
        row = np.repeat(np.arange(len(hit)), size)
        wide[row, place], labels[row, place] = d, ids[rows[c]]
        at = at[hit]
        wide, labels = np.concatenate([best[at], wide], 1), np.concatenate([name[at], labels], 1)
        order = np.lexsort((labels, wide), axis=1)[:, :k]
        best[at], name[at] = np.take_along_axis(wide, order, 1), np.take_along_axis(labels, order, 1)
        bound[at] = np.minimum(bound[at], best[at, -1])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _home(top: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top.home(_matrix(b.column("vec"))))], [*b.schema.names, "leaf"])

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        shard = b.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high > low:
                yield int(shard[low]), b.slice(low, high - low)


def _route(top: Tree, factor: float):
    """The leaves other than its own that a query has to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                home = b.column("home").to_numpy()
                query, leaf = top.visits(_matrix(b.column("vec")), b.column("tau").to_numpy(), factor)
                away = leaf != home[query]
                query, leaf = query[away], leaf[away]
                for low in range(0, len(query), 8192):
                    part = b.take(pa.array(query[low : low + 8192]))
                    columns = [part.column(c) for c in ("k1", "k2", "vec", "tau")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(leaf[low : low + 8192])], ["k1", "k2", "vec", "tau", "leaf"])

    return run


def _search(k: int, factor: float):
    """Rows by shard, its vectors before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree, ids = None, [], None, None
        for shard, part in _by_shard(batches):
            if shard != at:
                at, held, tree = shard, [], None
            asks = part.column("asks").to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(asks, True))
            if first:
                held.append(part.slice(0, first))
            if first < len(asks) and (held or tree):
                if tree is None:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    ids, tree, held = whole.column("id").to_numpy(), Tree(_matrix(whole.column("vec").chunk(0))), []
                for low in range(first, part.num_rows, QUERIES):
                    q = part.slice(low, QUERIES)
                    best, name = tree.search(_matrix(q.column("vec")), None, ids, k, factor, q.column("tau").to_numpy())
                    some = name >= 0
                    keys = [np.repeat(q.column(c).to_numpy(), k)[some.ravel()] for c in ("k1", "k2")]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*keys, name[some], best[some])], ["k1", "k2", "neighbour_id", "distance"])

    return run


def _keys(vec: Column) -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64(vec).alias("k1"), F.xxhash64(F.lit("lodestone"), vec).alias("k2")]


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that can be measured; vec keeps single precision where the table has it."""
    kind = df.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = df.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<float>" if single else "array<double>").alias("vec"))
    rows = rows.where("id IS NOT NULL AND size(vec) > 0")
    return rows.where(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _once(rows: DataFrame) -> DataFrame:
    """One row for each id, of its least vector. Only ids travel to find those that repeat."""
    twice = stored(rows.groupBy("id").count().where("count > 1").select("id"), "repeated")
    if twice.isEmpty():
        return rows
    many = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec"))
    return stored(rows.join(twice, "id", "left_anti").unionByName(many), "vectors")


def _points(rows: DataFrame, k: int) -> DataFrame:
    """Of each point's copies the k + 1 of the least ids: no other can be among the k nearest of anything. Only keys and
    ids travel to find points of more copies."""
    keyed = rows.select("id", *_keys(F.col("vec")))
    hot = keyed.groupBy("k1", "k2").count().where(F.col("count") > k + 1).select("k1", "k2")
    nth = Window.partitionBy("k1", "k2").orderBy("id")  # a limit on the rank is applied before the shuffle, too
    least = keyed.join(hot, ["k1", "k2"], "left_semi").withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1)
    last = stored(least.groupBy("k1", "k2").agg(F.max("id").alias("last")), "copies")
    n = last.count()
    if not n:
        return rows
    k1, k2 = _keys(F.col("vec"))
    met = rows.select("id", "vec", k1, k2).join(F.broadcast(last) if n <= BROADCAST_ROWS else last, ["k1", "k2"], "left")
    return met.where("last IS NULL OR id <= last").select("id", "vec")


def nearest(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, factor: float = 1.0, shard_rows: int = 16_384) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the k nearest of all ``vectors`` to each of ``queries`` (rows of the same
    columns; without them every vector is a query), by Euclidean distance, ties by id. A row of the query's own id is no
    neighbour of it.

    Left out, as queries and as neighbours: rows without id, and vectors that are null, empty, hold a null or a number
    that isn't finite, or haven't the dimension that most rows of ``vectors`` have (the larger one of equals). An id that
    repeats counts once, by its least vector; equal vectors of different ids are neighbours at distance 0, however many
    there are. An empty table gives no rows, and so do queries without any vectors; a vector of any length is measured
    whole. Other columns are ignored. Ids are cast to long, what can't be is an error.

    The top tree learns from ``SAMPLE`` vectors a leaf, of ``MOST_LEAVES`` leaves at most (65,536 in all), picked by a hash
    of their id; every row is indexed."""
    spark = vectors.sparkSession
    ship(spark)
    if factor < 1:
        raise ValueError("factor starts at one")
    rows = _vectors(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, rank int, distance double")
    right = F.size("vec") == sizes["n"]
    rows = _once(rows.where(right))
    asked = rows if queries is None else _once(_vectors(queries, id_col, vector_col).where(right))
    n = sizes["count"]
    leaves = min(MOST_LEAVES, 1 << max(0, int(np.ceil(np.log2(n / shard_rows)))))
    share = min(1.0, SAMPLE * leaves / n)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40))).limit(2 * SAMPLE * leaves).orderBy("id").toArrow().combine_chunks()
    top = Tree(_matrix(sample.column("vec").chunk(0)) if sample.num_rows else np.zeros((0, sizes["n"])), most_leaves=leaves).routes()
    kind = rows.schema["vec"].dataType.simpleString()
    placed = stored(_points(rows, k).mapInArrow(_home(top), f"id long, vec {kind}, leaf long"), "placed")
    # a row for each leaf: its chunks and the number of its first shard
    chunks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / shard_rows).alias("chunks"))
    plan = F.broadcast(stored(chunks.withColumn("first", F.sum("chunks").over(Window.orderBy("leaf")) - F.col("chunks")), "plan"))
    index = placed.join(plan, "leaf").select("id", "vec", (F.col("first") + F.pmod(F.xxhash64("id"), "chunks")).alias("shard"))
    points = stored(asked.select("vec", *_keys(F.col("vec"))).groupBy("k1", "k2").agg(F.first("vec").alias("vec")).mapInArrow(_home(top), f"k1 long, k2 long, vec {kind}, leaf long"), "queries")

    def search(routed: DataFrame) -> DataFrame:
        """(k1, k2, distance, neighbour_id) for (k1, k2, vec, tau, leaf)."""
        each = routed.join(plan, "leaf").withColumn("shard", F.explode(F.sequence("first", F.col("first") + F.col("chunks") - 1)))
        each = each.select("k1", "k2", "vec", "tau", "shard", F.lit(True).alias("asks"))
        both = each.unionByName(index.withColumn("asks", F.lit(False)), allowMissingColumns=True)
        ordered = both.repartition("shard").sortWithinPartitions("shard", "asks")
        return ordered.mapInArrow(_search(k + 1, factor), "k1 long, k2 long, neighbour_id long, distance double")

    def best(found: DataFrame) -> DataFrame:
        return found.groupBy("k1", "k2").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k + 1).alias("best"))

    near = stored(best(search(points.withColumn("tau", F.lit(float("inf"))))), "at-home")
    tau = F.coalesce(F.try_element_at("best", F.lit(k + 1))["distance"], F.lit(float("inf")))
    bounded = points.join(near.select("k1", "k2", tau.alias("tau")), ["k1", "k2"], "left").select("k1", "k2", "vec", F.coalesce("tau", F.lit(float("inf"))).alias("tau"), F.col("leaf").alias("home"))
    away = search(bounded.mapInArrow(_route(top, factor), f"k1 long, k2 long, vec {kind}, tau double, leaf long"))
    first = near.select("k1", "k2", F.explode("best").alias("x")).select("k1", "k2", "x.neighbour_id", "x.distance")
    done = best(first.unionByName(away))
    named = asked.select(F.col("id").alias("vec_id"), *_keys(F.col("vec"))).join(done, ["k1", "k2"])
    others = named.select("vec_id", F.posexplode(F.slice(F.filter("best", lambda x: x["neighbour_id"] != F.col("vec_id")), 1, k)).alias("pos", "x"))
    return others.select("vec_id", F.col("x.neighbour_id").alias("neighbour_id"), (F.col("pos") + 1).alias("rank"), F.col("x.distance").alias("distance"))
