"""Exact top-k search by inner product: dual-tree search with cover trees over cells of queries and of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.scratch import dropped, written

#: Scores a query gets, points of a leaf on average, and bytes of a block of vectors or queries, about.
BEST, LEAF, BLOCK_BYTES = 5, 128, 1 << 19
#: Vectors of the bounded sample, of which some are the middles of cells and all give queries their first worst scores.
SAMPLE = 8192
#: Vectors and queries a cell, about; cells at most; and lengths of vectors that are dealt to cells (others are searched whole).
CELL, QUERY_CELL, CELLS, LENGTHS = 4096, 256, 1024, 4


class Node(NamedTuple):
    """A node of a cover tree: its centre (a point of its own), the radius that covers points ``low`` to ``high``."""

    centre: np.ndarray
    norm: float
    radius: float
    low: int
    high: int
    children: tuple[Node, ...]


class Tree(NamedTuple):
    """A cover tree in arrays: ``order`` puts points so that every node's are neighbours; nodes come parents first.

    ``level`` l of a node says that its centre joined the net of level l: centres of that net lie 2**l or more apart,
    every point lies within 2**l of one of them, and the net of the level above is part of it.
    """

    order: np.ndarray
    centre: np.ndarray  # places in ``order``
    level: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    parent: np.ndarray


def farthest_first(x: np.ndarray, most: int) -> tuple[list[int], list[float], np.ndarray]:
    """Centres, each the point farthest from those before; how far it was; and each point's nearest centre."""
    first = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    centres, gaps, nearest = [first], [np.inf], np.zeros(len(x), np.int64)
    gap = ((x - x[first]) ** 2).sum(1)
    while len(centres) < most and gap.max() > 0:
        at = int(gap.argmax())
        gaps.append(float(np.sqrt(gap[at])))
        to = ((x - x[at]) ** 2).sum(1)
        nearest[to < gap] = len(centres)
        gap = np.minimum(gap, to)
        centres.append(at)
    return centres, gaps, nearest


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of the nets that farthest-first centres make: those that were 2**l or more away are the net of level l."""
    centres, gaps, nearest = farthest_first(x, -(-len(x) // leaf))
    level = np.array([10_000, *[int(np.floor(np.log2(g))) for g in gaps[1:]]])
    children: dict[int, list[tuple[int, list[int]]]] = {c: [] for c in range(len(centres))}  # by centre: (level, new ones)
    for own in sorted(set(level[1:].tolist()), reverse=True):
        new = np.flatnonzero(level == own)
        above = x[centres[: new[0]]]
        to = ((x[np.array(centres)[new]][:, None, :] - above[None]) ** 2).sum(2) if len(new) * len(above) * x.shape[1] < 1 << 24 else np.stack([((x[centres[k]] - above) ** 2).sum(1) for k in new])
        for k, parent in zip(new.tolist(), to.argmin(1).tolist(), strict=True):
            if not children[parent] or children[parent][-1][0] != own:
                children[parent].append((own, []))
            children[parent][-1][1].append(k)
    by_centre = np.argsort(nearest, kind="stable")
    cuts = np.searchsorted(nearest[by_centre], np.arange(len(centres) + 1))
    order: list[np.ndarray] = []
    nodes: list[list[float]] = []  # centre, level, low, high, parent
    filled = 0

    def grow(c: int, step: int, parent: int, own: int) -> None:
        """The subtree of centre ``c`` from its children of number ``step`` on."""
        nonlocal filled
        me = len(nodes)
        nodes.append([c, own, filled, 0, parent])
        if step < len(children[c]):
            lower, new = children[c][step]
            grow(c, step + 1, me, lower)
            for k in new:
                grow(k, 0, me, lower)
        else:
            points = by_centre[cuts[c] : cuts[c + 1]]
            order.append(points)
            filled += len(points)
        nodes[me][3] = filled

    grow(0, 0, -1, int(level[0]))
    whole = np.concatenate(order)
    place = np.empty(len(whole), np.int64)
    place[whole] = np.arange(len(whole))
    c, own, low, high, parent = (np.array(v, np.int64) for v in zip(*nodes, strict=True))
    middle = np.array(centres)[c]
    radius = np.array([np.sqrt(((x[whole[a:b]] - x[m]) ** 2).sum(1).max(initial=0.0)) for m, a, b in zip(middle, low, high, strict=True)])
    return Tree(whole, place[middle], own, low, high, radius, parent)


def bound(a: Node, b: Node) -> float:
    """No product of a point of ``a`` and one of ``b`` is greater."""
    most = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    return most + 1e-9 * (1 + abs(most))


class Search:
    """The best ``k`` (score, id) of every query so far, ties to smaller ids, and the dual descent that fills them."""

    def __init__(self, queries: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
        # Products of whole numbers are exact in doubles below 2**53; larger ones are taken in integers.
        exact = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1] < 2**53
        kind = np.float64 if exact else np.int64
        self.q, self.x, self.ids, self.k = queries.astype(kind), vectors.astype(kind), ids, k
        self.floor = floor
        self.scores = np.full((len(queries), k), np.iinfo(np.int64).min, np.int64)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)

    def worst(self, a: Node) -> int:
        return int(np.maximum(self.scores[a.low : a.high, -1], self.floor[a.low : a.high]).min())

    def meet(self, a: Node, b: Node) -> None:
        scores = (self.q[a.low : a.high] @ self.x[b.low : b.high].T).astype(np.int64)
        rows = np.flatnonzero(scores.max(1) >= np.maximum(self.scores[a.low : a.high, -1], self.floor[a.low : a.high]))
        if len(rows):
            at = a.low + rows
            every = np.concatenate([self.scores[at], scores[rows]], 1)
            ids = np.concatenate([self.found[at], np.broadcast_to(self.ids[b.low : b.high], (len(rows), b.high - b.low))], 1)
            order = np.lexsort((ids, ~every), axis=1)[:, : self.k]
            self.scores[at], self.found[at] = np.take_along_axis(every, order, 1), np.take_along_axis(ids, order, 1)

    def descend(self, a: Node, b: Node) -> None:
        """Visits pairs of nodes, the most promising first; a pair whose bound is below every worst score is left."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if bound(a, b) < self.worst(a):
                continue
            if not a.children and not b.children:
                self.meet(a, b)
            elif b.children and (not a.children or b.radius >= a.radius):
                stack += sorted(((a, c) for c in b.children), key=lambda p: bound(*p))
            else:
                stack += sorted(((c, b) for c in a.children), key=lambda p: bound(*p))


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """A column of lists of ``size`` whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


TREES = "size int, cell int, sub int, ids array<long>, floor array<long>, kind string, data binary, centre array<int>, low array<int>, high array<int>, radius array<double>, parent array<int>"


def plant(block: pa.Table, leaf: int = LEAF) -> pa.Table:
    """For applyInArrow: a block of (id, size, whole, cell, sub, floor) to one row with its tree, points in tree order."""
    size = block.column("size")[0].as_py()
    x = matrix(block.column("whole"), size)
    tree = cover_tree(x.astype(np.float64), leaf)
    reach = int(np.abs(x).max(initial=0))
    kind = "<i2" if reach < 1 << 15 else "<i4" if reach < 1 << 31 else "<i8"
    list_of = lambda v, t: pa.array([v.tolist()], pa.list_(t))
    columns = [
        *(block.column(c).slice(0, 1).combine_chunks() for c in ("size", "cell", "sub")), list_of(block.column("id").to_numpy()[tree.order], pa.int64()),
        list_of(block.column("floor").to_numpy()[tree.order], pa.int64()), pa.array([kind]), pa.array([x[tree.order].astype(kind).tobytes()], pa.binary()),
        list_of(tree.centre, pa.int32()), list_of(tree.low, pa.int32()), list_of(tree.high, pa.int32()), list_of(tree.radius, pa.float64()), list_of(tree.parent, pa.int32()),
    ]
    return pa.table(columns, names=[f.split()[0] for f in TREES.split(", ")])


def planted_rows(table: pa.Table) -> Iterator[dict]:
    """Rows of planted trees, their lists as arrays."""
    for i in range(len(table)):
        cells = {c: table.column(c)[i] for c in table.column_names}
        yield {c: x.values.to_numpy(zero_copy_only=False) if pa.types.is_list(x.type) else x.as_py() for c, x in cells.items()}


def points(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], row["kind"]).astype(np.int64).reshape(len(row["ids"]), row["size"])


def grown(row: dict) -> tuple[np.ndarray, Node]:
    """Points and root of a planted tree."""
    x = points(row)
    centres = x[row["centre"]].astype(np.float64)
    norms = np.sqrt((centres**2).sum(1)).tolist()
    radius, low, high, parent = (row[c].tolist() for c in ("radius", "low", "high", "parent"))
    children: list[list[Node]] = [[] for _ in parent]
    root = None
    for i in range(len(parent) - 1, -1, -1):  # children come after their parents
        root = Node(centres[i], norms[i], radius[i], low[i], high[i], tuple(children[i][::-1]))
        if parent[i] >= 0:
            children[parent[i]].append(root)
    return x, root


FOUND = "query long, vec_id long, score long"


def searcher(k: int):
    """A function for cogrouped applyInArrow: a block of queries and one of vectors to the best of each query."""

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        query, vec_id, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q_row in planted_rows(queries):
            q, q_root = grown(q_row)
            for x_row in planted_rows(vectors):
                x, x_root = grown(x_row)
                run = Search(q, q_row["floor"], x, x_row["ids"], k)
                run.descend(q_root, x_root)
                good = run.found.ravel() != np.iinfo(np.int64).max
                query.append(np.repeat(q_row["ids"], k)[good])
                vec_id.append(run.found.ravel()[good])
                score.append(run.scores.ravel()[good])
        return pa.table([pa.array(np.concatenate(v)) for v in (query, vec_id, score)], names=[f.split()[0] for f in FOUND.split(", ")])

    return search


def placer(middles: dict[int, np.ndarray]):
    """A function for mapInArrow: adds the cell of the nearest middle (-1 for lengths without) and the distance to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            cell, reach = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            for n, own in middles.items():
                rows = np.flatnonzero(size == n)
                if len(rows):
                    x = matrix(batch.column("whole").take(pa.array(rows)), n).astype(np.float64)
                    cell[rows] = ((own**2).sum(1) - 2 * (x @ own.T)).argmin(1)
                    reach[rows] = np.sqrt(((x - own[cell[rows]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(reach)], [*batch.schema.names, "cell", "reach"])

    return place


def floored(samples: dict[int, np.ndarray], k: int):
    """A function for mapInArrow: each query's kth best score over the sample, a lower bound of its final one."""

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = np.full(len(batch), np.iinfo(np.int64).min, np.int64), batch.column("size").to_numpy()
            for n, own in samples.items():
                rows = np.flatnonzero(size == n) if len(own) >= k else []
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    out[some] = np.partition(matrix(batch.column("whole").take(pa.array(some)), n) @ own.T, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "floor"])

    return floor


def nearby(k: int):
    """A function for cogrouped applyInArrow: queries of a cell and a block near it to the queries' kth best scores in it."""

    def near(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out, size = np.full(len(queries), np.iinfo(np.int64).min, np.int64), queries.column("size")[0].as_py() if len(queries) else 0
        for row in planted_rows(vectors):
            x = points(row)
            for at in range(0, len(queries) if len(x) >= k else 0, 1024):
                q = matrix(queries.column("whole").slice(at, 1024), size)
                out[at : at + 1024] = np.maximum(out[at : at + 1024], np.partition(q @ x.T, -k, axis=1)[:, -k])
        return pa.table([queries.column("id"), pa.array(out)], names=["id", "near"])

    return near


def blocks(rows: DataFrame) -> DataFrame:
    """Add ``sub``: which block of its cell a row is in; blocks have about ``BLOCK_BYTES``, at 2 bytes a component."""
    most = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / (2 * F.greatest(F.col("size"), F.lit(1)))))
    sizes = rows.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / F.first(most)).alias("_subs"))
    return rows.join(sizes, ["size", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("_subs")).cast("int")).drop("_subs")


def planted(rows: DataFrame) -> DataFrame:
    leaf = LEAF

    def grow(block: pa.Table) -> pa.Table:
        return plant(block, leaf)

    return rows.select("id", "size", "whole", "cell", "sub", "floor").groupBy("size", "cell", "sub").applyInArrow(grow, TREES)


def cell_pairs(middles: dict[int, np.ndarray], queries: list, vectors: list) -> tuple[pa.Table, int]:
    """(size, q_cell, v_cell) of the pairs of cells that can hold a result, and how many pairs there are.

    ``queries`` are rows (size, cell, reach, floor) of the query cells, the floor their worst one, ``vectors`` rows
    (size, cell, reach). No product over two cells is greater than that of their middles plus what the reaches allow.
    """
    out, every = [], 0
    for n, own in middles.items():
        q, v = [r for r in queries if r["size"] == n], [r for r in vectors if r["size"] == n]
        if not q or not v:
            continue
        norm = np.sqrt((own**2).sum(1))
        qc, vc = np.array([r["cell"] for r in q]), np.array([r["cell"] for r in v])
        rq, rv = np.array([r["reach"] for r in q])[:, None], np.array([r["reach"] for r in v])[None]
        most = own[qc] @ own[vc].T + norm[qc][:, None] * rv + norm[vc][None] * rq + rq * rv
        a, b = np.nonzero(most + 1e-9 * (1 + np.abs(most)) >= np.array([float(r["floor"]) for r in q])[:, None])
        out.append((np.full(len(a), n), qc[a], vc[b]))
        every += most.size
    columns = [np.concatenate(x) if x else np.zeros(0) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
    return pa.table([pa.array(c.astype(np.int32)) for c in columns], names=["size", "q_cell", "v_cell"]), every


def nearest(vectors: DataFrame, queries: DataFrame, k: int = BEST, sample: int = SAMPLE, cell: int = CELL, query_cell: int = QUERY_CELL, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest inner products of each of ``queries`` with ``vectors``.

    Both have (vec_id, embedding). A component x counts as floor(256 * x), so scores are whole numbers and exact; ties
    go to the smaller vec_id; a query's own vec_id takes no part. Null vectors, rows without a vec_id and vectors with
    null or non-finite components take no part; vectors of another length than the query's have no score with it; those
    without components score 0 with each other. Of rows that repeat a vec_id each counts: as a candidate with its own
    score, as a query with its own products, of which the k greatest of all its rows are returned. Fewer than k
    candidates give all. Other columns, whatever their names, aren't looked at. Empty tables give an empty result.

    Of equal vectors only the smallest ids can be in a result, as many as k and the rows of one query's vec_id, ``most``;
    equal queries have the same ``most`` best. So each distinct vector is kept with ``most`` ids and searched for once,
    which is exact. Then:

    1. A bounded sample (``sample`` vectors) gives middles. Every vector and query is dealt to the cell of its nearest
       middle, cells are split into blocks of bounded size, and each block's cover tree is planted once.
    2. The sample, then a block of the most promising cell, give each query a worst score to start with.
    3. Cells that by their covering radii can't reach the worst score of any query of a query cell aren't sent to it:
       only cell figures, at most ``CELLS`` for each of ``LENGTHS`` lengths, meet on the driver.
    4. The trees of the other pairs of blocks are descended together.

    ``report``, if given, gets the numbers of pairs of cells and of those that were left.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))

    def good(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        rows = rows.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull())
        return rows.select("vec_id", whole.alias("whole"))

    asked = written(good(queries), "queries")
    own = good(vectors).select("vec_id").join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").count()
    most = k + max(own.agg(F.max("count")).first()[0] or 0, 1)
    rank = Window.partitionBy("whole").orderBy("vec_id")
    kept = good(vectors).withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= most)
    kept = written(kept.select(F.col("vec_id").alias("id"), F.size("whole").alias("size"), "whole"), "vectors")
    first = kept.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    found_sizes, counts = np.unique(first.column("size").to_numpy(), return_counts=True)
    samples = {}
    for n in found_sizes[np.argsort(-counts)][:LENGTHS].tolist():
        samples[n] = matrix(first.filter(pa.array(first.column("size").to_numpy() == n)).column("whole"), n)
    cells = min(CELLS, max(1, kept.count() // cell))
    middles = {n: x[:cells].astype(np.float64) for n, x in samples.items()}
    q_cells = min(cells, max(1, asked.count() // query_cell))
    q_middles = {n: x[:q_cells] for n, x in middles.items()}  # the first of them, so that fewer queries make as large cells

    shape = "id long, size int, whole array<long>, cell int, reach double"
    dealt = written(kept.mapInArrow(placer(middles), shape), "vectors-dealt")
    dropped(kept)
    trees = written(planted(blocks(dealt).withColumn("floor", F.lit(0).cast("long"))), "vector-trees")
    v_cells = dealt.groupBy("size", "cell").agg(F.max("reach").alias("reach"))
    v_rows = v_cells.where("cell >= 0").collect()
    dropped(dealt)

    distinct = asked.select("whole").distinct().select(F.monotonically_increasing_id().alias("id"), F.size("whole").alias("size"), "whole")
    distinct = written(distinct, "queries-distinct")  # ids are kept, as they are written
    distinct = distinct.mapInArrow(placer(q_middles), shape).mapInArrow(floored(samples, most), f"{shape}, floor long")
    distinct = written(blocks(distinct.where("true")), "queries-floored")
    near = []  # the cell with the greatest product of middles for each cell of queries
    for n, own in middles.items():
        have = np.array(sorted(r["cell"] for r in v_rows if r["size"] == n), np.int64)
        near += [(n, int(c), int(have[b])) for c, b in enumerate((q_middles[n] @ own[have].T).argmax(1))] if len(have) else []
    spark = vectors.sparkSession
    best_cell = spark.createDataFrame(near, "size int, cell int, v_cell int")
    left = distinct.join(F.broadcast(best_cell), ["size", "cell"])  # at most CELLS * LENGTHS rows
    right = trees.where("sub = 0").withColumnRenamed("cell", "v_cell").join(F.broadcast(best_cell), ["size", "v_cell"])
    right = right.join(distinct.select("size", F.col("cell"), F.col("sub").alias("q_sub")).distinct(), ["size", "cell"])
    left = left.withColumnRenamed("sub", "q_sub")
    keys = ["size", "cell", "q_sub"]
    closer = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearby(most), "id long, near long")
    floors = distinct.join(closer, "id", "left").withColumn("floor", F.greatest("floor", F.coalesce("near", "floor"))).drop("near")
    floors = written(floors, "queries-near")
    q_trees = written(planted(floors), "query-trees")
    q_rows = floors.where("cell >= 0").groupBy("size", "cell").agg(F.max("reach").alias("reach"), F.min("floor").alias("floor")).collect()

    left_pairs, every = cell_pairs(middles, q_rows, v_rows)
    if report is not None:
        report |= {"cell_pairs": every, "left": len(left_pairs)}
    pairs = spark.createDataFrame(left_pairs.to_pandas(), "size int, q_cell int, v_cell int")
    others = q_trees.where("cell = -1").select("size", F.col("cell").alias("q_cell"), F.col("cell").alias("v_cell")).distinct()
    pairs = pairs.union(others)
    q_blocks, v_blocks = (t.select("size", F.col("cell").alias(f"{x}_cell"), F.col("sub").alias(f"{x}_sub")) for t, x in ((q_trees, "q"), (trees, "v")))
    pairs = written(pairs.join(q_blocks, ["size", "q_cell"]).join(v_blocks, ["size", "v_cell"]), "block-pairs")
    keys = ["size", "q_cell", "q_sub", "v_cell", "v_sub"]
    q_side = q_trees.withColumnsRenamed({"cell": "q_cell", "sub": "q_sub"}).join(pairs, ["size", "q_cell", "q_sub"])
    v_side = trees.withColumnsRenamed({"cell": "v_cell", "sub": "v_sub"}).join(pairs, ["size", "v_cell", "v_sub"])
    named = lambda side: side.select(*keys, *[f.split()[0] for f in TREES.split(", ") if f.split()[0] not in ("size", "cell", "sub")])
    met = named(q_side).groupBy(*keys).cogroup(named(v_side).groupBy(*keys)).applyInArrow(searcher(most), FOUND)

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    met = met.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).select("query", "vec_id", "score")
    ids = distinct.select(F.col("id").alias("query"), "whole").join(asked, "whole").select("query", F.col("vec_id").alias("query_id"))
    found = ids.join(met, "query").where(F.col("query_id") != F.col("vec_id"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for each vector whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
