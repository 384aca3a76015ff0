"""Nearest neighbours by inner product with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample of vectors; every vector is put in its leaf. A query walks the tree with a priority
queue of nodes, best centre first, and visits leaves in the order in which they come off the queue. How many it visits is
calibrated: a few queries are compared with all vectors, and the number is the one at which their true neighbours are
found at the wanted rate. Leaf contents and the queries that visit them meet in blocks of bounded size on both sides.

Equal vectors are one entry with their smallest ids, as many as any result can hold, so copies cost nothing twice.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivet.llm.common import cut

SAMPLE = 20_000  # vectors that the tree is fitted on, about
BRANCHES = 8
LEAVES = 64  # leaves that the tree has at the least, about, where there are vectors enough
LEAF_ROWS = 2000  # vectors in a leaf of a large table, about: leaves grow with the table, as far as the sample can tell them apart
LEAF = 40  # sampled vectors in a leaf, at the least
TRIALS = 200  # queries of the calibration, about
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048


@dataclass
class Node:
    centres: np.ndarray  # of the children
    children: list[Node | int] = field(default_factory=list)  # a number is a leaf


def kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        nearest = ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)
        for i in range(k):
            if (nearest == i).any():
                centres[i] = rows[nearest == i].mean(0)
    return centres, ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


class Tree:
    def __init__(self, rows: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 1):
        self.n_leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(rows, branches, leaf, rng)

    def _leaf(self) -> int:
        self.n_leaves += 1
        return self.n_leaves - 1

    def _grow(self, rows: np.ndarray, branches: int, leaf: int, rng: np.random.Generator) -> Node | int:
        if len(rows) <= max(leaf, branches):
            return self._leaf()
        centres, nearest = kmeans(rows, branches, rng)
        sizes = np.bincount(nearest, minlength=branches)
        if sizes.max() == len(rows):  # nothing to part
            return self._leaf()
        used = np.flatnonzero(sizes)
        node = Node(centres[used])
        node.children = [self._grow(rows[nearest == i], branches, leaf, rng) for i in used]
        return node

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row: the nearest centre at each level."""
        out = np.zeros(len(rows), np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if isinstance(node, int):
                out[own] = node
                continue
            nearest = ((node.centres**2).sum(1) - 2 * rows[own] @ node.centres.T).argmin(1)
            todo += [(child, own[nearest == i]) for i, child in enumerate(node.children) if (nearest == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves by best bin first: the node whose centre has the largest inner product is next."""
        queue: list[tuple[float, int, Node | int]] = [(0.0, 0, self.root)]
        count, out = 0, []
        while queue and len(out) < most:
            _, _, node = heapq.heappop(queue)
            if isinstance(node, int):
                out.append(node)
                continue
            for score, child in zip((node.centres @ query).tolist(), node.children):
                count += 1
                heapq.heappush(queue, (-score, count, child))
        return out


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the components."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += query[d] * rows[:, d]
    return total


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v array<double>`` of vectors that take part: no null, infinite or NaN component, not zero, of the length
    that most of these have (the smallest such length on a tie)."""
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = src.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    top = src.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return src.filter(F.size("v") == (top.n if top else 0))


def _merge(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of ``qv, s, ids`` for each query; ids of equal vectors are of one score."""
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), F.element_at("ids", 1)))
    return rows.withColumn("place", best).filter(F.col("place") <= k)


def visiting_rows(leaves: Iterable[Iterable[int]], blocks: dict[int, int], most: int = 4_096) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Query, leaf and block of every visit, ``most`` at once: a slice's vectors are what a task holds, however many leaves
    are visited and however many blocks they have."""
    at, leaf_out, block_out = [], [], []
    for i, visited in enumerate(leaves):
        for x in visited:
            for b in range(blocks.get(x, 0)):
                at.append(i)
                leaf_out.append(x)
                block_out.append(b)
                if len(at) == most:
                    yield at, leaf_out, block_out
                    at, leaf_out, block_out = [], [], []
    if at:
        yield at, leaf_out, block_out


def nearest(
    vectors: DataFrame,
    queries: Column | None = None,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = 0.95,
    sample: int = SAMPLE,
    leaf: int = LEAF,
) -> DataFrame:
    """Return ``query_id, rank int, vec_id, score double``: the ``k`` nearest found for each query row (all others, if
    fewer), by largest inner product, ties to the smaller id.

    * queries are the rows that satisfy ``queries`` (ids divisible by 20, unless given); candidates are all other rows.
    * vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
      neither do null ids. A row that repeats (same id and vector) counts once; one id with two vectors is two entries.
    * an empty table, or one without a query, gives no rows; other columns are not read.
    * ``recall`` is the rate at which the calibration's true neighbours must be found.
    """
    spark = vectors.sparkSession
    queries = F.col("vec_id") % 20 == 0 if queries is None else queries
    rows = cut(usable(vectors, id_col, vector_col).distinct())
    schema = "v array<double>, ids array<bigint>"
    # A result can hold k ids of one vector, and the query's own is not among them: k + 1 of the smallest are enough.
    near = F.row_number().over(Window.partitionBy("v").orderBy("vec_id")) <= k + 1
    first = rows.withColumn("ok", near).filter("ok").groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = first.select("v", "ids", F.xxhash64("v").alias("e"))
    n = rows.count()
    luck = F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    fitted = matrix(rows.filter(luck < sample / max(n, 1)).select("v").distinct().orderBy("v").toArrow().column("v").combine_chunks())
    tree = Tree(fitted, leaf=max(leaf, len(fitted) // max(LEAVES, n // LEAF_ROWS)))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf_of = shared.value.leaves(matrix(batch.column("v"))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of.astype(np.int32))], [*batch.schema.names, "leaf"])

    indexed = cut(entries.mapInArrow(place, f"{schema}, e bigint, leaf int"))
    asked = cut(rows.filter(queries).select("vec_id", "v"))
    # A vector is looked up once, under 128 bits of its digest.
    wanted = cut(asked.select("v").distinct().withColumn("q", F.unhex(F.md5(F.array_join(F.col("v").cast("array<string>"), ",")))))
    per_leaf = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # bounded by the tree
    n_visits = calibrate(wanted, indexed, tree, k, recall)
    blocks = {i: -(-c // BLOCK_ROWS) for i, c in per_leaf.items()}
    n_wanted = wanted.count()
    # Queries of a leaf are dealt over as many turns as keep a turn's queries few; a block's rows come to each turn.
    turns = max(1, -(-n_wanted * n_visits // (max(1, tree.n_leaves) * BLOCK_QUERIES)))
    q_blocks = max(64, n_wanted // BLOCK_QUERIES)
    turn_of = F.pmod(F.xxhash64("q"), F.lit(turns)).cast("int")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = (shared.value.visits(query, n_visits) for query in matrix(batch.column("v")))
            for at, leaf_out, block_out in visiting_rows(leaves, blocks):
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("q").take(take), batch.column("v").take(take), pa.array(leaf_out, pa.int32()), pa.array(block_out, pa.int32())], ["q", "v", "leaf", "block"])

    def search(left, right):
        """All queries that visit a block, against its rows; the best k + 1 entries of each."""
        q, rows_ = matrix(left.column("v").combine_chunks()), matrix(right.column("v").combine_chunks())
        asked_, taken, score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        ids = right.column("ids").combine_chunks()
        if len(q) and len(rows_):
            least = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0]]
            keep = min(k + 1, len(rows_))
            for start in range(0, len(q), 512):
                rough = q[start : start + 512] @ rows_.T
                # Rounding may order rough sums otherwise: all that are as good as the last one, to rounding, are summed exactly.
                last = np.partition(rough, len(rows_) - keep, axis=1)[:, len(rows_) - keep]
                i, j = np.nonzero(rough >= (last - 1e-9 * (1 + np.abs(last)))[:, None])
                i += start
                s = np.zeros(len(i))
                for d in range(q.shape[1]):
                    s += q[i, d] * rows_[j, d]
                order = np.lexsort((least[j], -s, i))
                i, j, s = i[order], j[order], s[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                best = place < keep
                asked_.append(i[best])
                taken.append(j[best])
                score.append(s[best])
        names = left.column("q").combine_chunks().take(pa.array(np.concatenate(asked_)))
        return pa.Table.from_arrays([names, pa.array(np.concatenate(score)), ids.take(pa.array(np.concatenate(taken)))], ["q", "s", "ids"])

    block_of = F.create_map(*[F.lit(x) for i, b in sorted(blocks.items()) for x in (i, b)]) if blocks else F.create_map(F.lit(0), F.lit(1))
    filed = indexed.select("v", "ids", "leaf", F.pmod(F.xxhash64("v", F.lit(2)), block_of[F.col("leaf")]).cast("int").alias("block"))
    filed = filed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    visiting = wanted.repartition(q_blocks, "q").mapInArrow(walk, "q binary, v array<double>, leaf int, block int").withColumn("turn", turn_of)
    keys = ["leaf", "block", "turn"]
    hits = visiting.groupBy(*keys).cogroup(filed.groupBy(*keys)).applyInArrow(search, "q binary, s double, ids array<bigint>")
    best = _merge(hits, k + 1).groupBy("q").agg(F.collect_list(F.struct("s", "ids")).alias("found"))
    named = cut(wanted.join(best, "q").select("v", "found"))
    # Every query of a vector takes its list, without itself.
    each = asked.join(named, "v").select(
        F.col("vec_id").alias("query_id"),
        F.expr("flatten(transform(found, f -> transform(f.ids, i -> struct(-f.s AS s, i AS i))))").alias("all"),
    )
    others = each.select("query_id", F.slice(F.sort_array(F.filter("all", lambda x: x["i"] != F.col("query_id"))), 1, k).alias("all"))
    return others.select("query_id", F.posexplode("all").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def calibrate(wanted: DataFrame, indexed: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """How many leaves a query has to visit so that a sample of queries finds its true ``k`` nearest entries at the rate
    ``recall``. The sample's neighbours come from a comparison with every entry, in tasks."""
    n = wanted.count()
    luck = F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    trial = matrix(wanted.filter(luck < TRIALS / max(n, 1)).select("v").toArrow().column("v").combine_chunks())
    if not len(trial):
        return tree.n_leaves
    shared = wanted.sparkSession.sparkContext.broadcast(trial)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("v"))
            if not len(rows):
                continue
            scores = shared.value @ rows.T
            top = np.argsort(-scores, axis=1)[:, : k + 1]
            own = np.repeat(np.arange(len(scores)), top.shape[1])
            at = top.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(scores[own, at]), batch.column("leaf").take(pa.array(at))], ["t", "s", "leaf"])

    found = indexed.select("v", "leaf").mapInArrow(compare, "t int, s double, leaf int")
    place = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s")))
    truth = found.withColumn("place", place).filter(F.col("place") <= k + 1).select("t", "leaf").collect()
    ranks = {}
    for t in {r.t for r in truth}:
        ranks[t] = {leaf: i + 1 for i, leaf in enumerate(tree.visits(trial[t], tree.n_leaves))}
    needed = np.sort([ranks[r.t][r.leaf] for r in truth])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
