"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and goes to every task; leaves grow in
number with the table as far as the sample bears. Every vector is filed under the leaf it descends to. A query
walks the tree with a priority queue, always opening the node whose centre has
the largest inner product with it, and visits leaves until it has seen as many
as the calibration asks for and enough vectors to answer. Calibration widens the
visits, on sampled queries with their true neighbours, until the wanted recall
is reached. Leaves are cut into pieces of bounded size, so a common vector
doesn't make a task long; queries meet the pieces of their leaves by shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from framelake.llm.common import materialise
from framelake.llm.sampling import fraction_of

#: Sample, rows of the table in a leaf, children of a node, rows in a piece of a leaf, at most; rows of the sample in a leaf, at least.
FIT_ROWS, LEAF, BRANCHES, PIECE, LEAST = 20_000, 1_000, 8, 4_096, 32
#: Neighbours, recall that calibration reaches on the sample, queries it uses.
K, RECALL, CALIBRATION = 20, 0.95, 200
#: Every row whose id this divides is a query.
QUERY_STEP = 20


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, one not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class KMeansTree:
    """Nodes by number: centre, children (none for a leaf), leaf number."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, branches: int = BRANCHES, seed: int = 11) -> None:
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf_of: dict[int, int] = {}
        self._rng = np.random.default_rng(seed)
        self._grow(np.asarray(vectors, dtype=np.float64), leaf, branches)
        self.matrix = [np.stack([self.centres[c] for c in own]) if own else None for own in self.children]

    def _grow(self, vectors: np.ndarray, leaf: int, branches: int) -> int:
        node = len(self.centres)
        self.centres.append(vectors.mean(axis=0))
        self.children.append([])
        groups = self._split(vectors, branches) if len(vectors) > leaf else []
        if len(groups) < 2:
            self.leaf_of[node] = len(self.leaf_of)
        else:
            self.children[node] = [self._grow(g, leaf, branches) for g in groups]
        return node

    def _split(self, vectors: np.ndarray, branches: int, rounds: int = 10) -> list[np.ndarray]:
        distinct = np.unique(vectors, axis=0)
        centres = distinct[self._rng.permutation(len(distinct))[:branches]]
        for _ in range(rounds):
            own = (vectors @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            centres = np.stack([vectors[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        own = (vectors @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        return [vectors[own == i] for i in range(len(centres)) if (own == i).any()]

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf to which each vector descends, by the nearest centre at every node."""
        out = np.zeros(len(vectors), dtype=np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            m = self.matrix[node]
            own = (vectors[rows] @ m.T - (m**2).sum(axis=1) / 2).argmax(axis=1)
            todo += [(child, rows[own == i]) for i, child in enumerate(self.children[node])]
        return out

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Leaves from the most to the least promising."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf_of[node]
            else:
                for child, score in zip(self.children[node], (self.matrix[node] @ query).tolist(), strict=True):
                    heapq.heappush(queue, (-score, child))

    def visits(self, query: np.ndarray, leaves: int, rows_in: np.ndarray, least: int) -> list[int]:
        """The first ``leaves`` leaves, and further ones until they hold ``least`` rows."""
        out, rows = [], 0
        for leaf in self.walk(query):
            if len(out) >= leaves and rows >= least:
                break
            out.append(leaf)
            rows += int(rows_in[leaf])
        return out


def calibrate(tree: KMeansTree, sample: np.ndarray, k: int = K, recall: float = RECALL, queries: int = CALIBRATION) -> int:
    """Leaf visits at which ``recall`` of the sampled queries' true neighbours in the sample are found."""
    sample = np.asarray(sample, dtype=np.float64)
    filed, leaves = tree.file(sample), len(tree.leaf_of)
    needed = []
    for i in range(0, len(sample), max(1, len(sample) // queries)):
        score = sample @ sample[i]
        score[i] = -np.inf
        true = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        rank = np.zeros(leaves, dtype=np.int64)
        rank[list(tree.walk(sample[i]))] = np.arange(1, leaves + 1)
        needed.append(rank[filed[true]])
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0, dtype=np.int64)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else leaves


def best(vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, query: np.ndarray, own: int, k: int, rough: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, uids, scores) of the k largest inner products, ties to smaller ids; the query's own row takes no part.

    ``rough`` has the products as a matrix product gives them, ``reach`` is the
    longest vector's length; those that may count are summed again in one fixed order, so that equal
    vectors tie. A product that is too large for a double is infinite, and not a number where
    parts of both signs are; these come last, after all numbers, and any that isn't finite may count.
    """
    other = uids != own
    finite = np.isfinite(rough) & other
    near = rough[finite]
    if len(near) > k:
        edge = np.partition(near, len(near) - k)[len(near) - k]
        with np.errstate(over="ignore"):
            slack = 4 * len(query) * np.finfo(np.float64).eps * float(np.linalg.norm(query)) * reach
        finite &= ~(rough < edge - slack)
    at = np.nonzero(finite | other & ~np.isfinite(rough))[0]
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.multiply(vectors[at], query[None, :]).sum(axis=1)
    at = at[order := np.lexsort((uids[at], ids[at], np.where(np.isnan(score), 0.0, -score), np.isnan(score)))[:k]]
    return ids[at], uids[at], score[order]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search_pieces(dim: int, k: int):
    """Rows sorted by (leaf, piece, kind): a piece's vectors, kind 0, then the queries that visit it, kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []
        ready: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        reach = 0.0
        for batch in batches:
            leaf, piece, kind, own, uid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            matrix = _matrix(batch.column(5), dim)
            cuts = np.nonzero((np.diff(leaf) != 0) | (np.diff(piece) != 0) | (np.diff(kind) != 0))[0] + 1
            edges = [0, *cuts.tolist(), len(leaf)]
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if at != (leaf[a], piece[a]):
                    at, ids, vectors, ready = (leaf[a], piece[a]), [], [], None
                if kind[a] == 0:
                    ids.append(np.stack([own[a:b], uid[a:b]]))
                    vectors.append(matrix[a:b])
                    continue
                if ready is None:
                    ready = (*np.concatenate(ids, axis=1), np.concatenate(vectors).astype(np.float64)) if ids else (*np.zeros((2, 0), dtype=np.int64), np.zeros((0, dim)))
                    with np.errstate(over="ignore"):
                        reach = float(np.linalg.norm(ready[2], axis=1).max(initial=0.0))
                if len(ready[0]):
                    queries = matrix[a:b].astype(np.float64)
                    for i in range(0, b - a, 256):
                        with np.errstate(over="ignore", invalid="ignore"):
                            rough = queries[i : i + 256] @ ready[2].T
                        for j, row in enumerate(rough):
                            query = a + i + j
                            found = best(ready[2], ready[0], ready[1], queries[i + j], uid[query], k, row, reach)
                            out.append((np.full(len(found[0]), uid[query]), np.full(len(found[0]), own[query]), *found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(5)], names=["query", "query_id", "vec_id", "uid", "score"])

    return run


def nearest(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_step: int = QUERY_STEP,
    recall: float = RECALL, fit_rows: int = FIT_ROWS, leaf: int = LEAF, piece: int = PIECE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row whose id ``query_step`` divides.

    Nearness is the inner product in double precision; ties go to the smaller
    vec_id. Vectors that are null, zero, hold null or non-finite components, or
    have another length than most take no part, nor do rows without an id. Every
    row but the query's own is a candidate, so rows that repeat are found as often
    as they occur, and an id that occurs twice has two queries, each with ranks of
    its own. With fewer than ``k`` candidates all are returned. An empty table
    gives no rows. A product beyond the range of doubles is infinite, or not a number and then last. Further columns are not read. Components are read as they are,
    floats as floats, others as doubles. The tree is fitted on about ``fit_rows``
    vectors at most, and a leaf is meant to hold about ``leaf`` rows of the table.
    """
    spark = table.sparkSession
    single = isinstance(table.schema[vector_col].dataType, ArrayType) and isinstance(table.schema[vector_col].dataType.elementType, FloatType)
    kind = "array<float>" if single else "array<double>"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector")).filter(usable(F.col("vector")) & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, total = lengths[0]
    rows = rows.filter(F.size("vector") == dim)
    part = min(1.0, fit_rows / total)
    # A hash of id and vector, and as many rows at most, so that ids that repeat can't swell the sample.
    chosen = rows.filter(fraction_of(F.concat_ws(" ", "id", F.xxhash64("vector"))) < part).limit(2 * fit_rows).toPandas().sort_values("id")
    if not len(chosen):
        chosen = rows.limit(1).toPandas()
    sample = np.stack(chosen["vector"].to_numpy()).astype(np.float64)
    # The tree sees all vectors at a scale, a power of two, at which the sample's squares are finite.
    scale = -int(np.frexp(np.abs(sample).max())[1])
    sample = np.ldexp(sample, scale)
    tree = KMeansTree(sample, max(LEAST, round(leaf * part)))
    visits = calibrate(tree, sample, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filed = shared.value.file(np.ldexp(_matrix(batch.column(1), dim).astype(np.float64), scale))
            yield pa.RecordBatch.from_arrays([pa.array(filed), *(batch.column(i) for i in range(3))], names=["leaf", "id", "vector", "uid"])

    # The rows' own numbers hold, as they are written with the rows.
    filed = materialise(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(file, f"leaf long, id long, vector {kind}, uid long"))
    rows_in = np.zeros(len(tree.leaf_of), dtype=np.int64)
    for leaf_id, n in filed.groupBy("leaf").count().collect():  # a row for each leaf of the bounded tree
        rows_in[leaf_id] = n
    pieces = np.maximum(1, -(-rows_in // piece))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.ldexp(_matrix(batch.column(1), dim).astype(np.float64), scale)
            leaves = [shared.value.visits(q, visits, rows_in, k + 1) for q in matrix]
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.list_(pa.int64())), *(batch.column(i) for i in range(3))], names=["leaves", "id", "vector", "uid"])

    cut = F.element_at(F.array(*[F.lit(int(p)) for p in pieces]), (F.col("leaf") + 1).cast("int"))
    vectors = filed.select("leaf", F.pmod(F.xxhash64("uid"), cut).cast("long").alias("piece"), F.lit(0).alias("kind"), "id", "uid", "vector")
    walks = filed.filter(F.col("id") % query_step == 0).select("id", "vector", "uid").mapInArrow(visit, f"leaves array<long>, id long, vector {kind}, uid long")
    queries = (
        walks.select(F.explode("leaves").alias("leaf"), "id", "uid", "vector")
        .select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), (cut - 1).cast("long"))).alias("piece"), F.lit(1).alias("kind"), "id", "uid", "vector")
    )
    met = vectors.unionByName(queries).repartition("leaf", "piece").sortWithinPartitions("leaf", "piece", "kind")
    found = met.mapInArrow(_search_pieces(dim, k), "query long, query_id long, vec_id long, uid long, score double")
    # Scores that are not numbers come last.
    number = F.when(~F.isnan("score"), F.col("score"))
    order = Window.partitionBy("query").orderBy(number.desc_nulls_last(), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
