"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir

#: Vectors of a block of lists, and queries of a query block.
VECTOR_BLOCK, QUERY_BLOCK = 8_192, 512
#: Depth of the lists at the first stop test; it grows by half from test to test.
FIRST_DEPTH = 4


def quantized(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, x): floor(scale * component); vectors that are null or hold null or non-finite components are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & finite & F.col("vec_id").isNotNull())
    x = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def pack(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks (block, n, dims, ids, x) of vectors of one length, at most block_rows of them, as binary matrices. A
    block's name is its task's partition and a counter, so that equal blocks are blocks of their own."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        part, made = TaskContext.get().partitionId(), 0

        def out(dims: int, some: list) -> pd.DataFrame:
            nonlocal made
            ids = np.array([i for i, _ in some], np.int64)
            x = np.stack([v for _, v in some]).astype(np.int64)
            small = not x.size or np.abs(x).max() < 2**31
            x = x.astype(np.int32 if small else np.int64)
            made += 1
            return pd.DataFrame({"block": [f"{part}-{made}"], "n": [len(ids)], "dims": [dims], "ids": [ids.tobytes()], "x": [x.tobytes()]})

        for batch in batches:
            for vec_id, x in zip(batch["vec_id"], batch["x"], strict=True):
                some = held.setdefault(len(x), [])
                some.append((vec_id, np.asarray(x)))
                if len(some) == block_rows:
                    yield out(len(x), held.pop(len(x)))
        for dims, some in held.items():
            yield out(dims, some)

    return rows.mapInPandas(blocks, "block string, n long, dims int, ids binary, x binary")


def unpack(n: int, dims: int, ids: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int32 if len(x) == 4 * n * dims else np.int64
    return np.frombuffer(ids, np.int64), np.frombuffer(x, kind).reshape(n, dims)


class SortedLists:
    """A block's vectors with a list of rows for each dimension, by falling component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.order = np.argsort(-x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        biggest = int(np.abs(x).max(initial=0))
        self.bound = biggest * max(1, x.shape[1])
        self.fast = x.astype(np.float64)

    def top(self, query_id: int, q: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best, ties to the smaller id, without the query's own row, and the rows scored.

        Lists are read from the end that gives the larger products. After each depth the sum of the products met
        last bounds every row not yet seen; it stops when that bound is below the kth score, or below least, which k
        rows of other blocks reach. Only rows that a list has shown are scored.
        """
        n = len(self.ids)
        exact = self.bound * int(np.abs(q).max(initial=0)) < 2**53
        x, w = (self.fast, q.astype(np.float64)) if exact else (self.x.astype(np.int64), q.astype(np.int64))
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        found, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, depth = 0, min(FIRST_DEPTH, n)
        while True:
            shown = np.zeros(n, bool)
            shown[self.order[start:depth, up]] = True
            shown[self.order[n - depth : n - start, down]] = True
            if depth == n:
                shown[:] = True
            new = np.flatnonzero(shown & ~seen)
            seen[new] = True
            own = new[self.ids[new] != query_id]
            found, score = np.concatenate([found, own]), np.concatenate([score, (x[own] @ w).astype(np.int64)])
            if len(found) > k:
                kth = np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[score >= kth], score[score >= kth]
            kth = score.min() if len(found) >= k else -np.inf
            limit = self.sorted[depth - 1, up] @ q[up] + self.sorted[n - depth, down] @ q[down]
            if depth == n or limit < max(kth, least):
                best = np.lexsort((self.ids[found], -score))[:k]
                return self.ids[found[best]], score[best], int(seen.sum())
            start, depth = depth, min(depth + max(FIRST_DEPTH, depth // 2), n)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best inner products of each query row with all other rows: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x). Rows whose vector is null or holds null or non-finite components take no
    part; vectors are compared with those of their own length; ties go to the smaller vec_id. With fewer than k
    other vectors all are returned. An empty table gives none; further columns are ignored.
    Repeated rows are rows of their own; query rows of one vec_id give the k best of all their scores together.
    The stated query set goes in blocks against blocks of all rows. A task's blocks are searched one after another
    for one block of queries, and each query's kth score so far is the bound to beat in the next block; a block's
    lists are sorted once in a task for all its queries.
    """
    folder = shared_dir(vectors.sparkSession)
    rows = quantized(vectors, scale)
    blocks = materialize(pack(rows, vector_block), folder, "vectors")
    asked = rows.filter(is_query).repartition(8, F.col("vec_id"))
    asked = materialize(pack(asked, query_block), folder, "queries")
    asked = asked.select("dims", F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    # Names of blocks only; their contents follow by two equal joins.
    met = blocks.select("block", "dims").join(asked.select("q_block", "dims"), "dims")
    met = met.join(blocks.drop("dims"), "block").join(asked.drop("dims"), "q_block")
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = met.repartition(parts, "block", "q_block").sortWithinPartitions("block", "q_block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, lists = None, None
        reached: dict[int, np.ndarray] = {}  # each query's best scores in this task's blocks so far, k at most
        for batch in batches:
            for r in batch.itertuples():
                if r.block != name:
                    name, lists = r.block, SortedLists(*unpack(r.n, r.dims, r.ids, r.x))
                q_ids, q = unpack(r.q_n, r.dims, r.q_ids, r.q_x)
                out: list[tuple[np.ndarray, ...]] = []
                for query_id, w in zip(q_ids.tolist(), q, strict=True):
                    before = reached.get(query_id, np.zeros(0, np.int64))
                    ids, score, scored = lists.top(query_id, w.astype(np.int64), k, before.min() if len(before) == k else -np.inf)
                    reached[query_id] = np.sort(np.concatenate([before, score]))[::-1][:k]
                    out.append((np.full(len(ids), query_id), ids, score, np.full(len(ids), scored)))
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "scored"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = met.mapInPandas(search, "query_id long, vec_id long, score long, scored long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
