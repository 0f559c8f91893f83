"""Exact top-k search by term-at-a-time accumulation (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import materialise

TOP = 20
#: Rows of a block of candidates and of a block of queries: the dense score array of a step.
CANDIDATE_ROWS, QUERY_ROWS = 2048, 256
#: A posting list with over 1/DENSE of a block's candidates is a whole column.
DENSE = 4


def integer_vector(vector: Column, scale: float = 64.0) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def is_finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components; an empty one is finite."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """A row per block: its ids in ascending order and their vectors, zero-padded to one width."""
    def pack(group: pa.Table) -> pa.Table:
        ids = group.column("id").combine_chunks().to_numpy()
        order = np.argsort(ids, kind="stable")
        column = group.column("v").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        width = int(sizes.max(initial=0))
        body = np.zeros((len(ids), width), np.int64)
        body[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
        return pa.table({"block": group.column(block)[:1], "ids": [ids[order].tobytes()],
                         "width": pa.array([width], pa.int32()), "body": [body[order].tobytes()]})

    return rows.groupBy(block).applyInArrow(pack, "block int, ids binary, width int, body binary")


def _unpack(ids: bytes, width: int, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids_ = np.frombuffer(ids, np.int64)
    return ids_, np.frombuffer(body, np.int64).reshape(len(ids_), width)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products (queries x candidates), term by term.

    A term's posting list holds the candidates that have it, with their weights; each query row that has
    the term scatters its weight times the list into its row of the dense score array. A list that most
    candidates are on is kept as a whole column.
    """
    width = min(queries.shape[1], candidates.shape[1])
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(width, 1)
    kind = np.int32 if most < 1 << 31 else np.int64
    postings = np.ascontiguousarray(candidates[:, :width].T.astype(kind))
    weights = queries[:, :width].astype(kind)
    scores = np.zeros((len(queries), len(candidates)), kind)
    term = np.empty_like(scores)
    for t in range(width):
        rows, on = np.flatnonzero(weights[:, t]), np.flatnonzero(postings[t])
        if DENSE * len(on) < len(candidates):
            scores[np.ix_(rows, on)] += weights[rows, t, None] * postings[t, on]
        elif len(rows) == len(queries):
            np.multiply(weights[:, t, None], postings[t], out=term)
            scores += term
        elif len(rows):
            scores[rows] += weights[rows, t, None] * postings[t]
    return scores


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple:
    """The k best candidates of each query, without those of its own id; ids ascend, so places break ties."""
    n = len(ids)
    own = ids[None, :] == query_ids[:, None]
    wide = scores.astype(np.int64)
    if n and np.abs(wide).max(initial=0) < (1 << 62) // n:
        order = wide * n + (n - 1 - np.arange(n))
    else:
        order = np.empty_like(wide)
        for r in range(len(query_ids)):
            order[r, np.lexsort((-np.arange(n), wide[r]))] = np.arange(n)
    order[own] = np.iinfo(np.int64).min
    take = min(k, n)
    best = np.argpartition(order, n - take, axis=1)[:, n - take:]
    rows = np.broadcast_to(np.arange(len(query_ids))[:, None], best.shape)
    real = ~own[rows, best]
    row = rows[real]
    return query_ids[row], ids[best[real]], wide[row, best[real]]


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Candidates are all rows but the query's own. Vectors that are null or hold
    null or non-finite components, and null ids, take no part. Rows of one id are not
    candidates for each other; for others each of them is one, and what several
    queries of one id find is ranked together. A shorter vector counts as padded with zeros. Ties go to
    the smaller id. Every query meets every candidate, in blocks: the rows that
    are moved are blocks, and each pair of blocks sends on k rows a query.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("e"))
    rows = rows.where(F.col("id").isNotNull() & is_finite(F.col("e"))).select(
        "id", integer_vector(F.col("e")).alias("v"))
    # the deal is written down, so that a task run again deals alike; repeated ids spread over all blocks
    rows = materialise(rows.withColumn("deal", F.xxhash64("id", F.monotonically_increasing_id())), "vectors")
    asks = rows.withColumnRenamed("id", vec_id).where(is_query).withColumnRenamed(vec_id, "id")
    blocks = -(-rows.count() // CANDIDATE_ROWS) or 1
    ask_blocks = -(-asks.count() // QUERY_ROWS) or 1

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return _packed(df.withColumn("b", F.pmod("deal", F.lit(n)).cast("int")).drop("deal"), "b")

    index = dealt(rows, blocks)
    ask = dealt(asks, ask_blocks).select(
        F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("body").alias("q_body"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    both = ask.join(index, "block").select("q_ids", "q_width", "q_body", "ids", "width", "body")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                values = [c[r].as_py() for c in batch.columns]
                q_ids, q = _unpack(*values[:3])
                ids, c = _unpack(*values[3:])
                found = _best(q_ids, ids, accumulate(q, c), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found],
                                                 names=["query_id", vec_id, "score"])

    found = both.mapInArrow(score, f"query_id bigint, {vec_id} bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), vec_id)
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", vec_id, "score"))


TOP_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
