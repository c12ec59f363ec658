"""Nearest vectors by inner product with randomly rotated one-bit codes.

A vector of length 1 is rotated by a random orthonormal matrix and keeps one sign bit for each dimension, packed, and one
correction: the inner product of the vector with its code. From the bits and the correction the inner product with a
query is estimated without bias, and its error is bounded with high probability by
`EPSILON * sqrt((1 - c^2) / c^2 / (d - 1))`, c the correction. Vectors whose upper bound reaches the exact score of the
k-th best estimate are computed exactly from the original vectors.

Every query meets every vector, in blocks: a block of queries and a block of vectors are one group. Blocks are dealt out
by hash, so copies of a vector spread; a block gives at most k vectors for each query.

Defined cases: vectors that are null, empty, zero, or hold a null or a component that is not finite take no part, nor do
rows without an id; vectors of different length do not meet; rows with the id of the query are its own; a repeated query
is asked once; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shipping import ship

#: Standard deviations of the estimate that the bound allows for.
EPSILON = 3.0
VECTORS_AT_ONCE = 16_384
QUERIES_AT_ONCE = 4_096
SEED = 20


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthonormal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and corrections of vectors of length 1."""
    turned = unit @ turn.T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def estimate(bits: np.ndarray, correction: np.ndarray, queries: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (query, vector) with turned queries of length 1, and the error bound of each vector."""
    d = queries.shape[1]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    products = queries.astype(np.float32) @ signs.T / math.sqrt(d)
    spread = np.sqrt(np.maximum(1 - correction**2, 0)) / correction / math.sqrt(max(d - 1, 1))
    return products / correction.astype(np.float32), epsilon * spread


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and lengths; scaled first so that squares stay finite."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / top
    length = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / length, (top * length)[:, 0]


def best_of_block(ids, vectors, query_ids, queries, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, exact score): up to k nearest vectors of the block for each query."""
    order = np.argsort(ids, kind="stable")  # so that equal scores keep the order of ids
    ids, vectors = ids[order], vectors[order]
    turn = rotation(vectors.shape[1])
    unit, length = units(vectors)
    bits, correction = encode(unit, turn)
    turned = units(queries)[0] @ turn.T
    query_length = units(queries)[1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), 256):
        some = turned[start : start + 256]
        guess, error = estimate(bits, correction, some, epsilon)
        for row in range(len(some)):
            q, own = queries[start + row], query_ids[start + row]
            value = guess[row].astype(np.float64) * length
            value[ids == own] = -np.inf
            probe = np.argpartition(-value, min(k, len(value)) - 1)[:k]
            probe = probe[ids[probe] != own]
            exact = np.sort((vectors[probe] * q).sum(axis=1))
            least = exact[0] if len(exact) == min(k, (ids != own).sum()) and len(exact) else -np.inf
            # rounding of single precision is far below 1e-5 of the lengths
            upper = value + (error + 1e-5) * length
            near = np.flatnonzero((upper * query_length[start + row] >= least) & (ids != own))
            score = (vectors[near] * q).sum(axis=1)
            take = np.argsort(-score, kind="stable")[:k]
            found.append((np.full(len(take), own), ids[near[take]], score[take]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def _block_search(k: int) -> Callable:
    def search(data: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not data.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)

        def read(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return t.column("id").to_numpy(), flat.reshape(t.num_rows, -1)

        (ids, vectors), (query_ids, queries) = read(data), read(asked)
        return pa.table([pa.array(x) for x in best_of_block(ids, vectors, query_ids, queries, k)], names)

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the k vectors with the largest inner product.

    Both frames have `id` and `vector`; the vectors with the id of a query are not among its answers.
    """
    ship(vectors.sparkSession)

    def prepared(df: DataFrame) -> DataFrame:
        v = F.col("vector").cast("array<double>")
        return df.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), v.alias("v")).where(usable(F.col("v")))

    data, asked = prepared(vectors), prepared(queries).dropDuplicates(["id"])
    n_data, n_asked = data.count(), asked.count()
    blocks, asks = max(1, math.ceil(n_data / VECTORS_AT_ONCE)), max(1, math.ceil(n_asked / QUERIES_AT_ONCE))
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    width = F.size("v").alias("d")
    left = data.select("id", "v", width, number(blocks).alias("block")).withColumn("ask", all_of(asks))
    right = asked.select("id", "v", width, number(asks).alias("ask")).withColumn("block", all_of(blocks))
    keys = ["d", "block", "ask"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_search(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
