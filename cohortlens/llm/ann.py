"""Approximate nearest neighbours by collision-counting hashing.

Largest inner product becomes smallest distance by one more component: a vector x gets sqrt(M^2 - |x|^2), M the largest
length, a query gets 0; then distance^2 = |q|^2 + M^2 - 2 q.x.

Every vector is hashed by ``PROJECTIONS`` random projections, each kept as one sorted array. A query opens a
window around its own projection in every array. Virtual rehashing widens all windows together (radius R, then R times ``GROWTH``,
...), and a vector that lies in enough windows is verified with its inner product. A vector within distance R lies in a window of radius R with a known probability, so the threshold is that
expectation less ``SLACK`` standard deviations. The query ends when its k-th best verified distance is at most R, or everything is verified.

Every row gets a number of its own, so rows of one id or of none count each. They are dealt into blocks by it, each with its own
arrays; every block meets every chunk of the stated queries. A block holds at most about ``BLOCK`` vectors, a chunk ``CHUNK`` queries, whatever repeats among them. Each
block returns k rows for a query, of which the best k are kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

PROJECTIONS = 48
#: Half a window's width per radius, first radius per largest length, and growth of the radius.
WIDTH, START, GROWTH = 1.36, 0.6, 1.15
#: Standard deviations that the collision threshold lies under the expected collisions at distance R.
SLACK = 1.5
BLOCK, CHUNK = 16384, 512
SEED = 20
#: P(|N(0, 1)| <= WIDTH): the chance of a vector at distance R to lie in a window of radius R.
_INSIDE = 0.8261


def usable(vec: Column) -> Column:
    """Neither null nor empty nor all zero, and every component is a finite number."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


class CollisionIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.rows, self.x, self.coarse, self.longest = ids, rows, vectors, vectors.astype(np.float32), longest
        axes = np.random.default_rng(SEED).standard_normal((PROJECTIONS, vectors.shape[1] + 1))
        self.axes = axes[:, :-1]
        rest = np.sqrt(np.maximum(0.0, longest**2 - np.einsum("ij,ij->i", vectors, vectors)))
        projected = axes[:, :-1] @ vectors.T + axes[:, -1:] * rest
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        # where each vector stands in each sorted array; the narrowest type that also holds a whole array's length
        self.position = np.empty(order.shape, dtype=np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.position, order, np.arange(len(ids), dtype=self.position.dtype)[None, :], axis=1)
        p = _INSIDE
        self.threshold = max(1, int(PROJECTIONS * p - SLACK * np.sqrt(PROJECTIONS * p * (1 - p))))

    def windows(self, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """First position inside and first behind every query's window in each sorted array."""
        half = WIDTH * radius
        return tuple(np.stack([np.searchsorted(s, c + sign * half, side) for s, c in zip(self.sorted, centres.T)], axis=1) for sign, side in ((-1, "left"), (1, "right")))

    def search(self, query_rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, places and inner products of the k nearest vectors found, its own row left out; ties to the smaller id, then row."""
        centres = queries @ self.axes.T
        levels: list[tuple[float, np.ndarray, np.ndarray]] = []  # all queries widen through the same radii
        for i, (query_row, q) in enumerate(zip(query_rows, queries)):
            checked = self.rows == query_row
            scores, found = np.empty(0, dtype=np.float32), np.empty(0, dtype=np.int64)
            q2 = float(q @ q)
            # single precision picks what may still be among the k best; the margin is above its error
            coarse, margin = q.astype(np.float32), (len(q) + 8) * 2.4e-7 * self.longest * np.sqrt(q2)
            for level in itertools.count():
                if level == len(levels):
                    radius = START * self.longest * GROWTH**level
                    levels.append((radius, *self.windows(centres, radius)))
                radius, low, high = levels[level]
                new = np.flatnonzero((self.collisions(low[i], high[i]) >= self.threshold) & ~checked)
                checked[new] = True
                scores, found = np.concatenate([scores, self.coarse.take(new, axis=0) @ coarse]), np.concatenate([found, new])
                if len(scores) > k:
                    near = scores >= np.partition(scores, -k)[-k] - margin
                    scores, found = scores[near], found[near]
                if checked.all() or len(scores) >= k and q2 + self.longest**2 - 2 * float(np.partition(scores, -k)[-k]) <= radius**2:
                    break
            exact = (self.x[found] * q).sum(axis=1)  # row by row in one order: equal vectors get equal products
            best = np.lexsort((self.rows[found], self.ids[found], -exact))[:k]
            yield found[best], exact[best]

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many of the windows low..high each vector lies, told by its position in each sorted array."""
        low, size = (x.astype(self.position.dtype)[:, None] for x in (low, high - low))
        return (self.position - low < size).view(np.uint8).sum(axis=0, dtype=np.uint8)  # positions before the window wrap around


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _search_block(k: int):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if vectors.num_rows and queries.num_rows:
            # a missing id sorts last; where it is the largest number as well, the row number decides
            ids = vectors["id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            index = CollisionIndex(ids, vectors["row"].to_numpy(), _matrix(vectors["vec"]), float(vectors["longest"][0].as_py()))
            rows = queries["q_row"].to_numpy()
            out = [(i, *found) for i, found in zip(rows, index.search(rows, _matrix(queries["q_vec"]), k))]
        n = [len(x[1]) for x in out]
        places = np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64)
        return pa.table({
            "query_row": pa.array(np.repeat(np.array([x[0] for x in out], dtype=np.int64), n)),
            "query_id": pa.array(np.repeat(queries["q_id"].to_numpy()[: len(out)], n), pa.int64()),
            "vec_row": vectors["row"].take(pa.array(places)).combine_chunks().cast(pa.int64()) if out else pa.array([], pa.int64()),
            "vec_id": vectors["id"].take(pa.array(places)).combine_chunks().cast(pa.int64()) if out else pa.array([], pa.int64()),
            "score": pa.array(np.concatenate([x[2] for x in out]) if out else np.empty(0), pa.float64()),
        })

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for each row that ``is_query`` (over the id) holds for.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part. Every other row is a candidate of all
    queries but its own, rows without an id (their vec_id is null) and of repeated ids too; a repeated query id gives k rows for each of
    its rows. Vectors of another length than the query's are no candidates. Fewer candidates than k give fewer rows; ties go to
    the smaller id, a missing one last.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(usable(F.col("vec")))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "vectors")
    is_query = F.coalesce(is_query, F.lit(False))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # a row per vector length in use
    stats = rows.withColumn("q", is_query).groupBy("dim").agg(F.sqrt(F.max(norm)).alias("longest"), F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.count_if("q") / chunk)).cast("int").alias("chunks"))
    sized = rows.join(F.broadcast(stats), "dim")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row"), F.col(n)).cast("int")
    left = sized.select("dim", "row", "id", "vec", "longest", mine(1, "blocks").alias("block"), every("chunks").alias("chunk"))
    right = sized.where(is_query).select(F.col("dim").alias("q_dim"), F.col("row").alias("q_row"), F.col("id").alias("q_id"), F.col("vec").alias("q_vec"), mine(2, "chunks").alias("q_chunk"), every("blocks").alias("q_block"))
    found = left.groupBy("dim", "block", "chunk").cogroup(right.groupBy("q_dim", "q_block", "q_chunk")).applyInArrow(_search_block(k), "query_row long, query_id long, vec_row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "vec_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
