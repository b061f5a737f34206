"""Hard negatives by best-first search in STR-packed R-trees.

Vectors are floored to integers, so scores are exact. They are dealt into blocks by hash, each with its own tree: rows are packed by
sort-tile-recursive (label first, then the coordinates of the largest variance), every node has the minimum bounding box of its rows and
the range of their labels. Against an anchor a box bounds each coordinate's product from both sides, so the sums of these
intervals bound every inner product in it. A queue takes boxes by upper bound; those outside every open score window, or whose best
score there is strictly below the k-th found, are pruned. Equal to the k-th is not pruned, as ties go to the smaller id.

Every block meets every chunk of anchors and returns at most k rows per anchor and window. A block has about ``BLOCK``
rows, a chunk ``CHUNK`` anchors, whatever repeats among them, so a label or vector with a third of the rows is spread.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
#: Components are floored after this factor.
FACTOR = 256
#: Largest floored component; sums of 10,000 of their products fit ``SCORE``.
LARGEST = 1 << 56
SCORE = "decimal(38,0)"
BLOCK, CHUNK = 8192, 2048
#: Rows of a leaf, children of a node, coordinates that tiles are sorted by.
LEAF, FANOUT, TILED = 256, 8, 3


def usable(vec: Column) -> Column:
    """Neither null nor empty, and every component is a finite number."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite, F.lit(False))


def _exact(dim: int, *parts: np.ndarray) -> type:
    """A type in which sums of ``dim`` products of components of ``parts`` are exact."""
    largest = max((max(abs(int(x.min())), abs(int(x.max()))) for x in parts if x.size), default=0)
    bound = 2 * dim * largest * largest
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


class RTree:
    """STR-packed tree of the vectors of one block; ``x`` are integers in a type that keeps their products exact."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        spread = np.argsort(-(x.astype(np.float64).var(axis=0)), kind="stable")[:TILED]
        order = self._tiles(np.lexsort((uids, labels)), [x[:, i] for i in spread])
        self.uids, self.ids, self.labels, self.x = uids[order], ids[order], labels[order], x[order]
        # levels[0] are the leaves: (first child, end of children, lowest, highest corner, lowest, highest label)
        starts = np.arange(0, len(order), LEAF)
        self.levels = [self._level(starts, len(order), self.x, self.x, self.labels, self.labels)]
        while len(self.levels[-1][0]) > 1:
            below = self.levels[-1]
            self.levels.append(self._level(np.arange(0, len(below[0]), FANOUT), len(below[0]), *below[2:]))

    @staticmethod
    def _tiles(rows: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """``rows`` sorted into tiles: cut into slabs by one coordinate, each slab by the next."""
        if not keys or len(rows) <= LEAF:
            return rows
        slabs = max(1, round((len(rows) / LEAF) ** (1 / (len(keys) + 1))))
        return np.concatenate([RTree._tiles(s[np.argsort(keys[0][s], kind="stable")], keys[1:]) for s in np.array_split(rows, slabs)])

    @staticmethod
    def _level(starts, count, lowest, highest, low_label, high_label):
        return (starts, np.append(starts[1:], count), np.minimum.reduceat(lowest, starts), np.maximum.reduceat(highest, starts),
                np.minimum.reduceat(low_label, starts), np.maximum.reduceat(high_label, starts))

    def bounds(self, level: int, nodes: slice, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the inner product with ``q`` in each of the boxes."""
        low, high = self.levels[level][2][nodes], self.levels[level][3][nodes]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return low @ up + high @ down, high @ up + low @ down

    def search(self, uid: int, q: np.ndarray, label: int, same: bool, windows: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        """For each window (lowest score, highest score, k): its best k rows as (score, id, uid), best first.

        Only rows of the anchor's label take part (``same``), or only those of others; the row ``uid`` never does.
        """
        best: list[list[tuple[int, int, int]]] = [[] for _ in windows]  # sorted by (-score, id, uid)

        def needed(low: int, high: int) -> bool:
            return any(high >= a and low <= b and (len(f) < k or min(high, b) >= -f[-1][0]) for (a, b, k), f in zip(windows, best))

        top = len(self.levels) - 1
        low, high = self.bounds(top, slice(0, 1), q)
        queue = [(-int(high[0]), top, 0, int(low[0]))]
        while queue:
            high, level, node, low = heapq.heappop(queue)
            if not needed(low, -high):
                continue
            first, end = int(self.levels[level][0][node]), int(self.levels[level][1][node])
            if level:
                lows, highs = self.bounds(level - 1, slice(first, end), q)
                low_label, high_label = self.levels[level - 1][4][first:end], self.levels[level - 1][5][first:end]
                fits = (low_label <= label) & (label <= high_label) if same else (low_label != label) | (high_label != label)
                for i in np.flatnonzero(fits):
                    if needed(int(lows[i]), int(highs[i])):
                        heapq.heappush(queue, (-int(highs[i]), level - 1, first + int(i), int(lows[i])))
                continue
            rows, scores = slice(first, end), self.x[first:end] @ q
            at = np.arange(first, end)
            if self.levels[0][4][node] != self.levels[0][5][node]:  # mixed labels; a leaf of one label is all of the kind asked for
                fits = (self.labels[rows] == label) == same
                at, scores = at[fits], scores[fits]
            if same:
                other = self.uids[at] != uid
                at, scores = at[other], scores[other]
            if not len(at):
                continue
            highest = int(scores.max())
            for w, (a, b, k) in enumerate(windows):
                least = max(a, -best[w][-1][0]) if len(best[w]) == k else a
                if highest < least:
                    continue
                inside = np.flatnonzero((scores >= least) & (scores <= b))
                if len(inside) > k:  # equal to the k-th of them stay for their ids
                    inside = inside[scores[inside] >= np.partition(scores[inside], -k)[-k]]
                if len(inside):
                    more = zip([-int(x) for x in scores[inside]], self.ids[at[inside]].tolist(), self.uids[at[inside]].tolist())
                    best[w] = sorted(best[w] + list(more))[:k]
        return [[(-s, i, u) for s, i, u in found] for found in best]


def window(positive: int) -> tuple[int, int]:
    """Lowest and highest integer score n with LOWEST * positive <= 100 * n <= HIGHEST * positive."""
    return -(-LOWEST * positive // 100), HIGHEST * positive // 100


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _scores(values: tuple[int, ...]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def _search_block(same: bool, k: int):
    """Best rows of one block for one chunk of anchors: positives, or negatives in the windows of given positive scores."""

    def search(vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        if vectors.num_rows and anchors.num_rows:
            x, q = _matrix(vectors["vec"]), _matrix(anchors["a_vec"])
            kind = _exact(x.shape[1], x, q)
            tree = RTree(vectors["uid"].to_numpy(), vectors["id"].to_numpy(), vectors["label"].to_numpy(), x.astype(kind))
            scores = anchors["scores"].to_pylist()
            for uid, label, vec, wanted in zip(anchors["a_uid"].to_pylist(), anchors["a_label"].to_pylist(), q.astype(kind), scores):
                asked = [(int(p), *window(int(p))) for p in sorted(wanted)] if not same else [(0, float("-inf"), float("inf"))]
                asked = [x for x in asked if x[1] <= x[2]]
                for (p, _, _), rows in zip(asked, tree.search(uid, vec, label, same, [(a, b, k) for _, a, b in asked])):
                    out.extend((uid, p, s, i, u) for s, i, u in rows)
        a, p, s, i, u = zip(*out) if out else ((),) * 5
        return pa.table({"a_uid": pa.array(a, pa.int64()), "p_score": _scores(p), "score": _scores(s), "id": pa.array(i, pa.int64()), "uid": pa.array(u, pa.int64())})

    return search


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label",
                   block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score for each row that ``is_anchor`` (over
    the column ``id``) holds for.

    An anchor's positives are the best ``POSITIVES`` other rows of its label; the negatives of each are the best ``NEGATIVES`` rows of
    other labels in its score window (none if the positive's score is negative). Rows with a null id or label, a null or empty
    vector or a null or non-finite component take no part; zero vectors do. Vectors of another length than the anchor's are no candidates.
    Repeated rows count each, repeated ids too; such an anchor gives the rows of each. Fewer rows than asked for give fewer. Components
    floor to ``LARGEST`` at most; scores beyond a long are compared exactly and returned as the nearest long.
    """
    named = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), named.cast("long").alias("label"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    floored = lambda x: F.floor(F.lit(float(FACTOR)) * x.cast("double")).cast("long")
    whole = F.transform("vec", lambda x: F.least(F.greatest(floored(x), F.lit(-LARGEST)), F.lit(LARGEST)))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", whole.alias("vec"), F.size("vec").alias("dim")), "vectors")
    stats = rows.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.count_if(is_anchor) / chunk)).cast("int").alias("chunks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    sized = rows.join(stats, "dim")
    left = sized.select("dim", "uid", "id", "label", "vec", mine("blocks").alias("block"), every("chunks").alias("chunk"))
    anchors = sized.where(is_anchor).select(F.col("dim").alias("a_dim"), F.col("uid").alias("a_uid"), F.col("id").alias("anchor_id"), F.col("label").alias("a_label"),
                                            F.col("vec").alias("a_vec"), mine("chunks").alias("a_chunk"), "blocks")
    schema = f"a_uid long, p_score {SCORE}, score {SCORE}, id long, uid long"

    def searched(asking: DataFrame, same: bool, k: int) -> DataFrame:
        """The best k of all blocks for each anchor and positive score."""
        right = asking.withColumn("a_block", every("blocks")).select("a_dim", "a_block", "a_chunk", "a_uid", "a_label", "a_vec", "scores")
        found = left.groupBy("dim", "block", "chunk").cogroup(right.groupBy("a_dim", "a_block", "a_chunk")).applyInArrow(_search_block(same, k), schema)
        order = Window.partitionBy("a_uid", "p_score").orderBy(F.desc("score"), "id", "uid")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    positives = searched(anchors.withColumn("scores", F.array().cast(f"array<{SCORE}>")), True, POSITIVES)
    positives = stored(positives.select("a_uid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("uid").alias("p_uid")), "positives")
    asked = positives.groupBy("a_uid").agg(F.collect_set("positive_score").alias("scores"))  # POSITIVES numbers at most
    negatives = searched(anchors.join(asked, "a_uid"), False, NEGATIVES)
    negatives = negatives.select("a_uid", F.col("p_score").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select("a_uid", "anchor_id")
    nearest_long = lambda c: F.least(F.greatest(F.col(c), F.lit(-(1 << 63))), F.lit((1 << 63) - 1)).cast("long").alias(c)
    joined = positives.join(negatives, ["a_uid", "positive_score"]).join(ids, "a_uid")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", nearest_long("positive_score"), nearest_long("negative_score"))
