"""N-gram Jaccard join by a prefix tree.

A document is the set of its distinct shingles as 64-bit hashes (two of 10^9 shingles share one with a chance of 3 %; equal
sets are told by a 64-bit digest). The sets of a group are put into one global order, most frequent shingle of the group first, and stored
in a trie whose unary paths are single edges. A set walks the trie once: the overlap with a path is counted once for all sets
that share the path, and a subtree is left where even if all remaining shingles matched no set in it could reach the similarity,
given how many remain on the path and in the walking set. Links are found breadth first and linked sets leave the trie, so a
dense group costs and returns about as many links as it has members, never all pairs.

Groups: sets of similar size whose hashes differ in at most d places agree in at least ``m - d`` of any m ranges of
hashes. Each set sends a signature per range (its size level and the next larger one are enough); ranges with few
shingles are left out where enough others remain to be sure (``signatures``). The smallest set under a signature is its centre, and all sets
under signatures of one centre form a group: every link has both its sets in a group, and a set is in one group per
distinct centre, mostly one. Large groups are dealt out in pairs of blocks of about ``BLOCK_GRAMS`` shingles.

Signatures are 16-byte rows sorted by Spark, and copies of a set send theirs once per task. Only sets that share a signature with another
set are ever shuffled whole.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import components, fresh, stored
from cohortlens.llm.simhash import _LOWER, _word_runs

#: Words in a shingle and the least Jaccard similarity in hundredths.
SHINGLE, PERCENT = 4, 85
#: Shingles of one block of a group.
BLOCK_GRAMS = 1 << 20
SEED = 11
#: Word hashes and digests a task remembers.
REMEMBERED = 1 << 20
#: From this many allowed differences on, a range needs two shingles to be sent.
SPARSE = 40

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shifts and odd factors)."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, SEED)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _WordHashes()


def gram_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a whole text, ascending; fewer words than a shingle are one, no words none."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    parts, rest = [], np.empty(0, dtype=np.uint64)
    for words in _word_runs(data):
        h = np.concatenate([rest, np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))])
        rest = h[max(0, len(h) - shingle + 1) :] if shingle > 1 else h[:0]
        if len(h) >= shingle:
            n = len(h) - shingle + 1
            parts.append(_mix(functools.reduce(np.add, [h[i : i + n] * _ODD[2 + i % 200] for i in range(shingle)])))
    if not parts:
        few = rest if shingle > 1 else rest[:0]
        spread = [few[i : i + 1] * _ODD[2 + i % 200] + np.uint64(len(few)) for i in range(len(few))]
        return _mix(functools.reduce(np.add, spread)) if spread else np.empty(0, dtype=np.uint64)
    return np.unique(np.concatenate(parts))


def set_digest(grams: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), SEED)).view(np.int64))


# Groups ----------------------------------------------------------------------------------------


@functools.cache
def level_sizes(percent: int) -> list[int]:
    """Largest set size of each level; linked sets are of one level or of neighbouring ones."""
    sizes = [1]
    while sizes[-1] < 1 << 40:
        sizes.append(max(sizes[-1] + 1, sizes[-1] * 100 // percent))
    return sizes


@functools.cache
def ranges(level: int, percent: int) -> tuple[np.ndarray, int, int]:
    """First hash of each of a level's ranges, how many of them may be left out, and the shingles a range needs not to be left out.

    Linked sets of at most r shingles differ in d = 2 r (100 - percent) / (100 + percent) at most. With m = d + 1 + spare ranges they
    agree in spare + 1 at least; a set that leaves out at most ``spare`` of them sends one of those that agree.
    """
    r = level_sizes(percent)[level]
    d = 2 * r * (100 - percent) // (100 + percent)
    spare = math.ceil((d + 1) / 4) if d else 0
    m = d + 1 + spare
    return np.array([-(-(i << 64) // m) for i in range(m)], dtype=np.uint64), spare, 2 if d >= SPARSE else 1


def signatures(grams: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures such that any two sets of the least similarity share one.

    At its own level, and at the next if a larger partner may be there, a set sends a hash of its shingles in each range. Ranges with
    too few shingles are left out if they are at most ``spare``; otherwise the set sends all its ranges, empty ones too. Of
    two linked sets with ``spare + 1`` equal ranges, either both send all, or one has an equal range that is not too
    small, and then it is not too small in the other.
    """
    n = len(grams)
    if not n:
        return grams
    sizes = level_sizes(percent)
    own = bisect.bisect_left(sizes, n)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mix(grams ^ _ODD[250]), dtype=np.uint64)))
    out = []
    for level in (own, own + 1) if 100 * n >= percent * (sizes[own] + 1) else (own,):
        first, spare, least = ranges(level, percent)
        at = np.append(np.searchsorted(grams, first), n)
        sig = _mix(sums[at[1:]] - sums[at[:-1]] + _ODD[251] * (np.uint64(level << 40) + np.arange(len(first), dtype=np.uint64)))
        few = np.diff(at) < least
        out.append(sig if few.sum() > spare else sig[~few])
    return np.concatenate(out)


# The trie --------------------------------------------------------------------------------------


class Trie:
    """A trie of sets in one global order, unary paths joined into edges.

    Node i is entered by the shingles start[i]..end[i] of the path of set first[i]; its sets are first[i]..last[i] in the
    order of the trie, of low[i] to high[i] shingles, alive[i] of which have not left yet.
    """

    def __init__(self, sets: list[np.ndarray]):
        distinct, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.empty(len(distinct), dtype=np.int64)
        place[np.argsort(-count, kind="stable")] = np.arange(len(distinct))
        paths = [np.sort(x) for x in np.split(place[code], np.cumsum([len(s) for s in sets])[:-1])]
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.order, self.paths = order, [paths[i] for i in order]
        self.grams = len(distinct)
        sizes = [len(p) for p in self.paths]
        shared = [0]
        for a, b in zip(self.paths, self.paths[1:]):
            k = min(len(a), len(b))
            differ = a[:k] != b[:k]
            shared.append(int(differ.argmax()) if differ.any() else k)
        self.start, self.end, self.first, self.low, self.high, self.alive, self.parent, self.children, self.is_set = [], [], [], [], [], [], [], [], []
        self.leaf = []
        self._node(0, 0, 0, -1)
        stack = [0]
        for i, (size, k) in enumerate(zip(sizes, shared)):
            while self.end[stack[-1]] > k:  # leave deeper nodes, splitting the edge that the two paths share in part
                node = stack.pop()
                if self.start[node] < k:
                    above = self._node(self.start[node], k, self.first[node], stack[-1])
                    self.children[stack[-1]].remove(node)
                    self.children[above].append(node)
                    self.parent[node], self.start[node] = above, k
                    stack.append(above)
            if size > self.end[stack[-1]]:
                stack.append(self._node(self.end[stack[-1]], size, i, stack[-1]))
            self.leaf.append(stack[-1])
            self.is_set[stack[-1]].append(i)
        for i, node in enumerate(self.leaf):
            while node >= 0:
                self.low[node], self.high[node] = min(self.low[node], sizes[i]), max(self.high[node], sizes[i])
                self.alive[node] += 1
                node = self.parent[node]

    def _node(self, start: int, end: int, first: int, parent: int) -> int:
        node = len(self.start)
        for column, value in ((self.start, start), (self.end, end), (self.first, first), (self.low, 1 << 62), (self.high, 0), (self.alive, 0), (self.parent, parent), (self.children, []), (self.is_set, [])):
            column.append(value)
        if parent >= 0:
            self.children[parent].append(node)
        return node

    def leave(self, i: int) -> None:
        """Set ``i`` is not found any more."""
        node = self.leaf[i]
        self.is_set[node].remove(i)
        while node >= 0:
            self.alive[node] -= 1
            node = self.parent[node]

    def linked(self, i: int, percent: int, held: np.ndarray) -> list[int]:
        """The sets still in the trie that are similar enough to set ``i``; ``held`` is an all-false array over the shingles."""
        walker = self.paths[i]
        n = len(walker)
        held[walker] = True
        found, todo = [], [(0, 0)]
        while todo:
            node, overlap = todo.pop()
            edge = self.paths[self.first[node]][self.start[node] : self.end[node]]
            depth = self.end[node]
            left = n
            if len(edge):
                overlap += int(np.count_nonzero(held[edge]))
                left = n - int(np.searchsorted(walker, edge[-1], side="right"))
            # the most promising size in the subtree: every further shingle adds one to the overlap until none is left in the walker
            best = min(max(depth + left, self.low[node]), self.high[node])
            if (100 + percent) * (overlap + min(best - depth, left)) < percent * (n + best):
                continue
            found += [j for j in self.is_set[node] if (100 + percent) * overlap >= percent * (n + len(self.paths[j]))]
            todo += [(c, overlap) for c in self.children[node] if self.alive[c]]
        held[walker] = False
        return found


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of positions in ``sets`` that form a spanning forest of all links among them."""
    if len(sets) < 2:
        return []
    trie, edges = Trie(sets), []
    held = np.zeros(trie.grams, dtype=bool)
    gone = [False] * len(sets)
    for i in range(len(sets)):
        if gone[i]:
            continue
        gone[i], todo = True, [i]
        trie.leave(i)
        while todo:
            x = todo.pop()
            for j in trie.linked(x, percent, held):
                gone[j] = True
                trie.leave(j)
                edges.append((trie.order[x], trie.order[j]))
                todo.append(j)
    return edges


# On Spark --------------------------------------------------------------------------------------


def _described(shingle: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram_set(x.as_py(), shingle) for x in batch.column(batch.num_columns - 1)]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "n", "set"])

    return describe


def _signed(shingle: int, percent: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sigs, sets = [], []
            for text in batch.column(0):
                grams = gram_set(text.as_py(), shingle)
                key = set_digest(grams)
                if len(grams) and key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    sigs.append(signatures(grams, percent))
                    sets.append(key)
            if sigs:
                n = [len(s) for s in sigs]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(sets, dtype=np.int64), n))], ["sig", "set"])

    return sign


def _loaded(shingle: int):
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wanted, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = gram_set(text.as_py(), shingle)
                if set_digest(grams) == wanted:
                    yield pa.RecordBatch.from_arrays([pa.array([wanted], pa.int64()), pa.array([grams.astype("<u8").tobytes()], pa.binary())], ["set", "grams"])

    return load


def _linked_runs(percent: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by group and pair of blocks; a run ends where the next begins."""
        run, names, sets = None, [], []

        def edges() -> Iterator[pa.RecordBatch]:
            found = forest(sets, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([names[a] for a, _ in found], pa.int64()), pa.array([names[b] for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for key, name, grams in zip(keys, batch.column(3).to_pylist(), batch.column(4)):
                if key != run:
                    yield from edges()
                    run, names, sets = key, [], []
                names.append(name)
                sets.append(np.frombuffer(grams.as_py(), dtype="<u8"))
        yield from edges()

    return link


def grouped(docs: DataFrame, text: str, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(centre, set) of the sets that share a signature with another set, once per distinct centre."""
    sent = docs.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(_signed(shingle, percent), "sig long, set long")
    under = Window.partitionBy("sig")
    shared = sent.withColumn("centre", F.min("set").over(under)).withColumn("other", F.max("set").over(under)).where("centre <> other")
    return shared.select("centre", "set").distinct()


def links(members: DataFrame, sets: DataFrame, percent: int = PERCENT, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Edges (a, b) whose components are those of all links; ``members`` has (centre, set), ``sets`` has (set, n, grams)."""
    sized = members.join(sets.select("set", "n"), "set")
    blocks = sized.groupBy("centre").agg(F.ceil(F.sum("n") / block_grams).cast("int").alias("blocks"))
    dealt = (
        sized.join(blocks, "centre")
        .withColumn("mine", F.pmod(F.xxhash64("set"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("centre", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "set")
    )
    runs = dealt.join(sets.select("set", "grams"), "set").select("centre", "lo", "hi", "set", "grams")
    return runs.repartition("centre", "lo", "hi").sortWithinPartitions("centre", "lo", "hi").mapInArrow(_linked_runs(percent), "a long, b long")


def jaccard_components(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                       block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """The columns ``keep`` of each row with n_shingles and component_id, the smallest id that links reach, its own included.

    Rows of equal sets are linked. A null text, an empty one and one without words has no shingle and is linked with nothing, so
    its component is its own id. Rows without an id are linked too but never name a component (null if no row of it has an id).
    Repeated rows each give a row. Names of ``keep`` that clash with the new columns get the new ones underscores.
    """
    n_name, component_name = fresh(docs.select(*[f"`{c}`" for c in keep]), "n_shingles"), fresh(docs.select(*[f"`{c}`" for c in keep]), "component_id")
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    key = F.xxhash64(F.col(f"`{text}`"))
    plain = docs.select(*kept, F.col(f"`{id_col}`").alias("id"), key.alias("key"), F.col(f"`{text}`").alias("text"))
    schema = ", ".join(f"{c} {t}" for c, t in plain.drop("text").dtypes) + ", n long, set long"
    rows = stored(plain.mapInArrow(_described(shingle), schema), "sets")
    classes = stored(rows.where("n > 0").groupBy("set").agg(F.min("id").alias("first"), F.min("key").alias("key"), F.max("n").alias("n")), "classes")
    members = stored(grouped(docs, text, shingle, percent), "groups")
    wanted = classes.join(members.select("set").distinct(), "set").select("set", "key", "n")
    texts = plain.select(F.col("key").alias("text_key"), "text")
    found = wanted.join(texts, F.col("key") == F.col("text_key")).select("set", "text").mapInArrow(_loaded(shingle), "set long, grams binary")
    sets = stored(found.dropDuplicates(["set"]).withColumn("n", (F.length("grams") / 8).cast("long")), "grams")
    linked = components(links(members, sets, percent, block_grams), "jaccard").withColumnRenamed("node", "set")
    named = classes.select("set", "first").join(linked, "set", "left").select("set", "first", F.coalesce("component", "set").alias("component"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(names, "component").select("set", "component_id")
    alone = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return rows.join(named, "set", "left").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("n").alias(n_name), alone.alias(component_name))
