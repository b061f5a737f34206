"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits differ in at most that many of their 8 bytes, so
they share at least ``8 - max_bits`` bytes at their positions. The inverted index therefore has as terms three bytes with their
positions; the triples are chosen so that any four positions hold at least one of them. Two fingerprints under one
term are a candidate pair: their shared positional bytes are tallied, pairs that reach the guaranteed minimum are
verified by their differing bits.

Equal fingerprints are one node. Under one term only a spanning forest of the links found there leaves the task, so a dense
group sends as many edges as it has members, never all its pairs; the components are the same. A term of more than
``BLOCK`` fingerprints is dealt out in pairs of blocks, so no task holds more than two blocks of a term.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import clear_of, components, quoted, stored

#: Words in a shingle and the largest linking distance in bits.
SHINGLE, MAX_BITS = 4, 4
SEED = 42
#: Fingerprints of one term that are compared in one piece.
BLOCK = 2048
#: Bytes of a text split into words at once.
PIECE = 1 << 22

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WHITE = re.compile(rb"[\x20\x09-\x0d]")


def _word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of ``data`` in pieces of about PIECE bytes."""
    start = 0
    while start < len(data):
        cut = _WHITE.search(data, start + PIECE)
        end = cut.start() if cut else len(data)
        yield data[start:end].split()
        start = end


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a whole text: bit i is set if it is set in over half the shingles' hashes; no word: 0."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    ones, total, rest = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for run in _word_runs(data):
        words = rest + run
        rest = words[-(shingle - 1) :] if shingle > 1 else []
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], dtype="<u8")
        for part in np.array_split(hashes, len(hashes) // 65536 + 1):
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return digest(b" ".join(rest), SEED) if rest else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of ``docs`` with fp, the fingerprint as a signed long."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes) + ", fp long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(batch.num_columns - 1)], dtype=np.uint64)
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(add, schema)


def term_positions(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any ``8 - max_bits`` equal positions include one of the sets.

    With four or more guaranteed positions these are triples by Turan's construction (positions in three groups; triples inside one
    group, or with two in a group and one in the next); with fewer, all sets of that size.
    """
    sure = 8 - max_bits
    if not 1 <= sure <= 8:
        raise ValueError("max_bits must be from 0 to 7")
    if sure < 4:
        return list(itertools.combinations(range(8), sure))
    group = lambda p: p % 3

    def chosen(triple: tuple[int, ...]) -> bool:
        g = sorted(map(group, triple))
        return g in ([0, 0, 0], [1, 1, 1], [2, 2, 2], [0, 0, 1], [1, 1, 2], [0, 2, 2])

    return [t for t in itertools.combinations(range(8), 3) if chosen(t)]


def _terms(fp: Column, max_bits: int) -> Column:
    byte = [F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long")) for p in range(8)]
    keys = []
    for i, positions in enumerate(term_positions(max_bits)):
        key = F.lit(i).cast("long")
        for p in positions:
            key = key * 256 + byte[p]
        keys.append(key)
    return F.array(*keys)


def forest(fps: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints, by breadth-first search."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        found, rest = [rest[0]], rest[1:]
        while found and len(rest):
            x = found.pop()
            differing = rest ^ x
            near = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - max_bits  # the tally
            near[near] = np.bitwise_count(differing[near]) <= max_bits
            if near.any():
                linked = rest[near]
                left.append(np.full(len(linked), x, dtype=np.uint64))
                right.append(linked)
                found.extend(linked)
                rest = rest[~near]
    return left, right


def _link_runs(max_bits: int):
    def edges(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fps):
            return
        starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(fps)]))
        left, right = [], []
        for r in np.flatnonzero(np.diff(starts) > 1):
            for into, more in zip((left, right), forest(fps[starts[r] : starts[r + 1]], max_bits)):
                into.extend(more)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by term and block pair; the last run of a batch may go on in the next."""
        keys, fps = np.empty((0, 3), dtype=np.int64), np.empty(0, dtype=np.uint64)
        for batch in batches:
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            keys, fps = np.concatenate([keys, new]), np.concatenate([fps, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(fps):
                last = len(fps) - 1 - int(np.argmin((keys[::-1] == keys[-1]).all(axis=1))) if (keys != keys[-1]).any() else -1
                yield from edges(keys[: last + 1], fps[: last + 1])
                keys, fps = keys[last + 1 :], fps[last + 1 :]
        yield from edges(keys, fps)

    return link


def links(classes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct fingerprints ``classes.fp``."""
    keyed = classes.select(F.explode(_terms(F.col("fp"), max_bits)).alias("term"), "fp")
    hot = keyed.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > block).select("term", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = (
        keyed.join(hot, "term", "left")
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .select("term", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    )
    runs = dealt.repartition("term", "lo", "hi").sortWithinPartitions("term", "lo", "hi")
    return runs.mapInArrow(_link_runs(max_bits), "a long, b long")


def _grouped(docs: DataFrame, keep: list[str], id_col: str, text: str, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The columns ``keep`` of each row with fp, __component (its smallest fingerprint) and component_id (its smallest id)."""
    rows = stored(fingerprints(docs, keep, text, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    linked = components(links(classes, max_bits), "simhash").withColumnRenamed("node", "fp")
    members = classes.join(linked, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = members.join(members.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("fp", F.col("component").alias("__component"), "component_id")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The columns ``keep`` (the id among them) of each row with fingerprint (16 hex digits) and component_id.

    component_id is the smallest id that links reach from the row's fingerprint, its own included. A null text counts as
    empty; texts without words have fingerprint 0 and are linked like any other. Rows without an id are linked too but
    never name a component; it is null if no row of it has an id. Repeated rows each give a row.
    Names of ``keep`` that clash with the new columns get the new ones underscores.
    """
    own = [f"__k{i}" for i in range(len(keep))]
    plain = docs.select(*[c.alias(k) for c, k in zip(quoted(keep), own)], F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").alias("__text_in"))
    found = _grouped(plain, [*own, "__id"], "__id", "__text_in", shingle, max_bits)
    fingerprint_name, component_name = clear_of(keep, "fingerprint", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(*[F.col(k).alias(c) for c, k in zip(keep, own)], hexed.alias(fingerprint_name), F.col("component_id").alias(component_name))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, every column as it was: of each component the document with the smallest doc_id.

    Of several texts under that id, or of a component without any, the one with the smallest digest stays. Rows repeated under one
    doc_id and text are one document and stay or go together; of rows without an id one stays, the smallest by its columns as JSON (columns may be maps).
    """
    from cohortlens.llm.common import fresh

    key = fresh(docs, "__text_key")
    digest = F.md5(F.coalesce("text", F.lit("")))
    found = _grouped(docs.select("doc_id", "text", digest.alias("key")), ["doc_id", "key"], "doc_id", "text")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("stay_id"), F.col("key").alias("stay_key"))
    stay = stored(found.groupBy("__component").agg(F.min(order).alias("stay")).select("stay.*"), "stay")
    keyed = docs.withColumn(key, digest)
    told, untold = (stay.where(~F.col("none")), stay.where("none"))
    named = keyed.where("doc_id is not null").join(told, (keyed["doc_id"] == told["stay_id"]) & (keyed[key] == told["stay_key"]), "left_semi").drop(key)
    nameless = keyed.where("doc_id is null").join(untold, keyed[key] == untold["stay_key"], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = nameless.groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return named.unionByName(one)
