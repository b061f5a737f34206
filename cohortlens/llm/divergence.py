"""Divergence between the sources of a language, over run-length columns.

The vocabulary of a language is dealt into blocks. In a block its terms are reordered so that equal counts stand together
(by the counts of the largest sources, one after the other), and the counts of every source become a column of runs
(first position, count). For two sources the run boundaries are intersected: within a piece both smoothed frequencies p and q are
constant, so f(p, q) = floor((p - q)^2 / (p + q)) is worked out once and multiplied by the length of the piece. Terms
that a source lacks are runs of zeros, never rows.

Term counts are added up per task before they are shuffled. A block holds about ``BLOCK_ENTRIES`` counts. A language with
many sources is dealt out in pairs of chunks of sources, so that no task holds more than two chunks of a block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

#: Documents of a language that must hold a term.
MIN_DOCS = 10
#: Terms reported for each source.
TOP = 10
#: Scale of the smoothed frequencies and the count added to every term.
SCALE, ADDED = 1_000_000_000, 2
BLOCK_ENTRIES = 1 << 18
CHUNK_SOURCES = 256
#: Sources whose counts order the vocabulary of a block.
ORDER_BY = 8
#: Bytes of a text taken apart at once, and counts that a task holds before it passes them on.
PIECE, HELD = 1 << 22, 1 << 19

#: Letters and bytes of non-ASCII characters are parts of terms (A-Z lower-cased), all else separates them.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _term_runs(data: bytes) -> Iterator[list[bytes]]:
    """The terms of ``data`` in pieces of about PIECE bytes."""
    start = 0
    data = data.translate(_TERM_BYTES)
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs) of a task's documents; the term '' stands for a source's presence."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            held = docs[lang, source]
            names = list(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
                 pa.array(list(terms.values()), pa.int64()), pa.array([held[x] for x in names], pa.int64())],
                ["lang", "source", "term", "count", "docs"])
        counts.clear()
        docs.clear()

    for batch in batches:
        groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for group, text in zip(groups, batch.column(2)):
            tally, seen = counts[group], set()
            tally.setdefault(b"", 0)
            for terms in _term_runs(text.cast(pa.binary()).as_py()):
                tally.update(terms)
                seen.update(terms)
            docs[group].update(seen)
        if sum(map(len, counts.values())) > HELD:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, count, docs) of all documents, with a row of term '' and count 0 for every occurring source."""
    named = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = named.mapInArrow(_count_batches, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def smoothed(count: int, n: int, v: int) -> int:
    """The scaled frequency of a term that a source of ``n`` kept occurrences has ``count`` times; ``v`` terms are kept."""
    return 1 + SCALE * (count + ADDED) // (n + ADDED * v)


def _smoothed(count: str, n: str) -> str:
    return f"1 + ({SCALE} * cast({count} + {ADDED} as decimal(28,0))) div ({n} + {ADDED} * v)"


def runs(positions: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions and counts of the runs of a column over 0..length; ``positions`` ascend, all others have count 0."""
    column_starts = np.concatenate((positions, positions + 1))  # each entry begins; the position behind it begins a zero unless it is an entry
    values = np.concatenate((counts, np.zeros(len(counts), dtype=np.int64)))
    order = np.lexsort((values == 0, column_starts))
    starts, values = column_starts[order], values[order]
    first = np.concatenate(([True], starts[1:] != starts[:-1])) if len(starts) else np.empty(0, bool)
    starts, values = starts[first], values[first]
    if not len(starts) or starts[0] > 0:
        starts, values = np.concatenate(([0], starts)), np.concatenate(([0], values))
    inside = starts < length
    starts, values = starts[inside], values[inside]
    changes = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.empty(0, bool)
    return starts[changes], values[changes]


def reorder(term: np.ndarray, source: np.ndarray, count: np.ndarray, n_terms: int) -> np.ndarray:
    """A position for each term, equal counts together: sorted by the counts of the largest sources, highest first."""
    weight = np.bincount(source, weights=count)
    columns = []
    for s in np.argsort(-weight, kind="stable")[:ORDER_BY]:
        column = np.zeros(n_terms, dtype=np.int64)
        column[term[source == s]] = -count[source == s]
        columns.append(column)
    order = np.lexsort(columns[::-1]) if columns else np.arange(n_terms)
    position = np.empty(n_terms, dtype=np.int64)
    position[order] = np.arange(n_terms)
    return position


def pair_sum(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """Sum of f over the intersected runs of two columns of (first position, frequency)."""
    cuts = np.union1d(a[0], b[0])
    p, q = (x[1][np.searchsorted(x[0], cuts, side="right") - 1] for x in (a, b))
    return int(((p - q) ** 2 // (p + q) * np.diff(cuts, append=length)).sum())


def _audit_block(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial sums of f over the terms of one block, for the pairs of sources of one pair of chunks."""
    names = sorted(zip(groups["source"].to_pylist(), groups["mine"].to_pylist(), groups["n"].to_pylist()), key=lambda x: x[0].encode())
    out: list[tuple[str, str, int]] = []
    if names:
        lang, lo, hi, v, length = (groups[c][0].as_py() for c in ("lang", "lo", "hi", "v", "terms"))
        at = {x[0]: i for i, x in enumerate(names)}
        source = np.fromiter((at[x] for x in entries["source"].to_pylist()), dtype=np.int64, count=entries.num_rows)
        coded = entries["term"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        count = entries["count"].to_numpy().astype(np.int64)
        position = reorder(term, source, count, len(coded.dictionary)) if len(term) else np.empty(0, np.int64)
        columns = []
        for i, (_, _, n) in enumerate(names):
            mine = source == i
            where = position[term[mine]]
            order = np.argsort(where)
            starts, values = runs(where[order], count[mine][order], length)
            distinct, code = np.unique(values, return_inverse=True)
            p = np.array([smoothed(int(c), n, v) for c in distinct], dtype=np.int64) if len(distinct) else np.empty(0, np.int64)
            columns.append((starts, p[code]))
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                if lo == hi or names[i][1] != names[j][1]:
                    out.append((names[i][0], names[j][0], pair_sum(columns[i], columns[j], length) if length else 0))
    return pa.table({
        "lang": pa.array([lang if names else ""] * len(out), pa.string()), "a": pa.array([x[0] for x in out], pa.string()),
        "b": pa.array([x[1] for x in out], pa.string()), "value": pa.array([x[2] for x in out], pa.int64()),
    })


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP,
               block_entries: int = BLOCK_ENTRIES, chunk_sources: int = CHUNK_SOURCES) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from the others of its language, and in which terms.

    Part ``pair`` has every other source of the language with the sum of f over all kept terms, ``term`` the ``top`` terms
    that the source uses more than its language. A language keeps the terms in at least ``min_docs`` of its documents; if it
    keeps none, every pair has 0. Null texts, languages and sources are ''. Repeated rows are documents of their own. Ties go to
    the smaller item. Other columns are not read. An empty table gives no row.
    """
    counts = stored(term_counts(docs, text, lang, source), "terms")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"))
    kept = stored(kept.where(F.col("docs") >= min_docs).select("lang", "term", "total"), "vocabulary")
    entries = stored(counts.where("term <> ''").join(kept, ["lang", "term"]), "entries")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    dealt = entries.groupBy("lang").agg(F.ceil(F.count("*") / block_entries).cast("int").alias("blocks"))
    groups = counts.where("term = ''").select("lang", "source").join(entries.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
    chunks = groups.groupBy("lang").agg(F.ceil(F.count("*") / chunk_sources).cast("int").alias("chunks"))
    groups = groups.join(chunks, "lang").join(langs, "lang", "left").join(dealt, "lang", "left")
    groups = stored(groups.na.fill({"n": 0, "v": 0, "lang_n": 0, "blocks": 1}), "sources")

    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    mine = F.pmod(F.xxhash64("source"), F.col("chunks")).cast("int")
    pairs = lambda df: df.withColumn("mine", mine).withColumn("other", others).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    per_lang = groups.groupBy("lang").agg(F.max("blocks").alias("blocks"), F.max("chunks").alias("chunks"))
    left = pairs(entries.join(per_lang, "lang").withColumn("block", block)).select("lang", "block", "lo", "hi", "source", "term", "count")
    lengths = kept.join(per_lang, "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("terms"))
    right = pairs(groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).join(lengths, ["lang", "block"], "left")
    right = right.select("lang", "block", "lo", "hi", "source", "mine", "n", "v", F.coalesce("terms", F.lit(0)).alias("terms"))
    keys = ["lang", "block", "lo", "hi"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_audit_block, "lang string, a string, b string, value long")
    sums = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order))

    rated = entries.where("count > 0").join(groups.select("lang", "source", "n", "lang_n", "v"), ["lang", "source"])
    rated = rated.withColumn("p", F.expr(_smoothed("count", "n"))).withColumn("q", F.expr(_smoothed("total", "lang_n"))).where("p > q")
    term = rated.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    term = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.unionByName(term)
