"""Language identification by rank-order profiles (Cavnar and Trenkle).

A profile is the list of a language's most frequent letter n-grams, most frequent first. A document is
compared to every profile by the out-of-place distance: for each of its own most frequent n-grams, how far its
rank there is from its rank in the profile, or the whole profile length where the profile lacks it. The language
of the smallest distance wins.

Counting is vectorised per document inside Arrow batches. Learning counts the n-grams of all labelled documents: each task
adds up its own counts first, so a language with most of the rows sends one row per n-gram and task. Only the
profiles (languages x ``profile_size`` rows, checked against ``MAX_PROFILE_ROWS``) reach the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import clear_of, quoted

#: N-grams in a profile.
PROFILE_SIZE = 400
#: Longest n-gram, in characters; three code points fill a 64-bit number.
MAX_N = 3
#: The profiles are sent to every task; more rows than this are refused.
MAX_PROFILE_ROWS = 1_000_000
#: Score that a text must exceed to count as written in a known language. Words of random letters and encoded data score 0.14 to 0.23
#: from some 100 letters on, texts in the language of a profile 0.46 or more; below that length scores of both are higher.
MIN_SCORE = 0.25
#: The answer where a text is null or has no letter.
UNDETERMINED = "und"
#: N-gram positions counted at once in one document.
CHUNK = 1 << 20
_EDGE = 0x20  # the mark at the start and the end of a word
_BITS = 21  # of a code point


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letters(text: str) -> np.ndarray:
    """Lower-case code points of the words of ``text`` with one edge mark before, between and after them."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, dtype=np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of the characters between two words stands for all of them
    out = np.where(is_letter, points, _EDGE)[keep].astype(np.int64)
    return np.concatenate(([_EDGE], out, [_EDGE] if out[-1] != _EDGE else [])).astype(np.int64)


def _codes(seq: np.ndarray) -> np.ndarray:
    """N-grams of up to MAX_N characters as numbers; none spans two words or is an edge alone."""
    parts = [seq[seq != _EDGE]]
    code = seq
    for n in range(2, MAX_N + 1):
        code = (code[:-1] << _BITS) | seq[n - 1 :]
        parts.append(code if n == 2 else code[seq[1:-1] != _EDGE])
    return np.concatenate(parts)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, ascending, and how often each occurs."""
    seq = letters(text)
    if len(seq) <= CHUNK:
        return np.unique(_codes(seq), return_counts=True)
    # the chunks of a very long text are cut at edges, so no n-gram is lost or counted twice
    edges = np.flatnonzero(seq == _EDGE)
    start, parts = 0, []
    while start < len(seq) - 1:
        i = np.searchsorted(edges, start + CHUNK, side="right") - 1
        end = edges[i] if edges[i] > start else edges[i + 1]  # a word longer than a chunk stays whole
        parts.append(np.unique(_codes(seq[start : end + 1]), return_counts=True))
        start = end
    return _added(parts)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), added up over the task."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        found: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.setdefault(lang, []).append(ngram_counts(text))
        for lang, parts in found.items():
            sums[lang] = _added(parts + ([sums[lang]] if lang in sums else []))
    for lang, (codes, n) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", profile_size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """N-grams of each language of ``labelled``, most frequent first (ties: the smaller n-gram).

    Rows whose text or language is null are left out; so is a language without a single letter.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= profile_size)
    found = top.select("lang", "rank", "gram").limit(MAX_PROFILE_ROWS + 1).collect()
    if len(found) > MAX_PROFILE_ROWS:
        raise ValueError(f"the profiles have more than {MAX_PROFILE_ROWS} rows: too many languages to send to every task")
    profiles: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r.lang, r["rank"])):
        profiles.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, dtype=np.int64) for k, v in profiles.items()}


class RankOrder:
    """Classifies single texts with given profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], profile_size: int = PROFILE_SIZE):
        self.langs = sorted(profiles)  # by code point, so ties go to the smaller name
        self.size = profile_size
        self.grams = np.unique(np.concatenate([profiles[x] for x in self.langs])) if profiles else np.empty(0, np.int64)
        # ranks[i, j]: rank of n-gram i in language j's profile; -1 where it is lacking; the last row is for unknown n-grams
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        for j, x in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[x]), j] = np.arange(len(profiles[x]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 - distance / the largest possible distance; 1 is the profile's own order."""
        codes, n = ngram_counts(text) if text else (np.empty(0, np.int64),) * 2
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        order = np.argsort(-n, kind="stable")[: self.size]  # codes ascend, so ties go to the smaller n-gram
        grams = codes[order]
        at = np.searchsorted(self.grams, grams)
        at[(at >= len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != grams)] = len(self.grams)
        ranks = self.ranks[at]
        out = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams))[:, None])).sum(axis=0)
        best = int(np.argmin(out))
        return self.langs[best], float(1.0 - out[best] / (len(grams) * self.size))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], text: str = "text", profile_size: int = PROFILE_SIZE) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score.

    A null text, an empty one and one without letters get ``und`` and 0. Every row gives one row, repeated ones too. Ties
    between languages go to the smaller name. Names of ``keep`` that clash with the new columns get the new ones underscores.
    """
    made = clear_of(keep, "lang_pred", "score", "__text")
    schema = ", ".join(f"`{c}` {t}" for c, t in [*docs.select(*quoted(keep)).dtypes, *zip(made, ("string", "double"))])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = RankOrder(profiles, profile_size)
        for batch in batches:
            found = [model(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], *made[:2]])

    return docs.select(*quoted(keep), F.col(f"`{text}`").alias(made[2])).mapInArrow(classify, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents never learned from: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those that are not held out."""
    docs = docs.select("doc_id", "text", "lang")
    profiles = learn_profiles(docs.where(~held_out()))
    return identify(docs.withColumn("held_out", held_out()), profiles, ["doc_id", "held_out"])


def reject_unidentified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has an identified language, every column as it was.

    Rejected are texts that are null or have no letter, and texts whose score is not over ``min_score``: encoded data,
    random letters, and languages or scripts without a profile. If no document is labelled, nothing
    can be identified and every row goes.
    """
    profiles = learn_profiles(docs.where(~held_out()).select("text", "lang"))

    @F.arrow_udf("boolean")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = RankOrder(profiles)
        for texts in batches:
            found = (model(x.as_py()) for x in texts)
            yield pa.array([lang != UNDETERMINED and score > min_score for lang, score in found], pa.bool_())

    return docs.where(identified(F.col("text")))  # only texts go to Python, only verdicts come back
