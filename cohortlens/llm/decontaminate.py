"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask selects some of the positions of a window of words and ignores the others, so a replaced word at an ignored
position does not spoil the hash. The selected words of every window of every benchmark item and of every
document are hashed; equal hashes of one mask are hits. Of hits that follow each other on one diagonal only the first goes
on. Around it, document and item are compared word by word along the diagonal, and the item is found if any stretch has
enough equal words at the share.

The index of the benchmark is sent to every task if it has at most ``BROADCAST_ROWS`` rows of a few numbers, else both sides
are shuffled by the hash, the documents' words left behind. A seed that more than ``HOT`` places of items share is not joined to all
of them: the pair must also have an equal word outside the window, one of the item's rarest so many that no overlap long enough
can do without all of them. Items no longer than a mask are searched by one hash of all their words. Items of equal words are one item, named by the smallest id, so copies in the benchmark add no rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import clear_of, stored

#: 1: the word counts, 0: it is ignored. Each mask starts and ends with 1.
MASKS = ("111010011", "110011011", "101101101")
#: Equal words that a stretch needs; all words of an item that has fewer.
MIN_WORDS = 13
#: Share of the stretch's words that must be equal.
MIN_SHARE = 0.8
#: Rows of the index (about 50 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 2_000_000
#: Places of items with one seed beyond which a hit on it needs a word outside the window.
HOT = 64
#: Words of the shortest item that is searched; fewer in a row are common speech.
SHORTEST = 5


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text: runs of ASCII letters (without case), digits and non-ASCII characters."""
    words = F.array_remove(F.split(F.lower(text), r"[^0-9a-z\x{80}-\x{10ffff}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, number: int, mask: str) -> Column:
    """Hash of the words that the mask selects in the window at ``at`` (from 0), with the mask's number."""
    return F.xxhash64(F.lit(number), *[F.get(words, at + F.lit(i)) for i, c in enumerate(mask) if c == "1"])


def _windows(rows: DataFrame, masks: tuple[str, ...], *columns: str) -> DataFrame:
    """A row for each position that begins a window of the shortest mask."""
    span = min(map(len, masks))
    return rows.where(F.size("words") >= span).select(*columns, "words", F.explode(F.sequence(F.lit(0), F.size("words") - span)).alias("at"))


def _seeds(masks: tuple[str, ...]) -> Column:
    return F.array(*[F.when(F.col("at") + F.lit(len(m)) <= F.size("words"), F.struct(F.lit(k).alias("mask"), _seed(F.col("words"), F.col("at"), k, m).alias("seed"))) for k, m in enumerate(masks)])


def _before(at: Column, masks: tuple[str, ...]) -> Column:
    """The seed of the window one word earlier under the row's mask; null at the start."""
    out = F.lit(None).cast("long")
    for k, m in enumerate(masks):
        out = F.when(F.col("mask") == k, _seed(F.col("words"), at - 1, k, m)).otherwise(out)
    return F.when(at > 0, out)


def items(benchmark: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words): distinct word sequences of the benchmark, each named by its smallest id."""
    rows = benchmark.select(F.col(id_col).alias("item"), word_hashes(F.col(text)).alias("words")).where("words is not null")
    return rows.groupBy("words").agg(F.min("item").alias("item")).where("item is not null")


def most_equal(words: Column, item: Column, min_share: float) -> Column:
    """Of two equally long word lists the stretch with the most equal words among those with the share: n_equal, n_words; the shortest of equals.

    An equal word adds and a replaced word costs so much that a stretch has the share if its sum is not negative, that is if the
    sum up to its start is no higher than up to its end. Only new lows of the sum are kept as starts, so the first that is low
    enough begins the stretch with the most equal words for an end.
    """
    share = Fraction(str(min_share))
    point = lambda *x: F.struct(*[F.coalesce(F.lit(v) if isinstance(v, int) else v, F.lit(0)).alias(n) for n, v in zip(("score", "equal", "length"), x)])
    best = lambda n, m: F.struct(F.coalesce(n, F.lit(0)).alias("n_equal"), F.coalesce(m, F.lit(0)).alias("minus"))

    def step(a: Column, same: Column) -> Column:
        score = a["at"]["score"] + F.when(same, share.denominator - share.numerator).otherwise(-share.numerator)
        equal, length = a["at"]["equal"] + same.cast("int"), a["at"]["length"] + 1
        last, here = F.element_at(a["starts"], -1), F.array(point(score, equal, length))
        # of starts with the same equal words before them only the last, which is the lowest
        starts = F.when(score >= last["score"], a["starts"]).when(last["equal"] == equal, F.concat(F.slice(a["starts"], F.lit(1), F.size(a["starts"]) - 1), here)).otherwise(F.concat(a["starts"], here))
        start = F.get(F.filter(a["starts"], lambda x: x["score"] <= score), F.lit(0))
        found = F.when(same, F.greatest(a["best"], best(equal - start["equal"], start["length"] - length))).otherwise(a["best"])
        return F.struct(point(score, equal, length).alias("at"), starts.alias("starts"), found.alias("best"))

    begin = F.struct(point(0, 0, 0).alias("at"), F.array(point(0, 0, 0)).alias("starts"), best(F.lit(0), F.lit(0)).alias("best"))
    same = F.zip_with(words, item, lambda x, y: x == y)
    return F.aggregate(same, begin, step, lambda a: F.struct(a["best"]["n_equal"].alias("n_equal"), (-a["best"]["minus"]).alias("n_words")))


def _document_seeds(rows: DataFrame, masks: tuple[str, ...], *columns: str) -> DataFrame:
    """``columns``, words, at, mask and seed of every window of every document."""
    return _windows(rows, masks, *columns).select(*columns, "words", "at", F.explode(_seeds(masks)).alias("s")).where("s is not null").select(*columns, "words", "at", "s.*")


def _first_hits(seeds: DataFrame, index: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Hits whose mask does not also hit one word earlier on the diagonal."""
    hits = seeds.join(index, "seed").where("mask = item_mask")
    if "before" not in hits.columns:
        hits = hits.withColumn("before", _before(F.col("at"), masks))
    return hits.where("item_before is null or before is null or item_before <> before")


def _here(hits: DataFrame, *columns: str) -> DataFrame:
    """The part of the item's diagonal that lies inside the document: where it starts in the item, and what the document has there."""
    shift = F.col("at") - F.col("item_at")
    begin, end = F.greatest(shift, F.lit(0)), F.least(shift + F.col("item_size"), F.size("words"))
    return hits.select(*columns, "item", "item_size", (begin - shift).alias("skip"), F.slice("words", begin + 1, end - begin).alias("here"))


def _index(known: DataFrame, masks: tuple[str, ...], spaced: int) -> DataFrame:
    """A row for each seed of each item; the masks from ``spaced`` on select all words of items of their own length."""
    places = _windows(known, masks, "item").select("item", "words", "at", F.explode(_seeds(masks)).alias("s")).where("s is not null").select("item", "words", "at", "s.*")
    length = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1)
    own = (F.col("mask") < spaced) & (F.size("words") > max([0, *[len(m) for m in masks[spaced:]]])) | (F.col("mask") >= spaced) & (F.size("words") == length)
    return places.where(own).select("seed", F.col("mask").alias("item_mask"), "item", F.col("at").alias("item_at"), F.size("words").alias("item_size"), _before(F.col("at"), masks).alias("item_before"))


def _tokens(words: Column, seed: Column, at: Column, begin: Column, end: Column, span: int) -> Column:
    """Hashes of seed, distance and word for the words from ``begin`` to before ``end`` outside the window at ``at``."""
    outside = F.filter(F.sequence(begin, F.greatest(begin, end - 1)), lambda i: (i < end) & ((i < at) | (i >= at + span)))
    return F.transform(outside, lambda i: F.xxhash64(seed, i - at, F.get(words, i)))


def _hot_hits(told: DataFrame, index: DataFrame, known: DataFrame, hot: DataFrame, masks: tuple[str, ...], min_words: int, *columns: str) -> DataFrame:
    """Documents and diagonals of items that meet at a hot seed and at one of the item's rarest words outside the window.

    Of the words alike at most those of a window (``span``) lie inside it, so an overlap has ``need - span`` or more outside, and
    misses none but that many, less one, of the item's words there: one of the others is alike.
    """
    span, size = max(map(len, masks)), F.col("item_size")
    held = index.join(hot.select("seed"), "seed", "left_semi").join(known, "item")
    token = held.select("seed", "item", "item_at", "item_size", F.explode(_tokens(F.col("words"), F.col("seed"), F.col("item_at"), F.lit(0), size, span)).alias("token"))
    token = token.join(token.groupBy("token").agg(F.count("*").alias("n")), "token")
    rarest = Window.partitionBy("seed", "item", "item_at").orderBy("n", "token")
    outside = F.count("*").over(Window.partitionBy("seed", "item", "item_at"))
    enough = token.withColumn("place", F.row_number().over(rarest)).withColumn("outside", outside)
    enough = stored(enough.where(F.col("place") <= F.col("outside") - (F.least(F.lit(min_words), size) - span) + 1).select("token", "item", "item_at", "item_size"), "tokens")
    near = _document_seeds(told, masks, *columns).join(hot, "seed")
    begin, end = F.greatest(F.lit(0), F.col("at") - F.col("back")), F.least(F.size("words"), F.col("at") + F.col("ahead"))
    met = near.select(*columns, "at", F.explode(_tokens(F.col("words"), F.col("seed"), F.col("at"), begin, end, span)).alias("token")).join(enough, "token")
    return met.select(*columns, "item", "item_size", F.expr("at - item_at").alias("shift")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """A row for each distinct ``keep`` of ``docs`` and benchmark item found in it: the columns ``keep``, item_id, n_equal, n_words.

    n_equal of the n_words words of the best stretch are alike: the one with the most equal words of all that have the share,
    the shortest of equals. Null, empty and short texts hold nothing; items no longer than a mask
    are found where all their words stand in a row, those of fewer than ``SHORTEST`` words never; of items with equal words the smallest id is named. Repeated rows
    of one ``keep`` give one row per item. Names of ``keep`` that clash with the new columns get the new ones underscores.
    """
    own = [f"__k{i}" for i in range(len(keep))]  # the columns may have any names
    span = min(max(map(len, masks)), min_words)
    known = stored(items(benchmark).where(F.size("words") >= SHORTEST), "items")
    short = sorted(r[0] for r in known.select(F.size("words")).where(F.size("words") <= span).distinct().collect())  # at most a mask's length of numbers
    spaced, masks = len(masks), (*masks, *["1" * n for n in short])
    index = stored(_index(known, masks, spaced), "seeds")
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, own)], word_hashes(F.col(text)).alias("words"))
    # seeds are shuffled without their document's words, which are joined back to the hits alone
    told = rows.withColumn("__doc", F.xxhash64("words")).withColumn("__size", F.size("words"))
    seeded = (*own, "__doc", "__size")

    def back(hits: DataFrame) -> DataFrame:
        sides = hits.select(*[F.col(k).alias(f"{k}_") for k in seeded], "item", "item_size", F.col("shift").alias("at"), F.lit(0).alias("item_at"))
        alike = F.lit(True)
        for k in seeded:
            alike = alike & (F.col(k).eqNullSafe(F.col(f"{k}_")) if k in own else F.col(k) == F.col(f"{k}_"))
        return _here(told.join(sides, alike), *own).join(known.select("item", F.col("words").alias("item_words")), "item")

    hot = stored(index.where(F.col("item_mask") < spaced).groupBy("seed").agg(F.count("*").alias("n"), F.max("item_at").alias("back"), F.max(F.col("item_size") - F.col("item_at")).alias("ahead")).where(F.col("n") > HOT).drop("n"), "hot")
    crowded = None
    if min_words > max(map(len, masks[:spaced])) and not hot.isEmpty():
        crowded = back(_hot_hits(told, index, known, hot, masks[:spaced], min_words, *seeded))
        index = stored(index.join(hot.select("seed"), "seed", "left_anti"), "seeds")
    if index.count() <= BROADCAST_ROWS:
        local = _here(_first_hits(_document_seeds(rows, masks, *own), F.broadcast(index), masks), *own)
        compared = local.join(F.broadcast(known.select("item", F.col("words").alias("item_words"))), "item")
    else:
        seeds = _document_seeds(told, masks, *seeded).withColumn("before", _before(F.col("at"), masks)).drop("words")
        compared = back(_first_hits(seeds, index, masks).select(*seeded, "item", "item_size", F.expr("at - item_at").alias("shift")).distinct())
    if crowded is not None:
        compared = compared.unionByName(crowded)
    there = F.slice("item_words", F.col("skip") + 1, F.size("here"))
    need = F.least(F.lit(min_words), F.col("item_size"))
    compared = compared.where(F.size(F.filter(F.zip_with("here", there, lambda x, y: x == y), lambda x: x)) >= need)
    stretch = most_equal(F.col("here"), there, min_share)
    found = compared.select(*own, F.col("item").alias("__item"), need.alias("need"), stretch.alias("b"))
    best = found.where(F.col("b.n_equal") >= F.col("need")).groupBy(*own, "__item").agg(F.max(F.struct("b.n_equal", "b.n_words")).alias("b"))
    item, n_equal, n_words = clear_of(keep, "item_id", "n_equal", "n_words")
    return best.select(*[F.col(k).alias(c) for c, k in zip(keep, own)], F.col("__item").alias(item), F.col("b.n_equal").alias(n_equal), F.col("b.n_words").alias(n_words))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark item, every column as it was.

    The verdict depends on the text alone, so rows are told apart by it: equal texts go or stay together and rows without an id are
    judged like any other.
    """
    from cohortlens.llm.common import fresh

    key = fresh(docs, "__text_key")
    keyed = docs.withColumn(key, F.md5("text"))
    own = docs.select(F.md5("text").alias("key"), "text")
    gone = stored(contaminated(own, benchmark, ["key"]).select("key").distinct(), "contaminated")
    return keyed.join(gone, keyed[key] == gone["key"], "left_anti").drop(key)
