"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a digest of a seed and the id), and the shuffled source is repeated up to
``MAX_REPEATS`` times. A copy of a document has the virtual finish time (tokens of its source up to its own end) /
(target of the source). The queue of all copies is sorted by that time and cut where its tokens reach the total budget.

Both running sums are kept apart from single tasks: a source is cut into ranges of its shuffle digest, the
queue into ranges of virtual time, each of about ``RANGE_ROWS`` rows. Range totals are added up first, in blocks of ``RANGE_ROWS``
ranges, then each range continues from the total before it. Virtual time spreads the tokens of all sources evenly, so its ranges are even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import before, fresh, in_ranges, stored, word_count

#: Weights of the sources in order of name, repeating; a source without a name comes last.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
RANGE_ROWS = 4096
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with target: the targets share all sizes by weight.

    Sources are weighted in their order. No target is above ``max_repeats`` times its source's size; what that leaves over is
    shared by weight among the others until none is above. With the sources ordered by cap per weight, those that are
    cut off come first, and the level is the share per weight that holds behind the last of them: shares only fall from the first source
    on that is not cut off, so it is the largest that does not exceed its own source's cap. Sources are numbered and added up in
    ranges, so there may be any number of them.
    """
    at = in_ranges(sizes, ["source"], "__range", RANGE_ROWS)
    number = F.row_number().over(Window.partitionBy("__range").orderBy("source")) - 1 + F.col("__rows")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    starts = before(at.groupBy("__range").agg(F.count("*").alias("__rows")), "__range", ["__rows"], [], RANGE_ROWS)
    rows = at.join(starts, "__range").withColumn("weight", weight).select(*sizes.columns, "weight")
    rows = rows.withColumn("cap", F.lit(max_repeats) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))

    dealt = in_ranges(rows, ["ratio", "source"], "range", RANGE_ROWS)
    size, heft = dealt.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    earlier = before(dealt.groupBy("range").agg(F.sum("cap").alias("caps"), F.sum("weight").alias("weights")), "range", ["caps", "weights"], [], RANGE_ROWS)
    inside = Window.partitionBy("range").orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, e: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(e)
    rows = dealt.join(earlier, "range").withColumn("share", (F.lit(size) - so_far("cap", "caps")) / (F.lit(heft) - so_far("weight", "weights")))
    level = F.lit(rows.agg(F.max(F.when(F.col("share") <= F.col("ratio"), F.col("share")))).first()[0]).cast("double")
    target = F.when(F.col("ratio") <= level, F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return rows.select(*sizes.columns, target.alias("target"))


def _marked(source: Column) -> Column:
    """A source's name that is never null and sorts null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def decide(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each distinct id, marked source and size of ``docs``.

    ``docs`` has doc_id, source (marked) and size. Rows alike in all three are one unit of the queue: they are taken
    together.
    """
    units = stored(docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("words", F.col("n") * F.col("size")), "units")
    plan = stored(targets(units.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("units")), weights), "targets")
    budget, n = plan.agg(F.sum("source_size"), F.sum("units")).first()
    budget, ranges = budget or 0, max(1, -(-(n or 0) // RANGE_ROWS))
    to_here = Window.unboundedPreceding

    # words of the source up to the unit's end in the shuffled order; a range is a stretch of the digest's first 32 bits
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    dealt = units.join(plan, "source").withColumn("digest", digest)
    dealt = dealt.withColumn("range", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") * F.ceil(F.col("units") / RANGE_ROWS) / float(1 << 32)))
    sums = before(dealt.groupBy("source", "range").agg(F.sum("words").alias("earlier")), "range", ["earlier"], ["source"], RANGE_ROWS)
    running = Window.partitionBy("source", "range").orderBy("digest", "doc_id", "size").rowsBetween(to_here, Window.currentRow)
    done = dealt.withColumn("own", F.sum("words").over(running)).join(sums, ["source", "range"]).withColumn("done", F.col("own") + F.col("earlier"))
    done = stored(done.select("doc_id", "source", "size", "words", "source_size", "target", "digest", "done"), "queue")

    # the queue: copies that begin by virtual time 1, when every target has been served
    copies = done.where("words > 0 and target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    copies = copies.where(F.col("done") - F.col("words") + F.col("copy") * F.col("source_size") <= F.col("target"))
    copies = copies.withColumn("finish", (F.col("done") + F.col("copy") * F.col("source_size")) / F.col("target")).withColumn("span", F.floor(F.col("finish") * ranges))
    spans = before(copies.groupBy("span").agg(F.sum("words").alias("earlier")), "span", ["earlier"], [], RANGE_ROWS).where(F.col("earlier") < budget)
    queue = Window.partitionBy("span").orderBy("finish", "source", "copy", "digest", "doc_id", "size").rowsBetween(to_here, Window.currentRow)
    taken = copies.join(spans, "span").withColumn("total", F.col("earlier") + F.sum("words").over(queue)).where(F.col("total") <= budget)
    counts = taken.groupBy(F.col("source").alias("s"), F.col("done").alias("d")).agg(F.count("*").alias("copies"))
    # an end of words in a source belongs to one unit that has words
    return done.join(counts, (F.col("source") == F.col("s")) & (F.col("done") == F.col("d")) & (F.col("words") > 0), "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).cast("long").alias("copies")
    )


def mix(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The columns ``keep`` (all) of every row of ``docs`` with size, source_size, target and taken.

    ``size`` is the number of words (null or empty text: 0), ``taken`` the words that the mix takes, repeats counted; only whole
    documents are taken, those without words never. A null source is a source of its own, the last. The shuffle follows a
    digest of the id, then the id, then the size, so reruns agree; rows alike in id, source and size are taken together.
    An empty table gives no row. Names that ``docs`` has already get underscores added.
    """
    keep = docs.columns if keep is None else keep
    i, s, size, copies = (fresh(docs, x) for x in ("__id", "__source", "size", "__copies"))
    rows = docs.withColumn(i, F.col(id_col)).withColumn(s, _marked(F.col(source))).withColumn(size, word_count(F.col(text)))
    if text not in keep:  # words are counted once, texts that are kept are not written for that
        rows = stored(rows.select(*[f"`{c}`" for c in dict.fromkeys([*keep, i, s, size])]), "sizes")
    found = decide(rows.select(F.col(i).alias("doc_id"), F.col(s).alias("source"), F.col(size).alias("size")), weights)
    named = {"source_size": fresh(docs, "source_size"), "target": fresh(docs, "target"), "copies": copies}
    found = found.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"), *[F.col(a).alias(b) for a, b in named.items()])
    joined = rows.join(found, F.col(i).eqNullSafe(F.col("__d")) & (F.col(s) == F.col("__s")) & (F.col(size) == F.col("__n")))
    return joined.select(*[f"`{c}`" for c in keep], size, named["source_size"], named["target"], (F.col(size) * F.col(copies)).alias(fresh(docs, "taken")))


def take(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, every column as it was, with the words taken."""
    out = mix(docs)
    return out.select(*[f"`{c}`" for c in docs.columns], F.col(out.columns[-1])).where(F.col(out.columns[-1]) > 0)
