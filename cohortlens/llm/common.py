"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

#: The ASCII white space that separates words (fixed by the query contracts).
WHITE = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


_collecting: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if _collecting:
        _collecting[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a frame that ``stored`` made and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` makes inside go at the end; what is to stay must have been written elsewhere by then."""
    _collecting.append([])
    try:
        yield
    finally:
        for folder in _collecting.pop():
            _delete(spark, folder)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def clear_of(keep: list[str], *names: str) -> list[str]:
    """``names``, each with underscores added until it differs from all of ``keep`` and from those before it."""
    taken, out = {c.lower() for c in keep}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col(f"`{c}`") for c in names]


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def in_ranges(df: DataFrame, order: list[str], name: str, rows: int) -> DataFrame:
    """``df`` with the number of each row's range of ``order``: ranges ascend, equal keys share one, each has about ``rows`` rows."""
    ranges = max(1, -(-df.count() // rows))
    if ranges == 1:
        return df.withColumn(name, F.lit(0))
    return stored(df.repartitionByRange(ranges, *order).withColumn(name, F.spark_partition_id()), "ranges")


def before(sums: DataFrame, place: str, values: list[str], keys: list[str], width: int) -> DataFrame:
    """``keys``, ``place`` and, instead of each of ``values``, its total at the places of the key before this one.

    ``sums`` has one row for each key and place. Totals are added up inside blocks of ``width`` places and then over blocks, so the window over
    all blocks of a key has one row for that many places.
    """
    to_here = lambda order, *by: Window.partitionBy(*keys, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda v, window: F.coalesce(F.sum(v).over(window), F.lit(0))
    dealt = sums.withColumn("__block", F.floor(F.col(place) / F.lit(width)))
    blocks = dealt.groupBy(*keys, "__block").agg(*[F.sum(v).alias(v) for v in values])
    blocks = blocks.select(*keys, "__block", *[so_far(v, to_here("__block")).alias(f"__{v}") for v in values])
    inside = dealt.select(*keys, "__block", place, *[so_far(v, to_here(place, "__block")).alias(v) for v in values])
    return inside.join(blocks, [*keys, "__block"]).select(*keys, place, *[(F.col(v) + F.col(f"__{v}")).alias(v) for v in values])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph, as (node, component); component is the smallest node.

    ``edges`` has two columns of one orderable type. Large-star and small-star rounds alternate until the edges are
    stars; each round is aggregated before it is shuffled and written to the shared folder, so nothing is collected
    and no lineage builds up. A node of very many edges is one key of a join with a one-row-per-key side, which
    adaptive execution can split.
    """
    a, b = edges.columns
    cur = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    state = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = stored(small.select("e.u", "e.v").where("u != v").distinct(), name)
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_stored(cur)
        cur = new
        if state == (now["n"], now["h"]):
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = (now["n"], now["h"])
