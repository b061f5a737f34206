"""N10 for nested contexts: JSON documents of any depth as a facts table.

A context is parsed to a VARIANT once and walked level by level: objects and arrays are taken apart by ``variant_explode``,
scalars become facts. Each level is one distributed pass over the containers of the level above, so a hot context or a
long list is spread like any other rows, and the number of passes is the depth of the deepest context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import materialize


def _is(kind: str) -> Column:
    return F.col("kind").startswith(kind)


def nested_facts(contexts: DataFrame, id_col: str = "context_id", json_col: str = "context") -> DataFrame:
    """``(context_id, path, value_double, value_string)`` of every scalar in JSON contexts.

    Paths are ``key.key[0].key``. Numbers are doubles, strings stay text, booleans are the texts True and False (they
    hold no number); null and an empty object or list inside a context is a fact without a value. A null or malformed context, an
    empty one and a context that is not an object or a list has no fact. Contexts that share an id are one context.
    """
    root = contexts.select(F.col(id_col).cast("string").alias("context_id"), F.lit("").alias("path"), F.try_parse_json(F.col(json_col).cast("string")).alias("v"))
    level = root.withColumn("kind", F.schema_of_variant("v")).where(_is("OBJECT") | _is("ARRAY"))
    facts = None
    while True:
        level = materialize(_children(level), "context_level")
        scalars = level.where(~_is("OBJECT") & ~_is("ARRAY") | F.col("kind").isin("OBJECT<>", "ARRAY<VOID>") & _childless())
        found = scalars.select(
            "context_id", "path",
            F.when(~F.col("kind").isin("STRING", "BOOLEAN", "VOID") & ~_is("OBJECT") & ~_is("ARRAY"), F.try_variant_get("v", "$", "double")).alias("value_double"),
            F.when(_is("STRING"), F.try_variant_get("v", "$", "string"))
            .when(_is("BOOLEAN"), F.initcap(F.try_variant_get("v", "$", "string"))).alias("value_string"))
        facts = found if facts is None else facts.unionByName(found)
        level = level.where(_is("OBJECT") | _is("ARRAY"))
        if level.isEmpty():
            return facts


def _childless() -> Column:
    return F.to_json("v").isin("{}", "[]")


def _children(level: DataFrame) -> DataFrame:
    """The members of the containers in ``level``, one row each, with the kind of their value."""
    members = level.select("context_id", "path", "v").lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
    path = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(
        F.concat("path", F.when(F.col("path") == "", F.lit("")).otherwise(F.lit(".")), "key"))
    return members.select("context_id", path.alias("path"), F.col("value").alias("v"), F.schema_of_variant("value").alias("kind"))
