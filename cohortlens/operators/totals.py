"""A1 and totals that are exact for every double: sums by decimal exponent, as whole numbers.

A value is read as the decimal that Spark prints for it: digits times a power of ten. Values (or products of a value and a
weight) of one power add up as whole numbers, so nothing is rounded before the end and the size of a value does not change how it
is added. Digits add up in parts of seven, as longs over chunks of 32,768 rows and then as decimals. After a partial aggregate
in every task a shuffle carries a row per group, sum, power and chunk, the next a row per group, sum and power, at most some
1,300 a sum and in practice a dozen; the powers are then put together digit by digit and rounded to a double once.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numeric import safe_div

#: Digits of a piece of a total, and digits of a part of a factor.
PIECE, PART = 18, 7
#: Rows, as a power of two, whose products of parts (at most three together, below 2.1e14) a long adds up for certain.
CHUNK = 15
#: Pieces that hold 38 digits moved up by less than a piece.
PIECES = 4
WHOLE = "decimal(38,0)"


def _decimal(df: DataFrame, side: str) -> DataFrame:
    """``df`` with the decimal of a factor, the double ``side`` or the whole number ``side``_whole: its digits, and the power of ten that they count.

    Null where the factor is null or not finite. A small step at a time, as a JVM leaves large generated methods uncompiled.
    """
    text, mark, number, point = (F.col(f"__{c}") for c in ("text", "mark", "number", "point"))
    df = df.withColumn("__text", F.when(F.abs(side) < float("inf"), F.col(side).cast("string")))  # NaN is above infinity
    df = df.withColumn("__mark", F.instr(text, "E"))
    df = df.withColumns({"__number": F.when(mark > 0, F.substring(text, F.lit(1), mark - 1)).otherwise(text),
                         "__power": F.when(mark > 0, F.substring(text, mark + 1, F.length(text)).cast("int")).otherwise(F.lit(0))})
    df = df.withColumn("__point", F.instr(number, "."))
    whole = F.col(f"{side}_whole")
    return df.withColumns({
        f"{side}_digits": F.coalesce(whole, F.replace(number, F.lit("."), F.lit("")).cast("long")),
        f"{side}_power": F.when(whole.isNotNull(), F.lit(0)).otherwise(F.col("__power") - F.when(point > 0, F.length(number) - point).otherwise(F.lit(0)))})


def _split(digits: Column) -> list[Column]:
    """A whole number as parts of seven digits, the lowest first, each with its sign."""
    div = lambda x, n: F.call_function("div", x, F.lit(n))
    base = F.lit(10**PART)
    return [digits % base, div(digits, 10**PART) % base, div(digits, 10 ** (2 * PART))]


def _pieces(total: Column, power: Column) -> Column:
    """A whole number of up to 38 digits times a power of ten as (place, piece): pieces of 18 digits that count 10^(18 place)."""
    place, shift = F.floor(power / F.lit(PIECE)).cast("int"), F.pmod(power, F.lit(PIECE)).cast("int")
    digits = F.lpad(F.concat(F.abs(total).cast("string"), F.repeat(F.lit("0"), shift)), PIECE * PIECES, "0")
    sign = F.signum(total).cast("int")
    return F.array(*[F.struct((place + i).alias("place"), (F.substring(digits, PIECE * (PIECES - 1 - i) + 1, PIECE).cast("long") * sign).alias("piece")) for i in range(PIECES)])


def _written_out(pieces: Column, sign: int) -> Column:
    """Digits of the total of pieces (a map from place to piece) times ``sign`` as (carry, text); the carry is -1 if that is below zero."""
    base = F.lit(10**PIECE).cast(WHOLE)
    places = F.map_keys(pieces)
    every = F.sequence(F.array_min(places), F.array_max(places) + 2)

    def carry_on(a: Column, place: Column) -> Column:
        here = a["carry"] + F.coalesce(F.try_element_at(pieces, place), F.lit(0)).cast(WHOLE) * F.lit(sign)
        piece = F.pmod(here, base)
        return F.struct(((here - piece) / base).cast(WHOLE).alias("carry"), F.concat(F.lpad(piece.cast("string"), PIECE, "0"), a["text"]).alias("text"))

    return F.aggregate(every, F.struct(F.lit(0).cast(WHOLE).alias("carry"), F.lit("").alias("text")), carry_on)


def _rounded(pieces: Column) -> Column:
    """The double nearest to the total of pieces; infinite where no double is that large."""
    plus, minus = _written_out(pieces, 1), _written_out(pieces, -1)
    power = F.concat(F.lit("E"), (F.array_min(F.map_keys(pieces)) * PIECE).cast("string"))
    value = lambda a: F.concat(a["text"], power).cast("double")
    return F.when(plus["carry"] < 0, -value(minus)).otherwise(value(plus))


def _number(df: DataFrame, name: str, side: str) -> list[Column]:
    """A factor as a double (``side``), or as a whole number (``side``_whole) if its column holds such; the other is null."""
    whole = df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long")
    null = F.lit(None)
    return [(null if whole else F.col(name)).cast("double").alias(side), (F.col(name) if whole else null).cast("long").alias(f"{side}_whole")]


def exact_totals(df: DataFrame, sums: dict, by: list[str] | None = None) -> DataFrame:
    """``by`` and, for each name of ``sums``, the total of a column or of the products of a (column, weight) pair, as the nearest double.

    The decimals of the values are added up without any rounding, so neither the partitioning nor the order of rows nor values of other sizes
    change a result. Terms that hold a null do not count; a total without terms is null. If a term is not finite, the
    total is what such terms add up to. Null keys are a group; an empty table gives no group, or one row of nulls without ``by``.
    """
    by = by or []
    pairs = {n: s if isinstance(s, tuple) else (s, F.lit(1).cast("long")) for n, s in sums.items()}
    col = lambda c: F.col(c) if isinstance(c, str) else c
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], *[col(c).alias(f"__{side}{i}") for i, pair in enumerate(pairs.values()) for side, c in zip("xw", pair)],
                     F.shiftright(F.monotonically_increasing_id(), CHUNK).alias("__chunk"))
    terms = F.array(*[F.struct(F.lit(i).alias("sum"), *_number(rows, f"__x{i}", "x"), *_number(rows, f"__w{i}", "w")) for i in range(len(pairs))])
    terms = rows.select(*keys, "__chunk", F.explode(terms).alias("t")).select(*keys, "__chunk", "t.*")
    # the factors' own digits count: a product of finite factors may have no double
    terms = _decimal(_decimal(terms, "x"), "w")
    x, w = (F.coalesce(side, F.col(f"{side}_whole").cast("double")) for side in "xw")
    finite = (F.abs(x) < float("inf")) & (F.abs(w) < float("inf"))
    terms = terms.select(*keys, "__chunk", "sum", (F.col("x_power") + F.col("w_power")).alias("power"), F.when(~finite, x * w).alias("other"),
                         *[part.alias(f"{side}{i}") for side in "xw" for i, part in enumerate(_split(F.col(f"{side}_digits")))])
    products = lambda k: reduce(add, [F.col(f"x{i}") * F.col(f"w{k - i}") for i in range(3) if 0 <= k - i < 3])
    sums_of = [f"p{k}" for k in range(5)]
    chunks = terms.groupBy(*keys, "sum", "power", "__chunk").agg(*[F.sum(products(k)).alias(p) for k, p in enumerate(sums_of)], F.sum("other").alias("other"))
    powers = chunks.groupBy(*keys, "sum", "power").agg(*[F.sum(F.col(p).cast("decimal(28,0)")).alias(p) for p in sums_of], F.sum("other").alias("other"))

    # from here on a row per group, sum and power
    each = F.array(*[F.struct((F.col("power") + PART * i).alias("power"), F.col(p).alias("total")) for i, p in enumerate(sums_of)])
    placed = powers.select(*keys, "sum", "other", F.explode(each).alias("e")).select(*keys, "sum", "other", F.explode(_pieces(F.col("e.total"), F.col("e.power"))).alias("p"))
    places = placed.groupBy(*keys, "sum", "p.place").agg(F.sum(F.col("p.piece").cast("decimal(18,0)")).alias("piece"), F.sum("other").alias("other"))
    held = F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("place", "piece")))
    totals = places.groupBy(*keys, "sum").agg(F.map_from_entries(held).alias("pieces"), F.sum("other").alias("other"))
    total = F.coalesce(F.col("other"), F.when(F.size("pieces") > 0, _rounded(F.col("pieces"))))
    totals = totals.select(*keys, "sum", total.alias("total"))
    out = totals.groupBy(*keys).agg(*[F.max(F.when(F.col("sum") == i, F.col("total"))).alias(f"__t{i}") for i in range(len(pairs))])
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *[F.col(f"__t{i}").alias(n) for i, n in enumerate(pairs)])


def exact_weighted_means(df: DataFrame, columns: list[str], weight: str = "households", by: list[str] | None = None) -> DataFrame:
    """A1 for doubles of any size: ``by`` and the weighted mean of each column, the exact total over the exact total weight; null if that is 0."""
    totals = exact_totals(df, {"__weight": weight, **{c: (c, weight) for c in columns}}, by)
    return totals.select(*[F.col(f"`{c}`") for c in by or []], *[safe_div(f"`{c}`", "__weight").alias(c) for c in columns])
