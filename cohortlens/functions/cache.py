"""Memoisation of column-expression builders.

Unresolved ``Column`` expressions (built from names and literals) can be
reused with any DataFrame. Building large ones - the 24-term survival curve,
the scenario lever formulas - costs thousands of Python->JVM calls, so the
builders are memoised per SparkContext.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def _token() -> int:
    sc = SparkContext._active_spark_context
    return id(sc) if sc is not None else 0


def per_context(fn):
    """lru_cache keyed by the active SparkContext plus the (hashable) arguments."""
    cached = functools.lru_cache(maxsize=256)(lambda token, *args: fn(*args))

    @functools.wraps(fn)
    def wrapper(*args):
        return cached(_token(), *args)

    return wrapper
