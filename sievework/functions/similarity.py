"""Edit similarity as columns: the Indel ratio and the token-set ratio, in Arrow batches.

Spark has no longest common subsequence, and a table of nested arrays is interpreted cell by cell. The
bit-parallel form (Hyyrö 2004) takes a few integer operations for each character of one side, and a
batch works each distinct string and pair out once.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

# workers get these few functions with the plan, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SPACE = re.compile("[ \\t\\n\\x0b\\f\\r]+")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: the zeros that are left in a row of bits, one for each character of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    row = whole = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """200 * lcs / (len(a) + len(b)); two empty strings are equal."""
    both = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / both if both else 100.0


def token_set(a: str, b: str) -> float:
    """The best Indel ratio among the shared tokens alone and with either side's own tokens."""
    x, y = ({w for w in _SPACE.split(s) if w} for s in (a, b))
    if not x or not y:
        return 0.0
    shared, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if shared and not (left and right):
        return 100.0
    s, sl, sr = " ".join(shared), " ".join(shared + left), " ".join(shared + right)
    return max(indel(s, sl), indel(s, sr), indel(sl, sr)) if shared else indel(sl, sr)


def _each(f, *sides: pd.Series) -> pd.Series:
    """``f`` of each distinct row without a null; null elsewhere."""
    once = lru_cache(None)(f)
    return pd.Series([None if any(v is None for v in row) else once(*row) for row in zip(*sides)], dtype="object")


@F.pandas_udf(DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(indel, a, b)


@F.pandas_udf(DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(token_set, a, b)


@F.pandas_udf(LongType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lcs_length, a, b)


def lcs(a: Column, b: Column) -> Column:
    return _lcs(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    return _indel(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _token_set(a, b)


def first_near(value: Column, targets: list[str], least: float) -> Column:
    """The first of ``targets`` whose Indel ratio to ``value`` is ``least`` at least, else null."""

    @F.pandas_udf(StringType())
    def near(v: pd.Series) -> pd.Series:
        return _each(lambda x: next((t for t in targets if indel(x, t) >= least), None), v)

    return near(value)
