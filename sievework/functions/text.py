"""Scalar cleaning and folding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin letters that fold to others of ASCII by dropping one accent.
_ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿçñÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÇÑ"
_BARE = "aaaaaaeeeeiiiiooooouuuuyycnAAAAAAEEEEIIIIOOOOOUUUUYCN"


def trimmed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c.cast("string"), r"^[\s ]+|[\s ]+$", ""))


def of_trimmed(t: Column) -> Column:
    return F.when(F.lower(t).isin("nan", "inf", "-inf", "infinity", "-infinity"), None).otherwise(F.nullif(t, F.lit("")))


def clean(c: Column) -> Column:
    """Trimmed text; blank, NaN and infinite values become null."""
    return of_trimmed(trimmed(c))


def add_clean(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``clean`` as the column ``name``, trimmed in a stage before: as one expression it trims three times for each use."""
    return df.withColumn(name, trimmed(c)).withColumn(name, of_trimmed(F.col(name)))


def strip_accents(c: Column) -> Column:
    """Latin accents off, inside the JVM; ``nfkd`` is for all of Unicode."""
    return F.translate(c, _ACCENTED, _BARE)


@F.pandas_udf(StringType())
def nfkd(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks, in Arrow batches (Spark has no normalize())."""
    import unicodedata

    fold = lambda s: None if s is None else "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))
    for s in batches:
        yield s.map(fold)


def key(c: Column) -> Column:
    """Folded lookup key: no accents, lower case, anything but word characters and hyphens as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), r"(?U)[^\w\s-]", " "), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)
