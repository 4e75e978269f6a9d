"""Deep pages: the rows at a rank, without sorting or skipping all before them.

A first pass counts the rows by ranges of the first sort key, from approximate quantiles; only the
ranges that the page falls into are read again and divided further, by the next key where they hold one
value only. What is sorted in the end, and skipped, is bounded, whatever the page's number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are sorted at last, and ranges that are counted at a time.
MOST_ROWS, RANGES = 100_000, 200


@dataclass(frozen=True)
class Key:
    """A sort key; nulls are last either way."""

    column: str
    down: bool = False

    def order(self) -> Column:
        c = F.col(self.column)
        return c.desc_nulls_last() if self.down else c.asc_nulls_last()


def _measure(df: DataFrame, column: str, skip: int) -> Column:
    """A number in the order of the column: its own, or that of six bytes of a text from the ``skip``th on and how many more there are, up to seven."""
    c, kind = F.col(column), df.schema[column].dataType.typeName()
    if kind == "string":
        bytes_ = F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), skip + 1, 6)), 12, "0"), 16, 10).cast("long")
        return (bytes_ * 8 + F.least(F.greatest(F.octet_length(c) - skip, F.lit(0)), F.lit(7))).cast("double")
    return c.cast("long").cast("double") if kind in ("timestamp", "boolean") else F.unix_date(c).cast("double") if kind == "date" else c.cast("double")


def _ranges(df: DataFrame, measure: Column) -> list[tuple[float | None, float | None, int]]:
    """(least, greatest, rows) of ranges in ascending order, those of nulls last; no more than a few hundred.

    Each cut is a range of its own, so a value of many rows does not keep others with it.
    """
    cuts = df.agg(F.percentile_approx(measure, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    all_cuts = F.lit(cuts).cast("array<double>")
    at = 2 * F.size(F.filter(all_cuts, lambda x: x < measure)) + F.array_contains(all_cuts, measure).cast("int")
    rows = df.groupBy(F.when(measure.isNull(), F.lit(2 * len(cuts) + 2)).otherwise(at).alias("range")).agg(F.min(measure).alias("a"), F.max(measure).alias("z"), F.count("*").alias("n")).collect()
    return [(r.a, r.z, r.n) for r in sorted(rows, key=lambda r: r.range)]


def deep_page(df: DataFrame, keys: list[Key], number: int, size: int, most: int = MOST_ROWS) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows of ``df`` in the order of ``keys``.

    Rows that tie in all keys are interchangeable, so the last keys should tell rows apart. Behind the
    last page there are no rows. Numbers beyond 2**53 tie in the ranges, and are sorted in the end.
    """
    if number < 1 or size < 1:
        raise ValueError("pages and sizes start at 1")
    skip, part, level, offset = (number - 1) * size, df, 0, 0
    while level < len(keys):
        key = keys[level]
        measure = _measure(df, key.column, offset)
        found = _ranges(part, measure)
        total = sum(n for *_, n in found)
        if skip >= total:
            return df.limit(0)
        if total <= most:
            break
        if key.down:
            found = [x for x in reversed(found) if x[0] is not None] + [x for x in found if x[0] is None]
        used = []
        for a, z, n in found:
            if not used and skip >= n:
                skip -= n
                continue
            used.append((a, z, n))
            if sum(x[2] for x in used) >= skip + size:
                break
        lows, highs = [x[0] for x in used if x[0] is not None], [x[1] for x in used if x[1] is not None]
        inside = measure.between(min(lows), max(highs)) if lows else F.lit(False)
        part = part.where(F.coalesce(inside, F.lit(False)) | measure.isNull() if any(x[0] is None for x in used) else inside)
        if sum(x[2] for x in used) <= most:
            break
        if len(used) > 1:
            if sum(x[2] for x in used) < total:
                continue
            break  # a page over several ranges, each as fine as the numbers are
        if used[0][0] == used[0][1]:  # one value: by the rest of a text, then by the next key
            more = df.schema[key.column].dataType.typeName() == "string" and used[0][0] is not None and part.where(F.octet_length(key.column) > offset + 6).limit(1).count()
            level, offset = (level, offset + 6) if more else (level + 1, 0)
    return part.orderBy(*[k.order() for k in keys]).limit(skip + size).offset(skip)
