"""Places and running sums in an order of all rows, without a window over all rows or a hot key.

The rows are dealt by ranges of the order and sorted within them, so a range knows the places of its
rows up to an offset: what the ranges before it have. Only one row per range, and one per range and
key, is summed over ranges. End an order with a column that no two rows share, so that rows alike in
the others can be dealt over ranges too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a range fit the low bits of its rows' numbers.
_BITS = 33


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _sorted(df: DataFrame, order: Sequence[Column], part: str, nth: str) -> DataFrame:
    """``df`` written with ``part``, the range of each row, and ``nth``, its place there from 0."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = fresh(df, "_id")[0]
    held = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id()), "ordered")
    return held.select(*df.columns, F.shiftright(number, _BITS).alias(part), F.col(number).bitwiseAND((1 << _BITS) - 1).alias(nth))


def rank_all(df: DataFrame, order: Sequence[Column], out: str = "place") -> DataFrame:
    """``df`` with each row's place from 1 in the order of all rows. A column named ``out`` is
    replaced, any others are kept."""
    df = df.drop(out)
    part, nth, of, start, n = fresh(df, "_range", "_nth", "_of", "_start", "_n")
    held = _sorted(df, order, part, nth)
    before = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = held.groupBy(F.col(part).alias(of)).agg(F.count(F.lit(1)).alias(n)).select(of, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    return held.join(starts, F.col(part) == F.col(of)).withColumn(out, (F.col(start) + F.col(nth) + 1).cast("long")).drop(part, nth, of, start)


def running(df: DataFrame, key: str, order: Sequence[Column], size: Column, place: str = "place", before: str = "before") -> DataFrame:
    """``df`` with each row's place from 0 among its key's rows and the sum of the sizes before it. A
    key's rows are dealt over as many ranges as they need. Columns named like an output are replaced,
    any others are kept."""
    df = df.drop(place, before)
    own, part, nth, at, sum_, k, of, n, total, n0, t0 = fresh(df, "_size", "_range", "_nth", "_at", "_sum", "_k", "_of", "_n", "_total", "_n0", "_t0")
    held = _sorted(df.withColumn(own, size.cast("long")), [F.col(key), *order], part, nth)
    within = Window.partitionBy(part, key).orderBy(nth)
    rows = held.withColumns({
        at: F.row_number().over(within) - 1,
        sum_: F.coalesce(F.sum(own).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    parts = held.groupBy(F.col(key).alias(k), F.col(part).alias(of)).agg(F.count(F.lit(1)).alias(n), F.sum(own).alias(total))
    earlier = Window.partitionBy(k).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)  # a key's ranges
    starts = parts.select(k, of, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n0), F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(t0))
    out = rows.join(starts, F.col(key).eqNullSafe(F.col(k)) & (F.col(part) == F.col(of)))
    out = out.withColumns({place: (F.col(at) + F.col(n0)).cast("long"), before: (F.col(sum_) + F.col(t0)).cast("long")})
    return out.select(*df.columns, place, before)
