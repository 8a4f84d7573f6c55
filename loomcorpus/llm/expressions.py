"""Column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once although ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written, with a number of each row that stays as written, and that column's name."""
    row = fresh(df, "_row")[0]
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), name), row


def gapless(df: DataFrame, group: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in column ``out``.

    The rows are written with a row number first. A group is dealt over parts by the hash of
    ``order`` and the row number, so rows alike are dealt too and no task holds a whole group; each
    part, of about ``rows`` rows in the largest group, is numbered by its own window and starts where
    the parts before it end. Only the row counts of the parts are gathered.
    """
    held, row = numbered(df, "numbered-rows")
    most = held.groupBy(*group).count().agg(F.max("count")).first()[0] or 1
    part, nth, start, *keys = fresh(held, "part", "nth", "start", *[f"k{i}" for i in range(len(group) + 1)])
    held = held.withColumn(part, F.pmod(F.xxhash64(*order, row), F.lit(-(-most // rows))).cast("int"))
    sizes = held.groupBy(*group, part).agg(F.count(F.lit(1)).alias(nth))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(c).alias(k) for c, k in zip([*group, part], keys)], F.coalesce(F.sum(nth).over(before), F.lit(0)).alias(start)
    )
    rank = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order, row))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip([*group, part], keys)]
    joined = held.withColumn(nth, rank).join(starts, on=same, how="left")
    return joined.withColumn(out, (F.col(start) + F.col(nth) - 1).cast("long")).drop(row, part, nth, start, *keys)
