"""Groups of neighbouring rows by their sizes, for keys with any number of rows.

A group takes rows until it has ``most``, or has ``least`` and would go over ``most`` by the next one;
the next group starts ``overlap`` rows before its end, and a row later than itself at least. Over the
running sums of a key's sizes, the end of a group that starts at a row is where two thresholds are
first passed, so it is looked up and nothing is added row by row.

A key's rows are cut into parts. What a part needs to know of the rows before it is how much the open
group has, up to ``most``, and how many rows, up to one over the overlap: a few thousand states. So a
part is a table from the state it is entered in to the state it is left in. Tables of neighbouring
parts compose; the states in which the parts are entered come from a walk over at most FAN tables at a
time, level by level; then every part gives its own groups. No task holds more than FAN tables or
the rows of some parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordered import running

#: Rows of a part, and tables that one task composes.
PART, FAN = 4096, 256
_TABLE = "_key {kind}, _part long, to array<int>, start array<long>, made array<long>"


@dataclass(frozen=True)
class Rule:
    least: int
    most: int
    overlap: int

    @property
    def width(self) -> int:
        return self.overlap + 2

    @property
    def states(self) -> int:
        return (self.most + 1) * self.width

    def state(self, total: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.minimum(total, self.most) * self.width + np.minimum(rows, self.overlap + 1)


class Part:
    """One part's rows with the last ones before it. Places count from the part's first row."""

    def __init__(self, rule: Rule, sizes: np.ndarray, before: np.ndarray):
        self.rule, self.behind, self.n = rule, len(before), len(sizes)
        self.sums = np.concatenate([[0], np.cumsum(np.concatenate([before, sizes]))])
        self.sums -= self.sums[self.behind]
        starts = np.arange(-self.behind, self.n)
        self.ends = self.end(self.sums[:-1], starts + 1)
        self.next = np.maximum(starts + 1, self.ends - rule.overlap)

    def end(self, base: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where groups end whose sums start at ``base``, at ``first`` or later; ``n`` if not here."""
        reached = np.searchsorted(self.sums, base + self.rule.most)
        enough = np.searchsorted(self.sums, base + self.rule.least)
        over = np.searchsorted(self.sums, base + self.rule.most, "right") - 1
        return np.minimum(np.maximum(np.minimum(reached, np.maximum(enough, over)) - self.behind, first), self.n)

    def entered(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, next start) of the group that is open where the part starts."""
        total, rows = state // self.rule.width, state % self.rule.width
        end = self.end(-total, np.where(rows == 0, 1, 0))
        own = np.where(rows > self.rule.overlap, -self.rule.overlap - 1, -rows)
        return end, np.maximum(own + 1, end - self.rule.overlap)

    def table(self, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per state of entry: the state of leaving, where the group open then starts (-1: where the
        one open at entry does), and how many groups ended."""
        n, behind = self.n, self.behind
        to, start, made = (np.zeros(behind + n, np.int64) for _ in range(3))
        places = np.arange(-behind, n)
        open_ = self.ends >= n
        to[open_] = self.rule.state(self.sums[-1] - self.sums[:-1][open_], n - places[open_])
        start[open_] = places[open_] + offset
        for i in np.flatnonzero(~open_)[::-1].tolist():
            j = self.next[i] + behind
            to[i], start[i], made[i] = to[j], start[j], made[j] + 1
        state = np.arange(self.rule.states)
        end, following = self.entered(state)
        at = np.minimum(following + behind, behind + n - 1)
        stays = end >= n
        left = self.rule.state(state // self.rule.width + self.sums[-1], state % self.rule.width + n)
        return np.where(stays, left, to[at]), np.where(stays, -1, start[at]), np.where(stays, 0, made[at] + 1)

    def groups(self, state: int, start: int, made: int, offset: int, last: bool) -> Iterator[tuple[int, int, int]]:
        """(number, start, end) of the groups that end here; the one left open ends with the last part."""
        end, following = (int(x) for x in self.entered(np.array(state)))
        while end < self.n:
            yield made, start, offset + end
            made, start = made + 1, offset + following
            at = following + self.behind
            end, following = int(self.ends[at]), int(self.next[at])
        if last and start < offset + self.n:
            yield made, start, offset + self.n


def _walk(rows: pa.Table, entry: tuple[int, int, int]) -> Iterator[tuple[int, tuple[int, int, int]]]:
    """(part, state of entry) along tables in order of parts, and at last (-1, state of leaving)."""
    order = np.argsort(rows.column("_part").to_numpy(), kind="stable")
    state, start, made = entry
    for i in order.tolist():
        yield rows.column("_part")[i].as_py(), (state, start, made)
        to, begins, more = (rows.column(c)[i].values for c in ("to", "start", "made"))
        begin = begins[state].as_py()
        state, start, made = to[state].as_py(), start if begin < 0 else begin, made + more[state].as_py()
    yield -1, (state, start, made)


def _composed(tables: DataFrame, kind: str) -> DataFrame:
    """A table for each FAN parts."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("_part").to_numpy(), kind="stable").tolist()
        state = np.arange(len(rows.column("to")[0]))
        start, made = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
        for i in order:
            to, begins, more = (rows.column(c)[i].values.to_numpy() for c in ("to", "start", "made"))
            start, made = np.where(begins[state] < 0, start, begins[state]), made + more[state]
            state = to[state]
        part = rows.column("_part")[order[0]].as_py() // FAN
        arrays = [pa.array([x.tolist()], t) for x, t in ((state, pa.list_(pa.int32())), (start, pa.list_(pa.int64())), (made, pa.list_(pa.int64())))]
        return pa.table([rows.column("_key").slice(0, 1), pa.array([part], pa.int64()), *arrays], ["_key", "_part", "to", "start", "made"])

    return tables.groupBy("_key", F.floor(F.col("_part") / FAN).alias("_up")).applyInArrow(run, _TABLE.format(kind=kind))


def _entries(tables: DataFrame, kind: str, most: int) -> DataFrame:
    """(_key, _part, state, begin, made): how each part is entered. ``most`` is the largest part."""
    schema = f"_key {kind}, _part long, state long, begin long, made long"
    above = None
    if most >= FAN:
        upper = written(_composed(tables, kind), "fold-tables")
        above = _entries(upper, kind, most // FAN).select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), F.struct("state", "begin", "made").alias("_entry"))
    held = tables.withColumn("_up", F.floor(F.col("_part") / FAN))
    held = held.withColumn("_entry", F.lit(None).cast("struct<state: long, begin: long, made: long>")) if above is None else (
        held.join(above, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_up") == F.col("_p"))).drop("_k", "_p"))

    def run(rows: pa.Table) -> pa.Table:
        entry = rows.column("_entry")[0].as_py()
        walked = list(_walk(rows, (entry["state"], entry["begin"], entry["made"]) if entry else (0, 0, 0)))[:-1]
        keys = rows.column("_key").slice(0, 1).take(pa.array([0] * len(walked)))
        columns = [pa.array([p for p, _ in walked], pa.int64()), *[pa.array([e[i] for _, e in walked], pa.int64()) for i in range(3)]]
        return pa.table([keys, *columns], ["_key", "_part", "state", "begin", "made"])

    return held.groupBy("_key", "_up").applyInArrow(run, schema)


def folded(df: DataFrame, key: str, order: str, size: Column, rule: Rule, whole: int = 0) -> DataFrame:
    """The rows of ``df`` with ``group``, from 0 in each key; a row in several groups comes as often. A
    key whose sizes sum to less than ``whole`` is one group. ``order`` is unique in a key; sizes are
    whole numbers of 0 or more, null being 0; a null key is a key like any other."""
    sized = F.coalesce(size, F.lit(0)).cast("long")
    placed = written(running(df.withColumn("_s", sized), key, [F.col(order)], F.col("_s"), "_place", "_before"), "fold-rows")
    kind = df.schema[key].dataType.simpleString()
    part = F.floor(F.col("_place") / PART)
    sums = placed.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_s").alias("_total"))
    cells = placed.groupBy(F.col(key).alias("_key"), part.alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_place", "_s")))["_s"].alias("sizes"))
    if rule.overlap:
        tails = cells.select(F.col("_key").alias("_k"), (F.col("_part") + 1).alias("_p"), F.expr(f"slice(sizes, greatest(1, size(sizes) - {rule.overlap - 1}), {rule.overlap})").alias("behind"))
        cells = cells.join(tails, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left").drop("_k", "_p")
    else:
        cells = cells.withColumn("behind", F.lit(None).cast("array<long>"))
    cells = written(cells.join(sums.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k"))).drop("_k"), "fold-parts")

    def tables(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                at = b.column("_part")[i].as_py()
                to, start, made = _part(b, i, rule).table(at * PART)
                arrays = [pa.array([x.tolist()], t) for x, t in ((to, pa.list_(pa.int32())), (start, pa.list_(pa.int64())), (made, pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([b.column("_key").slice(i, 1), pa.array([at], pa.int64()), *arrays], ["_key", "_part", "to", "start", "made"])

    def groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            of, out = [], []
            for i, (at, n, total, state, begin, made) in enumerate(zip(*[b.column(c).to_pylist() for c in ("_part", "_n", "_total", "state", "begin", "made")])):
                if total < whole:
                    found = [(0, 0, n)] if at == 0 else []
                else:
                    last = (at + 1) * PART >= n
                    found = list(_part(b, i, rule).groups(state or 0, begin or 0, made or 0, at * PART, last))
                of += [i] * len(found)
                out += found
            columns = [pa.array([x[j] for x in out], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(of, pa.int64())), *columns], ["_k", "group", "_first", "_end"])

    most = cells.agg(F.max("_part")).first()[0] or 0
    long = cells.filter((F.col("_n") > PART) & (F.col("_total") >= whole)).select("_key", "_part", "sizes", "behind")
    if most:
        entries = _entries(written(long.mapInArrow(tables, _TABLE.format(kind=kind)), "fold-tables"), kind, most)
        entries = entries.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), "state", "begin", "made")
        cells = cells.join(entries, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left").drop("_k", "_p")
    else:
        cells = cells.withColumns({c: F.lit(None).cast("long") for c in ("state", "begin", "made")})
    made = cells.select("_key", "_part", "sizes", "behind", "_n", "_total", "state", "begin", "made").mapInArrow(groups, f"_k {kind}, group long, _first long, _end long")
    each = made.select("_k", "group", F.explode(F.sequence("_first", F.col("_end") - 1)).alias("_p"))
    same = placed[key].eqNullSafe(each["_k"]) & (placed["_place"] == each["_p"])
    return placed.join(each, same).select(*[placed[c] for c in df.columns], F.col("group").cast("int").alias("group"))


def _part(b: pa.RecordBatch, i: int, rule: Rule) -> Part:
    behind = b.column("behind")[i]
    before = behind.values.to_numpy() if behind.is_valid else np.zeros(0, np.int64)
    return Part(rule, b.column("sizes")[i].values.to_numpy(), before)
