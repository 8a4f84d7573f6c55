"""Keyed tables: upserts, snapshots, first-seen and tiered dedup, quotas and caps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def validated(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """``df`` with ``violations``: the names of the constraints that a row breaks. A constraint
    that is null is broken."""
    broken = [F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in rules]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The union by key, new rows winning, with ``changed``: whether anything differs."""
    rest = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*rest).alias("_old"))
    b = new.select(key, F.struct(*rest).alias("_new"))
    joined = a.join(b, key, "full")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
    row = F.coalesce("_new", "_old")
    return joined.select(key, *[row[c].alias(c) for c in rest], changed.alias("changed"))


def latest(df: DataFrame, keys: list[str], order: Sequence[Column], kept: dict[str, str] | None = None) -> DataFrame:
    """The last row of each key; columns of ``kept`` keep the value of the first row, by a sort
    column. A top-1 window, which Spark prunes before the shuffle."""
    last = Window.partitionBy(*keys).orderBy(*order)
    if kept:
        for column, by in kept.items():
            df = df.withColumn(column, F.min_by(column, by).over(Window.partitionBy(*keys)))
    return df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def insert_if_absent(events: DataFrame, target: DataFrame, key: str, order: str) -> DataFrame:
    """The first event of each key that the target doesn't have."""
    fresh = events.join(target.select(key), key, "left_anti")
    row = F.min_by(F.struct(*events.columns), order)
    return fresh.groupBy(F.col(key).alias("_k")).agg(row.alias("_r")).select("_r.*")


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """``df`` with ``is_duplicate`` and ``duplicate_of``, the first row's ``order`` value. One
    partial aggregate and a join, so a very common value is no task of its own."""
    firsts = df.groupBy(value).agg(F.min(order).alias("_first"))
    named = firsts.select(F.col(value).alias("_value"), "_first")
    out = df.join(named, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
    later = F.col(order) != F.col("_first")
    return out.withColumns({"is_duplicate": later, "duplicate_of": F.when(later, F.col("_first"))}).drop("_first")


def tiered_dedup(df: DataFrame, tier: str, row_id: str, digest: str) -> DataFrame:
    """One row of each id, then of each digest: of the best tier, then the smallest id."""
    best = lambda t, k: t.groupBy(F.col(k).alias("_k")).agg(
        F.min_by(F.struct(*df.columns), F.struct(tier, row_id)).alias("_r")
    ).select("_r.*")
    return best(best(df, row_id), digest)


def quota(df: DataFrame, group: str, quotas: DataFrame, order: Sequence[Column], cap: int | None = None) -> DataFrame:
    """Per group its quota's rows in order; over all, the first ``cap`` by priority and rank.
    ``quotas`` has group, quota and priority."""
    q = quotas.select(F.col(group).alias("_g"), "quota", "priority")
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    out = ranked.join(q, F.col(group) == F.col("_g")).filter(F.col("rank") <= F.col("quota")).drop("_g")
    return out.orderBy("priority", "rank", *order).limit(cap) if cap is not None else out


def reserve_then_fill(df: DataFrame, group: str, targets: DataFrame, extra: int, total: int, within: Sequence[Column], over: Sequence[Column]) -> DataFrame:
    """Each group's target and ``extra`` more, by the order ``within`` a group and the priority of
    groups, then the best of all the rest by the order ``over`` them, ``total`` in all. ``targets``
    has group, target and priority; a group without one has nothing reserved."""
    t = targets.select(F.col(group).alias("_g"), "target", "priority")
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*within))).join(t, F.col(group) == F.col("_g"), "left")
    reserved = F.coalesce(F.col("_n") <= F.col("target") + extra, F.lit(False))
    place = [F.col("reserved").desc(), F.when(F.col("reserved"), F.col("priority")), F.when(F.col("reserved"), F.col("_n")), *over]
    return ranked.withColumn("reserved", reserved).orderBy(*place).limit(total).drop("_g", "_n", "target", "priority")


def predicate_quotas(df: DataFrame, predicates: Sequence[tuple[Column, int]], order: Sequence[Column], total: int) -> DataFrame:
    """Rows taken by the predicates' quotas in turn, best first by ``order``, which no two rows share:
    each takes what it still lacks, and a row taken for an earlier one counts for all that it meets.
    Then the best of the rest up to ``total`` in all. ``reason`` is the predicate's number, null for
    what fills.

    Which predicates a row meets is a bit mask. Of each mask only the best rows that quotas or the fill
    could take matter, ``total`` and all quotas together at most, so what is settled are those few; a
    window over masks is cut to them before rows are shuffled.
    """
    bits = F.lit(0)
    for i, (p, _) in enumerate(predicates):
        bits = bits + F.when(p, 1 << i).otherwise(0)
    most = total + sum(n for _, n in predicates)
    marked = df.withColumn("_mask", bits).withColumn("_nth", F.row_number().over(Window.partitionBy("_mask").orderBy(*order))).filter(F.col("_nth") <= most)
    held = marked.withColumn("reason", F.lit(None).cast("int"))
    for i, (_, n) in enumerate(predicates):
        meets, free = F.col("_mask").bitwiseAND(1 << i) != 0, F.col("reason").isNull()
        everyone = Window.partitionBy(meets)  # of the few candidates
        taken = F.count(F.when(~free, 1)).over(everyone)
        place = F.row_number().over(Window.partitionBy(meets, free).orderBy(*order))
        held = held.withColumns({"_taken": taken, "_place": place}).withColumn("reason", F.when(free & meets & (F.col("_place") <= n - F.col("_taken")), i).otherwise(F.col("reason")))
    used = F.count(F.when(F.col("reason").isNotNull(), 1)).over(Window.partitionBy(F.lit(1)))
    rest = F.row_number().over(Window.partitionBy(F.col("reason").isNull()).orderBy(*order))
    out = held.withColumns({"_taken": used, "_place": rest})
    return out.filter(F.col("reason").isNotNull() | (F.col("_place") <= total - F.col("_taken"))).drop("_mask", "_nth", "_taken", "_place")


def stratified_sample(df: DataFrame, stratum: str, key: str, score: str, flags: str, quotas: Mapping[str, int], least: Mapping[str, int]) -> DataFrame:
    """(stratum, key): each stratum's ``quotas`` rows of the highest score, changed until enough of
    them have each flag of ``least``, in their order. A change puts the best row with the flag in the
    place of its stratum's worst without it, the cheapest changes first.

    The n-th change of a stratum is always its n-th best row with the flag outside the sample for its
    n-th worst row without it in there, and costs more with n. So for a flag, rows in and out of the
    sample are ranked by stratum, the n-th are paired, and the cheapest pairs up to the number that is
    missing change places: a join and two windows a flag, over no more rows than quotas and the whole
    sample's size for each flag and stratum. Of rows at one score the one of the smaller key
    leaves and comes in first; of changes at one cost, that of the stratum that quotas name first.
    """
    size = sum(quotas.values())
    best = [F.col("_score").desc(), F.col("_key")]
    wanted = F.create_map(*[F.lit(x) for item in quotas.items() for x in item])
    turn = F.create_map(*[F.lit(x) for i, s in enumerate(quotas) for x in (s, i)])
    rank = lambda *by: F.row_number().over(Window.partitionBy("_stratum", *by).orderBy(*best))
    rows = df.select(F.col(stratum).alias("_stratum"), F.col(key).alias("_key"), F.col(score).alias("_score"), *[F.coalesce(F.col(flags)[f], F.lit(False)).alias(f"_f{i}") for i, f in enumerate(least)])
    rows = rows.filter(F.col("_stratum").isin(list(quotas))).withColumn("_n", rank())
    useful = F.col("_n") <= wanted[F.col("_stratum")]
    for i in range(len(least)):
        rows = rows.withColumn(f"_n{i}", rank(f"_f{i}"))
        useful = useful | (F.col(f"_f{i}") & (F.col(f"_n{i}") <= 2 * size))
    held = written(rows.withColumn("_in", F.col("_n") <= wanted[F.col("_stratum")]).filter(useful), "sample-candidates")
    for i, enough in enumerate(least.values()):
        flag, inside = F.col(f"_f{i}"), F.col("_in")
        leaves = held.filter(inside & ~flag).withColumn("_at", F.row_number().over(Window.partitionBy("_stratum").orderBy("_score", "_key")))
        comes = held.filter(~inside & flag).withColumn("_at", rank())
        pairs = leaves.select("_stratum", "_at", F.col("_key").alias("_leaves"), F.col("_score").alias("_lost")).join(
            comes.select("_stratum", "_at", F.col("_key").alias("_comes"), (F.col("_score")).alias("_won")), ["_stratum", "_at"])
        gain = F.col("_won") - F.col("_lost")
        missing = held.agg((enough - F.count(F.when(inside & flag, 1))).alias("_missing"))
        # the pairs are no more than the sample is large
        cheapest = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(gain.desc(), turn[F.col("_stratum")], "_at"))
        swapped = pairs.withColumn("_m", cheapest).join(missing, F.col("_m") <= F.col("_missing")).select("_leaves", "_comes")
        gone, new = (swapped.select(F.col(c).alias("_k")) for c in ("_leaves", "_comes"))
        moved = held.join(gone.withColumn("_out", F.lit(True)), F.col("_key") == F.col("_k"), "left").drop("_k")
        moved = moved.join(new.withColumn("_new", F.lit(True)), F.col("_key") == F.col("_k"), "left").drop("_k")
        held = written(moved.withColumn("_in", (inside & F.col("_out").isNull()) | F.col("_new").isNotNull()).drop("_out", "_new"), "sample")
    return held.filter("_in").select(F.col("_stratum").alias(stratum), F.col("_key").alias(key))


def cap_per_key(df: DataFrame, key: str, most: int, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``over_cap``: true beyond the best ``most`` of a key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("over_cap", n > most)


def duplicate_groups(df: DataFrame, value: str, row_id: str) -> DataFrame:
    """Values that more than one id has, with how many and the smallest and largest id."""
    groups = df.groupBy(value).agg(
        F.count_distinct(row_id).alias("n_ids"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id")
    )
    return groups.filter("n_ids > 1")


def value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group, "value=count" pairs in order of value: a map as text."""
    each = df.groupBy(group, value).count()
    pair = F.struct(F.col(value), F.concat_ws("=", value, F.col("count").cast("string")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), ",")
    return each.groupBy(group).agg(joined.alias("counts"))
