"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child makes a draw from the row's key
and the child's own name, ``-ln(u) / weight`` with ``u`` uniform in (0, 1), and the smallest draw
wins, which gives each child its share of the weight. A draw depends on nothing but the key, the
child's name and the child's weight. So when weights change, only rows of a level whose children
changed move, and they move within the subtrees whose weights changed; a new child takes rows only
into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import fresh, gapless


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(shards: int, regions: int = 2, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """The tree for a number of shards: a full base tree, and each shard beyond it in a region of
    its own, so that one more shard leaves every old weight as it was."""
    base = regions * racks * per_rack
    if shards < base:
        raise ValueError(f"the base tree has {base} shards")
    leaves = [
        Leaf(f"r{s // (racks * per_rack)}", f"k{s // per_rack % racks}", s) for s in range(base)
    ]
    return leaves + [Leaf(f"x{s}", "k0", s) for s in range(base, shards)]


def _levels(leaves: list[Leaf]) -> dict[str, dict[str, float]]:
    children: dict[str, dict[str, float]] = {}
    for leaf in leaves:
        if leaf.weight < 0:
            raise ValueError("weights can't be negative")
        if leaf.weight == 0:
            continue
        path = "/"
        for name in (leaf.region, leaf.rack, str(leaf.shard)):
            level = children.setdefault(path, {})
            child = f"{path}{name}" + ("/" if name != str(leaf.shard) or path.count("/") < 3 else "")
            level[child] = level.get(child, 0.0) + leaf.weight
            path = child
    if not children:
        raise ValueError("the tree has no weight")
    return children


def _choose(key: Column, children: Column, seed: int) -> Column:
    """The child with the smallest draw of a map from name to weight."""

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), child["key"], key), 12)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / child["value"]).alias("draw"), child["key"].alias("name"))

    return F.array_min(F.transform(F.map_entries(children), draw))["name"]


def assign(df: DataFrame, key: str, leaves: list[Leaf], out: str = "shard", seed: int = 0) -> DataFrame:
    """Add the shard of each row. A null key is a key like any other."""
    tree = F.create_map(
        *[
            x
            for path, level in _levels(leaves).items()
            for x in (
                F.lit(path),
                F.create_map(*[y for name, w in level.items() for y in (F.lit(name), F.lit(w))]),
            )
        ]
    )
    text = F.coalesce(F.col(key).cast("string"), F.lit("\x00null"))
    region, rack, leaf = fresh(df, "region", "rack", "leaf")
    df = df.withColumn(region, _choose(text, F.element_at(tree, F.lit("/")), seed))
    df = df.withColumn(rack, _choose(text, F.element_at(tree, F.col(region)), seed))
    df = df.withColumn(leaf, _choose(text, F.element_at(tree, F.col(rack)), seed))
    shard = F.regexp_extract(leaf, r"(-?\d+)/?$", 1).cast("int")
    return df.withColumn(out, shard).drop(region, rack, leaf)


def shard_rows(
    df: DataFrame, key: str, leaves: list[Leaf], grown: list[Leaf] | None = None, seed: int = 0, rows: int = 20_000
) -> DataFrame:
    """All rows of ``df`` with ``shard``, ``slot`` (gapless from 0 in its shard) and, given a
    second tree, ``grown_shard``.

    Rows with one key, null included, share a shard, whose slots are numbered in parts of about
    ``rows`` rows, however often a key is repeated. Repeated rows get slots of their own. An empty
    table gives an empty table. Columns of ``df`` named like an output are replaced, any others kept.
    """
    df = df.drop("shard", "slot", "grown_shard")
    df = assign(df, key, leaves, "shard", seed)
    if grown is not None:
        df = assign(df, key, grown, "grown_shard", seed)
    return gapless(df, ["shard"], [key], "slot", rows)


def op9_hash_tree_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = shard_rows(rows, "doc_id", topology(16), topology(17))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
