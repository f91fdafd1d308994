"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards with weights; a node's weight is the sum of its leaves'.  A row
descends by weighted rendezvous draws: at each level every child draws ``-ln(u) / weight`` from a
hash of the row's key and the child's name, and the smallest draw wins.  A child's draw depends on
nothing but the key, its name and its weight, so a change of one shard's weight moves rows only
between the subtrees that hold it and their siblings, and a new region takes rows only into itself.

Everything is a column expression of the key: no shuffle, no state, no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbers, with_tasks


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


@dataclass(frozen=True)
class HashTree:
    shards: tuple[Shard, ...]

    def __post_init__(self):
        if not self.shards or any(not s.weight > 0 for s in self.shards):
            raise ValueError("a tree needs shards, all with a positive weight")
        if len({s.shard for s in self.shards}) < len(self.shards):
            raise ValueError("two shards have the same number")

    @staticmethod
    def of(n: int, per_rack: int = 2, racks_per_region: int = 2) -> "HashTree":
        """Shards 0 to n - 1 of weight 1, dealt to racks and regions in their order."""
        per_region = per_rack * racks_per_region
        return HashTree(tuple(Shard(i, f"region{i // per_region}", f"rack{i // per_rack}") for i in range(n)))

    def grown(self, weight: float = 1.0) -> "HashTree":
        """One more shard in a region of its own, so that it takes rows only into itself."""
        n = max(s.shard for s in self.shards) + 1
        names = {s.region for s in self.shards}
        name = next(x for x in (f"region-of-{n}" + "+" * i for i in range(len(names) + 1)) if x not in names)
        return HashTree((*self.shards, Shard(n, name, f"rack-of-{n}", weight)))

    def weighted(self, shard: int, weight: float) -> "HashTree":
        return HashTree(tuple(replace(s, weight=weight) if s.shard == shard else s for s in self.shards))


def draw(key: Column, name: str, weight: float) -> Column:
    """Exponential draw of rate ``weight`` from the key and a node's name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double")
    return -F.log((bits + 0.5) / float(1 << 53)) / float(weight)


def winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; equal draws go to the first name."""
    children = sorted(children, key=lambda c: c[0])
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(draw(key, name, weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(children)]
    index = F.least(*draws)["i"]
    out = F.when(index == 0, children[0][2])
    for i, (_, _, value) in enumerate(children[1:], 1):
        out = out.when(index == i, value)
    return out


def shard_of(key: Column, tree: HashTree) -> Column:
    """The number of the shard that a key descends to (int)."""
    levels: dict[str, dict[str, list[Shard]]] = {}
    for s in tree.shards:
        levels.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    weight = lambda shards: sum(s.weight for s in shards)
    regions = []
    for region, racks in levels.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(f"shard/{s.shard}", s.weight, F.lit(s.shard)) for s in shards]
            inner.append((f"rack/{region}/{rack}", weight(shards), winner(key, leaves)))
        regions.append((f"region/{region}", sum(w for _, w, _ in inner), winner(key, inner)))
    return winner(key, regions).cast("int")


def shard_documents(docs: DataFrame, tree: HashTree, grown: HashTree | None = None) -> DataFrame:
    """Every row of (doc_id, text) with its shard, its slot there and its shard after growth.

    size is the text's UTF-8 bytes plus 1 (a null text counts as none), text_crc32 the checksum of those
    bytes.  The key is doc_id alone: rows with the same id, null included, share a shard; repeated rows
    each get a slot of their own.  An empty table gives an empty result.  Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), grown or tree.grown()).alias("grown_shard"),
    )
    return numbers(with_tasks(placed, "placed"), ["shard"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
