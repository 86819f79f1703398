"""Sharding by a hierarchical weighted hash tree (operator 9).

A key descends region, rack and shard. At each level every child draws an exponential variate from a hash of the
key and the child's name, at a rate equal to the child's weight (the sum of the weights below it); the least draw
wins. When weights change, a child's draw only moves for the better or the worse if its own weight changed, so rows
move only into subtrees that grew or out of subtrees that shrank. ``grow`` opens a new region for the new shard, so
that every row that moves lands in the new shard.

Cases: a null key is hashed as a value of its own; equal keys share a shard; an empty table gives an empty result;
a null or empty text has size 1 and checksum 0; further columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.offsets import running_totals


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def tree(shards: int, racks_a_region: int = 2, shards_a_rack: int = 2) -> list[Shard]:
    """``shards`` shards of equal weight, filled rack by rack and region by region."""
    per = racks_a_region * shards_a_rack
    return [Shard(s, s // per, s % per // shards_a_rack) for s in range(shards)]


def grow(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region of its own: the only subtree whose weight changes, so only it takes rows."""
    return [*shards, Shard(max((s.shard for s in shards), default=-1) + 1, max((s.region for s in shards), default=-1) + 1, 0, weight)]


def _least_draw(key: Column, level: Column, children: Column, weights: Column) -> Column:
    """Of ``children``, with ``weights`` above 0: the one with the least exponential variate, by a hash of key, level and child."""

    def draw(child: Column, weight: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, level, child), 11)
        return F.struct((-F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))) / weight).alias("draw"), child.alias("child"))

    return F.array_min(F.zip_with(children, weights, draw))["child"]


def place(key: Column, shards: list[Shard]) -> Column:
    """The shard of ``key``. Weights of 0 take nothing; at least one has to be above 0.

    The tree is held in arrays, a level each, so the expression is of one size for any number of shards, and a key draws
    only among the children of what it has chosen.
    """
    live = sorted((s for s in shards if s.weight > 0), key=lambda s: (s.region, s.rack, s.shard))
    if not live:
        raise ValueError("no shard has a weight above 0")
    racks = [list(g) for _, g in groupby(live, key=lambda s: (s.region, s.rack))]
    regions = [list(g) for _, g in groupby(racks, key=lambda k: k[0].region)]
    weight = lambda rack: sum(s.weight for s in rack)

    def below(groups: list[list]) -> tuple[Column, Column]:
        """Where each one's children start, from 1, and their number."""
        sizes = [len(g) for g in groups]
        return F.lit([1 + x for x in accumulate([0, *sizes[:-1]])]), F.lit(sizes)

    region_ids, region_weights = [r[0][0].region for r in regions], [float(sum(map(weight, r))) for r in regions]
    region = _least_draw(key, F.lit("region"), F.lit(region_ids), F.lit(region_weights))
    out = _Chosen(region, region_ids, below(regions))
    rack_ids, rack_weights = [k[0].rack for k in racks], [float(weight(k)) for k in racks]
    rack = _least_draw(key, F.concat(F.lit("rack of "), region.cast("string")), out.children(rack_ids), out.children(rack_weights))
    at = out.start() + F.array_position(out.children(rack_ids), rack).cast("int") - 1
    starts, sizes = below(racks)
    cut = lambda values: F.slice(F.lit(values), F.element_at(starts, at), F.element_at(sizes, at))
    level = F.concat(F.lit("shard of "), region.cast("string"), F.lit("."), rack.cast("string"))
    return _least_draw(key, level, cut([s.shard for s in live]), cut([float(s.weight) for s in live])).cast("int")


@dataclass(frozen=True)
class _Chosen:
    """The chosen one of ``ids``, and where its children lie in the level below."""

    child: Column
    ids: list[int]
    below: tuple[Column, Column]

    def _at(self, values: Column) -> Column:
        return F.element_at(values, F.array_position(F.lit(self.ids), self.child).cast("int"))

    def start(self) -> Column:
        return self._at(self.below[0])

    def children(self, values: list) -> Column:
        return F.slice(F.lit(values), self.start(), self._at(self.below[1]))


def shard(rows: DataFrame, key: str, shards: list[Shard], rows_a_bucket: int = 50_000) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the row's gapless place in its shard from 0.

    Slots come from running totals over hash buckets, at least 64 a shard and more as the table grows, so no task
    holds a whole shard. Columns named shard and slot are replaced. ``rows`` is read three times (once to count) and should be narrow.
    """
    rows = rows.drop("shard", "slot")
    buckets = max(64, rows.count() // (rows_a_bucket * len(shards)) + 1)
    cut = rows.withColumn("shard", place(F.col(key), shards))
    order = [key, *sorted(c for c in rows.columns if c != key)]
    return running_totals(cut, "shard", order, F.lit(1), buckets, "slot")


def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    shards = tree(8)
    out = shard(docs, "doc_id", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", place(F.col("doc_id"), grow(shards)).alias("grown_shard"))


QUERIES = {"op9_hash_tree": op9_hash_tree}
SQL: dict[str, str] = {}
