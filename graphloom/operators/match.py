"""Matching two labelled sides: an exact join, and a similarity join over blocks of anchor trigrams and lengths.

All work is done on distinct labels with the number of entities that have them; entities come back at the end.
``by`` names leading key columns, such as a pair of classes, that keep jobs in one run apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.staging import stage


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.90
    trigram_threshold: float = 0.60
    anchors: int = 4
    bucket_width: int = 4
    max_comparisons_per_block: int = 1_000_000
    gram_hash: str = "blake2b"

    def __post_init__(self):
        if not 0 <= self.threshold <= 1 or not 0 <= self.trigram_threshold <= 1:
            raise ValueError("thresholds lie between 0 and 1")
        if self.anchors < 1 or self.bucket_width < 1:
            raise ValueError("anchors and bucket_width are at least 1")


def sides(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (by..., side, uri, label)."""
    take = lambda df, side: df.select(*by, F.lit(side).alias("side"), "uri", "label")
    return take(left, "L").unionByName(take(right, "R")).where("uri is not null and label <> ''").distinct()


def label_counts(both: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, nl, nr): entities of each side that have the label."""
    n = lambda side: F.count_if(F.col("side") == side)
    return both.groupBy(*by, "label").agg(n("L").alias("nl"), n("R").alias("nr"))


def exact_pairs(both: DataFrame, cap: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., left, right, score 1) of equal labels; a label with more than ``cap`` pairs is left out."""
    keys = label_counts(both, by).where((F.col("nl") > 0) & (F.col("nr") > 0) & (F.col("nl") * F.col("nr") <= cap)).select(*by, "label")
    left = both.where("side = 'L'").select(*by, "label", F.col("uri").alias("left"))
    right = both.where("side = 'R'").select(*by, "label", F.col("uri").alias("right"))
    return left.join(keys, [*by, "label"], "left_semi").join(right, [*by, "label"]).select(*by, "left", "right", F.lit(1.0).alias("score"))


def blocks(counts: DataFrame, s: Settings, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bucket, gram, label, nl, nr): each label under its anchors and its length's bucket and the two next to it."""
    rows = counts.withColumn("gram", F.explode(T.anchor_grams(F.col("label"), s.anchors, s.gram_hash))).withColumn("b", T.length_bucket(F.col("label"), s.bucket_width))
    rows = rows.withColumn("bucket", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).where("bucket >= 0")
    return rows.select(*by, "bucket", "gram", "label", "nl", "nr")


def block_stats(block_rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bucket, gram, nl, nr): entities with their labels on each side of a block."""
    return block_rows.groupBy(*by, "bucket", "gram").agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))


def _open(stats: DataFrame, s: Settings) -> DataFrame:
    return stats.where((F.col("nl") > 0) & (F.col("nr") > 0) & (F.col("nl") * F.col("nr") <= s.max_comparisons_per_block))


def profiles(counts: DataFrame, s: Settings, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, nl, nr, keys, grams), once a label: its blocks under the cap as sorted hashes, and its trigrams as hashes."""
    rows = blocks(counts, s, by)
    key = [*by, "bucket", "gram"]
    rows = rows.join(_open(block_stats(rows, by), s).select(*key), key, "left_semi")
    found = rows.groupBy(*by, "label").agg(F.first("nl").alias("nl"), F.first("nr").alias("nr"), F.sort_array(F.collect_list(F.xxhash64("bucket", "gram"))).alias("keys"))
    return found.withColumn("grams", F.transform(T.trigrams(F.col("label")), lambda g: F.xxhash64(g)))


def _pairs(labels: DataFrame, s: Settings, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., x, y, n) of ``profiles``: label pairs with lengths and trigrams that allow a match; n: entity pairs, once for each shared block.

    A pair is made in the first of the blocks that both labels are in, so there are no pairs to tell apart, and the
    conditions run in the join, cheapest first, on numbers that were made once a label.
    """
    cut = lambda side, n, x, k: labels.where(f"{side} > 0").select(*by, F.explode("keys").alias("key"), F.col("label").alias(x), F.col(side).alias(n), F.col("keys").alias(f"k{k}"), F.col("grams").alias(f"g{k}"))
    shared = F.array_intersect("k1", "k2")
    once = F.array_min(shared) == F.col("key")
    near = T.trigram_dice(F.col("g1"), F.col("g2")) >= F.lit(s.trigram_threshold)
    pairs = cut("nl", "n1", "x", 1).join(cut("nr", "n2", "y", 2), [*by, "key"]).where(T.length_possible(F.col("x"), F.col("y"), s.threshold) & once & near)
    return pairs.select(*by, "x", "y", (F.col("n1") * F.col("n2") * F.size(shared)).alias("n"))


def candidates(counts: DataFrame, s: Settings, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (by..., x, y): label pairs that share a block, with lengths and trigrams that allow a match."""
    return _pairs(stage(profiles(counts, s, by)), s, by).drop("n")


def label_matches(counts: DataFrame, s: Settings, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., x, y, score) of label pairs at or above the threshold."""
    scored = candidates(counts, s, by).withColumn("score", T.similarity(F.col("x"), F.col("y")))
    return scored.where(F.col("score") >= F.lit(s.threshold))


def fuzzy_pairs(both: DataFrame, s: Settings, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., left, right, score) of entities whose labels match."""
    found = label_matches(label_counts(both, by), s, by)
    left = both.where("side = 'L'").select(*by, F.col("label").alias("x"), F.col("uri").alias("left"))
    right = both.where("side = 'R'").select(*by, F.col("label").alias("y"), F.col("uri").alias("right"))
    return found.join(left, [*by, "x"]).join(right, [*by, "y"]).select(*by, "left", "right", "score")


def best_scores(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by, "left", "right").agg(F.max("score").alias("score"))


def align(left: DataFrame, right: DataFrame, settings: Settings = Settings(), by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., left, right, score): every pair of entities that match, exactly or nearly, with the best score of its labels.

    ``left`` and ``right``: (by..., uri, label) with normalised labels. A pair is found if any of its blocks is under the cap.
    """
    both = stage(sides(left, right, by))
    exact = exact_pairs(both, settings.max_comparisons_per_block, by)
    return best_scores(exact.unionByName(fuzzy_pairs(both, settings, by)), by)


def align_metrics(left: DataFrame, right: DataFrame, s: Settings = Settings(), by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., stage, blocks, comparisons, scored, matches): one-sided blocks count as blocks; blocks above the cap count all their pairs as comparisons; a pair counts in each of its blocks."""
    counts = stage(label_counts(sides(left, right, by), by))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    product = F.col("nl").cast("long") * F.col("nr")
    under = F.when(product <= s.max_comparisons_per_block, product).otherwise(F.lit(0))
    exact = counts.groupBy(*by).agg(F.count("*").alias("blocks"), total(product).alias("comparisons"), F.lit(0).cast("long").alias("scored"), total(under).alias("matches")).withColumn("stage", F.lit("exact"))
    stats = block_stats(blocks(counts, s, by), by)
    seen = stats.groupBy(*by).agg(F.count("*").alias("blocks"), total(product).alias("comparisons"))
    pairs = _pairs(stage(profiles(counts, s, by)), s, by)
    pairs = pairs.withColumn("score", T.similarity(F.col("x"), F.col("y")))
    tried = pairs.groupBy(*by).agg(total("n").alias("scored"), total(F.when(F.col("score") >= F.lit(s.threshold), F.col("n"))).alias("matches"))
    one = lambda df: df if by else df.withColumn("_one", F.lit(1))  # noqa: E731  without keys: one row each
    fuzzy = one(seen).join(one(tried), list(by) or "_one", "left").na.fill(0).withColumn("stage", F.lit("fuzzy"))
    names = [*by, "stage", "blocks", "comparisons", "scored", "matches"]
    return exact.select(*names).unionByName(fuzzy.select(*names))
