"""Merging graphs along links: equivalence classes, canonical IRIs, rewriting, and distinct lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITE
from .components import connected_components


def preference(uri: Column) -> Column:
    """Canonical IRIs are the least by this: without per cent signs, then shorter, then by code points."""
    return F.struct(F.contains(uri, F.lit("%")).alias("percent"), F.char_length(uri).alias("length"), uri.alias("uri"))


def accepted(links: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Links at or above the threshold, NaN too, between different IRIs."""
    return links.where((F.col("score") >= F.lit(threshold)) & (F.col("left") != F.col("right")))


def linked_uris(links: DataFrame) -> DataFrame:
    """Distinct ``uri`` of all links, those below any threshold too."""
    return links.select(F.col("left").alias("uri")).union(links.select("right")).distinct()


def canonical_mapping(links: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(old, canonical) of every linked IRI. Links are transitive; IRIs without an accepted link map to themselves."""
    edges = accepted(links, threshold).select(preference(F.col("left")).alias("a"), preference(F.col("right")).alias("b"))
    roots = connected_components(edges).select(F.col("node.uri").alias("uri"), F.col("root.uri").alias("canonical"))
    return linked_uris(links).join(roots, "uri", "left").select(F.col("uri").alias("old"), F.coalesce("canonical", "uri").alias("canonical"))


def rewrite_lines(lines: DataFrame, mapping: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with subjects and IRI objects replaced by ``mapping(old, canonical)``.

    Predicates, literals and what follows the object stay as they are; lines of another form pass unchanged. Separators
    of rewritten lines become one blank.
    """
    changed = mapping.where("old <> canonical")
    other = [c for c in lines.columns if c != column]
    cut = lambda c, at: F.ltrim(F.substring(F.col(c), at, F.char_length(c)), F.lit(WHITE))
    end = F.instr(column, ">")
    rows = lines.select(*other, column, (F.col(column).startswith("<") & (end > 0)).alias("_ok"), F.substring(column, F.lit(2), end - 2).alias("_s"), cut(column, end + 1).alias("_po"))
    end = F.instr("_po", ">")
    rows = rows.select(*other, column, (F.col("_ok") & F.col("_po").startswith("<") & (end > 0)).alias("_ok"), "_s", F.substring("_po", F.lit(1), end).alias("_p"), cut("_po", end + 1).alias("_o"))
    end = F.instr("_o", ">")
    iri = F.col("_ok") & F.col("_o").startswith("<") & (end > 0)
    rows = rows.select("*", F.when(iri, F.substring("_o", F.lit(2), end - 2)).alias("_oi"), F.when(iri, F.substring("_o", end + 1, F.char_length("_o"))).alias("_tail"))
    # literals have no key to join by; one of their own, which is no IRI, keeps them from meeting in one task
    spread = F.concat(F.lit("> "), F.xxhash64(column).cast("string"))
    rows = rows.withColumn("_js", F.when(F.col("_ok"), F.col("_s")).otherwise(spread)).withColumn("_jo", F.coalesce("_oi", spread))
    rows = rows.join(changed.select(F.col("old").alias("_js"), F.col("canonical").alias("_s2")), "_js", "left")
    rows = rows.join(changed.select(F.col("old").alias("_jo"), F.col("canonical").alias("_o2")), "_jo", "left")
    obj = F.when(F.col("_oi").isNotNull(), F.concat(F.lit("<"), F.coalesce("_o2", "_oi"), F.lit(">"), "_tail")).otherwise(F.col("_o"))
    line = F.concat(F.lit("<"), F.coalesce("_s2", "_s"), F.lit("> "), "_p", F.lit(" "), obj)
    return rows.select(*other, F.when(F.col("_ok"), line).otherwise(F.col(column)).alias(column))


def distinct_lines(*graphs: DataFrame, column: str = "value") -> DataFrame:
    """The union of the graphs' lines, each once. Sorting them by this column is the order of their bytes."""
    out = graphs[0].select(column)
    for g in graphs[1:]:
        out = out.union(g.select(column))
    return out.distinct()


def merge_graphs(graphs: list[DataFrame], links: DataFrame, threshold: float = 0.7) -> DataFrame:
    mapping = canonical_mapping(links, threshold)
    return distinct_lines(*[rewrite_lines(g, mapping) for g in graphs])
