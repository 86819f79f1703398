"""CSV and link tables: class lists, instances, manifests, alignments, mappings."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, file_name, iri_term, pair_id, score_text, strip
from .files import publish
from .ntriples import RDFS_LABEL, label_triple, read_lines, write_lines

SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"
MANIFEST = ["left_iri", "right_iri", "score", "left_file", "right_file"]
FLOAT = r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file with a header, quoted cells of several lines and doubled quotes; an empty cell is an empty string."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path}: missing columns {missing}")
    return df.na.fill("")


def _labelled(df: DataFrame, iri: str, label: str) -> DataFrame:
    return df.select(strip(F.col(iri)).alias("iri"), strip(F.col(label)).alias("label")).where("iri <> '' and label <> ''")


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(iri, label) of ``class,label`` rows in which neither is empty."""
    return _labelled(read_csv(spark, path, ["class", "label"]), "class", "label")


def read_instances(spark: SparkSession, path: str, iri_column: str = "instance", label_column: str = "label") -> DataFrame:
    """(iri, label); an invalid IRI is an error."""
    rows = _labelled(read_csv(spark, path, [iri_column, label_column]), iri_column, label_column)
    return rows.select(F.regexp_extract(iri_term(F.col("iri")), r"(?s)^<(.*)>$", 1).alias("iri"), "label")


def csv_to_triples(spark: SparkSession, source: str, target: str) -> None:
    write_lines(read_classes(spark, source).select(label_triple(F.col("iri"), F.col("label"), RDFS_LABEL).alias("value")), target)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows with their position from 1 and paths taken from the manifest's folder. A manifest names the pairs of classes of one run: one file, read in order."""
    rows = read_csv(spark, path, MANIFEST).select(*MANIFEST).coalesce(1).withColumn("_at", F.monotonically_increasing_id())
    base = str(PurePosixPath(path).parent)
    place = lambda c: F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat(F.lit(base + "/"), F.col(c))).alias(c)
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy("_at")))
    return rows.select("position", "left_iri", "right_iri", "score", place("left_file"), place("right_file"), pair_id(F.col("position"), F.col("left_iri"), F.col("right_iri")).alias("pair_id"))


def _inner(token) -> Column:
    """What a ``<...>`` token holds; null for another one or if that is nothing."""
    return F.when(token.startswith("<") & token.endswith(">") & (F.char_length(token) > 2), F.substring(token, F.lit(2), F.char_length(token) - 2))


def parse_links_strict(lines: DataFrame, column: str = "value") -> DataFrame:
    """(left, right, score) of three fields between white space; comments and blank lines are skipped, all else is an error."""
    rows = lines.select(strip(F.col(column)).alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.select("line", F.split("line", f"{SPACE}+").alias("fields"))
    field = lambda k: F.get("fields", F.lit(k))
    rows = rows.select("line", F.size("fields").alias("n"), _inner(field(0)).alias("left"), _inner(field(1)).alias("right"), field(2).alias("score"))
    good = (F.col("n") == 3) & F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("score").rlike(FLOAT)
    checked = F.when(good, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("malformed link: "), "line")))
    return rows.select(F.inline(F.array(F.struct("left", "right", checked.cast("double").alias("score")))))


def parse_links_lenient(lines: DataFrame, column: str = "value") -> DataFrame:
    """(left, right, score) of tab-separated links and of ``owl:sameAs`` triples or quads (score 1); malformed lines are dropped.

    Three tab-separated fields are never a triple. A triple has at least four fields between white space: the full stop
    stands apart, and what follows the object, as a graph's name, is not read.
    """
    rows = lines.select(strip(F.col(column)).alias("line"))
    rows = rows.select(F.split("line", "\t").alias("tabs"), "line")
    link = F.size("tabs") >= 3
    rows = rows.select(link.alias("link"), F.when(link, F.col("tabs")).otherwise(F.split("line", f"{SPACE}+")).alias("fields"))
    field = lambda k: F.get("fields", F.lit(k))
    same = (F.size("fields") >= 4) & (field(1) == f"<{SAME_AS}>")
    left = F.when(F.col("link"), _inner(strip(field(0)))).when(same, _inner(field(0)))
    right = F.when(F.col("link"), _inner(strip(field(1)))).when(same, _inner(field(2)))
    score = F.when(F.col("link"), strip(field(2))).otherwise(F.lit("1"))
    rows = rows.select(left.alias("left"), right.alias("right"), score.alias("score"))
    rows = rows.select("left", "right", F.when(F.col("score").rlike(FLOAT), F.col("score").try_cast("double")).alias("score"))
    # one row or none of each line, made by a generator: a filter would be computed again below every step
    return rows.select(F.inline(F.when(F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("score").isNotNull(), F.array(F.struct("left", "right", "score")))))


def read_links(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    return parse_links_strict(read_lines(spark, path)) if strict else parse_links_lenient(read_lines(spark, path, None))


def link_line(left: str = "left", right: str = "right", score: str = "score"):
    return F.concat(F.lit("<"), left, F.lit(">\t<"), right, F.lit(">\t"), score_text(F.col(score)))


def write_links(links: DataFrame, path: str) -> None:
    write_lines(links.select(link_line().alias("value")), path)


def manifest(links: DataFrame) -> DataFrame:
    """A row for each pair of classes, with the names of the files that hold their instances."""
    names = [F.concat(F.lit(f"{side}/"), file_name(F.col(side))).alias(f"{side}_file") for side in ("left", "right")]
    return links.select(F.col("left").alias("left_iri"), F.col("right").alias("right_iri"), score_text(F.col("score")).alias("score"), *names)


def write_csv(df: DataFrame, path: str) -> None:
    publish(df.sparkSession, path, lambda made: df.write.csv(made, header=True, escape='"'))


def write_mapping(mapping: DataFrame, path: str) -> None:
    write_lines(mapping.where("old <> canonical").select(F.concat_ws("\t", "old", "canonical").alias("value")), path)
