"""Aligning the instances of many pairs of classes in one job, the pair being the leading key of every join and cap."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_label, pair_id, score_text
from ..operators.match import Settings, align
from ..sources.files import delete, exists, move, parts, publish, write_csv_file
from ..sources.tables import link_line, read_instances


def pair_ids(pairs: DataFrame) -> DataFrame:
    """``pairs(position, left_iri, right_iri, ...)`` with ``pair_id``; the position in the manifest is part of it."""
    return pairs.withColumn("pair_id", pair_id(F.col("position"), F.col("left_iri"), F.col("right_iri")))


def align_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, settings: Settings = Settings(), done: DataFrame | None = None) -> DataFrame:
    """(pair_id, left, right, score) of every pair of classes; ``done(pair_id)``: pairs to leave out.

    ``pairs``: (pair_id, left_iri, right_iri); ``left`` and ``right``: instances (class_iri, iri, label).
    """
    if done is not None:
        pairs = pairs.join(done, "pair_id", "left_anti")

    def side(instances: DataFrame, iri: str) -> DataFrame:
        rows = instances.select("class_iri", F.col("iri").alias("uri"), normalize_label(F.col("label")).alias("label")).where("label <> ''")
        return pairs.select("pair_id", F.col(iri).alias("class_iri")).join(rows, "class_iri").select("pair_id", "uri", "label")

    return align(side(left, "left_iri"), side(right, "right_iri"), settings, ("pair_id",))


def pair_results(pairs: DataFrame) -> DataFrame:
    """The index of results: (left_iri, right_iri, score, result_file); the score's text is passed through."""
    return pairs.select("left_iri", "right_iri", F.col("score").cast("string").alias("score"), F.concat(F.lit("pairs/"), "pair_id", F.lit(".tsv")).alias("result_file"))


def class_links(links: DataFrame, threshold: float) -> DataFrame:
    """Links of classes at or above the threshold; a score that is not a number passes."""
    return links.where(F.col("score") >= F.lit(threshold)).withColumn("score_text", score_text(F.col("score")))


def converted(spark: SparkSession, manifest: DataFrame, side: str, output: str, iri_column: str = "instance", label_column: str = "label", force: bool = False) -> DataFrame:
    """(class_iri, iri, label) of all instance files that a manifest names for a side, each converted once into ``output``.

    A manifest is a file that was read in order, so its rows are few enough for the driver to go through.
    """
    paths = []
    for row in manifest.select(F.col(f"{side}_iri").alias("iri"), F.col(f"{side}_file").alias("file")).distinct().toLocalIterator():
        path = f"{output}/{hashlib.sha256(chr(0).join((row['iri'], row['file'], iri_column, label_column)).encode()).hexdigest()}"
        if force or not exists(spark, path):
            rows = read_instances(spark, row["file"], iri_column, label_column).select(F.lit(row["iri"]).alias("class_iri"), "iri", "label")
            publish(spark, path, lambda made, rows=rows: rows.write.parquet(made))
        paths.append(path)
    schema = "class_iri string, iri string, label string"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_pairs(spark: SparkSession, pairs: DataFrame, left: DataFrame, right: DataFrame, output: str, settings: Settings = Settings(), force: bool = False) -> int:
    """Links of every pair of classes, ``pairs/<pair_id>.tsv`` each, all new pairs in one job, and ``pair_results.csv``; returns the number of new pairs."""
    ids = [r["pair_id"] for r in pairs.select("pair_id").toLocalIterator()]
    new = [i for i in ids if force or not exists(spark, f"{output}/pairs/{i}.tsv")]
    if new:
        todo = pairs.select("pair_id", "left_iri", "right_iri").join(spark.createDataFrame([(i,) for i in new], "pair_id string"), "pair_id", "left_semi")
        lines = align_pairs(todo, left, right, settings).select("pair_id", link_line().alias("value"))
        made = f"{output}/pairs.part"
        delete(spark, made)
        lines.repartition("pair_id").write.partitionBy("pair_id").text(made)
        found = {p.rsplit("pair_id=", 1)[1]: p for p in parts(spark, made)}
        nothing = f"{made}/none"
        for i in new:
            if i in found:
                move(spark, parts(spark, found[i])[0], f"{output}/pairs/{i}.tsv")
            else:
                spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(nothing)
                move(spark, parts(spark, nothing)[0], f"{output}/pairs/{i}.tsv")
        delete(spark, made)
    write_csv_file(pair_results(pairs.orderBy("position")), f"{output}/pair_results.csv")
    return len(new)
