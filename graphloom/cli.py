"""Command line: ``python -m graphloom.cli STAGE ...``; a thin layer over the functions."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.match import Settings, align
from .operators.merge import canonical_mapping, distinct_lines, rewrite_lines
from .operators.select import entities
from .plans.pairs import class_links, converted, write_pairs
from .sources import tables
from .sources.files import write_csv_file
from .sources.ntriples import RDFS_LABEL, read_lines, read_triples, write_lines
from .sources.sparql import fetch, read_template


def _settings(p: argparse.ArgumentParser) -> None:
    p.add_argument("--threshold", type=float, default=0.90)
    p.add_argument("--trigram-threshold", type=float, default=0.60)
    p.add_argument("--anchors", type=int, default=4)
    p.add_argument("--bucket-width", type=int, default=4)
    p.add_argument("--max-comparisons-per-block", type=int, default=1_000_000)


def _read(a: argparse.Namespace) -> Settings:
    return Settings(a.threshold, a.trigram_threshold, a.anchors, a.bucket_width, a.max_comparisons_per_block)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom")
    sub = top.add_subparsers(dest="stage", required=True)
    p = sub.add_parser("labels", help="class CSV to label triples")
    p.add_argument("input")
    p.add_argument("output")
    p = sub.add_parser("align", help="two graphs to links")
    for name in ("left-input", "right-input", "left-kg", "right-kg", "out"):
        p.add_argument(f"--{name}", required=True)
    for side in ("left", "right"):
        p.add_argument(f"--{side}-label-predicate", default=RDFS_LABEL)
    _settings(p)
    p = sub.add_parser("fetch", help="links of classes and two endpoints to instance tables and a manifest")
    for name in ("left_endpoint", "right_endpoint", "left_template", "right_template"):
        p.add_argument(name)
    p.add_argument("threshold", type=float)
    p.add_argument("page_size", type=int)
    p.add_argument("links")
    p.add_argument("--output", default="alignment_results")
    p.add_argument("--min-interval", type=float, default=1.0, help="seconds between requests to either endpoint")
    p.add_argument("--force", action="store_true", help="ask again for what is there")
    p = sub.add_parser("pairs", help="instance tables and a manifest to links of every pair of classes")
    p.add_argument("manifest")
    p.add_argument("--output", default="fuzzy_results")
    p.add_argument("--force", action="store_true", help="match again what is there, and read its instances again")
    for side in ("left", "right"):
        p.add_argument(f"--{side}-iri-column", default="instance")
        p.add_argument(f"--{side}-label-column", default="label")
    _settings(p)
    p = sub.add_parser("merge", help="links and graphs to a mapping and rewritten graphs")
    p.add_argument("--links", nargs="+", required=True)
    p.add_argument("--conf", type=float, default=0.7)
    p.add_argument("--out-mapping")
    p.add_argument("--rewrite", nargs="*", default=[])
    p.add_argument("--out-dir", default="rewritten")
    p.add_argument("--one-graph", action="store_true", help="the distinct union of all graphs instead of one output each")
    p = sub.add_parser("distinct", help="sorted distinct lines")
    p.add_argument("input", nargs="+")
    p.add_argument("output")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
    if a.stage == "labels":
        tables.csv_to_triples(spark, a.input, a.output)
    elif a.stage == "align":
        left, right = (entities(read_triples(spark, getattr(a, f"{s}_input")), getattr(a, f"{s}_kg"), getattr(a, f"{s}_label_predicate")) for s in ("left", "right"))
        tables.write_links(align(left, right, _read(a)), a.out)
    elif a.stage == "fetch":
        links = class_links(tables.read_links(spark, a.links, strict=True), a.threshold)
        sides = ("left", "right")
        told = fetch(links, {s: getattr(a, f"{s}_endpoint") for s in sides}, {s: read_template(getattr(a, f"{s}_template")) for s in sides}, a.output, a.page_size, a.min_interval, a.force)
        write_csv_file(tables.manifest(links), f"{a.output}/pairs.csv")
        print(told)
    elif a.stage == "pairs":
        pairs = tables.read_manifest(spark, a.manifest)
        left, right = (converted(spark, pairs, s, f"{a.output}/converted", getattr(a, f"{s}_iri_column"), getattr(a, f"{s}_label_column"), a.force) for s in ("left", "right"))
        print(f"{write_pairs(spark, pairs, left, right, a.output, _read(a), a.force)} new pairs of classes")
    elif a.stage == "merge":
        mapping = canonical_mapping(tables.read_links(spark, a.links), a.conf)
        if a.out_mapping:
            tables.write_mapping(mapping, a.out_mapping)
        graphs = {path: rewrite_lines(read_lines(spark, path, None), mapping) for path in a.rewrite}
        if a.one_graph:
            write_lines(distinct_lines(*graphs.values()), a.out_dir)
        else:
            names = [path.rstrip("/").rsplit("/", 1)[-1] for path in graphs]
            if len(set(names)) < len(names):
                raise ValueError(f"graphs of one name would take each other's place: {sorted(names)}")
            for name, lines in zip(names, graphs.values(), strict=True):
                write_lines(distinct_lines(lines).orderBy("value"), f"{a.out_dir}/{name}")
    else:
        write_lines(distinct_lines(read_lines(spark, a.input)).orderBy("value"), a.output)


if __name__ == "__main__":
    main()
