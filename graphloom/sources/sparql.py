"""SPARQL endpoints as a batch source: one query template, a list of IRIs, pages, and a least interval between requests."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import IRI
from ..plans.staging import stage, unstage
from .files import exists, write_csv_file

MARK = "{{IRI}}"
BINDINGS = "struct<head: struct<vars: array<string>>, results: struct<bindings: array<map<string, struct<type: string, value: string>>>>>"


def read_template(path: str) -> str:
    text = Path(path).read_text(encoding="utf-8").strip()
    if MARK not in text:
        raise ValueError(f"{path}: a query needs {MARK}")
    return text


def decode_bindings(body: Column) -> Column:
    """array<map<string, string>>: a row's variables and values; one that is not bound is an empty string."""
    parsed = F.from_json(body, BINDINGS)
    names = parsed["head"]["vars"]
    return F.transform(parsed["results"]["bindings"], lambda b: F.map_from_arrays(names, F.transform(names, lambda v: F.coalesce(F.try_element_at(b, v)["value"], F.lit("")))))


def term(iri: str) -> str:
    """``<iri>`` for a query; one that would end the term early, or is not an HTTP IRI, is an error."""
    if not re.search(IRI.replace("$", r"\Z"), iri):
        raise ValueError(f"invalid IRI: {iri!r}")
    return f"<{iri}>"


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.endpoint, self.template = options["endpoint"], options["template"]
        self.iris = json.loads(options["iris"])
        self.page, self.interval = int(options.get("pagesize", 10_000)), float(options.get("mininterval", 1.0))
        self.timeout = float(options.get("timeout", 180))
        if self.page < 1:
            raise ValueError("pageSize is at least 1")
        if MARK not in self.template:
            raise ValueError(f"the template needs {MARK}")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # one reader keeps the interval between all requests

    def _ask(self, query: str) -> str:
        request = urllib.request.Request(self.endpoint, urllib.parse.urlencode({"query": query}).encode(), {"Accept": "application/sparql-results+json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return answer.read().decode("utf-8")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        last = None
        for iri in self.iris:
            names, at = None, 0
            query = self.template.replace(MARK, term(iri))
            while True:
                if last is not None and (wait := last + self.interval - time.monotonic()) > 0:
                    time.sleep(wait)
                last = time.monotonic()
                body = self._ask(f"{query}\nLIMIT {self.page} OFFSET {at}")
                parsed = json.loads(body)
                found, rows = parsed.get("head", {}).get("vars") or [], parsed.get("results", {}).get("bindings")
                if not isinstance(rows, list):
                    raise ValueError("not a SPARQL result")
                if not found:
                    raise ValueError(f"{iri}: a result without variables")
                if names is not None and found != names:
                    raise ValueError(f"{iri}: the columns changed between pages")
                names = found
                yield iri, at, found, body
                at += len(rows)
                if len(rows) < self.page:
                    break


class SparqlDataSource(DataSource):
    """``spark.read.format("sparql")`` with options endpoint, template, iris (a JSON list), pageSize, minInterval, timeout."""

    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> str:
        return "iri string, position long, names array<string>, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_pages(spark: SparkSession, endpoint: str, template: str, iris: list[str], page_size: int = 10_000, min_interval: float = 1.0) -> DataFrame:
    """(iri, position of its first row, names, body): a row for each page, also for an empty result."""
    spark.dataSource.register(SparqlDataSource)
    return spark.read.format("sparql").options(endpoint=endpoint, template=template, iris=json.dumps(iris), pageSize=page_size, minInterval=min_interval).load()


def page_rows(pages: DataFrame) -> DataFrame:
    """(iri, position, row) of pages: their bindings, as maps."""
    return pages.select("iri", F.col("position").alias("start"), F.posexplode(decode_bindings(F.col("body"))).alias("k", "row")).select("iri", (F.col("start") + F.col("k")).alias("position"), "row")


def columns(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("iri", "position", *[F.coalesce(F.try_element_at("row", F.lit(n)), F.lit("")).alias(n) for n in names])


@dataclass
class Fetched:
    """What ``fetch`` has done: pairs of classes, IRIs asked for, IRIs that had been there, pages and rows."""

    pairs: int = 0
    asked: int = 0
    there: int = 0
    pages: int = 0
    rows: int = 0


def fetch(links: DataFrame, endpoints: dict[str, str], templates: dict[str, str], output: str, page_size: int = 10_000, min_interval: float = 1.0, force: bool = False) -> Fetched:
    """The instances of both classes of each of ``links(left, right, score)``, in a CSV file for each class, and the manifest ``pairs.csv`` that names them.

    Requests to either endpoint come one after the other, no sooner than ``min_interval`` after the last. A file is there only when
    it is whole, so a run that failed goes on where it ended; ``force`` asks for all again. ``links`` is read row by row.
    """
    spark, done, told, last = links.sparkSession, set(), Fetched(), None
    for row in links.select("left", "right").toLocalIterator():
        told.pairs += 1
        for side in ("left", "right"):
            iri = row[side]
            path = f"{output}/{side}/{hashlib.sha256(iri.encode()).hexdigest()}.csv"
            if path in done or (not force and exists(spark, path)):
                told.there += 1
                continue
            if last is not None and (wait := last + min_interval - time.monotonic()) > 0:
                time.sleep(wait)
            pages = stage(read_pages(spark, endpoints[side], templates[side], [iri], page_size, min_interval))
            last = time.monotonic()  # after the last request of this class
            names = pages.orderBy("position").first()["names"]
            rows = columns(page_rows(pages), names)
            write_csv_file(rows.orderBy("position").select(*names), path)
            told.asked, told.pages, told.rows = told.asked + 1, told.pages + pages.count(), told.rows + rows.count()
            unstage(pages)
            done.add(path)
    return told
