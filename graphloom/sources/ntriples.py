"""N-Triples: the strict reader for matching, the lenient one for rewriting, and the label writer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import WHITE, strip
from .files import publish

RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
#: N-Triples' escapes of one character, and the apostrophe; another escaped character stands for itself.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_STRING = re.compile(r'"((?:[^"\\]++|\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[^uU]))*+)"', re.DOTALL)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_SURROGATE = re.compile("[\ud800-\udfff]")


def decode_literal(token: str) -> str | None:
    """The text of the quoted string at the start of a token; None where there is none, or an escape in it names no character."""
    string = _STRING.match(token)
    if string is None:
        return None
    try:
        text = _ESCAPE.sub(lambda e: ESCAPES.get(e[3], e[3]) if e[3] else chr(int(e[1] or e[2], 16)), string[1])
    except (ValueError, OverflowError):  # beyond the last code point
        return None
    return None if _SURROGATE.search(text) else text


@F.pandas_udf(StringType())
def _decode(tokens: pd.Series) -> pd.Series:
    return tokens.map(decode_literal, na_action="ignore")


def literal(token: Column) -> Column:
    """Text of a literal token; only those with a backslash go through Python."""
    escaped = F.contains(token, F.lit("\\"))
    close = F.locate('"', token, 2)
    plain = F.substring(token, F.lit(2), close - 2)
    return F.when(~token.startswith('"'), F.lit(None)).when(escaped, _decode(F.when(escaped, token))).when(close > 0, plain)


def iri(token: Column) -> Column:
    """The IRI of a ``<...>`` token."""
    return F.when(token.startswith("<") & token.endswith(">"), F.substring(token, F.lit(2), F.char_length(token) - 2))


def read_lines(spark: SparkSession, path: str | list[str], newlines: str | None = "\n") -> DataFrame:
    """``value``, invalid UTF-8 replaced; ``newlines=None``: of any kind."""
    reader = spark.read if newlines is None else spark.read.option("lineSep", newlines)
    return reader.text(path).select(F.make_valid_utf8(F.col("value")).alias("value"))


def parse_triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(s, p, o_raw, o_iri, o_lex, o_lang, o_dt)`` of the lines that are triples with IRIs for subject and predicate.

    The first ``"> "`` ends an IRI; the object is what stands before the full stop at the end. Each step cuts its columns from
    those of the step before, by string functions. The rows are told by a generator at the end, not by filters, which the
    optimiser would move below the steps, with a copy of all of them for each column that they read.
    """
    white = F.lit(WHITE)
    rows = lines.select(strip(F.col(column)).alias("line"))
    rows = rows.select((F.col("line").startswith("<") & F.col("line").endswith(".")).alias("ok"), F.rtrim(F.substring("line", F.lit(1), F.char_length("line") - 1), white).alias("rest"))
    rows = rows.select("ok", "rest", F.instr("rest", "> ").alias("end"))
    rows = rows.select((F.col("ok") & (F.col("end") > 1)).alias("ok"), F.substring("rest", F.lit(2), F.col("end") - 2).alias("s"), F.ltrim(F.substring("rest", F.col("end") + 2, F.char_length("rest")), white).alias("rest"))
    rows = rows.select("ok", "s", "rest", F.instr("rest", "> ").alias("end"))
    rows = rows.select(
        (F.col("ok") & F.col("rest").startswith("<") & (F.col("end") > 1)).alias("ok"), "s", F.substring("rest", F.lit(2), F.col("end") - 2).alias("p"),
        F.ltrim(F.substring("rest", F.col("end") + 2, F.char_length("rest")), white).alias("o_raw"),
    )
    rows = rows.select(F.inline(F.when(F.col("ok") & (F.col("o_raw") != ""), F.array(F.struct("s", "p", "o_raw")))))
    tail = F.regexp_extract("o_raw", r'(?s)^"(?:[^"\\]|\\.)*+"(.*)$', 1)
    none = lambda c: F.when(c != "", c)
    return rows.select(
        "s", "p", "o_raw", iri(F.col("o_raw")).alias("o_iri"), literal(F.col("o_raw")).alias("o_lex"),
        none(F.regexp_extract(tail, r"^@([A-Za-z]+(?:-[A-Za-z0-9]+)*)", 1)).alias("o_lang"), none(F.regexp_extract(tail, r"^\^\^<([^>]*)>", 1)).alias("o_dt"),
    )


def read_triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_triples(read_lines(spark, path))


def label_triple(iri_: Column, label: Column, predicate: str = RDFS_LABEL) -> Column:
    """``<iri> <predicate> "label" .`` with JSON escapes."""
    quoted = F.regexp_replace(F.to_json(F.array(label)), r"(?s)^\[(.*)\]$", "$1")
    return F.concat(F.lit("<"), iri_, F.lit(f"> <{predicate}> "), quoted, F.lit(" ."))


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    publish(df.sparkSession, path, lambda made: df.select(F.col(column).alias("value")).write.text(made))
