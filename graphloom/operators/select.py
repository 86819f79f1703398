"""Selecting entities by triple patterns, and their labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_label
from ..sources.ntriples import RDFS_LABEL


def _http_iri(token: str) -> str:
    """The HTTP IRI of a pattern's token, which may stand between angle brackets."""
    uri = token.removeprefix("<").removesuffix(">") if token[:1] + token[-1:] == "<>" else token
    if not uri.startswith(("http://", "https://")) or not {"<", ">"}.isdisjoint(uri):
        raise ValueError(f"not an HTTP IRI: {token!r}")
    return uri


@dataclass(frozen=True)
class TriplePattern:
    """``s P ?``, ``s P URI``, ``? P o`` or ``URI P o``: the resource at ``s`` or ``o`` is selected."""

    selects: str  # "s" or "o"
    predicate: str
    fixed: str | None

    @staticmethod
    def parse(text: str) -> TriplePattern:
        tokens = text.split()
        if len(tokens) != 3:
            raise ValueError(f"a pattern has three parts: {text!r}")
        s, p, o = tokens
        if (s == "s") == (o == "o") or s == "o" or o == "s":
            raise ValueError(f"a pattern selects either its subject s or its object o: {text!r}")
        selects, other = ("s", o) if s == "s" else ("o", s)
        fixed = None if other == "?" else _http_iri(other)
        return TriplePattern(selects, _http_iri(p), fixed)

    def condition(self) -> Column:
        out = F.col("p") == self.predicate
        if self.selects == "o":
            out &= F.col("o_iri").isNotNull()
        if self.fixed is not None:
            out &= F.col("o_iri" if self.selects == "s" else "s") == self.fixed
        return out


def select_entities(triples: DataFrame, pattern: TriplePattern | str) -> DataFrame:
    """Distinct ``uri``."""
    pattern = TriplePattern.parse(pattern) if isinstance(pattern, str) else pattern
    return triples.where(pattern.condition()).select(F.col("s" if pattern.selects == "s" else "o_iri").alias("uri")).distinct()


def select_labels(triples: DataFrame, predicate: str = RDFS_LABEL) -> DataFrame:
    """Distinct (uri, label), labels normalised and not empty."""
    rows = triples.where(F.col("p") == predicate).select(F.col("s").alias("uri"), normalize_label(F.col("o_lex")).alias("label"))
    return rows.where("label <> ''").distinct()


def entities(triples: DataFrame, pattern: TriplePattern | str, predicate: str = RDFS_LABEL) -> DataFrame:
    """(uri, label) of the selected resources that have a label."""
    return select_labels(triples, predicate).join(select_entities(triples, pattern), "uri", "left_semi")


def class_instances(types: DataFrame, labels: DataFrame, lang: str | None = "en") -> DataFrame:
    """Distinct (class_iri, instance, label): what an endpoint's query for the labelled members of a class returns.

    ``types``: (instance, class_iri); ``labels``: (instance, label, lang).
    """
    rows = labels if lang is None else labels.where(F.col("lang") == lang)
    return types.join(rows, "instance").select("class_iri", "instance", "label").distinct()
