"""Label functions: built-in expressions where Spark has them, Arrow UDFs where it has not."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: White space as Python's ``str`` has it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def normal_form(label: str) -> str:
    """NFKC, case folding, runs of white space to one blank, no blank at the ends."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", label).casefold()).strip()


@F.pandas_udf(StringType())
def _normal_form(labels: pd.Series) -> pd.Series:
    return labels.map(normal_form, na_action="ignore")


def normalize_label(label: Column) -> Column:
    """``normal_form``; only labels that are not ASCII go through Python."""
    ascii_ = F.octet_length(label) == F.char_length(label)
    plain = F.trim(F.regexp_replace(F.lower(label), r"[\s\x1c-\x1f]+", " "))
    return F.when(ascii_, plain).otherwise(_normal_form(F.when(~ascii_, label)))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE))


def trigrams(label: Column) -> Column:
    """Distinct character 3-grams of the label between two blanks on either side."""
    padded = F.concat(F.lit("  "), label, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(label) + 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_dice(x: Column, y: Column) -> Column:
    n = F.size(x) + F.size(y)
    return F.when(n > 0, F.lit(2.0) * F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def token_sort(label: Column) -> Column:
    return F.array_join(F.array_sort(F.split(label, " ")), " ")


def length_possible(x: Column, y: Column, threshold: float) -> Column:
    """Whether the lengths' ratio is at least 0.8 of the threshold; part of what a match is, also below 0.75."""
    short, long = F.least(F.char_length(x), F.char_length(y)), F.greatest(F.char_length(x), F.char_length(y))
    return F.when(short > 0, short.cast("double") / long >= F.lit(threshold * 0.80)).otherwise(F.lit(False))


def length_bucket(label: Column, width: int) -> Column:
    return F.floor(F.char_length(label) / F.lit(width)).cast("int")


@lru_cache(maxsize=1 << 16)
def gram_hash(gram: str) -> bytes:
    """64-bit BLAKE2b, big-endian: bytes compare as unsigned numbers."""
    return hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def anchor_grams(label: Column, anchors: int, hash_: str = "blake2b") -> Column:
    """The ``anchors`` distinct trigrams of the least hash. ``md5`` stays in the JVM and orders otherwise."""
    if hash_ == "md5":
        ranked = F.array_sort(F.transform(trigrams(label), lambda g: F.struct(F.md5(g.cast("binary")).alias("h"), g.alias("g"))))
        return F.slice(F.transform(ranked, lambda r: r["g"]), 1, anchors)
    if hash_ != "blake2b":
        raise ValueError(f"unknown hash {hash_!r}")

    @F.pandas_udf(ArrayType(StringType()))
    def least(grams: pd.Series) -> pd.Series:
        return grams.map(lambda g: sorted(g, key=gram_hash)[:anchors], na_action="ignore")

    return least(trigrams(label))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit vector for ``a`` and a step for each character of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised insertion and deletion similarity in [0, 1]; 1 for two empty strings."""
    n = len(a) + len(b)
    return (1.0 - (n - 2 * lcs_length(a, b)) / n) * 100 / 100.0 if n else 1.0


@F.pandas_udf(DoubleType())
def indel_ratio(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else ratio(a, b) for a, b in zip(x, y, strict=True)], dtype="float64")


def final_similarity(x: Column, y: Column) -> Column:
    return F.greatest(indel_ratio(x, y), indel_ratio(token_sort(x), token_sort(y)))


@F.pandas_udf(DoubleType())
def _similarity(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([max(ratio(a, b), ratio(" ".join(sorted(a.split(" "))), " ".join(sorted(b.split(" "))))) for a, b in zip(x, y, strict=True)], dtype="float64")


def similarity(x: Column, y: Column) -> Column:
    """``final_similarity`` of labels that are not null, in one call."""
    return _similarity(x, y)


def score_text(score: Column) -> Column:
    """Six decimals, half to even."""
    return F.format_string("%.6f", F.bround(score, 6))


IRI = r"^(?i:https?)://[^/?#<>\"{}|^`\\\x00-\x20]+[^<>\"{}|^`\\\x00-\x20]*$"


def is_iri(iri: Column) -> Column:
    """HTTP or HTTPS, with a host, and without the characters that end an IRI term."""
    return F.coalesce(iri.rlike(IRI), F.lit(False))


def iri_term(iri: Column) -> Column:
    """``<iri>``; an invalid one is an error."""
    return F.when(is_iri(iri), F.concat(F.lit("<"), iri, F.lit(">"))).otherwise(F.raise_error(F.concat(F.lit("invalid IRI: "), F.coalesce(iri, F.lit("null")))))


def file_name(iri: Column) -> Column:
    return F.concat(F.sha2(iri, 256), F.lit(".csv"))


def pair_id(position: Column, left: Column, right: Column) -> Column:
    return F.format_string("%06d_%s", position, F.substring(F.sha2(F.concat(left, F.lit("\0"), right), 256), 1, 20))
