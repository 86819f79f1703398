"""Byte-level BPE encoding and decoding (operator 6).

The ranks of a byte-level vocabulary are written as a sentencepiece BPE model, field by field: each token's bytes are
mapped to printable characters one to one, its score is its negative rank, and normalisation is the identity. A
sentencepiece processor then merges, in each pre-token by itself, the adjacent pair of the best score, the leftmost
of equals, which is the rank order. Pre-tokens that are tokens themselves are looked up. Decoding maps ids back to
bytes and joins them.

Cases: a null or empty text has no ids; texts of any length are encoded whole; the order of rows and further columns
do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from . import textkit as K

#: Pre-tokens whose ids a worker remembers at once.
REMEMBERED = 400_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where that is printable Latin-1, else the next free one from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the vocabulary; token ``rank`` has id ``rank + 1``, id 0 is the unknown piece."""
    alphabet = byte_alphabet()

    def piece(text: str, score: float, kind: int) -> bytes:
        score_field = _varint(2 << 3 | 5) + np.float32(score).tobytes()
        return _field(1, _field(1, text.encode()) + score_field + _field(3, kind))

    out = [piece("<unk>", 0.0, 2)]
    out += [piece("".join(alphabet[b] for b in t), -float(rank), 1) for rank, t in enumerate(tokens)]
    # trainer: model_type BPE, vocab_size, unk_id, no bos, eos or pad
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0) + b"".join(_field(n, -1) for n in (41, 42, 43))
    # normaliser: identity, no dummy prefix, white space neither removed nor escaped
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join([*out, _field(2, trainer), _field(3, normaliser)])


class Codec:
    """Encodes and decodes with the ranks' own ids."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.letters = {b: c for b, c in enumerate(byte_alphabet())}
        self.whole = {t: np.uint32(i).tobytes() for i, t in enumerate(tokens)}
        self.seen: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new, ask = {}, []
        for w in words:
            raw = w.encode()
            if (known := self.whole.get(raw)) is not None:
                new[w] = known
            else:
                ask.append((w, raw.decode("latin-1").translate(self.letters)))
        if ask:
            for (w, _), ids in zip(ask, self.pieces.encode([x for _, x in ask], num_threads=1), strict=True):
                new[w] = (np.asarray(ids, "<u4") - np.uint32(1)).astype("<u4").tobytes()
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen = {}
        self.seen.update(new)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = self.find(text)
        try:
            return b"".join([self.seen[w] for w in words])
        except KeyError:
            out = []
            for i in range(0, len(words), REMEMBERED // 4):  # so that a part's words are remembered together
                part = words[i : i + REMEMBERED // 4]
                if missing := {w for w in part if w not in self.seen}:
                    self._learn(missing)
                    if len(self.seen) == len(missing):  # it was emptied
                        self._learn({w for w in part if w not in self.seen})
                out += [self.seen[w] for w in part]
            return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def _codec(packed: bytes, pattern: str) -> Codec:
    return Codec([base64.b64decode(t) for t in packed.split(b"\n")], pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, ids_too: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of ``docs``; the driver reads the vocabulary at ``path``."""
    packed = docs.sparkSession.sparkContext.broadcast(b"\n".join(map(base64.b64encode, read_ranks(path))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(packed.value, pattern)
        for batch in batches:
            n, a, b, kept = [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                kept.append(np.frombuffer(ids, "<u4").astype("<i4"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids_too:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(K.tidy(run), schema + ", ids array<int>" * ids_too)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
SQL: dict[str, str] = {}
