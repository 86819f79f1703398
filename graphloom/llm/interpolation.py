"""Language-model scores by deleted interpolation (operator 3).

The probability of a token after the two before it mixes four estimates: the maximum likelihood of the triple, that of the
pair, that of the token alone, and the uniform distribution over known tokens and one unknown. The weights depend on the
bucket of the context's frequency: that of the two tokens before, or, if they were never seen together, of the one before.
They are learned by expectation-maximisation on held-out counts: on a tenth of the training texts,
whose own counts are deleted from the corpus counts first. There, estimates are taken to steps of a log scale, so that what
is learned from is a histogram of a bounded size.

Keys go up, counts come down. A block is a part of one input split. Each block counts its different tokens, pairs and triples,
as sorted 64-bit keys; ranges of keys meet in one place, where the counts of all blocks are summed; each block gets
the totals of its keys back in their order. The block's texts are then read again, their keys are found again, and
every token has its counts at hand. What moves are packed differences of sorted keys, and the texts once.

Cases: a null or empty text is one end token; a null doc_id is hashed as no text (its checksum is 0, so it is held
out); repeated rows count each time; an empty table gives an empty result; texts of any length are taken whole; other
columns are not read. ``docs`` must read the same rows in the same partitions each time, as a file scan does; a
block whose keys are others the second time raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import textkit as K

#: Parts of an input split: texts to learn from or to score, by a hash, and, last, those that the weights are learned on.
PARTS = 11
BUCKETS = 25  # of a context's frequency, for pairs and again for single tokens
FINE, STEPS = (2, 2, 2), (32, 48, 96)  # steps an octave, and their number, of triples, pairs and tokens
PAIR_BITS, WORD_BITS = 56, 62
KINDS = (1, 2, 3)
START = K.U64(0x8000000000000001)
END = K.U64(0xC000000000000003)


def _pack(x: np.ndarray) -> bytes:
    """Integers by byte planes, so that planes of zeros cost nothing once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpack(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def tokens(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of all tokens, of all pairs with the token before, of all triples, and the text of each token; every text ends with END, and two START stand before it."""
    kinds, docs = ([], [], []), []
    with np.errstate(over="ignore"):
        for i, j, data, offs in K.pieces(column):
            starts, ends, doc = K.find_words(data, offs)
            h = K.word_hashes(data, starts, ends)
            n = np.bincount(doc, minlength=j - i)
            stop = np.cumsum(n + 1) - 1  # where the ends go
            w = np.empty(len(h) + (j - i), K.U64)
            w[stop] = END
            w[np.arange(len(h)) + doc] = h
            first = np.concatenate(([0], stop[:-1] + 1))
            before = np.empty_like(w)
            before[1:] = w[:-1]
            before[first] = START
            pair = K.mix(before * K.U64(0x9E3779B97F4A7C15) + w)
            past = np.empty_like(w)
            past[1:] = pair[:-1]
            past[first] = START
            kinds[0].append(w >> K.U64(64 - WORD_BITS))
            kinds[1].append(pair >> K.U64(64 - PAIR_BITS))
            kinds[2].append(K.mix(past * K.U64(0xD6E8FEB86659FD93) + w) >> K.U64(64 - PAIR_BITS))
            docs.append(np.repeat(np.arange(i, j), n + 1))
    if not docs:
        return [np.zeros(0, K.U64)] * 3, np.zeros(0, np.int64)
    return [np.concatenate(k) for k in kinds], np.concatenate(docs)


def _cuts(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    """Where sorted keys change their range of keys."""
    edges = np.arange(1, parts, dtype=K.U64) << K.U64((WORD_BITS if kind == 1 else PAIR_BITS) - (parts.bit_length() - 1))
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _up(parts: int):
    """doc rows (text, part, train) to (block, kind, range, keys, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * PARTS
        held: dict[int, list] = {}
        for b in batches:
            part, train = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            keys, doc = tokens(b.column(0))
            if not len(doc):
                continue
            of, learn = part[doc], train[doc].astype(K.U64)
            for k in np.unique(part):
                m = of == k
                held.setdefault(int(k), []).append([x[m] << K.U64(1) | learn[m] for x in keys])  # whether it is learned from, in the last bit
        for k in sorted(held):
            for kind, x in zip(KINDS, [np.concatenate(x) for x in zip(*held.pop(k), strict=True)], strict=True):
                x.sort()
                learn = (x & K.U64(1)).astype(np.int64)
                x >>= K.U64(1)
                new = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                keys, counts = x[new], np.add.reduceat(learn, new).astype(np.uint32)
                cut = _cuts(keys, kind, parts)
                rows = [(r, a, z) for r, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if z > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([at + k] * len(rows), pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array([r for r, _, _ in rows], pa.int32()),
                        pa.array([_pack(np.diff(keys[a:z], prepend=K.U64(0))) for _, a, z in rows], pa.binary()), pa.array([_pack(counts[a:z]) for _, a, z in rows], pa.binary()),
                    ],
                    ["block", "kind", "range", "keys", "counts"],
                )

    return run


def _meet(t: pa.Table) -> pa.Table:
    """All blocks' keys of one range: their totals, in each block's order; block -1 has the tokens and different tokens."""
    keys = [np.cumsum(_unpack(k.as_buffer(), K.U64), dtype=K.U64) for k in t.column("keys")]
    all_, n = np.concatenate(keys), np.concatenate([_unpack(c.as_buffer(), np.uint32) for c in t.column("counts")]).astype(np.int64)
    order = np.argsort(all_, kind="stable")
    ranked = all_[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    total = np.add.reduceat(n[order], np.flatnonzero(new))
    back = np.empty(len(all_), np.int64)
    back[order] = total[np.cumsum(new) - 1]
    ends = np.cumsum([len(k) for k in keys])
    down = [_pack(x) for x in np.split(back, ends[:-1])]  # of eight bytes: planes of zeros cost nothing
    kind, range_ = t.column("kind")[0].as_py(), t.column("range")[0].as_py()
    m = len(keys) + 1
    return pa.table(
        {
            "block": pa.array([*t.column("block").to_pylist(), -1], pa.int64()), "kind": pa.array([kind] * m, pa.int32()), "range": pa.array([range_] * m, pa.int32()), "totals": pa.array([*down, b""], pa.binary()),
            "tokens": pa.array([0] * (m - 1) + [int(total.sum())], pa.int64()), "different": pa.array([0] * (m - 1) + [int((total > 0).sum())], pa.int64()),
        }
    )


def _shifted(x: np.ndarray, first: np.ndarray, at_start) -> np.ndarray:
    """What stands one place before, in the same text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = at_start
    return out


def _counted(texts: pa.Table, totals: pa.Table):
    """Of a block: the text of each token; the indices of its token, pair and triple, and of their contexts; and the corpus counts of these.

    A START is as frequent as an END, and so are two.
    """
    keys, doc = tokens(texts.column("text"))
    index, count = [], []
    for kind, x in zip(KINDS, keys, strict=True):
        found, at = np.unique(x, return_inverse=True)
        rows = sorted((r, c) for k, r, c in zip(totals.column("kind").to_pylist(), totals.column("range").to_pylist(), totals.column("totals"), strict=True) if k == kind)
        c = np.concatenate([np.zeros(0, np.int64), *(_unpack(v.as_buffer(), np.int64) for _, v in rows)])
        if len(c) != len(found):
            raise RuntimeError("a block's keys are not those that were counted; the input's partitions have changed")
        index.append(at.astype(np.int32))
        count.append(c[at].astype(np.float64))
    first = np.append(True, doc[1:] != doc[:-1])
    end = np.flatnonzero(np.append(first[1:], True))[0]
    # the context of two START is kept apart from the pairs by an index of its own
    context = [_shifted(index[0], first, index[0][end]), _shifted(index[1], first, -1)]
    often = [_shifted(c, first, count[0][end]) for c in count[:2]]
    return doc, index, context, count, often, first


def _log2(c: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(c + 1))).astype(np.int64)


def _bucket(often: list[np.ndarray]) -> np.ndarray:
    """Of contexts' counts: BUCKETS and more for two tokens that were seen together, else that of the one before."""
    return np.where(often[1] > 0, BUCKETS + _log2(often[1]), _log2(often[0]))


def _step(p: np.ndarray, kind: int) -> np.ndarray:
    """0 for 0, else 1 and the probability's step on a log scale."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.minimum(STEPS[kind] - 1, np.round(-FINE[kind] * np.log2(np.maximum(p, 1e-300)))), 0).astype(np.int64)


def _estimates(count: list[np.ndarray], often: list[np.ndarray], n_all) -> list[np.ndarray]:
    """Maximum likelihood of triple, pair and token."""
    return [np.where(often[1] > 0, count[2] / np.maximum(often[1], 1), 0), np.where(often[0] > 0, count[1] / np.maximum(often[0], 1), 0), count[0] / np.maximum(n_all, 1)]


def _own(doc: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often the text of each position has ``of`` of that position among its ``at``."""
    width = int(max(at.max(), of.max())) + 1
    have, n = np.unique(doc * width + at, return_counts=True)
    ask = doc * width + of  # doc is of 64 bits
    i = np.minimum(np.searchsorted(have, ask), len(have) - 1)
    return np.where(have[i] == ask, n[i], 0)


def _deleted(n_all: float):
    """The histogram of (context bucket, steps of the three estimates) over a block, own counts deleted."""

    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        doc, index, context, count, often, first = _counted(texts, totals)
        size = np.bincount(doc)[doc]
        count = [c - _own(doc, i, i) for c, i in zip(count, index, strict=True)]
        # a text has one START, and two of them once
        own = [_own(doc, index[0], context[0]), np.where(first, 1, _own(doc, index[1], np.where(first, 0, context[1])))]
        often = [c - o for c, o in zip(often, own, strict=True)]
        cell = _bucket(often)
        for kind, p in enumerate(_estimates(count, often, n_all - size)):
            cell = cell * (STEPS[kind] + 1) + _step(p, kind)
        cell, n = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def weights(cell: np.ndarray, n: np.ndarray, unknown: float, rounds: int = 60) -> np.ndarray:
    """(2 * BUCKETS, 4): weights of triple, pair, token and uniform estimate by context bucket, by expectation-maximisation."""
    p = [np.full(len(cell), unknown)]
    for kind in (2, 1, 0):
        cell, s = np.divmod(cell, STEPS[kind] + 1)
        p.insert(0, np.where(s == 0, 0, 2.0 ** (-(s - 1) / FINE[kind])))
    p, b = np.stack(p, 1), cell
    out = np.full((2 * BUCKETS, 4), 1 / 4)
    prior = np.array([0.5, 0.5, 1.0, 0.5])  # keeps every weight above 0 where little is held out
    for _ in range(rounds):
        share = out[b] * p
        share *= (n / share.sum(1))[:, None]
        for k in range(4):
            out[:, k] = np.bincount(b, share[:, k], 2 * BUCKETS) + prior[k]
        out /= out.sum(1, keepdims=True)
    # contexts never seen have no triples, or no pairs; what these would take goes to the next estimate
    out[:BUCKETS, 1] += out[:BUCKETS, 0]
    out[:BUCKETS, 0] = 0
    out[0] = [0, 0, out[0, 1] + out[0, 2], out[0, 3]]
    return out


def _scored(n_all: float, v_all: float, mix: np.ndarray):
    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        ids = texts.column("doc_id")
        m = len(ids)
        if not m:
            return pa.table({"doc_id": ids, "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        doc, _, _, count, often, _ = _counted(texts, totals)
        w = mix[_bucket(often)]
        p = w[:, 3] / (v_all + 1) + sum(w[:, k] * e for k, e in enumerate(_estimates(count, often, n_all)))
        cw = count[0]
        base = np.log10((cw + 0.1) / (n_all + 0.1 * (v_all + 1)))
        add = lambda x: np.bincount(doc, x, m)
        return pa.table({"doc_id": ids, "n_tokens": pa.array(np.bincount(doc, minlength=m), pa.int64()), "n_known": pa.array(add(cw > 0).astype(np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(p)))})

    return run


def interpolated_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    sum_ = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    rows = docs.select("doc_id", "text", sum_.alias("crc")).withColumn("train", F.col("crc") % 10 != 0)
    part = F.when(F.col("crc") % 10 == 1, F.lit(PARTS - 1)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(PARTS - 1)).cast("int"))
    rows = rows.withColumn("part", part.cast("int")).withColumn("block", (F.spark_partition_id() * PARTS + F.col("part")).cast("long"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(6, int(np.ceil(np.log2(size / 8e6 + 1))))  # as many as the input needs, so that a range stays small
    up = rows.select("text", "part", "train").mapInArrow(_up(ranges), "block long, kind int, range int, keys binary, counts binary")
    down = stage(up.groupBy("kind", "range").applyInArrow(_meet, "block long, kind int, range int, totals binary, tokens long, different long"))
    n_all, v_all = down.where("block = -1 and kind = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()
    totals = down.where("block >= 0").select("block", "kind", "range", "totals")
    texts = rows.select("doc_id", "text", "block", "part")
    em = texts.where(F.col("part") == PARTS - 1).drop("part").groupBy("block").cogroup(totals.where(F.col("block") % PARTS == PARTS - 1).groupBy("block"))
    cells = em.applyInArrow(_deleted(float(n_all)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    mix = weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64), 1 / (v_all + 1))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = texts.drop("part").groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_scored(float(n_all), float(v_all), mix), f"doc_id {id_type}, n_tokens long, n_known long, base_score double, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 10 == 0
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")


def op3_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same counts and base score; the weights of the mix are learned by iteration and are not compared.
SQL: dict[str, str] = {}
QUERIES = {"op3_interpolation": op3_interpolation}
