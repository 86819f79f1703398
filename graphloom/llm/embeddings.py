"""Embedding near-dedup (operator 8).

Vectors are made unit vectors and rotated by a random orthogonal matrix, the same one for all of a length. What is kept
of a rotated vector x, once, beside the vector itself:

- ``code``: the signs of x, packed into bits;
- ``f``, the correction factor: the inner product of x with its code's unit vector c;
- ``most``: the largest number of places at which the signs of a linked vector can differ, if at those places x is the
  nearer one to 0: where signs differ, the vectors lie at least |x_j| + |y_j| apart, and the least squares of x have
  used up half of the squared distance of a link after that many;
- ``planes``, ``low``, ``step``, ``slack``: x in steps of a sixteenth of its range, as four planes of bits, and the sum of
  what the steps leave out.

Two vectors whose codes differ at more places than both ``most`` allow do not link: a bit count for each pair. For the
others, <c, y> / f estimates <x, y> without bias, where <c, y> comes from bit counts of the code with the planes of y. Since
c differs from f x by a vector of length sqrt(1 - f * f) that is orthogonal to x, the estimate is off by at most
sqrt(1 - f * f) / f * sqrt(1 - <x, y> ** 2), and by what the steps leave out. A pair whose estimate lies below the least
value possible at the threshold cannot link; all other pairs are computed again, in doubles. These bounds hold for certain.

Equal vectors with equal labels are one class. The classes of a label are dealt into blocks by a hash; a task holds
two blocks (a tile) and gives, instead of pairs, the number of links of each class and a spanning forest of the links.
All tiles of a label are looked at, so that every link is found: the work is quadratic in a label's different
vectors, at a bit count for each pair.

Cases: null labels, null or empty vectors, zero vectors and vectors with null or non-finite components link with
nothing and are kept; vectors of different lengths never link; a null vec_id has component null and counts as kept;
repeated rows link with each other; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.staging import stage, unstage

THRESHOLD = 0.98
BLOCK = 2048
SEED = 8
PLANES = 4
STRIP = 256  # rows of a tile at a time
#: Pairs of a strip from which on a matrix product decides first; it leaves those within CLOSE of the threshold to the exact formula.
MANY, CLOSE = 20_000, 1e-9


@lru_cache(maxsize=4)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _bits(rows: np.ndarray) -> np.ndarray:
    """Boolean rows as words of 64 bits, with zeros at the end."""
    packed = np.packbits(rows, axis=-1)
    packed = np.concatenate((packed, np.zeros((*packed.shape[:-1], -packed.shape[-1] % 8), np.uint8)), -1)
    return np.ascontiguousarray(packed).view(np.uint64)


@dataclass
class Codes:
    code: np.ndarray  # (n, words)
    f: np.ndarray
    most: np.ndarray
    planes: np.ndarray  # (n, PLANES, words)
    low: np.ndarray
    step: np.ndarray
    slack: np.ndarray
    total: np.ndarray  # the sum of a vector's steps

    def __getitem__(self, rows) -> Codes:
        return Codes(*(v[rows] for v in vars(self).values()))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def codes(x: np.ndarray, threshold: float = THRESHOLD) -> Codes:
    """What is kept of finite vectors other than zero."""
    turned = unit(x) @ rotation(x.shape[1])
    squares = np.cumsum(np.sort(turned * turned, 1), 1)
    low = turned.min(1)
    step = (turned.max(1) - low) / (2**PLANES - 1) + 1e-300
    steps = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    planes = np.stack([_bits((steps >> k & 1).astype(bool)) for k in range(PLANES)], 1)
    slack = np.abs(turned - (low[:, None] + steps * step[:, None])).sum(1)
    return Codes(_bits(turned >= 0), np.abs(turned).sum(1) / np.sqrt(x.shape[1]), (squares <= (1 - threshold) + 1e-9).sum(1), planes, low, step, slack, steps.sum(1))


def estimates(d: int, a: Codes, b: Codes) -> np.ndarray:
    """<c, y> / f of row by row, y in steps; c takes the places of the signs of x, 1 or -1 over sqrt(d)."""
    both = sum((np.bitwise_count(a.code & b.planes[:, k]).sum(1, dtype=np.int64) << k for k in range(PLANES)), np.zeros(len(a.f), np.int64))
    ones = np.bitwise_count(a.code).sum(1, dtype=np.int64)
    return (b.low * (2 * ones - d) + b.step * (2 * both - b.total)) / np.sqrt(d) / a.f


def links(x: np.ndarray, y: np.ndarray, cx: Codes | None = None, cy: Codes | None = None, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether cosine(x_i, y_j) >= threshold, for rows of finite vectors other than zero. Only pairs that the bounds leave open are computed exactly."""
    d = x.shape[1]
    cx, cy = codes(x, threshold) if cx is None else cx, codes(y, threshold) if cy is None else cy
    x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    least = threshold - np.sqrt(np.clip(1 - cx.f**2, 0, None)) / cx.f * np.sqrt(max(0.0, 1 - threshold * threshold)) - 1e-6
    out = np.zeros((len(x), len(y)), bool)
    for a in range(0, len(x), STRIP):
        s = slice(a, a + STRIP)
        apart = sum((np.bitwise_count(cx.code[s, k][:, None] ^ cy.code[:, k]).astype(np.int32) for k in range(cx.code.shape[1])), np.int32(0))
        i, j = np.nonzero(apart <= np.maximum(cx.most[s][:, None], cy.most))
        i += a
        for p in range(0, len(i), 1 << 18):
            r, c = i[p : p + (1 << 18)], j[p : p + (1 << 18)]
            open_ = estimates(d, cx[r], cy[c]) >= least[r] - cy.slack[c] / np.sqrt(d) / cx.f[r]
            r, c = r[open_], c[open_]
            if len(r) > MANY:  # so many that a product of whole rows and columns costs less
                rows, columns = np.unique(r), np.unique(c)
                near = (x[rows] @ y[columns].T / (nx[rows][:, None] * ny[columns]))[np.searchsorted(rows, r), np.searchsorted(columns, c)]
                sure = near >= threshold + CLOSE
                out[r[sure], c[sure]] = True
                close = ~sure & (near >= threshold - CLOSE)
                r, c = r[close], c[close]
            if len(r):
                out[r, c] = np.einsum("ij,ij->i", x[r], y[c]) / (nx[r] * ny[c]) >= threshold
    return out


def forest(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) that span the components of a symmetric link matrix."""
    left, a, b = adjacent.any(1), [], []
    for root in np.flatnonzero(left):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            reach = adjacent[front].any(0) & left
            left &= ~reach
            front = np.flatnonzero(reach)
            a.append(np.full(len(front), root))
            b.append(front)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


CODED = "label {label}, d int, node long, copies long, vector array<double>, code array<long>, planes array<long>, most int, f double, low double, step double, slack double, total long"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes (label, d, node, copies, vector) with their codes."""
    words = lambda w: pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * (w.size // max(1, len(w))), pa.array(w.reshape(-1).view(np.int64)))
    for b in batches:
        size = b.column(1).to_numpy()
        for d in np.unique(size).tolist():
            part = b.take(pa.array(np.flatnonzero(size == d)))
            for at in range(0, len(part), STRIP):
                rows = part.slice(at, STRIP)
                c = codes(_matrix(pa.chunked_array([rows.column(4)])))
                yield pa.RecordBatch.from_arrays([*rows.columns, words(c.code), words(c.planes.reshape(len(rows), -1)), pa.array(c.most.astype(np.int32)), *map(pa.array, (c.f, c.low, c.step, c.slack, c.total))], ["label", "d", "node", "copies", "vector", "code", "planes", "most", "f", "low", "step", "slack", "total"])


def _tile(t: pa.Table) -> pa.Table:
    """(a, n, b): links of class a in this tile where b is null, else an edge of the forest."""
    first, second = t.column("t1")[0].as_py(), t.column("t2")[0].as_py()
    node, copies, block = (t.column(c).to_numpy() for c in ("node", "copies", "block"))
    v = _matrix(t.column("vector"))
    code, planes = (np.ascontiguousarray(_matrix(t.column(c))).view(np.uint64) for c in ("code", "planes"))
    kept = Codes(code, *(t.column(c).to_numpy() for c in ("f", "most")), planes.reshape(len(v), PLANES, -1), *(t.column(c).to_numpy() for c in ("low", "step", "slack", "total")))
    if first == second:
        m = links(v, v, kept, kept)
        m |= m.T
        np.fill_diagonal(m, False)
    else:
        p, q = np.flatnonzero(block == first), np.flatnonzero(block == second)
        m = np.zeros((len(v), len(v)), bool)
        if len(p) and len(q):
            m[np.ix_(p, q)] = links(v[p], v[q], kept[p], kept[q])
        m |= m.T
    n = np.array([copies[row].sum() for row in m], np.int64)
    a, b = forest(m)
    some = np.flatnonzero(n > 0)
    return pa.table({"a": np.concatenate((node[some], node[a])), "n": np.concatenate((n[some], np.zeros(len(a), np.int64))), "b": pa.array([None] * len(some) + node[b].tolist(), pa.int64())})


def near_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``rows(vec_id, embedding, label)``."""
    vector = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col("label").isNotNull() & F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "label", vector.alias("vector"), ok.alias("ok"))
    named = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("label", "vector", F.lit(8))))
    classes = named.where("ok").groupBy("label", "node", F.size("vector").alias("d")).agg(F.first("vector").alias("vector"), F.count("*").alias("copies"))
    label_type = rows.schema["label"].dataType.simpleString()
    classes = stage(classes.select("label", "d", "node", "copies", "vector").mapInArrow(_coded, CODED.format(label=label_type)))
    blocks = classes.groupBy("label", "d").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = classes.join(blocks, ["label", "d"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "d", F.least("block", "other").alias("t1"), F.greatest("block", "other").alias("t2"), "block", "node", "copies", "vector", "code", "planes", "most", "f", "low", "step", "slack", "total")
    found = stage(dealt.groupBy("label", "d", "t1", "t2").applyInArrow(_tile, "a long, n long, b long"))
    n = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null"))
    told = classes.select("node", "copies").join(n, "node", "left").join(roots, "node", "left").select("node", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    least = named.where("ok").groupBy("node").agg(F.min("vec_id").alias("least")).join(told, "node").groupBy("root").agg(F.min("least").alias("least"))
    told = told.join(least, "root").select("node", (F.col("n") + F.col("copies") - 1).alias("n"), "least")
    out = named.join(told, "node", "left")
    component = F.coalesce("least", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


QUERIES = {"op8_near_vectors": op8_near_vectors}
SQL = {
    "op8_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, root.component_id, e.vec_id = root.component_id AS kept
FROM embeddings e JOIN root ON root.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
}
