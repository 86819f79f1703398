"""Mixing sources to target weights (operator 5).

The words of a source's documents, in a pseudorandom order, form one stream that is packed into blocks of fixed
length. Each output shard draws how many of its slots go to which source: a multinomial draw over GROUP sources at a time,
whose certain part is taken out first and whose error is carried to the next shard, so that a source's total stays within a few
blocks of its target. Sources are rows of a table, however many they are; targets are found by filling up: a share for each
unit of weight that grows until what full sources leave over is spent. A source's slots are numbered through all shards; slot g stands for pass ``g div blocks`` and for the
block to which that pass's pseudorandom permutation of the block numbers (swap-or-not rounds, a bijection for any
count) maps ``g mod blocks``. Slots are then joined to blocks by index, and blocks to the documents they were cut
from. Since no source is drawn for more than two passes, no block and no document is used more than twice.

Cases: null text counts as empty; documents without words take nothing; a null source is a source of its own, last;
repeated rows are rows of their own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.offsets import running_totals
from ..plans.staging import stage
from . import textkit as K

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 64
ROUNDS = 8
#: Sources whose slots are drawn together, in one task.
GROUP = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(found: DataFrame) -> DataFrame:
    """``found(source, ...)`` with ``code``: its place by code points, null last."""
    spark = found.sparkSession
    order = F.asc_nulls_last("source")
    rows = stage(found.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), order).withColumn("_part", F.spark_partition_id()))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_start"))
    code = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return rows.join(F.broadcast(starts), "_part").withColumn("code", code.cast("long")).drop("_part", "_start")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``sources(code, source_size)`` with ``target``: ``share`` of all sizes split by the repeating ``weights``; what would be above ``most`` times a source's size goes to the others."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("code") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("_w", weight)
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("source_size") > 0, F.col("_w"))), F.lit(0))).first()
    spend, open_, unit = share * total[0], total[1], 0.0
    while open_:  # sums of whole numbers, so that reruns agree
        unit = spend / open_
        full = F.lit(unit) * F.col("_w") >= most * F.col("source_size")
        taken, left = rows.where("source_size > 0").agg(F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0))).first()
        if left == open_:
            break
        spend, open_ = share * total[0] - taken, left
    if not open_:
        unit = float("inf")  # all are full
    return rows.withColumn("target", F.when(F.col("source_size") > 0, F.least(F.lit(unit) * F.col("_w"), (most * F.col("source_size")).cast("double"))).otherwise(F.lit(0.0))).drop("_w")


def draw_counts(expected: np.ndarray, limits: np.ndarray, shards: int, seed: int | list[int]) -> np.ndarray:
    """Slots by (shard, source): in each shard what is due for certain, and a multinomial draw over the fractions due."""
    rng = np.random.default_rng(seed)
    want, limit = np.asarray(expected, float), np.asarray(limits, np.int64)
    got, out = np.zeros(len(want), np.int64), np.zeros((shards, len(want)), np.int64)
    for j in range(shards):
        due = np.clip(np.minimum(want * (j + 1) / shards, limit) - got, 0, None)
        sure = np.floor(due + 1e-9).astype(np.int64)
        rest = np.clip(due - sure, 0, None)
        extra = int(round(rest.sum()))
        if extra and rest.sum() > 0:
            sure += rng.multinomial(extra, rest / rest.sum())
        sure = np.minimum(sure, limit - got)
        out[j] = sure
        got += sure
    return out


def permuted(index: Column, count: Column, *keys: Column) -> Column:
    """``index``, mapped by a pseudorandom permutation of 0..count-1 that depends on ``keys``."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), count) - at, count)
        coin = F.xxhash64(F.greatest(at, other), *keys, -r).bitwiseAND(F.lit(1))
        return F.when(coin == 1, other).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, range(1, ROUNDS + 1))), index.cast("long"), swap)


class Mix:
    """A mix of ``docs(keys..., source, size)``; ``docs`` has to be cheap to read twice.

    ``order``: columns that put a source's documents in their pseudorandom order, if ``keys`` should not, as they say where rows lie.

    ``sources``: (code, source, source_size, target, blocks); ``slots``: (code, block, shard, slot, pass);
    ``pieces``: (keys..., code, size, block, from, upto), the words of a document that lie in a block.
    """

    def __init__(self, docs: DataFrame, keys: list[str], weights=(5, 2, 1), share=1.5, most=2, block=BLOCK, shards=64, seed=5, order: list[str] | None = None):
        spark = docs.sparkSession
        self.block = block
        found = _numbered(docs.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"), F.count("*").alias("rows")))
        found = targets(found, weights, share, most).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
        self.sources = stage(found.select("code", "source", "source_size", "target", "blocks", "rows"))
        expected = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))
        total, documents = self.sources.agg(F.coalesce(F.sum(expected), F.lit(0.0)), F.coalesce(F.sum("rows"), F.lit(0))).first()

        def drawn(t: pa.Table) -> pa.Table:
            order = np.argsort(t.column("code").to_numpy())
            code, want, blocks = (t.column(c).to_numpy()[order] for c in ("code", "expected", "blocks"))
            counts = draw_counts(want, most * blocks, shards, [seed, int(code[0]) // GROUP])
            starts = counts.cumsum(0) - counts
            j, i = np.nonzero(counts)
            return pa.table({"shard": pa.array(j.astype(np.int32)), "code": pa.array(code[i]), "first": pa.array(starts[j, i]), "n": pa.array(counts[j, i]), "blocks": pa.array(blocks[i])})

        group = F.floor(F.col("code") / F.lit(GROUP)).alias("group")
        slots = stage(self.sources.select(group, "code", expected.alias("expected"), "blocks").groupBy("group").applyInArrow(drawn, "shard int, code long, first long, n long, blocks long"))
        piece = 1 << 14  # slots made from one row
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // 200_000)  # with a number, adaptive execution keeps them apart
        slots = slots.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / piece)))).repartition(tasks, "shard", "code", "_part")
        slots = slots.withColumn("slot", F.explode(F.sequence(F.col("_part") * piece, F.least(F.col("n"), (F.col("_part") + 1) * piece) - 1)))
        slots = slots.withColumn("_g", F.col("first") + F.col("slot")).withColumn("pass", F.floor(F.col("_g") / F.col("blocks")).cast("int"))
        slots = slots.withColumn("block", permuted(F.pmod("_g", "blocks"), F.col("blocks"), F.col("code"), F.col("pass")))
        self.slots = slots.select("code", "block", "shard", "slot", "pass")
        known = docs.join(self.sources.select("code", F.col("source").alias("_s")), docs["source"].eqNullSafe(F.col("_s"))).select(*keys, *(order or []), "code", "size")
        self.rows = known.select(*keys, "code", "size")
        at = running_totals(known.where("size > 0"), "code", [*(order or keys), "size"], F.col("size"), max(64, int(documents) // 50_000), "_start", keys if order else None)
        at = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block))))
        self.pieces = at.select(
            *keys, "code", "size", "_start", "block",
            F.greatest(F.lit(0), F.col("block") * block - F.col("_start")).alias("from"), F.least("size", (F.col("block") + 1) * block - F.col("_start")).alias("upto"),
        )

    def taken(self, keys: list[str]) -> DataFrame:
        """(keys..., code, size, taken): the words that the mix takes of each row, repeats counted."""
        times = self.slots.groupBy("code", "block").agg(F.count("*").alias("times"))
        # the planner takes the slots for as small as the counts they are made from, and would broadcast them
        used = self.pieces.hint("merge").join(times, ["code", "block"], "left").groupBy("code", "_start", *keys, "size")
        used = used.agg(F.sum((F.col("upto") - F.col("from")) * F.coalesce("times", F.lit(0))).cast("long").alias("taken")).drop("_start")
        return used.unionByName(self.rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def _cut(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """The text of each run of words (from, upto)."""
    raw = text.encode()
    at = [m.span() for m in re.finditer(WORD.encode(), raw)]
    return [text if (a, z) == (0, len(at)) else raw[at[a][0] : at[z - 1][1]].decode() for a, z in spans]


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows like ``docs(doc_id, text, source, ...)``: for each pass, every longest run of a document's words that lies in drawn blocks, as a row of its own; ``n_chars``, where there is one, is that of the run.

    Rows are found again by their places in the files, but put in order by doc_id and text: reruns agree wherever the files lie.
    """
    keys, order = ["_mix_file", "_mix_row"], ["_mix_id", "_mix_md5"]
    where = [F.xxhash64("_metadata.file_path").alias(keys[0]), F.col("_metadata.row_index").alias(keys[1])]
    columns = docs.columns
    try:
        rows = docs.select("*", *where)
    except AnalysisException:  # not a scan of files
        rows = stage(docs).select("*", *where)
    content = [F.col("doc_id").alias(order[0]), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias(order[1])]
    mix = Mix(stage(rows.select(*keys, *content, "source", word_count(F.col("text")).alias("size"))), keys, order=order)
    times = mix.slots.groupBy("code", "block").agg(F.count("*").alias("times"))
    used = mix.pieces.hint("merge").join(times, ["code", "block"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("from", "upto", "times"))).alias("_mix_used"))
    full = rows.join(used, keys).drop(*keys)
    at, chars = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = [], []
            for i, (text, used) in enumerate(zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), strict=True)):
                for turn in range(max(u["times"] for u in used)):
                    spans: list[tuple[int, int]] = []
                    for u in used:
                        if u["times"] > turn:
                            joins = spans and spans[-1][1] == u["from"]
                            spans[len(spans) - bool(joins) :] = [(spans[-1][0] if joins else u["from"], u["upto"])]
                    texts += _cut(text, spans)
                    rows += [i] * len(spans)
            out = b.take(pa.array(rows, pa.int64())).columns[: len(columns)]
            out[at] = pa.array(texts, out[at].type)
            if chars is not None:
                out[chars] = pa.array([len(t) for t in texts]).cast(out[chars].type)
            yield pa.RecordBatch.from_arrays(out, columns)

    return full.select(*columns, "_mix_used").mapInArrow(K.tidy(run), docs.schema)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mix = Mix(stage(docs), ["doc_id"])
    out = mix.taken(["doc_id"]).join(mix.sources, "code")
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_mix": op5_mix}
SQL: dict[str, str] = {}
