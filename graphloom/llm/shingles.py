"""N-gram Jaccard join (operator 7).

Sets of distinct word n-grams are compared by size-banded tiles. A tile holds the sets of one band of sizes that
share one n-gram of their prefixes; a prefix is the part of a set, rarest first, of which two sets that link must
share something (sets near the upper edge of a band also enter the next one). Equal sets stand for one another from
the start. Then:

1. Sieve. Each set's n-grams are put in one order for all: by hash, those that are common in many texts last. Two sets that
   link share at least l of their first n - ceil(n * SIMILAR / 100) + l, so a set that shares fewer with others is out.
2. The n-grams of the sets that are left are counted exactly. One that only one set has is in no overlap; a set without
   enough others is out. The rest are ordered rarest first, and make tiles by their prefixes.
3. The sets that meet the least set of a tile are one group, so a set enters few groups, and each pair of a tile is in one.
   A group's arrays go to one place, in blocks where it is large. There, a bound from above on the overlap, of sizes and of bit
   counts of hashed bitmaps, decides which pairs are intersected, exactly, as sorted arrays; sets that are connected already are not compared.
4. Sets of a large group that are still outside of its largest component are compared with all blocks of the group.

What leaves a block is a forest, never its pairs. No link between different components is lost.

Cases: null and empty texts have empty sets and link with nothing; a text with fewer words than n is one n-gram;
repeated rows and equal texts are one set (equal doc_ids are one document); null doc_ids are kept and link with
nothing; an empty table gives an empty result; texts of any length are taken whole; other columns are not read.
N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.staging import stage, unstage
from . import textkit as K

N, SIMILAR = 5, 80  # words in an n-gram; per cent
BITS = 512
#: Sizes of a band: 4**band and up. Sets of size s may link with sizes up to s * 100 / SIMILAR.
BAND = 4
#: Common n-grams: in so many texts of one task, in so many of all; no more than these are kept, which bounds the broadcast.
LOCAL, COMMON, MOST_COMMON = 3, 16, 1 << 17
#: A set's entries above its shortest prefix, as a share of it, of which as many must be shared.
MORE = 20
#: Sets, and n-grams of them, of a block of a group.
CROWD, CROWD_GRAMS = 1000, 500_000


def shingle_sets(column: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    step = [K.U64(pow(0xA24BAED4963EE407, j, 1 << 64)) for j in range(n)]
    for i, j, data, offs in K.pieces(column):
        starts, ends, doc = K.find_words(data, offs)
        h = K.word_hashes(data, starts, ends)
        first = np.searchsorted(doc, np.arange(j - i + 1))
        if len(h) >= n:
            m = len(h) - n + 1
            grams = h[:m] * step[0]
            for k in range(1, n):
                grams = grams + h[k : m + k] * step[k]
            grams = K.mix(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:  # fewer words: the whole sequence
                with np.errstate(over="ignore"):
                    yield K.mix(np.array([(h[a:b] * np.array(step[: b - a], K.U64)).sum() + K.U64(b - a)], K.U64))
            else:
                yield np.zeros(0, K.U64)


def _set_key(s: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have equal names."""
    with np.errstate(over="ignore"):
        x = K.mix(s ^ K.U64(0x5851F42D4C957F2D)).sum() + K.mix(s).sum() * K.U64(0x2545F4914F6CDD1D) + K.U64(len(s))
        return int(K.mix(np.array([x], K.U64)).view(np.int64)[0])


def least_shared(n: int) -> int:
    """Members that a set of n shares with one that it links with."""
    return -(-n * SIMILAR // 100)


def spare(n: int) -> int:
    return max(1, n // MORE)


def bands(n: int) -> list[int]:
    """The band of a size, and the next one if a similar set can be in it."""
    band = (n.bit_length() - 1) // 2
    return [band, band + 1] if n * 100 >= SIMILAR * BAND ** (band + 1) else [band]


def _sets_and_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: (doc_id, set, n) of each text; kind 1: (n-gram, -, texts) of those in LOCAL different sets here."""
    seen: set[int] = set()
    held: list[np.ndarray] = []
    total = 0

    def batch(kind, a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["kind", "a", "b", "c"])

    def common():
        found, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= LOCAL
        return batch(1, found[keep].view(np.int64), np.zeros(int(keep.sum()), np.int64), n[keep])

    for b in batches:
        keys, sizes = [], []
        for s in shingle_sets(b.column(1)):
            keys.append(_set_key(s))
            sizes.append(len(s))
            if len(s) and keys[-1] not in seen:
                seen.add(keys[-1])
                held.append(s)
                total += len(s)
            if total >= 4_000_000:
                yield common()
                held, total, seen = [], 0, set()
        yield batch(0, b.column(0).cast(pa.int64()), np.array(keys, np.int64), np.array(sizes, np.int64))
    if held:
        yield common()


def _fresh(column: pa.Array, seen: set[int], wanted=None) -> Iterator[tuple[int, np.ndarray]]:
    """Name and members of each set that is not empty and not in ``seen``, which forgets all at a million."""
    for s in shingle_sets(column):
        if len(s) and (key := _set_key(s)) not in seen and (wanted is None or wanted(key)):
            if len(seen) >= 1_000_000:
                seen.clear()
            seen.add(key)
            yield key, s


def _entries(told):
    """(key, set, n) of the longer prefix of each different set, by band; n is negative in the next band. ``told``: common n-grams, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = told.value
        seen: set[int] = set()
        for b in batches:
            keys, rows = [np.zeros(0, K.U64)], []
            for key, s in _fresh(b.column(1), seen):
                n = len(s)
                k = n - least_shared(n) + spare(n)
                if len(common):
                    at = np.searchsorted(common, s)
                    at[at == len(common)] = 0
                    hot = common[at] == s
                    if hot.any():
                        s = s[np.lexsort((s, np.where(hot, often[at], 0)))]
                for i, band in enumerate(bands(n)):
                    keys.append(K.mix(s[:k] + K.U64(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
                    rows.append((key, n if i == 0 else -n, k))
            key, n, k = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(key, k)), pa.array(np.repeat(n, k).astype(np.int32))], ["key", "set", "n"])

    return run


def _wanted(spark: SparkSession, ids: DataFrame):
    """A Bloom filter of the names in ``ids``: at most 2**21 words of 64 bits, or-ed on the executors. It only saves shuffling: with more names it lets more pass, which a join takes out."""
    words = 1 << int(np.clip(np.ceil(np.log2(max(1, ids.count()) / 4)), 10, 21))
    at = [F.col("set").bitwiseAND(F.lit(words * 64 - 1)), F.shiftrightunsigned("set", 32).bitwiseAND(F.lit(words * 64 - 1))]
    bits = ids.select(F.explode(F.array(*at)).alias("bit")).select(F.shiftright("bit", 6).alias("w"), F.col("bit").bitwiseAND(F.lit(63)).cast("int").alias("b"))
    found = bits.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).toArrow()  # Python objects of the rows would take the driver several times their size
    out = np.zeros(words, np.int64)
    out[found["w"].to_numpy()] = found["m"].to_numpy()
    return spark.sparkContext.broadcast(out)


def _arrays(told):
    """(set, members) of the sets that may be wanted, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = told.value, set()
        mask = len(bits) * 64 - 1
        wanted = lambda key: all(int(bits[x >> 6]) >> (x & 63) & 1 for x in (key & mask, (key & (1 << 64) - 1) >> 32 & mask))
        for b in batches:
            if rows := list(_fresh(b.column(0), seen, wanted)):
                keys, members = zip(*rows, strict=True)
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in members]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(members).view(np.int64)))], ["set", "members"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, n, c) of rows (key, set, n) in the order of key and set: of how many keys another set has too. A run of a key is never held."""
    tail = np.zeros((3, 0), np.int64)  # the last run so far: its last row, and the one before it if that has another set

    def count(rows: np.ndarray, done: np.ndarray) -> pa.RecordBatch:
        same = rows[0, 1:] == rows[0, :-1]  # rows are distinct: next to one of its key means another set
        near = np.append(False, same) | np.append(same, False)
        told, c = np.unique(rows[1:, near & done], axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(told[0]), pa.array(told[1]), pa.array(c)], ["set", "n", "c"])

    for b in batches:
        rows = np.concatenate((tail, np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])), 1)
        rows = rows[:, np.append(True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))] if rows.shape[1] else rows
        if rows.shape[1] < 2:
            tail = rows
            continue
        done = np.ones(rows.shape[1], bool)
        done[-1] = False  # told with the next batch
        done[: max(0, tail.shape[1] - 1)] = False  # told before
        yield count(rows, done)
        tail = rows[:, -2:]
    if tail.shape[1]:
        yield count(tail, np.arange(tail.shape[1]) == tail.shape[1] - 1)


def _candidates(docs: DataFrame, told, total: int) -> DataFrame:
    """Names of the sets that share enough of their prefixes with others to link with one."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 5_000_000)
    entries = docs.mapInArrow(K.tidy(_entries(told)), "key long, set long, n int").repartition(parts, "key").sortWithinPartitions("key", "set")
    shared = entries.mapInArrow(K.tidy(_shared), "set long, n long, c long").groupBy("set", "n").agg(F.sum("c").alias("c"))
    least = F.ceil(F.abs("n") * F.lit(SIMILAR) / F.lit(100))
    return shared.where(F.col("c") >= F.greatest(F.lit(1), F.floor(least / F.lit(MORE)))).select("set").distinct()


def _ranked(arrays: DataFrame) -> DataFrame:
    """(set, n, grams): of sets that may still link, the n-grams that another one has, rarest first."""
    sizes = arrays.select("set", F.size("members").alias("n"))
    grams = arrays.select("set", F.explode("members").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    shared = grams.join(counts, "gram").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("g"))
    out = shared.join(sizes, "set").where(F.size("g") * 100 >= F.col("n") * SIMILAR)
    return out.select("set", "n", F.transform("g", lambda x: x["gram"]).alias("grams"))


def _groups(ranked: DataFrame) -> DataFrame:
    """(lead, set): the sets that share an n-gram of their prefixes, in one band, with the least set that has it; the lead too."""
    rows = ranked.select("set", "n", "grams", F.expr("(length(bin(n)) - 1) div 2").cast("int").alias("band"))
    next_ = F.col("n") * 100 >= F.expr("shiftleft(1L, 2 * (band + 1))") * SIMILAR
    prefix = F.slice("grams", 1, F.size("grams") - F.ceil(F.col("n") * SIMILAR / F.lit(100)).cast("int") + 1)
    rows = rows.select("set", F.explode(F.when(next_, F.array(F.col("band"), F.col("band") + 1)).otherwise(F.array("band"))).alias("band"), prefix.alias("prefix"))
    entries = rows.select("set", F.explode("prefix").alias("gram"), "band")
    tiles = entries.groupBy("gram", "band").agg(F.min("set").alias("lead"), F.max("set").alias("hi")).where("lead <> hi")
    return entries.join(tiles, ["gram", "band"]).select("lead", "set").distinct()


def _bitmaps(owner: np.ndarray, ids: np.ndarray, rows: int) -> np.ndarray:
    """Members by hashed bits, BITS a row."""
    bits = np.zeros((rows, BITS), bool)
    bits[owner, (ids * 0x9E37 >> 3) % BITS] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def connect(n: np.ndarray, offsets: np.ndarray, grams: np.ndarray, comp: np.ndarray, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges between rows that, with the components given, connect whatever all similar pairs connect; with ``asks``, only pairs of which one row asks.

    One row at a time is compared with all that are apart from it, until all rows outside of the largest component have
    been (or all that ask). ``n``: sizes of the sets; ``grams``: those of their members that others have, row by row.
    """
    m, out = len(n), []
    ids = np.unique(grams, return_inverse=True)[1]
    size = np.diff(offsets)
    owner = np.repeat(np.arange(m), size)
    comp = np.unique(comp, return_inverse=True)[1]
    done = np.zeros(m, bool) if asks is None else ~asks
    bits = _bitmaps(owner, ids, m)
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    r = 0 if asks is None else int(np.argmax(asks))
    while True:
        done[r] = True
        most = np.minimum(size, size[r])
        far = np.flatnonzero((comp != comp[r]) & (100 * most >= SIMILAR * (n + n[r] - most)))
        if len(far):  # a bit that one bitmap alone has stands for a member that its set alone has
            only = np.maximum(np.bitwise_count(bits[far] & ~bits[r]).sum(1).astype(np.int64) - size[far], np.bitwise_count(~bits[far] & bits[r]).sum(1).astype(np.int64) - size[r])
            far = far[100 * -only >= SIMILAR * (n[far] + n[r] + only)]
        if len(far):
            mine = ids[offsets[r] : offsets[r + 1]]
            mark[mine] = True
            if 4 * len(far) > m:
                both = np.add.reduceat(mark[ids], offsets[:-1], dtype=np.int64)[far]
            else:
                both = np.array([int(mark[ids[offsets[x] : offsets[x + 1]]].sum()) for x in far.tolist()])
            mark[mine] = False
            near = far[100 * both >= SIMILAR * (n[far] + n[r] - both)]
            if len(near):
                labels, first = np.unique(comp[near], return_index=True)
                out += [(r, int(x)) for x in near[first]]
                comp[np.isin(comp, labels)] = comp[r]
        todo = ~done if asks is not None else ~done & (comp != np.bincount(comp).argmax())
        r = int(np.argmax(todo))
        if not todo[r]:
            return out


def _forests(t: pa.Table) -> pa.Table:
    """(a, b): edges of the blocks in one bucket. Rows with ``ask`` 0 or 1, if there are any, have components from before."""
    t = t.combine_chunks()
    lead, block, ask = (t.column(c).to_numpy() for c in ("lead", "block", "ask"))
    order = np.lexsort((ask, block, lead))
    cut = np.flatnonzero(np.append(True, (np.diff(lead[order]) != 0) | (np.diff(block[order]) != 0))) if len(order) else []
    edges: list[tuple[int, int]] = []
    for rows in np.split(order, cut[1:]):
        part = t.take(pa.array(rows))
        sets, ask = part.column("set").to_numpy(), part.column("ask").to_numpy()
        grams = part.column("grams").combine_chunks()
        offsets = grams.offsets.to_numpy() - grams.offsets[0].as_py()
        asks = None if ask.min() < 0 else ask == 1
        if len(sets) > 1 and (asks is None or asks.any()):
            # the lead comes first: it is the least name, but for those that ask
            found = connect(part.column("n").to_numpy().astype(np.int64), offsets, grams.flatten().to_numpy(), part.column("comp").to_numpy(), asks)
            edges += [(int(sets[a]), int(sets[b])) for a, b in found]
    return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def _compared(dealt: DataFrame, ranked: DataFrame) -> DataFrame:
    """Edges (a, b) of ``dealt(lead, block, set, comp, ask)``; blocks are put into buckets of about CROWD_GRAMS n-grams."""
    full = dealt.join(ranked, "set")
    spark = dealt.sparkSession
    weight = dealt.join(ranked.select("set", F.size("grams").alias("w")), "set").agg(F.sum("w")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), weight // CROWD_GRAMS + 1)
    full = full.withColumn("bucket", F.pmod(F.xxhash64("lead", "block"), F.lit(buckets)).cast("int"))
    return stage(full.groupBy("bucket").applyInArrow(_forests, "a long, b long").where("a <> b"))


def _apart(sizes: DataFrame, groups: DataFrame, ranked: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Edges between components of groups of several blocks; None if there is nothing to compare."""
    many = sizes.where("blocks > 1").select("lead")
    rows = groups.join(many, "lead", "left_semi").join(roots, F.col("set") == F.col("node"), "left").select("lead", "set", F.coalesce("root", "set").alias("comp"))
    by_comp = rows.groupBy("lead", "comp").agg(F.count("*").alias("m"))
    big = by_comp.groupBy("lead").agg(F.max(F.struct("m", "comp")).alias("big"), F.count("*").alias("comps")).where("comps > 1").select("lead", F.col("big.comp").alias("big"))
    rows = rows.join(big, "lead").join(ranked.select("set", F.size("grams").alias("w")), "set")
    rows = stage(rows.withColumn("out", F.col("comp") != F.col("big")).drop("big"))
    if not rows.take(1):
        unstage(rows)
        return None
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(F.count(w) / CROWD), F.ceil(F.sum(w) / CROWD_GRAMS)).cast("int")
    cuts = rows.groupBy("lead").agg(blocks(F.when(F.col("out"), F.col("w"))).alias("p"), blocks(F.col("w")).alias("q"))
    rows = rows.join(cuts, "lead")
    place = F.xxhash64("set", F.lit(3))
    mine, other = F.pmod(place, F.col("p")), F.pmod(place, F.col("q"))
    ask = rows.where("out").select("lead", "set", "comp", F.explode(F.expr("sequence(0, q - 1)")).alias("j"), mine.alias("i"), "q", F.lit(1).alias("ask"))
    told = rows.select("lead", "set", "comp", other.alias("j"), F.explode(F.expr("sequence(0, p - 1)")).alias("i"), "q", F.lit(0).alias("ask"))
    both = ask.unionByName(told, allowMissingColumns=False).select("lead", (F.col("i").cast("long") * F.col("q") + F.col("j")).alias("block"), "set", "comp", "ask")
    out = _compared(both, ranked)
    unstage(rows)
    return out


def set_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set, n_shingles) of each text, and (node, root) of the sets that are not the least of their component."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = stage(docs.mapInArrow(K.tidy(_sets_and_common), "kind int, a long, b long, c long"))
    sets = first.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("set"), F.col("c").alias("n_shingles"))
    counts = first.where("kind = 1").groupBy("a").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON)
    top = counts.orderBy(F.desc("c"), "a").limit(MOST_COMMON).toArrow()
    often, count = np.ascontiguousarray(top["a"].to_numpy()).view(K.U64), top["c"].to_numpy()
    order = np.argsort(often)
    told = spark.sparkContext.broadcast((often[order], count[order]))
    ids = stage(_candidates(docs, told, sets.agg(F.sum("n_shingles")).first()[0] or 0))
    told.unpersist()
    bloom = _wanted(spark, ids)
    arrays = stage(docs.select("text").mapInArrow(K.tidy(_arrays(bloom)), "set long, members array<long>").join(ids, "set", "left_semi").dropDuplicates(["set"]))
    bloom.unpersist()
    ranked = stage(_ranked(arrays))
    unstage(arrays, ids)
    groups = stage(_groups(ranked))
    sized = groups.join(ranked.select("set", F.size("grams").alias("w")), "set").groupBy("lead").agg(F.count("*").alias("m"), F.sum("w").alias("w"))
    sizes = stage(sized.select("lead", F.greatest(F.ceil(F.col("m") / CROWD), F.ceil(F.col("w") / CROWD_GRAMS)).cast("long").alias("blocks")))
    block = F.when(F.col("lead") == F.col("set"), F.expr("sequence(0L, blocks - 1L)")).otherwise(F.array(F.pmod(F.xxhash64("set", F.lit(3)), F.col("blocks"))))
    dealt = groups.join(sizes, "lead").select("lead", F.explode(block).alias("block"), "set", F.col("set").alias("comp"), F.lit(-1).alias("ask"))
    links = _compared(dealt, ranked)
    roots = stage(connected_components(links))
    if sizes.where("blocks > 1").take(1) and (more := _apart(sizes, groups, ranked, roots)) is not None:
        all_ = stage(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)))
        unstage(more, roots)
        roots = all_
    unstage(ranked, groups, sizes, links)
    return sets, roots


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs(doc_id, text)``: components of documents that link."""
    sets, roots = set_links(docs)
    known = sets.join(roots, sets["set"] == roots["node"], "left").select("doc_id", "n_shingles", F.coalesce("root", "set").alias("comp"))
    least = known.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = known.join(least, "comp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that link, directly or not, to one of a smaller doc_id. Rows of one doc_id are one document, of which the row of the least text stays; null doc_ids stay."""
    gone = jaccard_classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    known = docs.where("doc_id is not null")
    twice = known.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_twice"))
    kept = known.join(gone, known["doc_id"].cast("long") == F.col("_gone"), "left_anti").join(twice, known["doc_id"] == F.col("_twice"), "left")
    first = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("text"))
    many = kept.where("_twice is not null").withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return kept.where("_twice is null").select(*docs.columns).union(many.select(*docs.columns)).union(docs.where("doc_id is null"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_jaccard": op7_jaccard}
SQL = {
    "op7_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.b AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
}
