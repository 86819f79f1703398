"""Operators on keys and vectors (8, 9), and the pipeline."""

import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import embeddings, sharding


def plain_links(rows, t=0.98):
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is not None and a == b and good(v) and good(w) and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= t:
                n[i] += 1
                n[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [(r[0], n[i], rows[find(i)][0]) for i, r in enumerate(rows)]


def vectors(seed, count=120, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        near = rows and rng.random() < 0.6
        v = (np.array(rows[rng.integers(len(rows))][1]) + rng.standard_normal(d) * rng.choice([0.0, 0.02, 0.05, 0.2])) if near else rng.standard_normal(d)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors(3)
    odd = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [1.0, None, *[0.0] * 14], 0), (1004, [float("nan")] * 16, 0), (1005, rows[0][1], None), (1006, [1.0, 0.0], 0), (1007, [float("inf")] * 16, 1), (1008, [1e-300] * 16, 0), (1009, [1e300] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("clash"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect())
    want = plain_links(rows)
    assert got[: len(rows)] == want and sum(w[1] for w in want) > 0
    assert got[len(rows) :] == [(i, 0, i) for i in range(1000, 1008)] + [(1008, 1, 1008), (1009, 1, 1008)]
    assert embeddings.near_vectors(df.where("false")).collect() == []


def test_repeated_vectors(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0], 1)] * 3 + [(None, [1.0, 2.0], 1), (3, [2.0, 4.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect())
    assert got == [("3", 4, 3, True), *[("7", 4, 3, False)] * 3, ("None", 4, 3, True)]


def test_estimates_never_exclude_a_link():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 24))
    y = x + rng.standard_normal(x.shape) * rng.choice([0.01, 0.1, 0.15, 0.2], (300, 1))
    exact = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1))
    assert (embeddings.links(x, y) == (exact >= 0.98)).all() and (exact >= 0.98).sum() > 50
    c = embeddings.codes(x)
    assert c.code.shape == (300, 1) and c.code.dtype == np.uint64
    of = embeddings.estimates(24, c, c)  # of itself the estimate is 1, but for the steps
    assert (np.abs(of - 1) <= c.slack / np.sqrt(24) / c.f + 1e-9).all()
    other = embeddings.codes(y)
    near = np.flatnonzero(np.diag(exact) >= 0.98)
    apart = np.bitwise_count(c.code ^ other.code).sum(1)
    assert (apart[near] <= np.maximum(c.most, other.most)[near]).all()


def test_estimates_are_unbiased_and_codes_exclude_most(monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((4000, 64)), rng.standard_normal((4000, 64))
    y = x * 0.5 + y
    exact = (embeddings.unit(x) * embeddings.unit(y)).sum(1)
    a, b = embeddings.codes(x), embeddings.codes(y)
    assert abs((embeddings.estimates(64, a, b) - exact).mean()) < 0.01
    far = np.bitwise_count(a.code ^ embeddings.codes(rng.standard_normal((4000, 64))).code).sum(1) > np.maximum(a.most, b.most)
    assert far.mean() > 0.95


def test_dense_strips_decide_as_sparse_ones(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(32) + rng.standard_normal((260, 32)) * 0.14
    want = embeddings.links(x, x)
    monkeypatch.setattr(embeddings, "MANY", 1)
    assert (embeddings.links(x, x) == want).all() and 0.01 < want.mean() < 0.99


def test_places(spark):
    shards = sharding.tree(8)
    keys = spark.range(4000)
    at = lambda tree: np.array([r[0] for r in keys.select(sharding.place(F.col("id"), tree)).orderBy("id").collect()])
    now, then = at(shards), at(sharding.grow(shards))
    assert set(now) == set(range(8)) and np.bincount(now).min() > 400
    moved = now != then
    assert set(then[moved]) == {8} and 350 < moved.sum() < 550
    # another weight of one shard moves rows between its subtree and others, or within it
    heavy = [sharding.Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 0 else 1.0) for s in shards]
    more = at(heavy)
    assert not ((now != more) & (now >= 4) & (more >= 4)).any() and not ((now != more) & np.isin(now, [2, 3]) & np.isin(more, [2, 3])).any()
    assert sharding.place(F.col("id"), [sharding.Shard(0, 0, 0)]) is not None
    with pytest.raises(ValueError):
        sharding.place(F.col("id"), [sharding.Shard(0, 0, 0, 0.0)])


def plain_place(key, shards):
    """By hand: at each level the child with the least variate."""
    def draw(level, child, weight):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42) if key is not None else 42
        h = xxhash.xxh64_intdigest(struct.pack("<i", child), xxhash.xxh64_intdigest(level.encode(), h))
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    def least(level, children):
        return min((draw(level, c, w), c) for c, w in children.items() if w > 0)[1]

    def total(by):
        out = {}
        for s in shards:
            out[by(s)] = out.get(by(s), 0) + s.weight
        return out

    region = least("region", total(lambda s: s.region))
    shards = [s for s in shards if s.region == region]
    rack = least(f"rack of {region}", total(lambda s: s.rack))
    return least(f"shard of {region}.{rack}", {s.shard: s.weight for s in shards if s.rack == rack})


def test_places_by_hand(spark):
    rng = random.Random(3)
    for shards in (sharding.tree(8), sharding.grow(sharding.tree(8)), sharding.tree(1), [sharding.Shard(100 - k, rng.randrange(5), rng.randrange(3), rng.choice([0.0, 0.5, 1.0, 4.0])) for k in range(40)]):
        keys = [None, *(rng.randrange(-(2**63), 2**63) for _ in range(150))]
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.place(F.col("k"), shards)).collect()
        assert {r[0]: r[1] for r in got} == {k: plain_place(k, shards) for k in keys}


def test_thousands_of_shards(spark):
    shards = sharding.tree(5000, 10, 20)
    got = spark.range(20_000).select(sharding.place(F.col("id"), shards).alias("s")).groupBy("s").count().collect()
    assert len(got) > 4800 and max(r["count"] for r in got) < 30


def test_op9_by_hand(spark, docs, rows, tmp_path):
    more = spark.createDataFrame([(None, "x", "en", "a", 1, 0.0, "s", 1)] * 2, docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op9_hash_tree(spark, str(tmp_path)).collect()
    shards = sharding.tree(8)
    want = sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), plain_place(r.doc_id, shards), plain_place(r.doc_id, sharding.grow(shards))) for r in rows)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got if r["doc_id"] is not None) == want
    assert {r["law"] for r in got} == {"key"} and sum(r["doc_id"] is None for r in got) == 2
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    for s in range(8):
        mine = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(mine) == list(range(len(mine)))
    spark.read.parquet(str(tmp_path / "documents.parquet")).where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert sharding.op9_hash_tree(spark, str(tmp_path / "none")).collect() == []


def test_slots(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice([None, *range(300)]), "x", 5) for _ in range(500)], "doc_id long, shard string, slot int")
    got = sharding.shard(df, "doc_id", sharding.tree(4)).toPandas()
    assert len(got) == 500
    for _, rows in got.groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows)))
    assert sharding.shard(df.where("false"), "doc_id", sharding.tree(4)).collect() == []


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with documents, of which some hold a secret or a toxic word, and labels."""

    def make(rows, columns="doc_id long, text string, lang string, source string, n_chars long", name="in"):
        folder = tmp_path / name
        spark.createDataFrame(rows, columns).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(r[0], 1, int("vermin" in (r[1] or ""))) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        return str(folder)

    return make


def texts(n, seed=0):
    rng = random.Random(seed)
    words = [a + b for a in "the of en ti on ra lo mi".split() for b in ("", "n", "ster", "lo")]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        if i % 4 == 0:
            w[3:3] = ["vermin", "vermin", "rotten"]
        if i % 5 == 0:
            w.insert(7, "password=hunter2hunter2")
        out.append(" ".join(w))
    return out


def test_pipeline_against_plain_stages(spark, tables, tmp_path):
    """Each stage on all that the one before it kept, by hand: no toxic text, one of each group, no secret, the mix's words, the ids."""
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from graphloom.llm import bytebpe, toxicity
    from tests.llm.test_words import WORD, plain_classes, plain_targets

    base = texts(60)
    base += [base[5], base[6].replace("the", "the", 1), base[7] + " more", None, "", "two words", base[9]]
    rows = [(i * 2, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(base)] + [(None, base[10], "en", "a", 1)]
    folder = tables(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r.asDict().get("text") or "")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(str(tmp_path / f"s{k}"))
        kept.append(spark.read.parquet(str(tmp_path / f"s{k}")))
        assert k == 4 or kept[-1].columns == docs.columns
    tables_ = [sorted(d.collect(), key=key) for d in kept]
    model = toxicity.fit_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {t: p >= 0.7 for t, p in zip(base, model.scores(pa.array(base, pa.string())), strict=True)}
    assert tables_[1] == [r for r in tables_[0] if not bad[r["text"]]] and 0 < sum(bad.values()) < 40
    known = [r for r in tables_[1] if r["doc_id"] is not None]
    classes = plain_classes(known)
    assert tables_[2] == [r for r in tables_[1] if r["doc_id"] is None or classes[r["doc_id"]][1] == r["doc_id"]]
    assert len(tables_[2]) < len(tables_[1])
    clean = lambda t: t and t.replace("password=hunter2hunter2", "[SECRET]")
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in tables_[3]] == [(r["doc_id"], clean(r["text"]), None if r["text"] is None else len(clean(r["text"]))) for r in tables_[2]]
    size, taken, whole = {}, {}, {(r["doc_id"], r["source"]): r["text"] for r in tables_[3]}
    for r in tables_[3]:
        size[r["source"]] = size.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    for r in tables_[4]:
        assert r["text"] in whole[r["doc_id"], r["source"]] and r["n_chars"] == len(r["text"])
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORD.findall(r["text"]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for s, goal in zip(names, plain_targets([size[s] for s in names], [5, 2, 1]), strict=True):
        assert abs(taken.get(s, 0) - goal) <= 3 * 64
    codec = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    assert sorted((str(r["doc_id"]), r["ids"]) for r in tables_[5]) == sorted((str(r["doc_id"]), codec.encode_ordinary(r["text"])) for r in tables_[4])
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(r["doc_id"]), r["ids"]) for r in tables_[5])


def test_pipeline_of_odd_tables(spark, tables):
    import corpus_pipeline

    none = tables([], name="none")
    assert corpus_pipeline.run(spark, none).collect() == []
    # no n_chars, further columns with names that operators use, repeated rows and ids
    odd = tables([(1, "a b c d e f g", "x", 1.0), (1, "a b c d e f g", "x", 1.0), (2, None, None, 2.0), (3, "", "y", 3.0), (4, "one text more than that", "y", 4.0)], "doc_id long, text string, source string, score double", "odd")
    got = corpus_pipeline.run(spark, odd).collect()
    assert {r["doc_id"] for r in got} <= {1, 4} and got


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r.doc_id, 1, int(i % 5 == 0)) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "secret scans", "mixing sources", "byte-level BPE"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        out = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert k == 4 or out.columns == now.columns
        assert 0 < out.count() and {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in now.select("doc_id").collect()}
        now = out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r["doc_id"] for r in now.collect()}


def test_pipeline_hands_python_small_batches(spark):
    """A task's texts were one batch, up to Spark's 64 MB; a size that the session sets stays."""
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")

    def told(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "rows"])

    spark.conf.unset(name)
    try:
        corpus_pipeline.secrets_out(spark, docs, "")
        found = docs.mapInArrow(told, "bytes long, rows long").collect()
        assert max(r["bytes"] for r in found) < 6e6 and sum(r["rows"] for r in found) == 3000
        spark.conf.set(name, "1m")
        corpus_pipeline.secrets_out(spark, docs, "")
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)


def test_memory_goes_back_when_a_task_ends(monkeypatch):
    from graphloom.llm import textkit

    ends = []
    monkeypatch.setattr(textkit, "give_back", lambda: ends.append(1))
    rows = textkit.tidy(iter)([1, 2])
    assert next(rows) == 1 and not ends
    assert list(rows) == [2] and ends == [1]
