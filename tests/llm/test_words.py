"""Operators on words and n-grams: 3, 5, 7."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import interpolation, mixing, shingles, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_words_of_sliced_and_null_columns():
    texts = ["drop", "Ab c", None, "", " x\ty ", "ab  C"]
    column = pa.array(texts, pa.string()).slice(1)
    data, offs = textkit.buffers(column)
    s, e, doc = textkit.find_words(data, offs)
    got = [(d, bytes(data[a:z]).decode()) for a, z, d in zip(s, e, doc, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts[1:]) for w in WORD.findall(t or "")]
    h = textkit.word_hashes(data, s, e)
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 4


def shingle_set(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def plain_classes(rows):
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("common", [(3, 16), (1, 1)])
def test_jaccard(docs, rows, monkeypatch, common):
    monkeypatch.setattr(shingles, "LOCAL", common[0])
    monkeypatch.setattr(shingles, "COMMON", common[1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.jaccard_classes(docs).collect()}
    want = plain_classes(rows)
    assert got == want and any(d != c for d, (_, c) in want.items())


def test_jaccard_links_within_groups_of_several_blocks(spark, monkeypatch):
    """Sets that are all far from the group's least, and near to each other."""
    monkeypatch.setattr(shingles, "CROWD", 2)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:60] + [f"x{k}{i}" for i in range(40)]) for k in range(4)]
    texts += [" ".join(base[:60] + [f"x{k}{i}" for i in range(38)] + ["end", f"e{k}"]) for k in range(4)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in shingles.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 4 for i in range(8)}


@pytest.mark.parametrize("crowd", [1000, 7])
def test_jaccard_of_one_cluster_about_the_threshold(spark, monkeypatch, crowd):
    """Copies of one text with so many changes that some link and some do not."""
    monkeypatch.setattr(shingles, "CROWD", crowd)
    rng = np.random.default_rng(7)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(90):
        w = list(base)
        for at in rng.integers(0, len(w), rng.integers(1, 7)):
            w[at] = f"x{k}y{at}"
        rows.append((1000 - k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    from collections import namedtuple

    want = plain_classes([namedtuple("R", "doc_id text")(*r) for r in rows])
    assert got == want and 1 < len({c for _, c in want.values()}) < 90


def test_connect_against_all_pairs():
    rng = np.random.default_rng(3)
    for trial in range(40):
        m, pool = int(rng.integers(2, 40)), int(rng.integers(20, 60))
        sets = [np.unique(rng.choice(pool, int(rng.integers(pool // 2, pool)))) for _ in range(m)]
        own = rng.integers(0, 8, m)  # members that no other set has
        n, offsets = np.array([len(s) for s in sets]) + own, np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        asks = rng.random(m) < 0.4 if trial % 2 else None
        if asks is not None and not asks.any():
            continue

        def classes(edges):
            root = list(range(m))
            for _ in range(m):
                for a, b in edges:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
        want = [(a, b) for a in range(m) for b in range(a) if (asks is None or asks[a] or asks[b]) and 100 * both(a, b) >= 80 * (n[a] + n[b] - both(a, b))]
        got = shingles.connect(n, offsets, np.concatenate(sets), np.arange(m), asks)
        assert classes(got) == classes(want) and len(got) <= m


def test_sieve_keeps_runs_across_batches():
    rng = np.random.default_rng(5)
    rows = sorted(zip(rng.integers(0, 30, 300).tolist(), rng.integers(0, 9, 300).tolist(), strict=True))
    size = {s: 10 + s for s in range(9)}
    tiles: dict[int, set] = {}
    for k, s in rows:
        tiles.setdefault(k, set()).add(s)
    want = Counter(s for sets in tiles.values() if len(sets) > 1 for s in sets)
    for step in (1, 2, 7, 300):
        got = Counter()
        batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in part], "set": [s for _, s in part], "n": [size[s] for _, s in part]}) for part in (rows[i : i + step] for i in range(0, 300, step))]
        for b in shingles._shared(iter(batches)):
            for s, n, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                assert n == size[s]
                got[s] += c
        assert got == want


def test_one_of_each_class(docs, rows, empty):
    kept = shingles.one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in plain_classes(rows).items() if d == c}
    assert shingles.one_of_each_class(empty).collect() == []


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A  B C D E F")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in shingles.jaccard_classes(df).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 0, None), ("None", 2, 1)]
    assert len(shingles.one_of_each_class(df).collect()) == 3


def test_prefixes_bound_every_link():
    """Of sets that link, the longer prefixes in one order share as much as the sieve asks, and they meet in a band."""
    rng = np.random.default_rng(0)
    for n in range(1, 200):
        for m in range(n, n * 100 // 80 + 1):
            assert set(shingles.bands(n)) & set(shingles.bands(m))
            both = -(-80 * (n + m) // 180)
            if both > n:
                continue
            a, b = np.arange(n), np.concatenate((np.arange(both), np.arange(1000, 1000 + m - both)))
            order = rng.permutation(2000)
            a, b = a[np.argsort(order[a])], b[np.argsort(order[b])]
            head = lambda x: set(x[: len(x) - shingles.least_shared(len(x)) + shingles.spare(len(x))].tolist())
            shared = len(head(a) & head(b))
            for x in (n, m):
                assert shared >= max(1, shingles.least_shared(x) // shingles.MORE)


def plain_scores(rows):
    """Counts, weights and scores by dictionaries; the weights by the same rounds of expectation-maximisation."""
    I = interpolation
    texts = [(r.doc_id, ["<s>", "<s>", *WORD.findall(lower(r.text)), None]) for r in rows]
    crc = lambda d: zlib.crc32(str(d).encode()) % 10

    def count(some):
        c = Counter()
        for t in some:
            c["one",] += 0
            for i in range(2, len(t)):
                c[t[i],] += 1
                c[t[i - 1], t[i]] += 1
                c[t[i - 2], t[i - 1], t[i]] += 1
            c["<s>",] += 1
            c["<s>", "<s>"] += 1
        return c

    c = count(t for d, t in texts if crc(d))
    n, v = sum(len(t) - 2 for d, t in texts if crc(d)), sum(1 for k in c if len(k) == 1 and k != ("<s>",) and c[k])

    def parts(c, t, i, n):
        often = c[t[i - 1],], c[t[i - 2], t[i - 1]]
        b = I.BUCKETS + min(I.BUCKETS - 1, math.ceil(math.log2(often[1] + 1))) if often[1] else min(I.BUCKETS - 1, math.ceil(math.log2(often[0] + 1)))
        return b, [c[tuple(t[i - 2 : i + 1])] / often[1] if often[1] else 0, c[t[i - 1], t[i]] / often[0] if often[0] else 0, c[t[i],] / max(n, 1)]

    seen = []
    for d, t in texts:
        if crc(d) == 1:
            less = c.copy()
            less.subtract(count([t]))
            for i in range(2, len(t)):
                b, p = parts(less, t, i, n - len(t) + 2)
                seen.append((b, [2.0 ** (-min(I.STEPS[k] - 1, round(-I.FINE[k] * math.log2(x))) / I.FINE[k]) if x else 0 for k, x in enumerate(p)] + [1 / (v + 1)]))
    w = np.full((2 * I.BUCKETS, 4), 0.25)
    for _ in range(60):
        new = np.tile([0.5, 0.5, 1.0, 0.5], (2 * I.BUCKETS, 1))
        for b, p in seen:
            share = w[b] * p
            new[b] += share / share.sum()
        w = new / new.sum(1, keepdims=True)
    for b in range(I.BUCKETS):
        w[b] = [0, w[b, 0] + w[b, 1], w[b, 2], w[b, 3]]
    w[0] = [0, 0, w[0, 1] + w[0, 2], w[0, 3]]
    out = {}
    for d, t in texts:
        base = score = 0.0
        for i in range(2, len(t)):
            b, p = parts(c, t, i, n)
            score += math.log10(sum(x * y for x, y in zip(w[b], [*p, 1 / (v + 1)], strict=True)))
            base += math.log10((c[t[i],] + 0.1) / (n + 0.1 * (v + 1)))
        out[d] = (crc(d) == 0, len(t) - 2, sum(c[x,] > 0 for x in t[2:]), n, base, score)
    return out


def test_scores(docs, rows):
    """Against dictionaries, on whole texts; with clashing names."""
    want = plain_scores(rows)
    got = {r["doc_id"]: r for r in interpolation.interpolated_scores(docs).collect()}
    assert got.keys() == want.keys() and {w[0] for w in want.values()} == {True, False}
    for d, (held, size, known, n, base, score) in want.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, size, known, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_repeated_rows_are_scored_alike(spark, tmp_path):
    rows = [(d, "a b a b c") for d in (1, 2, 2, 3, None)] + [(d, f"a b {d}") for d in range(10, 40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    got = interpolation.interpolated_scores(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert len(got) == len(rows) and len({round(r["score"], 9) for r in got if r["n_tokens"] == 6}) == 1
    assert sum(r["n_tokens"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 10 and r["doc_id"] is not None) == got[0]["train_tokens"]


def test_totals_above_32_bits():
    big = 2**31
    t = pa.table({"block": [0, 1, 2], "kind": [1] * 3, "range": [0] * 3, "keys": [interpolation._pack(np.array([7], np.uint64))] * 3, "counts": [interpolation._pack(np.array([big], np.uint32))] * 3})
    down = interpolation._meet(t)
    assert [interpolation._unpack(x.as_buffer(), np.int64).tolist() for x in down.column("totals")][:3] == [[3 * big]] * 3 and down.column("tokens").to_pylist()[-1] == 3 * big


def test_weights_make_distributions():
    """The mix over all tokens, known and unknown, is a distribution for every context bucket that has been seen."""
    s = interpolation.STEPS
    cell = lambda b, *steps: ((b * (s[0] + 1) + steps[0]) * (s[1] + 1) + steps[1]) * (s[2] + 1) + steps[2]
    mix = interpolation.weights(np.array([cell(3, 0, 4, 10), cell(0, 0, 0, 20), cell(interpolation.BUCKETS + 2, 3, 5, 9)]), np.array([5.0, 2.0, 3.0]), 0.01)
    assert np.allclose(mix.sum(1), 1) and (mix >= 0).all() and not mix[0, :2].any() and not mix[: interpolation.BUCKETS, 0].any()


def test_scores_of_nothing(empty, spark):
    assert interpolation.interpolated_scores(empty.select("doc_id", "text")).collect() == []
    only = interpolation.interpolated_scores(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in only] == [(True, 1, 0, 0)]


def plain_targets(sizes, weights, share=1.5, most=2.0):
    """By hand: who is full gets ``most`` times its size, the others share what is left."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 0, 5], [], [0], [7], list(range(1, 400, 3)), [1, 2, 4, 8, 16, 32, 64, 128, 100_000]])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "code long, source_size long")
    got = [r["target"] for r in mixing.targets(df, (5, 2, 1), 1.5, 2).orderBy("code").collect()]
    assert got == pytest.approx(plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


def test_sources_are_numbered_by_code_points(spark):
    names = ["b", "é", "a", "\U0001f600", "\uffff", "", None, "Z"]
    df = spark.createDataFrame([(n,) for n in names], "source string")
    got = {r["source"]: r["code"] for r in mixing._numbered(df).collect()}
    assert got == {n: i for i, n in enumerate([*sorted(n for n in names if n is not None), None])}


def test_more_sources_than_are_drawn_together(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 10)
    rng = np.random.default_rng(4)
    rows = [(i, f"s{int(rng.integers(95)):02}", int(rng.integers(0, 200))) for i in range(900)] + [(900, None, 50), (900, None, 50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mix = mixing.Mix(df, ["doc_id"], block=8)
    out = mix.taken(["doc_id"]).join(mix.sources.drop("rows"), "code").collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = Counter()
    for _, s, n in rows:
        by[s] += n
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, plain_targets([by[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    for s in names:
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= 3 * 8 and math.isclose(mine[0]["target"], goal[s])
    empty = mixing.Mix(df.where("false"), ["doc_id"])
    assert empty.taken(["doc_id"]).collect() == [] and empty.sources.collect() == []


def test_op5_on_a_table(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op5_mix(spark, str(tmp_path)).collect()
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    assert {r["doc_id"]: r["size"] for r in got} == sizes and len(got) == len(sizes)
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    by = [sum(sizes[r.doc_id] for r in rows if r.source == s) for s in names]
    goal = dict(zip(names, zip(by, plain_targets(by, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True), strict=True))
    source, taken = {r.doc_id: r.source for r in rows}, Counter()
    for r in got:
        assert r["source_size"] == goal[source[r["doc_id"]]][0] and math.isclose(r["target"], goal[source[r["doc_id"]]][1]) and r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - goal[s][1]) <= 3 * mixing.BLOCK for s in names)
    assert {(r["doc_id"], r["taken"]) for r in mixing.op5_mix(spark, str(tmp_path)).collect()} == {(r["doc_id"], r["taken"]) for r in got}


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 17, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(0))).collect()]
        assert sorted(got) == list(range(n)) and (n < 17 or got != sorted(got))


def test_mix(docs, rows):
    narrow = docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size"))
    mix = mixing.Mix(narrow, ["doc_id"], block=8)
    out = mix.taken(["doc_id"]).join(mix.sources, "code").collect()
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    assert {r["doc_id"]: r["size"] for r in out} == sizes and len(out) == len(sizes)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    by = [sum(sizes[r.doc_id] for r in rows if r.source == s) for s in names]
    goal = dict(zip(names, plain_targets(by, [5, 2, 1, 5][: len(names)]), strict=True))
    for s in names:
        taken = sum(r["taken"] for r in out if r["source"] == s)
        assert abs(taken - goal[s]) <= 3 * 8 and all(math.isclose(r["target"], goal[s]) for r in out if r["source"] == s)
    again = mixing.Mix(narrow.repartition(5), ["doc_id"], block=8).taken(["doc_id"]).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in out}


def test_mixed_documents(docs, rows, empty, spark):
    narrow = docs.select("doc_id", "source", mixing.word_count(docs["text"]).alias("size"))
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in rows}
    words = Counter()
    for r in got.collect():
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert sum(words.values()) == pytest.approx(1.5 * sum(len(WORD.findall(t or "")) for t in texts.values()), abs=64 * 4)
    assert mixing.mixed_documents(empty).collect() == []
    made = spark.createDataFrame(rows, docs.schema)  # not a scan of files
    assert {r["doc_id"] for r in mixing.mixed_documents(made).collect()} <= set(texts)
    assert narrow.count() == len(rows)
