"""Blocks, matches, components and merging against plain Python."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions import text as T
from graphloom.operators import match, merge
from graphloom.operators.components import connected_components
from graphloom.plans import pairs as P
from graphloom.sources.ntriples import read_lines


def grams(x):
    p = f"  {x}  "
    return {p[i : i + 3] for i in range(len(p) - 2)}


def keys(x, s):
    b = len(x) // s.bucket_width
    return {(c, g) for g in sorted(grams(x), key=T.gram_hash)[: s.anchors] for c in (b - 1, b, b + 1) if c >= 0}


def plain_align(left, right, s):
    """Pairs and scores of (uri, label) lists; every block by itself."""
    out, blocks, same = {}, defaultdict(lambda: (set(), set())), defaultdict(lambda: (set(), set()))
    for side, rows in enumerate((left, right)):
        for uri, label in rows:
            same[label][side].add(uri)
            for k in keys(label, s):
                blocks[k][side].add((uri, label))
    for a, b in same.values():
        if len(a) * len(b) <= s.max_comparisons_per_block:
            out |= {(x, y): 1.0 for x in a for y in b}
    for a, b in blocks.values():
        if len(a) * len(b) <= s.max_comparisons_per_block:
            for (x, p), (y, q) in itertools.product(a, b):
                if min(len(p), len(q)) / max(len(p), len(q)) < s.threshold * 0.80:
                    continue
                g, h = grams(p), grams(q)
                if 2 * len(g & h) / (len(g) + len(h)) < s.trigram_threshold:
                    continue
                score = max(T.ratio(p, q), T.ratio(" ".join(sorted(p.split())), " ".join(sorted(q.split()))))
                if score >= s.threshold:
                    out[x, y] = max(out.get((x, y), 0), score)
    return out


def sample(n, seed):
    rng = random.Random(seed)
    words = ["red", "plate", "plates", "river", "rivers", "new", "york", "city", "football", "footbal", "player"]
    return [(f"u{seed}/{i % (n * 3 // 4)}", " ".join(rng.choices(words, k=rng.randint(1, 3)))) for i in range(n)]


@pytest.mark.parametrize("s", [match.Settings(), match.Settings(0.7, 0.4), match.Settings(0.7, 0.4, max_comparisons_per_block=40), match.Settings(0.5, 0.1, anchors=1, bucket_width=2)])
def test_align(spark, s):
    left, right = sample(60, 1), sample(50, 2)
    got = match.align(spark.createDataFrame(left, "uri string, label string"), spark.createDataFrame(right, "uri string, label string"), s).collect()
    assert {(r["left"], r["right"]): r["score"] for r in got} == plain_align(left, right, s)
    assert len(got) == len({(r["left"], r["right"]) for r in got})


def test_higher_thresholds_only_remove(spark):
    left, right = (spark.createDataFrame(sample(40, k), "uri string, label string") for k in (3, 4))
    low, high = ({(r["left"], r["right"]) for r in match.align(left, right, match.Settings(t, 0.4)).collect()} for t in (0.8, 0.95))
    assert high < low


def test_settings():
    for bad in ({"threshold": 1.1}, {"trigram_threshold": -0.1}, {"anchors": 0}, {"bucket_width": 0}, ):
        with pytest.raises(ValueError):
            match.Settings(**bad)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "uri string, label string")
    assert match.align(none, none).collect() == []


def test_pairs_are_apart(spark):
    rows = [("c1", "http://a", "Red Plate"), ("c2", "http://b", "red plate")]
    inst = spark.createDataFrame(rows, "class_iri string, iri string, label string")
    pairs = P.pair_ids(spark.createDataFrame([(1, "c1", "c2"), (2, "c1", "c1")], "position int, left_iri string, right_iri string"))
    got = P.align_pairs(pairs, inst, inst).collect()
    assert {(r["pair_id"][:6], r["left"], r["right"]) for r in got} == {("000001", "http://a", "http://b"), ("000002", "http://a", "http://a")}
    done = pairs.where("position = 1").select("pair_id")
    assert {r["pair_id"][:6] for r in P.align_pairs(pairs, inst, inst, done=done).collect()} == {"000002"}


def plain_roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root) if find(x) != x}


@pytest.mark.parametrize("kind", ["chain", "random", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {"chain": [(i, i + 1) for i in range(60)], "random": [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(70)], "star": [(7, i) for i in range(50)] + [(3, 3)], "none": []}[kind]
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == plain_roots([e for e in edges if e[0] != e[1]])


def test_canonical(spark):
    links = spark.createDataFrame([("http://a/%41", "http://a/bb", 0.9), ("http://a/bb", "http://a/BB", 0.7), ("http://a/BB", "http://a/ccc", float("nan")), ("http://a/ccc", "http://z", 0.69), ("http://q", "http://q", 1.0)], "left string, right string, score double")
    got = {r["old"]: r["canonical"] for r in merge.canonical_mapping(links).collect()}
    assert got == {"http://a/%41": "http://a/BB", "http://a/bb": "http://a/BB", "http://a/BB": "http://a/BB", "http://a/ccc": "http://a/BB", "http://z": "http://z", "http://q": "http://q"}


def test_from_files_to_one_graph(spark, tmp_path):
    label = "<http://www.w3.org/2000/01/rdf-schema#label>"
    (tmp_path / "l.nt").write_text(f'<http://l/berlin> {label} "Berlin" .\n<http://l/berlin> <http://p> <http://l/paris> .\n<http://l/paris> {label} "Paris" .\n')
    (tmp_path / "r.nt").write_text(f'<http://r/Q64> {label} "BERLIN" .\n<http://r/Q64> {label} "Berlin" .\n<http://r/Q90> {label} "Lutetia" .\n')
    l, r, links, out, maps = (str(tmp_path / x) for x in ("l.nt", "r.nt", "links", "graph", "maps"))
    cli.main(["align", "--left-input", l, "--right-input", r, "--left-kg", f"s {label[1:-1]} ?", "--right-kg", f"s {label[1:-1]} ?", "--out", links], spark)
    assert [x[0] for x in spark.read.text(links).collect()] == ["<http://l/berlin>\t<http://r/Q64>\t1.000000"]
    cli.main(["merge", "--links", links, "--rewrite", l, r, "--out-dir", out, "--out-mapping", maps, "--one-graph"], spark)
    got = sorted(x[0] for x in read_lines(spark, out).collect())
    assert got == sorted(['<http://r/Q64> <http://p> <http://l/paris> .', f'<http://r/Q64> {label} "Berlin" .', f'<http://r/Q64> {label} "BERLIN" .', f'<http://l/paris> {label} "Paris" .', f'<http://r/Q90> {label} "Lutetia" .'])
    assert [x[0] for x in spark.read.text(maps).collect()] == ["http://l/berlin\thttp://r/Q64"]
    cli.main(["distinct", l, l, str(tmp_path / "d")], spark)
    assert [x[0] for x in spark.read.text(str(tmp_path / "d")).orderBy("value").collect()] == sorted((tmp_path / "l.nt").read_text().splitlines())
    assert spark.read.text(str(tmp_path / "d")).where(F.col("value") == "").count() == 0
