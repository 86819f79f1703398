"""Spots that depend on what is near them only."""

from pyspark.sql import functions as F

from graphloom.llm import spotsigs


def spots_of(text: str) -> set[str]:
    """By hand: anchor spots, pairs of stretches of more than SPARSE words without a spot's start, pairs of all if there is nothing else."""
    w = text.split()
    anchor = lambda i: i < 0 or (i < len(w) and w[i] in spotsigs.ANCHORS)
    out, starts = set(), [0]
    for i in range(-1, len(w) - 1):
        if anchor(i) and not anchor(i + 1):
            chain = [x for x in w[i + 1 : i + 1 + spotsigs.CHAIN]]
            out.add(" ".join([w[i] if i >= 0 else "^", *(chain[:1] if anchor(i + 2) else chain)]))
            starts += [i] if i > 0 else []
    for a, z in zip(starts, [*starts[1:], len(w)], strict=True):
        if z - a > spotsigs.SPARSE:
            out |= {f"{w[i]} {w[i + 1]}" for i in range(a, z - 1)}
    return out or {f"{x} {y}" for x, y in zip(w, w[1:])} or set(w)


RARE = " ".join(f"junk{i}" for i in range(120))
PROSE = " ".join(f"the house{i} was green{i}" for i in range(40))
TEXTS = [RARE, PROSE, f"{RARE} {PROSE}", f"{PROSE} {RARE}", "in " * 80 + "end", "the of and", "the", "house", "", f"the {RARE}", " ".join(["x"] * 24), " ".join(["x"] * 25), "the x the y of of z", "of the " + "z " * 23]


def test_local_spots(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, text string").select("i", spotsigs.spots(spotsigs.normal(F.col("text"))).alias("s"))
    got = {r["i"]: r["s"] for r in df.collect()}
    assert {i: set(s) for i, s in got.items()} == {i: spots_of(t) for i, t in enumerate(TEXTS)} and all(len(s) == len(set(s)) for s in got.values())


def test_an_edit_leaves_the_rest_of_a_sparse_text_alike(spark, tmp_path):
    spark.createDataFrame([(2, RARE), (1, PROSE)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    near = {r["doc_id"]: r["near_edited"] for r in spotsigs.op2_spotsigs(spark, str(tmp_path)).collect()}
    assert near[2] > 0.4
