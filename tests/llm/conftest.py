import random

import pytest
from pyspark.sql import Row


def corpus(n: int = 60, seed: int = 0) -> list[Row]:
    """Documents with copies, near copies, shared passages, odd texts and clashing further columns."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "the of en ti on ra lo mi ka su".split() for b in ("", "n", "ster", "é", "lo")]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = make(30)
    texts = [None, "", " \t\n", "one", "two words", "Ünï ΣΑΣ 😀 日本語\x0b x", "a" * 3000, make(6000), "A B C D E", "a b\tc\nd  e"]
    while len(texts) < n:
        base = make(rng.randint(5, 120))
        texts.append(base)
        kind = rng.random()
        if kind < 0.2:
            texts.append(base)
        elif kind < 0.5:
            w = base.split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif kind < 0.7:
            texts.append(f"{make(20)} {passage} {make(20)}")
    return [Row(doc_id=i * 3, text=t, lang="en", source=[None, "a", "b", "b", "b", "é"][i % 6], n_chars=len(t or ""), score=0.5, slot="x", block=1) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, slot string, block int"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
