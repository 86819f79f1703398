"""Document fingerprints by SpotSigs (operator 2), in DataFrame functions only.

A text's words are runs of letters and digits, lower-cased. A spot is an anchor, a common word or the start of the
text, with the chain of up to CHAIN content words that follow it before the next anchor. Each stretch of more than SPARSE words
in which no spot starts, as in a language without any of the listed anchors, gives its pairs of adjacent words besides; a
text without any spot gives all its pairs, or its only word. So what is unchanged keeps its spots, whatever the rest of
the text is. The set of a text's spots is its signature, the fingerprint is a digest of the sorted set, and likeness is the
Jaccard index of two sets. The query compares each text with its edited copy and with the next document's, whose pairs are given.
``spot_pairs`` finds all pairs of a table at or above a likeness: sets are partitioned by length,
and a pair is compared only if its lengths, and the place of the first spot that it shares, leave the threshold
within reach.

Cases: null text counts as empty, whose set is empty; two empty sets have likeness 1, an empty and another 0; equal
texts have equal fingerprints; rows of equal doc_id are ordered by the MD5 of their texts, null doc_ids come last; one document alone
is its own next; an empty table gives an empty result; whole texts are taken; further columns are not read.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Common words of four languages.
ANCHORS = (
    "a an and are as at be by for from has have he his in is it of on or that the this to was were which with "
    "aber als auf aus bei das dem den der des die ein eine einen er es für im ist mit nicht oder sich sie und von war wie zu "
    "au aux ce dans de du elle en est et il la le les mais ne par pas plus pour que qui sa se son sur un une "
    "al con como del el lo los las no para pero por su sus una y"
).split()
CHAIN = 2
SPARSE = 24
MOST_RANGES = 1 << 16


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used: inside lambdas nothing is shared otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(w: Column) -> Column:
    """The spots at anchors and at the start."""
    parts = F.split(F.concat(F.lit("^ "), w), f" (?=(?:{'|'.join(ANCHORS)})(?: |$))")
    # the start's own run may be empty, or end in the blank that follows it
    return F.filter(F.transform(parts, lambda r: F.substring_index(F.rtrim(r), " ", CHAIN + 1)), lambda r: F.instr(r, " ") > 0)


def _pairs(every: Column) -> Column:
    return F.filter(F.zip_with(every, F.slice(every, F.lit(2), F.greatest(F.size(every), F.lit(1))), lambda x, y: F.concat(x, F.lit(" "), y)), lambda x: x.isNotNull())


def spots(words: Column) -> Column:
    """The distinct spots of a ``normal`` text."""
    anchors = "|".join(ANCHORS)

    def stretches(w: Column) -> Column:
        parts = F.split(w, f" (?=(?:{anchors}) (?!(?:{anchors})(?: |$)))")
        return F.filter(parts, lambda r: r.rlike(f"^(?:[^ ]++ ){{{SPARSE}}}"))

    def of(every: Column) -> Column:
        return F.when(F.size(every) > 1, _pairs(every)).otherwise(every)

    def all_(w: Column, found: Column) -> Column:
        long_ = F.flatten(F.transform(stretches(w), lambda r: _once(F.split(r, " "), _pairs)))
        return _once(F.array_distinct(F.concat(found, long_)), lambda x: F.when((F.size(x) == 0) & (w != ""), F.array_distinct(_once(F.split(w, " "), of))).otherwise(x))

    return _once(words, lambda w: _once(_runs(w), lambda found: all_(w, found)))


def digest(set_: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(set_), "\n"), 256)


def likeness(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def spot_pairs(sets: DataFrame, key: str, set_: str, at_least: float = 0.8) -> DataFrame:
    """(a, b, likeness) of all rows whose sets are alike, a < b.

    Sets are partitioned by length into bands within which lengths may differ by the threshold. In the order of their
    hashes, two alike sets share one of their first ``n - ceil(n * at_least) + 1`` spots; a pair is compared where
    the first shared one is met and if lengths and places allow it.
    """
    step = 1 / at_least
    rows = sets.where(F.size(set_) > 0).select(F.col(key).alias("k"), F.array_sort(F.transform(set_, lambda s: F.xxhash64(s))).alias("h"))
    rows = rows.withColumn("n", F.size("h")).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(step)) + 1e-9).cast("int"))
    head = F.slice("h", 1, F.col("n") - F.ceil(F.col("n") * F.lit(at_least) - 1e-9).cast("int") + 1)
    entries = rows.select("k", "n", "band", F.posexplode(head).alias("p", "g"))
    x = entries.select(F.col("k").alias("a"), F.col("n").alias("an"), F.col("p").alias("ap"), "g", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"))
    y = entries.select(F.col("k").alias("b"), F.col("n").alias("bn"), F.col("p").alias("bp"), "g", "band")
    rest = F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp"))  # they may still share
    may = (F.least("an", "bn") >= F.greatest("an", "bn") * at_least - 1e-9) & (rest * (1 + at_least) >= (F.col("an") + F.col("bn")) * at_least - 1e-9)
    pairs = x.join(y, ["g", "band"]).where((F.col("a") < F.col("b")) & may).select("a", "b").distinct()
    full = pairs.join(rows.select(F.col("k").alias("a"), F.col("h").alias("ah")), "a").join(rows.select(F.col("k").alias("b"), F.col("h").alias("bh")), "b")
    return full.select("a", "b", likeness(F.col("ah"), F.col("bh")).alias("likeness")).where(F.col("likeness") >= at_least)


def _above(value: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are at or below ``value``, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.lit(cuts)
    steps = F.sequence(F.lit(len(cuts).bit_length() - 1), F.lit(0), F.lit(-1))
    reach = lambda at, k: (at + F.call_function("shiftleft", F.lit(1), k)).cast("int")
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when((reach(at, k) <= len(cuts)) & (F.get(table, reach(at, k) - 1) <= value), reach(at, k)).otherwise(at))


def with_next(docs: DataFrame, rows_a_bucket: int = 256, spots_of=spots) -> DataFrame:
    """``docs(doc_id, text)`` with ``spots``, and the next document's ``next_text`` and ``next_spots``, in descending doc_id; after the last, the first.

    Documents are dealt into ranges between quantiles of doc_id, however the ids are spread; one doc_id, or none, that has more
    rows than a range is cut into parts by the MD5 of the texts, which is its order. Each part also gets the first document of
    the part that follows, and a window orders it. The first documents are broadcast: one in ``rows_a_bucket``, at most
    about the square root of the number of documents and no more than MOST_RANGES, twice.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("md5", F.md5(F.col("text").cast("binary")))
    n = docs.count()
    size = max(rows_a_bucket, isqrt(n), ceil(n / MOST_RANGES))
    ranges = max(1, ceil(n / size))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 4 * ranges)).first()[0] if ranges > 1 else None
    docs = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_above(F.col("doc_id"), sorted(set(cuts or [])))))
    # parts of a range that is one doc_id only
    counts = docs.groupBy("range").agg(F.count("*").alias("n"), F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("one"))
    counts = counts.select("range", F.when(F.col("one"), F.ceil(F.col("n") / size)).otherwise(F.lit(1)).cast("long").alias("parts"))
    place = F.floor(F.conv(F.substring("md5", 1, 7), 16, 10).cast("long") * F.col("parts") / F.lit(1 << 28)).cast("int")
    docs = docs.join(F.broadcast(counts), "range").withColumn("part", place).drop("parts")
    # bitwise not turns the order round without leaving the type
    first = F.struct(F.bitwise_not(F.col("doc_id").cast("long")).alias("k"), "md5")
    order = Window.orderBy(F.desc("range"), "part")
    heads = docs.groupBy("range", "part").agg(F.min(first).alias("head")).withColumn("goes", F.lag(F.struct("range", "part")).over(order))
    heads = heads.withColumn("last", F.last(F.struct("range", "part")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = F.broadcast(heads.select("head", F.coalesce("goes", "last").alias("goes")))
    dealt = docs.join(heads, first.eqNullSafe(F.col("head")), "left")
    own, copy = F.struct("range", "part", F.lit(0).alias("ghost")), F.struct("goes.range", "goes.part", F.lit(1).alias("ghost"))
    dealt = dealt.withColumn("_to", F.explode(F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    dealt = dealt.select("doc_id", "text", "md5", "_to.range", "_to.part", "_to.ghost").repartition("range", "part").withColumn("spots", spots_of(normal(F.col("text"))))
    order = Window.partitionBy("range", "part").orderBy("ghost", F.desc_nulls_last("doc_id"), "md5", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_spots", F.lead("spots").over(order)).where("ghost = 0").drop("range", "part", "ghost", "md5")


def _edited(docs: DataFrame, spots_of) -> DataFrame:
    out = with_next(docs.select("doc_id", "text"), spots_of=spots_of)
    out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    out = out.withColumn("edited", edited).withColumn("edited_spots", spots_of(normal(F.col("edited"))))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("spots")).alias("fingerprint"), digest(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark.read.parquet(f"{sf_dir}/documents.parquet"), spots)


def _sql_spots(text: str) -> str:
    anchors = "[" + ", ".join(f"'{a}'" for a in ANCHORS) + "]"
    pairs = "list_transform(range(2, greatest(2, len({0})) + 1), lambda i: concat_ws(' ', {0}[i - 1], {0}[i]))"
    return f"""(SELECT CASE WHEN len(runs) + len(long_) > 0 OR w = [''] THEN list_distinct(list_concat(runs, long_)) ELSE list_distinct({pairs.format("w")}) END FROM (
      SELECT w, list_transform(list_filter(range(1, len(c) + 1), lambda i: (i = 1 OR list_contains({anchors}, c[i])) AND i < len(c) AND NOT list_contains({anchors}, c[i + 1])),
               lambda i: c[i] || ' ' || c[i + 1] || CASE WHEN i + 1 < len(c) AND NOT list_contains({anchors}, c[i + 2]) THEN ' ' || c[i + 2] ELSE '' END) AS runs,
             flatten(list_transform(list_filter(list_transform(range(1, len(b)), lambda k: w[b[k]:b[k + 1] - 1]), lambda p: len(p) > {SPARSE}), lambda p: {pairs.format("p")})) AS long_
      FROM (SELECT w, CASE WHEN w = [''] THEN ['^'] ELSE list_concat(['^'], w) END AS c,
          list_concat([1], list_filter(range(2, len(w)), lambda i: list_contains({anchors}, w[i]) AND NOT list_contains({anchors}, w[i + 1])), [len(w) + 1]) AS b
        FROM (SELECT string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w))))"""


def _sql_like(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END"


QUERIES = {"op2_spotsigs": op2_spotsigs}
SQL = {
    "op2_spotsigs": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, '')), coalesce(text, '')) AS r, count(*) OVER () AS n FROM documents),
e AS (SELECT d.doc_id, d.text, x.text AS next_text, length(d.text) AS n_chars, d.text[1:length(d.text) - length(d.text) // 3] || x.text[1:length(d.text) // 3] AS edited
      FROM d JOIN d x ON x.r = d.r % d.n + 1),
s AS MATERIALIZED (SELECT *, {_sql_spots("text")} AS s, {_sql_spots("next_text")} AS x, {_sql_spots("edited")} AS t FROM e)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(list_sort(s), chr(10))) AS fingerprint, sha256(array_to_string(list_sort(t), chr(10))) AS edited_fingerprint,
  {_sql_like("s", "t")} AS near_edited, {_sql_like("s", "x")} AS near_next FROM s
"""
}
