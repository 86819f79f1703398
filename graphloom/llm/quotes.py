"""Quotation linking (operator 4), in DataFrame functions only.

A line's quote level is the number of ``>`` at its start. A passage is a run of lines of one level; its text is
normalised (lower case, one blank for white space) and hashed, as is each of its lines. Passages and lines of level
0 are what a message says itself; quoted ones are looked up among those, first in the same conversation, then in all,
and the message in which most characters are found that are quoted at the first level is what the message answers;
characters of deeper levels, which the answered message quotes itself, count only between equals. What many messages say
counts for the earliest of them. An answer always comes after what it quotes, in the order of (conv_id, turn). A message
that quotes nothing known answers the nearest turn before it. Following the answers up gives each message its thread
and its depth in it. ``position`` is its place in the order of replies, from 0: a message comes before its answers, and each
answer, in the order of (conv_id, turn), before the next one with all that hangs on it; ``own_text`` is what is left without the
quotes, so a thread's rows in this order are the conversation (``conversations``).

What thousands of messages say is first reduced to its earliest source, before it is joined. Threads are followed by
doubling; messages that have reached their first one leave the rounds. Positions are the ranks of a tour around each tree, down
and up again, also by doubling. The turn before is looked up in spans of turns, so that no task holds a whole conversation.

Cases: null text counts as empty; repeated equal rows are one row with their number in ``copies``; rows with null conv_id or
turn have no answers and answer nothing, and no position; different texts of one (conv_id, turn) are one message of the thread; an empty
table gives an empty result; texts of any length are taken whole; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import stage, unstage

MARKS = r"^(?:[ \t]*>)+"
#: Turns that one task may put in order.
SPAN = 4096


def parse(text: Column) -> Column:
    """Lines as array<struct<level, said, normal>>."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n")

    def line(x: Column) -> Column:
        level = F.regexp_count(F.regexp_substr(x, F.lit(MARKS)), F.lit(">"))
        said = F.regexp_replace(x, MARKS, "")
        return F.struct(F.coalesce(level, F.lit(0)).alias("level"), said.alias("said"), F.trim(F.regexp_replace(F.lower(said), r"\s+", " ")).alias("normal"))

    return F.transform(lines, line)


def passages(lines: Column) -> Column:
    """array<struct<level, normal>> of runs of one level."""
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, F.greatest(i - 1, F.lit(0)))["level"]))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))
    return F.zip_with(starts, ends, lambda a, z: F.struct(F.get(lines, a)["level"].alias("level"), F.trim(F.array_join(F.transform(F.slice(lines, a + 1, z - a), lambda x: x["normal"]), " ")).alias("normal")))


def messages(rows: DataFrame) -> DataFrame:
    """Different messages with parsed ``lines`` and ``passages``."""
    rows = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("lines", parse(F.col("text")))
    return rows.withColumn("passages", passages(F.col("lines")))


def _said(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of the passages and lines that a message says itself, each once a message."""
    own = F.filter(F.concat("passages", F.transform("lines", lambda p: F.struct(p["level"].alias("level"), p["normal"].alias("normal")))), lambda u: (u["level"] == 0) & (u["normal"] != ""))
    out = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.array_distinct(own)).alias("u"))
    return out.select("conv_id", "turn", F.xxhash64("u.normal", F.lit(4)).alias("hash")).distinct()


def _quoted(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, hash, chars, outer) of quoted passages and lines, each once a message; ``outer``: it is quoted at the first level."""
    units = F.concat(*[F.transform(c, lambda p: F.struct(p["level"].alias("level"), p["normal"].alias("normal"))) for c in ("passages", "lines")])
    some = F.filter(units, lambda u: (u["level"] > 0) & (u["normal"] != ""))
    out = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.array_distinct(some)).alias("u"))
    out = out.select("conv_id", "turn", F.xxhash64("u.normal", F.lit(4)).alias("hash"), F.char_length("u.normal").alias("chars"), "u.level")
    return out.groupBy("conv_id", "turn", "hash", "chars").agg((F.min("level") == 1).alias("outer"))


def _before(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, before) of distinct (conv_id, turn): the nearest earlier turn, if there is one."""
    span = F.floor(F.col("turn") / F.lit(SPAN)).cast("long")
    rows = nodes.withColumn("span", span)
    inside = rows.withColumn("near", F.lag("turn").over(Window.partitionBy("conv_id", "span").orderBy("turn")))
    last = rows.groupBy("conv_id", "span").agg(F.max("turn").alias("last")).withColumn("far", F.lag("last").over(Window.partitionBy("conv_id").orderBy("span"))).drop("last")
    out = inside.join(last, ["conv_id", "span"])
    before = F.coalesce("near", "far")
    return out.select("conv_id", "turn", F.when(before.isNotNull(), F.struct("conv_id", before.alias("turn"))).alias("before"))


def answers(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_conv, parent_turn, by): what each message answers."""
    quoted = stage(_quoted(rows))
    said = _said(rows).join(quoted.select("hash").distinct(), "hash", "left_semi")
    near = said.groupBy("hash", "conv_id").agg(F.min("turn").alias("near_turn"))
    far = said.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("far"))
    found = quoted.join(near, ["hash", "conv_id"], "left").join(far, "hash", "left")
    here = F.when(F.col("near_turn") < F.col("turn"), F.struct("conv_id", F.col("near_turn").alias("turn")))
    there = F.when(F.struct("conv_id", "turn") > F.col("far"), F.col("far"))
    found = found.withColumn("parent", F.coalesce(here, there)).where("parent is not null")
    votes = found.groupBy("conv_id", "turn", "parent").agg(F.sum(F.when(F.col("outer"), F.col("chars")).otherwise(0)).alias("outer"), F.sum("chars").alias("chars"))
    # most characters; of equals the same conversation, then the latest
    rank = F.struct("outer", "chars", (F.col("parent.conv_id") == F.col("conv_id")).alias("same"), "parent")
    best = votes.groupBy("conv_id", "turn").agg(F.max(rank).alias("best")).select("conv_id", "turn", F.col("best.parent").alias("quoted"))
    nodes = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    out = nodes.join(best, ["conv_id", "turn"], "left").join(_before(nodes), ["conv_id", "turn"])
    parent = F.coalesce("quoted", "before")
    by = F.when(F.col("quoted").isNotNull(), F.lit("quote")).when(F.col("before").isNotNull(), F.lit("turn"))
    return out.select("conv_id", "turn", parent["conv_id"].alias("parent_conv"), parent["turn"].alias("parent_turn"), by.alias("by"))


def threads(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth): the first message above each, and how many answers lie between."""
    node, up = F.struct("conv_id", "turn"), F.struct(F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn"))
    now = stage(edges.select(node.alias("node"), F.when(F.col("parent_turn").isNotNull(), up).alias("up"), F.when(F.col("parent_turn").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.when(F.col("parent_turn").isNull(), node).alias("root")))
    while True:
        open_ = now.where("root is null")
        if not open_.take(1):
            return now.select("node.conv_id", "node.turn", F.col("root.conv_id").alias("root_conv"), F.col("root.turn").alias("root_turn"), "depth")
        above = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"))
        then = stage(now.where("root is not null").unionByName(open_.drop("root").join(above, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("root2").alias("root"))))
        unstage(now)
        now = then


def positions(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, after): how many messages of its thread come after a message in the order of replies.

    A tour goes down to each message (side 0) and up from it again (side 1); each step's rank counts the steps down from it to the end.
    """
    node, up = F.struct("conv_id", "turn"), F.struct(F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn"))
    rows = edges.select(node.alias("node"), F.when(F.col("parent_turn").isNotNull(), up).alias("up"))
    kids = rows.where("up is not null")
    then = kids.select("node", F.lead("node").over(Window.partitionBy("up").orderBy("node")).alias("sibling"))
    first = kids.groupBy("up").agg(F.min("node").alias("child")).withColumnRenamed("up", "node")
    rows = rows.join(first, "node", "left").join(then, "node", "left")
    step = lambda to, side: F.struct(to.alias("node"), F.lit(side).alias("side"))
    down = F.when(F.col("child").isNotNull(), step(F.col("child"), 0)).otherwise(step(F.col("node"), 1))
    back = F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), 0)).when(F.col("up").isNotNull(), step(F.col("up"), 1))
    both = F.array(F.struct(F.lit(0).alias("side"), down.alias("to"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(1).alias("side"), back.alias("to"), F.lit(0).cast("long").alias("n")))
    now = stage(rows.select("node", F.explode(both).alias("s")).select(F.struct("node", F.col("s.side").alias("side")).alias("at"), F.col("s.to").alias("to"), F.col("s.n").alias("n")))
    while now.where("to is not null").take(1):
        reach = now.select(F.col("at").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
        moved = now.where("to is not null").join(reach, "to").select("at", F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n"))
        then = stage(now.where("to is null").unionByName(moved))
        unstage(now)
        now = then
    return now.where("at.side = 0").select("at.node.conv_id", "at.node.turn", F.col("n").alias("after"))


def linked(rows: DataFrame) -> DataFrame:
    rows = stage(messages(rows))
    edges = stage(answers(rows))
    told = stage(threads(edges).join(positions(edges), ["conv_id", "turn"]))
    roots = told.where("depth = 0").select("root_conv", "root_turn", F.col("after").alias("all"))
    told = edges.join(told, ["conv_id", "turn"]).join(roots, ["root_conv", "root_turn"]).withColumn("position", F.col("all") - F.col("after")).drop("all", "after")
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["said"]), "\n")
    facts = rows.select(
        "conv_id", "turn", "role", "copies", F.size(F.filter("passages", lambda p: (p["level"] > 0) & (p["normal"] != ""))).alias("n_quotes"),
        F.array_max(F.transform("lines", lambda x: x["level"])).alias("deepest"), own.alias("own_text"),
    )
    return facts.join(told, ["conv_id", "turn"], "left")


def conversations(rows: DataFrame) -> DataFrame:
    """(root_conv, root_turn, position, depth, role, own_text, conv_id, turn): each thread's messages one after the other, in the order of replies, without quotes.

    A thread is a run of rows, sorted through all partitions, and not one row: a thread may be as large as the table.
    """
    out = linked(rows).where("position is not null").select("root_conv", "root_turn", "position", "depth", "role", "own_text", "conv_id", "turn")
    return out.orderBy("root_conv", "root_turn", "position", "role", "own_text")


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op4_quotes": op4_quotes}
SQL = {
    "op4_quotes": r"""
WITH RECURSIVE m AS MATERIALIZED (
  SELECT conv_id, turn, role, text, count(*) AS copies FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) GROUP BY ALL
), l AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, regexp_extract(x, '^(?:[ \t]*>)+') AS marks, regexp_replace(x, '^(?:[ \t]*>)+', '') AS said
  FROM (SELECT *, unnest(string_split_regex(text, '\r?\n')) AS x, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM m)
), f AS (
  SELECT conv_id, turn, role, text, i, len(marks) - len(replace(marks, '>', '')) AS level, said, trim(regexp_replace(lower(said), '\s+', ' ', 'g')) AS normal FROM l
), g AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, role, text ORDER BY i) AS run FROM (
    SELECT *, CASE WHEN lag(level) OVER (PARTITION BY conv_id, turn, role, text ORDER BY i) = level THEN 0 ELSE 1 END AS new FROM f)
), p AS MATERIALIZED (
  SELECT conv_id, turn, role, text, level, trim(string_agg(normal, ' ' ORDER BY i)) AS normal FROM g GROUP BY conv_id, turn, role, text, run, level
), u AS MATERIALIZED (
  SELECT conv_id, turn, level, normal FROM p WHERE normal <> '' UNION SELECT conv_id, turn, level, normal FROM f WHERE normal <> ''
), q AS (SELECT conv_id, turn, normal, min(level) = 1 AS outer_ FROM u WHERE level > 0 GROUP BY ALL),
o AS (SELECT DISTINCT conv_id, turn, normal FROM u WHERE level = 0 AND normal IN (SELECT normal FROM q)),
near AS (SELECT normal, conv_id, min(turn) AS turn FROM o GROUP BY ALL),
far AS (SELECT normal, min({'c': conv_id, 't': turn}) AS at FROM o GROUP BY ALL),
v AS (
  SELECT q.conv_id, q.turn, length(q.normal) AS chars, CASE WHEN outer_ THEN length(q.normal) ELSE 0 END AS first_,
    CASE WHEN near.turn < q.turn THEN {'c': q.conv_id, 't': near.turn} WHEN {'c': q.conv_id, 't': q.turn} > far.at THEN far.at END AS parent
  FROM q LEFT JOIN near ON near.normal = q.normal AND near.conv_id = q.conv_id LEFT JOIN far ON far.normal = q.normal
), best AS (
  SELECT conv_id, turn, max({'o': o, 'n': n, 's': parent.c = conv_id, 'p': parent}).p AS p FROM (SELECT conv_id, turn, parent, sum(first_) AS o, sum(chars) AS n FROM v WHERE parent IS NOT NULL GROUP BY ALL) GROUP BY ALL
), k AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM m)),
e AS MATERIALIZED (
  SELECT k.conv_id, k.turn, coalesce(best.p.c, CASE WHEN before IS NOT NULL THEN k.conv_id END) AS pc, coalesce(best.p.t, before) AS pt, CASE WHEN best.p IS NOT NULL THEN 'quote' WHEN before IS NOT NULL THEN 'turn' END AS "by"
  FROM k LEFT JOIN best USING (conv_id, turn)
), t AS (
  SELECT conv_id, turn, conv_id AS rc, turn AS rt, 0::BIGINT AS depth, [{'c': conv_id, 't': turn}] AS path FROM e WHERE pt IS NULL
  UNION ALL SELECT e.conv_id, e.turn, t.rc, t.rt, t.depth + 1, list_append(t.path, {'c': e.conv_id, 't': e.turn}) FROM e JOIN t ON e.pc = t.conv_id AND e.pt = t.turn
), o2 AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY rc, rt ORDER BY path) - 1 AS position FROM t), a AS (
  SELECT conv_id, turn, role, text, max(level)::INT AS deepest, coalesce(string_agg(said, chr(10) ORDER BY i) FILTER (level = 0), '') AS own_text FROM f GROUP BY ALL
), n AS (SELECT conv_id, turn, role, text, count(*) FILTER (level > 0 AND normal <> '')::INT AS n_quotes FROM p GROUP BY ALL)
SELECT a.conv_id, a.turn, a.role, m.copies, n.n_quotes, a.deepest, a.own_text, e.pc AS parent_conv, e.pt AS parent_turn, e."by", t.rc AS root_conv, t.rt AS root_turn, t.depth, o2.position
FROM a JOIN m USING (conv_id, turn, role, text) JOIN n USING (conv_id, turn, role, text) LEFT JOIN e USING (conv_id, turn) LEFT JOIN t USING (conv_id, turn) LEFT JOIN o2 USING (conv_id, turn)
"""
}
