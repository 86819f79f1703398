"""Queries over the test tables, one for each operator or group of operators, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import match, merge, select
from .plans import pairs as P
from .plans.staging import shared_dir
from .sources import ntriples, sparql, tables
from .sources.files import write_csv_file

MD5 = match.Settings(threshold=0.70, trigram_threshold=0.40, gram_hash="md5")
QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- the tables as graphs -----------------------------------------------------------------------------------------

TITLE = r"(?s)<title>(.*?)</title>"


def _parts(spark, sf, side: str) -> DataFrame:
    """(uri, label) of all parts."""
    return _table(spark, sf, "part").select(F.concat(F.lit(f"http://{side}/part/"), "p_partkey").alias("uri"), T.normalize_label(F.col("p_name")).alias("label"))


def _titles(spark, sf, side: str) -> DataFrame:
    rows = _table(spark, sf, "pages").select(F.concat(F.lit(f"http://{side}/page/"), "page_id").alias("uri"), T.normalize_label(F.regexp_extract("html", TITLE, 1)).alias("label"))
    return rows.where("label <> ''")


def _triples(spark, sf) -> DataFrame:
    """Orders and their customers as triples: o/<k> by c/<k>, o/<k> status "x", c/<k> in n/<k>."""
    iri = lambda kind, c: F.concat(F.lit(f"http://x/{kind}/"), F.col(c))
    row = lambda s, p, o: F.concat(F.lit("<"), s, F.lit(f"> <http://x/p/{p}> "), o, F.lit(" ."))
    term = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    orders, customers = _table(spark, sf, "orders"), _table(spark, sf, "customer")
    lines = orders.select(row(iri("order", "o_orderkey"), "by", term(iri("customer", "o_custkey"))).alias("value"))
    lines = lines.union(orders.select(row(iri("order", "o_orderkey"), "status", F.concat(F.lit('"'), "o_orderstatus", F.lit('"@en')))))
    lines = lines.union(customers.select(row(iri("customer", "c_custkey"), "in", term(iri("nation", "c_nationkey")))))
    lines = lines.union(customers.select(ntriples.label_triple(iri("customer", "c_custkey"), F.col("c_name"))))
    return ntriples.parse_triples(lines)


_NORM = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_PART = f"SELECT p_partkey AS k, {_NORM.format('p_name')} AS label FROM part"
_PAGE = f"SELECT page_id AS k, {_NORM.format(chr(114) + 'egexp_extract(html, ' + chr(39) + TITLE + chr(39) + ', 1)')} AS label FROM pages"
_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 3), lambda i: ('  ' || {0} || '  ')[i:i + 2]))"
_ANCHORS = f"list_transform(list_sort(list_transform({_GRAMS}, lambda g: md5(g) || g)), lambda h: h[33:])[1:4]"
_BLOCKS = f"""blocks AS MATERIALIZED (
  SELECT label, nl, nr, gram, bucket FROM (SELECT label, nl, nr, unnest({_ANCHORS.format("label")}) AS gram, length(label) // 4 AS b FROM counts), LATERAL (SELECT unnest([b - 1, b, b + 1]) AS bucket) WHERE bucket >= 0
), stats AS MATERIALIZED (SELECT bucket, gram, sum(nl)::BIGINT AS nl, sum(nr)::BIGINT AS nr FROM blocks GROUP BY ALL)"""
_COUNTS = "counts AS MATERIALIZED (SELECT label, count(*)::BIGINT AS nl, count(*)::BIGINT AS nr FROM e GROUP BY label)"
_LCS = """list_reduce(list_concat([list_transform(range(0, length({1}) + 1), lambda j: 0)], list_transform(string_split({0}, ''), lambda c: [ascii(c)])), lambda row, c:
  list_reduce(list_concat([[0]], list_transform(range(2, length({1}) + 2), lambda j: [greatest(row[j], CASE WHEN ascii({1}[j - 1]) = c[1] THEN row[j - 1] + 1 ELSE 0 END)])), lambda acc, v: list_append(acc, greatest(acc[len(acc)], v[1]))))[length({1}) + 1]"""
_RATIO = "(1e0 - (length({0}) + length({1}) - 2 * " + _LCS + ")::DOUBLE / (length({0}) + length({1}))) * 100 / 100e0"
_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"


def _cand(cap: int = 1_000_000, t: float = 0.70, tri: float = 0.40) -> str:
    return f"""pairs AS MATERIALIZED (SELECT DISTINCT a.label AS x, b.label AS y FROM stats s JOIN blocks a USING (bucket, gram) JOIN blocks b USING (bucket, gram)
  WHERE s.nl > 0 AND s.nr > 0 AND s.nl * s.nr <= {cap} AND a.nl > 0 AND b.nr > 0 AND least(length(a.label), length(b.label))::DOUBLE / greatest(length(a.label), length(b.label)) >= {t}e0 * 0.8e0
), cand AS MATERIALIZED (SELECT x, y FROM (SELECT x, y, {_GRAMS.format("x")} AS gx, {_GRAMS.format("y")} AS gy FROM pairs) WHERE 2e0 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)) >= {tri}e0),
scored AS MATERIALIZED (SELECT x, y, greatest({_RATIO.format("x", "y")}, {_RATIO.format("sx", "sy")}) AS score FROM (SELECT x, y, {_SORTED.format("x")} AS sx, {_SORTED.format("y")} AS sy FROM cand))"""


def _label_pairs(spark, sf) -> DataFrame:
    """Distinct labels of parts that share a word."""
    words = _parts(spark, sf, "l").select("label").distinct().select("label", F.explode(F.array_distinct(F.split("label", " "))).alias("word"))
    return words.withColumnRenamed("label", "x").join(words.withColumnRenamed("label", "y"), "word").select("x", "y").distinct()


_SHARED = f"w AS (SELECT DISTINCT label, unnest(string_split(label, ' ')) AS word FROM ({_PART})), p AS (SELECT DISTINCT a.label AS x, b.label AS y FROM w a JOIN w b USING (word))"


# ---- functions ----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_NORM.format('text')} AS label FROM documents")
def normalize_labels(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.normalize_label(F.col("text")).alias("label"))


@query(f"WITH e AS ({_PART}) SELECT DISTINCT label, unnest({_GRAMS.format('label')}) AS gram FROM e")
def trigrams(spark, sf):
    return _parts(spark, sf, "l").select("label").distinct().select("label", F.explode(T.trigrams(F.col("label"))).alias("gram"))


@query(f"WITH {_SHARED} SELECT x, y, least(length(x), length(y))::DOUBLE / greatest(length(x), length(y)) >= 0.9e0 * 0.8e0 AS possible FROM p")
def length_filter(spark, sf):
    return _label_pairs(spark, sf).select("x", "y", T.length_possible(F.col("x"), F.col("y"), 0.9).alias("possible"))


@query(f"WITH {_SHARED}, g AS (SELECT x, y, {_GRAMS.format('x')} AS gx, {_GRAMS.format('y')} AS gy FROM p) SELECT x, y, 2e0 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)) AS dice FROM g")
def dice_filter(spark, sf):
    return _label_pairs(spark, sf).select("x", "y", T.trigram_dice(T.trigrams(F.col("x")), T.trigrams(F.col("y"))).alias("dice"))


@query(f"WITH {_SHARED} SELECT x, y, {_RATIO.format('x', 'y')} AS ratio FROM p")
def indel_ratio(spark, sf):
    return _label_pairs(spark, sf).select("x", "y", T.indel_ratio(F.col("x"), F.col("y")).alias("ratio"))


@query(f"WITH {_SHARED}, q AS (SELECT x, y, {_SORTED.format('x')} AS sx, {_SORTED.format('y')} AS sy FROM p) SELECT x, y, {_RATIO.format('sx', 'sy')} AS ratio FROM q")
def token_sort_ratio(spark, sf):
    return _label_pairs(spark, sf).select("x", "y", T.indel_ratio(T.token_sort(F.col("x")), T.token_sort(F.col("y"))).alias("ratio"))


# ---- sources, selection -------------------------------------------------------------------------------------------


@query("SELECT 'http://x/doc/' || doc_id AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, text AS o_lex FROM documents WHERE text <> ''")
def nt_roundtrip(spark, sf):
    docs = _table(spark, sf, "documents").where("text <> ''")
    lines = docs.select(ntriples.label_triple(F.concat(F.lit("http://x/doc/"), "doc_id"), F.col("text")).alias("value"))
    return ntriples.parse_triples(lines).select("s", "p", "o_lex")


@query("SELECT DISTINCT 'http://x/order/' || o_orderkey AS uri FROM orders")
def select_subjects(spark, sf):
    return select.select_entities(_triples(spark, sf), "s http://x/p/status ?")


@query("SELECT DISTINCT 'http://x/customer/' || c_custkey AS uri FROM customer WHERE c_nationkey = 7")
def select_subjects_fixed(spark, sf):
    return select.select_entities(_triples(spark, sf), "s http://x/p/in http://x/nation/7")


@query("SELECT DISTINCT 'http://x/customer/' || o_custkey AS uri FROM orders")
def select_objects(spark, sf):
    return select.select_entities(_triples(spark, sf), "? http://x/p/by o")


@query("SELECT DISTINCT 'http://x/customer/' || o_custkey AS uri FROM orders WHERE o_orderkey = 1")
def select_objects_fixed(spark, sf):
    return select.select_entities(_triples(spark, sf), "http://x/order/1 http://x/p/by o")


@query(f"SELECT DISTINCT 'http://x/customer/' || c_custkey AS uri, {_NORM.format('c_name')} AS label FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def entities(spark, sf):
    return select.entities(_triples(spark, sf), "? http://x/p/by o")


@query("SELECT DISTINCT 'http://x/nation/' || c_nationkey AS class_iri, 'http://x/customer/' || c_custkey AS instance, c_name AS label FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def class_instances(spark, sf):
    iri = lambda kind, c: F.concat(F.lit(f"http://x/{kind}/"), F.col(c))
    customers, orders = _table(spark, sf, "customer"), _table(spark, sf, "orders")
    types = customers.select(iri("customer", "c_custkey").alias("instance"), iri("nation", "c_nationkey").alias("class_iri"))
    labels = customers.join(orders, F.col("c_custkey") == F.col("o_custkey")).select(iri("customer", "c_custkey").alias("instance"), F.col("c_name").alias("label"), F.when(F.col("o_orderstatus") == "F", "en").otherwise("de").alias("lang"))
    return select.class_instances(types, labels)


# ---- matching -----------------------------------------------------------------------------------------------------

_EXACT = "SELECT 'http://l/part/' || a.k AS \"left\", 'http://r/part/' || b.k AS \"right\", 1e0 AS score FROM e a JOIN e b USING (label)"


@query(f"WITH e AS ({_PART}) {_EXACT}")
def exact_match(spark, sf):
    return match.exact_pairs(match.sides(_parts(spark, sf, "l"), _parts(spark, sf, "r")), 1_000_000)


@query(f"WITH e AS ({_PART}) {_EXACT} WHERE label IN (SELECT label FROM e GROUP BY label HAVING count(*) * count(*) <= 900)")
def exact_match_capped(spark, sf):
    return match.exact_pairs(match.sides(_parts(spark, sf, "l"), _parts(spark, sf, "r")), 900)


@query(f"WITH e AS ({_PART}), {_COUNTS}, {_BLOCKS} SELECT bucket::INT AS bucket, gram, label, nl, nr FROM blocks")
def anchor_blocks(spark, sf):
    return match.blocks(match.label_counts(match.sides(_parts(spark, sf, "l"), _parts(spark, sf, "r"))), MD5)


@query(f"WITH e AS ({_PAGE}), {_COUNTS}, {_BLOCKS} SELECT bucket::INT AS bucket, gram, nl, nr FROM stats")
def block_stats(spark, sf):
    both = match.sides(_titles(spark, sf, "l"), _titles(spark, sf, "r"))
    return match.block_stats(match.blocks(match.label_counts(both), MD5))


@query(f"WITH e AS ({_PART}), {_COUNTS}, {_BLOCKS} SELECT bucket::INT AS bucket, gram, nl, nr FROM stats WHERE nl * nr <= 100000")
def block_cap(spark, sf):
    counts = match.label_counts(match.sides(_parts(spark, sf, "l"), _parts(spark, sf, "r")))
    return match._open(match.block_stats(match.blocks(counts, MD5)), match.Settings(max_comparisons_per_block=100_000))


@query(f"WITH e AS ({_PAGE}), {_COUNTS}, {_BLOCKS}, {_cand()} SELECT x, y FROM cand")
def candidates(spark, sf):
    return match.candidates(match.label_counts(match.sides(_titles(spark, sf, "l"), _titles(spark, sf, "r"))), MD5)


_PAIRS = "SELECT 'http://l/part/' || a.k AS \"left\", 'http://r/part/' || b.k AS \"right\", score FROM scored JOIN e a ON a.label = x JOIN e b ON b.label = y WHERE score >= 0.70e0"


@query(f"WITH e AS ({_PART}), {_COUNTS}, {_BLOCKS}, {_cand()} {_PAIRS}")
def fuzzy_match(spark, sf):
    return match.fuzzy_pairs(match.sides(_parts(spark, sf, "l"), _parts(spark, sf, "r")), MD5)


@query(f"WITH e AS ({_PART}), {_COUNTS}, {_BLOCKS}, {_cand()} SELECT \"left\", \"right\", max(score) AS score FROM ({_PAIRS} UNION ALL {_EXACT} WHERE label IN (SELECT label FROM e GROUP BY label HAVING count(*) * count(*) <= 1000000)) GROUP BY ALL")
def align(spark, sf):
    return match.align(_parts(spark, sf, "l"), _parts(spark, sf, "r"), MD5)


@query(
    f"""WITH e AS ({_PART}), {_COUNTS}, {_BLOCKS}, {_cand()},
m AS (SELECT a.nl * b.nr AS n, c.x, c.y FROM cand c JOIN blocks a ON a.label = c.x JOIN blocks b ON b.label = c.y AND a.bucket = b.bucket AND a.gram = b.gram JOIN stats s ON s.bucket = a.bucket AND s.gram = a.gram WHERE s.nl * s.nr <= 1000000)
SELECT 'exact' AS stage, count(*) AS blocks, sum(nl * nr)::BIGINT AS comparisons, 0::BIGINT AS scored, coalesce(sum(nl * nr) FILTER (nl * nr <= 1000000), 0)::BIGINT AS matches FROM counts
UNION ALL SELECT 'fuzzy', (SELECT count(*) FROM stats), (SELECT sum(nl * nr)::BIGINT FROM stats), coalesce(sum(n), 0)::BIGINT, coalesce(sum(n) FILTER (score >= 0.70e0), 0)::BIGINT FROM m JOIN scored USING (x, y)"""
)
def align_metrics(spark, sf):
    return match.align_metrics(_parts(spark, sf, "l"), _parts(spark, sf, "r"), MD5)


@query("SELECT c_nationkey AS \"left\", o_orderpriority AS \"right\", max(o_totalprice) AS score FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def dedup_pairs_max(spark, sf):
    rows = _table(spark, sf, "orders").join(_table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return match.best_scores(rows.select(F.col("c_nationkey").alias("left"), F.col("o_orderpriority").alias("right"), F.col("o_totalprice").alias("score")))


# ---- links, classes, pairs ----------------------------------------------------------------------------------------


def _supply(spark, sf) -> DataFrame:
    """A link of each part and supplier in a lineitem, its score the tax and discount."""
    rows = _table(spark, sf, "lineitem")
    return rows.select(F.concat(F.lit("http://x/part/"), "l_partkey").alias("left"), F.concat(F.lit("http://x/supplier/"), "l_suppkey").alias("right"), (F.col("l_discount") + F.col("l_tax")).alias("score"))


_SUPPLY = "SELECT 'http://x/part/' || l_partkey AS \"left\", 'http://x/supplier/' || l_suppkey AS \"right\", l_discount + l_tax AS score FROM lineitem"


@query(f"SELECT \"left\", \"right\", round_even(score, 6) AS score FROM ({_SUPPLY})")
def links_strict(spark, sf):
    return tables.parse_links_strict(_supply(spark, sf).select(tables.link_line().alias("value")))


@query(f"SELECT \"left\", \"right\", round_even(score, 6) AS score FROM ({_SUPPLY}) UNION ALL SELECT 'http://x/order/' || o_orderkey, 'http://x/customer/' || o_custkey, 1e0 FROM orders")
def links_lenient(spark, sf):
    same = _table(spark, sf, "orders").select(F.concat(F.lit("<http://x/order/"), "o_orderkey", F.lit(f"> <{tables.SAME_AS}> <http://x/customer/"), "o_custkey", F.lit("> .")).alias("value"))
    noise = _table(spark, sf, "region").select(F.concat(F.lit("<http://x/a>\t"), "r_name", F.lit("\t0.5")).alias("value"))
    return tables.parse_links_lenient(_supply(spark, sf).select(tables.link_line().alias("value")).union(same).union(noise))


@query(f"SELECT \"left\", \"right\", score, printf('%.6f', score) AS score_text FROM ({_SUPPLY}) WHERE score >= 0.1e0")
def class_threshold(spark, sf):
    return P.class_links(_supply(spark, sf), 0.1)


@query("SELECT (n_nationkey + 1)::INT AS position, 'http://l/' || n_name AS left_iri, 'http://r/' || r_name AS right_iri, printf('%06d_', n_nationkey + 1) || sha256('http://l/' || n_name || chr(0) || 'http://r/' || r_name)[1:20] AS pair_id FROM nation JOIN region ON r_regionkey = n_regionkey")
def pair_ids(spark, sf):
    rows = _table(spark, sf, "nation").join(_table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return P.pair_ids(rows.select((F.col("n_nationkey") + 1).alias("position"), F.concat(F.lit("http://l/"), "n_name").alias("left_iri"), F.concat(F.lit("http://r/"), "r_name").alias("right_iri")))


# files: written to the shared folder, read back


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex}"


@query("SELECT 'http://n/' || n_nationkey AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, n_name || ', \"' || n_nationkey || '\"' AS o_lex FROM nation")
def class_csv(spark, sf):
    rows = _table(spark, sf, "nation").select(F.concat(F.lit(" http://n/"), "n_nationkey").alias("class"), F.concat("n_name", F.lit(', "'), "n_nationkey", F.lit('" ')).alias("label"))
    rows = rows.union(rows.limit(1).select(F.lit("http://none"), F.lit("  ")))
    folder = _folder(spark)
    write_csv_file(rows, f"{folder}/classes.csv")
    tables.csv_to_triples(spark, f"{folder}/classes.csv", f"{folder}/labels.nt")
    return ntriples.read_triples(spark, f"{folder}/labels.nt").select("s", "p", "o_lex")


@query("SELECT 'http://x/supplier/' || s_suppkey AS iri, s_name AS label FROM supplier")
def instance_csv(spark, sf):
    rows = _table(spark, sf, "supplier").select(F.col("s_name").alias("label"), F.lit("x").alias("more"), F.concat(F.lit("http://x/supplier/"), "s_suppkey").alias("instance"))
    folder = _folder(spark)
    write_csv_file(rows, f"{folder}/instances.csv")
    return tables.read_instances(spark, f"{folder}/instances.csv")


@query(
    """WITH m AS (SELECT row_number() OVER (ORDER BY n_name)::INT AS position, 'http://l/' || n_name AS left_iri, 'http://r/' || r_name AS right_iri, printf('%.6f', (n_nationkey % 10) / 10e0) AS score FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT position, left_iri, right_iri, score, 'left/' || sha256(left_iri) || '.csv' AS left_file, 'right/' || sha256(right_iri) || '.csv' AS right_file, printf('%06d_', position) || sha256(left_iri || chr(0) || right_iri)[1:20] AS pair_id FROM m"""
)
def manifest(spark, sf):
    rows = _table(spark, sf, "nation").join(_table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).orderBy("n_name")
    links = rows.select(F.concat(F.lit("http://l/"), "n_name").alias("left"), F.concat(F.lit("http://r/"), "r_name").alias("right"), (F.col("n_nationkey") % 10 / 10).alias("score"))
    path = f"{_folder(spark)}/pairs.csv"
    write_csv_file(tables.manifest(links), path)
    relative = [F.substring_index(c, "/", -2).alias(c) for c in ("left_file", "right_file")]
    return tables.read_manifest(spark, path).select("position", "left_iri", "right_iri", "score", *relative, "pair_id")


@query("SELECT left_iri, right_iri, printf('%.6f', (k % 10) / 10e0) AS score, 'pairs/' || printf('%06d_', k + 1) || sha256(left_iri || chr(0) || right_iri)[1:20] || '.tsv' AS result_file FROM (SELECT n_nationkey AS k, 'http://l/' || n_name AS left_iri, 'http://r/' || r_name AS right_iri FROM nation JOIN region ON r_regionkey = n_regionkey)")
def result_index(spark, sf):
    rows = _table(spark, sf, "nation").join(_table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = rows.select((F.col("n_nationkey") + 1).alias("position"), F.concat(F.lit("http://l/"), "n_name").alias("left_iri"), F.concat(F.lit("http://r/"), "r_name").alias("right_iri"), T.score_text(F.col("n_nationkey") % 10 / 10).alias("score"))
    return P.pair_results(P.pair_ids(rows))


@query("SELECT 'http://x/part/' || p_partkey AS old, 'http://x/part/' || p_size AS canonical FROM part WHERE p_partkey <> p_size")
def mapping_file(spark, sf):
    path = f"{_folder(spark)}/mapping.tsv"
    iri = lambda c: F.concat(F.lit("http://x/part/"), c)
    tables.write_mapping(_table(spark, sf, "part").select(iri("p_partkey").alias("old"), iri("p_size").alias("canonical")), path)
    fields = F.split("value", "\t")
    return ntriples.read_lines(spark, path).select(fields[0].alias("old"), fields[1].alias("canonical"))


@query("SELECT url, regexp_matches(url, '^(?i:https?)://[^/?#<>\"{}|^`\\\\\\x00-\\x20]+[^<>\"{}|^`\\\\\\x00-\\x20]*$') AS valid, sha256(url) || '.csv' AS file FROM pages")
def iri_terms(spark, sf):
    return _table(spark, sf, "pages").select("url", T.is_iri(F.col("url")).alias("valid"), T.file_name(F.col("url")).alias("file"))


@query(
    f"""WITH e AS (SELECT p_type AS t, p_partkey AS k, {_NORM.format("p_name")} AS label FROM part), c AS (SELECT t, label, count(*) AS n FROM e GROUP BY ALL)
SELECT '000000_' || a.t AS pair_id, 'http://x/part/' || a.k AS "left", 'http://x/part/' || b.k AS "right", 1e0 AS score FROM e a JOIN e b ON a.t = b.t AND a.label = b.label"""
)
def align_per_class_pair(spark, sf):
    parts = _table(spark, sf, "part").select(F.col("p_type").alias("class_iri"), F.concat(F.lit("http://x/part/"), "p_partkey").alias("iri"), F.col("p_name").alias("label"))
    pairs = parts.select(F.concat(F.lit("000000_"), "class_iri").alias("pair_id"), F.col("class_iri").alias("left_iri"), F.col("class_iri").alias("right_iri")).distinct()
    return P.align_pairs(pairs, parts, parts, match.Settings(threshold=1.0, trigram_threshold=1.0, gram_hash="md5"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 50")
def paginate(spark, sf):
    rows = _table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return rows.offset(50).limit(100)


@query("SELECT event_id, (props::JSON ->> '$.k') AS k, event_type AS kind, '' AS missing FROM events")
def sparql_json(spark, sf):
    # each event as a result of one binding, with a variable that is not bound
    events = _table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    value = lambda c: F.struct(F.lit("literal").alias("type"), F.col(c).cast("string").alias("value"))
    body = F.to_json(F.struct(F.struct(F.array(F.lit("k"), F.lit("kind"), F.lit("missing")).alias("vars")).alias("head"), F.struct(F.array(F.struct(value("k").alias("k"), value("event_type").alias("kind"))).alias("bindings")).alias("results")))
    rows = events.select("event_id", F.explode(sparql.decode_bindings(body)).alias("b"))
    return rows.select("event_id", *[F.col("b")[v].alias(v) for v in ("k", "kind", "missing")])


# ---- merging ------------------------------------------------------------------------------------------------------


def _in_line(spark, sf) -> DataFrame:
    """Each customer's orders as a ring: a link of each with the next, and of the last with the first. Low scores cut rings into chains."""
    orders = _table(spark, sf, "orders")
    over = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = orders.select("o_orderkey", F.coalesce(F.lead("o_orderkey").over(over), F.min("o_orderkey").over(Window.partitionBy("o_custkey"))).alias("to"))
    iri = lambda c: F.concat(F.when(F.pmod(c, F.lit(3)) == 0, "http://x/order%2F").otherwise("http://x/order/"), F.col(c))
    return rows.select(iri("o_orderkey").alias("left"), iri("to").alias("right"), (F.lit(1.0) - F.pmod("o_orderkey", F.lit(10)) / F.lit(20.0)).alias("score"))


_IRI = "CASE WHEN {0} % 3 = 0 THEN 'http://x/order%2F' ELSE 'http://x/order/' END || {0}"
_LINE = f"""SELECT {_IRI.format('o_orderkey')} AS "left", {_IRI.format('"to"')} AS "right", 1e0 - (o_orderkey % 10) / 20e0 AS score FROM (
  SELECT o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), min(o_orderkey) OVER (PARTITION BY o_custkey)) AS "to" FROM orders)"""
_REACH = f"""links AS MATERIALIZED ({_LINE}), nodes AS (SELECT "left" AS u FROM links UNION SELECT "right" FROM links),
edges AS MATERIALIZED (SELECT "left" AS a, "right" AS b FROM links WHERE score >= 0.7e0 AND "left" <> "right" UNION SELECT "right", "left" FROM links WHERE score >= 0.7e0 AND "left" <> "right"),
reach AS (SELECT u AS a, u AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
mapping AS MATERIALIZED (SELECT a AS old, min({{'p': contains(b, '%'), 'n': length(b), 'u': b}}).u AS canonical FROM reach GROUP BY a)"""


@query(f"WITH RECURSIVE {_REACH} SELECT canonical, count(*) AS members FROM mapping GROUP BY canonical")
def components(spark, sf):
    return merge.canonical_mapping(_in_line(spark, sf)).groupBy("canonical").agg(F.count("*").alias("members"))


@query(f"WITH RECURSIVE {_REACH} SELECT old, canonical FROM mapping")
def canonical_mapping(spark, sf):
    return merge.canonical_mapping(_in_line(spark, sf))


def _graph(spark, sf, links=_in_line) -> DataFrame:
    rows = links(spark, sf)
    line = lambda s, o: F.concat(F.lit("<"), s, F.lit(">\t<http://x/p/near> "), o, F.lit(" ."))
    return rows.select(line(F.col("left"), F.concat(F.lit("<"), "right", F.lit(">"))).alias("value")).union(rows.select(line(F.col("right"), F.lit('"<http://x/supplier/1>"@en'))))


_GRAPH = """SELECT '<' || coalesce(m.canonical, "left") || '> <http://x/p/near> <' || coalesce(n.canonical, "right") || '> .' AS value FROM links LEFT JOIN mapping m ON m.old = "left" LEFT JOIN mapping n ON n.old = "right"
UNION ALL SELECT '<' || coalesce(n.canonical, "right") || '> <http://x/p/near> "<http://x/supplier/1>"@en .' FROM links LEFT JOIN mapping n ON n.old = "right\""""


@query(f"WITH RECURSIVE {_REACH} {_GRAPH}")
def rewrite_triples(spark, sf):
    return merge.rewrite_lines(_graph(spark, sf), merge.canonical_mapping(_in_line(spark, sf)))


@query(f"WITH RECURSIVE {_REACH} SELECT DISTINCT value FROM ({_GRAPH} UNION ALL SELECT '# ' || r_name FROM region)")
def merge_graphs(spark, sf):
    notes = _table(spark, sf, "region").select(F.concat(F.lit("# "), "r_name").alias("value"))
    return merge.merge_graphs([_graph(spark, sf), notes], _in_line(spark, sf))


# the same over a graph of few, very large components


def _bought(spark, sf) -> DataFrame:
    """A link of each order's customer with the supplier of each of its lineitems; scores around the threshold."""
    orders, items = _table(spark, sf, "orders"), _table(spark, sf, "lineitem")
    rows = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.concat(F.lit("http://x/customer%2F"), "o_custkey").alias("left"), F.concat(F.lit("http://x/supplier/"), "l_suppkey").alias("right"), (F.pmod("o_orderkey", F.lit(10)) / F.lit(10.0)).alias("score"))


_BOUGHT = "SELECT 'http://x/customer%2F' || o_custkey AS \"left\", 'http://x/supplier/' || l_suppkey AS \"right\", (o_orderkey % 10) / 10e0 AS score FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
#: Each node takes the least of its neighbours' least nodes until none changes: the pairs of a component are never made.
_LEAST = f"""links AS MATERIALIZED ({_BOUGHT}), nodes AS (SELECT "left" AS u FROM links UNION SELECT "right" FROM links),
edges AS MATERIALIZED (SELECT "left" AS a, "right" AS b FROM links WHERE score >= 0.7e0 AND "left" <> "right" UNION SELECT "right", "left" FROM links WHERE score >= 0.7e0 AND "left" <> "right"),
least_(u, p) USING KEY (u) AS (SELECT u, {{'p': contains(u, '%'), 'n': length(u), 'u': u}} AS p FROM nodes
  UNION SELECT e.a, min(l.p) FROM least_ l JOIN edges e ON e.b = l.u JOIN recurring.least_ k ON k.u = e.a WHERE l.p < k.p GROUP BY e.a),
mapping AS MATERIALIZED (SELECT u AS old, p.u AS canonical FROM least_)"""


@query(f"WITH RECURSIVE {_LEAST} SELECT canonical, count(*) AS members FROM mapping GROUP BY canonical")
def components_whole(spark, sf):
    return merge.canonical_mapping(_bought(spark, sf)).groupBy("canonical").agg(F.count("*").alias("members"))


@query(f"WITH RECURSIVE {_LEAST} SELECT old, canonical FROM mapping")
def canonical_mapping_whole(spark, sf):
    return merge.canonical_mapping(_bought(spark, sf))


@query(f"WITH RECURSIVE {_LEAST} {_GRAPH}")
def rewrite_triples_whole(spark, sf):
    return merge.rewrite_lines(_graph(spark, sf, _bought), merge.canonical_mapping(_bought(spark, sf)))


@query(f"WITH RECURSIVE {_LEAST} SELECT DISTINCT value FROM ({_GRAPH} UNION ALL SELECT '# ' || r_name FROM region)")
def merge_graphs_whole(spark, sf):
    notes = _table(spark, sf, "region").select(F.concat(F.lit("# "), "r_name").alias("value"))
    return merge.merge_graphs([_graph(spark, sf, _bought), notes], _bought(spark, sf))


@query("SELECT DISTINCT text AS value FROM conversations WHERE text IS NOT NULL")
def distinct_lines(spark, sf):
    return merge.distinct_lines(_table(spark, sf, "conversations").where("text is not null").select(F.col("text").alias("value")))
