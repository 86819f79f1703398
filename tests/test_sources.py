"""Readers, parsers and writers."""

import csv
import hashlib
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.operators import merge
from graphloom.operators.select import TriplePattern, entities, select_entities
from graphloom.sources import ntriples as N
from graphloom.sources import sparql, tables

LABEL = f"<{N.RDFS_LABEL}>"


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_strict_triples(spark):
    rows = N.parse_triples(lines(spark,
        f'<http://x/a> {LABEL} "Hi"@en .', f'<http://x/a> {LABEL} "a\\tb\\u00e9" .', f'<http://x/a> {LABEL} "1"^^<http://t> .', f'<http://x/a> {LABEL} "open .',
        f'<http://x/a>\t{LABEL}\t"Hi" .', f'_:b {LABEL} "Hi" .', "# comment", "", f'<http://x/a> {LABEL} "Hi"', f"  <http://x/a> {LABEL} <http://x/o> .  ",
    )).collect()
    assert [(r["o_lex"], r["o_lang"], r["o_dt"], r["o_iri"]) for r in rows] == [("Hi", "en", None, None), ("a\tbé", None, None, None), ("1", None, "http://t", None), (None, None, None, None), (None, None, None, "http://x/o")]


@pytest.mark.parametrize(("token", "want"), [('"a"@en', "a"), ('"a', None), ('"a\\"b"', 'a"b'), ('"\\q"', "q"), ('"\\u12"', None), ('"\\uD83D"', None), ('"\\U0001F600"', "😀"), ("<x>", None), ('"\\', None), ('"\\U00110000"', None), ('"\\u00zz"', None), ('"a\nb\\n"^^<http://t>', "a\nb\n"), ('""', "")])
def test_literals(spark, token, want):
    assert N.decode_literal(token) == want
    assert lines(spark, token).select(N.literal(F.col("value"))).first()[0] == want


def test_class_csv_round_trip(spark, tmp_path):
    path, out = tmp_path / "c.csv", str(tmp_path / "out")
    path.write_bytes("﻿class,label\nhttp://a,\"say \"\"hi\"\"\nthere\"\n http://b , x \n,none\nhttp://c,\n".encode())
    tables.csv_to_triples(spark, str(path), out)
    got = {(r["s"], r["o_lex"]) for r in N.read_triples(spark, out).collect()}
    assert got == {("http://a", 'say "hi"\nthere'), ("http://b", "x")}
    with pytest.raises(ValueError, match="missing"):
        tables.read_csv(spark, str(path), ["other"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), min_size=1, max_size=12), min_size=1, max_size=6))
def test_labels_survive_a_round_trip(spark, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "i int, label string")
    triples = N.parse_triples(df.select(N.label_triple(F.concat(F.lit("http://x/"), "i"), F.col("label")).alias("value")))
    assert {r["s"]: r["o_lex"] for r in triples.collect()} == {f"http://x/{i}": x for i, x in enumerate(labels)}


def test_invalid_utf8(spark, tmp_path):
    (tmp_path / "x.nt").write_bytes(b'<http://x/a> <http://p> "a\xffb" .\n')
    assert N.read_triples(spark, str(tmp_path / "x.nt")).first()["o_lex"] == "a�b"


def test_patterns():
    assert TriplePattern.parse("s http://p ?") == TriplePattern("s", "http://p", None)
    assert TriplePattern.parse("http://u http://p o") == TriplePattern("o", "http://p", "http://u")
    assert TriplePattern.parse("s <http://p> ?") == TriplePattern("s", "http://p", None)
    assert TriplePattern.parse("<http://u> <http://p> o") == TriplePattern("o", "http://p", "http://u")
    for bad in ("s http://p o", "s http://p s", "o http://p o", "? http://p ?", "http://u http://p http://u", "s ? ?", "s http://p", "s ftp://p ?", "s HTTP://p ?", "s http://p <http://u", "s <<http://p>> ?"):
        with pytest.raises(ValueError):
            TriplePattern.parse(bad)


def test_selection(spark):
    triples = N.parse_triples(lines(spark, "<http://a> <http://p> <http://b> .", '<http://a> <http://p> "lit" .', "<http://c> <http://p> <http://d> .", f'<http://a> {LABEL} " Big  City " .', f'<http://a> {LABEL} " " .', f'<http://z> {LABEL} "z" .'))
    uris = lambda p: {r[0] for r in select_entities(triples, p).collect()}
    assert uris("s http://p ?") == {"http://a", "http://c"}
    assert uris("s http://p http://b") == {"http://a"}
    assert uris("? http://p o") == {"http://b", "http://d"}
    assert uris("http://c http://p o") == {"http://d"}
    assert [tuple(r) for r in entities(triples, "s http://p ?").collect()] == [("http://a", "big city")]


def test_lenient_links(spark):
    same = f"<d> <{tables.SAME_AS}> <e> ."
    rows = tables.parse_links_lenient(lines(spark, "<a>\t<b>\t0.7", "<c>\t<d>\tnan", "<a>\tb\t0.9", "<a>\t<>\t0.9", "<a>\t<b>\tx", "<a>\t<b>\t1d", same, same.replace(" ", "\t"), "", "# no",
        f"<f> <{tables.SAME_AS}> <g> <http://graph> .", f"<h> <{tables.SAME_AS}> <i>.", f"<h> <{tables.SAME_AS}> i .", f"<h> <other> <i> .", f" <j>  <{tables.SAME_AS}>   <k> . ", " <a> \t <l>\t 0.5 ", "<a>\t<b>\t0.5\tmore")).collect()
    assert [(r["left"], r["right"], str(r["score"])) for r in rows] == [("a", "b", "0.7"), ("c", "d", "nan"), ("d", "e", "1.0"), ("f", "g", "1.0"), ("j", "k", "1.0"), ("a", "l", "0.5"), ("a", "b", "0.5")]


def test_strict_links(spark):
    rows = tables.parse_links_strict(lines(spark, "<a> <b>  0.5", "", "# no", " <c>\t<d>\t1e-1 ")).collect()
    assert [tuple(r) for r in rows] == [("a", "b", 0.5), ("c", "d", 0.1)]
    for bad in ("<a> <b>", "<a> b 0.5", "<a> <b> x", "<a> <b> 0.5 1"):
        with pytest.raises(Exception, match="malformed link"):
            tables.parse_links_strict(lines(spark, bad)).collect()


def test_links_and_manifest_files(spark, tmp_path):
    links = spark.createDataFrame([("http://l", "http://r", 0.0078125)], "left string, right string, score double")
    tables.write_links(links, str(tmp_path / "links"))
    assert spark.read.text(str(tmp_path / "links")).first()[0] == "<http://l>\t<http://r>\t0.007812"
    tables.write_csv(tables.manifest(links).coalesce(1), str(tmp_path / "m"))
    part = next((tmp_path / "m").glob("*.csv"))
    row = tables.read_manifest(spark, str(part)).first()
    assert row["position"] == 1 and row["score"] == "0.007812" and row["left_file"].startswith(str(tmp_path)) and row["pair_id"].startswith("000001_")


def test_mapping_file(spark, tmp_path):
    tables.write_mapping(spark.createDataFrame([("a", "b"), ("b", "b")], "old string, canonical string"), str(tmp_path / "m"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["a\tb"]


def test_rewriting(spark):
    mapping = spark.createDataFrame([("http://x/a", "http://x/A")], "old string, canonical string")
    got = merge.rewrite_lines(lines(spark, "<http://x/a>\t<p>\t<http://x/a> .", '<http://x/a> <http://x/a> "see <http://x/a>" .', "_:b <p> <http://x/a> .", "# note", "<http://x/a><p><http://x/b> <g> ."), mapping)
    assert {r[0] for r in got.collect()} == {"<http://x/A> <p> <http://x/A> .", '<http://x/A> <http://x/a> "see <http://x/a>" .', "_:b <p> <http://x/a> .", "# note", "<http://x/A> <p> <http://x/b> <g> ."}
    again = merge.rewrite_lines(got, mapping)
    assert sorted(again.collect()) == sorted(got.collect())


class Endpoint(BaseHTTPRequestHandler):
    rows = [{"instance": {"type": "uri", "value": f"http://i/{k}"}} | ({"label": {"type": "literal", "value": f"n{k}"}} if k != 1 else {}) for k in range(5)]
    asked: list = []

    def do_POST(self):  # noqa: N802
        query = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
        iri = query.split("<")[1].split(">")[0]
        self.asked.append((self.path, iri, time.monotonic()))
        limit, offset = (int(query.split(w)[1].split()[0]) for w in ("LIMIT", "OFFSET"))
        rows = [] if iri.endswith("empty") else self.rows
        names = [] if iri.endswith("nothing") else ["instance", "label"]
        body = json.dumps({"head": {"vars": names}, "results": {"bindings": rows[offset : offset + limit]}}).encode()
        self.send_response(500 if iri.endswith("broken") else 200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Endpoint.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_sparql_pages(spark, endpoint):
    pages = sparql.read_pages(spark, endpoint, "SELECT * {{{IRI}}}", ["http://c"], page_size=2, min_interval=0.01)
    got = sparql.columns(sparql.page_rows(pages), ["instance", "label"]).orderBy("position").collect()
    assert [(r["position"], r["instance"], r["label"]) for r in got] == [(k, f"http://i/{k}", "" if k == 1 else f"n{k}") for k in range(5)]
    for bad, why in (("http://c> } #", "invalid IRI"), ("ftp://c", "invalid IRI"), ("http://c\n", "invalid IRI"), ("http://nothing", "without variables")):
        with pytest.raises(Exception, match=why):
            sparql.read_pages(spark, endpoint, "SELECT * {{{IRI}}}", [bad], min_interval=0.01).collect()
    assert "http://c> } #" not in {iri for _, iri, _ in Endpoint.asked}


def test_fetch_and_pairs(spark, endpoint, tmp_path):
    """From links of classes to links of instances, by the commands; what is there is not asked for or matched again."""
    template, links, out, found = tmp_path / "q", tmp_path / "links", tmp_path / "out", tmp_path / "found"
    template.write_text("SELECT * { ?instance a {{IRI}} }")
    links.write_text("<http://l/a>\t<http://r/a>\t0.900000\n<http://l/a>\t<http://r/empty>\t0.8\n<http://l/low>\t<http://r/low>\t0.1\n")
    fetch = ["fetch", f"{endpoint}/left", f"{endpoint}/right", str(template), str(template), "0.5", "3", str(links), "--output", str(out), "--min-interval", "0.2"]
    cli.main(fetch, spark)
    assert [(p, i) for p, i, _ in Endpoint.asked] == [("/left", "http://l/a")] * 2 + [("/right", "http://r/a")] * 2 + [("/right", "http://r/empty")]
    times = [t for *_, t in Endpoint.asked]
    assert times[-1] - times[0] >= 4 * 0.2 - 0.15  # over both endpoints
    with open(out / "pairs.csv", newline="") as f:
        rows = list(csv.DictReader(f))
    assert [(r["left_iri"], r["right_iri"], r["score"]) for r in rows] == [("http://l/a", "http://r/a", "0.900000"), ("http://l/a", "http://r/empty", "0.800000")]
    for r in rows:
        for side in ("left", "right"):
            with open(out / r[f"{side}_file"], newline="") as f:
                assert r[f"{side}_file"] == f"{side}/{hashlib.sha256(r[f'{side}_iri'].encode()).hexdigest()}.csv"
                assert [tuple(x.values()) for x in csv.DictReader(f)] == ([] if r[f"{side}_iri"].endswith("empty") else [(f"http://i/{k}", "" if k == 1 else f"n{k}") for k in range(5)])
    cli.main(fetch, spark)
    assert len(Endpoint.asked) == 5
    pairs = ["pairs", str(out / "pairs.csv"), "--output", str(found)]
    cli.main(pairs, spark)
    with open(found / "pair_results.csv", newline="") as f:
        index = list(csv.DictReader(f))
    assert [(r["left_iri"], r["right_iri"], r["score"]) for r in index] == [(r["left_iri"], r["right_iri"], r["score"]) for r in rows]
    files = [found / r["result_file"] for r in index]
    assert sorted(files[0].read_text().splitlines()) == sorted(f"<http://i/{k}>\t<http://i/{k}>\t1.000000" for k in (0, 2, 3, 4)) and files[1].read_text() == ""
    files[0].write_text("kept\n")
    cli.main(pairs, spark)
    assert files[0].read_text() == "kept\n"
    cli.main([*pairs, "--force"], spark)
    assert len(files[0].read_text().splitlines()) == 4
    assert [p for p in tmp_path.rglob("*") if p.is_dir() and ".part" in p.name] == []


def test_a_failed_fetch_goes_on(spark, endpoint, tmp_path):
    links = spark.createDataFrame([("http://l/a", "http://r/broken")], "left string, right string")
    ask = lambda **k: sparql.fetch(links, {"left": f"{endpoint}/l", "right": f"{endpoint}/r"}, dict.fromkeys(("left", "right"), "{{IRI}}"), str(tmp_path), 10, 0.01, **k)
    for times in (1, 1):
        with pytest.raises(Exception):  # noqa: B017
            ask()
        assert sum(i == "http://l/a" for _, i, _ in Endpoint.asked) == times
    assert [p.parent.name for p in tmp_path.rglob("*.csv")] == ["left"]


def test_instances(spark, tmp_path):
    (tmp_path / "i.csv").write_text('label,instance,more\n" a ",http://i/1,x\n,http://i/2,x\nb,,x\n"c\nd",http://i/3,x\n')
    assert [tuple(r) for r in tables.read_instances(spark, str(tmp_path / "i.csv")).collect()] == [("http://i/1", "a"), ("http://i/3", "c\nd")]
    (tmp_path / "i.csv").write_text("instance,label\nnot an iri,x\n")
    with pytest.raises(Exception, match="invalid IRI"):
        tables.read_instances(spark, str(tmp_path / "i.csv")).collect()


def test_templates(tmp_path):
    (tmp_path / "t").write_text(" SELECT {{IRI}} ")
    assert sparql.read_template(str(tmp_path / "t")) == "SELECT {{IRI}}"
    (tmp_path / "t").write_text("SELECT")
    with pytest.raises(ValueError):
        sparql.read_template(str(tmp_path / "t"))
