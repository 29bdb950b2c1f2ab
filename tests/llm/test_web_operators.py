"""HTML extraction, URL rules and WARC derivatives."""

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnslake.llm import extract, urlrules, warc
from dnslake.llm.htmlblocks import blocks

SF = "/root/testdata/sf0.01"
PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>'
        '<a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p><b>First  line'
        '<br><p>Second&nbsp;line &lt;x&gt;.</p></article><footer>&copy; x</footer></body></html>')


# -- HTML ---------------------------------------------------------------------------------------

def test_blocks_and_paths():
    got = blocks(PAGE)
    assert [b.text for b in got] == ["Home", "Buy now.", "A & B", "First line", "Second line <x>.", "© x"]
    assert got[0].links == 1.0 and got[1].path == ("html", "body", "div ad") and got[4].path == ("html", "body", "article", "p")
    for odd in ("", "<", "<a", "< b", "</p></div>", "<p", "<!-- x", "<script>x", "a<br>b", '<a href="x>y', "<" * 500):
        assert isinstance(blocks(odd), list)
    assert [b.text for b in blocks("a<br>b &am &amp &#x41;")] == ["a b &am & A"]


def test_skipped_elements_end_where_they_end():
    texts = lambda page, **how: [b.text for b in blocks(page, **how)]
    assert texts('<body><svg class="icon"/><article><p>One<p>Two <svg><g>no</g></svg>three</article><svg>no</svg>') == ["One", "Two three"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold<p>a <math/> b") == ["Let x=2 hold", "a b"]
    for name in ("select", "video", "object", "noscript", "iframe", "template", "canvas"):
        assert texts(f"<div><p>a <{name}><i>no</i></div><p>b") == ["a", "b"]
        assert texts(f"<div><p>a <{name}>no<p>b</div>c") == ["a", "b", "c"]
        assert texts(f"<div>a<{name}>no</div><p>b <{name}>no</{name}>c") == ["a", "b c"]
        assert texts(f"<p>a <{name}><div><p>no<{name}>no</{name}></p></div></{name}> b</p>") == ["a b"]
    assert texts("<ul><li>a<object>no<li>b</ul>c") == ["a", "b", "c"]
    assert texts('<p>a<script src="x"/><p>b') == ["a"] and texts('<p>a<script src="x"/><p>b', xml=True) == ["a", "b"]
    assert texts("<svg x=1/>no</svg>a") == ["a"] and texts("<svg>no") == texts("<style>no<p>no") == []
    head = "HTTP/1.1 200 OK\r\nContent-Type: application/xhtml+xml\r\n\r\n"
    record = dict.fromkeys(warc.RECORD.names) | {"record_id": "<urn:x>", "warc_type": "response",
                                                 "block": (head + '<html><script src="x"/><p>b</p></html>').encode()}
    assert [r["block"] for r in warc.derivatives(record) if r["warc_type"] == "conversion"] == [b"b"]


@pytest.fixture(scope="module")
def weights(spark):
    return extract.train(spark.read.parquet(f"{SF}/pages.parquet"), sample=120, built=400)


def test_labels_of_held_out_layouts(spark, weights):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()
    prose = [b.text for r in rows[:60] for b in blocks(r.html)]
    rng = random.Random(77)
    pages = [blocks(extract.built_page(prose, rng)) for _ in range(150)]
    prob = extract._probabilities(weights, pages)
    right = [(p >= 0.5) == b.keep for page, ps in zip(pages, prob) for b, p in zip(page, ps)]
    assert np.mean(right) > 0.97


def test_extract_pages(spark, weights):
    long_page = PAGE.replace("<p>Second", "<p>" + "<p>".join(f"Paragraph {k} says something." for k in range(3000)) + "<p>Second")
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (4, "<nav><a href=x>Home</a></nav>"), (5, long_page)]
    frame = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")).withColumn("text", F.lit("old"))
    got = {r.page_id: r for r in extract.extract(frame, weights).collect()}
    assert got[1].text == "A & B\nFirst line\nSecond line <x>." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert got[5].text.count("\n") > 2900
    assert extract.extract(frame.limit(0), weights).count() == 0


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in extract._initial(rng).items()}
    pages = [blocks(PAGE), blocks("<p>a<p>b c<div class=ad>d</div>"), blocks("<p>x")]
    x = extract.features(pages).astype(np.float64)
    y = rng.integers(0, 2, len(x)).astype(float)
    sizes = [len(q) for q in pages]
    _, g = extract._gradients(p, x, y, sizes)
    for name in ("out", "hf", "hb", "xf", "cb", "in0"):
        place = np.unravel_index(rng.integers(p[name].size), p[name].shape)
        losses = []
        for d in (1e-2, -1e-2):
            q = {k: v.copy() for k, v in p.items()}
            q[name][place] += d
            losses.append(extract._gradients(q, x, y, sizes)[0])
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(g[name][place], abs=2e-3)


# -- URL rules ----------------------------------------------------------------------------------

def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[:min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for verdict, h, p in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), verdict == "block")
            if best is None or key > best[0]:
                best = (key, h + p, verdict)
    return (host, path, best[1] if best else None, best[2] if best else default)


def urls():
    rng = random.Random(4)
    hosts = ["example.org", "a.example.org", "b.a.example.org", "EXAMPLE.ORG", "xexample.org", "org", "com", "x.com", "y.net", "a..org", ".org", "é.com"]
    paths = ["", "/", "/es", "/es/", "/es/x", "/en/1", "/en/12?q#f", "/en/2", "/fr/x", "/de/", "/de/é\U0010FFFF", "?es/", "#/es/", "/fr/a/b", "/d"]
    rows = [f"http{'s' * rng.randrange(2)}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    return rows + [None, "", "no scheme", "://", "x://", "a://b://example.org/es/", "http:///es/", "https://example.org/\nes/"]


@pytest.mark.parametrize("more", [[], [("block", "org", "/es"), ("allow", "a.example.org", "/es/x"), ("block", "com", "/"),
                                       ("allow", "com", "/d"), ("block", "com", "/de/é"), ("allow", "org", "/"), ("block", "org", "/"),
                                       (None, "net", "/"), ("block", None, "/"), ("block", "y.net", None), ("allow", "example.org", "")]])
def test_sweep_equals_plain_rules(spark, monkeypatch, more):
    monkeypatch.setattr(urlrules, "SHARE", 25)
    rules = urlrules.RULES + more
    clean = [(v, h, "/" if p is None else p) for v, h, p in rules if v and h]
    pages = spark.createDataFrame(list(enumerate(urls())), "page_id long, url string").withColumn("rule", F.lit("old")).withColumn("at", F.lit(1))
    got = urlrules.judge(pages, spark.createDataFrame(rules, urlrules.RULE_SQL)).collect()
    assert len(got) == len(urls()) and got[0]["at"] == 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, clean), r.url


def test_sweep_without_rows_or_rules(spark):
    pages = spark.createDataFrame(list(enumerate(urls())), "page_id long, url string")
    none = spark.createDataFrame([], urlrules.RULE_SQL)
    assert {r.verdict for r in urlrules.judge(pages, none, default="block").collect()} == {"block"}
    assert urlrules.judge(pages.limit(0), urlrules.production_rules(spark)).count() == 0
    plan = urlrules.judge(pages, urlrules.production_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan


# -- WARC ---------------------------------------------------------------------------------------

def test_derivatives_are_linked_and_digested(spark):
    rows = [(1, "http://a/x", PAGE), (2, None, None), (3, "http://b/", ""), (1, "http://a/x", PAGE), (None, "u", "<p>é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    sources = warc.responses(pages, "2024-01-01T00:00:00Z")
    of = {r.record_id: r for r in sources.collect()}
    assert len(of) == len(rows)
    made = warc.derive(sources).collect()
    assert len(made) == 2 * len(rows) and len({r.record_id for r in made}) == len(made)
    for r in made:
        source = of[r.refers_to]
        assert (r.target_uri, r.warc_date, r.payload_digest, r.page_id) == (source.target_uri, source.warc_date, source.payload_digest, source.page_id)
        assert r.block_digest == warc.digest(bytes(r.block))
        other = next(x for x in made if x.record_id == r.concurrent_to)
        assert other.concurrent_to == r.record_id and other.warc_type != r.warc_type
    text = {r.page_id: bytes(r.block).decode() for r in made if r.warc_type == "conversion"}
    assert text[1] == "Home\nBuy now.\nA & B\nFirst line\nSecond line <x>.\n© x" and text[None] == "é" and text[2] == ""
    meta = next(bytes(r.block).decode() for r in made if r.warc_type == "metadata" and r.page_id == 1)
    body = PAGE.encode()
    assert f"payload-length: {len(body)}\r\n" in meta and "title: T\r\n" in meta and "links: 1\r\n" in meta and "http-status: 200\r\n" in meta
    import base64
    assert "payload-digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() in meta


def test_members_and_files_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", PAGE) for k in range(5)], "page_id long, url string, html string")
    records = warc.responses(pages, "2024-01-01T00:00:00Z").drop("page_id")
    every = records.unionByName(warc.derive(records))
    stored = warc.members(every)
    back = warc.read_members(stored)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, every.collect())) == sorted(map(key, back.collect()))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(bytes(r.member) for r in stored.collect()))
    whole = warc.read_members(spark.read.format("binaryFile").load(str(path)).select(F.col("content").alias("member")))
    assert whole.count() == 15
    cut = spark.createDataFrame([(gzip.decompress(path.read_bytes())[:-30],)], "member binary")
    assert warc.read_members(cut).count() == 14


def test_odd_responses():
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nTransfer-Encoding: chunked\r\n\r\n4\r\n<p>\xe9\r\n2\r\nab\r\n0\r\n\r\n"
    zipped = b"HTTP/1.1 404 x\r\nContent-Type: application/xhtml+xml\r\nX-A: 1\r\n 2\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"<p>z")
    broken = b"HTTP/1.1 200\r\nContent-Type: text/html; charset=nope\r\nContent-Encoding: gzip\r\n\r\n<p>kept"
    make = lambda block, **k: warc.derivatives(warc._row(warc_type="response", record_id="<r>", block=block, **k))
    assert make(chunked)[1]["block"] == "éab".encode() and make(zipped)[1]["block"] == b"z" and make(broken)[1]["block"] == b"kept"
    assert b"http-x-a: 1 2\r\n" in make(zipped)[0]["block"] and b"http-status: 404" in make(zipped)[0]["block"]
    assert [r["warc_type"] for r in make(b"no head")] == ["metadata"] == [r["warc_type"] for r in make(None)]
    assert [r["warc_type"] for r in make(b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nx")] == ["metadata"]
    assert warc.derivatives(warc._row(warc_type="request", record_id="<r>")) == [] == warc.derivatives(warc._row(warc_type="response"))
    named = make(chunked, headers=[{"name": "X-Source", "value": "v"}])
    assert all(r["headers"] == [{"name": "X-Source", "value": "v"}] and r["refers_to"] == "<r>" for r in named)
    assert list(warc.parse_records(io.BufferedReader(io.BytesIO(b"\r\nWARC/1.0\r\nbad line\r\nContent-Length: x\r\n\r\n")))) == []
