import gzip
import os
import re
import time
from html.parser import HTMLParser

import pytest

from webloom.functions.html_kernel import BLOCK, HIDDEN
from webloom.llm.warc import derive, digest, extract, parse, responses, shards, visible_text

DATA = "/root/testdata/sf0.001"

PAGE = '<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>A &amp; B</title><style>p{}</style></head><body><script>var t="</p>";</script><!-- x --><h1>Hé</h1><p>one<b>two</b><br>three &middot; <a href="/x?a=1&amp;b">l</a><a href=\'y\'>m</a></body></html>'


def test_visible_text():
    assert visible_text(PAGE) == "Hé\nonetwo\nthree · lm"
    assert visible_text("") == "" and visible_text("2 < 3 > 1") == "2 < 3 > 1"


def test_records_link_and_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE, 1), (2, None, None, 1), (None, "http://b/", "", 1), (1, "http://a/", PAGE, 1)], "page_id long, url string, html string, record int")
    source = responses(pages)
    rows = derive(source).collect()
    assert len(rows) == 8
    urn = {r.key: r.record_id for r in source.collect()}
    for r in rows:
        ((headers, block),) = parse(bytes(r.record))
        assert headers["WARC-Refers-To"] == r.refers_to == urn[r.key]
        assert headers["WARC-Block-Digest"] == r.block_digest == digest(block) and len(block) == r.content_length
        assert headers["WARC-Source-Payload-Digest"] == r.payload_digest == digest({1: PAGE, 2: "", None: ""}[r.key].encode())
        assert headers["WARC-Type"] == r.record_type and headers.get("WARC-Target-URI") == (r.target_uri or None)
    meta = next(r for r in rows if r.key == 1 and r.record_type == "metadata")
    block = next(parse(bytes(meta.record)))[1].decode().splitlines()
    assert "title: A & B" in block and "outlink: /x?a=1&b" in block and "outlink: y" in block and "language: fr" in block and "source-header: HTTP/1.1 200 OK" in block
    text = next(r for r in rows if r.key == 1 and r.record_type == "conversion")
    assert next(parse(bytes(text.record)))[1].decode() == visible_text(PAGE)
    assert len({r.record_id for r in rows}) == 6


def test_shards(spark):
    pages = spark.range(25).selectExpr("id as page_id", "concat('http://h/', id) as url", "'<p>x' as html")
    content = [bytes(r.content) for r in shards(derive(responses(pages)), 7).collect()]
    assert sum(len(list(parse(gzip.decompress(c)))) for c in content) == 50
    assert derive(responses(pages.limit(0))).count() == 0


def test_markup_that_patterns_get_wrong():
    assert visible_text('<p title="a>b">hi</p>') == "hi"
    assert visible_text("x<y and z>w") == "xw"  # a start tag by the standard
    assert visible_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert extract("<title>t</title><body>seen<template>not</template> too").text == "seen too"
    assert extract("<html lang=de><head><title>A &amp; B</title><body>b<a href=' /x y '>l</a>").outlinks == ["/x y"]


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<p ", "<a href='", "<title>", "<", "</p", "&amp", "<div>"])
def test_unclosed_markup_is_linear(piece):
    page = piece * (1_000_000 // len(piece))
    begin = time.process_time()
    extract(page)
    assert time.process_time() - begin < 6


class Plain(HTMLParser):
    """The same facts by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden, self.titles, self.links = [], [], [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(" ".join(dict(attrs)["href"].split()))
        if tag == "body":
            self.hidden = [h for h in self.hidden if h != "head"]
        if tag in HIDDEN:
            self.hidden.append(tag)
        if tag in BLOCK:
            self.parts.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        if tag in BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.hidden and self.hidden[-1] == "title":
            self.titles.append(data)
        if not self.hidden:
            self.parts.append(data)

    def text(self):
        lines = [" ".join(re.findall(r"\S+", line)) for line in "".join(self.parts).split("\n")]
        return "\n".join(line for line in lines if line)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_whole_table_against_another_parser(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    html = {r.page_id: r.html or "" for r in pages.collect()}
    same = {"metadata": 0, "conversion": 0}
    for r in derive(responses(pages)).collect():
        ((_, block),) = parse(bytes(r.record))
        other = Plain(html[r.key])
        if r.record_type == "conversion":
            same["conversion"] += block.decode() == other.text()
        else:
            fields = block.decode().splitlines()
            title = [" ".join("".join(other.titles).split())]
            same["metadata"] += [f[9:] for f in fields if f.startswith("outlink: ")] == other.links and [f[7:] for f in fields if f.startswith("title: ")] == [t for t in title if t]
    assert min(same.values()) >= 0.98 * len(html), same


def test_charset_of_the_response(spark):
    page = "<title>é</title><p>ü"
    rows = [(1, "u", "http://a/", "d", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1", page.encode("latin-1"), "x"), (2, "v", "http://b/", "d", None, ("<meta charset=windows-1251>" + "<p>ж").encode("cp1251"), "x")]
    got = {(r.key, r.record_type): next(parse(bytes(r.record)))[1].decode() for r in derive(spark.createDataFrame(rows, "key long, record_id string, target_uri string, date string, http_headers string, payload binary, block string")).collect()}
    assert got[1, "conversion"] == "ü" and "title: é" in got[1, "metadata"]
    assert got[2, "conversion"] == "ж"
