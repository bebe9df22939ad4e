import gzip

import pytest

from webloom.functions import discovery_kernel as D
from webloom.functions import encoding_kernel as E
from webloom.functions import html_kernel as H
from webloom.functions import robots_kernel as R
from webloom.functions import url_kernel as U
from webloom.functions import xml_kernel as X


@pytest.mark.parametrize(
    ("raw", "base", "want"),
    [
        ("b/./c#top", "http://WWW.Example.ORG:80/x/", "http://www.example.org/x/b/c"), ("http://u:p@x/", None, None), ("javascript:x", "http://a/", None), ("http://[::1", None, None),
        ("/café/😀", "http://a/", "http://a/caf%C3%A9/%F0%9F%98%80"), ("../x?y#z", "http://a/b/c/d", "http://a/b/x?y"), ("./", "http://a/b/c", "http://a/b/"), ("?q", "http://a/b?z", "http://a/b?q"),
        ("", "http://a/b?z", "http://a/b?z"), ("//H:80/x", "http://a/", "http://h/x"), ("http:x", "http://a/b/c", "http://a/b/x"), ("\\\\h\\p", "http://a/", "http://h/p"), ("ht\ntp://a/\tb", None, "http://a/b"),
        ("http://0x7f.1/", None, "http://127.0.0.1/"), ("http://[::0:1]/", None, "http://[::1]/"), ("http://a:99999/", None, None), ("http://a b/", None, None), ("x", None, None), ("/a/%2E%2e/b", "http://h/", "http://h/b"),
        ("http://bücher.de", None, "http://xn--bcher-kva.de/"), (" http://a/ b ", None, "http://a/%20b"), ("/ß,a", "http://a/", "http://a/%C3%9F,a"), ("http:///x/y", None, "http://x/y"),
    ],
)
def test_urls(raw, base, want):
    assert U.normalize(raw, base) == want
    assert (U.failure(raw, base) is None) == (want is not None)


ROBOTS = "User-agent: *\nDisallow: /a\nAllow: /a/b\nAllow: /tie\nDisallow: /tie\nDisallow:\nUser-agent: site\nUser-agent: other\nDisallow: /*.pdf$\nDisallow: /x%2Fy # c\nCrawl-delay: 3\nSitemap: http://x/s\nSitemap: http://x/s\n"


@pytest.mark.parametrize(
    ("token", "path", "want"),
    [("x", "/a", False), ("x", "/a/b", True), ("x", "/tie", True), ("x", "/", True), ("MySiteBot", "/z.pdf", False), ("MySiteBot", "/z.pdf?q", True), ("MySiteBot", "/a", True), ("site", "/x%2fy", False), ("site", "/x/y", True)],
)
def test_robots(token, path, want):
    assert R.allowed(R.parse(ROBOTS), token, path) is want


def test_robots_details():
    r = R.parse(ROBOTS)
    assert r.sitemaps == ["http://x/s"] and R.crawl_delay(r, "site") == 3 and R.crawl_delay(r, "x") is None
    assert R.specificity("/é%20*x$") == 5 and R.normalise("/%7ea%c3\ud800") == "/~a%C3%EF%BF%BD"


def test_html_facts():
    p = H.Page('<html lang=fr><head><meta name=Description content="d"><meta property="og:x" content=y><base href="http://["><base href="/b/"><title> A &amp; B</title></head><h2>x</h2><h1>y <b>z</b></h1><h3>w</h3>', "http://h/")
    assert (p.title, p.base_href, p.lang, p.meta("description")) == ("A & B", "http://h/b/", "fr", "d") and p.warnings == ["BASE_HREF_IGNORED"]
    assert [h["level"] for h in p.headings] == [2, 1, 3] and [o["depth"] for o in p.outline] == [1, 1, 2]


def test_html_text_bounds_and_raw_text():
    p = H.Page('<p>é😀z</p><script>var t="</p>";</script><style>p{}</style><!-- <p>no -->', "http://h/", 3)
    assert p.visible_text == {"text": "é", "total_bytes": 7, "truncated": True}
    assert p.scripts[0]["text"] == 'var t="</p>";'


def test_html_links_in_collection_order():
    page = '<link rel="stylesheet" href=s><img src=i srcset="data:a,b 1x, c 2x"><a href="/q" rel="NoFollow">t<a href="">u</a><area href=z><iframe srcdoc="<a href=in>x</a>"></iframe><meta http-equiv=refresh content="1; url=\'/r\'"><video poster=p>'
    got = [(x["source"], x["raw"]) for x in H.Page(page, "http://h/").links()]
    assert got == [("a[href]", "/q"), ("a[href]", ""), ("area[href]", "z"), ("link[href]", "s"), ("img[src]", "i"), ("img[srcset]", "data:a,b"), ("img[srcset]", "c"), ("meta-refresh", "/r"), ("iframe[srcdoc]", "in"), ("video[poster]", "p")]
    assert H.Page(page, "http://h/x").resolve("") == "http://h/x"


def test_robots_header_and_refresh():
    assert H.robots_header("Bot: noindex, nofollow") == [{"agent": "bot", "directive": "noindex"}, {"agent": None, "directive": "nofollow"}]
    assert H.meta_refresh("5;URL=/x") == (5.0, "/x") and H.meta_refresh("now") is None and H.meta_refresh("3") == (3.0, None)


def test_css():
    sheet = '@im\\70ort url("print.css"); @IMPORT \'wide.css\' screen; li{cursor:\\55 RL(hand.cur)} .q::before{content:"url(text)"} i{mask:url(blob:1)} /*@ sourceMappingURL = all.map*/'
    got = [(f.method, f.url) for f in D.css_urls(sheet)]
    assert got == [("source-map", "all.map"), ("import", "print.css"), ("import", "wide.css"), ("url", "hand.cur")]
    assert [f.url for f in D.css_urls("a{b:url(1)}c{d:url(2)}@import '3'", 2)] == ["3", "1"]


def test_js():
    script = "fetch('/api'); var x = new XMLHttpRequest(); x.open('GET', '/y'); z.open('GET', '/n'); // fetch('/c')\nimport('./m.js'); new URL('http://u/'); '/lit'; 'plain text'"
    got = {f.url: (f.method, f.confidence) for f in D.js_urls(script)}
    assert got["/api"] == ("fetch", "high") and got["/y"] == ("xhr", "high") and got["/n"] == ("relative", "medium") and got["./m.js"][0] == "import" and got["http://u/"][0] == "url" and "plain text" not in got
    assert {f.method for f in D.js_urls(script, "regex")} <= {"absolute", "relative", "source-map"}
    assert [f.url for f in D.js_urls(script, limit=1)] == ["/api"]


def test_strings_comments_and_templates():
    script = "/* fetch('/no') */ a = `x\n${y}`; window . fetch( `/t` ); fetch(`/${z}`); my.fetch('/own'); 'it\\'s'; r = new XMLHttpRequest; r.open('PUT', \"/p\"); r = 1; \"open"
    got = {f.url: f.method for f in D.js_urls(script, "ast")}
    assert got == {"/t": "fetch"}
    assert {f.url for f in D.js_urls(script, "regex")} == {"/no", "/own", "/p"}  # quotes pair up within lines
    many = "'" * 200_001 + '"\n' * 1000
    assert list(D.source_maps("//# sourceMappingURL=a.map\n x sourceMappingURL=b @ SOURCEMAPPINGURL = c*/")) == [(2, "a.map"), (49, "c")]
    assert D.js_urls(many) == []


def test_link_header():
    assert [(x["url"], x["kind"]) for x in D.link_header('<a>; title="x, <y>"; rel="alternate canonical", <b>;rel=prefetch, <c>')] == [("a", "canonical"), ("b", "prefetch"), ("c", "asset")]


def test_sitemap_warnings():
    body = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url/><url><loc>http://[</loc></url><url><loc>http://o/x</loc></url><url><loc>/x</loc></url><url><loc>/d/x</loc><lastmod>2023-11-31</lastmod><changefreq>Often</changefreq><priority>1e0</priority></url></urlset>'
    got = [e["warnings"] for e in X.extract(body, "http://h/d/s.xml")["sitemap"]]
    assert got == [["missing loc"], ["invalid url"], ["other origin"], ["outside path prefix"], ["invalid lastmod", "invalid changefreq", "invalid priority"]]


@pytest.mark.parametrize(("text", "want"), [("2024", True), ("2024-13", False), ("2024-02-29", True), ("2023-02-29", False), ("2024-01-01T10:00Z", True), ("2024-01-01T10:00", False), ("2024-01-01T10:00:00.5+02:00", True), ("2024-01-01T24:00Z", False)])
def test_lastmod(text, want):
    assert X.valid_lastmod(text) is want


def test_xml_kinds_and_failures():
    kind = lambda s: X.extract(s, "http://h/")["kind"]
    assert kind('<feed xmlns="http://www.w3.org/2005/Atom"/>') == "feed" and kind("<rss/>") == "feed" and kind('<urlset xmlns="http://x/"/>') == "xml"
    assert X.extract("<a>", "http://h/")["status"] == "failed"
    assert X.extract('<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>', "http://h/")["status"] == "failed"
    assert X.extract(gzip.compress(b"<a>" + b" " * 5000 + b"</a>"), "http://h/", 100)["status"] == "budget"
    assert X.extract(gzip.compress(b"<rss><channel><item><link>/x</link></item></channel></rss>"), "http://h/")["feed"][0]["url"] == "http://h/x"
    assert X.extract(gzip.compress(b"<a/>")[:-6], "http://h/")["status"] == "failed"


def test_encodings():
    assert E.decode(b"\xef\xbb\xbfh\xc3\xa9", "text/html; charset=latin-1")[:3] == ("hé", "utf-8", "bom")
    assert E.decode(b"\x80", "text/html; charset=latin1").text == "€"
    assert E.decode(b'<meta charset="utf-16">x', "text/html; charset=utf-8").source == "http"
    assert E.decode(b"<meta charset=koi8-r>\xc1").text.endswith("а")
    assert E.decode(b'<?xml version="1.0" encoding="iso-8859-2"?>\xb1', None, "xml").text.endswith("ą")
    assert E.decode(b"a", "x; charset=utf-32")[3:] == (False, "unsupported encoding") and E.decode(b"a", "x; charset=utf-32", fatal=True).text is None
    assert E.decode(b"\xff\xfea\x00").text == "a" and E.decode(b"a\xff").replaced and E.decode(b"a\xff", fatal=True).text is None
