"""Resource graph, admission of its links, and nested facts, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.functions.element_kernel import nested_elements
from webloom.operators import nesting as N
from webloom.operators import resource_graph as G
from webloom.operators.resources import prepare
from webloom.operators.scope import Scope


def test_numbers_grow_in_order(spark):
    rows = [(None, 5), (None, 2), (3, 200_000), (3, 1), (1, 7), (2**40, 0)]
    got = G.numbered(spark.createDataFrame(rows, "page_id long, position long").repartition(5), ["page_id", "position"], "numbered").orderBy("seq").collect()
    assert [(r.page_id, r.position) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) and len({r.seq for r in got}) == 6


@pytest.mark.parametrize("seed", range(3))
def test_attribution_against_search(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(40)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(60)] + [("n00", "n00")]
    pages = [("n00", 7), ("n01", 3), ("n01", 9), ("n02", 3)]
    best = {}
    for url, ordinal in pages:
        best[url] = min(best.get(url, (0, ordinal, (url,))), (0, ordinal, (url,)))
    level, found = dict(best), dict(best)
    for hop in range(1, 5):
        new = {}
        for a, b in edges:
            if a in level and b not in found:
                way = (hop, level[a][1], (*level[a][2], b))
                new[b] = min(new.get(b, way), way)
        found |= new
        level = new
    got = G.attribute_assets(spark.createDataFrame(edges, "from_url string, to_url string"), spark.createDataFrame(pages, "url string, ordinal int"), max_hops=4).collect()
    assert {x.url: (x.hops, x.ordinal, tuple(x.path)) for x in got} == {k: v for k, v in found.items() if v[0]}


def test_edges_of_every_type_through_admission(spark):
    html = '<a href="/b">t</a><link rel=stylesheet href="/s.css"><script src="/j.js"></script><a href="/pic.png">x</a>'
    rows = [
        (1, "http://h/a", "text/html", html, "</h>; rel=next, <http://far/>; rel=prev"), (2, "http://h/s.css", "text/css", '@import "t.css"; i{background:url(http://far/x.png)} /*# sourceMappingURL=s.map */', None),
        (3, "http://h/j.js", "text/javascript", "fetch('/api'); var a = '/b';", None), (4, "http://h/none", "text/html", None, "</late>; rel=next"), (5, "http://h/k.js", "text/javascript", "fetch('http://[')", None),
    ]
    fetches = spark.createDataFrame([(i, u, u, 200, c, None if b is None else b.encode(), h) for i, u, c, b, h in rows], "request_id long, requested_url string, final_url string, status int, content_type string, body binary, link_header string")
    edges = G.resource_edges(prepare(fetches))
    requests = spark.createDataFrame([(i, 0, "http://h/") for i in range(1, 5)], "request_id long, depth int, seed_url string")

    def statuses(**more):
        return [(r.request_id, r.raw, r.kind, r.status, r.enqueue_source) for r in G.decide_edges(edges, requests, Scope(), **more).orderBy("seq").collect()]

    off = statuses()
    assert off == [
        (1, "/h", "navigation", "enqueued", "html-link"), (1, "http://far/", "navigation", "rejected_scope", None), (1, "/b", "navigation", "enqueued", "html-link"), (1, "/pic.png", "navigation", "asset_skipped", None),
        (1, "/s.css", "stylesheet", "asset_skipped", None), (1, "/j.js", "script", "asset_skipped", None), (2, "s.map", "source-map", "asset_skipped", None), (2, "t.css", "css-discovery", "asset_skipped", None),
        (2, "http://far/x.png", "css-discovery", "asset_skipped", None), (3, "/api", "script-discovery", "asset_skipped", None), (3, "/b", "script-discovery", "asset_skipped", None), (4, "/late", "navigation", "enqueued", "html-link"),
        (5, "http://[", "script-discovery", "asset_skipped", None),
    ]
    on = {(r[0], r[1]): r[3:] for r in statuses(enqueue_styles=True, enqueue_scripts=True, page_styles=True, page_scripts=True)}
    assert on[2, "t.css"] == ("enqueued", "css-static") and on[2, "http://far/x.png"] == ("rejected_scope", "css-static") and on[3, "/api"] == ("enqueued", "javascript-static")
    assert on[3, "/b"][0] == "already_seen" and on[1, "/s.css"] == ("enqueued", "css-static") and on[1, "/j.js"] == ("enqueued", "javascript-static") and on[5, "http://["][0] == "asset_skipped"
    share = {r.source: r for r in G.internal_share(G.decide_edges(edges, requests, Scope())).collect()}
    assert (share["style-content"].extracted, share["style-content"].internal, share["style-content"].external) == (3, 2, 1)
    few = statuses(limit=1)
    assert [r[1] for r in few if r[0] == 1] == ["/h", "/b"] and len([r for r in few if r[0] == 2]) == 3


def tree(r, depth=0):
    """A random page and, for each item, its parent and properties, as a plain walk finds them."""
    items, props, html, n = [], [], [], [0]

    def walk(depth, item):
        for _ in range(r.randint(0, 4 if depth < 4 else 0)):
            n[0] += 1
            mark, scope, names = str(n[0]), r.random() < 0.4, r.choice(["", "", "p", "p q"])
            tag = r.choice(["div", "span", "section", "b"])
            me = mark if scope else item
            html.append(f'<{tag} {"itemscope itemtype=t" + mark if scope else ""} {"itemprop=" + chr(34) + names + chr(34) if names else ""}>')
            if scope:
                items.append((f"t{mark}", f"t{item}" if item else None))
            for name in names.split():
                props.append((f"t{item}" if item else None, name, f"t{mark}" if scope else None))
            if r.random() < 0.3:
                html.append(f'<meta itemprop=m content="{mark}"><br>')
                props.append((f"t{me}" if me else None, "m", mark))
            walk(depth + 1, me)
            html.append(f"</{tag}>")

    walk(0, None)
    return "".join(html), items, props


def test_microdata_against_a_walk(spark):
    r = random.Random(4)
    trees = [tree(r) for _ in range(60)]
    pages = spark.createDataFrame([(i, "http://h/", t[0]) for i, t in enumerate(trees)] + [(99, "http://h/", None), (98, None, "<p itemprop=x>y")], "page_id long, url string, html string")
    items, props = N.microdata(N.nested(pages))
    types = items.select("page_id", F.col("item").alias("parent"), F.col("itemtype").alias("of"))
    got = sorted((x.page_id, x.itemtype, x.of) for x in items.join(types, ["page_id", "parent"], "left").select("page_id", "itemtype", "of").collect())
    want = sorted((i, *x) for i, t in enumerate(trees) for x in t[1])
    assert [str(x) for x in got] == [str(x) for x in want] and len(want) > 100
    values = items.select("page_id", F.col("item").alias("value_item"), F.col("itemtype").alias("v"))
    got = [(x.page_id, x.parent_type, x.name, x.v if x.v else x.value if x.name == "m" else None) for x in props.join(values, ["page_id", "value_item"], "left").where("page_id < 90").collect()]
    want = [(i, *x) for i, t in enumerate(trees) for x in t[2]]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert [(x.item, x["name"], x.value) for x in props.where("page_id >= 90").collect()] == [(None, "x", "y")]


def test_implied_and_missing_ends():
    names = lambda html: [(e.tag, e.itemprop, e.value) for e in nested_elements(html, "http://h/a/")]
    assert names("<ul><li itemprop=a>1<li itemprop=b>2</ul><p itemprop=c>3<div>4</div></b><i itemprop=d>5") == [("li", ["a"], "1"), ("li", ["b"], "2"), ("p", ["c"], "3"), ("i", ["d"], "5")]
    assert names("<a itemprop=u href='../x'>t</a><time itemprop=t datetime=2024>now</time><time itemprop=t>now</time><img itemprop=i><meta itemprop=m>") == [("a", ["u"], "http://h/x"), ("time", ["t"], "2024"), ("time", ["t"], "now"), ("img", ["i"], ""), ("meta", ["m"], "")]


def test_outline(spark):
    html = "<h2>a</h2><h1>b</h1><section><h3>c</h3><h2>d</h2><h3>e</h3><nav></nav></section><h4>f</h4><h2>g</h2>"
    nodes = N.outline(N.nested(spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string"))).orderBy("node").collect()
    names = {n.node: n.text or n.tag for n in nodes}
    assert {names[n.node]: names.get(n.parent) for n in nodes} == {"a": None, "b": None, "section": None, "c": "section", "d": "section", "e": "d", "nav": "section", "f": "b", "g": "b"}
