import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigraph.llm import extract


def page(i, body, extra=""):
    return f"<html><head><title>t{i}</title><script>x='</p>'</script></head><body>{extra}{body}</body></html>"


def test_parts_entities_and_white_space():
    html = """<!DOCTYPE html><body><div class="cookieNotice">We use</div><header><h1>Site</h1></header><nav><ul><li>m</ul></nav>
    <article><header><h1>Real &amp; &#116;itle</h1><p class="by">by me</p></header><p>One<br>two <i>th</i>ree&nbsp;x<ul><li>a<li>b</ul>
    <div class="ad-slot">buy</div><aside>side</aside><form><input><label>q</label></form><style>p{}</style><!-- c --><p hidden>h</p>
    <section id="comments"><p>first!</p></section><p>Last</p></article><footer>f</footer></body>"""
    assert extract.Page(html).text() == "Real & title\n\nOne two three x\n\na\n\nb\n\nLast"
    assert extract.Page("<p>no article<p>second<div id=footer>f</div>").text() == "no article\n\nsecond"
    assert extract.Page("").text() == "" and extract.Page("plain").text() == "plain"
    assert extract.Page("<div>" * 3000 + "deep").text() == "deep"


def brute_scores(pages):
    """The style tree of one host, from the pages' statistics, by recursion."""
    stats = [extract.page_statistics(extract.Page(html)) for html in pages]
    info, styles, segments, named = {}, {}, {}, {}
    for nodes, content in stats:
        for node, (parent, depth, style, _, name) in nodes.items():
            info[node] = (parent, depth)
            styles.setdefault(node, []).append(style)
            named[node] = named.get(node, 0) + name
        for (node, segment), times in content.items():
            segments.setdefault(node, {}).setdefault(segment, []).append(times)
    entropy = lambda counts: -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)
    importance = {}
    for node in sorted(info, key=lambda n: -info[n][1]):
        m, kinds = len(styles[node]), Counter(styles[node])
        presentation = entropy(list(kinds.values())) / math.log(m) if m > 1 else 1.0
        below = [(len(styles[c]), importance[c]) for c in info if info[c][0] == node and c != node]
        if node in segments:
            spread = [entropy(t) / math.log(m) if m > 1 else 0.0 for t in segments[node].values()]
            below.append((m, 1 - sum(spread) / len(spread)))
        inner = sum(p * x for p, x in below) / sum(p for p, _ in below) if below else 1.0
        decay = 0.9 ** len(kinds) if len(kinds) > 1 else 1.0
        importance[node] = (1 - decay) * presentation + decay * inner
    out = {}
    for node, x in importance.items():
        m = len(styles[node])
        out[node] = (x, (m / (m + 0.5) * x + 0.5 / (m + 0.5)) * (1 - 0.85 * named[node] / m))
    return out


def test_style_tree_against_recursion(spark):
    hosts = {"a.x": [page(i, f"<nav><a href=/>Home</a></nav><article><h1>T {i}</h1>{'<p>own %d</p>' % i * (i % 4)}</article><div class=box><p>same</p></div>") for i in range(12)], "b.x": [page(i, f"<div><p>only {i}</p><p>x</p></div>") for i in range(3)]}
    rows = [(f"http://{h}/{i}", html) for h, pages in hosts.items() for i, html in enumerate(pages)]
    got = extract.style_tree(spark.createDataFrame(rows, "url string, html string")).collect()
    for h, pages in hosts.items():
        want, own = brute_scores(pages), {r.node: r for r in got if r.host == h}
        assert set(own) == set(want)
        for node, (importance, score) in want.items():
            assert own[node].importance == pytest.approx(importance) and own[node].score == pytest.approx(score)


def test_tree_removes_the_parts_of_the_standard_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.host: (frozenset(r.removed), frozenset(r.kept)) for r in extract.verdicts(pages).collect()}
    rows = pages.withColumn("host", extract.host()).collect()
    changed = 0
    for r in rows:
        p = extract.Page(r.html or "")
        raw, own = p.text(frozenset(), frozenset(p.nodes)), p.text(*found.get(r.host, ((), ())))
        removed = frozenset(found.get(r.host, ((), ()))[0])
        changed += raw != p.text(removed, frozenset(p.nodes) - removed)
        article = extract.Page(r.html[r.html.index("<article>") : r.html.index("</article>")]).text()
        assert own == article
    assert changed > 0.9 * len(rows)


def test_hostile_pages():
    words = "The text of this page is long enough to be most of it."
    assert extract.Page("<p>a</p><![foo[ x><script>evil()</script><nav>menu</nav><p>b</p>").text() == "a\n\nb"
    assert extract.Page(f"<div class='search-results-article'><p>{words}</p></div>").text() == words
    assert extract.Page(f"<p>{words}</p><article><p>{words}</p></article>").text() == f"{words}\n\n{words}"
    began = time.time()
    deep = extract.Page("<div>a" * 50_000)
    assert len(deep.text().split("\n\n")) == 50_000 and len(deep.nodes) <= extract.MOST_DEPTH + 1
    assert len(extract.page_statistics(deep)[0]) <= extract.MOST_DEPTH + 1
    assert extract.Page("<nav>x" * 20_000 + "</nav>" * 20_000 + "</b>" * 20_000 + "<p>end").text() == "end"
    assert time.time() - began < 20


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_site_tree_removes_what_a_host_repeats_and_keeps_articles(spark, monkeypatch, most):
    monkeypatch.setattr(extract, "BROADCAST_NODES", most)
    rows = []
    for i in range(20):
        own = f"<div class=story><p>Story number {i} tells of {i * 7} rivers.</p><p>And of {i * 3} hills, at length, for the share of text.</p></div>"
        rows.append((i, f"http://a.example/{i}", page(i, own, "<div class=strip><p>Always the same words</p></div>")))
        rows.append((100 + i, f"http://copies.example/{i}", page(i, "<p>One and the same page everywhere</p>")))
    rows += [(200, "http://b.example/", page(200, "<div class=strip><p>Always the same words</p></div>")), (201, None, page(201, "<p>no url</p>")), (202, "http://a.example/x", None), (203, "http://a.example/y", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1)).withColumn("removed", F.lit(1))
    got = {(r.page_id, r.url): r for r in extract.extracted(df).collect()}
    assert extract.extracted(df).count() == len(rows)
    assert got[3, "http://a.example/3"].text == "Story number 3 tells of 21 rivers.\n\nAnd of 9 hills, at length, for the share of text."
    assert got[103, "http://copies.example/3"].text == "One and the same page everywhere"
    assert got[200, "http://b.example/"].text == "Always the same words"
    assert got[201, None].text == "no url" and got[201, None].n_chars == 6
    assert got[202, "http://a.example/x"].text == got[203, "http://a.example/y"].text == ""
    assert extract.extracted(df.limit(0)).collect() == []


def test_names_do_not_remove_the_main_text():
    page = lambda html: extract.Page(html).text()
    words = "The text of this page is long enough to be most of it."
    assert page(f'<nav>Home</nav><div class="site-content has-sidebar"><article><p>{words}</p></article><div class="sidebar">Links</div></div>') == words
    assert page(f'<div id="content" class="no-sidebar"><p>{words}</p><div class="share">Share</div></div>') == words
    assert page(f'<form id="aspnetForm"><nav>Home</nav><div><p>{words}</p></div></form>') == words
    assert page(f'<article><p>{words}</p></article><aside class="related"><article>Teaser</article></aside>') == words
    assert page(f'<p>{words} <span class="share">Share</span> More.</p>') == f"{words} More."
    assert page(f'<div class="sidebar-left" role="main"><p>{words}</p></div><article>Teaser</article>').startswith(words)


def host_pages(n, make):
    return [(i, f"http://h.example/{i}", page(i, make(i))) for i in range(n)]


def extracted(spark, rows):
    return {r.page_id: r.text for r in extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("pages", [3, 4, 20])
def test_a_nameless_menu_goes_on_hosts_of_few_pages(spark, pages):
    rows = host_pages(pages, lambda i: f"<div class=q><ul><li>Home<li>Shop</ul></div><div class=r><p>Story {i} of {i * 7} rivers.</p><p>And {i * 3} hills.</p></div>")
    assert extracted(spark, rows)[1] == "Story 1 of 7 rivers.\n\nAnd 3 hills."


def test_numbered_siblings_are_told_apart(spark):
    rows = host_pages(12, lambda i: f"<div class=col-3><p>Home Shop Cart</p></div><div class=col-9><p>Story {i} of {i * 7} rivers.</p></div><div class=post-{1000 + i}><p>More {i} of {i * 5}.</p></div><div class=x3><p>All rights with us</p></div>")
    assert extracted(spark, rows)[2] == "Story 2 of 14 rivers.\n\nMore 2 of 10."


@pytest.mark.parametrize("depth", [4, 30])
def test_deep_templates(spark, depth):
    rows = host_pages(15, lambda i: "<div class=w>" * depth + f"<div class=t><p>Always the same</p></div><div class=u><p>Story {i} of {i * 7} rivers.</p><p>And {i * 3} hills.</p></div>" + "</div>" * depth)
    assert extracted(spark, rows)[3] == "Story 3 of 21 rivers.\n\nAnd 9 hills."


def test_the_name_of_a_node_is_no_part_of_it():
    one, two = (extract.Page(f"<div class='{c}'><p>x</p></div><footer>y</footer>") for c in ("story", "story"))
    assert one.nodes == two.nodes
    wide = extract.Page("<form class=a><p>all of the text of this page</p></form>")
    narrow = extract.Page("<form class=a><p>x</p></form><p>all of the text of this page</p>")
    assert wide.nodes[1] == narrow.nodes[1] and wide.named[1] != narrow.named[1]


def test_groups_of_pages_give_what_broadcast_verdicts_give(spark, monkeypatch):
    rows = host_pages(30, lambda i: f"<div class=q><p>Home Shop</p></div><div class=r><p>Story {i} of {i * 7}.</p></div>") + [(99, None, "<p>no url</p>"), (98, "http://h.example/x", None)]
    want = extracted(spark, rows)
    monkeypatch.setattr(extract, "BROADCAST_NODES", -1)
    monkeypatch.setattr(extract, "GROUP_PAGES", 4)
    assert extracted(spark, rows) == want and want[98] == "" and want[99] == "no url"
