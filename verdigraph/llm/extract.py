"""Main text of web pages with the help of a site style tree.

The whole DOMs of a host are merged: elements with the same path of presentation (tag, class, role) are one style
node, and a node's distinct child sequences are its styles. A node's presentation importance is the entropy of its
styles over the host's pages, its content importance is one minus the mean entropy of its text segments over these
pages, and the composite importance passes from the leaves up, one aggregation for each depth of the tree. Branches of
low importance are removed from each page.

What elements call themselves (nav, footer, advert classes) is one more feature of a node: evidence that lowers its
importance, as reader comments and adverts may differ from page to page as much as articles do. It does not count
where a named branch holds a page's only article or main or, without one and if but a class or id names it, most of its text. A node is believed by the
number of pages it was met on; with few of them it falls back on that evidence. Where all of a host's pages read
alike, nothing can be told from their likeness, and only the evidence counts.

Segments, and not words, are the features of content: with words, any text in a common vocabulary would look like noise.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm import common

#: A branch goes if its importance is below THRESHOLD.
THRESHOLD = 0.2
#: What a node's own name leaves of its importance, and how many pages weigh as much as the belief that a nameless node matters.
NAMED_PART, BELIEF = 0.15, 0.5
_GAMMA = 0.9
#: Elements that lie deeper belong to their ancestor at this depth (named ones keep the verdict of their name).
MOST_DEPTH = 64
#: Up to so many verdicts are broadcast; beyond, pages meet their host's verdicts in groups of about GROUP_PAGES.
BROADCAST_NODES = 1_000_000
GROUP_PAGES = 2000

# HTML's void, block and unrendered elements, and the names by which pages mark what is no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas audio video map math datalist".split())
PARTS = frozenset("nav header footer aside form button select textarea fieldset dialog menu".split())
#: Parts whose tag says what they are, however much text they hold.
NEVER_WIDE = PARTS - {"form", "header"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "comment comments disqus replies respond sidebar aside widget nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related recommended recommendations pagination pager search".split()
)
#: What an element of this name closes when it is opened inside.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = BLOCK - {"body", "html", "caption", "legend", "option", "optgroup"}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NUMBER = re.compile(r"\d{3,}")  # counts pages and not columns
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page(HTMLParser):
    """Elements of a page and its text chunks. Per element: style node, parent, whether it names itself as no main text,
    child sequence; elements come after their parents, so passes over them need no recursion."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes, self.parents, self.depths = [0], [0], [0]
        self.named, self.main, self.children = [False], [False], [[]]
        self.wide: set[int] = set()  # elements that may hold a whole page whatever their name is
        self.virtual: dict[int, int] = {}
        self.blocks: list[list[tuple[int, str]]] = []
        self.buffer: list[tuple[int, str]] = []
        # tag, element (-1: not rendered), inside a main element, inside its header, under a heading there
        self.stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        self.open: Counter = Counter()
        self.feed(html)
        self.close()
        self._flush()
        self._settle()

    def parse_marked_section(self, i: int, report: int = 1) -> int:  # of any name: a comment, as browsers read it
        return self.parse_bogus_comment(i)

    def _element(self, parent: int, signature: str, named: bool, main: bool = False) -> int:
        self.nodes.append(xxhash.xxh64_intdigest(signature, self.nodes[parent]) >> 1)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.named.append(named)
        self.main.append(main)
        self.children.append([])
        self.children[parent].append(signature)
        return len(self.nodes) - 1

    def _flush(self) -> None:
        if self.buffer:
            self.blocks.append(self.buffer)
            self.buffer = []

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.open[tag] -= 1
            if tag in BLOCK:
                self._flush()

    def _close(self, names: set, until: set) -> None:
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in until:
                return
            if self.stack[i][0] in names:
                self._pop(i)
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._close({"p"}, {"button", "table", "td", "th", "caption", "object"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in BLOCK:
            self._flush()
        _, at, main, header, heading = self.stack[-1]
        if tag == "br" and at >= 0:
            self.buffer.append((at, "\n"))
        if tag in VOID:
            return
        found = dict(attrs) if attrs else {}
        if at < 0 or tag in UNSEEN or "hidden" in found or _HIDDEN.search(found.get("style") or ""):
            at = -1
        elif found or tag in BLOCK:
            names, role = f"{found.get('class') or ''} {found.get('id') or ''}", (found.get("role") or "").lower()
            noisy = {w.lower() for w in _NAME.findall(names)} & NOISE if found else ()
            is_main = role in ("article", "main") or (tag in ("article", "main") and role not in ROLES)
            own_header = main and (tag == "header" or noisy == {"header"})  # it keeps its headings
            named = not own_header and not is_main and tag not in ("html", "body") and bool(tag in PARTS or noisy or role in ROLES)
            if header and not heading and tag in BLOCK and tag not in HEADINGS and tag not in ("div", "hgroup", "section", "header"):
                named = True
            if named or is_main or found.get("class") or role or tag in BLOCK:
                signature = f"{tag}.{_NUMBER.sub('0', found.get('class') or '')}.{role}"
                if named or is_main or self.depths[at] < MOST_DEPTH:
                    at = self._element(at, signature, named, is_main)
                    if named and tag not in NEVER_WIDE and role not in ROLES:
                        self.wide.add(at)
            main, header = main or is_main, header or own_header
            heading = heading or (header and tag in HEADINGS)
        self.stack.append((tag, at, main, header, heading))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] == tag:
                    self._pop(i)
                    return

    def handle_data(self, data: str) -> None:
        _, at, _, header, heading = self.stack[-1]
        if at < 0:
            return
        if header and not heading and data.strip():  # a header's own words
            if at not in self.virtual:
                self.virtual[at] = self._element(at, "#text!", True)
            at = self.virtual[at]
        if self.buffer and self.buffer[-1][0] == at:
            self.buffer[-1] = (at, self.buffer[-1][1] + data)
        else:
            self.buffer.append((at, data))

    def _settle(self) -> None:
        """Text sizes of branches, and which named branches the page needs: without another article or main, those
        that hold one, or, if only a class or id names them, most of the text."""
        n = len(self.nodes)
        self.sizes = [0] * n
        for block in self.blocks:
            for i, data in block:
                self.sizes[i] += len("".join(data.split()))
        holds, inside = list(self.main), list(self.named)
        for i in range(1, n):
            inside[i] = inside[i] or inside[self.parents[i]]
        for i in range(n - 1, 0, -1):
            self.sizes[self.parents[i]] += self.sizes[i]
            holds[self.parents[i]] = holds[self.parents[i]] or holds[i]
        if not any(m and not x for m, x in zip(self.main, inside, strict=True)):
            self.named = [x and not holds[i] and not (i in self.wide and 2 * self.sizes[i] > self.sizes[0]) for i, x in enumerate(self.named)]

    def text(self, removed: frozenset | set = frozenset(), kept: frozenset | set = frozenset()) -> str:
        """The text without the removed style nodes; nodes that no set holds go if they name themselves. If nothing would
        be left, names alone decide."""
        for known in (True, False):
            dead = [False] * len(self.nodes)
            for i, (node, parent, named) in enumerate(zip(self.nodes, self.parents, self.named, strict=True)):
                dead[i] = dead[parent] or (named and node not in kept) or (known and i > 0 and node in removed)
            out = (" ".join("".join(data for i, data in block if not dead[i]).split()) for block in self.blocks)
            text = "\n\n".join(t for t in out if t)
            if text or not removed:
                return text
        return text


def host():
    """The host of `url`, lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def page_statistics(page: Page) -> tuple[dict[int, tuple], Counter]:
    """Per style node of a page (parent, depth, style, share of the text, 1 if it names itself), and how often each
    (node, segment) stands there. A node that is met several times on a page counts once."""
    total, last = page.sizes[0] or 1, [0] * len(page.nodes)
    found: dict[int, tuple] = {}
    for i, (node, parent) in enumerate(zip(page.nodes, page.parents, strict=True)):
        if page.depths[i] > MOST_DEPTH:
            last[i] = last[parent]
            continue
        last[i] = i
        style = xxhash.xxh64_intdigest(" ".join(page.children[i])) >> 1
        old = found.get(node, (0, 0, style, 0.0, 0))
        found[node] = (page.nodes[parent], page.depths[i], min(old[2], style), old[3] + page.sizes[i] / total, max(old[4], int(page.named[i])))
    segments: Counter = Counter()
    for block in page.blocks:
        for i, data in block:
            if (words := " ".join(data.split())):
                segments[page.nodes[last[i]], xxhash.xxh64_intdigest(words) >> 1] += 1
    return found, segments


def _statistics(batches):
    """Hashed rows of `page_statistics`: a row per (page, node) with a parent, a row per (page, node, segment) without."""
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for h, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            nodes, segments = page_statistics(Page(html or ""))
            for node, (parent, depth, style, share, named) in nodes.items():
                for column, value in zip(out, (h, node, parent, depth, style, 1, share, named), strict=True):
                    column.append(value)
            for (node, segment), times in segments.items():
                for column, value in zip(out, (h, node, None, None, segment, times, 0.0, 0), strict=True):
                    column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        names = ["host", "node", "parent", "depth", "feature", "times", "share", "named"]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, parent, depth, pages, content, importance, score, share, named) of every style node of every host.

    importance is the composite one; score is what it leaves after the evidence of names and the number of pages.
    Segments meet in two aggregations with map-side combining, so no task holds the text of a host or of a node.
    """
    rows = pages.select(host().alias("host"), "html").where("html is not null").mapInArrow(_statistics, "host string, node long, parent long, depth int, feature long, times long, share double, named long")
    is_style = F.col("depth").isNotNull()
    sums = [F.sum("times").alias("c"), F.sum(F.col("times") * F.log("times")).alias("l"), F.sum("share").alias("share"), F.sum("named").alias("named"), F.max("parent").alias("parent")]
    per = rows.groupBy("host", "node", "depth", "feature").agg(*sums)
    of = lambda own, value: F.sum(F.when(own, value))
    nodes = per.groupBy("host", "node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), of(is_style, F.col("c")).alias("pages"), F.count(F.when(is_style, 1)).alias("styles"), of(is_style, F.col("c") * F.log("c")).alias("l"),
        F.sum("share").alias("share"), F.sum("named").alias("named"), F.sum(F.when(~is_style, F.log("c") - F.col("l") / F.col("c"))).alias("h"), F.count(F.when(~is_style, 1)).alias("segments"),
    )
    several, whole = F.col("pages") > 1, F.log("pages")
    nodes = nodes.select(
        "host", "node", "parent", "depth", "pages", "styles", F.when(several, (whole - F.col("l") / F.col("pages")) / whole).otherwise(1.0).alias("presentation"),
        F.when(F.col("segments") > 0, F.when(several, 1 - F.col("h") / F.col("segments") / whole).otherwise(1.0)).alias("content"), (F.col("share") / F.col("pages")).alias("share"), (F.col("named") / F.col("pages")).alias("named"),
    )
    return composite(common.staged(nodes, "style-nodes"))


def composite(nodes: DataFrame) -> DataFrame:
    """nodes (host, node, parent, depth, pages, styles, presentation, content, share, named) with importance and score.

    A node's composite importance is (1 - g**styles) of its presentation and g**styles of what is below: the mean of
    its children and of its own content, weighted by pages. A single style tells nothing, so wrappers pass on what is
    below them, however many there are. Each round handles one depth; there are MOST_DEPTH at most.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    done, below = [], None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        own = F.when(F.col("content").isNotNull(), F.col("pages")).otherwise(0)
        if below is None:
            level = level.withColumn("w", F.lit(0.0)).withColumn("x", F.lit(0.0))
        else:
            level = level.join(below, ["host", "node"], "left")
        weight = F.coalesce("w", F.lit(0.0)) + own
        inner = F.when(weight > 0, (F.coalesce("x", F.lit(0.0)) + own * F.coalesce("content", F.lit(0.0))) / weight).otherwise(1.0)
        decay = F.when(F.col("styles") > 1, F.pow(F.lit(_GAMMA), F.col("styles"))).otherwise(1.0)
        importance = (1 - decay) * F.col("presentation") + decay * inner
        level = level.select("host", "node", "parent", "depth", "pages", "content", "share", "named", importance.alias("importance"))
        level = common.staged(level, "style-tree")
        done.append(level)
        below = level.where("node <> parent").groupBy("host", F.col("parent").alias("node")).agg(F.sum("pages").cast("double").alias("w"), F.sum(F.col("pages") * F.col("importance")).alias("x"))
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    known = F.col("pages") / (F.col("pages") + BELIEF)
    score = (known * F.col("importance") + 1 - known) * (1 - (1 - NAMED_PART) * F.col("named"))
    return out.withColumn("score", score)


def verdicts(pages: DataFrame) -> DataFrame:
    """(host, removed array<long>, kept array<long>): per host the style nodes of several pages that are of low importance,
    and those that stay although they name themselves on some page."""
    tree = common.staged(style_tree(pages), "scored-tree")
    # pages that are all alike tell nothing: there, only nodes that name themselves go
    texts = tree.where("content is not null").groupBy("host").agg((F.sum(F.col("content") * F.col("pages")) / F.sum("pages")).alias("content"))
    alike = texts.where(F.col("content") < THRESHOLD).select("host", F.lit(True).alias("alike"))
    judged = tree.where((F.col("pages") > 1) & (F.col("node") != 0) & ((F.col("score") < THRESHOLD) | (F.col("named") > 0))).join(alike, "host", "left")
    gone = (F.col("score") < THRESHOLD) & ((F.col("named") >= 0.5) | F.col("alike").isNull())
    found = judged.groupBy("host").agg(F.collect_list(F.when(gone, F.col("node"))).alias("removed"), F.collect_list(F.when(~gone & (F.col("named") > 0), F.col("node"))).alias("kept"))
    return found.where("size(removed) + size(kept) > 0")


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    A null html gives an empty text; a null url has the empty host; repeated rows count as pages of their host and
    give a row each; other columns are not looked at.
    """
    found = common.staged(verdicts(pages), "site-verdicts")
    own = pages.select("page_id", "url", "html", host().alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"
    if (found.agg(F.sum(F.size("removed") + F.size("kept") + 8)).first()[0] or 0) <= BROADCAST_NODES:
        known = {r["host"]: (frozenset(r["removed"]), frozenset(r["kept"])) for r in found.collect()}
        sent = pages.sparkSession.sparkContext.broadcast(known)

        def run(batches):
            for batch in batches:
                yield _texts(batch, [sent.value.get(h, _NONE) for h in batch.column("host").to_pylist()])

        return own.mapInArrow(run, schema)
    # a host's pages are dealt to as many groups as they need, each with the host's verdicts
    counts = own.groupBy("host").agg(F.ceil(F.count("*") / GROUP_PAGES).cast("int").alias("groups"))
    part = F.pmod(F.xxhash64("page_id", "url"), F.col("groups")).cast("int")
    dealt = own.join(counts, "host").select("page_id", "url", "html", "host", part.alias("part"))
    rows = found.join(counts, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "removed", "kept")

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = _NONE if not right.num_rows else tuple(frozenset(right.column(c)[0].as_py()) for c in ("removed", "kept"))
        return pa.Table.from_batches([_texts(b, [sets] * b.num_rows) for b in left.combine_chunks().to_batches()], _text_schema(left.schema))

    return dealt.groupBy("host", "part").cogroup(rows.groupBy("host", "part")).applyInArrow(judged, schema)


_NONE: tuple[frozenset, frozenset] = (frozenset(), frozenset())


def _text_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([schema.field("page_id"), schema.field("url"), pa.field("text", pa.string()), pa.field("n_chars", pa.int64())])


def _texts(batch: pa.RecordBatch, sets: list) -> pa.RecordBatch:
    """(page_id, url, text, n_chars) of pages, each with its (removed, kept) style nodes."""
    texts = [Page(html).text(*x) if html else "" for html, x in zip(batch.column("html").to_pylist(), sets, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_text_schema(batch.schema))
