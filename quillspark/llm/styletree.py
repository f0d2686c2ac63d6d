"""Operator 5: main text of HTML pages by a site style tree.

The pages of a host are merged into one tree: a node is an element path (tags with their classes, no positions). Over the
m pages that have the node, an element node's presentation importance is the entropy of its pages' child sequences, and
a text node's content importance is 1 minus the mean, over its texts as often as they occur, of the text's entropy over
pages: a text on k of m pages has log k / log m. A branch's importance blends both: (1 - g^l) * presentation + g^l * mean of its text
nodes, l text nodes, g = 0.9. A branch below THRESHOLD, as all its text nodes are, seen on MIN_PAGES pages at least, is
removed from each page.
Elements that are never article text by their meaning (navigation, footers, scripts, forms, adverts, comments, by tag, role
or class) go on every page. Of a page that has article or main with text, only what is inside them is looked at. There as
elsewhere the tree decides; only where it would leave a page with no text does meaning alone.

Defined cases: null html: no text; null url or one without a host: the host is the empty string; repeated pages count as
pages and give repeated rows; pages of any length are parsed whole; empty table: empty result; other columns are not read.
Statistics are per (host, node, text) and per (host, node), summed before they are shuffled; a host's result is its list
of removed nodes. It is broadcast only if all hosts together have at most MOST_NODES of them (counted); else joined.
"""

from __future__ import annotations

import html as H
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, saved, small_batches

THRESHOLD, MIN_PAGES, GAMMA, MOST_NODES = 0.45, 8, 0.9, 20_000
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "math", "object", "canvas", "select"}
#: Without an end tag they last to the end of the page.
TO_THE_END = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
NEVER = {"nav", "footer", "header", "aside", "form", "button", "menu", "dialog", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}
NOISE = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|respond|replies|cookies?|consent|footer|header|menu|nav|navbar|navigation|newsletter|notice|notices|popup|promo|related|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|widget|toolbar|disclaimer|alert|modal|masthead|tags|pagination|pager)(?:$|[-_\s\d])", re.I)
#: A start tag of the key closes an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "details"}


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


class Block:
    __slots__ = ("main", "never", "parts", "path")

    def __init__(self, path: tuple, never: bool, main: bool):
        self.path, self.never, self.main, self.parts = path, never, main, []

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def parse(page: str | None) -> tuple[list[Block], list[tuple[tuple, tuple]]]:
    """Blocks in page order; (path, child names) of elements that hold blocks or elements.

    A path is a tuple of the names of block elements; an element's name is its tag with up to two classes.
    """
    s = page or ""
    blocks: list[Block] = []
    elements: list[tuple[tuple, list]] = []
    unclosed: set[str] = set()
    # tag, path, never, main, children, never and main of it or of an element around it
    root: list = ["", (), False, False, [], False, False]
    stack = [root]
    elements.append(((), root[4]))
    current: Block | None = None
    at = 0

    def text(x: str) -> None:
        nonlocal current
        if not x:
            return
        if current is None:
            if not x.strip():
                return
            top = stack[-1]
            current = Block(top[1], top[5], top[6])
            blocks.append(current)
        current.parts.append(H.unescape(x) if "&" in x else x)

    def close(upto: int) -> None:
        nonlocal current
        if any(e[0] not in INLINE or e[2] for e in stack[upto:]):
            current = None
        del stack[upto:]

    n = len(s)
    for m in iter(lambda: TAG.search(s, at), None):
        text(s[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                text(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "textarea", "title"):
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(s, at)
                if end:
                    at = end.end()
                elif tag in TO_THE_END:
                    at = n
                else:
                    # nothing closes it: the page goes on
                    unclosed.add(tag)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                current = None
            continue
        if tag in P_ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table"):
                    break
        attrs = {a.lower(): v.strip("\"'") for a, v in ATTR.findall(m[3])} if m[3].strip(" /") else {}
        classes = attrs.get("class", "")
        # an article's own header keeps its headline
        never = (tag in NEVER and not (tag == "header" and stack[-1][6])) or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "") or (tag not in ("html", "body", "article", "main") and bool(NOISE.search(f"{classes} {attrs.get('id', '')}")))
        main = tag in ("article", "main") or attrs.get("role") in ("main", "article")
        parent = stack[-1]
        if tag in INLINE and not never:
            stack.append([tag, parent[1], False, main, parent[4], parent[5], parent[6] or main])
            continue
        current = None
        name = ".".join([tag, *sorted(re.sub(r"\d+", "", c) for c in classes.split()[:2])])
        parent[4].append(name)
        children: list = []
        path = (*parent[1], name) if len(parent[1]) < 24 else parent[1]
        stack.append([tag, path, never, main, children, parent[5] or never, parent[6] or main])
        elements.append((path, children))
    text(s[at:])
    return blocks, [(p, tuple(dict.fromkeys(c))) for p, c in elements if c]


def _key(path: tuple) -> int:
    return xxhash.xxh64_intdigest("/".join(path)) >> 1


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x) >> 1


def tree(pages: DataFrame) -> DataFrame:
    """host, node, pages, importance, highest (of its text nodes) of each branch of each host's style tree; pages: url, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host = host_of(url)
                blocks, elements = parse(page)
                rows = {(_key(x.path), 0, _hash(x.text)) for x in blocks if x.text}
                rows |= {(_key(p), 1, _hash("|".join(c))) for p, c in elements}
                rows |= {(_key(x.path[:d]), 2, _key(x.path)) for x in blocks if x.text for d in range(len(x.path))}
                # 3: pages that have the node
                rows |= {(p, 3 + kind, 0) for p, kind, _ in rows if kind < 2}
                out += [(host, *r) for r in rows]
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["host", "node", "kind", "value"])

    counts = saved(pages.select("url", "html").mapInArrow(run, "host string, node long, kind int, value long").groupBy("host", "node", "kind", "value").agg(F.count("*").alias("k")), "style-counts")
    m = counts.where("kind >= 3").select("host", "node", (F.col("kind") - 3).alias("kind"), F.col("k").alias("m"))
    seen = counts.where("kind < 2").join(m, ["host", "node", "kind"])
    share = F.col("k") / F.col("m")
    entropy = F.when(F.col("m") > 1, F.when(F.col("kind") == 0, F.log("k") / F.log("m")).otherwise(-share * F.log(share) / F.log("m"))).otherwise(0.0)
    stat = seen.withColumn("h", entropy).groupBy("host", "node", "kind").agg(F.max("m").alias("m"), (F.sum(F.col("h") * F.col("k")) / F.sum("k")).alias("mean"), F.sum("h").alias("sum"))
    one = F.col("m") <= 1
    text = stat.where("kind = 0").select("host", "node", "m", F.when(one, 1.0).otherwise(1 - F.least(F.col("mean"), F.lit(1.0))).alias("content"))
    shape = stat.where("kind = 1").select("host", "node", F.col("m").alias("em"), F.when(one, 1.0).otherwise(F.col("sum")).alias("shape"))
    below = counts.where("kind = 2").select("host", "node", F.col("value").alias("leaf"))
    leaves = text.select("host", F.col("node").alias("leaf"), "m", "content")
    inner = below.join(leaves, ["host", "leaf"]).groupBy("host", "node").agg(F.avg("content").alias("mean"), F.max("content").alias("highest"), F.count("*").alias("l"))
    weight = F.pow(F.lit(GAMMA), F.col("l"))
    inner = inner.join(shape, ["host", "node"]).select("host", "node", F.col("em").alias("pages"), ((1 - weight) * F.col("shape") + weight * F.col("mean")).alias("importance"), "highest")
    return text.select("host", "node", F.col("m").alias("pages"), F.col("content").alias("importance"), F.col("content").alias("highest")).unionByName(inner)


def extract(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    small_batches(pages.sparkSession)
    d = pick(pages, page_id=page_col, url=url_col, html=html_col)
    noisy = tree(d).where((F.greatest("importance", "highest") < THRESHOLD) & (F.col("pages") >= MIN_PAGES))
    # one element a removed branch of the host
    noisy = saved(noisy.groupBy("host").agg(F.collect_set("node").alias("noisy")), "noisy")
    size = noisy.agg(F.coalesce(F.sum(F.size("noisy")), F.lit(0))).first()[0]
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    both = d.withColumn("host", host).join(F.broadcast(noisy) if size <= MOST_NODES else noisy, "host", "left").select("page_id", "url", "html", "noisy")

    def main_text(page: str | None, gone: set[int]) -> str:
        blocks = [(b, t) for b in parse(page)[0] if not b.never and (t := b.text)]
        # what the page itself marks as its main text
        blocks = [x for x in blocks if x[0].main] or blocks
        kept = [t for b, t in blocks if not any(_key(b.path[:k]) in gone for k in range(1, len(b.path) + 1))] if gone else []
        return " ".join(kept or [t for _, t in blocks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(page, set(gone or ())) for page, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = d.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
