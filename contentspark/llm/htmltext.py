"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is content or not. Its own potential comes from its tag, class and id words, links and text; a parent
and a child share a pairwise potential, with one table for children marked as furniture, one for other children with
text of their own and one for the rest. Sum-product
messages go up and down the tree; elements whose marginal favours content give their text. Both potentials are
estimated from labelled pages: by default a sample of the pages that mark their article themselves.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages the potentials are estimated from, chosen by hash of the id.
SAMPLE_PAGES = 2000

# Fixed values of HTML and of its customs.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math canvas object audio video select button title head".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
                    "pre section summary table tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCKS - frozenset("body html caption legend option optgroup summary tbody td tfoot th thead tr".split())
FURNITURE = frozenset("nav footer aside form menu dialog header".split())
ARTICLE = frozenset(("article", "main"))
FURNITURE_WORDS = frozenset(("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
                             "cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation "
                             "newsletter notice outbrain pagination popup promo promoted recommended related reply replies respond search share sharing "
                             "shoutbox sidebar signup skip social sponsor sponsored subscribe taboola teaser toolbar widget").split())
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
         "option": ("option",), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
_STOP = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
         "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")

FEATURES = ("furniture tag|article tag|furniture word|content word|heading|paragraph|list|link|hidden|"
            "own text|long text|linked text|few words|sentence end|body or html|inside furniture").split("|")


class Node:
    __slots__ = ("tag", "parent", "bits", "own", "linked", "label", "raw")

    def __init__(self, tag: str, parent: int, bits: int, raw: bool):
        self.tag, self.parent, self.bits, self.raw = tag, parent, bits, raw
        self.own = self.linked = 0
        self.label = -1


def _bits(tag: str, attributes: str) -> int:
    bits = 0
    if tag in FURNITURE:
        bits |= 1
    if tag in ARTICLE:
        bits |= 2
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                bits |= 1 << 8
            words = set(_WORDS.findall(value))
            if words & FURNITURE_WORDS or value in ("contentinfo", "complementary", "alert", "alertdialog"):
                bits |= 1 << 2
            elif words & CONTENT_WORDS:
                bits |= 1 << 3
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        bits |= 1 << 4
    elif tag in ("p", "blockquote", "pre", "figcaption"):
        bits |= 1 << 5
    elif tag in ("ul", "ol", "li", "dl", "dt", "dd", "menu"):
        bits |= 1 << 6
    elif tag == "a":
        bits |= 1 << 7
    elif tag in ("body", "html"):
        bits |= 1 << 14
    return bits


def parse(page: str) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """(nodes, pieces) of a page. Node 0 is the page itself; a piece is (node, block number, text with references decoded).

    Start tags close what HTML says they close, end tags close up to their start tag, and an end tag without one is
    left out. Comments, and the inside of scripts, styles and other elements that show no prose, give no pieces.
    """
    nodes = [Node("", -1, 0, False)]
    pieces: list[tuple[int, int, str]] = []
    open_, block, at, lower = [0], 0, 0, None

    def text(upto: int) -> None:
        node = nodes[open_[-1]]
        if upto > at and not node.raw:
            said = page[at:upto]
            pieces.append((open_[-1], block, entities.unescape(said) if "&" in said else said))

    def close_to(depth: int) -> None:
        del open_[depth:]

    m = _TOKEN.search(page)
    while m:
        text(m.start())
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                for depth in range(len(open_) - 1, 0, -1):
                    if nodes[open_[depth]].tag == tag:
                        close_to(depth)
                        break
                    if tag not in BLOCKS and nodes[open_[depth]].tag in BLOCKS:
                        break
                block += tag in BLOCKS
            else:
                if tag in CLOSES_P:
                    for depth in range(len(open_) - 1, 0, -1):
                        if nodes[open_[depth]].tag == "p":
                            close_to(depth)
                            break
                        if nodes[open_[depth]].tag in BLOCKS:
                            break
                if tag in _SAME:
                    for depth in range(len(open_) - 1, 0, -1):
                        if nodes[open_[depth]].tag in _STOP[tag]:
                            break
                        if nodes[open_[depth]].tag in _SAME[tag] and (tag != "tr" or nodes[open_[depth]].tag == "tr"):
                            close_to(depth)
                            break
                elif tag == "body":
                    for depth in range(len(open_) - 1, 0, -1):
                        if nodes[open_[depth]].tag == "head":
                            close_to(depth)
                            break
                block += tag in BLOCKS
                if tag == "br" or tag in VOID:
                    pieces.append((open_[-1], block, " "))
                else:
                    parent = open_[-1]
                    inside = (1 << 15) * bool(nodes[parent].bits & 0b1000000100000101)
                    nodes.append(Node(tag, parent, _bits(tag, m[3]) | inside, nodes[parent].raw or tag in RAW))
                    if not m[3].endswith("/") or tag in BLOCKS or tag in RAW:
                        open_.append(len(nodes) - 1)
                    if tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template"):
                        # The text runs up to the end tag, whatever it looks like.
                        if lower is None:
                            lower = page.lower()
                        end = lower.find(f"</{tag}", at)
                        if end < 0 and tag in ("noscript", "template"):
                            end = at
                        at = len(page) if end < 0 else end
        m = _TOKEN.search(page, at)
    text(len(page))
    return nodes, pieces


def describe(nodes: list[Node], pieces: list[tuple[int, int, str]]) -> None:
    """Adds the text features: an element's own text includes that of inline elements below it."""
    ends = {}
    for at, _, said in pieces:
        size = len(said.split())
        if not size:
            continue
        linked = False
        while at > 0 and nodes[at].tag not in BLOCKS:
            linked |= nodes[at].tag == "a"
            nodes[at].own += size
            at = nodes[at].parent
        nodes[at].own += size
        nodes[at].linked += size if linked else 0
        ends[at] = said.rstrip()[-1:]
    for i, node in enumerate(nodes):
        if node.own:
            node.bits |= (1 << 9) | (node.own >= 25) << 10 | (2 * node.linked > node.own) << 11 | (node.own < 4) << 12
            if ends.get(i, "") in ".!?…":
                node.bits |= 1 << 13


def self_labels(nodes: list[Node]) -> bool:
    """Labels from the page's own marks: inside an article or main element and not inside furniture. False if it marks none."""
    marked = False
    for node in nodes[1:]:
        up = nodes[node.parent]
        if node.raw or node.bits & 0b100000101:
            node.label = 0
        elif node.bits & 2:
            node.label, marked = 1, True
        else:
            node.label = max(0, up.label) if node.parent else 0
            if up.bits & 0b100000101 or up.raw:
                node.label = 0
        if node.label == 1 and node.parent and up.label == 0 and not node.bits & 2:
            node.label = 0
    return marked


def kind_of(node: Node) -> int:
    """Which pairwise table holds between an element and its parent."""
    return 2 if node.bits & 0b100000101 else 1 if node.own else 0


def estimate(counts: dict, pairs: dict) -> dict:
    """Potentials from {(bits, label): number} and {(parent label, label, kind): number}."""
    keys = list(counts) or [(0, 0)]
    counts = counts or {(0, 0): 0}
    x = np.asarray([[bits >> k & 1 for k in range(len(FEATURES))] + [1] for bits, _ in keys], float)
    y = np.asarray([label for _, label in keys], float)
    n = np.asarray([counts[k] for k in keys], float)
    # What custom says, as prior means; data move them.
    prior = np.asarray([-4, 3, -4, 1, 0.5, 1, 0, -0.5, -4, 0.5, 1, -2, -0.3, 0.7, -0.5, -4, -0.5], float)
    w = prior.copy()
    n = n / max(1.0, n.sum() / 2000.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - 2.0 * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 2.0 * np.eye(len(w)), gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    table = {}
    for kind in (0, 1, 2):
        for up in (0, 1):
            seen = [pairs.get((up, label, kind), 0) for label in (0, 1)]
            # Imagined pairs: a child goes with its parent, one marked as furniture is none of the content, both at
            # 19 to 1; and no table becomes surer than 99 to 1, since other sites are built otherwise.
            c = [seen[label] + 0.01 * sum(seen) + (19 if label == (0 if kind == 2 else up) else 1) for label in (0, 1)]
            table[up, kind] = [c[0] / sum(c), c[1] / sum(c)]
    return {"w": w.tolist(), "pair": table}


def marginals(nodes: list[Node], model: dict) -> list[float]:
    """Probability of content of every node, by one pass up and one pass down the tree (parents come before children)."""
    n, w, pair, known = len(nodes), model["w"], model["pair"], {}
    own = [(0.5, 0.5)] * n
    for i in range(1, n):
        node = nodes[i]
        if node.raw:
            own[i] = (1.0, 1e-9)
            continue
        p = known.get(node.bits)
        if p is None:
            z = w[-1] + sum(w[k] for k in range(len(FEATURES)) if node.bits >> k & 1)
            p = known[node.bits] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        own[i] = (1 - p, p)
    up0, up1 = [a for a, _ in own], [b for _, b in own]
    sent = [(1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        s = up0[i] + up1[i]
        a, b = up0[i] / s, up1[i] / s
        if nodes[i].raw:
            continue
        kind = kind_of(nodes[i])
        m0 = pair[0, kind][0] * a + pair[0, kind][1] * b
        m1 = pair[1, kind][0] * a + pair[1, kind][1] * b
        sent[i] = (m0, m1)
        parent = nodes[i].parent
        up0[parent] *= m0
        up1[parent] *= m1
        if up0[parent] + up1[parent] < 1e-100:
            up0[parent] *= 1e100
            up1[parent] *= 1e100
        up0[i], up1[i] = a, b
    out = [0.0] * n
    for i in range(n):
        if i:
            # What the parent believes without this child's own message, passed down through the pair's potential.
            q, kind = nodes[i].parent, kind_of(nodes[i])
            e0, e1 = up0[q] / max(sent[i][0], 1e-300), up1[q] / max(sent[i][1], 1e-300)
            d0 = e0 * pair[0, kind][0] + e1 * pair[1, kind][0]
            d1 = e0 * pair[0, kind][1] + e1 * pair[1, kind][1]
        else:
            d0, d1 = 1.0, 1e-3  # a page as a whole is not content
        b0, b1 = up0[i] * d0, up1[i] * d1
        s = b0 + b1
        up0[i], up1[i] = (b0 / s, b1 / s) if s else (1.0, 0.0)
        out[i] = up1[i]
    return out


def page_text(page: str | None, model: dict) -> str:
    """Main text of one page: blocks of content elements in page order, white space inside a block made one space."""
    if not page:
        return ""
    nodes, pieces = parse(page)
    describe(nodes, pieces)
    chance = marginals(nodes, model)
    blocks, current, said = [], None, []
    for at, block, text in pieces:
        if block != current:
            line = " ".join("".join(said).split())
            if line:
                blocks.append(line)
            current, said = block, []
        while at > 0 and nodes[at].tag not in BLOCKS and not nodes[at].bits & 0b100000100:
            at = nodes[at].parent
        if at > 0 and chance[at] >= 0.5:
            said.append(text)
    line = " ".join("".join(said).split())
    if line:
        blocks.append(line)
    return "\n".join(blocks)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict:
    """Potentials from at most so many pages (page_id, html) that mark their article; counts are summed by Spark."""
    ids = pages.where("page_id is not null and html is not null").select("page_id").distinct().orderBy(
        F.xxhash64("page_id", F.lit(31)), "page_id").limit(sample_pages)
    sample = pages.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).select("html")

    def counted(batches):
        for batch in batches:
            found: dict[tuple, int] = {}
            for page in batch.column(0).to_pylist():
                nodes, pieces = parse(page)
                describe(nodes, pieces)
                if not self_labels(nodes):
                    continue
                for node in nodes[1:]:
                    if node.raw:
                        continue
                    for key in ((0, node.bits, node.label), (1, max(0, nodes[node.parent].label) * 3 + kind_of(node), node.label)):
                        found[key] = found.get(key, 0) + 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[j] for k in keys], pa.int32()) for j in range(3)] + [pa.array([found[k] for k in keys], pa.int64())],
                names=["kind", "bits", "label", "n"])

    rows = sample.mapInArrow(counted, "kind int, bits int, label int, n long").groupBy("kind", "bits", "label").agg(
        F.sum("n").alias("n")).collect()  # at most 2^16 patterns and twelve pairs
    return estimate({(r["bits"], r["label"]): r["n"] for r in rows if r["kind"] == 0},
                    {(r["bits"] // 3, r["label"], r["bits"] % 3): r["n"] for r in rows if r["kind"] == 1})


def extract_text(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """The rows of pages (page_id, url, html, ...) with `text`, the main text, in place of html.

    Null and empty html and pages without content give the empty string. Without a model the potentials are
    estimated from the pages themselves, or are those of custom where no page marks its article. Repeated rows are
    extracted each; a column named text is replaced.
    """
    pages = pages.drop("text")
    model = model or train(pages.select("page_id", "html"))
    kept = [c for c in pages.columns if c != "html"]

    def extracted(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [page_text(h.as_py(), model) for h in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "text"])

    return pages.select(*kept, "html").mapInArrow(extracted, pages.select(*kept).schema.add("text", "string"))
