"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree, and so do the runs of text that stand between them, each a leaf. Each node is
content or not: unary potentials come from its tag, class and id words, text lengths and share of link text; parent-child
potentials tie a node to its parent. Sum-product messages pass
up and then down all trees of a batch at once, level by level, and give each node's content marginal. The weights are
trained by exact gradients on labelled pages. Pages are independent rows: no shuffle.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
BLOCKS = set(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend figure figcaption blockquote pre address hr details summary dialog center menu hgroup search".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp".split())
SKIPPED = set("noscript template svg iframe select button audio video datalist noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+))>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
_MAIN = re.compile(r"\bdata-main\b")

FEATURES = 1 << 14
#: Pages whose trees pass messages together.
PAGES = 256
#: A page without likely content is read once more if its chance to hold some is this, and how much likelier it starts then.
DOUBT, ENTRY = 0.05, 30.0


@dataclass
class Page:
    """Nodes in page order (a parent comes first), their keys, and the text blocks (node, text, characters in links)."""

    parents: list[int]
    keys: list[tuple[str, str]]
    blocks: list[tuple[int, str, int]]
    marked: list[bool]


def parse(html: str) -> Page:
    """The block tree of a page; unclosed and stray tags are settled as browsers do for common markup."""
    page = Page([-1], [("root", "")], [], [False])
    stack, names = [0], ["root"]
    buffer: list[str] = []
    links = [0, 0]  # open link, link characters in the buffer
    skipping, depth, at = "", 0, 0

    def flush():
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                page.parents.append(stack[-1])
                page.keys.append(("#text", ""))
                page.marked.append(page.marked[stack[-1]])
                page.blocks.append((len(page.parents) - 1, text, min(links[1], len(text))))
            buffer.clear()
            links[1] = 0

    def pop_to(i):
        flush()
        del stack[i:], names[i:]

    while m := _TOKEN.search(html, at):  # from at, so that no token begins in raw text that was passed over
        if not skipping and m.start() > at:
            piece = html[at : m.start()]
            buffer.append(piece)
            if links[0]:
                links[1] += len(piece.strip())
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if skipping:
            if name == skipping:
                depth += -1 if closing else 1
                if not depth:
                    skipping = ""
            continue
        if not closing and name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in SKIPPED:
            if not closing and not attrs.endswith("/"):
                skipping, depth = name, 1
            continue
        if name not in BLOCKS:
            if name == "a":
                links[0] = 0 if closing else 1
            elif name == "br":
                buffer.append(" ")
            continue
        links[0] = 0
        if closing:
            for i in range(len(names) - 1, 0, -1):
                if names[i] == name:
                    pop_to(i)
                    break
            continue
        if name == "body" and "body" in names or name == "html":
            continue
        if names[-1] == "p":
            pop_to(len(names) - 1)
        if name in CLOSES:
            for i in range(len(names) - 1, 0, -1):
                if names[i] in SCOPES[name]:
                    break
                if names[i] in CLOSES[name]:
                    pop_to(i)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
        flush()
        if name in VOID:
            continue
        page.parents.append(stack[-1])
        words = " ".join(v.strip("\"'").lower() for _, v in _ATTR.findall(attrs)) if attrs else ""
        page.keys.append((name, words))
        page.marked.append(bool(attrs) and _MAIN.search(attrs) is not None)
        stack.append(len(page.parents) - 1)
        names.append(name)
    if not skipping and at < len(html):
        buffer.append(html[at:])
    flush()
    return page


@cache
def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


_keys: dict[tuple[tuple[str, str], str], tuple[int, ...]] = {}


def _key_features(key: tuple[str, str], of: str = "") -> tuple[int, ...]:
    """Features of a node's tag and of its class and id words, for itself or as those of its parent."""
    if (found := _keys.get((key, of))) is None:
        parts = {w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", key[1]) if len(w) > 1}
        found = (_feature(f"{of}t:{key[0]}"), *sorted({_feature(f"{of}c:{w[:7]}") for w in parts}))
        if len(_keys) < 50_000:
            _keys[key, of] = found
    return found


def _bins(kind: str, edges: list[float]) -> np.ndarray:
    return np.array([_feature(f"{kind}:{i}") for i in range(len(edges) + 1)])


_LENGTHS, _SHARES = [1, 10, 25, 60, 120, 300, 1000], [0.01, 0.2, 0.5, 0.9]
_OWN, _BELOW, _LINKS, _LINKS_BELOW, _STOPS = (_bins(k, e) for k, e in (("own", _LENGTHS), ("below", _LENGTHS), ("links", _SHARES), ("links below", _SHARES), ("stops", [1, 3])))


@dataclass
class Forest:
    """Trees of several pages: parent of each node, nodes by level, and (node, feature) pairs."""

    parents: np.ndarray
    levels: list[np.ndarray]
    node: np.ndarray
    feature: np.ndarray


def forest(pages: list[Page]) -> Forest:
    shift = np.cumsum([0] + [len(p.parents) for p in pages])
    n = int(shift[-1])
    parents = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + s) for p, s in zip(pages, shift)]) if pages else np.zeros(0, int)
    depth = np.zeros(n, int)
    own, link, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    node, feature = [], []
    for p, s in zip(pages, shift.tolist()):
        for i, parent in enumerate(p.parents):
            if parent >= 0:
                depth[s + i] = depth[s + parent] + 1
            f = _key_features(p.keys[i])
            if parent >= 0:
                f = f + _key_features(p.keys[parent], "parent ")
            feature.extend(f)
            node.extend([s + i] * len(f))
        for i, text, linked in p.blocks:
            own[s + i] += len(text)
            link[s + i] += linked
            stops[s + i] += text.count(".") + text.count(",")
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if n else []
    below, link_below = own.copy(), link.copy()
    for level in levels[:0:-1]:
        np.add.at(below, parents[level], below[level])
        np.add.at(link_below, parents[level], link_below[level])
    every = np.arange(n)
    wide = [
        _OWN[np.searchsorted(_LENGTHS, own, "right")], _BELOW[np.searchsorted(_LENGTHS, below, "right")],
        _LINKS[np.searchsorted(_SHARES, link / np.maximum(own, 1), "right")], _LINKS_BELOW[np.searchsorted(_SHARES, link_below / np.maximum(below, 1), "right")],
        _STOPS[np.searchsorted([1, 3], stops, "right")],
    ]
    return Forest(parents, levels, np.concatenate([np.array(node, int), *[every] * len(wide)]), np.concatenate([np.array(feature, int), *wide]))


@dataclass
class Model:
    weights: np.ndarray
    turns: np.ndarray  # parent state by child state

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent state, child state) of each node (zero for roots)."""
        n = len(f.parents)
        score = np.bincount(f.node, self.weights[f.feature], n)
        local = np.stack([np.zeros(n), score], 1)  # log potentials
        up, down = np.zeros((n, 2)), np.zeros((n, 2))
        for level in f.levels[:0:-1]:  # children to parents
            m = np.logaddexp(*(self.turns[:, s][None] + (local[level, s] + up[level, s])[:, None] for s in (0, 1)))
            m -= m.max(1, keepdims=True)
            np.add.at(up, f.parents[level], m)
        pairs = np.zeros((n, 2, 2))
        for level in f.levels[1:]:  # parents to children
            parent = f.parents[level]
            own = np.logaddexp(*(self.turns[:, s][None] + (local[level, s] + up[level, s])[:, None] for s in (0, 1)))
            own -= own.max(1, keepdims=True)
            rest = local[parent] + up[parent] + down[parent] - own
            joint = rest[:, :, None] + self.turns[None] + (local[level] + up[level])[:, None, :]
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            pairs[level] = joint / joint.sum((1, 2), keepdims=True)
            m = np.logaddexp(rest[:, 0, None] + self.turns[0], rest[:, 1, None] + self.turns[1])
            down[level] = m - m.max(1, keepdims=True)
        belief = local + up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pairs


def fit(pages: list[Page], labels: list[np.ndarray], rounds: int = 250, penalty: float = 0.005) -> Model:
    """Adaptive gradient ascent of the penalised log likelihood of labelled trees."""
    f, y = forest(pages), np.concatenate(labels).astype(float)
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)))
    child = np.flatnonzero(f.parents >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[f.parents[child]].astype(int), y[child].astype(int)), 1)
    sums = [np.full(FEATURES, 1e-6), np.full((2, 2), 1e-6)]
    for _ in range(rounds):
        p, pairs = model.marginals(f)
        steps = [np.bincount(f.feature, (y - p)[f.node], FEATURES) - penalty * model.weights, seen - pairs.sum(0) - penalty * model.turns]
        for s, g in zip(sums, steps):
            s += g * g
        model.weights += 0.3 * steps[0] / np.sqrt(sums[0])
        model.turns += 0.3 * steps[1] / np.sqrt(sums[1])
    return model


def labelled_pages(n: int = 600, seed: int = 11) -> list[str]:
    """Training pages of many layouts, drawn from a grammar; data-main marks the content nodes and is not a feature."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("ba de ki lo mu ra se ti vo ne".split()) for _ in range(r.randint(1, 4)))

    def prose(least, most):
        out = []
        for i in range(r.randint(least, most)):
            out.append(word() + ("." if r.random() < 0.1 else "," if r.random() < 0.08 else ""))
        return " ".join(out).capitalize() + "."

    def bare(least, most):
        """Words without marks, as in lists, verse or junk."""
        few = [word() for _ in range(r.choice([1, 5, 50]))]
        return " ".join(r.choice(few) for _ in range(r.randint(least, most)))

    def links(k, around="li"):
        return "".join(f'<{around}><a href="/{word()}">{prose(1, 3)}</a></{around}>' for _ in range(k))

    def named(tag, words, inside):
        kind = r.random()
        w = r.choice(words)
        attr = "" if tag != "div" and kind < 0.4 else f' class="{w}"' if kind < 0.7 else f' id="{w}"' if kind < 0.85 else f' class="{r.choice(["block", "box", "wrap", "col"])} {w}-{r.choice(["area", "box", "inner", "main"])}"'
        return f"<{tag}{attr}>{inside}</{tag}>"

    def plain(inside, mark=""):
        """A box whose name says nothing."""
        w = r.choice("col1 col2 col-md-8 left right center wrap inner box1 area holder c x1 row primary secondary view cell one two".split())
        return f'<div{mark} {r.choice(["id", "class"])}="{w}">{inside}</div>'

    def noise():
        p = lambda a, b: f"<p>{prose(a, b)}</p>"
        return r.choice([
            lambda: named("nav", ["nav", "menu", "navbar", "breadcrumb"], f"<ul>{links(r.randint(2, 9))}</ul>"),
            lambda: named("header", ["header", "masthead", "site-header", "top"], r.choice([p(1, 6), f"<h1>{prose(1, 4)}</h1>", f"<div>{prose(1, 4)}</div>"]) + r.choice(["", f"<ul>{links(3)}</ul>"])),
            lambda: named("footer", ["footer", "site-footer", "copyright", "bottom"], "&copy; " + r.choice([prose(3, 30), p(3, 20), f"<ul>{links(4)}</ul>"])),
            lambda: named("div", ["hatnote", "note", "dablink", "ambox", "metadata", "noprint", "toc", "navbox", "editnotice"], r.choice([prose(3, 20), f"<i>{prose(3, 12)}</i>", f'{prose(1, 5)} <a href="/x">{prose(1, 4)}</a>.', f"<ul>{links(4)}</ul>"])),
            lambda: plain(r.choice([f"<ul>{links(r.randint(3, 12))}</ul>", f"<h4>{prose(1, 2)}</h4>" + links(r.randint(3, 6), "p"), links(r.randint(3, 9), "div"), f"<h3>{prose(1, 3)}</h3>{prose(4, 12)}<ul>{links(3)}</ul>"])),
            lambda: named("aside", ["sidebar", "widget", "related", "aside"], f"<h3>{prose(1, 3)}</h3>" + r.choice([f"<ul>{links(5)}</ul>", p(5, 40)])),
            lambda: named("div", ["sidebar", "widget", "related", "recommended", "popular", "trending"], f"<h3>{prose(1, 3)}</h3>" + r.choice([f"<ul>{links(5)}</ul>", p(5, 40), links(4, "p")])),
            lambda: named("div", ["ad", "ads", "advert", "advertisement", "sponsor", "banner", "promo"], r.choice([prose(3, 30), p(3, 30)])),
            lambda: named("div", ["cookie", "notice", "consent", "alert", "popup", "modal", "gdpr", "disclaimer"], r.choice([prose(5, 40), p(5, 40)])),
            lambda: named("div", ["menu", "nav", "toolbar", "pagination", "share", "social", "tags", "breadcrumbs"], links(r.randint(2, 6), r.choice(["span", "div", "p"]))),
            lambda: named("form", ["search", "login", "newsletter", "subscribe", "signup", "form"], f"<label>{prose(1, 3)}</label><input name=q>" + r.choice(["", p(3, 15), f"<div>{prose(2, 8)}</div>"])),
            lambda: named(r.choice(["div", "section"]), ["comments", "comment", "responses", "replies", "disqus", "discussion", "respond"], f"<h2>{prose(1, 3)}</h2>" + "".join(r.choice([named("div", ["comment", "reply"], p(5, 60)), f"<li>{p(5, 200)}</li>", f"<article>{p(5, 90)}</article>", p(5, 400)]) for _ in range(r.randint(1, 4)))),
        ])()

    def main():
        m = " data-main"
        parts = [f"<h{k}{m}>{prose(2, 9)}</h{k}>" for k in ([1] if r.random() < 0.8 else [])]
        for _ in range(r.choice([1, 1, 2, 3, 5, 9])):
            parts.append(r.choice([
                lambda: f"<p{m}>{prose(1, 120)}</p>", lambda: f"<p{m}>{prose(30, r.choice([60, 120, 400, 1500]))}</p>", lambda: f"<p{m}>{prose(1, 4)}</p>", lambda: f'<p{m}>{prose(3, 30)} <a href="/x">{prose(1, 4)}</a> {prose(3, 30)}</p>',
                lambda: f"<h2{m}>{prose(1, 6)}</h2><p{m}>{prose(20, 80)}</p>", lambda: f"<ul{m}>" + "".join(f"<li{m}>{prose(2, 20)}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote{m}><p{m}>{prose(5, 40)}</p></blockquote>",
                lambda: f"<table{m}><tr{m}><td{m}>{prose(1, 4)}</td><td{m}>{prose(1, 4)}</td></tr></table>", lambda: f"<div{m}>{prose(20, 90)}</div>", lambda: f"<pre{m}>{prose(3, 20)}</pre>",
                lambda: f"<p{m}>{bare(8, r.choice([20, 100, 600]))}</p>", lambda: f"{prose(20, 90)}<br><br>{prose(10, 60)}", lambda: f"{prose(5, 60)} <b>{prose(1, 4)}</b> {prose(5, 60)}", lambda: f"<p{m}><b>{prose(1, 6)}</b> {prose(10, r.choice([80, 300]))}</p>",
                lambda: f"<dl{m}><dt{m}>{prose(1, 4)}</dt><dd{m}>{prose(5, 40)}</dd></dl>", lambda: f"<figure{m}><img src=x><figcaption{m}>{prose(3, 12)}</figcaption></figure>", lambda: f"<section{m}><h3{m}>{prose(1, 6)}</h3><p{m}>{prose(20, 90)}</p></section>",
                lambda: f"<p{m}>{prose(3, 20)} <code>{word()}</code> {prose(3, 20)}</p><pre{m}>{prose(3, 40)}</pre>", lambda: f"<ol{m}>" + "".join(f"<li{m}>{prose(4, 40)}</li>" for _ in range(4)) + "</ol>",
            ])())
        for chance in (0.4, 0.2):
            if r.random() < chance:
                parts.insert(r.randrange(len(parts) + 1), noise())
        inside = "".join(parts)
        return r.choice([
            lambda: f"<article{m}>{inside}</article>", lambda: f"<article{m}>{inside}</article>", lambda: f"<main><article{m}>{inside}</article></main>", lambda: f"<main{m}>{inside}</main>",
            lambda: f'<div{m} class="{r.choice(["content", "post", "entry-content", "article-body", "story", "text", "post-content", "main-content"])}">{inside}</div>',
            lambda: f'<div{m} id="{r.choice(["content", "main", "article", "body", "story"])}">{inside}</div>', lambda: f"<section{m}>{inside}</section>", lambda: f"<div{m}>{inside}</div>",
            lambda: f'<div class="container"><div{m} class="content">{inside}</div></div>', lambda: plain(inside, m), lambda: plain(inside, m), lambda: f"<table><tr><td{m}>{inside}</td></tr></table>",
            lambda: f'<div class="{r.choice(["document", "mw-body", "page"])}"><div{m} class="{r.choice(["body", "mw-parser-output", "docs-content", "markdown-body"])}"{r.choice(["", " role=main"])}>{inside}</div></div>',
        ])()

    pages = []
    for _ in range(n):
        parts = [noise() for _ in range(r.randint(0, 3))] + [main()] + [noise() for _ in range(r.randint(0, 3))]
        inside = "".join(parts)
        if r.random() < 0.3:
            inside = f'<div class="{r.choice(["wrapper", "page", "container"])}">{inside}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{prose(2, 6)}</title><style>p{{}}</style></head><body>{inside}</body></html>")
    return pages


def labels_of(page: Page) -> np.ndarray:
    return np.array(page.marked, float)


@cache
def trained() -> Model:
    pages = [parse(x) for x in labelled_pages()]
    return fit(pages, [labels_of(p) for p in pages])


def none_at_all(f: Forest, p: np.ndarray, pairs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The chance of each page to hold no content at all."""
    child = np.flatnonzero(f.parents >= 0)
    none = np.log(np.maximum(1 - p, 1e-300))  # of roots; each other node adds its chance to be none below a parent that is none
    none[child] = np.log(np.maximum(pairs[child, 0, 0], 1e-300) / np.maximum(pairs[child, 0].sum(1), 1e-300))
    return np.exp(np.minimum(np.add.reduceat(none, starts), 0))


def texts(htmls: list[str], model: Model) -> list[str]:
    """Main text of each page: content blocks in page order, joined by a line end.

    A page without a node that is likely content, but with a chance of DOUBT to hold some, is read once more by a model
    to which content below other nodes is ENTRY more likely.
    """
    pages = [parse(x) for x in htmls]
    if not pages:
        return []
    f, sizes = forest(pages), np.array([len(x.parents) for x in pages])
    starts = np.cumsum(sizes) - sizes
    p, pairs = model.marginals(f)
    open_ = (np.maximum.reduceat(p, starts) < 0.5) & (none_at_all(f, p, pairs, starts) <= 1 - DOUBT)
    if open_.any():
        again = Model(model.weights, model.turns + np.array([[0, np.log(ENTRY)], [0, 0]]))
        p = np.where(np.repeat(open_, sizes), again.marginals(f)[0], p)
    out = []
    for page, at in zip(pages, starts.tolist()):
        out.append("\n".join(text for node, text, _ in page.blocks if p[at + node] >= 0.5))
    return out


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every row; null html counts as empty; repeated rows stay.

    model: by default the one trained on labelled_pages().
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())  # bounded by FEATURES

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PAGES):
                part = batch.slice(a, PAGES)
                found = texts([x or "" for x in part.column(2).to_pylist()], sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(pull, "page_id long, url string, text string, n_chars long")
