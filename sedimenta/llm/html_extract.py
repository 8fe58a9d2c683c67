"""Main text of web pages: boosted trees over DOM nodes, then hierarchical decoding.

A page becomes a tree of its block elements. Trees score each one that has text
of its own from text and tag density of its subtree, links, depth, siblings,
its place to the page's densest container, the elements it is in, and what was
learned of attribute tokens: how often text under a token is content in the
pages fitted on, tokens that were not met there counting as unknown. Decoding
then picks the likeliest labelling of the whole tree in which every path from
the root goes outside -> content -> cut and never back, so a page cannot have
boilerplate that holds content that holds boilerplate that holds content.

The trees are fitted here: on weak labels of a bounded sample of pages
(``MAX_TRAIN_PAGES``) that mark their article with elements of HTML, and on
pages laid out by ``layout`` below, half of them with marks that tell nothing.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .staging import bounded_batches, hash_sample

#: Pages of the corpus that are fitted on at most, and pages laid out for fitting.
MAX_TRAIN_PAGES, LAYOUTS = 300, 500

#: Element names of HTML and MathML by how they take part in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover object q s samp semantics small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("annotation audio canvas iframe noscript script select style svg template textarea title video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul li dd dt tr td th tbody thead".split())
SELF_CLOSING = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "td", "th", "dd", "dt", "blockquote", "pre", "figcaption", "section", "article", "main", "body", "button", "summary", "details", "caption")
#: Ancestors that a node is asked about.
HOLDERS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "table", "ul", "ol", "dialog", "figure", "menu", "fieldset", "address")

#: An attribute with its value, or what parts attributes.
_ATTR = r"(?:[^\s>=/][^\s>=/]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+|[\s/=]++)"
_TOKEN = re.compile(rf"<!--(?:.*?)(?:-->|\Z)|<!\[CDATA\[(?:.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:{_ATTR})*+)(?:>|\Z)", re.S)
_ATTRS = re.compile(r"(?:^|(?<=[\s\"'/]))(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>\"'][^\s>]*))", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "row", "depth", "names", "mask", "holder", "own", "own_links", "text", "links", "tags", "kids", "at", "marks")

    def __init__(self, tag: str, parent: "Node | None", attrs: str, row: int):
        self.tag, self.parent, self.row = tag, parent, row
        self.depth = parent.depth + 1 if parent else 0
        self.names = tuple({w.lower() for m in _ATTRS.finditer(attrs) for v in m.groups()[1:] if v for w in _WORDS.findall(_HUMPS.sub(" ", v))}) if "=" in attrs else ()
        self.mask, self.holder = (parent.mask, parent.holder) if parent else (0, -1)
        if tag in HOLDERS:
            self.holder = HOLDERS.index(tag)
            self.mask |= 1 << self.holder
        self.own = self.own_links = self.text = self.links = self.tags = self.kids = self.marks = 0
        self.at = parent.kids if parent else 0
        if parent:
            parent.kids += 1

    @property
    def holders(self) -> set[str]:
        """Of which of ``HOLDERS`` the node is part."""
        return {h for k, h in enumerate(HOLDERS) if self.mask >> k & 1}


class Stack:
    """Open elements, with the places of each tag, so that closing looks at none but what it closes."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def cut(self, to: int) -> None:
        while len(self.nodes) > to:
            self.places[self.nodes.pop().tag].pop()


def parse(source: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block elements in document order, and the page's text blocks with the element each is in.

    Broken and cut-off markup is read as browsers would: missing end tags are
    implied, stray ones ignored, an unfinished tag at the end is markup. What
    is inline, scripts and form fields included, parts no block. The time
    taken is linear, however deep elements lie.
    """
    root = Node("body", None, "", 0)
    nodes, blocks, stack = [root], [], Stack(root)
    parts: list[str] = []
    in_link = link_chars = 0

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                node = stack.nodes[-1]
                node.own += len(text)
                node.own_links += min(link_chars, len(text))
                node.marks += sum(map(text.count, ".,;:!?"))
                blocks.append((node, text))
        parts, link_chars = [], 0

    def close(names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        k = stack.last(names)
        if k and k >= stack.last(within):
            flush()
            stack.cut(k)

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        stop = m.start() if m else end
        if stop > at:
            piece = source[at:stop]
            parts.append(piece)
            if in_link:
                link_chars += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag not in INLINE and tag not in VOID and tag not in RAW:
                flush()
                close((tag,))
            continue
        stack.nodes[-1].tags += 1
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            elif tag == "br" or tag == "img":
                parts.append(" ")
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|</{re.escape(tag)}\Z", re.I).search(source, at)
                at = over.end() if over else end
            continue
        if tag in VOID and tag != "hr":
            continue
        flush()
        if tag in ("html", "head", "body"):
            continue
        if tag in CLOSES_P:
            close(("p",), ("td", "th", "button", "object"))
        if tag == "hr":
            continue
        in_link = 0
        if tag in SELF_CLOSING:
            own, within = SELF_CLOSING[tag]
            close(tuple(own.split()), within)
        node = Node(tag, stack.nodes[-1], m[3], len(nodes))
        nodes.append(node)
        stack.push(node)
    flush()
    for node in reversed(nodes):
        node.text += node.own
        node.links += node.own_links
        node.tags += 1
        if node.parent:
            node.parent.text += node.text
            node.parent.links += node.links
            node.parent.tags += node.tags
    return nodes, blocks


N_PLAIN = 36
WIDTH = N_PLAIN + len(TAGS) + 2 * len(HOLDERS)
_TAG_AT = {t: k for k, t in enumerate(TAGS)}


def features(nodes: list[Node], scores: dict[str, float]) -> np.ndarray:
    """One row per node; ``scores`` of attribute tokens are log odds of content."""
    n = len(nodes)
    total = max(1, nodes[0].text)
    alike: dict[tuple[int, str], int] = defaultdict(int)
    weight = [0.0] * n  # text that a container holds in blocks of its own
    for x in nodes:
        up = x.parent.row if x.parent else 0
        alike[up, x.tag] += 1
        weight[up] += x.own
        weight[x.row] += x.own
    best = max(range(n), key=lambda i: (weight[i], -i))
    heavy = max(1.0, weight[best])
    inside, low, high, near, mark = [False] * n, [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    far, shared = [0] * n, [False] * n  # whether a node holds the best container, and how far below such a one it is
    x = nodes[best]
    while x:
        shared[x.row] = True
        x = x.parent
    plain, at, where = np.zeros((n, N_PLAIN), np.float32), [], []
    for i, x in enumerate(nodes):
        up = x.parent or x
        j, jj = up.row, (up.parent or up).row
        inside[i] = i == best or inside[j]
        far[i] = 0 if shared[i] else far[j] + 1
        known = [scores[w] for w in x.names if w in scores]
        mark[i] = sum(known) / len(known) if known else 0.0
        low[i], high[i], near[i] = (min(low[j], mark[i]), max(high[j], mark[i]), mark[i] if known else near[j]) if i else (mark[i],) * 3
        brothers = max(1, up.kids)
        same, same_up = alike[j, x.tag], alike[jj, up.tag]
        plain[i] = (
            math.log1p(x.own), math.log1p(x.text), x.text / x.tags, x.links / max(1, x.text), x.own_links / max(1, x.own), x.marks / max(1, x.own), x.depth, x.at, brothers, x.at / brothers,
            same / brothers, x.text / max(1, up.text), up.text / up.tags, up.links / max(1, up.text), up.own / max(1, up.text), (up.text - x.text) / brothers,
            x.text / total, up.text / total, x.kids, i / n,
            inside[i], i > best, far[i], weight[i] / heavy, weight[j] / heavy, weight[jj] / heavy, heavy / total, same, same_up, len(x.names) > 0,
            len(up.names) > 0, mark[i], low[i], high[i], near[i], mark[j],
        )
        if x.tag in _TAG_AT:
            at.append((i, N_PLAIN + _TAG_AT[x.tag]))
        if x.holder >= 0:
            at.append((i, WIDTH - len(HOLDERS) + x.holder))
        where.append(x.mask)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :N_PLAIN] = plain
    out[:, N_PLAIN + len(TAGS) : WIDTH - len(HOLDERS)] = np.array(where)[:, None] >> np.arange(len(HOLDERS)) & 1
    out[tuple(np.array(at).reshape(-1, 2).T)] = 1
    return out


@dataclass
class Model:
    forest: gbt.Forest
    scores: dict[str, float]


def token_scores(pages: list[tuple[list[Node], list[int]]], least: int = 3, prior: float = 2.0) -> dict[str, float]:
    """Log odds that text under an attribute token is content, for tokens on at least ``least`` pages; a page counts once."""
    found: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0])
    for nodes, y in pages:
        good = [0.0] * len(nodes)
        for x in reversed(nodes):
            good[x.row] += x.own * y[x.row]
            if x.parent:
                good[x.parent.row] += good[x.row]
        here: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for x in nodes:
            for w in x.names:
                here[w][0] += good[x.row]
                here[w][1] += x.text
        for w, (c, t) in here.items():
            if t:
                found[w][0] += c / t
                found[w][1] += 1 - c / t
                found[w][2] += 1
    return {w: math.log((c + prior) / (o + prior)) for w, (c, o, n) in found.items() if n >= least}


def decode(nodes: list[Node], logit: np.ndarray) -> set[int]:
    """Ids of the nodes labelled content in the best consistent labelling."""
    index = {id(n): i for i, n in enumerate(nodes)}
    gain = np.array([np.log1p(n.own) for n in nodes]) * np.clip(logit, -6, 6)
    best = np.zeros((len(nodes), 3))  # outside, content, cut
    best[:, 1] += np.where([n.own > 0 for n in nodes], gain, 0)
    up = [index[id(n.parent)] if n.parent else -1 for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        o, c, x = best[i]
        best[up[i]] += (max(o, c), max(c, x), x)
    state, content = [0] * len(nodes), set()
    for i in range(len(nodes)):
        o, c, x = best[i]
        above = 0 if up[i] < 0 else state[up[i]]
        state[i] = (1 if c > o else 0) if above == 0 else (1 if c >= x else 2) if above == 1 else 2
        if state[i] == 1:
            content.add(id(nodes[i]))
    return content


#: Usual names of marks on web pages, which the layouts below are drawn with; nothing else reads them.
CONTENT_NAMES = "article body content entry main post prose story text".split()
CUT_NAMES = {
    "nav": "breadcrumb menu nav navbar navigation tabs toolbar".split(),
    "header": "banner header logo masthead top topbar".split(),
    "footer": "bottom copyright footer legal".split(),
    "aside": "aside more popular recommended related sidebar trending widget".split(),
    "notice": "alert consent cookie disclaimer gdpr modal notice overlay popup".split(),
    "ad": "ad ads advert advertisement banner promo promoted sponsor sponsored".split(),
    "form": "form login newsletter search signup subscribe".split(),
    "comments": "comment comments discussion disqus replies reply respond".split(),
    "share": "author bio byline meta share sharing social tags".split(),
}


def layout(seed: int, vague: float = 0.0) -> tuple[str, set[str]]:
    """A page laid out at random for fitting, and the texts of its article; ``vague`` is the share of marks that tell nothing."""
    r = random.Random(seed)
    syllables = "an be ca do en fi go hu in ja ko lu me no or pa qui ra se to un va we".split()

    def words(n: int) -> str:
        out = " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize()
        return out + r.choice([".", ".", "", "!", "?"]) if n > 3 else out

    def named(kind: str, tag: str | None = None) -> tuple[str, str]:
        names = CUT_NAMES.get(kind, CONTENT_NAMES)
        tag = tag or r.choice(["div", "div", "section"])
        if r.random() < vague:
            return f"<{tag}{nothing()}>", f"</{tag}>"
        mark = r.choice(names) + r.choice(["", "", "-box", "-wrap", f"-{r.randint(1, 9)}"])
        mark = r.choice([mark, f"site-{mark}", f"{mark} block"])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{mark}">', f"</{tag}>"

    def nothing() -> str:
        mark = "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
        return r.choice(["", f' class="{mark}"', f' class="x{r.randint(1, 99)} {mark}"', f" id={mark}"])

    def own() -> str:
        """What a paragraph of the article may be marked with: any name at all."""
        every = [*CONTENT_NAMES, *(x for v in CUT_NAMES.values() for x in v)]
        return "" if r.random() >= vague / 3 else r.choice([nothing(), f' class="{r.choice(every)} {r.choice(every)}"', f' class="{r.choice(every)}-{r.choice(syllables)}"'])

    def links(n: int) -> str:
        items = [f'<a href="/{i}">{words(r.randint(1, 3))}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.6 else " ".join(items)

    def cut(kind: str) -> str:
        plain = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        start, end = (f"<{plain}>", f"</{plain}>") if plain and r.random() < 0.5 else named(kind, plain if plain and r.random() < 0.5 else None)
        prose = lambda: f"<p>{words(r.randint(4, 40))}</p>"
        body = {
            "nav": lambda: links(r.randint(3, 9)), "header": lambda: r.choice([f"<p>{words(3)}</p>", f"<div>{words(4)}</div>", f"<h1>{words(3)}</h1>"]) + r.choice(["", links(4)]),
            "footer": lambda: f"&copy; {words(r.randint(3, 16))}" + r.choice(["", links(4), prose()]), "aside": lambda: f"<h3>{words(2)}</h3>" + r.choice([links(5), prose(), prose() + links(3)]),
            "notice": lambda: r.choice([words(r.randint(5, 25)), prose()]) + r.choice(["", "<button>OK</button>"]), "ad": lambda: r.choice([words(r.randint(3, 20)), prose(), f'<a href="/x">{words(6)}</a>']),
            "form": lambda: f"<label>{words(3)}</label><input name=q><button>{words(1)}</button>" + r.choice(["", prose()]), "share": lambda: r.choice([words(r.randint(2, 8)), links(4)]),
            "comments": lambda: f"<h3>{words(2)}</h3>" + "".join(r.choice(["<div class=comment>{}</div>", "<li>{}</li>", "<article class=comment>{}</article>", "{}"]).format(r.choice([f"<b>{words(1)}</b>", f"<h3>{words(2)}</h3>", f"<h4>{words(1)}</h4>"]) + prose()) for _ in range(r.randint(1, 5))),
        }[kind]()
        return start + body + end

    article, texts = [], set()
    for k in range(r.randint(1, 14)):
        text = words(r.choice([2, 3, 5, r.randint(6, 90), r.randint(10, 90)]))
        tag = "h1" if k == 0 and r.random() < 0.8 else r.choice(["p"] * 12 + ["h2", "h3", "li", "blockquote", "pre", "div", "td"])
        if tag == "li":
            more = [text] + [words(r.randint(2, 20)) for _ in range(r.randint(0, 4))]
            article.append("<ul>" + "".join(f"<li>{x}</li>" for x in more) + "</ul>")
            texts.update(more)
            continue
        texts.add(text)
        if r.random() < 0.12:  # parts with texts of their own beside the first
            more = [words(r.choice([1, 2, r.randint(3, 30)])) for _ in range(r.choice([1, 3, 5]))]
            row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{x}</{tag}>" for x in cells) + "</tr>"
            part, held = r.choice([
                ("<table>" + row("th", [text, more[0]]) + "".join(row(r.choice(["td", "td", "th"]), more[i : i + 2]) for i in range(1, len(more), 2)) + "</table>", more),
                (f"<table><caption>{text}</caption>" + row("th", more) + "</table>", more),
                (f"<details{r.choice(['', ' open'])}><summary>{text}</summary>" + "".join(f"<p>{x}</p>" for x in more) + "</details>", more),
                (f"<figure><img src=/i><figcaption>{text}</figcaption></figure>", []),
                (f"<figure><img src=/i><figcaption><p>{text}</p></figcaption></figure>", []),
                ("<dl>" + "".join(f"<dt>{a}</dt><dd>{b}</dd>" for a, b in zip([text, *more], more)) + "</dl>", more),
                (f"<ol><li><p>{text}</p>" + "".join(f"<li><p>{x}</p>" for x in more) + "</ol>", more),
            ])
            article.append(part)
            texts.update(held)
            continue
        article.append({"p": r.choice([f"<p{own()}>{text}</p>", f"<p{own()}>{text}</p>", f"<p{own()}><b>{text}<br>", f"<p{own()}>{text}"]), "td": f"<table><tr><td>{text}</td></tr></table>"}.get(tag, f"<{tag}>{text}</{tag}>"))
    cuts = r.sample(["ad", "aside", "share", "form", "notice", "nav"], r.choice([0, 1, 1, 2, 3]))
    for kind in cuts:
        article.insert(r.randint(0, len(article)), cut(kind))
    if r.random() < 0.25:
        article.append(cut("comments"))
    if r.random() < 0.25 and article[0].startswith("<h1"):  # the article's own header; what stands beside its title is not the article's text
        title = article.pop(0)
        article.insert(0, "<header>" + r.choice(["", cut("share")]) + title + r.choice(["", "", cut("share")]) + "</header>")
    start, end = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), named("content"), named("content"), ("<div>", "</div>"), ("<section>", "</section>")])
    if r.random() < 0.1:  # a page of nothing else
        page = "".join(r.choice([x, x, f"<div{nothing()}>{x}</div>"]) for x in article) if not set(CUT_NAMES) & set(cuts) else start + "".join(article) + end
        return f"<html><body>{page}</body></html>", texts
    before = [cut(k) for k in r.sample(["nav", "header", "notice", "ad", "aside", "form", "nav"], r.randint(0, 4))]
    after = [cut(k) for k in r.sample(["footer", "comments", "aside", "ad", "form", "share", "notice", "nav"], r.randint(0, 4))]
    page = "".join(before) + start + "".join(article) + end + "".join(after)
    for _ in range(r.randint(0, 2)):
        page = r.choice(["<div>", "<div class=wrapper>", "<div id=page>"]) + page + "</div>"
    return "<!DOCTYPE html><html><head><title>t</title></head><body>" + page + r.choice(["</body></html>", ""]), texts


def weak_labels(nodes: list[Node]) -> list[int] | None:
    """Labels of a page that marks its article with elements of HTML: in the one with most text, and in no other holder, is content.

    So is a heading in the article's own header; a byline there is not.
    """
    mains = [x for x in nodes if x.tag in ("article", "main")]
    if not mains:
        return None
    top = max(mains, key=lambda x: (x.text, -x.row))
    cut = sum(1 << HOLDERS.index(h) for h in ("nav", "header", "footer", "aside", "form", "dialog", "menu"))
    head = 1 << HOLDERS.index("header")
    inside = [False] * len(nodes)
    out = []
    for x in nodes:
        inside[x.row] = x is top or bool(x.parent and inside[x.parent.row])
        title = x.tag in ("h1", "h2", "h3") and x.mask & cut == head and not top.mask & head
        out.append(int(inside[x.row] and (title or not x.mask & cut)))
    return out


def fit(pages: DataFrame, max_pages: int = MAX_TRAIN_PAGES, layouts: int = LAYOUTS) -> Model:
    """Token scores and trees. Trees see scores that were learned from the other half of the pages, so that they learn how far to trust them."""
    picked = hash_sample(pages.select(F.coalesce("html", F.lit("")).alias("html")), max_pages, "html").distinct().orderBy("html").limit(max_pages)
    known: list[tuple[list[Node], list[int], float]] = []
    for r in picked.toLocalIterator():
        nodes, _ = parse(r["html"])
        if (y := weak_labels(nodes)) is not None:
            known.append((nodes, y, 1.0))
    for k in range(layouts):
        source, texts = layout(k, vague=(0.0, 0.7)[k % 2])
        nodes, blocks = parse(source)
        found = {id(n): t for n, t in blocks}
        known.append((nodes, [int(found.get(id(n)) in texts) for n in nodes], 1.0))
    random.Random(0).shuffle(known)
    halves = [[(nodes, y) for nodes, y, _ in known[k::2]] for k in (0, 1)]
    scores = [token_scores(x) for x in (halves[1], halves[0])]
    xs, ys, ws = [np.zeros((0, WIDTH))], [], []
    for k, (nodes, y, w) in enumerate(known):
        keep = [i for i, n in enumerate(nodes) if n.own]
        xs.append(features(nodes, scores[k % 2])[keep])
        ys += [y[i] for i in keep]
        ws += [w] * len(keep)
    forest = gbt.fit(np.concatenate(xs), np.array(ys, float), trees=70, depth=5, rate=0.2, weight=np.array(ws))
    return Model(forest, token_scores(halves[0] + halves[1]))


def main_text(sources: list[str], model: Model) -> list[str]:
    """The main text of each page; all nodes of the pages are scored together."""
    parsed = [parse(s) for s in sources]
    rows = [[i for i, n in enumerate(nodes) if n.own] for nodes, _ in parsed]
    stacks = [features(nodes, model.scores)[keep] for (nodes, _), keep in zip(parsed, rows)]
    logit = model.forest.logit(np.concatenate(stacks)) if stacks else np.zeros(0)
    out, at = [], 0
    for (nodes, blocks), keep in zip(parsed, rows):
        mine = np.zeros(len(nodes))
        mine[keep] = logit[at : at + len(keep)]
        at += len(keep)
        content = decode(nodes, mine)
        out.append("\n".join(t for n, t in blocks if id(n) in content))
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, repeated ones too.

    Null and empty html, and pages without text, give an empty text; long and
    deep pages are read whole, in linear time. Extra columns are left out. An
    empty table gives an empty one.
    """
    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    model = fit(pages) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = [x or "" for x in b.column(2).to_pylist()]
            texts = [t for k in range(0, len(sources), 64) for t in main_text(sources[k : k + 64], model)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
