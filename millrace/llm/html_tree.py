"""Main text of HTML pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree; each is content or not. A node
shows its tag, the words of its class, id and role, how much text stands in it and how
much of that is links, all given its label; a label depends on the parent's. The tables
of these probabilities are counted on labelled pages. Messages are passed from the
leaves up and from the root down (sum-product), which gives each node's exact marginal
probability of being content, given the whole page. The text of nodes at one half or
more is the page's text.

Pages are parsed in tasks, each by itself; the messages of a batch of pages are passed
together, level by level. The labelled pages are small, made up and kept here.

What stands in a script, style or other element of ``RAW`` is not read as tags: it ends at
the next ``</name``, or with the page if there is none. Text that stands outside all block
elements, or in the body itself, has nodes of its own, one for each run between blocks, and
is judged like any other.

Results: a null or empty page has no text. Unclosed and stray tags and unclosed quotes are
read in time that grows with the page's length, however long it is; elements nested more than ``DEEPEST``
deep are siblings. Pages that repeat an id are extracted each. An empty table gives an
empty table.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import prepare

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[\"'>]")
NAMED = re.compile(r"\b(class|id|role|data-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# The kinds of elements that HTML defines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title svg math iframe object textarea select datalist".split())
#: Those in which HTML knows no tags or comments, only the end of the element.
RAW = frozenset("script style noscript title iframe textarea".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])[^>]*>", re.ASCII | re.IGNORECASE) for name in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Elements in which text that no block holds has a node of its own, as if in a block.
LOOSE = frozenset("#page html body".split())
#: Nodes of a path, at most; what is nested more deeply is taken for siblings, as browsers do.
DEEPEST = 512
#: An element that ends open ones of the same kind, up to an enclosing one.
ENDS = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}


@dataclass
class Page:
    """Nodes in page order; node 0 is the page itself."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    kind: list[tuple[str, str]] = field(default_factory=lambda: [("#page", "")])
    label: list[int] = field(default_factory=lambda: [0])
    text: list[int] = field(default_factory=lambda: [0])  # characters of own text
    link: list[int] = field(default_factory=lambda: [0])  # those in links
    pieces: list[tuple[int, str]] = field(default_factory=list)


class _Tags:
    """The tags of a page, one after the other, in time that grows with its length."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")  # beyond it there are no tags
        self.without: dict[str, int] = {}  # quotes and marks, and where none follows

    def _find(self, what: str, at: int) -> int:
        if at >= self.without.get(what, len(self.source) + 1):
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.without[what] = at
        return found

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Begin, end, name, whether it closes, attributes; no name for a comment."""
        source = self.source
        while 0 <= (begin := source.find("<", at)) and (begin < self.last or source.startswith("<!--", begin)):
            if source.startswith("<!--", begin):
                end = self._find("-->", begin + 4)
                return begin, len(source) if end < 0 else end + 3, "", False, ""
            if source[begin + 1] in "!?":
                return begin, self._find(">", begin) + 1, "", False, ""
            if not (m := TAG.match(source, begin)):
                at = begin + 1
                continue
            first, end = m.end(), -1
            here = first
            while (stop := STOP.search(source, here)) is not None:
                if stop[0] == ">":
                    end = stop.end()
                    break
                close = self._find(stop[0], stop.end())
                if close < 0:
                    break
                here = close + 1
            if end < 0:  # a quote is not closed
                end = self._find(">", first) + 1
            return begin, end, m[1].lower(), source[begin + 1] == "/", source[first : end - 1]
        return None


def parse(source: str, labelled: bool = False) -> Page:
    page = Page()
    open_: list[tuple[str, int]] = [("#page", 0)]  # block elements that are open
    counts: dict[str, int] = {}  # of their names
    links, gap, at, node = 0, False, 0, 0
    hidden: str | None = None
    said_label: int | None = None
    tags = _Tags(source)

    def add(kind: tuple[str, str], above: int, label: int) -> int:
        if page.depth[above] >= DEEPEST:
            above = page.parent[above]
        page.parent.append(above)
        page.depth.append(page.depth[above] + 1)
        page.kind.append(kind)
        page.label.append(label)
        page.text.append(0)
        page.link.append(0)
        return len(page.parent) - 1

    def say(text: str) -> None:
        nonlocal gap, node
        if "&" in text:
            text = html.unescape(text)
        n = len(text.strip())
        if n and page.kind[node][0] in LOOSE:
            node = add(("#loose", ""), node, page.label[node] if said_label is None else said_label)
        page.text[node] += n
        if links:
            page.link[node] += n
        page.pieces.append((node, " " + text if gap else text))
        gap = False

    def end_from(i: int) -> None:
        for gone, _ in open_[i:]:
            counts[gone] -= 1
        del open_[i:]

    while (tag := tags.next(at)) is not None:
        begin, end, name, closing, attributes = tag
        if hidden is None and begin > at:
            say(source[at:begin])
        at = end
        if not name:
            continue
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                found = RAW_END[name].search(source, at)
                at = found.end() if found else len(source)
            continue
        if hidden is not None:
            if closing and name == hidden:
                hidden = None
            continue
        if name in HIDDEN:
            if not closing and not attributes.endswith("/"):
                hidden = name
            continue
        if name in INLINE:
            if name == "br":
                gap = True
            elif name == "a":
                links = 0 if closing else 1
            elif labelled and name == "span":
                said_label = int("1" in attributes) if "data-label" in attributes else None
            continue
        gap = True
        if closing:
            if counts.get(name):
                i = len(open_) - 1
                while open_[i][0] != name:
                    i -= 1
                end_from(i)
            node, links = open_[-1][1], 0
            continue
        if name in CLOSES_P:
            names, stop = ("p",), ()
        else:
            names, stop = ENDS.get(name, ("", ()))
            names = names.split() if names else ()
        if any(counts.get(x) for x in names):
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] in names:
                    end_from(i)
                    if name in ("tr", "dd", "dt"):
                        continue
                    break
                if open_[i][0] in stop or (not stop and open_[i][0] in ("td", "th", "li", "div", "article")):
                    break
        if name in VOID:
            node = open_[-1][1]
            continue
        above = open_[-1][1]
        said, label = "", page.label[above]
        if "=" in attributes:
            for key, value in NAMED.findall(attributes):
                value = value.strip("\"'")
                if key.lower() != "data-label":
                    said += " " + value
                elif labelled:
                    label = int(value)
        node = add((name, said), above, label)
        open_.append((name, node))
        counts[name] = counts.get(name, 0) + 1
    if hidden is None and at < len(source):
        say(source[at:])
    return page


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1)))


#: Classes of nodes that have tables of their own for a label given the parent's; the text
#: and links of ``ITEMS`` are told by the list alone, of which they are parts.
ITEMS = frozenset("li dt dd".split())
OUTERMOST = 5  # blocks of the page or its body
CLASSES = {"#loose": 2, "td": 3, "th": 3, "ul": 4, "ol": 4, "dl": 4} | {tag: 1 for tag in sorted(ITEMS)}

TEXT_BOUNDS = np.array([1, 40, 200, 1000])
LINK_BOUNDS = np.array([0.05, 0.3, 0.7])


@dataclass
class Forest:
    """The nodes of several pages."""

    parent: np.ndarray
    levels: list[np.ndarray]
    kind: list[tuple[str, str]]
    of: np.ndarray  # class
    label: np.ndarray
    size: np.ndarray  # bin of the text in the subtree, or the last
    linked: np.ndarray  # bin of the share of it that is links; the next if there is no text, or the last


def forest(pages: list[Page]) -> Forest:
    starts = np.cumsum([0, *(len(p.parent) for p in pages)])
    parent = np.concatenate([np.array(p.parent) + a for p, a in zip(pages, starts, strict=False)])
    depth = np.concatenate([p.depth for p in pages])
    parent[depth == 0] = -1
    text = np.concatenate([p.text for p in pages]).astype(float)
    link = np.concatenate([p.link for p in pages]).astype(float)
    levels = _levels(depth)
    for level in reversed(levels[1:]):
        np.add.at(text, parent[level], text[level])
        np.add.at(link, parent[level], link[level])
    share = np.searchsorted(LINK_BOUNDS, link / np.maximum(text, 1), "right")
    kind = [k for p in pages for k in p.kind]
    of = np.array([CLASSES.get(tag, 0) for tag, _ in kind])
    outer = np.array([tag in LOOSE for tag, _ in kind])
    of[(of == 0) & (parent >= 0) & outer[parent]] = OUTERMOST
    return Forest(
        parent,
        levels,
        kind,
        of,
        np.concatenate([p.label for p in pages]),
        np.where(np.isin(of, (1, 4)), len(TEXT_BOUNDS) + 1, np.searchsorted(TEXT_BOUNDS, text, "right")),
        np.where(np.isin(of, (1, 4)), len(LINK_BOUNDS) + 2, np.where(text > 0, share, len(LINK_BOUNDS) + 1)),
    )


def _shows(kind: tuple[str, str]) -> list[tuple[str, str]]:
    """Its tag, told apart by whether it is named, and the words of class, id and role."""
    tag, said = kind
    named = {w.lower() for w in WORD.findall(said)}
    words = [("word", w) for w in sorted(named)]
    # What a class of its own says stands in its table of labels.
    return words if tag in CLASSES else [("tag", f"{tag}." if named else tag), *words]


class Model:
    """Log odds of what a node shows, and log chances of a label given the parent's."""

    SMOOTH = 0.5

    def __init__(self, pages: list[Page]):
        f = forest(pages)
        n = np.bincount(f.label, minlength=2) + 2 * self.SMOOTH
        shown: dict[tuple, list[float]] = {}
        for i, kind in enumerate(f.kind):
            for what in [*_shows(kind), ("size", f.size[i]), ("linked", f.linked[i])]:
                shown.setdefault(what, [self.SMOOTH, self.SMOOTH])[f.label[i]] += 1
        self.odds = {w: float(np.log(c[1] / n[1]) - np.log(c[0] / n[0])) for w, c in shown.items()}
        self.odds[("size", len(TEXT_BOUNDS) + 1)] = self.odds[("linked", len(LINK_BOUNDS) + 2)] = 0.0
        steps = np.full((OUTERMOST + 1, 2, 2), self.SMOOTH)
        below = f.parent >= 0
        np.add.at(steps, (f.of[below], f.label[f.parent[below]], f.label[below]), 1)
        self.steps = np.log(steps / steps.sum(axis=2, keepdims=True))  # by class, parent's label, label
        self._kinds: dict[tuple[str, str], float] = {}

    def _kind(self, kind: tuple[str, str]) -> float:
        known = self._kinds.get(kind)
        if known is None:
            if len(self._kinds) > 100_000:
                self._kinds.clear()
            known = sum(self.odds.get(what, 0.0) for what in _shows(kind))
            self._kinds[kind] = known
        return known

    def marginals(self, f: Forest) -> np.ndarray:
        """Each node's probability of being content, by sum-product."""
        size = np.array([self.odds.get(("size", i), 0.0) for i in range(len(TEXT_BOUNDS) + 2)])
        linked = np.array([self.odds.get(("linked", i), 0.0) for i in range(len(LINK_BOUNDS) + 3)])
        own = np.zeros((len(f.parent), 2))
        own[:, 1] = np.array([self._kind(k) for k in f.kind]) + size[f.size] + linked[f.linked]
        own[f.levels[0], 1] = -np.inf  # the page as a whole is not content
        up = np.zeros_like(own)  # to the parent, by its label
        for level in reversed(f.levels[1:]):
            steps = self.steps[f.of[level]]
            up[level] = np.logaddexp(steps[:, :, 0] + own[level, 0, None], steps[:, :, 1] + own[level, 1, None])
            np.add.at(own, f.parent[level], up[level])
        belief = own  # what the subtree says; what comes from above is added
        for level in f.levels[1:]:
            above = belief[f.parent[level]] - up[level]
            steps = self.steps[f.of[level]]
            down = np.logaddexp(above[:, 0, None] + steps[:, 0], above[:, 1, None] + steps[:, 1])
            belief[level] += down - np.maximum(down[:, :1], down[:, 1:])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def texts(model: Model, sources: list[str]) -> list[str]:
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    content = model.marginals(forest(pages)) >= 0.5
    out, start = [], 0
    for page in pages:
        kept = "".join([t for node, t in page.pieces if content[start + node]])
        out.append(" ".join(kept.split()))
        start += len(page.parent)
    return out


# The labelled pages: parts of pages, combined by a seed. Content is marked by
# data-label="1", what is not content within it by data-label="0".
_CONTENT = (
    *['<article data-label="1">{body}</article>'] * 5,
    '<div data-label="1">{body}</div>',
    '<main><article class="post" data-label="1">{body}</article></main>',
    '<div class="post-content entry" data-label="1">{body}</div>',
    '<div id="content"><div class="article-body" data-label="1">{body}</div></div>',
    '<main id="main" data-label="1">{body}</main>',
    '<div class="wrapper"><section class="story-text" data-label="1">{body}</section></div>',
    '<div id="page"><div class="main content" data-label="1"><div>{body}</div></div></div>',
    '<table><tr><td><a href="/">{w}</a> <a href="/n">{w}</a></td><td data-label="1">{body}</td></tr></table>',
    '<table width="100%"><tbody><tr><td data-label="1">{body}</td><td><a href="/">{w}</a><br><a href="/n">{w}</a></td></tr></tbody></table>',
)
_TITLES = ("<h1>{t}</h1>", "<header><h1>{t}</h1></header>", "<h2>{t}</h2>", "")
_BODIES = (
    "<p>{a}</p>",
    "<p>{a}<br>{b}</p>",
    "<p><b>{t}<br><p>{a}</p>",
    "<div><p>{a}</p><p>{b}</p></div>",
    "<h2>{t}</h2><p>{a}</p>",
    "<h3>{t}</h3><p>{b}</p>",
    '<p>{t} <a href="/x">{t}</a> {a}</p>',
    "<ul><li>{t}</li><li>{b}</li></ul>",
    "<ol><li>{b}</li><li>{b}</li></ol>",
    "<blockquote><p>{b}</p></blockquote>",
    "<pre><code>{t}</code></pre>",
    "<table><tbody><tr><th>{t}</th><td>{t}</td></tr><tr><td>{b}</td><td>{t}</td></tr></tbody></table>",
    "<figure><img src=x><figcaption>{t}</figcaption></figure>",
    "<section><h2>{t}</h2><p>{a}</p></section>",
)
#: Parts that few pages have.
_RARE_BODIES = (
    '<ul><li><a href="/l">{t}</a></li><li><a href="/k">{t}</a></li><li><a href="/j">{t}</a></li></ul>',
    '<ol><li><a href="/l">{t}</a>, {t}</li><li><a href="/k">{t}</a>, {t}</li></ol>',
    "<table><tr><th>{w}</th><th>{w}</th></tr><tr><td>{w}</td><td>{w}</td></tr><tr><td>{t}</td><td>{w}</td></tr></table>",
)
_INNER = (
    '<aside class="related" data-label="0"><h3>{t}</h3><ul><li><a href="/r">{t}</a></li></ul></aside>',
    '<div class="ad advert" data-label="0">{b}</div>',
    '<div class="share social" data-label="0"><a href="/s">{w}</a> <a href="/t">{w}</a></div>',
    '<section class="comments" id="comments" data-label="0"><h3>{w}</h3><div class="comment"><p>{b}</p></div></section>',
    '<form class="subscribe newsletter" data-label="0"><p>{t}</p><button>{w}</button></form>',
    '<div class="promo sponsored" data-label="0"><p>{b}</p></div>',
    '<footer data-label="0">{t} <a href="/c">{w}</a></footer>',
    '<footer data-label="0"><p>{t}</p></footer>',
    '<nav data-label="0"><a href="/p">{w}</a> <a href="/q">{t}</a></nav>',
)
#: Runs of text in no block, as a page's main text, and beside it.
_LOOSE_CONTENT = (
    '<span data-label="1"><b>{t}</b><br>{a}</span>',
    '<span data-label="1">{a}<br><br>{a}</span>',
    '<span data-label="1">{t}<br>{b}<br>{a}</span>',
    '<span data-label="1">{b}</span>',
    '<span data-label="1">{a}<br>{a}<br>{a} <a href="/z">{t}</a> {b}</span>',
)
_LOOSE_BESIDE = (
    '<a href="/">{w}</a> | <a href="/n">{w}</a> | <a href="/o">{w}</a>',
    '<a href="/">{w}</a> <a href="/n">{w}</a>',
)
_BEFORE = (
    '<nav><ul><li><a href="/a">{w}</a></li><li><a href="/b">{w}</a></li><li><a href="/c">{w}</a></li></ul></nav>',
    '<header><div class="logo"><a href="/">{w}</a></div><p>{t}</p></header>',
    '<div class="header top"><h1><a href="/">{w}</a></h1><div class="menu"><ul><li><a href="/m">{w}</a></li></ul></div></div>',
    '<div class="cookie notice banner"><p>{b}</p><button>{w}</button></div>',
    '<div class="ad">{b}</div>',
    '<div class="breadcrumb"><a href="/">{w}</a> <a href="/k">{w}</a></div>',
    '<form class="search login"><p>{w}</p><input type=text><button>{w}</button></form>',
    '<div class="alert message"><p>{t}</p></div>',
    '<div id="nav"><a href="/1">{w}</a> <a href="/2">{w}</a></div>',
)
_AFTER = (
    "<footer>{t}</footer>",
    '<footer><p>{t}</p><ul><li><a href="/i">{w}</a></li></ul></footer>',
    '<aside class="sidebar widget"><h3>{w}</h3><p>{b}</p><ul><li><a href="/w">{t}</a></li></ul></aside>',
    '<div id="sidebar"><div class="widget"><p>{b}</p></div></div>',
    '<section class="comments"><h2>{w}</h2><article class="comment"><p>{b}</p></article><article class="comment"><p>{a}</p></article></section>',
    '<div id="comments"><ol class="comment-list"><li class="comment"><div class="comment-body"><p>{a}</p></div></li></ol></div>',
    '<div class="footer bottom copyright"><p>{t}</p></div>',
    '<div class="related recommended"><h3>{w}</h3><ul><li><a href="/y">{t}</a></li><li><a href="/z">{t}</a></li></ul></div>',
    '<div class="ads advertisement"><p>{b}</p></div>',
    '<div class="popup modal"><p>{b}</p></div>',
    "<div>{t}</div>",
    "<div><small>{t}</small></div>",
    '<div>{t} <a href="/i">{w}</a> <a href="/j">{w}</a></div>',
    "<hr><p><small>{w} {w}</small></p>",
)


def labelled_pages(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)

    def prose(words: int) -> str:
        return " ".join("".join(rng.choices("abdeginorst", k=rng.randint(2, 9))) for _ in range(words)) + "."

    def filled(part: str) -> str:
        sizes = {"a": (30, 160), "b": (8, 40), "t": (3, 10), "w": (1, 1)}
        return re.sub(r"\{([abtw])\}", lambda m: prose(rng.randint(*sizes[m[1]])), part)

    pages = []
    for _ in range(n):
        body = [rng.choice(_TITLES), *(
            rng.choice(_RARE_BODIES if rng.random() < 0.02 else _BODIES) for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 9)))
        )]
        for part in rng.sample(_INNER, rng.choice((0, 0, 1, 2))):
            body.insert(rng.randint(1, len(body)), part)
        parts = [
            *rng.sample(_BEFORE, rng.randint(1, 4)),
            rng.choice(_CONTENT).replace("{body}", "".join(body)),
            *rng.sample(_AFTER, rng.randint(1, 4)),
        ]
        inside = "".join(parts)
        if rng.random() < 0.05:  # a fragment
            parts = [re.sub(r"^<(\w+)", r'<\1 data-label="1"', part) for part in body if "data-label" not in part]
            pages.append(filled("".join(parts)))
            continue
        if rng.random() < 0.12:  # text in no block
            loose = rng.choice(_LOOSE_CONTENT)
            beside = [rng.sample(_BEFORE, 1), [], [], [rng.choice(_LOOSE_BESIDE) + "<hr>"]][rng.randrange(4)]
            after = [rng.sample(_AFTER, 1), [], [], ["<hr>" + rng.choice(_LOOSE_BESIDE)]][rng.randrange(4)]
            page = filled("".join([*beside, loose, *after]))
            pages.append(page if rng.random() < 0.4 else f"<html><body>{page}</body></html>")
            continue
        if rng.random() < 0.1:  # nothing but the text
            inside = f'<body data-label="1">{"".join(body)}'
        elif rng.random() < 0.4:
            inside = f'<div class="container">{inside}</div>'
        if not inside.startswith("<body"):
            inside = f"<body>{inside}"
        pages.append(f"<html><head><title>x</title></head>{filled(inside)}</body></html>")
    return pages


#: Labelled pages that the tables are counted on.
TRAINING_PAGES = 1000


def trained(seed: int = 1) -> Model:
    return Model([parse(p, labelled=True) for p in labelled_pages(TRAINING_PAGES, seed)])


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(model.value, [h or "" for h in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    return run


def main_text(pages: DataFrame, *, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of each page, from the whole of it."""
    prepare(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(
        F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html")
    )
    found = rows.mapInArrow(_extract(model), "id long, url string, text string, n_chars long")
    return found.select(F.col("id").alias(id), F.col("url").alias(url), "text", "n_chars")
