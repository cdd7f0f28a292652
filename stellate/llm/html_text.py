"""Main text of web pages by a tree-structured graphical model over the DOM's block elements.

Every block element is a node with one of three states: boilerplate, content, or mixed (it holds both).
Node potentials are P(feature | state) of a few discrete features; parent-child potentials are P(child's state |
parent's state, kind of child). Sum-product messages go up and down the tree once, which gives exact marginals; the text
of a block is kept if content is likelier than boilerplate. Both kinds of potentials are counted on labelled pages,
which a seeded generator composes from the usual parts of pages (`labelled_page`), with their states in an attribute.

Defined results: null or empty html gives the empty text; repeated rows give a row each; ids and urls may be null; html of
any length is read whole, in time that grows with its length only, and broken markup never fails; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table

BOILERPLATE, CONTENT, MIXED = range(3)
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text to show; what they hold is skipped.
UNSHOWN = frozenset("script style title textarea iframe noscript template svg math object canvas head".split())
#: An opening tag of the first kind ends an open element of the second, unless one of the third lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id, role and aria-label that speak against or for content.
AGAINST = frozenset("ad ads adv advert advertisement advertising aside banner bar breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus dialog footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup privacy promo promotion recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget alert contentinfo complementary teaser".split())
FOR = frozenset("article body content entry hentry main post story text prose".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>")
_ZEROS, _TOO_LARGE = re.compile(r"(&#[xX]?)0{8,}"), re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{7,});?")
_ATTR = re.compile(r"""\b(class|id|role|aria-label|data-state)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
GROUPS = {t: g for g, tags in enumerate(("article main", "section div body center", "nav menu", "header hgroup", "footer", "aside", "form fieldset button label select option legend dialog", "p blockquote pre figcaption", "h1", "h2 h3 h4 h5 h6", "ul dl dir", "ol", "li dt dd", "table tbody thead tfoot tr td th caption", "figure details summary address")) for t in tags.split()}
N_GROUPS = len(set(GROUPS.values())) + 1


def unescaped(text: str) -> str:
    """Text with character references decoded; numbers beyond Unicode become U+FFFD, however long they are."""
    return html_lib.unescape(_TOO_LARGE.sub("\ufffd", _ZEROS.sub(r"\g<1>0", text))) if "&" in text else text


def markup(html: str) -> Iterator[tuple[str, str, bool, str, int]]:
    """Text before a tag, the tag's name (empty for comments, declarations and the end), whether it closes, its attributes, and where it ends.

    The receiver may send a position to go on from. One pass: a `<` that begins no tag is text; quotes may hold a `>`, until a
    quote proves to have no end, from where on the next `>` ends a tag."""
    at = start = 0
    last, quotes = html.rfind(">"), True
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3
            found = ("", False, "", end if end > 2 else len(html))
        elif at > last:  # nothing can end a tag any more
            at += 1
            continue
        elif html[at + 1] in "!?":
            found = ("", False, "", html.find(">", at) + 1)
        elif m := _NAME.match(html, at + 1):
            if not (whole := quotes and _QUOTED.match(html, m.end())):
                quotes = False
            end = whole.end() if whole else html.find(">", m.end()) + 1
            found = (m[2].lower(), bool(m[1]), html[m.end() : end - 1], end)
        else:
            at += 1
            continue
        at = start = (yield html[start:at], *found) or found[3]
    yield html[start:], "", False, "", len(html)


class Page:
    """Block elements in page order (parents first) and the text segments between their borders."""

    __slots__ = ("parents", "tags", "hints", "states", "segments", "linked", "direct")

    def __init__(self, html: str):
        self.parents, self.tags, self.hints, self.states = [-1], ["body"], [(0, 0)], [None]
        self.segments: list[tuple[int, str]] = []
        self.linked, self.direct = [0], [0]  # characters in links, characters; both without those of inner blocks
        stack: list[tuple[str, int]] = [("body", 0)]  # open elements with their block
        places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements in the stack, without the body
        blocks = [0]  # places of open block elements
        buffer: list[str] = []
        endless: set[str] = set()
        links, go_on = 0, None

        def flush() -> None:
            if buffer:
                text = unescaped("".join(buffer))
                buffer.clear()
                if text := " ".join(text.split()):
                    self.segments.append((stack[-1][1], text))

        def cut(n: int) -> None:
            while len(stack) > n:
                places[stack.pop()[0]].pop()
            while blocks[-1] >= n:
                blocks.pop()

        def last(tags: set[str]) -> int:
            return max((places[t][-1] for t in tags if places[t]), default=0)

        pieces = markup(html)
        while True:
            try:
                text, tag, closing, attributes, end = pieces.send(go_on)
            except StopIteration:
                break
            go_on = None
            if text:
                buffer.append(text)
                n = len(text.strip())
                self.direct[stack[-1][1]] += n
                if links:
                    self.linked[stack[-1][1]] += n
            if not tag:
                continue
            if tag in UNSHOWN:
                if not closing and not attributes.endswith("/"):
                    shown = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(html, end)
                    if shown:
                        go_on = shown.end()
                    else:
                        endless.add(tag)
                        if tag != "head":
                            break
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag == "a":
                links = 0 if closing else 1
            if tag in BLOCKS:
                flush()
            if tag == "body" or tag == "html":
                if tag == "body" and not closing:
                    self.hints[0], self.states[0] = self._hints(attributes)
                continue
            if closing:  # an inline element ends within its block only
                if places[tag] and (tag in BLOCKS or places[tag][-1] > blocks[-1]):
                    cut(places[tag][-1])
                continue
            if tag in BLOCKS:
                ended, fence = ENDS.get(tag, ({"p"}, {"td", "th", "li", "div", "button"}))
                if (n := last(ended)) > last(fence):
                    cut(n)
                links = 0
            if tag in VOID:
                continue
            places[tag].append(len(stack))
            if tag in BLOCKS:
                hints, state = self._hints(attributes)
                self.parents.append(stack[-1][1])
                self.tags.append(tag)
                self.hints.append(hints)
                self.states.append(state)
                self.linked.append(0)
                self.direct.append(0)
                blocks.append(len(stack))
                stack.append((tag, len(self.tags) - 1))
            else:
                stack.append((tag, stack[-1][1]))
        flush()

    @staticmethod
    def _hints(attributes: str) -> tuple[tuple[int, int], int | None]:
        against = for_ = 0
        state = None
        for name, value in _ATTR.findall(attributes):
            if name.lower() == "data-state":
                state = value.strip("\"'")
                continue
            for w in _WORD.findall(value):
                w = w.lower()
                against |= w in AGAINST
                for_ |= w in FOR
        return (against, for_), int(state) if state and state.isdigit() and int(state) < 3 else None

    def features(self) -> list[tuple[int, ...]]:
        """Of each block: its tag's group with the link density of its whole text, its hints, and its own text's length and ending."""
        n = len(self.tags)
        own: list[list[str]] = [[] for _ in range(n)]
        for at, text in self.segments:
            own[at].append(text)
        total, linked = self.direct[:], self.linked[:]
        for at in range(n - 1, 0, -1):
            total[self.parents[at]] += total[at]
            linked[self.parents[at]] += linked[at]
        out = []
        for at in range(n):
            words = sum(t.count(" ") + 1 for t in own[at])
            density = 4 if not total[at] else min(3, int(4 * linked[at] / total[at]))
            length = 0 if not words else 1 if words < 4 else 2 if words < 12 else 3 if words < 40 else 4
            ending = 2 if not words else int(any(t[-1] in ".!?:;\"”»" for t in own[at]))
            against, for_ = self.hints[at]
            group = GROUPS.get(self.tags[at], N_GROUPS - 1)
            out.append((group * 5 + density, against + 2 * for_, length, ending))
        return out


class Model:
    """Log potentials: node[feature][value][state], edge[kind of child][parent's state][child's state], root[state]."""

    SIZES = (N_GROUPS * 5, 4, 5, 3)

    def __init__(self, pages: list[Page]):
        node = [[[0.5] * 3 for _ in range(s)] for s in self.SIZES]
        edge = [[[0.5] * 3 for _ in range(3)] for _ in range(2)]
        root = [0.5] * 3
        for page in pages:
            for at, (values, state) in enumerate(zip(page.features(), page.states, strict=True)):
                for f, v in enumerate(values):
                    node[f][v][state] += 1
                if at:
                    edge[self.kind(values)][page.states[page.parents[at]]][state] += 1
                else:
                    root[state] += 1
        self.node = [[[math.log(table[v][s] / sum(row[s] for row in table)) for s in range(3)] for v in range(len(table))] for table in node]
        self.edge = [[[p / sum(row) for p in row] for row in kind] for kind in edge]
        self.root = [p / sum(root) for p in root]
        self.weights = (1.0, 1.0)

    def tempered(self, pages: list[Page]) -> Model:
        """Sets the weights of node potentials by kind (many text blocks in a part say the same thing over and over) to those under which the states of these pages' text are likeliest."""

        def loss(weights: tuple[float, float]) -> float:
            self.weights = weights
            return sum(-math.log(max(1e-6, q[at][p.states[at]])) for p in pages for q in (self.marginals(p),) for at, _ in p.segments)

        self.weights = min(((a, b) for a in (0.02, 0.05, 0.1, 0.2, 0.4, 1.0) for b in (0.5, 1.0, 2.0)), key=loss)
        return self

    @staticmethod
    def kind(values: tuple[int, ...]) -> int:
        """1 for children that are a part of the page, 0 for those that hold text only."""
        return int(values[0] // 5 < 7 or values[0] // 5 in (10, 11))

    def marginals(self, page: Page) -> list[list[float]]:
        """P(state) of each block, by messages from the leaves to the root and back."""
        features, parents, n = page.features(), page.parents, len(page.tags)
        belief = []
        for values in features:
            weight = self.weights[self.kind(values)]
            logs = [weight * sum(self.node[f][v][s] for f, v in enumerate(values)) for s in range(3)]
            top = max(logs)
            belief.append([math.exp(x - top) for x in logs])
        up: list = [None] * n
        for at in range(n - 1, 0, -1):  # children come after their parents
            b, edge = belief[at], self.edge[self.kind(features[at])]
            message = [e[0] * b[0] + e[1] * b[1] + e[2] * b[2] for e in edge]
            scale = max(message)
            up[at] = [x / scale for x in message]
            p = belief[parents[at]]
            p = [x * y for x, y in zip(p, up[at], strict=True)]
            scale = max(p) or 1.0
            belief[parents[at]] = [max(x / scale, 1e-100) for x in p]
        full = [x * r for x, r in zip(belief[0], self.root, strict=True)]
        total = sum(full)
        out = [[x / total for x in full]]
        for at in range(1, n):
            without = [x / max(u, 1e-100) for x, u in zip(out[parents[at]], up[at], strict=True)]
            edge = self.edge[self.kind(features[at])]
            down = [sum(without[p] * edge[p][s] for p in range(3)) for s in range(3)]
            full = [max(x * d, 1e-300) for x, d in zip(belief[at], down, strict=True)]
            total = sum(full)
            out.append([x / total for x in full])
        return out

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        p = self.marginals(page)
        return "\n".join(text for at, text in page.segments if p[at][CONTENT] + p[at][MIXED] / 2 > 0.5)


def labelled_page(rng: random.Random) -> str:
    """A page composed of the usual parts, with every block's state in data-state."""
    syllables = "ka ro mi te lu sa no ve di pa shi lo ne ra to".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + rng.choice(".....!?")
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def el(tag: str, state: int, inner: str, name: str = "") -> str:
        named = f' {rng.choice(("class", "class", "class", "id", "id", "role"))}="{name}"' if name else ""
        return f'<{tag}{named} data-state="{state}">{inner}</{tag}>'

    def links(state: int, tag: str = "ul") -> str:
        return el(tag, state, "".join(el("li", state, link()) for _ in range(rng.randint(3, 8)))) if rng.random() < 0.8 else " | ".join(link() for _ in range(rng.randint(2, 6)))

    def content() -> str:
        parts, block = [], rng.choice(("p", "p", "p", "p", "p", "div"))
        if rng.random() < 0.8:
            parts.append(el("h1", CONTENT, words(2, 12)))
        for _ in range(rng.choice((1, 2, 3, 5, 8, 12))):
            kind = rng.random()
            if kind < 0.72:
                text = prose() if rng.random() < 0.85 else words(1, 6) + rng.choice((".", ""))
                parts.append(el(block, CONTENT, text if rng.random() < 0.7 else f"{text} {link()} {prose()}"))
            elif kind < 0.79:
                parts.append(el(rng.choice(("h2", "h3")), CONTENT, words(1, 8)))
            elif kind < 0.88:
                parts.append(el(rng.choice(("ul", "ol")), CONTENT, "".join(el("li", CONTENT, rng.choice((words(2, 9), words(1, 3), sentence(), prose(1, 2), link() + " " + words(3, 9)))) for _ in range(rng.randint(2, 5)))))
            elif kind < 0.91:
                parts.append(el("blockquote", CONTENT, el("p", CONTENT, prose(1, 3))))
            elif kind < 0.93:
                parts.append(el("table", CONTENT, "".join(el("tr", CONTENT, "".join(el("td", CONTENT, words(1, 4)) for _ in range(3))) for _ in range(3))))
            elif kind < 0.96:
                parts.append(el("figure", CONTENT, '<img src="x.png">' + el("figcaption", CONTENT, sentence())))
            elif kind < 0.98:
                parts.append(el("pre", CONTENT, words(5, 30)))
            else:
                parts.append(el("div", CONTENT, prose()))
        return "".join(parts)

    def ad() -> str:
        return el(rng.choice(("div", "div", "aside", "section")), BOILERPLATE, rng.choice((prose(1, 2), el("p", BOILERPLATE, prose(1, 2)), link(), words(2, 12))), rng.choice(("ad", "ads", "advert", "ad-banner", "sponsored", "promo", "banner-ad", "advertisement")))

    def comments() -> str:
        one = lambda: rng.choice((el("p", BOILERPLATE, prose(1, 3)), prose(1, 3), el("h4", BOILERPLATE, words(1, 3)) + el("p", BOILERPLATE, prose(1, 2))))
        inner = "".join(el(rng.choice(("div", "li", "article")), BOILERPLATE, one(), rng.choice(("comment", "reply", ""))) for _ in range(rng.randint(1, 5)))
        return el(rng.choice(("div", "section", "ul", "aside")), BOILERPLATE, (el("h3", BOILERPLATE, words(1, 3)) if rng.random() < 0.6 else "") + inner, rng.choice(("comments", "comment-list", "reader-comments", "discussion", "replies")))

    def notice() -> str:
        if rng.random() < 0.2:
            return el("p", BOILERPLATE, prose(1, 2), rng.choice(("notice", "cookie-notice", "alert", "disclaimer")))
        return el(rng.choice(("div", "section", "aside", "dialog")), BOILERPLATE, rng.choice((prose(1, 2), el("p", BOILERPLATE, prose(1, 2)))) + (el("button", BOILERPLATE, words(1, 2)) if rng.random() < 0.6 else ""), rng.choice(("cookie-notice", "cookie", "consent", "notice", "gdpr-banner", "alert", "privacy-popup")))

    def form() -> str:
        inner = el("label", BOILERPLATE, words(1, 3)) + '<input type="text">' + el("button", BOILERPLATE, words(1, 2))
        return el("form", BOILERPLATE, (el("p", BOILERPLATE, prose(1, 2)) if rng.random() < 0.5 else "") + inner, rng.choice(("", "newsletter", "search", "login-form", "subscribe")))

    def sidebar() -> str:
        inner = "".join(rng.choice((el("h3", BOILERPLATE, words(1, 3)) + links(BOILERPLATE), el("p", BOILERPLATE, prose(1, 3)), ad(), form(), links(BOILERPLATE))) for _ in range(rng.randint(1, 3)))
        return el("aside", BOILERPLATE, inner, rng.choice(("", "sidebar", "related"))) if rng.random() < 0.6 else el("div", BOILERPLATE, inner, rng.choice(("sidebar", "widget", "related", "right-sidebar")))

    def share() -> str:
        return el("div", BOILERPLATE, links(BOILERPLATE), rng.choice(("share", "social", "breadcrumbs", "pagination", "tags", "related-posts")))

    def wrapped(inner: str, state: int) -> str:
        tag, name = rng.choice((("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post-content"), ("div", "entry"), ("div", "post"), ("section", "story"), ("section", ""), ("div", "")))
        return el(tag, state, inner, name)

    main = content()
    inside = [f() for f, p in ((share, 0.15), (ad, 0.2), (comments, 0.12), (notice, 0.08), (form, 0.08)) if rng.random() < p]
    if inside and rng.random() < 0.5:  # boilerplate inside the article, at its end or between its blocks
        body = wrapped(main + "".join(inside), MIXED) if rng.random() < 0.5 else wrapped("".join(inside) + main, MIXED)
        inside = []
    else:
        body = wrapped(main, CONTENT) if rng.random() < 0.9 else main
    if rng.random() < 0.3:
        body = el(rng.choice(("main", "div", "div")), MIXED if inside or "data-state=\"0\"" in body else CONTENT, body, rng.choice(("", "main", "page", "container")))
    before = [f() for f, p in ((lambda: el("nav", BOILERPLATE, links(BOILERPLATE), rng.choice(("", "menu"))), 0.6), (lambda: el("header", BOILERPLATE, rng.choice((el("h1", BOILERPLATE, words(1, 3)), el("p", BOILERPLATE, sentence()), words(1, 4), el("div", BOILERPLATE, words(1, 3), "logo"))) + (links(BOILERPLATE) if rng.random() < 0.5 else ""), rng.choice(("", "site-header"))), 0.5), (lambda: el("div", BOILERPLATE, links(BOILERPLATE), rng.choice(("menu", "navbar", "nav", "topbar", "header"))), 0.3), (lambda: el("div", BOILERPLATE, el("div", BOILERPLATE, words(1, 4)), rng.choice(("topbar", "header", "masthead"))), 0.15), (notice, 0.25), (ad, 0.4), (sidebar, 0.2)) if rng.random() < p]
    after = [f() for f, p in ((sidebar, 0.35), (comments, 0.35), (form, 0.25), (ad, 0.25), (notice, 0.2), (lambda: el("footer", BOILERPLATE, rng.choice((f"&copy; {words(1, 3)} {sentence()}", el("p", BOILERPLATE, prose(1, 2)), links(BOILERPLATE), words(1, 5)))), 0.7), (lambda: el("div", BOILERPLATE, rng.choice((prose(1, 2), links(BOILERPLATE))), rng.choice(("footer", "copyright", "legal"))), 0.25)) if rng.random() < p]
    rng.shuffle(before)
    return f'<html><head><title>{words(2, 6)}</title></head><body data-state="{MIXED if before or after or inside or chr(34) + "0" + chr(34) in body else CONTENT}">{"".join(before)}{body}{"".join(inside)}{"".join(after)}</body></html>'


@lru_cache
def trained(pages: int = 1500, seed: int = 7) -> Model:
    """A model counted on so many generated pages."""
    rng = random.Random(seed)
    labelled = [p for p in (Page(labelled_page(rng)) for _ in range(pages)) if None not in p.states]
    return Model(labelled).tempered(labelled[::8])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html). One pass without a shuffle."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = [own.text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html").mapInArrow(scan, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
