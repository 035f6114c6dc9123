"""Main text of web pages by a tree-structured graphical model.

Each node of a page's tree (block elements, inline elements with names or hidden, and runs of text as leaves) is content or not. The joint
distribution is a product of one potential for each parent and child, P(child | parent) by kind of
child, and of one for each node's observations, P(observation | state). Sum-product message passing,
one sweep up and one sweep down, gives every node's exact marginal; runs whose marginal of content
reaches one half are the page's text, in page order. Where no run does but one reaches ``LEAST``, as in pages
of bare divisions, those that have at least half of the highest marginal are. Of 1000 made pages without any article this second rule
takes text from 352, the first alone from 187. Both sweeps are linear in the number of nodes.

The potentials are relative frequencies with add-one smoothing over labelled pages. The labelled
pages are made by :func:`labelled_pages` from a fixed seed: ``PAGES`` pages in common layouts
(semantic elements, classed divisions, bare divisions, tables, remarks without telling names, adverts and
hidden text inside paragraphs), whose parts are known. Their number
is a parameter and does not depend on the input.

A null or empty page gives the empty text. Very long, deep or broken pages take time and memory in
proportion to their length, as tags that close nothing aren't searched for. Rows are independent: one pass, no shuffle; repeated rows
each give a row; other columns are ignored.
"""
from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import pick, ship
from tidemill.llm.html_tree import INLINE, Node, parse

PAGES, SEED, CONTENT, LEAST = 1500, 5, 0.5, 0.4

_KIND = {
    **dict.fromkeys("p blockquote pre dd dt figcaption figure".split(), "para"),
    "h1": "title", **dict.fromkeys("h2 h3 h4 h5 h6 hgroup".split(), "head"),
    **dict.fromkeys("ul ol li dl menu".split(), "list"),
    **dict.fromkeys("table tbody thead tfoot tr td th caption".split(), "cell"),
    **dict.fromkeys("form fieldset button select option optgroup legend input dialog".split(), "form"),
    "article": "article", "main": "main", "section": "section", "nav": "nav", "aside": "aside", "header": "header",
    "footer": "footer", "head": "meta", "noscript": "noscript", **dict.fromkeys(INLINE, "inline"), "#text": "text", "#page": "page", "html": "page", "body": "page",
}


#: Words that head or make up the parts around an article.
_CUES = {
    "talk": "comments comment replies reply discussion responses kommentare commentaires comentarios".split(),
    "side": "related recommended trending popular tags categories archives".split(),
    "ad": "advertisement sponsored anzeige publicité publicidad".split(),
    "note": "cookies cookie consent javascript newsletter subscribe".split(),
    "share": "share tweet facebook whatsapp pinterest".split(),
}
_CUE = {word: part for part, words in _CUES.items() for word in words}


def _cue(text: str) -> str:
    """The part of a page that a short text's words name, if any."""
    return next((_CUE[w] for w in text.lower().split() if w in _CUE), "none")


def observations(nodes: list[Node], i: int) -> list[str]:
    """What is seen of a node."""
    node = nodes[i]
    if node.name != "#text":
        return ["w:" + word for word in node.labels] or (["bare:div"] if node.name not in _KIND else [])
    text = node.text
    n = len(text)
    share = node.linked / n
    stops = sum(text.count(c) for c in ".!?,;")
    return [
        f"shape:{min(8, int(math.log2(n + 1)))}{min(3, stops)}{text[-1] in '.!?:;'}",
        f"links:{0 if share == 0 else 1 if share < 0.5 else 2}",
        f"sign:{'©' in text or '»' in text}",
        f"cue:{_cue(text) if n < 60 else 'long'}",
    ]


class PageModel:
    """Potentials, and inference with them."""

    def __init__(self, pages: Iterator[tuple[list[Node], list[int]]]) -> None:
        seen: list[dict[str, int]] = [defaultdict(int), defaultdict(int)]
        groups: list[dict[str, int]] = [defaultdict(int), defaultdict(int)]
        steps: dict[str, list[list[int]]] = defaultdict(lambda: [[1, 1], [1, 1]])
        for nodes, states in pages:
            for i, state in enumerate(states):
                for what in observations(nodes, i):
                    seen[state][what] += 1
                    groups[state][what.partition(":")[0]] += 1
                if i:
                    steps[self._step(nodes, i)][states[nodes[i].parent]][state] += 1
        self.odds = {}
        for what in seen[0].keys() | seen[1].keys():
            group = what.partition(":")[0]
            self.odds[what] = ((seen[1][what] + 1) / (groups[1][group] + 20)) / ((seen[0][what] + 1) / (groups[0][group] + 20))
        self.steps = {k: [[row[0] / sum(row), row[1] / sum(row)] for row in rows] for k, rows in steps.items()}
        self.plain_step = self.steps.get("div", [[0.9, 0.1], [0.2, 0.8]])

    @staticmethod
    def _step(nodes: list[Node], i: int) -> str:
        """Kind of a child, and whether it stands at the top of its page."""
        node = nodes[i]
        return _KIND.get(node.name, "div") + "^" * (_KIND.get(nodes[node.parent].name) == "page")

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, given the whole page."""
        n = len(nodes)
        odds = self.odds.get
        # Likelihoods of a node's observations and of all below it, as (not content, content).
        own = [1.0] * n
        for i in range(1, n):
            x = 1.0
            for what in observations(nodes, i):
                x *= odds(what, 1.0)
            own[i] = min(max(x, 1e-12), 1e12)
        step = [self.steps.get(self._step(nodes, i), self.plain_step) for i in range(n)]
        up0, up1 = [1.0] * n, own[:]
        msg0, msg1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            (a, b), (c, d) = step[i]
            m0, m1 = a * up0[i] + b * up1[i], c * up0[i] + d * up1[i]
            top = m0 + m1
            m0, m1 = m0 / top, m1 / top
            msg0[i], msg1[i] = m0, m1
            p = nodes[i].parent
            u0, u1 = up0[p] * m0, up1[p] * m1
            top = u0 + u1
            up0[p], up1[p] = (u0 / top, u1 / top) if top > 0 else (0.5, 0.5)
        out = [0.0] * n
        down0, down1 = [1.0] * n, [0.0] * n  # the page as a whole is not content
        for i in range(n):
            if i:
                p = nodes[i].parent
                # The parent's belief without this child's message.
                q0 = down0[p] * up0[p] / max(msg0[i], 1e-300)
                q1 = down1[p] * up1[p] / max(msg1[i], 1e-300)
                (a, b), (c, d) = step[i]
                x, y = q0 * a + q1 * c, q0 * b + q1 * d
                top = x + y
                down0[i], down1[i] = (x / top, y / top) if top > 0 else (0.5, 0.5)
            b0, b1 = down0[i] * up0[i], down1[i] * up1[i]
            out[i] = b1 / (b0 + b1) if b0 + b1 > 0 else 0.0
        return out

    def text(self, html: str | None) -> str:
        """Main text of a page."""
        if not html:
            return ""
        nodes = parse(html)
        out: list[str] = []
        gap = False
        beliefs = self.marginals(nodes)
        most = max((b for node, b in zip(nodes, beliefs, strict=True) if node.name == "#text"), default=0.0)
        least = min(CONTENT, most / 2) if most >= LEAST else CONTENT
        for node, belief in zip(nodes, beliefs, strict=True):
            if node.name == "#text":
                gap = gap or not node.tight
                if belief >= least:
                    out += [" ", node.text] if gap and out else [node.text]
                    gap = False
        return "".join(out)


# Labelled pages ------------------------------------------------------------------------------

#: Names that page authors commonly give to parts of a page.
_GOOD = ("article content post entry story body text main blog single page news body-copy article-body post-content "
         "entry-content story-body main-content article-text markdown prose read hentry").split()
_BAD = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav site-nav main-menu pager pagination toc tabs".split(),
    "header": "header masthead site-header page-header topbar banner logo branding top".split(),
    "footer": "footer site-footer page-footer colophon copyright legal bottom credits".split(),
    "side": "sidebar aside rail widget related recommended trending popular side-bar secondary tags".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo ad-slot adbox banner-ad dfp promotion".split(),
    "note": "cookie cookies notice consent alert gdpr popup modal overlay cookie-banner newsletter subscribe signup disclaimer hidden".split(),
    "form": "form search login searchbox contact newsletter-form subscribe-form".split(),
    "talk": "comments comment comment-list reply replies discussion respond disqus comment-body thread feedback".split(),
    "share": "share social sharing social-links share-buttons follow author-bio byline meta".split(),
}
#: Names that say nothing of what part an element belongs to.
_PLAIN = "highlight term link caps lang emph ref nobr math inline keyword hl date name strong note-ref dropcap small x1 a".split()
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "side": ["aside", "div", "section"],
         "ad": ["div", "aside", "section"], "note": ["div", "section", "aside"], "form": ["form", "div"],
         "talk": ["section", "div", "ol"], "share": ["div", "ul"]}


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join("".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high)))


def _sentences(r: random.Random, low: int, high: int) -> str:
    return " ".join(_words(r, 4, 22).capitalize() + r.choice("...!?") for _ in range(r.randint(low, high)))


class _Maker:
    """Builds nodes with states."""

    def __init__(self, r: random.Random) -> None:
        self.r, self.nodes, self.states = r, [Node("#page", (), -1)], [0]

    def element(self, name: str, parent: int, state: int, label: str = "") -> int:
        words = tuple(w for w in label.replace("-", " ").split())
        self.nodes.append(Node(name, words, parent))
        self.states.append(state)
        return len(self.nodes) - 1

    def cued(self, part: str, text: str) -> str:
        """``text``, at times with a word that names its part."""
        words = _CUES.get(part)
        return f"{self.r.choice(words).capitalize()} {text}" if words and self.r.random() < 0.5 else text

    def prose(self, home: int, text: str, linked: float = 0.0) -> None:
        """A paragraph's text; at times with inline elements that are nodes, some of them not content."""
        r = self.r
        if r.random() > 0.2:
            self.run(home, 1, text, linked)
            return
        for _ in range(r.randint(1, 3)):
            self.run(home, 1, _words(r, 1, 12) + r.choice(["", "", "."]))
            if r.random() < 0.6:
                inner = self.element(r.choice(["span", "a", "em", "code", "sup", "mark", "time"]), home, 1, r.choice(_PLAIN))
                self.run(inner, 1, _words(r, 1, 5), r.choice([0, 0, 1]))
            else:
                inner = self.element(r.choice(["span", "a", "small", "ins"]), home, 0, r.choice([*_BAD["ad"], *_BAD["note"], *_BAD["share"], *["hidden"] * 30]))
                self.run(inner, 0, r.choice([_words(r, 1, 9), _sentences(r, 1, 2)]), r.choice([0, 0, 1]))
        self.run(home, 1, text, linked)

    def thread(self, parent: int) -> None:
        """Readers' remarks in elements without telling names."""
        r = self.r
        top = self.element(r.choice(["div", "section", "ul"]), parent, 0)
        self.run(self.element(r.choice(["h2", "h3", "h4", "div"]), top, 0), 0, self.cued("talk", _words(r, 0, 2)) or _words(r, 1, 2))
        for _ in range(r.randint(1, 6)):
            one = self.element(r.choice(["div", "li"]), top, 0)
            self.run(self.element(r.choice(["div", "p"]), one, 0), 0, _words(r, 1, 4), r.choice([0, 1, 1]))
            for _ in range(r.randint(1, 2)):
                self.run(self.element(r.choice(["p", "div"]), one, 0), 0, _sentences(r, 1, 4))

    def run(self, parent: int, state: int, text: str, linked: float = 0.0) -> None:
        self.element("#text", parent, state)
        self.nodes[-1].text, self.nodes[-1].linked = text, int(linked * len(text))

    def junk(self, part: str, parent: int, depth: int = 0) -> None:
        r = self.r
        name = r.choice(_TAGS[part])
        semantic = name in ("nav", "header", "footer", "aside", "form")
        top = self.element(name, parent, 0, r.choice(_BAD[part]) if not semantic or r.random() < 0.5 else "")
        if part in ("nav", "share") or part == "side" and r.random() < 0.6 or part == "footer" and r.random() < 0.4:
            if part == "side" and r.random() < 0.7:
                self.run(self.element(r.choice(["h2", "h3", "h4"]), top, 0), 0, self.cued("side", _words(r, 1, 3)))
            items = top if name in ("ul", "ol") else self.element("ul", top, 0) if r.random() < 0.7 else top
            for _ in range(r.randint(2, 9)):
                self.run(self.element("li", items, 0) if items != top or name in ("ul", "ol") else top, 0, _words(r, 1, 5), r.choice([1, 1, 1, 0.8]))
        elif part == "talk":
            if r.random() < 0.7:
                self.run(self.element(r.choice(["h2", "h3", "h4"]), top, 0), 0, self.cued("talk", _words(r, 1, 3)))
            for _ in range(r.randint(1, 5)):
                one = self.element(r.choice(["div", "li", "article"]), top, 0, r.choice(_BAD["talk"] + [""]))
                if r.random() < 0.6:
                    self.run(self.element("div", one, 0, r.choice(["author", "meta", "user"])), 0, _words(r, 1, 4), r.choice([0, 1]))
                for _ in range(r.randint(1, 2)):
                    self.run(self.element(r.choice(["p", "div"]), one, 0), 0, _sentences(r, 1, 4))
        elif part == "form":
            for _ in range(r.randint(1, 4)):
                self.run(self.element(r.choice(["label", "button", "fieldset", "p", "div"]), top, 0), 0, _words(r, 1, 5))
        elif part == "header":
            self.run(self.element(r.choice(["h1", "div", "p", "h2"]), top, 0, r.choice(["logo", "title", "", "tagline"])), 0, _words(r, 1, 5), r.choice([0, 1]))
            if r.random() < 0.5 and not depth:
                self.junk("nav", top, 1)
            if r.random() < 0.3:
                self.run(self.element("p", top, 0, "tagline"), 0, _words(r, 2, 8))
        else:
            for _ in range(r.randint(1, 3)):
                home = top if r.random() < 0.6 else self.element(r.choice(["p", "div"]), top, 0)
                text = r.choice([_words(r, 1, 8), _sentences(r, 1, 2), _sentences(r, 1, 1)])
                self.run(home, 0, ("© " if part == "footer" and r.random() < 0.6 else "") + self.cued(part, text), r.choice([0, 0, 0, 0.4, 1]))

    def article(self, home: int) -> None:
        r = self.r
        if r.random() < 0.8:
            at = self.element("header", home, 1) if r.random() < 0.15 else home
            self.run(self.element("h1", at, 1), 1, _words(r, 2, 14).capitalize() + r.choice(["", "", "."]))
        for _ in range(r.randint(1, 9)):
            roll = r.random()
            if roll < 0.6:
                self.prose(self.element("p", home, 1), _sentences(r, 1, 6), r.choice([0, 0, 0, 0, 0.1, 0.3]))
            elif roll < 0.66:
                self.run(self.element("p", home, 1), 1, _words(r, 5, 120))
            elif roll < 0.72:
                self.run(self.element("p", home, 1), 1, _words(r, 1, 8) + r.choice([".", "", ":"]), r.choice([0, 0, 1]))
            elif roll < 0.80:
                self.run(self.element(r.choice(["h2", "h3", "h4"]), home, 1), 1, _words(r, 1, 8).capitalize())
            elif roll < 0.88:
                items = self.element(r.choice(["ul", "ol"]), home, 1)
                for _ in range(r.randint(2, 5)):
                    self.run(self.element("li", items, 1), 1, r.choice([_words(r, 1, 8), _sentences(r, 1, 2)]))
            elif roll < 0.92:
                self.run(self.element(r.choice(["blockquote", "pre", "figcaption"]), home, 1), 1, _sentences(r, 1, 3))
            elif roll < 0.95:
                rows = self.element("tr", self.element("table", home, 1), 1)
                for _ in range(r.randint(2, 5)):
                    self.run(self.element(r.choice(["td", "th"]), rows, 1), 1, _words(r, 1, 4))
            elif roll < 0.96:
                self.prose(self.element("noscript", home, 1), _sentences(r, 1, 3))
            elif roll < 0.98:
                self.prose(home, _sentences(r, 1, 4))
            else:
                self.junk(r.choice(["ad", "share", "side", "note"]), home)

    def page(self) -> tuple[list[Node], list[int]]:
        r = self.r
        body = self.element("body", self.element("html", 0, 0), 0)
        at = self.element("div", body, 0, r.choice(["", "wrapper", "container", "page"])) if r.random() < 0.4 else body
        before = [p for p in ("note", "header", "nav", "ad", "form") if r.random() < 0.45]
        after = [p for p in ("ad", "side", "talk", "share", "form", "note", "footer") if r.random() < 0.45]
        r.shuffle(before)
        for part in before:
            self.junk(part, at)
        outer = at
        if r.random() < 0.5:
            outer = self.element(r.choice(["main", "div", "section"]), at, 0, r.choice(["", "", "main", "container", "row"]))
            if r.random() < 0.3:
                self.junk(r.choice(["nav", "side", "ad"]), outer)
        style = r.random()
        if style < 0.08:
            home = outer  # no element of its own: its parts stand among the others
            self.states[home] = int(outer != at)
        elif style < 0.45:
            home = self.element("article", outer, 1, r.choice(["", "", *_GOOD]))
        elif style < 0.55:
            home = self.element("main", outer, 1, r.choice(["", *_GOOD]))
        else:
            home = self.element(r.choice(["div", "div", "section", "td"]), outer, 1, r.choice(_GOOD) if r.random() < 0.6 else "")
        if r.random() < 0.25:
            home = self.element("div", home, 1, r.choice(["", *_GOOD]))
        self.article(home)
        for part in after:
            if part == "talk" and r.random() < 0.4:
                self.thread(outer if r.random() < 0.3 else at)
            else:
                self.junk(part, outer if r.random() < 0.3 else at)
        if r.random() < 0.15:
            self.run(self.element("noscript", at, 0), 0, self.cued("note", _sentences(r, 1, 1)))
        return self.nodes, self.states


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> Iterator[tuple[list[Node], list[int]]]:
    """Trees with a state for each node: 1 is content."""
    r = random.Random(seed)
    for _ in range(pages):
        yield _Maker(r).page()


_models: dict[tuple[int, int], PageModel] = {}


def page_model(pages: int = PAGES, seed: int = SEED) -> PageModel:
    """The trained model, made once in each process."""
    if (pages, seed) not in _models:
        _models[pages, seed] = PageModel(labelled_pages(pages, seed))
    return _models[pages, seed]


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row."""
    ship(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(page_model())

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.value
        for htmls in batches:
            yield pd.Series([own.text(x) for x in htmls], dtype=object)

    out = pick(pages, "page_id", "url", "html").select("page_id", "url", main_text("html").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
