"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements and runs of text are the nodes of a tree.  Each node is in one
of three states: boilerplate, content, or frame (an element that holds both).
Potentials of a parent and its child and of a node's features are estimated by
counting on labelled pages; sum-product messages go from the leaves to the root
and back, and give each run of text its exact marginal.  Runs that are content
with a probability over a half make the text.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BOILERPLATE, CONTENT, FRAME = 0, 1, 2

# Element names by their role in a page.
BLOCKS = frozenset(
    "html body div section article main nav header footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address fieldset legend hr details summary menu dialog center hgroup search".split()
)
RAW = frozenset("script style noscript template iframe svg math object embed canvas audio video select textarea title head button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element whose start ends the open element of the same row, within the named scope.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
#: Words in class, id, role and label attributes, by what they tell.
HINTS = {
    "ad": "ad ads adv advert advertisement advertising adsense banner promo promoted promotion sponsor sponsored sponsors dfp outbrain taboola",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip topbar tabs navi",
    "page": "header head masthead footer foot bottom colophon copyright site-header site-footer contentinfo legal banner-top logo",
    "side": "sidebar side aside widget widgets related recommended recommendations more trending popular tags tag share sharing social toolbar complementary",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay subscribe subscription newsletter signup paywall disclaimer warning",
    "talk": "comment comments commentlist disqus discussion reply replies respond reviews responses",
    "form": "form search login signin register contact feedback poll survey",
    "text": "article content post entry story body text main prose page-content post-content entry-content article-body single blog-post hentry copy",
}
_HINT = {word: name for name, words in HINTS.items() for word in words.split()}
_CLAIM = re.compile(r"©|\(c\)|\ball rights reserved\b|\bcookies?\b|\bsubscribe\b|\bnewsletter\b|\bsign (?:in|up)\b|\blog ?in\b|\badvert|\bsponsored\b|\bprivacy\b|\bread more\b|\bshare\b|\brepl(?:y|ies)\b|\bcomments?\b", re.I)
#: Attributes: a quote counts after an equals sign only.
_REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+"
_TAG = re.compile(rf"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)({_REST})(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'][^\s]*)))?")
_NAMES = frozenset("class id role aria-label data-y".split())
_WORD = re.compile(r"[^\s_]+")
_SPACE = re.compile(r"\s+")


class Page:
    """The tree: for each node its parent, name, attributes, and a leaf's text and linked characters."""

    def __init__(self, source: str, labelled: bool = False):
        self.parent: list[int] = [-1]
        self.name: list[str] = ["#root"]
        self.hints: list[str] = [""]
        self.text: list[str | None] = [None]
        self.linked: list[float] = [0.0]
        self.label: list[int | None] = [None]
        self.labelled = labelled
        self._parse(source)

    def _node(self, parent: int, name: str, attributes: str = "", text: str | None = None, linked: float = 0.0) -> int:
        found: dict[str, str] = {}
        if "=" in attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                if m[1].lower() in _NAMES:
                    found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", " ".join(v for k, v in found.items() if k != "data-y")).lower())
        hints = sorted({_HINT[w] for w in words if w in _HINT})
        self.parent.append(parent)
        self.name.append(name)
        self.hints.append("+".join(hints))
        self.text.append(text)
        self.linked.append(linked)
        self.label.append(int(found["data-y"]) if self.labelled and "data-y" in found else None)
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        """One pass over the source; open elements are found by name, so that depth costs nothing."""
        stack, run, in_link, links, at = [0], [], 0, 0, 0
        places: dict[str, list[int]] = defaultdict(list)  # of the open elements in the stack, by name
        unclosed: set[str] = set()  # elements that nothing further on closes

        def flush() -> None:
            nonlocal links
            if run:
                text = "".join(run)
                text = _SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
                if text:
                    self._node(stack[-1], "#text", "", text, min(1.0, links / len(text)))
                run.clear()
                links = 0

        def close(place: int) -> None:
            for k in stack[place:]:
                places[self.name[k]].pop()
            del stack[place:]

        def after(name: str, pattern: str) -> re.Match | None:
            found = re.compile(pattern, re.I).search(source, at) if name not in unclosed else None
            if not found:
                unclosed.add(name)
            return found

        while at < len(source):
            match = _TAG.search(source, at)
            piece = source[at : match.start() if match else len(source)]
            if piece:
                run.append(piece)
                links += len(piece) if in_link else 0
            if not match:
                break
            at = match.end()
            name = (match[2] or "").lower()
            if not name:
                continue
            if match[1]:
                if name == "a":
                    in_link = 0
                elif places[name]:
                    flush()
                    close(places[name][-1])
                    in_link = 0
                continue
            if name in RAW:
                if not match[3].endswith("/") or name in ("script", "style", "title", "textarea"):
                    end = after(name, rf"</{name}\b[^>]*(?:>|\Z)")
                    if end:
                        at = end.end()
                    elif name == "head":
                        body = after("#body", r"<body\b")
                        at = body.start() if body else at
                    elif name in ("script", "style", "textarea", "title"):
                        at = len(source)
                run.append(" ")
                continue
            if name == "br":
                run.append(" ")
            elif name == "a":
                in_link = 1
            elif name in BLOCKS:
                flush()
                in_link = 0
                if self.name[stack[-1]] == "p":
                    close(len(stack) - 1)
                ends, scope = CLOSES.get(name, ((), ()))
                if ends:
                    low = max((places[x][-1] for x in scope if places[x]), default=0)
                    own = [places[x][k] for x in ends for k in [bisect_right(places[x], low)] if k < len(places[x])]
                    if own:
                        close(min(own))
                if name != "hr":
                    places[name].append(len(stack))
                    stack.append(self._node(stack[-1], name, match[3]))
        flush()

    def features(self) -> list[tuple]:
        """What the model sees of each node."""
        out = []
        for k, name in enumerate(self.name):
            text = self.text[k]
            if text is None:
                out.append((("tag", name), ("hint", self.hints[k] or "-")))
                continue
            n = len(text)
            size = 0 if n < 15 else 1 if n < 40 else 2 if n < 90 else 3 if n < 250 else 4
            link = self.linked[k]
            links = 0 if link == 0 else 1 if link < 0.34 else 2 if link < 0.8 else 3
            out.append((("in", self.name[self.parent[k]]), ("size", size), ("links", links), ("stop", text[-1] in ".!?…:;\"”»"), ("claim", bool(_CLAIM.search(text)) and n < 250)))
        return out


class Model:
    """Potentials of parent, child and the child's features, from counts on labelled pages.

    psi(above, state, features) = P(state | above, features) * P(features | above) ** UP.
    What children tell about their parent is tempered, since the features of
    brothers repeat each other and would count many times over.
    """

    UP = 0.4

    def __init__(self, pages: list[str], smooth: float = 0.05):
        step = np.full((3, 3), smooth)
        seen: dict[str, dict] = defaultdict(lambda: defaultdict(lambda: np.zeros((3, 3))))
        for source in pages:
            page = Page(source, labelled=True)
            state = []
            for k, (label, feats) in enumerate(zip(page.label, page.features())):
                above = state[page.parent[k]] if k else FRAME
                if label is None:  # a leaf of a frame is boilerplate; anything else is what holds it
                    label = above if page.text[k] is None or above != FRAME else BOILERPLATE
                state.append(label)
                if k:
                    step[above, label] += 1
                    for kind, value in feats:
                        seen[kind][value][above, label] += 1
        self.step = step / step.sum(axis=1, keepdims=True)
        self.tables = {}
        for kind, values in seen.items():
            total = sum(values.values()) + smooth * (len(values) + 1)
            self.tables[kind] = ({v: (c + smooth) / total for v, c in values.items()}, smooth / total)
        self.cache: dict[tuple, tuple] = {}

    def potential(self, feats: tuple) -> tuple:
        """psi for a child with these features, as nine numbers by parent and child state."""
        got = self.cache.get(feats)
        if got is None:
            value = self.step
            for kind, name in feats:
                table, unseen = self.tables[kind]
                value = value * table.get(name, unseen)
            evidence = value.sum(axis=1, keepdims=True)
            value = value / evidence * (evidence / evidence.max()) ** self.UP
            got = self.cache[feats] = tuple(value.ravel().tolist())
        return got

    def marginals(self, page: Page) -> list[tuple[float, float, float]]:
        """Sum-product over the tree: each node's state probabilities. The root is a frame."""
        parent, n = page.parent, len(page.parent)
        psi = [self.potential(x) for x in page.features()]
        belief = [[1.0, 1.0, 1.0] for _ in range(n)]
        up: list[tuple] = [(1.0, 1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):  # a child comes after its parent
            x, y, z = belief[k]
            a, b, c, d, e, f, g, h, i = psi[k]
            p, q, r = a * x + b * y + c * z, d * x + e * y + f * z, g * x + h * y + i * z
            s = p + q + r
            up[k] = p, q, r = p / s + 1e-12, q / s + 1e-12, r / s + 1e-12
            own = belief[parent[k]]
            x, y, z = own[0] * p, own[1] * q, own[2] * r
            s = x + y + z
            own[0], own[1], own[2] = x / s, y / s, z / s
        out: list[tuple] = [(0.0, 0.0, 1.0)]
        for k in range(1, n):
            x, y, z = belief[k]
            a, b, c, d, e, f, g, h, i = psi[k]
            (p, q, r), m = out[parent[k]], up[k]
            u, v, w = p / m[0], q / m[1], r / m[2]
            x, y, z = x * (u * a + v * d + w * g), y * (u * b + v * e + w * h), z * (u * c + v * f + w * i)
            s = x + y + z
            out.append((x / s, y / s, z / s))
        return out

    def text(self, source: str) -> str:
        """The main text of a page."""
        page = Page(source)
        if not any(page.text):
            return ""
        marginals = self.marginals(page)
        return " ".join(t for t, m in zip(page.text, marginals) if t and m[CONTENT] > 0.5)


#: Names of elements in the labelled pages that tell nothing of their role.
PLAIN_NAMES = "col col-8 col-md-9 row wrap wrapper inner outer box block grid cell panel pane area zone part unit item card module region layer container page site left right center l-1 css-1x2y"


def labelled_pages(n: int = 900, seed: int = 3, plain_names: str = PLAIN_NAMES) -> list[str]:
    """Pages with their states in ``data-y``, drawn from the ways in which sites lay pages out.

    The article is an element of that name, one with a name that says so, a
    ``main``, elements with names that tell nothing, or stands in the body
    itself; some names mislead, and some of what isn't the article has none.
    """
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p
    words = [pick("bcdfghlmnprstv") + pick("aeiou") + pick(["", "n", "r", "st", "la", "me"]) for _ in range(400)]

    def sentence(low: int, high: int) -> str:
        return " ".join(pick(words) for _ in range(rng.randint(low, high))).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def heading(high: int) -> str:
        text = sentence(1, high)
        return text if chance(0.4) else text.rstrip(".!?") + pick(["", "", "", ",", " -"])

    def prose() -> str:
        return " ".join(sentence(1, 24) for _ in range(pick([1, 1, 1, 2, 4, 8, 14])))

    def tag(name: str, y: int | None, body: str, attributes: str = "") -> str:
        label = f' data-y="{y}"' if y is not None else ""
        close = "" if name in ("p", "li") and chance(0.15) else f"</{name}>"
        return f"<{name}{label}{' ' + attributes if attributes else ''}>{body}{close}"

    def links(k: int) -> str:
        return tag("ul", None, "".join(tag("li", None, f'<a href="/{pick(words)}">{pick(words)}</a>') for _ in range(k)))

    def plain() -> str:
        name = pick([pick(plain_names.split()), pick(words), f"{pick(words)}-{rng.randint(1, 12)}", f"{pick(plain_names.split())} {pick(words)}"])
        return pick(["", f'class="{name}"', f'class="{name}"', f'id="{name}"'])

    def named(name: str, *hints: str) -> tuple[str, str]:
        if hints[0] in ("nav", "page", "form", "talk") and chance(0.12):
            return name, plain()
        word = pick(" ".join(HINTS[h] for h in hints).split())
        return name, pick([f'class="{word}"', f'id="{word}"', f'class="{word} {pick(words)}"', f'class="{pick(words)}-{word}"'])

    def menu() -> str:
        if chance(0.6):
            return tag("nav", 0, links(rng.randint(2, 8)) if chance(0.7) else " ".join(f'<a href="/x">{pick(words)}</a>' for _ in range(5)))
        name, attributes = named("div", "nav")
        return tag(name, 0, links(rng.randint(2, 8)), attributes)

    def header() -> str:
        body = pick([tag("h1", None, sentence(1, 3)), tag("p", None, sentence(2, 6)), menu(), tag("div", None, pick(words).title())])
        return tag("header", 0, body + (menu() if chance(0.3) else "")) if chance(0.6) else tag("div", 0, body, named("div", "page")[1])

    def footer() -> str:
        body = pick(["&copy; " + sentence(2, 8), tag("p", None, "© 2020 " + sentence(2, 6) + " All rights reserved."), links(4) + sentence(3, 9), sentence(3, 12) + " " + sentence(1, 8)])
        return tag("footer", 0, body) if chance(0.75) else tag("div", 0, body, named("div", "page")[1])

    def side() -> str:
        body = tag("h3", None, sentence(1, 3)) + pick([links(rng.randint(2, 6)), tag("p", None, prose()), prose()])
        return tag("aside", 0, body, pick(["", named("", "side")[1]])) if chance(0.6) else tag("div", 0, body, named("div", "side")[1])

    def advert() -> str:
        body = pick([sentence(2, 12), tag("p", None, sentence(3, 15)), f'<a href="/b">{sentence(2, 6)}</a>', prose()])
        return tag(pick(["div", "div", "section", "p", "aside"]), 0, body, named("div", "ad")[1])

    def notice() -> str:
        body = pick([sentence(3, 14), tag("p", None, sentence(3, 14)), tag("p", None, "We use cookies. " + sentence(2, 9)), tag("p", None, "Subscribe to our newsletter. " + sentence(1, 7)), prose()])
        return tag(pick(["div", "div", "section", "p"]), 0, body, named("div", "notice")[1])

    def form() -> str:
        body = pick([sentence(1, 5), tag("p", None, sentence(2, 9)), f"<label>{sentence(1, 3)}</label><input name=q>"])
        return tag("form", 0, body, pick(["", 'action="/s"'])) if chance(0.75) else tag("div", 0, body, named("div", "form")[1])

    def comments() -> str:
        each = [pick([tag("p", None, prose()), tag("div", None, tag("p", None, prose()), named("div", "talk")[1]), tag("li", None, prose()), tag("article", None, tag("p", None, prose()), 'class="comment"')]) for _ in range(rng.randint(1, 6))]
        body = (tag("h2", None, pick(["Comments", sentence(1, 4)])) if chance(0.6) else "") + "".join(each) + (form() if chance(0.3) else "")
        return tag(pick(["div", "section", "section", "ol"]), 0, body, named("div", "talk")[1])

    def paragraph() -> str:
        body = prose()
        if chance(0.2):
            body += f' <a href="/y">{pick(words)} {pick(words)}</a> ' + sentence(2, 9)
        return tag("p", None, ("<b>" if chance(0.1) else "") + body)

    def item() -> str:
        if chance(0.25):
            return tag("li", None, f'<a href="/z">{sentence(1, 9)}</a>' + (" " + sentence(1, 9) if chance(0.4) else ""))
        return tag("li", None, sentence(1, 20))

    def piece() -> str:
        made = kind_of_piece()
        if chance(0.06):  # a name that misleads, or an element that tells nothing
            inside = pick([made, made + paragraph()])
            return tag(pick(["div", "section"]), None, inside, pick([plain(), named("div", pick([h for h in HINTS if h != "text"]))[1]]))
        return made

    def kind_of_piece() -> str:
        return pick([
            paragraph, paragraph, paragraph, paragraph, paragraph, paragraph, lambda: tag(pick(["h2", "h3", "h4"]), None, heading(8)),
            lambda: tag(pick(["ul", "ol"]), None, "".join(item() for _ in range(rng.randint(1, 6)))),
            lambda: tag("blockquote", None, pick([prose(), paragraph()])), lambda: tag("pre", None, sentence(3, 20)),
            lambda: tag("table", None, "".join(tag("tr", None, "".join(tag("td", None, sentence(1, 4)) for _ in range(3))) for _ in range(3))),
            lambda: tag("figure", None, "<img src=x>" + tag("figcaption", None, sentence(2, 12))), lambda: tag("div", None, prose()), lambda: tag("section", None, paragraph() + paragraph()),
            lambda: tag("dl", None, tag("dt", None, sentence(1, 3)) + tag("dd", None, sentence(3, 12))),
        ])()

    def article() -> str:
        title = tag("h1", None, heading(14)) if chance(0.85) else ""
        if title and chance(0.2):
            title = tag("header", 1, title + (tag("p", None, sentence(2, 8)) if chance(0.5) else ""))
        body = [piece() if chance(0.6) else paragraph() for _ in range(rng.randint(1, 14))]
        for extra, p in ((advert, 0.2), (side, 0.15), (form, 0.1), (notice, 0.1), (comments, 0.08)):
            if chance(p):
                body.insert(rng.randint(0, len(body)), extra())
        inner = title + "".join(body)
        way = rng.random()
        if way < 0.1:  # in the body itself
            return "".join(re.sub(r"^<(\w+)(?! data-y)", r'<\1 data-y="1"', x) for x in ([title] if title else []) + body)
        if chance(0.25):
            inner = tag("div", 1, inner, pick([plain(), named("div", "text")[1]]))
        if way < 0.22:
            return tag("main", 1, inner, plain())
        if way < 0.4:
            inner = tag("div", 1, inner, plain())
            for _ in range(pick([0, 1, 1, 2])):
                inner = tag(pick(["div", "div", "section", "main"]), pick([1, 2]), inner, plain())
            return inner
        if way < 0.75:
            return tag("article", 1, inner, pick(["", "", plain(), named("", "text")[1]]))
        return tag(pick(["div", "div", "section", "main"]), 1, inner, named("div", "text")[1])

    out = []
    for _ in range(n):
        before = [p() for p, q in ((header, 0.6), (menu, 0.6), (notice, 0.3), (advert, 0.35), (form, 0.15), (side, 0.1)) if chance(q)]
        after = [p() for p, q in ((side, 0.35), (comments, 0.4), (advert, 0.25), (form, 0.15), (notice, 0.15)) if chance(q)]
        rng.shuffle(before)
        rng.shuffle(after)
        middle, foot = article() if chance(0.97) else "", footer() if chance(0.8) else ""
        if chance(0.3):
            inside = chance(0.5)
            middle = tag(pick(["main", "div"]), 2, middle + ("".join(after) if inside else ""), plain())
            for _ in range(pick([0, 0, 1, 3])):
                middle = tag("div", 2, middle, plain())
            after = [] if inside else after
        body = "".join(before) + middle + "".join(after) + foot
        for _ in range(pick([0, 0, 0, 0, 1, 2, 4])):
            body = tag("div", 2, body, plain())
        out.append(f'<!DOCTYPE html><html data-y="2"><head><title>x</title></head><body data-y="2">{body}{pick(["", "</body></html>"])}')
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model, the same in every process."""
    return Model(labelled_pages())


def extract_text(source: str | None) -> str:
    """The main text of one page; null and empty sources have none."""
    return trained().text(source) if source else ""


def extract(pages: DataFrame, *, html_col: str = "html", key_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the key columns and text.

    Whole sources are read.  Runs of text are in page order, joined by one
    space; character references are decoded and white space inside a run is
    one space.  A page without content, null or empty has the empty text.
    Keys may be null or repeat; other columns play no part.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([extract_text(x.as_py()) for x in batch.column(len(key_cols))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key_cols)], text], names=[*key_cols, "text"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key_cols) + ", text string"
    return pages.select(*key_cols, F.col(html_col)).mapInArrow(run, schema)
