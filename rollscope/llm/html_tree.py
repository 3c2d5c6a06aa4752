"""A page as a tree of block elements and the runs of text between their borders."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text a reader of the page never sees as text.
UNSEEN = frozenset("script style title template noscript noframes svg iframe object applet canvas audio video select datalist "
                   "textarea button".split())
BLOCKS = ("html head body main article section div header footer nav aside form fieldset legend dialog details summary h1 h2 h3 h4 h5 h6 "
          "p pre blockquote address center ul ol menu dir li dl dt dd figure figcaption table caption thead tbody tfoot tr td th "
          "hr hgroup search").split()
TAGS = {t: i for i, t in enumerate(BLOCKS)}
# A start tag ends open elements of the named kinds, as far up as one of the stops.
P_END = frozenset(BLOCKS) - frozenset("html head body tr td th thead tbody tfoot caption".split())
ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
        "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
        "tbody": ("thead tbody tfoot tr td th", ("table",)), "thead": ("thead tbody tfoot tr td th", ("table",)),
        "tfoot": ("thead tbody tfoot tr td th", ("table",)), "body": ("head", ("html",))}
ENDS = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in ENDS.items()}
P_STOP = frozenset("table td th caption button object html body".split())

# What names of classes, ids and roles hint at; a bit each, in this order.
CUES = ("nav", "head", "foot", "side", "ad", "notice", "comment", "social", "form", "body", "hidden")
CUE_WORDS = [re.compile(p) for p in (
    r"nav|menu|crumb|paginat|pager|toolbar|tabs?$|toc$|skip$|links?$", r"header|masthead|topbar|logo|brand|hero$|tagline",
    r"foot|copyright|colophon|legal|imprint|credits?$", r"side|aside|widget|rail$|relat|recommend|popular|trending|teaser|more$|complementary",
    r"ads?$|advert|sponsor|promo|banner|adsense|dfp|outbrain|taboola|commercial", r"cookie|consent|gdpr|notice|notif|alert|popup|modal|overlay|paywall|"
    r"newsletter|subscri|signup|toast|warning|message$|disclaim", r"comment|disqus|repl(?:y|ies)|respond|discuss|feedback|guestbook|review",
    r"share|sharing|social|follow|likes?$|tweet", r"form|search|login|signin|register|contact$|survey|poll$",
    r"article|content|post$|entry|main|story|text$|body|prose")]
HIDDEN = 1 << (len(CUES) - 1)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=1 << 14)
def cues(names: str) -> int:
    found = 0
    for word in {w.lower() for w in WORDS.findall(names)}:
        for i, p in enumerate(CUE_WORDS):
            if p.match(word) if i == 4 else p.search(word):
                found |= 1 << i
    return found


# An element's own name hints like a class name, but for the outermost ones.
TAG_CUES = {t: 0 if t in ("html", "head", "body", "thead", "tfoot", "tbody") else cues(t) for t in BLOCKS}


class Tree(HTMLParser):
    """Nodes in page order: parent, tag number (-1 for a run), cue bits, and of runs the text, the characters in links and the mark."""

    def __init__(self, mark: str | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.mark = mark
        self.parent, self.tag, self.cue, self.depth = [-1], [TAGS["html"]], [0], [0]
        self.text: list[str] = [""]
        self.linked, self.marked = [0], [0]
        # Open elements: name, node (of the nearest block), mark.
        self.open: list[tuple[str, int, int]] = [("", 0, 0)]
        self.inside: dict[str, int] = {}
        self.unseen = 0
        self.links = 0
        self.buffer: list[str] = []
        self.buffer_linked = 0

    def node(self, parent: int, tag: int, cue: int, text: str, linked: int, mark: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.cue.append(cue)
        self.depth.append(self.depth[parent] + 1)
        self.text.append(text)
        self.linked.append(linked)
        self.marked.append(mark)
        return len(self.parent) - 1

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.node(self.open[-1][1], -1, 0, text, min(self.buffer_linked, len(text)), self.open[-1][2])
            self.buffer, self.buffer_linked = [], 0

    def pop(self) -> None:
        name = self.open.pop()[0]
        self.inside[name] -= 1
        if name in UNSEEN:
            self.unseen -= 1
        elif name == "a":
            self.links -= 1

    def end(self, names, stops) -> None:
        """Close the nearest open element of these names, and all in it, unless a stop is nearer."""
        if not any(self.inside.get(n) for n in names):
            return
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name in names:
                self.flush()
                while len(self.open) > at:
                    self.pop()
                return
            if name in stops:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.buffer.append(" ")
            return
        if not self.unseen:
            if tag in P_END:
                self.end(("p",), P_STOP)
                if tag[0] == "h" and tag[1:].isdigit() and self.open[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    self.end((self.open[-1][0],), ())
            if tag in ENDS:
                self.end(*ENDS[tag])
            elif self.inside.get("head") and tag in TAGS and tag != "head":
                self.end(("head",), ())
        block = tag in TAGS
        if block:
            self.flush()
        if tag in VOID or tag == "html":
            return
        _, node, mark = self.open[-1]
        if block and not self.unseen:
            cue = TAG_CUES[tag]
            for k, v in attrs:
                if k in ("class", "id", "role"):
                    cue |= cues(v) if v else 0
                elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "")):
                    cue |= HIDDEN
                elif k == self.mark:
                    mark = int(v)
            node = self.node(node, TAGS[tag], cue, "", 0, mark)
        self.open.append((tag, node, mark))
        self.inside[tag] = self.inside.get(tag, 0) + 1
        if tag in UNSEEN:
            self.unseen += 1
        elif tag == "a":
            self.links += 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        # A slash closes nothing in HTML, but for foreign elements, which are unseen.
        if not (self.inside.get("svg") or tag == "svg"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.inside.get(tag):
            if tag in TAGS and not self.unseen:
                self.flush()
            return
        if tag in ("body", "html"):
            self.flush()
            return
        if self.unseen and tag not in UNSEEN:
            return
        # Inline elements do not reach across a block, and nothing but a table part out of a cell.
        stops = () if tag in UNSEEN or tag in ("table", "tr", "tbody", "thead", "tfoot") else ("td", "th") if tag in TAGS else TAGS
        self.end((tag,), stops) if tag in TAGS or tag in UNSEEN else self.end_inline(tag, stops)

    def end_inline(self, tag: str, stops) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name == tag:
                while len(self.open) > at:
                    self.pop()
                return
            if name in stops:
                return

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        self.buffer.append(data)
        if self.links:
            self.buffer_linked += len(data)

    def finish(self) -> Tree:
        self.close()
        self.flush()
        return self


def parse(html: str, mark: str | None = None) -> Tree:
    """Tree of a page. `mark` names an attribute whose 0 or 1 labels an element's text, for training."""
    tree = Tree(mark)
    tree.feed(html)
    return tree.finish()
