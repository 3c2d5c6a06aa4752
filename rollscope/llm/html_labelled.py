"""Labelled training pages for the content model.

Pages are composed from a seed: layouts of semantic elements, of named and of unnamed divs, of table cells and of blog themes, with
menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and inside the article. Elements carry the
attribute `data-main`, 1 for the article's text and 0 for the rest; the label of a text is that of its nearest marked ancestor.
"""

from __future__ import annotations

import random

MARK = "data-main"
SYLLABLES = "ka lo ren ti mas u ven dor el pi sta go mer an ish ou bra net fi cul".split()
NAMES = {
    "nav": ["nav", "main-menu", "navbar", "breadcrumbs", "menu primary", "pagination"], "head": ["header", "site-header", "masthead", "topbar", "branding"],
    "foot": ["footer", "site-footer", "bottom copyright", "colophon"], "side": ["sidebar", "aside", "widget-area", "right-rail", "related", "recommended"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo-box", "ad-slot banner"], "notice": ["cookie-notice", "consent", "gdpr-banner", "alert", "newsletter", "popup modal"],
    "comment": ["comments", "comment-list", "disqus_thread", "discussion", "replies"], "social": ["share", "social-links", "sharing"],
    "form": ["search-form", "login", "contact-form", "subscribe-form"], "main": ["content", "article", "post", "entry-content", "main", "story-body", "text"],
    "wrap": ["wrapper", "page", "container", "row", "outer", "site"]}
LAYOUTS = ("semantic", "divs", "plain", "semantic", "hashed", "table", "semantic", "blog")


class Page:
    def __init__(self, seed: int, layout: str) -> None:
        self.r = random.Random(seed)
        self.layout = layout
        self.cjk = self.r.random() < 0.1
        # What ends a sentence of the article, and of the rest, on this page.
        self.ends = self.r.choice(["...?!", "...?!", "....", [" |", ""], ["", "."]])

    def words(self, lo: int, hi: int) -> str:
        n = self.r.randint(lo, hi)
        if self.cjk:
            return "".join(chr(self.r.randint(0x4E00, 0x9000)) for _ in range(2 * n))
        return " ".join("".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n))

    def sentences(self, lo: int, hi: int) -> str:
        out = []
        for _ in range(self.r.randint(lo, hi)):
            s = self.words(1, 18)
            if self.r.random() < 0.3:
                s += ", " + self.words(2, 9)
            out.append(s[:1].upper() + s[1:] + self.r.choice(self.ends if not self.cjk else "。。!"))
        return " ".join(out)

    def link(self, lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 99)}">{self.words(lo, hi).capitalize()}</a>'

    def names(self, kind: str) -> str:
        if self.layout == "hashed":
            return f' class="css-{self.r.randrange(16 ** 6):06x}"'
        if self.layout in ("plain", "table") or self.r.random() < (0.5 if self.layout == "semantic" else 0.15):
            return ""
        return f' {self.r.choice(("class", "id"))}="{self.r.choice(NAMES[kind])}"'

    def box(self, kind: str, tag: str, inner: str, main: int = 0) -> str:
        if self.layout not in ("semantic", "blog") or self.r.random() < 0.1:
            tag = "div" if tag in ("nav", "header", "footer", "aside", "section", "main", "article", "form") and not (
                tag == "form" and self.r.random() < 0.8) else tag
        return f'<{tag}{self.names(kind)} {MARK}="{main}">{inner}</{tag}>'

    # The parts around the article.
    def nav(self) -> str:
        items = [self.link() for _ in range(self.r.randint(2, 12))]
        inner = self.r.choice([lambda: "<ul><li>" + "</li><li>".join(items) + "</li></ul>", lambda: "<ul><li>" + "<li>".join(items) + "</ul>",
                               lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)])()
        return self.box("nav", "nav", inner)

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<a href='/'>{self.words(1, 2)}</a>", f"<div>{self.words(1, 3)}</div>"])
        return self.box("head", "header", inner + (f"<p>{self.words(2, 7)}</p>" if self.r.random() < 0.5 else "") + (self.nav() if self.r.random() < 0.3 else ""))

    def footer(self) -> str:
        inner = self.r.choice([f"&copy; {self.r.randint(1999, 2025)} {self.words(1, 4)}", f"<p>&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}</p>",
                               f"<p>{self.sentences(1, 2)}</p><p>{self.link()} {self.link()}</p>", self.sentences(1, 2)])
        return self.box("foot", "footer", inner)

    def sidebar(self) -> str:
        out = ""
        for _ in range(self.r.randint(1, 3)):
            out += f"<h3>{self.words(1, 3)}</h3>" + self.r.choice([
                "<ul>" + "".join(f"<li>{self.link(2, 8)}</li>" for _ in range(self.r.randint(2, 8))) + "</ul>",
                f"<p>{self.sentences(1, 2)}</p><p>{self.link(2, 4)}</p>",
                "".join(f"<div><a href='/x'>{self.words(3, 8)}</a><p>{self.sentences(1, 1)}</p></div>" for _ in range(self.r.randint(2, 4)))])
        return self.box("side", "aside", out)

    def ad(self) -> str:
        inner = self.r.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 2)}</p>", f"<a href='/ad'>{self.words(3, 9)}</a>", f"<span>{self.words(2, 6)}!</span> {self.link()}"])
        return f"<!-- ad {self.words(1, 2)} -->" + self.box("ad", self.r.choice(["div", "aside"]), inner)

    def notice(self) -> str:
        return self.box("notice", "div", self.r.choice([f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 2) + " " + self.link()]) + f"<button>{self.words(1, 2)}</button>")

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name='a'>" for _ in range(self.r.randint(1, 4)))
        return self.box("form", "form", (f"<p>{self.sentences(1, 1)}</p>" if self.r.random() < 0.5 else f"<h3>{self.words(1, 4)}</h3>") + fields + "<button>ok</button>")

    def comments(self) -> str:
        one = [f"<{t} {self.names('comment')}><div>{self.words(1, 2)} {self.r.randint(1, 28)}.{self.r.randint(1, 12)}.</div><p>{self.sentences(1, 5)}</p>{self.link() if self.r.random() < 0.5 else ''}</{t}>"
               for t in [self.r.choice(["li", "li", "div", "div", "article" if self.r.random() < 0.3 else "div"])] for _ in range(self.r.randint(1, 7))]
        items = "".join(one)
        return self.box("comment", "section", f"<h{(k := self.r.randint(2, 4))}>{self.r.randint(1, 50)} {self.words(1, 2)}</h{k}>" + (f"<ol>{items}</ol>" if one[0].startswith("<li") else items)
                        + (self.form() if self.r.random() < 0.4 else ""))

    def share(self) -> str:
        return self.box("social", "div", " ".join(self.link(1, 1) for _ in range(self.r.randint(2, 5))))

    # The article.
    def paragraph(self) -> str:
        r, text = self.r, self.sentences(1, self.r.choice([1, 1, 3, 7, 12]))
        if r.random() < 0.2:
            text = text[:len(text) // 2] + f" <a href='/l'>{self.words(1, 4)}</a> " + text[len(text) // 2:]
        if r.random() < 0.15:
            text = f"<b>{text}" + ("</b>" if r.random() < 0.5 else "<br>")
        return f"<p>{text}" + ("</p>" if r.random() < 0.9 else "")

    def article(self, inserts: list[str]) -> str:
        r = self.r
        title = self.words(2, 12).capitalize()
        parts = [f"<h1>{title}</h1>" if r.random() < 0.7 else f"<h2>{title}</h2>"] if r.random() < 0.9 else []
        style = r.random()
        for _ in range(r.randint(1, 9)):
            x = r.random()
            if style < 0.12:
                parts.append(f"{self.sentences(1, 6)}<br><br>")
            elif x < 0.72:
                parts.append(self.paragraph())
            elif x < 0.8:
                parts.append(f"<h{r.randint(2, 4)}>{self.words(1, 6)}</h3>")
            elif x < 0.88:
                t = r.choice(["ul", "ol"])
                parts.append(f"<{t}>" + "".join(f"<li>{self.words(2, 14)}{r.choice(['.', ''])}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif x < 0.93:
                parts.append(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>")
            elif x < 0.95:
                parts.append(f"<pre>{self.words(4, 20)}\n{self.words(3, 9)}</pre>")
            elif x < 0.98:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            else:
                parts.append(f"<figure><img src='x'><figcaption>{self.words(3, 10)}</figcaption></figure>")
        for x in inserts:
            # At the end, or between two blocks.
            parts.insert(len(parts) if r.random() < 0.5 else r.randint(min(1, len(parts)), len(parts)), x)
        return "".join(parts)

    def html(self) -> str:
        r = self.r
        chance = lambda p, make: make() if r.random() < p else ""
        inserts = [f() for f in (self.ad, self.share, self.sidebar, self.form, self.notice) if r.random() < 0.1]
        comments = chance(0.35, self.comments)
        if comments and r.random() < 0.4:
            inserts.append(comments)
            comments = ""
        body = self.article([])
        if self.layout == "blog" and body.startswith("<h1>"):
            head, rest = body.split("</h1>", 1)
            body = f"<header class='entry-header'>{head}</h1></header><div class='entry-content'>{rest}</div>" + "".join(inserts)
        elif inserts:
            body = self.article(inserts)
        main = self.box("main", r.choice(["article", "article", "main", "section"]), body, 1)
        for _ in range(r.choice([0, 0, 1, 2])):
            main = f'<div{self.names("wrap")}>{main}{chance(0.2, self.share)}</div>'
        top = [x for x in (chance(0.6, self.header), chance(0.8, self.nav), chance(0.3, self.ad), chance(0.2, self.notice), chance(0.15, self.form)) if x]
        r.shuffle(top)
        end = [x for x in (comments, chance(0.45, self.sidebar), chance(0.15, self.form), chance(0.15, self.ad), chance(0.3, self.nav)) if x]
        r.shuffle(end)
        if self.layout == "table":
            cells = [f"<td {MARK}='0'>{''.join(top[1:])}</td>", f"<td>{main}</td>", f"<td {MARK}='0'>{''.join(end)}</td>"]
            inner = f"<table><tr><td colspan='3' {MARK}='0'>{''.join(top[:1])}</td></tr><tr>{''.join(cells)}</tr></table>"
        else:
            inner = "".join(top) + main + "".join(end)
        inner += chance(0.85, self.footer) + chance(0.15, self.notice)
        if r.random() < 0.2:
            inner = f'<div{self.names("wrap")}>{inner}</div>'
        if r.random() < 0.04:
            inner = f"<form action='/page'>{inner}</form>"
        return (f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
                f'<body {MARK}="0">{inner}' + ("</body></html>" if r.random() < 0.9 else ""))


def labelled_pages(n: int, seed: int, layouts: tuple[str, ...] = LAYOUTS) -> list[str]:
    return [Page(seed * 1_000_003 + i, layouts[i % len(layouts)]).html() for i in range(n)]
