"""Page layouts with known main text, drawn at random, to fit the extractor on.

The tables hold no labels for pages, so the trees learn from layouts: page furniture of many kinds,
under semantic tags, telling class names or meaningless ones, around articles of all lengths.
``data-part`` marks what is the article (m) and what is not (b); no feature reads it.
"""

from __future__ import annotations

import numpy as np

FURNITURE = {
    "nav": ["nav", "menu", "navbar", "navigation", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "tabs", "nav-links", "site-nav", "toc", "pagination", "pager", "skip-link", "submenu"],
    "header": ["header", "site-header", "masthead", "top", "branding", "logo", "page-header", "topbar", "banner-top", "hdr", "title-bar", "tagline"],
    "footer": ["footer", "site-footer", "colophon", "bottom", "copyright", "legal", "footer-links", "page-footer", "credits", "imprint", "ftr"],
    "aside": ["sidebar", "aside", "widget", "rail", "right-col", "secondary", "related", "recommended", "popular", "trending", "more-stories", "tags", "tag-cloud", "archive-list", "author-box", "side", "teaser", "read-more"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "promoted", "adsbox", "dfp", "sponsor", "affiliate", "partner-offer", "ad-slot", "commercial"],
    "notice": ["cookie", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "message-bar", "announcement", "disclaimer", "privacy"],
    "form": ["search", "search-form", "signup", "login", "contact-form", "subscribe-form", "poll", "newsletter-form"],
    "comments": ["comments", "comment-list", "comment", "disqus", "responses", "discussion", "replies", "reader-comments", "respond", "feedback", "comment-section", "user-comments"],
    "share": ["share", "social", "sharing", "share-buttons", "follow-us", "social-links", "like-box", "tools", "actions"],
}
TAGS = {"nav": ["nav", "div", "ul", "nav"], "header": ["header", "div"], "footer": ["footer", "div", "footer"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "ins", "section"], "notice": ["div", "section", "dialog"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}
ARTICLE = ["content", "article", "post", "entry", "entry-content", "article-body", "story", "main", "main-content", "post-content", "page-content", "text", "body-text", "story-body", "article-text", "blog-post", "prose", "body-content", "hentry", "article__body"]
PARTS = ["intro", "lead", "paragraph", "section", "text-block", "body", "copy", "block", "standfirst", "quote", "caption", "summary"]
OUTER = ["wrapper", "container", "page", "site", "layout", "row", "col", "inner", "wrap", "root", "app", "grid", "outer"]


class Layouts:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, of: list):
        return of[int(self.rng.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, n: int) -> str:
        syllables = ["an", "the", "ro", "li", "ou", "é", "ch", "ing", "ta", "mo", "es", "de", "ü", "qu", "st", "re"]
        out = []
        for i in range(max(1, n)):
            w = "".join(self.pick(syllables) for _ in range(int(self.rng.integers(1, 5))))
            out.append(w.capitalize() if i == 0 or out[-1].endswith(".") else w)
            if self.chance(0.1):
                out[-1] += self.pick([",", ".", "."])
        return " ".join(out) + self.pick([".", ".", ".", "", "!"])

    def link(self, n: int) -> str:
        return f'<a href="/{self.rng.integers(1e6)}">{self.words(n)}</a>'

    def name(self, names: list[str]) -> str:
        if self.obscure:
            return f' class="{self.pick(["c", "x", "css-", "_"])}{self.rng.integers(1e5):x}"' if self.chance(0.7) else ""
        kind = self.rng.random()
        if kind < 0.15:
            return ""
        token = self.pick(names)
        if self.chance(0.3):
            token += self.pick(["-1", " clearfix", " block", "-wrapper", "-container", " js-x", "__inner", " " + self.pick(names)])
        return f' id="{token}"' if kind < 0.4 else f' class="{token}"'

    def links(self, low: int, high: int) -> str:
        items = [self.link(int(self.rng.integers(1, 5))) for _ in range(int(self.rng.integers(low, high)))]
        kind = self.rng.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.pick([" | ", " ", " &middot; "]).join(items) if kind < 0.85 else "".join(f"<div>{x}</div>" for x in items)

    def furniture(self, kind: str) -> str:
        tag = self.pick(TAGS[kind]) if not (self.obscure and self.chance(0.8)) else "div"
        n = lambda a, b: self.words(int(self.rng.integers(a, b)))
        if kind == "nav":
            inner = self.links(3, 10) if tag != "ul" else "".join(f"<li>{self.link(1)}</li>" for _ in range(5))
        elif kind == "header":
            inner = self.pick([f"<h1>{self.link(2)}</h1>", f"<div>{n(1, 5)}</div>", f"<h2>{n(1, 4)}</h2><p>{n(2, 9)}</p>", f"<a href='/'>{n(1, 3)}</a>"]) + (self.links(3, 8) if self.chance(0.5) else "")
        elif kind == "footer":
            inner = self.pick([f"&copy; {n(1, 14)}", f"<p>&copy; 2024 {n(1, 20)}</p>", f"<p>{n(1, 30)}</p>", n(1, 6)]) + (self.links(2, 8) if self.chance(0.5) else "")
        elif kind == "aside":
            inner = self.pick(["", f"<h3>{n(1, 4)}</h3>", f"<h4>{n(1, 3)}</h4>"]) + self.pick([self.links(3, 9), f"<p>{n(5, 30)}</p>", "".join(f"<div>{self.link(6)}<p>{n(5, 20)}</p></div>" for _ in range(3))])
        elif kind == "ad":
            inner = self.pick([n(2, 15), f"<p>{n(4, 25)}</p>", f"{self.link(5)} {n(2, 9)}", f"<span>{n(1, 3)}</span><p>{n(3, 12)} {self.link(2)}</p>"])
        elif kind == "notice":
            inner = f"<p>{n(6, 40)}</p>" + self.pick(["<button>OK</button>", self.link(2), f"{n(1, 3)}", ""])
        elif kind == "form":
            inner = f"<label>{n(1, 4)}</label><input type=text>" + self.pick(["<button>Go</button>", f"<p>{n(3, 12)}</p>", ""])
        elif kind == "comments":
            one = [f"<div{self.name(['comment', 'comment-body', 'reply'])}><b>{n(1, 2)}</b><p>{n(4, 60)}</p>{self.pick(['', self.link(1)])}</div>" for _ in range(int(self.rng.integers(1, 6)))]
            if tag == "ol":
                one = [f"<li>{x}</li>" for x in one]
            inner = self.pick(["", f"<h3>{n(1, 3)}</h3>"]) + "".join(one) if tag != "ol" else "".join(one)
        else:
            inner = " ".join(self.link(1) for _ in range(int(self.rng.integers(2, 6)))) if tag != "ul" else "".join(f"<li>{self.link(1)}</li>" for _ in range(4))
        role = self.pick(["", "", "", f' role="{self.pick(["navigation", "banner", "contentinfo", "complementary", "search", "dialog"])}"']) if kind in ("nav", "header", "footer", "aside") else ""
        return f'<{tag} data-part="b"{self.name(FURNITURE[kind])}{role}>{inner}</{tag}>'

    def block(self) -> str:
        size = int(self.rng.choice([1, 4, 12, 40, 90, 200], p=[0.06, 0.12, 0.22, 0.3, 0.2, 0.1]))
        n = lambda a, b: self.words(int(self.rng.integers(a, b)))
        text = self.words(max(1, int(size * self.rng.uniform(0.5, 1.5))))
        if self.chance(0.25):
            text = self.pick([f"<b>{text}</b>", f"{text} {self.link(2)} {n(3, 20)}", f"{text} <em>{n(1, 5)}</em> {n(2, 9)}", f"{text}<br>{n(5, 40)}", f"<b>{text}<br>"])
        kind = self.rng.random()
        if kind < 0.7:
            return f"<p{self.name(PARTS) if self.chance(0.1) else ''}>{text}" + ("</p>" if self.chance(0.85) else "")
        if kind < 0.78:
            return f"<h{self.rng.integers(2, 5)}>{n(2, 9)}</h2>" if self.chance(0.05) else f"<h2>{n(2, 9)}</h2>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{n(2, 25)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote><p>{text}</p></blockquote>" if self.chance(0.5) else f"<blockquote>{text}</blockquote>"
        if kind < 0.91:
            return f"<pre><code>{n(5, 40)}</code></pre>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{n(1, 5)}</td><td>{n(1, 9)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.96:
            return f"<figure><img src=x><figcaption>{n(3, 15)}</figcaption></figure>"
        return f"<div{self.name(PARTS)}>{text}</div>"

    def page(self) -> str:
        self.obscure = self.chance(0.15)
        small = self.chance(0.12)  # a page with hardly any text
        blocks = [f"<h1>{self.words(int(self.rng.integers(1, 10)))}</h1>"] if self.chance(0.4 if small else 0.85) else []
        if blocks and self.chance(0.2):
            blocks = [f"<header{self.name(['entry-header', 'article-header', 'post-header', 'title'])}>{blocks[0]}</header>"]
        blocks += [self.block() for _ in range(1 if small else 1 + int(self.rng.geometric(0.12)))]
        for kind in ("ad", "share", "aside", "form", "notice"):
            if self.chance(0.12):
                blocks.insert(int(self.rng.integers(1, len(blocks) + 1)), self.furniture(kind))
        if self.chance(0.1):
            blocks = [f"<section{self.name(PARTS)}>{''.join(blocks)}</section>"]
        tag = self.pick(["article", "article", "main", "div", "div", "section", "td"])
        article = f'<{tag} data-part="m"{self.name(ARTICLE) if not (tag == "article" and self.chance(0.6)) else ""}>{"".join(blocks)}</{tag}>'
        if tag == "td":
            rows = [f'<tr><td data-part="b">{self.links(3, 7)}</td>{article}</tr>']
            if self.chance(0.5):
                rows.insert(0, f'<tr><td data-part="b" colspan=2>{self.pick(["<b>{}</b>", "{}", "<h1>{}</h1>"]).format(self.words(int(self.rng.integers(1, 5))))}</td></tr>')
            if self.chance(0.6):
                rows.append(f'<tr><td data-part="b">{self.pick(["&copy; ", "Copyright ", ""])}{self.words(int(self.rng.integers(1, 9)))}</td></tr>')
            article = f"<table>{''.join(rows)}</table>"
        elif self.chance(0.2):
            article = f"<main{self.name(ARTICLE)}>{article}{self.furniture('comments') if self.chance(0.4) else ''}</main>"
        parts = [article]
        for kind, p, after in (("nav", 0.3 if small else 0.7, 0), ("header", 0.55, 0), ("notice", 0.3, None), ("ad", 0.45, None), ("form", 0.2, None), ("aside", 0.45, None), ("comments", 0.35, 1), ("share", 0.2, None), ("footer", 0.8, 1), ("nav", 0.15, 1)):
            if self.chance(p):
                late = after if after is not None else int(self.chance(0.6))
                parts.insert(len(parts) if late else 0, self.furniture(kind))
        while self.chance(0.4):
            parts = [f"<div{self.name(OUTER)}>{''.join(parts)}</div>"]
        return f'<html><head><title>{self.words(5)}</title><script>x("</p>")</script></head><body>{"".join(parts)}' + ("</body></html>" if self.chance(0.9) else "")


def pages(n: int, seed: int) -> list[str]:
    make = Layouts(seed)
    return [make.page() for _ in range(n)]
