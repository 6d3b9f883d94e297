"""Labelled pages to train on: layouts as sites use them, with invented words.

Each page comes with the blocks of its main text. Layouts vary in elements, names, order, and in
which of the surroundings they have; the words are drawn alike everywhere, so a model can learn
from structure, names and block shape only.
"""

from __future__ import annotations

import random

# Names that sites give to parts of a page.
AROUND = {
    "nav": ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "breadcrumbs", "toc-nav", "topnav", "site-nav", "pagination", "pager", "skip-links", "tabs"],
    "header": ["header", "site-header", "masthead", "top-bar", "page-header", "banner", "branding", "logo", "toolbar"],
    "footer": ["footer", "site-footer", "page-footer", "colophon", "copyright", "legal", "bottom"],
    "aside": ["sidebar", "side", "aside", "widget", "widget-area", "rail", "right-column", "related", "related-posts", "recommended", "popular", "trending", "more-stories", "read-next", "tags", "archive", "sidenote"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsbygoogle", "ad-slot", "banner-ad", "commercial", "affiliate", "teaser"],
    "notice": ["notice", "cookie-notice", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "overlay", "paywall", "warning", "announcement", "disclaimer", "message", "toast", "privacy"],
    "form": ["form", "search", "search-form", "login", "signup", "newsletter", "subscribe", "contact-form", "subscription", "register"],
    "share": ["share", "social", "share-buttons", "follow-us", "social-links", "print-tools"],
    "comments": ["comments", "comment-list", "comment", "responses", "respond", "disqus", "discussion", "reply", "replies", "reader-comments", "feedback", "guestbook", "user-comments"],
}
INSIDE = ["article", "content", "post", "entry", "main", "story", "article-body", "post-content", "entry-content", "main-content", "page-content", "body-text", "text", "story-body", "prose"]
_SYLLABLES = "an er on the re in ti es or he nd st en ou ed ha at le de que ción ä é is of to".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.text: list[str] = []
        # How this page's authors write, in its main text and around it alike.
        self.commas = self.r.choice([0.06, 0.06, 0.06, 0.3, 0.9, 0.0])
        self.sentence = self.r.choice([(5, 14), (5, 14), (5, 14), (2, 5), (40, 120)])
        self.ends = self.r.choice([0.9, 0.9, 0.9, 0.2])

    def words(self, low: int, high: int) -> str:
        r = self.r
        w = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(min(low, high), high))]
        out, left = [], r.randint(*self.sentence)
        for x in w:
            left -= 1
            out.append(x + "." if not left else x + ("," if r.random() < self.commas else ""))
            left = left or r.randint(*self.sentence)
        return (" ".join(out)).capitalize()

    def block(self, tag: str, low: int, high: int, keep: bool, attributes: str = "") -> str:
        t = self.words(low, high) + ("." if high > 12 and self.r.random() < self.ends else "")
        if keep:
            self.text.append(" ".join(t.split()))
        if self.r.random() < 0.15 and high > 12:
            i = t.find(" ", len(t) // 2)
            if i > 0:
                t = t[:i] + self.r.choice([" <b>%s</b>", " <a href='#'>%s</a>", " <em>%s</em>"]) % t[i + 1 :][:20] + t[i + 1 :][20:]
        return f"<{tag}{attributes}>{t}" + ("" if tag in ("p", "li") and self.r.random() < 0.2 else f"</{tag}>")

    def named(self, tag: str, names: list[str], inner: str) -> str:
        r = self.r
        name = r.choice(names)
        kind = r.random()
        if kind < 0.12 and tag != "div":
            return f"<{tag}>{inner}</{tag}>"
        return f'<{tag} {"class" if kind < 0.75 else "id"}="{name}{r.choice(["", "", " x", "-1", " clearfix"])}">{inner}</{tag}>'

    def links(self, low: int, high: int) -> str:
        items = [f"<li><a href='/{i}'>{self.words(1, 5)}</a></li>" for i in range(self.r.randint(low, high))]
        return f"<ul>{''.join(items)}</ul>" if self.r.random() < 0.7 else " ".join(i[4:-5] for i in items)

    def around(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.named(r.choice(["nav", "div", "nav"]), AROUND[kind], self.links(3, 12))
        if kind == "header":
            return self.named(r.choice(["header", "div"]), AROUND[kind], self.block(r.choice(["p", "div", "h1", "h2"]), 2, 8, False) + (self.links(2, 5) if r.random() < 0.5 else ""))
        if kind == "footer":
            return self.named(r.choice(["footer", "div", "footer"]), AROUND[kind], "&copy; " + self.words(3, 20) + (self.links(2, 6) if r.random() < 0.5 else ""))
        if kind == "aside":
            inner = self.block(r.choice(["h3", "h4", "p"]), 1, 5, False) + (self.links(2, 8) if r.random() < 0.6 else "".join(self.block("p", 5, 60, False) for _ in range(r.randint(1, 3))))
            return self.named(r.choice(["aside", "div", "section"]), AROUND[kind], inner)
        if kind == "ad":
            return self.named(r.choice(["div", "div", "aside", "section", "p"]), AROUND[kind], self.words(3, 45))
        if kind == "notice":
            return self.named(r.choice(["div", "div", "section", "p", "dialog"]), AROUND[kind], self.block("p", 6, 60, False) + r.choice(["", "<button>Ok</button>"]) if r.random() < 0.6 else self.words(6, 50))
        if kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name='q'><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>"
            return f"<form{r.choice(['', ' class=search', ' id=newsletter'])}>{self.block('p', 3, 30, False)}{inner}</form>" if r.random() < 0.7 else self.named("div", AROUND[kind], f"<form>{inner}</form>")
        if kind == "share":
            return self.named("div", AROUND[kind], self.links(2, 5))
        many = "".join(self.named(r.choice(["div", "li", "article", "p"]), ["comment", "reply", "comment-body", "response", "user-comment"], self.block("p", 3, 70, False) + (self.block("p", 3, 50, False) if r.random() < 0.4 else "")) for _ in range(r.randint(1, 5)))
        return self.named(r.choice(["section", "div", "ol", "aside", "div"]), AROUND["comments"], self.block(r.choice(["h2", "h3"]), 1, 3, False) + many)

    def article(self) -> str:
        r = self.r
        out = [self.block(r.choice(["h1", "h1", "h2"]), 2, 14, True)] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                out.append(self.block("p", r.choice([1, 3, 20, 60]), r.choice([8, 60, 150, 250]), True))
            elif kind < 0.80:
                out.append(self.block(r.choice(["h2", "h3"]), 1, 9, True))
            elif kind < 0.85:
                out.append(f"<{(k := r.choice(['ul', 'ol']))}>" + "".join(self.block("li", 1, 25, True) for _ in range(r.randint(2, 6))) + f"</{k}>")
            elif kind < 0.88:
                out.append("<blockquote>" + self.block("p", 5, 60, True) + "</blockquote>")
            elif kind < 0.90:
                out.append("<table>" + "".join("<tr>" + "".join(self.block("td", 1, 6, True) for _ in range(2)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.92:
                out.append("<pre>" + self.block("code", 3, 20, True) + "</pre>")
            elif kind < 0.93:
                out.append("<figure><img src=x>" + self.block("figcaption", 2, 15, True) + "</figure>")
            elif kind < 0.96:
                out.append(self.block("div", 10, 80, True))
            else:
                out.append(self.around(r.choice(["ad", "aside", "share", "form", "notice"])))
        if r.random() < 0.15:
            out.append(self.around("comments"))
        if r.random() < 0.1:
            out.append(self.around(r.choice(["footer", "nav"])))
        return "".join(out)

    def make(self) -> tuple[str, list[str]]:
        r = self.r
        before = [self.around(k) for k in ("nav", "header", "ad", "notice", "form", "aside", "share") if r.random() < 0.45]
        r.shuffle(before)
        inner = self.article()
        kind = r.random()
        if kind < 0.45:
            body = f"<article>{inner}</article>"
        elif kind < 0.6:
            body = f"<main>{inner}</main>"
        elif kind < 0.9:
            body = self.named("div", INSIDE, inner)
        else:
            body = f"<div>{inner}</div>"
        if r.random() < 0.3:
            body = r.choice(["<main>%s</main>", '<div class="wrapper">%s</div>', '<div id="page">%s</div>', '<div class="container"><div class="row">%s</div></div>']) % body
        after = [self.around(k) for k in ("aside", "comments", "form", "ad", "notice", "share", "nav") if r.random() < 0.35]
        r.shuffle(after)
        if r.random() < 0.8:
            after.append(self.around("footer"))
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
        return page, self.text


def labelled_pages(count: int, seed: int = 0) -> list[tuple[str, list[str]]]:
    """Pages and the blocks of their main text."""
    return [_Page(seed * 1_000_003 + i).make() for i in range(count)]
