"""Labelled pages to learn from: random layouts of articles among menus, adverts, notices, forms and reader comments.

No table holds labelled pages. A layout is drawn from a seed: which regions there are, whether they go by element
names, by classes, by ids or by nothing, how deep they are wrapped, and what stands inside them. The words are random
letters, so that only the shape of a page and the names of its parts can be learned.
"""

from __future__ import annotations

import random

#: Names that authors give to the parts of their pages.
NAMES = {
    "content": ("content", "article", "post", "entry", "story", "main", "body", "text", "prose", "detail"),
    "nav": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "links", "toc", "pagination", "pager", "topbar"),
    "header": ("header", "masthead", "banner", "logo", "brand", "top", "head"),
    "footer": ("footer", "foot", "copyright", "legal", "bottom", "colophon", "imprint"),
    "side": ("sidebar", "aside", "widget", "related", "recommended", "popular", "tags", "rail", "trending", "archive", "more", "recent", "latest"),
    "ad": ("ad", "ads", "advert", "advertisement", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner", "teaser"),
    "notice": ("cookie", "cookies", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "announcement", "message", "privacy", "warning"),
    "comments": ("comment", "comments", "reply", "replies", "discussion", "respond", "responses", "disqus", "feedback", "reader", "thread"),
    "form": ("form", "search", "login", "signup", "newsletter", "subscribe", "contact", "register", "signin"),
    "share": ("share", "social", "sharing", "follow", "toolbar", "buttons"),
}
WRAPPERS = ("wrapper", "container", "page", "site", "layout", "row", "col", "inner", "outer", "grid", "section", "wrap", "box")
#: Elements that stand for a part where a page goes by element names.
ELEMENTS = {"content": ("article", "main", "section"), "nav": ("nav",), "header": ("header",), "footer": ("footer",), "side": ("aside",), "form": ("form",), "comments": ("section", "aside"), "notice": ("aside", "dialog")}


class Layout:
    """One random page; data-y marks where the article (C) and everything else (B) begins."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.by = self.r.choice(("element", "element", "class", "class", "id", "both"))
        self.letters = self.r.choice(("etaoinshrdlu", "eansirtudloécèê", "enisratdhulcüäöß"))

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices(self.letters, k=self.r.randint(2, 10))) for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 16) -> str:
        said = self.words(low, high).capitalize()
        return (said.replace(" ", ", ", 1) if self.r.random() < 0.3 else said) + self.r.choice("...!?" if self.r.random() < 0.9 else ",;: ")

    def prose(self, low: int, high: int, links: float = 0.1) -> str:
        said = [self.sentence() for _ in range(self.r.randint(low, high))]
        if self.r.random() < links:
            said[self.r.randrange(len(said))] += f' <a href="/{self.words(1, 1)}">{self.words(1, 4)}</a> {self.sentence()}'
        if self.r.random() < 0.15:
            said.append(f"<{(t := self.r.choice(('b', 'em', 'strong', 'span', 'i')))}>{self.words(1, 6)}</{t}>.")
        return " ".join(said)

    def element(self, part: str) -> tuple[str, str]:
        """(name, attributes) of a part's outer element, as this page names its parts."""
        name, attributes = "div", ""
        names = NAMES[part]
        if self.by in ("element", "both") and part in ELEMENTS:
            name = self.r.choice(ELEMENTS[part][:1] * 3 + ELEMENTS[part])
        bare = name not in ("div", "section", "aside") and part != "comments"
        if self.by != "element" or not bare or self.r.random() < 0.2:
            said = [self.r.choice(names)]
            if self.r.random() < 0.4:
                said.append(self.r.choice((*WRAPPERS, *names, self.words(1, 1))))
            joined = self.r.choice("-_ ").join(said)
            attributes = f' {"id" if self.by == "id" or self.r.random() < 0.2 else "class"}="{joined}"'
            if part == "content" and self.r.random() < 0.25:
                attributes = ""
        return name, attributes

    def part(self, part: str, inside: str) -> str:
        name, attributes = self.element(part)
        for _ in range(self.r.choice((0, 0, 0, 1, 2))):
            inside = f"<div{self.wrapper(0.5)}>{inside}</div>"
        return f'<{name}{attributes} data-y="{"C" if part == "content" else "B"}">{inside}</{name}>'

    def wrapper(self, named: float) -> str:
        return f' class="{self.r.choice(WRAPPERS)}"' if self.r.random() < named else ""

    def menu(self, low: int = 3, high: int = 12) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.r.randint(low, high))]
        shape = self.r.randrange(4)
        if shape < 2:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.r.choice((" | ", " ", " &raquo; ")).join(items) if shape == 2 else "".join(f"<div>{i}</div>" for i in items)

    def block(self) -> str:
        kind = self.r.random()
        if kind < 0.68:
            return f"<p>{self.prose(1, self.r.choice((1, 3, 8, 20)))}</p>"
        if kind < 0.74:
            return f"<h{(n := self.r.randint(2, 4))}>{self.words(1, 8)}</h{n}>"
        if kind < 0.80:
            return f"<{(t := self.r.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.prose(1, 2, 0.25)}</li>" for _ in range(self.r.randint(2, 7))) + f"</{t}>"
        if kind < 0.84:
            return f"<blockquote>{self.r.choice(('', '<p>'))}{self.prose(1, 4)}</blockquote>"
        if kind < 0.87:
            return f'<figure><img src="/x"><figcaption>{self.prose(1, 1)}</figcaption></figure>'
        if kind < 0.90:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 6))) + "</table>"
        if kind < 0.93:
            return f"<pre><code>{self.words(3, 30)}</code></pre>"
        if kind < 0.96:
            return f"<div>{self.prose(1, 6)}</div>"
        return f"<p><b>{self.prose(1, 3)}<br><p>{self.prose(1, 5)}</p>"

    def article(self) -> str:
        n = self.r.choice((1, 1, 2, 3, 5, 9, 16))
        title = f"<h1>{self.words(1, 9)}{self.r.choice(('', '.'))}</h1>" if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.15:
            title = f"<header>{title}{self.r.choice(('', f'<p>{self.prose(1, 1)}</p>'))}</header>"
        shape = self.r.random()
        if shape < 0.12:
            inside = [self.r.choice(("<br><br>", "<br>", "<hr>")).join(self.prose(1, 6) for _ in range(n))]
        elif shape < 0.45:
            inside = [f"<p>{self.prose(1, self.r.choice((1, 4, 12)))}</p>" for _ in range(n)]
        else:
            inside = [self.block() for _ in range(n)]
        for extra, chance in (("ad", 0.15), ("share", 0.12), ("side", 0.1), ("form", 0.06), ("nav", 0.08)):
            if self.r.random() < chance and n > 1:
                inside.insert(self.r.randint(1, len(inside)), self.part(extra, getattr(self, f"in_{extra}")()))
        return title + "".join(inside)

    def in_content(self) -> str:
        return self.article()

    def in_nav(self) -> str:
        return self.menu()

    def in_header(self) -> str:
        top = self.r.choice(("", f'<a href="/">{self.words(1, 2)}</a>', f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 4)}</div>", f'<img src="/l"><p>{self.words(2, 7)}</p>'))
        return top + (self.menu(2, 7) if self.r.random() < 0.5 or not top else "")

    def in_footer(self) -> str:
        return self.r.choice((f"&copy; {self.words(1, 3)} &middot; {self.prose(1, 2)}", f"<p>&copy; 2024 {self.words(1, 5)}</p>{self.menu(2, 6)}", self.menu(2, 9), f"<p>{self.prose(1, 3, 0.5)}</p>"))

    def in_side(self) -> str:
        head = f"<h{(n := self.r.randint(2, 4))}>{self.words(1, 3)}</h{n}>" if self.r.random() < 0.7 else ""
        return head + self.r.choice((self.menu(), f"<p>{self.prose(1, 3, 0.4)}</p>", "".join(f'<div><a href="/{i}">{self.words(2, 9)}</a><p>{self.prose(1, 1)}</p></div>' for i in range(self.r.randint(1, 5)))))

    def in_ad(self) -> str:
        return self.r.choice((self.prose(1, 2, 0.0), f'<a href="/o">{self.words(2, 12)}</a>', f"<p>{self.prose(1, 3, 0.4)}</p>", f"<span>{self.words(1, 2)}</span> {self.sentence()}"))

    def in_notice(self) -> str:
        return self.r.choice((self.prose(1, 3, 0.4), f"<p>{self.prose(1, 4, 0.4)}</p><button>{self.words(1, 2)}</button>", f"{self.sentence()} <a href='/p'>{self.words(1, 2)}</a>"))

    def in_share(self) -> str:
        return self.menu(2, 5)

    def in_form(self) -> str:
        rows = "".join(f'<label>{self.words(1, 3)}</label><input name="{i}">' for i in range(self.r.randint(1, 4)))
        body = self.r.choice(("", f"<p>{self.prose(1, 2)}</p>", f"<h3>{self.words(1, 4)}</h3>")) + rows + f"<button>{self.words(1, 2)}</button>"
        return body if self.by in ("element", "both") else f"<form>{body}</form>"

    def in_comments(self) -> str:
        inner = self.r.choice(("div", "li", "article", "section"))
        named = f' class="{self.r.choice(NAMES["comments"])}"' if self.r.random() < 0.6 else ""
        one = lambda: f"<{inner}{named}>{self.r.choice(('', f'<b>{self.words(1, 2)}</b> ', f'<span>{self.words(1, 3)}</span>', f'<h4>{self.words(1, 2)}</h4>'))}{self.r.choice((f'<p>{self.prose(1, 4)}</p>', self.prose(1, 3)))}</{inner}>"
        every = "".join(one() for _ in range(self.r.randint(1, 8)))
        return (f"<h3>{self.words(1, 3)}</h3>" if self.r.random() < 0.6 else "") + (f"<ol>{every}</ol>" if inner == "li" else every) + (self.in_form() if self.r.random() < 0.2 else "")

    def page(self) -> str:
        before = [p for p, chance in (("notice", 0.3), ("header", 0.5), ("nav", 0.75), ("ad", 0.35), ("form", 0.12), ("side", 0.12)) if self.r.random() < chance]
        after = [p for p, chance in (("ad", 0.2), ("share", 0.12), ("comments", 0.4), ("side", 0.4), ("form", 0.2), ("footer", 0.75), ("notice", 0.15)) if self.r.random() < chance]
        if self.r.random() < 0.2:
            self.r.shuffle(before)
        make = lambda parts: [self.part(p, getattr(self, f"in_{p}")()) for p in parts]
        top, main, end = make(before), [self.part("content", self.article())], make(after)
        if self.r.random() < 0.6:
            take, give = self.r.randint(0, min(2, len(top))), self.r.randint(0, min(3, len(end)))
            middle = "".join(top[len(top) - take :] + main + end[:give])
            if self.r.random() < 0.15:
                cells = [f"<td>{x}</td>" for x in top[len(top) - take :] + main + end[:give]]
                middle = f"<table><tr>{''.join(cells)}</tr></table>"
            top, main, end = top[: len(top) - take], [f"<div{self.wrapper(0.7)}>{middle}</div>"], end[give:]
        inside = "".join(top + main + end)
        for _ in range(self.r.choice((0, 0, 1, 1, 2))):
            inside = f"<div{self.wrapper(0.7)}>{inside}</div>"
        if self.r.random() < 0.12:
            inside = f'<form action="/">{inside}</form>'
        return f"<html><head><title>{self.words(1, 8)}</title><style>p{{}}</style></head><body>{inside}</body></html>"
