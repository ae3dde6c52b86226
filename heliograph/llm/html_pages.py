"""Made-up pages with known article blocks, from which the block labeller learns.

A seeded generator lays out pages as sites do: menus, headers, footers, side columns, notices,
adverts, forms and reader comments around an article (or none), with or without telling tags and class
names. Words are random syllables, so that nothing but their use can be learnt."""

from __future__ import annotations

import random

_SYLLABLES = "a an ar be ca co da de do el en er es fo ga he il in ka la le lo ma me mi mo na ne no on or pa pe qu ra re ri ro sa se si st ta te ti to tr un ve vi wa ze".split()
_BODY = ("article", "content", "post", "entry", "story", "main", "body", "text", "page")
_OTHER = {
    "menu": ("nav", "menu", "navbar", "breadcrumb", "navigation", "topnav"),
    "head": ("header", "masthead", "branding", "top", "logo"),
    "foot": ("footer", "copyright", "bottom", "site-footer", "legal"),
    "side": ("sidebar", "aside", "widget", "related", "rail", "recommended"),
    "ad": ("ad", "ads", "advert", "sponsor", "promo", "banner", "adsbox"),
    "notice": ("cookie", "notice", "consent", "popup", "alert", "gdpr"),
    "form": ("newsletter", "subscribe", "signup", "login", "search", "contact"),
    "comment": ("comments", "comment", "reply", "discussion", "responses"),
    "share": ("share", "social", "tags", "pagination", "meta"),
}
_TAGS = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "ad": "div", "notice": "div", "form": "form", "comment": "section", "share": "div"}


class Maker:
    """Pages of one seed. page() gives html, with every article block wrapped in \x01 and \x02."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def prose(self, lo: int, hi: int) -> str:
        out, n = [], self.r.randint(lo, hi)
        if self.r.random() < 0.06:  # some texts repeat themselves
            return " ".join([self.word()] * n)
        while n > 0:
            k = min(n, self.r.randint(1, 18))
            s = self.words(k, k).split()
            if k > 5 and self.r.random() < 0.4:
                s[k // 2] += ","
            out.append(" ".join(s).capitalize() + ".")
            n -= k
        return " ".join(out)

    def attrs(self, names: tuple[str, ...], often: float) -> str:
        if self.r.random() >= often:
            return f' class="{self.word()}"' if self.r.random() < 0.3 else ""
        name = self.r.choice(names)
        name = self.r.choice((name, f"{name}-{self.word()}", f"{self.word()}-{name}", f"{name} {self.word()}"))
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def links(self, lo: int, hi: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(lo, hi))]
        kind = self.r.random()
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<p>{x}</p>" for x in items) if kind < 0.8 else " | ".join(items)

    def other(self, kind: str) -> str:
        r = self.r
        often = r.choice((0.5, 0.9, 1.0))
        if kind == "menu":
            inner = self.links(2, 10)
        elif kind == "head":
            inner = r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 3)}</div><p>{self.words(2, 8)}</p>", f'<a href="/">{self.word()}</a>'))
        elif kind == "foot":
            inner = f"{r.choice(('&copy;', '(c)', ''))} {self.word()}.example.com {r.choice(('&middot;', '-', '|'))} {self.prose(2, 25)}" + (self.links(1, 5) if r.random() < 0.4 else "")
        elif kind == "side":
            inner = f"<h{r.choice('234')}>{self.words(1, 4)}</h3>" + r.choice((self.links(2, 8), f"<p>{self.prose(3, 25)}</p>"))
        elif kind in ("ad", "notice"):
            inner = r.choice((self.prose(2, 25), f"<p>{self.prose(2, 25)}</p>", f'<a href="#">{self.prose(2, 10)}</a>', f"<p>{self.prose(4, 30)}</p><button>{self.words(1, 2)}</button>"))
        elif kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + (f"<p>{self.prose(3, 15)}</p>" if r.random() < 0.5 else "") + (f"<select><option>{self.word()}</option><option>{self.word()}</option></select>" if r.random() < 0.3 else "")
        elif kind == "comment":
            one = lambda: r.choice((f"<div class=\"comment\"><b>{self.word()}</b><p>{self.prose(3, 60)}</p></div>", f"<li><p>{self.prose(3, 60)}</p></li>", f"<p>{self.prose(3, 60)}</p>"))
            inner = f"<h3>{self.words(1, 3)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 6)))
        else:
            inner = r.choice((self.links(2, 6), f"<span>{self.words(1, 5)}</span>", f"<p>{self.words(1, 6)}</p>"))
        tag = _TAGS[kind] if r.random() < 0.6 else "div"
        if tag == "div":
            often = max(often, 0.9)
        return f"<{tag}{self.attrs(_OTHER[kind], often)}>{inner}</{tag}>"

    def article(self) -> str:
        r = self.r
        mark = lambda s: f"\x01{s}\x02"
        out = [f"<h{r.choice('112')}>{mark(self.words(2, 12))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 3, 4, 6, 8, 12, 20))):
            k = r.random()
            long = r.choice((3, 20, 60, 150))
            if k < 0.72:
                lead = r.choice(("", "", "<b>", "<em>", "<span>"))
                out.append(f"<p>{lead}{mark(self.prose(1, long))}" + r.choice(("</p>", "</p>", "<br></p>", "")))
            elif k < 0.8:
                out.append(f"<h{r.choice('23')}>{mark(self.words(1, 8))}</h2>")
            elif k < 0.88:
                out.append("<ul>" + "".join(f"<li>{mark(self.prose(2, 20))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.92:
                out.append(f"<blockquote><p>{mark(self.prose(5, 40))}</p></blockquote>")
            elif k < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{mark(self.words(1, 3))}</td><td>{mark(self.words(1, 3))}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif k < 0.97:
                out.append(self.other(r.choice(("ad", "share", "form", "notice", "side"))))
            else:
                out.append(f"<div>{mark(self.prose(10, 60))}</div>")
        tag = r.choice(("article", "article", "article", "main", "div"))
        inner = "".join(out)
        if r.random() < 0.3:
            inner = f"<div{self.attrs(_BODY, 0.8)}>{inner}</div>"
        return f"<{tag}{self.attrs(_BODY, 0.9 if tag == 'div' else 0.4)}>{inner}" + (self.other(r.choice(("share", "comment"))) if r.random() < 0.15 else "") + f"</{tag}>"

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "head", "menu", "ad", "form", "side") if r.random() < {"menu": 0.8, "head": 0.5}.get(k, 0.35)]
        after = [k for k in ("share", "ad", "side", "comment", "form", "foot", "notice") if r.random() < {"foot": 0.8, "comment": 0.4}.get(k, 0.3)]
        r.shuffle(before)
        body = [self.other(k) for k in before] + ([self.article()] if r.random() < 0.95 else []) + [self.other(k) for k in after]
        page = "".join(body)
        if r.random() < 0.3:
            page = f"<div{self.attrs(('wrapper', 'container', 'page'), 0.8)}>{page}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 10)}</title><style>p{{}}</style></head><body>{page}</body></html>"
