"""Labelled pages to learn weights from: elements of the main text bear the attribute data-main.

The pages are built by rule from the layouts of several made-up sites.  A site
gives each part of a page a tag and a name of its own, as sites do, and some
sites use names that say nothing; so neither tags nor names alone tell the main
text, and lengths, links and sentences count as well.
"""

from __future__ import annotations

import random

_LINES = (
    "The ferry between the two islands returned to service on Monday after a winter of repairs, and the first crossing was full before sunrise.",
    "Fishermen had lent their boats in the meantime, carrying schoolchildren in the morning and mail in the afternoon.",
    "The harbour office expects three crossings a day until the summer timetable begins.",
    "Engineers replaced both shafts and most of the wiring; the hull, which dates from 1958, needed less work than they had feared.",
    "It rained all week.",
    "We counted the days, said the baker, and the days counted us.",
    "Tickets are sold on board only, in coins or by card, and bicycles travel free of charge outside the busy hours.",
    "Nobody in the village could remember a longer winter.",
)
_LABELS = ("Home", "News", "Contact us", "Coast", "Sport", "Ten quiet harbours", "Bread at home", "Privacy", "Terms of use", "Print", "Share this page", "Next story")
#: Tag and name of each part on each site; the last ones say nothing.
_SITES = (
    {"head": "header masthead", "menu": "nav menu", "way": "div breadcrumb", "ad": "div ad", "side": "aside sidebar", "note": "div notice", "form": "form newsletter", "talk": "section comments", "share": "div share", "foot": "footer footer", "main": "article post"},
    {"head": "div header", "menu": "ul navigation", "way": "p crumbs", "ad": "aside advert", "side": "div related", "note": "div cookie", "form": "form search", "talk": "div comment-list", "share": "ul social", "foot": "div footer", "main": "div content"},
    {"head": "header top", "menu": "nav navbar", "way": "nav trail", "ad": "div banner", "side": "aside widget", "note": "aside alert", "form": "form login", "talk": "ol replies", "share": "p sharing", "foot": "footer bottom", "main": "main story"},
    {"head": "div brand", "menu": "div nav", "way": "div path", "ad": "section sponsored", "side": "section more", "note": "p consent", "form": "form subscribe", "talk": "div discussion", "share": "div tools", "foot": "footer legal", "main": "article entry"},
    {"head": "header", "menu": "nav", "way": "nav", "ad": "aside", "side": "aside", "note": "div", "form": "form", "talk": "section", "share": "p", "foot": "footer", "main": "article"},
    {"head": "div a1", "menu": "div b2", "way": "p c3", "ad": "div d4", "side": "div e5", "note": "div f6", "form": "form g7", "talk": "div h8", "share": "div i9", "foot": "div j0", "main": "div k1"},
    {"head": "header", "menu": "nav", "way": "p", "ad": "div", "side": "aside", "note": "div", "form": "form", "talk": "section", "share": "div", "foot": "footer", "main": "div"},
    {"head": "div x1", "menu": "ul x2", "way": "div x3", "ad": "p x4", "side": "section x5", "note": "section x6", "form": "form x7", "talk": "ul x8", "share": "p x9", "foot": "div y0", "main": "section y1"},
    {"head": "header", "menu": "ul", "way": "div", "ad": "div", "side": "div", "note": "p", "form": "form", "talk": "div", "share": "div", "foot": "footer", "main": "main"},
)


class _Page:
    def __init__(self, site: dict[str, str], rng: random.Random):
        self.site, self.rng = site, rng

    def wrap(self, part: str, inner: str, more: str = "") -> str:
        tag, _, name = self.site[part].partition(" ")
        named = f' {self.rng.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f"<{tag}{named}{more}>{inner}</{tag}>"

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{k}">{label}</a></{tag}>' for k, label in enumerate(self.rng.sample(_LABELS, n)))

    def lines(self, n: int) -> str:
        return " ".join(self.rng.choice(_LINES) for _ in range(n))

    def furniture(self, part: str) -> str:
        r = self.rng
        inner = {
            "head": lambda: f'<div><a href="/">Example Press</a></div><p>News from the coast since {r.randrange(1890, 1990)}</p>',
            "menu": lambda: self.links(r.randrange(3, 8)) if self.site["menu"].startswith("ul") else f"<ul>{self.links(r.randrange(3, 8))}</ul>",
            "way": lambda: " / ".join(f'<a href="#">{x}</a>' for x in r.sample(_LABELS, 2)) + " / Coast",
            "ad": lambda: r.choice(("Buy two lamps and get the third one at half price today.", "Lamps at half price. <a href='/l'>Order now</a>", "<p>" + self.lines(1) + "</p>")),
            "side": lambda: f"<h3>Most read</h3><ul>{self.links(r.randrange(2, 6))}</ul>" + r.choice(("", "<p>More from our archive</p>")),
            "note": lambda: "This site uses cookies. Accept or change the settings." + r.choice(("", "<button>Accept</button>")),
            "form": lambda: "<label>Your mail</label><input name='m'><button>Go</button>" + r.choice(("", "<select><option>Daily</option><option>Weekly</option></select>")),
            "talk": lambda: "<h3>Comments</h3>" + "".join(f"<div><b>{r.choice(('Ann', 'Ben', 'Cleo'))}</b><p>{self.lines(1)}</p></div>" for _ in range(r.randrange(1, 4))),
            "share": lambda: " ".join(f'<a href="#">{x}</a>' for x in r.sample(_LABELS, 2)),
            "foot": lambda: "&copy; Example Press. All rights reserved." + r.choice(("", f"<ul>{self.links(3)}</ul>", "<p>Printed on the coast.</p>")),
        }[part]()
        return self.wrap(part, inner)

    def article(self) -> str:
        r = self.rng
        blocks = [f"<h1>{r.choice(_LINES)[:40].rsplit(' ', 1)[0]}</h1>"]
        for _ in range(r.randrange(1, 9)):
            blocks.append(
                r.choices(
                    (
                        f"<p>{self.lines(r.randrange(1, 5))}</p>",
                        f"<h2>{r.choice(('What changes', 'For passengers', 'Notes'))}</h2><p>{self.lines(2)}</p>",
                        f"<ul><li>{self.lines(1)}</li><li>Dogs pay nothing</li><li>Soup is served below <a href='/d'>deck</a></li></ul>",
                        f"<p>{r.choice(('It rained', 'Nobody asked', 'Three crossings a day, no more', 'The captain, the baker and I', 'See below'))}</p>",
                        f"<blockquote>{self.lines(1)}</blockquote>",
                        f"<p>The <a href='/l'>log of the first crossing</a> lies open. <b>{self.lines(1)}</b><br>{self.lines(1)}</p>",
                        "<table><tr><th>Day</th><th>Boats</th></tr><tr><td>Monday</td><td>three crossings</td></tr></table>",
                        "<figure><figcaption>The old ferry at the pier</figcaption></figure><pre>times follow the tide</pre>",
                    ),
                    weights=(10, 2, 2, 3, 1, 2, 1, 1),
                )[0]
            )
        if r.random() < 0.2:
            return self.wrap("main", "".join(blocks), " data-main")
        inner = "".join(b.replace(">", " data-main>", 1) if not b.startswith("<h2") else f"<div data-main>{b}</div>" for b in blocks)
        cut = r.choice(("", "", self.furniture("ad"), self.furniture("share")))
        return self.wrap("main", inner + cut if r.random() < 0.5 else cut + inner)

    def text(self) -> str:
        some = lambda *parts: "".join(self.furniture(p) for p in parts if self.rng.random() < 0.6)
        body = some("note", "head") + self.furniture("menu") + some("way", "ad") + self.article() + some("share", "talk", "side", "form", "ad") + self.furniture("foot")
        return f"<!DOCTYPE html><html><head><title>The ferry returns</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"


def pages(per_site: int = 12, sites: tuple[int, ...] = tuple(range(len(_SITES)))) -> list[str]:
    """The labelled pages of the sites; the same ones at every call."""
    return [_Page(_SITES[s], random.Random(1000 * s + k)).text() for s in sites for k in range(per_site)]
