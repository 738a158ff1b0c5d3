"""Labelled pages for the extraction model: seeded pages of many layouts, blocks labelled in the markup.

An element with ``data-main="1"`` or ``"0"`` labels the blocks below it; the attribute is no feature.
"""

from __future__ import annotations

import random

PAGES = 700
SEED = 31

SYLLABLES = "an en er on ti re la de si mo ver tor que lin sch ould ach ion ment eau ará ñe öß ют на 文 字".split()
CONTENT = (
    '<article data-main="1">{}</article>', '<main data-main="1">{}</main>', '<div id="content" data-main="1">{}</div>',
    '<div class="post-body entry" data-main="1">{}</div>', '<main><article class="story" data-main="1">{}</article></main>',
    '<section class="article-text" data-main="1">{}</section>', '<div role="main"><div class="text" data-main="1">{}</div></div>',
    '<table><tr><td class="body" data-main="1">{}</td></tr></table>', '<div data-main="1">{}</div>',
)
NOTICES = ("cookie-notice", "alert banner", "notice", "consent", "newsletter", "paywall")
ADVERTS = ("ad", "ads", "advert sponsored", "promo", "ad-slot banner")
COMMENTS = (
    '<section id="comments" data-main="0"><h3>{}</h3>{}</section>', '<div class="comments" data-main="0"><h2>{}</h2>{}</div>',
    '<ol class="commentlist" data-main="0"><li>{}</li>{}</ol>', '<div class="discussion replies" data-main="0"><p>{}</p>{}</div>',
)


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def words(self, low: int, high: int) -> str:
        words = ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high))]
        if self.chance(0.1):
            words = [w.upper() + "!!" if self.chance(0.5) else w + "###" for w in words]
        if len(words) > 4 and self.chance(0.7):
            words[self.rng.randrange(1, len(words))] += ","
            words[-1] += "."
        return " ".join(words)

    def links(self, count: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(count))

    def menu(self) -> str:
        links = self.links(self.rng.randint(2, 9))
        return self.rng.choice((
            f'<nav data-main="0"><ul>{links}</ul></nav>', f'<div class="menu navigation" data-main="0"><ul>{links}</ul></div>',
            f'<ul id="nav" data-main="0">{links}</ul>', f'<div class="breadcrumb" data-main="0">{links}</div>',
        ))

    def paragraph(self) -> str:
        text = self.words(*self.rng.choice(((1, 4), (5, 30), (30, 120))))
        if self.chance(0.2):
            text = f"<b>{text}<br>" if self.chance(0.5) else text.replace(" ", ' <a href="/x">', 1) + "</a>"
        kind = self.rng.random()
        if kind < 0.75:
            return f"<p>{text}" + ("</p>" if self.chance(0.8) else "")
        if kind < 0.83:
            return f"<ul>{''.join(f'<li>{self.words(1, 12)}</li>' for _ in range(self.rng.randint(1, 5)))}</ul>"
        return self.rng.choice((f"<h2>{self.words(1, 8)}</h2>", f"<blockquote>{text}</blockquote>", f"<pre>{text}</pre>", f"<div>{text}</div>"))

    def aside(self) -> str:
        inner = self.rng.choice((self.links(4), f"<p>{self.words(4, 40)}</p>", f"<h3>{self.words(1, 3)}</h3><ul>{self.links(3)}</ul>"))
        return self.rng.choice((
            f'<aside data-main="0">{inner}</aside>', f'<div class="sidebar" data-main="0">{inner}</div>',
            f'<div id="related" class="widget" data-main="0">{inner}</div>',
        ))

    def advert(self) -> str:
        return f'<div class="{self.rng.choice(ADVERTS)}" data-main="0">{self.words(2, 14)}</div>'

    def notice(self) -> str:
        return f'<div class="{self.rng.choice(NOTICES)}" data-main="0"><p>{self.words(4, 25)}</p></div>'

    def form(self) -> str:
        return f'<form data-main="0"><label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button></form>'

    def comments(self) -> str:
        each = "".join(f'<div class="comment"><p>{self.words(1, 3)}</p><p>{self.words(2, 50)}</p></div>' for _ in range(self.rng.randint(1, 5)))
        return self.rng.choice(COMMENTS).format(self.words(1, 3), each)

    def page(self) -> str:
        body = []
        if self.chance(0.6):
            body.append(f'<header data-main="0"><h1>{self.words(1, 4)}</h1>{self.menu() if self.chance(0.5) else ""}</header>')
        if self.chance(0.9):
            body.append(self.menu())
        body += [make() for make, share in ((self.advert, 0.5), (self.notice, 0.3), (self.aside, 0.25), (self.form, 0.15)) if self.chance(share)]
        main = [f"<h1>{self.words(1, 9)}</h1>"] if self.chance(0.8) else []
        main += [self.paragraph() for _ in range(self.rng.randint(1, 12))]
        for make, share in ((self.advert, 0.25), (self.aside, 0.1), (self.comments, 0.15), (self.form, 0.1), (self.notice, 0.1)):
            if self.chance(share):
                main.insert(self.rng.randint(1, len(main)), make())
        body.append(self.rng.choice(CONTENT).format("".join(main)))
        body += [make() for make, share in ((self.comments, 0.3), (self.aside, 0.3), (self.advert, 0.2), (self.form, 0.2)) if self.chance(share)]
        if self.chance(0.9):
            foot = self.words(2, 15)
            body.append(self.rng.choice((
                f'<footer data-main="0">&copy; {foot}</footer>', f'<div id="footer" data-main="0"><p>&copy; {foot}</p></div>',
                f'<div class="site-footer legal" data-main="0">{foot} <a href="/t">{self.words(1, 2)}</a></div>',
            )))
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(body)}</body></html>"


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[str]:
    writer = _Writer(seed)
    return [writer.page() for _ in range(count)]
