"""Labelled pages to train the block labeller on: layouts written for this purpose, filled with invented text.

A text that belongs to the article begins with MARK. Layouts differ in the
elements and names they use, in what stands around and inside the article,
and in how long the texts are, so that no single clue decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MARK = ""
_SYLLABLES = "ka lo mi ren tas vel dor ish una per qui sol tem bra cho di fen gal hin jor".split()
# Element and names of the places that hold an article, or something else.
_ARTICLE = ["article", "main", "div id=content", "div class=post-content", "div class='entry-content'", "section class=article-body", "div class=story", "div role=main", "article class=post", "div id=main-content", "div class=text"]
_MENU = ["nav", "ul class=menu", "div id=nav", "div class=navbar", "nav class=breadcrumbs", "div role=navigation", "div class=pagination", "ul class=tags"]
_TOP = ["header", "div id=header", "header class=site-header", "div class=masthead", "div class=topbar", "div role=banner"]
_BOTTOM = ["footer", "div id=footer", "footer class=site-footer", "div class=copyright", "div role=contentinfo"]
_SIDE = ["aside", "div class=sidebar", "div id=sidebar", "aside class=widget", "div class=related", "section class='related-posts'", "div role=complementary"]
_ADVERT = ["div class=ad", "div class=advert", "div class='ad-banner'", "div id=ads", "aside class=ad", "div class=sponsored", "div class=promo", "p class=advertisement", "section class=ads"]
_NOTICE = ["div class='cookie-notice'", "div id=cookie-banner", "div class=notice", "div class=alert", "p class=notice", "div class=gdpr-consent", "div class=subscribe", "div class=newsletter", "div class=popup", "div role=alert"]
_SHARE = ["div class=share", "ul class=social", "div class=share-buttons"]
_COMMENTS = ["div id=comments", "section class=comments", "div class=comment-list", "ol class=commentlist", "div class=discussion", "section id=comments", "div class=responses", "div class=user-replies", "section id=replies", "div class='reader-comments'", "div class=reactions"]
#: Places without a name, of an article or around it.
_PLAIN = ["div", "section", "div", "div class=row", "div class=col", "center", "td"]


class _Page:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, options: list[str]) -> str:
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int, sentence: bool = True) -> str:
        out = []
        odd = self.pick([" |", "%%%", "&amp;&amp;", "!!", " -"]) if self.chance(0.06) else ""
        for _ in range(int(self.rng.integers(low, high + 1))):
            word = "".join(self.rng.choice(_SYLLABLES, int(self.rng.integers(1, 4))))
            if sentence and self.chance(0.1):
                word += self.pick([",", ".", ",", ";"])
            out.append(word + odd)
        return " ".join(out).capitalize() + ("." if sentence else "")

    def within(self, place: str, inside: str) -> str:
        return f"<{place}>{inside}</{place.split()[0]}>"

    def links(self, n: int) -> str:
        item = (lambda: f"<li><a href=/x>{self.words(1, 3, False)}</a></li>") if self.chance(0.7) else (lambda: f"<a href=/y>{self.words(1, 2, False)}</a> ")
        return "".join(item() for _ in range(n))

    def plain_body(self) -> str:
        """Paragraphs in one kind of place: containers without names, or all in one."""
        texts = [MARK + self.words(6, 90) for _ in range(int(self.rng.integers(1, 8)))]
        if self.chance(0.4):
            texts[0] = MARK + self.words(2, 9, False)
        kind = self.rng.random()
        if kind < 0.4:
            return "".join(f"<div>{t}</div>" for t in texts)
        if kind < 0.8:
            return "<div>" + "".join(f"<p>{t}</p>" for t in texts) + "</div>"
        return "".join(f"<p>{t}</p>" for t in texts)

    def body(self) -> str:
        if self.chance(0.3):
            return self.plain_body()
        parts = [f"<h1>{MARK}{self.words(3, 9, False)}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.rng.integers(1, 10))):
            long = self.chance(0.7)
            text = MARK + (self.words(15, 90) if long else self.words(1, 14))
            kind = self.rng.random()
            if kind < 0.66:
                text = text if self.chance(0.8) else text + f" <a href=/z>{self.words(1, 3)}</a> {self.words(2, 8)}"
                parts.append(f"<p>{text}</p>" if self.chance(0.8) else f"<p><b>{text}<br>" if self.chance(0.3) else f"<div>{text}</div>")
            elif kind < 0.74:
                parts.append(f"<h2>{MARK}{self.words(1, 7, False)}</h2>")
            elif kind < 0.82:
                parts.append("<ul>" + "".join(f"<li>{MARK}{self.words(2, 20)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.92:
                parts.append(f"<pre>{text}</pre>")
            elif kind < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4, False)}</td><td>{MARK}{self.words(1, 4, False)}</td></tr>" for _ in range(2)) + "</table>")
            else:
                parts.append(f"<figure><img src=a><figcaption>{MARK}{self.words(3, 15)}</figcaption></figure>")
            if self.chance(0.08):
                parts.append(self.within(self.pick(_ADVERT + _NOTICE + _SHARE), self.words(3, 25)))
            if self.chance(0.03):
                parts.append(self.within(self.pick(_SIDE), f"<p>{self.words(5, 40)}</p>"))
        return "".join(parts)

    def form(self) -> str:
        return f"<form action=/s><label>{self.words(1, 4, False)}</label><input name=q><select><option>{self.words(1, 2, False)}<option>{self.words(1, 2, False)}</select><button>{self.words(1, 2, False)}</button><p>{self.words(3, 15)}</p></form>"

    def comments(self) -> str:
        each = lambda: f"<{self.pick(['div class=comment', 'li class=comment', 'article class=comment', 'p'])}>{self.words(3, 60)}" if self.chance(0.4) else f"<div class=comment><span class=author>{self.words(1, 2, False)}</span><p>{self.words(3, 60)}</p></div>"
        return self.within(self.pick(_COMMENTS), f"<h3>{self.words(1, 3, False)}</h3>" + "".join(each() for _ in range(int(self.rng.integers(1, 6)))))

    def html(self) -> str:
        some = lambda p, make: make() if self.chance(p) else ""
        notice = lambda: self.within(self.pick(_NOTICE), some(0.5, lambda: "<p>") + self.words(4, 40) + some(0.3, lambda: f"<button>{self.words(1, 2, False)}</button>"))
        advert = lambda: self.within(self.pick(_ADVERT), some(0.4, lambda: "<p>") + self.words(2, 45))
        top = some(0.7, lambda: self.within(self.pick(_TOP), some(0.5, lambda: f"<h1>{self.words(1, 3, False)}</h1>") + some(0.4, lambda: f"<p>{self.words(2, 12)}</p>") + self.links(3)))
        side = some(0.5, lambda: self.within(self.pick(_SIDE), f"<h3>{self.words(1, 3, False)}</h3>" + self.links(4) + some(0.5, lambda: f"<p>{self.words(5, 50)}</p>")))
        article = self.within(self.pick(_ARTICLE), self.body()) if self.chance(0.7) else self.within(self.pick(_PLAIN), self.body())
        if self.chance(0.15):
            article = self.body()  # straight in its wrapper
        if self.chance(0.3):
            article = self.within(self.pick(["div class=wrapper", "div id=page", "div class=container", "section"]), article)
        begins = self.chance(0.25)  # with the article
        before = [
            top,
            some(0.8, lambda: self.within(self.pick(_MENU), self.links(int(self.rng.integers(2, 8))))),
            some(0.3, notice),
            some(0.4, advert),
            some(0.3, lambda: side),
        ]
        after = [
            some(0.3, lambda: self.within(self.pick(_SHARE), self.links(3))),
            some(0.3, advert),
            some(0.45, self.comments),
            some(0.35, self.form),
            side,
            some(0.2, notice),
            some(0.85, lambda: self.within(self.pick(_BOTTOM), some(0.6, lambda: "&copy; ") + self.words(2, 25) + some(0.3, lambda: self.links(3)))),
        ]
        page = "".join([*([] if begins else before), article, *([] if self.chance(0.1) else after)])
        return page if self.chance(0.1) else f"<html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{page}</body></html>"


def labelled_pages(n: int, seed: int = 0) -> Iterator[str]:
    """n pages, some cut off somewhere; the same n and seed give the same pages."""
    for i in range(n):
        page = _Page(seed * 1_000_003 + i)
        html = page.html()
        yield html[: int(len(html) * page.rng.uniform(0.4, 1))].rstrip(MARK) if page.chance(0.12) else html
