"""Invented pages with known main text, from which the block labeller is trained.

Layouts are put together from parts with a share of chance: what surrounds an article, how it is
marked, what interrupts it.  Texts are invented words, so that the labeller learns from structure
and from the words of surroundings, not from one language.
"""

from __future__ import annotations

import random

# Words found in the surroundings of articles.
CHROME = (
    "home about contact login search menu subscribe newsletter privacy cookies accept share tweet print "
    "related popular advertisement sponsored terms copyright rights reserved reply comment posted sign up "
    "follow next previous more read categories tags archive"
).split()
NOT_MAIN = {
    "menu": ("nav", "ul.menu", "div.navbar", "div#navigation", "div.breadcrumb", "nav.top-nav", "div.menu-links"),
    "ad": ("div.ad", "div.ads", "aside.advert", "div.sponsored", "div#banner-ad", "div.promo", "ins.adsbygoogle"),
    "notice": ("div.cookie-notice", "div.notice", "div#gdpr-consent", "div.alert", "div.popup", "section.banner", "div.paywall"),
    "side": ("aside", "div.sidebar", "aside.widget", "div#secondary", "div.related", "section.recommended", "div.popular-posts"),
    "form": ("form", "form.search", "form#newsletter", "div.subscribe", "form.login", "div.signup-form"),
    "comments": ("section.comments", "div#comments", "div.comment-list", "div.discussion", "ol.comments", "section#responses"),
    "head": ("header", "div.header", "div#masthead", "header.site-header", "div.top"),
    "foot": ("footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.bottom"),
    "share": ("div.share", "div.social", "ul.share-buttons", "div.tags", "div.meta-links"),
}
MAIN = (
    "article", "main", "div.content", "div#content", "div.post", "section.article-body", "div.entry-content",
    "article.post", "div.story", "div#main", "div.text", "article.h-entry", "section", "div",
)
SYLLABLES = "ka lo mi ru te no sa ve pi du ra shu on er th al ing est ou ber cht lle tion".split()


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def prose(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        words[0] = words[0].capitalize()
        for i in range(8, len(words) - 1, self.r.randint(6, 14)):
            words[i] += self.r.choice((".", ",", ";"))
        return " ".join(words) + self.r.choice((".", ".", ".", "!", "?", ""))

    def paragraph(self) -> str:
        """Mostly long; also short ones, and ones with the words of surroundings."""
        r = self.r.random()
        if r < 0.08:
            words = [self.r.choice((self.word(), self.r.choice(CHROME))) for _ in range(self.r.randint(2, 14))]
            return " ".join(words).capitalize() + self.r.choice((".", " 2.0.", " 3.", ""))
        return self.prose(1, 8) if r < 0.28 else self.prose(8, 80)

    def label(self) -> str:
        if self.r.random() < 0.5:
            return " ".join(self.r.choice(CHROME) for _ in range(self.r.randint(1, 4))).capitalize()
        return self.prose(1, 3).rstrip(".")

    def element(self, kind: str, inner: str) -> str:
        tag, _, name = kind.partition(".")
        attribute = "class"
        if "#" in kind:
            tag, _, name = kind.partition("#")
            attribute = "id"
        return f'<{tag} {attribute}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = "".join(f'<li><a href="/x">{self.label()}</a></li>' for _ in range(self.r.randint(low, high)))
        return f"<ul>{items}</ul>" if self.r.random() < 0.8 else items.replace("li>", "span>")

    def part(self, kind: str) -> str:
        shell = self.r.choice(NOT_MAIN[kind])
        r = self.r.random()
        if kind == "menu":
            inner = self.links(3, 8)
        elif kind in ("ad", "notice"):
            inner = self.prose(2, 25) if r < 0.6 else f"<p>{self.prose(3, 25)}</p><a href='/x'>{self.label()}</a>"
        elif kind == "side":
            inner = f"<h3>{self.label()}</h3>" + (self.links(2, 6) if r < 0.6 else f"<p>{self.prose(5, 30)}</p>" * 2)
        elif kind == "form":
            inner = f"<label>{self.label()}</label><input name=q><p>{self.prose(3, 15)}</p><button>{self.label()}</button>"
        elif kind == "comments":
            one = self.r.choice(("div.comment", "li", "article.comment", "div.reply", "div"))
            inner = f"<h2>{self.label()}</h2>" + "".join(
                self.element(one, f"<p>{self.prose(3, 40)}</p>" if self.r.random() < 0.7 else self.prose(3, 40))
                for _ in range(self.r.randint(1, 5))
            )
        elif kind == "head":
            inner = f"<div>{self.label()}</div>" + (self.part("menu") if r < 0.6 else "")
        elif kind == "foot":
            inner = f"&copy; {self.label()} {self.r.randint(1990, 2030)}" if r < 0.6 else f"<p>&copy; {self.prose(3, 12)}</p>" + self.links(1, 4)
        else:
            inner = self.links(2, 4)
        return self.element(shell, inner)

    def article(self) -> tuple[str, list[str]]:
        """Main part and the texts of its blocks."""
        texts: list[str] = []

        def keep(text: str) -> str:
            texts.append(" ".join(text.split()))
            return text

        out = []
        title = self.r.random()
        if title < 0.8:
            head = f"<h1>{keep(self.prose(2, 12))}</h1>"
            out.append(f"<header>{head}</header>" if title < 0.1 else head)
        for _ in range(self.r.randint(1, 14)):
            r = self.r.random()
            if r < 0.74:
                out.append(f"<p>{keep(self.paragraph())}" + ("</p>" if self.r.random() < 0.9 else ""))
            elif r < 0.80:
                out.append(f"<h2>{keep(self.prose(1, 7))}</h2>")
            elif r < 0.86:
                out.append("<ul>" + "".join(f"<li>{keep(self.prose(2, 15))}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif r < 0.89:
                out.append(f"<blockquote><p>{keep(self.prose(5, 30))}</p></blockquote>")
            elif r < 0.91:
                out.append(f"<pre>{keep(self.prose(3, 15))}</pre>")
            else:
                out.append(self.part(self.r.choice(("ad", "share", "form", "side", "notice"))))
        shell = self.r.choice(MAIN)
        return self.element(shell, "".join(out)), texts

    def page(self) -> tuple[str, list[str]]:
        """One page and the texts of its main blocks, in order."""
        chance = lambda p: self.r.random() < p
        main, texts = self.article()
        before = [self.part(k) for k, p in (("notice", 0.3), ("head", 0.5), ("menu", 0.7), ("ad", 0.5), ("form", 0.2), ("side", 0.2)) if chance(p)]
        after = [self.part(k) for k, p in (("share", 0.3), ("form", 0.25), ("comments", 0.4), ("side", 0.4), ("ad", 0.3), ("menu", 0.1), ("foot", 0.8)) if chance(p)]
        if chance(0.3):
            self.r.shuffle(before)
        body = "".join(before) + main + "".join(after)
        if chance(0.3):
            body = self.element(self.r.choice(("div.wrapper", "div#page", "div", "div.container")), body)
        return f"<html><head><title>{self.prose(2, 8)}</title></head><body>{body}</body></html>", texts
