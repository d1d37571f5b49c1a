"""Labelled pages for the extractor: invented pages in the common layouts of the web.

Each element that holds text is marked ``data-main`` 1 or 0 by its part of the page.
The parser hands the mark on as a label; no feature sees it.
"""

from __future__ import annotations

import random

#: Names that page templates give to the parts of a page.
_NAMES = {
    "menu": "menu nav navbar navigation main-menu site-nav top-nav tabs links skip-links breadcrumb breadcrumbs pagination pager toc language-switch",
    "header": "header site-header masthead top-bar topbar logo branding page-header hero-bar search account",
    "footer": "footer site-footer colophon copyright legal bottom-bar footer-links credits page-footer imprint",
    "sidebar": "sidebar side aside widget widgets related related-posts recommended more-stories trending popular most-read rail tags tag-cloud categories author-box",
    "notice": "notice cookie cookie-banner consent gdpr banner alert paywall subscribe newsletter signup popup modal message warning-bar privacy",
    "advert": "ad ads advert advertisement adsbygoogle ad-slot sponsored sponsor promo promotion promoted commercial teaser partner",
    "comments": "comments comment comment-list commentlist respond replies reply discussion disqus reader-comments responses thread",
    "share": "share social sharing share-buttons follow likes toolbar actions",
    "content": "content article article-body post post-content entry entry-content story story-body text body-text main main-content page-content maincontent prose",
    "wrapper": "wrapper container page site row col grid inner outer layout box section wrap region group",
}
_CODES = {part: names.split() for part, names in _NAMES.items()}
_SYLLABLES = "ta ren mi so lu kar ven do pel ish on ber qua ti el ge fo nan wy zu schi eau ción ü é ñ ar un os".split()


class _Page:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def word(self) -> str:
        return "".join(self.random.choices(_SYLLABLES, k=self.random.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.random.randint(low, high)))

    def sentence(self) -> str:
        style = self.random.random()
        text = self.words(1, 18)
        if style < 0.04:
            return text.upper() + "!! "
        if style < 0.08:
            return " | ".join(text.split()) + ". "
        if style < 0.12:
            return " ".join(w + self.random.choice(["###", "$$$", "%%%", "&amp;&amp;&amp;"]) for w in text.split()) + " "
        return text.capitalize() + self.random.choice([". ", ". ", ". ", "? ", "! ", ", "])

    def prose(self, low: int, high: int) -> str:
        text = "".join(self.sentence() for _ in range(self.random.randint(low, high)))
        if self.random.random() < 0.2:
            text = f"<b>{text}</b>" if self.random.random() < 0.5 else f"<b>{text}"
        if self.random.random() < 0.2:
            text += f'<a href="/{self.word()}">{self.words(1, 4)}</a> {self.sentence()}'
        return text

    def part(self, kind: str, tags: list[str], inner: str, named: float = 0.85) -> str:
        tag = self.random.choice(tags)
        attribute = ""
        if self.random.random() < named or tag in ("div", "section"):
            attribute = f' {self.random.choice(["class", "class", "id"])}="{self.random.choice(_CODES[kind])}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def marked(self, tag: str, main: int, inner: str) -> str:
        end = "" if tag == "p" and self.random.random() < 0.15 else f"</{tag}>"
        return f'<{tag} data-main="{main}">{inner}{end}'

    def links(self, low: int, high: int) -> str:
        items = "".join(self.marked("li", 0, f'<a href="/{self.word()}">{self.words(1, 3)}</a>') for _ in range(self.random.randint(low, high)))
        return f"<ul>{items}</ul>"

    def loose(self, tag: str = "p", low: int = 1, high: int = 4) -> str:
        """Text that is not the article's: a paragraph, or bare text in a marked span."""
        inner = self.prose(low, high)
        return self.marked(tag, 0, inner) if self.random.random() < 0.6 else f'<span data-main="0">{inner}</span>'

    def aside(self, kind: str) -> str:
        if kind == "menu":
            return self.part("menu", ["nav", "nav", "div", "ul"], self.links(2, 9), 0.5)
        if kind == "header":
            return self.part("header", ["header", "header", "div"], self.loose(self.random.choice(["p", "h2", "div"]), 1, 1) + (self.links(2, 5) if self.random.random() < 0.5 else ""), 0.6)
        if kind == "footer":
            own = f'<span data-main="0">&copy; {self.word()}.example &middot; {self.prose(1, 4)}</span>' if self.random.random() < 0.6 else self.loose()
            return self.part("footer", ["footer", "footer", "footer", "div"], own + (self.links(2, 6) if self.random.random() < 0.3 else ""), 0.4)
        if kind == "sidebar":
            return self.part("sidebar", ["aside", "aside", "div", "section"], self.marked("h3", 0, self.words(1, 4)) + (self.links(2, 6) if self.random.random() < 0.5 else self.loose()), 0.7)
        if kind == "notice":
            return self.part("notice", ["div", "div", "section", "aside"], self.loose() + (f'<button data-main="0">{self.words(1, 2)}</button>' if self.random.random() < 0.5 else ""))
        if kind == "advert":
            if self.random.random() < 0.2:  # paragraphs hold no other blocks
                return self.part("advert", ["p"], f'<span data-main="0">{self.prose(1, 4)}</span>', 1)
            return self.part("advert", ["div", "div", "aside", "section"], self.loose("div", 1, 4))
        if kind == "form":
            return f'<form action="/{self.word()}"><label data-main="0">{self.words(1, 4)}</label><input name="q">{self.loose()}<button data-main="0">{self.words(1, 2)}</button></form>'
        if kind == "share":
            return self.part("share", ["div", "ul", "p"], f'<span data-main="0">{self.words(1, 3)} <a href="#">{self.word()}</a></span>', 1)
        replies = "".join(self.part("comments", ["div", "li", "article"], self.loose("p", 1, 5), 0.9) for _ in range(self.random.randint(1, 4)))
        return self.part("comments", ["section", "div", "ol"], self.marked("h3", 0, self.words(1, 3)) + replies, 0.95)

    def code(self) -> str:
        lines = [f"{self.word()}{self.random.choice([' = ', '(', ': ', ' - '])}{self.random.randint(0, 99)}{self.random.choice(['', ')', ';'])}" for _ in range(self.random.randint(1, 6))]
        return "\n".join(lines)

    def main_block(self, flow: str) -> str:
        """A block of the article: prose in the article's own kind of element, or one of the others that hold text."""
        kind, mark = self.random.random(), self.marked
        if kind < 0.66:
            tag = self.random.choice(["p", "div", "section"]) if flow == "mixed" else flow
            if tag == "bare":
                return f'<span data-main="1">{self.prose(1, 5)}</span><br><br>'
            return mark(tag, 1, self.prose(1, 9))
        if kind < 0.74:
            return mark(self.random.choice(["h2", "h2", "h3", "h4"]), 1, self.words(1, 6))
        if kind < 0.8:
            tag = self.random.choice(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(mark("li", 1, self.prose(1, 2) if self.random.random() < 0.7 else self.words(1, 5)) for _ in range(self.random.randint(2, 5))) + f"</{tag}>"
        if kind < 0.84:
            return f"<blockquote>{mark('p', 1, self.prose(1, 3))}</blockquote>" if self.random.random() < 0.5 else mark("blockquote", 1, self.prose(1, 3))
        if kind < 0.88:
            rows = "".join("<tr>" + "".join(mark(cell, 1, self.words(1, 4)) for _ in range(self.columns)) + "</tr>" for cell in ["th", *["td"] * self.random.randint(1, 3)])
            return f"<table>{rows}</table>"
        if kind < 0.92:
            return "<dl>" + "".join(mark("dt", 1, self.words(1, 3)) + mark("dd", 1, self.prose(1, 2)) for _ in range(self.random.randint(1, 3))) + "</dl>"
        if kind < 0.96:
            return mark("pre", 1, f"<code>{self.code()}</code>" if self.random.random() < 0.6 else self.code())
        return f'<figure><img src="/{self.word()}.png">{mark("figcaption", 1, self.prose(1, 1))}</figure>'

    def article(self) -> str:
        """The article: a title or none, blocks, and now and then what is not the article's between any two of them."""
        blocks = []
        self.columns = self.random.randint(2, 4)
        flow = self.random.choice(["p"] * 11 + ["div"] * 4 + ["mixed"] * 3 + ["bare"])
        if self.random.random() < 0.82:
            title = self.marked(self.random.choice(["h1"] * 8 + ["h2"]), 1, self.words(2, 10) + self.random.choice(["", "", ".", "&amp;"]))
            blocks.append(f"<header>{title}</header>" if self.random.random() < 0.1 else title)
        often = self.random.choice([0, 0, 0.2, 0.4])
        for _ in range(self.random.choice([1, 2, 3, 5, 8, 12])):
            block = self.main_block(flow)
            blocks.append(block if self.random.random() < 0.93 else f'<div class="{self.word()}-{self.random.randint(0, 99)}">{block}</div>')
            if self.random.random() < often:
                blocks.append(self.aside(self.random.choice(["advert", "notice", "sidebar", "share", "share", "form"])))
        inner = "".join(blocks)
        if self.random.random() < 0.15:
            inner += self.aside("comments")
        style = self.random.random()
        if style < 0.42:
            return f"<article>{inner}</article>"
        if style < 0.55:
            return self.part("content", ["article"], inner, 1)
        if style < 0.65:
            return self.part("content", ["main"], inner, 0.5)
        if style < 0.8:
            return self.part("content", ["div", "section"], inner, 1)
        if style < 0.92:  # a container whose name says nothing
            return f'<div class="{self.word()}{self.random.randint(0, 99)}">{inner}</div>'
        return inner

    def build(self) -> str:
        body = []
        for kind, chance in (("notice", 0.35), ("header", 0.45), ("menu", 0.8), ("advert", 0.5), ("form", 0.15)):
            if self.random.random() < chance:
                body.append(self.aside(kind))
        if self.random.random() < 0.3:
            self.random.shuffle(body)
        body.append(self.article())
        after = [self.aside(k) for k, chance in (("sidebar", 0.4), ("advert", 0.3), ("comments", 0.4), ("form", 0.2), ("menu", 0.1), ("notice", 0.15)) if self.random.random() < chance]
        self.random.shuffle(after)
        body += after
        if self.random.random() < 0.85:
            body.append(self.aside("footer"))
        inner = "".join(body) if self.random.random() < 0.85 else self.article()  # some pages are nothing else
        for _ in range(self.random.choice([0, 0, 1, 2])):
            inner = self.part("wrapper", ["div"], inner, 1) if self.random.random() < 0.7 else f'<div id="{self.word()}-{self.random.randint(0, 9)}">{inner}</div>'
        end = "</body></html>" if self.random.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{inner}{end}"


def labelled_pages(n: int, seed: int) -> list[str]:
    """``n`` pages, the same for the same ``seed``."""
    return [_Page(seed * 1_000_003 + i).build() for i in range(n)]
