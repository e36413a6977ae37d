"""Made pages with known main text, from which the extraction model is learned.

Names of classes and ids are drawn from lists of common ones. MARK before a word says
that it belongs to the article. Some pages have faults that are common on the web:
paragraphs and bold words that are not closed, articles without a container, no body.
"""

from __future__ import annotations

import random

MARK = ""

# Common names in the markup of pages, by what they hold.
MAIN = "article content main post entry story body text maincontent articlebody postbody entrycontent storybody prose markdown blogpost".split()
NEUTRAL = "page wrapper container site inner outer row col column layout grid wrap app root section block center view box".split()
BOILERPLATE = {
    "nav": "nav navigation menu navbar topnav mainmenu breadcrumb breadcrumbs pagination pager toc skiplink tabs links".split(),
    "header": "header masthead topbar branding logo banner tagline sitehead hero".split(),
    "footer": "footer copyright colophon legal bottom siteinfo imprint credits".split(),
    "aside": "sidebar aside widget related recommended trending popular more archive tagcloud tags rail secondary teaser promo authorbox".split(),
    "ad": "ad ads advert advertisement adbox adslot sponsor sponsored banner promo promotion dfp adsense commercial".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup paywall disclaimer toast warning message privacy".split(),
    "form": "form search login contact feedback poll survey register signin searchform".split(),
    "comments": "comments comment commentlist reply replies disqus respond discussion responses feedback thread reviews".split(),
    "share": "share social sharing follow toolbar tools actions print buttons meta byline dateline".split(),
}
_SYLLABLES = "the an er on in re th at nd st en ou ti es or ing ha is it ed le ca mo pa ri su ve do lu bi ko na".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int, main: bool = False) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            w = self.word()
            if self.r.random() < 0.08:
                w += self.r.choice(",.;:")
            out.append((MARK if main else "") + w)
        s = " ".join(out)
        return s + self.r.choice((".", ".", ".", "!", "?", ""))

    def name(self, kind: str) -> str:
        base = self.r.choice(BOILERPLATE.get(kind) or {"main": MAIN}.get(kind, NEUTRAL))
        form = self.r.random()
        if form < 0.5:
            return base
        if form < 0.7:
            return f"{base}-{self.r.choice(('box', 'wrap', 'list', 'item', 'inner', 'container', 'area', 'section', 'block', 'top', '1', '2', 'bar'))}"
        if form < 0.85:
            return f"{self.r.choice(('site', 'page', 'js', 'c', 'm', 'block', 'module', 'ui'))}{self.r.choice('-_')}{base}"
        return f"{self.r.choice(('row', 'col', 'clearfix', 'box', 'module'))} {base}"

    def tag(self, kind: str, inner: str, tags: tuple[str, ...], named: float) -> str:
        tag = self.r.choice(tags)
        if tag not in ("div", "section", "span", "ul", "p") and self.r.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        sure = tag in ("div", "section", "span", "ul", "p")
        attribute = f' {self.r.choice(("class", "class", "id"))}="{self.name(kind)}"' if sure and self.r.random() < named or not sure else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(low, high))]
        form = self.r.random()
        if form < 0.5:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice((" | ", " ", "<br>", " &middot; ")).join(items)

    def sentence(self) -> str:
        return self.r.choice(("{}", "<p>{}</p>", "<span>{}</span>", "<strong>{}</strong>")).format(self.words(3, 25))

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.tag(kind, self.links(3, 9), ("nav", "nav", "div", "ul"), 1)
        if kind == "header":
            inner = self.tag("header", self.words(1, 4), ("div", "span", "p"), 0.6) + r.choice(("", self.links(2, 6), f"<p>{self.words(3, 10)}</p>", f"<h1>{self.words(1, 3)}</h1>"))
            return self.tag(kind, inner, ("header", "div"), 1)
        if kind == "footer":
            return self.tag(kind, f"&copy; {self.word()}.example &middot; {self.words(2, 25)}" + r.choice(("", self.links(2, 6))), ("footer", "footer", "div"), 1)
        if kind == "aside":
            inner = r.choice(("", f"<h3>{self.words(1, 4)}</h3>")) + r.choice((self.links(3, 8), "".join(f"<p>{self.words(8, 40)}</p>" for _ in range(r.randint(1, 3))), self.links(2, 4) + self.sentence()))
            return self.tag(kind, inner, ("aside", "div", "section"), 1)
        if kind == "notice" and r.random() < 0.15:
            return f"<noscript>{self.sentence()}</noscript>"
        if kind in ("ad", "notice"):
            inner = self.sentence() + r.choice(("", f'<a href="#">{self.words(1, 3)}</a>', f"<button>{self.words(1, 2)}</button>", f"<p>{self.words(5, 40)}</p>"))
            return self.tag(kind, inner, ("div", "div", "section", "p", "aside") if kind == "notice" else ("div", "div", "aside", "ins"), 1)
        if kind == "form":
            inner = "".join(f"<label>{self.words(1, 3)}</label><input name='{self.word()}'>" for _ in range(r.randint(1, 4))) + r.choice(("", f"<p>{self.words(4, 20)}</p>")) + f"<button>{self.words(1, 2)}</button>"
            return f"<form>{inner}</form>" if r.random() < 0.7 else self.tag(kind, f"<form>{inner}</form>", ("div", "section"), 1)
        if kind == "comments":
            one = lambda: self.tag("comments", f"<b>{self.word()}</b> {r.choice(('', '<time>1 May</time>'))}<p>{self.words(3, 60)}</p>", ("div", "li", "article", "div"), 0.8)
            inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 5)))
            return self.tag(kind, inner, ("section", "div", "div", "ol"), 1)
        return self.tag("share", self.links(2, 5) if r.random() < 0.6 else self.words(2, 8), ("div", "p", "ul", "div"), 1)

    def inline(self, low: int, high: int) -> str:
        s = self.words(low, high, True)
        form = self.r.random()
        if form < 0.15:
            s = f"<b>{self.words(1, 12, True)}</b> " + s
        elif form < 0.3:
            s += f' <a href="/{self.word()}">{self.words(1, 4, True)}</a> {self.words(1, 15, True)}'
        elif form < 0.4:
            s += f"<br>{self.words(2, 20, True)}"
        elif form < 0.45:
            s += f" <math><mi>{self.words(1, 1, True)}</mi><mo>{MARK}=</mo><mrow>{self.words(1, 3, True)}</mrow></math> {self.words(1, 8, True)}"
        return s

    def part(self) -> str:
        r, form = self.r, self.r.random()
        if form < 0.1:
            tag, low = r.choice(("b", "strong", "em")), r.choice((1, 1, 3, 10))
            end = r.choice((f"</{tag}></p>", "<br>", "<br></p>", f"</{tag}><br></p>"))
            return f"<p><{tag}>{self.words(low, low + r.choice((0, 2, 20)), True)}{end}"
        if form < 0.66:
            end = r.choice(("</p>", "</p>", "</p>", ""))
            return f"<p>{self.inline(*r.choice(((1, 1), (1, 3), (3, 15), (15, 60), (40, 150))))}{end}"
        if form < 0.76:
            return f"<h{(k := r.randint(2, 4))}>{self.words(1, 8, True)}</h{k}>"
        if form < 0.84:
            kind = r.choice(("ul", "ol"))
            return f"<{kind}>" + "".join(f"<li>{self.inline(1, 14)}</li>" for _ in range(r.randint(2, 6))) + f"</{kind}>"
        if form < 0.88:
            return f"<blockquote>{self.inline(5, 40)}</blockquote>"
        if form < 0.92:
            return f"<pre>{self.words(4, 30, True)}</pre>"
        if form < 0.945:
            return f"<object data='/{self.word()}'>{self.inline(3, 20)}</object>"
        if form < 0.955:
            return f"<math>{''.join(f'<mi>{self.words(1, 2, True)}</mi>' for _ in range(r.randint(1, 4)))}</math>"
        if form < 0.975:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4, True)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"
        return f"<div>{self.inline(10, 60)}</div>"

    def html(self) -> str:
        r = self.r
        parts = [f"<h1>{self.words(2, 9, True)}</h1>"] * (r.random() < 0.8) + [self.part() for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20)))]
        for kind in r.sample(("ad", "share", "notice", "aside", "form"), r.choice((0, 0, 1, 2))):
            parts.insert(r.randint(0, len(parts)), self.boilerplate(kind))
        if r.random() < 0.2:
            parts.append(self.boilerplate("comments"))
        body = "".join(parts)
        form = r.random()
        bare = r.random() < 0.1  # the article's parts stand among everything else
        body = body if bare else f"<article>{body}</article>" if form < 0.45 else f"<main>{body}</main>" if form < 0.6 else self.tag("main", body, ("div", "div", "section", "article"), 1)
        if not bare and r.random() < 0.3:
            body = f"<main>{body}</main>" if not body.startswith("<main") else f"<div>{body}</div>"
        before = [self.boilerplate(k) for k in ("header", "nav", "ad", "notice", "form", "aside") if r.random() < 0.45]
        after = [self.boilerplate(k) for k in ("comments", "aside", "share", "ad", "notice", "form", "nav", "footer") if r.random() < (0.8 if k == "footer" else 0.35)]
        r.shuffle(before)
        page = "".join(before) + body + "".join(after)
        for _ in range(r.choice((0, 0, 1, 2))):
            page = f'<div class="{self.name("neutral")}">{page}</div>'
        if r.random() < 0.05:
            return page
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body>{page}</body></html>"


def marked_page(seed: int) -> str:
    """A page of which the words that MARK precedes are the article's."""
    return _Page(seed).html()
