"""Made-up pages whose blocks have known roles: what the block labeller is trained on.

Layouts differ in order, nesting, class names and wording; words are syllables drawn alike
for articles and for the rest, so that roles are learned from structure and from the few
words that page furniture really uses.
"""

from __future__ import annotations

import numpy as np

#: Class and id words that pages use for parts that are no article.
FURNITURE = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs toc links tabs pagination pager",
    "header": "header masthead topbar banner logo branding site-header page-header tagline",
    "footer": "footer foot site-footer bottom colophon copyright legal",
    "aside": "sidebar aside side widget related recommended popular trending more-posts rail",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense ad-slot",
    "notice": "cookie cookies consent notice alert gdpr newsletter subscribe popup modal paywall disclaimer",
    "comments": "comments comment comment-list replies reply discussion responses disqus reader-comments",
    "share": "share social sharing follow tags meta byline",
}
#: Class and id words around articles.
BODY = "article main content post entry story body text post-content entry-content article-body main-content"
#: Words of page furniture.
SAID = {
    "nav": "home about contact menu next previous search login",
    "header": "welcome home search login register",
    "footer": "copyright all rights reserved privacy policy terms contact imprint",
    "aside": "related popular recent posts more read also recommended",
    "ad": "advertisement sponsored buy now sale offer shop deal",
    "notice": "we use cookies accept consent subscribe newsletter sign up",
    "comments": "comment comments reply says wrote ago posted by report like",
    "share": "share tweet facebook email print tags posted by",
}
SYLLABLES = "ka lo mi ren tas vu shi pol der an est qui or bla zen fu gra tel nos wi eau ung ción heit ment".split()


class PageGrammar:
    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, of):
        return of[int(self.r.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(self.r.integers(low, high))
        out = ["".join(self.pick(SYLLABLES) for _ in range(int(self.r.integers(1, 4)))) for _ in range(n)]
        for i in range(0, n, 9):
            out[i] = out[i].capitalize()
            out[max(0, i - 1)] += self.pick([".", ".", ",", ""])
        return " ".join(out) + self.pick([".", ".", ""])

    def attrs(self, names: str, p: float = 0.85) -> str:
        if not self.chance(p):
            return self.pick(["", "", f' class="{self.pick(SYLLABLES)}{self.pick(SYLLABLES)}"'])
        name = self.pick(names.split())
        other = self.pick(["", "", "", "-wrap", "-box", "_1", " clearfix"])
        return f' {self.pick(["class", "class", "class", "id"])}="{name}{other}"'

    def said(self, role: str, low: int = 0, high: int = 12) -> str:
        own = SAID[role].split()
        use = [self.pick(own) for _ in range(int(self.r.integers(0, 4)))] if self.chance(0.6) else []
        return " ".join([*use, self.words(max(low, 1), high + 2)])

    def furniture(self, role: str) -> str:
        tag = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"],
               "ad": ["div", "div", "aside", "section"], "notice": ["div", "div", "section", "p"], "comments": ["section", "section", "div", "ol"], "share": ["div", "ul", "p"]}[role]
        tag = self.pick(tag)
        bare = tag in ("nav", "footer", "aside", "header")
        a = self.attrs(FURNITURE[role], 0.45 if bare else 1.0)
        if role in ("nav", "share") or (role in ("aside", "footer") and self.chance(0.5)):
            n = int(self.r.integers(2, 9))
            li = [f'<li><a href="/{self.pick(SYLLABLES)}">{self.words(1, 4) if self.chance(0.6) else self.said(role, 0, 2)}</a></li>' for _ in range(n)]
            inner = "".join(li) if tag in ("ul", "ol") else f"<ul>{''.join(li)}</ul>" if self.chance(0.7) else "".join(x[4:-5] for x in li)
            if role == "aside" and tag not in ("ul", "ol"):
                inner = f"<h3>{self.said(role, 1, 3)}</h3>" + inner
        elif role == "comments":
            c = [f'<div{self.attrs("comment reply comment-body user-comment")}><b>{self.words(1, 3)}</b><p>{self.words(4, 45)}</p></div>' for _ in range(int(self.r.integers(1, 6)))]
            inner = (f"<h3>{self.said(role, 1, 3)}</h3>" if self.chance(0.6) else "") + "".join(c)
            if self.chance(0.4):
                inner += f"<form><label>{self.words(1, 3)}</label><textarea></textarea><button>{self.words(1, 3)}</button></form>"
        elif role == "header":
            inner = f"<h1>{self.words(1, 5)}</h1>" if self.chance(0.4) else f'<a href="/">{self.words(1, 4)}</a>'
            inner += f"<p>{self.said(role, 2, 9)}</p>" if self.chance(0.5) else ""
        elif role == "ad":
            t = self.said(role, 2, 25)
            inner = t if self.chance(0.7) else f"<p>{t}</p>"
        else:
            t = ("&copy; " if role == "footer" and self.chance(0.5) else "") + self.said(role, 2, 30)
            inner = t if self.chance(0.5) or tag == "p" else f"<p>{t}</p>"
            if role == "notice" and self.chance(0.5):
                inner += f"<button>{self.said(role, 1, 2)}</button>"
        return f"<{tag}{a}>{inner}</{tag}>"

    def article(self) -> str:
        tag = self.pick(["article", "article", "main", "div", "div", "section"])
        parts = []
        title = f"<h1>{self.words(2, 14)}</h1>"
        parts.append(title if self.chance(0.85) else f"<header>{title}</header>" if self.chance(0.5) else "")
        for _ in range(int(self.r.integers(1, 9))):
            k = self.r.random()
            if k < 0.68:
                t = self.words(2, 90) if self.chance(0.8) else self.words(1, 6)
                if self.chance(0.2):
                    t = f"<b>{t}" + ("</b>" if self.chance(0.6) else "")
                if self.chance(0.2):
                    t += f' <a href="/x">{self.words(1, 4)}</a> {self.words(1, 9)}'
                parts.append(f"<p>{t}</p>" if self.chance(0.85) else f"{t}<br>" if self.chance(0.5) else f"<p>{t}")
            elif k < 0.78:
                parts.append(f"<h2>{self.words(1, 8)}</h2>")
            elif k < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 16)}</li>" for _ in range(int(self.r.integers(2, 6)))) + "</ul>")
            elif k < 0.9:
                parts.append(f"<blockquote>{self.words(4, 30)}</blockquote>")
            elif k < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"\0{self.furniture(self.pick(['ad', 'aside', 'share', 'notice', 'comments']))}\1")
        plain = tag in ("article", "main")
        a = self.attrs(BODY, 0.4 if plain else 0.9)
        inner = "".join(parts)
        if self.chance(0.25):
            inner = f'<div{self.attrs(BODY, 0.7)}>{inner}</div>'
        return f"<{tag}{a}>{inner}</{tag}>"

    def page(self) -> str:
        """HTML in which \\1 starts what is no article and \\2 what is one (state marks, not text)."""
        before = [r for r in ("header", "nav", "notice", "ad") if self.chance(0.55)]
        after = [r for r in ("comments", "aside", "ad", "share", "footer") if self.chance(0.5)]
        if self.chance(0.3):
            self.r.shuffle(before)
        body = "".join("\1" + self.furniture(r) for r in before)
        body += "\2" + self.article().replace("\1", "\2").replace("\0", "\1")
        if self.chance(0.06):
            body += "\2" + self.article().replace("\1", "\2").replace("\0", "\1")
        body += "".join("\1" + self.furniture(r) for r in after)
        if self.chance(0.3):
            body = f"<div{self.pick([' class=\"wrapper\"', ' id=\"page\"', ' class=\"container\"', ''])}>{body}</div>"
        head = f"<html><head><title>{self.words(2, 9)}</title></head>" if self.chance(0.9) else ""
        return f"<!DOCTYPE html>{head}<body>{body}</body></html>"
