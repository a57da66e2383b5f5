"""Labelled pages to train on: invented pages of many layouts, each block known to be article or not."""

from __future__ import annotations

import random

_SYLLABLES = "an be co da el fa gu hi in jo ka le mi no or pa qui re sa ti un ve wo xa yo ze th st ed ing er on".split()


def _words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]


def _sentences(r: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        words = _words(r, r.choice((1, 2, 4, 7, 10, 14, 20, 28)))
        out.append(" ".join(words).capitalize() + r.choice((".", ".", ".", ".", "?", "!")))
    return " ".join(out)


def _title(r: random.Random) -> str:
    return " ".join(_words(r, r.randint(1, 12))).capitalize() + r.choice(("", "", "."))


def _tag(r: random.Random, tags: str, names: str) -> tuple[str, str]:
    """An opening and a closing tag; the tag alone says what it is if it is not a div, section or ul."""
    tag, name = r.choice(tags.split()), r.choice(names.split())
    plain = tag not in ("div", "section", "ul", "ol", "p", "td") and r.random() < 0.6
    return (f"<{tag}>" if plain else f'<{tag} {r.choice(("class", "class", "id"))}="{name}">'), f"</{tag}>"


def _links(r: random.Random) -> list[tuple[str, int, str]]:
    return [("li", 0, f'<a href="/{i}">{" ".join(_words(r, r.randint(1, 3)))}</a>') for i in range(r.randint(2, 8))]


#: Boxes around what is no article: tags, names (classes or ids), what is in them.
_BOXES = {
    "menu": ("nav nav ul div", "menu navbar nav main-nav navigation breadcrumb topmenu", "links"),
    "header": ("header header div", "header site-header masthead top-bar page-header", "short"),
    "footer": ("footer footer div", "footer site-footer page-footer bottom copyright", "short"),
    "sidebar": ("aside aside div", "sidebar side-bar widget related rail", "mixed"),
    "advert": ("div div aside section p", "ad ads advert advertisement promo sponsored banner ad-slot", "prose"),
    "notice": ("div div section p", "cookie-notice notice consent alert gdpr popup newsletter subscribe", "prose"),
    "form": ("form", "search login signup contact-form newsletter", "form"),
    "share": ("div ul", "share social share-buttons tags toolbar", "links"),
    "comments": ("section div ol", "comments comment-list comment reader-comments responses discussion", "comments"),
}
_ARTICLE = ("article article article main div div section td", "content article post entry-content post-body story article-body main-text main body-text")


def _box(r: random.Random, kind: str) -> list:
    tags, names, inside = _BOXES[kind]
    opening, closing = _tag(r, tags, names)
    if inside == "links":
        body = [*_links(r)]
    elif inside == "short":
        n = r.randint(1, 2)
        body = [("" if n == 1 and r.random() < 0.6 else "p", 0, r.choice(("&copy; ", "", "© 2020 ")) + " ".join(_words(r, r.randint(1, 8))) + r.choice(("", " &middot; " + _sentences(r, 1)))) for _ in range(n)]
    elif inside == "mixed":
        body = [("h3", 0, _title(r)), *_links(r), ("p", 0, _sentences(r, r.randint(1, 3)))]
    elif inside == "form":
        body = [("label", 0, " ".join(_words(r, 2))), ("button", 0, _words(r, 1)[0]), ("p", 0, _sentences(r, 1))]
    elif inside == "comments":
        body = [("h3", 0, _title(r))] if r.random() < 0.5 else []
        for _ in range(r.randint(1, 5)):
            body += [("p" if r.random() < 0.6 else "div", 0, _sentences(r, r.randint(1, 5)))]
    else:
        body = [("p" if r.random() < 0.4 else "", 0, _sentences(r, r.randint(1, 3)))]
    return [opening, *body, closing]


def _article(r: random.Random) -> list:
    opening, closing = _tag(r, *_ARTICLE)
    out: list = [opening]
    if r.random() < 0.8:
        out.append((r.choice(("h1", "h1", "h2")), 1, _title(r)))
    for _ in range(r.choice((0, 1, 1, 2, 4, 8, 15))):
        kind = r.random()
        if kind < 0.1:
            out.append(("p", 1, " ".join(_words(r, r.randint(1, 9))) + r.choice(("", "", "***", " %%%", ":", "&amp;"))))
        elif kind < 0.78:
            body = _sentences(r, r.randint(1, 6))
            if r.random() < 0.15:
                body += f' <a href="/x">{" ".join(_words(r, 3))}</a> ' + _sentences(r, 1)
            if r.random() < 0.15:
                body = f"<b>{body}" + r.choice(("</b>", "<br>", ""))
            out.append((r.choice(("p", "p", "p", "p", "div", "blockquote", "pre")), 1, body))
        elif kind < 0.86:
            out += ["<ul>", *(("li", 1, _sentences(r, 1)) for _ in range(r.randint(1, 4))), "</ul>"]
        elif kind < 0.93:
            out.append((r.choice(("h2", "h3")), 1, _title(r)))
        else:
            out += _box(r, r.choice(("advert", "share", "notice", "form")))
    if r.random() < 0.15:
        out += _box(r, "comments")
    return [*out, closing]


def sample_page(r: random.Random) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks with text, in page order."""
    before = [_box(r, k) for k in ("header", "menu", "advert", "notice", "sidebar", "form") if r.random() < 0.45]
    after = [_box(r, k) for k in ("share", "comments", "sidebar", "advert", "menu", "notice", "footer") if r.random() < 0.4]
    r.shuffle(before)
    parts = [x for box in [*before, _article(r), *after] for x in box]
    html, labels = ["<!DOCTYPE html><html><head><title>" + _title(r) + "</title><style>p{}</style></head><body>"], []
    for x in parts:
        if isinstance(x, str):
            html.append(x)
        else:
            tag, label, body = x
            html.append(f"<{tag}>{body}</{tag}>" if tag else body)
            labels.append(label)
    if r.random() < 0.85:
        html.append("</body></html>")
    return "".join(html), labels


def sample_pages(n: int, seed: int = 7) -> list[tuple[str, list[int]]]:
    r = random.Random(seed)
    return [sample_page(r) for _ in range(n)]
