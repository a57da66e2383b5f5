"""The article of a web page: a linear-chain conditional random field over its leaf blocks.

A leaf block is the text between two tags that break lines. Its features are the tags around
it, what their classes and ids hint at, and its own text: words, links, last letter. The
field has two labels; it is trained on labelled pages by the gradient of the conditional
likelihood (forward-backward over all pages at once) and decoded by Viterbi.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.page_samples import sample_pages
from corvane.llm.scratch import small_batches

#: Labelled pages that training reads.
TRAINING_PAGES = 800

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<svg\b[^>]*/>|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|"""
    r"""<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>""",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"""display\s*:\s*none|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
#: Tags that break lines.
_BREAKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend "
    "li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: A start tag ends an open element of these tags, up to the nearest of the last ones.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Beginnings of words in class, id and role that hint at what a box holds.
_HINTS = (
    "ad|ads|advert|sponsor|promo|banner|comment|respons|discuss|reply|sidebar|side|widget|related|recommend|menu|nav|breadcrumb|foot|copyright|head|masthead|cookie|consent|gdpr|notice|alert|popup|modal|"
    "newsletter|subscri|share|social|toolbar|tags|search|login|signup|form|content|article|post|entry|story|body|main|text|rail|bottom|top|complementary|contentinfo|banner"
).split("|")
_EXACT = frozenset({"ad", "ads", "top", "side", "head", "form", "nav"})


@lru_cache(maxsize=50_000)
def _opened(name: str, rest: str) -> tuple[str, ...]:
    """What an element lends to the blocks in it."""
    out = [f"in:{name}"]
    for m in _NAMED.finditer(rest):
        for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", m[1]).lower()):
            out += [f"hint:{h}" for h in _HINTS if word == h or (h not in _EXACT and word.startswith(h))]
    if rest and _HIDDEN.search(rest):
        out.append("hint:hidden")
    return tuple(dict.fromkeys(out))


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    around: tuple[tuple[str, ...], ...]
    linked: float


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks with text of a page, in page order."""
    found: list[Block] = []
    names: list[str] = []
    around: list[tuple[str, ...]] = []
    held: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            held.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                found.append(Block(text, names[-1] if names else "", tuple(around), min(1.0, linked / len(raw))))
        linked = 0

    def close(n: int) -> None:
        del names[n:], around[n:]

    page = page or ""
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            in_link = not m["end"]
        elif name == "br":
            held.append(" ")
        elif name in _BREAKS:
            flush()
            if m["end"]:
                if name in names:
                    close(len(names) - 1 - names[::-1].index(name))
                continue
            in_link = False
            if names and names[-1] == "p":
                close(len(names) - 1)
            ends, upto = _ENDS.get(name, ((), ()))
            for i in range(len(names) - 1, -1, -1) if ends else ():
                if names[i] in upto:
                    break
                if names[i] in ends:
                    close(i)
                    break
            if name not in _VOID:
                names.append(name)
                around.append(_opened(name, m["rest"] if not m["rest"].isspace() else ""))
    if at < len(page):
        held.append(page[at:])
    flush()
    return found


@lru_cache(maxsize=50_000)
def _lent(around: tuple[tuple[str, ...], ...]) -> frozenset[str]:
    return frozenset(f for element in around for f in element)


def features(found: list[Block]) -> list[list[str]]:
    """The features of each block of a page."""
    lent = [_lent(b.around) for b in found]
    holders = [f for f in ("in:article", "in:main", "hint:content", "hint:article", "hint:post", "hint:entry", "hint:story") if any(f in x for x in lent)]
    out = []
    for i, (b, around) in enumerate(zip(found, lent, strict=True)):
        n = b.text.count(" ") + 1
        own = [
            "bias",
            f"tag:{b.tag}",
            f"words:{min(7, n.bit_length())}",
            f"linked:{int(b.linked * 3.99)}",
            "stop" if b.text[-1] in ".!?\"'”»" else "no stop",
            *around,
        ]
        if "©" in b.text or "copyright" in b.text.lower():
            own.append("copyright")
        if holders and not any(h in around for h in holders):
            own.append("outside")
        if i == 0:
            own.append("first")
        if i == len(found) - 1:
            own.append("last")
        out.append(own)
    return out


@dataclass
class Field:
    """Scores of label 1 against 0 for each feature, and of each pair of neighbouring labels."""

    weights: dict[str, float]
    pairs: list[list[float]]

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi); of equal ones the article."""
        get, ((t00, t01), (t10, t11)) = self.weights.get, self.pairs
        back, a, b = [], 0.0, 0.0
        for i, own in enumerate(page):
            score = sum([get(f, 0.0) for f in own])
            if i:
                x0, x1, y0, y1 = a + t00, b + t10, a + t01, b + t11
                back.append((x1 >= x0, y1 >= y0))
                a, b = max(x0, x1), max(y0, y1) + score
            else:
                b = score
        if not page:
            return []
        label = int(b >= a)
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[str, list[int]]], turns: int = 150, shrink: float = 0.02) -> Field:
    """Fit the field to labelled pages (html, labels of its blocks)."""
    names: dict[str, int] = {}
    columns, lengths, labels = [], [], []
    for page, known in pages:
        own = features(blocks(page))
        if len(own) != len(known):
            raise ValueError("a label for each block is needed")
        for x in own:
            columns.append([names.setdefault(f, len(names)) for f in x])
        lengths.append(len(own))
        labels += known
    if not labels:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]])
    y = np.array(labels)
    flat = np.concatenate([np.array(c) for c in columns])
    of = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    length = np.array(lengths)
    start = np.cumsum(length) - length
    most = int(length.max())
    step = np.arange(most)
    inside = step[None, :] < length[:, None]
    place = np.where(inside, start[:, None] + step[None, :], 0)
    gold_pairs = np.zeros((2, 2))
    for s, n in zip(start, length, strict=True):
        np.add.at(gold_pairs, (y[s : s + n - 1], y[s + 1 : s + n]), 1) if n > 1 else None
    w, t = np.zeros(len(names)), np.zeros((2, 2))
    gw, gt = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(turns):
        unary = np.bincount(of, weights=w[flat], minlength=len(columns))[place]
        unary = np.stack([np.zeros_like(unary), unary], axis=2)
        forward, backward = np.zeros((len(length), most, 2)), np.zeros((len(length), most, 2))
        forward[:, 0] = unary[:, 0]
        for k in range(1, most):
            forward[:, k] = np.logaddexp.reduce(forward[:, k - 1, :, None] + t, axis=1) + unary[:, k]
        for k in range(most - 2, -1, -1):
            later = np.logaddexp.reduce(t + (unary[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(inside[:, k + 1, None], later, 0)
        whole = np.logaddexp.reduce(forward[np.arange(len(length)), np.maximum(length - 1, 0)], axis=1)
        p1 = np.exp(forward[:, :, 1] + backward[:, :, 1] - whole[:, None])[inside]
        d_w = np.bincount(flat, weights=(y - p1)[of], minlength=len(names)) - shrink * w
        both = np.exp(np.minimum(forward[:, :-1, :, None] + t + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None], 0))
        d_t = gold_pairs - both[inside[:, 1:]].sum(axis=0) - shrink * t
        gw += d_w**2
        gt += d_t**2
        w += 0.5 * d_w / np.sqrt(gw)
        t += 0.5 * d_t / np.sqrt(gt)
    return Field({f: float(w[i]) for f, i in names.items()}, t.tolist())


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, field.decode(features(found)), strict=True) if label)


def _extracted(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py(), field) for p in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, labelled: list[tuple[str, list[int]]] | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text (its article, '' if none), n_chars.

    Blocks of the article are joined by one line break, each with single spaces and decoded character
    references. ``labelled``: pages to train on; by default ``TRAINING_PAGES`` invented ones.
    Null, empty and blank html: no text. Plain text without tags is one block. Broken markup is read
    as far as it goes; whole pages are read, however long. Repeated rows give equal rows, null ids stay
    null, an empty table gives an empty result, further columns are ignored.
    """
    field = train(sample_pages(TRAINING_PAGES) if labelled is None else labelled)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return small_batches(pages).select("page_id", "url", "html").mapInArrow(lambda x: _extracted(x, field), schema)
