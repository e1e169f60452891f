"""HTML extraction by the maximum-scoring subsequence.

A page becomes a sequence of words and tags. A linear scan finds the contiguous region of the greatest sum of their scores, and the region's words outside
boilerplate elements are the main text; words and tags of boilerplate elements score nothing, so that they can't part an article.

All weights are log odds of lying in the main text, learned from a bounded sample of labelled pages, those that mark their main text as their one article:
a word's by the block element that holds it and by whether it is link text, a tag's by its name (tags score below zero, the more the less main text they come with),
and an element's by the words of its class, id and role, or its name. Fixed lists of names give the prior only, as evidence of so many words.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, by_rows

#: Labelled pages that training reads, about, by the hash of page_id (twice as many at most).
SAMPLE = 512
#: Words of evidence that the prior counts for, tags likewise, and the weight below which an element is boilerplate.
PRIOR_WORDS, PRIOR_TAGS, BOILERPLATE = 200.0, 20.0, -1.0

#: Names of HTML elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
STRUCTURAL = frozenset("nav footer aside form header menu dialog button select option fieldset head".split())
KEPT = frozenset("html body main article".split())
#: Words of class, id and role that name boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer foot header masthead topbar toolbar comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager copyright legal disclaimer contentinfo complementary "
    "paywall outbrain taboola skip hidden".split()
)
#: Words that say nothing beside such a name, as in site-footer.
DECOR = frozenset("site page main post entry article content block box container wrapper wrap inner outer section area region row col column left right top bottom list item items group slot unit body global primary secondary js the".split())
#: Prior log odds: of a word, of link text outside prose, of an element by its name; of a token that is such a name, that has one beside decor, that has one beside other words.
WORD, LINK, NAME, TOKEN, COMPOUND, HINT = 1.0, -0.5, -3.0, -3.0, -2.0, -0.9
#: Scores of an inline and another tag without evidence; prior and most of what an article or main element that holds most of a page's words speaks for a word in it.
INLINE_TAG, TAG, ARTICLE, ARTICLE_MOST = -0.01, -0.1, 2.0, 3.0

_TAG = re.compile(r"""</?[a-zA-Z](?:[^>"'=]++|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z]+")
_CLOSED_BY = frozenset("p li dt dd tr td th option".split())
_ENDS_PARAGRAPH = frozenset("p li dt dd tr td th option div ul ol dl table section article footer nav aside header main h1 h2 h3 h4 h5 h6 form blockquote pre".split())
_PROSE = frozenset("p article main td blockquote".split())


class Element:
    """An open element: its keys, its parent, whether it lies in a link outside prose; the outermost article or main element around it; the name of the block that holds its text; words in it that are no link text."""

    __slots__ = ("own", "parent", "link", "inner", "prose", "block", "words", "bad", "labelled")

    def __init__(self, own: tuple[str, ...], parent: Element | None):
        name = own[0]
        self.own, self.parent, self.words, self.bad, self.labelled = own, parent, 0, False, [0, 0]
        self.inner = parent and parent.inner or (self if name in ("article", "main") else None)
        self.prose = bool(parent and parent.prose) or name in _PROSE
        self.link = bool(parent and parent.link) or name == "a"
        self.block = parent.block if parent and name in INLINE else name

    def context(self) -> str:
        return f"word {self.block}" + (" in a link" if self.link and not self.prose else "")


class Piece(NamedTuple):
    """A text or a tag of a page: kind is text, open or close; text, what it says; element, the one it lies in or that it opens or closes; block, the number of the block."""

    kind: str
    text: str
    element: Element
    block: int


def _keys(name: str, attributes: str) -> tuple[str, ...]:
    """The element's name, then its class, id and role tokens as .token; .hidden if it isn't shown."""
    out = [name]
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        which, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if which in ("hidden", "aria-hidden"):
            if which == "hidden" or value.lower() == "true":
                out.append(".hidden")
        else:
            out += ["." + w for w in value.split()]
    return tuple(dict.fromkeys(out))


def _tag_name(tag: str) -> str:
    return re.match(r"</?([^\s/>]+)", tag)[1].lower()


def _tokens(page: str):
    """Texts and tags of markup, each read once: (text, None) or (None, tag). Comments, declarations and what scripts and the like hold are left out."""
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield page[at:], None
            return
        if start > at:
            yield page[at:start], None
        after = page[start + 1 : start + 3]
        if after[:1] in ("!", "?") and after:
            if page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                yield page[start + 9 : n if end < 0 else end].replace("&", "&amp;"), None
                at = n if end < 0 else end + 3
                continue
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + 2)
            at = n if end < 0 else end + len(mark)
        elif re.match("/?[a-zA-Z]", after):
            if start > last:  # the page ends within a tag
                return
            m = _TAG.match(page, start) if quotes else None
            quotes = m is not None  # after a quote without an end, tags end at the next >
            end = m.end() if m else page.find(">", start) + 1
            tag = page[start:end]
            yield None, tag
            at, name = end, _tag_name(tag)
            if name in RAW and tag[1] != "/" and not tag.endswith("/>"):  # what it holds is no markup
                end = re.compile(f"</{name}(?![\\w-])[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
        else:
            yield "<", None
            at = start + 1


def pieces(page: str) -> tuple[list[Piece], list[Element]]:
    """Texts and tags of a page in order, and its elements, parents first. Scripts, styles and the like are left out; broken markup never fails, and the time is in proportion to the length, however deep elements lie."""
    out: list[Piece] = []
    root = Element(("",), None)
    elements, stack, open_names = [root], [root], Counter()
    solid = [0]  # places on the stack of elements that aren't inline
    block = 0
    for text, tag in _tokens(page):
        if text is not None:
            out.append(Piece("text", text, stack[-1], block))
            continue
        closing = tag[1] == "/"
        name = _tag_name(tag)
        if name not in INLINE:
            block += 1
        if closing:
            if open_names[name]:
                while True:
                    e = stack.pop()
                    open_names[e.own[0]] -= 1
                    if e.own[0] == name:
                        break
                while solid[-1] >= len(stack):
                    solid.pop()
                out.append(Piece("close", name, e, block))
            continue
        if name in RAW:
            continue
        if name in _ENDS_PARAGRAPH:
            # an open paragraph ends where a block starts, an open item where the next one starts, with the inline elements in it
            other = stack[solid[-1]].own[0]
            if other == "p" or other == name and name in _CLOSED_BY:
                for e in stack[solid[-1] :]:
                    open_names[e.own[0]] -= 1
                del stack[solid.pop() :]
        if name in VOID or tag.endswith("/>"):
            out.append(Piece("open", name, Element((name,), stack[-1]), block))
        else:
            e = Element(_keys(name, tag[1 + len(name) : -1]), stack[-1])
            out.append(Piece("open", name, e, block))
            elements.append(e)
            if name not in INLINE:
                solid.append(len(stack))
            stack.append(e)
            open_names[name] += 1
    for p in out:
        if p.kind == "text" and not p.element.link:
            p.element.words += len(p.text.split())
    for e in reversed(elements):
        if e.parent:
            e.parent.words += e.words
    return out, elements


def token_prior(token: str) -> float:
    """Log odds of main text that the fixed lists give a class, id or role token. camelCase, dashes and underscores part words."""
    words = [w.lower() for w in _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token))]
    if not (named := [w for w in words if w in NAMES]):
        return TOKEN if token.lower() in NAMES else 0.0
    rest = [w for w in words if w not in NAMES]
    return TOKEN if not rest else COMPOUND if DECOR.issuperset(rest) else HINT


def _log_odds(inside: float, outside: float, prior: float, weight: float) -> float:
    p = 1 / (1 + math.exp(-prior))
    return math.log((inside + weight * p) / (outside + weight * (1 - p)))


class Weights:
    """Log odds of main text by key, from evidence: for each key, how often it was seen inside and outside."""

    def __init__(self, evidence: dict[str, tuple[float, float]] | None = None):
        self.seen = evidence or {}
        self._memory: dict = {}

    def _remembered(self, key, work):
        if (found := self._memory.get(key)) is None:
            if len(self._memory) > 100_000:
                self._memory.clear()
            found = self._memory[key] = work(key)
        return found

    def word(self, context: str) -> float:
        """Of a word in a context."""
        return self._remembered(context, lambda c: min(2.0, max(-2.0, _log_odds(*self.seen.get(c, (0, 0)), LINK if c.endswith("link") else WORD, PRIOR_WORDS))))

    def article(self) -> float:
        """Of lying in the element that holds most of a page's words, if that is an article or main element."""
        return min(ARTICLE_MOST, max(-ARTICLE_MOST, _log_odds(*self.seen.get("article", (0, 0)), ARTICLE, PRIOR_WORDS)))

    def tag(self, name: str) -> float:
        """Of a tag: below zero."""
        start = INLINE_TAG if name in INLINE or name in ("p", "br") else TAG
        return self._remembered(("tag", name), lambda _: start * math.exp(-min(2.0, max(-2.0, _log_odds(*self.seen.get(f"tag {name}", (0, 0)), 0.0, PRIOR_TAGS)))))

    def element(self, own: tuple[str, ...]) -> tuple[float, bool, bool]:
        """Of an element: its weight; whether its compound tokens alone make it boilerplate; whether only the name header does."""
        return self._remembered(own, self._element)

    def _element(self, own: tuple[str, ...]) -> tuple[float, bool, bool]:
        name, firm, loose, header = own[0], [0.0], [0.0], True
        if name in KEPT:
            return 0.0, False, False
        for key in (name, *own[1:]) if name in STRUCTURAL else own[1:]:
            before = NAME if key == name or key == ".hidden" else token_prior(key[1:])
            inside, outside = self.seen.get(key, (0, 0))
            found = _log_odds(inside, outside, before, PRIOR_WORDS)
            (loose if before == COMPOUND and inside + outside < PRIOR_WORDS else firm).append(found)
            header &= found >= BOILERPLATE or "header" in key.lower()
        low = min(*firm, *loose)
        return low, min(firm) >= BOILERPLATE, header

    def judge(self, elements: list[Element]) -> None:
        """Mark boilerplate elements and what lies in them. The header of an article isn't, nor what compound tokens alone speak against if it holds most of the page's words."""
        total = elements[0].words
        for e in elements[1:]:
            low, loose, header = self.element(e.own)
            spared = loose and 2 * e.words > total or header and e.parent.inner
            e.bad = e.parent.bad or low < BOILERPLATE and not spared


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch of the greatest sum, the first and longest of equals; (0, 0) if no score is positive."""
    best, at, end, total, start = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, k
        total += s
        if total > best or total == best > 0 and start == at:
            best, at, end = total, start, k + 1
    return at, end


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page: its blocks in order, white space inside a block as one space, joined by one space."""
    parts, elements = pieces(page or "")
    weights.judge(elements)
    sizes = [len(p.text.split()) if p.kind == "text" and not p.element.bad else 0 for p in parts]
    held: dict[int, int] = {}
    for (_, _, e, _), n in zip(parts, sizes, strict=True):
        if n and e.inner:
            held[id(e.inner)] = held.get(id(e.inner), 0) + n
    total = sum(sizes)
    most = {k for k, n in held.items() if 2 * n > total}
    scores = []
    for (kind, text, e, _), n in zip(parts, sizes, strict=True):
        if e.bad:
            scores.append(0.0)
        elif kind == "text":
            scores.append(n * (weights.word(e.context()) + (weights.article() if most and id(e.inner) in most else 0.0)))
        else:
            scores.append(weights.tag(text))
    start, end = best_region(scores)
    blocks: dict[int, list[str]] = {}
    for kind, text, e, block in parts[start:end]:
        if kind == "text" and not e.bad:
            blocks.setdefault(block, []).append(text)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return " ".join(t for t in texts if t)


def evidence(page: str | None) -> dict[str, list[int]] | None:
    """For each context, tag and element key: words or tags inside and outside the page's main text. None if the page doesn't mark its main text as its one article."""
    parts, elements = pieces(page or "")
    if sum(e.own[0] == "article" for e in elements) != 1:
        return None
    Weights().judge(elements)
    out: dict[str, list[int]] = {}
    for kind, text, e, _ in parts:
        outside = e.bad or not e.inner
        n = len(text.split()) if kind == "text" else 1
        out.setdefault(e.context() if kind == "text" else f"tag {text}", [0, 0])[outside] += n
        if kind == "text":
            e.labelled[outside] += n
    for e in reversed(elements[1:]):
        for k in (0, 1):
            e.parent.labelled[k] += e.labelled[k]
        for key in e.own:
            a, b = out.get(key, (0, 0))
            out[key] = [a + e.labelled[0], b + e.labelled[1]]
    return out


def learn(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from about sample pages of pages(page_id, html), twice as many at most."""
    n = pages.count()
    some = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)))
    if n > sample and some.select("page_id").count() > 2 * sample:  # where page_ids repeat
        some = some.limit(2 * sample)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                total: Counter = Counter()
                for page in whole.column(0).slice(at, BATCH_ROWS).to_pylist():
                    for key, (a, b) in (evidence(page) or {}).items():
                        total[key, 0] += a
                        total[key, 1] += b
                keys = sorted({k for k, _ in total})
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[k, 0] for k in keys], pa.int64()), pa.array([total[k, 1] for k in keys], pa.int64())], names=["key", "inside", "outside"])

    sums = some.select("html").mapInArrow(run, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    return Weights({r["key"]: (r["inside"], r["outside"]) for r in sums.collect()})  # as many as the sample's pages have


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """For each row of pages(page_id, url, html): page_id, url, text, n_chars (code points of text).

    Null and empty pages, and pages without a word outside boilerplate, have an empty text. A page that ends within a tag ends before it. Repeated rows stay repeated. An empty table gives an empty result.
    Other columns are ignored. Weights are learned from the same pages unless given. Nothing of the pages is shuffled.
    """
    weights = weights or learn(pages.select("page_id", "html"))

    def rows(b):
        texts = [extract(p, weights) for p in b.column(2).to_pylist()]
        return {"page_id": b.column(0), "url": b.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return by_rows(pages.select("page_id", "url", "html"), rows, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
