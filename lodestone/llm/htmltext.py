"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: blocks in structural boilerplate (menus, page headers, footers,
sidebars, forms, adverts, notices, comments, by tag or by the words of class, id and role) and blocks that are mostly
links are bad; long blocks with a good share of stop words are good; blocks without enough stop words are bad; short ones
stay open. Stop words tell only of four languages: in a page whose text holds hardly any, the form of sentences stands for
them, and in text mostly of letters beyond Latin length alone decides. Second pass: an open block takes the label of its
nearest decided neighbours; where the two sides differ, the nearer one counts, and bad wins a tie; a heading goes with what
follows it. Inside an element that the page itself marks as its article, a block is open rather than bad for want of stop
words, only neighbours inside it count, and it is bad only between bad ones.

Menus, footers, asides, dialogs, page headers and comments are never text. All other signs of boilerplate - class words such
as `sidebar`, `social` or `promo`, and forms - are votes: layout names often stand on a wrapper, and some pages are one form.
An element so voted keeps its text if it holds half of the page's marked articles, or, where none is marked, two thirds of
the page's text out of links. A page that would be empty although it has long blocks in sentences gives those.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space in page
order. Nothing else is dropped or capped. The tokeniser takes time in proportion to the page, whatever is left unclosed.

Cases: null and empty pages give an empty text; broken, unclosed and cut-off markup is read as far as it goes: an unended
comment or script reaches the end of the page, as does a tag after which no > comes; very long pages are read whole;
repeated rows are extracted alike, so there are no ties to break; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import slices

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our she so that the their them then there they this to was we were what when which who will with you your "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei bin bis da das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so und von war was wie wir zu zum zur über "
    "al como con del donde el ella ellos era es esta este fue ha hay la las lo los más me muy no nos o para pero por que se sin sobre su sus también te un una uno y ya".split()
)
# Elements by their part in a page.
RAW = frozenset("script style title textarea iframe".split())  # without an end they reach that of the page
DROPPED = RAW | frozenset("noscript template svg canvas select button audio video".split())
BAD_TAGS = frozenset("nav aside footer menu dialog".split())
CONTAINERS = frozenset("nav aside footer form menu dialog header article main section div ul ol dl table tbody thead tr td th figure fieldset details blockquote center body".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address caption figcaption summary legend option html br".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager toolbar skip".split()
)
STATES = frozenset("no not has have with without is".split())  # such class names tell of a page's layout, not of the element
SPOKEN = frozenset("comment comments reply replies respond disqus".split())  # never the page's own text
PAID = frozenset("ad ads advert advertisement sponsored promo".split())  # of an article, only these speak against it
NEXT = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
SIMPLE = re.compile(r"((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*)>")  # the rest of a tag that holds no < or >
VALUE = re.compile(r">|=\s*[\"']")
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|</{t}\s*\Z", re.I) for t in DROPPED}
HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[^\W\d_]+")
OTHER = re.compile(r"[^\W\d_\x00-\u024f]")
DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")  # scripts that say more in a character
SENTENCE = re.compile(r"[.!?\u2026][\"'\u00bb\u201d\u2019)\]]*(?=\s|$)")
OPEN, GOOD, BAD, VOTED = 0, 1, -1, -2


def _role(tag: str, attrs: str, in_article: bool) -> int:
    """-1 for boilerplate, -2 for a vote for it, 1 for a marked article, 0 for none of these."""
    if tag in BAD_TAGS or tag == "header" and not in_article:
        return BAD
    article, role = tag in ("article", "main"), VOTED if tag == "form" else OPEN
    if attrs and tag not in ("body", "main"):
        for m in HINT.finditer(attrs):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                words = [w for w in re.split(r"[^a-z]+", name) if w]
                if not words or words[0] in STATES:
                    continue
                if words[0] in SPOKEN:
                    return BAD
                if words[0] in PAID if article else any(w in BAD_WORDS for w in words) or name in ("contentinfo", "complementary", "search"):
                    role = VOTED
    return role if role == VOTED else GOOD if article else OPEN


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before it, element in lower case, end tag?, attributes) of each tag; "" for a comment or the end of the page.

    A dropped element is one token, with its content left out. Every character is looked at a bounded number of times.
    """
    at, say, loose, unended = 0, 0, False, set()
    while m := NEXT.search(page, at):
        text, tag = page[say : m.start()], (m[2] or "").lower()
        if not tag:
            end = page.find("-->", m.end()) + 2 if m[0] == "<!--" else page.find(">", m.end())
            if end < (2 if m[0] == "<!--" else 0) or end == 1:
                end = len(page)
            yield text, "", False, ""
        else:
            if s := SIMPLE.match(page, m.end()):
                end = s.end() - 1
            else:
                end = -1
                if not loose:  # quoted values may hold < and >
                    pos = m.end()
                    while v := VALUE.search(page, pos):
                        if v[0] == ">":
                            end = v.start()
                            break
                        if (pos := page.find(v[0][-1], v.end()) + 1) == 0:
                            break
                    loose = end < 0  # some quote never ends: from here on, tags end at the next >
                if end < 0:
                    end = page.find(">", m.end())
            attrs = page[m.end() : end] if end >= 0 else ""
            if end < 0:
                end = len(page)
            if tag in DROPPED and not m[1] and not (tag not in RAW and attrs.endswith("/")):
                close = None if tag in unended else ENDS[tag].search(page, end + 1)
                if close:
                    end = close.end() - 1
                elif tag in RAW:
                    end = len(page)
                else:
                    unended.add(tag)
            yield text, tag, bool(m[1]), attrs
        at = say = min(end + 1, len(page))
    if say < len(page):
        yield page[say:], "", False, ""


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    bad: bool  # in boilerplate
    votes: tuple[int, ...]  # numbers of the elements around it that are voted boilerplate
    article: int  # number of the marked article, or 0
    heading: bool


def blocks(page: str) -> list[Block]:
    """The blocks with text."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # element, role, article outside it
    open_now: Counter[str] = Counter()
    votes: list[int] = []
    bad = article = articles = link = voted = 0
    heading = False
    text: list[str] = []
    linked: list[str] = []

    def close() -> None:
        words = " ".join(html.unescape("".join(text)).split())
        if words:
            own = " ".join(html.unescape("".join(linked)).split())
            out.append(Block(words, len(own), bad > 0, tuple(votes[-64:]), article, heading))
        text.clear()
        linked.clear()

    def say(s: str) -> None:
        text.append(s)
        if link:
            linked.append(s)

    for before, tag, ends, attrs in tokens(page):
        if before:
            say(before)
        if not tag:
            continue
        if tag in DROPPED:
            close()
            continue
        if tag == "a":
            link = 0 if ends else 1
        if tag not in BREAKS:
            continue
        close()
        heading = not ends and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag not in CONTAINERS:
            continue
        if not ends:
            role = _role(tag, attrs, article > 0)
            stack.append((tag, role, article))
            open_now[tag] += 1
            bad += role == BAD
            if role == VOTED:
                voted += 1
                votes.append(voted)
            if (role == GOOD or role == VOTED and tag == "article") and not article:
                articles += 1
                article = articles
        elif open_now[tag]:
            link = 0
            while stack:
                name, role, article = stack.pop()
                open_now[name] -= 1
                bad -= role == BAD
                if role == VOTED:
                    votes.pop()
                if name == tag:
                    break
    close()
    return out


def outvoted(found: list[Block], of_articles: float = 0.5, of_page: float = 2 / 3) -> set[int]:
    """The voted elements that hold so much of the page that they are no boilerplate."""
    own = [(b, len(b.text) - b.linked) for b in found if not b.bad]
    marked = [x for x in own if x[0].article]
    some, share = (marked, of_articles) if sum(n for _, n in marked) else (own, of_page)
    held: Counter[int] = Counter()
    for b, n in some:
        for v in b.votes:
            held[v] += n
    total = sum(n for _, n in some)
    return {v for v, n in held.items() if total and n >= share * total}


def _stops(words: list[str]) -> float:
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _in_sentences(text: str) -> bool:
    """Ends as a sentence does, has a sentence in 400 characters, and not a capital at every other word."""
    ends = list(SENTENCE.finditer(text))
    words = text.split()
    return bool(ends) and ends[-1].end() == len(text) and len(text) <= 400 * len(ends) and len(words) >= 5 * len(ends) and 2 * sum(w[:1].isupper() for w in words) <= len(words) + 2


def foreign(found: list[Block], short: int = 70, few: float = 0.25) -> bool:
    """Whether the page's text out of links and boilerplate holds hardly any stop word."""
    words = [w for b in found if not b.bad and len(b.text) >= short and 2 * b.linked <= len(b.text) for w in WORD.findall(b.text.lower())]
    return len(words) >= 20 and _stops(words) < few


def classify(found: list[Block], short: int = 70, long: int = 200, low: float = 0.3, high: float = 0.32, links: float = 0.2) -> list[int]:
    """Label of each block after both passes."""
    kept, strange = outvoted(found), foreign(found)
    first = []
    for text, linked, bad, votes, article, _ in found:
        density = linked / len(text)
        if bad or not kept.issuperset(votes) or density > (0.5 if article else links):
            first.append(BAD)
            continue
        words = WORD.findall(text.lower())
        if 2 * len(OTHER.findall(text)) > sum(map(len, words)):
            size = len(text) + 2 * len(DENSE.findall(text))
            first.append(OPEN if size < long else GOOD)
            continue
        if len(text) < short:
            first.append(OPEN if article or not linked else BAD)
            continue
        enough, plenty = (_in_sentences(text),) * 2 if strange else ((s := _stops(words)) >= low, s >= high)
        if plenty and len(text) >= long or article and enough:
            first.append(GOOD)
        elif enough:
            first.append(OPEN)
        else:
            first.append(OPEN if article else BAD)
    n, where = len(found), [f.article for f in found]
    left, right = [(0, BAD)] * n, [(0, BAD)] * n
    for side, order, back in ((left, range(n), -1), (right, range(n - 1, -1, -1), 1)):
        for i in order:
            j = i + back
            if not 0 <= j < n or where[j] != where[i]:
                side[i] = (1, OPEN if where[i] else BAD)  # the edge of the page is bad, that of an article undecided
            elif first[j] != OPEN:
                side[i] = (1, first[j])
            else:
                side[i] = (side[j][0] + 1, side[j][1])
    out = []
    for i, label in enumerate(first):
        if label == OPEN:
            (dl, a), (dr, b) = left[i], right[i]
            if where[i]:
                label = BAD if a == b == BAD else GOOD
            elif found[i].heading:
                label = b
            else:
                label = a if a == b or dl < dr else b if dr < dl else BAD
        out.append(label)
    if GOOD not in out:  # better a doubtful article than none
        out = [GOOD if not b.bad and len(b.text) >= long and b.linked <= links * len(b.text) and _in_sentences(b.text) else BAD for b in found]
    return out


def main_text(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    found = blocks(page)
    return " ".join(f.text for f, label in zip(found, classify(found), strict=True) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
