"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags. The first pass decides blocks by stop-word density, length and link
density; the second lets the undecided ones, short blocks above all, inherit from the nearest decided neighbours.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.arrow import per_text

SHORT, LONG, MOST_LINKS, STOP_DENSITY, KNOWN_DENSITY = 70, 200, 0.2, 0.2, 0.05
# words of a short paragraph that may read like prose, and characters a sentence may have on the average in a language unknown here
FEW_WORDS, SENTENCE = 4, 300

# fixed values: frequent function words
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or our she so that the their there they this to was we were which who will with you
    aber als am auch auf aus bei das dem den der des die du durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et être il ils je la le les leur lui mais même ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con cuando de del donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se sin sobre son su sus también un una y ya""".split()
)
# fixed values: tags that don't end a block; whose content is never text; that hold no article text
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select option head".split())
PLAIN_RAW = frozenset("script style textarea title iframe".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# fixed values: words of class, id or role that mark a container outside the article
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus dialog
    footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted
    sidebar signup sponsor sponsored subscribe subscription toolbar complementary contentinfo""".split()
)
# fixed values: words that articles use as well; what they mark has to read like prose to be article text
WEAK_HINTS = frozenset("recommended related search share sharing skip social widget".split())
# fixed values: hints that articles use in names of their own parts, and elements that hold an article's prose: inside an
# article neither ends the matter
DOUBTFUL = frozenset("copyright dialog login modal overlay signup subscription toolbar".split())
PROSE = frozenset("p blockquote pre".split())
NOT_HINTED = frozenset("html body main article".split())
# elements that hold a piece of text rather than a part of the page: only a whole name, not a part of one, marks them
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption summary".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
ENDS = re.compile(r"[.!?…。！？][\"'»”’)]*(?=\s|$)|[。！？]")
OPPOSITE = re.compile(r"^(?:has|no|with|without|is)[-_]")


def _outside(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element holds no article text, by its tag or by what its class, id and role say, and whether a weak hint
    speaks against it. Inside an article a header is the article's own, and hints at prose are weak."""
    if tag in OUTSIDE and not (inside and tag == "header"):
        return True, False
    if not attributes or tag in NOT_HINTED:
        return bool(attributes) and tag == "article" and "comment" in attributes.lower(), False
    weak = False
    for m in NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            if OPPOSITE.match(name):
                continue
            parts = (name,) if tag in PIECES else re.split(r"[-_]", name)
            if hints := HINTS.intersection(parts) - ({"header"} if inside else set()):
                if not inside or tag not in PROSE and not hints <= DOUBTFUL:
                    return True, False
                weak = True
            weak = weak or not WEAK_HINTS.isdisjoint(parts)
    low = attributes.lower()
    return ("hidden" in low or "display" in low) and bool(HIDDEN.search(attributes)), weak


class Block:
    __slots__ = ("text", "linked", "outside", "weak", "inside", "tag")

    def __init__(self, text: str, linked: int, outside: bool, weak: bool, inside: bool, tag: str):
        self.text, self.linked, self.outside, self.weak, self.inside, self.tag = text, linked, outside, weak, inside, tag

    def stop_words(self) -> tuple[int, int]:
        """How many of the block's words are stop words, and how many words it has."""
        words = [w.strip(".,;:!?\"'()[]*#$%&|<>«»„“”").lower() for w in self.text.split()]
        return sum(map(STOP_WORDS.__contains__, words)), len(words)

    def linky(self) -> bool:
        return self.linked > MOST_LINKS * len(self.text)

    def reads(self, known: bool) -> bool:
        """Whether it reads like prose: stop words enough; where they are of no use on the page, always; and where the block has next to
        none, as in a language unknown here, if it is made of sentences."""
        found, words = self.stop_words()
        return not known or found >= STOP_DENSITY * words or found < KNOWN_DENSITY * words and len(ENDS.findall(self.text)) * SENTENCE >= len(self.text)


def blocks(page: str) -> list[Block]:
    """The page's blocks that hold text, in order. outside: in a container outside the article; weak: in one with a weak hint
    of that; inside: in <article> or <main>; tag: the element that it begins, if it does. An unclosed container ends where an element round it does, or where the page's first article begins."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # (tag, outside, weakly so, in an article) of the open elements
    texts: list[str] = []
    linked = links = at = 0
    outside = weak = inside = False
    begun = ""

    def flush() -> None:
        nonlocal linked, begun
        if texts:
            raw = "".join(texts)
            text = " ".join((references.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, linked, outside, weak, inside, begun))
            texts.clear()
        linked, begun = 0, ""

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            texts.append(raw)
            if links:
                linked += len(raw.strip())

    while m := TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing, attributes = m[2].lower(), m[1], m[3]
        if tag in RAW:
            if not closing and not attributes.endswith("/") and tag != "head":
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if close:
                    at = close.end()
                elif tag in PLAIN_RAW:
                    at = len(page)
            elif tag == "head":
                if not closing and (close := re.compile(r"</head\s*>|<body\b", re.I).search(page, at)):
                    at = close.start() if page[close.start() + 1] != "/" else close.end()
            continue
        if tag == "br":
            add(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE and (closing or not attributes or not any(_outside(tag, attributes, inside))):
            if not any(tag == t for t, *_ in stack[-1:]) or not closing:
                continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            links = 0
        elif tag not in VOID and not attributes.endswith("/"):
            first = tag in ("article", "main") and not inside
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            fresh = first and not any(t in OUTSIDE for t, *_ in stack)
            base, hinted = (False, False) if fresh or not stack else stack[-1][1:3]
            own = _outside(tag, attributes, inside or first)
            stack.append((tag, base or own[0], hinted or own[1], inside or first))
        outside, weak, inside = stack[-1][1:] if stack else (False, False, False)
        begun = "" if closing else tag
    if at < len(page):
        add(page[at:])
    flush()
    return out


def known_language(parts: list[Block]) -> bool:
    """Whether the stop words are of use on this page: some of the words of its longer plain blocks are among them. On a page
    without such blocks there is nothing to be told by."""
    counts = [b.stop_words() for b in parts if not b.outside and not b.linky() and len(b.text) >= SHORT]
    return not counts or sum(s for s, _ in counts) >= KNOWN_DENSITY * sum(n for _, n in counts)


def first_pass(block: Block, known: bool = True) -> str:
    """good or bad if decided; near (reads like prose) or short if not. Links decide outside an article only, and there too
    prose with some links is left to its neighbours."""
    n = len(block.text)
    if block.outside:
        return "bad"
    if block.linky():
        if block.inside and not block.weak:
            return "short"
        return "near" if n >= SHORT and 2 * block.linked <= n and block.reads(known) else "bad"
    if n < SHORT:
        if block.weak:
            return "bad"
        found, words = block.stop_words()
        sentence = block.tag == "p" and words >= FEW_WORDS and found >= STOP_DENSITY * words and ENDS.search(block.text, n - 2)
        return "near" if sentence else "short"
    if block.reads(known):
        return "good" if n > LONG else "near"
    # without stop words only the place tells an odd article from boilerplate
    if block.weak:
        return "bad"
    return "near" if block.tag == "pre" else "short" if block.inside else "bad"


def second_pass(parts: list[Block], labels: list[str]) -> list[bool]:
    """Which blocks are article text. An undecided block takes the label of its nearest decided neighbours: good if both
    are, and if one is, where it reads like prose, is a heading above good text, or lies in the article; only blocks of
    the article count for a block of the article. Without any decided neighbour it is good if the page has no other good
    text of its kind: in the article, or on a page without one."""
    n, article = len(parts), any(b.inside for b in parts)
    kept = [label == "good" for label in labels]
    for inside in (True, False):
        own = [i for i in range(n) if parts[i].inside == inside and not (inside and parts[i].outside)]
        before, last = {}, None
        for i in own:
            before[i] = last
            last = labels[i] if labels[i] in ("good", "bad") else last
        last = None
        for i in reversed(own):
            a, b = before[i], last
            last = labels[i] if labels[i] in ("good", "bad") else last
            if labels[i] in ("good", "bad"):
                continue
            if a is None and b is None:
                kept[i] = inside or not article
            elif inside:
                kept[i] = "good" in (a, b) or "good" not in labels
            elif article:
                kept[i] = a == b == "good"
            else:
                kept[i] = a == b == "good" or "good" in (a, b) and (labels[i] == "near" or parts[i].tag in HEADINGS and b == "good")
    return kept


def main_text(page: str) -> str:
    parts = blocks(page)
    known = known_language(parts)
    kept = second_pass(parts, [first_pass(b, known) for b in parts])
    return "\n\n".join(b.text for b, k in zip(parts, kept) if k)


def extract(df: DataFrame, page: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """The columns `keep` with text, the main text of each whole page, and n_chars, its code points.

    Null and empty pages, and pages without text, give ''. Broken markup ends what it leaves open at the next element
    round it. Pages are independent of each other, so there is no shuffle; other columns are not read."""

    def make(pages: pa.Array) -> list[pa.Array]:
        texts = [main_text(p or "") for p in pages.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

    return per_text(df, page, keep, "text string, n_chars long", make)
