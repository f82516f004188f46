"""Main text of web pages by two-pass block rules.

Markup is cut into blocks at block-level tags. Pass one rates every block by the density of stop words among
its words, its length and the share of its text inside links: good, near good, short (undecided), or bad. Its
place is one more measure: menus, headers, footers, side matter, forms, adverts, notices and comments are bad;
inside an article or main element what is near good is good and what the densities reject is undecided, and beside
one what they accept is bad, unless the article elements hold nothing but links. There links speak against a block
only if it is a list of them: several anchors with little between, or one of several such blocks in a row; a linked title
or paragraph is part of its article.

On pages in whose blocks the known stop words hardly occur, another language's, a block is prose by what all languages
share: sentence marks, the last at its end, in some number for its length, few links, and words that do not just repeat.
Writing without spaces counts two characters as a word. Pass two gives the undecided the label of their nearest decided neighbours: good if those on both sides
are, near good if one is, else short ones the nearer one's. An article's bounds count as good neighbours. Both passes and the cutting are linear
in the page.

Defined cases: null or empty html gives '' and 0; unclosed or stray tags are tolerated; text outside any
block element forms blocks of its own; a page without article is judged by densities alone, in a language without
known stop words by the signs of prose; equal pages get equal texts; input columns that clash with results are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from terrano.llm.arrow_map import with_arrow_columns

#: Frequent function words of the languages in use, and tag names.
STOP_WORDS = frozenset(
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nicht noch sein sich sie sind so und von war wie wird zu zum zur über "
    "a al ante como con de del desde el en entre es esta este la las lo los más mi no o para pero por que se sin sobre su sus un una y ya "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa sans se ses son sur un une vous à".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED_TAGS = frozenset("head nav header footer aside form button select textarea menu dialog iframe object noscript template svg canvas".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe template svg".split())
HOLDERS = frozenset("nav header footer head form".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_NAMES = re.compile(
    r"(?i)(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|widget|menu|nav\w*|breadcrumbs?|"
    r"header|footer|masthead|comments?|comment\w*|replies|respond|disqus|related|recommended|share|sharing|social|tags|pagination|pager|toolbar|search)(?:$|[\s_-])"
)
COMMENT_NAMES = re.compile(r"(?i)(?:^|[\s_-])(?:comment\w*|reply|replies|teaser|related|promo\w*|sponsor\w*|ad|advert\w*)(?:$|[\s_-])")
#: Classes that only tell of other parts, such as has-sidebar.
TOLD_NAMES = re.compile(r"(?i)(?:^|\s)(?:has|with|no|without|is)[_-]\S+")
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MIN_WORDS, LONG_WORDS, LOW_STOP, HIGH_STOP, MAX_LINK = 10, 25, 0.10, 0.25, 0.5
GOOD, NEAR, SHORT, BAD = "good", "near", "short", "bad"
#: Anchors that make a block a list of links, and mostly linked blocks in a row that make one.
LIST_LINKS = 3
#: Prose: at most so much of it in links, a sentence mark for so many words at most and at least, so many different ones of a hundred words.
PROSE_LINK, FEWEST_MARKS, MOST_MARKS, VARIETY = 0.2, 40, 2, 30
_MARKS = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\uff0e\u0964\u06d4\u061f\u1362\u104b]+")
_MARK_AT_END = re.compile(_MARKS.pattern + r"[\s\"'\u00bb\u201d\u2019\u300d\u300f)\]]*$")
#: Letters of writing without spaces between words.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S
)
_NAMED = re.compile(r"""(?i)\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_LETTERS = re.compile(r"[^\W\d_]+")


def _skips(tag: str, attributes: str) -> bool:
    if tag in SKIPPED_TAGS:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    names = COMMENT_NAMES if tag in ("article", "main") else SKIPPED_NAMES
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and names.search(TOLD_NAMES.sub(" ", value)) or name == "role" and value.lower() in SKIPPED_ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


class Block:
    __slots__ = ("text", "words", "linked", "anchors", "stops", "prose", "inside", "out", "label")

    def __init__(self, parts: list[tuple[str, int]], inside: int, out: bool) -> None:
        self.text = " ".join("".join(p for p, _ in parts).split())
        words = _LETTERS.findall(self.text.lower())
        unspaced = len(_UNSPACED.findall(self.text))
        self.words, self.stops = max(len(words), unspaced // 2), sum(w in STOP_WORDS for w in words)
        self.linked = len(" ".join("".join(p for p, a in parts if a).split())) / max(1, len(self.text))
        self.anchors = len({a for _, a in parts if a})
        marks = len(_MARKS.findall(self.text))
        various = len(set(_UNSPACED.findall(self.text) if unspaced > len(words) else words))
        self.prose = (
            self.words >= MIN_WORDS and self.linked <= PROSE_LINK and MOST_MARKS * marks <= self.words <= FEWEST_MARKS * marks
            and 100 * various >= VARIETY * min(100, self.words) and _MARK_AT_END.search(self.text) is not None
        )
        self.inside, self.out, self.label = inside, out, ""


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order. ``inside``: number of the article or main element around, or 0."""
    out: list[Block] = []
    parts: list[tuple[str, int]] = []  # text, the number of the anchor around it or 0
    stack: list[tuple[str, bool, bool]] = []  # tag, starts a skipped part, starts an article
    opened: Counter[str] = Counter()  # tags on the stack
    held: list[int] = []  # places on the stack of skipped parts that no article can be in
    skipped = articles = links = anchor = breaks = number = 0
    raw_until = ""

    def flush() -> None:
        nonlocal parts
        if parts:
            block = Block(parts, number if articles else 0, bool(skipped))
            if block.text:
                out.append(block)
            parts = []

    for m in _TOKEN.finditer(page):
        tag = m[2]
        if tag is None:
            token = m[0]
            if raw_until or token[0] == "<" and len(token) > 1:
                if not raw_until and token.startswith("<![CDATA["):
                    parts.append((token[9:].removesuffix("]]>"), anchor if links else 0))
                continue
            if not token.isspace():
                breaks = 0
            parts.append((entities.unescape(token) if "&" in token else token, anchor if links else 0))
            continue
        tag = tag.lower()
        if raw_until:
            if m[1] and tag == raw_until:
                raw_until = ""
            continue
        if tag in RAW_TAGS:
            if tag in BLOCK_TAGS:
                flush()
            if not m[1] and not m[3].endswith("/"):
                raw_until = tag
            continue
        if tag == "br":
            breaks += 1
            parts.append((" ", 0))
            if breaks > 1:
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            breaks = 0
        if tag in VOID_TAGS:
            continue
        if not m[1]:
            if tag == "p":  # a paragraph does not nest
                while opened["p"] and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a"):
                    gone = stack.pop()
                    opened[gone[0]] -= 1
                    links -= gone[0] == "a"
                    skipped -= gone[1]
            starts = tag in ("article", "main")
            if starts:
                if not articles:
                    number += 1
                articles += 1
            skip = _skips(tag, m[3])
            if starts and not skip and held:  # no menu, header or footer holds an article: it was left unclosed
                for i in held:
                    stack[i] = (stack[i][0], False, stack[i][2])
                skipped -= len(held)
                held = []
            skipped += skip
            if skip and tag in HOLDERS:
                held.append(len(stack))
            if tag == "a":
                links, anchor = links + 1, anchor + 1
            opened[tag] += 1
            stack.append((tag, skip, starts))
        elif opened[tag]:
            while True:
                gone = stack.pop()
                opened[gone[0]] -= 1
                skipped -= gone[1]
                if held and held[-1] == len(stack):
                    held.pop()
                articles -= gone[2]
                links -= gone[0] == "a"
                if gone[0] == tag:
                    break
    flush()
    return out


def rating(b: Block, foreign: bool = False) -> str:
    """A block by its own measures: GOOD, NEAR (good), SHORT (undecided) or BAD. ``foreign``: on a page without known stop words."""
    density = b.stops / max(1, b.words)
    if b.linked > MAX_LINK:
        return BAD if b.words else SHORT
    if b.words < MIN_WORDS:
        return BAD if b.linked > 0 and not b.inside else SHORT
    if density >= HIGH_STOP or foreign and b.prose:
        return GOOD
    if density >= LOW_STOP:
        return GOOD if b.words > LONG_WORDS else NEAR
    return BAD


def lists_of_links(found: list[Block]) -> list[bool]:
    """Whether each block is mostly links and a list of them, or one of several such blocks in a row."""
    out = [b.linked > MAX_LINK and b.anchors >= LIST_LINKS for b in found]
    at = 0
    for i in range(len(found) + 1):
        if i == len(found) or found[i].linked <= MAX_LINK or found[i].inside != found[at].inside:
            if i - at >= LIST_LINKS:
                out[at:i] = [True] * (i - at)
            at = i if i < len(found) and found[i].linked > MAX_LINK else i + 1
    return out


def _nearest(found: list[Block], rated: list[str], order: range) -> list[tuple[int, str] | None]:
    """For each block the nearest one before it, in the order given, that is decided and of the same part of the page."""
    out: list[tuple[int, str] | None] = [None] * len(found)
    last: dict[int, tuple[int, str]] = {}
    for i in order:
        part = found[i].inside
        out[i] = last.get(part)
        if rated[i] in (GOOD, BAD) and not (part and found[i].out):
            last[part] = (i, rated[i])
    return out


def label(found: list[Block]) -> None:
    """Both passes: sets every block's label to good or bad."""
    told = [b for b in found if not b.out and b.linked <= MAX_LINK and b.words >= MIN_WORDS]
    foreign = sum(b.stops for b in told) < LOW_STOP * sum(b.words for b in told)
    rated, listed = [rating(b, foreign) for b in found], lists_of_links(found)
    articles = any(b.inside and not b.out and b.linked <= MAX_LINK for b in found)
    for i, b in enumerate(found):
        if b.out or articles and not b.inside:
            rated[i] = BAD
        elif b.inside and not listed[i] and rated[i] != GOOD:
            rated[i] = GOOD if rated[i] == NEAR else SHORT
    ahead, back = _nearest(found, rated, range(len(found) - 1, -1, -1)), _nearest(found, rated, range(len(found)))
    for i, b in enumerate(found):
        b.label = rated[i]
        if rated[i] in (GOOD, BAD):
            continue
        sides = [(abs(i - x[0]), x[1]) for x in (back[i], ahead[i]) if x is not None]
        if b.inside:
            b.label = GOOD if len(sides) < 2 or any(s[1] == GOOD for s in sides) else BAD
        elif not sides:
            b.label = GOOD
        elif rated[i] == NEAR:
            b.label = GOOD if any(s[1] == GOOD for s in sides) else BAD
        else:
            b.label = min(sides, key=lambda s: (s[0], s[1] != GOOD))[1]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    label(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, html: str = "html", keep_html: bool = False) -> DataFrame:
    """``pages`` with text, the main text, and n_chars, its code points."""
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def of(batch):
            got = [main_text(x) for x in batch.column(html).to_pylist()]
            return {"text": pa.array(got, pa.string()), "n_chars": [len(x) for x in got]}

        return of

    return with_arrow_columns(pages, schema, make, drop=() if keep_html else (html,), rows=256)
