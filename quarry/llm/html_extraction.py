"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. First pass, each block by itself: long blocks rich in stop
words are good, blocks made of links are bad, the rest, short blocks and long ones poor in stop words, are
undecided. Where all long blocks of a page together are poor in stop words, the page is in a language that the
lists lack, and its long blocks with a sentence's end are good. Element names, roles, classes and ids of navigation, adverts and the like vote: a strong vote
makes a block bad, a weak one only if it is not good by its words. An element that holds nearly all of the
page's good text is its frame, whatever it is called, and has no vote. Second pass: an undecided block takes
the label of its nearest decided neighbours; those in the same article count first, then the nearer one; without an article, a heading follows the next.

Tags are read in one pass, states of open elements are carried on the stack, and votes are summed from the
inner to the outer elements, so the time grows with a page's length whatever it holds.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm._shared import small_batches
from quarry.llm._words import chunks

#: Words at which a block can be decided by its stop words; shares of stop words and of linked characters.
LONG, STOP_LOW, STOP_HIGH, LINKED = 12, 0.08, 0.2, 0.5
#: Share of a page's good text outside an element up to which the element is the page's frame; characters at which linked text in an article is undecided.
OUTSIDE, LONG_LINKED = 0.1, 200
STOP_WORDS = frozenset(
    """the of and to in a is that for it on with as was at by be this are from or an
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch
    de la le et les des en un une du dans est que pour qui sur par au avec pas
    el los las y que del se por con una para su lo al como más""".split()
)
_BLOCK = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOTING = frozenset("nav footer aside form button select dialog menu".split())
#: Elements whose content is no text: up to their end tag, or to the end of the page; the second kind only if there is an end tag.
_RAW, _EMBEDDED = frozenset("script style title textarea iframe noembed noframes xmp".split()), frozenset("noscript template svg math object canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end an open one of the same name beside them.
_BESIDE = frozenset("li dt dd tr td th option".split())
#: Words of class and id values that name what is not the article, and words that may stand beside them.
_MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus
    footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related
    share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget""".split()
)
#: Words that name readers' answers if an element that groups or lists is called so; within an article they may name a part of it.
_ANSWERS, _GROUPS = frozenset("response responses reply replies respond discussion".split()), frozenset("article section ol ul li".split())
_BESIDE_MARKS = frozenset(
    """area article articles bar block body bottom box buttons column container content entry footer form global group inner item items label left level
    link links list main page panel post posts primary reader readers right row secondary section site slot stories text thread title top unit user wrap wrapper""".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
#: Characters of scripts without spaces between words (Han, kana, Thai, Lao, Khmer, Burmese), two of which count as a word; ends of sentences.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")
_SENTENCE = re.compile(r"[.!?…。！？।؟۔][\"'”’»)\]]*(?:\s|$)")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))?+)?+""")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in _RAW | _EMBEDDED}


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    mark: int  # number of the innermost voting element it is in, -1 for none
    article: int  # number of the innermost article or main element it is in, 0 for none
    heading: bool


@dataclass
class Mark:
    strength: int  # 2 strong, 1 weak
    parent: int
    in_article: bool
    holds: bool = False  # an article, main or h1 element


def pieces(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, '/' of an end tag, tag, attributes): the text before each tag. Comments and raw elements are left out."""
    begin = at = 0
    simple = False  # since a quote was never closed, tags end at the next >
    lost: set[str] = set()  # embedded elements without an end tag behind here
    while (lt := page.find("<", at)) >= 0:
        if not (name := _NAME.match(page, lt)):
            after = page[lt + 1 : lt + 2]
            if after not in ("!", "?", "/") or not after:
                at = lt + 1
                continue
            end = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            stop = page.find(end, lt + 2)
            yield page[begin:lt], "", "", ""
            if stop < 0:
                return
            begin = at = stop + len(end)
            continue
        whole = None if simple else _TAG.match(page, lt)
        if whole:
            stop, attributes = whole.end(), whole[3]
        else:
            simple, stop = True, page.find(">", lt) + 1
            if not stop:
                yield page[begin:lt], "", "", ""
                return
            attributes = page[name.end() : stop - 1]
        tag = name[2].lower()
        yield page[begin:lt], name[1], tag, attributes
        begin = at = stop
        if not name[1] and (tag in _RAW or tag in _EMBEDDED and tag not in lost and not attributes.endswith("/")):
            end = _ENDS[tag].search(page, stop)
            if end:
                begin = at = page.find(">", end.end()) + 1 or len(page)
            elif tag in _RAW:
                return
            else:
                lost.add(tag)
    yield page[begin:], "", "", ""


@lru_cache(1 << 14)
def _named(token: str, in_article: bool, groups: bool) -> int:
    """Vote of one class or id: strong if all its words are known, weak if only some name what is not the article."""
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+", token)]
    if "header" in words and not in_article and all(w in ("header", "site", "page", "global", "top", "main", "wrapper", "container", "inner") for w in words):
        return 2
    marks = _MARKS | _ANSWERS if groups else _MARKS
    if not marks.intersection(words):
        return 0
    if any(w in ("no", "not", "without", "with", "has", "hide") for w in words):
        return 0  # says how the page is laid out
    return 2 if all(w in marks or w in _BESIDE_MARKS or w.isdigit() for w in words) else 1


@lru_cache(1 << 14)
def vote(tag: str, attributes: str, in_article: bool) -> int:
    """2, 1 or 0: how surely an element is not the article, by its name, role, class and id."""
    if tag in ("html", "body"):
        return 0
    if tag in _VOTING or tag == "header" and not in_article:
        return 2
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in _ROLES:
        return 2
    return max((_named(token, in_article, tag in _GROUPS) for token in f"{found.get('class', '')} {found.get('id', '')}".split()), default=0)


def blocks(page: str) -> tuple[list[Block], list[Mark]]:
    """The page's blocks with text, in order, and its voting elements, outer ones first."""
    out: list[Block] = []
    marks: list[Mark] = []
    open_: list[tuple[str, int, int]] = []  # (tag, innermost mark, innermost article) of the open block-level elements
    count: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    link, articles, heading = -1, 0, False  # link: open elements where the open link began

    def flush() -> None:
        nonlocal text, linked
        if text and (found := " ".join(entities.unescape("".join(text)).split())):
            _, mark, article = open_[-1] if open_ else ("", -1, 0)
            out.append(Block(found, len(" ".join(entities.unescape("".join(linked)).split())) if linked else 0, mark, article, heading))
        text, linked = [], []

    def leave() -> None:
        nonlocal link
        count[open_.pop()[0]] -= 1
        if link > len(open_):
            link = -1

    for piece, end, tag, attributes in pieces(page):
        if piece:
            text.append(piece)
            if link >= 0:
                linked.append(piece)
        if tag == "a":
            link = -1 if end else len(open_)
        elif tag == "br":
            text.append(" ")
            if link >= 0:
                linked.append(" ")
        elif tag in _RAW or tag in _EMBEDDED:
            text.append(" ")
        elif tag in _BLOCK:
            flush()
            if end:
                if count[tag]:
                    while open_[-1][0] != tag:
                        leave()
                    leave()
            elif tag not in _VOID:
                while open_ and (open_[-1][0] == "p" or open_[-1][0] == "head" or open_[-1][0] == tag and (tag in _BESIDE or tag in _HEADINGS)):
                    leave()
                _, mark, article = open_[-1] if open_ else ("", -1, 0)
                if tag in ("article", "main", "h1"):
                    if mark >= 0:
                        marks[mark].holds = True
                    if tag != "h1":
                        articles += 1
                        article = articles
                if strength := vote(tag, attributes, article > 0):
                    marks.append(Mark(strength, mark, article > 0, tag in ("article", "main")))
                    mark = len(marks) - 1
                open_.append((tag, mark, article))
                count[tag] += 1
            heading = not end and tag in _HEADINGS
    flush()
    return out, marks


def _words(text: str) -> tuple[int, int]:
    """How many words a text has, and how many of them are stop words."""
    words = text.lower().split()
    return len(words) + len(_SPACELESS.findall(text)) // 2, sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words)


def density(block: Block, counts: tuple[int, int], articles: bool, known: bool) -> bool | None:
    """Good, bad, or None for undecided, by links, length and stop words (counts); known: the page's language has stop words."""
    if block.linked >= LINKED * len(block.text):
        sentence = block.linked < len(block.text) and _SENTENCE.search(block.text)
        return None if block.article and (sentence or len(block.text) >= LONG_LINKED) else False
    words, stops = counts
    if block.heading or words < LONG:
        return None
    if not known:
        return True if _SENTENCE.search(block.text) else None
    return True if stops >= STOP_HIGH * words or articles and block.article and stops >= STOP_LOW * words else None


def _votes(found: list[Block], marks: list[Mark], labels: list[bool | None], articles: bool) -> list[int]:
    """The vote that counts in each mark: of its own and the outer elements, but of those that frame the page's text."""
    inside = [0] * len(marks)
    total = 0
    in_articles = any(label and block.article for block, label in zip(found, labels, strict=True))
    for block, label in zip(found, labels, strict=True):
        if label and (block.article or not in_articles):
            total += len(block.text)
            if block.mark >= 0:
                inside[block.mark] += len(block.text)
    for k in range(len(marks) - 1, -1, -1):
        if (parent := marks[k].parent) >= 0:
            inside[parent] += inside[k]
            marks[parent].holds |= marks[k].holds
    out = []
    for mark, own in zip(marks, inside, strict=True):
        near_article = not articles or mark.holds or mark.in_article
        most = OUTSIDE * total if mark.in_article or not articles else 0  # all of the articles, or nearly all of one
        frame = near_article and (total - own <= most if total else mark.holds)
        out.append(max(0 if frame else mark.strength, out[mark.parent] if mark.parent >= 0 else 0))
    return out


def article_text(page: str | None) -> str:
    """The main text: good blocks in page order, joined by one line feed."""
    found, marks = blocks(page or "")
    articles = any(b.article for b in found)
    counts = [_words(b.text) for b in found]
    long = [own for b, own in zip(found, counts, strict=True) if own[0] >= LONG and b.linked < LINKED * len(b.text)]
    known = sum(stops for _, stops in long) >= STOP_LOW * sum(words for words, _ in long)
    labels = [density(b, own, articles, known) for b, own in zip(found, counts, strict=True)]
    votes = _votes(found, marks, labels, articles)
    voted = [False] * len(found)
    for k, block in enumerate(found):
        against = votes[block.mark] if block.mark >= 0 else 0
        if against == 2 or against == 1 and not labels[k] and not block.article:
            labels[k], voted[k] = False, True
    good, decided = set(), set()  # articles
    nearest: list[tuple[int, int]] = []
    last = -1
    for k, block in enumerate(found):
        nearest.append((last, -1))
        if labels[k] is not None and not voted[k]:
            last = k
            (good if labels[k] else decided).add(block.article)
    last = -1
    for k in range(len(found) - 1, -1, -1):
        nearest[k] = (nearest[k][0], last)
        if labels[k] is not None and not voted[k]:
            last = k
    keep = []
    for k, (block, label) in enumerate(zip(found, labels, strict=True)):
        if label is None:
            near = [x for x in nearest[k] if x >= 0]
            if block.article:
                own = [x for x in near if found[x].article == block.article]
                label = any(labels[x] for x in own) if own else block.article in good or block.article not in decided
            elif articles:
                label = False
            elif block.heading and nearest[k][1] >= 0:  # it heads what follows
                label = labels[nearest[k][1]]
            elif len(near) == 2 and labels[near[0]] != labels[near[1]]:
                label = labels[near[0] if k - near[0] <= near[1] - k else near[1]]
            else:
                label = labels[near[0]] if near else True
        if label:
            keep.append(block.text)
    return "\n".join(keep)


def _extract(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, schema.names[0]):
                texts = [article_text(page) for page in part.column(0).to_pylist()]
                new = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip([*part.columns, *new], schema.types, strict=True)], schema=schema)

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with text, the article of html, and n_chars, its code points; columns of these names give way.

    Character references are decoded; white space inside a block becomes one space; blocks are joined by
    \\n. A null, empty or article-less page has an empty text; repeated rows are each answered; an empty
    table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    base = small_batches(pages).select("html", *(c for c in pages.columns if c not in ("html", "text", "n_chars")))
    extra = pages.sparkSession.createDataFrame([], "text string, n_chars long").schema
    schema = type(extra)([*base.schema.fields, *extra.fields])
    return base.mapInArrow(_extract(to_arrow_schema(schema)), schema)


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every page of the table."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op8_html_extraction": op8_html_extraction}
# The pages' articles by their tags alone: the SQL needs no rules, for these pages have one article element each.
ORACLE_SQL = {
    "op8_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_transform(string_split(regexp_replace(regexp_replace(h, '</?(p|h1)>', chr(1), 'g'), '<br>', ' ', 'g'), chr(1)), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(x, '&copy;', '©'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
}
