"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Zones that are never article text
(navigation, forms, scripts, adverts, comments ... by element or by class and id names)
are set aside while reading. A name tells of a zone by its last word ("site-header",
"share-list"), not by any ("header-fixed", "with-sidebar"); and a zone that only its layout names
ends where an article begins. Pass one decides each remaining block by its length, stop-word
density and link density: good, bad, or open where the block is short or its words say
little. Pass two gives every open block the label of the nearest decided block of its own
container (the nearer one, the earlier at equal distance); without any decided block it
is kept, since zones that are no article text are already gone.

If a page has article or main elements, blocks outside them are bad, and inside them only
links make a block bad. On other pages a long block with few stop words, a short notice of
rights, and three or more short blocks in a row without any stop word are bad as well. Text of a block:
character references decoded, white space as one space, trimmed; blocks joined by \\n.
Defined results: null and empty pages give an empty text; tags cut off at the end of a
page are markup and vanish.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attest.llm.common import only, tidy

# Frequent words of the languages at hand.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die und das den von zu ist mit des im für auf dem nicht ein eine als auch es an werden aus er hat dass sie "
    "le la les et des en un une du est que dans pour qui sur pas plus par au avec ce il sont ne se ou aux "
    "el los las de y por con no su para al lo como más o pero sus del ha me si".split()
)
# Elements whose content is no article text, and elements that end a block.
OUT_TAGS = frozenset("nav header footer aside form script style noscript template iframe button select option textarea "
                     "svg math object canvas dialog menu head title fieldset figcaption audio video map".split())
RAW_TAGS = frozenset("script style textarea title noscript template iframe".split())
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figure footer "
                       "form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td "
                       "tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(["article", "main"])
# Words of class, id and role attributes that name such zones.
OUT_WORDS = frozenset("ad ads advert advertisement adverts banner promo promotion sponsor sponsored sidebar navigation nav "
                      "navbar menu breadcrumb breadcrumbs footer header cookie cookies consent notice gdpr comment comments "
                      "disqus reply replies related recommended share sharing social newsletter subscribe signup login "
                      "popup modal widget pagination pager toolbar complementary contentinfo search".split())
# Of them, those that make an article element itself no article text; others may tell of its layout.
OUT_ARTICLES = frozenset("ad ads advert advertisement adverts promo promotion sponsor sponsored comment comments reply replies "
                         "related recommended".split())
# Words of a name that say nothing of what a zone holds, and such that speak of another element.
AROUND_WORDS = frozenset("list box block section area wrapper wrap container inner outer left right top bottom item items post posts "
                         "article articles link links bar panel content title text row col column group unit slot zone button buttons "
                         "icons tools body author meta count thread card form".split())
LAYOUT_WORDS = frozenset("with has no without is not show hide".split())
NOTICES = re.compile(r"^\W*(?:copyright|©|\(c\))|all rights reserved", re.IGNORECASE)
# Elements that end an open element of the same kind, as writers leave end tags out.
_CLOSES = {t: {t} for t in ("p", "li", "option", "tr", "td", "th")} | {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}}

SHORT, LONG = 70, 200  # characters
STOP_HIGH, STOP_LOW = 0.30, 0.15
LINKS_MOST = 0.33

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^<]*\Z",
                    re.DOTALL)
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z0-9]+")
_GAP = re.compile(r"\s+")


class Block:
    __slots__ = ("container", "linked", "parts")

    def __init__(self, container: int):
        self.container = container
        self.parts: list[str] = []
        self.linked = 0


# A zone by its element, by a name for what is never an article's, or by a name that may be its layout's.
_ELEMENT, _FOREIGN, _LAYOUT = 4, 2, 1


def _named_word(name: str) -> str:
    """The word that says what a class or id stands for."""
    parts = [p for p in _PARTS.split(name) if p]
    if not parts or parts[0] in LAYOUT_WORDS:
        return ""
    while len(parts) > 1 and (parts[-1] in AROUND_WORDS or parts[-1].isdigit()):
        parts.pop()
    return parts[-1]


def _zone(name: str, attributes: str) -> int:
    if name in OUT_TAGS:
        return _ELEMENT
    found = 0
    if name not in ("body", "html"):
        for m in _NAMED.finditer(attributes):
            for word in map(_named_word, (m[1] or m[2] or m[3] or "").lower().split()):
                if word in OUT_ARTICLES:
                    found |= _FOREIGN
                elif word in OUT_WORDS and name not in CONTAINERS:
                    found |= _LAYOUT
    return found


def blocks(page: str) -> tuple[list[Block], bool]:
    """Text blocks in page order, and whether the page has an article or main element."""
    found: list[Block] = []
    # Open elements: (name, zones it is in, container number); container 0 is the page.
    stack: list[tuple[str, int, int]] = []
    containers, links, at = 0, 0, 0
    out, container = 0, 0
    current: Block | None = None

    def text(piece: str) -> None:
        nonlocal current
        if not piece or out:
            return
        if current is None:
            current = Block(container)
            found.append(current)
        current.parts.append(piece)
        if links:
            current.linked += len(_GAP.sub(" ", piece).strip())

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if not m[1]:
            if name == "br":
                text(" ")
                continue
            if name in VOID_TAGS:
                if name in BLOCK_TAGS:
                    current = None
                continue
            if name in BLOCK_TAGS or name in OUT_TAGS:
                current = None
            if stack and stack[-1][0] in _CLOSES.get(name, ()):
                links -= stack.pop()[0] == "a"
            elif name in BLOCK_TAGS and any(s[0] == "p" for s in stack[-4:]):
                # A block inside an open paragraph ends it, with what was left open in it.
                while stack:
                    last = stack.pop()[0]
                    links -= last == "a"
                    if last == "p":
                        break
            out, container = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
            if m[3].endswith("/") and name not in BLOCK_TAGS:
                continue
            if name in RAW_TAGS:
                end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in CONTAINERS:
                out &= ~_LAYOUT
                if container == 0:
                    containers += 1
                    container = containers
            out |= _zone(name, m[3])
            stack.append((name, out, container))
            links += name == "a"
        elif any(s[0] == name for s in stack):
            while True:
                last = stack.pop()[0]
                links -= last == "a"
                if last in BLOCK_TAGS or last in OUT_TAGS:
                    current = None
                if last == name:
                    break
            out, container = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
    return found, containers > 0


def _first_pass(text: str, linked: int, framed: bool) -> int:
    """1 good, 0 bad, -1 open; inside an article only links make a block bad."""
    if linked / max(1, len(text)) > LINKS_MOST:
        return 0
    if not framed and len(text) < LONG and NOTICES.search(text):
        return 0
    if len(text) < SHORT:
        return -1
    words = text.lower().split()
    density = sum(w in STOP_WORDS for w in words) / len(words)
    if density >= STOP_HIGH or density >= STOP_LOW and len(text) >= LONG:
        return 1
    return 0 if not framed and density < STOP_LOW and len(text) >= LONG else -1


def _word_lists(labels: np.ndarray, texts: list[str]) -> None:
    """Three or more short open blocks in a row without a stop word are a list of words: bad."""
    start = 0
    for i in range(len(texts) + 1):
        bare = i < len(texts) and labels[i] < 0 and len(texts[i]) < SHORT and not STOP_WORDS.intersection(texts[i].lower().split())
        if not bare:
            if i - start >= 3:
                labels[start:i] = 0
            start = i + 1


def _second_pass(labels: np.ndarray, container: np.ndarray) -> np.ndarray:
    """Open blocks take the label of the nearest decided one of their container."""
    out = labels.copy()
    for c in np.unique(container):
        at = np.flatnonzero(container == c)
        decided = at[labels[at] >= 0]
        loose = at[labels[at] < 0]
        if not len(decided):
            out[loose] = 1
            continue
        after = np.searchsorted(decided, loose)
        before = np.clip(after - 1, 0, len(decided) - 1)
        after = np.clip(after, 0, len(decided) - 1)
        nearer = np.abs(decided[after] - loose) < np.abs(decided[before] - loose)
        out[loose] = labels[np.where(nearer, decided[after], decided[before])]
    return out


def main_text(page: str) -> str:
    found, framed = blocks(page)
    kept = []
    for b in found:
        text = _GAP.sub(" ", html.unescape("".join(b.parts))).strip()
        if text and (b.container or not framed):
            kept.append((text, b.linked, b.container))
    if not kept:
        return ""
    labels = np.array([_first_pass(t, linked, framed) for t, linked, _ in kept])
    if not framed:
        _word_lists(labels, [t for t, _, _ in kept])
    final = _second_pass(labels, np.array([c for _, _, c in kept]))
    return "\n".join(t for (t, _, _), keep in zip(kept, final, strict=True) if keep == 1)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: (key, url, text, n_chars)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    return only(pages, key=key, url=url, page=page).mapInArrow(tidy(run), "key bigint, url string, text string, n_chars bigint").withColumnRenamed("key", key)
