"""Main text of web pages by two passes of block rules.

Pass 1 looks at each block alone: link density makes it bad or undecided, stop-word density and length make it good,
near good or undecided. Pass 2 looks at the neighbours: undecided and near-good blocks take the label of the nearest
decided block, where the two ends of the page count as bad ones. Of two that are as near, the good one wins for paragraphs
and near-good blocks, the bad one for others; a heading goes with what follows it.

Elements come after that, for what no statistic can tell. Blocks in navigation, footers, asides, forms and in elements
whose class, id or role names such a part go, however they read (reader comments, notices); where a name only leans that
way, a long dense block of the article outweighs it. Blocks of an article or main element need one good neighbour; if the
blocks of such elements hold at least as much text that may be good as the rest of the page does, the rest goes. A heading
that announces comments, or short lines with dates that come again and again after the text, begin a thread of comments.

Stop words are of seven languages (STOP_WORDS). Where a page's text holds next to none of them, its blocks are judged by
length, links and place alone. A long block of few stop words and few links is undecided, like a short one.

A page without an article or main element is read as a whole. Unclosed elements end with the page or their parent; a "<"
that no ">" closes is text; after a quote that is never closed, tags end with the next ">". Scripts, styles and comments
never count as text. Null and empty pages give an empty text. Pages of any length are read whole, in time that grows with
their length; repeated rows give equal texts; other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import schema_of

LENGTH_LOW, LENGTH_HIGH = 40, 110
STOP_LOW, STOP_HIGH = 0.08, 0.2
#: Below this share of stop words in a page's text, its language is none of STOP_WORDS and density says nothing.
STOP_PAGE = 0.1
#: Shares of a block's characters in links from which it is undecided, and bad.
LINK_DENSITY, MANY_LINKS = 0.25, 0.6

# Frequent function words.
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are as with be by at this from or have an not but which you they his her has had were we been their "
    "le la les un une des du de et est que qui dans pour pas sur au aux ce il elle en par avec son se ne plus ou mais "
    "der die das und ist den dem ein eine zu mit von auf für im nicht als auch sich es an bei nach wie aus war dass "
    "el los las una y en es por con para del al se no su lo como más o pero sus le ya este sí porque cuando "
    "il lo gli e di che non per sono da del della con si più come nel alla "
    "o os as um uma do da dos das em no na para com não por mais se ao "
    "het een van en dat niet te zijn op met voor aan door".split()
)

# Elements by their part in a page.
_SKIP = frozenset("script style noscript template iframe object svg math select option textarea button canvas audio video map datalist head title".split())
_BAD = frozenset("nav footer aside form menu dialog fieldset".split())
_GOOD = frozenset(["article", "main"])
_RAW = frozenset("script style noscript template iframe textarea title svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
#: Names in class, id or role that mark an element as no part of the main text, whatever else it is called.
_STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments disqus respond reply replies share sharing related recommended recommendation recommendations login searchbox "
    "contentinfo complementary hidden sr-only visually-hidden screen-reader-text".split()
)
#: Names that lean that way: a long dense block inside an article outweighs them.
_LEANING = frozenset("promotion social menu search toolbar skip".split())
#: Those that mark it as the first part of a longer name, too (comment-list, related_posts), and as the last one
#: (site-nav) unless what goes before says that the element only has or lacks such a thing.
_STEMS = frozenset("ad ads advert advertisement sponsored promo banner cookie cookies consent popup modal newsletter nav navbar navigation menu breadcrumb breadcrumbs pagination comment comments disqus related recommended sidebar footer".split())
_HAS = frozenset("has with no without is not show hide js overflow open closed under".split())
#: Beginnings of names that mark it likewise (commentlist, advertbox).
_STRONG_START = re.compile(r"comment(?!ar[yi]|ator)|advert|sponsor|cookie|newsletter|breadcrumb|disqus|adsby|adslot|adbox|adunit")
#: Names that mark it unless another name speaks of content.
_WEAK = frozenset("header footer sidebar side rail widget widgets masthead topbar bottombar meta tags tag byline copyright legal disclaimer alert toc".split())
_CONTENT = frozenset("content article main post entry story body text page".split())
#: Names that mark an article or main element.
_OTHER_ARTICLE = frozenset("ad ads advert advertisement sponsored promo comment comments reply related recommended teaser".split())

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_EDGE = re.compile(r">|=\s*([\"'])")
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden|aria-modal)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I | re.S)
_PARTS = re.compile(r"[-_:]+")
_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
# What announces reader comments, and dates of short lines.
_THREAD = re.compile(r"(?:\d+\s+|leave an?\s+|post an?\s+)?(?:comments?|responses?|replies|reply|thoughts on|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?|commenti|reacties)(?:\s*[(:]\s*\d*\)?|\s+(?:on|to|zu|sur|sobre|a)\s.{1,60})?$", re.I)
_DATED = re.compile(r"\b(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}|\d+\s+(?:second|minute|hour|day|week|month|year|jour|heure|an|mois|día|hora|año|mes)s?\s+ago|(?:vor|hace|il y a)\s+\d+\s+\w+|\d{1,2}\.?\s+[^\W\d_]{3,10}\.?,?\s+\d{4}|[^\W\d_]{3,10}\.?\s+\d{1,2},\s+\d{4})", re.I)


def _marked(tag: str, attrs: str) -> bool:
    """Whether the attributes speak against the element."""
    if not attrs or tag in ("html", "body"):
        return False
    names: list[str] = []
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if key in ("class", "id", "role"):
            names += value.split()
    if tag in _GOOD:
        return any(n in _OTHER_ARTICLE or _PARTS.split(n)[0] in _OTHER_ARTICLE for n in names)
    return any(map(_against, names)) or (any(n in _WEAK or _PARTS.split(n)[0] in _WEAK for n in names) and not any(p in _CONTENT for n in names for p in _PARTS.split(n)))


def _leans(tag: str, attrs: str) -> bool:
    return bool(attrs) and tag not in ("html", "body") and any(n in _LEANING or _PARTS.split(n)[0] in _LEANING for key, value in _ATTR.findall(attrs) if key.lower() in ("class", "id", "role") for n in value.strip("\"'").lower().split())


def _against(name: str) -> bool:
    """Whether a whole name marks an element as no part of the main text."""
    if name in _STRONG or _STRONG_START.match(name):
        return True
    parts = _PARTS.split(name)
    return len(parts) > 1 and (parts[0] in _STEMS or (parts[-1] in _STEMS and parts[0] not in _HAS))


def _main(tag: str, attrs: str) -> bool:
    """Whether the element says that it is the main part."""
    return tag in _GOOD or bool(attrs and re.search(r"\b(?:role\s*=\s*[\"']?main|itemprop\s*=\s*[\"']?articleBody)\b", attrs, re.I))


class _Blocks:
    """The blocks of a page in order: text, characters in links, heading or not, place (-1 against, -2 leaning against
    inside the main part, 1 for, 0), paragraph or not."""

    def __init__(self):
        self.found: list[list] = []
        self.parts: list[str] = []
        self.linked = 0
        self.state = (False, 0, False)

    def flush(self) -> None:
        if self.parts:
            text = _SPACES.sub(" ", "".join(self.parts)).strip()
            if text:
                self.found.append([text, self.linked, *self.state])
            self.parts, self.linked = [], 0


class _Stack:
    """The open block elements: (tag, heading, place), with the places of each tag."""

    def __init__(self):
        self.items: list[tuple[str, bool, int]] = []
        self.at: dict[str, list[int]] = {}

    def push(self, item: tuple[str, bool, int]) -> None:
        self.at.setdefault(item[0], []).append(len(self.items))
        self.items.append(item)

    def cut(self, length: int) -> None:
        while len(self.items) > length:
            self.at[self.items.pop()[0]].pop()

    def last(self, tag: str) -> int:
        """The place of the innermost such element, -1 if none is open."""
        return self.at[tag][-1] if self.at.get(tag) else -1

    @property
    def top(self) -> tuple[str, bool, int]:
        return self.items[-1] if self.items else ("", False, 0)


class _Tags:
    """The tags of a page. Quoted values (after "=") may hold ">"; where a quote is not closed, or hides all that would
    close a tag, tags up to it end with the next ">". No part of the page is searched twice for what it lacks."""

    def __init__(self, page: str):
        self.page, self.last, self.loose = page, page.rfind(">"), -1

    def read(self, lt: int) -> tuple[int, str, bool, str] | None:
        """(end, name, closing, attributes) of the tag or other markup (without a name) at lt; None if it is text."""
        if other := _OTHER.match(self.page, lt):
            return other.end(), "", False, ""
        name = _NAME.match(self.page, lt)
        if not name or lt > self.last:
            return None
        end = self._end(name.end()) if lt > self.loose else self.page.find(">", name.end())
        return (end + 1, name[2].lower(), bool(name[1]), self.page[name.end() : end]) if end >= 0 else None

    def _end(self, begin: int) -> int:
        at = begin
        while edge := _EDGE.search(self.page, at):
            if edge[0] == ">":
                return edge.start()
            at = self.page.find(edge[1], edge.end()) + 1
            if not at:
                self.loose = edge.start()
                break
        else:
            self.loose = len(self.page)
        return self.page.find(">", begin)


def blocks(page: str) -> list[list]:
    out, stack, tags = _Blocks(), _Stack(), _Tags(page)
    links, at, end = 0, 0, len(page)
    heading, place = False, 0

    def text(raw: str) -> None:
        if raw:
            if not out.parts:
                out.state = (heading, place, stack.top[0] == "p")
            raw = html.unescape(_LONG_NUMBER.sub("\ufffd", raw)) if "&" in raw else raw
            out.parts.append(raw)
            if links:
                out.linked += len(raw.strip())

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        found = tags.read(lt)
        if not found:
            text("<")
            at = lt + 1
            continue
        at, tag, closing, attrs = found
        if not tag:
            continue
        if tag in _RAW and not closing:
            if not attrs.rstrip().endswith("/") or tag in ("script", "style"):
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br" or tag in ("img", "input", "wbr"):
            if tag == "br":
                text(" ")
        elif tag in _VOID and tag != "hr":
            continue
        elif tag in _BLOCK or tag in _SKIP or (attrs and not closing and (_marked(tag, attrs) or _leans(tag, attrs))) or (closing and stack.last(tag) >= 0):
            out.flush()
            links = 0
            if tag == "hr":
                continue
            if closing:  # a stray end tag does not close an article
                own = stack.last(tag)
                if own >= 0 and (tag in ("body", "html", "article", "main") or own > max((stack.last(t) for t in _GOOD), default=-1)):
                    stack.cut(own)
            else:
                if tag in ("p", "li", "dt", "dd", "td", "th", "tr") or tag in _HEADING:
                    while stack.top[0] == "p":
                        stack.cut(len(stack.items) - 1)
                    if stack.top[0] == tag:
                        stack.cut(len(stack.items) - 1)
                elif stack.top[0] == "p" and tag in _BLOCK:
                    stack.cut(len(stack.items) - 1)
                stack.push((tag, tag in _HEADING, _place(tag, attrs, stack.top[2])))
            heading, place = any(s[1] for s in stack.items[-2:]), stack.top[2]
            place = -1 if place == 2 else place
    out.flush()
    return out.found


def _place(tag: str, attrs: str, above: int) -> int:
    """The place of an element whose parent has place above; 2: a header in the main part, where only headings count."""
    if above == -1 or tag in _BAD or tag in _SKIP or _marked(tag, attrs):
        return -1
    if above == -2 or _leans(tag, attrs):
        return -2 if above in (-2, 1) else -1
    if tag == "header":
        return 2 if above == 1 else -1
    if above == 2:
        return 1 if tag in _HEADING else 2
    return 1 if above == 1 or _main(tag, attrs) else 0


def _first_pass(found: list[list]) -> list[str]:
    """good, near, bad or undecided, for each block alone."""
    densities, stops, total = [], 0, 0
    for text, linked, _, place, _ in found:
        words = _WORD.findall(text.lower())
        own = sum(w in STOP_WORDS for w in words)
        densities.append(own / max(1, len(words)))
        if place >= 0 and len(text) >= LENGTH_LOW and linked <= LINK_DENSITY * len(text):
            stops, total = stops + own, total + len(words)
    unknown = stops < STOP_PAGE * total
    kinds = []
    for (text, linked, heading, _, _), density in zip(found, densities):
        n, links = len(text), linked / len(text)
        if links > MANY_LINKS:
            kinds.append("bad")
        elif links > LINK_DENSITY or n < LENGTH_LOW or heading:
            kinds.append("undecided")
        elif unknown or density >= STOP_HIGH:
            kinds.append("good" if n > LENGTH_HIGH else "near")
        else:  # long text of few function words (code, tables, names) goes with its neighbours
            kinds.append("near" if density >= STOP_LOW else "undecided")
    if "good" not in kinds:
        kinds = ["good" if k == "near" else k for k in kinds]
    return kinds


def _nearest(kinds: list[str | None], reverse: bool = False) -> list[tuple[str | None, int]]:
    """For each block the nearest decided one before it (after it) and its distance in blocks; (None, distance to the
    page's end) if there is none."""
    out, last, at = [], None, -1
    for i, k in enumerate(reversed(kinds) if reverse else kinds):
        out.append((last, i - at))
        if k in ("good", "bad"):
            last, at = k, i
    return out[::-1] if reverse else out


def _second_pass(found: list[list], kinds: list[str]) -> list[bool]:
    """Whether each block is text, by the labels of the first pass alone."""
    keep = []
    for (text, linked, heading, _, paragraph), kind, (a, far_a), (b, far_b) in zip(found, kinds, _nearest(kinds), _nearest(kinds, True)):
        if kind in ("good", "bad"):
            keep.append(kind == "good")
            continue
        if "good" not in kinds:  # nothing to go by: what has few links
            keep.append(linked <= LINK_DENSITY * len(text))
            continue
        good = min((far for k, far in ((a, far_a), (b, far_b)) if k == "good"), default=len(kinds) + 1)
        bad = min((far for k, far in ((a, far_a), (b, far_b)) if k != "good"), default=len(kinds) + 1)
        if heading:
            keep.append(b == "good" and (kind == "undecided" or good <= bad))
        else:
            keep.append(linked <= LINK_DENSITY * len(text) and (good < bad or good == bad and (kind == "near" or paragraph)))
    return keep


def _threads(found: list[list], kinds: list[str]) -> list[bool]:
    """Whether each block belongs to a thread of reader comments: from a heading that announces one to the next other
    heading; or from the first of three and more short dated lines, each with text after it, that come after most of the
    page's text."""
    inside, out = False, []
    for text, _, heading, _, _ in found:
        if heading:
            inside = bool(_THREAD.match(text)) and bool(out)
        out.append(inside)
    dated = [i for i, (b, k) in enumerate(zip(found, kinds)) if len(b[0]) < LENGTH_LOW + 20 and k in ("undecided", "near") and not b[2] and _DATED.search(b[0])]
    dated = [i for i, j in zip(dated, [*dated[1:], len(found)]) if j - i > 1]
    mass = [len(b[0]) if k == "good" else 0 for b, k in zip(found, kinds)]
    for n, i in enumerate(dated[:-2]):
        if sum(mass[:i]) > sum(mass[i:]):
            return [x or j >= i for j, x in enumerate(out)]
    return out


def classify(found: list[list]) -> list[bool]:
    """Whether each block is main text: what the passes say, then what elements and threads object."""
    kinds = _first_pass(found)
    keep = _second_pass(found, kinds)
    places = [1 if p == -2 and k == "good" else -1 if p == -2 else p for (_, _, _, p, _), k in zip(found, kinds)]
    kinds = ["bad" if p < 0 else k for k, p in zip(kinds, places)]
    mass = lambda place, some: sum(len(b[0]) for b, k, p in zip(found, kinds, places) if p == place and k in some)
    whole = 1 in places and mass(1, ("good", "near", "undecided")) >= mass(0, ("good",))
    # Blocks outside the main part by their place say nothing about their neighbours inside it.
    decided = [k if k in ("good", "bad") and p >= 0 and not (whole and p == 0) else None for k, p in zip(kinds, places)]
    for i, (kind, place, (a, _), (b, _)) in enumerate(zip(kinds, places, _nearest(decided), _nearest(decided, True))):
        if place < 0 or (whole and place == 0):
            keep[i] = False
        elif place == 1 and kind not in ("good", "bad"):  # no neighbour that is decided: the element alone speaks
            keep[i] = "good" in (a, b) or (a is None and b is None)
    return [k and not thread for k, thread in zip(keep, _threads(found, kinds))]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b[0] for b, k in zip(found, classify(found)) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep with text and n_chars. Map-only: a page is read in the task that holds it."""
    keep = keep or []
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b["_html"]]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, schema_of(pages, keep, "text string, n_chars long"))
