"""Operator 8: main text of web pages from flat text blocks, by a learned decision tree.

The html is cut into blocks at block-level tags; scripts, styles, comments and other raw elements go.
Each block has its number of words and its link density, those of the blocks before and after it, its kind
(paragraph, heading) and where it stands: inside an article, inside an element that is page furniture by its
tag or role, or named as such, on a page that has an article. A name counts where the element is itself
what it names: not on an article, and what an element around an article is called after other words (a layout
with or without a sidebar) says nothing of the article in it. A decision tree, grown on the labelled blocks of
``html_samples`` when first needed, tells content from the rest: marks decide where pages carry them (comments
of readers read like any text), words and links of a block and its neighbours everywhere else, such as for lists
of links inside an article and for pages made of plain divisions. Character references are decoded, white space
inside a block becomes one space (``br`` included), blocks are trimmed and joined in page order by two newlines.

Null and empty html give an empty text, tags that are never closed are fine (a quote that is not closed ends
with its tag), a page of any length is read whole in time linear in it, repeated rows get equal results, columns
beside page_id, url and html are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.html_samples import SAMPLES

# fixed values: element names
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select datalist button textarea head title applet noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu dialog search fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that class and id names of furniture end in.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion paid banner cookie cookies consent notice sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist discussion respond response responses reply replies reactions disqus newsletter subscribe".split())
#: Words before them that tell how a page is laid out, not what an element is.
LAYOUT = frozenset("no not without has have with is hide show layout wrap wrapper container".split())

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Columns of a block's features.
FEATURES = ("furniture", "named", "in_article", "has_article", "links", "links_before", "links_after", "words", "words_before", "words_after", "paragraph", "heading")


def _named(names: str) -> int:
    """2 if one of the class and id names is that of furniture, 1 if one ends in such a word after others, else 0."""
    found = 0
    for n in names.lower().split():
        words = [w for w in re.split(r"[^a-z]+", n) if w]
        if words and words[-1] in NAMES and not LAYOUT & set(words[:-1]):
            found = max(found, 2 if len(words) == 1 else 1)
    return found


def _marks(tag: str, attributes: str) -> tuple[bool, bool, int]:
    """Whether an element is an article, furniture by tag, role or being hidden, and how far it is named as furniture."""
    found = {}
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role = found.get("role", "").lower()
    article = tag in ("article", "main") or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "") == "true" or "display:none" in style or "visibility:hidden" in style
    named = _named(f"{found.get('class', '')} {found.get('id', '')}") if tag not in ("html", "body", "main") else 0
    return article, hidden or tag in FURNITURE or role in FURNITURE_ROLES, 0 if article and named < 2 else named


class _Tags:
    """The tags of a page from the front, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.never: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where what stands next; what was once not found is not looked for again."""
        if what in self.never:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.never.add(what)
        return found

    def end(self, at: int) -> int:
        """Where a tag ends whose name ends at ``at``, past any quoted values; -1 without an end."""
        if self.quotes:
            k = at
            while m := QUOTE_OR_END.search(self.page, k):
                if m[0] == ">":
                    return m.start()
                k = self.find(m[0], m.end()) + 1
                if not k:
                    break
            self.quotes = False  # from a quote or tag that nothing closes on, quotes are plain characters
        return self.find(">", at)

    def closing(self, tag: str, at: int) -> re.Match | None:
        """The end tag of a raw element."""
        if tag in self.never:
            return None
        found = re.compile(rf"</{tag}\s*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I).search(self.page, at)
        if not found:
            self.never.add(tag)
        return found


def blocks(page: str) -> list[list]:
    """[text, words, link words, paragraph, heading, furniture, named, in article] of each block that has text."""
    out: list[list] = []
    parts: list[str] = []
    link_words = 0
    in_link = False
    stack: list[tuple[str, bool, bool, int]] = []
    opened: Counter = Counter()  # elements of each tag on the stack
    marks = [0, 0, 0, 0]  # articles, furniture, elements named so in full and in part on the stack
    outside = [0]  # elements named in part around each open article: a wrapper's name says nothing of an article in it
    kind = ""

    def push(entry) -> None:
        stack.append(entry)
        opened[entry[0]] += 1
        if entry[1]:
            outside.append(marks[3])
        for k, there in enumerate((entry[1], entry[2], entry[3] == 2, entry[3] == 1)):
            marks[k] += there

    def pop() -> str:
        entry = stack.pop()
        opened[entry[0]] -= 1
        if entry[1]:
            outside.pop()
        for k, there in enumerate((entry[1], entry[2], entry[3] == 2, entry[3] == 1)):
            marks[k] -= there
        return entry[0]

    def end() -> None:
        nonlocal link_words
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                words = text.count(" ") + 1
                heading = len(kind) == 2 and kind[0] == "h" and kind[1] in "123456"
                out.append([text, words, min(link_words, words), kind == "p", heading, marks[1] > 0, marks[2] > 0 or marks[3] > outside[-1], marks[0] > 0])
        link_words = 0

    def add(text: str) -> None:
        nonlocal link_words
        if text:
            parts.append(text)
            if in_link:
                link_words += len(text.split())

    tags, at, n = _Tags(page), 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        if page.startswith("<!--", start):
            stop = tags.find("-->", start + 4)
            at = n if stop < 0 else stop + 3
            continue
        if page.startswith("<![CDATA[", start) and (stop := tags.find("]]>", start)) >= 0:
            parts.append(html.escape(page[start + 9 : stop]))
            at = stop + 3
            continue
        closing = page.startswith("</", start)
        name = NAME.match(page, start + 1 + closing)
        if not name and not page.startswith(("<!", "<?", "</"), start):
            add("<")
            at = start + 1
            continue
        stop = tags.end(name.end()) if name else tags.find(">", start)
        if stop < 0:  # a tag that never ends, and all after it is inside
            add(page[start : start + 1])
            at = start + 1
            continue
        at = stop + 1
        if not name:
            continue
        tag, attributes = name[0].lower(), page[name.end() : stop]
        if tag in RAW and not closing and not attributes.endswith("/"):
            if tag in ("head", "title"):
                end()
            found = tags.closing(tag, at)
            if found:
                at = found.end()
            elif tag not in ("head", "title", "button", "select", "object", "noscript", "svg"):
                at = n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = not closing
            continue
        if closing:
            if tag in BLOCK:
                end()
            if opened[tag]:
                if tag in BLOCK:
                    while pop() != tag:
                        pass
                else:  # an inline element ends only with no block open in it
                    k = len(stack) - 1
                    while stack[k][0] != tag and stack[k][0] not in BLOCK:
                        k -= 1
                    if stack[k][0] == tag:
                        while len(stack) > k:
                            pop()
            if tag in BLOCK:
                kind = ""
            continue
        article, furniture, named = _marks(tag, attributes) if attributes or tag in BLOCK else (False, False, 0)
        if tag in BLOCK:
            end()
            kind = tag
            if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                pop()
            if stack and tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == tag:
                pop()
        if tag not in VOID and not attributes.endswith("/") and (tag in BLOCK or furniture or named):
            push((tag, article, furniture, named))
    end()
    return out


def features(found: list[list]) -> np.ndarray:
    """One row of FEATURES a block."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b[1] for b in found], float)
        links = np.array([b[2] for b in found], float) / words
        x[:, 0:3] = [b[5:8] for b in found]
        x[:, 3] = any(b[7] and not b[5] and not b[6] for b in found)
        x[:, 4], x[:, 7] = links, words
        x[1:, 5], x[1:, 8] = links[:-1], words[:-1]
        x[:-1, 6], x[:-1, 9] = links[1:], words[1:]
        x[:, 10:12] = [b[3:5] for b in found]
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A tree by least Gini impurity: (feature, threshold, low, high), or (share of content,)."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2:
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            a, b = y[low], y[~low]
            cost = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), low)
    if best is None:
        return (share,)
    _, f, t, low = best
    return (f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def judge(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Share of content for each row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, t, low, high = tree
    return np.where(x[:, f] <= t, judge(low, x), judge(high, x))


@lru_cache(maxsize=1)
def model() -> tuple:
    """The tree of the labelled samples."""
    xs, ys = [], []
    for page in SAMPLES:
        # every fragment ends its blocks, so blocks are told by counting them fragment by fragment
        made, labels, seen = "", [], 0
        for label, fragment in page:
            made += fragment
            now = len(blocks(made))
            labels += [label] * (now - seen)
            seen = now
        xs.append(features(blocks(made)))
        ys += labels
    return grow(np.concatenate(xs), np.array(ys, float))


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found = blocks(page) if page else []
    if not found:
        return ""
    good = judge(model(), features(found)) >= 0.5
    return "\n\n".join(b[0] for b, ok in zip(found, good, strict=True) if ok)


def _run(batches):
    for b in batches:
        out = [main_text(x) for x in b["html"].to_pylist()]
        yield pa.record_batch([b["page_id"], b["url"], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row a page."""
    return pages.select("page_id", "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
