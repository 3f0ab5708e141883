"""Main text of web pages from flat text blocks.

A page becomes a list of blocks with their word counts, link densities, those of the neighbours and a few marks of the
elements around them. A decision tree, grown from the blocks of small labelled pages, says which belong to the article.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import per_row, read

# What each element does to the text.
#: The text of RAW elements runs to their end tag or the end of the page; tags in it are text.
RAW = "script style textarea title"
#: These are left out from a start tag to the end tag that matches it; without one, only the tag itself is.
DROPPED = frozenset("noscript template svg iframe select button object canvas".split())
#: What "/>" closes at once, and the RAW elements in it too.
FOREIGN = frozenset("svg".split())
#: Marks of these say what else is on the page.
ROOTS = frozenset("html body main".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img "
    "math mi mn mo mrow ms mspace msqrt mroot mfrac msub msup msubsup munder mover munderover mtext mstyle semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
FRAME = frozenset("nav footer aside form fieldset menu dialog header".split())
#: Words in a class or id that mark what isn't the article, and what is.
AROUND = frozenset(
    "ad ads adv advert advertisement alert banner breadcrumb breadcrumbs comment commentaires comments consent cookie cookies disqus "
    "feedback footer gdpr header kommentar kommentare login masthead menu modal nav navbar navigation newsletter notice pagination "
    "pager paywall popup promo related reply replies respond responses reviews search share sharing sidebar signup social sponsor "
    "sponsored subscribe toc toolbar widget".split()
)
#: Of an article itself, and of a phrase in a line, only these as a whole name.
ALONE = frozenset("ad ads advert advertisement comment promo related sponsor sponsored".split())
#: A name that begins or ends so tells what a page has or how it looks, not what the element is.
HAVING, STATE = frozenset("has no not with without is hide show".split()), frozenset("open closed enabled disabled on off active count visible".split())
#: "related" marks a list of such things, or stands alone.
LISTED = frozenset("related article articles content entries items links news pages post posts products reading stories story topics videos".split())
#: A thread of comments, unless it is a section of the article.
THREAD = frozenset("discussion thread".split())
INSIDE = frozenset("article body content entry main post story text".split())

_NAME_AT = re.compile(r"/?[a-zA-Z]")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+))>")
_SPECIAL = re.compile("[>\"']")
_STOP = re.compile(r"[\s/>]")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW.split()}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)""", re.I)
_STYLE = re.compile(r"""\bstyle\s*=\s*["']?([^"']*+)""", re.I)
_UNSEEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
#: A reference to a character beyond all there are, and zeros before a number.
_BEYOND, _ZEROS = re.compile(r"&#0*+[1-9][0-9]{7,};?"), re.compile(r"(&#x?)0{6,}(?=[0-9a-f])", re.I)
_VALUES = re.compile(r""""[^"]*"|'[^']*'""")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "framed", "marked")


def _named(attributes: str) -> list[list[str]]:
    """The names in an element's class, id and role, each as its lower-case words."""
    names = (n for m in _NAMES.finditer(attributes) for x in m.groups() if x for n in x.split()) if attributes else ()
    return [words for n in names if (words := [w.lower() for w in _WORD.findall(n)])]


def _hidden(attributes: str) -> bool:
    if not attributes:
        return False
    return any(_UNSEEN.search(m[1]) for m in _STYLE.finditer(attributes)) or bool(_HIDDEN.search(_VALUES.sub("''", attributes)))


def _beside(element: str, words: list[str]) -> bool:
    """Whether a name marks an element as something beside the article."""
    if words[0] in HAVING or len(words) > 1 and words[-1] in STATE:
        return False
    if element in ARTICLE:
        return len(words) == 1 and words[0] in ALONE
    found = AROUND.intersection(words)
    if "related" in found and not LISTED.issuperset(words):
        found = found - {"related"}
    if "header" in found and INSIDE.intersection(words):  # an article's own head
        found = found - {"header"}
    return bool(found) or element != "section" and bool(THREAD.intersection(words))


def _marks(element: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Of an element: whether it opens an article, frames one, or is marked as something beside it, or hidden."""
    names = _named(attributes)
    marked = _hidden(attributes) or any(_beside(element, words) for words in names)
    opens = element in ARTICLE or not marked and any(INSIDE.intersection(words) for words in names)
    return opens, element in FRAME and not (element == "header" and inside), marked


def _phrase(attributes: str) -> bool:
    """Whether a phrase in a line is an advert or hidden."""
    return bool(attributes) and (any(len(w) == 1 and w[0] in ALONE - {"comment", "related"} for w in _named(attributes)) or _hidden(attributes))


class _Scanner:
    """Finds what isn't text, from the left, in time linear in the page however broken it is.

    A tag is matched as it stands. Only where one has no end do its attributes have to be scanned for nothing; from then on
    it is worked out first whether a tag ends: what the scan would meet next, ``>`` or a quote, is looked up in a list of
    the page's, and places that lead to no end are remembered, so each is passed once.
    """

    def __init__(self, html: str):
        self.html, self.at, self.broken, self.stop = html, None, set(), -1
        self.last = {c: html.rfind(c) for c in "<>"}

    def tag(self, start: int):
        """The match of a tag that begins at ``start``, or nothing."""
        if start > self.last[">"]:
            return None
        if self.at is None:
            m = _TAG.match(self.html, start)
            if m or not _NAME_AT.match(self.html, start + 1):
                return m
            self.at = [m.start() for m in _SPECIAL.finditer(self.html)]
            after: dict[str, int] = {}
            self.closing = [-1] * len(self.at)  # for each quote, its next like
            for k in range(len(self.at) - 1, -1, -1):
                c = self.html[self.at[k]]
                self.closing[k] = after.get(c, -1)
                after[c] = k
        return _TAG.match(self.html, start) if _NAME_AT.match(self.html, start + 1) and self._ends(start) else None

    def _ends(self, start: int) -> bool:
        """Whether a ``>`` outside quotes comes before a quote that nothing closes."""
        begin = start + 2 if self.html.startswith("/", start + 1) else start + 1
        if self.stop < begin:  # a name runs to the next white space, slash or end
            m = _STOP.search(self.html, begin)
            self.stop = m.start() if m else len(self.html)
        k, passed = bisect_left(self.at, self.stop), []
        while k < len(self.at) and k not in self.broken:
            if self.html[self.at[k]] == ">":
                return True
            passed.append(k)
            if self.closing[k] < 0:
                break
            k = self.closing[k] + 1
        self.broken.update(passed)
        return False

    def next(self, at: int):
        """``(start, stop, match)`` of the next thing from ``at`` on that isn't text, the match if it is a tag."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            c = html[start + 1 : start + 2]
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, len(html) if end < 0 else end + 3, None
            if c in ("!", "?"):
                end = html.find(">", start) if start < self.last[">"] else -1
                if end >= 0:
                    return start, end + 1, None
            elif c and (c == "/" or c.isascii() and c.isalpha()) and (m := self.tag(start)):
                return start, m.end(), m
            if c and (c in "/!?" or c.isascii() and c.isalpha()) and start == self.last["<"] and start > self.last[">"]:
                return start, len(html), None  # the page ends in a tag
            at = start + 1
        return None


def _tags(html: str) -> list[tuple[int, int, bool, str, str]]:
    """``(start, stop, closes, name, attributes)`` of what isn't text, in page order; comments and left out elements are
    one entry without a name."""
    found: list[tuple] = []
    opened: dict[str, list[int]] = {}
    last: dict[int, int] = {}  # entry of a dropped element's start tag: entry of its end tag
    foreign = at = 0
    scanner = _Scanner(html)
    while part := scanner.next(at):
        start, at, m = part
        name, closes, attributes = (m[2].lower(), bool(m[1]), m[3]) if m else ("", False, "")
        empty = attributes.endswith("/") and (foreign > 0 or name in FOREIGN)
        if name in _ENDS and not closes:
            if not empty:
                m = _ENDS[name].search(html, at)
                end = html.find(">", m.end()) if m else -1
                at = len(html) if end < 0 else end + 1
            name = ""
        elif name in DROPPED:
            if closes:
                if opened.get(name):
                    last[opened[name].pop()] = len(found)
                    foreign -= name in FOREIGN
            elif not empty:
                opened.setdefault(name, []).append(len(found))
                foreign += name in FOREIGN
        found.append((start, at, closes, name, attributes))
    out, k = [], 0
    while k < len(found):
        start, stop, closes, name, attributes = found[k]
        if name in DROPPED:
            k = last.get(k, k)
            stop, name = found[k][1], ""
        out.append((start, stop, closes, name, attributes))
        k += 1
    return out


def _unescaped(text: str) -> str:
    """Character references decoded, however long their numbers are."""
    if "&#" in text:
        text = _ZEROS.sub(r"\1", _BEYOND.sub("\ufffd", text))
    return unescape(text)


def blocks(html: str) -> list[tuple[str, tuple]]:
    """``(text, features)`` of each block in page order; blocks without words are left out."""
    found: list[list] = []  # text, words, words in links, in article, framed, marked
    stack: list[tuple] = []  # name, in article, framed, marked
    opened: Counter = Counter()  # names in the stack
    parts: list[str] = []
    linked: list[str] = []
    depth = 0
    skipped: list[str] = []  # open phrases that are left out, and what of their name is open in them

    def flush():
        skipped.clear()
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1] if stack else ("", False, False, False)
            found.append([text, len(text.split()), len(" ".join(linked).split()), *top[1:]])
        parts.clear()
        linked.clear()

    def close(name):
        """Drops the innermost open ``name`` and what is open in it."""
        while opened[name]:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return

    def add(text):
        if text and not skipped:
            text = _unescaped(text)
            parts.append(text)
            if depth:
                linked.append(text)

    at = 0
    for start, stop, closes, name, attributes in _tags(html):
        add(html[at:start])
        at = stop
        if not name:
            continue
        if name in INLINE and name not in VOID:
            if skipped and name == skipped[0]:
                skipped.pop() if closes else skipped.append(name)
                continue
            if not closes and not skipped and _phrase(attributes):
                skipped.append(name)
        if name == "a":
            depth = 0 if closes or skipped else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            continue
        flush()
        if closes:
            depth = 0
            close(name)
        elif name not in VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or stack and stack[-1][0] == "p":
                # An open paragraph ends with the next block, an item with the next item.
                if stack and stack[-1][0] == "p":
                    close("p")
                if name != "p" and stack and stack[-1][0] == name:
                    close(name)
            _, inside, framed, marked = stack[-1] if stack else ("", False, False, False)
            opens, frames, marks = _marks(name, attributes, inside)
            # The main element is what a wrapper's marks stand beside.
            marked = name != "main" and (marked or marks and name not in ROOTS or _hidden(attributes))
            stack.append((name, inside or opens, framed or frames, marked))
            opened[name] += 1
    add(html[at:])
    flush()
    out = []
    for k, (text, words, links, inside, framed, marked) in enumerate(found):
        before = found[k - 1] if k else ["", 0, 0]
        after = found[k + 1] if k + 1 < len(found) else ["", 0, 0]
        density = lambda x: min(1.0, x[2] / x[1]) if x[1] else 0.0
        out.append((text, (words, density(found[k]), before[1], density(before), after[1], density(after), int(inside), int(framed), int(marked))))
    return out


#: The labelled pages, ``{n}`` standing for n words, and for each of their blocks 1 if it is of the article, else 0.
LABELLED_PAGES = (
    # an article in its element, below a menu and above a foot; a headline of one word; short and long paragraphs
    ("<nav><ul><li><a>{1}</a><li><a>{1}</a><li><a>{2}</a></ul></nav><article><h1>{1}</h1><p>{60}<p>{45}<p>{3}<p>{120}</article><footer>{14}</footer>", "000111110"),
    ("<header><a>{1}</a><p>{9}</p></header><div class=ad>{9}</div><article><h1>{8}</h1><p>{25} <a>{3}</a><p>{14}<p>{6}<p>{7}</article><aside>{30}</aside>", "000111110"),
    ("<div id=menu><a>{2}</a><a>{3}</a></div><main><h2>{2}</h2><p>{2}<p>{2}<h2>{1}</h2><p>{30}</main><footer><p>{40} <a>{4}</a><p>{9} <a>{2}</a></footer>", "01111100"),
    ("<article><h1>{4}</h1><p>{8}<div class=ad>{5}</div><p>{60}<div class=promo>{18}</div><p>{35}</article><div class=comments><p>{22}<p>{70}<p>{1}</div>", "110101000"),
    ("<article><header><h1>{5}</h1><p>{3}</header><p>{33}<ul><li>{4}<li>{6}<li><a>{4}</a></ul><p>{55}<p><a>{6}</a> {3}</article><nav><a>{1}</a></nav>", "111111110"),
    ("<article><p>{11}<nav><a>{12}</a></nav><p>{9}<form>{5} <input></form><p>{30}<footer>{30}</footer></article><form>{25}</form>", "1010100"),
    ("<div class=cookie-notice>{15}</div><div class=banner>{3}</div><article><p>{20}<h2>{3}</h2><p>{10}</article><div class=sidebar><p>{45}<p><a>{3}</a></div>", "0011100"),
    ("<article><p>{50}<div class=related><a>{4}</a> {1}</div><p>{24}<div class=newsletter>{14}</div></article><article class=comment><p>{60}</article>", "10100"),
    ("<div class=popup><p>{12}</div><article><p>{1}</article><div class=share><a>{1}</a><a>{1}</a></div>", "010"),
    # pages that mark no article: paragraphs among menus, notes and lists of links
    ("<div><a>{1}</a> <a>{2}</a> <a>{1}</a></div><h1>{6}</h1><p>{70}<p>{40}<p>{28} <a>{3}</a><p>{18}<div><a>{6}</a> {1}</div>", "0111110"),
    ("<ul><li><a>{2}</a><li><a>{1}</a><li><a>{3}</a></ul><div>{35}</div><div>{22}</div><div>{90} <a>{8}</a></div><div>{3}</div>", "0001110"),
    ("<p>{2}<p><a>{1}</a><p>{13}<p>{33}<p>{70}<p>{21}<p>{5}<p><a>{2}</a><p><a>{4}</a>", "001111000"),
    ("<table><tr><td><a>{1}</a><td><a>{2}</a><tr><td>{2}</table><div>{45}</div><div>{6}</div><div>{38}</div><div>{9}</div><div>{26}</div><div>{2}</div>", "000111110"),
    ("<div class=header>{4}</div><div class=menu><a>{3}</a></div><p>{17}<p>{40}<p>{12}<p>{55}<div class=footer>{11}</div><div class=login>{80}</div>", "00111100"),
    ("<div><a>{2}</a></div><h2>{2}</h2><p>{60}<h2>{3}</h2><p>{45}<h3>{10}</h3><p>{72}<h3>{4}</h3><p>{110}", "011111111"),
    ("<p>{15}", "1"),
    ("<p>{13}", "1"),
    ("<p>{20}<p>{19} <a>{2}</a><div class=sponsor>{16}</div><p>{30}<dl><dt><a>{8}</a> {2}<dd><a>{20}</a> {2}</dl>", "110100"),
    # links right before and behind long paragraphs
    ("<ul><li><a>{1}</a><li><a>{2}</a></ul><p>{80}<p>{60}<p>{33}<ul><li><a>{3}</a><li><a>{1}</a></ul>", "0011100"),
    ("<nav><a>{2}</a></nav><article><p>{90}<p>{30}</article><nav><a>{3}</a></nav>", "0110"),
    ("<div><a>{5}</a></div><article><p>{70}<p><a>{5}</a><p>{95}</article><div><a>{2}</a></div><div>{65}</div>", "011101"),
    ("<div><a>{3}</a></div><div><a>{9}</a></div><p>{50}<div><a>{3}</a></div><p>{48}<p>{18}<div><a>{1}</a></div>", "0010110"),
    ("<aside><a>{4}</a></aside><article><p>{66}</article><aside><a>{3}</a><p>{52}</aside><p>{22}<div><a>{7}</a></div>", "010010"),
    ("<div><a>{2}</a></div><p>{130}<div><a>{3}</a></div><div>{160}</div>", "0101"),
    ("<nav><a>{3}</a></nav><p>{150}<nav><a>{1}</a><br><a>{6}</a></nav><p>{99}", "0101"),
    ("<article><p>{30}<p><a>{8}</a><p>{25}<p><a>{12}</a><p>{140}<nav><a>{4}</a></nav><p>{110}<p><a>{3}</a></article>", "11111011"),
    ("<article><p>{30}<p><a>{8}</a> {2}<p>{20}<p><a>{4}</a> {1}<div class=share><a>{4}</a> {1}</div><p>{16}</article>", "111101"),
    # short blocks in a row, in an article and beside one
    ("<article><h1>{1}</h1><p>{6}<p>{1}<p>{7}<p>{2}<p>{6}<p>{3}<p>{1}<p>{5}</article>", "111111111"),
    ("<nav><a>{1}</a></nav><article><h1>{7}</h1><p>{2}<p>{7}<p>{9}</article><footer>{7}</footer>", "011110"),
    ("<article><p>{7}<p>{19}</article><div>{6}</div>", "110"),
    ("<article><p>{6}</article>", "1"),
    ("<main><p>{7}<p>{6}<p>{4}</main><p><a>{2}</a>", "1110"),
    ("<div><a>{1}</a></div><article><p>{6}</article><div>{6}</div><div>{2}</div>", "0100"),
    ("<div>{7}</div><div><a>{3}</a></div><div>{4}</div><div><a>{2}</a></div><div>{5}</div>", "00000"),
    ("<div>{3}</div><div>{2}</div><div>{4}</div>", "000"),
    ("<header>{25}</header><div>{60}</div><div>{14}</div><footer>{28}</footer><footer>{50}</footer>", "01100"),
    ("<aside><p>{75}<p>{16}</aside><h2>{9}</h2><p>{31}<p>{24}<h2>{3}</h2><p>{41}<dialog>{33}</dialog>", "00111110"),
)


def labelled() -> np.ndarray:
    """The labelled table: FEATURES of each block of LABELLED_PAGES, then its label."""
    rows = []
    for page, labels in LABELLED_PAGES:
        found = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page))
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {page}")
        rows += [(*features, int(label)) for (_, features), label in zip(found, labels)]
    return np.array(rows, float)


def grow(rows: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: a share of ones, or ``(feature, threshold, at most, above)``. Of equal splits the
    one by an element's marks comes first, then a block's own words and links, then its neighbours'."""
    x, y = rows[:, :-1], rows[:, -1]
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in (8, 7, 6, 0, 1, 2, 3, 4, 5):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            impurity = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), low)
    if best is None:
        return share
    return best[1], best[2], grow(rows[best[3]], depth - 1), grow(rows[~best[3]], depth - 1)


def decide(tree, features: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def main_text(html: str | None, tree) -> str:
    """The blocks of the article in page order, joined by one space; null, empty and textless pages: empty."""
    return " ".join(text for text, features in blocks(html or "") if decide(tree, features))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and ``text`` for each page, whole and in one pass without a shuffle.

    Null and empty pages have an empty text; other columns are ignored; repeated rows give repeated results; an empty
    table gives none.
    """
    tree = grow(labelled())
    return per_row(pages, html_col, list(keep), "text string", lambda html: (main_text(html, tree),))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
