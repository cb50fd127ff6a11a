"""Main text of HTML pages by line-block distribution.

1. A page is read once into elements and lines.  A block tag ends a line, other
   tags vanish, ``br`` is a space.  Reading is linear: a quote counts only after
   ``=`` in a tag, and one that is never closed is looked for once.
2. Taken out with what they hold: scripts, styles and other raw elements,
   comments, boilerplate by its element (nav, footer, aside, form, a header that
   isn't an article's own), by role, by ``hidden``, or by a class or id all of
   whose words name boilerplate (``cookie-notice``, ``related-posts``; not
   ``related-work`` nor ``has-sidebar``).  An element around ``main``, around all
   articles of the page, or a form around most of its text stays.
3. The lengths of all lines, without the text of links, are summed over windows
   of ``WINDOW`` lines.  Where the sums rise to the length of a long line is a
   surge, where they fall below it a dive.  On a page that marks its content
   (``article``, ``main``) the marks are a prior: marked lines weigh ``PRIOR``
   times, and are the text unless a stretch outside outweighs them.  Else text
   between surge and dive is kept, from the first to the last line that is long
   or stands beside a long one in the same element, with headings right before
   it; small stretches far from the largest and runs of links inside go.  What
   lies between two kept lines of one element stays.  A long line has ``LONG``
   characters, or a quarter of the page's longest line if that is less.

Character references are decoded, white space in a block becomes one space,
blocks are joined by an empty line.

Defined cases: null or empty html and pages without text give the empty text;
unclosed elements end with their parent; a tag that never ends is text; page_id
and url may be null or repeated; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches

WINDOW = 3
LONG = 60
SMALL = 0.15  # of the largest stretch
PRIOR = 4
SCHEMA = "page_id long, url string, text string, n_chars long"
# fixed values of the HTML standard: names of elements and roles
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "datalist")
OUT = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LEAF = HEADINGS | {"p", "li", "dt", "dd", "td", "th", "tr", "pre", "figcaption", "summary"}
HEAD_ONLY = frozenset(("base", "link", "meta"))
ROLE_OUT = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
# words of classes and ids that name boilerplate, and words that go with them
NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos promotion cookie cookies consent notice notices gdpr popup modal newsletter subscribe sidebar nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead toolbar share sharing social related recommended recommendations comment comments disqus reply replies respond widget widgets login signup signin skip pagination pager teaser teasers kommentar kommentare commentaire commentaires comentario comentarios werbung anzeige anzeigen publicité publicidad".split())
BESIDE = frozenset("box bar wrap wrapper container block section list item items area inner outer top bottom left right main site page global primary secondary panel content form link links button buttons icons post posts article articles story stories news body text unit slot label policy".split())
OWN_PARTS = frozenset(("header", "masthead", "banner"))  # an article may have these of its own
OWN_BESIDE = frozenset("article articles post posts story section content body text main news item".split())
SIMPLE = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"'=]*+)>""")
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
NEXT = re.compile(r"[>=]")
SPACE = re.compile(r"\s*")
ATTRIBUTE = re.compile(r"""(?<![^\s=/"'])([^\s=/"']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
QUOTED = re.compile(r"""(["']).*?\1""", re.S)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
BLANK = re.compile(r"\s+")
WORDS = re.compile(r"[A-Za-z]+|[^A-Za-z\s_\d-]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names_boilerplate(value: str, inside_content: bool) -> bool:
    """Whether one of the names in a class or id names boilerplate with all its words."""
    for name in value.split():
        words = {w.lower() for w in WORDS.findall(CAMEL.sub(" ", name))}
        named = words & NAMES
        if named and words <= NAMES | BESIDE and not (named <= OWN_PARTS and (inside_content or words & OWN_BESIDE)):
            return True
    return False


def is_boilerplate(name: str, attributes: str, inside_content: bool) -> bool:
    if name in OUT:
        return not (name == "header" and inside_content)
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value, key = html.unescape(a or b or c), key.lower()
        if key == "role" and value.lower() in ROLE_OUT or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in ("class", "id") and names_boilerplate(value, inside_content):
            return True
    return bool(HIDDEN.search(QUOTED.sub("", attributes)))


class Page:
    """Elements (name, attributes, parent) and lines ((element, text) pieces) of a page."""

    def __init__(self, page: str):
        self.names, self.attributes, self.parent = ["#page"], [""], [-1]
        self.lines: list[list[tuple[int, str]]] = []
        self.stack, self.depths, self.blocks = [0], defaultdict(list), []  # places in the stack: by name, of blocks
        self.line: list[tuple[int, str]] = []
        self.missing: set[str] = set()  # quotes that don't come again
        self.read(page)
        self.end_line()

    def end_line(self) -> None:
        if self.line:
            self.lines.append(self.line)
            self.line = []

    def say(self, text: str) -> None:
        if text:
            self.line.append((self.stack[-1], text))

    def tag_end(self, page: str, at: int) -> int:
        """Where the tag that goes on here ends (after its >), or -1."""
        while m := NEXT.search(page, at):
            at = m.end()
            if m[0] == ">":
                return at
            at = SPACE.match(page, at).end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote and quote not in self.missing:
                end = page.find(quote, at + 1)
                if end < 0:
                    self.missing.add(quote)
                else:
                    at = end + 1
        return -1

    def read(self, page: str) -> None:
        at, n, endless = 0, len(page), False
        while at < n:
            lt = page.find("<", at)
            if lt < 0 or endless:
                self.say(page[at:])
                return
            self.say(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                self.say(html.escape(page[lt + 9 : n if end < 0 else end]))
                at = n if end < 0 else end + 3
            elif page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            elif m := SIMPLE.match(page, lt):
                at = self.tag(page, m.end(), bool(m[1]), m[2].lower(), m[3])
            elif m := OPENING.match(page, lt):
                end = self.tag_end(page, m.end())
                if end < 0:  # no tag ends from here on
                    endless = True
                    self.say("<")
                    at = lt + 1
                else:
                    at = self.tag(page, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1])
            elif page.startswith("</", lt):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                self.say("<")
                at = lt + 1

    def tag(self, page: str, at: int, close: bool, name: str, attributes: str) -> int:
        """Take a tag that ends here; where to read on."""
        if name in RAW_END and not close:
            if attributes.endswith("/"):
                return at
            end = RAW_END[name].search(page, at)
            gt = page.find(">", end.end()) if end else -1
            return len(page) if gt < 0 else gt + 1
        if name == "br":
            self.say(" ")
        if name in BLOCK:
            self.end_line()
        if name in VOID:
            return at
        if close:
            self.close(name)
            return at
        if self.names[self.stack[-1]] == "head" and name not in HEAD_ONLY or name == "body" and self.depths["head"]:
            self.pop("head")
        if name in BLOCK and name != "html":
            self.close("p", inner=True)
        if name in ("li", "dt", "dd", "tr", "td", "th", "a", "option"):
            self.close(name, inner=True)
        self.depths[name].append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(len(self.names))
        self.names.append(name)
        self.attributes.append(attributes)
        self.parent.append(self.stack[-2])
        return at

    def pop(self, name: str) -> None:
        while True:
            top = self.names[self.stack.pop()]
            self.depths[top].pop()
            if top in BLOCK:
                self.blocks.pop()
            if top == name:
                return

    def close(self, name: str, inner: bool = False) -> None:
        """End the innermost open element of a name; an inline one (or inner) only if no block is open in it."""
        open_ = self.depths[name]
        if open_ and not ((inner or name not in BLOCK) and self.blocks and self.blocks[-1] > open_[-1]):
            self.pop(name)

    def taken_out(self) -> tuple[np.ndarray, np.ndarray]:
        """For every element, whether it is in boilerplate, and whether it is in article or main."""
        n = len(self.names)
        own, marked = np.zeros(n, bool), np.zeros(n, bool)
        holds, mains, text = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
        for e in range(1, n):
            within = marked[self.parent[e]]
            marked[e] = within or self.names[e] in CONTENT
            own[e] = is_boilerplate(self.names[e], self.attributes[e], bool(within))
        for line in self.lines:
            for e, piece in line:
                text[e] += len(piece)
        for e in range(n - 1, 0, -1):
            holds[e] += self.names[e] in CONTENT
            mains[e] += self.names[e] == "main"
            for total in (holds, mains, text):
                total[self.parent[e]] += total[e]
        own &= mains == 0
        own &= ~((np.array(self.names) == "form") & ((holds > 0) | (2 * text > text[0])))
        out = self.spread(own)
        if not any(t.strip() for line in self.lines for e, t in line if not out[e]):
            out = self.spread(own & (holds == 0))  # nothing else is left: what holds the page's articles stays
        return out, marked

    def spread(self, own: np.ndarray) -> np.ndarray:
        out = own.copy()
        for e in range(1, len(out)):
            out[e] |= out[self.parent[e]]
        return out


def lines(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, characters in links, element around it, heading?, in article or main?) of the lines that are left."""
    p = Page(page)
    out, marked = p.taken_out()
    link = p.spread(np.array([x == "a" for x in p.names]))
    found = []
    for line in p.lines:
        kept = [(e, t) for e, t in line if not out[e]]
        text = BLANK.sub(" ", html.unescape("".join(t for _, t in kept))).strip()
        if not text:
            continue
        linked = sum(len(BLANK.sub(" ", html.unescape(t)).strip()) for e, t in kept if link[e])
        e = next(e for e, t in kept if t.strip())
        while p.names[e] not in BLOCK and e:
            e = p.parent[e]
        box = p.parent[e] if p.names[e] in LEAF else e
        found.append((text, min(linked, len(text)), box, p.names[e] in HEADINGS, bool(marked[e])))
    return found


def distribution(size: np.ndarray, whole: np.ndarray, box: np.ndarray, heading: np.ndarray, marked: np.ndarray | None = None) -> np.ndarray:
    """Which lines of a page are main text; marked: those in article or main."""
    if not size.any():
        size = whole
    long = min(LONG, size.max() / 4)
    n = len(size)
    window = np.ones(WINDOW, int)
    sums = np.convolve(size, window)
    near = (sums[:n] >= long) | (sums[WINDOW - 1 :] >= long)  # windows that end, or begin, at a line
    edge = np.flatnonzero(np.diff(np.r_[0, near.astype(int), 0]))
    stretches = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))  # from a surge to a dive
    if marked is not None and marked.any():
        outside = max((int(size[a:b][~marked[a:b]].sum()) for a, b in stretches), default=0)
        if PRIOR * max(int(size[marked].sum()), 1) >= outside:
            return marked.copy()
    is_long = size >= long
    largest = max(int(size[a:b].sum()) for a, b in stretches)
    main = next((a, b) for a, b in stretches if int(size[a:b].sum()) == largest)
    home = set(box[main[0] : main[1]][is_long[main[0] : main[1]]].tolist())
    keep = np.zeros(n, bool)
    for a, b in stretches:
        beside = set(box[a:b][is_long[a:b]].tolist())
        firm = np.flatnonzero([is_long[i] or box[i] in beside and size[i] > 0 for i in range(a, b)]) + a
        if not len(firm) or int(size[a:b].sum()) < SMALL * largest and not beside & home:
            continue
        first, last = int(firm[0]), int(firm[-1])
        while first > a and heading[first - 1]:
            first -= 1
        keep[first : last + 1] = True
    # runs of links only
    links = (size == 0) & ~heading
    edge = np.flatnonzero(np.diff(np.r_[0, links.astype(int), 0]))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a >= WINDOW:
            keep[a:b] = False
    return keep


def between(keep: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Also the lines between two kept ones of one element."""
    keep, kept = keep.copy(), np.flatnonzero(keep)
    for a, b in zip(kept[:-1], kept[1:]):
        if box[a] == box[b]:
            keep[a:b] = True
    return keep


def main_text(page: str | None) -> str:
    found = lines(page or "")
    if not found:
        return ""
    whole, linked, box = (np.array([x[k] if k else len(x[0]) for x in found]) for k in (0, 1, 2))
    heading, marked = (np.array([x[k] for x in found], bool) for k in (3, 4))
    keep = distribution(whole - linked, whole, box, heading, marked)
    if not (keep == marked).all():
        keep = between(keep, box)
    return "\n\n".join(x[0] for x, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)
