"""Main text of HTML pages from streaming parser events and the text-to-tag ratio of their lines."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from rowassay.llm.common import map_texts, text_array

# Elements of the HTML standard by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "applet aside audio button canvas datalist dialog footer form head header iframe math menu nav noscript object script "
    "select style svg template textarea title video".split()
)
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in a class or id that name a part of a page that is not its article.
SKIPPED_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies disqus footer gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices "
    "notification outbrain pagination paywall popup promo promoted promotion recommended related replies share sharing sidebar "
    "signup social sponsor sponsored subscribe taboola toolbar widget".split()
)
_WORDS = re.compile(r"[a-z0-9]+")
#: What an element's start ends before it: (elements it ends, elements that stop the search).
_ENDED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}


class Lines(HTMLParser):
    """Turns events into lines: the text of a block, its tags, and the element it lies in.

    ``lines`` holds (text, tags, element); ``parents`` gives each element's parent, and ``mains`` the elements that a page
    itself calls its main content. Text in a skipped part makes no line.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.parents, self.mains = [], [-1], []
        self.stack = [("", 0, False, False)]  # tag, element, whether it is skipped, whether it lies in main content
        self.text, self.tags = [], 0

    def _flush(self):
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.stack[-1][1]))
            self.text = []
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self._flush()
            if self.stack[-1][0] == "p":
                self.stack.pop()
            ended, stop = _ENDED.get(tag, ((), ()))
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth][0] in ended:
                    del self.stack[depth:]
                if depth >= len(self.stack) or self.stack[depth][0] in stop or not ended:
                    break
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, element, skipped, inside = self.stack[-1]
        own = tag in MAIN or (inside and tag in HEADINGS)
        skip = skipped or tag in SKIPPED or (tag not in ("html", "body", *MAIN) and bool(attrs) and _unwanted(attrs))
        if skipped == "header" and tag in HEADINGS:
            skip = False  # the title in an article's own header
        elif skip and not skipped and tag == "header" and inside:
            skip = "header"
        elif skip:
            skip = skipped or True
        if not block and (not skip or skipped) and tag not in SKIPPED:
            return  # an inline element
        main = tag in MAIN or any(k == "role" and v == "main" for k, v in attrs)
        if block:
            self.parents.append(element)
            element = len(self.parents) - 1
            if main and not skip and not inside:
                self.mains.append(element)
        self.stack.append((tag, element, skip, inside or main or own))

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self._flush()
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == tag:
                del self.stack[depth:]
                return

    def handle_data(self, data):
        if not self.stack[-1][2]:
            self.text.append(data)

    def close(self):
        super().close()
        self._flush()


def _unwanted(attrs) -> bool:
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        value = value.lower()
        if name in ("class", "id") and not SKIPPED_WORDS.isdisjoint(_WORDS.findall(value)):
            return True
        if name == "role" and value.strip() in SKIPPED_ROLES:
            return True
        if name == "aria-hidden" and value.strip() == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the outer values go on."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str) -> str:
    """The blocks of the page's article, one a line.

    Lines whose smoothed text-to-tag ratio reaches half its standard deviation are content; the rest are not. Of the elements
    a page calls its main content (or of all, if it calls none so) the one with the most content, less what else it holds,
    is the article, and all its lines are kept, however short: the ratio picks the region, not the lines in it.
    """
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    size = np.array([len(text) for text, _, _ in lines], float)
    ratio = smoothed(size / (1 + np.array([tags for _, tags, _ in lines])))
    content = np.where(ratio >= 0.5 * ratio.std(), size, -size)
    parents = parser.parents
    score, holds = np.zeros(len(parents)), np.zeros(len(parents), bool)
    for worth, (_, _, element) in zip(content, lines):
        while element >= 0:
            score[element] += worth
            holds[element] = True
            element = parents[element]
    among = [m for m in parser.mains if holds[m]] or np.flatnonzero(holds).tolist()
    best = max(among, key=lambda e: (score[e], e))
    inside = {best}
    for element in range(best + 1, len(parents)):  # parents come before their children
        if parents[element] in inside:
            inside.add(element)
    return "\n".join(text for text, _, element in lines if element in inside)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` and text: the main text of every whole page, in one pass.

    A null or empty page, or one without text, gives the empty text. Broken markup is read as far as it goes; repeated rows
    are kept; other columns are not read.
    """

    def begin():
        return lambda pages: [text_array([main_text(p) for p in pages.to_pylist()])]

    return map_texts(df, list(keep), html_col, "text string", begin)
