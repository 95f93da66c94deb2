"""The main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, and every line gets a
weight: the length of its text, and nothing where the text cannot be the
article's - in scripts, menus, forms, adverts, comments and the like, outside
the article where the page marks one, or mostly links where it marks none.
Sums of weights over a window of lines rise from nothing at a surge point and
fall back to it at a dive point.  The text between the two is kept, lines that
the window bridges included, if the sums reach a threshold there; on a page
where they never do, the stretch of the largest sum is kept.  This decides on
every page, whether it marks its article or not.

A dropped part leaves a gap as wide as the window, but none between two lines
of one article or container: the text around it is one stretch.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._words import slices, tidy

WINDOW, SURGE = 3, 80

# Element names and words of class and id.
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
_DROPPED = frozenset("nav footer aside form button select menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINERS = frozenset("article blockquote body center dd details div fieldset figure li main section td th".split())
_HINTS = frozenset("""
ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs
footer sidebar aside notice cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login form search share sharing social
comment comments commentlist reply replies disqus respond related recommended pagination pager toolbar widget masthead skip
""".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
# a class or id with one of these speaks of what an element holds or lacks, not of what it is
_ABOUT = frozenset("has have with without no not is".split())
# hints and elements that whole layouts bear too; of a class of several words, those of the second list as well
_LAYOUT = frozenset("banner promo widget overlay modal masthead header form search".split())
_LAYOUT_PARTS = frozenset("sidebar aside menu nav navbar".split())
# what a start tag ends without an end tag: (elements that end, elements that bound the search)
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_ENDS_P = _BLOCKS - frozenset("body caption html head tbody td tfoot th thead tr legend".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|([^<]+)|(<)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)


def _hint(name: str, attributes: str, in_article: bool) -> bool | None:
    """None if nothing speaks against an element: neither its name nor a word of a class, id or role; else whether a whole layout may bear that word."""
    if name in _DROPPED or name == "header" and not in_article:
        return name in _LAYOUT
    if not attributes or name in ("html", "body", "article", "main"):
        return None
    for key, value in _ATTRIBUTE.findall(attributes):
        role = key.lower() == "role"
        for part in value.strip("\"' ").lower().split():
            words = re.findall(r"[a-z0-9]+", part)
            if not role and _ABOUT.intersection(words):
                continue
            for word in words:
                if word in (_ROLES if role else _HINTS) or word == "header" and not in_article and not role:
                    return not role and (word in _LAYOUT or len(words) > 1 and word in _LAYOUT_PARTS)
    return None


class Line:
    """The text of a block: its share in links, the dropped element that holds it (0: none), its article (0: none) and its container."""

    __slots__ = ("text", "links", "cut", "article", "home")

    def __init__(self, text: str, links: float, cut: int, article: int, home: int):
        self.text, self.links, self.cut, self.article, self.home = text, links, cut, article, home


def lines(page: str) -> tuple[list[Line], dict[int, tuple[bool, bool, int]]]:
    """The lines of a page in order, and per dropped element whether it may be a whole layout, whether an article lies in it, and the dropped one around it (0: none).

    A dropped element begins with an empty line of its own.  End tags that HTML
    lets out are supplied; an end tag without a start does nothing.
    """
    out: list[Line] = []
    dropped: dict[int, tuple[bool, bool, int]] = {}
    # open elements: name, and the dropped element, article and container from here on
    names, cuts, articles, homes = [""], [0], [0], [0]
    parts: dict[int, list[str]] = {}
    linked: dict[int, int] = {}
    count, links, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        for cut, texts in parts.items():
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                out.append(Line(text, min(1.0, linked.get(cut, 0) / len(text)), cut, articles[-1], homes[-1]))
        parts.clear()
        linked.clear()

    def end(depth: int) -> None:
        nonlocal links
        if any(x in _BLOCKS for x in names[depth:]):
            flush()
        links -= names[depth:].count("a")
        del names[depth:], cuts[depth:], articles[depth:], homes[depth:]

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        close, name, attributes, text, stray = m.groups()
        if text or stray:
            parts.setdefault(cuts[-1], []).append(text or stray)
            if links:
                linked[cuts[-1]] = linked.get(cuts[-1], 0) + len(text or stray)
            continue
        if name is None:
            continue
        name = name.lower()
        if close:
            for depth in range(len(names) - 1, 0, -1):
                if names[depth] == name:
                    end(depth)
                    break
                if name not in _BLOCKS and names[depth] in _BLOCKS:
                    break
            else:
                if name in _BLOCKS:
                    flush()
            continue
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else n
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                parts.setdefault(cuts[-1], []).append(" ")
                if name == "hr":
                    flush()
            continue
        ends, bounds = _ENDS.get(name, ((), ()))
        if name in _ENDS_P:
            ends, bounds = (*ends, "p"), (*bounds, "button", "td", "th", "caption", "object")
        for depth in range(len(names) - 1, 0, -1) if ends else ():
            if names[depth] in ends:
                end(depth)
                if name not in _ENDS or names[-1] not in _ENDS[name][0]:
                    break
            elif names[depth] in bounds or names[depth] in _BLOCKS and name not in _ENDS:
                break
        if name in _BLOCKS:
            flush()
        if attributes.endswith("/"):
            continue
        cut, article, home = cuts[-1], articles[-1], homes[-1]
        if name in ("article", "main"):
            for x in set(cuts):
                if x:
                    dropped[x] = dropped[x][0], True, dropped[x][2]
            count += 1
            article = article or count
        elif (not cut or dropped[cut][0]) and (layout := _hint(name, attributes, article > 0)) is not None:
            count += 1
            dropped[count] = layout, False, cut
            cut = count
            if name in _BLOCKS or not any(parts.values()):
                out.append(Line("", 0.0, cut, article, home))
        if name in _CONTAINERS:
            count += 1
            home = count
        elif name == "a":
            links += 1
        names.append(name)
        cuts.append(cut)
        articles.append(article)
        homes.append(home)
    flush()
    return out, dropped


def weights(found: list[Line], lost: set[int]) -> list[int]:
    """The weight of each line; ``lost`` are the dropped elements that do not count."""
    open_ = [bool(x.text) and x.cut not in lost for x in found]
    marked = any(o and x.article for x, o in zip(found, open_, strict=True))
    return [len(x.text) if o and (x.article if marked else x.links <= 0.5) else 0 for x, o in zip(found, open_, strict=True)]


def stretches(weight: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """(first, behind the last) of the lines between each surge and dive point whose window sums reach ``surge``, or the largest sum if none does."""
    w = np.asarray(weight, np.int64)
    if not w.any():
        return []
    sums = np.convolve(w, np.ones(window, np.int64))  # sums[i]: the window that ends with line i
    up = np.flatnonzero((sums > 0) & (np.concatenate(([0], sums[:-1])) == 0))  # its last line has the first weight after none
    down = np.flatnonzero((sums == 0) & (np.concatenate(([0], sums[:-1])) > 0))
    down = np.append(down, len(sums))[: len(up)] - window + 1
    peak = [int(sums[i : j + window - 1].max()) for i, j in zip(up, down, strict=True)]
    least = min(surge, max(peak))
    return [(int(i), int(j)) for i, j, p in zip(up, down, peak, strict=True) if p >= least]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Kept blocks in page order, two line breaks between; empty if there is none.

    A dropped element counts if only a layout's word speaks against it and it
    holds an article, or if all text would be lost; one of comments or cards
    never does, whatever elements it is made of.
    """
    found, dropped = lines(page or "")

    def gone(free) -> set[int]:
        """Dropped elements that are not free, and those inside them."""
        out: set[int] = set()
        for k, (layout, article, outer) in dropped.items():  # an outer one comes first
            if not free(layout, article) or outer in out:
                out.add(k)
        return out

    lost_in = gone(lambda layout, article: layout and article)
    weight = weights(found, lost_in)
    if not any(weight):
        lost_in = gone(lambda layout, _: layout)
        weight = weights(found, lost_in)
        if max(weight, default=0) < surge:
            return ""
    marked = any(x.article and w for x, w in zip(found, weight, strict=True))
    lost = [x.cut in lost_in for x in found]
    place = [x.article or -x.home for x in found]
    before, behind, last = [0] * len(found), [0] * len(found), 0
    for i, x in enumerate(found):
        before[i] = last
        last = place[i] if x.text and not lost[i] else last
    last = -1
    for i in range(len(found) - 1, -1, -1):
        behind[i] = last
        last = place[i] if found[i].text and not lost[i] else last
    text, mass = [], []
    for i, x in enumerate(found):
        if not lost[i] and x.text:
            text.append("" if marked and not x.article else x.text)
            mass.append(weight[i])
        elif before[i] != behind[i]:
            text += [""] * window
            mass += [0] * window
    return "\n\n".join(t for i, j in stretches(mass, window, surge) for t in text[i:j] if t)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``df`` without ``html_col``, with ``text`` (empty if none) and ``n_chars``, its code points.

    Null and empty pages have no text.  Columns already named ``text`` or
    ``n_chars`` are replaced.  Nothing is shuffled.
    """
    from pyspark.sql import types as T

    names = [c for c in df.columns if c not in (html_col, "text", "n_chars")]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, html_col):
                texts = [main_text(page) for page in batch.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return df.select(*names, F.col(html_col)).mapInArrow(tidy(run), schema)
