"""HTML extraction by consensus host paths.

Each page is read once to score its containers: the deepest one that holds nearly all of the page's running text (outside
menus, notices and the like, links not counted) gets the page's vote, given as its generalised path of tags and classes.
Spark counts the votes for each host. Then every page is read again and its text is taken from the elements at the host's
winning path; a page without such elements uses its own best container.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, released

#: Share of a page's running text that its best container must hold.
COVER = 0.75
#: Share of a page's running text from which on an element isn't a menu, notice or form, whatever it is called: it wraps the article. Comments
#: may well be longer than an article; they are taken for a wrapper only if they hold nearly all.
WRAPPER, WRAPPER_OF_COMMENTS = 0.5, 0.95
#: Characters, links not counted, from which on a block beside the best container is running text and not a line of some other part.
RUNNING = 40
#: Up to so many hosts the winning paths are broadcast (some 100 bytes each); beyond, hosts of few pages are joined by a shuffle.
BROADCAST_HOSTS = 100_000

#: HTML elements that start a block of text, those that may be containers, those without an end tag, those whose
#: content isn't text, and those that are no part of an article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body center div form main section table tbody td tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|textarea"  # without an end tag they go on to the end of the page
LOOSE = "noscript|template|iframe|svg|math|object|canvas|audio|video|select|button"  # without one, their tag alone is dropped
NOT_ARTICLE, NEVER_ARTICLE = frozenset("header form fieldset".split()), frozenset("nav footer aside menu dialog".split())
#: Words of class, id and role that mark parts around an article, those that mark readers' comments, and those that may stand
#: beside them in a name. A name of other words besides, such as category-social, has-header or search-result, marks nothing.
MARKS = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header masthead menu modal nav navbar navigation navi newsletter notice notification pagination pager popup promo promoted related share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets contentinfo complementary search".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
BESIDE = frozenset("a area articles bar block body bottom box button buttons container content desktop error field fixed form global group icon icons info inner input item items left link links list main message mobile msg outer overlay page panel policy posts primary reader readers right row secondary section site slot small sticky stories sub text thread title top trail user users view wrap wrapper".split())
#: Paragraphs and headings are marked by these alone: a paragraph called notice is part of its article.
MARKS_OF_TEXT = MARKS - frozenset("banner header notice notification search skip footer related social".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote li dt dd pre td th caption figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What stands in a tag behind its name: values are quoted only right behind a =; other quotes are ordinary characters.
INSIDE = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b{INSIDE}>.*?(?:</\1\s*+>|\Z)|<({LOOSE})\b{INSIDE}>|<(/?)([a-zA-Z][^\s/>]*+)({INSIDE})>|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
#: Where a LOOSE element ends; a select or button also ends, as if it had no end tag, where the next one begins.
ENDS = {t: re.compile(rf"</{t}\s*+>" + rf"|<{t}\b" * (t in ("select", "button")), re.IGNORECASE) for t in LOOSE.split("|")}
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\s(hidden)(?=[\s>/=]|$)", re.IGNORECASE)


@lru_cache(maxsize=10_000)
def mark_of(names: str, is_text: bool) -> int:
    """What the words of class, id and role say of an element: 0 nothing, 1 a part around an article, 2 readers' comments."""
    known, found = (MARKS_OF_TEXT if is_text else MARKS), 0
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and all(p in MARKS or p in COMMENTS or p in BESIDE for p in parts):
            found = max(found, *(2 if p in COMMENTS else int(p in known) for p in parts))
    return found


class Page:
    """The blocks of a page in order: (text, characters in links, chain of the elements around it, kept or not)."""

    def __init__(self, source: str | None):
        self.names: list[str] = [""]  # of each element, generalised
        self.paths: list[int] = [0]  # the number of its path; a path is its parent's and a name
        self.known: dict[tuple[int, str], int] = {}
        self.parents: list[int] = [-1]
        self.can_hold: list[bool] = [False]
        self.tags: list[str] = [""]
        self.marks: list[int] = [0]  # as ``mark_of`` has them, and 3 for what never wraps an article
        self.blocks: list[tuple[str, int, int, bool]] = []
        self.stack: list[tuple[str, int]] = [("", 0)]  # tag, element
        self.links, self.open, self.linked = 0, [], 0
        at, source, endless = 0, source or "", set()
        while m := TOKEN.search(source, at):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if not m[0].endswith("/>") and tag not in endless:
                    end = ENDS[tag].search(source, at)
                    if end is None:
                        endless.add(tag)  # nor has a later one an end
                    elif end[0].startswith("</"):
                        at = end.end()
            elif m[4]:
                tag = m[4].lower()
                if tag == "a":
                    self.links = 0 if m[3] else 1
                elif tag == "br":
                    self.open.append(" ")
                elif tag in BLOCKS:
                    self._flush()
                    if m[3]:
                        self._close(tag)
                    elif tag not in VOID:
                        self._open(tag, m[5])
        self._text(source[at:])
        self._flush()
        self._judge()

    def _judge(self) -> None:
        """Blocks in marked elements aren't kept, unless the element holds so much of the page, and all its article and main elements, that it
        wraps the article."""
        held, articles = [0] * len(self.names), [int(t in ("article", "main")) for t in self.tags]
        for text, linked, element, _ in self.blocks:
            held[element] += max(0, len(text) - 2 * linked)
        for k in range(len(self.names) - 1, 0, -1):  # an element comes behind its parent
            held[self.parents[k]] += held[k]
            articles[self.parents[k]] += articles[k]
        least = (0.0, WRAPPER * held[0], WRAPPER_OF_COMMENTS * held[0], 2.0 * held[0])
        kept = [True] * len(self.names)
        for k in range(1, len(kept)):
            wraps = 0 < least[self.marks[k]] <= held[k] and articles[k] == articles[0]
            kept[k] = kept[self.parents[k]] and (not self.marks[k] or wraps)
        self.blocks = [(text, linked, element, kept[element]) for text, linked, element, _ in self.blocks]

    def _text(self, text: str) -> None:
        self.open.append(text)
        if self.links:
            self.linked += len(text.strip())

    def _flush(self) -> None:
        if self.open:
            text = "".join(self.open)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                self.blocks.append((text, self.linked, self.stack[-1][1], True))
            self.open, self.linked = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        if self.stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or tag == self.stack[-1][0] in ("li", "td", "tr", "dt", "dd"):
            self.stack.pop()  # these end where the next block starts
        name, marks, hidden = tag, "", False
        if attributes:
            for k, *values, bare in ATTRIBUTE.findall(attributes):
                value, k = "".join(values), k.lower()
                if k == "class":
                    name += "".join("." + re.sub(r"\d+", "0", c) for c in sorted(value.split()))
                if bare or k == "aria-hidden":
                    hidden = hidden or bool(bare) or value.strip().lower() == "true"
                elif k == "style":
                    hidden = hidden or "display:none" in "".join(value.lower().split())
                else:
                    marks += " " + value
        parent = self.stack[-1][1]
        mark = 3 if tag in NEVER_ARTICLE else 1 if hidden or tag in NOT_ARTICLE else 0
        if marks and tag not in ("html", "body", "article", "main"):
            mark = max(mark, mark_of(marks, tag in TEXT_TAGS))
        self.names.append(name)
        self.paths.append(self.known.setdefault((self.paths[parent], name), len(self.known) + 1))
        self.parents.append(parent)
        self.can_hold.append(tag in CONTAINERS)
        self.tags.append(tag)
        self.marks.append(mark)
        self.stack.append((tag, len(self.names) - 1))

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def best(self) -> int:
        """Element number of the container of the article; 0 if the page has none. That is the deepest one with COVER of the kept running
        text, or what holds it and the rest of the article: the outermost article (or else main) element around it, and from
        there up all containers that add nothing but text, or, where menus and the like are among what they add (which the text
        leaves out), nothing else but headings and running text; none out of an article or main element."""
        held, other, short = [0] * len(self.names), [0] * len(self.names), [0] * len(self.names)
        for text, linked, element, kept in self.blocks:
            n = max(0, len(text) - 2 * linked) if kept else 0
            held[element] += n
            other[element] += not n
            short[element] += kept and n < RUNNING and self.tags[element] not in HEADINGS
        for k in range(len(self.names) - 1, 0, -1):  # an element comes behind its parent
            held[self.parents[k]] += held[k]
            other[self.parents[k]] += other[k]
            short[self.parents[k]] += short[k]
        total = held[0]
        if not total:
            return 0
        best = max((k for k in range(len(held)) if self.can_hold[k] and held[k] >= COVER * total), default=0)
        above, k = [], best
        while k > 0:
            above.append(k)
            k = self.parents[k]
        marked = [k for k in above if self.tags[k] == "article"] or [k for k in above if self.tags[k] == "main"]
        last = 0
        if marked:
            best = marked[-1]
            last = min(k for k in above if self.tags[k] in ("article", "main"))
        for k in above:
            if last <= k < best and (other[k] == other[best] or short[k] == short[best]) and self.can_hold[k]:
                best = k
        return best

    def path(self, element: int) -> str | None:
        """The generalised tag-class path of an element: names without white space, joined by spaces. None for the page itself."""
        names = []
        while element > 0:
            names.append(self.names[element])
            element = self.parents[element]
        return " ".join(reversed(names)) or None

    def text(self, path: str | None) -> str:
        """The kept blocks within the elements at ``path``; within the best container if the page has none there."""
        number = 0
        for name in (path or "").split(" "):
            number = self.known.get((number, name), -1)
        inside = [k > 0 and p == number for k, p in enumerate(self.paths)]
        if not any(inside):
            inside[self.best()] = True
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parents[k]]
        return "\n\n".join(text for text, _, element, kept in self.blocks if kept and inside[element])


def host_of(url):
    """The host as of ``op7``: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path: the winning path of each host that has a vote. Most votes win; of equal ones the longer path, then the
    later one in the order of its characters."""
    return _votes(pages, url, html).drop("n")


def _votes(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``votes`` with n, how many of a host's pages there are, those without a vote too."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            pages = map(Page, batch)
            yield pd.Series([page.path(page.best()) for page in pages], dtype=object)

    vote = F.pandas_udf(released(run), "string").asNondeterministic()  # evaluated once
    cast = pages.select(host_of(F.col(url)).alias("host"), vote(F.col(html)).alias("path"))
    counted = cast.groupBy("host", "path").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("path").isNotNull(), F.struct("n", F.length("path").alias("l"), "path")))
    return counted.groupBy("host").agg(best.alias("b"), F.sum("n").alias("n")).where("b is not null").select("host", F.col("b.path").alias("path"), "n")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text: the main text of every page, blocks joined by two line ends.

    Null or empty html, and pages without running text: ''. A null url or one without ``://`` belongs to host ''. Very long
    and deep pages are read whole: an element costs the same at any depth. Equal pages of a host get equal texts; repeated rows stay. No rows: none. Other columns are left out."""
    winners = cut(_votes(pages, url, html))
    named = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = named.join(F.broadcast(winners), "host", "left")
    else:  # pages of hosts that many pages have don't meet in a task
        joined = join_counted(named, winners, ["host"], how="left")
    joined = joined.select("key", "url", "html", "path")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, paths in batches:
            yield pd.Series([Page(source).text(path) for source, path in zip(sources, paths, strict=True)], dtype=object)

    text = F.pandas_udf(released(run), "string").asNondeterministic()
    return joined.select(F.col("key").alias(key), F.col("url").alias(url), text("html", "path").alias("text"))


def extraction_report(pages: DataFrame) -> DataFrame:
    """The columns of ``op9``."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
