"""Main text of web pages by consensus of each host's container paths.

First pass: every page scores its containers (article, section, div, ...) and
names the generalised tag-class path of its best one, beside the paths that it
has. Spark counts per host the votes for each path and the pages that have it.
Second pass: every page is cut again by the path with the most votes among its
own ones; its own best container joins in where it holds the others, or where
its path wins on most of the host's pages that have it.

Paths are known by a digest of their names, so that a page's memory grows with
its length and not with the depth of its elements.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.common import join_sized
from duelframe.llm.url_filter import host_and_path
from duelframe.session import ship, spool

# fixed values: element names of HTML by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article main section div td body center blockquote".split())
#: Containers that may win; a quotation is a part of its article.
RATED = CONTAINERS - {"blockquote"}
SKIPPED = frozenset(
    "head nav header footer aside form script style noscript template iframe button select option svg canvas dialog menu "
    "textarea title object video audio xmp noembed noframes".split()
)
SKIPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
# fixed values: words that name page furniture in class and id attributes, whatever stands beside them
SKIPPED_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies disclaimer disqus footer gdpr masthead navbar newsletter pagination popup promo sidebar sponsor sponsored toolbar widget "
    "widgets".split()
)
# fixed values: words that do so only alone or among words for places and shapes
VAGUE_WORDS = frozenset(
    "alert banner consent header login menu menubar modal nav navigation notice notices notification overlay pager promoted promotion "
    "related replies respond search share sharing signup social subscribe subscription".split()
)
#: Words that may stand beside a vague one; any other word (share-price, search-history) makes it another thing.
NEUTRAL_WORDS = frozenset(
    "site main page top bottom left right primary secondary global local mobile desktop area bar box button buttons block body col column "
    "container content form group icon icons inner item items links list outer panel post posts row section slot text title unit wrap wrapper "
    "article articles blog entry legal media privacy reader readers stories story user users website".split()
)
#: Words that say of an element how its page is built (has-sidebar, comments-open, no-footer), not what it is.
MODIFIERS = frozenset("closed disabled enabled free has have hide is no non not off on open opened show with without".split())
#: Readers often write more than the author: their names stay furniture however long the text is.
READERS_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
#: Elements whose start ends an open paragraph, list item or cell of the same kind.
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}
BONUS = {"article": 1.5, "main": 1.5, "body": 0.8}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
READ_ATTRIBUTES = frozenset("class id role style hidden".split())
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")


def _furniture_words(marks: str) -> set[str]:
    """Furniture that class and id names stand for; a name with a modifier stands for none."""
    found: set[str] = set()
    for name in marks.split():
        words = {w.lower() for w in NAME_PART.findall(name)}
        if words & MODIFIERS:
            continue
        found |= words & SKIPPED_WORDS
        vague = words & VAGUE_WORDS
        if vague and words <= VAGUE_WORDS | NEUTRAL_WORDS | SKIPPED_WORDS:
            found |= vague
    return found


def _describe(tag: str, attributes: str) -> tuple[str, bool, frozenset[str]]:
    """Generalised name of an element (tag and classes, digits folded), whether tag or role make it page furniture, and its names that do.

    An element that a browser does not show counts as named 'hidden'.
    """
    skipped, name, named = tag in SKIPPED, tag, set()
    if not attributes.strip(" \t\r\n\f/"):
        return name, skipped, frozenset()
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key in READ_ATTRIBUTES:
            found.setdefault(key, m[2] or m[3] or m[4] or "")
    if "role" in found:
        skipped = skipped or found["role"].strip().lower() in SKIPPED_ROLES
    if not skipped and tag not in ("body", "html", "main"):
        named = _furniture_words(f"{found.get('class', '')} {found.get('id', '')}")
        if tag == "article":  # a reader's comment may be an article of its own
            named &= {"comment", "comments", "ad", "ads"}
        if "hidden" in found or NOT_SHOWN.search(found.get("style", "")):
            named.add("hidden")
    classes = sorted({DIGITS.sub("#", c.lower()) for c in found.get("class", "").split()})
    return ".".join([tag, *classes]), skipped, frozenset(named)


class Page:
    """Text pieces of a page in order and the containers that hold them.

    Furniture, scripts, styles and comments leave no piece; the edge of a block
    or a line break leaves a blank one. A container is (path, first piece, end);
    a path is the number of its parent and a name. The first container is the
    page itself, with the empty path 0.

    What only its name calls furniture is none if it holds a main element, the
    longest article, or, unless its name is that of readers' comments or an
    article or main element stands outside, most of the plain text.
    """

    def __init__(self, page: str):
        self._read_page(page, frozenset())
        wrong = self._misnamed()
        if wrong:
            self._read_page(page, wrong)

    def _read_page(self, page: str, shown: frozenset[int]) -> None:
        self.pieces: list[str] = []
        self.linked: list[bool] = []
        self.containers: list[tuple[int, int, int]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._parts: list[tuple[int, str]] = [(-1, "")]  # of each path: its parent, its last name
        self._stack: list[tuple[str, int, bool, int]] = []  # tag, path, furniture, number of its container or -1
        self._opened: Counter[str] = Counter()
        self._hidden = self._links = 0
        self._shown = shown
        self._hard = self._plain = 0  # furniture by tag or role that is open; plain characters outside of such
        self._names: list[tuple[frozenset[str], int, int]] = []  # furniture by name: its words, plain characters before and up to its end
        self._articles: list[tuple[str, int, int]] = []  # article and main elements: tag, plain characters before and up to the end
        self._marks: list[tuple[bool, int, int]] = []  # of what is open: hard, number in names or -1, number in articles or -1
        self._open("", 0, False, True)
        self._read(page)
        while self._stack:
            self._pop()
        self._good, self._bad = [0], [0]  # characters of plain and of linked text before each piece
        for text, linked in zip(self.pieces, self.linked):
            n = len(text.strip())
            self._good.append(self._good[-1] + (0 if linked else n))
            self._bad.append(self._bad[-1] + (n if linked else 0))

    def _path(self, above: int, name: str) -> int:
        number = self._paths.setdefault((above, name), len(self._parts))
        if number == len(self._parts):
            self._parts.append((above, name))
        return number

    def keys(self) -> list[str]:
        """Of each path, the digest of its names from the outermost on."""
        digests: list[str] = []
        for parent, name in self._parts:
            above = digests[parent] if parent >= 0 else ""
            digests.append(hashlib.blake2b(f"{above}>{name}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
        return digests

    def depth(self, path: int) -> int:
        deep = 0
        while path > 0:
            path, deep = self._parts[path][0], deep + 1
        return deep

    def _tag(self, k: int) -> str:
        return self._parts[self.containers[k][0]][1].partition(".")[0]

    def holds_text(self, k: int) -> bool:
        _, first, end = self.containers[k]
        return self._good[end] + self._bad[end] > self._good[first] + self._bad[first]

    def holds(self, k: int, inner: int) -> bool:
        return self.containers[k][1] <= self.containers[inner][1] and self.containers[inner][2] <= self.containers[k][2]

    def _misnamed(self) -> frozenset[int]:
        """Numbers of the elements that are furniture by name only and hold what cannot be furniture."""
        if not self._names:
            return frozenset()
        full = [a for a in self._articles if a[2] > a[1]]
        kept = [a for a in full if a[0] == "main"]
        kept += sorted((a for a in full if a[0] == "article"), key=lambda a: a[1] - a[2])[:1]
        wrong = set()
        for k, (words, first, end) in enumerate(self._names):
            held = any(first <= a[1] and a[2] <= end for a in kept)
            if held or not (full or words & READERS_WORDS) and 2 * (end - first) > self._plain:
                wrong.add(k)
        return frozenset(wrong)

    def _mark(self, tag: str, hard: bool, named: frozenset[str]) -> bool:
        """Note what opens; whether it is furniture."""
        name = article = -1
        if named:
            name = len(self._names)
            self._names.append((named, self._plain, self._plain))
        elif tag in ("article", "main") and not hard and not self._hard:
            article = len(self._articles)
            self._articles.append((tag, self._plain, self._plain))
        self._marks.append((hard, name, article))
        self._hard += hard
        return hard or name >= 0 and name not in self._shown

    def _unmark(self) -> None:
        hard, name, article = self._marks.pop()
        self._hard -= hard
        if name >= 0:
            self._names[name] = (*self._names[name][:2], self._plain)
        if article >= 0:
            self._articles[article] = (*self._articles[article][:2], self._plain)

    def _add(self, text: str) -> None:
        if not self._hard and not self._links:
            self._plain += len(text.strip())
        if not self._hidden:
            self.pieces.append(text)
            self.linked.append(self._links > 0)

    def _open(self, tag: str, path: int, hard: bool, container: bool, named: frozenset[str] = frozenset()) -> None:
        furniture = self._mark(tag, hard, named)
        number = -1
        if container and not furniture and not self._hidden:
            number = len(self.containers)
            self.containers.append((path, len(self.pieces), -1))
        self._stack.append((tag, path, furniture, number))
        self._opened[tag] += 1
        self._hidden += furniture
        self._links += tag == "a"

    def _pop(self) -> str:
        tag, path, furniture, number = self._stack.pop()
        self._opened[tag] -= 1
        self._unmark()
        self._hidden -= furniture
        self._links -= tag == "a"
        if number >= 0:
            self.containers[number] = (path, self.containers[number][1], len(self.pieces))
        return tag

    def _close(self, tags: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of these names, and what is open inside it; stop at ``within``."""
        if not any(self._opened[t] for t in tags):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in tags:
                while len(self._stack) > k:
                    self._pop()
                return
            if self._stack[k][0] in within:
                return

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            m = TOKEN.search(page, at)
            start = m.start() if m else size
            if start > at:
                self._add(page[at:start])
            if not m:
                return
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            block = tag not in INLINE
            if m[1] or m[4]:
                self._close((tag,))
                if block:
                    self._add("\n")
                continue
            attributes = m[3] or m[6] or ""
            if block:
                self._add("\n")
                if tag not in VOID:
                    self._close(SELF_CLOSING.get(tag, ("p",)), CONTAINERS if tag != "td" else frozenset(("table",)))
            if tag in VOID:
                continue
            name, furniture, named = _describe(tag, attributes)
            above = self._stack[-1][1]
            if block:
                self._open(tag, self._path(above, name), furniture, tag in RATED, named)
            else:
                self._open(tag, above, furniture, False, named)
            if tag in RAW:  # no markup inside: go on at its end tag
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                stop = end.start() if end else size
                self._add(page[at:stop])
                at = stop

    def best(self) -> int:
        """Number of the container with the main text: the outermost with the best score, or what holds it and more plain text.

        An article or main element stands for itself; another container gives way
        to the one around it, short of the body, if it leaves out more than links.
        """
        tags = [self._tag(k) for k in range(len(self.containers))]
        rated = []
        for k, (_, first, end) in enumerate(self.containers):
            plain, linked = self._good[end] - self._good[first], self._bad[end] - self._bad[first]
            rated.append((plain * (plain / (plain + linked)) if plain else 0.0) * BONUS.get(tags[k], 1.0) if k else plain * 0.7)
        most = max(rated)
        best = max((k for k, r in enumerate(rated) if r >= most), key=lambda k: (self._length(k), -k))
        lines, whole = self._text_lines(), ("article", "main")
        alike = self._alike(best)
        for k in range(best - 1, 0, -1):  # what is around a container opened before it
            if tags[k] == "body" or tags[best] in whole and tags[k] not in whole or not self.holds(k, best):
                continue
            if self._leaves_text(k, alike, lines):
                best = k
                alike = self._alike(best)
        return best

    def _text_lines(self) -> list[int]:
        """Before each piece, the number of lines begun that are more text than links; a line lies in a container or outside of it."""
        begun, start, plain, linked = [0] * (len(self.pieces) + 1), 0, 0, 0
        for k, piece in enumerate([*self.pieces, "\n"]):
            if piece != "\n":
                n = len(piece.strip())
                plain, linked = (plain, linked + n) if self.linked[k] else (plain + n, linked)
                continue
            if plain > linked:
                begun[start + 1] += 1
            start, plain, linked = k + 1, 0, 0
        return list(accumulate(begun))

    def _alike(self, k: int) -> tuple[list[int], list[int]]:
        """First pieces and ends of the containers with the path of this one, in page order; none lies in another."""
        path = self.containers[k][0]
        found = [(first, end) for p, first, end in self.containers if p == path]
        return [first for first, _ in found], [end for _, end in found]

    def _leaves_text(self, around: int, taken: tuple[list[int], list[int]], lines: list[int]) -> bool:
        """Whether a line that is more text than links lies in one container and outside of all the taken ones."""
        _, first, end = self.containers[around]
        firsts, ends = taken
        low, high = bisect_left(firsts, first), bisect_left(firsts, end)
        return lines[end] - lines[first] > sum(lines[ends[k]] - lines[firsts[k]] for k in range(low, high))

    def _length(self, k: int) -> int:
        _, first, end = self.containers[k]
        return end - first

    def text(self, numbers: list[int]) -> str:
        """Decoded text of these containers in page order; what lies inside another one counts once."""
        parts, done = [], 0
        for k in sorted(numbers):
            _, first, end = self.containers[k]
            if end > done:
                parts.append("".join(self.pieces[max(first, done) : end]))
                done = end
        return " ".join(entities.unescape("\n".join(parts)).split())


def survey(page: str | None) -> tuple[str | None, int, list[str]]:
    """Key and depth of the path of the page's best container, and the keys of all its paths with text; none where the page has no text."""
    if not page:
        return None, 0, []
    read = Page(page)
    best = read.best()
    if not read.text([best]):
        return None, 0, []
    keys = read.keys()
    path = read.containers[best][0]
    return keys[path], read.depth(path), sorted({keys[c[0]] for k, c in enumerate(read.containers) if read.holds_text(k)})


def best_path(page: str | None) -> str | None:
    """Key of the path of the page's best container; null where the page has no text."""
    return survey(page)[0]


def main_text(page: str | None, paths: Sequence[str] | None, own_wins: bool = False) -> str:
    """Text under the first of ``paths`` that the page has, else of its own best container.

    The own one joins the others where it lies around one of them, so that no
    plain text is left beside them, or where ``own_wins`` says that the host
    votes for its path too.
    """
    if not page:
        return ""
    read = Page(page)
    own = read.best()
    keys = read.keys() if paths is not None and len(paths) else []
    for path in paths if paths is not None else ():
        numbers = [k for k, c in enumerate(read.containers) if keys[c[0]] == path]
        if numbers and (text := read.text(numbers)):
            around = read._tag(own) not in ("", "body") and any(read.holds(own, k) for k in numbers)
            return read.text(sorted({*numbers, own})) if around or own_wins else text
    return read.text([own])


def _survey_all(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([survey(h) for h in html], columns=["best", "depth", "paths"])


def choose_paths(surveyed: DataFrame) -> DataFrame:
    """(host, layout, path, own_wins, path_votes) for every layout of ``surveyed`` (host, layout, best, depth, paths).

    A layout is what pages have in common that have the same paths and the same
    best one. Pages are counted by layout before anything is joined, so a busy
    host costs as many rows as it has layouts. Equal votes go to the deeper
    path, then to the smaller key.
    """
    layouts = spool(
        surveyed.groupBy("host", "layout").agg(
            F.count(F.lit(1)).alias("pages"), F.first("best").alias("best"), F.first("depth").alias("depth"), F.first("paths").alias("paths")
        ),
        "page-layouts",
    )
    votes = layouts.groupBy("host", F.col("best").alias("path")).agg(F.sum("pages").alias("votes"), F.max("depth").alias("deep"))
    had = layouts.select("host", "layout", "pages", "best", F.explode("paths").alias("path"))
    seen = had.groupBy("host", "path").agg(F.sum("pages").alias("seen"))
    rated = spool(votes.join(seen, ["host", "path"]), "path-votes")
    return (
        join_sized(had, rated, ["host", "path"])
        .groupBy("host", "layout")
        .agg(
            F.max(F.struct("votes", "deep", F.col("path"))).alias("most"),
            F.max((F.col("path") == F.col("best")) & (F.col("votes") * 2 > F.col("seen"))).alias("own_wins"),
        )
        .select("host", "layout", F.col("most.path").alias("path"), "own_wins", F.col("most.votes").alias("path_votes"))
    )


def extract_main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars, path_votes) for every row of ``pages``.

    Null or blank html gives an empty text of 0 characters and no votes. Rows
    with null or malformed urls vote together as the host ''. Repeated rows vote
    and return once each; equal votes go to the deeper path, then to the smaller
    key. Long and deeply nested pages are read whole, and a page may use any
    path of its host. An empty table gives no rows; other columns are not read.
    """
    ship(__name__)
    host, _ = host_and_path(F.col(url_column))
    row = [F.xxhash64(F.col(id_column), F.col(url_column)).alias("_row"), F.xxhash64(F.col(html_column)).alias("_html")]
    rows = pages.select(
        F.col(id_column).alias("_id"), F.col(url_column).alias("_url"), F.md5(host).alias("host"), F.col(html_column).alias("html"), *row
    )
    look = F.pandas_udf(_survey_all, "best string, depth int, paths array<string>")
    surveyed = spool(
        rows.select("_row", "_html", "host", look("html").alias("s"))
        .where("s.best IS NOT NULL")
        .select("_row", "_html", "host", "s.*", F.md5(F.concat_ws(" ", "s.best", "s.paths")).alias("layout")),
        "page-surveys",
    )
    chosen = join_sized(
        surveyed.select("_row", "_html", "host", "layout"), spool(choose_paths(surveyed), "page-paths"), ["host", "layout"]
    ).drop("host", "layout")
    # rows of one key have one url and one html, so they share what is chosen
    chosen = spool(chosen.dropDuplicates(["_row", "_html"]), "chosen-paths")

    @F.pandas_udf(T.StringType())
    def cut(html: pd.Series, path: pd.Series, own_wins: pd.Series) -> pd.Series:
        found = [main_text(h, [p] if p else None, bool(o)) for h, p, o in zip(html, path, own_wins)]
        return pd.Series(found, dtype=object)

    placed = join_sized(rows, chosen, ["_row", "_html"], "left")
    return placed.select(
        F.col("_id").alias(id_column), F.col("_url").alias("url"), cut("html", "path", F.coalesce("own_wins", F.lit(False))).alias("text"), "path_votes"
    ).select(id_column, "url", "text", F.length("text").cast("long").alias("n_chars"), "path_votes")
