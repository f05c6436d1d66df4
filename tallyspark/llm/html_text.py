"""Main text of web pages by nearest-URL page differencing.

A page becomes text lines, one for each block of its markup. Pages of one host
are ordered by URL path; each page is paired with the neighbour whose path
shares the longer prefix, the two line lists are aligned by their longest common
subsequence, and lines in it, the template, are deleted. A neighbour whose lines
are all the same is a copy of the page, not a sibling, and is passed over.

Differencing alone can't give the right text where each page has its own menu
or advert, or where two pages quote the same paragraph. So lines within
elements that are no article by their meaning (menus, footers, asides, forms,
scripts, and classes such as advert or comments) go first. A class, id or role counts
as a whole, or if each of its words is such a meaning or a container ('ad-box', not
'overflow-hidden' or 'no-sidebar'). html, body, main and article are never noise,
and what is around an article is none for it; a form that holds more than half of
the page's other text is the page, not a form in it; an article marked as a comment
is one if the page has another article. If a page has explicit article elements with
text, the result is the lines of those that differencing leaves a line of: one that is
wholly in the template, such as a teaser that its siblings show too, goes if another
has a line of the page's own, and an article quoting its sibling stays whole. Else the
result is the lines that differencing leaves, without those that only hold links.

The result joins the kept lines by a space; white space in a line is one space,
character references are decoded. Pairing is a sort by (host, path) over ranges,
so a host of any size spreads over tasks; the pages that meet at the edge of two
ranges are paired afterwards (two rows a range).

Rows: a null or empty html gives an empty text with n_chars 0; a null URL has no
sibling; repeated rows give the same text each; broken and cut markup is read as
far as it goes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
          "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
          "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table",
          "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"ul", "ol", "dl", "table", "select", "menu", "div", "section", "article", "main", "body"}
_NO_ARTICLE = {"head", "nav", "footer", "aside", "button", "select", "svg", "canvas", "object", "dialog", "menu", "template", "audio", "video", "map"}
_NOISE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
          "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
          "signup", "social", "share", "sharing", "sidebar", "widget", "widgets", "related", "recommended", "recommendations", "trending",
          "breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "footer", "masthead", "header", "topbar", "toolbar", "login",
          "search", "pagination", "pager", "copyright", "hidden", "navigation", "contentinfo", "complementary", "dialog", "byline"}
_COMMENTS = {"comment", "comments", "disqus", "reply", "replies", "respond", "responses", "discussion"}
_CONTAINERS = {"wrapper", "wrap", "container", "box", "block", "area", "bar", "section", "panel", "inner", "outer", "list", "item", "items", "links",
               "link", "buttons", "button", "icons", "left", "right", "top", "bottom", "site", "global", "primary", "secondary", "form", "thread"}
_NEVER_NOISE = {"html", "body", "main", "article"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@lru_cache(maxsize=4096)
def _means(token: str) -> tuple[bool, bool]:
    """Whether a class, id or role is noise, reader comments."""
    words = {token.lower()}
    if not words & (_NOISE | _COMMENTS):
        words = {w.lower() for w in _WORD.findall(token)}
        if not words <= _NOISE | _COMMENTS | _CONTAINERS:
            return False, False
    return bool(words & _NOISE), bool(words & _COMMENTS)


def _hints(attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes mark it as noise, as reader comments."""
    noise = comments = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for token in value.split():
                a, b = _means(token)
                noise, comments = noise or a, comments or b
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            noise = True
    return noise, comments


class _Place(NamedTuple):
    """What the open elements say of a text within them; each element's place follows
    from the one around it, so that a text costs the same at any depth."""

    article: bool = False   # in an article or main element
    reply: bool = False     # in an article marked as a comment
    hard: bool = False      # in an element that never holds an article
    noise: bool = False     # in noise, with no article in it
    comments: bool = False  # in comments, with no main in them
    header: bool = False    # in a header element
    heading: bool = False   # in a heading within the innermost header
    form: int = 0           # the outermost form within the innermost article
    no: int = 0             # the innermost article's number

    def within(self, name: str, what: str) -> _Place:
        """The place within one more element."""
        place = self._replace(comments=False) if name == "main" and self.comments else self
        if what.startswith(("article", "reply")):
            return place._replace(article=True, reply=place.reply or what.startswith("reply"), noise=False, form=0, no=int(what.lstrip("aceilprty")))
        if what.startswith("form"):
            return place._replace(form=place.form or int(what[4:]))
        if what == "heading":
            return place._replace(heading=place.header)
        if what == "header":
            return place._replace(header=True, heading=False)
        return place._replace(**{what: True}) if what else place

    def dead(self) -> bool:
        """Nothing brings back a comment (but main) or what stands in a hard noise
        element; of noise and article the last decides; a header counts in an article,
        by its headings."""
        return self.hard or self.noise or self.comments or self.header and not (self.article and self.heading)


def lines_of(page: str | None) -> list[tuple[str, str, int]]:
    """(text, kind, article) of each block in page order; kind: 'article' within an
    article or main element, 'link' only links outside of one, 'other'; article: the
    number of the innermost such element (0: none). Lines of elements that hold no
    article are not returned."""
    if not page:
        return []
    out: list[tuple[str, str, int, bool, int]] = []  # text, kind, the form it goes with (0: none), whether in an article marked as a comment, article
    stack: list[tuple[str, _Place]] = []
    open_: Counter = Counter()  # elements on the stack by name
    n_forms = n_articles = 0
    buffer: list[str] = []
    in_link: list[bool] = []

    def cut(i: int) -> None:
        for n, _ in stack[i:]:
            open_[n] -= 1
        del stack[i:]

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        place = stack[-1][1] if stack else _Place()
        if text and not place.dead():
            out.append((text, "article" if place.article else "link" if all(in_link) else "other", place.form, place.reply, place.no))
        buffer.clear()
        in_link.clear()

    at = 0
    while True:
        m = _TOKEN.match(page, at)
        if not m or m.end() == at:
            break
        at = m.end()
        closing, name, attributes, text = m.groups()
        if text is not None:
            if text.isspace():
                buffer.append(" ")
            else:
                buffer.append(html_lib.unescape(text))
                in_link.append(open_["a"] > 0)
            continue
        if name is None:
            continue
        name = name.lower()
        block = name in _BLOCK
        if block:
            flush()
        elif name == "br":
            buffer.append(" ")
        if closing:
            if open_[name]:
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                if not block and any(n in _BLOCK for n, _ in stack[i:]):
                    flush()
                cut(i)
            continue
        if name in _VOID:
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if block:  # an open paragraph ends here, and so does an open item of the same list
            if open_["p"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        cut(i)
                        break
                    if stack[i][0] in _BLOCK:
                        break
            if any(open_[n] for n in _CLOSES.get(name, ())):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _CLOSES[name]:
                        cut(i)
                        break
                    if stack[i][0] in _FENCE:
                        break
        noise, comments = _hints(attributes)
        what = ""
        if name in ("article", "main"):
            n_articles += 1
            what = f"reply{n_articles}" if comments and name == "article" else f"article{n_articles}"
        elif comments and name not in _NEVER_NOISE:
            what = "comments"
        elif name in _NO_ARTICLE:
            what = "hard"
        elif name == "form":
            n_forms += 1
            what = f"form{n_forms}"
        elif name == "header":
            what = "header"
        elif noise and name not in _NEVER_NOISE:
            what = "noise"
        elif name in _HEADINGS:
            what = "heading"
        if not attributes.rstrip().endswith("/") or block:
            stack.append((name, (stack[-1][1] if stack else _Place()).within(name, what)))
            open_[name] += 1
    flush()
    if any(kind == "article" and not reply for _, kind, _, reply, _ in out):
        out = [x for x in out if not x[3]]
    held = Counter()
    for t, kind, form, _, _ in out:
        held[form] += len(t) * (kind != "link")
    return [(t, kind, no) for t, kind, form, _, no in out if not form or 2 * held[form] > held.total()]


def line_hashes(lines: list[tuple[str, str, int]]) -> list[int]:
    import xxhash
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _, _ in lines]


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``."""
    shared: set[int] = set()
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        shared.add(lo)
        lo += 1
    end_a, end_b = len(a), len(b)
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
        shared.add(end_a)
    places: dict[int, list[int]] = {}
    for j in range(end_b - 1, lo - 1, -1):  # descending, so that one line takes one place
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # the smallest end of a common subsequence of each length
    chain: list[tuple | None] = []
    for i in range(lo, end_a):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k] = j
                chain[k] = link
    link = chain[-1] if chain else None
    while link:
        shared.add(link[0])
        link = link[1]
    return shared


def main_text(lines: list[tuple[str, str, int]], siblings: list[list[int]] = ()) -> str:
    """The text of a page's lines; ``siblings``: line hashes of its nearest pages, nearest first."""
    own = line_hashes(lines)
    template: set[int] = set()
    for other in siblings:
        shared = common_lines(own, other)
        if len(shared) < len(own):
            template = shared
            break
    if any(kind == "article" for _, kind, _ in lines):
        # an article that its sibling shows too, line by line, is template (a teaser, a notice) if another is the page's own
        mine = {no for i, (_, kind, no) in enumerate(lines) if kind == "article" and i not in template}
        return " ".join(t for t, kind, no in lines if kind == "article" and (no in mine or not mine))
    return " ".join(t for i, (t, kind, _) in enumerate(lines) if kind == "other" and i not in template)


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def siblings(pages: DataFrame) -> DataFrame:
    """(key, near): for each page the line hashes of its neighbours by URL path
    within the host, the nearer first. ``pages``: key, page_id, host, path, lines."""
    fields = "key long, host string, path string, lines array<long>"

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        before = held = None  # the row before the held one, and the one whose next is not known yet
        for batch in batches:
            rows = []
            for row in batch[["key", "host", "path", "lines"]].itertuples(index=False, name=None):
                if held is not None:
                    rows.append(_with_near(held, before, row, part, before is None, False))
                before, held = held, row
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS)
        if held is not None:
            yield pd.DataFrame([_with_near(held, before, None, part, before is None, True)], columns=_COLUMNS)

    order = [F.col("host"), F.col("path"), F.col("page_id"), F.col("key")]
    ranged = pages.repartitionByRange(*order).sortWithinPartitions(*order)
    near = staged(ranged.mapInPandas(neighbours, fields + ", near array<struct<p: int, h: array<long>>>, part int, first boolean, last boolean"), "page-siblings")
    # At the edge of two ranges: the last row of one and the first of the next, two rows a range.
    edge = near.where("first or last").withColumn("kind", F.when(F.col("first"), 0).otherwise(1))
    w = Window.orderBy("part", "kind")
    row = F.struct("host", "path", "lines")
    edge = edge.withColumn("b", F.when(F.col("first"), F.lag(row).over(w))).withColumn("a", F.when(F.col("last"), F.lead(row).over(w)))
    same = lambda c: F.col(f"{c}.host") == F.col("host")

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                found = [(x["p"], 0, x["h"]) for x in (r.near if r.near is not None else [])]
                found += [(_shared_prefix(r.path, p), 1, h) for p, h in ((r.bp, r.bl), (r.ap, r.al)) if h is not None]
                found.sort(key=lambda x: (-x[0], x[1]))
                rows.append((r.key, [list(h) for _, _, h in found]))
            yield pd.DataFrame(rows, columns=["key", "near"])

    edge = edge.select("key", "path", "near", F.when(same("b"), F.col("b.path")).alias("bp"), F.when(same("b"), F.col("b.lines")).alias("bl"),
                       F.when(same("a"), F.col("a.path")).alias("ap"), F.when(same("a"), F.col("a.lines")).alias("al"))
    mended = edge.mapInPandas(mend, "key long, near array<array<long>>")
    return near.where("not first and not last").select("key", F.expr("transform(near, x -> x.h)").alias("near")).unionByName(mended)


_COLUMNS = ["key", "host", "path", "lines", "near", "part", "first", "last"]


def _with_near(row, before, after, part, first, last):
    key, host, path, lines = row
    found = [(_shared_prefix(path, r[2]), i, list(r[3])) for i, r in enumerate((before, after)) if r is not None and r[1] == host and host]
    found.sort(key=lambda x: (-x[0], x[1]))
    return key, host, path, list(lines), [{"p": p, "h": h} for p, _, h in found], part, first, last


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("key", F.xxhash64("page_id", "url", "html"))
    url = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", 2)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["key", "page_id", "host", "path"]].assign(lines=[line_hashes(lines_of(h)) for h in b["html"]])

    keyed = rows.select("key", F.coalesce("page_id", F.lit(-1)).alias("page_id"), F.lower(url).alias("host"), path.alias("path"), "html")
    keyed = staged(keyed.mapInPandas(hashed, "key long, page_id long, host string, path string, lines array<long>"), "page-lines")
    near = siblings(keyed.dropDuplicates(["key"]))

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(lines_of(h), [] if n is None else [list(x) for x in n]) for h, n in zip(b["html"], b["near"])]
            yield b[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts]).astype({"page_id": "Int64"})

    return rows.join(near, "key", "left").select("page_id", "url", "html", "near").mapInPandas(text, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark, sf_dir) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
