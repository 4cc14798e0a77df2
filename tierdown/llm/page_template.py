"""Main text of web pages, by deducing each site's template.

Pages of one host come out of one template with slots. A token of the template (an
opening tag with its path, or a text that is always the same) shows in the same numbers
on every page, so tokens are grouped by their occurrence vector, the counts over all
pages of the host. A group (an equivalence class) is valid if its tokens keep their
order; valid classes are nested in the gaps of others, and crossing ones are dropped.
Texts of the template are no content, within an article or main element too.

What is left are the slots, and the template tells them apart:

* a slot outside articles that is filled on most pages, from a few texts over and over
  (an advert, a slogan), is furniture;
* a site that puts most of its slot text in articles puts its content there, on pages
  with a short article too.

Names are the second signal. Elements that are never content (navigation, footers, heads
and the like, by element or role) are left out. Class words and forms are weak: such an
element is left out only if it holds less than half of the page's slot text, or if an
article or main element has text outside it. A main element stands for the page; articles
do where the site, or without a template the page itself, has at least half of its text in them.

A text that one page only holds, however many copies of it the site has, tells nothing
about a template and stays.

An occurrence vector is as long as the site, so only order-free sums of hashes are kept,
added up page by page; classes are then a grouping by these. Sites of fewer than
``LEAST_PAGES`` pages have no template: two pages that share a paragraph would lose it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierdown.operators.joins import skew_safe_join
from tierdown.operators.scans import written
from tierdown.scratch import scratch_dir

LEAST_PAGES = 10
SUPPORT = 0.8
LEAST_TOKENS = 3
#: Distinct texts among those of a slot, at most, for it to be furniture.
REPEATED = 0.25

# fixed values: element names
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
_ENDS_PARAGRAPH = _BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
_ASIDE = frozenset("head title nav footer aside menu dialog button select label".split())
_WEAK = frozenset(("form", "fieldset"))
_ARTICLE, _MAIN = 1, 2
_CONTENT = {"article": _ARTICLE, "main": _MAIN}
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments reply replies "
    "disqus pagination pager widget toolbar skip".split()
)
# nothing here looks past the next "<" for an end that may not come, so a page is read once
_PARTS = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z](?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+>|</?[a-zA-Z][^<>]*+>", re.DOTALL
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""\shidden(?:[\s=/>]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Token:
    """An opening tag (``text`` is None) or a block of text. ``path`` is a hash of the
    elements it stands in, ``weak`` the innermost of them that a class word or a form
    labels (a number into ``Page.weak``, -1 if there is none)."""

    path: int
    text: str | None
    aside: bool
    weak: int
    content: int

    def key(self) -> int:
        return _hash(f"{self.path}\0{self.text}") if self.text is not None else self.path


@dataclass
class Page:
    """Tokens in order; of each weakly labelled element the one around it."""

    tokens: list[Token]
    weak: list[int]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _labels(tag: str) -> tuple[str, bool, bool]:
    """Class names as written, whether they hold a word for what is no content, and whether
    a role says so or the element is hidden."""
    if "=" not in tag and "hidden" not in tag:
        return "", False, False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(tag)}
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    aside = found.get("role", "").lower() in _ROLES or bool(_HIDDEN.search(tag))
    return found.get("class", ""), bool(_WORDS.intersection(_SPLIT.split(named))), aside


@dataclass
class _Open:
    """An element that is open."""

    name: str
    path: int
    aside: bool
    weak: int
    content: int


class _Stack:
    """Open elements. Which names are open, and where the innermost block is, is kept at
    hand, so that closing tags without an opening one cost nothing."""

    def __init__(self) -> None:
        self.elements = [_Open("", 0, False, -1, 0)]
        self.blocks: list[int] = [0]
        self.open_blocks: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]  # inline names since each block

    def top(self) -> _Open:
        return self.elements[-1]

    def block(self) -> str:
        return self.elements[self.blocks[-1]].name

    def push(self, element: _Open) -> None:
        if element.name in _BLOCKS:
            self.blocks.append(len(self.elements))
            self.open_blocks[element.name] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][element.name] += 1
        self.elements.append(element)

    def pop(self) -> str:
        name = self.elements.pop().name
        if name in _BLOCKS:
            self.blocks.pop()
            self.inline.pop()
            self.open_blocks[name] -= 1
        else:
            self.inline[-1][name] -= 1
        return name

    def is_open(self, name: str) -> bool:
        return self.open_blocks[name] > 0 if name in _BLOCKS else self.inline[-1][name] > 0


def parsed(page: str) -> Page:
    """The page in order: an opening tag each, and its texts block by block with white
    space made one space. Anything a browser would read is read; nothing raises, and the
    time grows with the length of the page."""
    out = Page([], [])
    stack = _Stack()
    text: list[str] = []

    def close_block() -> None:
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if whole:
                here = stack.top()
                out.tokens.append(Token(here.path, whole, here.aside, here.weak, here.content))

    def leave(name: str) -> None:
        close_block()
        while stack.pop() != name:
            pass

    at, skip = 0, None
    while at < len(page):
        found = (skip or _PARTS).search(page, at)
        if skip is not None:  # raw elements end at their own closing tag only
            at = found.end() if found else len(page)
            skip = None
            continue
        begin = found.start() if found else len(page)
        if begin > at:
            text.append(page[at:begin])
        if not found:
            break
        at, tag = found.end(), found[0]
        if tag[1] in "!?":
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if stack.is_open(name):
                if name in _BLOCKS or stack.top().name != name:
                    leave(name)
                else:
                    stack.pop()
            elif name in _BLOCKS:
                close_block()
            continue
        if name in _RAW:
            text.append(" ")
            if not tag.endswith("/>"):
                skip = re.compile(rf"</{name}\s*>", re.IGNORECASE)
            continue
        if name == "br" or name == "wbr":
            text.append(" " * (name == "br"))
            continue
        if name in _BLOCKS:
            close_block()
            if name in _ENDS_PARAGRAPH and stack.block() == "p":
                leave("p")
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack.block() == name:
            leave(name)
        classes, word, hidden = _labels(tag)
        around = stack.top()
        path = _hash(f"{around.path}/{name}.{classes}")
        content = max(around.content, _CONTENT.get(name, 0))
        aside = around.aside or hidden or name in _ASIDE or (name == "header" and not content)
        weak = around.weak
        if name in _WEAK or word and name not in ("html", "body"):
            out.weak.append(weak)
            weak = len(out.weak) - 1
        if name in _BLOCKS:
            out.tokens.append(Token(path, None, aside, weak, content))
        if name not in _VOID and not tag.endswith("/>"):
            stack.push(_Open(name, path, aside, weak, content))
    close_block()
    return out


def tokens(page: str) -> list[Token]:
    return parsed(page).tokens


_OCCURRENCE = "host string, page long, token long, path long, times long, place double, is_text boolean, content boolean, chars long"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and token: count, place and, of texts, the length. Texts of elements
    that are never content count nothing."""
    names = [column.split()[0] for column in _OCCURRENCE.split(", ")]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64())
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = [(t.key(), t) for t in tokens(page)]
            counts, first = Counter(key for key, _ in found), {}
            for place, (key, token) in enumerate(found):
                first.setdefault(key, (place / len(found), token))
            number = _hash(page)
            for key, times in counts.items():
                place, token = first[key]
                chars = 0 if token.text is None or token.aside else len(token.text) * times
                rows.append((host, number, key, token.path, times, place, token.text is not None, token.content > 0, chars))
        columns = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def nested(classes: list[tuple[int, list[tuple[float, int]]]]) -> list[list[int]]:
    """Classes as tokens in template order, with those left out that cross another.

    A class fits if each other class lies wholly before, behind, around or within one
    gap of it; of two that cross, the one on more pages stays.
    """
    kept: list[list[tuple[float, int]]] = []
    for _, found in sorted(classes, key=lambda c: (-c[0], -len(c[1]))):
        found = sorted(found)
        if all(_apart(found, other) or _apart(other, found) for other in kept):
            kept.append(found)
    return [[token for _, token in found] for found in sorted(kept)]


def _apart(inner: list[tuple[float, int]], outer: list[tuple[float, int]]) -> bool:
    """Whether ``inner`` lies in one gap of ``outer`` (before, between two tokens, behind)."""
    first, last = inner[0][0], inner[-1][0]
    return not any(first < place < last for place, _ in outer)


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, support: float = SUPPORT) -> DataFrame:
    """``host, classes, furniture, in_articles`` of each host with at least ``least_pages``
    pages: lists of token keys in template order (``array<array<long>>``), paths of slots
    that are filled from a few texts, and whether most slot text is in articles. ``pages``
    has ``host, html``."""
    numbered = pages.where(F.col("host").isNotNull()).select("host", "html")
    code = F.xxhash64("page", "times")
    low = F.lit(0x7FFFFFFF).cast("long")
    tallied = numbered.mapInArrow(_occurrences, _OCCURRENCE).groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("times").alias("times"),
        # the occurrence vector: sums of its hashes, which do not depend on order, and in
        # which copies of a page add up instead of cancelling out
        F.struct(F.sum(code.bitwiseAND(low)).alias("low"), F.sum(F.shiftrightunsigned(code, 33)).alias("high")).alias("vector"),
        F.avg("place").alias("place"),
        F.first("is_text").alias("is_text"),
        (F.min("page") < F.max("page")).alias("on_several"),
        F.first("path").alias("path"),
        F.first("content").alias("content"),
        F.sum("chars").alias("chars"),
    )
    tallied = written(tallied, "tokens")  # the three parts of a template are taken from it
    totals = written(numbered.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages")).where(F.col("all_pages") >= least_pages), "hosts")
    framed = tallied.where((F.col("pages") >= least_pages) & (~F.col("is_text") | F.col("on_several")))
    # a hot host has tokens without end before the support is asked for
    usual = skew_safe_join(framed, totals, "host").where(F.col("pages") >= F.lit(support) * F.col("all_pages"))
    # what is left of a host is at most 1 / support times the tokens of a page
    classes = usual.groupBy("host").applyInArrow(_template, "host string, classes array<array<bigint>>")
    slots = tallied.where("is_text and not content").groupBy("host", "path").agg(F.count(F.lit(1)).alias("texts"), F.sum("pages").alias("filled"))
    furniture = (
        slots.join(totals, "host")
        .where((F.col("filled") >= F.lit(support) * F.col("all_pages")) & (F.col("texts") <= F.lit(REPEATED) * F.col("filled")))
        .groupBy("host")
        .agg(F.collect_list("path").alias("furniture"))
    )
    inside = F.coalesce(F.sum(F.when(F.col("content"), F.col("chars"))), F.lit(0))
    # texts on all pages are no slots; summed up by the number of pages before hosts meet
    by_pages = tallied.where("is_text").groupBy("host", "pages", "on_several").agg(inside.alias("inside"), F.sum("chars").alias("chars"))
    articles = (
        by_pages.join(totals, "host")
        .where("pages < all_pages or not on_several")
        .groupBy("host")
        .agg((F.sum("inside") * 2 >= F.sum("chars")).alias("in_articles"))
    )
    found = totals.select("host").join(classes, "host", "left").join(furniture, "host", "left").join(articles, "host", "left")
    return found.select("host", F.coalesce("classes", F.array()).alias("classes"), F.coalesce("furniture", F.array()).alias("furniture"), F.coalesce("in_articles", F.lit(False)).alias("in_articles"))


def _template(table: pa.Table) -> pa.Table:
    groups: dict[tuple, list] = {}
    for row in table.to_pylist():
        groups.setdefault((*row["vector"].values(), row["pages"], row["times"]), []).append(row)
    classes = [
        (key[1], [(r["place"], r["token"]) for r in rows])
        for key, rows in groups.items()
        # a lone text is no frame: it takes tags that come and go with it
        if len(rows) >= LEAST_TOKENS and not all(r["is_text"] for r in rows)
    ]
    host = table.column("host")[0].as_py()
    return pa.table(
        [pa.array([host], pa.string()), pa.array([nested(classes)], pa.list_(pa.list_(pa.int64())))], names=["host", "classes"]
    )


def template_texts(found: list[Token], classes: list[list[int]]) -> set[int]:
    """Positions of texts that belong to the template. A class counts on this page if its
    tokens stand here in its order and in equal numbers; if the texts in the article are
    what breaks the order, the others count without them."""
    places: dict[int, list[int]] = {}
    for place, token in enumerate(found):
        places.setdefault(token.key(), []).append(place)
    constant: set[int] = set()
    for tokens_ in classes:
        here = [places.get(token, []) for token in tokens_]
        if len({len(p) for p in here}) != 1 or not here[0]:
            continue
        frame = [p for p in here if found[p[0]].text is None or not found[p[0]].content]
        for part in (here, frame):
            walk = [p for turn in zip(*part) for p in turn]
            if walk == sorted(walk):
                constant.update(p for p in walk if found[p].text is not None)
                break
    return constant


def _dropped(page: Page, slots: list[Token]) -> list[bool]:
    """Of each weakly labelled element whether it is left out."""
    held = [[0, 0] for _ in page.weak]  # characters, and those in articles
    whole = [0, 0]
    for token in slots:
        size = (len(token.text), len(token.text) if token.content else 0)
        for sums in (whole, *([held[token.weak]] if token.weak >= 0 else [])):
            sums[0] += size[0]
            sums[1] += size[1]
    for n in range(len(held) - 1, -1, -1):  # an element comes after the one around it
        if page.weak[n] >= 0:
            for k in (0, 1):
                held[page.weak[n]][k] += held[n][k]
    out: list[bool] = []
    for n, (chars, in_articles) in enumerate(held):
        most = 2 * chars > whole[0] and in_articles == whole[1]
        out.append(not most or (page.weak[n] >= 0 and out[page.weak[n]]))
    return out


def main_text(
    page: str, classes: list[list[int]] | None = None, furniture: list[int] | None = None, in_articles: bool | None = None
) -> str:
    """The slots that are content, joined by two line feeds. Without a template the page
    itself says whether its text is in articles."""
    read = parsed(page)
    found = read.tokens
    constant = template_texts(found, classes) if classes else set()
    repeated = set(furniture or ())
    slots = [
        t for p, t in enumerate(found)
        if t.text is not None and not t.aside and p not in constant and (t.content or t.path not in repeated)
    ]
    dropped = _dropped(read, slots)
    slots = [t for t in slots if t.weak < 0 or not dropped[t.weak]]
    main = [t for t in slots if t.content == _MAIN]
    inside = [t for t in slots if t.content]
    if main:
        slots = main
    elif inside and (in_articles or 2 * sum(len(t.text) for t in inside) >= sum(len(t.text) for t in slots)):
        slots = inside
    return "\n\n".join(t.text for t in slots)


def page_texts(pages: DataFrame, least_pages: int = LEAST_PAGES, support: float = SUPPORT) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars`` (code points).

    A null or empty html has an empty text; a null or odd ``url`` has no host and so no
    template. Repeated rows are rows of their own. Other columns are ignored. Time and
    memory grow with the length of a page, however it is written.
    """
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    hosted = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.when(host != "", host).alias("host"), F.coalesce("html", F.lit("")).alias("html")
    )
    # written first, so that Spark knows the size: few templates are broadcast, many are
    # joined by host, where adaptive execution splits a hot host
    at = scratch_dir(spark, "templates")
    site_templates(hosted, least_pages, support).write.parquet(at)
    templates = spark.read.parquet(at)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(*row) for row in zip(*[batch.column(n).to_pylist() for n in (2, 3, 4, 5)])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    joined = hosted.join(templates, "host", "left").select("page_id", "url", "html", "classes", "furniture", "in_articles")
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
