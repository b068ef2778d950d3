"""Main text of web pages by differencing each with its nearest page.

``page_lines`` reads a page into lines, one a block element, and tells from the
markup whether a line belongs to the article (inside an article or main
element), to the page's frame (menus, headers, footers, sidebars, notices,
adverts, forms, comments), or whether the markup doesn't say, or leaves it in
doubt: in an article, a class such as ``notice`` or ``banner-image``.  Each page is
read once.  ``shared_lines`` pairs every page with the page of the same host whose
URL path is nearest, aligns all their lines by longest common subsequence, and
marks those that both have: a template's lines, which are deleted.  Then the
markup is asked: a frame's line goes though the other page hasn't got it, and a
line that the markup places in the article without a doubt stays though the other
page has it, as articles do quote each other.  A page without another to compare
with is left to its markup (``text_lines``).

An article or main element in a wrapper that only a class word or a form makes a
frame is no frame's, but for sidebars, comments and adverts; a form around most of
a page's text is none either.

Pages of one host with the same lines are one in pairing, or they would delete
each other; all get what their one page gets.

Pairing sorts hosts, paths and line hashes, not pages, by range, so a host that
holds a third of all pages is dealt over many tasks.  Only pages with lines that
the markup doesn't settle meet the difference again.

Defined results: a null page counts as empty and gives an empty text, as does a
page without an article; a null URL is a host of its own kind and the empty
path; repeated rows are treated alike; a page alone on its host loses no
line; elements may be unclosed (``p``, list items, cells and rows end where HTML ends
them), nested to any depth and pages of any length; an empty table gives no rows.
Other columns aren't read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize

# HTML's elements by kind.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "template"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em",
    "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input",
}
FRAME = {
    "head", "nav", "footer", "aside", "button", "select", "noscript", "svg", "menu",
    "dialog", "object", "canvas", "audio", "video",
}
# Words of class, id and role that mark a frame's elements, and
# class names that mark the article's.
FRAME_WORDS = {
    "nav", "navigation", "navbar", "menu", "menubar", "breadcrumb", "breadcrumbs", "header",
    "masthead", "topbar", "footer", "contentinfo", "sidebar", "complementary", "aside", "notice",
    "notices", "alert", "cookie", "cookies", "consent", "gdpr", "banner", "ad", "ads", "advert",
    "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "form", "search", "login", "signup", "newsletter", "subscribe", "popup", "modal", "share",
    "social", "comment", "comments", "disqus", "replies", "respond",
}
ARTICLE_CLASSES = {
    "article", "article-body", "article-content", "article-text", "entry-content", "post-body",
    "post-content", "story-body", "articlebody", "main-content",
}
COMMENT_CLASSES = {"comment", "comments", "reply", "ad", "advert", "promo", "sponsored"}
# Frame words that hold for an article inside as well; those that
# in an article leave it in doubt; and words of a class name that undo the others.
STICKY_WORDS = {
    "sidebar", "complementary", "aside", "comment", "comments", "disqus", "replies", "respond", "ad",
    "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
}
DOUBTFUL_WORDS = {
    "notice", "notices", "alert", "banner", "search", "form", "login", "signup", "popup", "modal",
    "share", "social", "promotion", "masthead", "topbar", "subscribe",
}
UNDOING_WORDS = {"no", "not", "with", "without", "has", "layout"}
# Which open elements a start tag ends, up to which around them.
_BLOCKS = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul"
).split()
ENDS = {
    **{name: ({"p"}, {"button", "table", "td", "th", "li", "object"}) for name in _BLOCKS},
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[\s_\-]+")

# What the markup says of a line.  FORMED: it stands in a form.
ARTICLE, DOUBT, MAIN, UNKNOWN, FRAMED, FORMED = 3, 2, 1, 0, -1, -2
# How an element is a frame: by a form, a class word, one that holds for articles
# inside, or by its name.
OPEN, FORM, WEAK, STICKY, HARD = range(5)


def _kind(tag: str, attributes: str, around: int) -> tuple[int, int]:
    """How the element is a frame, and what it says of its lines."""
    inside = around > UNKNOWN
    if tag in FRAME or (tag == "header" and not inside):
        return HARD, UNKNOWN
    names = {k.lower(): v.strip("\"'").lower() for k, v in _NAMES.findall(attributes)}
    classes = set(names.get("class", "").split()) | set(names.get("id", "").split())
    if tag == "article":
        return STICKY if classes & COMMENT_CLASSES else OPEN, ARTICLE
    if tag == "main" or names.get("role") == "main":
        return OPEN, MAIN
    if tag in ("html", "body"):
        return OPEN, UNKNOWN
    if classes & ARTICLE_CLASSES or names.get("itemprop") == "articlebody":
        return OPEN, ARTICLE
    words = set()
    for name in (*classes, names.get("role", "")):
        parts = set(_WORD.split(name))
        if not parts & UNDOING_WORDS:
            words |= parts
    words &= FRAME_WORDS
    if inside:  # in an article, a header is its own
        words.discard("header")
    if words & STICKY_WORDS:
        return STICKY, UNKNOWN
    if inside and words:
        return (OPEN, DOUBT) if words <= DOUBTFUL_WORDS else (WEAK, UNKNOWN)
    if tag == "form":
        return FORM, UNKNOWN
    return WEAK if words else OPEN, UNKNOWN


def page_lines(page: str) -> tuple[list[str], list[int]]:
    """All lines of the page, and what the markup says of each."""
    lines: list[str] = []
    kinds: list[int] = []
    buffer: list[str] = []
    aside: list[str] = []  # the frame's text
    stack: list[tuple[str, int, int]] = []  # element, its frame, what holds around
    opened: dict[str, int] = defaultdict(int)
    level, around, aside_kind, at, end = OPEN, UNKNOWN, FRAMED, 0, len(page)

    def put(text: str) -> None:
        nonlocal aside_kind
        if level == OPEN:
            buffer.append(text)
        else:
            aside.append(text)
            aside_kind = FORMED if level == FORM else FRAMED

    def flush() -> None:
        for held, kind in ((buffer, around), (aside, aside_kind)):
            if held:
                line = " ".join("".join(held).split())
                if line:
                    lines.append(line)
                    kinds.append(kind)
                held.clear()

    def close(first: int) -> None:
        nonlocal level, around
        for name, _, _ in stack[first:]:
            opened[name] -= 1
        del stack[first:]
        level, around = stack[-1][1:] if stack else (OPEN, UNKNOWN)

    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            put(html.unescape(page[at:start]))
        if start == end:
            break
        found = _TAG.match(page, start) or _LOOSE.match(page, start)
        if found is None:
            put("<")
            at = start + 1
            continue
        at = found.end()
        name = found[2]
        if name is None:
            if page.startswith("<![CDATA[", start):
                put(page[start + 9 : at - 3])
            continue
        name = name.lower()
        if name not in INLINE and name not in RAW:
            if name == "br":
                put(" ")
            else:
                flush()
        if found[1]:
            if opened[name] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        flush() if name not in INLINE else None
                        close(i)
                        break
                    if name in INLINE and stack[i][0] not in INLINE:
                        break  # misnested: an inline end doesn't close blocks
            continue
        if name in ENDS and any(opened[e] > 0 for e in ENDS[name][0]):
            ended, bounds = ENDS[name]
            first = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ended:
                    first = i
                    if not any(opened[e] > (e == stack[i][0]) for e in ended):
                        break
                elif stack[i][0] in bounds or (ended == {"p"} and stack[i][0] not in INLINE):
                    break
            if first is not None:
                close(first)
        if name in RAW:
            found = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = found.end() if found else end
        elif name not in VOID and not found[3].endswith("/"):
            if level != HARD:
                frame, says = _kind(name, found[3], around)
                if level and says in (ARTICLE, MAIN) and frame == OPEN:
                    inner = name == "article" or name == "main" or says == MAIN
                    if inner and (level < STICKY or says == MAIN):
                        level = OPEN
                level = max(level, frame)
                around = DOUBT if DOUBT in (says, around) else max(around, says)
            opened[name] += 1
            stack.append((name, level, around))
    flush()
    # A form around most of the page's text is no frame.
    formed = sum(len(x) for x, k in zip(lines, kinds) if k == FORMED)
    other = sum(len(x) for x, k in zip(lines, kinds) if k >= UNKNOWN)
    return lines, [k if k != FORMED else UNKNOWN if formed > other else FRAMED for k in kinds]


def kept_lines(
    lines: Sequence[str], kinds: Sequence[int], alone: bool | None, shared: Sequence[int] | None
) -> list[int]:
    """Places of the lines that stay: the markup's alone if there is no other page, or else
    those that are neither the frame's nor, where it doesn't say, shared."""
    if alone:
        least = MAIN if max(kinds, default=UNKNOWN) > UNKNOWN else UNKNOWN
        return [i for i, k in enumerate(kinds) if k >= least]
    gone = {i for i in shared or () if kinds[i] in (UNKNOWN, DOUBT)}
    return [i for i, k in enumerate(kinds) if k != FRAMED and i not in gone]


def text_lines(page: str) -> tuple[list[str], list[int]]:
    """The lines that the markup alone keeps: the article's, or all but the frame's."""
    lines, kinds = page_lines(page)
    kept = kept_lines(lines, kinds, True, None)
    return [lines[i] for i in kept], [kinds[i] for i in kept]


def common_lines(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places = defaultdict(list)
    for j in range(len(b) - tail - 1, head - 1, -1):
        places[b[j]].append(j)
    # Longest increasing run of places, last places of a line first.
    ends: list[int] = []
    chain: list[tuple[int, object]] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    middle, node = [], chain[-1] if chain else None
    while node is not None:
        middle.append(node[0])
        node = node[1]
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def _line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line) - (1 << 63)


def shared_lines(pages: DataFrame, page_id: str, url: str, page: str) -> DataFrame:
    """``page_id, url, texts, kinds, alone, shared`` of every page.

    ``texts`` and ``kinds`` are ``page_lines``; ``shared`` holds places in them.
    ``alone``: no other page of the host.  Both are null on pages where they decide
    nothing: each line is the frame's, or the article's without a doubt.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [page_lines(value.as_py() or "") for value in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(3)],
                    pa.array([[*map(_line_hash, lines)] for lines, _ in read], pa.list_(pa.int64())),
                    pa.array([lines for lines, _ in read], pa.list_(pa.string())),
                    pa.array([kinds for _, kinds in read], pa.list_(pa.int8())),
                    pa.array([UNKNOWN in kinds or DOUBT in kinds for _, kinds in read], pa.bool_()),
                ],
                names=["page_id", "url", "path", "lines", "texts", "kinds", "open"],
            )

    address = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][\w+.\-]*://([^?#]*)", 1)
    address = F.when(address == "", F.coalesce(F.col(url), F.lit(""))).otherwise(address)
    kind = pages.schema[page_id].dataType.simpleString()
    same = ["host", "h1", "h2"]
    described = (
        pages.select(
            F.col(page_id).alias("page_id"),
            F.col(url).alias("url"),
            address.alias("path"),
            F.col(page).alias("page"),
        )
        .mapInArrow(
            hashed,
            f"page_id {kind}, url string, path string, lines array<bigint>, texts array<string>, "
            "kinds array<tinyint>, open boolean",
        )
        .withColumns({
            "host": F.substring_index("path", "/", 1),
            "h1": F.xxhash64("lines"),
            "h2": F.xxhash64(F.lit(1), "lines"),
        })
    )
    described = materialize(described)
    # Pages of the same lines are one, under their first path.
    key = ["host", "path", "h1", "h2"]
    ones = described.groupBy(*same).agg(
        F.min("path").alias("path"), F.any_value("lines").alias("lines")
    )
    ones = ones.repartitionByRange(*key).sortWithinPartitions(*key)
    ones = materialize(ones.withColumn("part", F.spark_partition_id()))

    # Neighbours in the order of host and path.  Each part's first and last row
    # have theirs in other parts: a row a part.
    row = F.struct("path", "lines")
    ends = ones.groupBy("part").agg(
        F.min_by(row, F.struct(*key)).alias("head"), F.max_by(row, F.struct(*key)).alias("tail")
    )
    parts = Window.orderBy("part")
    ends = ends.select(
        "part", F.lag("tail").over(parts).alias("before"), F.lead("head").over(parts).alias("after")
    )
    inside = Window.partitionBy("part").orderBy(*key)
    paired = (
        ones.withColumn("prior", F.lag(row).over(inside))
        .withColumn("next", F.lead(row).over(inside))
        .join(ends, "part")
        .select(
            *same,
            "path",
            "lines",
            F.coalesce("prior", "before").alias("prior"),
            F.coalesce("next", "after").alias("next"),
        )
    )

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone, shared = [], []
            for r in batch.select(["path", "lines", "prior", "next"]).to_pylist():
                near = nearest(r["path"], r["prior"], r["next"])
                alone.append(near is None)
                shared.append(common_lines(r["lines"], near["lines"]) if near else [])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(3)],
                    pa.array(alone, pa.bool_()),
                    pa.array(shared, pa.list_(pa.int32())),
                ],
                names=[*same, "alone", "shared"],
            )

    differed = materialize(
        paired.mapInArrow(differ, "host string, h1 bigint, h2 bigint, alone boolean, shared array<int>")
    )
    discard(ones)
    kept = ["page_id", "url", "texts", "kinds"]
    nothing = [F.lit(None).cast("boolean").alias("alone"), F.lit(None).cast("array<int>").alias("shared")]
    met = described.where("open").select(*same, *kept).join(differed, same)
    return met.select(*kept, "alone", "shared").unionByName(
        described.where("NOT open").select(*kept, *nothing)
    )


def nearest(path: str, prior: dict | None, following: dict | None) -> dict | None:
    """The neighbour of the same host with the longer common start of path; the prior on ties."""

    def common(other: dict | None) -> int:
        if other is None or other["path"].split("/", 1)[0] != path.split("/", 1)[0]:
            return -1
        a, b = path, other["path"]
        same = np.frombuffer(a.encode("utf-32-le"), "<u4")[: len(b)]
        rest = np.frombuffer(b.encode("utf-32-le"), "<u4")[: len(a)]
        differs = np.flatnonzero(same != rest)
        return int(differs[0]) if len(differs) else len(same)

    a, b = common(prior), common(following)
    return None if max(a, b) < 0 else prior if a >= b else following


def main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages``."""
    found = shared_lines(pages, page_id, url, page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for r in batch.select(["texts", "kinds", "alone", "shared"]).to_pylist():
                kept = kept_lines(r["texts"], r["kinds"], r["alone"], r["shared"])
                texts.append(" ".join(r["texts"][i] for i in kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    kind = pages.schema[page_id].dataType.simpleString()
    return found.mapInArrow(run, f"page_id {kind}, url string, text string")
