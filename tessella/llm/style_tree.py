"""HTML extraction by a site style tree.

The pages of a host are merged into one tree of style paths (tags with their classes).
Each path has the number m of pages that show it and two entropies in base m:

* presentation: over the shapes that it takes on pages, a shape being the runs of child
  styles and the size class of the text right below each of its nodes;
* content: a text block is lower-cased, its digits are masked, and it counts as three
  features, the whole block and its first and last three words. The mean entropy of a
  path's features over pages, taken from 1, times the share of its characters outside
  links, is its content importance: a text on all pages and a list of links count 0, a
  text on a single page 1.

A path's own text has the importance content * (1 + presentation) / 2; composite
importance is (1 - g) * presentation + g * the mean of own text and of the paths below,
with g = 0.9 ** (paths below). Few pages say little, so composite importance is drawn
towards one half as by PRIOR more pages; a single page gives one half.

A branch is removed from the pages of its host if it and all branches below it have an
importance under LOW, inside articles as well. A tag, class, id or role that names a
branch as a menu, header, footer, sidebar, notice, advert, form, script, style or reader
comment scales the importance of the branch by NAMED, which decides where entropy can't
tell, as with adverts that differ from page to page. Importance never empties a page:
if no text is left, all that isn't named so stays.

Character references are decoded, white space (a br too) becomes one space, blocks are
trimmed and joined by one line feed. Null, empty and text-only html give the empty text
or their text. Pages whose url is null or has no host belong to no site; there names
alone decide. Repeated rows each get their row and count as pages of their own. Broken
markup is read as far as it goes, in linear time: once a tag's quotes don't close before
the end, quotes no longer count, and once no tag closes, the rest is text.

The tree is summed from digests with map-side aggregation, so a host with a third of all
pages needs no task of its own; a task holds one host's distinct style paths. Only the
removed paths go back to the pages.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import only, stage

#: Composite importance under which a branch goes, what a noise name scales it by, and the pages' worth of doubt.
LOW, NAMED, PRIOR, DECAY = 0.2, 0.2, 2.0, 0.9
#: Removed paths are broadcast up to this number, joined by host beyond it.
BROADCAST_PATHS = 100_000

# Tags of HTML and the words by which pages name what isn't an article.
NOISE_TAGS = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "textarea", "menu", "dialog", "head", "title", "object", "canvas"}
NOISE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "related", "share", "sidebar", "social", "sponsored", "subscribe", "widget"}
BLOCK_TAGS = {"address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW_TAGS = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HOST = r"^[a-zA-Z][\w+.-]*://([^/?#]*)"
_DIGITS = re.compile(r"\d+")


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


class Node:
    """An element of a page: its style path, whether it or what holds it is named as noise, and whether its path is removed."""

    __slots__ = ("tag", "path", "depth", "parent", "named", "removed", "children", "blocks", "inner")

    def __init__(self, tag: str, path: int, depth: int, parent: int, named: bool, removed: bool):
        self.tag, self.path, self.depth, self.parent, self.named, self.removed = tag, path, depth, parent, named, removed
        self.children: list[str] = []
        #: text blocks with their characters inside links
        self.blocks: list[tuple[str, int]] = []
        self.inner = 0

    def shape(self) -> str:
        """Runs of child styles and the size class of own text."""
        runs: list[list] = []
        for style in self.children:
            if runs and runs[-1][0] == style:
                runs[-1][1] += 1
            else:
                runs.append([style, 1])
        words = sum(text.count(" ") + 1 for text, _ in self.blocks)
        return " ".join(f"{style}*{n}" for style, n in runs) + f"|{words.bit_length()}"


def read_page(page: str | None, removed: frozenset[int] | set[int] = frozenset(), names: bool = True) -> tuple[list[Node], list[tuple[str, Node]]]:
    """The page's nodes and its text blocks in order, each with its node; those of named nodes are left out."""
    page = page or ""
    root = Node("", 0, 0, -1, False, False)
    stack, nodes = [root], [root]
    blocks: list[tuple[str, Node]] = []
    pieces: list[str] = []
    open_tags: Counter = Counter()
    link, linked = 0, 0  # the depth of the stack where a link began, characters inside links
    quotes = True

    def say(text: str) -> None:
        nonlocal linked
        if not stack[-1].named:
            text = references.unescape(text)
            pieces.append(text)
            if link:
                linked += len(text)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                blocks.append((text, stack[-1]))
                stack[-1].blocks.append((text, min(linked, len(text))))
        linked = 0

    def cut(upto: int) -> None:
        nonlocal link
        for node in stack[upto:]:
            open_tags[node.tag] -= 1
        del stack[upto:]
        if link > len(stack):
            link = 0

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        if begin > at:
            say(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            continue
        token = (_TAG if quotes else _PLAIN).match(page, begin)
        if not token:
            first = page[begin + 1 : begin + 2]
            closing = first == "/" and page[begin + 2 : begin + 3]
            name = closing or first
            if name and name.isascii() and name.isalpha():
                end = page.find(">", begin)
                if end < 0:
                    say(page[begin:])
                    break
                quotes = False
                token = _PLAIN.match(page, begin)
            elif first and first in "!?/":
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else size
                continue
            else:
                say("<")
                at = begin + 1
                continue
        at = token.end()
        tag = token[2].lower()
        block = tag in BLOCK_TAGS
        top = stack[-1]
        if token[1]:
            if tag == "a":
                link = 0
            if block or tag in NOISE_TAGS:
                if open_tags[tag] > 0:
                    place = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                    flush()
                    cut(place)
                elif block:
                    flush()
            elif top.tag == tag:
                if top.inner:
                    top.inner -= 1
                else:
                    flush()
                    cut(len(stack) - 1)
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in VOID_TAGS and tag != "hr":
            continue
        words = {w for _, v in _ATTRIBUTE.findall(token[3]) for w in re.split(r"[\s_-]+", v.strip("\"'").lower())} if token[3] else set()
        noise = names and (tag in NOISE_TAGS or not words.isdisjoint(NOISE_NAMES))
        if block or noise and not top.named:
            flush()
        if block:
            # a paragraph ends where a block begins, an item where the next begins
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag == tag in ("li", "dd", "dt", "tr", "td", "th"):
                    cut(i)
                    break
                if stack[i].tag in BLOCK_TAGS:
                    break
            top = stack[-1]
        if tag in RAW_TAGS:
            shut = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            end = page.find(">", shut.start()) if shut else -1
            at = end + 1 if end >= 0 else size
            continue
        if tag == "a":
            link = len(stack)
        if tag == "hr" or not block and (top.named or not noise):
            if top.tag == tag and not block:
                top.inner += 1
            continue
        style = tag + "".join("." + n for n in sorted(words) if n.isalpha())
        top.children.append(style)
        path = _digest(f"{top.path}>{style}")
        node = Node(tag, path, top.depth + 1, top.path, top.named or noise, top.removed or path in removed)
        open_tags[tag] += 1
        stack.append(node)
        nodes.append(node)
    flush()
    return nodes, blocks


def page_text(page: str | None, removed: frozenset[int] | set[int] = frozenset()) -> str:
    """What is left of a page without removed paths; if that is nothing, all that isn't named as noise."""
    _, blocks = read_page(page, removed)
    return "\n".join([text for text, node in blocks if not node.removed] or [text for text, _ in blocks])


def features_of(text: str) -> list[int]:
    """A block's three features."""
    words = _DIGITS.sub("0", text.lower()).split()
    return [_digest(" ".join(words)), _digest("< " + " ".join(words[:3])), _digest("> " + " ".join(words[-3:]))]


#: What a row of the tree's counts is about.
_SHAPE, _FEATURE, _LINKS = 0, 1, 2


def _styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages: Counter = Counter()
        times: Counter = Counter()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            shapes: dict[tuple, list[str]] = {}
            found: Counter = Counter()
            for node in read_page(page.as_py())[0]:
                place = (host, node.path, node.parent, node.depth, node.named)
                shapes.setdefault(place, []).append(node.shape())
                for text, linked in node.blocks:
                    found.update((*place, _FEATURE, f) for f in features_of(text))
                    pages[*place, _LINKS, 0] += len(text)
                    times[*place, _LINKS, 0] += linked
            pages.update((*place, _SHAPE, _digest("/".join(own))) for place, own in shapes.items())
            pages.update(found.keys())
            times.update(found)
        columns = list(zip(*pages)) or [[]] * 7
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64())
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(pages.values()), pa.int64()), pa.array([times[k] for k in pages], pa.int64())], names=["host", "path", "parent", "depth", "named", "about", "digest", "pages", "times"])


def composite(rows: pd.DataFrame) -> pd.DataFrame:
    """Importance of one host's paths, from the leaves up; ``best`` is the largest of a path and all below it."""
    below: dict[int, list[int]] = {}
    for path, parent in zip(rows["path"].tolist(), rows["parent"].tolist()):
        below.setdefault(parent, []).append(path)
    found: dict[int, float] = {}
    scaled: dict[int, float] = {}
    best: dict[int, float] = {}
    ordered = rows.sort_values(["depth", "path"], ascending=False)
    for r in ordered.itertuples():
        under = [p for p in below.get(r.path, ()) if p in found]
        parts = [found[p] for p in sorted(under)]
        if r.chars:
            parts.append(r.content * (1 + r.presentation) / 2)
        g = DECAY ** len(under)
        found[r.path] = (1 - g) * r.presentation + g * sum(parts) / len(parts) if parts else r.presentation
        drawn = (found[r.path] * (r.m - 1) + 0.5 * PRIOR) / (r.m - 1 + PRIOR)
        scaled[r.path] = drawn * (NAMED if r.named else 1.0)
        best[r.path] = max([scaled[r.path], *(best[p] for p in under)])
    paths = ordered["path"].tolist()
    return pd.DataFrame({"host": rows["host"].iloc[0], "path": paths, "parent": ordered["parent"].tolist(), "named": ordered["named"].tolist(), "m": ordered["m"].astype("int64").tolist(), "importance": [scaled[p] for p in paths], "best": [best[p] for p in paths]})


def _with_host(pages: DataFrame, *names: str) -> DataFrame:
    return only(pages, *names).withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))


def path_sums(pages: DataFrame) -> DataFrame:
    """Rows (host, path, parent, depth, named, m, presentation, content, chars) of the merged trees."""
    sited = _with_host(pages, "url", "html").filter("host <> ''").select("host", "html")
    place = "host string, path long, parent long, depth int, named boolean"
    keys = ["host", "path", "parent", "depth", "named"]
    counts = sited.mapInArrow(_styles, f"{place}, about int, digest long, pages long, times long")
    counts = counts.groupBy(*keys, "about", "digest").agg(F.sum("pages").alias("pages"), F.sum("times").alias("times"))

    def total(about: int, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("about") == about, value)), F.lit(0)).cast("double")

    seen = F.col("pages").cast("double")
    sums = counts.groupBy(*keys).agg(
        total(_SHAPE, seen).alias("m"),
        total(_SHAPE, seen * F.ln(seen)).alias("shown"),
        total(_FEATURE, F.col("times")).alias("features"),
        total(_FEATURE, F.col("times") * F.ln(seen)).alias("spread"),
        total(_LINKS, seen).alias("chars"),
        total(_LINKS, F.col("times")).alias("linked"),
    )
    many = F.col("m") > 1
    outside = F.when(F.col("chars") > 0, 1 - F.col("linked") / F.col("chars")).otherwise(1.0)
    presentation = F.when(many, 1 - F.col("shown") / F.col("m") / F.ln("m")).otherwise(1.0)
    # a path that a page shows often can have a feature on all of m pages at most
    content = F.when(many & (F.col("features") > 0), 1 - F.col("spread") / F.col("features") / F.ln("m")).otherwise(1.0) * outside
    return sums.select(*keys, "m", presentation.alias("presentation"), content.alias("content"), "chars")


def style_tree(pages: DataFrame) -> DataFrame:
    """Rows (host, path, parent, named, m, importance, best): the merged trees of all hosts."""
    kinds = "host string, path long, parent long, named boolean, m long, importance double, best double"
    return path_sums(pages).groupBy("host").applyInPandas(composite, kinds)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [page_text(page.as_py(), frozenset(removed.as_py() or ())) for page, removed in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars): the main text of every page."""
    # named branches are known by their names on the page itself
    low, _ = stage(style_tree(pages).filter((F.col("best") < LOW) & ~F.col("named") & (F.col("path") != 0)).select("host", "path"), "low-branches")
    n_low = low.count()
    # a stored table, so that adaptive execution can split the pages of a host with very many
    hosts, _ = stage(low.groupBy("host").agg(F.collect_set("path").alias("removed")), "low-hosts")
    joined = _with_host(pages, "page_id", "url", "html").join(F.broadcast(hosts) if n_low <= BROADCAST_PATHS else hosts, "host", "left")
    return joined.select("page_id", "url", "html", "removed").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
