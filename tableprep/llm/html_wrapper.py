"""HTML extraction by union-free regular-expression inference.

Pages of one host mostly come from one template. From a bounded sample of a host's pages a wrapper is inferred: the
token streams of the pages are aligned one after another, and every mismatch is resolved into an optional group, a
repeated group, or, between texts, a slot. The wrapper shows which element holds most of the text that is not links,
navigation, advertising and the like; the path to that element is the host's rule, applied to all of its pages.
"""

from __future__ import annotations

import html
import json
import re
import sys
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.session import materialize

SAMPLE_PAGES = 12  # pages a wrapper is inferred from
SALTS = 64
NO_ID = -(1 << 63)
LONGEST_PERIOD = 4  # elements in a repeated group

# How HTML elements behave, and words that classes and ids of page furniture go by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select button canvas audio video".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 td pre blockquote".split())
FURNITURE = frozenset("head nav footer aside form dialog menu".split())
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer header masthead ad ads advert advertisement advertising adverts sponsor sponsored promo "
    "promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "search share sharing social related recommended breadcrumb breadcrumbs pagination pager widget comment comments reply replies "
    "respond disqus toolbar skip copyright".split()
)
# Parts of a class that tell about the layout around an element, as in with-sidebar or no-comments.
LAYOUT_WORDS = frozenset("with without no not has have is fixed".split())
CONTENT_WORDS = frozenset("article content main post entry story body text".split())
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
SCOPES = frozenset("table ul ol dl div section article main body html blockquote".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")


class Element:
    """A page element: key (tag with its first class or id), and children, which are elements or texts."""

    __slots__ = ("tag", "key", "furniture", "sure", "content", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.key, self.children = tag, tag, []
        found = {a.lower(): (x or y or z).lower() for a, x, y, z in _ATTRIBUTE.findall(attributes)} if attributes else {}
        names = [set(_PARTS.findall(token)) for token in " ".join(found.values()).split()]
        words = set().union(*names)
        name = (found.get("class") or found.get("id") or "").split()
        if name:
            self.key = f"{tag}.{re.sub('[0-9]+', '', name[0])}"
        self.content = tag in ("article", "main") or (tag in ("div", "section", "td") and bool(words & CONTENT_WORDS))
        told = () if tag in ("html", "body", "article", "main") else [x for x in names if x & FURNITURE_WORDS and not x & LAYOUT_WORDS]
        self.furniture = tag in FURNITURE or bool(told)
        # Forms and names like content-sidebar may also wrap the page.
        self.sure = (tag in FURNITURE and tag != "form") or any(x <= FURNITURE_WORDS for x in told)


def parse(page: str) -> Element:
    """The elements of a page as a browser would roughly see them; anything goes in, comments and raw elements stay out."""
    root = _elements(page)
    _spare_wrappers(root)
    return root


def _spare_wrappers(root: Element) -> None:
    """Elements named as furniture that wrap the article are none.

    Such an element holds the page's main element, or its only articles while nothing outside is named as content, or,
    where its name is not furniture throughout, most of the words outside links and no less of what is named as content.
    """
    order, todo = [], [(root, -1, False)]
    while todo:
        element, parent, link = todo.pop()
        link = link or element.tag == "a"
        own = 0 if link else sum(len("".join(c.split())) for c in element.children if isinstance(c, str))
        named = element.content and (not element.furniture or element.tag in ("article", "main"))
        order.append([element, parent, own, int(named), int(element.tag == "main"), int(element.tag == "article")])
        here = len(order) - 1
        todo.extend((c, here, link) for c in element.children if isinstance(c, Element))
    for row in reversed(order):
        if row[1] >= 0:
            for k in range(2, 6):
                order[row[1]][k] += row[k]
    _, _, words, named, _, _ = order[0]
    for element, _, own, inside, mains, articles in order:
        if element.furniture and element.tag != "head":
            alone = inside == named
            wraps = mains or (articles and alone) or (not element.sure and 2 * own > words and (inside or alone))
            element.furniture = not wraps


def _elements(page: str) -> Element:
    root = Element("#root")
    stack, at, n = [root], 0, len(page)
    opened = {"#root": 1}
    while at < n:
        token = _TOKEN.match(page, at)
        if token is None:  # a tag that never ends is text
            stack[-1].children.append(page[at])
            at += 1
            continue
        at = token.end()
        closing, tag, attributes, text = token.groups()
        if text is not None:
            stack[-1].children.append(text)
        elif tag is None:
            continue
        elif closing:
            tag = tag.lower()
            if opened.get(tag):
                while True:
                    last = stack.pop()
                    opened[last.tag] -= 1
                    if last.tag == tag:
                        break
        else:
            tag = tag.lower()
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
                at = end.end() if end else (n if tag in ("script", "style") else at)
                continue
            if tag in VOID:
                stack[-1].children.append(Element(tag))
                continue
            ends = CLOSES.get(tag) or (() if tag in INLINE else ("p",))
            depth = len(stack) - 1 if any(opened.get(t) for t in ends) else 0
            while depth > 0 and stack[depth].tag not in SCOPES and stack[depth].tag not in ends:
                depth -= 1
            if depth > 0 and stack[depth].tag in ends:
                for gone in stack[depth:]:
                    opened[gone.tag] -= 1
                del stack[depth:]
            if not attributes.rstrip().endswith("/"):
                element = Element(tag, attributes)
                stack[-1].children.append(element)
                stack.append(element)
                opened[tag] = opened.get(tag, 0) + 1
    return root


def skeleton(page: str) -> str:
    """A page's token stream without its words: elements, their ends (0), and length and checksum of each text.

    The stream is flat, so that no depth of nesting is too much.
    """
    out: list = []
    todo: list = list(reversed(parse(page).children))
    while todo:
        node = todo.pop()
        if node == 0:
            out.append(0)
        elif isinstance(node, Element):
            out.append([node.key, int(node.furniture) + 2 * int(node.content)])
            todo.append(0)
            todo.extend(reversed(node.children))
        else:
            words = " ".join(node.split())
            if words:
                out.append([len(words), zlib.crc32(words.encode())])
    return json.dumps(out, separators=(",", ":"))


class Item:
    """A place of a wrapper: an element, a text slot (key `#`) or a group, perhaps optional, perhaps repeated."""

    __slots__ = ("key", "kind", "items", "constant", "optional", "repeated", "chars", "links")

    def __init__(self, key: str, kind: int = 0, items: list[Item] | None = None, constant: int | None = None, chars: int = 0, links: int = 0):
        self.key, self.kind, self.items, self.constant = key, kind, items or [], constant
        self.optional, self.repeated, self.chars, self.links = False, False, chars, links

    def is_block(self) -> bool:
        """Whether it is a block of text, or one of several alike, rather than what holds them."""
        tag = self.key.split(".")[0]
        return tag in INLINE or tag in BLOCKS or self.repeated

    def text(self) -> str:
        """The regular expression that this item stands for."""
        out: list[str] = []
        todo: list[Item | str] = [self]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            suffix = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[int(item.optional), int(item.repeated)]
            group = item.key.startswith("(")
            begin, end = ("(", f"){suffix}") if suffix or group else ("", "")
            if item.key == "#":
                out.append(begin + ("#" if item.constant is None else f"'{item.constant:08x}'") + end)
                continue
            if not group:
                begin, end = f"{begin}<{item.key}>", f"</>{end}"
            out.append(begin)
            todo.append(end)
            for k, inner in enumerate(reversed(item.items)):
                todo.extend((" ", inner) if k else (inner,))
        return "".join(out)


@contextmanager
def _any_depth() -> Iterator[None]:
    """Lets calls nest as deep as pages do. Frames of Python functions are on the heap, so the limit guards nothing here."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1 << 30))
    try:
        yield
    finally:
        sys.setrecursionlimit(limit)


def _items(told: list) -> list[Item]:
    """The items of a token stream."""
    out: list[Item] = []
    above: list[tuple] = []  # items so far, key, kind and link of the elements around
    link = False
    for part in told:
        if part == 0:
            inner = collapse(out)
            out, key, kind, link = above.pop()
            out.append(Item(key, kind, inner, None, sum([i.chars for i in inner]), sum([i.links for i in inner])))
        elif isinstance(part[0], int):
            out.append(Item("#", constant=part[1], chars=part[0], links=part[0] if link else 0))
        else:
            above.append((out, *part, link))
            out, link = [], link or part[0].split(".")[0] == "a"
    return out


def _united(a: Item, b: Item) -> Item:
    """One item for two of the same key."""
    kind = (a.kind & b.kind & 1) | ((a.kind | b.kind) & 2)  # furniture only if it is so on all pages
    out = Item(a.key, kind, None, a.constant if a.constant == b.constant else None, a.chars + b.chars, a.links + b.links)
    out.items = align(a.items, b.items)
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated
    return out


def collapse(items: list[Item]) -> list[Item]:
    """Neighbouring squares become repeated groups, the shortest periods first."""
    for period in range(1, LONGEST_PERIOD + 1):
        out: list[Item] = []
        at = 0
        while at < len(items):
            keys = [i.key for i in items[at : at + period]]
            end = at + period
            while len(keys) == period and [i.key for i in items[end : end + period]] == keys:
                end += period
            if end == at + period or (period == 1 and keys == ["#"]):
                out.append(items[at])
                at += 1
                continue
            group = items[at : at + period]
            for k in range(at + period, end, period):
                group = [_united(a, b) for a, b in zip(group, items[k : k + period])]
            one = group[0] if period == 1 else Item("(" + " ".join(keys) + ")", 0, group, None, sum(i.chars for i in group), sum(i.links for i in group))
            one.repeated = True
            out.append(one)
            at = end
        items = out
    return items


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """A union-free expression for both streams. At a mismatch the nearer of the two next matches is taken, and what it
    skips becomes optional; if neither side matches again, both parts are."""
    places_a: dict[str, list[int]] = {}
    places_b: dict[str, list[int]] = {}
    for places, side in ((places_a, a), (places_b, b)):
        for k, item in enumerate(side):
            places.setdefault(item.key, []).append(k)
    out: list[Item] = []

    def skip(item: Item) -> None:
        item.optional = True
        out.append(item)

    i = j = 0
    while i < len(a) and j < len(b):
        if a[i].key == b[j].key:
            out.append(_united(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        in_a, in_b = places_a.get(b[j].key, ()), places_b.get(a[i].key, ())
        next_a, next_b = bisect_left(in_a, i), bisect_left(in_b, j)
        far_a = in_a[next_a] - i if next_a < len(in_a) else None
        far_b = in_b[next_b] - j if next_b < len(in_b) else None
        if far_a is not None and (far_b is None or far_a <= far_b):
            for item in a[i : i + far_a]:
                skip(item)
            i += far_a
        elif far_b is not None:
            for item in b[j : j + far_b]:
                skip(item)
            j += far_b
        else:
            skip(a[i])
            skip(b[j])
            i, j = i + 1, j + 1
    for item in (*a[i:], *b[j:]):
        skip(item)
    return collapse(out)


def infer(skeletons: list[str]) -> list[Item]:
    """The wrapper of the pages: each is aligned with what the ones before it gave."""
    wrapper: list[Item] | None = None
    with _any_depth():
        for told in skeletons:
            page = collapse(_items(json.loads(told)))
            wrapper = page if wrapper is None else align(wrapper, page)
    return wrapper or []


def _weigh(wrapper: list[Item]) -> dict[int, int]:
    """Characters outside furniture and links of every item, by its identity."""
    order, todo = [], [(i, None) for i in wrapper]
    worth: dict[int, int] = {}
    while todo:
        item, above = todo.pop()
        order.append((item, above))
        worth[id(item)] = item.chars - item.links if item.key == "#" else 0
        if not item.kind & 1:
            todo.extend((i, item) for i in item.items)
    for item, above in reversed(order):
        if above is not None and not item.kind & 1:
            worth[id(above)] += worth[id(item)]
    return worth


def main_path(wrapper: list[Item]) -> list[str]:
    """Keys from the root to the element that holds the article.

    That is the richest element named as content, if it holds half of the words outside furniture; else the way down
    goes on as long as one element holds nine tenths of them. An empty path means the whole page.
    """
    worth = _weigh(wrapper)
    total = sum(worth[id(i)] for i in wrapper)
    best_named, path = (0, 0), None
    here: list[str] = []
    todo: list[tuple[Item, int]] = [(i, 0) for i in reversed(wrapper)]
    while todo:
        item, depth = todo.pop()
        if item.key == "#" or item.kind & 1:
            continue
        del here[depth:]
        if not item.key.startswith("("):
            here.append(item.key)
        own = worth[id(item)]
        if item.kind & 2 and own > 0 and 2 * own >= total and (own, len(here)) > best_named:
            best_named, path = (own, len(here)), list(here)
        todo.extend((i, len(here)) for i in reversed(item.items))
    if path is not None:
        return path
    path, items = [], wrapper
    while True:
        best = max((i for i in items if i.key != "#"), key=lambda i: worth[id(i)], default=None)
        if best is None or best.is_block() or 10 * worth[id(best)] < 9 * total or not worth[id(best)]:
            return path
        if not best.key.startswith("("):
            path.append(best.key)
        items = best.items


def _select(element: Element, path: list[str]) -> list[Element]:
    found = [element]
    for key in path:
        found = [c for e in found for c in e.children if isinstance(c, Element) and c.key == key]
    return found


def text_of(elements: list[Element]) -> str:
    """Their words without furniture inside them, white space made single blanks; inline elements do not part words."""
    parts: list[str] = []
    chosen = set(map(id, elements))
    todo: list = list(reversed(elements))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            parts.append(node)
        elif not node.furniture or id(node) in chosen:
            if node.tag in INLINE:
                todo.extend(reversed(node.children))
            else:
                parts.append(" ")
                todo.append(" ")
                todo.extend(reversed(node.children))
    return " ".join(html.unescape("".join(parts)).split())


def extract(page: str | None, path: list[str] | None) -> str:
    """Main text of a page by its host's path; a page that the path doesn't fit is its own sample."""
    if not page:
        return ""
    root = parse(page)
    found = _select(root, path) if path else []
    if not found:
        found = _select(root, main_path(infer([skeleton(page)])))
    return text_of(found)


def host_of(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def _named(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id")
    return pages.select(number, F.col(url_col).cast("string").alias("url"), host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))


def wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: host, n_pages, wrapper (the expression), path (to the element that holds the article).

    Inferred from about a dozen pages, picked by a hash of id; only their token streams are brought together. Pages
    without a host in their url share one. Null and empty pages teach nothing.
    """
    named = _named(pages, id_col, url_col, html_col)
    counts = materialize(named.groupBy("host").agg(F.count("*").alias("n_pages")), "wrapper-hosts")
    draw = F.pmod(F.xxhash64(F.lit("wrapper"), "id"), F.lit(1 << 30))
    # Salted: a busy host's pages must not meet its count in one task.
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    keys = named.select("host", "id", draw.alias("draw"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    keys = keys.join(counts.withColumn("salt", each).hint("merge"), ["host", "salt"])
    keys = keys.where(F.col("draw") * F.col("n_pages") < F.lit(4 * SAMPLE_PAGES * (1 << 30))).select("host", "id").distinct()
    keys = materialize(keys, "wrapper-sample")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [skeleton(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["host", "id", "told"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "told"])
        learned = infer(group["told"].head(SAMPLE_PAGES).tolist())
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [" ".join(i.text() for i in learned)], "path": [main_path(learned)]})

    streams = named.where("html <> ''").select("host", "id", "html").mapInArrow(told, "host string, id long, told string")
    streams = streams.join(keys.hint("merge"), ["host", "id"], "left_semi")
    learned = streams.groupBy("host").applyInPandas(learn, "host string, wrapper string, path array<string>")
    return counts.join(materialize(learned, "wrapper-learned").hint("merge"), "host", "left")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Id, url, text and n_chars of every row: the article's words, blocks joined in page order by one blank.

    Null, empty and furniture-only pages give an empty text. Every host's pages are spread over salts, and its path, a
    short row, goes to each. Repeated ids are read row by row; an empty table gives an empty result; other columns are ignored.
    """
    rules = wrappers(pages, id_col, url_col, html_col).select("host", "path")
    rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rules = materialize(rules, "wrapper-paths").hint("merge")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, path) for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    named = _named(pages, id_col, url_col, html_col).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    met = named.join(rules, ["host", "salt"]).select("id", "url", "html", "path")
    rows = met.mapInArrow(extracted, "id long, url string, text string, n_chars long")
    return rows.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "url", "text", "n_chars")
