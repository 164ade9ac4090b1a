"""Main text of web pages, with site templates removed.

A page is parsed once per pass, tolerantly, into blocks of text, each under a chain of elements. The subtree of every block
element is hashed, and counted over the distinct pages of each host in Spark. What recurs across many pages of a host is
its template, and its blocks are deleted first: menus, footers, boxes and notices go in this step wherever a host has them
on enough pages. What it cannot see, as it stands on too few pages, goes by the kind or name of its element (navigation,
scripts, forms, adverts, ...); of the rest, an article's own element holds the article, if there is one.

How many pages are many depends on where a subtree stands (SHARES): outside an article a small share will do, for
paragraphs and headings a larger one, and inside an article only what more than half of the pages have is template. Pages
are distinct if their texts are: copies of an article count once, so they don't become a template.

Pass one sends hashes only; counts combine before the shuffle, so a host with very many pages is no burden. For pass two
each task gets the templates as one table if they are few (they are counted first); else hashes of pages and templates are
joined pair by pair, and the hits of a page go to it by its own hash.

Defined cases: null and empty html gives no text; a null url, or one without a host, is a host of its own; repeated rows
give the same text; an element that is never closed ends with its parent; other columns are ignored; empty in, empty out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import materialise, small_batches

#: A subtree on more distinct pages of a host than this is template, if it is also on more than a share of them: of
#: elements outside an article, of paragraphs and the like there, and of all that is inside an article.
MIN_PAGES, SHARES = 4, (0.05, 0.2, 0.5)
#: Template rows that every task gets at most; about 100 bytes each.
BROADCAST_ROWS = 200_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACES = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in _RAW}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Never article text.
_DROPPED = frozenset("head title script style noscript template nav footer aside form fieldset button select option input textarea iframe object embed svg canvas audio video map dialog menu noframes noembed datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that name what is not the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside masthead footer foot colophon"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall"
    " comment comments commentlist disqus respond replies share sharing social related recommended recommendations teaser"
    " pagination pager toolbar widget widgets search skip".split()
)
#: Inside an article these are its text.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption article main body html ul ol dl table tbody tr thead".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


def _is_dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and not _NAMES.isdisjoint(_PARTS.findall(value)):
            return True
        if name == "role" and value.strip() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class Page:
    """blocks: (text, element, dropped by kind, in an article); parents, keys and kinds (see SHARES; -1: never template) of
    elements. A key is the hash of a subtree and of its kind."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, bool, bool]] = []
        self.parents, self.keys, self.kinds = [-1], [0], [-1]
        self._parse(source)

    def _parse(self, source: str) -> None:
        # Open elements: tag, element number, dropped, in an article, digests of what it holds, and of dropped inline
        # elements, whose text is not read, how often their own tag is open (0 for all others).
        stack: list[list] = [["", 0, False, False, [], 0]]
        opened: Counter[str] = Counter()
        buffer: list[str] = []

        def flush() -> None:
            if buffer:
                text = _SPACES.sub(" ", entities.unescape("".join(buffer))).strip()
                buffer.clear()
                if text:
                    k = len(stack) - 1
                    while stack[k][5]:  # the text came before the inline element
                        k -= 1
                    _, node, dropped, in_article, parts, _ = stack[k]
                    parts.append(text.encode("utf-8", "surrogatepass"))
                    self.blocks.append((text, node, dropped, in_article))

        def close(upto: int) -> None:
            while len(stack) > upto:
                tag, node, _, _, parts, inline = stack.pop()
                opened[tag] -= 1
                if inline:
                    stack[-1][4].extend(parts)
                elif parts:
                    kind = self.kinds[node]
                    digest = xxhash.xxh3_64_digest(b"\0".join([tag.encode(), *parts]))
                    self.keys[node] = xxhash.xxh3_64_intdigest(digest, seed=kind + 1) - (1 << 63)
                    stack[-1][4].append(digest)

        def read(text: str) -> None:
            if not stack[-1][5]:
                buffer.append(text)

        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                read(source[at:])
                break
            if lt > at:
                read(source[at:lt])
            m = _TOKEN.match(source, lt)
            if not m:
                read("<")
                at = lt + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in _INLINE:
                    if stack[-1][5] and stack[-1][0] == tag and stack[-1][5] > 1:
                        stack[-1][5] -= 1
                    elif opened[tag]:  # only dropped ones are on the stack
                        if not stack[-1][5]:
                            flush()
                        close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
                    continue
                if not opened[tag]:
                    if not stack[-1][5]:
                        flush()
                    continue
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] in ("article", "main", "body", "table") and tag not in ("article", "main", "body", "html", "table", "div", "section"):
                        break
                continue
            if tag in _RAW:
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else n
                continue
            if tag in _INLINE:
                if stack[-1][5]:
                    stack[-1][5] += tag == stack[-1][0]
                elif tag == "br":
                    buffer.append(" ")
                elif tag not in _VOID and m[3] and not m[3].endswith("/") and _is_dropped(tag, m[3], stack[-1][3]):
                    stack.append([tag, stack[-1][1], True, stack[-1][3], [], 1])
                    opened[tag] += 1
                continue
            flush()
            if tag in _VOID:
                continue
            if tag in _CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if not (stack[k][5] and tag == "p"):  # other blocks can be part of a dropped inline element
                        break
            if tag in _SELF:
                same, until = _SELF[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in same.split():
                        close(k)
                        if tag != "tr" or stack[-1][0] not in ("tr", "td", "th"):
                            break
                    elif stack[k][0] in until:
                        break
            _, parent, dropped, in_article, _, _ = stack[-1]
            dropped = dropped or _is_dropped(tag, m[3], in_article)
            in_article = in_article or (tag in ("article", "main") and not dropped)
            self.parents.append(parent)
            self.keys.append(0)
            self.kinds.append(-1 if tag in ("html", "body", "article", "main") else 2 if in_article else 1 if tag in _PROSE else 0)
            stack.append([tag, len(self.parents) - 1, dropped, in_article, [], 0])
            opened[tag] += 1
        flush()
        close(1)

    def subtrees(self) -> set[tuple[int, int]]:
        """Keys and kinds of the subtrees that can be template."""
        return {(key, kind) for key, kind in zip(self.keys, self.kinds, strict=True) if kind >= 0 and key}

    def text(self, template: frozenset[int] = frozenset()) -> tuple[str, int]:
        """The main text, and how many blocks went with the template."""
        # Parents come before their children.
        gone = [False] * len(self.parents)
        for k in range(1, len(gone)) if template else ():
            gone[k] = gone[self.parents[k]] or (self.kinds[k] >= 0 and self.keys[k] in template)
        left = [b for b in self.blocks if not gone[b[1]]]
        kept = [b for b in left if not b[2]]
        if any(b[3] for b in kept):  # an article's own element holds the article
            kept = [b for b in kept if b[3]]
        return "\n\n".join(b[0] for b in kept), len(self.blocks) - len(left)


def host_of(url: Column) -> Column:
    """The host of a url in lower case; null if it has none."""
    found = F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _subtree_rows(rows: DataFrame, name: str) -> DataFrame:
    """host, `name`, key and kind of every subtree of rows (host, html, `name`), and a key 0 for each page; a null `name` is
    a hash of the page's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str | None, int, int, int]] = []
            for host, source, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(source or "")
                own = own if own is not None else xxhash.xxh3_64_intdigest(page.text()[0].encode("utf-8", "surrogatepass")) >> 1
                out += [(host, own, key, kind) for key, kind in ((0, 0), *page.subtrees())]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["host", name, "key", "kind"])

    return rows.select("host", "html", name).mapInArrow(run, f"host string, {name} bigint, key bigint, kind int")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """host and key of the subtrees that recur, in rows."""
    rows = small_batches(pages).select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"), F.lit(None).cast("bigint").alias("identity"))
    counts = _subtree_rows(rows, "identity").distinct().groupBy("host", "key", "kind").agg(F.count("*").alias("n")).where((F.col("n") > min_pages))
    # A host with a subtree on more than min_pages pages has as many pages, so its own row is here.
    whole = counts.where(F.col("key") == 0).select(F.col("host").alias("w_host"), F.col("n").alias("all_pages"))
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("kind") + 1)
    above = counts.where(F.col("key") != 0).join(whole, F.col("host").eqNullSafe(F.col("w_host"))).where(F.col("n") > share * F.col("all_pages"))
    return above.select("host", "key").distinct()


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """page_id, url, text, n_chars and n_template_blocks (blocks that went with the template) of every row of pages
    (page_id, url, html)."""
    spark = pages.sparkSession
    templates = materialise(site_templates(pages, min_pages, shares), "templates")
    rows = small_batches(pages).select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long").add("n_template_blocks", "long")
    known = None
    if templates.count() <= BROADCAST_ROWS:
        by_host: dict[str | None, set[int]] = {}
        for host, key in templates.toLocalIterator():
            by_host.setdefault(host, set()).add(key)
        known = spark.sparkContext.broadcast({h: frozenset(k) for h, k in by_host.items()})
        rows = rows.withColumn("hits", F.lit(None).cast("array<bigint>"))
    else:
        rows = rows.withColumn("own", F.xxhash64("host", "html"))
        subtrees = _subtree_rows(rows.select("host", "html", "own").where(F.col("html").isNotNull()), "own").where(F.col("key") != 0).distinct()
        found = subtrees.join(templates.withColumnsRenamed({"host": "t_host", "key": "t_key"}), F.col("host").eqNullSafe(F.col("t_host")) & (F.col("key") == F.col("t_key")))
        hits = found.groupBy("own").agg(F.collect_set("key").alias("hits")).withColumnRenamed("own", "h_own")
        rows = rows.join(hits, F.col("own") == F.col("h_own"), "left")
    rows = rows.select("page_id", "url", "html", "host", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: frozenset[int] = frozenset()
        for batch in batches:
            texts, removed = [], []
            for source, host, hits in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                text, n = Page(source or "").text(known.value.get(host, none) if known else frozenset(hits or ()))
                texts.append(text.encode("utf-8", "replace").decode())
                removed.append(n)
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], ["page_id", "url", "text", "n_chars", "n_template_blocks"])

    return rows.mapInArrow(run, schema)
