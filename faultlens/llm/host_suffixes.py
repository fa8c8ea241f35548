"""Main text of web pages: markup zones, and a suffix array of each host's page streams."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.runtime import pin

# Tokens a repeated substring must have to be boilerplate. Suffixes are ordered
# by so many tokens, which is all that longest-common-prefix of this length needs.
DEPTH = 8
MAIN, OPEN, CHROME = 0, 1, 2

# What markup calls the parts that are not the article.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math head title select option object".split())
CHROME_TAGS = frozenset("nav header footer aside form button menu dialog".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices popup promo"
    " related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CHROME_ROLES = frozenset("banner navigation complementary contentinfo search form menu dialog alert".split())
# An article with one of these is no main text.
ARTICLE_WORDS = frozenset("ad ads advert comment comments sponsored promo related".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")


def _is_chrome(tag: str, rest: str, in_main: bool) -> bool:
    if tag in CHROME_TAGS and not (tag == "header" and in_main):
        return True
    words = ARTICLE_WORDS if tag in ("article", "main") else CHROME_WORDS
    for name, *values in _NAMED.findall(rest) if rest else ():
        found = set(_WORDS.findall("".join(values).lower()))
        if name.lower() == "role":
            if found & CHROME_ROLES:
                return True
        # A heading called "header" inside the article is part of it.
        elif found & words - ({"header"} if in_main else set()):
            return True
    return False


def blocks_of(page: str) -> list[tuple[int, str]]:
    """Blocks of text with their zones, in page order; character references are decoded.

    A block ends at any tag that is not inline. White space inside is one space.
    Comments, scripts, styles and the like are no text. An unclosed element ends
    with the element around it.
    """
    blocks: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    zone = OPEN
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append((zone, text))
        parts.clear()

    while at < len(page):
        match = _TAG.search(page, at)
        if match is None:
            parts.append(page[at:])
            break
        parts.append(page[at : match.start()])
        at = match.end()
        tag = (match["name"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        rest = match["rest"]
        if match["close"]:
            if any(name == tag for name, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not rest.endswith("/"):
            own = stack[-1][1] if stack else OPEN
            if own != CHROME and tag not in ("html", "body"):
                if _is_chrome(tag, rest, own == MAIN):
                    own = CHROME
                elif tag in ("article", "main"):
                    own = MAIN
            # Inline elements matter only if they change the zone; paragraphs are often left open.
            if tag not in INLINE and tag not in ("p", "li") or own != (stack[-1][1] if stack else OPEN):
                stack.append((tag, own))
        new = stack[-1][1] if stack else OPEN
        if new != zone:
            flush()
            zone = new
    flush()
    return blocks


def host_of(url: str | None) -> str:
    match = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return match[1].lower() if match else ""


_BLOCKS = pa.list_(pa.struct([("zone", pa.int32()), ("text", pa.string()), ("first", pa.int32())]))


def _parsed(pages: DataFrame) -> DataFrame:
    """Pages with host and blocks; ``first`` is a block's place in the page's token stream.

    The stream leaves out articles. ``content`` hashes it, so that copies of a page
    count as one page.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found, contents = [], [], []
            for url, page in zip(batch.column(1), batch.column(2), strict=True):
                rows, first = [], 0
                digest = xxhash.xxh64()
                for zone, text in blocks_of(page.as_py()):
                    rows.append({"zone": zone, "text": text, "first": first})
                    digest.update(text)
                    if zone != MAIN:
                        first += text.count(" ") + 1
                hosts.append(host_of(url.as_py()))
                found.append(rows)
                contents.append(digest.intdigest() >> 1)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(hosts), pa.array(found, _BLOCKS), pa.array(contents, pa.int64())],
                names=["page_id", "url", "host", "blocks", "content"],
            )

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    schema = (
        f"page_id {id_type}, url string, host string, "
        "blocks array<struct<zone:int,text:string,first:int>>, content bigint"
    )
    return rows.mapInArrow(parsed, schema).withColumn("row", F.monotonically_increasing_id())


def _suffixes(pages: DataFrame) -> DataFrame:
    """Suffixes of the page streams: ``(host, prefix, row, content, pos, open)``.

    ``prefix`` hashes the first ``DEPTH`` tokens. Equal prefixes of a host are
    neighbours in its suffix array, at a common prefix of at least ``DEPTH``.
    ``open`` marks suffixes that reach into a block which may turn out to be main text.
    """
    names = ["host", "prefix", "row", "content", "pos", "open"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for host, row, content, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens: list[str] = []
                open_: list[bool] = []
                undecided = all(block["zone"] != MAIN for block in blocks)
                for block in blocks:
                    if block["zone"] != MAIN:
                        words = block["text"].split(" ")
                        tokens += words
                        open_ += [undecided and block["zone"] == OPEN] * len(words)
                for p in range(len(tokens) - DEPTH + 1):
                    prefix = xxhash.xxh64_intdigest(" ".join(tokens[p : p + DEPTH])) - (1 << 63)
                    reach = any(open_[p : p + DEPTH])
                    for column, value in zip(rows, (host, prefix, row, content, p, reach), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    schema = "host string, prefix bigint, row bigint, content bigint, pos int, open boolean"
    return pages.select("host", "row", "content", "blocks").mapInArrow(listed, schema)


def _unique_runs(blocks: list[dict], covered: set[int]) -> str:
    """Open blocks without their covered tokens, one line per block that has any left."""
    lines = []
    for block in blocks:
        if block["zone"] == OPEN:
            words = block["text"].split(" ")
            kept = [word for n, word in enumerate(words, block["first"]) if n not in covered]
            if kept:
                lines.append(" ".join(kept))
    return "\n".join(lines)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)``: the main text of every page, blocks joined by newlines.

    Markup comes first. What stands in menus, headers, footers, asides, forms and
    elements named after adverts, notices or comments is chrome; what stands in
    an article or main element is main text and is kept whole, passages shared with
    other pages included. A page without such an element keeps its blocks outside
    chrome, less what the suffix array shows to be boilerplate: tokens covered by a
    substring of at least ``DEPTH`` tokens that occurs on pages of the same host
    with different content. Chrome takes part in the suffix array, so a menu that is
    marked on one page is recognised on another.

    Null html is an empty page with empty text; null urls share one host. Copies of
    a page count as one page, so they do not erase each other. Repeated rows give
    repeated results; other columns are not read; an empty table gives an empty
    result. The suffix array is never held in one place: suffixes are dealt by host and
    prefix, the interval of a prefix is an aggregate made before the shuffle, and
    only suffixes that reach into undecided blocks are joined back, by a join Spark
    can split, so a host with a third of all pages is no single group.
    """
    parsed = pin(_parsed(pages))
    marked = parsed.filter(F.exists("blocks", lambda block: block["zone"] == MAIN))
    own = F.filter("blocks", lambda block: block["zone"] == MAIN)
    done = marked.select(
        "page_id", "url", F.array_join(F.transform(own, lambda block: block["text"]), "\n").alias("text")
    )

    suffixes = pin(_suffixes(parsed))
    intervals = suffixes.groupBy("host", "prefix").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
    repeated = pin(intervals.filter("lo <> hi").select("host", "prefix"))
    covered = (
        suffixes.filter("open")
        .join(repeated, ["host", "prefix"], "left_semi")
        .groupBy(F.col("row").alias("_row"))
        .agg(F.collect_set("pos").alias("starts"))
    )
    rest = parsed.filter(~F.exists("blocks", lambda block: block["zone"] == MAIN))
    rest = rest.join(covered, F.col("row") == F.col("_row"), "left")
    id_type = pages.schema["page_id"].dataType.simpleString()

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, starts in zip(batch.column(2), batch.column(3), strict=True):
                gone = {n for p in starts.as_py() or () for n in range(p, p + DEPTH)}
                texts.append(_unique_runs(blocks.as_py(), gone))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rest = rest.select("page_id", "url", "blocks", "starts")
    return done.unionByName(rest.mapInArrow(decided, f"page_id {id_type}, url string, text string"))
