"""Main text of web pages, with a suffix array over the pages of a host.

Each page becomes a stream of tokens (tags and words) and a list of text blocks.

1. The distinct pages of a host are dealt by a hash of their content to buckets of about
   `RUN` characters and at least `PAGES` pages; most hosts have one. A bucket's streams are
   concatenated and their suffixes sorted by their first `LONG` tokens. A substring of that
   length that stands on `FEWEST` distinct pages and on a share `SHARE` of a bucket's pages
   is boilerplate of the host. What stands on that share of all the host's pages does so in
   one of its buckets, so no such substring is missed, and which are found depends on the
   pages alone, not on partitions.
2. Hosts' substrings, as hashes, are joined to all their pages: tokens that one covers are
   boilerplate.

On a page without a marked article covered tokens go and the unique runs stay. In a marked
article the blocks that are covered as a whole go, unless they are more than half of it:
a host may hold many versions of one article. Markup helps: menus, headers, footers,
sidebars, notices, adverts, forms and reader comments go whatever the array says.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, staged

RUN, PAGES, LONG, SHARE, FEWEST = 2_000_000, 16, 8, 1 / 2, 4
BROADCAST = 200_000  # hosts up to which their sizes and substrings are broadcast; more are joined by a shuffle
SEEN = 1 << 20  # pages that a task remembers, so as not to send copies
FACTORS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(1, LONG + 1)], np.uint64)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|select|button|svg|iframe|object|title)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?/]?[a-zA-Z][^>]*(?:>|$)|[^<]+|<", re.S | re.I)
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
MARKS = re.compile(r"""[\s"'](class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND = frozenset("nav header footer aside form menu dialog head fieldset".split())
WITHIN = AROUND - {"header"}  # an article's own header holds its title
CONTENT = frozenset(["article", "main"])
#: Words in a class, an id or a role that mark what isn't the article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social breadcrumb breadcrumbs menu nav navbar navigation sidebar sidebars rail widget widgets "
    "related recommended recommendations footer header masthead topbar toolbar comment comments commentlist reply replies respond disqus pagination pager copyright "
    "contentinfo complementary dialog form".split()
)


def unwanted(tag: str, name: str, inside: bool) -> bool:
    """Whether an opening tag starts something that isn't the article."""
    if name in (WITHIN if inside else AROUND):
        return True
    if name in ("body", "html"):
        return False
    for kind, value in MARKS.findall(tag):
        words = WORD.findall(value.lower())
        if inside and kind.lower() in ("class", "id") and words and words[-1] == "header":
            continue
        if kind.lower() != "itemprop" and not NOT_ARTICLE.isdisjoint(words):
            return True
        if kind.lower() == "itemprop" and "comment" in words:
            return True
    return False


def blocks_of(page: str) -> tuple[list[tuple[str, int]], list[str], list[int]]:
    """(blocks, tokens, the block of each token or -1) of a page.

    A block is its text, white space collapsed, and where it is: 2 in an article, 1 in
    the main part, 0 elsewhere; unwanted blocks leave their tokens only.
    """
    blocks: list[tuple[str, int]] = []
    tokens: list[str] = []
    owner: list[int] = []
    pieces: list[str] = []
    skipped, depth, inside, articles = "", 0, 0, 0

    def flush() -> None:
        if pieces:
            words = html.unescape("".join(pieces)).split()
            pieces.clear()
            tokens.extend(words)
            owner.extend([-1 if skipped else len(blocks)] * len(words))
            if words and not skipped:
                blocks.append((" ".join(words), 2 if articles else int(inside > 0)))

    for m in TOKEN.finditer(page):
        part = m.group()
        if part[0] != "<" or part == "<":
            pieces.append(part)
            continue
        named = NAME.match(part)
        if m.group(1) or not named:
            continue
        closing, name = named.group(1), named.group(2).lower()
        if name in INLINE and not (skipped == name) and (closing or not unwanted(part, name, inside > 0)):
            continue
        flush()
        tokens.append("/" + name if closing else name)
        owner.append(-1)
        empty = name in VOID or part.endswith("/>")
        if skipped:
            ended = not inside and not closing and (name in CONTENT and not unwanted(part, name, False) or name == "body")
            if name == skipped and not empty:
                depth += -1 if closing else 1
            if inside and closing and name in CONTENT and skipped not in CONTENT:
                ended = True  # the article ends, and with it what was left open in it
            if skipped == "p" and not closing:
                ended = True  # a paragraph ends where another block starts
            if depth == 0 or ended:
                skipped, depth = "", 0
            if not ended:
                continue
        if closing:
            if name in CONTENT:
                inside = max(0, inside - 1)
                articles = max(0, articles - (name == "article"))
        elif not empty:
            if unwanted(part, name, inside > 0):
                skipped, depth = name, 1
            elif name in CONTENT:
                inside += 1
                articles += name == "article"
    flush()
    return blocks, tokens, owner


def codes_of(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(t.encode("utf-8", "replace")) for t in tokens), np.uint32, len(tokens))


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the `LONG` tokens from each position on, as far as there are so many."""
    n = max(0, len(codes) - LONG + 1)
    return sum((codes[j : j + n].astype(np.uint64) * FACTORS[j] for j in range(LONG)), np.zeros(n, np.uint64)).view(np.int64)


def boilerplate(streams: list[np.ndarray]) -> np.ndarray:
    """Hashes of the substrings of `LONG` tokens that enough of the pages have, given the codes of distinct pages.

    Suffixes of the concatenated streams are ranked by 1, 2, 4, .. tokens, each rank from
    the pair of ranks before it, up to `LONG`; a run of equal rank in the sorted array is
    one substring. Each page ends in a token of its own.
    """
    enough = max(FEWEST, math.ceil(SHARE * len(streams)))
    if len(streams) < enough:
        return np.zeros(0, np.int64)
    sizes = np.array([len(s) + 1 for s in streams])
    page = np.repeat(np.arange(len(streams)), sizes)
    text = np.concatenate([np.r_[s.astype(np.int64), (1 << 32) + i] for i, s in enumerate(streams)])
    rank, length = np.unique(text, return_inverse=True)[1], 1
    while length < LONG:
        after = np.full(len(rank), -1, np.int64)
        after[:-length] = rank[length:]
        rank, length = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1], 2 * length
    suffixes = np.argsort(rank, kind="stable")
    new = np.r_[True, np.diff(rank[suffixes]) != 0]
    turned = new | np.r_[True, np.diff(page[suffixes]) != 0]  # pages ascend within a run
    starts = np.flatnonzero(new)
    first = suffixes[starts[np.add.reduceat(turned.astype(np.int64), starts) >= enough]]
    return np.unique(grams(text)[first[first + LONG <= len(text)]])


def covered(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the substrings whose hashes are `known`, sorted."""
    hit = np.zeros(len(codes) + LONG, np.int64)
    h = grams(codes)
    if len(known) and len(h):
        at = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + LONG, -1)
    return np.cumsum(hit)[: len(codes)] > 0


def text_of(page: str, known: np.ndarray) -> str:
    """The main text of a page of a host with this boilerplate."""
    blocks, tokens, owner = blocks_of(page)
    best = max((level for _, level in blocks), default=0)
    hit = covered(codes_of(tokens), known) if len(known) else np.zeros(len(tokens), bool)
    if not best:
        return " ".join(t for t, b, h in zip(tokens, owner, hit, strict=True) if b >= 0 and not h)
    mine = np.array(owner, np.int64)
    words = np.bincount(mine[mine >= 0], minlength=len(blocks))
    stale = np.bincount(mine[(mine >= 0) & hit], minlength=len(blocks)) == words
    article = np.array([level == best for _, level in blocks])
    if 2 * words[article & stale].sum() <= words[article].sum():
        article &= ~stale
    return " ".join(text for (text, _), kept in zip(blocks, article, strict=True) if kept)


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (host, bucket, content, html): (host, bucket, content, codes), once per page and task."""
    seen: set = set()
    for batch in batches:
        hosts, contents = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        new = []
        for k, key in enumerate(zip(hosts, contents, strict=True)):
            if key not in seen:
                new.append(k)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
        rows = batch.take(pa.array(new, pa.int64()))
        codes = [codes_of(blocks_of(page)[1]).tobytes() for page in rows.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), pa.array(codes, pa.binary())], names=["host", "bucket", "content", "codes"])


def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (host, bucket, content, codes) in this order: (host, gram)."""
    key, last, held = None, None, []

    def rows() -> pa.RecordBatch:
        hashes = boilerplate(list({x.tobytes(): x for x in held}.values()))
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(hashes), pa.string()), pa.array(hashes, pa.int64())], names=["host", "gram"])

    for batch in batches:
        for host, bucket, content, codes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != (host, bucket):
                if held:
                    yield rows()
                key, last, held = (host, bucket), None, []
            if content != last:
                held.append(np.frombuffer(codes, np.uint32))
                last = content
    if held:
        yield rows()


def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, url, html, known): (id, url, text, n_chars)."""
    for batch in batches:
        known = batch.column(3)
        ends, flat = known.offsets.to_numpy(), known.values.to_numpy()
        texts = [text_of(page, flat[a:b]) for page, a, b in zip(batch.column(2).to_pylist(), ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def host_boilerplate(rows: DataFrame) -> DataFrame:
    """(host, known): per host of `rows(host, html)` the sorted hashes of its boilerplate, of hosts that have any."""
    rows = rows.withColumn("content", F.xxhash64("html"))
    sizes = rows.groupBy("host", "content").agg(F.max(F.length("html")).alias("n")).groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").alias("n"))
    buckets = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / RUN), F.floor(F.col("pages") / PAGES))).cast("long")
    sizes = staged(sizes.where(F.col("pages") >= FEWEST).select("host", buckets.alias("buckets")))
    dealt = rows.join(sized(sizes, BROADCAST), "host").select("host", F.pmod("content", "buckets").alias("bucket"), "content", "html")
    parsed = dealt.mapInArrow(streams, "host string, bucket bigint, content bigint, codes binary").repartition("host", "bucket").sortWithinPartitions("host", "bucket", "content")
    return staged(parsed.mapInArrow(found, "host string, gram bigint").groupBy("host").agg(F.sort_array(F.collect_set("gram")).alias("known")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of `pages`: id, url, text (the main text, empty if none) and n_chars (code points).

    Null html counts as empty; a null URL has the host ''; null or repeated ids keep their
    rows; equal pages are one page to the suffix array; a host of fewer than `FEWEST`
    distinct pages has no boilerplate; an empty table gives an empty result; other columns
    are not read. Very long pages are parsed whole; a bucket holds the codes, four bytes a
    token, of its pages. Character references are decoded, white space is one space, blocks
    are joined by one space.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col)
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(host.alias("host"), F.col(id_col).alias("id"), url.alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    known = sized(host_boilerplate(rows.select("host", "html")), BROADCAST)
    joined = rows.join(known, "host", "left").select("id", "url", "html", F.coalesce("known", F.array().cast("array<bigint>")).alias("known"))
    return joined.mapInArrow(apply, f"id {kind}, url string, text string, n_chars bigint").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
