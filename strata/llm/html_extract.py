"""Main text of pages by a suffix array over each host's token streams.

A page is cut into blocks of text, each with the markup it stands in. The blocks'
words are concatenated, some pages at a time, and a suffix array sorts all places by
what follows them, so equal runs of REPEAT_WORDS words are neighbours and their pages
are counted; summed over all pages of a host, these numbers tell which runs occur on
several distinct pages. The places that repeated runs cover are exactly those that
maximal repeats of REPEAT_WORDS words or more cover, as every window of such a repeat
is a repeated run, and a chain of repeated runs is what a page shares; a block with
fewer words counts as one run, filled up. Blocks that are covered for the most part are
boilerplate and go, unique ones stay, on every page. Markup has the last word where it
is explicit: blocks in navigation, headers, footers, side columns, notices, adverts,
forms, comments, scripts or styles never count, and blocks in an article or main
element are kept even if other pages repeat them, since copied passages are part of a
page's text.

Defined results: null and empty pages have empty text; repeated rows get equal
result rows and, like pages of one host with the same blocks, count as one page; a host of one page
has no repeats; very long pages are read whole; ties do not arise; broken markup is read as far as it
goes (an unfinished tag is dropped, an unfinished reference stays as it is written);
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from strata.llm.common import BROADCAST_ROWS, per_row, small, stored

#: Pages of one suffix array; their runs are summed over all shards.
SHARD_PAGES = 64
#: Pages of a run from which it is joined by broadcast.
HEAVY_PAGES = 5_000
#: Words a repeated sequence needs (a power of two), and distinct pages it must be on.
REPEAT_WORDS = 8
REPEAT_PAGES = 2
#: Share of a block's words that repeats must cover for the block to go.
COVERED = 0.6

BLOCKS_TYPE = ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())]))
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Element names by role.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "head", "object", "canvas", "textarea", "select"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
MAIN = {"article", "main"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCKS = {
    "p", "div", "section", "article", "main", "header", "footer", "aside", "nav", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th",
    "thead", "tbody", "caption", "blockquote", "pre", "figure", "figcaption", "form", "fieldset", "address", "body", "html", "hr", "details", "summary", "title",
}
CHROME_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "notices", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "header", "footer", "sidebar", "side", "aside", "widget", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "signup", "popup", "modal", "overlay",
    "comment", "comments", "reply", "replies", "disqus", "pagination", "pager", "legal", "copyright", "masthead", "toolbar", "skip",
}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}

#: Parts of compound class names that say nothing about their role.
NEUTRAL_NAMES = {
    "site", "page", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "box", "bar", "wrap", "wrapper", "container", "block", "inner", "links", "list", "item", "items", "slot", "unit",
    "section", "area", "button", "buttons", "form", "text", "message", "policy", "icon", "icons", "media", "content", "widget", "posts", "articles", "stories", "mobile", "desktop",
}
#: Elements that hold a page's text, whatever their classes say (but for an article in an article).
HOLDERS = {"html", "body", "main", "article"}
#: Elements of running text: inside an article their class doesn't make them chrome, and a button in one is a word of it.
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption", "caption"}
#: Names that say nothing of a part inside an article, and names of comments, which compounds with any other part keep.
VAGUE_NAMES = {"legal", "copyright", "notice", "notices", "side", "header", "banner"}
COMMENT_NAMES = {"comment", "comments", "replies", "disqus"}
STATE_NAMES = {"has", "no", "with", "without", "open", "closed", "enabled", "disabled", "allow"}

# What stands in a tag; a quoted value may hold a closing bracket.
_INSIDE = r"""(?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea)\b{_INSIDE}>.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?]{_INSIDE}(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9-]*)")
_MARKED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")


def _is_chrome_name(name: str) -> bool:
    """A name of the list, or a compound of such names and neutral ones (site-header, but not post-header or has-sidebar); of comments, any compound."""
    parts = _PART.findall(name)
    if name in CHROME_NAMES or any(p in COMMENT_NAMES for p in parts) and not any(p in STATE_NAMES for p in parts):
        return True
    return any(p in CHROME_NAMES and p not in NEUTRAL_NAMES for p in parts) and all(p in CHROME_NAMES or p in NEUTRAL_NAMES for p in parts)


def _is_comment(tag: str) -> bool:
    return any(m[1].lower() in ("class", "id") and any(p in COMMENT_NAMES for p in _PART.findall((m[2] or "").lower())) for m in _MARKED.finditer(tag))


def _is_chrome(tag: str, inside: bool = False) -> bool:
    """Does a tag's class, id or role name chrome? Inside an article, vague names don't."""
    for m in _MARKED.finditer(tag):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id") and any(_is_chrome_name(v) and not (inside and v in VAGUE_NAMES) for v in value.split()):
            return True
        if name == "role" and value in CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def _gives(tag: str, token: str, depth: Counter[str], running: bool) -> str:
    """The role that an element gives to what is in it: skipped, chrome by its kind, named by its class, main, inner (main in a named one), or none."""
    inside = depth["main"] > 0 or depth["inner"] > 0
    named = "named inside" if depth["inner"] else "named"
    if tag in SKIPPED:
        return "skipped"
    if tag in MAIN:
        return named if inside and _is_comment(token) else "inner" if depth["named"] else "main"
    if tag in CHROME and not (tag == "header" and inside and not _is_chrome(token)):  # an article's own heading is none
        return "chrome"
    if tag == "button":
        return "" if running else "chrome"
    if tag in HOLDERS or inside and tag in RUNNING and not _is_comment(token):
        return ""
    return named if _is_chrome(token, inside) else ""


def blocks_of(page: str | None) -> list[tuple[str, str]]:
    """(role, text) of each block in page order; the role is main, chrome or open.

    An article in an element whose class names chrome is main where the page has no other article, and holds more than the main elements do: such names are often a layout's.
    """
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []  # element, role it gives
    depth: Counter[str] = Counter()  # open elements and roles, so that a tag costs the same at any depth
    role = "open"

    def leave() -> str:
        tag, gives = stack.pop()
        depth.subtract((f"<{tag}", gives, "running" if tag in RUNNING else ""))
        return tag

    def close() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((role, text))
            held.clear()

    for m in _TOKEN.finditer(page or ""):
        token = m[0]
        if token[0] != "<" or len(token) == 1:
            if not depth["skipped"]:
                held.append(entities.unescape(token) if "&" in token else token)
            continue
        name = _NAME.match(token)
        if m[1] or name is None or token[-1] != ">":
            continue  # comments, skipped elements, declarations and unfinished tags
        tag = name[1].lower()
        if tag in BLOCKS or tag in CHROME or tag in MAIN or tag == "button" and not depth["running"]:
            close()
        elif tag == "br":
            held.append(" ")
        if token[1] == "/":
            if depth[f"<{tag}"]:
                while leave() != tag:
                    pass
        elif tag not in VOID and token[-2] != "/":
            if tag == "p" and stack and stack[-1][0] == "p":
                leave()
            gives = _gives(tag, token, depth, depth["running"] > 0)
            if gives and held and tag not in SKIPPED:
                close()  # an inline element with a role of its own
            stack.append((tag, gives))
            depth.update((f"<{tag}", gives, "running" if tag in RUNNING else ""))
        now = "chrome" if depth["chrome"] or depth["named inside"] else "inner" if depth["inner"] else "chrome" if depth["named"] else "open" if not depth["main"] else "article" if depth["<article"] else "main"
        if now != role:
            close()
        role = now
    close()
    size = Counter[str]()
    for r, text in out:
        size[r] += len(text)
    inner = "main" if size["inner"] > size["main"] and not size["article"] else "chrome"
    return [({"inner": inner, "article": "main"}.get(r, r), text) for r, text in out]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by prefix doubling, and the ranks after the last round (equal ranks: equal first words)."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < REPEAT_WORDS:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 2) + second + 1
        order = np.argsort(key, kind="stable")
        same = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(same[1:] != same[:-1])])
        k *= 2
    return order, rank


def _code(word: str, known: dict[str, int]) -> int:
    got = known.get(word)
    if got is None:
        got = known[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return got


def _names(codes: np.ndarray, at: np.ndarray, host: np.ndarray) -> np.ndarray:
    """A 64-bit name of the REPEAT_WORDS words from each place on, the same in every task; hosts have names of their own."""
    out = host.astype(np.uint64)
    for i in range(REPEAT_WORDS):
        out = (out ^ codes[at + i]) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _streams(hosts: list[str], pages: list[list], roles: tuple[str, ...], known: dict[str, int]) -> tuple[np.ndarray, ...]:
    """The pages' blocks of some roles as one token stream, with a separator after each block, and where its whole runs begin.

    Gives tokens, each one's page, block, code and openness, the first separator, and the starts.
    """
    words: dict[tuple[str, str], int] = {}
    tokens, codes, page, block, is_open = [], [], [], [], []
    for p, (host, blocks) in enumerate(zip(hosts, pages)):
        for b, x in enumerate(blocks):
            if x["role"] in roles:
                part = x["text"].split()
                part += [""] * (REPEAT_WORDS - len(part))  # a short block is one run, filled up
                tokens += [words.setdefault((host, w), len(words)) for w in part]
                codes += [_code(w, known) for w in part]
                tokens.append(-1), codes.append(0)
                n = len(part) + 1
                page += [p] * n
                block += [b] * n
                is_open += [x["role"] == "open"] * n
    out = np.array(tokens, dtype=np.int64)
    ends = np.flatnonzero(out < 0)
    out[ends] = len(words) + np.arange(len(ends))
    blank = np.concatenate([[0], np.cumsum(out >= len(words))])
    last = max(0, len(out) - REPEAT_WORDS + 1)
    starts = np.flatnonzero(blank[REPEAT_WORDS: REPEAT_WORDS + last] == blank[:last])
    return out, np.array(page, dtype=np.int64), np.array(block, dtype=np.int64), np.array(codes, dtype=np.uint64), np.array(is_open, dtype=bool), starts


def shard_runs(hosts: list[str], pages: list[list], roles: tuple[str, ...], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the distinct runs of REPEAT_WORDS words of a shard, the pages with the run in an open block, and the other pages with it.

    Equal runs are neighbours in the suffix array; each of a run's pages counts once.
    """
    tokens, page, _, codes, is_open, starts = _streams(hosts, pages, roles, known)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, rank = suffix_array(tokens)
    whole = np.zeros(len(tokens), dtype=bool)
    whole[starts] = True
    at = order[whole[order]]
    pair, which = np.unique(rank[at] * len(pages) + page[at], return_inverse=True)
    opens = np.bincount(which, weights=is_open[at], minlength=len(pair)) > 0
    first = np.full(len(pair), len(tokens))
    np.minimum.at(first, which, at)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(pair // len(pages)) > 0]))
    places = first[heads]
    own = np.array([_code(h, known) for h in hosts], dtype=np.uint64)[page[places]]
    return _names(codes, places, own), np.add.reduceat(opens.astype(np.int64), heads), np.add.reduceat((~opens).astype(np.int64), heads)


def _counted(roles: tuple[str, ...], column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[str, int] = {}
            for lo in range(0, len(batch), SHARD_PAGES):
                part = batch.iloc[lo: lo + SHARD_PAGES]
                names, opens, others = shard_runs(part["host"].tolist(), part["blocks"].tolist(), roles, known)
                n = opens if column == "open" else others
                yield pd.DataFrame({"run": names[n > 0], "n": n[n > 0]})

    return run


def _open_runs(hosts: list[str], pages: list[list]) -> list[list[int]]:
    """The distinct runs in each page's open blocks."""
    known: dict[str, int] = {}
    out = []
    for host, blocks in zip(hosts, pages):
        _, _, _, codes, _, starts = _streams([host], [blocks], ("open",), known)
        out.append(np.unique(_names(codes, starts, np.full(len(starts), _code(host, known), np.uint64))).tolist())
    return out


def clean_page(host: str, blocks: list, repeats: list[int] | None) -> str:
    """The main text of a page, from its blocks and the repeated runs of its open ones."""
    gone: set[int] = set()
    if repeats:
        known: dict[str, int] = {}
        tokens, _, block, codes, _, starts = _streams([host], [blocks], ("open",), known)
        hit = starts[np.isin(_names(codes, starts, np.full(len(starts), _code(host, known), np.uint64)), np.array(repeats, dtype=np.int64))]
        cover = np.zeros(len(tokens) + 1, dtype=np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + REPEAT_WORDS, -1)
        covered = np.cumsum(cover)[:-1] > 0
        words, of = np.bincount(block) - 1, np.bincount(block, weights=covered)
        gone = {b for b in np.unique(block).tolist() if words[b] >= 1 and of[b] >= COVERED * words[b]}
    return "\n\n".join(x["text"] for b, x in enumerate(blocks) if x["role"] == "main" or x["role"] == "open" and b not in gone)


def _semi(runs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(row, run) whose run is in ``repeated`` (run, n). Runs of very many pages meet them by broadcast, so no task gets one run's pages."""
    if repeated.count() <= BROADCAST_ROWS:
        return runs.join(F.broadcast(repeated), "run", "left_semi")
    heavy = F.col("n") > HEAVY_PAGES
    return runs.join(repeated.where(~heavy), "run", "left_semi").unionByName(runs.join(small(repeated.where(heavy)), "run", "left_semi"))


def _without_repeats(parsed: DataFrame) -> DataFrame:
    """One row of each group of equal pages of a host; only digests of pages are shuffled for that, and only the further rows' numbers are joined."""
    digest = [F.xxhash64("host", "blocks").alias("d1"), F.xxhash64(F.lit(1), "host", "blocks").alias("d2")]
    groups = parsed.select("row", *digest).groupBy("d1", "d2").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    further = stored(parsed.select("row", *digest).join(small(stored(groups, "equal-pages")), ["d1", "d2"]).where(F.col("row") != F.col("first")).select("row"), "further-pages")
    return parsed if further.isEmpty() else parsed.join(small(further), "row", "left_anti")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Pages are read once, in shards as they lie, and their blocks are stored. Each shard's
    suffix array gives its runs of words with their numbers of pages; the sums over all
    shards of a host say which runs are repeated, whatever the host's size. Only runs of
    open blocks can decide anything, so others are counted only where they may add to those.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z]+://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    read = per_row(rows, ["html"], [StructField("blocks", BLOCKS_TYPE)], lambda: lambda html: ([[{"role": r, "text": t} for r, t in blocks_of(h)] for h in html],))
    parsed = stored(read.drop("html").withColumn("row", F.monotonically_increasing_id()), "pages")
    loose = F.exists("blocks", lambda b: b["role"] == "open")
    mixed = parsed.where(loose)
    runs = "run long, n long"
    counted = _without_repeats(parsed) if not mixed.isEmpty() else parsed
    opened = stored(counted.where(loose).select("host", "blocks").mapInPandas(_counted(("open",), "open"), runs).groupBy("run").agg(F.sum("n").alias("n")), "open-runs")
    # Pages that have the run, but not in an open block, count for runs that lack pages.
    lacking = opened.where(F.col("n") < REPEAT_PAGES)
    repeated = opened.where(F.col("n") >= REPEAT_PAGES)
    if not lacking.isEmpty():
        others = counted.select("host", "blocks").mapInPandas(_counted(("open", "main", "chrome"), "other"), runs).groupBy("run").agg(F.sum("n").alias("more"))
        found = others.join(small(lacking), "run").where(F.col("n") + F.col("more") >= REPEAT_PAGES)
        repeated = stored(repeated.unionByName(found.select("run", "n")), "repeated-runs")
    each = per_row(mixed.select("row", "host", "blocks"), ["host", "blocks"], [StructField("runs", ArrayType(LongType()))], lambda: lambda h, b: (_open_runs(h, b),)).select("row", F.explode("runs").alias("run"))
    hits = stored(_semi(each, repeated).groupBy("row").agg(F.collect_list("run").alias("repeats")), "repeats")
    told = mixed.join(small(hits), "row", "left").unionByName(parsed.where(~loose).withColumn("repeats", F.lit(None).cast("array<bigint>")))
    out = per_row(told, ["host", "blocks", "repeats"], [StructField("text", StringType())], lambda: lambda h, b, r: ([clean_page(*x) for x in zip(h, b, r)],))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
