"""Main text of web pages: markup rules for the page's parts, a host suffix array for its boilerplate.

Each page is cut into blocks by its markup. Scripts, styles, menus, headers, footers, sidebars,
notices, adverts, forms and reader comments go by element, role, class, id and hidden state;
where an article or main element exists, only what is in it counts, else blocks that are mostly
link text go too.

What the markup doesn't tell, the host does: the token streams of a host's pages, block ends
included, are concatenated; a suffix array over them, by prefix doubling to full depth, and its
common prefixes give for every place the longest substring from there on that stands on another
page too, and what such substrings of MIN_TOKENS tokens or more cover is repeated. A block that
is repeated as a whole, that stands on MIN_PAGES pages or more and on at least MIN_SHARE of the
host's pages, is boilerplate and removed. So is, inside of blocks and over their ends, every run of RUN_TOKENS
tokens or more that stands on so many pages: windows over the array's order with so many different
pages give for every place the longest such run, and pages lose the tokens these cover; unique runs stay.
Pages with the same blocks count as one page, and for runs also pages of which NEAR percent of the five-token shingles are
those of one other page, so copies are no evidence of boilerplate.

A host with many pages is spread over shards of about SHARD pages by a hash of the blocks, so
equal pages meet, the shards' page counts add up to those of the host, and no task holds a whole
large host. The rule doesn't depend on the shards: what is on half of the pages of a host is on half of those of some shard,
where the array finds it; the runs so found are then counted in all shards.

Null and empty pages have empty text. A page without a host is of the host ''. Repeated rows
count as one page. Ties don't arise: every rule is a threshold. Only ``page_id``, ``url`` and
``html`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .op1_suffix import RangeMin

MIN_TOKENS = 4
MIN_PAGES = 3
MIN_SHARE = 0.5
RUN_TOKENS = 8
NEAR = 80
SHARD = 500
#: Pages a task remembers having sent.
SEEN = 200_000
SALTS = 16
LINK_SHARE = 0.6

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "fieldset", "dialog", "menu", "audio", "video", "datalist"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
DROPPED_NAMES = set(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond widget toolbar pagination pager login search skip hidden copyright legal disclaimer topbar".split()
)
CONTENT_NAMES = {"article", "post", "entry", "story"}
#: An open paragraph ends where one of these begins; a list item, row or cell where its like begins.
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "dl", "table", "select"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|\Z)""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _junk(name: str, attrs: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not attrs or attrs.isspace():
        return False
    names: set[str] = set()
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower() if m[1].lower() not in ("class", "id") else (m[2] or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if key == "role" and value in DROPPED_ROLES:
            return True
        if key in ("class", "id"):
            names.update(x.lower() for x in NAME.findall(value))
    if name in ("html", "body", "main"):
        return False
    return bool(names & DROPPED_NAMES) or ("header" in names and not in_article and not names & CONTENT_NAMES)


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """(text, from an article or main element) of the blocks that the markup doesn't rule out, in page order."""
    if not page:
        return []
    out: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, article
    text: list[str] = []
    links = 0

    def end_block() -> None:
        nonlocal links
        if text:
            s = " ".join(entities.unescape("".join(text)).split())
            if s:
                out.append((s, bool(stack) and stack[-1][2], links))
            text.clear()
        links = 0

    at, in_link = 0, 0
    while True:
        m = TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not (stack and stack[-1][1]):
            text.append(piece)
            if in_link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if name not in INLINE:
                end_block()
            if k >= 0:
                del stack[k:]
            if name == "a":
                in_link = 0
            continue
        if name not in INLINE or name == "br":
            end_block()
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in VOID:
            continue
        if name in ENDS_P:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), -1)
            if k >= 0 and all(x[0] in INLINE for x in stack[k + 1 :]):
                del stack[k]
        elif name in LIKE:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in HOLDERS:
                    break
                if stack[i][0] in LIKE[name]:
                    del stack[i:]
                    break
        dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        attrs = m[3] or m[6] or ""
        if name == "body":
            stack = [x for x in stack if x[0] != "head"]
            dropped = article = False
        if not dropped and _junk(name, attrs, article):
            dropped = True
        article = article or name in ("article", "main") or 'role="main"' in attrs
        if name == "a":
            in_link = 1
        if not (attrs.endswith("/") and name not in INLINE and attrs.strip() == "/"):
            stack.append((name, dropped, article))
    end_block()
    if any(a for _, a, _ in out):
        return [(s, True) for s, a, _ in out if a]
    return [(s, False) for s, _, k in out if k <= LINK_SHARE * len(s)]


class SuffixArray:
    """Suffixes of a stream of integers in order, and the common prefixes of neighbours, by prefix doubling."""

    def __init__(self, stream: np.ndarray):
        n = len(stream)
        rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
        ranks, h = [rank], 1
        while rank.max(initial=0) < n - 1:
            after = np.full(n, -1, np.int64)
            after[: n - h] = rank[h:]
            rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
            ranks.append(rank)
            h *= 2
        self.order = np.argsort(rank)
        # common[i]: of suffixes i - 1 and i; equal ranks after k doublings mean 2 ** k equal places
        self.common = np.zeros(n, np.int64)
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
            step = same.astype(np.int64) << k
            self.common[1:] += step
            a += step
            b += step

    def shared(self, owner: np.ndarray) -> np.ndarray:
        """For each place, the length of the longest substring from there that another owner has too."""
        who, n = owner[self.order], len(self.order)
        lowest = RangeMin(self.common)
        new = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        run = np.cumsum(np.concatenate([[0], (who[1:] != who[:-1]).astype(np.int64)]))
        first, end, at = new[run], np.append(new[1:], n)[run], np.arange(n)
        best = np.zeros(n, np.int64)
        # the nearest suffix of another owner stands right before or right after the run of one's own
        before, after = np.flatnonzero(first > 0), np.flatnonzero(end < n)
        best[before] = lowest.query(first[before], at[before] + 1)
        best[after] = np.maximum(best[after], lowest.query(at[after] + 1, end[after] + 1))
        out = np.empty(n, np.int64)
        out[self.order] = best
        return out


    def shared_by(self, owner: np.ndarray, count: int) -> np.ndarray:
        """For each place, the length of the longest substring from there that ``count`` owners have, two at least."""
        who, n = owner[self.order].tolist(), len(self.order)
        held, distinct, low, left = [0] * (max(who, default=0) + 1), 0, 0, np.full(n, -1, np.int64)
        for r, c in enumerate(who):
            held[c] += 1
            distinct += held[c] == 1
            while distinct > count or (distinct == count and held[who[low]] > 1):
                held[who[low]] -= 1
                distinct -= held[who[low]] == 0
                low += 1
            if distinct == count:
                left[r] = low
        out, valid = np.zeros(n, np.int64), np.flatnonzero(left >= 0)
        if not len(valid):
            return out
        # a window's owners share its least common prefix; a suffix takes the best of the windows it is in, and of the one it begins
        value, lowest = np.zeros(n, np.int64), RangeMin(self.common)
        value[valid] = lowest.query(left[valid] + 1, valid + 1)
        at = np.arange(n)
        first, last = np.maximum(at, valid[0]), valid[0] + np.searchsorted(left[valid[0] :], at, side="right")
        inside = last > first
        best = np.zeros(n, np.int64)
        best[inside] = -RangeMin(-value).query(first[inside], last[inside])
        to = valid[0] + np.searchsorted(left[valid[0] :], at, side="left")
        begins = np.flatnonzero((to < n) & (to > at))
        best[begins] = np.maximum(best[begins], lowest.query(begins + 1, to[begins] + 1))
        out[self.order] = best
        return out


class Host:
    """The pages' tokens in a row, 0 before and after every block and a mark of its own before each page, and their suffix array."""

    def __init__(self, pages: list[list[list[int]]]):
        flat: list[int] = []
        owner: list[int] = []
        block: list[int] = []
        k = 0
        for p, page in enumerate(pages):
            before = len(flat)
            flat.append(-1 - p)
            block.append(-1)
            for b in page:
                flat += [0, *b]
                block += [-1] + [k] * len(b)
                k += 1
            flat.append(0)
            block.append(-1)
            owner += [p] * (len(flat) - before)
        self.pages, self.blocks = pages, k
        self.flat, self.owner, self.block = (np.array(v, np.int64) for v in (flat, owner, block))
        self.array = SuffixArray(self.flat)
        #: For each place, the longest substring from there that another page has too.
        self.length = self.array.shared(self.owner)


def near_groups(pages: list[list[list[int]]], near: int = NEAR) -> np.ndarray:
    """For each page, the number of its group: pages that share ``near`` percent of their five-token shingles are one."""
    sets = []
    for page in pages:
        t = [x for b in page for x in b]
        sets.append(set(zip(*(t[k:] for k in range(5)))) if len(t) >= 5 else {tuple(t)})
    group = list(range(len(pages)))

    def top(x: int) -> int:
        while group[x] != x:
            x = group[x]
        return x

    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    for n, i in enumerate(order):
        for j in reversed(order[:n]):
            if 100 * len(sets[j]) < near * len(sets[i]):
                break
            if top(i) != top(j):
                both = len(sets[i] & sets[j])
                if 100 * both >= near * (len(sets[i]) + len(sets[j]) - both):
                    group[top(i)] = top(j)
    return np.unique([top(i) for i in range(len(pages))], return_inverse=True)[1]


def repeated_runs(host: Host, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, least: int = RUN_TOKENS) -> tuple[dict[tuple[int, ...], int], int]:
    """The longest runs (tokens, 0 at block ends) of ``least`` tokens on enough groups of pages, with their numbers of groups; and the number of groups."""
    pages, flat, owner = host.pages, host.flat, host.owner
    # a run is on enough pages only if so many have any that another page has too
    if len(np.unique(owner[host.length >= least])) < max(2, min_pages, math.ceil(min_share * len(pages))):
        return {}, len(pages)
    array, groups = host.array, np.arange(len(pages))
    found: dict[tuple[int, ...], int] = {}
    # copies are only looked for where there is something to find
    for groups in (groups, None):
        if groups is None:
            groups = near_groups(pages)
        n = int(groups.max()) + 1
        enough = max(2, min_pages, math.ceil(min_share * n))
        length = array.shared_by(groups[owner], enough) if enough <= n else np.zeros(len(flat), np.int64)
        end = np.arange(len(flat)) + length
        starts = np.flatnonzero((length >= least) & (end > np.concatenate([[-1], end[:-1]])))
        if not len(starts):
            return {}, n
    for i in starts.tolist():
        run = flat[i : int(end[i])].tolist()
        while run and run[0] == 0:
            run.pop(0)
        while run and run[-1] == 0:
            run.pop()
        if len(run) - run.count(0) >= least:
            found[tuple(run)] = 0
    return {run: len({int(groups[p]) for p in range(len(pages)) if _places([run], pages[p])}) for run in found}, n


def _places(runs: list[tuple[int, ...]], page: list[list[int]]) -> list[tuple[int, int]]:
    """Where runs stand in a page's blocks put in a row, each with a 0 before it: (start, end)."""
    stream = [x for b in page for x in (0, *b)]
    by_head: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
    for run in runs:
        by_head.setdefault(run[:4], []).append(run)
    return [(i, i + len(run)) for i in range(len(stream) - 3) for run in by_head.get(tuple(stream[i : i + 4]), ()) if tuple(stream[i : i + len(run)]) == run]


def _tokens(text: str) -> list[int]:
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) + 1 for t in text.split()]


def without(texts: list[str], runs: list[tuple[int, ...]]) -> list[str]:
    """The blocks without what the runs cover; white space as it was in blocks that lose nothing."""
    page = [_tokens(t) for t in texts]
    covered = np.zeros(sum(len(b) + 1 for b in page) + 1, bool)
    for a, b in _places(runs, page):
        covered[a:b] = True
    out, at = [], 0
    for text, b in zip(texts, page):
        gone = covered[at + 1 : at + 1 + len(b)]
        out.append(" ".join(t for t, g in zip(text.split(), gone.tolist()) if not g) if gone.any() else text)
        at += len(b) + 1
    return out


def repeated_blocks(host: Host, min_tokens: int = MIN_TOKENS) -> np.ndarray:
    """For each block of each page in a row: whether substrings that stand on other pages too cover it."""
    at = np.arange(len(host.flat))
    covered = np.maximum.accumulate(np.where(host.length >= min_tokens, at + host.length, 0)) > at
    tokens = host.block >= 0
    return np.bincount(host.block[tokens], minlength=host.blocks) == np.bincount(host.block[tokens & covered], minlength=host.blocks)


def _key(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw)


def host_of(url: Column | str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def boilerplate(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, shard: int = SHARD) -> DataFrame:
    """(host, gone array<long>, runs array<array<long>>): keys of the blocks and token runs that are boilerplate of a host."""

    def make():
        seen: set[tuple[str, bytes]] = set()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = [s for s, _ in blocks(page)]
                content = hashlib.blake2b("\n".join(got).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                if (host, content) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((host, content))
                out.append((host, int.from_bytes(content, "little", signed=True), got))
            return C.records(["host", "content", "blocks"], list(zip(*out)) or [[], [], []], [pa.string(), pa.int64(), pa.list_(pa.string())])

        return work

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pages with each block, and whether the block is repeated; under key null the pages of the shard."""
        pdf = pdf.drop_duplicates("content")
        keys = np.array([_key(s) for p in pdf["blocks"] for s in p], np.int64)
        owner = np.repeat(np.arange(len(pdf)), [len(p) for p in pdf["blocks"]])
        streams = [[_tokens(s) for s in p] for p in pdf["blocks"]]
        host = Host(streams)
        runs, groups = repeated_runs(host, min_pages, min_share)
        got = pd.DataFrame({"key": keys, "page": owner, "repeated": repeated_blocks(host)}).groupby("key", as_index=False).agg(pages=("page", "nunique"), repeated=("repeated", "any"))
        out = pd.concat([pd.DataFrame({"key": pd.array([None], "Int64"), "pages": [len(pdf)], "repeated": [False]}), got.astype({"key": "Int64"})])
        more = pd.DataFrame({"key": pd.array([None] * (len(runs) + 1), "Int64"), "pages": [groups, *runs.values()], "repeated": True, "run": [[], *map(list, runs)]})
        return pd.concat([out.assign(run=None), more]).assign(host=pdf["host"].iloc[0])[["host", "key", "pages", "repeated", "run"]]

    def recount(pages_: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        """In how many groups of a shard's pages each run of the host is."""
        if not len(runs) or not len(pages_):
            return pd.DataFrame({"host": [], "run": [], "pages": []})
        streams = [[_tokens(s) for s in p] for p in pages_.drop_duplicates("content")["blocks"]]
        groups = near_groups(streams)
        number = [len({int(groups[p]) for p, page in enumerate(streams) if _places([tuple(run)], page)}) for run in runs["run"]]
        return pd.DataFrame({"host": runs["host"], "run": runs["run"], "pages": number})

    scratch = C.Scratch(pages.sparkSession, "html-hosts")
    named = pages.select(host_of("url").alias("host"), "html")
    # only large hosts are spread; there are few of them, so texts are shuffled once, not for this join
    large = scratch.save(named.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > shard).select("host", F.ceil(F.col("n") / shard).alias("shards")))
    sent = C.map_rows(named, make, "host string, content long, blocks array<string>")
    dealt = sent.join(large, "host", "left").withColumn("shard", F.pmod("content", F.coalesce("shards", F.lit(1)))).drop("shards")
    counts = scratch.save(dealt.groupBy("host", "shard").applyInPandas(count, "host string, key long, pages long, repeated boolean, run array<long>"))
    sizes = counts.where("key is null and run is null").groupBy("host").agg(F.sum("pages").alias("all"))
    found = counts.where("key is not null").groupBy("host", "key").agg(F.sum("pages").alias("pages"), F.max("repeated").alias("repeated")).where(F.col("repeated") & (F.col("pages") >= min_pages))
    # a host has few of these: each stands on a good share of its pages
    gone = found.join(sizes, "host").where(F.col("pages") >= F.col("all") * min_share).groupBy("host").agg(F.collect_set("key").alias("gone"))
    # runs of hosts in one shard are counted already, those of spread hosts in all their shards
    runs = scratch.save(counts.where(F.size("run") > 0).join(large, "host", "left").select("host", "shards", "run", "pages"))
    if runs.isEmpty():
        return gone.withColumn("runs", F.lit(None).cast("array<array<long>>"))
    groups = counts.where("key is null and size(run) = 0").groupBy("host").agg(F.sum("pages").alias("groups"))
    spread = runs.where("shards is not null").select("host", "run", "shards").distinct().select("host", "run", F.explode(F.sequence(F.lit(0), F.col("shards") - 1).cast("array<long>")).alias("shard"))
    again = dealt.join(spread.select("host").distinct(), "host", "left_semi").groupBy("host", F.col("shard").cast("long").alias("shard")).cogroup(spread.groupBy("host", "shard")).applyInPandas(recount, "host string, run array<long>, pages long")
    total = runs.where("shards is null").select("host", "run", "pages").unionByName(again).groupBy("host", "run").agg(F.sum("pages").alias("pages"))
    total = total.join(groups, "host").where((F.col("pages") >= min_pages) & (F.col("pages") >= F.col("groups") * min_share)).groupBy("host").agg(F.collect_list("run").alias("runs"))
    return gone.join(total, "host", "full_outer")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, shard: int = SHARD) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    scratch = C.Scratch(pages.sparkSession, "html")
    kind = pages.schema["page_id"].dataType.simpleString()

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            kept = []
            for page, gone, runs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                gone = set(gone or ())
                texts = [s for s, _ in blocks(page)]
                left = without(texts, [tuple(r) for r in runs]) if runs else texts
                kept.append(" ".join(x for s, x in zip(texts, left) if x and (not gone or _key(s) not in gone)))
            return C.records(["page_id", "url", "text"], [b.column(0), b.column(1), kept], [None, None, pa.string()])

        return work

    # pages are cut anew here: that costs less than keeping all texts a second time
    gone = scratch.save(boilerplate(pages, min_pages, min_share, shard).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    done = pages.select("page_id", "url", "html").withColumn("host", host_of("url")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(gone, ["host", "salt"], "left")
    return C.map_rows(done.select("page_id", "url", "html", "gone", "runs"), make, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.read(spark, sf_dir, "pages"))
