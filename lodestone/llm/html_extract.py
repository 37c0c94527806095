"""Main text of web pages by page structure and host-wide suffix arrays.

Structure splits a page into the blocks of its article (or, where it names none, all that is not marked as something else) and the
rest, its frame. Class and id names that only hold a word for such things put a block in doubt. The token streams of a host's pages,
frames and doubtful blocks everywhere and the whole of pages without an article, are laid end to end; their suffix array and its common
prefixes give the runs that several distinct pages share: boilerplate. Doubtful blocks and pages without an article lose it; unique
runs stay. A host of any size is dealt to as many arrays as its tokens need, and runs around an anchor too frequent for an array are counted.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import cut, releasing, slices, table

#: Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside form head template svg button select dialog menu object canvas audio video math datalist".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class and id that name what is no article.
CHROME = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus replies respond related recommended share sharing social widget pagination pager toolbar search".split())
#: Words that say nothing of what an element holds. A name of these and of CHROME alone is as sure as a single word.
PLAIN = frozenset("area article bar block blog body bottom box button buttons btn col column component container content element entry field foot form global group head heading icon icons inner item items js label left link links list lists main module new outer page panel post primary reader readers right row secondary section site slot story text thread title top unit user users view wrap wrapper zone".split())
#: Elements that are text of their own, which no name alone takes out of an article.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile(r">|=\s*+([\"'])")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Za-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NEEDED = re.compile(r"class|id|role|hidden", re.I)


def _is_hidden(attributes: str) -> bool:
    if not _NEEDED.search(attributes):
        return False
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
    return False


def _chrome(tag: str, attributes: str) -> int:
    """Whether class or id names what is no article: 2 surely, 1 perhaps, as the name has other words or its element is text; 0 if not.

    That says nothing of an element that is or holds an article.
    """
    if not _NEEDED.search(attributes):
        return 0
    found = 0
    for attribute, *values in _NAMED.findall(attributes):
        for name in "".join(values).split() if attribute.lower() in ("class", "id") else ():
            words = [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name))]
            if any(w in CHROME for w in words):
                sure = all(w in CHROME or w in PLAIN or w.isdigit() or len(w) == 1 for w in words)
                found = max(found, 2 if sure and tag not in TEXTUAL else 1)
    return found


def _is_main(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or "role" in attributes and any(n.lower() == "role" and "".join(v).lower() == "main" for n, *v in _NAMED.findall(attributes))


def _tags(page: str) -> Iterator[tuple[int, int, int, str, str]]:
    """(start, end, kind, tag, attributes) of markup in order, in one pass; kind 1 opens, -1 closes, 0 neither. A quote or comment may be of any length."""
    last = {q: page.rfind(q) for q in "\"'>"}
    at = page.find("<")
    while at >= 0:
        start, at = at, at + 1
        if page.startswith("!--", at):
            short = page.startswith((">", "->"), at + 3)
            end = page.find(">" if short else "-->", at + 3)
            at = len(page) if end < 0 else end + (1 if short else 3)
            yield start, at, 0, "", ""
        elif page.startswith(("!", "?"), at) or page.startswith("/", at) and not _NAME.match(page, at + 1):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            yield start, at, 0, "", ""
        elif m := _NAME.match(page, at + page.startswith("/", at)):
            closes, tag, pos = page[at] == "/", m[0].lower(), m.end()
            while pos <= last[">"] and (stop := _STOP.search(page, pos)) and stop[1]:
                # without a closing quote it is a character like any other
                pos = page.find(stop[1], stop.end()) + 1 if stop.end() <= last[stop[1]] else stop.end()
            if pos > last[">"]:
                return  # no tag ends from here on
            attributes, at = page[m.end() : stop.start()], stop.end()
            if not closes and tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                end = page.find(">", end.end()) if end else -1
                at = end + 1 if end >= 0 else len(page)
                yield start, at, 0, tag, ""
            else:
                yield start, at, 0 if tag in VOID else -1 if closes else 1, tag, "" if closes else attributes
        at = page.find("<", at)


def blocks(page: str) -> tuple[list[str], bool, list[str]]:
    """(texts of the page's main blocks in order, whether they are those of its article or main element, texts of its frame)."""
    return parts(page)[:3]


def parts(page: str) -> tuple[list[str], bool, list[str], list[int]]:
    """blocks(page), and which of the main blocks a name puts in doubt; other pages of the host tell whether they are boilerplate.

    An element that drops its content counts only where it is closed; one that is not, as in a page cut short,
    drops nothing but its tag. Scripts and the like run to their end tag, or else to the end of the page.
    """
    tokens = list(_tags(page))
    close_of, opened = {}, {}
    for i, (_, _, kind, tag, _) in enumerate(tokens):
        if kind == 1:
            opened.setdefault(tag, []).append(i)
        elif kind == -1 and opened.get(tag):
            close_of[opened[tag].pop()] = i
    mains = [k for k, (_, _, kind, tag, attributes) in enumerate(tokens) if kind == 1 and _is_main(tag, attributes)]
    holds_main = lambda k: (at := bisect_left(mains, k)) < len(mains) and mains[at] < close_of[k]
    out: dict[str, list[str]] = {"main": [], "plain": [], "frame": []}
    doubtful: dict[str, list[int]] = {"main": [], "plain": [], "frame": []}
    main_until, frame_until, doubt_until, any_main, last = -1, -1, -1, False, 0
    current: list[str] = []

    def end_block() -> None:
        if current:
            if text := " ".join(html.unescape("".join(current)).split()):
                to = "frame" if frame_until >= 0 else "main" if main_until >= 0 else "plain"
                if doubt_until >= 0:
                    doubtful[to].append(len(out[to]))
                out[to].append(text)
            current.clear()

    for i, (start, end, kind, tag, attributes) in enumerate(tokens):
        if start > last:
            current.append(page[last:start])
        last = end
        if main_until >= 0 and i >= main_until:
            end_block()
            main_until = -1
        if doubt_until >= 0 and i >= doubt_until:
            end_block()
            doubt_until = -1
        named = _chrome(tag, attributes) if kind == 1 and attributes and frame_until < 0 and i in close_of and tag not in ("html", "body") and not holds_main(i) else 0
        if frame_until >= 0:
            if i >= frame_until:
                end_block()
                frame_until = -1
            elif tag == "br":
                current.append(" ")
            elif tag and tag not in INLINE:
                end_block()
        elif kind == 1 and i in close_of and (tag in DROPPED or attributes and _is_hidden(attributes) or named == 2) and tag not in ("html", "body"):
            end_block()
            frame_until = close_of[i]
        elif tag == "br":
            current.append(" ")
        elif tag and tag not in INLINE:
            end_block()
            if named and doubt_until < 0:
                doubt_until = close_of[i]
            if kind == 1 and main_until < 0 and _is_main(tag, attributes):
                main_until, any_main = close_of.get(i, len(tokens)), True
    current.append(page[last:])
    end_block()
    return (out["main"], True, out["plain"] + out["frame"], doubtful["main"]) if any_main else (out["plain"], False, out["frame"], doubtful["plain"])


def _suffixes(rank: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix and the one before it) of texts laid end to end, by doubling until no order is open.

    rank: of each place its symbol, 0 at the end of a text; left: tokens from a place to the end of its text. Suffixes that are equal up to
    the ends of their texts stand beside each other.
    """
    levels, width, classes = [(1, rank.astype(np.int32))], 1, int(rank.max(initial=0)) + 1
    at = np.arange(len(rank))
    while True:
        behind = np.minimum(at + width, at + left)  # the end of its text at most, whose rank is 0
        pair = rank.astype(np.int64) << 32
        pair |= rank[behind]
        _, rank = np.unique(pair, return_inverse=True)
        width *= 2
        n = int(rank.max(initial=0)) + 1
        if n == classes:
            levels[-1] = (len(rank), levels[-1][1])  # twice the width tells no more apart: what agrees so far agrees up to the end
            break
        levels.append((width, rank.astype(np.int32)))
        classes = n
    order = np.argsort(rank, kind="stable")
    # common prefixes from the widths at which both agree, the widest first
    i, j = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(order), np.int64)
    for width, r in reversed(levels):
        same = np.flatnonzero((r[i] == r[j]) & (r[i] > 0))
        step = np.minimum(width, left[i[same]])
        common[same + 1] += step
        i[same] += step
        j[same] += step
    return order, common


def shared_runs(hosts: np.ndarray, texts: list[list[str]], pages: list[list[int]], run: int, least: int) -> list[np.ndarray]:
    """For each text, the places where a run of `run` tokens starts that `least` distinct pages of its host have.

    hosts, pages: of each text its host and pages. The texts are laid end to end, with symbols of their host; suffixes whose common prefix
    is as long as a run, or reaches the ends of both texts, have the run in common. A text of fewer tokens is one run of its own length.
    """
    size = np.array([max(1, len(t)) for t in texts], np.int64)
    first = np.cumsum(size + 1) - size - 1
    n = int((size + 1).sum())
    number: dict[str, int] = {}
    rank = np.zeros(n, np.int64)  # 0 is the end of a text
    owner = np.repeat(np.arange(len(size)), size + 1)
    inside = np.arange(n) - first[owner]
    left = size[owner] - inside
    rank[left > 0] = [number.setdefault(w, len(number) + 1) for t in texts for w in t or [""]]
    _, rank = np.unique(rank + (len(number) + 1) * np.unique(hosts, return_inverse=True)[1][owner] * (rank > 0), return_inverse=True)
    order, common = _suffixes(rank, left)
    new = common < run
    new[1:] &= (common[1:] < left[order[1:]]) | (left[order[1:]] != left[order[:-1]])
    group = np.cumsum(new)
    starts = (inside < size[owner]) & (inside <= np.maximum(0, size[owner] - run))
    group, order = group[starts[order]], order[starts[order]]
    many = np.array([len(p) for p in pages], np.int64)[owner[order]]
    all_pages = np.concatenate([np.asarray(p, np.int64) for p in pages])
    page_from = np.cumsum([0] + [len(p) for p in pages])[owner[order]]
    at = np.repeat(page_from, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    seen = np.unique(np.stack([np.repeat(group, many), all_pages[at]], axis=1), axis=0)[:, 0]
    shared = np.zeros(int(group.max(initial=0)) + 1, bool)
    value, count = np.unique(seen, return_counts=True)
    shared[value[count >= least]] = True
    hit = np.sort(order[shared[group]])
    bounds = np.searchsorted(hit, np.append(first, n))
    return [inside[hit[bounds[i] : bounds[i + 1]]] for i in range(len(texts))]


def segments(words: list[str], run: int, gram: int = 4) -> Iterator[tuple[int, int, int]]:
    """(anchor, start, end) of stretches of a text of `run` tokens or more: all runs that start in one share its anchor, the smallest
    hash of the grams inside a run, so equal runs have equal anchors wherever they stand."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    g = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - gram + 1 + k]
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    low = np.lib.stride_tricks.sliding_window_view(g, run - gram + 1).min(1)
    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    for s, e in zip(new.tolist(), [*new[1:].tolist(), len(low)], strict=True):
        yield int(low[s]), s, e + run - 1


KEYS = ["host", "h1", "h2"]
#: A part of so many times an array's tokens holds an anchor that very many texts share; its runs are counted one by one instead.
HOT = 8
PART = "host long, part long, h1 long, h2 long, start int, pages array<long>, text string"


def boilerplate(streams: DataFrame, run: int, least: int, array_tokens: int, broadcast_rows: int) -> DataFrame:
    """(host, h1, h2, kept) of streams (host, page, h1, h2, text): texts of which runs that `least` pages share were cut out, with what is left."""
    once = streams.groupBy("page", *KEYS).agg(F.first("text").alias("text"))
    # Spark keeps the first `least` pages of a text in each partition before it shuffles, so a hot text is no hot task
    few = once.withColumn("k", F.row_number().over(W.partitionBy(*KEYS).orderBy("page"))).where(F.col("k") <= least)
    texts = cut(few.groupBy(*KEYS).agg(F.collect_list("page").alias("pages"), F.first("text").alias("text")))
    sizes = cut(texts.groupBy("host").agg(F.ceil(F.sum(F.size(F.split("text", " "))) / array_tokens).cast("long").alias("parts")).where("parts > 1"))
    large = sizes.count()
    sizes = F.broadcast(sizes) if large <= broadcast_rows else sizes
    dealt = texts.join(sizes, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            out = []
            for r in b.to_pylist():
                words = r["text"].split(" ")
                if r["parts"] == 1 or len(words) < run:
                    out.append((r["host"], r["h1"] % r["parts"], r["h1"], r["h2"], 0, r["pages"], r["text"]))
                else:
                    out += [(r["host"], a % r["parts"], r["h1"], r["h2"], s, r["pages"], " ".join(words[s:e])) for a, s, e in segments(words, run)]
            names = [c.split()[0] for c in PART.split(", ")]
            types = [pa.int64()] * 4 + [pa.int32(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            out = []
            for r in b.to_pylist():
                words = r["text"].split(" ")
                each = [" ".join(words[k : k + run]) for k in range(max(1, len(words) - run + 1))]
                out += [(r["host"], xxhash.xxh64_intdigest(w, 1) - (1 << 63), xxhash.xxh64_intdigest(w, 2) - (1 << 63), r["h1"], r["h2"], r["start"] + k, r["pages"]) for k, w in enumerate(each)]
            types = [pa.int64()] * 5 + [pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=["host", "w1", "w2", "h1", "h2", "at", "pages"])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, last = [], 0, None
        for b in _and_end(batches):
            for r in b.to_pylist() if b is not None else [None]:
                to = r and (r["host"], r["part"])
                # arrays of whole hosts (or a host's part), several small ones together
                if held and (r is None or to != last and tokens >= array_tokens // 8):
                    yield solve(held)
                    held, tokens = [], 0
                if r is not None:
                    r["words"] = r.pop("text").split(" ")
                    held.append(r)
                    tokens, last = tokens + len(r["words"]), to

    def solve(rows: list[dict]) -> pa.RecordBatch:
        hosts = np.array([r["host"] for r in rows], np.int64) ^ np.array([r["part"] for r in rows], np.int64) * np.int64(0x9E3779B1)
        found = shared_runs(hosts, [r["words"] for r in rows], [r["pages"] for r in rows], run, least)
        out = [(r["host"], r["h1"], r["h2"], (f + r["start"]).tolist()) for r, f in zip(rows, found, strict=True) if len(f)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, [pa.int64()] * 3 + [pa.list_(pa.int32())], strict=True)], names=[*KEYS, "starts"])

    n = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = dealt.select(*KEYS, "pages", "text", "parts").mapInArrow(releasing(deal), PART)
    found = None
    if large:
        hot = parted.groupBy("host", "part").agg(F.sum(F.size(F.split("text", " "))).alias("tokens")).where(F.col("tokens") > HOT * array_tokens)
        hot = cut(hot.select("host", "part"))
        if n_hot := hot.count():
            hot = F.broadcast(hot) if n_hot <= broadcast_rows else hot
            each = parted.join(hot, ["host", "part"]).select("host", "h1", "h2", "start", "pages", "text").mapInArrow(releasing(windows), "host long, w1 long, w2 long, h1 long, h2 long, at int, pages array<long>")
            own = each.select("host", "w1", "w2", F.explode("pages").alias("page")).distinct()
            own = own.withColumn("k", F.row_number().over(W.partitionBy("host", "w1", "w2").orderBy("page"))).where(F.col("k") <= least)
            shared = own.groupBy("host", "w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
            found = each.join(shared, ["host", "w1", "w2"]).groupBy(*KEYS).agg(F.collect_list("at").alias("starts"))
            parted = parted.join(hot, ["host", "part"], "left_anti").select(parted.columns)
    covers = parted.repartition(n, "host", "part").sortWithinPartitions("host", "part").mapInArrow(releasing(arrays), "host long, h1 long, h2 long, starts array<int>")
    covers = covers if found is None else covers.unionByName(found)
    covers = covers.groupBy(*KEYS).agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            kept = []
            for text, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), strict=True):
                words, reach, left = text.split(" "), 0, []
                for s in sorted(starts):
                    left += words[reach:s]
                    reach = max(reach, s + run)
                kept.append(" ".join(left + words[reach:]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in KEYS], pa.array(kept, pa.string())], names=[*KEYS, "kept"])

    return cut(texts.join(covers, KEYS).select(*KEYS, "text", "starts").mapInArrow(cut_out, "host long, h1 long, h2 long, kept string"))


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def extract(pages: DataFrame, run: int = 8, shared_pages: int = 3, array_tokens: int = 2_000_000, broadcast_rows: int = 500_000) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html; more columns are ignored).

    Runs of `run` tokens that `shared_pages` distinct pages of a host have in their frames or doubtful blocks, or anywhere on pages
    without an article or main element, are boilerplate (a block of fewer tokens as a whole). Pages without such an element lose them, and
    so do the blocks of an article that a class or id puts in doubt. The rest of an article stays whole whatever its host repeats, as does the
    longest block of any other page (one in no doubt, if there is one), its main body: so an article at several addresses, and a line that
    articles and frames both have, are kept. Pages of a host with equal blocks count as one. A host whose streams have more than
    `array_tokens` tokens is dealt to several arrays.

    Null or empty html gives an empty text. Repeated rows and rows without page_id or url are kept, each for itself; an empty
    table gives no rows. Sides are broadcast only after they were counted as at most `broadcast_rows` rows.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = list(zip(*[parts(h) for h in b.column(2).to_pylist()], strict=True)) or [[]] * 4
            types = [pa.list_(pa.string()), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, found, types)], names=["page_id", "url", "blocks", "marked", "frame", "doubtful"])

    parsed = pages.mapInArrow(releasing(parse), "page_id long, url string, blocks array<string>, marked boolean, frame array<string>, doubtful array<int>")
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))
    parsed = cut(parsed.withColumn("row", F.monotonically_increasing_id()).withColumn("host", host).withColumn("page", F.xxhash64("host", "blocks")))
    key = [F.xxhash64("host", "text").alias("h1"), F.xxhash64(F.lit("second"), "host", "text").alias("h2")]
    doubted = F.transform("doubtful", lambda i: F.get("blocks", i))
    streams = parsed.select("host", "page", F.explode(F.concat(F.when(F.col("marked"), doubted).otherwise(F.col("blocks")), "frame")).alias("text")).select("host", "page", "text", *key)
    gone = boilerplate(streams, run, shared_pages, array_tokens, broadcast_rows)
    sure = F.size("doubtful") < F.size("blocks")
    longest = F.transform("blocks", lambda b, i: F.when(sure & F.array_contains("doubtful", i), -1).otherwise(F.length(b)))
    body = F.array_position(longest, F.array_max(longest)) - 1
    own = parsed.where("NOT marked OR size(doubtful) > 0").select("row", "host", "marked", "doubtful", body.alias("body"), F.posexplode("blocks").alias("i", "text"))
    own = own.where("IF(marked, array_contains(doubtful, i), i <> body)")
    hits = own.select("row", "host", "i", *key).join(small(gone), KEYS)
    hits = cut(hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("i", "kept"))).alias("gone")))
    left = F.transform("blocks", lambda b, i: F.coalesce(F.try_element_at("gone", i), b))
    text = F.when(F.col("gone").isNull(), F.array_join("blocks", " ")).otherwise(F.array_join(F.filter(left, lambda b: b != ""), " "))
    out = parsed.select("row", "page_id", "url", "blocks").join(small(hits), "row", "left").select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_host_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
