"""Main text of web pages: a host's suffix array over all blocks, page structure as the check that follows.

1. Each page is read, tag by tag, into blocks of text. A block lies in an article (``article``,
   ``main``, ``role=main`` or a container named like one), in chrome (menus, headers, footers, sidebars,
   notices, adverts, forms, comments, hidden parts) or in neither.
2. The words of all blocks of all pages of a host, articles included, with marks between blocks, are
   concatenated and sorted as suffixes. Runs of ``MIN_RUN`` words that occur on more than ``SHARE`` of the
   host's different pages, and on ``MIN_PAGES`` at least, are boilerplate.
3. The structure's check follows: chrome goes, and open blocks where the page has an article. Of other
   open blocks the words that no run covers stay; an article's block goes if runs cover it whole and
   the host has ``ARTICLE_PAGES`` different pages.

A hot host is dealt into bounded blocks of pages, by a hash of what the page says (exact copies are one
page and meet in one block), each with a suffix array of its own, sorted by prefix doubling until prefixes
are ``MIN_RUN`` long. A run on more than a share of all pages is on more than that share in one block at
least, so each block hands on only its own common runs; those of hosts with several blocks are then
counted over all pages of the host. No group is unbounded, and texts are shuffled once.

Null or empty html: empty text. Null urls share one host. Repeated rows are pages of their own with
the same text. Empty tables give empty results; other columns are left aside.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import query, table
from tradebook.session import settle

MIN_RUN = 8
#: Words of one suffix array, about.
BLOCK_WORDS = 1_000_000
#: Characters of html for each word, about: hosts are dealt into blocks before their pages are read.
WORD_CHARS = 6
#: Boilerplate is on more than this share of a host's different pages, and on so many at least.
SHARE = 0.5
MIN_PAGES = 3
#: Hosts with fewer different pages say nothing against the blocks of an article.
ARTICLE_PAGES = 8

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|title)\b"
    r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^<>]*+>",
    re.S | re.I)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

_BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME_TAGS = frozenset("nav footer aside form button dialog menu head".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_CHROME_NAMES = re.compile(
    r"ads?|adverts?|advertisements?|advertising|banners?|promos?|promotions?|sponsor(?:s|ed)?|sidebars?|cookies?|consent|gdpr|"
    r"notices?|popups?|modals?|overlay|newsletters?|subscribe|subscription|signup|login|comments?|commentlist|disqus|replies|"
    r"share|sharing|social|related|recommended|recommendations|breadcrumbs?|pagination|pager|menus?|nav|navbar|navigation|"
    r"footer|masthead|toolbar|widgets?|skip|copyright|disclaimer|hidden|sr")
_HEAD_NAMES = frozenset("header topbar".split())
_MAIN_NAMES = re.compile(r"(?:main|article|post|entry|story|page)[-_]?(?:content|body|text)|articlebody|main|article|content|post|entry|story")
_NAME_MODIFIERS = frozenset("has with without no".split())
_NAME_PARTS = re.compile(r"[^a-z0-9]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text else {}


def _kind(tag: str, attrs: dict[str, str], inside_main: bool) -> str | None:
    """"chrome", "wrap" (chrome that may stand around a whole page), "main", "doubt" (only a part of a name sounds like
    chrome: the host's runs decide) or None for an element that changes nothing."""
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    parts = [p for n in names for before, p in pairwise(["", *filter(None, _NAME_PARTS.split(n))]) if before not in _NAME_MODIFIERS]
    if tag in _CHROME_TAGS - {"form"} or attrs.get("role", "").lower() in _CHROME_ROLES or "hidden" in attrs \
            or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return "chrome"
    if tag == "form":
        return "wrap"
    if tag in ("body", "html", "article", "main") and not any(p.startswith("comment") for p in parts):
        return "main" if tag in ("article", "main") else None
    if any(_CHROME_NAMES.fullmatch(n) for n in names):
        return "wrap"
    if not inside_main and (tag == "header" or any(n in _HEAD_NAMES for n in names)):
        return "chrome"
    if attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "") == "articleBody" \
            or tag in ("div", "section", "td") and any(_MAIN_NAMES.fullmatch(n) for n in names):
        return "main"
    return "doubt" if any(_CHROME_NAMES.fullmatch(p) or p in _HEAD_NAMES for p in parts) else None


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block in page order; zones are main, chrome, open, wrapped (in forms and what is named like
    chrome) and inner (an article or main element in such a wrapper), with a "?" inside an element of doubtful name."""
    out: list[tuple[str, str]] = []
    frames: list[list] = []            # elements that change the zone: [tag, kind, open elements of the same tag inside]
    held: list[str] = []

    def zone() -> str:
        return certain() + ("?" if any(f[1] == "doubt" for f in frames) else "")

    def certain() -> str:
        kinds = [f[1] for f in frames if f[1] != "doubt"]
        if "chrome" in kinds:
            return "chrome"
        if "wrap" not in kinds:
            return "main" if "main" in kinds else "open"
        if "main" in kinds[:kinds.index("wrap")]:
            return "chrome"
        last = len(kinds) - kinds[::-1].index("wrap")
        if any(f[0] in ("article", "main") and f[1] == "main" for f in [f for f in frames if f[1] != "doubt"][last:]):
            return "inner"
        return "wrapped" if "main" not in kinds[:last] else "chrome"

    now = "open"

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((now, text))
            held.clear()

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            held.append(html.unescape(page[at:m.start()]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and m["raw"].lower() in ("iframe", "textarea", "select", "title"):
                held.append(" ")
            continue
        if tag == "br":
            held.append(" ")
        if tag in _BLOCK_TAGS:
            flush()
            if not m["end"]:
                while frames and frames[-1][0] in ("p", "li", "dt", "dd") and tag in (frames[-1][0], "p", "div", "article", "section"):
                    if frames[-1][0] != tag and frames[-1][0] != "p":
                        break
                    frames.pop()
        if m["end"]:
            for k in range(len(frames) - 1, -1, -1):
                if frames[k][0] == tag:
                    if frames[k][2]:
                        frames[k][2] -= 1
                    else:
                        if tag not in _BLOCK_TAGS:
                            flush()
                        del frames[k:]
                    break
            now = zone()
        elif tag not in _VOID:
            kind = _kind(tag, _attributes(m["attrs"]), now.rstrip("?") in ("main", "inner"))
            if kind:
                flush()
                frames.append([tag, kind, 0])
                now = zone()
            else:
                for f in reversed(frames):
                    if f[0] == tag:
                        f[2] += 1
                        break
    if at < len(page):
        held.append(html.unescape(page[at:]))
    flush()
    return out


STREAMS = "host string, says bigint, stream string"


def judged(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block after the structure's check: main, main? (of doubtful name), open or chrome.

    Open blocks are chrome where there is an article. Without one, an article in a wrapper is the page's if
    it holds more than the open blocks; where all blocks are in wrappers, those are open.
    """
    blocks = blocks_of(page)
    size = Counter()
    for z, t in blocks:
        size[z.rstrip("?")] += len(t)
    taken = {"main": "main"} if size["main"] else {"inner": "main"} if size["inner"] > size["open"] \
        else {"open": "open"} if size["open"] else {"wrapped": "open"}
    judged_as = {z + mark: taken.get(z, "chrome") + (mark if taken.get(z) == "main" else "")
                 for z in ("main", "inner", "open", "wrapped", "chrome") for mark in ("", "?")}
    return [(judged_as[z], t) for z, t in blocks]


def _stream(blocks: list[tuple[str, str]]) -> list[str]:
    """The words of all blocks of a page, a line feed before and after each block."""
    out = []
    for _, block in blocks:
        out.append("\n")
        out += block.split(" ")
    return [*out, "\n"] if out else out


def _says(stream: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(stream).encode()) >> 1


def _streams(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        streams = [_stream(judged(page.as_py())) for page in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array([_says(s) for s in streams], pa.int64()),
             pa.array([" ".join(s) for s in streams], pa.string())], ["host", "says", "stream"])


def suffix_ranks(words: np.ndarray, run: int = MIN_RUN) -> np.ndarray:
    """Rank of each suffix among all, by its first ``run`` words, by prefix doubling.

    Equal ranks are suffixes that share ``run`` words. ``words`` are numbers from 0; the stream ends of
    pages must be numbers of their own, so that no run crosses from one page to the next.
    """
    rank, size = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while size < run:
        grown = min(size, run - size)
        follow = np.full(len(rank), -1, np.int64)
        follow[:len(rank) - grown] = rank[grown:]
        rank = np.unique(rank * (len(rank) + 2) + follow + 1, return_inverse=True)[1].astype(np.int64)
        size += grown
    return rank


def _array_of(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(suffix ranks, page of each position) of the concatenated streams, each with an end of its own."""
    ids: dict[str, int] = {}
    coded, page = [], []
    for k, s in enumerate(streams):
        coded += [ids.setdefault(w, len(ids)) for w in s]
        coded.append(-1 - k)
        page += [k] * (len(s) + 1)
    words = np.array(coded, np.int64)
    words[words < 0] += len(ids) + len(streams) + 1
    words[np.array(coded) < 0] = len(ids) + np.arange(len(streams))
    return suffix_ranks(words), np.array(page)


def _key(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).encode()) - (1 << 63)


def _common_runs(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Rows sorted by (host, part): the runs on more than ``SHARE`` of a part's pages; a null run has the number of pages."""
    for (host, part), rows in _parts(batches, ("host", "part")):
        pages = {r["says"]: r["stream"].split(" ") for r in rows if r["stream"]}       # exact copies are one page
        lone = rows[0]["parts"] == 1
        need = max(int(SHARE * len(pages)) + 1, MIN_PAGES if lone else 1)
        runs: list[int | None] = [None]
        counts = [len(pages)]
        if len(pages) >= need:
            streams = list(pages.values())
            ranks, page = _array_of(streams)
            often = np.flatnonzero(np.bincount(ranks)[ranks] >= need)
            pairs = np.unique(ranks[often] * len(streams) + page[often]) // len(streams)
            common, n = np.unique(pairs, return_counts=True)
            first = np.full(int(ranks.max()) + 1, -1, np.int64)
            first[ranks[often]] = often
            flat = [w for s in streams for w in (*s, None)]
            for p, c in zip(first[common[n >= need]].tolist(), n[n >= need].tolist(), strict=True):
                run = flat[p:p + MIN_RUN]
                if len(run) == MIN_RUN and None not in run:
                    runs.append(_key(run))
                    counts.append(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array([host] * len(runs), pa.string()), pa.array([lone] * len(runs), pa.bool_()),
             pa.array(runs, pa.int64()), pa.array(counts, pa.int64())], ["host", "lone", "run", "pages"])


def _parts(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]):
    """Groups of neighbouring rows with equal keys, as dicts."""
    current, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current:
                if held:
                    yield current, held
                current, held = key, []
            held.append(row)
    if held:
        yield current, held


def _hits(stream: list[str], runs: set[int]) -> list[int]:
    """Positions at which one of the runs begins."""
    return [p for p in range(len(stream) - MIN_RUN + 1) if _key(stream[p:p + MIN_RUN]) in runs] if runs else []


def _runs_of_rows(batch: pa.RecordBatch) -> Iterable[set[int]]:
    """The runs of each row's host, one set for neighbours of the same host."""
    host, runs = None, set()
    hosts = batch.column("host").to_pylist()
    for k, h in enumerate(hosts):
        if k == 0 or h != host:
            host, runs = h, set(batch.column("runs")[k].as_py() or ())
        yield runs


def _recount(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """(host, run, says) of each run of the host's list that a page holds."""
    for batch in batches:
        hosts, found, says = [], [], []
        for host, page, runs in zip(batch.column("host").to_pylist(), batch.column("html"), _runs_of_rows(batch), strict=True):
            stream = _stream(judged(page.as_py()))
            held = {_key(stream[p:p + MIN_RUN]) for p in _hits(stream, runs)}
            hosts += [host] * len(held)
            found += held
            says += [_says(stream)] * len(held)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(says, pa.int64())],
                                         ["host", "run", "says"])


def text_of(page: str, runs: set[int], host_pages: int) -> str:
    """What the host's boilerplate runs leave of a page, checked by its structure.

    Chrome goes. An open block loses the words that runs cover. An article's block goes if runs cover it
    whole and the host has ``ARTICLE_PAGES`` different pages (``MIN_PAGES`` are enough for a block of doubtful
    name); an article that would lose every block stays.
    """
    blocks = judged(page)
    stream = _stream(blocks)
    covered = bytearray(len(stream))
    for p in _hits(stream, runs):
        covered[p:p + MIN_RUN] = b"\1" * MIN_RUN
    kept, article, at = [], [], 0
    for zone, block in blocks:
        words = block.split(" ")
        left = [w for w, c in zip(words, covered[at + 1:at + 1 + len(words)], strict=True) if not c]
        at += 1 + len(words)
        if zone == "open":
            kept.append(" ".join(left))
        elif zone != "chrome":
            article.append(block)
            kept.append(block if left or host_pages < (MIN_PAGES if zone == "main?" else ARTICLE_PAGES) else "")
    kept = [k for k in kept if k]
    return "\n".join(kept or article)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        texts = [text_of(page.as_py(), runs, n or 0) for page, runs, n in zip(
            batch.column("html"), _runs_of_rows(batch), batch.column("pages").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                         ["page_id", "url", "text"])


def boilerplate(bare: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(host, runs, pages): the keys of each host's boilerplate runs and its different pages, as a written table."""
    size = F.ceil(F.sum(F.length("html")) / F.lit(block_words * WORD_CHARS)).cast("int")
    # a row for each hot host only: no more than there are blocks
    hot = F.broadcast(settle(bare.groupBy("host").agg(size.alias("parts")).filter("parts > 1")))
    dealt = bare.select("host", "html").mapInArrow(_streams, STREAMS).join(hot, "host", "left") \
        .withColumn("parts", F.coalesce("parts", F.lit(1))) \
        .withColumn("part", F.pmod(F.xxhash64("says"), F.col("parts")).cast("int"))
    found = settle(dealt.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(
        _common_runs, "host string, lone boolean, run bigint, pages bigint"))
    sure = found.filter("lone and run is not null").select("host", "run")
    asked = found.filter("not lone and run is not null").groupBy("host").agg(F.collect_set("run").alias("runs"))
    total = found.filter("run is null").groupBy("host").agg(F.sum("pages").alias("pages"))
    counted = bare.select("host", "html").join(settle(asked), "host").mapInArrow(_recount, "host string, run bigint, says bigint") \
        .distinct().groupBy("host", "run").agg(F.count("*").alias("n"))
    merged = counted.join(total, "host").filter((F.col("n") > F.col("pages") * SHARE) & (F.col("n") >= MIN_PAGES))
    runs = sure.unionByName(merged.select("host", "run")).groupBy("host").agg(F.collect_list("run").alias("runs"))
    return settle(runs.join(total, "host"))


def extract_text(pages: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(page_id, url, text) of every page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    bare = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return bare.join(boilerplate(bare, block_words), "host", "left").mapInArrow(
        _cut, "page_id bigint, url string, text string")


@query("op2_html_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
