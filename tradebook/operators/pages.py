"""Address extraction from a table of fetched pages (page_id, url, html)."""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions.address import extract_address
from tradebook.functions.base import blank, contains_any, let, strip, text, words
from tradebook.functions.text import format_address
from tradebook.operators.markup import (
    attribute,
    has_class_rule,
    inside,
    joined_text,
    literals,
    selected,
    shown_text,
    strings,
    with_elements,
)
from tradebook.operators.mentions import with_mentions
from tradebook.session import settle

FOUND = ("struct<raw_address:string,street:string,city:string,state:string,zip_code:string,"
         "confidence:double,source:string>")
_SCRIPT = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
_NEXT = r"(?is)<script\b[^>]*\bid\s*=\s*[\"']?__NEXT_DATA__[\"']?[^>]*>(.*?)</script\s*>"
# An opening tag with its attributes; a quoted value may hold ">".
_TAG = "(?is)<%s(?=[\\s/\"'>])(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>?)"
#: Ids of linked pages are broadcast up to so many (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
_BEFORE = "[\\s\"'/]"       # what may stand before an attribute's name


def _decode(s: pd.Series) -> pd.Series:
    return s.map(html_module.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """All character references as text; only texts with a reference leave the JVM."""
    return F.coalesce(F.pandas_udf(_decode, "string")(F.when(c.contains("&"), c)), c)


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags removed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)\s*>|<!--.*?-->", "")
    return unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", ""))


def _found(raw: Column, parts: Column, confidence: float, source: str) -> Column:
    return F.struct(raw.alias("raw_address"), parts["street"].alias("street"), parts["city"].alias("city"),
                    parts["state"].alias("state"), parts["zip_code"].alias("zip_code"),
                    F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))


def json_ld_address(html: Column) -> Column:
    """First address object of the page's JSON-LD scripts, NULL when there is none."""
    def address_of(script: Column) -> Column:
        own = F.get_json_object(script, "$.address")
        empty = own.isNull() | own.isin("", "{}", "[]", "0", "false", "null")
        obj = F.when(empty, F.get_json_object(script, "$.location.address")).otherwise(own)
        root_ok = F.ltrim(script).startswith("{") | script.rlike(r"^\s*\{")
        return F.when(root_ok & obj.startswith("{") & (obj != "{}"), obj)

    def build(obj: Column) -> Column:
        street, city, state, zip_code = (F.get_json_object(obj, f"$.{k}") for k in (
            "streetAddress", "addressLocality", "addressRegion", "postalCode"))
        none = F.lit("None")
        raw = F.concat(F.coalesce(street, none), F.lit(", "), F.coalesce(city, none), F.lit(", "),
                       F.coalesce(state, none), F.lit(" "), F.coalesce(zip_code, none))
        parts = F.struct(street.alias("street"), city.alias("city"), state.alias("state"), zip_code.alias("zip_code"))
        return F.when(obj.isNotNull(), _found(raw, parts, 0.9, "structured_data"))

    objects = F.filter(F.transform(F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1)), address_of),
                       lambda o: o.isNotNull())
    return F.when(html.contains("ld+json"), let(F.try_element_at(objects, F.lit(1)), build))


def _meta_tag(html: Column, prop: str) -> Column:
    """The first meta tag of the property, empty text if there is none."""
    own = rf"(?is){_BEFORE}property\s*=\s*[\"']?{re.escape(prop)}[\"'\s/>]"
    tags = F.filter(F.regexp_extract_all(html, F.lit(_TAG % "meta"), F.lit(0)), lambda t: t.rlike(own))
    return F.coalesce(F.try_element_at(tags, F.lit(1)), F.lit(""))


def meta_address(html: Column, word_boundary: bool = True) -> Column:
    """Address in the page's address meta tags, tried in a fixed order."""
    options = []
    for prop in fixed.META_ADDRESS:
        tag = _meta_tag(html, prop)
        raw = unescape(F.coalesce(
            F.nullif(F.regexp_extract(tag, _BEFORE + r'(?i:content)\s*=\s*"([^"]*)"', 1), F.lit("")),
            F.nullif(F.regexp_extract(tag, _BEFORE + r"(?i:content)\s*=\s*'([^']*)'", 1), F.lit(""))))
        options.append(F.when(html.contains(prop), let(raw, lambda r: let(
            extract_address(r, word_boundary),
            lambda p: F.when(p.isNotNull(), _found(r, p, 0.85, "meta_tags"))))))
    return F.coalesce(*options)


def _near_name(lines: Column, name: Column, word_boundary: bool) -> Column:
    """The first address within two lines of a line that contains the name."""
    low = F.lower(name)
    spots = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: F.lower(lines[k]).contains(low))

    def context(k: Column) -> Column:
        start = F.greatest(k - 2, F.lit(0))
        stop = F.least(k + 3, F.size(lines))
        return F.array_join(F.slice(lines, start + 1, stop - start), " ")

    hits = F.filter(F.transform(spots, lambda k: let(context(k), lambda t: let(
        extract_address(t, word_boundary),
        lambda p: F.when(p.isNotNull(), _found(t, p, 0.75, "text_content"))))), lambda h: h.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def text_address(html: Column, name: Column, word_boundary: bool = True) -> Column:
    """Address within two lines of a line that contains the business name."""
    # Cheap test first: most pages do not mention the name at all, and only texts are decoded that may.
    may = ~blank(name) & (F.lower(html).contains(F.lower(name)) | html.contains("&"))
    return F.when(may, let(F.split(page_text(F.when(may, html)), "\n"), lambda lines: _near_name(lines, name, word_boundary)))


def _rows(pages: DataFrame, found: Column, keep: Sequence[str]) -> DataFrame:
    return pages.select(*keep, found.alias("_f")).filter(F.col("_f").isNotNull()).select(*keep, "_f.*")


def from_json_ld(pages: DataFrame) -> DataFrame:
    return _rows(pages, json_ld_address(F.col("html")), ["page_id"])


def from_meta_tags(pages: DataFrame, word_boundary: bool = True) -> DataFrame:
    return _rows(pages, meta_address(F.col("html"), word_boundary), ["page_id"])


def from_text(pages: DataFrame, names: DataFrame | None = None, word_boundary: bool = True) -> DataFrame:
    """Addresses near the business name.

    Pages carry the wanted ``business_name``; or ``names`` is given and every page is paired with
    the names its markup mentions, found where the page is read: no markup is shuffled.
    """
    if names is None:
        return _rows(pages, text_address(F.col("html"), F.col("business_name"), word_boundary), ["page_id", "business_name"])
    named = names.filter(~blank("business_name"))
    paired = with_mentions(pages, "html", named, "business_name", "_names", ["page_id", "html"])
    found = paired.select("page_id", "_names", F.split(page_text(F.col("html")), "\n").alias("_lines")) \
        .select("page_id", F.explode(F.transform("_names", lambda n: F.struct(
            n.alias("business_name"), _near_name(F.col("_lines"), n, word_boundary).alias("f")))).alias("_m"))
    return found.filter(F.col("_m.f").isNotNull()).select("page_id", "_m.business_name", "_m.f.*").distinct()


def _with_contact_links(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` with ``_links``: resolved links that look like contact pages, in document order.

    Only pages that hold a telling word, or a coded character, are parsed.
    """
    html = F.col("html")
    parsed = with_elements(pages, html.rlike(fixed.CONTACT_HREF) | _coded_attribute(html), keep, ["a"], texts=False)
    links = F.filter("nodes", lambda n: attribute(n, "href").rlike(fixed.CONTACT_HREF) & n["link"].isNotNull())
    return parsed.select(*keep, F.transform(links, lambda n: n["link"]).alias("_links"))


def _listed(found: DataFrame) -> DataFrame:
    return found.select("page_id", F.posexplode("_links").alias("pos", "link"))


def contact_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): resolved links that look like contact pages, in document order."""
    return _listed(_with_contact_links(pages, ["page_id"]))


def _element_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, texts): texts of address-like elements of a page, in document order.

    Pages without a fitting class attribute keep their row but send no markup to Python.
    """
    html = F.col("html")
    may = F.lower(html).contains("class") & html.rlike(fixed.CONTACT_CLASS) | _coded_attribute(html)
    parsed = with_elements(pages, may, ["page_id", "url"], ["address", "div", "p"])
    named = F.filter("nodes", lambda n: F.coalesce(F.exists(words(attribute(n, "class")), lambda c: c.rlike(fixed.CONTACT_CLASS)), F.lit(False)))
    return parsed.select("page_id", "url", F.transform(named, joined_text).alias("texts"))


def _coded_attribute(html: Column) -> Column:
    """True where an attribute value may hold a letter as a number: its text cannot be searched for."""
    return html.contains("&#")


def _may_match(html: Column, selectors: Sequence[str]) -> Column:
    """False only where no selector can match: a cheap test that keeps most markup out of Python."""
    low, out = F.lower(html), _coded_attribute(html)
    for s in selectors:
        out = out | reduce(lambda x, y: x & y, [low.contains(t) for t in literals(s)], F.lit(True))
    return out


def from_contact_pages(pages: DataFrame, word_boundary: bool = True) -> DataFrame:
    """Addresses found on the contact page a page links to.

    Every page is reduced to its own (url, address) row first, however many pages link to it, so
    only links and addresses are shuffled, never markup. Of pages with the same URL the first
    counts.
    """
    return _linked_addresses(contact_links(pages), pages, word_boundary)


def _linked_addresses(links: DataFrame, pages: DataFrame, word_boundary: bool) -> DataFrame:
    """The address of the first link of every page that leads to a page with one."""
    hit = F.filter(F.transform("texts", lambda t: let(extract_address(t, word_boundary), lambda p: F.when(
        p.isNotNull(), _found(t, p, 0.8, "contact_page")))), lambda f: f.isNotNull())
    own = _element_texts(pages).select("page_id", F.col("url").alias("link"), F.try_element_at(hit, F.lit(1)).alias("_f"))
    found = own.groupBy("link").agg(F.min_by(F.struct("_f"), "page_id")["_f"].alias("_f")) \
        .filter(F.col("_f").isNotNull())
    return links.join(found, "link").groupBy("page_id").agg(F.min_by("_f", "pos").alias("_f")) \
        .select("page_id", "_f.*")


Strategy = Callable[[DataFrame], DataFrame]


def extract_cascade(pages: DataFrame, strategies: Sequence[Strategy] | None = None,
                    threshold: float = 0.7, word_boundary: bool = True) -> DataFrame:
    """First strategy with a confident address per page.

    Pages carry ``business_name``. The default order is structured data, meta tags, contact page,
    page text. Pages are scanned once for structured data and meta tags; only those that these leave open have
    their links resolved and their text searched, and only pages that such links lead to are parsed for
    addresses. Own ``strategies`` (pages -> rows with page_id and the address fields) replace the default
    ones and are tried in order on what is still open.
    """
    if strategies is not None:
        done, left = None, pages.select("page_id", "business_name")
        for strategy in strategies:
            # each strategy reads the pages in its own scan; only ids and addresses meet in joins
            hits = strategy(pages).filter(F.col("confidence") > threshold)
            hits = hits.drop("business_name").join(left, "page_id")
            done = hits if done is None else done.unionByName(hits)
            left = left.join(hits.select("page_id"), "page_id", "left_anti")
        return done

    html = F.col("html")
    early = F.coalesce(*[F.when(f["confidence"] > threshold, f) for f in (
        json_ld_address(html), meta_address(html, word_boundary))])
    # the markup of pages that are settled is null from here on: neither read nor parsed any further
    open_ = pages.select("page_id", "url", "business_name", "html", early.alias("_early")) \
        .select("page_id", "url", "business_name", "_early", F.when(F.col("_early").isNull(), html).alias("html"))
    read = settle(_with_contact_links(open_, ["page_id", "business_name", "_early", "html"]).select(
        "page_id", "business_name", "_early", "_links",
        text_address(html, F.col("business_name"), word_boundary).alias("_late")))
    links = _listed(read)
    linked = settle(pages.select("page_id", "url").join(links.select(F.col("link").alias("url")).distinct(), "url")
                    .select("page_id").distinct())
    few = linked.count() <= BROADCAST_IDS
    asked = pages.select("page_id", "url", "html").join(F.broadcast(linked) if few else linked, "page_id", "left_semi")
    contact = _linked_addresses(links, asked, word_boundary)
    contact = contact.select("page_id", F.struct(*[c for c in contact.columns if c != "page_id"]).alias("_contact"))
    best = F.coalesce(F.col("_early"), *[F.when(F.col(c)["confidence"] > threshold, F.col(c)) for c in ("_contact", "_late")])
    return read.select("page_id", "business_name", "_early", "_late").join(contact, "page_id", "left") \
        .select("page_id", "business_name", best.alias("_f")) \
        .filter(F.col("_f").isNotNull()).select("page_id", "business_name", "_f.*")


def from_next_data(pages: DataFrame) -> DataFrame:
    """Address of the page state script's business location, on one line."""
    def build(loc: Column) -> Column:
        parts = [F.nullif(F.get_json_object(loc, f"$.{k}"), F.lit(""))
                 for k in ("street", "city", "state", "zipCode", "country")]
        return F.nullif(F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit(""))
    script = F.regexp_extract("html", _NEXT, 1)
    raw = F.when(F.col("html").contains("__NEXT_DATA__"), let(F.get_json_object(
        script, "$.props.pageProps.business.location"), build))
    return pages.select("page_id", raw.alias("_r")).filter(F.col("_r").isNotNull()) \
        .select("page_id", format_address("_r").alias("address"))


def from_selectors(pages: DataFrame, selectors: Sequence[str] = tuple(fixed.REVIEW_SELECTORS),
                   attributes: Sequence[str] = tuple(fixed.SELECTOR_ATTRIBUTES), nested: bool = True) -> DataFrame:
    """First usable text of ordered selectors as a one-line address.

    Per matching element: its address attributes, its text when longer than five characters, then
    the texts of the elements inside.
    """
    def long(found: Column) -> Column:
        return F.filter(found, lambda t: F.length(t) > 5)

    def candidates(node: Column) -> Column:
        given = F.filter(F.array(*[attribute(node, a) for a in attributes]).cast("array<string>"), lambda v: v != "")
        shown = long(F.array(shown_text(node)))
        return F.concat(given, shown, long(F.transform(inside(node), shown_text))) if nested else F.concat(given, shown)

    parsed = with_elements(pages.filter(_may_match(F.col("html"), selectors)), F.lit(True), ["page_id"])
    hits = parsed.select("page_id", "nodes", "pieces", F.concat(*[selected(s) for s in selectors]).alias("_hits"))
    raw = hits.select("page_id", F.flatten(F.transform("_hits", candidates)).alias("texts"))
    first = F.try_element_at(F.filter(F.transform("texts", format_address), lambda a: a != ""), F.lit(1))
    return raw.filter(F.size("texts") > 0).select("page_id", first.alias("address")) \
        .filter(F.col("address").isNotNull())


def from_class_patterns(pages: DataFrame) -> DataFrame:
    """(page_id, pattern, text): texts matched by the fixed address patterns, blank ones left out."""
    def line(rule: tuple) -> Column:
        hits = F.filter("nodes", lambda n: has_class_rule(n, rule))
        bits = F.transform(F.flatten(F.transform(hits, strings)), strip)
        return F.array_join(F.filter(bits, lambda b: b != ""), " ")

    low, may = F.lower("html"), _coded_attribute(F.col("html")) | F.lower("html").contains("<address")
    for rule in fixed.ADDRESS_CLASS_PATTERNS:
        if rule[3]:
            may = may | low.contains(rule[3].lower())
    parsed = with_elements(pages.filter(may), F.lit(True), ["page_id"])
    lines = F.array(*[line(rule) for rule in fixed.ADDRESS_CLASS_PATTERNS])
    return parsed.select("page_id", F.posexplode(lines).alias("pattern", "text")).filter("text <> ''")


def _has_tag(html: Column, tag: str, pattern: str) -> Column:
    """True where an opening tag of that name matches the pattern."""
    return F.exists(F.regexp_extract_all(html, F.lit(_TAG % tag), F.lit(0)), lambda t: t.rlike(pattern))


def is_challenge(url: Column, html: Column) -> Column:
    """True for bot walls: telling URL words, phrases or markup."""
    low = F.lower(html)
    # the fixed patterns, applied to one tag at a time: any attribute may stand before, parted by quotes as well
    markup = "(?is)" + "|".join(p.replace(r"[^>]*\s", ".*?" + _BEFORE, 1) for p in fixed.CHALLENGE_MARKUP)
    telling = contains_any(low, fixed.CHALLENGE_MARKUP_WORDS)
    return contains_any(F.lower(text(url)), fixed.CHALLENGE_URL_WORDS) \
        | contains_any(low, fixed.CHALLENGE_PHRASES) | telling & _has_tag(html, r"[a-z][a-z0-9]*", markup)


def flag_challenge_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("is_challenge", is_challenge(F.col("url"), F.col("html")))


def flag_no_results(pages: DataFrame) -> DataFrame:
    """Add ``no_results``: a no-result phrase, or no result container at all."""
    def with_class(names: str) -> str:
        return (rf"(?is){_BEFORE}class\s*=\s*(?:\"(?:[^\"]*\s)?(?:{names})(?:\s[^\"]*)?\"|'(?:[^']*\s)?(?:{names})(?:\s[^']*)?'"
                rf"|(?:{names})(?=[\s>]))")

    html, cls = F.col("html"), "|".join(fixed.RESULT_CLASSES)
    box = contains_any(F.lower("html"), fixed.RESULT_CLASSES) & _has_tag(html, r"[a-z][a-z0-9]*", with_class(cls)) \
        | F.lower("html").contains("card") & _has_tag(html, "a", with_class("card"))
    return pages.withColumn("no_results", contains_any(F.lower("html"), fixed.NO_RESULT_PHRASES) | ~box)


def blocked_domains(http_log: DataFrame, key: str, content: DataFrame | None = None,
                    domains: Sequence[str] = tuple(fixed.WATCHED_DOMAINS), share: float = 0.5) -> DataFrame:
    """Keys whose responses of the watched domains were mostly refused.

    ``content`` (key, html) lists pages already loaded: a key with a page that shows real content
    is not blocked.
    """
    watched = http_log.filter(contains_any(F.col("url"), domains))
    if content is not None:
        useful = content.filter(contains_any(F.lower("html"), fixed.CONTENT_MARKERS)).select(key).distinct()
        watched = watched.join(useful, key, "left_anti")
    return watched.groupBy(key).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status").isin(fixed.BLOCK_STATUS)).alias("refused")) \
        .filter(F.col("refused") > F.col("requests") * share)
