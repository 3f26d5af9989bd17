"""Relevance scores of search results (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions.base import ColumnLike, contains_any, count_hits, let, text, words
from tradebook.functions.text import url_domain


def _share(terms: Column, body: Column) -> Column:
    """Share of the terms that occur in the text; NULL without terms."""
    hits = F.size(F.filter(terms, lambda t: body.contains(t)))
    return F.try_divide(hits, F.size(terms))


def result_text(title: ColumnLike, description: ColumnLike) -> Column:
    return F.lower(F.concat(text(title), F.lit(" "), text(description)))


def relevance_score(name: ColumnLike, title: ColumnLike, description: ColumnLike,
                    url: ColumnLike) -> Column:
    """Name share, keyword share and trust tiers of the URL; 0.1 for a blank name."""
    link = F.lower(text(url))
    trust = F.lit(0.0)
    for weight, domains in fixed.TRUST_TIERS:
        trust = trust + F.when(contains_any(link, domains), F.lit(weight)).otherwise(F.lit(0.0))

    def total(body: Column) -> Column:
        base = let(words(F.lower(text(name))), lambda w: _share(w, body)) * 0.4
        keywords = count_hits(body, fixed.RELEVANCE_KEYWORDS) * F.lit(0.02)
        return F.coalesce(F.round(F.least(base + keywords + trust, F.lit(1.0)), 3), F.lit(0.1))

    return let(result_text(title, description), total)


def weighted_score(body: ColumnLike, url: ColumnLike, terms: Column) -> Column:
    """Term share, weighted keyword groups and the first trusted domain; 0.1 without terms."""
    host = url_domain(F.lower(text(url)))
    trust = F.lit(0.0)
    for domain, weight in reversed(fixed.TRUSTED_DOMAINS):
        trust = F.when(host.contains(domain), F.lit(weight)).otherwise(trust)

    def total(t: Column) -> Column:
        keywords = F.lit(0.0)
        for weight, group in fixed.KEYWORD_GROUPS:
            keywords = keywords + count_hits(t, group) * F.lit(weight)
        return F.coalesce(
            F.round(F.least(_share(terms, t) * 0.4 + keywords + trust, F.lit(1.0)), 3), F.lit(0.1))

    return let(F.lower(text(body)), total)


def basic_relevance(title: ColumnLike, description: ColumnLike, url: ColumnLike) -> Column:
    """Keyword share with a bonus for trusted URLs and for telling titles."""
    link, head = F.lower(text(url)), F.lower(text(title))
    bonus = F.when(contains_any(link, fixed.BASIC_DOMAINS), F.lit(0.2)).otherwise(F.lit(0.0)) \
        + F.when(contains_any(head, fixed.BASIC_TITLE_TERMS), F.lit(0.1)).otherwise(F.lit(0.0))
    share = let(result_text(title, description),
                lambda t: count_hits(t, fixed.BASIC_KEYWORDS) / F.lit(float(len(fixed.BASIC_KEYWORDS))))
    return F.round(F.least(share + bonus, F.lit(1.0)), 2)


