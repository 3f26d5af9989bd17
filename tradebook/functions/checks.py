"""Record-level predicates and validations (Column -> Column)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions.address import address_text_errors
from tradebook.functions.base import (
    ColumnLike, as_col, blank, let, messages, no_messages, strip, text, texts, verdict, words,
)
from tradebook.functions.text import is_iso_date, url_domain

_SCHEME_AND_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"


def is_valid_url(c: ColumnLike) -> Column:
    return F.coalesce(as_col(c).rlike(r"^https?://[^/?#]+"), F.lit(False))


def url_errors(c: ColumnLike) -> Column:
    c = as_col(c)
    return F.when(blank(c), texts(["URL cannot be empty"])) \
        .when(~c.rlike(_SCHEME_AND_HOST), texts(["Invalid URL format"])) \
        .when(~c.rlike(r"(?i)^https?://"), texts(["URL must use HTTP or HTTPS protocol"])) \
        .otherwise(no_messages())


def validate_url(c: ColumnLike) -> Column:
    c = as_col(c)
    long = F.when(c.rlike(r"(?i)^https?://[^/?#]") & (F.length(c) > 2048),
                  texts(["URL is unusually long"])).otherwise(no_messages())
    return verdict(url_errors(c), long)


def in_allowed_domains(url: ColumnLike, domains: Iterable[str] = tuple(fixed.ALLOWED_DOMAINS)) -> Column:
    """True where the URL's host is one of the domains or below one."""
    def test(host: Column) -> Column:
        out = F.lit(False)
        for d in domains:
            out = out | (host == d) | host.endswith("." + d)
        return out
    return let(F.lower(F.regexp_replace(url_domain(url), r":\d+$", "")), test)


def validate_contact_field(c: ColumnLike, kind: str) -> Column:
    pattern = {"phone": fixed.PHONE, "email": fixed.EMAIL, "url": fixed.WEB_URL,
               "zip_code": fixed.ZIP_CODE}[kind]
    return F.coalesce(as_col(c).rlike(pattern), F.lit(False))


def missing_fields(names: Iterable[str]) -> Column:
    """Names of the columns that are missing (NULL or empty), in the given order."""
    return F.array_compact(F.array(*[
        F.when(F.col(n).isNull() | (F.col(n).cast("string") == ""), F.lit(n)) for n in names]))


def keyword_hits(c: ColumnLike, keywords: Iterable[str] = tuple(fixed.NAME_KEYWORDS)) -> Column:
    """The distinct words of the text that are in the keyword set, sorted."""
    return F.array_sort(F.array_intersect(words(F.lower(text(c))), texts(keywords)))


def name_errors(c: ColumnLike) -> Column:
    name, low = text(c), F.lower(text(c))
    term = F.lit(None).cast("string")
    for word in reversed(fixed.NAME_BLACKLIST):
        term = F.when(low.contains(word), F.lit(word)).otherwise(term)
    specials = F.length(F.regexp_replace(name, r"(?U)[\p{L}\p{N}\s]", ""))
    return F.when(F.length(name) < 2, texts(["Business name too short"])) \
        .otherwise(let(term, lambda t: F.when(
            t.isNotNull(), F.array(F.concat(F.lit("Business name contains invalid term: "), t)))
            .when(specials > F.length(name) * F.lit(0.3),
                  texts(["Business name contains too many special characters"]))
            .otherwise(no_messages())))


def name_warnings(c: ColumnLike) -> Column:
    """Format warnings; only meaningful where the name has no error."""
    name = text(c)
    return let(words(F.lower(name)), lambda w: messages(
        (F.array_contains(w, "inc") & ~name.rlike(r"(?:Inc\.|Inc|Incorporated)\z"),
         "Inconsistent Inc. formatting"),
        (F.array_contains(w, "llc") & ~name.rlike(r"(?:LLC|L\.L\.C\.)\z"),
         "Inconsistent LLC formatting")))


def validate_name(c: ColumnLike) -> Column:
    errors = name_errors(c)
    return let(errors, lambda e: verdict(
        e, F.when(F.size(e) == 0, name_warnings(c)).otherwise(no_messages())))


def validate_business(name: ColumnLike, address: ColumnLike, url: ColumnLike | None = None,
                      created_at: ColumnLike | None = None,
                      propagate_address_errors: bool = True) -> Column:
    """Verdict on a business record.

    ``propagate_address_errors=False`` ignores the outcome of the address check.
    """
    name, address = as_col(name), as_col(address)
    missing = F.when(name.isNull(), F.lit("Missing required field: business_name")) \
        .when(address.isNull(), F.lit("Missing required field: address"))
    tail = []
    if url is not None:
        tail.append((~blank(url) & ~as_col(url).rlike(_SCHEME_AND_HOST), "Invalid URL format"))
    if created_at is not None:
        tail.append((~blank(created_at) & ~is_iso_date(created_at), "Invalid created_at date format"))
    rest = messages(*tail) if tail else no_messages()
    body = F.concat(address_text_errors(address), rest) if propagate_address_errors else rest

    def after_name(e: Column) -> Column:
        ok = missing.isNull() & (F.size(e) == 0)
        errors = F.when(missing.isNotNull(), F.array(missing)).when(F.size(e) > 0, e).otherwise(body)
        return verdict(errors, F.when(ok, name_warnings(name)).otherwise(no_messages()))

    return let(name_errors(name), after_name)


def validate_search_result(url: ColumnLike, title: ColumnLike, score: ColumnLike | None = None) -> Column:
    """Verdict on a search result; a NULL score counts as absent."""
    url, title = as_col(url), as_col(title)
    missing = F.when(url.isNull(), F.lit("Missing required field: url")) \
        .when(title.isNull(), F.lit("Missing required field: title"))
    tests = [(F.length(title) < 3, "Title too short")]
    if score is not None:
        number = as_col(score).try_cast("double")
        tests += [
            (as_col(score).isNotNull() & number.isNull(), "Invalid relevance score type"),
            (number.isNotNull() & ~number.between(0.0, 1.0), "Relevance score must be between 0 and 1"),
        ]
    return verdict(F.when(missing.isNotNull(), F.array(missing)).otherwise(
        F.concat(url_errors(url), messages(*tests))))


def record_constraints(id: ColumnLike, name: ColumnLike, address: ColumnLike, state: ColumnLike,
                       zip_code: ColumnLike, created_at: ColumnLike, as_of: str) -> Column:
    """All violated record constraints; ``as_of`` (ISO date) stands for today."""
    id, state, zip_code, created = map(as_col, (id, state, zip_code, created_at))
    name_len, addr_len = F.length(strip(text(name))), F.length(strip(text(address)))
    iso = is_iso_date(created)
    return messages(
        (id.isNull() | (id <= 0), "id must be a positive integer"),
        (~name_len.between(2, 200), "business_name length must be between 2 and 200 characters"),
        (~addr_len.between(5, 200), "address length must be between 5 and 200 characters"),
        (state.isNotNull() & ~state.rlike(r"(?U)^\p{L}{2}\z"), "state must be a two-letter code"),
        (zip_code.isNotNull() & ~zip_code.rlike(fixed.ZIP_CODE),
         "zip_code must be in format XXXXX or XXXXX-XXXX"),
        (~iso, "created_at must be in format %Y-%m-%d"),
        (iso & (F.try_to_date(created, "y-M-d") > F.lit(as_of).cast("date")),
         "created_at cannot be in the future"),
    )


def first_violation(errors: Column) -> Column:
    return F.try_element_at(errors, F.lit(1))
