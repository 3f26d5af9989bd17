"""Text, key, date, prompt and label functions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions.base import (
    ColumnLike, as_col, blank, contains_any, let, strip, text,
)


def clean_text(c: ColumnLike) -> Column:
    """NULL becomes '', white-space runs become one space, ends are trimmed."""
    return F.trim(collapse(text(c)))


def collapse(c: Column) -> Column:
    """Every white-space run as one space."""
    return F.regexp_replace(c, fixed.SPACE_RUN, " ")


def format_address(c: ColumnLike) -> Column:
    """One-line address: e-mails dropped, lines joined by commas, text without digits marked.

    A lone ZIP line needs no special step: joining lines by ", " already attaches it.
    """
    raw = text(c)
    # a match can only begin where a run of its characters begins, or where the match before ended
    mail = r"(?U)(?:\G|(?<![\w.\-]))" + fixed.EMAIL_IN_TEXT.replace("+@", "++@", 1)
    no_mail = F.when(raw.contains("@"), F.regexp_replace(raw, mail, "")) \
        .otherwise(raw)
    lines = F.filter(F.transform(F.split(no_mail, "\n"), strip), lambda p: p != "")

    def finish(parts: Column) -> Column:
        one = F.array_join(parts, ", ")
        one = F.regexp_replace(one, f",{fixed.SPACE_RUN}?,", ",")
        one = F.btrim(collapse(one), F.lit(" ,"))
        return F.when(F.size(parts) == 0, F.lit("")).otherwise(let(
            one, lambda a: F.when(a.rlike(r"(?U)\d"), a).otherwise(F.concat(F.lit("[PARTIAL] "), a))))

    return let(lines, finish)


def parse_date(c: ColumnLike) -> Column:
    """ISO text of the first matching date format, else NULL."""
    def attempt(s: Column) -> Column:
        out = F.lit(None).cast("date")
        for pattern, fmt in reversed(fixed.DATE_FORMATS):
            out = F.when(s.rlike(pattern), F.try_to_date(s, fmt)).otherwise(out)
        return F.date_format(out, "yyyy-MM-dd")
    return let(strip(c), attempt)


def is_iso_date(c: ColumnLike) -> Column:
    """True where the text is a real year-month-day date."""
    c = as_col(c)
    return F.coalesce(
        c.rlike(fixed.DATE_FORMATS[0][0]) & F.try_to_date(c, "y-M-d").isNotNull(), F.lit(False))


def strip_specials(c: ColumnLike) -> Column:
    """Drop characters that are neither letters, digits, spaces nor ``.,-``; collapse spaces."""
    return clean_text(F.regexp_replace(text(c), r"(?U)[^\w\s.,\-]", ""))


def zip5(c: ColumnLike) -> Column:
    """First five digits of a ZIP or ZIP+4, '' for anything else."""
    return F.regexp_extract(text(c), r"^(\d{5})(?:-\d{4})?$", 1)


def strict_state(c: ColumnLike) -> Column:
    """The text if it is a two-letter upper-case code, else ''."""
    return F.when(text(c).rlike("^[A-Z]{2}$"), text(c)).otherwise(F.lit(""))


def business_key(name: ColumnLike, address: ColumnLike) -> Column:
    """Identity of a record: lower-case trimmed name and address."""
    return F.concat_ws("|", strip(F.lower(text(name))), strip(F.lower(text(address))))


def params_key(args: Column, kwargs: Column) -> Column:
    """md5 over the arguments and the sorted ``name=value`` pairs."""
    pairs = F.transform(F.array_sort(F.map_entries(kwargs)),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.md5(F.array_join(F.concat(args, pairs), "|"))


def url_domain(c: ColumnLike) -> Column:
    """Network location of a URL (port kept), '' when there is none."""
    return F.regexp_extract(text(c), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def search_url(name: ColumnLike, source: str) -> Column:
    gap, head, tail = fixed.SEARCH_URLS[source]
    return F.concat(F.lit(head), F.replace(as_col(name), F.lit(" "), F.lit(gap)), F.lit(tail))


def fallback_query(name: ColumnLike) -> Column:
    return F.concat_ws(" ", as_col(name), *[F.lit(t) for t in fixed.FALLBACK_TERMS])


def build_prompt(name: ColumnLike) -> Column:
    return F.format_string(fixed.QUERY_PROMPT, as_col(name))


def build_score_prompt(title: ColumnLike, description: ColumnLike, url: ColumnLike) -> Column:
    return F.format_string(fixed.SCORE_PROMPT, text(title), text(description), text(url))


def parse_model_query(c: ColumnLike) -> Column:
    """Usable query out of a model answer, NULL when too short or off topic."""
    def unquote(s: Column) -> Column:
        return F.when(s.startswith('"') & s.endswith('"') & (F.length(s) >= 2),
                      strip(F.substring(s, F.lit(2), F.length(s) - 2))) \
            .when(s == '"', F.lit("")).otherwise(s)
    return let(let(clean_text(c), unquote), lambda q: F.when(
        (F.length(q) >= 5) & contains_any(F.lower(q), fixed.MODEL_QUERY_TERMS), q))


def parse_model_score(c: ColumnLike) -> Column:
    """Number clamped to [0, 1]; 0.5 for anything that is no number."""
    return let(strip(c).try_cast("double"), lambda v: F.when(v.isNull(), F.lit(0.5))
               .when(F.isnan(v), v)
               .otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))))


def event_priority(c: ColumnLike) -> Column:
    c = as_col(c)
    return F.when(c.isin(fixed.HIGH_EVENTS), F.lit("HIGH")) \
        .when(c.isin(fixed.MEDIUM_EVENTS), F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def severity_priority(c: ColumnLike) -> Column:
    c = F.lower(as_col(c))
    return F.when(c == "error", F.lit("HIGH")).when(c == "warning", F.lit("MEDIUM")) \
        .otherwise(F.lit("LOW"))


def metric_name(c: ColumnLike) -> Column:
    """Known first part of a dotted name is replaced by its short prefix and ``_``."""
    c = as_col(c)
    head = F.substring_index(c, ".", 1)
    out = c
    for name, prefix in fixed.METRIC_PREFIXES.items():
        out = F.when(c.contains(".") & (head == name),
                     F.concat(F.lit(prefix + "_"), F.substring(c, F.lit(len(name) + 2), F.length(c)))) \
            .otherwise(out)
    return out


def error_metric_name(c: ColumnLike) -> Column:
    return F.concat(F.lit("error_"), F.lower(as_col(c)))


def is_sensitive_key(c: ColumnLike) -> Column:
    return contains_any(F.lower(as_col(c)), fixed.SENSITIVE_WORDS)


def mask_token(c: ColumnLike) -> Column:
    return F.concat(F.substring(as_col(c), 1, 8), F.lit("..."))


def alert_text(severity: ColumnLike, rule: ColumnLike, message: ColumnLike) -> Column:
    return F.concat(F.lit("["), F.upper(as_col(severity)), F.lit("] "), as_col(rule), F.lit(": "),
                    as_col(message))


def record_label(name: ColumnLike, address: ColumnLike, state: ColumnLike, zip_code: ColumnLike,
                 id: ColumnLike | None = None, created: ColumnLike | None = None) -> Column:
    """Readable one-line label; missing state and ZIP show as N/A."""
    def or_na(c):
        return F.when(blank(c), F.lit("N/A")).otherwise(as_col(c))
    parts = []
    if id is not None:
        parts += [F.lit("id="), as_col(id).cast("string"), F.lit(", ")]
    parts += [F.lit("name='"), as_col(name), F.lit("', address='"), as_col(address),
              F.lit("', state='"), or_na(state), F.lit("', zip='"), or_na(zip_code), F.lit("'")]
    if created is not None:
        parts += [F.lit(", created='"), as_col(created), F.lit("'")]
    return F.concat(F.lit("Business("), *parts, F.lit(")"))
