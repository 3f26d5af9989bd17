"""Small Column helpers shared by all functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradebook.fixed import SPACE_RUN, SPACES

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: ColumnLike) -> Column:
    """True for NULL and for the empty text: both count as missing."""
    c = as_col(c)
    return c.isNull() | (c == "")


def text(c: ColumnLike) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def strip(c: ColumnLike) -> Column:
    return F.btrim(as_col(c), F.lit(SPACES))


def words(c: ColumnLike) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.filter(F.split(as_col(c), SPACE_RUN), lambda w: w != "")


def capture(c: ColumnLike, pattern: str, group: int) -> Column:
    """A regular-expression group, NULL where there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(as_col(c), pattern, group), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def quoted(value: str) -> str:
    """The text as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values: Iterable[str]) -> Column:
    """Array of fixed texts, built in one call."""
    return F.expr("array(" + ", ".join(quoted(v) for v in values) + ")")


def contains_any(c: Column, values: Iterable[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | c.contains(v)
    return out


def count_hits(c: Column, values: Iterable[str]) -> Column:
    """How many of the fixed words occur in the text."""
    out = F.lit(0)
    for v in values:
        out = out + c.contains(v).cast("int")
    return out


def messages(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the messages whose condition holds, in the given order."""
    return F.array_compact(F.array(*[
        F.when(cond, F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in pairs
    ])).cast("array<string>")


def no_messages() -> Column:
    return F.array().cast("array<string>")


def verdict(errors: Column, warnings: Column | None = None) -> Column:
    """struct<is_valid, errors, warnings, confidence> of a validation."""
    return let(errors, lambda e: F.struct(
        (F.size(e) == 0).alias("is_valid"),
        e.alias("errors"),
        (no_messages() if warnings is None else warnings).alias("warnings"),
        F.when(F.size(e) == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("confidence"),
    ))


def joined(errors: Column) -> Column:
    """The errors as one message, NULL when there is none."""
    return F.nullif(F.array_join(errors, "; "), F.lit(""))
