"""Address parsing and address validation (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions.base import (
    ColumnLike, as_col, blank, let, messages, strip, text, texts, verdict, words,
)

PARTS = "struct<street:string,city:string,state:string,zip_code:string>"


def normalize_state(c: ColumnLike) -> Column:
    """Two-letter code of a state text.

    Valid code, full name, then the first name that begins with the text; other
    two-character text passes through, anything else is NULL.
    """
    codes = [code for _, code in fixed.STATE_NAMES]
    table = F.expr("array(" + ", ".join(
        f"named_struct('name', '{n}', 'code', '{k}')" for n, k in fixed.STATE_NAMES) + ")")

    def resolve(s: Column) -> Column:
        named = F.try_element_at(F.filter(table, lambda e: e["name"] == s), F.lit(1))["code"]
        begun = F.try_element_at(F.filter(table, lambda e: F.startswith(e["name"], s)), F.lit(1))["code"]
        return F.when(s.isin(codes), s).otherwise(
            F.coalesce(named, begun, F.when(F.length(s) == 2, s)))

    return F.when(~blank(c), let(strip(F.upper(as_col(c))), resolve))


def parse_state_zip(c: ColumnLike, word_boundary: bool = True) -> Column:
    """struct<clean_address, state, zip_code> from the end of an address line.

    The first matching ending of ``ST ZIP``, ``ST``, ``ZIP`` is cut off.
    ``word_boundary=False`` lets the two letters be the tail of a longer word.
    """
    both, state, zip_ = (
        (fixed.STATE_ZIP_END_B, fixed.STATE_END_B, fixed.ZIP_END_B) if word_boundary
        else (fixed.STATE_ZIP_END, fixed.STATE_END, fixed.ZIP_END))

    def cut(a: Column, pattern: str) -> Column:
        return F.rtrim(strip(F.regexp_replace(a, pattern, "")), F.lit(","))

    def row(clean: Column, st: Column, zp: Column) -> Column:
        return F.struct(clean.alias("clean_address"), st.cast("string").alias("state"),
                        zp.cast("string").alias("zip_code"))

    def parse(a: Column) -> Column:
        none = F.lit(None)
        return F.when(a.rlike(both), row(
            cut(a, both), F.upper(F.regexp_extract(a, both, 1)), F.regexp_extract(a, both, 2))) \
            .when(a.rlike(state), row(cut(a, state), F.upper(F.regexp_extract(a, state, 1)), none)) \
            .when(a.rlike(zip_), row(cut(a, zip_), none, F.regexp_extract(a, zip_, 1))) \
            .otherwise(row(a, none, none))

    return F.when(~blank(c), let(strip(c), parse))


def _parts(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    return F.struct(street.cast("string").alias("street"), city.cast("string").alias("city"),
                    state.cast("string").alias("state"), zip_code.cast("string").alias("zip_code"))


def split_address(c: ColumnLike) -> Column:
    """struct<street, city, state, zip_code> of a comma-separated address."""
    none = F.lit(None).cast("string")

    def by_comma(pieces: Column) -> Column:
        n = F.size(pieces)

        def by_word(tokens: Column) -> Column:
            k = F.size(tokens)
            last = F.element_at(tokens, -1)
            enough = (n >= 2) & (k >= 2)
            zip_hit = enough & last.rlike(fixed.ZIP_CODE)
            left = F.when(zip_hit, F.slice(tokens, F.lit(1), k - 1)).otherwise(tokens)

            def rest(r: Column) -> Column:
                code = F.upper(F.element_at(r, -1))
                state_hit = enough & code.isin(fixed.VALID_STATES)
                town = F.when(state_hit, F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)
                city = F.when(enough, F.nullif(F.array_join(town, " "), F.lit("")))
                return _parts(
                    pieces[0],
                    F.coalesce(city, F.when(n >= 3, pieces[1])),
                    F.when(state_hit, code), F.when(zip_hit, last))

            return let(left, rest)

        last_piece = words(F.element_at(pieces, -1))
        return let(F.when(F.size(last_piece) == 0, texts([""])).otherwise(last_piece), by_word)

    return F.when(as_col(c).isNull(), _parts(none, none, none, none)).otherwise(
        let(F.transform(F.split(as_col(c), ","), strip), by_comma))


def _found_once(tail: str, groups: str) -> str:
    """A pattern that finds what the fixed free-text patterns find, in linear time.

    A comma-free stretch can only match from its first digit on, so a match is sought once for each
    stretch, and only where what has to follow (``tail``, after one comma or two) does follow.
    """
    ahead = rf"(?=[^,]*+,(?:[^,]++,)?{tail})" if tail else ""
    return rf"(?i)(?:^|,)[^,\d]*+{ahead}(\d[^,]+)(?:,|\sin\s)([^,]++){groups}"


_STATE, _ZIP = r"\s*[A-Za-z]{2}", r"\s*\d{5}(?:-\d{4})?"
_STATE_GROUP, _ZIP_GROUP = r",\s*([A-Za-z]{2})", r"\s*(\d{5}(?:-\d{4})?)"


def extract_address(c: ColumnLike, word_boundary: bool = True) -> Column:
    """First address found in free text as struct<street, city, state, zip_code>, else NULL.

    Every pattern reads the text once; the parts are then taken from the short stretch it found.
    """
    end = r"\b" if word_boundary else ""
    patterns = [(_found_once(_STATE + _ZIP + end, _STATE_GROUP + _ZIP_GROUP + end), 4),
                (_found_once(_STATE + end, _STATE_GROUP + end), 3), (_found_once("", ""), 2)]

    def found(t: Column, pattern: str, groups: int) -> Column:
        def parts(hit: Column) -> Column:
            vals = [strip(F.regexp_extract(hit, pattern, i)) for i in range(1, groups + 1)]
            return F.when(hit != "", _parts(*vals, *[F.lit(None)] * (4 - groups)))
        return let(F.regexp_extract(t, pattern, 0), parts)

    def parse(t: Column) -> Column:
        return F.coalesce(*[found(t, pattern, groups) for pattern, groups in patterns])

    # every pattern needs a digit
    return F.when(as_col(c).rlike("[0-9]"), let(as_col(c), parse))


def one_line(parts: Column) -> Column:
    """'street, city, state zip' text of a parts struct."""
    tail = F.concat_ws(" ", parts["state"], parts["zip_code"])
    return F.array_join(F.array_compact(F.array(
        F.nullif(parts["street"], F.lit("")), F.nullif(parts["city"], F.lit("")),
        F.nullif(tail, F.lit("")))), ", ")


def is_valid_state(c: ColumnLike) -> Column:
    return F.coalesce(F.upper(as_col(c)).isin(fixed.VALID_STATES), F.lit(False))


def is_valid_zip(c: ColumnLike) -> Column:
    return F.coalesce(as_col(c).rlike(fixed.ZIP_CODE), F.lit(False))


def is_valid_street(c: ColumnLike) -> Column:
    """Two words or more, a leading number and a street-type word."""
    return let(words(F.lower(text(c))), lambda w: (F.size(w) >= 2)
               & F.coalesce(w[0].rlike(r"^\d"), F.lit(False))
               & F.arrays_overlap(w, texts(fixed.STREET_TYPES)))


_CITY = r"(?U)^[\p{L}\s'\-.]*$"


def _city_messages(city: Column) -> list[tuple[Column, str]]:
    return [
        (F.length(city) < 2, "City name too short"),
        ((F.length(city) >= 2) & ~city.rlike(_CITY), "City contains invalid characters"),
    ]


def validate_address_parts(street: ColumnLike, city: ColumnLike, state: ColumnLike,
                           zip_code: ColumnLike) -> Column:
    """Verdict on given parts: NULL is a missing field, the first missing one is reported."""
    cols = {"street": as_col(street), "city": as_col(city), "state": as_col(state),
            "zip_code": as_col(zip_code)}
    missing = F.lit(None).cast("string")
    for name in reversed(list(cols)):
        missing = F.when(cols[name].isNull(), F.lit(f"Missing required field: {name}")).otherwise(missing)
    errors = messages(
        (~is_valid_street(cols["street"]), "Invalid street format"),
        *_city_messages(cols["city"]),
        (~cols["state"].isin(fixed.VALID_STATES), "Invalid state code"),
        (~cols["zip_code"].rlike(fixed.ZIP_CODE), "Invalid ZIP code format"),
    )
    return verdict(F.when(missing.isNotNull(), F.array(missing)).otherwise(errors))


def component_errors(parts: Column) -> Column:
    """Error messages for parsed parts, with a message per missing part."""
    street, city, state, zip_code = (parts[f] for f in ("street", "city", "state", "zip_code"))
    return messages(
        (blank(street), "Missing street"),
        (~blank(street) & ~is_valid_street(street), "Invalid street format"),
        (blank(city), "Missing city"),
        *[(~blank(city) & cond, msg) for cond, msg in _city_messages(city)],
        (blank(state), "Missing state"),
        (~blank(state) & ~state.isin(fixed.VALID_STATES), "Invalid state code"),
        (blank(zip_code), "Missing ZIP code"),
        (~blank(zip_code) & ~zip_code.rlike(fixed.ZIP_CODE), "Invalid ZIP code format"),
    )


def validate_components(parts: Column) -> Column:
    return verdict(let(parts, component_errors))


def address_text_errors(c: ColumnLike) -> Column:
    c = as_col(c)
    bad = "(?i)" + "|".join(fixed.BAD_ADDRESS)
    return F.when(c.isNull() | c.rlike(bad), texts(["Invalid address format"])) \
        .when(F.length(c) < 5, texts(["Address too short"])) \
        .when(~c.rlike(r"(?U)\d"), texts(["Address must contain at least one number"])) \
        .otherwise(let(split_address(c), component_errors))


def validate_address_text(c: ColumnLike) -> Column:
    """Verdict on an address text: format, length, digits, then its parsed parts."""
    return verdict(address_text_errors(c))


def match_state(c: ColumnLike, target: str | Column) -> Column:
    """struct<is_valid, message> of a state against a wanted state."""
    want = F.upper(F.lit(target) if isinstance(target, str) else target)
    s = F.upper(text(c))
    message = F.when(blank(c), F.lit("State is required")) \
        .when(~s.isin(fixed.VALID_STATES), F.concat(F.lit("Invalid state code: "), s)) \
        .when(s != want, F.concat(F.lit("State "), s, F.lit(" does not match target state "), want))
    return let(message, lambda m: F.struct(m.isNull().alias("is_valid"), m.alias("message")))


