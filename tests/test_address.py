import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tradebook import fixed
from tradebook.functions import address as A
from tradebook.functions import checks as K


def test_normalize_state(evaluate):
    pairs = {"NY": "NY", " ny ": "NY", "new york": "NY", "NEW": "NH", "A": "AL", "TE": "TN", "DC": "DC", "..": "..",
             "Ontario": None, "": None, None: None, "   ": "AL", "West V": "WV"}
    assert evaluate(A.normalize_state, list(pairs)) == list(pairs.values())


def test_normalize_state_is_idempotent(evaluate):
    once = evaluate(A.normalize_state, ["new york", "cal", "tx"])
    assert evaluate(A.normalize_state, once) == once


def _state_zip(evaluate, texts, boundary):
    return [None if v is None else tuple(v) for v in evaluate(lambda c: A.parse_state_zip(c, boundary), texts)]


def test_parse_state_zip(evaluate):
    texts = ["1 Elm St, Troy, NY 12180", "1 Elm St, Troy ny", "1 Elm St, 12180-1234", "1 Elm St", "", None,
             "123 Main Street", "Albany 12207"]
    assert _state_zip(evaluate, texts, True) == [
        ("1 Elm St, Troy", "NY", "12180"), ("1 Elm St, Troy", "NY", None), ("1 Elm St", None, "12180-1234"),
        ("1 Elm", "ST", None), None, None, ("123 Main Street", None, None), ("Albany", None, "12207")]
    loose = _state_zip(evaluate, texts[-2:], False)
    assert loose == [("123 Main Stre", "ET", None), ("Alba", "NY", "12207")]


def test_split_address(evaluate):
    texts = ["123 Main Street, New York, NY 10001", "1 Elm St", "1 Elm St, Troy NY", "1 Elm St, Troy", "a, b c, 12180 x", None]
    assert [tuple(v) for v in evaluate(A.split_address, texts)] == [
        ("123 Main Street", "New York", "NY", "10001"), ("1 Elm St", None, None, None), ("1 Elm St", "Troy", "NY", None),
        ("1 Elm St", None, None, None), ("a", "12180 x", None, None), (None, None, None, None)]


def test_extract_address(evaluate):
    texts = ["Visit 12 Oak St, Troy, NY 12180 today", "12 Oak St in Troy, New York", "12 Oak St, Troy", "no digits here", None]
    got = evaluate(A.extract_address, texts)
    assert [None if v is None else tuple(v) for v in got] == [
        ("12 Oak St", "Troy", "NY", "12180"), ("12 Oak St in Troy", "New York", None, None), ("12 Oak St", "Troy", None, None), None, None]
    loose = evaluate(lambda c: A.extract_address(c, False), texts[1:2])[0]
    assert tuple(loose) == ("12 Oak St", "Troy", "Ne", None)


def test_linear_patterns_equal_nested_ones():
    nested = {
        fixed.ADDRESS_ZIP: r"(?i)(\d+[^,]+(?:\s+[^,]+)*?)(?:,|\sin\s)([^,]+),\s*([A-Za-z]{2})\s*(\d{5}(?:-\d{4})?)",
        fixed.ADDRESS_STATE: r"(?i)(\d+[^,]+(?:\s+[^,]+)*?)(?:,|\sin\s)([^,]+),\s*([A-Za-z]{2})",
        fixed.ADDRESS_CITY: r"(?i)(\d+[^,]+(?:\s+[^,]+)*?)(?:,|\sin\s)([^,]+)",
    }
    rnd = random.Random(7)
    bits = ["1", "12345", " ", ",", "a", "NY", " in ", "-1234", ", ", "x y"]
    for _ in range(3000):
        s = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 9)))
        for linear, slow in nested.items():
            a, b = re.search(linear, s), re.search(slow, s)
            assert (a and a.groups()) == (b and b.groups()), s


@pytest.mark.parametrize("boundary", [True, False])
def test_extracted_addresses_equal_the_patterns(evaluate, boundary):
    """The column form against the fixed patterns, tried in order by another regular-expression engine."""
    patterns = [fixed.ADDRESS_ZIP_B, fixed.ADDRESS_STATE_B] if boundary else [fixed.ADDRESS_ZIP, fixed.ADDRESS_STATE]
    rnd = random.Random(17)
    bits = ["1", "12345", " ", ",", "a", "NY", " in ", "-1234", ", ", "x y", "\n", "z", ", ny 12345", " IN "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12))) for _ in range(4000)]

    def expected(t):
        for p in [*patterns, fixed.ADDRESS_CITY]:
            m = re.search(p, t, re.ASCII)
            if m:
                vals = [g.strip(" \t\n\r\f\v") for g in m.groups()]
                return (*vals, *[None] * (4 - len(vals)))
        return None

    got = evaluate(lambda c: A.extract_address(c, boundary), texts)
    wrong = [(t, g and tuple(g), expected(t)) for t, g in zip(texts, got, strict=True) if (g and tuple(g)) != expected(t)]
    assert not wrong, wrong[:3]


HOSTILE = ["1" * 100_000, "1 in " * 20_000, "word 7 " * 15_000, "1 in, " * 17_000, "12 a, b, N" * 10_000, ",1 in 2" * 14_000]


def test_long_texts_take_linear_time(spark, evaluate):
    for value in HOSTILE:
        began = time.perf_counter()
        evaluate(A.extract_address, [value])
        assert time.perf_counter() - began < 10, value[:20]


def test_mail_in_long_texts(evaluate):
    from tradebook.functions.text import format_address
    began = time.perf_counter()
    got = evaluate(format_address, ["x." * 50_000 + " 1 a@b.c-d@e.f 5 Main", "a" * 100_000 + "@", "1 me@x.org, 2 you@y.co.uk"])
    assert time.perf_counter() - began < 20
    assert "@" not in got[0] and "@" not in got[2]


VALID = ["123 Main Street, New York, NY 10001", "456 Broadway Ave, Brooklyn, NY 11201", "789 Queens Blvd, Queens, NY 11375",
         "321 N Main St, Albany, NY 12207", "654 SW Broadway Dr, Buffalo, NY 14201",
         "123 Main Street, Los Angeles, CA 90001", "456 Broadway Ave, Brooklyn, NY 00000"]
INVALID = ["Invalid Address", "", "test@example.com", "http://example.com", "123-456-7890", "P.O. Box 123",
           "Private Mailbox 456", "General Delivery", None]


def test_validate_address_text(evaluate):
    out = evaluate(A.validate_address_text, VALID + INVALID)
    assert [v["is_valid"] for v in out] == [True] * len(VALID) + [False] * len(INVALID)
    assert {v["confidence"] for v in out[:len(VALID)]} == {1.0}
    assert out[-1]["errors"] == ["Invalid address format"]


STREETS = {
    True: ["123 Main Street", "456 Broadway Ave", "789 5th Avenue", "321 N Main St", "654 SW Broadway Dr",
           "987 NE Central Pkwy", "789 Central Rd", "321 Oak Blvd", "654 Pine Ln", "147 Cedar Ct", "258 Park Cir",
           "369 Market Plz", "741 Town Sq", "258 SW Park Way"],
    False: ["Main Street", "123", "", "ABC Main St", "123 Invalid", "456 S Broadway", None],
}


@pytest.mark.parametrize("expected", [True, False])
def test_streets(evaluate, expected):
    assert evaluate(A.is_valid_street, STREETS[expected]) == [expected] * len(STREETS[expected])


def test_address_parts(evaluate):
    good = [("123 Main St", c, "NY", "10001") for c in ["New York", "Albany-West", "St. Louis", "Winston-Salem", "O'Fallon"]]
    good += [("123 Main St", "New York", "NY", z) for z in ["10001", "12345-6789", "00123", "99999"]]
    bad = [("123 Main St", c, "NY", "10001") for c in ["", "A", "New York123", "Test@City"]]
    bad += [("123 Main St", "New York", "NY", z) for z in ["", "1234", "123456", "1234-5678", "ABCDE", "12345-", "-12345", None]]
    bad += [("123 Main St", "New York", "ny", "10001")]
    out = evaluate(A.validate_address_parts, good + bad, ("s", "c", "t", "z"))
    assert [v["is_valid"] for v in out] == [True] * len(good) + [False] * len(bad)
    assert out[-2]["errors"] == ["Missing required field: zip_code"]


def test_match_state(evaluate):
    cases = [("NY", "NY", True), ("CA", "NY", False), ("", "NY", False), ("XX", "NY", False), ("ny", "NY", True), ("NY", "ny", True)]
    out = evaluate(lambda s, t: A.match_state(s, F.col(t)), [c[:2] for c in cases], ("s", "t"))
    assert [v["is_valid"] for v in out] == [c[2] for c in cases]
    assert out[2]["message"] == "State is required"


def test_domains(evaluate):
    urls = ["https://example.com/path", "http://test.org/page", "https://invalid.com", "not_a_url", "", "https://www.example.com:80/x", "https://badexample.com"]
    assert evaluate(lambda c: K.in_allowed_domains(c, ["example.com", "test.org"]), urls) \
        == [True, True, False, False, False, True, False]


def test_names(evaluate):
    out = evaluate(K.validate_name, ["Nathan's", "A", "Joe's Shop inc ltd", "Joe LLC", "@@## ab", None])
    assert [v["errors"] for v in out] == [
        ["Business name contains invalid term: na"], ["Business name too short"], [], [],
        ["Business name contains too many special characters"], ["Business name too short"]]
    assert out[2]["warnings"] == ["Inconsistent Inc. formatting"]
    assert out[3]["warnings"] == []


def test_address_errors_can_be_ignored(evaluate):
    row = [("Joe Shop", "P.O. Box 1")]
    assert evaluate(lambda n, a: K.validate_business(n, a), row, ("n", "a"))[0]["errors"] == ["Invalid address format"]
    assert evaluate(lambda n, a: K.validate_business(n, a, propagate_address_errors=False), row, ("n", "a"))[0]["is_valid"]
