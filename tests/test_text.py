import hashlib

from pyspark.sql import functions as F

from tradebook.functions import text as X
from tradebook.functions.base import strip, words


def test_clean_text(evaluate):
    pairs = {" test  text ": "test text", "": "", None: "", "  multiple   spaces  ": "multiple spaces",
             "a\n\r\tb": "a b", " x 　y\x1c": "x y"}
    assert evaluate(X.clean_text, list(pairs)) == list(pairs.values())


def test_clean_text_is_idempotent(evaluate):
    once = evaluate(X.clean_text, [" a \n b ", "\t", "x  y"])
    assert evaluate(X.clean_text, once) == once


def test_white_space_matches_python(evaluate):
    texts = ["".join([c, "a", c, c, "b", c]) for c in map(chr, range(0x3100)) if c.isspace()]
    assert evaluate(strip, texts) == [t.strip() for t in texts]
    assert evaluate(words, texts) == [t.split() for t in texts]


def test_cleaning_tables(evaluate):
    pairs = {"Normal Text": "Normal Text", " Extra  Spaces ": "Extra Spaces",
             "Special@#$Characters": "SpecialCharacters", "": "", None: ""}
    assert evaluate(X.strip_specials, list(pairs)) == list(pairs.values())
    assert evaluate(X.strict_state, ["NY", "new york", "123", "", None]) == ["NY", "", "", "", ""]
    assert evaluate(X.zip5, ["10001", "10001-1234", "abc", "123", ""]) == ["10001", "10001", "", "", ""]


def test_parse_date(evaluate):
    pairs = {"2024-01-01": "2024-01-01", "01/01/2024": "2024-01-01", "31-12-2023": "2023-12-31",
             "2024/2/9": "2024-02-09", "2024-1-5": "2024-01-05", "2024-02-30": None, "invalid": None, "": None,
             " 2024-03-04 ": "2024-03-04", "13/01/2024": None}
    assert evaluate(X.parse_date, list(pairs)) == list(pairs.values())


def test_url_domain(evaluate):
    pairs = {"https://example.com/path": "example.com", "http://test.org": "test.org", "invalid_url": "", "": "",
             "http://a_b.example.com:8080?x": "a_b.example.com:8080"}
    assert evaluate(X.url_domain, list(pairs)) == list(pairs.values())


def test_format_address(evaluate):
    pairs = {
        "": "", None: "", "info@shop.com\n 12 Main St \n\nTroy\n12180": "12 Main St, Troy, 12180",
        "Main Street,, Troy": "[PARTIAL] Main Street, Troy", ",": "[PARTIAL] ", "a@b.com": "",
        "1 Elm St,\tTroy ,": "1 Elm St, Troy",
    }
    assert evaluate(X.format_address, list(pairs)) == list(pairs.values())


def test_model_answers(evaluate):
    assert evaluate(X.parse_model_query, ['"enhanced business query"', "location of\nshop", "  spaces  ", "co", None, '"']) \
        == ["enhanced business query", "location of shop", None, None, None, None]
    assert evaluate(X.parse_model_score, ["0.75", "invalid score", " 3 ", "-1", None]) == [0.75, 0.5, 1.0, 0.0, 0.5]


def test_sensitive_keys(evaluate):
    keys = ["password", "secret_key", "auth_token", "private_key", "credentials", "name", "age", "address", "phone"]
    assert evaluate(X.is_sensitive_key, keys) == [True] * 5 + [False] * 4


def test_business_key(evaluate):
    assert evaluate(X.business_key, [("Test Business", "123 Main St"), (" A ", None)], ("n", "a")) \
        == ["test business|123 main st", "a|"]


def test_params_key(spark):
    df = spark.range(1).select(X.params_key(F.array(F.lit("u"), F.lit("1")), F.create_map(
        F.lit("b"), F.lit("2"), F.lit("a"), F.lit("x"))).alias("k"))
    assert df.first()["k"] == hashlib.md5(b"u|1|a=x|b=2").hexdigest()


def test_priorities_and_metrics(evaluate):
    assert evaluate(X.event_priority, ["NODE_DOWN", "BACKUP", "CLEANUP", "GET"]) == ["HIGH", "MEDIUM", "LOW", "LOW"]
    assert evaluate(X.severity_priority, ["ERROR", "Warning", "x"]) == ["HIGH", "MEDIUM", "LOW"]
    assert evaluate(X.metric_name, ["database.a.b", "cache.hits", "other.x", "database"]) \
        == ["db_a.b", "cache_hits", "other.x", "database"]


def test_labels(spark):
    df = spark.createDataFrame([("A", "1 St", None, "")], "n string, a string, s string, z string")
    assert df.select(X.record_label("n", "a", "s", "z").alias("v")).first()["v"] \
        == "Business(name='A', address='1 St', state='N/A', zip='N/A')"
