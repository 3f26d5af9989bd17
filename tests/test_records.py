import pytest
from pyspark.sql import functions as F

from tradebook.functions import checks as K
from tradebook.functions import rules as R
from tradebook.operators import keyed, mentions, quality, ranking, records

COLS = "id bigint, business_name string, address string, state string, zip_code string, created_at string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLS)


def test_clean_business_flags(spark):
    df = frame(spark, (1, " A ", "1 Elm, Troy, NY 12180", "new york", None, "d"), (0, "B", "x", None, None, "d"),
               (2, "C", "1 Elm", "ca", " 9 ", "d"), (3, "", "1 Elm", None, None, "d"), (4, "D", "1 Elm, 12180", None, "55", "d"))
    got = {r["id"]: (r["business_name"], r["address"], r["state"], r["zip_code"]) for r in records.clean_business(df).collect()}
    assert got == {1: ("A", "1 Elm, Troy", "NY", "12180"), 2: ("C", "1 Elm", "CA", "9"), 4: ("D", "1 Elm", None, "55")}
    dropped = {r["id"]: (r["state"], r["zip_code"]) for r in records.clean_business(df, keep_given=False).collect()}
    assert dropped == {1: (None, "12180"), 2: ("CA", "9"), 4: (None, None)}


def test_missing_optional_columns(spark):
    df = spark.createDataFrame([(1, "A", "1 Elm, Troy, NY 12180", "d")], "id bigint, business_name string, address string, created_at string")
    assert records.clean_business(df).first()["state"] == "NY"


def test_coerce_and_constraints(spark):
    df = spark.createDataFrame([("1", "  Test Business  ", "  123 Test St  ", "  ny  ", "  10001  ", "2024-01-01"),
                                ("x", "A", "12", None, "", "2024/01/01")], COLS.replace("bigint", "string"))
    first, second = sorted(records.coerce_record(df).collect(), key=lambda r: r["business_name"], reverse=True)
    assert tuple(first) == (1, "Test Business", "123 Test St", "NY", "10001", "2024-01-01")
    assert second["id"] is None and second["zip_code"] is None


def test_record_constraints(evaluate):
    base = (1, "Test LLC", "123 Test St", "NY", "10001", "2024-01-01")
    cols = ("id bigint", "n", "a", "s", "z", "d")
    changes = [(), (0, -1), (1, "A"), (1, "A" * 201), (2, "12"), (3, "123"), (4, "123"), (5, "2024/01/01"), (5, "2024-06-02")]
    rows = [tuple(c[1] if c and k == c[0] else v for k, v in enumerate(base)) for c in changes]
    out = evaluate(lambda *c: K.record_constraints(*c, as_of="2024-06-01"), rows, cols)
    assert out[0] == []
    for found, word in zip(out[1:], ["positive", "business_name length", "business_name length", "address length",
                                     "two-letter", "zip_code", "format %Y-%m-%d", "future"], strict=True):
        assert len(found) == 1 and word in found[0]


def test_duplicates(spark):
    df = frame(spark, (3, "Test Business", "123 Main St", None, None, "d"), (1, "test business ", "123 MAIN ST", None, None, "d"),
               (2, "Test Business", "456 Other St", None, None, "d"), (4, None, None, None, None, "d"), (5, None, None, None, None, "d"))
    kept = records.dedup_businesses(df)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4]
    assert records.dedup_businesses(kept).count() == 3
    marks = {r["id"]: r["is_duplicate"] for r in records.mark_duplicates(df, "business_name").collect()}
    assert marks == {1: False, 2: False, 3: True, 4: False, 5: True}
    assert sorted((r["id"], r["total_duplicates"]) for r in records.duplicate_summary(df, "business_name").collect()) == [(3, 2), (5, 2)]


def test_rules_on_nested_and_typed_fields(spark):
    df = spark.createDataFrame([("ab", (None, [1, 2, 3]), True)], "s string, n struct<x:string,l:array<int>>, b boolean")
    rules = {"s": R.Rule(str, min_length=3, pattern="a"), "b": R.Rule(int), "gone": R.Rule(str, required=False),
             "n": R.Rule(dict, nested={"x": R.Rule(str), "l": R.Rule(list, max_length=2)})}
    issues = R.validate_rules(df, rules).select(F.explode(R.issue_lines(F.col("issues"))).alias("v")).collect()
    assert [r["v"] for r in issues] == ["s: Length must be at least 3", "n.x: Required field is missing", "n.l: Length must be at most 2"]


def test_variant_checks(evaluate):
    texts = ['{"a": [1, "x", {"b": ""}]}', '{"a": 1}', '[null]', '"' + "x" * 1001 + '"', "nope", None]
    out = [tuple(v) for v in evaluate(lambda c: R.validate_variant(F.col(c)), texts)]
    assert out == [(False, ".a[2].b", "String too short (min 1)"), (True, None, None),
                   (False, "[0]", "Type NoneType not allowed"), (False, "", "String too long (max 1000)"),
                   (False, "", "Invalid JSON"), (False, "", "Type NoneType not allowed")]


def test_input_report(spark):
    df = frame(spark, (1, "Joe Shop", "123 Main St, Troy, NY 12180", None, None, "d"), (2, "Joe Shop", None, None, None, "d"), (3, "x", "1", None, None, "d"))
    v = quality.validate_input(df)
    assert tuple(quality.input_totals(v).first()) == (3, 2, 1, 0, 1, False)
    assert [tuple(r) for r in quality.error_table(v).collect()] == [(3, "x", "Business name too short")]


def test_hot_business_keeps_all_results(spark):
    rows = spark.range(3000).select(
        F.lit(1).alias("business_id"), F.lit("Acme").alias("business_name"), F.col("id").alias("pos"),
        F.concat(F.lit("https://x.example/"), (F.col("id") % 500).cast("string")).alias("url"),
        F.lit("Acme").alias("title"), F.lit("").alias("description"))
    top = ranking.top_results(rows, 3)
    assert [(r["pos"], r["total_results"]) for r in top.orderBy("pos").collect()] == [(0, 500), (1, 500), (2, 500)]


@pytest.mark.parametrize("letters", [10 ** 6, 12])
def test_name_mentions_equals_brute_force(spark, letters):
    names = ["acme 1", "ACME 1", "acme 12", "me", "Joe's", "é", "in the middle", "x" * 40, "", None]
    texts = [None, "ACME 123", "some joe's acme 1", "home", "café", "word in  the middle", "in the middle", "x" * 50, "", "acme\n1"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    n = spark.createDataFrame([(x,) for x in names], "business_name string")
    names, texts = names[:-2], [b or "" for b in texts]
    got = {(r["k"], r["business_name"]) for r in mentions.name_mentions(t, "k", "body", n, letters=letters).collect()}
    assert got == {(k, x) for k, b in enumerate(texts) for x in names if x.lower() in b.lower()}


def test_eviction_matches_sequential_run(spark):
    rows = [(f"k{i:03d}", (i * 37) % 101, (i * 7) % 5, 10 + i % 13, None if i % 3 else i % 50, ["HIGH", "MEDIUM", "LOW"][i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "cache_key string, last_access bigint, access_count bigint, size_bytes bigint, ttl bigint, priority string")
    total = sum(r[3] for r in rows)
    for name, order in {"LRU": lambda r: (r[1], r[0]), "LFU": lambda r: (r[2], r[0]), "TTL": lambda r: (r[4] or 0, r[0])}.items():
        gone, kept = set(), total
        for r in sorted(rows, key=order):
            if kept <= int(3000 * 0.7):
                break
            gone.add(r[0])
            kept -= r[3]
        assert {r["cache_key"] for r in keyed.evict_to_budget(df, name, 3000).collect()} == gone
    assert keyed.evict_to_budget(df, "LRU", 10**9).count() == 0
    assert keyed.evict_to_budget(df, "LRU", 3000, keep_share=None).count() == 400


def test_trim_cache_between_sizes(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("cache_key"), F.col("id").alias("expires_at"))
    assert keyed.trim_cache(df, 10, max_size=50, threshold=95).count() == 90
    assert keyed.trim_cache(df, 10, max_size=50, threshold=60).agg(F.min("expires_at")).first()[0] == 50


def test_restore_from_a_chain(spark):
    """A full snapshot and two increments: deleted, rewritten and late keys at every time."""
    def table(*rows):
        return spark.createDataFrame(list(rows), "cache_key string, v int")

    def log(*rows):
        return spark.createDataFrame([(k, t, kind) for k, t, kind in rows], "cache_key string, t bigint, type string")

    chain = keyed.full_snapshot(table(("a", 1), ("b", 1), ("c", None)), 10) \
        .unionByName(keyed.snapshot_increment(table(("a", 2), ("c", None)), log(("a", 12, "SET"), ("b", 15, "DELETE"), ("x", 9, "SET")), 20, 10)) \
        .unionByName(keyed.snapshot_increment(table(("b", 3), ("d", 3)), log(("b", 25, "SET"), ("d", 26, "SET"), ("a", 27, "DELETE"), ("c", 28, "DELETE"), ("c", 28, "GET")), 30, 20))

    def at(t):
        return sorted((r["cache_key"], r["v"]) for r in keyed.restore_chain(chain, t).collect())

    assert at(9) == [] and at(10) == at(19) == [("a", 1), ("b", 1), ("c", None)]
    assert at(20) == [("a", 2), ("c", None)] and at(30) == at(99) == [("b", 3), ("d", 3)]
    assert keyed.restore_chain(chain, 30).columns == ["cache_key", "v"]
    assert keyed.snapshot_increment(table(("a", 2)), log(), 40, 30).count() == 0


def test_error_table_checks_once(spark):
    """No filter repeats the checks of the projection."""
    df = spark.createDataFrame([(1, "Acme", "12 Oak St, Troy, NY 12180"), (2, "A", "x"), (3, None, None)], "id int, business_name string, address string")
    table = quality.error_table(quality.validate_input(df))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "too short" in line]
    assert sorted((r["id"], r["error"]) for r in table.collect()) == [(2, "Business name too short"), (3, "Business name too short")]
