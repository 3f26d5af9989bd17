"""Statistics of a text as Column expressions.

All of them work on the whole text and stay in the JVM. A word is a run of characters other than
space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"

#: Counts of a text; every count is 0 for a null text.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
          "n_marks"]
#: Shares and means that learned rules test; names, in order.
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share",
            "letter_share", "words_per_line"]


_BLANK = r"[ \t\n\x0b\f\r]"


def _kept(text: Column, dropped: str) -> Column:
    """How many code points are left when runs that match ``dropped`` go."""
    return F.length(F.regexp_replace(text, dropped, "")).cast("long")


def words(text: Column) -> Column:
    """The words of a text as an array."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK + "+"))


def with_repeat_words(df: DataFrame, word_array: str, name: str) -> DataFrame:
    """Adds how many words lie in a three-word window found twice or more in the array.

    Every window becomes one long: its hash, with the lowest bits replaced by its position. Sorted,
    equal windows are neighbours, so all repeated ones are found, and by chance a few others. The windows
    found are then sorted as texts (words hold no blanks, so three of them with blanks between are one
    window only), which leaves just the repeated ones: the count is exact at any length. Their positions, back in
    text order, cover min(3, distance to the next) words each. Linear space, n log n time. The steps are
    columns of their own, so that nothing is evaluated once for each element that needs evaluating once for each row.
    """
    w, bits, ordered = F.col(word_array), F.col("_st_bits"), F.col("_st_packed")
    n = F.size(w)

    def equal(x: Column, y: Column) -> Column:
        return F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0

    none = F.array().cast("array<bigint>")
    return df.withColumn("_st_bits", F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int")) \
        .withColumn("_st_mask", F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1) \
        .withColumn("_st_packed", F.when(n < 4, none).otherwise(F.sort_array(F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", F.xxhash64(
                F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")))))) \
        .withColumn("_st_marked", F.filter(ordered, lambda x, k: equal(x, F.get(ordered, k + 1))
                                           | equal(x, F.get(ordered, k - 1)))) \
        .withColumn("_st_at", F.transform("_st_marked", lambda x: x.bitwiseAND(F.col("_st_mask")).cast("int"))) \
        .withColumn("_st_texts", F.sort_array(F.transform("_st_at", lambda p: F.struct(F.concat_ws(
            " ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("t"), p.cast("long").alias("p"))))) \
        .withColumn("_st_at", F.sort_array(F.transform(F.filter("_st_texts", lambda x, k: F.coalesce(
            (x["t"] == F.get("_st_texts", k + 1)["t"]), F.lit(False)) | F.coalesce(
            (x["t"] == F.get("_st_texts", k - 1)["t"]), F.lit(False))), lambda x: x["p"]))) \
        .withColumn(name, F.aggregate(F.transform("_st_at", lambda p, k: F.least(F.lit(3).cast("long"), F.coalesce(
            F.get("_st_at", k + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda acc, x: acc + x)) \
        .drop("_st_bits", "_st_mask", "_st_packed", "_st_marked", "_st_texts", "_st_at")


def with_counts(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the columns of ``COUNTS`` (named with ``prefix``); helper columns start with ``_st_`` and are dropped."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0b\f\r]"))
    wide = with_repeat_words(df.withColumns({"_st_words": words(t), "_st_lines": lines}), "_st_words",
                             prefix + "n_repeat_words")
    return wide.withColumns({
        prefix + "n_words": F.size("_st_words").cast("long"),
        prefix + "word_chars": _kept(t, _BLANK + "+"),
        prefix + "n_symbols": _kept(t, r"[^#*$%&|<>]+"),
        prefix + "n_dup_lines": (F.size("_st_lines") - F.size(F.array_distinct("_st_lines"))).cast("long"),
        prefix + "n_lines": F.size("_st_lines").cast("long"),
        prefix + "n_upper": _kept(t, r"[^\p{Lu}]+"),
        prefix + "n_letters": _kept(t, r"[^\p{L}]+"),
        prefix + "n_marks": _kept(t, r"[^!?]+"),
    }).drop("_st_words", "_st_lines")


def features(prefix: str = "") -> dict[str, Column]:
    """The features as doubles, from the columns of ``COUNTS``; never null."""
    c = {k: F.col(prefix + k).cast("double") for k in COUNTS}
    word_total, letters = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_letters"], F.lit(1.0))
    return {
        "n_words": c["n_words"],
        "mean_word": c["word_chars"] / word_total,
        "symbol_share": c["n_symbols"] / word_total,
        "dup_line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)),
        "repeat_share": c["n_repeat_words"] / word_total,
        "upper_share": c["n_upper"] / letters,
        "mark_share": c["n_marks"] / word_total,
        "letter_share": c["n_letters"] / F.greatest(c["word_chars"], F.lit(1.0)),
        "words_per_line": c["n_words"] / F.greatest(c["n_lines"], F.lit(1.0)),
    }
