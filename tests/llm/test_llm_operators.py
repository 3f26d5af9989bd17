"""The text operators on small inputs: brute force, edge cases, determinism."""

import hashlib
import html
import itertools
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tools.check import rows_of
from tradebook.llm import (
    chat,
    decontamination,
    html_text,
    jaccard_join,
    language_id,
    mixing,
    quality_classifier,
    quality_rules,
    statistics,
    token_counts,
    toxicity,
)
from tradebook.llm.queries import CHECKS, QUERIES
from tradebook.session import settle

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, **extra):
    """Documents numbered from 0, with the given texts."""
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENT)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@needs_data
@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(CHECKS[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


# --- statistics, quality rules, quality classifier

def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "a", "a b c a b c", "x y z " * 700, "a a a a a a", "# * $ %\n\n& | < >\n# * $ %", "é ü 日本 語\x0b語\n日本",
         "one two three\none two three\n one two three", "\\n literal", "w " * 30_000, "tail  \n", "a\r\nb\r\nb\r\n"]


def test_counts_against_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abc\n") for _ in range(rng.randrange(40))) for _ in range(60)]
    got = statistics.with_counts(docs(spark, texts)).orderBy("doc_id").collect()
    for text, r in zip(texts, got, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text), repr(text)[:80]


def labelled(spark, n=240):
    rng = random.Random(5)
    texts = [(("ok " + sentence(rng, 90)) if k % 4 else " ".join(w + "***" for w in sentence(rng, 80).split())) for k in range(n)]
    frame = docs(spark, texts, n_words="clash", kept=1, score="x", copies=2)
    labels = spark.createDataFrame([(k, int(k % 4 > 0), None) for k in range(n)], "doc_id bigint, quality int, toxic int")
    return frame, labels


def test_quality_rules_learn_and_keep_columns(spark):
    frame, labels = labelled(spark)
    rules = quality_rules.learned_rules(frame, labels)
    assert rules and quality_rules.learned_rules(frame, labels) == rules
    out = quality_rules.judge(frame, rules)
    assert {r.doc_id for r in out.filter("_q_kept").collect()} == {k for k in range(240) if k % 4}
    assert out.columns[:len(frame.columns)] == frame.columns


def test_quality_rules_without_labels(spark):
    frame, labels = labelled(spark, 8)
    assert quality_rules.learned_rules(frame, labels.limit(0)) == []
    assert quality_rules.learned_rules(frame.limit(0), labels) == []
    assert quality_rules.judge(frame.limit(0), []).count() == 0
    kept = quality_rules.judge(docs(spark, ["a b c d " * 3, sentence(random.Random(1), 60), None]), [])
    assert [r["_q_kept"] for r in kept.orderBy("doc_id").collect()] == [False, True, False]


def test_rule_stays_native(spark):
    frame, labels = labelled(spark)
    plan = quality_rules.judge(frame, quality_rules.learned_rules(frame, labels))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_classifier(spark):
    frame, labels = labelled(spark)
    rows = quality_rules.labelled_statistics(frame, labels, "quality", 1000)
    model = quality_classifier.fit(rows)
    assert model.rules and len(str(model).split("\n")) == len(model.rules) + 1
    scored = quality_classifier.score(frame, model).select("doc_id", "_qc_score").collect()
    assert all((r["_qc_score"] > 0.5) == (r.doc_id % 4 > 0) and 0 <= r["_qc_score"] <= 1 for r in scored)
    assert quality_classifier.fit(rows.limit(0)).rules == []
    lone = quality_classifier.fit(rows.filter("_label = 1"))
    assert [r["_qc_score"] > 0.9 for r in quality_classifier.score(docs(spark, [None, ""]), lone).collect()] == [True, True]
    assert quality_classifier.narrowed((quality_rules.Condition("n_words", True, 1.0), quality_rules.Condition("n_words", True, 3.0))) \
        == (quality_rules.Condition("n_words", True, 3.0),)


# --- language identification

def test_code_words():
    for n in (2, 3, 4, 7, 20):
        code = language_id.code_words(n)
        assert code.shape[0] == n and all((code[a] != code[b]).any() for a, b in itertools.combinations(range(n), 2))


def test_language_identification(spark):
    rng = random.Random(8)
    sounds = {"xx": "ka ko ki ku", "yy": "bel bol bil", "zz": "öst äst üst", "qq": "pra pre pri"}
    made = [(k, " ".join("".join(rng.choice(s.split()) for _ in range(3)) for _ in range(20)), lang, None, None)
            for k, (lang, s) in enumerate(list(sounds.items()) * 12)]
    frame = spark.createDataFrame(made + [(900, None, "xx", "s", 1), (901, "123 !!", None, "s", 1), (902, "", None, None, None)], DOCUMENT)
    model = language_id.learn(frame)
    out = {r.doc_id: r for r in language_id.identify(frame, model).collect()}
    assert all(out[k].lang_pred == lang and 0 <= out[k].score <= 1 for k, _, lang, _, _ in made)
    assert [out[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert language_id.learn(frame.filter("doc_id < 0")).languages == []
    one = language_id.learn(frame.filter("lang = 'xx'"))
    assert {r.lang_pred for r in language_id.identify(frame.filter("doc_id < 9"), one).collect()} == {"xx"}
    assert language_id.identify(frame.limit(0), model).count() == 0


# --- decontamination

def brute_hits(text, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for name, item in items:
        x = words(item)
        size = min(window, len(x))
        shots = {tuple(x[i:i + size]) for i in range(len(x) - size + 1)} if x else set()
        for i in range(len(w) - size + 1 if x else 0):
            if tuple(w[i:i + size]) in shots:
                hit |= set(range(i, i + size))
                found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("shard_bytes", [10 ** 6, 60])
def test_matches_against_brute_force(spark, shard_bytes):
    rng = random.Random(4)
    items = [(k, sentence(rng, rng.choice([1, 2, 3, 5, 8, 12, 20]), 6)) for k in range(25)]
    items += [(90, None), (91, ""), (92, "??"), (3, items[3][1]), (None, "w1 w2 w3 w4")]
    texts = [sentence(rng, rng.randrange(60), 7).upper() for _ in range(40)] + [None, "", "É w1-w2_w3"]
    matches = decontamination.find_matches(docs(spark, texts, spans=1), spark.createDataFrame(items, "item_id bigint, text string"),
                                           window=5, shard_bytes=shard_bytes)
    got = {r.doc_id: r for r in matches.withColumn("n", decontamination.hit_words()).collect()}
    known = [(str(k), t) for k, t in items if k is not None]
    for k, t in enumerate(texts):
        assert (got[k].n_words, got[k].n, got[k]["items"]) == brute_hits(t, known, 5), (k, t)


def test_decontaminate_cuts_spans_and_drops_covered_documents(spark):
    rng = random.Random(6)
    item, clean = sentence(rng, 20, 10 ** 6), [sentence(rng, 40, 10 ** 6) for _ in range(3)]
    texts = [clean[0], f"{clean[1]}. {item.upper()}! {clean[2]}", item, None, "", " ".join(item.split()[:9])]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    out = {r.doc_id: r for r in decontamination.decontaminate(docs(spark, texts, items="clash"), bench).collect()}
    assert set(out) == {0, 1, 3, 4, 5} and out[0].text == texts[0] and out[5].text == texts[5]
    assert out[1].text == f"{clean[1]}.\n! {clean[2]}".replace(".\n", ".\n") and out[1].n_chars == len(out[1].text)
    again = decontamination.find_matches(docs(spark, [out[1].text]), bench).first()
    assert not again["spans"]
    assert decontamination.decontaminate(docs(spark, texts), bench.limit(0)).count() == len(texts)


@pytest.mark.parametrize("shard_bytes", [10 ** 6, 150])
def test_decontaminate_with_shards(spark, shard_bytes):
    rng = random.Random(15)
    items = [sentence(rng, 12, 10 ** 6) for _ in range(6)]
    split = items[0].split()
    texts = [" ".join([sentence(rng, 16, 10 ** 6), *items[:4]]),                       # covered by several items together
             " ".join([sentence(rng, 30, 10 ** 6), *items[1:3]])]
    # each item's words come together when another one is cut
    texts += [" ".join([sentence(rng, 60, 10 ** 6), *split[:6], item, *split[6:]]) for item in items[1:]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert decontamination.dealt_items(bench, shard_bytes)[1] == (1 if shard_bytes == 10 ** 6 else 4)
    frame = docs(spark, [*texts, None, "", texts[1]])
    out = {r.doc_id: r for r in decontamination.decontaminate(frame, bench, shard_bytes=shard_bytes).collect()}
    assert set(out) == set(range(1, 10))
    assert out[1].text == " ".join(texts[1].split()[:30]) == out[9].text and out[7].text is None and out[8].text == ""
    assert all(out[k].text == " ".join(texts[k].split()[:60]) and out[k].n_chars == len(out[k].text) for k in range(2, 7))


@pytest.mark.parametrize("shard_bytes", [10 ** 6, 150])
def test_matches_of_rows_with_the_same_id(spark, shard_bytes):
    rng = random.Random(16)
    items = [sentence(rng, 12, 10 ** 6) for _ in range(6)]
    rows = [(None, items[0]), (None, f"a b {items[1]}"), (5, items[2]), (5, items[2])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = decontamination.find_matches(spark.createDataFrame(rows, "doc_id bigint, text string"), bench, shard_bytes=shard_bytes)
    assert sorted((str(r.doc_id), r.n_words, r["spans"], r["items"]) for r in found.collect()) == [
        ("5", 12, [[0, 12]], ["2"]), ("5", 12, [[0, 12]], ["2"]), ("None", 12, [[0, 12]], ["0"]), ("None", 14, [[2, 14]], ["1"])]


# --- near duplicates

def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            lo, hi = sorted((label[a], label[b]))
            label = [lo if x == hi else x for x in label]
    return [(k, len(s), c) for k, (s, c) in enumerate(zip(sets, label, strict=True))]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(words)


def duplicate_texts():
    rng = random.Random(12)
    texts = [None, "", " \n", "one", "ONE", "one two", "one\ttwo", "One  two three four five", "one two three four five"]
    for size in (30, 60, 200):
        base = sentence(rng, size, 10 ** 6).split()
        texts += [edited(rng, base, rng.randrange(1 + size // 25)) for _ in range(25)]
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base) + "\n"]
    chain = sentence(rng, 120, 10 ** 6).split()                  # neighbours link, ends do not
    for k in range(12):
        chain[k * 9] = f"c{k}"
        texts.append(" ".join(chain))
    shared = sentence(rng, 50, 10 ** 6)                          # one passage in many different documents
    texts += [shared + " " + sentence(rng, 60, 10 ** 6) for _ in range(30)]
    texts += [sentence(rng, rng.randrange(1, 80), 10 ** 6) for _ in range(40)]
    rng.shuffle(texts)
    return texts


def chained_groups():
    """Groups of near copies whose members reach other groups only from their outer side."""
    rng = random.Random(77)
    texts = []
    for _ in range(4):
        base = sentence(rng, 100, 10 ** 6).split()
        for step in range(6):                                    # each centre is a third of a link or more from the last
            for k in range(rng.randrange(2, 5)):
                base[(step * 17 + k * 3) % 100] = f"m{rng.randrange(10 ** 6)}"
            texts += [edited(rng, base, rng.randrange(4)) for _ in range(rng.randrange(3, 14))]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small,make", [((8, 2048), duplicate_texts), ((1, 4), chained_groups)])
def test_components_against_brute_force(spark, monkeypatch, small, make):
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", small[0])
    monkeypatch.setattr(jaccard_join, "BLOCK", small[1])
    texts = make()
    got = jaccard_join.near_duplicates(docs(spark, texts, component_id="clash", n="x")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(texts)


def grouped(rows):
    """Components of (id, text) rows where rows of one id are one document."""
    parts = brute_components([t for _, t in rows])
    label = {}
    for (i, _), (_, n, c) in zip(rows, parts, strict=True):
        if i is not None and n:
            label.setdefault(c, set()).add(i)
    found = [set(v) for v in label.values()] + [{i} for i, _ in rows if i is not None]
    merged = []
    for g in found:
        for other in [m for m in merged if m & g]:
            merged.remove(other)
            g = g | other
        merged.append(g)
    out = [(str(i), n, None if i is None else min(next(g for g in merged if i in g)))
           for (i, _), (_, n, _) in zip(rows, parts, strict=True)]
    return sorted(map(str, out))


def test_rows_that_share_an_id(spark, monkeypatch):
    rng = random.Random(31)
    x, y, z = (sentence(rng, 60, 10 ** 6) for _ in range(3))
    near = edited(rng, y.split(), 2)
    cases = [[(1, x), (2, x), (2, y), (3, y)], [(1, x), (2, y), (5, x), (5, y)], [(1, x), (4, x), (4, y), (9, near)],
             [(1, x), (1, x), (1, x)], [(None, x), (2, x), (None, y), (3, None), (3, x)], [(7, x), (7, ""), (6, ""), (5, z)],
             [(1, x), (7, x), (7, "")]]
    crowd = [(100 + k, edited(rng, z.split(), rng.randrange(3))) for k in range(30)]
    cases.append([*crowd, (3, crowd[4][1]), (3, x), (2, edited(rng, x.split(), 1)), *crowd[:5]])
    # all cases in one table, each with ids and words of its own
    rows = [(None if i is None else 1000 * k + i, t and re.sub(r"\b(?=\w)", f"c{k}", t)) for k, case in enumerate(cases) for i, t in case]
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", 2)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(str((str(r.doc_id), r.n_shingles, r.component_id)) for r in got) == grouped(rows)


def test_pairs_of_like_members_stay_few(spark):
    """Like members that are all single name one other each: links, not all pairs."""
    sketch = jaccard_join._sketch(jaccard_join.shingles(sentence(random.Random(1), 60, 10 ** 6).encode()))
    for m in (100, 400):
        rows = spark.range(m).select(
            F.lit(1).cast("bigint").alias("g"), "id", F.lit(56).alias("n"), F.lit(56).alias("lo"),
            F.lit(56).alias("hi"), F.lit(0).alias("slack"), F.lit(0).alias("r"), F.lit(0).alias("apart"),
            F.lit(-1).alias("side"), F.col("id").alias("component"), F.lit(m).alias("m"), F.lit(sketch).alias("sketch"))
        assert jaccard_join._crossed(rows, True).count() < m


def test_near_duplicate_stage(spark):
    text = sentence(random.Random(2), 40, 10 ** 6)
    frame = spark.createDataFrame([(5, text, "en", "a", 1), (3, text.upper(), "en", "b", 1), (3, text.upper(), "en", "b", 1),
                                   (None, text, None, None, None), (9, None, None, None, None), (7, "", "en", "c", 0)], DOCUMENT)
    out = jaccard_join.stage(spark, frame, None)
    assert out.columns == frame.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "7", "9", "None"]
    assert jaccard_join.near_duplicates(frame.limit(0)).count() == 0


def test_shingles_are_sets_of_word_runs():
    assert len(jaccard_join.shingles(b"a b c d e f a b c d e f")) == 6
    assert list(jaccard_join.shingles(b"A  b\tc d\x0be\n")) == list(jaccard_join.shingles(b"a b c d e"))
    assert len(jaccard_join.shingles(b"a b")) == 1 and len(jaccard_join.shingles(b" \n")) == 0


# --- mixing

def test_poisson_mixing(spark):
    frame = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").otherwise(
        F.when(F.col("id") % 2 == 0, "small")).alias("source"), F.lit("t").alias("text"), F.lit(9).alias("copies"))
    out = mixing.mix(frame, {"big": 1.0, "absent": 5.0}, total=10_000)
    n = out.count()
    assert {r.source for r in out.select("source").distinct().collect()} == {"big"} and abs(n - 10_000) < 400
    per = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("c"), F.max("copy").alias("k")).filter("n <> c or k <> c - 1")
    assert per.count() == 0 and out.exceptAll(mixing.mix(frame.repartition(7), {"big": 1.0, "absent": 5.0}, total=10_000)).isEmpty()
    assert mixing.mix(frame.limit(0)).count() == 0
    flat = mixing.mix(frame, temperature=0.0, total=6000).groupBy("source").count().collect()
    assert {r.source for r in flat} == {"big", "small", None} and all(abs(r["count"] - 2000) < 250 for r in flat)


@needs_data
def test_mixing_query_replicates_whole_documents(spark, monkeypatch):
    written = []
    monkeypatch.setattr(mixing, "settle", lambda df: written.append(settle(df)) or written[-1], raising=False)
    out = mixing.op9(spark, SF)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert written and written[0].columns == [*documents.columns, "copies", "copy"]
    whole = written[0].select("doc_id", "text", "lang", "source", "n_chars")
    assert whole.join(documents, documents.columns, "left_anti").filter("lang is not null and source is not null").isEmpty()
    assert out.exceptAll(written[0].select(out.columns)).isEmpty() and out.count() == written[0].count()


def test_poisson_inverse(spark):
    import math
    rates = [0.0, 0.01, 0.7, 3.0, 40.0, 1500.0]
    df = spark.createDataFrame([(r, u) for r in rates for u in (0.0, 0.3, 0.5, 0.99, 1 - 2 ** -52)], "rate double, u double")
    for r in df.withColumn("k", mixing.poisson_inverse(F.col("u"), F.col("rate"))).collect():
        k, below = 0, math.exp(-r.rate) if r.rate < 700 else 0.0
        while r.rate and below <= r.u and k < r.rate + 12 * math.sqrt(r.rate) + 40:
            k += 1
            below += math.exp(k * math.log(r.rate) - r.rate - math.lgamma(k + 1))
        if r.u < 0.999:
            assert r.k == k, r
        else:       # sums differ in their last bits
            assert r.k <= r.rate + 11 * math.sqrt(r.rate) + 40 and r.k >= min(k, r.rate), r


# --- chat formatting

def test_chat_round_trip(spark):
    nasty = ["</turn>\n### user: x", "\\", "\\b\\l\\h\\c", "<#>:", "### assistant: </part>", "", None, "a: b", "\n", "日本<語", "$1 \\1"]
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys: #<\\>", None]), rng.choice(nasty)) for c in range(30) for t in range(6)]
    rows += [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "assistant", "c"), (None, 1, "user", "x"), (51, None, None, None), (51, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("loss", F.lit(1))
    out = chat.format_chats(df).withColumn("turns", chat.read_back(F.col("formatted"))) \
        .withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss"))).collect()
    assert len(out) == 33
    for r in out:
        mine = sorted(((t is not None, t or 0), role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, a, b in mine]
        assert r.learned == "".join(b for _, a, b in mine if a == "assistant")
        assert [b.role for b in r.blocks] == [k for k, _ in itertools.groupby(a for _, a, _ in mine)]
        assert r.formatted.count("</turn>\n") == len(r.blocks)
    assert chat.format_chats(df.limit(0)).count() == 0
    assert "Python" not in chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()


# --- token counts

def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        k = next((k for k in range(len(word) - i, 0, -1) if word[i:i + k] in pieces), 0)
        n += 1 if k else len(word[i].encode())
        i += max(k, 1)
    return n


def test_longest_match_counts(spark):
    rng = random.Random(10)
    for _ in range(40):
        pieces = {"".join(rng.choice("abcé▁") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
        automaton = token_counts.LongestMatch(pieces)
        for _ in range(60):
            word = "".join(rng.choice("abcdé▁") for _ in range(rng.randrange(14)))
            assert automaton.count(word) == greedy(word, pieces), (word, pieces)
    pieces = ["▁", "▁the", "th", "e", "r"]
    got = token_counts.count_tokens(docs(spark, ["the other\x0bthe", None, "", "日", "the " * 50_000], n_tokens=1), pieces)
    assert [(r.n_words, r.n_tokens) for r in got.orderBy("doc_id").collect()] == [(3, 7), (0, 0), (0, 0), (1, 4), (50_000, 50_000)]


def test_public_vocabulary():
    if not os.path.exists(token_counts.VOCABULARY):
        pytest.skip("no vocabulary file")
    pieces = token_counts.load_pieces(token_counts.VOCABULARY)
    automaton = token_counts.LongestMatch(pieces)
    known = set(pieces)
    for word in ("tokenization", "internationalisation", "naïveté", "日本語", "x" * 500, "😀"):
        assert automaton.count("▁" + word) == greedy("▁" + word, known)


# --- toxicity

def toxic_corpus(spark):
    rng = random.Random(11)
    bad = ["grudling", "snorfbag", "wretchok"]
    texts, labels = [], []
    for k in range(200):
        words = sentence(rng, 40, 300).replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij")).split()
        if k % 5 == 0:
            for _ in range(2):
                words[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append((k, int(k % 5 == 0)))
    return texts, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity(spark):
    texts, labels = toxic_corpus(spark)
    frame = docs(spark, texts, score="clash")
    model = toxicity.learn(frame, labels)
    more = docs(spark, ["Ünd GRUDLING, you", "word words only", None, "", "x " * 30_000 + "snorfbag"])
    out = [r for r in toxicity.tag(more, model).orderBy("doc_id").collect()]
    assert [r.score > 0.5 for r in out] == [True, False, False, False, True]
    assert [(s.start, s.end) for s in out[0].spans] == [(4, 12)] and [(s.start, s.end) for s in out[4].spans] == [(60_000, 60_008)]
    got = {r.doc_id: r.score for r in toxicity.tag(frame, model).collect()}
    assert all((got[k] > 0.3) == (k % 5 == 0) for k in got)
    assert toxicity.learn(frame, labels.limit(0)).weight == {} and toxicity.tag(frame.limit(0), model).count() == 0


def test_marginals_against_enumeration():
    import numpy as np
    model = toxicity.Field({"=bad": 3.0, "=odd": 1.2}, -2.0, (0.3, -0.4), np.array([[0.5, -0.7], [0.1, 0.9]]))
    words = [b"a", b"bad", b"b", b"c", b"odd", b"bad", b"d"]
    emit = [model.bias + {b"bad": 3.0, b"odd": 1.2}.get(w, 0.0) for w in words]
    total, hit = 0.0, np.zeros(len(words))
    for path in itertools.product((0, 1), repeat=len(words)):
        e = model.start[path[0]] + sum(s * x for s, x in zip(path, emit, strict=True)) + sum(model.move[a, b] for a, b in itertools.pairwise(path))
        total += np.exp(e)
        hit += np.exp(e) * np.array(path)
    at, p = model.marginals(words, toxicity._Memo(model.weight))
    assert at.tolist() == [1, 4, 5] and np.allclose(p, (hit / total)[at])


# --- main text of pages

PAGE = ('<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>'
        '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="cookie-notice">Cookies</div><article><h1>Head &amp; more</h1>'
        '<p><b>First<br>part.<p>Second&nbsp;&#8212; <i>it</i>alic<aside>Side</aside><form>Form <input></form><div class="ad">Buy</div>'
        '<ul><li>one<li>two</ul><section id="comments"><p>Reader</p></section></article><footer>&copy; foot</footer>')


def test_page_structure(spark):
    assert [t for z, t in html_text.blocks_of(PAGE) if z == "main"] == ["Head & more", "First part.", "Second — italic", "one", "two"]
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<"), (5, "u", "<p class='a>b"), (1, "http://a.example/x", PAGE)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")))
    got = sorted((r.page_id, r.text) for r in out.collect())
    assert [k for k, _ in got] == [1, 1, 2, 3, 4, 5] and got[0] == got[1] and got[2][1] == got[3][1] == ""
    assert html_text.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("block_words", [10 ** 6, 60])
def test_host_boilerplate(spark, block_words):
    rng = random.Random(13)
    top, end = sentence(rng, 15, 10 ** 6), sentence(rng, 12, 10 ** 6)
    story = {k: sentence(rng, 30, 10 ** 6) for k in range(9)}
    rows = [(k, "http://h.example/%d" % k, f"<body><div>{top}</div><p>{story[k]}</p><p>{end}") for k in range(9)]
    rows += [(20, "http://other.example/", f"<body><div>{top}</div><p>{end}")]
    rows += [(30 + k, "http://copy.example/", f"<body><p>{story[0]}</p>") for k in range(2)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), block_words)
    got = {r.page_id: r.text for r in out.collect()}
    assert all(got[k] == story[k] for k in range(9))
    assert got[20] == f"{top}\n{end}" and got[30] == got[31] == story[0]


@pytest.mark.parametrize("block_words", [10 ** 6, 60])
def test_host_runs_decide_over_articles(spark, block_words):
    rng = random.Random(14)
    ask, quote = sentence(rng, 12, 10 ** 6), sentence(rng, 12, 10 ** 6)
    story = {k: sentence(rng, 30, 10 ** 6) for k in range(9)}
    rows = [(k, "http://h.example/%d" % k, f"<article><p>{story[k]}</p><p>{ask}</p>{f'<p>{quote}</p>' if k < 3 else ''}</article>")
            for k in range(9)]
    rows += [(20 + k, "http://two.example/", f"<p>{story[0]}</p><p>{story[k]}</p>") for k in (1, 2)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), block_words)
    got = {r.page_id: r.text for r in out.collect()}
    assert all(got[k] == (f"{story[k]}\n{quote}" if k < 3 else story[k]) for k in range(9))
    assert all(got[20 + k] == f"{story[0]}\n{story[k]}" for k in (1, 2))


def test_articles_in_wrappers():
    def text(page):
        return html_text.text_of(page, set(), 0)
    nav, story = "<nav>Menu</nav>", "<article><p>Story told</p><div class='share'>Share</div></article>"
    assert text(f"{nav}<div class='layout has-sidebar'>{story}</div>") == "Story told"
    assert text(f"<div class='page no-sidebar'>{nav}<p>Plain</p></div>") == "Plain"
    assert text(f"<form>{nav}{story}<footer>End</footer></form>") == text(f"<div class='sidebar'>{story}</div>") == "Story told"
    assert text(f"<form>{nav}<div>Told without article</div><div hidden>No</div></form>") == "Told without article"
    assert text(f"<p>The page itself, long</p><div class='related'><article>Card</article></div>") == "The page itself, long"
    assert text(f"{story}<form><article>Other</article></form>") == "Story told"
    assert text(f"<div hidden>{story}</div><aside>{story}</aside>") == ""


def test_doubtful_names_are_left_to_the_host(spark):
    """Only a part of a name sounds like chrome: the text stays, unless the host repeats it."""
    names = ["share-prices", "social-history", "related-work", "menu-of-options", "hidden-gems", "widget-assembly", "banner-year"]
    for n in names:
        page = f"<article><h1>T</h1><section class='{n}'><p>Real article words here</p></section></article>"
        assert html_text.text_of(page, set(), 0) == "T\nReal article words here"
        assert html_text.text_of(f"<div class='{n}'><p>Plain words</p></div>", set(), 0) == "Plain words"
    assert html_text.text_of("<article><p>Told</p><div class='x share'>Share</div><div id=sidebar><p>No</p></div></article>", set(), 0) == "Told"
    rng = random.Random(15)
    plea = sentence(rng, 12, 10 ** 6)
    rows = [(k, f"http://h.example/{k}", f"<article><p>{sentence(rng, 30, 10 ** 6)}</p><div class='share-box'><p>{plea}</p></div>"
             f"<div class='share-prices'><p>{sentence(rng, 20, 10 ** 6)}</p></div></article>") for k in range(4)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 4 and all(plea not in r.text and len(r.text.split()) == 50 for r in got)


def test_suffix_ranks():
    import numpy as np
    words = np.array([3, 1, 2, 3, 1, 2, 9, 3, 1])
    rank = html_text.suffix_ranks(words, 3)
    runs = [tuple(words[i:i + 3].tolist()) for i in range(len(words))]
    assert [sorted(set(runs)).index(r) for r in runs] == rank.tolist()


# --- pipeline

@needs_data
def test_pipeline(spark):
    import corpus_pipeline
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs_now = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, columns = docs_now.count(), list(docs_now.columns)
        docs_now = settle(stage(spark, docs_now, SF))
        assert docs_now.columns == columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < docs_now.count() <= before
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "lang", "source", "n_chars", "copy"} <= set(out.columns) and out.count() > 0
    docs_in = spark.read.parquet(f"{SF}/documents.parquet")
    kept = out.select("doc_id").distinct()
    assert kept.count() < docs_in.count() and kept.join(docs_in, "doc_id", "left_anti").isEmpty()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.find_matches(out, bench).filter(F.size("spans") > 0).isEmpty()


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442") and html.unescape("&amp;") == "&"
