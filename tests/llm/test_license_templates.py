"""Template markup against a plain backtracking reader, edge cases and long texts."""

import random

import pytest
from pyspark.sql import functions as F

from tradebook.llm import license_templates as L
from tradebook.llm.license_templates import Template


def reads(regions, words, at):
    """All ends at which ``regions`` can be read from ``at``: plain recursion over the markup."""
    if not regions:
        return {at}
    first, rest = regions[0], regions[1:]
    if first[0] == "word":
        return reads(rest, words, at + 1) if at < len(words) and words[at] == first[1] else set()
    if first[0] == "may":
        return set().union(reads(rest, words, at), *[reads(rest, words, e) for e in reads(first[1], words, at)])
    return set().union(*[reads(rest, words, at + n) for n in range(first[1], first[2] + 1) if at + n <= len(words)])


def brute_ends(template, words):
    """The last words of all places of a template that begin with a word."""
    regions = L.parse(template.markup)
    return {e - 1 for at in range(len(words)) for e in reads(regions, words, at) if e > at}


TOYS = [
    Template("a", "a", "x y", 0.5), Template("b", "b", "x [[y]] z", 1), Template("c", "c", "y {{n:1-3}} x", 1),
    Template("d", "d", "z {{n:0-2}} [[x {{m:1-1}}]] z y", 1), Template("e", "e", "x [[y [[x]] z]]", 1),
    Template("f", "f", "[[y]] [[z]] w", 1),
]


def test_automaton_against_recursion():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice([b"x", b"y", b"z", b"w"]) for _ in range(rng.randrange(14))]
        n, places = L.compile_templates(TOYS).finds(b" ".join(words))
        assert n == len(words)
        for k, t in enumerate(TOYS):
            expect = brute_ends(t, words)
            got = {last for _, last, which in places if which == k}
            # the longest end of each start is reported; every reported one is a true end
            assert got <= expect and bool(got) == bool(expect), (t, words)
            assert max(got, default=-1) == max(expect, default=-1), (t, words)
            for first, last, which in places:
                if which == k:
                    assert last + 1 in reads(L.parse(t.markup), words, first)


def test_mandatory_words_decide():
    a = L.compile_templates(L.NOTICES)

    def labels(text):
        return {L.NOTICES[t].label for _, _, t in a.finds(text.encode())[1]}

    assert labels("Released under the MIT License.") == {"mit-notice"}
    assert labels("Released under the terms of the MIT License.") == {"mit-notice"}
    assert labels("Released under an MIT License.") == set()
    assert labels("licensed under the Apache License, Version 2.0") == {"apache-2.0"}
    assert labels("licensed under the Apache License, Version 1.1") == set()
    assert labels("under the terms of the GNU General Public License, version 3") == set()
    assert labels("Copyright (c) 2020-2021 Some Firm Ltd. All rights reserved") == {"all-rights-reserved"}
    text = ("Permission is hereby granted, free of charge, to any person obtaining a copy of {} and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
            "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions")
    assert labels(text.format("this software")) == {"mit-text"}
    assert labels(text.format("the Tool (all its parts)")) == {"mit-text"}
    assert labels(text.format("this software").replace("without restriction", "with restriction")) == set()


@pytest.mark.parametrize("markup", ["[[a", "a]]", "{{n:1-2}}", "[[a]]", "", "a {{n:3-1}} b", "a { b", "a {{n}} b"])
def test_unreadable_markup(markup):
    with pytest.raises(ValueError):
        L.parse(markup)


def test_words_fold_ascii_only():
    n, places = L.compile_templates(L.PHRASES).finds("MIT LICENSE MİT LİCENSE mité license Kit".encode())
    assert n == 7 and places == [(0, 1, 0)]


def test_scan_of_odd_rows(spark):
    long = "word " * 200_000 + "MIT License " + "more " * 200_000
    rows = [(1, "MIT License mit license"), (1, "MIT License mit license"), (None, None), (3, ""), (4, "!!!"), (5, long),
            (6, "general public licence"), (7, "mit " * 5 + "license")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {"license_n_words": F.lit("old"), "_text_bytes": F.lit(1)})
    out = L.scan(df, L.PHRASES)
    assert out.columns == ["doc_id", "text", "_text_bytes", "license_n_words", "license_matches"]
    got = [(r["doc_id"], r["license_n_words"], [(m["label"], m["first_word"], m["last_word"]) for m in r["license_matches"]])
           for r in out.collect()]
    twice = (1, 4, [("mit", 0, 1), ("mit", 2, 3)])
    assert got == [twice, twice, (None, 0, []), (3, 0, []), (4, 0, []), (5, 400_002, [("mit", 200_000, 200_001)]),
                   (6, 3, []), (7, 6, [("mit", 4, 5)])]
    assert L.scan(df.limit(0), L.PHRASES).collect() == []


def test_pieces_cut_between_words(monkeypatch):
    text = ("mit license, " * 50).encode()
    whole = L.compile_templates(L.PHRASES).finds(text)
    monkeypatch.setattr(L, "PIECE", 7)
    assert L.compile_templates(L.PHRASES).finds(text) == whole and whole[0] == 100 and len(whole[1]) == 50
