"""Licence scans by template markup: notices compiled into token automata.

A template is the wording of a notice with marked regions: ``[[words]]`` may be left out (regions
nest), ``{{name:lo-hi}}`` stands for any ``lo`` to ``hi`` words. All other words are mandatory and must
stand exactly so, one after the other. All templates become one position automaton: a state for
every word of every template, and edges that go around optional and through replaceable regions. A
text is walked once; while no template is under way a word costs one look-up.

The automaton is as large as the templates, whatever the size of the corpus. Whole texts are walked
piece by piece, so a text of any length needs the memory of one piece and of its finds. Nothing is
shuffled.

Null and empty texts have no words and no finds. Repeated rows, null and repeated ids are rows of their own.
All input columns stay; the added ones carry a prefix of the caller's and replace columns of that name. Of
several ends of one template at one start the longest counts; where places of one template overlap in
the same state, the one that began first goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.llm.common import query, table

#: Words are runs of these bytes of the UTF-8 text, A-Z in lower case.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: A text is walked in pieces of about so many bytes, cut between words.
PIECE = 1 << 18


@dataclass(frozen=True)
class Template:
    """``sure`` is what a find says about the licence: 1 for a whole notice, less for a mention."""

    name: str
    label: str
    markup: str
    sure: float


# Phrases that name a licence, with their labels.
PHRASES = [
    Template("mit-name", "mit", "mit license", 0.5),
    Template("apache-name", "apache", "apache license", 0.5),
    Template("gpl-name", "gpl", "general public license", 0.5),
]

# Wordings of public licence statements and notices, with their optional and replaceable regions.
NOTICES = [
    Template("mit-statement", "mit-notice",
             "[[is]] released under the [[terms of the]] MIT License", 0.8),
    Template("mit-licensed", "mit-notice",
             "licensed under the [[terms of the]] MIT license", 0.8),
    Template("mit-permission", "mit-text",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of {{work:1-12}} and "
             "associated documentation files [[the {{short:1-3}}]] to deal in {{item:1-4}} without restriction, including "
             "without limitation [[on]] the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
             "sell copies of {{item:1-4}} and to permit persons to whom {{item:1-4}} is furnished to do so, subject to the "
             "following conditions", 1.0),
    Template("apache-statement", "apache-2.0",
             "licensed under the Apache License [[Version]] 2.0 [[the License]]", 0.8),
    Template("apache-header", "apache-2.0",
             "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
             "[[http {{address:1-8}}]] unless required by applicable law or agreed to in writing, software distributed under "
             "the License is distributed on an AS IS basis without warranties or conditions of any kind", 1.0),
    Template("gpl-statement", "gpl-3.0",
             "licensed under the GNU General Public License [[as published by the Free Software Foundation]] [[either]] "
             "version 3 [[of the License]] [[or at your option any later version]]", 0.8),
    Template("gpl-2-statement", "gpl-2.0",
             "licensed under the GNU General Public License [[as published by the Free Software Foundation]] [[either]] "
             "version 2 [[of the License]] [[or at your option any later version]]", 0.8),
    Template("gpl-header", "gpl-header",
             "{{work:0-6}} is free software [[you can]] redistribute it and/or modify it under the terms of the GNU "
             "[[Lesser]] [[Affero]] General Public License as published by the Free Software Foundation", 1.0),
    Template("cc-by-nc-statement", "cc-by-nc-4.0",
             "licensed under [[a]] [[the]] [[Creative Commons]] CC BY-NC 4.0 [[International]] [[License]]", 0.8),
    Template("cc-by-nc-words", "cc-by-nc-4.0",
             "Creative Commons Attribution NonCommercial 4.0 International [[Public]] License", 0.8),
    Template("cc-by-statement", "cc-by-4.0",
             "licensed under [[a]] [[the]] [[Creative Commons]] CC BY 4.0 [[International]] [[License]]", 0.8),
    Template("cc0-statement", "cc0-1.0", "CC0 1.0 Universal [[Public Domain Dedication]]", 0.8),
    Template("mpl-header", "mpl-2.0",
             "subject to the terms of the Mozilla Public License [[v]] [[Version]] 2.0", 1.0),
    Template("isc-permission", "isc",
             "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted, provided that the above copyright notice and this permission notice appear in all copies", 1.0),
    Template("bsd-redistribution", "bsd",
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
             "that the following conditions are met", 1.0),
    Template("bsd-endorsement", "bsd-3-clause",
             "Neither the name of {{holder:1-12}} nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission", 1.0),
    Template("rights-reserved", "all-rights-reserved",
             "copyright [[c]] {{year:1-2}} {{holder:0-8}} all rights reserved", 0.8),
]


# --- markup ------------------------------------------------------------------------------------------------------------
_PART = re.compile(r"\[\[|\]\]|\{\{[^{}:]*:(\d+)-(\d+)\}\}|[^\[\]{}]+|.", re.S)


def parse(markup: str) -> list[tuple]:
    """The regions of a template: ``("word", bytes)``, ``("any", lo, hi)`` and ``("may", regions)`` in order."""
    open_regions: list[list[tuple]] = [[]]
    for m in _PART.finditer(markup):
        part = m.group()
        if part == "[[":
            open_regions.append([])
        elif part == "]]":
            if len(open_regions) == 1:
                raise ValueError(f"']]' without '[[' in template: {markup!r}")
            inner = open_regions.pop()
            open_regions[-1].append(("may", inner))
        elif m.group(1) is not None:
            lo, hi = int(m.group(1)), int(m.group(2))
            if lo > hi or not hi:
                raise ValueError(f"empty range {part} in template: {markup!r}")
            open_regions[-1].append(("any", lo, hi))
        elif part.startswith("{{") or part in "[]{}":
            raise ValueError(f"unreadable markup at {part!r} in template: {markup!r}")
        else:
            open_regions[-1].extend(("word", w) for w in WORD.findall(part.encode().lower()))
    if len(open_regions) > 1:
        raise ValueError(f"'[[' without ']]' in template: {markup!r}")
    return _trim(open_regions[0], markup)


def _trim(regions: list[tuple], markup: str) -> list[tuple]:
    """Replaceable regions at either end say nothing about a place: their least words are not asked for."""
    while regions and regions[0][0] == "any":
        regions = regions[1:]
    while regions and regions[-1][0] == "any":
        regions = regions[:-1]
    if not any(r[0] == "word" for r in regions):
        raise ValueError(f"a template needs a mandatory word: {markup!r}")
    return regions


# --- automaton ---------------------------------------------------------------------------------------------------------
@dataclass
class Automaton:
    """Position automaton: state q is reached by reading ``symbol[q]`` (None: any word)."""

    templates: list[Template]
    symbol: list[bytes | None] = field(default_factory=list)
    begin: dict[bytes, tuple[int, ...]] = field(default_factory=dict)
    by_word: list[dict[bytes, tuple[int, ...]]] = field(default_factory=list)
    by_any: list[tuple[int, ...]] = field(default_factory=list)
    ends: dict[int, int] = field(default_factory=dict)

    def finds(self, text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words and the sorted places ``(first word, last word, template)`` of a text."""
        begin, by_word, by_any, ends = self.begin, self.by_word, self.by_any, self.ends
        under_way: dict[int, int] = {}
        longest: dict[tuple[int, int], int] = {}
        at = 0
        for words in pieces(text):
            for i, w in enumerate(words, at):
                fresh = begin.get(w)
                if under_way:
                    reached: dict[int, int] = {}
                    for p, first in under_way.items():
                        for q in (*by_word[p].get(w, ()), *by_any[p]):
                            if q not in reached or first < reached[q]:
                                reached[q] = first
                    under_way = reached
                if fresh is not None:
                    for q in fresh:
                        under_way.setdefault(q, i)
                if under_way:
                    for q in under_way.keys() & ends.keys():
                        longest[ends[q], under_way[q]] = i
            at += len(words)
        return at, sorted((first, last, t) for (t, first), last in longest.items())


def pieces(text: bytes) -> Iterable[list[bytes]]:
    """The lower-case words of a text, piece by piece."""
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def compile_templates(templates: Sequence[Template]) -> Automaton:
    """One automaton for all templates."""
    a = Automaton(list(templates))
    follow: list[set[int]] = []

    def place(symbol: bytes | None) -> int:
        a.symbol.append(symbol)
        follow.append(set())
        return len(a.symbol) - 1

    def chain(parts: list[tuple[bool, set[int], set[int]]]) -> tuple[bool, set[int], set[int]]:
        """Parts in a row: whether all can be left out, the states that begin and that end them."""
        empty, firsts, lasts = True, set(), set()
        for may, f, end in parts:
            for p in lasts:
                follow[p] |= f
            firsts = firsts | f if empty else firsts
            lasts = lasts | end if may else set(end)
            empty = empty and may
        return empty, firsts, lasts

    def build(regions: list[tuple]) -> tuple[bool, set[int], set[int]]:
        parts = []
        for r in regions:
            if r[0] == "word":
                q = place(r[1])
                parts.append((False, {q}, {q}))
            elif r[0] == "may":
                parts.append((True, *build(r[1])[1:]))
            else:
                # later words of the region are reached through earlier ones only: no two ways to read a region
                states = [place(None) for _ in range(r[2])]
                for p, q in zip(states, states[1:], strict=False):
                    follow[p].add(q)
                parts.append((r[1] == 0, {states[0]}, set(states[max(r[1], 1) - 1:])))
        return chain(parts)

    for k, t in enumerate(a.templates):
        _, firsts, lasts = build(parse(t.markup))
        for q in firsts:
            if a.symbol[q] is None:
                raise ValueError(f"a template can't begin with a replaceable region: {t.markup!r}")
            a.begin[a.symbol[q]] = (*a.begin.get(a.symbol[q], ()), q)
        a.ends.update(dict.fromkeys(lasts, k))
    for after in follow:
        words: dict[bytes, tuple[int, ...]] = {}
        for q in sorted(after):
            if a.symbol[q] is not None:
                words[a.symbol[q]] = (*words.get(a.symbol[q], ()), q)
        a.by_word.append(words)
        a.by_any.append(tuple(q for q in sorted(after) if a.symbol[q] is None))
    return a


# --- operator ----------------------------------------------------------------------------------------------------------
MATCH = T.ArrayType(T.StructType([
    T.StructField("template", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("sure", T.DoubleType()), T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType())]))


def scan(df: DataFrame, templates: Sequence[Template], text: str = "text", prefix: str = "license_") -> DataFrame:
    """``df`` with ``n_words`` and ``matches`` (named with ``prefix``): the places of all templates in order."""
    shared = df.sparkSession.sparkContext.broadcast(compile_templates(templates))
    added = [T.StructField(prefix + "n_words", T.LongType()), T.StructField(prefix + "matches", MATCH)]
    kept = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    held = "_text_bytes"
    while held in df.columns:
        held += "_"
    bare = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text).cast("binary").alias(held))
    names = [f.name for f in kept]
    kind = pa.list_(pa.struct([("template", pa.string()), ("label", pa.string()), ("sure", pa.float64()),
                               ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        automaton = shared.value
        about = [(t.name, t.label, t.sure) for t in automaton.templates]
        for batch in batches:
            n_words, matches = [], []
            for value in batch.column(len(names)):
                n, places = automaton.finds(value.as_py() or b"")
                n_words.append(n)
                matches.append([{"template": about[t][0], "label": about[t][1], "sure": about[t][2],
                                 "first_word": first, "last_word": last} for first, last, t in places])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(matches, kind)],
                [*names, *[f.name for f in added]])

    return bare.mapInArrow(run, T.StructType([*kept, *added]))


def labels_of(matches: Column) -> Column:
    """The distinct labels of the places, sorted, joined by commas; empty text for none."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


# --- query -------------------------------------------------------------------------------------------------------------
def as_pattern(template: Template) -> str:
    """The template as a regular expression over a text whose words each stand between two blanks of their own."""
    def of(regions: list[tuple]) -> str:
        out = ""
        for r in regions:
            out += f" {r[1].decode()} " if r[0] == "word" else \
                f"(?:{of(r[1])})?" if r[0] == "may" else f"(?: [^ ]+ ){{{r[1]},{r[2]}}}"
        return out
    return of(parse(template.markup))


def _check() -> str:
    every = [*PHRASES, *NOTICES]
    places = "\n".join(
        f", list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(t.markup.split()))}) AS {t.label}"
        for t in PHRASES)
    found = ", ".join(f"CASE WHEN regexp_matches(s, '{as_pattern(t)}') THEN '{t.label}' END" for t in every)
    sure = ", ".join(f"CASE WHEN regexp_matches(s, '{as_pattern(t)}') THEN {t.sure} ELSE 0 END" for t in every)
    base = ", ".join(f"CASE WHEN len({t.label}) > 0 THEN '{t.label}' END" for t in PHRASES)
    joined = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), places AS (
  SELECT doc_id, w, array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') AS s {places}
  FROM words
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(mit) + len(apache) + len(gpl) AS BIGINT) AS n_base,
       CAST(list_min(mit || apache || gpl) AS BIGINT) AS first_word,
       CAST(list_max(mit || apache || gpl) AS BIGINT) AS last_word,
       {joined.format(base)} AS base_labels, {joined.format(found)} AS labels,
       CAST(greatest({sure}) AS DOUBLE) AS score
FROM places"""


@query("op13_license_templates", _check())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` is the surest find: 0.5 for a phrase, 0.8 for a statement, 1 for the wording of a notice."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), [*PHRASES, *NOTICES], prefix="_lt_")
    phrases = F.array(*[F.lit(t.name) for t in PHRASES])
    base = F.filter("_lt_matches", lambda m: F.array_contains(phrases, m["template"]))
    first = F.transform(F.col("_base"), lambda m: m["first_word"])
    return found.select("doc_id", F.col("_lt_n_words").alias("n_words"), "_lt_matches", base.alias("_base")).select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        labels_of(F.col("_base")).alias("base_labels"), labels_of(F.col("_lt_matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_lt_matches", lambda m: m["sure"])), F.lit(0.0)).alias("score"))
