"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton accepts every run of words that some item contains. A document is streamed through it
word by word; the automaton's state always knows the longest run that ends at the word and occurs in
an item. Where that run reaches the window length, its last words are a window of an item.

The automaton is broadcast. Items are dealt into shards of at most ``SHARD_BYTES`` of text, one
automaton and one scan of the documents each, so that what is broadcast stays bounded when the
benchmark grows. Texts are read whole; nothing of a document is shuffled with one shard. With several, each
row gets a number of its own, and what is found, kept and cut is the same as with one.

Null texts have no words; items without an id or without words match nothing; repeated items count
once. Documents without words are never contaminated. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import query, table
from tradebook.session import settle

#: Text of the items that one automaton holds, at most (one longer item is a shard of its own).
SHARD_BYTES = 8_000_000
WINDOW = 10
#: A document goes when more than this share of its words is contaminated; otherwise its spans go.
MAX_COVERAGE = 0.5

#: Bytes to words: A-Z folded, everything in ASCII but digits and letters parts words.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Automaton:
    """Generalised suffix automaton of the items' words, with the windows of ``window`` words marked."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in items]
        for code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        #: items whose only window is shorter, at the state that holds it: (length, item)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, code in enumerate(coded):
            if 0 < len(code) < window:
                state = 0
                for c in code:
                    state = self.step[state][c]
                self.short.setdefault(state, []).append((len(code), k))
        self.least = min((min(len(c), window) for c in coded if c), default=0)
        self._above()
        #: items that hold the windows of a state
        self.holders: dict[int, set[int]] = {}
        for k, code in enumerate(coded):
            for _, _, state in self._ends(code, 0):
                if state >= 0:
                    self.holders.setdefault(state, set()).add(k)

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _above(self) -> None:
        """For each state: the suffix state that holds its last ``window`` words, and the nearest suffix
        state (itself included) at which a short item ends."""
        n = len(self.length)
        self.at_window, self.at_short = [-1] * n, [-1] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            self.at_window[v] = v if self.length[up] < self.window <= self.length[v] else self.at_window[up]
            self.at_short[v] = v if v in self.short else self.at_short[up]

    def _ends(self, code: Iterable[int], offset: int):
        """(position, matched words, state of the window or -1) for each word at which something matches."""
        state = size = 0
        step, link, length, at_window, at_short = self.step, self.link, self.length, self.at_window, self.at_short
        for k, c in enumerate(code, offset):
            while state and c not in step[state]:
                state = link[state]
                size = length[state]
            state = step[state].get(c, 0)
            size = size + 1 if state else 0
            if size >= self.window:
                yield k, size, at_window[state]
            if at_short[state] >= 0 and self.short:
                yield k, size, ~state if state else -1

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Contaminated spans of word positions (start, end) and the items that occur."""
        spans: list[list[int]] = []
        items: set[int] = set()
        if not self.least or len(words) < self.least:
            return spans, items
        ids = np.array(list(map(self.vocabulary.get, words, repeat(-1))), dtype=np.int64)
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        seen: set[int] = set()
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start < self.least:
                continue
            for k, size, state in self._ends(ids[start:end].tolist(), start):
                if state >= 0:
                    hit = self.window
                    if state not in seen:
                        seen.add(state)
                        items |= self.holders.get(state, set())
                else:
                    hit = self._short_ends(~state, size, items)
                if hit:
                    begin = k + 1 - hit
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append([begin, k + 1])
        return spans, items

    def _short_ends(self, state: int, size: int, items: set[int]) -> int:
        """Adds the short items that end here; the length of the longest."""
        longest, state = 0, self.at_short[state]
        while state >= 0:
            for n, item in self.short[state]:
                if n <= size:
                    items.add(item)
                    longest = max(longest, n)
            state = self.at_short[self.link[state]]
        return longest


def dealt_items(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The distinct items (i, t) and the number of shards they are dealt into."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")) \
        .filter("i is not null and t is not null").distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    return items, max(1, -(-total // shard_bytes))


def automata(items: DataFrame, shards: int, window: int = WINDOW) -> Iterable[Automaton]:
    """One automaton for each shard of the items, in turn; only one shard's items are on the driver at a time."""
    for k in range(shards):
        part = items if shards == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k)
        rows = [(r["i"], words_of(bytes(r["t"]))) for r in part.orderBy("i", "t").collect()]
        yield Automaton([r for r in rows if r[1]], window)


def _numbered(documents: DataFrame) -> DataFrame:
    """``documents`` as a written table with a row number of its own for each row, ``_dc_row``."""
    return settle(documents.withColumn("_dc_row", F.monotonically_increasing_id()))


MATCHES = "n_words bigint, spans array<array<int>>, items array<string>"


def find_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document; spans are [start, end) in words."""
    items, shards = dealt_items(benchmark, shard_bytes)
    if shards > 1:
        documents = _numbered(documents.select("doc_id", "text"))
    key = "doc_id" if shards == 1 else "_dc_row"
    found = []
    for automaton in automata(items, shards, window):
        shared = documents.sparkSession.sparkContext.broadcast(automaton)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterable[pa.RecordBatch]:
            a = shared.value
            for batch in batches:
                counts, spans, items = [], [], []
                for t in batch.column("t"):
                    words = words_of(t.as_py() or b"")
                    at, which = a.match(words)
                    counts.append(len(words))
                    spans.append(at)
                    items.append(sorted({a.names[k] for k in which}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                     pa.array(items, pa.list_(pa.string()))], [key, "n_words", "spans", "items"])

        bare = documents.select(key, F.col("text").cast("binary").alias("t"))
        kind = bare.schema[key].dataType.simpleString()
        found.append(bare.mapInArrow(run, f"{key} {kind}, {MATCHES}"))
    if shards == 1:
        return found[0]
    every = found[0]
    for part in found[1:]:
        every = every.unionAll(part)
    merged = every.groupBy(key).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return documents.select(key, "doc_id").join(merged, key).drop(key)


def hit_words() -> Column:
    """How many words the spans cover; sorted spans of several shards may overlap."""
    zero = F.lit(0).cast("long")
    return F.aggregate("spans", F.struct(zero.alias("n"), zero.alias("end")), lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s[1] - F.greatest(s[0].cast("long"), acc["end"]), zero)).alias("n"),
        F.greatest(acc["end"], s[1].cast("long")).alias("end")), lambda acc: acc["n"])


def cut_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the given spans of words; what stood around a span is parted by a line feed."""
    at = [m.span() for m in _WORD.finditer(text.translate(_TO_WORDS))]
    parts, begin = [], 0
    for start, end in spans:
        parts.append(text[begin:at[start][0]].rstrip())
        begin = at[end - 1][1]
    parts.append(text[begin:].lstrip())
    return b"\n".join(p for p in parts if p)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  max_coverage: float = MAX_COVERAGE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``documents`` without benchmark passages, with the same columns.

    Contaminated spans are cut from the texts, again and again while a cut brings words together that
    match; documents of which they cover more than ``max_coverage`` go. ``n_chars`` follows the text
    where there is such a column. Texts without matches stay byte for byte.
    """
    items, shards = dealt_items(benchmark, shard_bytes)
    if shards > 1:
        return _in_rounds(documents, items, shards, window, max_coverage)
    shared = documents.sparkSession.sparkContext.broadcast(next(iter(automata(items, shards, window))))
    return documents.mapInArrow(_cutter(shared, max_coverage), documents.schema)


def _in_rounds(documents: DataFrame, items: DataFrame, shards: int, window: int, max_coverage: float) -> DataFrame:
    """The same with several shards: the spans of all shards are found on the same text, and then cut at once.

    Coverage is decided in the first round; texts that a round changed go into the next, until no shard matches.
    """
    columns = documents.columns
    whole = _numbered(documents)
    left, changed = whole.select("_dc_row", "text"), []
    while True:
        hits = None
        for automaton in automata(items, shards, window):
            shared = documents.sparkSession.sparkContext.broadcast(automaton)
            part = settle(left.mapInArrow(_spans_of(shared), "_dc_row bigint, spans array<array<int>>"))
            hits = part if hits is None else hits.unionAll(part)
        spans = hits.groupBy("_dc_row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        share = max_coverage if not changed else float("inf")
        cut = settle(left.join(spans, "_dc_row").mapInArrow(_cut_all(share), "_dc_row bigint, _dc_kept boolean, _dc_text string"))
        if cut.isEmpty():
            break
        changed.append(cut.withColumn("_dc_round", F.lit(len(changed))))
        left = cut.filter("_dc_kept").select("_dc_row", F.col("_dc_text").alias("text"))
    if not changed:
        return whole.select(columns)
    every = changed[0]
    for part in changed[1:]:
        every = every.unionAll(part)
    last = every.groupBy("_dc_row").agg(F.max_by(F.struct("_dc_kept", "_dc_text"), "_dc_round").alias("_dc_now"))
    out = whole.join(last, "_dc_row", "left").filter("_dc_now is null or _dc_now._dc_kept") \
        .withColumn("text", F.coalesce("_dc_now._dc_text", "text"))
    if "n_chars" in columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_dc_now").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(columns)


def _spans_of(shared) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            found = [automaton.match(words_of((t.as_py() or "").encode()))[0] for t in batch.column("text")]
            out = pa.RecordBatch.from_arrays([batch.column("_dc_row"), pa.array(found, pa.list_(pa.list_(pa.int32())))],
                                             ["_dc_row", "spans"])
            yield out.filter(pa.array([bool(s) for s in found], pa.bool_()))

    return run


def merged_spans(spans: list[list[int]]) -> list[list[int]]:
    """Sorted spans, with those that overlap or touch made one."""
    out: list[list[int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _cut_all(max_coverage: float) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            kept, texts = [], []
            for t, s in zip(batch.column("text"), batch.column("spans"), strict=True):
                data, spans = t.as_py().encode(), merged_spans(s.as_py())
                kept.append(sum(e - b for b, e in spans) <= max_coverage * len(words_of(data)))
                texts.append(cut_spans(data, spans).decode() if kept[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column("_dc_row"), pa.array(kept, pa.bool_()), pa.array(texts, pa.string())],
                                             ["_dc_row", "_dc_kept", "_dc_text"])

    return run


def _cutter(shared, max_coverage: float) -> Callable:
    def clean(text: str | None, automaton: Automaton) -> tuple[bool, str | None]:
        if text is None:
            return True, text
        data = text.encode()
        words = words_of(data)
        spans, _ = automaton.match(words)
        if not spans:
            return True, text
        if sum(e - s for s, e in spans) > max_coverage * len(words):
            return False, None
        while spans:
            data = cut_spans(data, spans)
            spans, _ = automaton.match(words_of(data))
        return True, data.decode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            got = [clean(t.as_py(), automaton) for t in batch.column("text")]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array([t for _, t in got], columns["text"].type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(
                    [n if a is None or t is None or a == t else len(t) for a, (_, t), n in zip(
                        batch.column("text").to_pylist(), got, columns["n_chars"].to_pylist(), strict=True)],
                    columns["n_chars"].type)
            whole = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            yield whole.filter(pa.array([ok for ok, _ in got], pa.bool_()))

    return run


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), " + _LETTERS + r"), '[0-9a-z\x{80}-\x{10FFFF}]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS g FROM (
    SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hits AS (SELECT doc_id, s, l, item_id FROM dw JOIN win USING (l, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN found ON d.doc_id = found.doc_id"""


@query("op1_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("n_hit", hit_words()).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))
