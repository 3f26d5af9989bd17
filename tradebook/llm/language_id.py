"""Language identification with error-correcting output codes.

Every language has a code word of bits. One binary classifier for each bit (logistic weights over
hashed byte n-grams, fitted on labelled texts) gives a real-valued answer for a text; the code word
with the smallest loss, weighted by how sure each classifier was in training, wins. Answers whose
best two code words lie close together are flagged as ambiguous.

The model is a table of ``BUCKETS`` x bits floats, whatever the size of the corpus. Texts are scored
whole, Arrow batch by batch; nothing is shuffled.

Null texts and texts without a letter: ``und``, score 0. With fewer than two languages to learn from,
every text with a letter gets the only language (score 1), or ``und`` where there is none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.llm.common import fold, query, table, unit

#: Texts to learn from for each language, at most (about).
SAMPLE_PER_LANGUAGE = 200
BUCKETS = 1 << 15
#: Below this lead of the best code word over the second, as a share of their losses, a text is ambiguous.
AMBIGUOUS = 0.05
UNKNOWN = "und"

_GRAMS = (1, 2, 3)
_MIX = np.uint32(2654435761)
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[48:58] = 48


def gram_buckets(text: bytes) -> np.ndarray:
    """The bucket of every byte n-gram of the text, A-Z folded, white space as blanks, digits alike."""
    b = _FOLD[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    out = []
    for n in _GRAMS:
        if len(b) >= n:
            key = np.full(len(b) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                key = key * np.uint32(257) + b[k:len(b) - n + 1 + k]
            out.append((key * _MIX) >> np.uint32(17))
    return np.concatenate(out)


def code_words(count: int) -> np.ndarray:
    """One row of -1/+1 bits for each of ``count`` classes.

    Up to seven classes every split of the classes is a bit (exhaustive code); for more, 10 log2(count)
    bits are drawn with a fixed seed, the best of 50 drawings by the smallest distance between rows.
    """
    if count <= 7:
        splits = [(1,) + rest for rest in itertools.product((1, -1), repeat=count - 1) if -1 in rest]
        return np.array(splits, dtype=np.float64).T
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(count)))
    best, apart = None, -1.0
    for _ in range(50):
        drawn = rng.choice((-1.0, 1.0), size=(count, bits))
        least = min(np.sum(drawn[i] != drawn[j]) for i in range(count) for j in range(i))
        if least > apart and (np.abs(drawn.sum(axis=0)) < count).all():
            best, apart = drawn, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray        # languages x bits
    weights: np.ndarray     # buckets x bits, to be averaged over the n-grams of a text
    bias: np.ndarray        # bits
    sure: np.ndarray        # weight of each bit in the decoding

    def decode(self, text: bytes) -> tuple[str, float, bool]:
        """Language, score and whether the answer is ambiguous."""
        if len(self.languages) < 2:
            return (self.languages[0], 1.0, False) if self.languages else (UNKNOWN, 0.0, True)
        rows = self.weights[gram_buckets(text)]
        margin = (np.ones(len(rows), np.float32) @ rows).astype(np.float64) / len(rows) + self.bias
        loss = (np.logaddexp(0, -self.code * margin) * self.sure).sum(axis=1) / self.sure.sum()
        order = np.argsort(loss, kind="stable")
        best, second = loss[order[0]], loss[order[1]]
        odds = np.exp(-(loss - best) * len(self.sure))
        return self.languages[order[0]], float(1 / odds.sum()), bool(second - best < AMBIGUOUS * (second + best))


def fit(texts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], steps: int = 40) -> Model:
    """Binary logistic classifiers on n-gram shares, one for each bit, fitted together by Adam steps.

    A text is given as its distinct buckets and their counts.
    """
    languages = sorted(set(langs))
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    code = code_words(len(languages))
    which = np.array([languages.index(x) for x in langs])
    y = code[which]                                              # texts x bits
    rows, cols, vals = [], [], []
    for k, (found, n) in enumerate(texts):
        rows.append(np.full(len(found), k))
        cols.append(found)
        vals.append(n / n.sum())
    row, col, val = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    used, at = np.unique(col, return_inverse=True)
    scale = np.zeros(len(used))
    np.add.at(scale, at, val ** 2)
    scale = 1 / np.sqrt(scale / len(texts) + 1e-8)               # common and rare n-grams get a like range
    val = val * scale[at]
    balance = (1 / np.bincount(which))[which][:, None] * len(texts) / len(languages)
    x = _Sparse(row, at, val, len(texts), len(used))
    w, bias = np.zeros((len(used), code.shape[1])), np.zeros(code.shape[1])
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(bias), np.zeros_like(bias)]
    for step in range(1, steps + 1):
        margin = x.dot(w) + bias
        slope = -y * balance / (1 + np.exp(np.clip(y * margin, -30, 30))) / len(texts)
        for p, g, a, b in ((w, x.tdot(slope) + 1e-5 * w, 0, 1), (bias, slope.sum(axis=0), 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.99 * moments[b] + 0.01 * g * g
            p -= 0.05 * (moments[a] / (1 - 0.9 ** step)) / (np.sqrt(moments[b] / (1 - 0.99 ** step)) + 1e-8)
    margin = y * (x.dot(w) + bias)
    sure = np.clip(1 - np.mean(np.logaddexp(0, -margin), axis=0) / np.log(2), 0.05, 1)
    weights = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32)
    weights[used] = w * scale[:, None]
    return Model(languages, code, weights, bias, sure)


class _Sparse:
    """Rows x columns with products by summing over sorted entries."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, m: int):
        self.shape, self.by_row = (n, m), (row, col, val)
        self.starts = np.searchsorted(row, np.arange(n))
        order = np.argsort(col, kind="stable")
        self.by_col = (row[order], col[order], val[order])
        self.col_starts = np.searchsorted(col[order], np.arange(m))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(w[self.by_row[1], k] * self.by_row[2], self.starts)
                         for k in range(w.shape[1])], axis=1)

    def tdot(self, s: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(s[self.by_col[0], k] * self.by_col[2], self.col_starts)
                         for k in range(s.shape[1])], axis=1)


def learn(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the rows of ``documents`` with a language; ``doc_id`` only picks the sample."""
    known = documents.select("doc_id", "text", "lang").filter("text is not null and lang is not null") \
        .filter(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    if not counts:
        return fit([], [])
    chosen = known.filter(unit("language", F.col("doc_id")) < share).select(F.col("text").cast("binary").alias("t"), "lang")
    rows = chosen.mapInArrow(_counted, "lang string, bucket array<int>, n array<int>").collect()
    rows.sort(key=lambda r: (r["lang"], r["bucket"], r["n"]))
    return fit([(np.array(r["bucket"]), np.array(r["n"])) for r in rows], [r["lang"] for r in rows])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The n-gram counts of whole texts: at most ``BUCKETS`` numbers for each."""
    for batch in batches:
        found = [np.unique(gram_buckets(t.as_py()), return_counts=True) for t in batch.column("t")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), *[pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1)]],
            ["lang", "bucket", "n"])


def identify(documents: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``ambiguous`` (named with ``prefix``)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    added = [pa.field(prefix + "lang_pred", pa.string()), pa.field(prefix + "score", pa.float64()),
             pa.field(prefix + "ambiguous", pa.bool_())]
    bare = documents.withColumns({"_li_text": F.coalesce(F.col("text").cast("binary"), F.lit(b"")),
                                  "_li_letter": F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, letter = batch.column("_li_text"), batch.column("_li_letter").to_pylist()
            got = [m.decode(t.as_py()) if ok else (UNKNOWN, 0.0, True) for t, ok in zip(texts, letter, strict=True)]
            keep = [k for k, name in enumerate(batch.schema.names) if not name.startswith("_li_")]
            columns = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], *[pa.array(c, f.type) for c, f in zip(columns, added, strict=True)]],
                [*[batch.schema.names[k] for k in keep], *[f.name for f in added]])

    kinds = {"string": T.StringType(), "double": T.DoubleType(), "bool": T.BooleanType()}
    fields = [T.StructField(f.name, kinds[str(f.type)]) for f in added]
    return bare.mapInArrow(run, T.StructType([*documents.schema.fields, *fields]))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    model = learn(documents.filter(~held))
    out = identify(documents.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told: no letter, or the best two code words lie too close."""
    told = identify(docs, learn(docs), "_li2_")
    return told.filter((F.col("_li2_lang_pred") != UNKNOWN) & ~F.col("_li2_ambiguous")).select(*docs.columns)
