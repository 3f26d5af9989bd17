"""Toxicity with a linear-chain conditional random field over words.

Two states, plain and toxic. A word's features are itself and its beginnings of four to nine letters.
Token labels come from document labels: in toxic documents, words with a feature that is bound to toxic
documents far beyond chance are toxic, everything else is plain. The field is fitted on windows of such
tokens; forward-backward marginals give every word its probability, and a document's score is the
probability that one word at least is toxic. Spans are the words above one half, with their offsets.

Only words that carry a learned feature differ from one another for the field. The stretches between
them are powers of one 2 x 2 matrix, so a text is scored exactly in time that grows with its words, and
in memory that grows with the longest single text.

Learning reads ``SAMPLE_ROWS`` labelled texts at most. Copies teach once: of texts that share the
smallest hash of their three-word shingles one is used. Null and empty texts have no words and score as
a text without learned words does. Without labelled rows of both kinds the score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import bounded_sample, fold, query, table
from tradebook.session import settle

#: Labelled texts to learn from, and windows of tokens to fit on, at most.
SAMPLE_ROWS, FIT_WINDOWS, WINDOW = 20_000, 12_000, 24
#: Features kept at most, those bound most strongly to toxic texts.
MAX_FEATURES = 20_000
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6, 7, 8, 9)

#: Letters of a lower-cased text; everything in ASCII but a-z parts words.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


def features_of(word: bytes) -> list[str]:
    w = word.decode()
    return ["=" + w, *[w[:k] for k in BEGINNINGS if len(w) > k]]


@dataclass
class Field:
    """Weights of the toxic state; the plain state's emissions are 0."""
    weight: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    start: tuple[float, float] = (0.0, 0.0)
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def marginals(self, words: list[bytes], memo: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words with learned features, and their probability of being toxic."""
        scores = np.array([memo[w] for w in words]) if words else np.zeros(0)
        active = np.flatnonzero(scores != 0)
        if not len(active):
            return active, np.zeros(0)
        plain = np.exp(self.move) * np.array([1.0, np.exp(self.bias)])       # one step onto a word without features
        first = np.exp(self.start) * np.array([1.0, np.exp(self.bias + (scores[0] if active[0] == 0 else 0.0))])
        a, at, alphas = first / first.sum(), 0, []
        for p in active.tolist():
            if p > at:
                a = a @ _power(plain, p - at - 1) @ (np.exp(self.move) * np.array([1.0, np.exp(self.bias + scores[p])]))
                a, at = a / a.sum(), p
            alphas.append(a)
        b, at, betas = np.ones(2), len(words) - 1, []
        for p in active[::-1].tolist():
            b = _power(plain, at - p) @ b if not betas else \
                _power(plain, at - p - 1) @ (np.exp(self.move) * np.array([1.0, np.exp(self.bias + scores[at])])) @ b
            b, at = b / b.sum(), p
            betas.append(b)
        both = np.array(alphas) * np.array(betas[::-1])
        return active, both[:, 1] / both.sum(axis=1)


class _Memo(dict):
    """Scores of words, computed once each; emptied before it outgrows a million words."""

    def __init__(self, weight: dict[str, float]):
        super().__init__()
        self.weight = weight

    def __missing__(self, word: bytes) -> float:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = sum(self.weight.get(f, 0.0) for f in features_of(word))
        return value


def _power(m: np.ndarray, n: int) -> np.ndarray:
    """m to the power n, scaled (only ratios matter here)."""
    out = np.eye(2)
    while n:
        if n & 1:
            out = out @ m
            out /= out.sum()
        m = m @ m
        m /= m.sum()
        n >>= 1
    return out


def _signature(words: list[bytes]) -> int:
    return min((hash_of(b" ".join(words[k:k + 3])) for k in range(max(len(words) - 2, 1))), default=0)


def hash_of(data: bytes) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(data) >> 1


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, toxic, clean): labelled texts that hold the feature, counted in the tasks first."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                held = {f for w in set(words_of(text)) for f in features_of(w)}
                for f in held:
                    counts.setdefault(f, [0, 0])[1 - label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)]],
                ["feature", "toxic", "clean"])

    return rows.select("text", "label").mapInArrow(run, "feature string, toxic bigint, clean bigint") \
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _one_of_copies(rows: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sign = [_signature(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sign, pa.int64())], [*batch.schema.names, "sign"])

    return settle(rows.mapInArrow(run, "text string, label int, sign bigint").groupBy("sign", "label")
                  .agg(F.min("text").alias("text")).select("text", "label"))


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """Fit the field on the texts of ``documents`` that ``labels`` (doc_id, toxic) marks."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)") \
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = bounded_sample(marked, F.col("doc_id"), sample_rows, "labels:toxic")
    rows = _one_of_copies(documents.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id")
                          .select("text", "label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Field()
    share, n = toxic / (toxic + clean), F.col("toxic") + F.col("clean")
    # bound beyond chance: half of the texts with the feature are toxic, and a like split among texts drawn at
    # random is less likely than e^-12 (the likelihood ratio of its share against the share of toxic texts)
    beyond = F.col("toxic") * F.log(F.col("toxic") / n / F.lit(share)) \
        + F.col("clean") * F.log((F.col("clean") + 1e-9) / n / F.lit(1 - share))
    bound = feature_counts(rows).filter((F.col("toxic") >= F.col("clean")) & (beyond > 12)) \
        .orderBy(beyond.desc(), "feature").limit(MAX_FEATURES).collect()
    return fit(rows, {r["feature"] for r in bound})


def fit(rows: DataFrame, bound: set[str], steps: int = 120) -> Field:
    """Maximise the likelihood of token labels over windows, a bounded number of them."""
    if not bound:
        return Field()
    names = {f: k for k, f in enumerate(sorted(bound), 1)}
    share = min(1.0, FIT_WINDOWS / max(1, rows.count() * 8))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        # all windows with a learned feature, and a hashed share of the others
        for batch in batches:
            out = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = words_of(text)
                for begin in range(0, len(words), WINDOW):
                    part = words[begin:begin + WINDOW]
                    ids = [[names[f] for f in features_of(w) if f in names] for w in part]
                    h = hash_of(b" ".join(part))
                    if any(ids) or h % 1_000_000 < share * 1_000_000:
                        out.append((label, h, ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.list_(pa.list_(pa.int32())))], ["label", "h", "ids"])

    windows = rows.mapInArrow(run, "label int, h bigint, ids array<array<int>>").orderBy("h", "label").limit(FIT_WINDOWS).collect()
    longest = max(len(r["ids"]) for r in windows)
    n, k = len(windows), 1 + len(BEGINNINGS)
    x, length = np.zeros((n, longest, k), np.int64), np.array([len(r["ids"]) for r in windows])
    for a, r in enumerate(windows):
        for b, held in enumerate(r["ids"]):
            x[a, b, :len(held)] = held
    inside = np.arange(longest) < length[:, None]
    y = ((x > 0).any(axis=2) & (np.array([r["label"] for r in windows]) == 1)[:, None]).astype(np.int64)
    w, rest = np.zeros(len(names) + 1), np.zeros(7)          # bias, start, moves
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(rest), np.zeros_like(rest)]
    gold_w = np.zeros_like(w)
    np.add.at(gold_w, x.ravel(), np.repeat((y * inside).ravel(), k))
    gold = np.zeros(7)
    gold[0] = (y * inside).sum()
    gold[1:3] = np.bincount(y[:, 0], minlength=2)
    gold[3:] = np.bincount((2 * y[:, :-1] + y[:, 1:])[inside[:, 1:]], minlength=4)
    for step in range(1, steps + 1):
        w[0] = 0.0
        node, edge = _expected(w[x].sum(axis=2) + rest[0], rest[1:3], rest[3:].reshape(2, 2), inside)
        slope_w = np.zeros_like(w)
        np.add.at(slope_w, x.ravel(), np.repeat(node.ravel(), k))
        first = node[:, 0]
        slope = np.concatenate(([node.sum()], [(1 - first).sum(), first.sum()], edge.ravel()))
        for p, g, a, b in ((w, (slope_w - gold_w) / n + 2e-5 * w, 0, 1), (rest, (slope - gold) / n + 2e-5 * rest, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.99 * moments[b] + 0.01 * g * g
            p -= 0.15 * (moments[a] / (1 - 0.9 ** step)) / (np.sqrt(moments[b] / (1 - 0.99 ** step)) + 1e-9)
    return Field({f: float(w[i]) for f, i in names.items() if w[i] != 0}, float(rest[0]), (float(rest[1]), float(rest[2])),
                 rest[3:].reshape(2, 2).copy())


def _expected(score: np.ndarray, start: np.ndarray, move: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many windows at once: toxic marginals and expected moves."""
    n, length = score.shape
    emit = np.stack((np.ones_like(score), np.exp(np.clip(score, -40, 40))), axis=2)
    m = np.exp(move)
    alpha, beta = np.zeros((n, length, 2)), np.ones((n, length, 2))
    a = np.exp(start) * emit[:, 0]
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ m) * emit[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (beta[:, t + 1] * emit[:, t + 1]) @ m.T
        beta[:, t] = np.where(inside[:, t + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
    both = alpha * beta
    node = both[:, :, 1] / both.sum(axis=2) * inside
    pair = alpha[:, :-1, :, None] * m * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair = pair / pair.sum(axis=(2, 3), keepdims=True) * inside[:, 1:, None, None]
    return node, pair.sum(axis=(0, 1))


def tag(documents: DataFrame, model: Field, prefix: str = "") -> DataFrame:
    """``doc_id`` with ``score`` and ``spans`` (start, end, probability; offsets in code points)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def spans_of(text: str, at: np.ndarray, p: np.ndarray) -> list[dict]:
        low = text.lower()
        if len(low) != len(text):       # some letters have a lower-case form of other length
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        data = low.encode().translate(_LETTERS)
        found = [m.span() for m in _WORD.finditer(data)]
        out = []
        for k, q in zip(at.tolist(), p.tolist(), strict=True):
            if q > 0.5 and k < len(found):
                start = len(data[:found[k][0]].decode())
                out.append({"start": start, "end": start + len(data[found[k][0]:found[k][1]].decode()), "p": q})
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        m = shared.value
        memo = _Memo(m.weight)
        for batch in batches:
            scores, spans = [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                at, p = m.marginals(words_of(text), memo)
                scores.append(float(1 - np.prod(1 - p)))
                spans.append(spans_of(text, at, p) if len(at) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(
                spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))],
                ["doc_id", "score", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, spans array<struct<start: int, end: int, p: double>>")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(documents, labels.filter(fold(F.col("doc_id"), 4) != 2))
    return tag(documents, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
