"""Token counts of greedy longest-match word pieces, without building the pieces.

The vocabulary is a trie. Each node knows how many tokens greedy matching has certainly produced when
the next character does not continue it (``popped``), and the node where the rest of what was read stands
(``fail``). Reading a word then costs one step a character, however long the pieces are, and the count
is a sum of precomputed numbers.

Texts are split at white space; a word is matched as the marker for "begin of a word" plus its
characters, pieces inside a word have no marker. A character that no piece begins with or that stands
alone without a piece counts as its UTF-8 bytes (byte tokens). Counts of words are kept in a bounded
memo in each worker, so common words are read once. The vocabulary file is a parameter; its trie is
broadcast after a check of its size.

Null and empty texts have no words and no tokens. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import query, table

#: The public vocabulary of the query, its marker for the begin of a word, and the most pieces a broadcast may have.
VOCABULARY, MARKER, MAX_PIECES = "/opt/tokenizers/piece_bpe_32k.model", "▁", 1_000_000
MEMO_WORDS = 1_000_000


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model (no control, unknown or byte pieces)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size())
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]


class LongestMatch:
    """The automaton: count(word) is the number of tokens of greedy longest matching."""

    def __init__(self, pieces: Iterable[str]):
        known = {p for p in pieces if p}
        if len(known) > MAX_PIECES:
            raise ValueError(f"{len(known)} pieces; a broadcast vocabulary has {MAX_PIECES} at most")
        # a character of the trie that is no piece itself costs its bytes: every node then has a way on
        cost = {c: len(c.encode()) for p in known for c in p} | {p: 1 for p in known}
        self.step: list[dict[str, int]] = [{}]
        weight = [0]
        for piece, tokens in cost.items():
            node = 0
            for c in piece:
                if c not in self.step[node]:
                    self.step[node][c] = len(self.step)
                    self.step.append({})
                    weight.append(0)
                node = self.step[node][c]
            weight[node] = tokens
        self.fail, self.popped = [0] * len(self.step), [0] * len(self.step)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.step[u].items():
                    below.append(v)
                    if weight[v]:
                        self.fail[v], self.popped[v] = 0, weight[v]
                        continue
                    at, popped = self.fail[u], self.popped[u]
                    while c not in self.step[at]:
                        popped += self.popped[at]
                        at = self.fail[at]
                    self.fail[v], self.popped[v] = self.step[at][c], popped
            level = below

    def count(self, word: str) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        node = tokens = 0
        for c in word:
            while node and c not in step[node]:
                tokens += popped[node]
                node = fail[node]
            if c in step[node]:
                node = step[node][c]
            else:
                tokens += len(c.encode())
        while node:
            tokens += popped[node]
            node = fail[node]
        return tokens


class _Memo(dict):
    def __init__(self, automaton: LongestMatch, marker: str):
        super().__init__()
        self.automaton, self.marker = automaton, marker

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = self.automaton.count(self.marker + word.decode())
        return value


def count_tokens(documents: DataFrame, pieces: Iterable[str], marker: str = MARKER) -> DataFrame:
    """(doc_id, n_words, n_bytes, n_tokens) of every document's whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(LongestMatch(pieces))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        memo = _Memo(shared.value, marker)
        for batch in batches:
            words, size, tokens = [], [], []
            for t in batch.column("t"):
                data = t.as_py() or b""
                split = data.split()
                words.append(len(split))
                size.append(len(data))
                tokens.append(sum(map(memo.__getitem__, split)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (words, size, tokens)]],
                ["doc_id", "n_words", "n_bytes", "n_tokens"])

    bare = documents.select("doc_id", F.col("text").cast("binary").alias("t"))
    kind = bare.schema["doc_id"].dataType.simpleString()
    return bare.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_bytes bigint, n_tokens bigint")


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_pieces(vocabulary))
