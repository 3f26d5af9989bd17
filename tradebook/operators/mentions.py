"""Names inside texts: one automaton over all names, texts walked once and never shuffled."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.session import settle

#: Letters of names in one automaton. A letter takes about 35 bytes of it (measured with random names,
#: the worst case: 1.85 million letters 62 MB), so each Python worker holds about 70 MB.
SHARD_LETTERS = 2_000_000

_HELD: dict[str, tuple] = {}        # the automaton of the shard this worker read last


def _automaton(shard) -> tuple:
    """(automaton, spellings) of a broadcast shard, built once for each worker."""
    if shard.value["mark"] not in _HELD:
        _HELD.clear()
        machine, spellings = ahocorasick.Automaton(), shard.value["names"]
        for k, (low, _) in enumerate(spellings):
            machine.add_word(low, k)
        machine.make_automaton()
        _HELD[shard.value["mark"]] = machine, [own for _, own in spellings]
    return _HELD[shard.value["mark"]]


def _shards(names: DataFrame, name: str, letters: int) -> Iterable[list[tuple[str, list[str]]]]:
    """The distinct names by their lower-case form, in parts of about ``letters`` letters."""
    low = settle(names.select(F.col(name).alias("own")).filter(F.length("own") > 0).distinct()
                 .groupBy(F.lower("own").alias("low")).agg(F.sort_array(F.collect_list("own")).alias("own")))
    size = low.agg(F.coalesce(F.sum(F.length("low")), F.lit(0)).alias("n")).collect()[0]["n"]
    parts = -(-size // letters)
    part = F.pmod(F.xxhash64("low"), F.lit(max(parts, 1)))
    for k in range(parts):
        # about SHARD_LETTERS letters at a time on the driver
        names_of = [(r["low"], r["own"]) for r in low.filter(part == k).collect()]
        if names_of:
            yield names_of


def with_mentions(texts: DataFrame, body: str, names: DataFrame, name: str, out: str, keep: list[str],
                  letters: int = SHARD_LETTERS) -> DataFrame:
    """The columns ``keep`` of the texts that contain a name, ignoring case, and in ``out`` the names found.

    All names form a multi-pattern automaton, which is broadcast; each text is walked once with it, in the task
    that scans it. Names beyond ``letters`` letters are dealt into several automata by a hash: then a text
    is walked once with each, and has a row for each that finds names. Finds are exact: lower-case
    text against lower-case names, both as Spark writes them.
    """
    spark = texts.sparkSession
    low = "_low"
    while low in texts.columns:
        low += "_"
    bare = texts.select(*keep, F.lower(body).alias(low))
    schema = T.StructType([*[bare.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.StringType()))])

    def walk(shard):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            machine, spellings = _automaton(shard)
            for batch in batches:
                rows, found = [], []
                for k, text in enumerate(batch.column(len(keep))):
                    hits = {at for _, at in machine.iter(text.as_py())} if text.is_valid else ()
                    if hits:
                        rows.append(k)
                        found.append([own for at in sorted(hits) for own in spellings[at]])
                taken = pa.array(np.array(rows, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(taken) for c in batch.columns[:-1]], pa.array(found, pa.list_(pa.string()))], [*keep, out])
        return run

    result = None
    for part in _shards(names, name, letters):
        shard = spark.sparkContext.broadcast({"mark": uuid.uuid4().hex, "names": part})
        rows = bare.mapInArrow(walk(shard), schema)
        result = rows if result is None else result.unionAll(rows)
    return spark.createDataFrame([], schema) if result is None else result


def name_mentions(texts: DataFrame, key: str, body: str, names: DataFrame, name: str = "business_name",
                  letters: int = SHARD_LETTERS) -> DataFrame:
    """Distinct (key, name) pairs where a text of the key contains the name, ignoring case."""
    found = with_mentions(texts, body, names, name, "_names", [key], letters)
    return found.select(key, F.explode("_names").alias(name)).distinct()
