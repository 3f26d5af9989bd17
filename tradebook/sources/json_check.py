"""Whether JSON files are well formed, whatever their size.

A file is read in pieces between commas, by as many tasks as its blocks. Every chunk of pieces is reduced to
a summary of what it does to the nesting around it: the containers that it closes, and those that it
opens. A chunk does not know in which container, or whether inside a string, it begins, so it is reduced for
both cases, and what happens at each level is a function of the state that the level is entered in. The
small summaries are then put together in file order. Texts are not shuffled, and no file has to fit into a row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.plans.scale import sorted_groups

#: Bytes of a chunk, about.
CHUNK_BYTES = 1 << 20

_INNER = r'[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})'
_TOKENS = re.compile(rf'(?P<s>"(?:{_INNER})*+")|(?P<q>"(?:{_INNER})*+\Z)'
                     r"|(?P<v>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)|(?P<w>[ \t\n\r]+)", re.ASCII)
_INSIDE = re.compile(rf'(?:{_INNER})*+("|\Z)')
_FLAT = re.compile(r"\{(?:s:[sv](?:,s:[sv])*+)?\}|\[(?:[sv](?:,[sv])*+)?\]")

# States of a level: what may come next. "T" and "D" are the root before and after its value.
_STEP = {
    "T": {"v": "D", "s": "D"}, "D": {},
    "o": {"s": "k"}, "k": {":": "c"}, "c": {"v": "m", "s": "m"}, "m": {",": "n"}, "n": {"s": "k"},     # objects
    "a": {"v": "e", "s": "e"}, "e": {",": "f"}, "f": {"v": "e", "s": "e"},                              # arrays
}
_STATES = "".join(_STEP)
_MAY_CLOSE = {"}": "om", "]": "ae"}
_MARKS = {ord(c): None for c in "{}[],:sv"}


def tokens(text: str, inside: bool) -> tuple[str, bool] | None:
    """Tokens of a chunk, entered inside a string or not, and whether it ends inside one; None for a bad one.

    ``s`` and ``v`` are strings and other values; a string counts where it ends. Flat containers count as values.
    """
    begin = ""
    if inside:
        m = _INSIDE.match(text)
        if not m:
            return None
        if not m.group(1):
            return "", True
        begin, text = "s", text[m.end():]
    ends_inside = False

    def short(m: re.Match) -> str:
        nonlocal ends_inside
        if m.lastgroup == "q":
            ends_inside = True
        return "" if m.lastgroup in "qw" else m.lastgroup

    out = begin + _TOKENS.sub(short, text)
    if out.translate(_MARKS):
        return None
    # the first container may be the root, whose kind and items are wanted: its begin is kept apart
    first, out = out[:1], out[1:]
    while True:
        less, n = _FLAT.subn("v", out)
        if not n:
            return first + out, ends_inside
        out = less


def _apply(level: str, token: str) -> str:
    """A level's function, as the state it leads to from each state ("-": an error), after one more token."""
    return "".join(_STEP[state].get(token, "-") if state != "-" else "-" for state in level)


def reduce_chunk(text: str, inside: bool) -> dict | None:
    """What a chunk does: levels it closes (function before it, closing mark), the level it ends in, levels it opens.

    Items are counted for every level, as members (colons) and as values. ``whole`` is the first container that
    begins and ends in the chunk with none around it: the root, if the file begins with it.
    """
    found = tokens(text, inside)
    if found is None:
        return None
    marks, ends_inside = found
    closes, opened, whole, level = [], [], None, [_STATES, 0, 0]    # the level entered: a function; opened ones: a state
    for mark in marks:
        here = opened[-1] if opened else level
        if mark in "{[":
            here[0], here[2] = _apply(here[0], "v"), here[2] + 1
            if not here[0].strip("-"):
                return None
            opened.append(["o" if mark == "{" else "a", 0, 0])
        elif mark in "}]":
            if opened:
                state, members, values = opened.pop()
                if state not in _MAY_CLOSE[mark]:
                    return None
                if not opened and whole is None:
                    whole = _root(mark, members, values)
            else:
                closes.append([*level, mark])
                # what is outside has had its value when the container opened
                level = [_STATES, 0, 0]
        else:
            here[0] = _apply(here[0], mark)
            if not here[0].strip("-"):
                return None
            if mark == ":":
                here[1] += 1
            elif mark in "sv":
                here[2] += 1
    return {"closes": closes, "level": level, "opened": opened, "inside": ends_inside, "whole": whole}


def _root(mark: str, members: int, values: int) -> tuple[str, int]:
    return ("{", members) if mark == "}" else ("[", values)


def fold(summaries: Iterable[list]) -> tuple[str | None, int]:
    """Root and number of its items (members of an object, values of an array) of a file's summaries in order.

    The root is ``{``, ``[`` or ``v`` (any other value); None for a file that is not well formed.
    """
    stack: list[list] = [["T", 0, 0]]
    root, items, inside = "v", 0, False
    for outside_case, inside_case in summaries:
        now = inside_case if inside else outside_case
        if now is None:
            return None, 0

        def enter(level: list) -> bool:
            top = stack[-1]
            top[0] = level[0][_STATES.index(top[0])]
            top[1] += level[1]
            top[2] += level[2]
            return top[0] != "-"

        for *level, mark in now["closes"]:
            if not enter(level) or stack[-1][0] not in _MAY_CLOSE[mark] or len(stack) == 1:
                return None, 0
            _, members, values = stack.pop()
            if len(stack) == 1:
                root, items = _root(mark, members, values)
        if stack[0][0] == "T" and now["whole"]:
            root, items = now["whole"]
        if not enter(now["level"]):
            return None, 0
        stack += [list(level) for level in now["opened"]]
        inside = now["inside"]
    return (root, items) if not inside and len(stack) == 1 and stack[0][0] == "D" else (None, 0)


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """One row for each chunk of a block: its place, its pieces and bytes, and its two summaries."""
    key, held, size, number = None, [], 0, 0

    def close() -> pa.RecordBatch:
        # the comma before a piece belongs to it; only a file's first piece has none
        data = b",".join(held)
        text = (b"" if key[1] == 0 and number == 0 else b",") + data
        try:
            decoded = text.decode("utf-8")
            both = [reduce_chunk(decoded, case) for case in (False, True)]
        except UnicodeDecodeError:
            both = [None, None]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([number], pa.int64()),
             pa.array([len(held)], pa.int64()), pa.array([len(data) + 1], pa.int64()), pa.array([json.dumps(both)])],
            ["path", "block", "number", "pieces", "bytes", "summary"])

    for batch in batches:
        for path, block, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (path, block) != key or size > CHUNK_BYTES:
                if held:
                    yield close()
                number = 0 if (path, block) != key else number + 1
                key, held, size = (path, block), [], 0
            held.append(value)
            size += len(value) + 1
    if held:
        yield close()


def json_roots(spark: SparkSession, path: str) -> DataFrame:
    """(path, root, items) of each file: root ``{``, ``[``, ``v``, or null where the JSON is not well formed."""
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary"))
    chunks = pieces.mapInArrow(_summaries, "path string, block bigint, number bigint, pieces bigint, bytes bigint, summary string")

    def whole(_key: tuple, columns: list) -> tuple:
        root, items = fold(json.loads(s) for s in columns[2])
        return root, items, sum(columns[3])

    folded = sorted_groups(chunks, ["path"], ["block", "number"], ["block", "number", "summary", "bytes"], whole,
                           "root string, items bigint, read bigint")
    files = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    # the reader drops a comma at the very end and a byte-order mark: both are errors
    lost = F.col("size") - F.col("read") + 1
    return files.join(folded, "path", "left").select(
        "path", F.when(~F.coalesce(lost, F.lit(0)).isin(1, 3, 4), F.col("root")).alias("root"), "items")
